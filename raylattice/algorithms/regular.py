"""Total-variation steps on volumes.

Slices meet their neighbours by a join on k - 1 and k + 1. Descent needs a global norm in every step, so a volume of
at most ``WHOLE_BYTES`` runs all steps in one task; a larger one runs a join and an aggregate per step. The denoising
model has no global term: larger volumes are cut into slabs with as many slices of overlap as steps, which is exact.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from raylattice.operators.fields import FIELD, WHOLE_BYTES, Field, as_table


def gradient(x: np.ndarray, eps: float = 1e-8, delta: float | None = None) -> np.ndarray:
    """Gradient of the total variation of a (z, y, x) array by backward differences."""
    d = [np.diff(x, axis=a, prepend=np.take(x, [0], axis=a)) for a in range(3)]
    if delta is not None:
        d = [k * np.exp(-((k / delta) ** 2)) for k in d]
    size = np.sqrt(sum(k * k for k in d) + eps)
    out = sum(d) / size
    for a, k in enumerate(d):
        q = k / size
        out -= np.concatenate([np.take(q, range(1, q.shape[a]), axis=a), np.zeros_like(np.take(q, [0], axis=a))], axis=a)
    return out


def whole(x: Field, shape: tuple[int, int, int], run: Callable[[np.ndarray], np.ndarray], *others: Field) -> Field:
    """``run`` on the whole volume in one task; raises ValueError beyond ``WHOLE_BYTES``."""
    if 8 * int(np.prod(shape)) > WHOLE_BYTES:
        raise ValueError(f"a volume of {shape} is too large for one task")
    parts, count = x.df.withColumn("i", F.lit(0)), len(others) + 1
    for i, o in enumerate(others, 1):
        parts = parts.unionByName(o.df.withColumn("i", F.lit(i)))

    def work(table: pa.Table) -> pa.Table:
        i, k = table["i"].to_numpy(), table["k"].to_numpy()
        data = np.array(table["data"].to_pylist(), float)
        volumes = [data[i == n][np.argsort(k[i == n])].reshape(shape) for n in range(count)]
        return pa.Table.from_batches([as_table(list(range(shape[0])), run(*volumes).reshape(shape[0], -1))])

    return Field(parts.withColumn("all_", F.lit(0)).groupBy("all_").applyInArrow(work, FIELD))


def local(x: Field, other: Field, shape: tuple[int, int, int], run: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> Field:
    """``run`` of two volumes slice by slice, where a slice of its result depends on that slice and its neighbours."""
    both = x.df.join(other.df.withColumnRenamed("data", "other"), "k").select("k", F.struct("data", "other").alias("s"))
    before = both.select((F.col("k") + 1).alias("k"), F.col("s").alias("before"))
    after = both.select((F.col("k") - 1).alias("k"), F.col("s").alias("after"))
    rows = both.join(before, "k", "left").join(after, "k", "left")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                there = [r[c] for c in ("before", "s", "after") if r[c] is not None]
                a, o = (np.array([t[c] for t in there], float).reshape(-1, *shape[1:]) for c in ("data", "other"))
                yield as_table([r["k"]], run(a, o)[1 if r["before"] is not None else 0].reshape(1, -1))

    return Field(rows.mapInArrow(work, FIELD))


def gradient_field(x: Field, shape: tuple[int, int, int], eps: float, delta: float | None) -> Field:
    """``gradient`` slice by slice, each with its neighbours."""
    area = shape[1:]
    before = x.df.select((F.col("k") + 1).alias("k"), F.col("data").alias("before"))
    after = x.df.select((F.col("k") - 1).alias("k"), F.col("data").alias("after"))
    rows = x.df.join(before, "k", "left").join(after, "k", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                there = [np.array(r[c], float).reshape(area) for c in ("before", "data", "after") if r[c] is not None]
                g = gradient(np.stack(there), eps, delta)
                # Within the stack the slice's own value only depends on its two neighbours; a border repeats itself.
                yield as_table([r["k"]], g[1 if r["before"] is not None else 0].reshape(1, -1))

    return Field(rows.mapInArrow(run, FIELD))


def descend(x: Field, shape: tuple[int, int, int], alpha: float, steps: int, delta: float | None = None, prior: Field | None = None, share: float = 0.0, whole_bytes: int = WHOLE_BYTES) -> Field:
    """``steps`` of x - alpha g / ‖g‖ with g the gradient of the total variation (adaptive with ``delta``); with a
    ``prior``, (1 - share) of it plus share times that of x - prior."""
    eps = 1e-8 if prior is None else 1e-6

    def steepest(v: np.ndarray, p: np.ndarray | None = None) -> np.ndarray:
        for _ in range(steps):
            g = gradient(v, eps, delta)
            if p is not None:
                g = (1 - share) * g + share * gradient(v - p, eps, delta)
            v = v - alpha * g / np.sqrt((g * g).sum() + 1e-7)
        return v

    if 8 * int(np.prod(shape)) <= whole_bytes:
        return whole(x, shape, steepest, *([prior] if prior is not None else [])).done()
    for _ in range(steps):
        g = gradient_field(x, shape, eps, delta)
        if prior is not None:
            g = g * (1 - share) + gradient_field(x - prior, shape, eps, delta) * share
        g = g.done()
        x = x.plus(-alpha / np.sqrt(g.dot(g) + 1e-7), g).done()
    return x


def rof(f: np.ndarray, weight: float, steps: int) -> np.ndarray:
    """Primal-dual denoising with the step sizes tau2 = 0.3 + 0.02 i and tau1 = (1 / tau2)(1/6 - 5 / (45 + i)).

    The usual 15 in place of 45 would make the first fifteen steps go backwards.
    """
    u, p = f.copy(), [np.zeros_like(f) for _ in range(3)]
    for i in range(steps):
        tau2 = 0.3 + 0.02 * i
        tau1 = (1 / tau2) * (1 / 6 - 5 / (45 + i))
        div = sum(np.diff(k, axis=a, prepend=0) for a, k in enumerate(p))
        u = u * (1 - tau1) + tau1 * (f + div / weight)
        q = [k + tau2 * np.diff(u, axis=a, append=np.take(u, [-1], axis=a)) for a, k in enumerate(p)]
        size = np.maximum(1, np.sqrt(sum(k * k for k in q)))
        p = [k / size for k in q]
    return u


def denoise(x: Field, shape: tuple[int, int, int], weight: float, steps: int, slab: int = 64, whole_bytes: int = WHOLE_BYTES) -> Field:
    """``rof`` of a volume."""
    if 8 * int(np.prod(shape)) <= whole_bytes:
        return whole(x, shape, lambda f: rof(f, weight, steps)).done()
    halo = steps + 1
    first, last = F.greatest(F.lit(0), F.floor((F.col("k") - halo) / slab)), F.floor(F.least(F.col("k") + halo, F.lit(shape[0] - 1)) / slab)
    rows = x.df.select(F.explode(F.sequence(first.cast("int"), last.cast("int"))).alias("slab"), "k", "data")

    def work(key: tuple, table: pa.Table) -> pa.Table:
        k = np.sort(table["k"].to_numpy())
        order = np.argsort(table["k"].to_numpy())
        out = rof(np.array(table["data"].to_pylist(), float)[order].reshape(len(k), *shape[1:]), weight, steps)
        own = np.flatnonzero(k // slab == key[0].as_py())
        return pa.Table.from_batches([as_table([int(i) for i in k[own]], out[own].reshape(len(own), -1))])

    return Field(rows.groupBy("slab").applyInArrow(work, FIELD)).done()


def im3d_denoise(x: Field, shape: tuple[int, ...], weight: float, steps: int = 50) -> Field:
    """Denoising of a volume brought to 0..1 first and back afterwards. Raises ValueError unless it is 3D."""
    if len(shape) != 3:
        raise ValueError("denoising needs a 3D array")
    row = x.df.agg(F.min(F.array_min("data")).alias("a"), F.max(F.array_max("data")).alias("b")).first()
    low, span = row["a"], (row["b"] - row["a"]) or 1.0
    unit = x.map(lambda v: (v - low) / span)
    return denoise(unit, shape, weight, steps).map(lambda v: v * span + low)
