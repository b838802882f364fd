"""Irregular readings onto each scan's regular angular grid, with low-rank filling of what is missing.

A scan's readings fall into slots of its grid; the reading nearest a slot's centre gives the slot its vector of
detector values, unchanged. All scans with the same number of slots form one source-by-slot matrix, a source
being one detector element of one scan. Missing cells are estimated by alternating least squares with a small
rank. The slot factors are a table joined by the number of slots, never collected: each half step is one pass
over the matrix that emits normal equations, summed per slot by a partial aggregation. A tenth of the observed cells
is held out of the factors, to choose the rank and how far an estimate may leave its source's mean.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from raylattice.session import materialise, scratch, small_enough

#: Detector elements in one row of the matrix; a wider detector has several rows a scan.
ELEMENTS = 1024
#: Cells handled at once inside one Arrow batch, so that a worker's memory and the lists' offsets are bounded.
CELLS_AT_ONCE = 2_000_000
GRID_ROW_BYTES = 64
BROADCAST_BYTES = 32 << 20
#: Ranks to choose from; of the cells one of so many is held out.
RANKS, HELD_OUT = (2, 3), 10


def grids(scan: DataFrame) -> DataFrame:
    """One row (scan_id, start_deg, step_deg, n_slots) per scan; repeats fold, unusable grids are left out."""
    return (
        scan.select("scan_id", F.struct("start_deg", "step_deg", "n_slots").alias("g"))
        .where("scan_id is not null and g.start_deg is not null and g.step_deg <> 0 and not isnan(g.step_deg) and g.n_slots > 0")
        .groupBy("scan_id")
        .agg(F.max("g").alias("g"))
        .select("scan_id", "g.*")
    )


def usable_readings(projection: DataFrame) -> DataFrame:
    """Readings with a finite angle (in degrees, ``deg_``) and at least one finite value in ``projs``."""
    deg = F.when(F.lower(F.trim("angle_unit")).startswith("rad"), F.degrees("angle")).otherwise(F.col("angle"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return (
        projection.select("scan_id", "reading_id", deg.alias("deg_"), "projs")
        .where(F.col("scan_id").isNotNull() & finite(F.col("deg_")) & F.exists("projs", finite))
        .withColumn("projs", F.transform("projs", lambda x: F.when(finite(x), x.cast("float"))))
    )


def slotted(readings: DataFrame, grid: DataFrame) -> DataFrame:
    """Readings with the slots they fall into and their distance from the slot's centre, in steps.

    The grid is broadcast where its counted size allows; otherwise both sides are joined on the scan and a salt,
    so that a scan or a source with a third of all readings is spread over many tasks.
    """
    if small_enough(grid, GRID_ROW_BYTES):
        joined = readings.join(F.broadcast(grid), "scan_id")
    else:
        salts = int(readings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        salted = grid.withColumn("salt_", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        joined = readings.withColumn("salt_", F.pmod(F.xxhash64("reading_id", "deg_"), F.lit(salts)).cast("int")).join(salted, ["scan_id", "salt_"])
    width = F.abs("step_deg")
    ahead = F.pmod((F.col("deg_") - F.col("start_deg")) * F.signum("step_deg"), F.lit(360.0))
    ahead = F.when(F.lit(360.0) - ahead <= width / 2, ahead - 360.0).otherwise(ahead)
    turns = F.greatest(F.lit(0), F.floor(((F.col("n_slots") - 0.5) * F.col("w_") - F.col("x_")) / 360.0).cast("int"))
    at = (F.col("x_") + F.col("turn_") * 360.0) / F.col("w_")
    return (
        joined.withColumns({"w_": width, "x_": ahead})
        .withColumn("turn_", F.explode(F.sequence(F.lit(0), turns)))
        .withColumn("slot", F.floor(at + 0.5).cast("int"))
        .where("slot >= 0 and slot < n_slots")
        .withColumn("off_", F.abs(at - F.col("slot")))
        .select("scan_id", "slot", "off_", "reading_id", "projs")
    )


def source_matrix(projection: DataFrame, scan: DataFrame) -> DataFrame:
    """One row per scan and block of ``ELEMENTS`` detector elements: its grid, the observed ``slots``, the block's
    ``width`` and ``cells``, the vectors of the observed slots laid end to end (null where an element isn't finite)."""
    grid = grids(scan)
    blocks = F.sequence(F.lit(0), F.ceil(F.size("r_.projs") / ELEMENTS).cast("int") - 1)
    nearest = (
        slotted(usable_readings(projection), grid)
        .groupBy("scan_id", "slot")
        .agg(F.min(F.struct("off_", "reading_id", "projs")).alias("r_"))
        .select("scan_id", "slot", "r_.projs", F.explode(blocks).alias("block"))
        .select("scan_id", "block", "slot", F.slice("projs", F.col("block") * ELEMENTS + 1, F.lit(ELEMENTS)).alias("projs"))
        .groupBy("scan_id", "block")
        .agg(F.sort_array(F.collect_list(F.struct("slot", "projs"))).alias("s_"))
        .withColumn("width", F.array_max(F.transform("s_", lambda s: F.size(s["projs"]))))
        .select(
            "scan_id",
            "block",
            "width",
            F.col("s_.slot").alias("slots"),
            F.flatten(F.transform("s_", lambda s: F.concat(s["projs"], F.array_repeat(F.lit(None).cast("float"), F.col("width") - F.size(s["projs"]))))).alias("cells"),
        )
    )
    return grid.join(nearest, "scan_id", "left").withColumns({"width": F.coalesce("width", F.lit(0)), "block": F.coalesce("block", F.lit(0))})


def first_factors(n: int, rank: int) -> np.ndarray:
    """Smooth starting factors: the first cosines over the slots, from the constant one."""
    return np.cos(np.pi * np.outer(np.arange(n) + 0.5, np.arange(rank)) / n)


def held_out(scan_id: np.ndarray, n: int) -> np.ndarray:
    """(scan, slot): whether a scan's cells of a slot are held out; by a hash of both."""
    h = (scan_id.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15)) ^ (np.arange(n, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return (h >> np.uint64(33)) % np.uint64(HELD_OUT) == 0


def dense_groups(batch: pa.RecordBatch, rank: int, hold: bool = False) -> Iterator[tuple]:
    """Rows of a batch in groups of equal slots and width: (row numbers, n, width, X, Y, W, mean, V, support, count,
    held out).

    Y (row, element, slot) holds relative deviations from each source's mean, W its observed cells as 0 or 1; with
    ``hold`` without those held out.
    """
    n, width = (batch.column(c).to_numpy(zero_copy_only=False).astype(int) for c in ("n_slots", "width"))
    ids = batch.column("scan_id").to_numpy(zero_copy_only=False)
    slots, cells = batch.column("slots"), batch.column("cells")
    s_at, c_at = slots.offsets.to_numpy(), cells.offsets.to_numpy()
    s_all, c_all = slots.values.to_numpy(zero_copy_only=False), cells.values.to_numpy(zero_copy_only=False).astype(float)
    first = {}
    for i in range(batch.num_rows):
        first.setdefault((n[i], width[i]), []).append(i)
    for (k, p), rows in first.items():
        if "v" in batch.schema.names and batch.column("v")[rows[0]].is_valid:
            v = np.array(batch.column("v")[rows[0]].as_py(), float).reshape(k, -1)
            support = np.array(batch.column("support")[rows[0]].as_py(), float)
        else:
            v, support = first_factors(k, rank), np.full(k, np.inf)
        at_once = max(1, CELLS_AT_ONCE // max(1, p * k))
        for part in (rows[j : j + at_once] for j in range(0, len(rows), at_once)):
            x = np.full((len(part), max(p, 1), k), np.nan)
            for j, i in enumerate(part):
                if p and s_at[i + 1] > s_at[i]:
                    at = s_all[s_at[i] : s_at[i + 1]]
                    x[j][:, at] = c_all[c_at[i] : c_at[i + 1]].reshape(len(at), p).T
            w = np.isfinite(x)
            out = held_out(ids[part], k)[:, None, :] & w if hold else None
            if hold:
                w = w & ~out
            count = w.sum(2, keepdims=True)
            mean = np.where(w, x, 0).sum(2, keepdims=True) / np.maximum(count, 1)
            mean = np.where(np.abs(mean) < 1e-12, 1.0, mean)
            yield part, k, p, x, np.where(w, x / mean - 1, 0.0), w.astype(float), mean, v, support, count, out


def source_factors(y: np.ndarray, w: np.ndarray, v: np.ndarray, ridge: float) -> np.ndarray:
    """Least-squares factors of each source given the slots' factors."""
    k = v.shape[1]
    s, p, n = y.shape
    outer = (v[:, :, None] * v[:, None, :]).reshape(n, k * k)
    a = (w.reshape(-1, n) @ outer).reshape(-1, k, k) + ridge * np.eye(k)
    return np.linalg.solve(a, (y.reshape(-1, n) @ v)[:, :, None])[:, :, 0].reshape(s, p, k)


def fill_low_rank(matrix: DataFrame, ranks: tuple[int, ...] = RANKS, rounds: int = 3, ridge: float = 0.1, least: int = 4) -> DataFrame:
    """``matrix`` (of ``source_matrix``) with every slot's vector and state.

    ``rounds`` alternating least squares rounds for each of ``ranks``; ``chosen_factors`` takes, for each number of
    slots, the rank and the share of the estimated deviation from the mean that predict the held-out cells best. A
    missing cell is filled, within its source's observed range, where its source has at least ``least`` observed cells
    and its slot at least ``least`` observed cells over all sources of its matrix; any other stays null and its slot is
    ``unsupported``. Observed cells come out exactly as they went in.
    """
    source = matrix.join(if_small(chosen_factors(matrix, ranks, rounds, ridge, least)), "n_slots", "left")

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shrink = batch.column("shrink").to_numpy(zero_copy_only=False)
            for part, k, p, x, y, w, mean, v, support, count, _ in dense_groups(batch, max(ranks)):
                by = np.nan_to_num(shrink[part].astype(float))[:, None, None]
                guess = (np.einsum("spk,nk->spn", source_factors(y, w, v, ridge), v) * by + 1) * mean
                low, high = (f(np.where(w > 0, x, sign * np.inf), 2, keepdims=True) for f, sign in ((np.min, 1), (np.max, -1)))
                ok = (count >= least) & (support[None, None, :] >= least) & (p > 0)
                out = np.where(w > 0, x, np.where(ok, np.clip(guess, low, high), np.nan)).transpose(0, 2, 1)  # row, slot, element
                seen = (w > 0).any(1)
                state = np.where(seen, 0, np.where(np.isfinite(out).any(2), 1, 2)).astype(np.int8)
                if not p:
                    out = out[:, :, :0]
                s = len(part)
                flat = out.reshape(-1).astype(np.float32)
                vectors = pa.ListArray.from_arrays(pa.array(np.arange(s * k + 1) * p, pa.int32()), pa.array(flat, mask=~np.isfinite(flat)))
                outer = pa.array(np.arange(s + 1) * k, pa.int32())
                take = pa.array(part)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("scan_id").take(take), batch.column("block").take(take), pa.ListArray.from_arrays(outer, vectors), pa.ListArray.from_arrays(outer, pa.array(state.reshape(-1)))],
                    names=["scan_id", "block", "projs", "state"],
                )

    filled = source.select("scan_id", "block", "n_slots", "width", *listed(), "v", "support", "shrink").mapInArrow(fill, "scan_id bigint, block int, projs array<array<float>>, state array<tinyint>")
    rows = filled.select("scan_id", "block", F.posexplode(F.arrays_zip("projs", "state")).alias("slot", "c_")).select("scan_id", "block", F.col("slot").cast("bigint").alias("slot"), "c_.projs", "c_.state")
    if matrix.agg(F.max("block")).first()[0]:  # some detector has several blocks
        rows = rows.groupBy("scan_id", "slot").agg(F.sort_array(F.collect_list(F.struct("block", "projs"))).alias("l_"), F.min("state").alias("state")).select("scan_id", "slot", F.flatten("l_.projs").alias("projs"), "state")
    return rows.select("scan_id", "slot", "projs", F.element_at(F.array(F.lit("observed"), F.lit("filled"), F.lit("unsupported")), F.col("state") + 1).alias("state"))


def if_small(factors: DataFrame) -> DataFrame:
    """A broadcast hint on slot factors that are counted small."""
    size = factors.agg(F.sum(F.size("v") + F.size("support")) * 8).first()[0] or 0
    return F.broadcast(factors) if size <= BROADCAST_BYTES else factors


def chosen_factors(matrix: DataFrame, ranks: tuple[int, ...], rounds: int, ridge: float, least: int) -> DataFrame:
    """(n_slots, v, support, shrink) of the rank that predicts the held-out cells best."""
    found = None
    for rank in ranks:
        factors = None
        for _ in range(rounds):
            factors = slot_factors(matrix if factors is None else matrix.join(factors, "n_slots", "left"), rank, ridge)
        factors = materialise(factors)
        fitted = factors.join(held_out_errors(matrix.join(if_small(factors), "n_slots"), ridge, least), "n_slots", "left").withColumn("rank", F.lit(rank))
        found = fitted if found is None else found.unionByName(fitted)
    best = F.min_by(F.struct("v", "support", F.coalesce("shrink", F.lit(0.0)).alias("shrink")), F.struct(F.coalesce("rmse", F.lit(float("inf"))), "rank"))
    return materialise(found.groupBy("n_slots").agg(best.alias("b_")).select("n_slots", "b_.*"))


def held_out_errors(source: DataFrame, ridge: float, least: int) -> DataFrame:
    """(n_slots, cells, shrink, rmse, mean_rmse) over the held-out cells that could be filled: the share of the estimated
    deviation that suits them best, between 0 and 1, its error, and that of the source's mean."""

    def errors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for _, k, _, x, y, w, mean, v, support, count, out in dense_groups(batch, 1, hold=True):
                u = source_factors(y, w, v, ridge)
                low, high = (f(np.where(w > 0, x, sign * np.inf), 2, keepdims=True) for f, sign in ((np.min, 1), (np.max, -1)))
                test = out & (count >= least) & (support[None, None, :] >= least)
                guess = np.where(test, np.clip((np.einsum("spk,nk->spn", u, v) + 1) * mean, low, high) - mean, 0)
                off = np.where(test, np.nan_to_num(x) - mean, 0)
                rows.append((k, int(test.sum()), float((guess * guess).sum()), float((guess * off).sum()), float((off * off).sum())))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 5, (pa.int32(), pa.int64(), *[pa.float64()] * 3), strict=True)], names=["n_slots", "cells", "gg", "go", "oo"])

    sums = source.where("width > 0").select("scan_id", "n_slots", "width", *listed(), "v", "support").mapInArrow(errors, "n_slots int, cells bigint, gg double, go double, oo double")
    sums = sums.groupBy("n_slots").agg(*[F.sum(c).alias(c) for c in ("cells", "gg", "go", "oo")]).where("cells > 0")
    shrink = F.when(F.col("gg") > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("go") / F.col("gg")))).otherwise(0.0)
    left = F.col("oo") - 2 * F.col("shrink") * F.col("go") + F.col("shrink") * F.col("shrink") * F.col("gg")
    return sums.withColumn("shrink", shrink).select("n_slots", "cells", "shrink", F.sqrt(F.greatest(left, F.lit(0.0)) / F.col("cells")).alias("rmse"), F.sqrt(F.col("oo") / F.col("cells")).alias("mean_rmse"))


def listed() -> list:
    return [F.coalesce("slots", F.array().cast("array<int>")).alias("slots"), F.coalesce("cells", F.array().cast("array<float>")).alias("cells")]


def slot_factors(matrix: DataFrame, rank: int, ridge: float) -> DataFrame:
    """One least-squares round: (n_slots, v, support) from the matrix and, if joined, the factors before.

    v is the slots' factors row by row, support the observed cells of each slot over all sources, without those held
    out.
    """
    pairs = [(i, j) for i in range(rank) for j in range(i, rank)]
    sums = [f"a{i}{j}" for i, j in pairs] + [f"b{i}" for i in range(rank)] + ["support"]

    def equations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for _, k, _, _, y, w, _, v, *_ in dense_groups(batch, rank, hold=True):
                u = source_factors(y, w, v, ridge).reshape(-1, rank)
                w2, y2 = w.reshape(-1, k), y.reshape(-1, k)
                part = np.stack([w2.T @ (u[:, i] * u[:, j]) for i, j in pairs] + [y2.T @ u[:, i] for i in range(rank)] + [w2.sum(0)], 1)
                total[k] = total[k] + part if k in total else part
        for k, part in total.items():
            yield pa.RecordBatch.from_pydict({"n_slots": np.full(k, k, np.int32), "slot": np.arange(k, dtype=np.int32)} | {c: part[:, i] for i, c in enumerate(sums)})

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in sums}
            a = np.zeros((batch.num_rows, rank, rank))
            for i, j in pairs:
                a[:, i, j] = a[:, j, i] = col[f"a{i}{j}"]
            b = np.stack([col[f"b{i}"] for i in range(rank)], 1)
            v = np.linalg.solve(a + ridge * np.eye(rank), b[:, :, None])[:, :, 0] if len(b) else b
            yield pa.RecordBatch.from_arrays(
                [batch.column("n_slots"), batch.column("slot"), pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1) * rank, pa.int32()), pa.array(v.reshape(-1))), batch.column("support")],
                names=["n_slots", "slot", "v", "support"],
            )

    columns = ["scan_id", "n_slots", "width", *listed(), *[c for c in ("v", "support") if c in matrix.columns]]
    return (
        matrix.where("width > 0")
        .select(*columns)
        .mapInArrow(equations, "n_slots int, slot int, " + ", ".join(f"{c} double" for c in sums))
        .groupBy("n_slots", "slot")
        .agg(*[F.sum(c).alias(c) for c in sums])
        .mapInArrow(solve, "n_slots int, slot int, v array<double>, support double")
        .groupBy("n_slots")
        .agg(F.sort_array(F.collect_list(F.struct("slot", "v", "support"))).alias("f_"))
        .select("n_slots", F.flatten("f_.v").alias("v"), F.col("f_.support").alias("support"))
    )


def regular_series(projection: DataFrame, scan: DataFrame, ranks: tuple[int, ...] = RANKS, rounds: int = 3) -> DataFrame:
    """(scan_id, slot, projs, state) for every slot of every scan of ``scan``.

    state is ``observed``, ``filled`` or ``unsupported`` (projs then holds nulls, or no value if the scan has no
    usable reading). Null, infinite and NaN angles, readings without a finite value, readings of unknown scans and
    outside all slots are ignored. Of several readings in a slot the one nearest its centre counts, then the
    smaller reading id; repeats change nothing. A null angle unit means degrees. Empty readings leave every slot
    unsupported; an empty scan table gives an empty result. Further columns of either table aren't read.
    """
    matrix = source_matrix(projection, scan)
    at = scratch(matrix.sparkSession, "matrix")
    matrix.write.option("compression", "zstd").parquet(at)
    return fill_low_rank(matrix.sparkSession.read.parquet(at), ranks, rounds)


def empty_slots(series: DataFrame) -> DataFrame:
    """(scan_id, slot) of the slots that no reading gave a value."""
    return series.where("state <> 'observed'").select("scan_id", "slot")
