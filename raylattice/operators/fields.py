"""Volumes and projections as distributed vectors, and the linear operators between them.

A field is a table (k, data): a volume's slices by z, or a scan's images by view. Sums and products are columns;
inner products are one aggregate. A projector's entries are computed where they are used and never stored or moved: the
volume is cut into slabs of slices of at most ``SLAB_BYTES``, each view meets each slab in a task that holds the slab,
and only detector rows and slabs that were added up there go on. What is shuffled grows with the volume and the images.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from raylattice.geometry import VIEW_FIELDS, Geometry
from raylattice.operators import kernels
from raylattice.session import materialise, small_enough

#: Volumes up to this size may be handled in one task, by what needs them whole.
WHOLE_BYTES = 128 << 20
SLAB_BYTES = 16 << 20
#: Bytes of arrays that one task adds up at a time.
SUM_BYTES = 256 << 20
FIELD = "k int, data array<double>"
PARTS = "k int, first int, data array<double>"


def arrays(column: pa.Array) -> Iterator[np.ndarray]:
    """The rows of a list column as arrays, without copies."""
    values, ends = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    for a, b in zip(ends, ends[1:], strict=False):
        yield values[a:b]


def summed(parts: DataFrame, size: int, rows: int) -> DataFrame:
    """(k, data) of length ``size`` with the parts of equal k, which begin at ``first``, added up; k is below ``rows``.
    Each task adds as they come, so that it holds one array for each of its k."""
    width = max(1, SUM_BYTES // (8 * size))
    cores = parts.sparkSession.sparkContext.defaultParallelism
    tasks = max(min(rows, cores), -(-rows // width))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for k, first, data in zip(b.column("k").to_pylist(), b.column("first").to_pylist(), arrays(b.column("data")), strict=True):
                if k not in total:
                    total[k] = np.zeros(size)
                total[k][first : first + len(data)] += data
        for k, data in total.items():
            yield as_table([k], data[None])

    return parts.repartitionById(tasks, F.pmod("k", F.lit(tasks)).cast("int")).mapInArrow(add, FIELD)


def as_table(k: list[int], rows: np.ndarray) -> pa.RecordBatch:
    rows = np.asarray(rows, float)
    ends = pa.array(np.arange(len(k) + 1) * rows.shape[1], pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.ListArray.from_arrays(ends, pa.array(rows.ravel()))], names=["k", "data"])


def as_part(k: int, first: int, data: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([first], pa.int32()), pa.ListArray.from_arrays(pa.array([0, len(data)], pa.int32()), pa.array(data))], names=["k", "first", "data"])


class Field:
    """A distributed vector with the operations that the algorithms need."""

    def __init__(self, df: DataFrame):
        self.df = df.select("k", "data")

    @classmethod
    def of(cls, spark: SparkSession, rows: np.ndarray) -> Field:
        """From a small array whose first axis numbers the rows."""
        rows = np.asarray(rows, float).reshape(len(rows), -1)
        return cls(spark.createDataFrame(pa.Table.from_batches([as_table(list(range(len(rows))), rows)]), FIELD))

    def array(self) -> np.ndarray:
        """All rows on the driver, in order of k: for results of known size and tests."""
        table = self.df.toArrow().sort_by("k").combine_chunks()
        rows = [x for c in table["data"].chunks for x in arrays(c)]
        return np.array(rows, float)

    def done(self) -> Field:
        """Computed once and kept in the shared folder."""
        return Field(materialise(self.df))

    def map(self, f: Callable[[Column], Column]) -> Field:
        return Field(self.df.select("k", F.transform("data", f).alias("data")))

    def zip(self, other: Field, f: Callable[[Column, Column], Column]) -> Field:
        both = self.df.join(other.df.withColumnRenamed("data", "other"), "k")
        return Field(both.select("k", F.zip_with("data", "other", f).alias("data")))

    def __add__(self, other: Field) -> Field:
        return self.zip(other, lambda a, b: a + b)

    def __sub__(self, other: Field) -> Field:
        return self.zip(other, lambda a, b: a - b)

    def __mul__(self, other: Field | float) -> Field:
        if isinstance(other, Field):
            return self.zip(other, lambda a, b: a * b)
        return self.map(lambda a: a * float(other))

    __rmul__ = __mul__

    def over(self, other: Field) -> Field:
        """a / b, and 0 where b is 0."""
        return self.zip(other, lambda a, b: F.when(b == 0, 0.0).otherwise(a / b))

    def plus(self, factor: float, other: Field) -> Field:
        return self.zip(other, lambda a, b: a + float(factor) * b)

    def positive(self) -> Field:
        return self.map(lambda a: F.greatest(a, F.lit(0.0)))

    def inverse(self, threshold: float = 0.0) -> Field:
        return self.map(lambda a: F.when(a <= threshold, 0.0).otherwise(1 / a))

    def dot(self, other: Field) -> float:
        return self.zip(other, lambda a, b: a * b).total()

    def total(self) -> float:
        part = F.aggregate("data", F.lit(0.0), lambda a, b: a + b)
        return float(self.df.agg(F.sum(part)).first()[0] or 0.0)

    def norm(self) -> float:
        return float(np.sqrt(self.map(lambda a: a * a).total()))

    def rows(self, ks: list[int]) -> Field:
        return Field(self.df.where(F.col("k").isin([int(k) for k in ks])))


def union(fields: list[Field]) -> Field:
    df = fields[0].df
    for f in fields[1:]:
        df = df.unionByName(f.df)
    return Field(df)


class Projector:
    """A and its backprojections for one geometry and its views, which the driver holds: there are as many as a scan
    acquires, and more than ``VIEW_ROWS`` raise ValueError."""

    VIEW_ROWS = 1_000_000

    def __init__(self, geometry: Geometry, views: DataFrame, kind: str = "siddon", slab_bytes: int = SLAB_BYTES, rows: list[dict] | None = None):
        self.g, self.kind, self.slab_bytes = geometry, kind, slab_bytes
        self.views = views.select(*VIEW_FIELDS)
        self.spark = views.sparkSession
        self._rows = rows

    @property
    def rows(self) -> list[dict]:
        if self._rows is None:
            if not small_enough(self.views, 1, self.VIEW_ROWS):
                raise ValueError(f"more than {self.VIEW_ROWS} views")
            self._rows = [r.asDict() for r in self.views.orderBy("proj_idx").collect()]
        return self._rows

    def only(self, ks: list[int]) -> Projector:
        wanted = {int(k) for k in ks}
        return Projector(self.g, self.views.where(F.col("proj_idx").isin(sorted(wanted))), self.kind, self.slab_bytes, [v for v in self.rows if v["proj_idx"] in wanted])

    @property
    def slices(self) -> int:
        """Slices in a slab."""
        return max(1, min(self.g.n_voxel[0], self.slab_bytes // (8 * self.g.n_voxel[1] * self.g.n_voxel[2])))

    @property
    def slabs(self) -> list[tuple[int, int]]:
        nz = self.g.n_voxel[0]
        return [(a, min(a + self.slices, nz)) for a in range(0, nz, self.slices)]

    @property
    def groups(self) -> int:
        """Groups of views, so that slabs and groups make at least a task for each core."""
        return max(1, min(len(self.rows), -(-self.spark.sparkContext.defaultParallelism // len(self.slabs))))

    def placed(self, df: DataFrame, slab: Column, group: Column) -> DataFrame:
        """``df`` with a partition for each slab and group of views."""
        return df.repartitionById(len(self.slabs) * self.groups, (slab * self.groups + group).cast("int"))

    def forward(self, x: Field) -> Field:
        """Slabs go to the groups of views; of each view's image the rows that the slab's shadow meets come back."""
        g, kind, rows, groups, ranges, slices = self.g, self.kind, self.rows, self.groups, self.slabs, self.slices
        (nv, nu), area = g.n_detector, g.n_voxel[1] * g.n_voxel[2]
        pieces = x.df.select((F.col("k") / slices).cast("int").alias("slab"), F.col("k"), "data", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[tuple[int, int], np.ndarray] = {}
            for b in batches:
                for slab, group, k, data in zip(*(b.column(c).to_pylist() for c in ("slab", "group", "k")), arrays(b.column("data")), strict=True):
                    lo, hi = ranges[slab]
                    if (slab, group) not in held:
                        held[slab, group] = np.zeros((hi - lo, area))
                    held[slab, group][k - lo] = data
            for (slab, group), volume in held.items():
                flat = volume.ravel()
                for v in rows[group::groups]:
                    ray, cell, w = kernels.entries(g, v, kind, *ranges[slab])
                    if slab == 0 and not len(ray):
                        yield as_part(v["proj_idx"], 0, np.zeros(0))
                    if len(ray):
                        first, last = int(ray.min()) // nu, int(ray.max()) // nu + 1
                        yield as_part(v["proj_idx"], first * nu, np.bincount(ray - first * nu, w * flat[cell], (last - first) * nu))

        parts = self.placed(pieces, F.col("slab"), F.col("group")).select("slab", "group", "k", "data").mapInArrow(run, PARTS)
        last = max((v["proj_idx"] for v in rows), default=0) + 1
        return Field(summed(parts, nv * nu, last))

    def adjoint(self, b: Field, kind: str | None = None) -> Field:
        """A' b exactly, or with ``kind`` ``fdk`` or ``matched`` the voxel-driven backprojection. Each image's rows go to
        the slabs whose shadow they may lie in; a task adds up its slab over its views."""
        g, kind, rows, groups, ranges = self.g, kind or self.kind, self.rows, self.groups, self.slabs
        (nv, nu), area = g.n_detector, g.n_voxel[1] * g.n_voxel[2]
        by_id = {v["proj_idx"]: (i, v) for i, v in enumerate(rows)}

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k, data in zip(batch.column("k").to_pylist(), arrays(batch.column("data")), strict=True):
                    if k not in by_id:
                        continue
                    i, v = by_id[k]
                    for slab, (lo, hi) in enumerate(ranges):
                        first, last = kernels.rows_of(g, v, lo, hi)
                        if first < last:
                            part = as_part(k, first * nu, data[first * nu : last * nu])
                            yield pa.RecordBatch.from_arrays([pa.array([slab * groups + i % groups], pa.int32()), *part.columns], names=["at", *part.schema.names])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict[int, np.ndarray] = {}
            for batch in batches:
                for at, k, first, data in zip(*(batch.column(c).to_pylist() for c in ("at", "k", "first")), arrays(batch.column("data")), strict=True):
                    lo, hi = ranges[at // groups]
                    ray, cell, w = kernels.entries(g, by_id[k][1], kind, lo, hi)
                    inside = (ray >= first) & (ray < first + len(data))
                    if not inside.all():
                        ray, cell, w = ray[inside], cell[inside], w[inside]
                    part = np.bincount(cell, w * data[ray - first], (hi - lo) * area)
                    total[at] = total[at] + part if at in total else part
            for at, part in total.items():
                for j, row in enumerate(part.reshape(-1, area)):
                    yield as_part(ranges[at // groups][0] + j, 0, row)

        dealt = b.df.mapInArrow(deal, f"at int, {PARTS}")
        parts = dealt.repartitionById(len(ranges) * groups, F.col("at")).mapInArrow(run, PARTS)
        nz = g.n_voxel[0]
        added = summed(parts, area, nz) if groups > 1 else parts.select("k", "data")
        every = self.spark.range(nz).select(F.col("id").cast("int").alias("k")).join(added, "k", "left")
        return Field(every.select("k", F.coalesce("data", F.array_repeat(F.lit(0.0), area)).alias("data")))

    def ones(self, volume: bool) -> Field:
        n, size = (self.g.n_voxel[0], self.g.n_voxel[1] * self.g.n_voxel[2]) if volume else (0, int(np.prod(self.g.n_detector)))
        keys = self.spark.range(n).select(F.col("id").cast("int").alias("k")) if volume else self.views.select(F.col("proj_idx").cast("int").alias("k"))
        return Field(keys.select("k", F.array_repeat(F.lit(1.0), size).alias("data")))


def largest_singular_value(p: Projector, rounds: int = 8, seed: int = 0) -> float:
    """By the power method on A'A."""
    rng = np.random.default_rng(seed)
    x = Field.of(p.spark, rng.random(p.g.n_voxel))
    s = 0.0
    for _ in range(rounds):
        x = (x * (1 / max(x.norm(), 1e-300))).done()
        y = p.forward(x).done()
        s = y.norm()
        x = p.adjoint(y).done()
    return s
