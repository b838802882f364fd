"""Lookups that are joins: circular interpolation, nearest view, tables with intervals, and the greedy view filter."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from raylattice.session import broadcast_if_small, materialise

#: Cells of sources at most.
CELLS = 1 << 24


def source_cells(sources: DataFrame, low: float, high: float) -> tuple[DataFrame, Column]:
    """Sources (angle, ``s_`` a struct that begins with it) in as many even cells as there are sources: per cell its
    sources in order and the last before and first after, and the cell of a column ``angle``. Cells without sources
    have a row as well, so that each target meets one row. A cell's neighbours come from blocks of cells, whose ends are
    chained, so that no window holds all cells."""
    n = max(1, min(CELLS, sources.count()))
    cell = lambda a: F.greatest(F.lit(0), F.least(F.lit(n - 1), F.floor((a - low) / max(high - low, 1e-300) * n))).cast("int")
    held = sources.withColumn("cell_", cell(F.col("angle"))).groupBy("cell_").agg(F.sort_array(F.collect_list("s_")).alias("l_"))
    every = sources.sparkSession.range(n).select(F.col("id").cast("int").alias("cell_")).join(held, "cell_", "left").withColumn("block_", F.floor(F.col("cell_") / 1024))
    ends = every.withColumns({"last_": F.element_at("l_", -1), "first_": F.element_at("l_", 1)})
    blocks = ends.groupBy("block_").agg(F.max("last_").alias("b_last"), F.min("first_").alias("b_first"))
    across = Window.partitionBy(F.lit(0)).orderBy("block_")  # one row for 1,024 cells
    chained = blocks.select(
        "block_", F.last("b_last", ignorenulls=True).over(across.rowsBetween(Window.unboundedPreceding, -1)).alias("b_before"),
        F.first("b_first", ignorenulls=True).over(across.rowsBetween(1, Window.unboundedFollowing)).alias("b_after"),
    )
    within = Window.partitionBy("block_").orderBy("cell_")
    carried = ends.select(
        "cell_", "l_", "block_", F.last("last_", ignorenulls=True).over(within.rowsBetween(Window.unboundedPreceding, -1)).alias("before_"),
        F.first("first_", ignorenulls=True).over(within.rowsBetween(1, Window.unboundedFollowing)).alias("after_"),
    ).join(chained, "block_")
    return carried.select("cell_", "l_", F.coalesce("before_", "b_before").alias("before_"), F.coalesce("after_", "b_after").alias("after_")), cell(F.col("angle"))


def around(targets: DataFrame, sources: DataFrame) -> DataFrame:
    """``targets`` with ``lo_`` and ``hi_``, the sources' structs just at or before and at or after their ``angle``. An
    equi-join with cells that hold about one source each: the cells are broadcast where they are counted small, else
    hot cells are split like those of any join."""
    ends = sources.agg(F.min("angle").alias("a"), F.max("angle").alias("b")).first()
    cells, cell = source_cells(sources, *(float(x) if x is not None else 0.0 for x in (ends["a"], ends["b"])))
    joined = targets.withColumn("cell_", cell).join(broadcast_if_small(cells, 128), "cell_")
    own = F.coalesce("l_", F.array())
    lo = F.element_at(F.filter(own, lambda s: s["angle"] <= F.col("angle")), -1)
    hi = F.get(F.filter(own, lambda s: s["angle"] >= F.col("angle")), 0)
    at = lambda c, other: F.coalesce(F.when(F.size("l_") > 0, c), F.col(other))
    safe = F.when(F.size(F.filter(own, lambda s: s["angle"] <= F.col("angle"))) > 0, lo)
    return joined.withColumns({"lo_": at(safe, "before_"), "hi_": at(hi, "after_")}).drop("cell_", "l_", "before_", "after_")


def interpolate_circular(views: DataFrame, blanks: DataFrame, period: float = 360.0) -> DataFrame:
    """``views`` with ``blank``: the blank value at their angle, linear between the two neighbours modulo ``period``.
    Equal blank angles are averaged. A view meets one row of the blanks' cells."""
    b = blanks.groupBy(F.pmod(F.col("angle"), F.lit(period)).alias("angle")).agg(F.avg("value").alias("value"))
    turns = b.withColumn("t_", F.explode(F.array(F.lit(-period), F.lit(0.0), F.lit(period)))).select((F.col("angle") + F.col("t_")).alias("angle"), "value")
    sources = materialise(turns.select("angle", F.struct("angle", "value").alias("s_")))
    at = F.pmod(F.col("angle_"), F.lit(period))
    near = around(views.withColumnRenamed("angle", "angle_").withColumn("angle", at), sources)
    width = F.col("hi_.angle") - F.col("lo_.angle")
    share = F.when(width > 0, (F.col("angle") - F.col("lo_.angle")) / width).otherwise(0.0)
    blank = F.col("lo_.value") * (1 - share) + F.col("hi_.value") * share
    return near.withColumn("blank", blank).drop("angle", "lo_", "hi_").withColumnRenamed("angle_", "angle")


def nearest(targets: DataFrame, sources: DataFrame, tolerance: float | None = None) -> DataFrame:
    """(t_idx, t_angle, s_idx, s_angle, delta): each target's nearest source by angle; ties go to the smaller
    source id. With ``tolerance`` targets whose nearest is further away are left out. Both sides are (idx, angle)."""
    s = materialise(sources.where("angle is not null and not isnan(angle)").groupBy("angle").agg(F.min("idx").alias("idx")).select("angle", F.struct("angle", "idx").alias("s_")))
    near = around(targets.where("angle is not null and not isnan(angle)").select(F.col("idx").alias("t_idx"), "angle"), s)

    def cand(c: str) -> Column:
        return F.when(F.col(c).isNotNull(), F.struct(F.abs(F.col("angle") - F.col(f"{c}.angle")).alias("delta"), F.col(f"{c}.idx").alias("s_idx"), F.col(f"{c}.angle").alias("s_angle")))

    out = near.withColumn("b_", F.least(cand("lo_"), cand("hi_"))).select("t_idx", F.col("angle").alias("t_angle"), "b_.s_idx", "b_.s_angle", "b_.delta").where("s_idx is not null")
    return out if tolerance is None else out.where(F.col("delta") <= tolerance)


def keyed(rows: DataFrame, calibration: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with the columns of ``calibration`` for their ``keys``, of which it must hold one row each. A key that it
    lacks ends the query with an error that names it; it is never a silent null."""
    known = calibration.dropDuplicates(keys).withColumn("known_", F.lit(True))
    joined = rows.join(broadcast_if_small(known, 256), keys, "left")
    name = F.concat(F.lit("no calibration for "), F.to_json(F.struct(*keys)))
    return joined.where(F.when(F.col("known_").isNull(), F.raise_error(name).cast("boolean")).otherwise(F.lit(True))).drop("known_")


def spaced_views(views: DataFrame, threshold: float, by: str = "scan_id") -> DataFrame:
    """The views of each scan, in order of ``idx``, whose angle differs from the last kept one by more than
    ``threshold``; the first is kept. Null and NaN angles are left out.

    Each view depends on those before, so a scan stays in one partition; it is sorted there (spilling if need be) and
    streamed past one remembered angle, whatever its length.
    """
    kind = f"{by} bigint, idx bigint, angle double"

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan, last = None, 0.0
        for b in batches:
            kept = []
            for i, (s, a) in enumerate(zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True)):
                if s != scan or abs(a - last) > threshold:
                    scan, last = s, a
                    kept.append(i)
            yield b.take(pa.array(kept, pa.int64()))

    rows = views.select(F.col(by).cast("bigint").alias(by), F.col("idx").cast("bigint").alias("idx"), F.col("angle").cast("double").alias("angle"))
    rows = rows.where(F.col(by).isNotNull() & F.col("angle").isNotNull() & ~F.isnan("angle"))
    return rows.repartition(by).sortWithinPartitions(by, "idx", "angle").mapInArrow(keep, kind)


def classes(values: DataFrame, bounds: list[float], column: str = "value") -> DataFrame:
    """``values`` with ``class``: i where bounds[i] < value < bounds[i + 1], strictly; the last class has no end."""
    v = F.col(column)
    cases = [F.when((v > lo) & (v < hi), F.lit(i)) for i, (lo, hi) in enumerate(zip(bounds, [*bounds[1:], float("inf")], strict=True))]
    return values.withColumn("class", F.coalesce(*cases))


def piecewise(values: DataFrame, knots: list[tuple[float, float]], column: str = "value") -> DataFrame:
    """``values`` with ``mapped``: linear between the knots (x, y) of a calibration, constant beyond its ends."""
    xs = sorted(knots)
    v = F.col(column)
    inner = [F.when((v >= a) & (v < b), ya + (v - a) * ((yb - ya) / (b - a))) for (a, ya), (b, yb) in zip(xs, xs[1:], strict=False)]
    return values.withColumn("mapped", F.coalesce(F.when(v < xs[0][0], F.lit(float(xs[0][1]))), *inner, F.lit(float(xs[-1][1]))))


def rotation_centre(projection: DataFrame, candidates: list[int], width: int) -> DataFrame:
    """One row (cor, cost): the shift for which the first view and the mirrored opposite one (``side`` 0 and 1)
    agree best in the mean square; ties go to the smaller shift."""
    first = projection.where("side = 0").select("v", F.col("u"), F.col("value").alias("a"))
    other = projection.where("side = 1").select("v", F.explode(F.array(*[F.lit(c) for c in candidates])).alias("cor"), "u", F.col("value").alias("b"))
    other = other.withColumn("u", F.lit(width - 1) - F.col("u") + F.col("cor"))
    cost = first.join(other, ["v", "u"]).groupBy("cor").agg(F.avg((F.col("a") - F.col("b")).cast("double") ** 2).alias("cost"))
    return cost.agg(F.min(F.struct("cost", "cor")).alias("m")).select("m.cor", "m.cost")


def centre_search(views: DataFrame, pitch: float, dso: float, dsd: float, levels: int = 7) -> DataFrame:
    """(scan_id, cor): the shift of the rotation's centre, in mm at the axis, for which opposite rays agree best.

    ``views`` has scan_id, angle in radians and ``row``, the values along u of one detector row, which with a scan's
    views makes a sinogram for one task. Each ray is compared with the one that a full turn's scan sees from the other
    side if the centre's image lies at c on the detector, linear between angles and pixels and 0 beyond the detector.
    Of 21 shifts a step apart the best, the smallest of equals, is the middle of the next level's, ten times finer; the
    first step is 1 mm. Null rows and angles are left out; a scan without any gives nothing."""

    def best(table: pa.Table) -> pa.Table:
        scan = table["scan_id"][0]
        order = np.argsort(angles := table["angle"].to_numpy(), kind="stable")
        data = np.array(table["row"].to_pylist(), float)[order]
        turns = np.concatenate([angles[order] + k for k in (-2 * np.pi, 0, 2 * np.pi)])
        wide, nu = np.concatenate([data] * 3), data.shape[1]
        u = (np.arange(nu) - (nu - 1) / 2) * pitch
        gamma, middle = np.arctan(u / dsd), 0.0

        def cost(c: float) -> float:
            own = np.arctan(c / dsd)
            to = angles[order][:, None] + 2 * (gamma - own) + np.pi
            to = np.where(to > turns[-1], to - 2 * np.pi, to)
            s = np.tan(2 * own - gamma) * dsd / pitch + (nu - 1) / 2
            i = np.clip(np.searchsorted(turns, to, "right") - 1, 0, len(turns) - 2)
            gap = turns[i + 1] - turns[i]
            w = np.clip(np.where(gap > 0, (to - turns[i]) / np.where(gap > 0, gap, 1), 0), 0, 1)
            j = np.clip(np.floor(s).astype(int), 0, max(nu - 2, 0))
            v, k = np.clip(s - j, 0, 1), np.minimum(j + 1, nu - 1)
            seen = (1 - w) * ((1 - v) * wide[i, j] + v * wide[i, k]) + w * ((1 - v) * wide[i + 1, j] + v * wide[i + 1, k])
            seen = np.where((s >= 0) & (s <= nu - 1), seen, 0)
            there = seen > 0
            return float(((seen - data)[there] ** 2).mean()) if there.any() else np.inf

        for level in range(levels):
            shifts = middle + np.arange(-10, 11) * 10.0**-level
            middle = float(shifts[np.argmin([cost(c) for c in shifts])])
        return pa.table({"scan_id": pa.array([scan.as_py()], pa.int64()), "cor": pa.array([-middle * dso / dsd], pa.float64())})

    rows = views.where("scan_id is not null and angle is not null and row is not null").select(F.col("scan_id").cast("bigint").alias("scan_id"), F.col("angle").cast("double").alias("angle"), "row")
    return rows.groupBy("scan_id").applyInArrow(best, "scan_id bigint, cor double")
