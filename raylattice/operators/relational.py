"""Projection, backprojection and update steps as joins and aggregations over long tables.

A volume is (z, y, x, value), a projection (proj, ray, value), the system matrix (proj, ray, z, y, x, w). Sums are
partial before the shuffle; the joins are equi-joins on cell or ray, so that Spark broadcasts or shuffles either side
by its size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from raylattice.session import materialise

CELL = ["z", "y", "x"]
RAY = ["proj", "ray"]


def ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0 or null."""
    return F.when(b == 0, 0.0).otherwise(F.coalesce(a / b, F.lit(0.0)))


def project_axis(volume: DataFrame, keep: list[str], step: float = 1.0) -> DataFrame:
    """The parallel projection along the axis left out of ``keep``: path length times the sum."""
    total = F.sum("value")
    return volume.groupBy(*keep).agg((total if step == 1.0 else total * step).alias("value"))


def backproject_axis(projection: DataFrame, volume_grid: DataFrame, keep: list[str]) -> DataFrame:
    """Each cell's value of the projection along one axis: the adjoint of ``project_axis``."""
    return volume_grid.select(*CELL).join(projection, keep).select(*CELL, "value")


def forward(system: DataFrame, volume: DataFrame) -> DataFrame:
    """A x: the weighted sum of the cells on each ray."""
    return system.join(volume, CELL).groupBy(*RAY).agg(F.sum(F.col("w") * F.col("value")).alias("value"))


def adjoint(system: DataFrame, projection: DataFrame) -> DataFrame:
    """A' b, exactly: the weighted sum of the rays through each cell."""
    return system.join(projection, RAY).groupBy(*CELL).agg(F.sum(F.col("w") * F.col("value")).alias("value"))


def row_sums(system: DataFrame) -> DataFrame:
    return system.groupBy(*RAY).agg(F.sum("w").alias("row_w"))


def column_sums(system: DataFrame) -> DataFrame:
    return system.groupBy(*CELL).agg(F.sum("w").alias("col_w"))


def sirt_step(system: DataFrame, volume: DataFrame, measured: DataFrame, relax: float = 1.0) -> DataFrame:
    """x + relax V A' W (b - A x), not below 0, with W and V the inverse row and column sums."""
    residual = (
        measured.withColumnRenamed("value", "b").join(forward(system, volume), RAY, "left").join(row_sums(system), RAY)
        .select(*RAY, ratio(F.col("b") - F.coalesce("value", F.lit(0)), F.col("row_w")).alias("value"))
    )
    update = adjoint(system, residual).withColumnRenamed("value", "d").join(column_sums(system), CELL)
    return volume.join(update, CELL, "left").select(*CELL, F.greatest(F.lit(0.0), F.col("value") + relax * F.coalesce(ratio(F.col("d"), F.col("col_w")), F.lit(0.0))).alias("value"))


def mlem_step(system: DataFrame, volume: DataFrame, measured: DataFrame) -> DataFrame:
    """x A'(b / A x) / A' 1; zero denominators contribute nothing."""
    quotient = measured.withColumnRenamed("value", "b").join(forward(system, volume), RAY).select(*RAY, ratio(F.col("b"), F.col("value")).alias("value"))
    update = adjoint(system, quotient).withColumnRenamed("value", "d").join(column_sums(system), CELL)
    return volume.join(update, CELL).select(*CELL, (F.col("value") * ratio(F.col("d"), F.col("col_w"))).alias("value"))


def dot(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """One row ``s``: the inner product over ``keys``."""
    return a.join(b.withColumnRenamed("value", "other"), keys).agg(F.sum(F.col("value") * F.col("other")).alias("s"))


def combined(a: DataFrame, b: DataFrame, keys: list[str], factor: DataFrame) -> DataFrame:
    """a + factor b, where factor is a one-row table with column ``f``; cells missing from either side count as 0."""
    joined = a.join(b.withColumnRenamed("value", "other"), keys, "full")
    return joined.select(*keys, (F.coalesce("value", F.lit(0.0)) + factor.scalar() * F.coalesce("other", F.lit(0.0))).alias("value"))


def cgls(system: DataFrame, measured: DataFrame, steps: int) -> DataFrame:
    """x after ``steps`` conjugate gradient steps for least squares, from 0; scalars stay in one-row tables."""
    r = measured.select(*RAY, F.col("value").cast("double").alias("value"))
    s = materialise(adjoint(system, r))
    p, x = s, s.select(*CELL, F.lit(0.0).alias("value"))
    gamma = materialise(dot(s, s, CELL))
    for _ in range(steps):
        q = forward(system, p)
        qq = dot(q, q, RAY)
        alpha = gamma.select(ratio(F.col("s"), qq.scalar()).alias("f"))
        alpha = materialise(alpha)
        x = materialise(combined(x, p, CELL, alpha))
        r = materialise(combined(r, q, RAY, alpha.select((-F.col("f")).alias("f"))))
        s = materialise(adjoint(system, r))
        after = materialise(dot(s, s, CELL))
        beta = after.select(ratio(F.col("s"), gamma.scalar()).alias("f"))
        p, gamma = materialise(combined(s, p, CELL, beta)), after
    return x
