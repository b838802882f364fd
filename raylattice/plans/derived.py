"""CT inputs derived from the driver's tables, as DataFrames and as SQL.

Volumes and projections are long tables of whole numbers, so that sums don't depend on their order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from raylattice.session import table

NZ, NY, NX = 7, 11, 11
NV, NU = 8, 8


def volume(spark: SparkSession, sf_dir: str, flag: str | None = None) -> DataFrame:
    """(z, y, x, value): prices binned by line number, quantity and discount; cells without rows are 0."""
    items = table(spark, sf_dir, "lineitem")
    items = items.where(F.col("l_returnflag") == flag) if flag else items
    binned = items.groupBy(
        (F.col("l_linenumber") - 1).cast("int").alias("z"), F.floor(F.col("l_quantity") / 5).cast("int").alias("y"), F.round(F.col("l_discount") * 100).cast("int").alias("x")
    ).agg(F.sum(F.round(F.col("l_extendedprice") * 100).cast("bigint")).alias("value"))
    return grid(spark).join(binned, ["z", "y", "x"], "left").select("z", "y", "x", F.coalesce("value", F.lit(0)).alias("value"))


def grid(spark: SparkSession) -> DataFrame:
    return spark.range(NZ * NY * NX).select(
        F.floor(F.col("id") / (NY * NX)).cast("int").alias("z"), F.floor(F.col("id") / NX % NY).cast("int").alias("y"), (F.col("id") % NX).cast("int").alias("x")
    )


def projections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(proj_idx, v, u, value): embeddings as detector images of 8 by 8, in millionths."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("proj_idx"), F.posexplode("embedding").alias("i", "e")).select(
        "proj_idx", F.floor(F.col("i") / NU).cast("int").alias("v"), (F.col("i") % NU).cast("int").alias("u"), F.round(F.col("e").cast("double") * 1000000).cast("bigint").alias("value")
    )


def angles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(idx, angle, i0, kind): events as views with an angle in degrees and a count."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("idx"), (F.col("event_id") * 37 % 360).cast("double").alias("angle"), F.round(F.col("value") * 100).cast("bigint").alias("i0"), F.col("event_type").alias("kind")
    )


def incidence(spark: SparkSession) -> DataFrame:
    """(proj, ray, z, y, x, w): rays along x, along y and along the diagonals of each slice, whole weights."""
    cells = grid(spark)
    along = [("0", "z * 100 + y", "1"), ("1", "z * 100 + x", "1"), ("2", "z * 100 + (y + x)", "2")]
    parts = [cells.selectExpr(f"{p} as proj", f"{r} as ray", "z", "y", "x", f"{w} as w") for p, r, w in along]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


GRID_SQL = f"grid AS (SELECT CAST(i // {NY * NX} AS INT) AS z, CAST(i // {NX} % {NY} AS INT) AS y, CAST(i % {NX} AS INT) AS x FROM range({NZ * NY * NX}) t(i))"


def volume_sql(name: str = "vol", flag: str | None = None) -> str:
    where = f"WHERE l_returnflag = '{flag}'" if flag else ""
    return f"""{name} AS (SELECT z, y, x, CAST(coalesce(value, 0) AS BIGINT) AS value FROM grid LEFT JOIN (
  SELECT CAST(l_linenumber - 1 AS INT) AS z, CAST(floor(l_quantity / 5) AS INT) AS y, CAST(round(l_discount * 100) AS INT) AS x,
    sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS value FROM lineitem {where} GROUP BY 1, 2, 3) USING (z, y, x))"""


PROJ_SQL = f"""proj AS (SELECT vec_id AS proj_idx, CAST(i // {NU} AS INT) AS v, CAST(i % {NU} AS INT) AS u, CAST(round(CAST(e AS DOUBLE) * 1000000) AS BIGINT) AS value
  FROM (SELECT vec_id, unnest(embedding) AS e, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings))"""
ANG_SQL = "ang AS (SELECT event_id AS idx, CAST(event_id * 37 % 360 AS DOUBLE) AS angle, CAST(round(value * 100) AS BIGINT) AS i0, event_type AS kind FROM events)"
SYS_SQL = """sys AS (SELECT 0 AS proj, z * 100 + y AS ray, z, y, x, 1 AS w FROM grid UNION ALL SELECT 1, z * 100 + x, z, y, x, 1 FROM grid UNION ALL SELECT 2, z * 100 + y + x, z, y, x, 2 FROM grid)"""
VOL = f"WITH {GRID_SQL}, {volume_sql()}"
VOL2 = f"{VOL}, {volume_sql('vol2', 'A')}"
