"""Image quality and norms: one aggregation each, over an equi-join of the two images."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

K1, K2 = 0.01, 0.02


def paired(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    return before.select(*keys, F.col("value").cast("double").alias("p")).join(after.select(*keys, F.col("value").cast("double").alias("r")), keys)


def quality(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """One row (rmse, nrmse, ssd, cc, uqi, mssim) of ``after`` against ``before``, over cells that both have.

    nrmse keeps the cell count outside its root and adds 1e-5; uqi mixes the sample covariance with population
    variances; mssim uses K d² with d the range of ``before``, and the mean of one global window. Without any
    common cell all are null.
    """
    p, r = F.col("p"), F.col("r")
    s = paired(before, after, keys).agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.sum((p - r) * (p - r)).alias("ssd"), F.sum(r * r).alias("rr"), F.corr("p", "r").alias("cc"),
        F.avg("p").alias("mp"), F.avg("r").alias("mr"), F.var_pop("p").alias("vp"), F.var_pop("r").alias("vr"), F.covar_samp("p", "r").alias("c"), (F.max("p") - F.min("p")).alias("d"),
    )
    rmse = F.sqrt(F.col("ssd") / F.col("n"))
    c1, c2 = K1 * F.col("d") ** 2, K2 * F.col("d") ** 2
    light = (2 * F.col("mp") * F.col("mr") + c1) / (F.col("mp") ** 2 + F.col("mr") ** 2 + c1)
    contrast = (2 * F.sqrt("vp") * F.sqrt("vr") + c2) / (F.col("vp") + F.col("vr") + c2)
    structure = (F.col("c") + c2 / 2) / (F.sqrt("vp") * F.sqrt("vr") + c2 / 2)
    return s.select(
        rmse.alias("rmse"), (rmse / (F.lit(1e-5) + F.sqrt("rr") / F.col("n"))).alias("nrmse"), "ssd", "cc",
        ((2 * F.col("c") / (F.col("vr") + F.col("vp"))) * (2 * F.col("mr") * F.col("mp") / (F.col("mr") ** 2 + F.col("mp") ** 2))).alias("uqi"),
        (light * contrast * structure / F.col("n")).alias("mssim"),
    )


def norm(image: DataFrame, order: float = 2) -> DataFrame:
    """One row ``norm``: the p-norm of the values; ``float('inf')`` gives the largest size."""
    v = F.abs(F.col("value").cast("double"))
    if order == float("inf"):
        return image.agg(F.max(v).alias("norm"))
    if order == 1:
        return image.agg(F.sum(v).alias("norm"))
    return image.agg(F.pow(F.sum(F.pow(v, F.lit(float(order)))), F.lit(1 / order)).alias("norm"))


def extremes(image: DataFrame) -> DataFrame:
    """One row: smallest, largest, mean and population deviation."""
    v = F.col("value").cast("double")
    return image.agg(F.min(v).alias("least"), F.max(v).alias("most"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("deviation"))


def relative_error(image: DataFrame, truth: DataFrame, keys: list[str]) -> DataFrame:
    """One row ``error``: the norm of the difference over that of ``truth``; null where that is 0 or nothing is common."""
    p, r = F.col("p"), F.col("r")
    s = paired(image, truth, keys).agg(F.sum((p - r) * (p - r)).alias("d"), F.sum(r * r).alias("rr"))
    return s.select(F.sqrt(F.try_divide(F.col("d"), F.col("rr"))).alias("error"))


def sample_quality(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """One row (rmse, cc, uqi) from sample variances throughout."""
    p, r = F.col("p"), F.col("r")
    s = paired(before, after, keys).agg(
        F.avg((p - r) * (p - r)).alias("d"), F.covar_samp("p", "r").alias("c"), F.var_samp("p").alias("vp"), F.var_samp("r").alias("vr"), F.avg("p").alias("mp"), F.avg("r").alias("mr"),
    )
    light = F.try_divide(2 * F.col("mp") * F.col("mr"), F.col("mp") ** 2 + F.col("mr") ** 2)
    return s.select(F.sqrt("d").alias("rmse"), F.try_divide(F.col("c"), F.sqrt("vp") * F.sqrt("vr")).alias("cc"), (F.try_divide(2 * F.col("c"), F.col("vp") + F.col("vr")) * light).alias("uqi"))


def cosine(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """One row ``c``: the cosine between two images, with a floor of 1e-6 under the norms' product."""
    p, r = F.col("p"), F.col("r")
    s = paired(a, b, keys).agg(F.sum(p * r).alias("pr"), F.sum(p * p).alias("pp"), F.sum(r * r).alias("rr"))
    return s.select((F.col("pr") / F.greatest(F.sqrt("pp") * F.sqrt("rr"), F.lit(1e-6))).alias("c"))


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    kept: list[Column] = [F.round(c, digits).alias(c) if c in columns else F.col(c) for c in df.columns]
    return df.select(*kept)
