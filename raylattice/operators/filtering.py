"""Projection weights and ramp filters: column expressions, an SQL convolution and an FFT kernel."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PI = math.pi


def cosine_weight(u: Column, v: Column, dsd: float) -> Column:
    """DSD / sqrt(DSD² + u² + v²), with u and v in mm from the piercing point."""
    return F.lit(dsd) / F.sqrt(F.lit(dsd * dsd) + u * u + v * v)


def parker_weight(beta: Column, alpha: Column, delta: float, epsilon: float = 0.0, q: float = 1.0) -> Column:
    """Short-scan weight for the view at ``beta`` and the fan angle ``alpha`` (radians, along u); ``delta`` is half
    the fan and ``epsilon`` the overscan."""

    def s(x: Column) -> Column:
        return F.when(x <= -0.5, 0.0).when(x >= 0.5, 1.0).otherwise(0.5 * (1 + F.sin(PI * x)))

    fall = q * (2 * delta - 2 * alpha + epsilon)
    rise = q * (2 * delta + 2 * alpha + epsilon)
    return 0.5 * (
        s(beta / fall - 0.5) + s((beta - 2 * delta + 2 * alpha - epsilon) / fall + 0.5) - s((beta - PI + 2 * alpha) / rise - 0.5) - s((beta - PI - 2 * delta - epsilon) / rise + 0.5)
    )


def offset_weight(t: Column, theta: float, dso: float) -> Column:
    """Redundancy weight of a laterally displaced detector: ``t`` mm at the axis, overlap up to ``theta`` mm."""
    inside = F.sin(PI / 2 * F.atan(t / dso) / math.atan(theta / dso)) + 1
    return F.when(t < -theta, 0.0).when(t > theta, 2.0).otherwise(inside)


def ramp_kernel(n: int) -> np.ndarray:
    """Band-limited ramp at offsets -n/2 .. n/2-1: 1/4 at 0, -1/(pi k)² at odd k, else 0."""
    k = np.arange(-n // 2, n // 2)
    h = np.zeros(n)
    odd = k % 2 == 1
    h[odd] = -1 / (np.pi * k[odd]) ** 2
    h[k == 0] = 0.25
    return h


def ramp_table(spark: SparkSession, reach: int) -> DataFrame:
    """(off, h) for offsets within ``reach``."""
    off = F.col("id").cast("int")
    odd = off % 2 != 0
    return spark.range(-reach, reach + 1).select(off.alias("off"), F.when(off == 0, 0.25).when(odd, -1 / (F.lit(PI) * off) ** 2).otherwise(0.0).alias("h"))


def ramp_spatial(projection: DataFrame, width: int) -> DataFrame:
    """The ramp filter as a sum over the row: each pixel sends its weighted value to the pixels of its row.

    The row's ``width`` bounds the fan-out; the sum is partial before the shuffle.
    """
    to = projection.select("proj_idx", "v", F.col("u").alias("from_"), "value", F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("u"))
    off = F.col("u") - F.col("from_")
    h = F.when(off == 0, 0.25).when(off % 2 != 0, -1 / (F.lit(PI) * off) ** 2).otherwise(0.0)
    return to.groupBy("proj_idx", "v", "u").agg(F.sum(h * F.col("value")).alias("value"))


def window(name: str, n: int) -> np.ndarray:
    """Spectrum of the filter ``name`` on n frequencies (DC first, up to the Nyquist frequency)."""
    w = 2 * np.pi * np.arange(n) / (2 * max(n - 1, 1))
    half = np.ones(n)
    if name == "shepp_logan":
        half[1:] = np.sin(w[1:] / 2) / (w[1:] / 2)
    elif name == "cosine":
        half[1:] = np.cos(w[1:] / 2)
    elif name == "hamming":
        half[1:] = 0.54 + 0.46 * np.cos(w[1:])
    elif name == "hann":
        half[1:] = (1 + np.cos(w[1:])) / 2
    elif name != "ram_lak":
        raise ValueError(f"unknown filter {name!r}")
    return half


def filter_rows(image: np.ndarray, name: str, scale: float) -> np.ndarray:
    """Each detector row (last axis) ramp-filtered by FFT, zero-padded to a power of two of at least 64."""
    width = image.shape[-1]
    n = max(64, 1 << math.ceil(math.log2(2 * width)))
    half = 2 * np.abs(np.fft.rfft(ramp_kernel(n))) * window(name, n // 2 + 1)
    first = (n - width) // 2
    padded = np.zeros((*image.shape[:-1], n))
    padded[..., first : first + width] = image
    return np.fft.irfft(np.fft.rfft(padded) * half, n)[..., first : first + width] * scale


def filtered(projections: DataFrame, nv: int, nu: int, du: float, views: int, dsd: float = 1.0, dso: float = 1.0, name: str = "ram_lak", weight: np.ndarray | None = None) -> DataFrame:
    """(proj_idx, data) with every detector row multiplied by ``weight`` and filtered; ``data`` is the image with u
    fastest. One narrow pass."""
    scale = dsd / dso * 2 * math.pi / views / (4 * du)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            images = np.array(b.column("data").to_pylist(), float).reshape(b.num_rows, nv, nu)
            images = images if weight is None else images * weight
            out = filter_rows(images, name, scale).reshape(b.num_rows, -1)
            yield pa.RecordBatch.from_arrays([b.column("proj_idx"), pa.array(list(out), pa.list_(pa.float64()))], names=["proj_idx", "data"])

    return projections.select(F.col("proj_idx").cast("bigint").alias("proj_idx"), "data").mapInArrow(run, "proj_idx bigint, data array<double>")
