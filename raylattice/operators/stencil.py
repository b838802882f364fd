"""Neighbour stencils over volumes as window functions: gradients, total variation, denoising steps, medians.

Each axis is one window partitioned by the other two; a line of voxels is bounded by the grid.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

AXES = ("z", "y", "x")


def line(axis: str) -> Window:
    return Window.partitionBy(*[a for a in AXES if a != axis]).orderBy(axis)


def backward(volume: DataFrame, column: str = "value", prefix: str = "d") -> DataFrame:
    """``dz, dy, dx``: differences to the previous cell, 0 at the border."""
    v = F.col(column).cast("double")
    return volume.withColumns({f"{prefix}{a}": F.coalesce(v - F.lag(v).over(line(a)), F.lit(0.0)) for a in AXES})


def ahead(volume: DataFrame, column: str = "value", prefix: str = "g") -> DataFrame:
    """``gz, gy, gx``: differences to the next cell, 0 at the border."""
    v = F.col(column).cast("double")
    return volume.withColumns({f"{prefix}{a}": F.coalesce(F.lead(v).over(line(a)) - v, F.lit(0.0)) for a in AXES})


def length(prefix: str, eps: float = 0.0) -> Column:
    return F.sqrt(sum((F.col(f"{prefix}{a}") ** 2 for a in AXES[1:]), F.col(f"{prefix}{AXES[0]}") ** 2) + eps)


def tv_norm(volume: DataFrame) -> DataFrame:
    """One row ``tv``: the sum of the lengths of the backward gradient."""
    return backward(volume).agg(F.sum(length("d")).alias("tv"))


def tv_gradient(volume: DataFrame, eps: float = 1e-8, delta: float | None = None) -> DataFrame:
    """(z, y, x, value): the gradient of the total variation; with ``delta`` each difference d is weighted by
    exp(-(d/delta)²) first (adaptive total variation)."""
    d = backward(volume)
    if delta is not None:
        d = d.withColumns({f"d{a}": F.col(f"d{a}") * F.exp(-F.pow(F.col(f"d{a}") / delta, 2)) for a in AXES})
    d = d.withColumn("len", length("d", eps))
    here = sum((F.col(f"d{a}") for a in AXES[1:]), F.col(f"d{AXES[0]}")) / F.col("len")
    d = d.withColumns({f"q{a}": F.col(f"d{a}") / F.col("len") for a in AXES})
    after = sum((F.coalesce(F.lead(f"q{a}").over(line(a)), F.lit(0.0)) for a in AXES[1:]), F.coalesce(F.lead(f"q{AXES[0]}").over(line(AXES[0])), F.lit(0.0)))
    return d.select(*AXES, (here - after).alias("value"))


def descent_step(volume: DataFrame, gradient: DataFrame, alpha: float) -> DataFrame:
    """x - alpha g / sqrt(sum g² + 1e-7)."""
    size = gradient.agg(F.sqrt(F.sum(F.col("value") ** 2) + 1e-7).alias("size"))
    return volume.join(gradient.withColumnRenamed("value", "g"), list(AXES)).select(*AXES, (F.col("value") - alpha * F.col("g") / size.scalar()).alias("value"))


def piccs_gradient(volume: DataFrame, prior: DataFrame, share: float, eps: float = 1e-6) -> DataFrame:
    """(1 - share) times the gradient for x, plus share times the one for x - prior."""
    off = volume.join(prior.withColumnRenamed("value", "p"), list(AXES)).select(*AXES, (F.col("value") - F.col("p")).alias("value"))
    own, other = tv_gradient(volume, eps), tv_gradient(off, eps).withColumnRenamed("value", "o")
    return own.join(other, list(AXES)).select(*AXES, ((1 - share) * F.col("value") + share * F.col("o")).alias("value"))


def rof_step(state: DataFrame, weight: float, tau1: float, tau2: float) -> DataFrame:
    """One primal-dual step of the denoising model: ``state`` has f, u and the dual pz, py, px.

    u = u(1 - tau1) + tau1 (f + div p / weight); then p = q / max(1, |q|) with q = p + tau2 grad u.
    """
    div = sum((F.col(f"p{a}") - F.coalesce(F.lag(f"p{a}").over(line(a)), F.lit(0.0)) for a in AXES[1:]), F.col("pz") - F.coalesce(F.lag("pz").over(line("z")), F.lit(0.0)))
    s = state.withColumn("u", F.col("u") * (1 - tau1) + tau1 * (F.col("f") + div / weight))
    s = ahead(s, "u")
    s = s.withColumns({f"q{a}": F.col(f"p{a}") + tau2 * F.col(f"g{a}") for a in AXES})
    size = F.greatest(F.lit(1.0), length("q"))
    return s.select(*AXES, "f", "u", *[(F.col(f"q{a}") / size).alias(f"p{a}") for a in AXES])


def median_along(image: DataFrame, by: list[str], at: str, reach: int) -> DataFrame:
    """``value`` replaced by the median of the ``2 reach + 1`` values around it along ``at``; at the borders, of
    those there are (the lower one of two)."""
    w = Window.partitionBy(*by).orderBy(at).rowsBetween(-reach, reach)
    near = F.sort_array(F.collect_list("value").over(w))
    return image.select(*by, at, F.element_at(near, F.floor((F.size(near) + 1) / 2).cast("int")).alias("value"))
