"""Views and their subsets, pointwise corrections, masks, phantoms, energies: column work without Python."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from raylattice.functions.algebra import not_a_knot
from raylattice.operators.lookup import around, nearest
from raylattice.session import broadcast_if_small, materialise, placed

EPS = 2.220446049250313e-16


def log_transform(counts: Column, white: Column) -> Column:
    """-ln(I / I0)."""
    return -F.log(counts / white)


def log_normalised(counts: Column, blank: Column) -> Column:
    """ln(max(1, blank / (counts + eps) + eps))."""
    return F.log(F.greatest(F.lit(1.0), blank / (counts + EPS) + EPS))


def enforced_positive(value: Column) -> Column:
    """0 for NaN, infinite and negative values."""
    return F.when(F.isnan(value) | (F.abs(value) == float("inf")) | (value < 0), 0.0).otherwise(value)


def inverse_weight(w: Column, threshold: float) -> Column:
    """1 / w, and 0 at or below the threshold."""
    return F.when(w <= threshold, 0.0).otherwise(1 / w)


def sampled(views: DataFrame, how: str, n: int, total: int | None = None, idx: str = "idx") -> DataFrame:
    """Views by number: ``step`` takes every nth, ``continuous`` the first n, ``equidistant`` n spread over
    ``total``. Filters on the view number, so that pixels of other views aren't decoded."""
    i = F.col(idx)
    if how == "step":
        return views.where(i % n == 0)
    if how == "continuous":
        return views.where(i < n)
    if how == "equidistant":
        if not total:
            raise ValueError("equidistant sampling needs the number of views")
        # i is the rounded place of one of n equal parts
        k = F.round(i * n / total)
        return views.where((F.floor(k * total / n) == i) & (k < n))
    raise ValueError(f"unknown sampling {how!r}")


def subsets(views: DataFrame, blocksize: int, how: str = "ordered", seed: int = 0) -> DataFrame:
    """(idx, block_id, pos_in_block): blocks of ``blocksize`` views, the last may be short.

    ``ordered`` follows the view numbers (0 to n-1), ``random`` numbers the blocks anew and ``random2`` the views,
    both by a hash with ``seed``.
    """
    place = F.col("idx")
    if how == "random2":
        views, place = placed(views.withColumn("hash_", F.xxhash64("idx", F.lit(seed))), "hash_", "idx", name="place_"), F.col("place_")
    elif how not in ("ordered", "random"):
        raise ValueError(f"unknown order {how!r}")
    out = views.select("idx", F.floor(place / blocksize).cast("int").alias("block_id"), (place % blocksize).cast("int").alias("pos_in_block"))
    if how == "random":
        blocks = out.select("block_id").distinct().withColumn("hash_", F.xxhash64("block_id", F.lit(seed)))
        blocks = placed(blocks, "hash_", "block_id", name="to_").select("block_id", F.col("to_").cast("int").alias("to_"))
        out = out.join(broadcast_if_small(blocks, 16), "block_id").select("idx", F.col("to_").alias("block_id"), "pos_in_block")
    return out


def sorted_modulo(views: DataFrame, period: float, angle: str = "angle", idx: str = "idx") -> DataFrame:
    """``views`` with ``place``, their place from 1 in order of the angle modulo ``period``, then of ``idx``."""
    at = placed(views.withColumn("at_", F.pmod(F.col(angle), F.lit(period))), "at_", idx)
    return at.withColumn("place", F.col("place") + 1).drop("at_")


def cylinder(image: DataFrame, cy: float, cx: float, radius: float, outside: float = 0.0, strict: bool = False) -> DataFrame:
    """``value`` kept within the cylinder about (cy, cx) and ``outside`` beyond; ``strict`` leaves the rim out."""
    r2 = (F.col("y") - cy) ** 2 + (F.col("x") - cx) ** 2
    inside = r2 < radius * radius if strict else r2 <= radius * radius
    return image.withColumn("value", F.when(inside, F.col("value")).otherwise(F.lit(outside).cast("double") if outside else F.lit(0)))


#: The three head phantoms' ellipsoids, as half axes a, b, c, centre x, y, z, Euler angles in degrees, amplitude.
#: First that of Kak and Slaney; that of Yu, Ye and Wang has its places with amplitudes of more contrast.
KAK_SLANEY = [
    (0.69, 0.92, 0.9, 0, 0, 0, 0, 0, 0, 2.0),
    (0.6624, 0.874, 0.88, 0, 0, 0, 0, 0, 0, -0.98),
    (0.41, 0.16, 0.21, -0.22, 0, -0.25, 108, 0, 0, -0.02),
    (0.31, 0.11, 0.22, 0.22, 0, -0.25, 72, 0, 0, -0.02),
    (0.21, 0.25, 0.5, 0, 0.35, -0.25, 0, 0, 0, 0.02),
    (0.046, 0.046, 0.046, 0, 0.1, -0.25, 0, 0, 0, 0.02),
    (0.046, 0.023, 0.02, -0.08, -0.65, -0.25, 0, 0, 0, 0.01),
    (0.046, 0.023, 0.02, 0.06, -0.65, -0.25, 90, 0, 0, 0.01),
    (0.056, 0.04, 0.1, 0.06, -0.105, 0.625, 90, 0, 0, 0.02),
    (0.056, 0.056, 0.1, 0, 0.1, 0.625, 0, 0, 0, -0.02),
]
YU_YE_WANG = [1.0, -0.8, -0.2, -0.2, 0.2, 0.2, 0.1, 0.1, 0.2, -0.2]
TOFT_SCHABEL = [
    (0.69, 0.92, 0.81, 0, 0, 0, 0, 0, 0, 1.0),
    (0.6624, 0.874, 0.78, 0, -0.0184, 0, 0, 0, 0, -0.8),
    (0.11, 0.31, 0.22, 0.22, 0, 0, -18, 0, 10, -0.2),
    (0.16, 0.41, 0.28, -0.22, 0, 0, 18, 0, 10, -0.2),
    (0.21, 0.25, 0.41, 0, 0.35, -0.15, 0, 0, 0, 0.1),
    (0.046, 0.046, 0.05, 0, 0.1, 0.25, 0, 0, 0, 0.1),
    (0.046, 0.046, 0.05, 0, -0.1, 0.25, 0, 0, 0, 0.1),
    (0.046, 0.023, 0.05, -0.08, -0.605, 0, 0, 0, 0, 0.1),
    (0.023, 0.023, 0.02, 0, -0.606, 0, 0, 0, 0, 0.1),
    (0.023, 0.046, 0.02, 0.06, -0.605, 0, 0, 0, 0, 0.1),
]


def head_phantom(spark: SparkSession, shape: tuple[int, int, int], kind: str = "yu-ye-wang") -> DataFrame:
    """(z, y, x, value): ``kak-slaney``, ``yu-ye-wang`` or ``toft-schabel``. The centres of the last turn with their
    ellipsoids."""
    if kind == "toft-schabel":
        return ellipsoids(spark, shape, TOFT_SCHABEL, turned_centres=True, ends=True)
    if kind not in ("kak-slaney", "yu-ye-wang"):
        raise ValueError(f"unknown phantom {kind!r}")
    rows = KAK_SLANEY if kind == "kak-slaney" else [(*r[:9], a) for r, a in zip(KAK_SLANEY, YU_YE_WANG, strict=True)]
    return ellipsoids(spark, shape, rows, ends=True)


def ellipsoids(spark: SparkSession, shape: tuple[int, int, int], rows: list[tuple], turned_centres: bool = False, ends: bool = False) -> DataFrame:
    """(z, y, x, value) on [-1, 1]³: the sum of the amplitudes of the ellipsoids (a, b, c, x0, y0, z0, angles in degrees,
    amplitude) that hold the voxel's centre. There is one angle, about z, or three: the frame is turned by the first
    about z, by the second about the new x and by the third about the new z. Ellipsoids turn about their centres, or with
    ``turned_centres`` about the origin. With ``ends`` the first and last voxels' centres lie at -1 and 1, else their outer faces. The few ellipsoids become one expression, so that each voxel is made once and
    nothing is joined."""
    nz, ny, nx = shape
    place = (lambda i, n: i * (2.0 / max(n - 1, 1)) - 1) if ends else (lambda i, n: (i * 2.0 + 1) / n - 1)
    at = [place(F.col(a), n) for a, n in (("x", nx), ("y", ny), ("z", nz))]
    total: Column = F.lit(0.0)
    for a, b, c, x0, y0, z0, *angles, amp in rows:
        phi, theta, psi = (math.radians(t) for t in (*angles, 0, 0)[:3])
        turn = about_z(psi) @ np.array([[1, 0, 0], [0, math.cos(theta), math.sin(theta)], [0, -math.sin(theta), math.cos(theta)]]) @ about_z(phi)
        before = [p if turned_centres else p - q for p, q in zip(at, (x0, y0, z0), strict=True)]
        own = [sum((before[j] * float(turn[i, j]) for j in (1, 2)), before[0] * float(turn[i, 0])) for i in range(3)]
        own = [p - q if turned_centres else p for p, q in zip(own, (x0, y0, z0), strict=True)]
        total = total + F.when((own[0] / a) ** 2 + (own[1] / b) ** 2 + (own[2] / c) ** 2 <= 1, float(amp)).otherwise(0.0)
    cells = spark.range(nz * ny * nx).select(
        F.floor(F.col("id") / (ny * nx)).cast("int").alias("z"), F.floor(F.col("id") / nx % ny).cast("int").alias("y"), (F.col("id") % nx).cast("int").alias("x")
    )
    return cells.select("z", "y", "x", total.alias("value"))


def about_z(angle: float) -> np.ndarray:
    """Turns the frame, not the point."""
    return np.array([[math.cos(angle), math.sin(angle), 0], [-math.sin(angle), math.cos(angle), 0], [0, 0, 1]])


def flat_dark(projection: DataFrame, flats: DataFrame, darks: DataFrame, floor: float = 0.001) -> DataFrame:
    """(proj_idx, v, u, value): -ln of (p - dark) / (flat - dark) over its largest value; ratios that aren't
    positive become ``floor``. Flats and darks are averaged per pixel; the detector's size bounds them."""
    flat = flats.groupBy("v", "u").agg(F.avg("value").alias("flat"))
    dark = darks.groupBy("v", "u").agg(F.avg("value").alias("dark"))
    p = projection.join(flat, ["v", "u"]).join(dark, ["v", "u"])
    p = p.withColumn("t", F.when(F.col("flat") == F.col("dark"), F.lit(floor)).otherwise((F.col("value") - F.col("dark")) / (F.col("flat") - F.col("dark"))))
    p = p.withColumn("t", F.when(F.col("t") > 0, F.col("t")).otherwise(F.lit(floor)))
    top = p.agg(F.max("t").alias("m"))
    return p.select("proj_idx", "v", "u", (-F.log(F.col("t") / top.scalar())).alias("value"))


def dual_energy(low: Column, high: Column, c: list[float]) -> Column:
    """The cubic polynomial of nine coefficients in the low and high energy values."""
    terms = [low, high, low * low, low * high, high * high, low * low * low, high * low * low, low * high * high, high * high * high]
    out = c[0] * terms[0]
    for k, t in zip(c[1:], terms[1:], strict=True):
        out = out + k * t
    return out


def virtual_mono(m1: Column, m2: Column, mu1: float, mu2: float) -> Column:
    return mu1 * m1 + mu2 * m2


def monochromatic(images: DataFrame, attenuation: dict[str, tuple[list[float], list[float]]], materials: tuple[str, str], energy: float) -> DataFrame:
    """(..., data): the images at one energy from thicknesses ``material1`` and ``material2``, with attenuations from
    splines through a table of (energies, attenuations) by material. Raises KeyError for materials it lacks and ValueError
    for energies beyond it."""
    for m in materials:
        if m not in attenuation:
            raise KeyError(f"no attenuation of {m!r}; known are {sorted(attenuation)}")
        if not min(attenuation[m][0]) <= energy <= max(attenuation[m][0]):
            raise ValueError(f"{energy} lies beyond the energies of {m!r}")
    mu1, mu2 = (not_a_knot(*attenuation[m], energy) for m in materials)
    return images.withColumn("data", F.zip_with("material1", "material2", lambda a, b: virtual_mono(a, b, mu1, mu2))).drop("material1", "material2")


def decomposed(low: DataFrame, high: DataFrame, calibration: dict, scanner: str, pair: str, materials: tuple[str, str], model: str = "nearest", tolerance: float | None = None) -> DataFrame:
    """(idx, angle, material1, material2): each high-energy view (idx, angle, data) with its counterpart among the
    low-energy ones mapped to thicknesses of two materials by their polynomials.

    ``model`` is ``nearest``; ``skip``, which leaves out views whose nearest is further than ``tolerance``; or ``linear``
    between the two around a view, the nearest where there is one only. ``calibration`` nests scanner, pair of
    voltages, material and nine coefficients; a name it lacks raises KeyError with those it has. Angles find their
    neighbours first; images are then joined by number."""
    at = calibration
    for key in (scanner, pair):
        if key not in at:
            raise KeyError(f"no calibration for {key!r}; known are {sorted(at)}")
        at = at[key]
    for m in materials:
        if m not in at:
            raise KeyError(f"no calibration for {m!r}; known are {sorted(at)}")
    if model not in ("nearest", "skip", "linear") or model == "skip" and tolerance is None:
        raise ValueError(f"unknown model {model!r}, or no tolerance")
    views, sources = high.select("idx", "angle"), low.select("idx", "angle")
    if model == "linear":
        one = materialise(sources.groupBy("angle").agg(F.min("idx").alias("idx")).select("angle", F.struct("angle", "idx").alias("s_")))
        near = around(views, one)
        lo, hi = F.coalesce("lo_", "hi_"), F.coalesce("hi_", "lo_")
        share = F.when(hi["angle"] > lo["angle"], (F.col("angle") - lo["angle"]) / (hi["angle"] - lo["angle"])).otherwise(0.0)
        near = near.select("idx", share.alias("w_"), lo["idx"].alias("a_"), hi["idx"].alias("b_"))
    else:
        found = nearest(views, sources, tolerance if model == "skip" else None)
        near = found.select(F.col("t_idx").alias("idx"), F.lit(0.0).alias("w_"), F.col("s_idx").alias("a_"), F.col("s_idx").alias("b_"))
    image = lambda k, d: low.select(F.col("idx").alias(k), F.col("data").alias(d))
    both = high.join(near, "idx").join(image("a_", "l_"), "a_").join(image("b_", "h_"), "b_")
    both = both.withColumn("l_", F.zip_with("l_", "h_", lambda a, b: a * (1 - F.col("w_")) + b * F.col("w_")))
    c, d = (at[m] for m in materials)
    return both.select("idx", "angle", F.zip_with("l_", "data", lambda x, y: dual_energy(x, y, c)).alias("material1"), F.zip_with("l_", "data", lambda x, y: dual_energy(x, y, d)).alias("material2"))


def hounsfield_fit(pairs: DataFrame) -> list[float]:
    """(a, b, c) of the least-squares hu = a v² + b v + c over (v, hu), from one pass of power sums."""
    import numpy as np

    v, h = F.col("v").cast("double"), F.col("hu").cast("double")
    row = pairs.agg(*[F.sum(F.pow(v, F.lit(k))).alias(f"s{k}") for k in range(5)], *[F.sum(h * F.pow(v, F.lit(k))).alias(f"t{k}") for k in range(3)]).first()
    a = np.array([[row[f"s{i + j}"] for j in (2, 1, 0)] for i in (2, 1, 0)], float)
    return [float(x) for x in np.linalg.lstsq(a, np.array([row[f"t{i}"] for i in (2, 1, 0)], float), rcond=None)[0]]


def weighted_pixels(tracks: DataFrame) -> DataFrame:
    """(pixel, value): the mean of ``wepl`` weighted by the squared share of the path in the pixel; null where no track
    has a share."""
    w = F.col("share") * F.col("share")
    return tracks.groupBy("pixel").agg(F.try_divide(F.sum(w * F.col("wepl")), F.sum(w)).alias("value"))


def dose(files: DataFrame, factor: float, mas: float, least_bytes: int = 10 * 1024) -> DataFrame:
    """One row (n_proj, ctdi): the dose of the frames, those files above ``least_bytes``."""
    n = F.count_if(F.col("length") > least_bytes)
    return files.agg(n.alias("n_proj"), (factor * mas / 100 * n).alias("ctdi"))


def zero_padded(images: DataFrame, shape: tuple[int, int], left: int, right: int) -> DataFrame:
    """Images with columns of zeros added at both ends of u, as for a displaced detector whose filter must not be cut at
    its edge. Column expressions only."""
    nv, nu = shape
    zeros = lambda n: F.array_repeat(F.lit(0.0), n)
    rows = F.transform(F.sequence(F.lit(0), F.lit(nv - 1)), lambda v: F.concat(zeros(left), F.slice("data", v * nu + 1, F.lit(nu)), zeros(right)))
    return images.withColumn("data", F.flatten(rows))


def union_scans(scans: list[DataFrame]) -> DataFrame:
    """Scans one after the other, the view numbers of each continuing those before. Each scan's size is one
    aggregate; no window runs over all views."""
    out = None
    for s in scans:
        if out is None:
            out = s.select("idx", "angle")
            continue
        size = out.agg(F.coalesce(F.max("idx") + 1, F.lit(0)).alias("n"))
        out = out.unionByName(s.select((F.col("idx") + size.scalar()).alias("idx"), "angle"))
    return out
