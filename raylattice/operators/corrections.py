"""Detector corrections: scatter, beam hardening, noise, rings, curved detectors. Each is one narrow pass over images;
calibrations are small and travel with it."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

IMAGE = "proj_idx bigint, data array<double>"


def per_image(images: DataFrame, shape: tuple[int, int], run: Callable[..., np.ndarray], *others: str) -> DataFrame:
    """(proj_idx, data) with ``run`` applied to each image (v, u); ``others`` are image columns given as well. Null
    images stay null."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                given = [None if r[c] is None else np.array([np.nan if x is None else x for x in r[c]], float).reshape(shape) for c in ("data", *others)]
                out = None if None in [None if g is None else 0 for g in given] else run(r["proj_idx"], *given).ravel()
                yield pa.RecordBatch.from_arrays([pa.array([r["proj_idx"]], pa.int64()), pa.array([out], pa.list_(pa.float64()))], names=["proj_idx", "data"])

    return images.select(F.col("proj_idx").cast("bigint").alias("proj_idx"), "data", *others).mapInArrow(work, IMAGE)


def convolved(image: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    """The linear convolution of the same size; the kernel is centred."""
    shape = [a + b - 1 for a, b in zip(image.shape, kernel.shape, strict=True)]
    full = np.fft.irfft2(np.fft.rfft2(image, shape) * np.fft.rfft2(kernel, shape), shape)
    at = [(k - 1) // 2 for k in kernel.shape]
    return full[at[0] : at[0] + image.shape[0], at[1] : at[1] + image.shape[1]]


def reduced(image: np.ndarray, by: int) -> np.ndarray:
    """Means of blocks of ``by`` pixels; the image's border fills the last ones."""
    pad = [(0, -n % by) for n in image.shape]
    p = np.pad(image, pad, mode="edge")
    return p.reshape(p.shape[0] // by, by, p.shape[1] // by, by).mean((1, 3))


def enlarged(image: np.ndarray, by: int, shape: tuple[int, int]) -> np.ndarray:
    """Back to ``shape``, linear between the blocks' centres."""
    out = image
    for axis, n in enumerate(shape):
        centres = np.arange(out.shape[axis]) * by + (by - 1) / 2
        out = np.apply_along_axis(lambda v, c=centres, k=n: np.interp(np.arange(k), c, v), axis, out)
    return out


def distances(shape: tuple[int, int], pitch: tuple[float, float]) -> np.ndarray:
    v, u = ((np.arange(2 * n - 1) - (n - 1)) * p for n, p in zip(shape, pitch, strict=True))
    return np.hypot(v[:, None], u)


def point_scatter(image: np.ndarray, pitch: tuple[float, float], p: list[float], by: int = 8) -> np.ndarray:
    """The image less what its detector scatters: the kernel p0 e^(-p1 r) + p2 e^(-p3 (r - p4)³), scaled to the sum p5,
    on an image reduced ``by`` times; not below a tiny positive value."""
    small = reduced(image, by)
    r = distances(small.shape, tuple(d * by for d in pitch)) / 10  # cm
    kernel = p[0] * np.exp(-p[1] * r) + p[2] * np.exp(-p[3] * np.clip(r - p[4], 0, None) ** 3)
    kernel *= p[5] / kernel.sum()
    return np.maximum(image - enlarged(convolved(small, kernel), by, image.shape), np.finfo(float).eps)


def smooth(image: np.ndarray, sigma: float) -> np.ndarray:
    if sigma <= 0:
        return image
    k = np.exp(-0.5 * (np.arange(-int(3 * sigma) - 1, int(3 * sigma) + 2) / sigma) ** 2)
    k /= k.sum()
    pad = len(k) // 2
    for axis in (0, 1):
        wide = np.pad(image, [(pad, pad) if a == axis else (0, 0) for a in (0, 1)], mode="edge")
        image = np.apply_along_axis(lambda v: np.convolve(v, k, "valid"), axis, wide)
    return image


def object_scatter(image: np.ndarray, blank: np.ndarray, groups: list[dict], pitch: tuple[float, float], mu: float, by: int = 12, rounds: int = 8, relax: float = 0.005, least: float = 1e-16) -> np.ndarray:
    """The primary part of an image by adaptive scatter kernels.

    ``groups`` has, by rising ``thickness`` (mm of water from which it holds), the fit's A, alpha, beta, sigma1, sigma2,
    B and gamma. In each round the thickness gives each pixel's group; its amplitude A (I/I0)^alpha ln(I0/I)^beta is
    spread by two Gaussians, weakened by gamma times the thickness; the primary is the image less the scatter, at least
    ``relax`` of it. It ends after ``rounds`` or when the scatter hardly changes.
    """
    small, air = np.maximum(reduced(image, by), 1e-9), np.maximum(reduced(blank, by), 1e-9)
    step = tuple(d * by for d in pitch)
    r = distances(small.shape, step)
    area = step[0] * step[1]
    primary, scatter = small.copy(), np.zeros_like(small)
    bounds = [g["thickness"] for g in groups] + [np.inf]
    for _ in range(rounds):
        path = np.log(np.maximum(air / primary, 1.0))
        depth = smooth(path / mu, 1.0)
        rim = np.clip(depth / max(depth.max(), 1e-9) * 2, 0, 1)
        now = np.zeros_like(small)
        for g, lo, hi in zip(groups, bounds, bounds[1:], strict=False):
            mask = (depth > lo) & (depth < hi) if lo > 0 else depth < hi
            amplitude = np.where(mask, g["A"] * (primary / air) ** g["alpha"] * np.maximum(path, 1e-9) ** g["beta"], 0.0) * primary * rim
            form = np.exp(-0.5 * (r / g["sigma1"]) ** 2) + g["B"] * np.exp(-0.5 * (r / g["sigma2"]) ** 2)
            form *= area / 1e4
            now += (1 - g["gamma"] * depth / 10) * convolved(amplitude, form) + g["gamma"] / 10 * convolved(amplitude * depth, form)
        change = np.mean((now - scatter) ** 2)
        scatter = np.clip(now, 0, None)
        primary = np.maximum(small - scatter, relax * small)
        if change < least:
            break
    return np.maximum(image - enlarged(scatter, by, image.shape), relax * image)


def hardening_table(energies: np.ndarray, spectrum: np.ndarray, mu: np.ndarray, depths: np.ndarray) -> np.ndarray:
    """-ln(F(depth) / F(0)) of a spectrum behind a material of each depth."""
    seen = np.exp(-np.outer(depths, mu)) @ (spectrum * energies)
    return -np.log(seen / (spectrum * energies).sum())


def beam_hardening(images: DataFrame, knots: list[tuple[float, float]]) -> DataFrame:
    """Line integrals mapped to those of a single energy: linear between the calibration's knots, its last slope
    beyond. Column expressions only."""
    ks = sorted(knots)

    def mapped(x):
        out = None
        for (a, ya), (b, yb) in zip(ks, ks[1:], strict=False):
            line = ya + (x - a) * ((yb - ya) / (b - a))
            out = F.when(x < b, line) if out is None else out.when(x < b, line)
        (a, ya), (b, yb) = ks[-2:]
        return out.otherwise(yb + (x - b) * ((yb - ya) / (b - a)))

    return images.withColumn("data", F.transform("data", mapped))


def noisy(images: DataFrame, shape: tuple[int, int], photons: float = 60_000, mean: float = 0.0, sigma: float = 0.5, seed: int = 0) -> DataFrame:
    """Line integrals with photon and electronic noise. Each view has its own random stream, so that the result
    doesn't depend on the partitioning. Counts that aren't positive become 1."""
    top = images.agg(F.max(F.array_max("data"))).first()[0] or 1.0

    def add(i: int, p: np.ndarray) -> np.ndarray:
        rng = np.random.default_rng([seed, i])
        counts = rng.poisson(photons * np.exp(-p / top)) + rng.normal(mean, sigma, p.shape)
        return -np.log(np.maximum(counts, 1.0) / photons) * top

    return per_image(images, shape, add)


def ring_removal(images: DataFrame, shape: tuple[int, int], reach: int = 4) -> DataFrame:
    """The median of 2 reach + 1 pixels along u, mirrored at the borders."""

    def run(_: int, p: np.ndarray) -> np.ndarray:
        wide = np.pad(p, [(0, 0), (reach, reach)], mode="symmetric")
        return np.median(np.lib.stride_tricks.sliding_window_view(wide, 2 * reach + 1, axis=1), axis=2)

    return per_image(images, shape, run)


def median3(images: DataFrame, shape: tuple[int, int]) -> DataFrame:
    """The median of 3 by 3 pixels, mirrored at the borders."""

    def run(_: int, p: np.ndarray) -> np.ndarray:
        wide = np.pad(p, 1, mode="symmetric")
        return np.median(np.lib.stride_tricks.sliding_window_view(wide, (3, 3)).reshape(*p.shape, 9), axis=2)

    return per_image(images, shape, run)


def polar_rings(slices: DataFrame, n: int, reach: int = 4) -> DataFrame:
    """Ring removal in square slices: on a polar grid each circle's mean offset from its neighbours' median is taken
    off."""

    def run(_: int, p: np.ndarray) -> np.ndarray:
        c = (n - 1) / 2
        yy, xx = np.indices(p.shape) - c
        r = np.hypot(yy, xx)
        k = np.minimum(np.round(r).astype(int), int(r.max()))
        mean = np.bincount(k.ravel(), p.ravel()) / np.maximum(np.bincount(k.ravel()), 1)
        wide = np.pad(mean, reach, mode="edge")
        level = np.median(np.lib.stride_tricks.sliding_window_view(wide, 2 * reach + 1), axis=1)
        return p - (mean - level)[k]

    return per_image(slices, (n, n), run)


def mean3(images: DataFrame, shape: tuple[int, int]) -> DataFrame:
    """The mean of 3 by 3 pixels, mirrored at the borders."""

    def run(_: int, p: np.ndarray) -> np.ndarray:
        return np.lib.stride_tricks.sliding_window_view(np.pad(p, 1, mode="symmetric"), (3, 3)).mean((2, 3))

    return per_image(images, shape, run)


def flat_detector(images: DataFrame, shape: tuple[int, int], pitch: float, dsd: float, oversample: int = 1, arc_pitch: float | None = None) -> DataFrame:
    """Images of a detector curved about the source, resampled along u to a flat one of the same width, with
    ``oversample`` pixels for each. ``arc_pitch`` is the pixels' size along the arc, ``pitch`` on the flat detector."""
    nu = shape[1]
    flat = (np.arange(nu * oversample) - (nu * oversample - 1) / 2) * pitch / oversample
    at = dsd * np.arctan(flat / dsd)  # the arc that a flat pixel's ray meets
    own = (np.arange(nu) - (nu - 1) / 2) * (arc_pitch or pitch)

    def run(_: int, p: np.ndarray) -> np.ndarray:
        return np.stack([np.interp(at, own, row) for row in p])

    return per_image(images, shape, run)


def holes_filled(images: DataFrame, shape: tuple[int, int], tol: float = 1e-10) -> DataFrame:
    """NaN and null pixels from the surface that is the mean of its neighbours everywhere in the holes (solved by
    conjugate gradients to ``tol``); an image without any other stays as it is."""

    def around(q: np.ndarray) -> np.ndarray:
        w = np.pad(q, 1)
        return w[:-2, 1:-1] + w[2:, 1:-1] + w[1:-1, :-2] + w[1:-1, 2:]

    def run(_: int, p: np.ndarray) -> np.ndarray:
        bad = ~np.isfinite(p)
        if not bad.any() or bad.all():
            return p
        count, mean = around(np.ones(p.shape)), p[~bad].mean()
        x = np.zeros(p.shape)
        r = np.where(bad, around(np.where(bad, 0.0, p - mean)), 0.0)
        d, now = r, (r * r).sum()
        start = now
        for _ in range(10 * int(bad.sum()) + 10):
            if now <= tol**2 * start:
                return np.where(bad, x + mean, p)
            q = np.where(bad, count * d - around(d), 0.0)
            step = now / (d * q).sum()
            x, r = x + step * d, r - step * q
            before, now = now, (r * r).sum()
            d = r + now / before * d
        raise ValueError("a hole's surface didn't settle")

    return per_image(images, shape, run)
