"""Proton radiography: curved paths binned to pixels, and the path-weighted mean energy loss of each pixel."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from raylattice.session import materialise, spread

PART = "pixel bigint, w double, wv double, rejected bigint"
NEEDED = ("px_in", "py_in", "px_out", "py_out", "dx_in", "dy_in", "dx_out", "dy_out", "wepl")


def range_of(energy: float) -> float:
    """Range in water (mm) of protons of an energy (MeV)."""
    return 10 * 0.00244 * energy**1.75


def path(t: np.ndarray, a: np.ndarray, b: np.ndarray, da: np.ndarray, db: np.ndarray) -> np.ndarray:
    """Cubic Hermite curves from a to b with end slopes da and db, at the parameters t."""
    a, b, da, db = (x[:, None] for x in (a, b, da, db))
    h = t[None]
    return (2 * h**3 - 3 * h**2 + 1) * a + (h**3 - 2 * h**2 + h) * da + (3 * h**2 - 2 * h**3) * b + (h**3 - h**2) * db


def project(protons: DataFrame, shape: tuple[int, int], pitch: tuple[float, float], distance: float, energy: float, focus: float | None = None, samples: int = 256) -> DataFrame:
    """(pixel, value, rejected): per pixel (row-major, y slow) the mean wepl weighted by the squared share of each
    path's length in it; ``rejected`` repeats the number of protons left out.

    Directions are slopes. A path is a cubic through both trackers, ``distance`` apart, whose end slopes are stretched
    by 1.01 + 0.43 q² and 0.99 - 0.46 q², q being wepl over the range. ``focus`` is the distance of the entry tracker
    from a point source (cone beam): paths are then binned where they point on the exit plane. Rows with nulls or values
    that aren't finite, with a wepl beyond the range or outside the detector all along count as rejected. Each task adds up
    its pixels first; the shuffle carries at most one row per pixel and task.
    """
    ny, nx = shape
    reach = range_of(energy)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, wv, rejected = np.zeros(ny * nx), np.zeros(ny * nx), 0
        t = (np.arange(samples) + 0.5) / samples
        for batch in batches:
            c = {k: batch.column(k).to_numpy(zero_copy_only=False).astype(float) for k in NEEDED}
            ok = np.isfinite(np.stack(list(c.values()))).all(0) & (c["wepl"] <= reach) & (c["wepl"] >= 0)
            rejected += int((~ok).sum())
            c = {k: v[ok] for k, v in c.items()}
            for start in range(0, len(c["wepl"]), 4096):
                d = {k: v[start : start + 4096] for k, v in c.items()}
                q2 = (d["wepl"] / reach) ** 2
                first, last = distance * (1.01 + 0.43 * q2), distance * (0.99 - 0.46 * q2)
                x = path(t, d["px_in"], d["px_out"], d["dx_in"] * first, d["dx_out"] * last)
                y = path(t, d["py_in"], d["py_out"], d["dy_in"] * first, d["dy_out"] * last)
                if focus is not None:
                    scale = (focus + distance) / (focus + t * distance)
                    x, y = x * scale, y * scale
                length = np.sqrt(np.gradient(x, axis=1) ** 2 + np.gradient(y, axis=1) ** 2 + (distance / samples) ** 2)
                col, row = np.floor(x / pitch[1] + nx / 2).astype(int), np.floor(y / pitch[0] + ny / 2).astype(int)
                inside = (col >= 0) & (col < nx) & (row >= 0) & (row < ny)
                rejected += int((~inside.any(1)).sum())
                # A path stays in a pixel for many samples: runs are added up first, then what a pixel got of a path.
                proton = np.arange(len(q2))[:, None] * (ny * nx)
                key = np.where(inside, proton + row * nx + col, -1).ravel()
                first_of = np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1]) if len(key) else np.zeros(0, int)
                runs = np.add.reduceat(length.ravel(), first_of) if len(key) else np.zeros(0)
                kept = key[first_of] >= 0
                key, at = np.unique(key[first_of][kept], return_inverse=True)
                share = np.bincount(at, runs[kept], len(key)) / length.sum(1)[key // (ny * nx)]
                w += np.bincount(key % (ny * nx), share**2, ny * nx)
                wv += np.bincount(key % (ny * nx), share**2 * d["wepl"][key // (ny * nx)], ny * nx)
        there = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(w[there]), pa.array(wv[there]), pa.array(np.zeros(len(there), np.int64))], names=["pixel", "w", "wv", "rejected"])
        yield pa.RecordBatch.from_arrays([pa.array([-1]), pa.array([0.0]), pa.array([0.0]), pa.array([rejected])], names=["pixel", "w", "wv", "rejected"])

    parts = spread(protons.select(*NEEDED)).mapInArrow(run, PART)
    # One row per pixel: kept, so that the tracks are read once for the image and the rejected ones.
    pixels = materialise(parts.groupBy("pixel").agg(F.sum("w").alias("w"), F.sum("wv").alias("wv"), F.sum("rejected").alias("rejected")))
    left_out = pixels.agg(F.sum("rejected").alias("r"))
    return pixels.where("pixel >= 0").select("pixel", (F.col("wv") / F.col("w")).alias("value"), left_out.scalar().alias("rejected"))
