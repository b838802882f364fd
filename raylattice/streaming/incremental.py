"""Streams of views: running sums of backprojections and the greedy view filter, as Structured Streaming queries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from raylattice.geometry import VIEW_FIELDS, Geometry
from raylattice.operators import kernels

CELL = "cell int, value double"


def backprojected_cells(views: DataFrame, g: Geometry, kind: str = "fdk") -> DataFrame:
    """(cell, value): each view's contribution to each voxel. Narrow, so it runs on a stream as on a table; filtered
    backprojection is linear in the views."""
    n = int(np.prod(g.n_voxel))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            total = np.zeros(n)
            for v in b.to_pylist():
                ray, cell, w = kernels.entries(g, v, kind)
                total += np.bincount(cell, w * np.array(v["data"])[ray], n)
            there = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(there.astype(np.int32)), pa.array(total[there])], names=["cell", "value"])

    return views.select(*VIEW_FIELDS, "data").mapInArrow(run, CELL)


def running_volume(views: DataFrame, g: Geometry, kind: str = "fdk") -> DataFrame:
    """(cell, value) summed over all views so far; for ``outputMode`` complete or update. The state is one number per
    voxel."""
    return backprojected_cells(views, g, kind).groupBy("cell").agg(F.sum("value").alias("value"))


def readings_per_window(readings: DataFrame, at: str = "read_at", delay: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """(window_start, scanner_id, readings, airnorm): hourly means per scanner; readings later than ``delay`` behind the
    newest are dropped and the windows' state with them."""
    timed = readings.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, delay)
    sums = timed.groupBy(F.window(at, width).alias("w"), "scanner_id").agg(F.count(F.lit(1)).alias("readings"), F.avg("airnorm").alias("airnorm"))
    return sums.select(F.col("w.start").alias("window_start"), "scanner_id", "readings", "airnorm")


def spaced_stream(views: DataFrame, threshold: float, key: str = "scan_id") -> DataFrame:
    """(key, idx, angle): the greedy view filter on a stream. The state of a scan is the last kept angle; within a
    micro-batch views are taken in order of ``idx``."""

    def keep(k: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(frames)).sort_values("idx")
        out = []
        for idx, angle in zip(rows["idx"], rows["angle"], strict=True):
            if last is None or abs(angle - last) > threshold:
                out.append((k[0], int(idx), float(angle)))
                last = float(angle)
        if last is not None:
            state.update((last,))
        yield pd.DataFrame(out, columns=[key, "idx", "angle"])

    from pyspark.sql.streaming.state import GroupStateTimeout

    rows = views.select(F.col(key).cast("bigint").alias(key), F.col("idx").cast("bigint").alias("idx"), F.col("angle").cast("double").alias("angle"))
    return rows.groupBy(key).applyInPandasWithState(keep, f"{key} bigint, idx bigint, angle double", "last double", "append", GroupStateTimeout.NoTimeout)
