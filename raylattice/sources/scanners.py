"""Scanner folders as DataFrames: headers are read on the driver, frames are listed, sampled by number and only then
decoded, each file in the task that reads it."""

from __future__ import annotations

import math
import re
import struct
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from raylattice.geometry import Geometry
from raylattice.operators import corrections
from raylattice.operators.acquisition import log_normalised, sampled
from raylattice.operators.lookup import around, spaced_views
from raylattice.session import broadcast_if_small, materialise, placed
from raylattice.sources import formats

FRAME = "proj_idx bigint, data array<double>"


def text_of(spark: SparkSession, pattern: str) -> str:
    """The one small header file that ``pattern`` names."""
    rows = spark.read.format("binaryFile").load(pattern).select("content").limit(2).collect()
    if len(rows) != 1:
        raise FileNotFoundError(f"{pattern} names {'several files' if rows else 'no file'}")
    return bytes(rows[0]["content"]).decode("utf-8-sig", "replace")


def numbered(spark: SparkSession, folder: str, glob: str, how: str = "step", n: int = 1) -> DataFrame:
    """(idx, path): the folder's frames in order of their names, those that the sampling keeps. Only names are listed
    and sorted; contents aren't read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder).select("path")
    files = placed(files, "path", name="idx").select("idx", "path")
    return sampled(files, how, n, files.count() if how == "equidistant" else None)


def frames(spark: SparkSession, folder: str, glob: str, decode: Callable[[bytes], np.ndarray], how: str = "step", n: int = 1) -> DataFrame:
    """(proj_idx, data): decoded frames, v slow and u fast. A broken frame fails its task, naming the file."""
    kept = numbered(spark, folder, glob, how, n)
    raw = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder).select("path", "content").join(kept, "path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content, i in zip(*(b.column(c).to_pylist() for c in ("path", "content", "idx")), strict=True):
                try:
                    image = decode(content)
                except (ValueError, KeyError, IndexError) as e:
                    raise ValueError(f"{path}: {e}") from e
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([image.astype(float).ravel()], pa.list_(pa.float64()))], names=["proj_idx", "data"])

    return raw.mapInArrow(run, FRAME)


def logged(images: DataFrame, white: float) -> DataFrame:
    """-ln(I / white), with counts below 1 taken as 1."""
    return images.withColumn("data", F.transform("data", lambda x: -F.log(F.greatest(x, F.lit(1.0)) / white)))


def recorded_angles(spark: SparkSession, folder: str) -> dict[int, float]:
    """Radians by view from 0, as a Nikon scanner recorded them: lines with the view's number from 1 and degrees, after
    one heading in .ang files and three in _ctdata.txt files, whose sense is the opposite. Empty without such a file."""
    for glob, headings, sign in (("*.ang", 1, 1.0), ("*_ctdata.txt", 3, -1.0)):
        files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder).select("content").limit(2).collect()
        if len(files) > 1:
            raise FileNotFoundError(f"{folder}/{glob} names several files")
        if files:
            lines = bytes(files[0]["content"]).decode("utf-8-sig", "replace").splitlines()[headings:]
            rows = [re.split(r"[:\s]+", line.strip()) for line in lines if line.strip()]
            try:
                out = {int(r[0]) - 1: sign * math.radians(float(r[1])) for r in rows}
            except (ValueError, IndexError) as e:
                raise ValueError(f"{folder}/{glob}: {e}") from e
            if not out:
                raise ValueError(f"{folder}/{glob} has no angles")
            return out
    return {}


def nikon(spark: SparkSession, folder: str, how: str = "step", n: int = 1) -> tuple[DataFrame, Geometry, DataFrame]:
    """(projections, geometry, angles) of an .xtekct folder with TIFF frames. Angles come from an .ang or else a
    _ctdata.txt file if there is one, otherwise from the header's first angle and step."""
    h = next(v for k, v in formats.ini(text_of(spark, f"{folder}/*.xtekct")).items() if k.lower() == "xtekct")
    f = lambda k: float(h[k])
    g = Geometry(
        (int(f("voxelsz")), int(f("voxelsy")), int(f("voxelsx"))), tuple(f(f"voxels{a}") * f(f"voxelsize{a}") for a in "zyx"),
        (int(f("detectorpixelsy")), int(f("detectorpixelsx"))), (f("detectorpixelsizey"), f("detectorpixelsizex")), f("srctoobject"), f("srctodetector"),
    )
    total, recorded = int(f("projections")), recorded_angles(spark, folder)
    if recorded:
        if lost := [i for i in range(total) if i not in recorded]:
            raise ValueError(f"{folder}: no recorded angle of {len(lost)} of {total} views, first {lost[0]}")
        angles = spark.createDataFrame([(i, recorded[i]) for i in range(total)], "idx bigint, angle double")
    else:
        step, first = f("angularstep"), float(h.get("initialangle", 0) or 0)
        angles = spark.range(total).select(F.col("id").alias("idx"), (-F.radians(F.lit(first) + F.col("id") * step)).alias("angle"))
    return logged(frames(spark, folder, "*.tif*", formats.tiff, how, n), float(h.get("whitelevel", 65535))), g, sampled(angles, how, n, total)


def bruker(spark: SparkSession, folder: str, how: str = "step", n: int = 1, dataset: int | str | None = None) -> tuple[DataFrame, Geometry, DataFrame]:
    """(projections, geometry, angles) of a .log folder with TIFF frames.

    A folder of several connected scans, whose logs and frames are numbered by two digits, needs ``dataset``: a number or
    ``all``, which puts the scans one after the other under the first one's geometry. The frame after the last step
    repeats the first and is left out. With a .csv of detector shifts by view (five heading lines; then view, u and v in
    pixels) angles have off_v and off_u in mm as well."""
    logs = sorted(r["path"] for r in spark.read.format("binaryFile").option("pathGlobFilter", "*.log").load(folder).select("path").collect())
    scans = [p for p in logs if re.search(r"\d\d\.log$", p)] if len(logs) > 1 else []
    if scans and dataset is None:
        raise ValueError(f"{folder} holds {len(scans)} scans; choose one by dataset, or 'all'")
    if scans and dataset == "all":
        parts = [bruker(spark, folder, how, n, k) for k in range(len(scans))]
        before, images, angles = 0, [], []
        for p, _, a in parts:
            images.append(p.withColumn("proj_idx", F.col("proj_idx") + before))
            angles.append(a.withColumn("idx", F.col("idx") + before))
            before += (a.agg(F.max("idx")).first()[0] if a.head(1) else -1) + 1
        return reduce(DataFrame.unionByName, images), parts[0][1], reduce(DataFrame.unionByName, angles)
    own = f"*{int(dataset):02d}" if scans else ""
    if scans and not [p for p in scans if p.endswith(f"{int(dataset):02d}.log")]:
        raise ValueError(f"{folder} has no scan {dataset}")
    h = {k: v for section in formats.ini(text_of(spark, f"{folder}/{own or '*'}.log")).values() for k, v in section.items()}
    f = lambda *ks: float(next(h[k] for k in ks if k in h))
    nv, nu, total, step = int(f("number of rows")), int(f("number of columns")), int(f("number of files")) - 1, f("rotation step (deg)")
    plain = f("camera pixel size (um)") / 1000
    binned = re.match(r"\s*(\d)\D(\d)", h.get("camera binning", ""))
    bin_u, bin_v = (float(b) for b in binned.groups()) if binned else (1.0, 1.0)
    resized = float(h.get("resized in image", 1) or 1)
    dv, du = plain * bin_v * resized, plain * bin_u * resized
    dso, dsd = f("object to source (mm)"), f("camera to source (mm)")
    voxel = float(h["image pixel size (um)"]) / 1000 if "image pixel size (um)" in h else du * dso / dsd
    axis = -(nv / 2 - float(h["optical axis (line)"])) * dv if "optical axis (line)" in h else 0.0
    g = Geometry((nv, nu, nu), (nv * voxel, nu * voxel, nu * voxel), (nv, nu), (dv, du), dso, dsd, off_detector=(axis, 0.0))
    angles = spark.range(total).select(F.col("id").alias("idx"), F.radians(F.col("id") * step).alias("angle"))
    shifts = spark.read.format("binaryFile").option("pathGlobFilter", f"{own}*.csv").load(folder).select("content").orderBy("path").limit(1).collect()
    if shifts:
        lines = bytes(shifts[0]["content"]).decode("utf-8-sig", "replace").splitlines()[5:]
        rows = [(k, *[float(x) for x in line.split(",")[1:3]]) for k, line in enumerate(x for x in lines if x.strip())]
        table = spark.createDataFrame(rows, "idx bigint, u double, v double")
        angles = angles.join(F.broadcast(table), "idx", "left").select("idx", "angle", (F.coalesce("v", F.lit(0.0)) * dv / bin_v + axis).alias("off_v"), (F.coalesce("u", F.lit(0.0)) * du / bin_u).alias("off_u"))
    glob = f"{own}????????.[tT][iI][fF]*" if scans else "*.[tT][iI][fF]*"
    white = float(1 << int(h["depth (bits)"])) if "depth (bits)" in h else 65536.0
    images = frames(spark, folder, glob, formats.tiff, how, n).where(F.col("proj_idx") < total)
    return logged(images, white), g, sampled(angles, how, n, total)


def yxlon(spark: SparkSession, folder: str, how: str = "step", n: int = 1) -> tuple[DataFrame, Geometry, DataFrame]:
    """(projections, geometry, angles) of a folder with ScanParameter.xml and TIFF frames, or else with a tab-separated
    header and raw 16-bit frames, upside down. Of the first, only circular scans are read."""
    if spark.read.format("binaryFile").option("pathGlobFilter", "ScanParameter.xml").load(folder).select("path").head(1):
        return yxlon_xml(spark, folder, how, n)
    h = formats.tab_header(text_of(spark, f"{folder}/*.txt"))
    f = lambda k: float(h[k].replace(",", "."))
    side, total = int(f("Number of Detector Elements")), int(f("CT: Number of Projections"))
    pixel, slices = f("2D-Pixel Size [mm]"), int(f("Number of Z-slices"))
    dso, dsd = f("FOD [mm]"), f("FDD [mm]")
    dim = int(f("Image Dimension"))
    voxel = pixel * dso / dsd
    g = Geometry((slices, dim, dim), (slices * voxel, dim * voxel, dim * voxel), (side, side), (pixel, pixel), dso, dsd, off_detector=(0.0, f("Center Offset [mm]") if "Center Offset [mm]" in h else 0.0))
    angles = spark.range(total).select(F.col("id").alias("idx"), (F.col("id") * (2 * math.pi / total)).alias("angle"))
    decode = lambda raw: formats.raw_frame(raw, (side, side), flip=True)
    return logged(frames(spark, folder, "*.raw", decode, how, n), 65535.0), g, sampled(angles, how, n, total)


def yxlon_xml(spark: SparkSession, folder: str, how: str, n: int) -> tuple[DataFrame, Geometry, DataFrame]:
    raw = formats.xml_values(text_of(spark, f"{folder}/ScanParameter.xml"))
    h = {k.partition("ConeBeamScanParameter/")[2]: v for k, v in raw.items() if "ConeBeamScanParameter/" in k}
    kind = h.get("ScanTrajectory@type", "")
    if kind != "CircleTrajectory":
        raise ValueError(f"only circular scans are supported, not {kind!r}")
    f = lambda k: float(h[k])
    nv, nu = int(f("ProjectionSize/Height")), int(f("ProjectionSize/Width"))
    dv, du = f("PixelSize/Height"), f("PixelSize/Width")
    scale, total = f("ScanTrajectory/PixelPitch"), int(f("ScanTrajectory/NumberOfProjections"))
    dso, dsd = scale * f("ScanTrajectory/Fod"), scale * f("ScanTrajectory/Fdd")
    off = tuple(-scale * float(h.get(f"DejustmentParameter/{k}DetectorOffset", 0)) for k in ("Vertical", "Horizontal"))
    size = tuple(k * dso / dsd for k in (nv * dv, nu * du, nu * du))
    g = Geometry((nv, nu, nu), size, (nv, nu), (dv, du), dso, dsd, off_detector=off, cor=-scale * f("ScanTrajectory/YoCenter"))
    first, turn = math.radians(f("ScanTrajectory/StartAngle")), math.radians(f("ScanTrajectory/Rotation")) / total
    angles = spark.range(total).select(F.col("id").alias("idx"), (F.lit(first) - F.col("id") * turn).alias("angle"))
    white = float((1 << int(f("ProjectionBitdepth"))) - 1) if "ProjectionBitdepth" in h else 65535.0
    return logged(frames(spark, folder, "*.[tT][iI][fF]*", formats.tiff, how, n), white), g, sampled(angles, how, n, total)


def diondo(spark: SparkSession, folder: str, how: str = "step", n: int = 1) -> tuple[DataFrame, Geometry, DataFrame]:
    """(projections, geometry, angles) of an .xml folder with raw 16-bit frames; helical scans are refused."""
    h = {k.rpartition("/")[2]: v for k, v in formats.xml_values(text_of(spark, f"{folder}/*.xml")).items()}
    if "helical" in h.get("ScanType", "").lower() or "laminography" in h.get("ScanType", "").lower():
        raise ValueError("only circular scans are supported")
    f = lambda k: float(h[k])
    nv, nu, total = int(f("ProjectionDimY")), int(f("ProjectionDimX")), int(f("ProjectionCount"))
    pixel, dso, dsd = f("ProjectionPixelSize"), f("SourceObjectDist"), f("SourceDetectorDist")
    voxel = pixel * dso / dsd
    g = Geometry((nv, nu, nu), (nv * voxel, nu * voxel, nu * voxel), (nv, nu), (pixel, pixel), dso, dsd)
    angles = spark.range(total).select(F.col("id").alias("idx"), (F.col("id") * (2 * math.pi / total)).alias("angle"))
    return logged(frames(spark, folder, "*.raw", lambda raw: formats.raw_frame(raw, (nv, nu)), how, n), 65535.0), g, sampled(angles, how, n, total)


def xim_files(spark: SparkSession, folder: str, glob: str = "*.xim") -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(folder).select("path", "content")


def xim_properties(spark: SparkSession, folder: str, glob: str = "*.xim") -> DataFrame:
    """(path, angle, airnorm) of every XIM frame below ``folder``: its gantry angle in degrees and its air reading.
    Pixels are skipped. Frames without image or angle give nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for path, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                try:
                    p = formats.xim(content, pixels=False)[1]
                    rows.append((path, float(p["GantryRtn"]), float(p["KVNormChamber"])))
                except (ValueError, KeyError, IndexError, struct.error):
                    continue
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 3, (pa.string(), pa.float64(), pa.float64()), strict=True)], names=["path", "angle", "airnorm"])

    return xim_files(spark, folder, glob).mapInArrow(run, "path string, angle double, airnorm double")


def xim_images(spark: SparkSession, folder: str, wanted: DataFrame, glob: str = "*.xim") -> DataFrame:
    """``wanted`` (path, airnorm, ...) with ``data``: each frame, mirrored along u, over its air reading. Other files
    aren't decoded."""
    more = [c for c in wanted.columns if c != "airnorm"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, (content, air) in enumerate(zip(b.column("content").to_pylist(), b.column("airnorm").to_pylist(), strict=True)):
                image = formats.xim(content)[0][:, ::-1].astype(float) / air
                yield pa.RecordBatch.from_arrays([*(b.column(c).slice(i, 1) for c in more), pa.array([image.ravel()], pa.list_(pa.float64()))], names=[*more, "data"])

    schema = ", ".join(f"`{c}` {t}" for c, t in wanted.dtypes if c != "airnorm")
    return xim_files(spark, folder, glob).join(broadcast_if_small(wanted, 512), "path").mapInArrow(run, f"{schema}, data array<double>")


#: Degrees between the gantry's head and the imaging source.
SOURCE_TURN = 90.0


def varian_projections(spark: SparkSession, folder: str, threshold: float) -> DataFrame:
    """(idx, angle, data): frames in order of their names, those whose angle is more than ``threshold`` degrees from the
    last kept one, divided by their air readings. Angles are read first, pixels of the kept frames only."""
    seen = placed(xim_properties(spark, folder, "Proj_*.xim"), "path", name="idx").withColumn("angle", F.col("angle") + SOURCE_TURN)
    kept = spaced_views(seen.select(F.lit(0).alias("scan_id"), "idx", "angle"), threshold).select("idx")
    wanted = seen.join(broadcast_if_small(kept, 16), "idx").select("path", "idx", "angle", "airnorm")
    return xim_images(spark, folder, wanted, "Proj_*.xim").select("idx", "angle", "data")


def varian_blanks(spark: SparkSession, folder: str, bowtie: bool, version: float, clockwise: bool) -> DataFrame:
    """(angle, data): blank frames over their air readings; the older version has one for all angles."""
    name = "Filter.xim" if not bowtie else "FilterBowtie.xim" if version < 2.7 else f"FilterBowtie_{'CW' if clockwise else 'CC'}*.xim"
    found = xim_properties(spark, f"{folder}/Calibrations/Air-*", name)
    if version < 2.7:
        found = found.orderBy("path").limit(1)
    wanted = materialise(found.withColumn("angle", F.col("angle") + SOURCE_TURN))
    if not wanted.head(1):
        raise FileNotFoundError(f"{folder}/Calibrations has no blank frame {name}")
    return xim_images(spark, f"{folder}/Calibrations/Air-*", wanted, name).select("angle", "data")


def varian_settings(spark: SparkSession, folder: str) -> tuple[dict[str, str], Geometry]:
    """The scan's settings by name, and its geometry: the grid of the scanner's own reconstruction if there is one, else
    one that covers the detector. Raises ValueError for versions other than 2.0 and 2.7 and for missing settings."""
    raw = formats.xml_values(text_of(spark, f"{folder}/Scan.xml"))
    version = next((v for k, v in raw.items() if k.endswith("Scan@Version")), "")
    h = {k.rpartition("/")[2]: v for k, v in raw.items() if "/Acquisitions/" in f"/{k}/"} | {"Version": version.removesuffix(".0.0")}
    if not re.fullmatch(r"2\.[07](\..*)?|2", h["Version"]):
        raise ValueError(f"unknown version {version!r} of {folder}/Scan.xml")
    try:
        nu, nv, du, dv = int(h["ImagerSizeX"]), int(h["ImagerSizeY"]), float(h["ImagerResX"]), float(h["ImagerResY"])
        dso, dsd, lateral = float(h["SAD"]), float(h["SID"]), float(h["ImagerLat"])
    except (KeyError, ValueError) as e:
        raise ValueError(f"{folder}/Scan.xml: {e}") from e
    own = spark.read.format("binaryFile").option("pathGlobFilter", "Reconstruction.xml").option("recursiveFileLookup", "true").load(folder).select("content").limit(2).collect()
    if len(own) > 1:
        raise ValueError(f"several Reconstruction.xml below {folder}")
    if own:
        r = {k.rpartition("/")[2]: v for k, v in formats.xml_values(bytes(own[0]["content"]).decode("utf-8-sig", "replace")).items()}
        size = tuple(float(r[f"VOISize{a}"]) for a in "ZYX")
        n = (math.ceil(size[0] / float(r["SliceThickness"])), int(r["MatrixSize"]), int(r["MatrixSize"]))
    else:
        voxel = (dv * dso / dsd, du * dso / dsd, du * dso / dsd)
        n = (nv, *[math.ceil(nu + abs(lateral) / du)] * 2)
        size = tuple(k * d for k, d in zip(n, voxel, strict=True))
    return h, Geometry(n, size, (nv, nu), (dv, du), dso, dsd, off_detector=(0.0, -lateral))


def blank_of_view(views: DataFrame, blanks: DataFrame) -> DataFrame:
    """``views`` (idx, angle, data) with ``blank``, linear between the blanks (angle, data) just before and after their
    angle modulo 360. Angles find their neighbours first; images are joined by number."""
    known = materialise(placed(blanks.groupBy(F.pmod("angle", F.lit(360.0)).alias("angle")).agg(F.first("data").alias("data")), "angle", name="b_"))
    turns = known.select("b_", "angle", F.explode(F.array(F.lit(-360.0), F.lit(0.0), F.lit(360.0))).alias("t_")).select((F.col("angle") + F.col("t_")).alias("angle"), "b_")
    near = around(views.select("idx", F.pmod("angle", F.lit(360.0)).alias("angle")), materialise(turns.select("angle", F.struct("angle", "b_").alias("s_"))))
    width = F.col("hi_.angle") - F.col("lo_.angle")
    share = F.when(width > 0, (F.col("angle") - F.col("lo_.angle")) / width).otherwise(0.0)
    near = near.select("idx", share.alias("w_"), F.col("lo_.b_").alias("lo_"), F.col("hi_.b_").alias("hi_"))
    images = known.select("b_", "data")
    lo, hi = images.select(F.col("b_").alias("lo_"), F.col("data").alias("d_lo")), images.select(F.col("b_").alias("hi_"), F.col("data").alias("d_hi"))
    both = views.join(near.join(lo, "lo_").join(hi, "hi_"), "idx")
    return both.withColumn("blank", F.zip_with("d_lo", "d_hi", lambda a, b: a * (1 - F.col("w_")) + b * F.col("w_"))).drop("w_", "lo_", "hi_", "d_lo", "d_hi")


def cleared(views: DataFrame, g: Geometry, run: Callable[..., np.ndarray], *others: str) -> DataFrame:
    """``views`` (idx, data, ...) with ``run`` applied to each image."""
    images = corrections.per_image(views.withColumnRenamed("idx", "proj_idx"), g.n_detector, run, *others)
    return views.drop("data").join(images.withColumnRenamed("proj_idx", "idx"), "idx")


def varian(spark: SparkSession, folder: str, spaced: bool = True, point: list[float] | None = None, groups: list[dict] | None = None, airs: float = 0.02) -> tuple[DataFrame, Geometry, DataFrame]:
    """(projections, geometry, angles) of a cone-beam folder: Scan.xml, Acquisitions with XIM frames, Calibrations with
    blanks. Angles are read before pixels; with ``spaced`` frames taken while the gantry speeds up or slows down are
    left out (0.9 of the usual step). Frames and blanks are divided by their air readings, cleared of the detector's
    scatter with ``point`` and of the object's with ``groups``, where given; then the logarithm against the blank of the
    view's angle, and the median of nine pixels along u against rings."""
    h, g = varian_settings(spark, folder)
    bowtie = bool(h.get("Bowtie", "").strip()) and h["Bowtie"].strip().lower() != "none"
    threshold = 0.9 * float(h["Velocity"]) / float(h["FrameRate"]) if spaced else 0.0
    clockwise = float(h["StopAngle"]) < float(h["StartAngle"])
    views = varian_projections(spark, f"{folder}/Acquisitions", threshold)
    blanks = varian_blanks(spark, folder, bowtie, float(".".join(h["Version"].split(".")[:2])), clockwise)
    if point:
        points = lambda _, p: corrections.point_scatter(p, g.d_detector, point)
        views, blanks = cleared(views, g, points), cleared(placed(blanks, "angle", name="idx"), g, points)
    rows = blank_of_view(views, blanks)
    if groups:
        rows = cleared(rows, g, lambda _, p, b: corrections.object_scatter(p, b, groups, g.d_detector, airs), "blank")
    rows = rows.withColumn("data", F.zip_with("data", "blank", log_normalised)).select(F.col("idx").alias("proj_idx"), "angle", "data")
    rows = materialise(rows)
    images = corrections.ring_removal(rows.select("proj_idx", "data"), g.n_detector)
    return images, g, rows.select(F.col("proj_idx").alias("idx"), F.radians("angle").alias("angle"))


def material_table(spark: SparkSession, path: str) -> DataFrame:
    """(material, energy, mu) of a JSON file of materials with energy and mu lists."""
    text = text_of(spark, path)
    rows = spark.createDataFrame([(text,)], "text string").select(F.from_json("text", "map<string,struct<energy:array<double>,mu:array<double>>>").alias("m"))
    return rows.select(F.explode("m").alias("material", "c")).select("material", F.inline(F.arrays_zip("c.energy", "c.mu"))).toDF("material", "energy", "mu")
