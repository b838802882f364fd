"""Millions of tiny frame files into few well-sized sorted ones.

Files are decoded to frame records, each complete record is kept once, the records are range-partitioned by
their clustering keys (boundaries sampled by Spark's range partitioner, number of files from measured bytes and
the target) and written sorted to a staging directory. Only if what was written has the count and checksum of
what was to be written does the staging directory take the place of the target.
"""

from __future__ import annotations

import json
import math
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from raylattice.session import materialise, scratch, spread

KEYS = ("scan", "proj", "rev")
FIELDS = {"scan", "proj", "rev", "n", "px"}
RECORD = "file_id bigint, at timestamp, scan bigint, proj bigint, rev bigint, angle double, n bigint, px array<double>"
WHOLE = re.compile(r"[+-]?\d+(?:\.0*)?$")
#: Uncompressed bytes of a record besides its pixels, for sizing.
RECORD_BYTES = 48
#: Uncompressed bytes of the sample from which the size of the written files is told.
SAMPLE_BYTES = 8 << 20


def refused(name: str) -> float:
    """For NaN and infinities, which JSON has no numbers for."""
    raise ValueError(name)


def whole(x: object) -> int | None:
    """``x`` as a whole number, or None."""
    if isinstance(x, bool) or x is None:
        return None
    if isinstance(x, int):
        return x if abs(x) < 1 << 63 else None
    if isinstance(x, float):
        return int(x) if x == x and abs(x) < 1 << 53 and x == int(x) else None
    if not isinstance(x, str) or not WHOLE.match(x.strip()):
        return None
    digits = x.strip().partition(".")[0].lstrip("+").lstrip("0") or "0"
    return whole(int(digits)) if len(digits) < 21 else None


def real(x: object) -> float | None:
    """``x`` as a number, or None."""
    try:
        return None if isinstance(x, bool) or x is None else float(x)
    except (TypeError, ValueError, OverflowError):
        return None


def complete(fields: dict) -> tuple | None:
    """(scan, proj, rev, angle, n, px) of a record that is complete, else None."""
    keys = [whole(fields.get(k)) for k in (*KEYS, "n")]
    px = fields.get("px")
    if isinstance(px, str):
        px = [p for p in re.split(r"[;,\s]+", px.strip()) if p]
    if None in keys or not isinstance(px, list):
        return None
    values = [real(p) for p in px]
    if None in values or len(values) != keys[3]:
        return None
    return (*keys[:3], real(fields.get("angle")), keys[3], values)


def delimited(lines: list[str]) -> Iterator[dict]:
    """Rows below a header line; the delimiter is the sign between the header's names."""
    by = next((c for c in "\t,|;" if c in lines[0]), ",")
    names = [h.strip().strip('"').lower() for h in lines[0].split(by)]
    for line in lines[1:]:
        parts = line.split(by)
        if len(parts) == len(names):
            yield dict(zip(names, (p.strip().strip('"') for p in parts), strict=True))


def unzipped(raw: bytes) -> bytes:
    """The content of gzip members one after the other, up to where they are cut off or broken."""
    out = []
    while raw[:2] == b"\x1f\x8b":
        member = zlib.decompressobj(wbits=31)
        try:
            for at in range(0, len(raw), 4096):
                out.append(member.decompress(raw[at : at + 4096]))
                if member.eof:
                    raw = member.unused_data + raw[at + 4096 :]
                    break
            else:
                break
        except zlib.error:
            break
    return b"".join(out)


def records(raw: bytes | None) -> list[tuple]:
    """The complete records of one file, whatever its name says about its layout.

    Gzip is told by its first bytes and read as far as it goes. A JSON array is read as a whole, JSON lines and the other layouts line by
    line, so that a cut-off file still gives the records before the cut.
    """
    text = (unzipped(raw) if raw and raw[:2] == b"\x1f\x8b" else raw or b"").decode("utf-8-sig", "replace").strip("\ufeff \t\r\n\x00")
    if not text:
        return []
    found: list = []
    if text[0] == "[":
        try:
            found = json.loads(text, parse_constant=refused)
        except (ValueError, RecursionError):
            return []
    elif text[0] == "{":
        try:
            found = [json.loads(text, parse_constant=refused)]
        except (ValueError, RecursionError):
            for line in text.splitlines():
                try:
                    found.append(json.loads(line, parse_constant=refused))
                except (ValueError, RecursionError):
                    continue
    else:
        lines = [x for x in text.splitlines() if x.strip()]
        if re.match(r"\s*\w+\s*=", lines[0]):
            found = [{k.strip().lower(): v.strip() for k, s, v in (p.partition("=") for p in line.split("|")) if s} for line in lines]
        elif FIELDS <= {h.strip().strip('"').lower() for h in re.split(r"[\t,|;]", lines[0])}:
            found = list(delimited(lines))
    return [r for f in found if isinstance(f, dict) and (r := complete(f))]


def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = pa.schema([("file_id", pa.int64()), ("at", pa.timestamp("us", "UTC")), *[(k, pa.int64()) for k in KEYS], ("angle", pa.float64()), ("n", pa.int64()), ("px", pa.list_(pa.float64()))])
    for batch in batches:
        for start in range(0, batch.num_rows, 512):
            part = batch.slice(start, 512)
            rows = [(i, t, *r) for i, t, raw in zip(*(part.column(c).to_pylist() for c in ("file_id", "at", "raw_bytes")), strict=True) for r in records(raw)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 8, kinds.types, strict=True)], schema=kinds)


def frame_records(files: DataFrame) -> DataFrame:
    """Each complete frame record of ``files`` once, of the latest file that holds it (then the greater file id).

    Null or empty contents, broken files and incomplete records give nothing; a null time is older than any;
    repeated files change nothing. ``files`` needs file_id, modified_at and raw_bytes; other columns aren't read.
    """
    raw = files.select("file_id", F.col("modified_at").cast("timestamp").alias("at"), "raw_bytes")
    decoded = spread(raw).mapInArrow(decode, RECORD)
    best = F.max(F.struct("at", "file_id", "angle", "n", "px")).alias("r_")
    return decoded.groupBy(*KEYS).agg(best).select(*KEYS, "r_.angle", "r_.n", "r_.px", "r_.file_id")


def bytes_of_records() -> Column:
    return F.sum(F.lit(RECORD_BYTES) + 8 * F.size("px"))


def tally(df: DataFrame) -> tuple[int, int, int]:
    """(records, checksum, uncompressed bytes), in one pass."""
    row = df.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.xxhash64(*KEYS, "n", "px").cast("decimal(38,0)")).alias("h"),
        bytes_of_records().alias("b"),
    ).first()
    return row["n"], int(row["h"] or 0), int(row["b"] or 0)


def swap(spark: SparkSession, staging: str, target: str) -> None:
    """Puts ``staging`` in the place of ``target``; an older target is kept aside until the new one is there."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path
    fs = path(target).getFileSystem(spark._jsc.hadoopConfiguration())
    old = path(target + ".old")
    if fs.exists(path(target)):
        fs.delete(old, True)
        if not fs.rename(path(target), old):
            raise OSError(f"could not move {target} aside")
    if not fs.rename(path(staging), path(target)):
        if fs.exists(old):
            fs.rename(old, path(target))
        raise OSError(f"could not move {staging} to {target}")
    fs.delete(old, True)


def written_share(kept: DataFrame, size: int) -> float:
    """Bytes on disk for each uncompressed byte, from a written sample of about ``SAMPLE_BYTES``; 1 without records."""
    if not size:
        return 1.0
    spark = kept.sparkSession
    at = scratch(spark, "sample")
    sample = kept.sample(min(1.0, SAMPLE_BYTES / size), 7).coalesce(1).sortWithinPartitions(*KEYS)
    sample.write.option("compression", "zstd").parquet(at)
    whole = spark.read.schema(kept.schema).parquet(at).agg(bytes_of_records().alias("b")).first()["b"]
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    written = fs.getContentSummary(path).getLength()
    fs.delete(path, True)
    return written / whole if whole else 1.0


def compact(files: DataFrame, target: str, target_bytes: int = 128 << 20) -> DataFrame:
    """Writes every complete frame record of ``files`` once into sorted Parquet files of about ``target_bytes`` on
    disk below ``target`` and returns them as a DataFrame.

    Keys are unique by then, so a scan that holds a third of all frames is split over files like any other range.
    Raises RuntimeError, leaving the old target in place, if the written count or checksum differs. No records
    give one empty file.
    """
    spark = files.sparkSession
    kept = materialise(frame_records(files))
    n, checksum, size = tally(kept)
    staging = target + ".staging"
    (
        kept.repartitionByRange(max(1, math.ceil(size * written_share(kept, size) / target_bytes)), *KEYS)
        .sortWithinPartitions(*KEYS)
        .write.mode("overwrite")
        .option("compression", "zstd")
        .parquet(staging)
    )
    if tally(spark.read.schema(kept.schema).parquet(staging))[:2] != (n, checksum):
        raise RuntimeError(f"{staging} does not hold what was to be written; {target} is unchanged")
    swap(spark, staging, target)
    return spark.read.schema(kept.schema).parquet(target)


def compacted_keys(files: DataFrame) -> DataFrame:
    """(scan_id, proj_idx, rev) of the records of a compaction of ``files`` into the shared folder."""
    out = compact(files, scratch(files.sparkSession, "frames"))
    return out.select(F.col("scan").alias("scan_id"), F.col("proj").alias("proj_idx"), "rev")
