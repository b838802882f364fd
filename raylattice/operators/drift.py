"""Headers whose fields drift from file to file: one consistent table and a report of each change.

Each body is loaded as path-value rows with their raw JSON types, path and type statistics are aggregated by
file, and the tracked fields are projected to typed columns; casts that fail are reported.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from raylattice.session import materialise


@dataclass(frozen=True)
class Tracked:
    """A quantity, the keys that hold it (compared without case and signs) and the type of its column: ``number``
    (a length in mm or an angle in degrees where units are given), ``whole``, ``pair`` or ``version``."""

    name: str
    keys: tuple[str, ...]
    kind: str


HEADER_FIELDS = (
    Tracked("SrcToObject", ("srctoobject", "sourcetoobject", "sourceobjectdist", "sourceobjectdistance", "srcobjectdist", "sod", "fod", "srctoobjectmm", "focusobjectdistance", "dso"), "number"),
    Tracked("SrcToDetector", ("srctodetector", "sourcetodetector", "sourcedetectordist", "sourcedetectordistance", "srcdetectordist", "sdd", "fdd", "srctodetectormm", "focusdetectordistance", "dsd"), "number"),
    Tracked("PixelSize", ("pixelsize", "detectorpixelsize", "projectionpixelsize", "pitch", "pixelpitch", "detectorpitch", "pixelsizemm"), "pair"),
    Tracked("version", ("version", "formatversion", "schemaversion", "swver", "swversion", "softwareversion", "fileversion"), "version"),
    Tracked("DetectorPixelsX", ("detectorpixelsx", "projectiondimx", "ndetu", "detectorcolumns"), "whole"),
    Tracked("DetectorPixelsY", ("detectorpixelsy", "projectiondimy", "ndetv", "detectorrows"), "whole"),
    Tracked("WhiteLevel", ("whitelevel", "i0level", "i0", "whitelvl"), "whole"),
    Tracked("Projections", ("projections", "numberofprojections", "projectioncount", "numprojections", "nprojections", "nproj"), "whole"),
    Tracked("AngularStep", ("angularstep", "stepdeg", "anglestep", "angularstepdeg"), "number"),
    Tracked("InitialAngle", ("initialangle", "startangle", "firstangle", "initialangledeg"), "number"),
    Tracked("ObjectOffsetX", ("objectoffsetx", "centreofrotationtop", "centerofrotationtop", "yocenter", "yocentre"), "number"),
)
#: A key may end in the unit of its value.
KEY_UNITS = ("um", "mm", "cm", "m")
MM = {"um": 0.001, "µm": 0.001, "μm": 0.001, "mm": 1.0, "cm": 10.0, "m": 1000.0}
#: A station's headers are put in order within spans of so many days, which are then chained; see ``changes``.
SPAN_DAYS = 1
#: Those without a time come first, in spans of so many ids.
SPAN_IDS = 4096


def plain(key: Column) -> Column:
    return F.regexp_replace(F.lower(key), "[^a-z0-9]", "")


def field_of(key: Column, fields: tuple[Tracked, ...]) -> Column:
    """The name of the tracked field that ``key`` holds, else null: its plain form is looked up in a literal map,
    with and without a unit at the end that a sign sets off."""
    names = F.create_map(*[F.lit(x) for f in fields for k in f.keys for x in (k, f.name)])
    bare = F.regexp_replace(key, rf"(?i)[^A-Za-z0-9]+({'|'.join(KEY_UNITS)})\]?$", "")
    return F.coalesce(F.element_at(names, plain(key)), F.element_at(names, plain(bare)))


def path_values(headers: DataFrame) -> DataFrame:
    """(header_id, station_id, written_at, key, raw, raw_type) of each readable header's keys.

    A header is readable if its body is a whole JSON object. Of rows with the same header id the one with the
    latest arrival counts. raw_type is number, string, array, object, boolean or null.
    """
    one = (
        headers.select("header_id", "station_id", F.struct("arrived_at", "written_at", "body").alias("h_"))
        .where("header_id is not null and station_id is not null")
        .groupBy("header_id", "station_id")
        .agg(F.max("h_").alias("h_"))
        .select("header_id", "station_id", "h_.written_at", F.try_parse_json("h_.body").alias("v_"))
    )
    named = one.where(F.schema_of_variant("v_").startswith("OBJECT"))
    pairs = named.lateralJoin(headers.sparkSession.tvf.variant_explode_outer(F.col("v_").outer()))
    kind = F.schema_of_variant("value")
    raw_type = (
        F.when(F.col("value").isNull() | kind.isin("VOID"), "null").when(kind == "STRING", "string").when(kind == "BOOLEAN", "boolean")
        .when(kind.startswith("ARRAY"), "array").when(kind.startswith("OBJECT"), "object").otherwise("number")
    )
    return pairs.select("header_id", "station_id", "written_at", "key", F.col("value").cast("string").alias("raw"), raw_type.alias("raw_type"))


def file_statistics(paths: DataFrame) -> DataFrame:
    """Per header, key and raw type: how often it occurs, its value and when the header was written. A header without
    keys has one row with a null key. Partitioned by header as ``path_values`` is, so that nothing is shuffled."""
    return paths.groupBy("header_id", "station_id", "key", "raw_type").agg(
        F.count("key").alias("occurrences"), F.min("raw").alias("raw"), F.min("written_at").alias("written_at")
    )


def path_statistics(paths: DataFrame) -> DataFrame:
    """Per station, key and raw type: the number of headers and the first and last time, from ``file_statistics``."""
    return file_statistics(paths).where("key is not null").groupBy("station_id", "key", "raw_type").agg(
        F.count(F.lit(1)).alias("headers"), F.min("written_at").alias("first_at"), F.max("written_at").alias("last_at")
    )


def states(statistics: DataFrame, fields: tuple[Tracked, ...]) -> DataFrame:
    """From ``file_statistics``, one row per readable header with ``s_``, an array of (key, raw, raw_type) by the
    position of each field.

    Of several keys for a field the first in alphabetical order counts.
    """
    field = field_of(F.col("key"), fields)
    one = F.struct("key", "raw", "raw_type")
    return (
        statistics.groupBy("header_id", "station_id")
        .agg(F.min("written_at").alias("written_at"), *[F.min(F.when(field == f.name, one)).alias(f"f{i}_") for i, f in enumerate(fields)])
        .select("header_id", "station_id", "written_at", F.array(*[f"f{i}_" for i in range(len(fields))]).alias("s_"))
    )


NUMBER = r"([+-]?[0-9]+(?:[.,][0-9]*)?(?:[eE][+-]?[0-9]+)?)"
UNIT = r"(?:(um|µm|μm|mm|cm|m)|deg|degrees?|°)?"


def typed(field: Tracked, s: Column, height: bool = False) -> Column:
    """The typed value of a field's state; of a pair its width, or its ``height``, which is the width where only one
    value is given. Nothing but a number's unit may follow it."""
    member = lambda keys: F.coalesce(*[F.get_json_object(s["raw"], f"$.{k}") for k in keys])
    first = F.when(s["raw_type"] == "array", F.get_json_object(s["raw"], "$[0]")).when(
        s["raw_type"] == "object", member(("Value", "value", "Width", "width", "major"))
    ).otherwise(s["raw"])
    if field.kind == "version":
        return F.when(s["raw_type"] == "object", F.concat_ws(".", F.get_json_object(s["raw"], "$.major"), F.get_json_object(s["raw"], "$.minor"))).otherwise(
            F.regexp_replace(F.trim(s["raw"]), "^[vV]", "")
        )
    if height:
        second = F.when(s["raw_type"] == "array", F.get_json_object(s["raw"], "$[1]")).when(s["raw_type"] == "object", member(("Height", "height")))
        first = F.coalesce(second, first)
    one = rf"{NUMBER}\s*{UNIT}"
    pattern = rf"^\s*{NUMBER}\s*$" if field.kind == "whole" else rf"^\s*{one}\s*$"
    if field.kind == "pair":
        pattern = rf"^\s*{one}\s*(?:[;xX×]\s*{one}\s*)?$"
    part = lambda *groups: F.coalesce(*[F.nullif(F.regexp_extract(first, pattern, g), F.lit("")) for g in groups])
    sides = ((1,), (2,)) if field.kind != "pair" else ((3, 1), (4, 2)) if height else ((1,), (2, 4))
    number = F.regexp_replace(part(*sides[0]), ",", ".").try_cast("double")
    if field.kind == "whole":
        return F.when(number == F.floor(number), number.cast("bigint"))
    unit = F.lower(F.coalesce(
        part(*sides[1]), F.get_json_object(s["raw"], "$.Unit"), F.nullif(F.regexp_extract(s["key"], rf"[_ \[]({'|'.join(KEY_UNITS)})\]?$", 1), F.lit("")),
    ))
    factors = F.create_map(*[F.lit(x) for u, x in MM.items() for x in (u, x)])
    return number * F.coalesce(F.element_at(factors, unit), F.lit(1.0))


def consistent(headers: DataFrame, fields: tuple[Tracked, ...] = HEADER_FIELDS) -> DataFrame:
    """One row per readable header: header_id, station_id, written_at, a typed column per field (lengths in mm,
    angles in degrees; pairs as their width and, in a further column, their height) and ``failed_casts``, the fields whose value isn't null but gave no
    typed value. Bodies that are null, broken or no JSON object give no row; nulls and absent fields give null."""
    rows = states(file_statistics(path_values(headers)), fields)
    columns = [(f, i, f.name + ("Height" if high else ""), high) for i, f in enumerate(fields) for high in ((False, True) if f.kind == "pair" else (False,))]
    cells = [typed(f, F.col("s_")[i], high).alias(name) for f, i, name, high in columns]
    rows = rows.select("header_id", "station_id", "written_at", "s_", *cells)
    failed = [F.when(F.col(name).isNull() & (F.col("s_")[i]["raw_type"] != "null"), F.lit(f.name)) for f, i, name, _ in columns]
    return rows.select("header_id", "station_id", "written_at", *[name for _, _, name, _ in columns], F.array_distinct(F.array_compact(F.array(*failed))).alias("failed_casts"))


def changes(headers: DataFrame, fields: tuple[Tracked, ...] = HEADER_FIELDS) -> DataFrame:
    """(station_id, header_id, field_name, change_kind) against the station's previous readable header.

    ``added``, ``removed``, ``renamed`` (another key) and ``retyped`` (another JSON type; a null keeps the type
    before it, as long as the field stays present). Headers are ordered by written_at (nulls first), then id.
    Null ids and stations, broken bodies and texts that are no JSON object are left out; repeats count once; a
    station's first header and an empty table report nothing.

    A station may hold a third of all headers, so no window runs over a whole station: rows are compared within
    spans of days, those without a time within spans of ids, and each span's first row with the last state of the spans before, taken from one
    pre-aggregated row per station, field and span.
    """
    absent = F.lit("absent")
    of_field = lambda c: F.struct(
        F.coalesce(c["key"], F.lit("")).alias("key_"), c.isNotNull().alias("has_"),
        F.when(c.isNull(), absent).when(c["raw_type"] != "null", c["raw_type"]).alias("type_"),
    )
    slim = states(file_statistics(path_values(headers)), fields)
    slim = slim.select("station_id", "header_id", "written_at", F.transform("s_", of_field).alias("s_"))
    # Read twice below; the bodies are parsed once.
    rows = materialise(slim).select(
        "station_id", "header_id", "written_at",
        F.coalesce(F.floor(F.unix_date(F.col("written_at").cast("date")) / SPAN_DAYS), F.floor(F.col("header_id") / SPAN_IDS) - F.lit(1 << 60)).alias("span_"),
        F.posexplode("s_").alias("f_", "s_"),
    ).select("station_id", "f_", "span_", "written_at", "header_id", "s_.*")
    order = F.struct("written_at", "header_id")
    span = Window.partitionBy("station_id", "f_", "span_")
    last = (
        rows.groupBy("station_id", "f_", "span_")
        .agg(F.max(F.struct(order.alias("o"), F.col("key_"), F.col("has_"))).alias("l_"), F.max(F.when(F.col("type_").isNotNull(), F.struct(order.alias("o"), F.col("type_")))).alias("t_"))
    )
    before = Window.partitionBy("station_id", "f_").orderBy("span_")
    carried = last.select(
        "station_id", "f_", "span_",
        F.lag("l_.key_").over(before).alias("c_key"), F.lag("l_.has_").over(before).alias("c_has"),
        F.last("t_.type_", ignorenulls=True).over(before.rowsBetween(Window.unboundedPreceding, -1)).alias("c_type"),
    )
    ordered = span.orderBy("written_at", "header_id")
    rows = rows.withColumns({
        "p_key": F.lag("key_").over(ordered),
        "p_has": F.lag("has_").over(ordered),
        "p_type": F.last("type_", ignorenulls=True).over(ordered.rowsBetween(Window.unboundedPreceding, -1)),
    }).join(carried, ["station_id", "f_", "span_"])
    had, was, kind = F.coalesce("p_has", "c_has"), F.coalesce("p_key", "c_key"), F.coalesce("p_type", "c_type")
    both = F.col("has_") & had
    found = F.array_compact(F.array(
        F.when(F.col("has_") & ~had, F.lit("added")),
        F.when(~F.col("has_") & had, F.lit("removed")),
        F.when(both & (F.col("key_") != was), F.lit("renamed")),
        F.when(both & F.col("type_").isNotNull() & (kind != absent) & (F.col("type_") != kind), F.lit("retyped")),
    ))
    names = F.array(*[F.lit(f.name) for f in fields])
    return rows.where(had.isNotNull()).select("station_id", "header_id", F.element_at(names, F.col("f_") + 1).alias("field_name"), F.explode(found).alias("change_kind"))
