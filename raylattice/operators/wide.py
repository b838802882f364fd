"""Attribute-value rows into one typed row per entity.

The entity-by-attribute grid is completed first, the values are left-joined to it, each entity's cells are
collected in the order of the attributes' positions and the typed columns are projected from fixed indices by
try-casts. Values are reduced to the latest usable one per cell before anything is joined, by a partial
aggregation, so that an entity holding a third of all rows costs its mappers, not one task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACES = r"[\s\u00a0\u2000-\u200b\u202f\u3000\ufeff]"
#: Millimetres in one unit of length, by its spelling.
LENGTH_UNITS = {"mm": 1.0, "cm": 10.0, "m": 1000.0, "µm": 0.001, "μm": 0.001, "um": 0.001}


@dataclass(frozen=True)
class Attribute:
    """A wanted column. ``pattern`` is matched against the whole normalised attribute name; ``kind`` is
    ``int`` (whole numbers), ``number`` or ``length`` (numbers with a unit in the name or in the text, in mm)."""

    column: str
    pattern: str
    kind: str


COUNT_OF = "(number|no|nr|num|count) of"
SCAN_ATTRIBUTES = (
    Attribute("n_det", f"{COUNT_OF} detector elements|detector elements {COUNT_OF}", "int"),
    Attribute("fdd", "(fdd|focus detector distance)( (mm|cm|m|µm|μm|um))?", "length"),
    Attribute("n_proj", f"ct {COUNT_OF} projections|ct projections {COUNT_OF}|projections {COUNT_OF} ct", "int"),
)


def normalised(name: Column) -> Column:
    """A name in lower case, its runs of signs, underscores and white space as one space."""
    return F.trim(F.regexp_replace(F.lower(name), r"[^\p{L}\p{N}]+", " "))


def number_text(text: Column, kind: str) -> Column:
    """The number in ``text`` in plain notation, or an empty text where the text is no number.

    White space, quotes and digit grouping (apostrophes, spaces) are removed. With both a comma and a point the
    earlier one groups digits. A lone comma groups digits in whole numbers where three digits follow each, else
    it is the decimal sign.
    """
    s = F.regexp_replace(text, rf"^(?:{SPACES}|\")+|(?:{SPACES}|\")+$", "")
    s = F.regexp_replace(s, rf"(?i){SPACES}*(mm|cm|m|µm|μm|um)$", "") if kind == "length" else s
    s = F.regexp_replace(s, rf"(?<=[0-9])(?:'|’|{SPACES})(?=[0-9]{{3}})", "")
    s = F.regexp_replace(s, r",(?=[0-9]{3}(?:,[0-9]{3})*\.[0-9]*$)|\.(?=[0-9]{3}(?:\.[0-9]{3})*,[0-9]*$)", "")
    s = F.regexp_replace(s, r",(?=[0-9]{3}(?:,[0-9]{3})*$)", "") if kind == "int" else s
    return F.regexp_extract(F.regexp_replace(s, ",", "."), r"^([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)$", 1)


def unit_factor(name: Column, text: Column) -> Column:
    """Millimetres per unit: by the text's own unit, else by the one in the normalised name, else 1."""
    found = F.coalesce(
        F.nullif(F.regexp_extract(F.lower(text), rf"[0-9.,]{SPACES}*(mm|cm|m|µm|μm|um){SPACES}*$", 1), F.lit("")),
        F.nullif(F.regexp_extract(name, r" (mm|cm|m|µm|μm|um)$", 1), F.lit("")),
        F.lit("mm"),
    )
    return F.coalesce(*[F.when(found == u, F.lit(f)) for u, f in LENGTH_UNITS.items()])


def usable(rows: DataFrame, attributes: tuple[Attribute, ...], name: str, text: str) -> DataFrame:
    """``rows`` that give one of ``attributes`` a number, with ``pos_`` and ``value_`` (text of the number).

    A row whose text holds the name of an attribute and whose name holds the value is read the other way round.
    """
    known = "|".join(a.pattern for a in attributes)
    ways = F.array(F.struct(F.col(name).alias("n"), F.col(text).alias("t")), F.struct(F.col(text).alias("n"), F.col(name).alias("t")))
    named = F.filter(F.transform(ways, lambda w: F.struct(normalised(w["n"]).alias("n"), w["t"].alias("t"))), lambda w: w["n"].rlike(f"^({known})$"))
    # Each explode also keeps what follows from being folded back into the expressions before it.
    rows = rows.withColumn("hit_", F.explode(F.slice(named, 1, 1)))
    at = F.coalesce(*[F.when(F.col("hit_.n").rlike(f"^({a.pattern})$"), F.lit(i)) for i, a in enumerate(attributes)])
    rows = rows.withColumn("pos_", F.explode(F.array(at)))
    plain = F.coalesce(*[F.when(F.col("pos_") == i, number_text(F.col("hit_.t"), a.kind)) for i, a in enumerate(attributes)])
    rows = rows.withColumn("number_", F.explode(F.array(plain.try_cast("double"))))
    whole, length = (F.col("pos_").isin([i for i, a in enumerate(attributes) if a.kind == k]) for k in ("int", "length"))
    rows = rows.where((F.abs("number_") < float("inf")) & (~whole | (F.col("number_") == F.floor("number_"))))
    return rows.withColumn("value_", (F.col("number_") * F.when(length, unit_factor(F.col("hit_.n"), F.col("hit_.t"))).otherwise(1.0)).cast("string"))


def widen(
    rows: DataFrame,
    attributes: tuple[Attribute, ...] = SCAN_ATTRIBUTES,
    entity: str = "scan_id",
    name: str = "attr_name",
    text: str = "attr_text",
    at: str = "recorded_at",
    tie: str = "attr_row_id",
) -> DataFrame:
    """One row per entity of ``rows`` with one typed column per attribute.

    Nulls: rows without entity are left out; null names and texts give no value; a null time is older than any.
    Ties in time: the greater row id wins, then the greater text. Repeats change nothing. An empty table gives an
    empty one. Lengths come out in mm as doubles, whole numbers as bigint; a cell without usable value is null.
    Other columns of ``rows``, whatever their names, are not read.
    """
    rows = rows.select(*[F.col(c).alias(k) for c, k in ((entity, "entity_"), (name, "n_"), (text, "t_"), (at, "at_"), (tie, "tie_"))]).where("entity_ is not null")
    latest = (
        usable(rows, attributes, "n_", "t_")
        .groupBy("entity_", "pos_")
        .agg(F.max(F.struct("at_", "tie_", "value_")).alias("best_"))
        .select("entity_", "pos_", F.col("best_.value_").alias("value_"))
    )
    grid = rows.select("entity_").distinct().select("entity_", F.explode(F.array(*[F.lit(i) for i in range(len(attributes))])).alias("pos_"))
    cells = (
        grid.join(latest, ["entity_", "pos_"], "left")
        .groupBy("entity_")
        .agg(F.sort_array(F.collect_list(F.struct("pos_", "value_"))).alias("cells_"))
    )
    to = {"int": "bigint", "number": "double", "length": "double"}
    typed = [
        F.expr(f"try_cast(try_cast(cells_[{i}].value_ as double) as {to[a.kind]})").alias(a.column) for i, a in enumerate(attributes)
    ]
    return cells.select(F.col("entity_").alias(entity), *typed)


def found(wide: DataFrame, entity: str = "scan_id") -> DataFrame:
    """The cells of ``widen`` as (entity, field_name, field_val); lengths in whole micrometres."""
    cells = F.array(
        F.struct(F.lit("n_det").alias("field_name"), F.col("n_det").alias("field_val")),
        F.struct(F.lit("fdd").alias("field_name"), F.round(F.col("fdd") * 1000).cast("bigint").alias("field_val")),
        F.struct(F.lit("n_proj").alias("field_name"), F.col("n_proj").alias("field_val")),
    )
    return wide.select(entity, F.inline(cells)).where("field_val is not null")
