"""Deeply nested XML and JSON documents into related flat tables.

Every body is brought to one uniform tree (each element a list of objects, values under ``#text``), a merged
schema is inferred over all trees, and each level of repeated elements becomes a child table by a recursive
explode that carries the parent's surrogate key and the element's ordinal.
"""

from __future__ import annotations

import json
import re
import xml.parsers.expat
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType, _parse_datatype_string

from raylattice.session import materialise, spread

TEXT = "#text"
#: Marks an element that holds a value that isn't blank, itself or below.
HAS = "#value"
#: Nesting beyond which a body isn't read but reported; Spark's JSON reader ends at 1,000 levels of objects and lists.
DEEPEST = 50


class TooDeep(ValueError):
    """For a body nested beyond ``DEEPEST``."""


def refused(name: str) -> float:
    """For NaN and infinities, which JSON has no numbers for."""
    raise ValueError(name)


def local(name: str) -> str:
    return name.rpartition(" ")[2].rpartition(":")[2]


def xml_tree(body: str) -> dict | None:
    """The tree of a well-formed XML text: attributes and children alike as lists of objects. Names lose their
    namespace; comments and processing instructions give nothing. Entities declared in the text aren't expanded."""
    top: dict = {}
    stack: list[dict] = [top]

    def start(name: str, attributes: dict) -> None:
        if len(stack) > DEEPEST:
            raise TooDeep(f"nested beyond {DEEPEST} levels")
        node: dict = {}
        for k, v in attributes.items():
            if k.startswith("http://www.w3.org/2001/XMLSchema-instance "):
                continue
            node.setdefault(local(k), []).append({TEXT: v})
        stack[-1].setdefault(local(name), []).append(node)
        stack.append(node)

    def text(data: str) -> None:
        stack[-1][TEXT] = stack[-1].get(TEXT, "") + data

    def declared(*_: object) -> None:
        raise ValueError("entity declarations aren't read")

    parser = xml.parsers.expat.ParserCreate(namespace_separator=" ")
    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = start, lambda _: stack.pop(), text
    parser.EntityDeclHandler, parser.buffer_text = declared, True
    try:
        parser.Parse(re.sub(r"^(<\?xml[^>]*?)\s+encoding\s*=\s*(\"[^\"]*\"|'[^']*')", r"\1", body).encode("utf-8", "replace"), True)
    except TooDeep:
        raise
    except (xml.parsers.expat.ExpatError, ValueError):
        return None
    return top


def listed(value: object, depth: int = 0) -> list[dict]:
    """A JSON value as a list of objects; nulls hold their place as blank objects, nested lists are joined."""
    if depth > DEEPEST:
        raise TooDeep(f"nested beyond {DEEPEST} levels")
    if isinstance(value, list):
        return [x for v in value for x in listed(v, depth + 1)]
    if isinstance(value, dict):
        node: dict = {}
        for k, v in value.items():
            if k == TEXT:
                node[TEXT] = v if isinstance(v, str) else json.dumps(v)
            else:
                node[k.lstrip("@")] = listed(v, depth + 1)
        return [node]
    return [{} if value is None else {TEXT: value if isinstance(value, str) else json.dumps(value)}]


def tree(body: str | None) -> dict | None:
    """The uniform tree of a body, or None where it isn't well-formed; raises ``TooDeep``. A JSON object whose text value ``payload``
    (or, as its only long text, any value) is itself such a body is an envelope and is opened."""
    text = (body or "").strip("﻿ \t\r\n")
    if text[:1] == "<":
        return xml_tree(text)
    if text[:1] not in ("{", "["):
        return None
    try:
        value = json.loads(text, parse_constant=refused)
    except RecursionError:
        raise TooDeep(f"nested beyond {DEEPEST} levels") from None
    except ValueError:
        return None
    if isinstance(value, dict):
        inner = [v for v in value.values() if isinstance(v, str) and v.strip("﻿ \t\r\n")[:1] in ("<", "{") and len(v) > 1]
        if len(inner) == 1 and not any(isinstance(v, dict | list) for v in value.values()):
            return tree(inner[0])
    roots = listed(value)
    merged: dict = {}
    for r in roots:
        for k, v in r.items():
            merged.setdefault(k, [] if k != TEXT else "")
            merged[k] = merged[k] + v
    return merged


def marked(node: dict) -> bool:
    """Whether ``node`` holds a value that isn't blank; marks it and its descendants, and drops blank texts."""
    if not node.get(TEXT, "").strip():
        node.pop(TEXT, None)
    below = [marked(x) for v in node.values() if isinstance(v, list) for x in v]
    if TEXT in node or any(below):
        node[HAS] = "1"
    return HAS in node


def judged(body: str | None) -> tuple[str | None, str | None]:
    """(tree as JSON, None) of a body with a value, or (None, what keeps it from being read)."""
    try:
        found = tree(body)
    except TooDeep as e:
        return None, str(e)
    if not found:
        return None, "not well-formed"
    return (json.dumps(found), None) if marked(found) else (None, "blank")


def trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, 256):
            part = batch.slice(start, 256)
            found = [judged(b) for b in part.column("body").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("key_"), pa.array([t for t, _ in found], pa.string()), pa.array([r for _, r in found], pa.string())], names=["key_", "tree", "reason"])


TREES = "key_ bigint, tree string, reason string"


def bodies(docs: DataFrame, key: str, body: str) -> DataFrame:
    return docs.select(F.col(key).cast("bigint").alias("key_"), F.col(body).alias("body")).where("key_ is not null and body is not null")


def unreadable(docs: DataFrame, key: str = "calib_id", body: str = "body") -> DataFrame:
    """(key, reason) of each document with a key and a body that the flat tables leave out: ``not well-formed``,
    ``blank`` or nested beyond ``DEEPEST`` levels. Repeats count once."""
    return spread(bodies(docs, key, body)).mapInArrow(trees, TREES).where("reason is not null").select(F.col("key_").alias(key), "reason").distinct()


def pruned(kind: DataType, names: tuple[str, ...]) -> DataType:
    """``kind`` with only the elements on the way to those called one of ``names``, and the marks of values."""
    if isinstance(kind, ArrayType):
        return ArrayType(pruned(kind.elementType, names))
    if not isinstance(kind, StructType):
        return kind
    out = StructType()
    for f in kind.fields:
        below = pruned(f.dataType, names)
        if f.name == HAS or f.name in names or isinstance(below, ArrayType) and isinstance(below.elementType, StructType) and set(below.elementType.fieldNames()) - {HAS}:
            out.add(f.name, below)
    return out


def merged_schema(canonical: DataFrame) -> StructType:
    """The schema that all trees fit, merged over all rows by an aggregate. Names differing only in case stay apart."""
    ddl = canonical.agg(F.schema_of_variant_agg(F.try_parse_json("tree")).alias("s")).first()["s"]
    if not ddl or ddl in ("VOID", "VARIANT"):
        return StructType()
    ddl = re.sub(r"\bVOID\b", "STRING", re.sub(r"\bOBJECT(?=<)", "STRUCT", ddl))
    return _parse_datatype_string(ddl)  # type: ignore[return-value]


def unique_names(kind: DataType) -> DataType:
    """``kind`` with field names that differ in case only numbered, so that each can be addressed."""
    if isinstance(kind, ArrayType):
        return ArrayType(unique_names(kind.elementType))
    if not isinstance(kind, StructType):
        return kind
    out, seen = StructType(), set()
    for f in kind.fields:
        name, i = f.name, 2
        while name.lower() in seen:
            name, i = f"{f.name}_{i}", i + 1
        seen.add(name.lower())
        out.add(name, unique_names(f.dataType))
    return out


def is_leaf(kind: DataType) -> bool:
    """Whether an element holds text only."""
    return isinstance(kind, ArrayType) and (not isinstance(kind.elementType, StructType) or set(kind.elementType.fieldNames()) <= {TEXT, HAS})


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def flatten(docs: DataFrame, key: str = "calib_id", body: str = "body", always: tuple[str, ...] = (), only: tuple[str, ...] = ()) -> dict[str, DataFrame]:
    """Flat tables of the documents in ``docs``, by element path such as ``Scan/Acquisitions``.

    Each has the document's key, ``row_key`` (ordinals along the path: a surrogate key within the document),
    ``parent_key``, ``parent_no`` and ``child_no`` (positions from 1 among siblings of the same name, blank ones
    counted), ``blank`` and a text column per attribute or leaf child of the element (repeated leaves joined by a
    newline). A leaf element is a column of its parent, and no table of its own, unless some document gives it
    children or attributes or ``always`` names it. With ``only`` no more is parsed than leads to elements of these
    names. Each document is parsed once, whatever the number of tables.

    Null bodies, empty texts, bodies that aren't well-formed or too deep, which ``unreadable`` reports, and rows
    without key give nothing. Of rows with the
    same key and body one is read. An empty table gives no tables. Other columns of ``docs`` aren't read.
    """
    read = spread(bodies(docs, key, body)).mapInArrow(trees, TREES).where("tree is not null").select("key_", "tree")
    canonical = materialise(read.dropDuplicates(["key_", "tree"]))
    schema = merged_schema(canonical)
    if only:
        schema = pruned(schema, only)
    unique = unique_names(schema)
    tables: dict[str, DataFrame] = {}

    def descend(parent: DataFrame, kind: StructType, path: str) -> None:
        for f in kind.fields:
            if not isinstance(f.dataType, ArrayType) or not isinstance(f.dataType.elementType, StructType) or (is_leaf(f.dataType) and f.name not in always):
                continue
            here = f"{path}/{f.name}" if path else f.name
            below = f.dataType.elementType
            level = parent.select(
                "key_", F.col("row_key").alias("parent_key"), F.col("child_no").alias("parent_no"), F.posexplode(F.col(f"node_.{quoted(f.name)}")).alias("at_", "node_")
            ).select(
                "key_", "parent_key", "parent_no", (F.col("at_") + 1).cast("bigint").alias("child_no"),
                F.concat_ws(".", "parent_key", (F.col("at_") + 1).cast("string")).alias("row_key"), "node_",
            )
            leaves = {}
            for g in below.fields:
                if g.name == TEXT:
                    leaves[TEXT] = F.col(f"node_.{quoted(TEXT)}")
                elif is_leaf(g.dataType) and isinstance(g.dataType.elementType, StructType):
                    known = TEXT in g.dataType.elementType.fieldNames()
                    leaves[g.name] = F.array_join(F.col(f"node_.{quoted(g.name)}.{quoted(TEXT)}"), "\n") if known else F.lit(None).cast("string")
            taken = {"row_key", "parent_key", "parent_no", "child_no", "blank", key.lower()}
            named = [v.alias(n if n.lower() not in taken else f"{n}_value") for n, v in leaves.items()]
            blank = F.col(f"node_.{quoted(HAS)}").isNull() if HAS in below.fieldNames() else F.lit(True)
            tables[here] = level.select(F.col("key_").alias(key), "row_key", "parent_key", "parent_no", "child_no", blank.alias("blank"), *named)
            descend(level, below, here)

    top = canonical.select("key_", F.lit("").alias("row_key"), F.lit(1).cast("bigint").alias("child_no"), F.from_json("tree", schema).cast(unique).alias("node_")) if schema.fields else None
    if top is not None:
        descend(materialise(top), unique, "")
    return tables


def children(docs: DataFrame, kinds: tuple[str, ...], key: str = "calib_id") -> DataFrame:
    """(key, child_kind, parent_no, child_no) of each element of ``kinds`` that holds a value, at any depth."""
    empty = docs.select(F.col(key).cast("bigint").alias(key), F.lit("").alias("child_kind"), F.lit(1).cast("bigint").alias("parent_no"), F.lit(1).cast("bigint").alias("child_no")).limit(0)
    parts = [t.where("not blank").select(key, F.lit(p.rpartition("/")[2]).alias("child_kind"), "parent_no", "child_no") for p, t in flatten(docs, key, always=kinds, only=kinds).items() if p.rpartition("/")[2] in kinds]
    return reduce(DataFrame.unionByName, parts, empty).distinct()
