"""Queries of the general data problems (pN_...), over their whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from raylattice.operators import compaction, drift, nested, regular, wide
from raylattice.session import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wide.found(wide.widen(table(spark, sf_dir, "scan_attr")))


def p1_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wide.widen(table(spark, sf_dir, "scan_attr"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regular.empty_slots(p2_series(spark, sf_dir))


def p2_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regular.regular_series(table(spark, sf_dir, "projection"), table(spark, sf_dir, "scan"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compaction.compacted_keys(table(spark, sf_dir, "frame_file"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested.children(table(spark, sf_dir, "calib_doc"), ("ObjectScatterFit", "DetectorScatterModel", "Acquisitions"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.changes(table(spark, sf_dir, "header_file"))


def p5_consistent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.consistent(table(spark, sf_dir, "header_file"))


def p5_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.path_statistics(drift.path_values(table(spark, sf_dir, "header_file")))


QUERIES = {f.__name__: f for f in (p1_found, p1_wide, p2_found, p2_series, p3_found, p4_found, p5_found, p5_consistent, p5_paths)}

P1_CELLS = r"""
WITH named AS (
  SELECT scan_id, recorded_at, attr_row_id, attr_text,
    trim(regexp_replace(lower(attr_name), '[^\p{L}\p{N}]+', ' ', 'g')) AS n,
    trim(regexp_replace(lower(attr_text), '[^\p{L}\p{N}]+', ' ', 'g')) AS m, attr_name
  FROM scan_attr WHERE scan_id IS NOT NULL
), kinds AS (
  SELECT * FROM (VALUES
    ('n_det', '((number|no|nr|num|count) of detector elements|detector elements (number|no|nr|num|count) of)'),
    ('fdd', '(fdd|focus detector distance)( (mm|cm|m|µm|μm|um))?'),
    ('n_proj', '(ct (number|no|nr|num|count) of projections|ct projections (number|no|nr|num|count) of|projections (number|no|nr|num|count) of ct)')) AS t(field_name, pattern)
), hits AS (
  SELECT scan_id, recorded_at, attr_row_id, field_name, n AS name, attr_text AS txt FROM named JOIN kinds ON regexp_full_match(n, pattern)
  UNION ALL
  SELECT scan_id, recorded_at, attr_row_id, k.field_name, m, attr_name FROM named JOIN kinds k ON regexp_full_match(m, k.pattern)
  WHERE NOT EXISTS (SELECT 1 FROM kinds q WHERE regexp_full_match(named.n, q.pattern))
), stripped AS (
  SELECT *, regexp_replace(txt, '^[\s\x{a0}"]+|[\s\x{a0}"]+$', '', 'g') AS s FROM hits
), units AS (
  SELECT *, CASE WHEN field_name = 'fdd' THEN coalesce(
      nullif(regexp_extract(lower(s), '[0-9.,][\s\x{a0}]*(mm|cm|m|µm|μm|um)$', 1), ''),
      nullif(regexp_extract(name, ' (mm|cm|m|µm|μm|um)$', 1), ''), 'mm') END AS unit,
    regexp_replace(replace(replace(CASE WHEN field_name = 'fdd' THEN regexp_replace(s, '[\s\x{a0}]*(mm|cm|m|µm|μm|um)$', '', 'i') ELSE s END, '''', ''), ' ', ''), ',', '.', 'g') AS num
  FROM stripped
), vals AS (
  SELECT scan_id, field_name, recorded_at, attr_row_id, TRY_CAST(num AS DOUBLE) * CASE unit WHEN 'cm' THEN 10 WHEN 'm' THEN 1000 WHEN 'µm' THEN 0.001 WHEN 'μm' THEN 0.001 WHEN 'um' THEN 0.001 ELSE 1 END AS v
  FROM units WHERE regexp_full_match(num, '[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?')
), cells AS (
  SELECT scan_id, field_name, arg_max(v, (recorded_at, attr_row_id)) AS v FROM vals
  WHERE field_name = 'fdd' OR v = floor(v) GROUP BY 1, 2
)
"""

P5_PATHS = """
WITH one AS (SELECT header_id, station_id, arg_max(struct_pack(w := written_at, b := body), (coalesce(arrived_at, TIMESTAMP '0001-01-01'), coalesce(written_at, TIMESTAMP '0001-01-01'), coalesce(body, ''))) AS h
  FROM header_file WHERE header_id IS NOT NULL AND station_id IS NOT NULL GROUP BY 1, 2),
readable AS MATERIALIZED (SELECT header_id, station_id, h.w AS written_at, h.b AS body FROM one WHERE CASE WHEN json_valid(h.b) THEN json_type(h.b) = 'OBJECT' ELSE false END),
keys AS (SELECT header_id, station_id, written_at, body, unnest(json_keys(body)) AS key FROM readable),
paths AS MATERIALIZED (SELECT header_id, station_id, written_at, key, CASE json_type(body, '$."' || key || '"')
  WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'ARRAY' THEN 'array' WHEN 'OBJECT' THEN 'object' WHEN 'NULL' THEN 'null' ELSE 'number' END AS raw_type FROM keys)"""

#: As ``drift.field_of``: the key's plain form names the field, with or without a unit at its end.
P5_NAMES = ", ".join(f"('{k}', {i}, '{f.name}')" for i, f in enumerate(drift.HEADER_FIELDS) for k in f.keys)
P5_FOUND = f"""{P5_PATHS},
names(plain, f, field_name) AS (VALUES {P5_NAMES}),
named AS (SELECT p.*, coalesce(a.f, b.f) AS f FROM paths p LEFT JOIN names a ON a.plain = regexp_replace(lower(key), '[^a-z0-9]', '', 'g')
  LEFT JOIN names b ON b.plain = regexp_replace(lower(regexp_replace(key, '(?i)[^A-Za-z0-9]+({'|'.join(drift.KEY_UNITS)})\\]?$', '')), '[^a-z0-9]', '', 'g')),
cells AS (SELECT r.station_id, r.header_id, r.written_at, f.f, f.field_name, n.key, CASE WHEN n.key IS NULL THEN 'absent' WHEN n.raw_type <> 'null' THEN n.raw_type END AS kind
  FROM readable r CROSS JOIN (SELECT DISTINCT f, field_name FROM names) f LEFT JOIN (SELECT header_id, station_id, f, min(key) AS key, arg_min(raw_type, key) AS raw_type FROM named WHERE f IS NOT NULL GROUP BY ALL) n
  ON n.header_id = r.header_id AND n.station_id = r.station_id AND n.f = f.f),
seq AS (SELECT *, row_number() OVER w AS n, lag(key) OVER w AS was, last_value(kind IGNORE NULLS) OVER (PARTITION BY station_id, f ORDER BY written_at NULLS FIRST, header_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS kind0
  FROM cells WINDOW w AS (PARTITION BY station_id, f ORDER BY written_at NULLS FIRST, header_id)),
found AS (SELECT station_id, header_id, field_name, unnest([CASE WHEN key IS NOT NULL AND was IS NULL THEN 'added' END, CASE WHEN key IS NULL AND was IS NOT NULL THEN 'removed' END,
  CASE WHEN key <> was THEN 'renamed' END, CASE WHEN key IS NOT NULL AND was IS NOT NULL AND kind0 <> 'absent' AND kind <> kind0 THEN 'retyped' END]) AS change_kind FROM seq WHERE n > 1)
SELECT station_id, header_id, field_name, change_kind FROM found WHERE change_kind IS NOT NULL"""

ORACLES = {
    "p5_paths": P5_PATHS + " SELECT station_id, key, raw_type, count(DISTINCT header_id) AS headers, min(written_at) AS first_at, max(written_at) AS last_at FROM paths GROUP BY ALL",
    "p5_found": P5_FOUND,
    "p1_found": P1_CELLS
    + "SELECT scan_id, field_name, CAST(round(CASE WHEN field_name = 'fdd' THEN v * 1000 ELSE v END) AS BIGINT) AS field_val FROM cells",
    "p1_wide": P1_CELLS
    + """SELECT e.scan_id, CAST(max(v) FILTER (field_name = 'n_det') AS BIGINT) AS n_det, max(v) FILTER (field_name = 'fdd') AS fdd,
      CAST(max(v) FILTER (field_name = 'n_proj') AS BIGINT) AS n_proj
    FROM (SELECT DISTINCT scan_id FROM scan_attr WHERE scan_id IS NOT NULL) e LEFT JOIN cells USING (scan_id) GROUP BY 1""",
    "p2_found": """
WITH g AS (SELECT DISTINCT scan_id, start_deg, step_deg, n_slots FROM scan WHERE scan_id IS NOT NULL),
r AS (
  SELECT scan_id, CASE WHEN angle_unit = 'rad' THEN degrees(angle) ELSE angle END AS deg FROM projection
  WHERE angle IS NOT NULL AND isfinite(angle) AND len(list_filter(projs, lambda x: x IS NOT NULL AND isfinite(x))) > 0
), d AS (
  SELECT g.*, (((deg - start_deg) * sign(step_deg)) % 360 + 360) % 360 AS raw, abs(step_deg) AS w FROM r JOIN g USING (scan_id)
), s AS (
  SELECT DISTINCT scan_id, CAST(floor((CASE WHEN 360 - raw <= w / 2 THEN raw - 360 ELSE raw END) / w + 0.5) AS BIGINT) AS slot FROM d
), allslots AS (SELECT scan_id, CAST(unnest(range(n_slots)) AS BIGINT) AS slot FROM g)
SELECT scan_id, slot FROM allslots ANTI JOIN s USING (scan_id, slot)""",
}
