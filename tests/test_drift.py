import json
from datetime import datetime

from raylattice.operators import drift

HEAD = "header_id bigint, station_id bigint, written_at timestamp, arrived_at timestamp, body string, key string, value int, s_ int"


def heads(spark, rows):
    return spark.createDataFrame([(h, s, None if d is None else datetime(2024, 1, d), datetime(2024, 2, 1), b, "clash", 1, 2) for h, s, d, b in rows], HEAD)


def changes(spark, *rows):
    return sorted(tuple(r)[1:] for r in drift.changes(heads(spark, rows)).collect())


def test_each_kind_of_change(spark):
    assert changes(
        spark, (1, 1, 1, '{"SOD": 1, "Junk": 2}'), (2, 1, 2, '{"Fod": "1", "Junk": "x"}'), (3, 1, 3, '{"fod": "1", "Version": 2}'), (4, 1, 4, "{}"),
        (5, 2, 1, '{"PixelSize": [1], "SrcToObjectTol": 5}'), (6, 2, 2, '{"PixelSize": {"Width": 1}}'),
    ) == [(2, "SrcToObject", "renamed"), (2, "SrcToObject", "retyped"), (3, "SrcToObject", "renamed"), (3, "version", "added"), (4, "SrcToObject", "removed"), (4, "version", "removed"), (6, "PixelSize", "retyped")]


def test_a_null_is_present_and_keeps_the_type_before_it(spark):
    assert changes(spark, (1, 1, 1, '{"SOD": 1}'), (2, 1, 5, '{"SOD": null}'), (3, 1, 9, '{"SOD": 1.5}'), (4, 1, 12, '{"SOD": null}'), (5, 1, 20, '{"SOD": "2"}')) == [(5, "SrcToObject", "retyped")]
    assert changes(spark, (1, 1, 1, '{"SOD": 1}'), (2, 1, 2, "{}"), (3, 1, 3, '{"SOD": null}'), (4, 1, 4, '{"SOD": "2"}')) == [(2, "SrcToObject", "removed"), (3, "SrcToObject", "added")]


def test_order_repeats_unreadable_and_nulls(spark):
    rows = [(9, 1, 1, '{"SOD": 1}'), (3, 1, 2, '{"SDD": 1'), (4, 1, 2, None), (5, 1, 2, "[1]"), (2, 1, 3, '{"SOD": "1"}'), (2, 1, 3, '{"SOD": "1"}'), (None, 1, 4, '{"SOD": 1}'), (7, None, 4, '{"SOD": 1}'), (6, 1, None, '{"SOD": true}'), (8, 1, 5, " ")]
    assert changes(spark, *rows) == [(2, "SrcToObject", "retyped"), (9, "SrcToObject", "retyped")]
    assert changes(spark) == []


def test_headers_without_time_are_chained_over_spans_of_ids(spark):
    rows = [(k, 1, None, json.dumps({"SOD": k // 5000})) for k in (-9000, 3, 4096, 9999)] + [(20_000, 1, None, '{"SOD": "x"}'), (1, 1, 1, '{"SDD": 5}')]
    assert changes(spark, *rows) == [(1, "SrcToDetector", "added"), (1, "SrcToObject", "removed"), (20_000, "SrcToObject", "retyped")]


def test_ties_in_time_go_by_id_and_long_bodies_are_read(spark):
    long = '{"SOD": 1, "Note": "' + "x" * 300_000 + '"}'
    assert changes(spark, (2, 1, 1, '{"SOD": "1"}'), (1, 1, 1, long)) == [(2, "SrcToObject", "retyped")]


def test_consistent_table_and_failed_casts(spark):
    rows = [(1, 1, 1, '{"SrcToObject_um": 500000, "PixelSize": [0.2, 0.2], "version": {"major": 2, "minor": 1}, "Projections": "720.0"}'), (2, 1, 2, '{"SOD": {"Value": 50, "Unit": "cm"}, "pixel_size": "0,4 mm", "StepDeg": "oops", "WhiteLevel": null}')]
    a, b = drift.consistent(heads(spark, rows)).orderBy("header_id").collect()
    assert (a["SrcToObject"], a["PixelSize"], a["version"], a["Projections"], a["failed_casts"]) == (500.0, 0.2, "2.1", 720, [])
    assert (b["SrcToObject"], b["PixelSize"], b["AngularStep"], b["WhiteLevel"], b["failed_casts"]) == (500.0, 0.4, None, None, ["AngularStep"])
    assert drift.path_statistics(drift.path_values(heads(spark, rows))).where("key = 'SOD'").collect()[0]["raw_type"] == "object"


def test_heights_ends_of_numbers_and_statistics_by_file(spark):
    bodies = {
        '{"PixelSize": [0.2, 0.3]}': (0.2, 0.3, []), '{"PixelSize": {"Width": 0.2, "Height": 0.3}}': (0.2, 0.3, []), '{"PixelSize": "0.2;0.3"}': (0.2, 0.3, []),
        '{"PixelSize": "0.2x0.3 cm"}': (2.0, 3.0, []), '{"PixelSize_um": "200 x 300"}': (0.2, 0.3, []), '{"PixelSize": "0,2 mm"}': (0.2, 0.2, []), '{"PixelSize": 0.2}': (0.2, 0.2, []),
        '{"PixelSize": [0.2, "bad"]}': (0.2, None, ["PixelSize"]), '{"PixelSize": "12abc"}': (None, None, ["PixelSize"]), '{"SOD": "12abc", "Projections": "12abc"}': (None, None, ["Projections", "SrcToObject"]),
        '{"StepDeg": "-0.5 deg", "SOD": "5 cm"}': (None, None, []),
    }
    rows = drift.consistent(heads(spark, [(k, 1, 1, b) for k, b in enumerate(bodies)])).orderBy("header_id").collect()
    for r, (width, high, failed) in zip(rows, bodies.values(), strict=True):
        assert (r["PixelSize"] is None, r["PixelSizeHeight"] is None, sorted(r["failed_casts"])) == (width is None, high is None, failed)
        assert abs((r["PixelSize"] or 0) - (width or 0)) < 1e-12 and abs((r["PixelSizeHeight"] or 0) - (high or 0)) < 1e-12
    assert (rows[-1]["AngularStep"], rows[-1]["SrcToObject"]) == (-0.5, 50.0)
    paths = drift.path_values(heads(spark, [(1, 1, 1, '{"SOD": 1}')]))
    assert [r["headers"] for r in drift.path_statistics(paths.unionByName(paths)).collect()] == [1]
