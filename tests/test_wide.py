from datetime import datetime

import pytest

from raylattice.operators import wide

ROW = "attr_row_id bigint, scan_id bigint, attr_name string, attr_text string, recorded_at timestamp, arrived_at timestamp"


def t(day):
    return datetime(2024, 1, day)


def table(spark, rows):
    return spark.createDataFrame([(i, s, n, x, a, None) for i, s, n, x, a in rows], ROW)


def cells(spark, rows):
    return {(r["scan_id"], r["field_name"]): r["field_val"] for r in wide.found(wide.widen(table(spark, rows))).collect()}


@pytest.mark.parametrize(
    ("name", "text", "field", "value"),
    [
        ("Number of Detector Elements", "1'440", "n_det", 1440), ("number_of_detector_elements", "1.024e+03", "n_det", 1024), ("Detector Elements, Number of", ' "0256" ', "n_det", 256),
        ("No. of Detector Elements:", "+384.", "n_det", 384), ("Number of Detector Elements", " 1,024", "n_det", 1024), ("FDD [mm]", "1126,88", "fdd", 1126880), ("FDD_mm", "1.126,88", "fdd", 1126880),
        ("fdd", "138.568 cm", "fdd", 1385680), ("FDD [m]", "1.43397", "fdd", 1433970), ("FDD [µm]", "1004620", "fdd", 1004620), ("FDD [cm]", "534.12mm", "fdd", 534120),
        ("CT: No. of Projections", "180", "n_proj", 180), ("512", "Detector Elements, Number of", "n_det", 512), ("155.830", "FDD [cm]", "fdd", 1558300),
    ],
)
def test_spellings(spark, name, text, field, value):
    assert cells(spark, [(1, 7, name, text, t(1))]) == {(7, field): value}


@pytest.mark.parametrize(
    ("name", "text"),
    [("FDD tolerance [mm]", "0.2"), ("CT: Number of Projections skipped", "8"), ("Number of Detector Modules", "16"), ("FDD [mm]", "n/a"), ("FDD [mm]", "NaN"), ("FDD [mm]", "Infinity"), ("FDD", ""), ("FDD", None), (None, "5"), ("CT: Number of Projections", "12.5"), ("FDD", "1d"), ("FDD", "5 kg")],
)
def test_unusable(spark, name, text):
    assert cells(spark, [(1, 7, name, text, t(1))]) == {}


def test_latest_usable_wins_and_ties_go_to_the_greater_row(spark):
    rows = [(1, 7, "FDD", "1", t(1)), (2, 7, "fdd [mm]", "2", t(3)), (3, 7, "FDD", "?", t(4)), (4, 7, "FDD", "9", None), (5, 8, "FDD", "1", t(1)), (6, 8, "FDD", "2", t(1)), (6, 8, "FDD", "2", t(1)), (7, None, "FDD", "2", t(1))]
    assert cells(spark, rows) == {(7, "fdd"): 2000, (8, "fdd"): 2000}


def test_every_entity_gets_a_row_and_clashing_columns_are_harmless(spark):
    df = table(spark, [(1, 7, "Filter", "Cu", t(1)), (2, 8, "FDD", "3", t(1))]).selectExpr("*", "'x' as value_", "1 as pos_", "2 as entity_", "'y' as field_val")
    assert sorted(map(tuple, wide.widen(df).collect())) == [(7, None, None, None), (8, None, 3.0, None)]
    assert wide.widen(df.limit(0)).collect() == []
    long = "x" * 200_000
    assert cells(spark, [(1, 7, "FDD", long, t(1)), (2, 7, long, "1", t(1))]) == {}
