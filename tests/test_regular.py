import math

import numpy as np
import pytest

from raylattice.operators import regular

SCAN = "scan_id bigint, scanner_id int, start_deg double, step_deg double, n_slots int"
READ = "reading_id bigint, scan_id bigint, angle double, angle_unit string, airnorm double, projs array<float>"


def run(spark, scans, readings, **kw):
    s = spark.createDataFrame([(i, 1, *g) for i, *g in scans], SCAN)
    p = spark.createDataFrame([(k, s_, a, u, 1.0, v) for k, (s_, a, u, v) in enumerate(readings)], READ)
    return regular.regular_series(p, s, **kw)


def slots(df, state="observed"):
    return {(r["scan_id"], r["slot"]) for r in df.where(df.state == state).collect()}


def test_slots_wrap_and_signs_and_units(spark):
    scans = [(1, 350.0, 10.0, 36), (2, 10.0, -90.0, 4), (3, 0.0, 90.0, 2), (1, 350.0, 10.0, 36)]
    one = [1.0, None]
    readings = [(1, 346.0, None, one), (1, -724.0, "deg", one), (1, math.radians(30), " RAD", one), (2, 281.0, "deg", one), (2, 56.0, "deg", one), (3, 136.0, "deg", one), (3, 314.0, "deg", one), (3, 316.0, "deg", one), (9, 1.0, "deg", one)]
    df = run(spark, scans, readings)
    assert slots(df) == {(1, 0), (1, 1), (1, 4), (2, 1), (2, 3), (3, 0)}
    assert df.count() == 42


def test_grids_beyond_a_turn_take_a_reading_twice(spark):
    df = run(spark, [(1, 0.0, 90.0, 6)], [(1, 5.0, "deg", [1.0])])
    assert slots(df) == {(1, 0), (1, 4)}


def test_unusable_readings_and_scans_without_any(spark):
    nan, inf = float("nan"), float("inf")
    bad = [(1, nan, "deg", [1.0]), (1, None, "deg", [1.0]), (1, inf, "deg", [1.0]), (1, 0.0, "deg", []), (1, 0.0, "deg", None), (1, 0.0, "deg", [nan, inf, None]), (None, 0.0, "deg", [1.0])]
    df = run(spark, [(1, 0.0, 90.0, 4), (None, 0.0, 1.0, 4), (2, 0.0, 0.0, 4), (3, None, 1.0, 4)], bad)
    assert slots(df, "unsupported") == {(1, k) for k in range(4)}
    assert run(spark, [], []).count() == 0
    assert regular.empty_slots(run(spark, [(1, 0.0, 90.0, 4)], [])).count() == 4


def test_nearest_reading_counts_and_repeats_do_not(spark):
    df = run(spark, [(1, 0.0, 90.0, 4)], [(1, 20.0, "deg", [5.0]), (1, 2.0, "deg", [7.0]), (1, 2.0, "deg", [7.0]), (1, -2.0, "deg", [8.0])])
    assert [r["projs"] for r in df.where("slot = 0").collect()] == [[7.0]]


def test_low_rank_cells_are_recovered_and_observed_ones_exact(spark):
    rng = np.random.default_rng(1)
    n, scans, width = 24, 40, 3
    basis = np.cos(np.pi * np.outer(np.arange(1, 3), np.arange(n) + 0.5) / n)
    truth = 100 * (1 + 0.3 * np.einsum("spk,kn->snp", rng.standard_normal((scans, width, 2)), basis))
    readings, missing = [], set()
    for s in range(scans):
        for k in range(n):
            if rng.random() < 0.2:
                missing.add((s, k))
            else:
                readings.append((s, 15.0 * k, "deg", [float(x) for x in truth[s, k]]))
    df = run(spark, [(s, 0.0, 15.0, n) for s in range(scans)], readings, rounds=6)
    rows = {(r["scan_id"], r["slot"]): r for r in df.collect()}
    for (s, k), r in rows.items():
        if (s, k) in missing:
            assert r["state"] == "filled"
        else:
            assert r["state"] == "observed" and r["projs"] == pytest.approx([np.float32(x) for x in truth[s, k]], abs=0)
    assert np.mean([np.abs(np.array(rows[m]["projs"]) - truth[m]).mean() for m in missing]) < 0.15 * truth.std()


def test_broadcast_and_salted_ways_agree(spark, monkeypatch):
    args = ([(1, 0.0, 10.0, 36), (2, 5.0, -7.5, 48)], [(1 + k % 2, 3.7 * k, "deg", [1.0 * k]) for k in range(60)])
    a = slots(run(spark, *args))
    monkeypatch.setattr(regular, "small_enough", lambda *_: False)
    monkeypatch.setattr(regular, "BROADCAST_BYTES", -1)
    assert slots(run(spark, *args)) == a


def test_wide_detectors_are_cut_into_blocks(spark, monkeypatch):
    rng = np.random.default_rng(3)
    readings = [(s, 10.0 * k, "deg", [float(x) for x in rng.random(7 if k % 5 else 4)]) for s in range(6) for k in range(36) if (s + k) % 6]
    scans = [(s, 0.0, 10.0, 36) for s in range(6)] + [(9, 0.0, 10.0, 36)]
    whole = sorted(map(tuple, run(spark, scans, readings).collect()))
    monkeypatch.setattr(regular, "ELEMENTS", 3)
    cut = sorted(map(tuple, run(spark, scans, readings).collect()))
    assert len(whole) == len(cut) == 7 * 36
    for a, b in zip(whole, cut, strict=True):
        assert a[:2] == b[:2] and a[3] == b[3] and a[2] == pytest.approx(b[2], rel=1e-4)


def test_noise_is_filled_by_the_mean_within_the_observed_range(spark):
    rng = np.random.default_rng(2)
    truth = rng.exponential(10, (30, 24, 2))
    missing = {(s, k) for s in range(30) for k in range(24) if rng.random() < 0.2}
    readings = [(s, 15.0 * k, "deg", [float(x) for x in truth[s, k]]) for s in range(30) for k in range(24) if (s, k) not in missing]
    rows = {(r["scan_id"], r["slot"]): r["projs"] for r in run(spark, [(s, 0.0, 15.0, 24) for s in range(30)], readings).collect()}
    means = {s: np.mean([rows[s, k] for k in range(24) if (s, k) not in missing], 0) for s in range(30)}
    error = np.sqrt(np.mean([(np.array(rows[s, k]) - truth[s, k]) ** 2 for s, k in missing]))
    assert error < 1.03 * np.sqrt(np.mean([(means[s] - truth[s, k]) ** 2 for s, k in missing]))
    assert min(min(rows[m]) for m in missing) >= 0
