import gzip
import json
from datetime import datetime

import pytest

from raylattice.operators import compaction

LINE = '{"scan":1,"proj":2,"rev":1,"angle":3.5,"n":3,"px":[1,2,3]}'


def keys(raw):
    return [r[:3] for r in compaction.records(raw)]


@pytest.mark.parametrize(
    ("raw", "found"),
    [
        (LINE.encode(), [(1, 2, 1)]), (gzip.compress(LINE.encode()), [(1, 2, 1)]), (("﻿" + LINE + "\r\n").encode(), [(1, 2, 1)]), (json.dumps(json.loads(LINE), indent=1).encode(), [(1, 2, 1)]),
        ((LINE + "\n" + LINE[:30]).encode(), [(1, 2, 1)]), (f"[{LINE},{LINE}]".encode(), [(1, 2, 1)] * 2), (f"[{LINE},{LINE[:20]}".encode(), []), (b"scan=4|proj=5|rev=1|angle=1|n=2|px=7,8\nscan=4|proj=6|rev=1|n=2|px=7", [(4, 5, 1)]),
        (b"proj\tscan\tangle\trev\tn\tpx\r\n5\t4\t1.0\t1\t2\t7;8\r\n6\t4\t1.0\t1\t2\t7\r\n7\t4", [(4, 5, 1)]), (b"scan,proj,rev,angle,n,px\n4,5,1,,2,7;8", [(4, 5, 1)]), (b"scan,proj,rev,angle,n,px", []), (b"5,4,1.0,1,2,7;8", []),
        (b"", []), (None, []), (b"\n", []), (b"[]", []), (b"\x1f\x8bbroken", []), (b"\xff\xfe\x00", []), (b'{"scan":1,"proj":2,"rev":1,"n":1,"px":[null]}', []), (b'{"scan":1,"proj":2,"rev":true,"n":0,"px":[]}', []), (b'{"scan":1,"proj":2,"rev":1,"n":0,"px":[]}', [(1, 2, 1)]),
    ],
)
def test_layouts(raw, found):
    assert keys(raw) == found


def test_cut_and_joined_gzip_files_and_long_numbers():
    many = "\n".join(LINE.replace('"proj":2', f'"proj":{k}').replace("[1,2,3]", f"[{k * k},{k**3 % 97}.25,3]") for k in range(2000))
    whole = gzip.compress(many.encode())
    cut = keys(whole[: len(whole) // 2])
    assert 500 < len(cut) < 1500 and cut == [(1, k, 1) for k in range(len(cut))]
    assert keys(gzip.compress(LINE.encode() + b"\n") + gzip.compress(LINE.encode())) == [(1, 2, 1)] * 2
    assert keys(b"scan=00000000000000000000000000000004|proj=9223372036854775807|rev=1.000000000000000000000000|n=1|px=7") == [(4, 9223372036854775807, 1)]
    assert keys(b"scan=4|proj=9223372036854775808|rev=1|n=1|px=7") == []


def test_written_files_come_near_to_the_target(spark, tmp_path):
    raws = [f'{{"scan":{k % 3},"proj":{k},"rev":1,"n":200,"px":[{",".join(str(k * j % 50) for j in range(200))}]}}'.encode() for k in range(3000)]
    compaction.compact(files(spark, raws), f"file://{tmp_path}/out", target_bytes=100_000)
    sizes = sorted(p.stat().st_size for p in (tmp_path / "out").glob("*.parquet"))
    assert 25_000 < sizes[len(sizes) // 2] < 250_000, sizes


FILES = "file_id bigint, file_path string, n_bytes bigint, modified_at timestamp, raw_bytes binary, px string, scan int"


def files(spark, raws):
    return spark.createDataFrame([(i, "x", 1, datetime(2024, 1, 1 + i % 5), r, "clash", 9) for i, r in enumerate(raws)], FILES)


def test_every_record_once_sorted_and_the_latest_file_wins(spark, tmp_path):
    raws = [f'{{"scan":{k % 3},"proj":{k},"rev":1,"n":2,"px":[{k},{k}]}}'.encode() for k in range(50)] * 2 + [b'{"scan":0,"proj":0,"rev":1,"n":1,"px":[77]}']
    target = f"file://{tmp_path}/out"
    df = compaction.compact(files(spark, raws[:-1] + [None, b""] + [b""] * 2 + raws[-1:]), target, target_bytes=700)
    rows = df.collect()
    assert sorted((r["scan"], r["proj"], r["rev"]) for r in rows) == sorted((k % 3, k, 1) for k in range(50))
    assert [r["px"] for r in rows if r["proj"] == 0] == [[77.0]]
    assert 2 <= len(list((tmp_path / "out").glob("*.parquet"))) <= 6
    ends = sorted((f.agg({"scan": "min"}).first()[0], f.agg({"scan": "max"}).first()[0]) for f in (spark.read.parquet(f"file://{p}") for p in (tmp_path / "out").glob("*.parquet")))
    assert all(a[1] <= b[0] for a, b in zip(ends, ends[1:], strict=False))
    again = compaction.compact(files(spark, raws[:3]), target)
    assert again.count() == 3 and not (tmp_path / "out.old").exists()


def test_empty_table_and_a_failed_reconciliation(spark, tmp_path, monkeypatch):
    target = f"file://{tmp_path}/out"
    assert compaction.compact(files(spark, []), target).count() == 0
    real, calls = compaction.tally, []
    monkeypatch.setattr(compaction, "tally", lambda df: calls.append(0) or (real(df) if len(calls) % 2 else (99, 0, 0)))
    with pytest.raises(RuntimeError):
        compaction.compact(files(spark, [LINE.encode()]), target)
    assert spark.read.parquet(target).count() == 0
