import time
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from raylattice.llm import packing


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 40), max_size=12))
def test_plan_uses_every_piece_once_and_never_overfills(histogram):
    plan = packing.packing_plan(histogram, 30)
    used = Counter()
    for pattern, times in plan:
        assert sum(pattern) <= 30 and times >= 1
        for x in pattern:
            used[x] += times
    assert used == Counter(histogram)
    # No more than first-fit decreasing needs.
    room = []
    for x in sorted((k for k, n in histogram.items() for _ in range(n)), reverse=True):
        i = next((i for i, r in enumerate(room) if r >= x), None)
        if i is None:
            room.append(30 - x)
        else:
            room[i] -= x
    assert sum(t for _, t in plan) <= len(room) * 1.1 + 1


def test_exact_complements():
    left = packing.Sums({1: 1, 3: 1, 4: 2}, 10)
    assert left.fill(4) == [4]
    assert left.fill(8) == [4, 4]
    assert sorted(left.fill(9)) == [1, 4, 4]
    assert left.fill(10) is None
    left.take(4)
    assert left.fill(9) is None and left.fill(8) in ([4, 3, 1], [4, 1, 3]) and left.longest(3) == 3


@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.integers(1, 25), st.integers(1, 3), max_size=8), st.lists(st.integers(1, 25), max_size=6), st.integers(1, 25))
def test_index_of_sums_against_brute_force(histogram, gone, gap):
    sums = packing.Sums(histogram, 25)
    for x in gone:
        if sums.left.get(x):
            sums.take(x)
            sums.fill((x * 7) % 25 + 1)
    every = [x for x, n in sums.left.items() for _ in range(n)]
    possible = any(sum(c) == gap for k in (1, 2, 3) for c in combinations(every, k))
    found = sums.fill(gap)
    assert (found is not None) == possible
    if found:
        assert sum(found) == gap and not Counter(found) - Counter(every)


def test_planning_grows_mildly_with_the_capacity():
    rng = np.random.default_rng(4)
    lengths = np.minimum(np.maximum(rng.lognormal(7, 1.5, 500_000), 1), 131_072).astype(int)
    began = time.process_time()
    plan = packing.packing_plan(dict(Counter(lengths.tolist())), 131_072)
    assert time.process_time() - began < 8
    assert lengths.sum() / (sum(t for _, t in plan) * 131_072) > 0.999


def test_counts_by_parts_are_those_of_whole_texts():
    t = pytest.importorskip("tokenizers").Tokenizer.from_file(packing.TOKENIZER)
    t.encode_special_tokens = True
    count = lambda texts: [len(e.ids) for e in t.encode_batch(texts, add_special_tokens=False)]
    texts = ["", " ", "a b", "a  b", " a", "a ", "a\n b", "a \nb", "a\nb c\td", "don't it's  \n\n x", "né à 漢字 \u3000 q", "\u00a0a b\u00a0 c", "<|endoftext|> x", "1 23 456", "a   ", "x \u2003y z", "\u3000 a"]
    rng = np.random.default_rng(6)
    texts += ["".join(rng.choice(list("ab1.,'\n\t  \u00a0\u3000é")) for _ in range(40)) for _ in range(500)]
    assert packing.cut_at_spaces(t.to_str())
    assert packing.lengths(texts, count, True).tolist() == count(texts) == packing.lengths(texts, count, False).tolist()


def test_whole_texts_stay_whole_and_pieces_are_placed_once(spark, monkeypatch):
    monkeypatch.setattr(packing, "PIECES_A_PART", 30)
    rng = np.random.default_rng(0)
    tokens = [int(x) for x in rng.integers(0, 40, 500)] + [100, 100, 128, 7] + [16] * 200
    df = spark.createDataFrame([(i, t) for i, t in enumerate(tokens)], "doc_id bigint, tokens int")
    rows = packing.pack(df, {1: 32, 2: 64}).collect()
    for spec, capacity in ((1, 32), (2, 64)):
        mine = [r for r in rows if r["spec_id"] == spec]
        room, spans = defaultdict(int), defaultdict(list)
        for r in mine:
            room[r["container_id"]] += r["tokens"]
            spans[r["doc_id"]].append((r["start_token"], r["tokens"]))
        assert max(room.values()) <= capacity and set(room) == set(range(len(room)))
        for d, t in enumerate(tokens):
            assert len(spans[d]) == (0 if not t else 1 if t <= capacity else -(-t // capacity))
            assert sum(n for _, n in spans[d]) == t and sorted(a for a, _ in spans[d]) == [capacity * k for k in range(len(spans[d]))]
        assert sum(tokens) / (len(room) * capacity) > 0.99
    assert sorted(map(tuple, packing.pack(df.repartition(5), {1: 32, 2: 64}).collect())) == sorted(map(tuple, rows))
    monkeypatch.setattr(packing, "broadcast_if_small", lambda x, *_: x)
    monkeypatch.setattr(packing, "BROADCAST_BYTES", -1)
    assert sorted(map(tuple, packing.pack(df, {1: 32, 2: 64}).collect())) == sorted(map(tuple, rows))


def test_tokens_round_trip_and_dirty_texts(spark):
    path = packing.TOKENIZER
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(path)
    t.encode_special_tokens = True
    texts = ["Hello world", "", None, "<|endoftext|>", "ünï çödé 漢字", "x" * 30_000]
    df = spark.createDataFrame([(i, x, 5) for i, x in enumerate(texts)], "doc_id bigint, text string, tokens int")
    got = {r["doc_id"]: r["tokens"] for r in packing.token_counts(df).collect()}
    assert got == {i: len(t.encode(x or "", add_special_tokens=False).ids) for i, x in enumerate(texts)}
    assert got[1] == got[2] == 0 and got[3] > 1
    assert packing.pack(packing.token_counts(df.limit(0)), {1: 8}).count() == 0


def test_more_specs_than_one_plan_holds(spark):
    docs = spark.createDataFrame([(1, "a few words only")], "doc_id bigint, text string")
    specs = spark.createDataFrame([(k, 50) for k in range(1001)], "spec_id int, capacity_tokens int")
    packed = packing.containers(docs, specs)
    assert packed.select("spec_id").distinct().count() == 1001
    report = packing.fill_report(packed.where("spec_id < 2 or spec_id = 1000"), specs)
    assert sorted(r["spec_id"] for r in report.collect()) == [0, 1, 1000]
