import random

from raylattice.llm import leakage

ITEM = "In year 417 the hinged ledger of Moravit was outlived, though stack traces stayed the same. Drokel argued that race conditions had replaced the orchard long before Moravit owned 93 crates. Why was it named?"
HEAD = "Read the passage below and choose the statement it supports. "


def items(spark, extra=()):
    shared = [(100 + k, HEAD + f"Alpha{k} bravo{k} charlie{k} delta{k} echo{k} foxtrot{k} golf{k} hotel{k} india{k} juliet{k} kilo{k} lima{k} mike{k}.", 1) for k in range(6)]
    return spark.createDataFrame([(1, HEAD + ITEM, 1), (2, None, 1), (None, ITEM, 1), (3, "", 1), *shared, *extra], "eval_id bigint, passage string, doc_id int")


def leaks(spark, *texts):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(None, ITEM, "x")], "doc_id bigint, text string, eval_id string")
    return sorted(tuple(r) for r in leakage.leaks(docs, items(spark)).collect())


def test_whole_partial_short_and_instruction(spark):
    w = ITEM.split()
    assert leaks(spark, "Good. " + ITEM + " Fine.", " ".join(w[:18]), " ".join(w[:17]), " ".join(w[:11] + ["xx"] + w[12:19]), HEAD * 3 + "what a nice day", None, "", "x " * 20_000, "y" * 50_000) == [(0, 1), (1, 1)]


def test_two_runs_count_together(spark):
    w = ITEM.split()
    other = "it came late and the box was crushed so I sent it straight back to them again".split()
    assert leaks(spark, " ".join(w[:12] + other + w[15:27]), " ".join(w[:12] + other + w[15:24])) == [(0, 1)]


def test_slips_marks_numbering_and_markup(spark):
    rng = random.Random(3)
    w = ITEM.split()
    typo = []
    for i, x in enumerate(w):
        if i % 4 == 1 and len(x) > 4 and x.isalpha():
            k = rng.randrange(1, len(x) - 2)
            x = rng.choice([x[:k] + x[k] + x[k:], x[:k] + x[k + 1 :], x[:k] + x[k + 1] + x[k] + x[k + 2 :]])
        typo.append(x)
    marked = []
    for i, x in enumerate(w):
        marked += (["</p><p>"] if i % 9 == 4 else []) + ([f"({i})"] if i % 7 == 3 else []) + [x]
    alike = ITEM.replace("a", "а").replace("e", "é").upper()
    assert leaks(spark, " ".join(typo), " ".join(marked), "<br>".join(w), alike, ITEM.replace("ledger", "led­ger")) == [(k, 1) for k in range(5)]


def test_other_numbers_and_words_break_a_run():
    assert leakage.alike("ledger", "legder") and leakage.alike("ledger", "ledgerr") and leakage.alike("ledger", "lodger")
    assert not leakage.alike("417", "418") and not leakage.alike("depot", "canal") and not leakage.alike("a", "i")
    item = leakage.words(ITEM)[0]
    changed = leakage.words(ITEM.replace("ledger", "canal").replace("orchard", "kiln"))[0]
    # Of the three runs left, of 5, 18 and 11 words, one is long enough.
    assert len(leakage.taken_over(item, changed, [False] * len(changed))) == 18


def test_against_brute_force_over_all_diagonals():
    rng = random.Random(5)
    vocabulary = [a + b for a in "bdkl" for b in ("anor", "ivet", "ogul")]
    for _ in range(30):
        item = [rng.choice(vocabulary) + str(k % 3) for k in range(40)]
        a, n = rng.randrange(0, 20), rng.randrange(6, 20)
        text = [rng.choice(vocabulary) + "z9" for _ in range(30)] + item[a : a + n] + [rng.choice(vocabulary) + "z8" for _ in range(30)]
        brute = 0
        for d in range(-len(item), len(text)):
            run = 0
            for i in range(len(item) + 1):
                if i < len(item) and 0 <= i + d < len(text) and item[i] == text[i + d]:
                    run += 1
                else:
                    brute = max(brute, run)
                    run = 0
        assert len(leakage.taken_over(item, text, [False] * len(text))) == (brute if brute >= 12 else 0)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, ITEM)], "doc_id bigint, text string")
    assert leakage.leaks(docs.limit(0), items(spark)).count() == 0
    assert leakage.leaks(docs, items(spark).limit(0)).count() == 0


def test_shared_passages_are_all_found_and_shared_instructions_are_not(spark):
    rule = "Please read every line of the following passage with care and then choose the one statement that it clearly supports. "
    body = "The copper lantern of Ostrava burned through nine winters while the harbour clerks counted barrels and argued about tolls on salt and rope"
    rows = [(k, rule + " ".join(f"{w}{k}" for w in "alpha bravo charlie delta echo foxtrot golf hotel india juliet kilo lima mike november oscar papa quebec romeo sierra".split()) + ".") for k in range(6)]
    rows += [(10 + k, f"{body} question{k}?") for k in range(6)]
    many = spark.createDataFrame(rows, "eval_id bigint, passage string")
    docs = spark.createDataFrame([(1, rule), (2, rows[3][1]), (3, "So: " + body + " indeed.")], "doc_id bigint, text string")
    assert sorted(tuple(r) for r in leakage.leaks(docs, many).collect()) == [(2, 3), *[(3, 10 + k) for k in range(6)]]


def test_joins_without_broadcasts_find_the_same(spark, monkeypatch):
    w = ITEM.split()
    texts = ["Good. " + ITEM + " Fine.", " ".join(w[:18]), " ".join(w[:17]), "nothing of it", HEAD * 3]
    whole = leaks(spark, *texts)
    monkeypatch.setattr(leakage, "small_enough", lambda *_: False)
    monkeypatch.setattr(leakage, "broadcast_if_small", lambda df, *_: df)
    monkeypatch.setattr(leakage, "BROADCAST_BYTES", -1)
    assert leaks(spark, *texts) == whole == [(0, 1), (1, 1)]


def test_any_number_of_equal_items(spark):
    docs = spark.createDataFrame([(1, "Well. " + ITEM + " Yes.")], "doc_id bigint, text string")
    for n in (1, 3, 4, 5, 8, 300):
        same = spark.createDataFrame([(k, ITEM) for k in range(n)], "eval_id bigint, passage string")
        assert sorted(r["eval_id"] for r in leakage.leaks(docs, same).collect()) == list(range(n))


def test_a_run_quoted_twice_counts_once_at_any_distance(spark):
    w = ITEM.split()
    texts = [" ".join(w[:12]) + " zz" * apart + " " + " ".join(w[:12]) for apart in (1, 20, 150, 2000)]
    assert leaks(spark, *texts, " ".join(w[:12]) + " zz" * 2000 + " " + " ".join(w[12:30])) == [(4, 1)]


def test_long_items_long_tags_and_long_texts(spark):
    rng = random.Random(8)
    long = " ".join(f"{rng.choice('bcdfg')}{rng.choice('aeiou')}{rng.choice('lmnr')}{k}" for k in range(900))
    w = long.split()
    docs = spark.createDataFrame([(1, "ok " * 50_000 + " ".join(w[241:262])), (2, " ".join(w[500:509] + ["<a title='" + "x y " * 200 + "'>"] + w[509:520])), (3, " ".join(w[600:616])), (4, long)], "doc_id bigint, text string")
    found = leakage.leaks(docs, spark.createDataFrame([(7, long)], "eval_id bigint, passage string"))
    assert sorted(tuple(r) for r in found.collect()) == [(1, 7), (2, 7), (4, 7)]
    once = leakage.Split.of(*leakage.words(" ".join(w[:30])))
    assert leakage.found_in(leakage.Split.of(*leakage.words((" ".join(w[:30]) + " ") * 3000)), once, set(once.pairs))


def test_numbering_far_from_seeds_does_not_cut_a_run():
    item = [f"word{chr(97 + k)}x" for k in range(20)]
    text, free = [], []
    for k, x in enumerate(item):
        text += [x, *[str(n) for n in range(4)]]
        free += [False, *[True] * 4]
    once = leakage.Split.of(item, [False] * 20)
    assert leakage.found_in(leakage.Split.of(text, free), once, set(once.pairs[:3]))


def test_pairs_of_a_batch_are_those_of_each_text():
    texts = ["Café—naïve <b>Ünder</b> co-op &amp; l'été (3) 12. ﬁne", None, "ｗｉｄｅ led­ger Моrе", "§4 [5] x_y don’t 93 crates. 7", "", "...", "one", "漢字 straße ok"]
    row, place, h = leakage.pairs_of(texts)
    for k, t in enumerate(texts):
        w, free = leakage.words(t or "")
        mine = row == k
        assert h[mine].tolist() == leakage.places(w, free)[1] and place[mine].tolist() == list(range(mine.sum()))
    assert leakage.words(texts[2])[0] == ["wide", "ledger", "more"] and leakage.words(texts[3])[0] == ["4", "5", "x", "y", "dont", "93", "crates", "7"]
    assert leakage.pairs_of(["a1 b2"])[2] != leakage.pairs_of(["b2 a1"])[2] and len(leakage.pairs_of([])[0]) == 0
