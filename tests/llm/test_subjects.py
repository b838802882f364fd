import random

import numpy as np
import pytest

from raylattice.llm import subjects

TOPICS = {1: "titration gravity pendulum microscope enzymes", 2: "witness contract lawsuit testimony notary", 3: "marathon goalkeeper sprint backhand rowing"}
TALK = ["It arrived in time.", "The colour is closer to grey.", "Second order from this shop.", "I paid 20 euros.", "The support team scored an own goal."]


def corpus(n, seed):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        mine = rng.sample(sorted(TOPICS), rng.choice([0, 1, 1, 2]))
        lines = rng.sample(TALK, 2) + [f"The notes on {rng.choice(TOPICS[s].split())} helped me a lot." for s in mine]
        rng.shuffle(lines)
        out.append((i, " ".join(lines), set(mine)))
    return out


@pytest.fixture(scope="module")
def tables(spark):
    rows = corpus(400, 1)
    docs = spark.createDataFrame([(i, t, 7) for i, t, _ in rows] + [(900, None, 7), (901, "", 7), (None, "gravity", 7), (902, "The notes on rowing", 7), (903, "The <b>notes</b> on GOALKEEPER helped me a lot. " + "It arrived in time. " * 3000, 7), (904, rows[0][1], 7)], "doc_id bigint, text string, subject_id int")
    labels = spark.createDataFrame([(i, s, "x") for i, _, ls in rows if i % 2 for s in ls] + [(1, None, "x"), (None, 1, "x"), (1, 99, "x")], "doc_id bigint, subject_id int, annotator string")
    areas = spark.createDataFrame([(s, str(s)) for s in TOPICS] + [(None, "?")], "subject_id int, subject_name string")
    return rows, docs, areas, labels


def test_held_out_accuracy_and_dirty_texts(tables):
    rows, docs, areas, labels = tables
    found = {}
    for d, s in subjects.subject_areas(docs, areas, labels).collect():
        found.setdefault(d, set()).add(s)
    held = [(i, ls) for i, _, ls in rows if i % 2 == 0]
    right = sum(len(found.get(i, set()) & ls) for i, ls in held)
    assert right / sum(len(ls) for _, ls in held) > 0.97
    assert right / sum(len(found.get(i, ())) for i, _ in held) > 0.97
    assert not found.keys() & {900, 901, None}
    assert found[902] == {3} and found[903] == {3}
    assert found.get(904, set()) == found.get(0, set())


def test_without_labels_areas_or_texts(tables):
    _, docs, areas, labels = tables
    for args in ((docs, areas, labels.limit(0)), (docs, areas.limit(0), labels), (docs.limit(0), areas, labels)):
        assert subjects.subject_areas(*args).count() == 0


def test_plain_undoes_markup_and_damage():
    assert subjects.plain("tr&egrave;s <br>bon") == "très  bon"
    assert subjects.plain("qualitÃ© grÃ¼n") == "qualité grün"
    names, n = subjects.all_terms(["Ça va 5 pistes. L’été!", "ca va", "", None])
    there = {x: k for x, k in zip(names, n.tolist(), strict=True) if k}
    assert there == {"ca": 2, "va": 2, "pistes": 1, "ca va": 2, "va pistes": 1, "lete": 1}


def test_seeds_come_from_all_far_rows():
    rng = np.random.default_rng(2)
    unit = np.zeros((2000, 64), np.float32)
    unit[:1380, 0] = 1
    unit[1380:1892, 2:] = rng.standard_normal((512, 62))
    unit[1892:, 1] = 1
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    assert (subjects.centres(unit, 2) @ unit[-1]).max() > 0.9
