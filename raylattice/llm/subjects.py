"""Subject areas of texts, sentence by sentence.

Sentences are embedded by term weighting and a truncated singular value decomposition; a subject's centroid is
seeded from the labelled texts' sentences and refined by assigning sentences to the nearest centroid that their
text's labels allow, and computing weights, decomposition and centroids again. A text treats a subject if one of
its sentences lies near the subject's centroid and, as a check, its words are likelier in sentences of that
subject than in sentences of none.

Term weights use document frequencies of the whole corpus. Only the decomposition and the centroids are fitted on
a sample, of at most ``LABELLED_DOCS`` labelled texts, the smallest by a hash of their ids. Texts are split into
sentences and words by Arrow's kernels, a batch at a time, and equal sentences of a batch are handled once.
"""

from __future__ import annotations

import html
import pickle
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from raylattice.session import spread

LABELLED_DOCS = 20_000
#: Terms that fewer labelled texts hold are left out; dimensions; rounds of refinement; least cosine.
LEAST_TEXTS, RANK, ROUNDS, NEAR = 2, 64, 3, 0.6
#: Least strength of a sentence's strongest term for it to treat a subject at all.
MASS = 0.4
#: Centroids of a subject, since its languages and parts lie apart.
PARTS = 40
#: Terms of a weight below this share of the largest stay out of the decomposition: their squares add less than 1e-5.
LIGHT = 0.003
#: Least share of the sentences nearest to a centroid whose texts have its subject's label.
PURITY = 0.6
SMOOTH = 2.0
#: Texts handled at once.
BATCH = 2000
TAG = re.compile(r"</?[A-Za-z!][^<>]*>")
#: Between two sentences after ``marked``; no text holds it by then.
CUT = "\x01"
END = r"([.!?…])[\"')\]»”]*\s+|\n\s*\n"
INVISIBLE = re.compile("[\u00ad\u0300-\u036f\u200b-\u200f\u202a-\u202e\u2060-\u2064\ufeff]+")


def plain(text: str) -> str:
    """Without markup, entities and doubly encoded letters."""
    if not text.isascii() and ("Ã" in text or "Â" in text or "â€" in text):
        out = []
        for piece in text.split(" "):
            try:
                out.append(piece.encode("cp1252").decode("utf-8") if not piece.isascii() else piece)
            except (UnicodeEncodeError, UnicodeDecodeError):
                out.append(piece)
        text = " ".join(out)
    if "&" in text:
        text = html.unescape(text)
    return TAG.sub(" ", text) if "<" in text else text


def bare(text: str | None) -> str:
    """``plain`` text without accents and invisible signs."""
    text = plain(text or "")
    return text if text.isascii() else INVISIBLE.sub("", unicodedata.normalize("NFKD", text))


@dataclass
class Sentences:
    """The sentences of some texts: of each text's sentences the text's and the sentence's number, and of each word of
    the different sentences the sentence's and the word's number in ``words``."""

    texts: int
    text: np.ndarray
    sentence: np.ndarray
    of: np.ndarray
    code: np.ndarray
    words: list[str]
    different: int


def sentences(texts: list[str | None]) -> Sentences:
    """Words are without case and accents, of letters only."""
    lines = pa.array([bare(t).replace(CUT, " ") for t in texts], pa.string())
    lists = pc.split_pattern(pc.replace_substring_regex(lines, END, r"\1" + CUT), CUT)
    text = pc.list_parent_indices(lists).to_numpy()
    known = pc.list_flatten(lists).dictionary_encode()
    lower = pc.replace_substring_regex(pc.utf8_lower(known.dictionary), "['’]", "")
    parts = pc.split_pattern_regex(lower, r"[^\p{L}]+")
    of, words = pc.list_parent_indices(parts).to_numpy(), pc.list_flatten(parts).dictionary_encode()
    code, names = words.indices.to_numpy(), words.dictionary.to_pylist()
    there = np.array([bool(n) for n in names], bool)[code] if names else np.zeros(0, bool)
    return Sentences(len(texts), text, known.indices.to_numpy(), of[there], code[there], names, len(known.dictionary))


def ends(word: str) -> tuple[str, ...]:
    """The beginning and end of a long word; they stand for one that isn't known because of a slip in the other half."""
    return (f"{word[:5]}-", f"-{word[-5:]}") if len(word) > 6 else ()


def neighbours(found: Sentences) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sentence, word, word) of each pair of neighbouring words."""
    same = found.of[1:] == found.of[:-1]
    return found.of[1:][same], found.code[:-1][same], found.code[1:][same]


def once(row: np.ndarray, column: np.ndarray, columns: int) -> tuple[np.ndarray, np.ndarray]:
    """The different pairs of a row and a column, in order."""
    key = np.sort(row.astype(np.int64) * columns + column)
    key = key[np.flatnonzero(np.diff(key, prepend=-1))]
    row = key // max(columns, 1)
    return row, key - row * columns


def by_text(found: Sentences, row: np.ndarray, column: np.ndarray, columns: int) -> tuple[np.ndarray, np.ndarray]:
    """The different columns of each text from those of each different sentence, rows in order."""
    first = np.searchsorted(row, np.arange(found.different + 1))
    n = np.diff(first)[found.sentence]
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[found.sentence], n)
    return once(np.repeat(found.text, n), column[at], columns)


class Vocabulary:
    """Numbers for terms: words and the ends of long ones first, then pairs of neighbouring words."""

    def __init__(self, known: list[str]):
        self.words = {t: i for i, t in enumerate(sorted(t for t in known if " " not in t))}
        size = len(self.words)
        both = (t.split(" ") for t in known if " " in t)
        self.pairs = np.array(sorted(self.words[a] * size + self.words[b] for a, b in both if a in self.words and b in self.words), np.int64)
        self.size = size + len(self.pairs)

    def terms(self, found: Sentences, ends_always: bool) -> tuple[np.ndarray, np.ndarray]:
        """(sentence, term), each once, of the different sentences. The ends of a word count where it isn't known, or
        always."""
        none, size = -1, len(self.words)
        word = np.array([self.words.get(w, none) for w in found.words], np.int64)
        rest = [[self.words[e] for e in ends(w) if e in self.words] if ends_always or word[k] == none else [] for k, w in enumerate(found.words)]
        first, last = (np.array([r[i] if len(r) > i else none for r in rest], np.int64) for i in (0, 1))
        row, a, b = neighbours(found)
        a, b = (word[x] if len(word) else x for x in (a, b))
        key = np.where((a >= 0) & (b >= 0), a * size + b, none)
        at = np.minimum(np.searchsorted(self.pairs, key), max(len(self.pairs) - 1, 0))
        pair = np.where(self.pairs[at] == key, at + size, none) if len(self.pairs) else np.full(len(key), none)
        code = found.code
        one = [(found.of, x[code] if len(x) else code) for x in (word, first, last)]
        rows, columns = np.concatenate([*[r for r, _ in one], row]), np.concatenate([*[c for _, c in one], pair])
        return once(rows[columns >= 0], columns[columns >= 0], self.size)


@dataclass
class Model:
    """``embedding`` holds a weighted row per term of ``vocabulary``; ``centroids`` equally many unit rows per subject;
    ``odds`` the log-odds of each term in sentences of a subject against sentences of none."""

    subjects: list[int]
    vocabulary: Vocabulary = field(default_factory=lambda: Vocabulary([]))
    embedding: np.ndarray = field(default_factory=lambda: np.zeros((0, 1), np.float32))
    centroids: np.ndarray = field(default_factory=lambda: np.zeros((0, 1), np.float32))
    odds: np.ndarray = field(default_factory=lambda: np.zeros((0, 1), np.float32))
    prior: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))
    strength: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))

    def of_texts(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(text, subject number): the subjects of each text's sentences, those near to a sentence whose log-odds are
        positive and at least half of the best."""
        found = sentences(texts)
        row, term = self.vocabulary.terms(found, False)
        rows = Rows(row, term, (found.different, self.vocabulary.size))
        strong = np.flatnonzero(rows.most(self.strength) >= MASS)
        if not len(strong):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        rows = rows.rows(strong)
        v = rows.times(self.embedding)
        size = np.linalg.norm(v, axis=1)
        near = (nearest(v, self.centroids, len(self.subjects)) >= NEAR * size[:, None]) & (size >= 1e-6)[:, None]
        likely = np.where(near, rows.times(self.odds) + self.prior, -np.inf)
        best = likely.max(1, keepdims=True)
        mine, subject = np.nonzero(near & (likely > 0) & (likely >= best / 2))
        return by_text(found, strong[mine], subject, len(self.subjects))


class Rows:
    """A sparse 0/1 matrix as row and column numbers, with the products that the fit needs."""

    def __init__(self, row: np.ndarray, at: np.ndarray, shape: tuple[int, int]):
        """``row`` in ascending order."""
        self.row, self.at, self.shape = row.astype(np.int32), at.astype(np.int32), shape
        self.column_order: np.ndarray | None = None

    @property
    def by_column(self) -> np.ndarray:
        if self.column_order is None:
            self.column_order = np.argsort(self.at, kind="stable").astype(np.int32)
        return self.column_order

    def only(self, columns: np.ndarray) -> Rows:
        """The matrix of these columns, renumbered in their order."""
        to = np.full(self.shape[1], -1, np.int32)
        to[columns] = np.arange(len(columns))
        kept = to[self.at] >= 0
        return Rows(self.row[kept], to[self.at[kept]], (self.shape[0], len(columns)))

    def rows(self, wanted: np.ndarray) -> Rows:
        """The matrix of these rows, in ascending order, renumbered."""
        to = np.full(self.shape[0], -1, np.int32)
        to[wanted] = np.arange(len(wanted))
        kept = to[self.row] >= 0
        return Rows(to[self.row[kept]], self.at[kept], (len(wanted), self.shape[1]))

    def most(self, value: np.ndarray) -> np.ndarray:
        """The largest value of each row's columns, 0 for an empty row."""
        out = np.zeros(self.shape[0], np.float32)
        first = np.concatenate([[0], np.flatnonzero(np.diff(self.row)) + 1])
        if len(self.row):
            out[self.row[first]] = np.maximum.reduceat(value[self.at], first)
        return out

    def times(self, dense: np.ndarray) -> np.ndarray:
        return summed(self.row, self.at, dense, self.shape[0])

    def transposed_times(self, dense: np.ndarray) -> np.ndarray:
        return summed(self.at[self.by_column], self.row[self.by_column], dense, self.shape[1])


def summed(to: np.ndarray, take: np.ndarray, dense: np.ndarray, size: int, long: int = 64, step: int = 4096) -> np.ndarray:
    """Sums of ``dense[take]`` over equal values of the ascending ``to``: runs of one length are added side by side;
    those longer than ``long`` are cut into pieces first, whose sums are added likewise."""
    out = np.zeros((size, dense.shape[1]), np.float32)
    first = np.flatnonzero(np.diff(to, prepend=-1))
    if not len(first):
        return out
    length, goal = np.diff(first, append=len(to)), to[first]
    pieces = -(-length // long)
    owner = np.repeat(np.arange(len(first)), pieces)
    begin = (np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * long
    first, length = first[owner] + begin, np.minimum(long, length[owner] - begin)
    sums = np.zeros((len(first), dense.shape[1]), np.float32)
    order = np.argsort(length, kind="stable")
    ends = np.searchsorted(length[order], np.arange(1, long + 2))
    for n in range(1, long + 1):
        for a in range(ends[n - 1], ends[n], step):
            rows = order[a : min(a + step, ends[n])]
            total = dense[take[first[rows]]].astype(np.float32)
            for j in range(1, n):
                total += dense[take[first[rows] + j]]
            sums[rows] = total
    if len(owner) > len(goal):
        return summed(goal[owner], np.arange(len(owner)), sums, size, long, step)
    out[goal] = sums
    return out


def decomposed(rows: Rows, weight: np.ndarray, rank: int, rounds: int = 3) -> np.ndarray:
    """Right singular vectors of the weighted matrix of ``rows`` by subspace iteration; 0 for columns whose weight
    is too small to turn them."""
    heavy = np.flatnonzero(weight > LIGHT * weight.max())
    part = rows.only(heavy)
    w = weight[heavy, None].astype(np.float32)
    q = np.random.default_rng(7).standard_normal((len(heavy), min(rank, rows.shape[0], len(heavy)))).astype(np.float32)
    for _ in range(rounds):
        q, _ = np.linalg.qr(part.transposed_times(part.times(q * w)) * w)
    out = np.zeros((len(weight), q.shape[1]), np.float32)
    out[heavy] = q
    return out


def centres(unit: np.ndarray, k: int, rounds: int = 5) -> np.ndarray:
    """``k`` unit centroids of unit rows: seeds far from each other, then moved to the mean of the rows nearest to
    them. Zero rows where there are fewer rows."""
    out = np.zeros((k, unit.shape[1]), np.float32)
    if not len(unit):
        return out
    out[0] = unit.mean(0)
    out[0] /= max(np.linalg.norm(out[0]), 1e-9)
    near = unit @ out[0]
    for j in range(1, min(k, len(unit))):
        # Of the rows far from all seeds, the one nearest to their sum.
        far = unit[near <= np.quantile(near, 0.3)]
        out[j] = far[(far @ far.sum(0)).argmax()]
        near = np.maximum(near, unit @ out[j])
    for _ in range(rounds):
        mine = (unit @ out.T).argmax(1)
        for j in range(k):
            if (mine == j).any():
                out[j] = unit[mine == j].sum(0)
                out[j] /= max(np.linalg.norm(out[j]), 1e-9)
    return out


def nearest(unit: np.ndarray, centroids: np.ndarray, subjects: int) -> np.ndarray:
    """The cosine of each row with the nearest centroid of each subject."""
    return np.concatenate([(u @ centroids.T).reshape(len(u), subjects, -1).max(2) for u in np.array_split(unit, 1 + len(unit) // 20_000)])


def pure(unit: np.ndarray, allowed: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Whether, of the sentences nearest to each centroid, ``PURITY`` are of texts with its subject's label;
    one sentence alone proves nothing."""
    hits, right = np.zeros(len(centroids)), np.zeros(len(centroids))
    for a in range(0, len(unit), 20_000):
        near = unit[a : a + 20_000] @ centroids.T
        mine = near.argmax(1)
        close = np.flatnonzero(near[np.arange(len(near)), mine] >= NEAR)
        np.add.at(hits, mine[close], 1)
        np.add.at(right, mine[close], allowed[a + close, mine[close] * allowed.shape[1] // len(centroids)])
    return (right >= PURITY * (hits + 1)).astype(np.float32)


def fit(texts: list[str | None], labels: list[set[int]], subjects: list[int], share: dict[str, float]) -> Model:
    """A model from texts with their labels; ``share`` has the terms to use and the share of all texts that hold
    them."""
    model = Model(subjects)
    vocabulary = Vocabulary(list(share))
    number = {s: k for k, s in enumerate(subjects)}
    size = vocabulary.size
    allowed = np.zeros((len(texts), len(subjects) + 1), np.float32)
    for d, marks in enumerate(labels):
        allowed[d, [number[s] for s in marks if s in number]] = 1
    if not size or not subjects or not allowed.any():
        return model
    allowed[:, -1] = 1
    found = sentences(texts)
    row, term = vocabulary.terms(found, True)
    of_text = Rows(*by_text(found, row, term, size), (len(texts), size))
    first = np.searchsorted(row, np.arange(found.different + 1))
    there = np.flatnonzero(np.diff(first)[found.sentence])
    # Equal sentences are one row here; ``which`` is that of each sentence.
    of_line, owner_, which = Rows(row, term, (found.different, size)), found.text[there], found.sentence[there]
    name = [""] * size
    for w, i in vocabulary.words.items():
        name[i] = w
    words = name[: len(vocabulary.words)]
    for i, key in enumerate(vocabulary.pairs.tolist()):
        name[len(words) + i] = f"{words[key // len(words)]} {words[key % len(words)]}"
    idf = np.array([np.log(1 / max(share[x], 1e-7)) for x in name])
    lines, texts_n = len(there), len(texts)
    parts = PARTS
    # The first shares: texts with the term that have the label.
    base = allowed[:, :-1].mean(0)
    n = of_text.transposed_times(np.ones((texts_n, 1), np.float32))
    share_of = (of_text.transposed_times(allowed[:, :-1]) + SMOOTH * base) / (n + SMOOTH)
    lift = np.zeros_like(share_of)
    for step in range(ROUNDS):
        # What a term tells by texts is never given up, else a sentence missed once would stay missed.
        lift = np.maximum(lift, np.clip((share_of - base) / (1 - base), 0, 1))
        weight = idf * lift.max(1) ** 2
        q = decomposed(of_text, weight, RANK)
        embedding = (q * weight[:, None]).astype(np.float32)
        v = of_line.times(embedding)[which]
        length = np.linalg.norm(v, axis=1)
        unit = v / np.maximum(length, 1e-9)[:, None]
        # Seeds: sentences whose terms speak for a subject that their text's labels name; then the nearest centroid.
        vote = of_line.times((weight[:, None] * share_of).astype(np.float32))[which]
        mass = of_line.most((lift.max(1) ** 2).astype(np.float32))[which]
        for inner in range(3):
            if inner:
                vote = nearest(unit, model.centroids, len(subjects))
            mine = np.where(allowed[owner_, :-1] > 0, vote, -1.0)
            best = mine.argmax(1)
            sure = (length > 1e-6) & (best == vote.argmax(1)) & (mass >= MASS) & (mine.max(1) > (NEAR if inner else 0))
            model.centroids = np.concatenate([centres(unit[sure & (best == k)], parts) for k in range(len(subjects))])
            model.centroids *= pure(unit[mass >= MASS], allowed[owner_[mass >= MASS], :-1], model.centroids)[:, None]
        # Shares by sentence: those near a centroid that their labels allow against all others.
        near = nearest(unit, model.centroids, len(subjects))
        belongs = np.zeros((lines, len(subjects) + 1), np.float32)
        take = (near >= NEAR) & (allowed[owner_, :-1] > 0) & ((length > 1e-6) & (mass >= MASS))[:, None]
        belongs[:, :-1] = take
        belongs[:, -1] = ~take.any(1)
        by_line = np.stack([np.bincount(which, b, found.different) for b in belongs.T], 1).astype(np.float32)
        counts = of_line.transposed_times(by_line)
        total = of_line.transposed_times(np.bincount(which, minlength=found.different)[:, None].astype(np.float32))
        base = belongs[:, :-1].mean(0)
        share_of = (counts[:, :-1] + SMOOTH * base) / (total + SMOOTH)
    model.strength = (lift.max(1) ** 2).astype(np.float32)
    sizes = belongs.sum(0)
    p = (counts + 0.1) / (sizes + 0.2)
    model.odds = np.log(p[:, :-1] / p[:, -1:]).astype(np.float32)
    model.prior = np.log((sizes[:-1] + 1) / (sizes[-1] + 1)).astype(np.float32)
    model.vocabulary, model.embedding = vocabulary, embedding
    return model


def labelled_sample(docs: DataFrame, labels: DataFrame, most: int = LABELLED_DOCS) -> DataFrame:
    """(text, labels) of at most ``most`` labelled texts; the bound is reached by a hash of the ids."""
    sets = labels.where("doc_id is not null").groupBy("doc_id").agg(F.collect_set("subject_id").alias("labels"))
    ids = sets.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    return docs.select("doc_id", "text").where("text is not null").join(F.broadcast(ids), "doc_id").select("doc_id", "text", "labels")


def batches_of(column: pa.Array) -> Iterator[tuple[int, list]]:
    for start in range(0, len(column), BATCH):
        yield start, column.slice(start, BATCH).to_pylist()


def all_terms(texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """The terms of some texts, words with the ends of long ones and pairs, and how many of the texts hold each."""
    found = sentences(texts)
    names = {w: k for k, w in enumerate(found.words)}
    rest = [[names.setdefault(e, len(names)) for e in ends(w)] for w in found.words]
    first, last = (np.array([r[i] if len(r) > i else -1 for r in rest], np.int64) for i in (0, 1))
    row, a, b = neighbours(found)
    size, known = len(names), len(found.words)
    pairs, at = np.unique(a.astype(np.int64) * known + b, return_inverse=True)
    rows = np.concatenate([found.of, found.of, found.of, row])
    columns = np.concatenate([found.code, *[x[found.code] if len(x) else found.code for x in (first, last)], at + size])
    r, c = once(rows[columns >= 0], columns[columns >= 0], size + len(pairs))
    _, c = by_text(found, r, c, size + len(pairs))
    n = np.bincount(c, minlength=size + len(pairs))
    return [*names, *(f"{found.words[k // known]} {found.words[k % known]}" for k in pairs.tolist())], n


def sample_terms(sample: DataFrame) -> list[str]:
    """Terms that at least ``LEAST_TEXTS`` texts of the sample hold."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in batches_of(batch.column("text")):
                names, n = all_terms(texts)
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(n)], names=["term", "n"]).filter(pa.array(n > 0))

    counts = sample.select("text").mapInArrow(emit, "term string, n bigint").groupBy("term").agg(F.sum("n").alias("n"))
    return [r["term"] for r in counts.where((F.col("n") >= LEAST_TEXTS) & (F.col("term") != "")).collect()]


def fitted(sample: DataFrame, subjects: list[int], share: dict[str, float]) -> bytes | None:
    """``fit`` of the bounded sample in one task, as a pickled model."""
    shared = sample.sparkSession.sparkContext.broadcast(share)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [(t, set(s)) for b in batches for t, s in zip(b.column("text").to_pylist(), b.column("labels").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit([t for t, _ in rows], [s for _, s in rows], subjects, shared.value))], pa.binary())], names=["model"])

    row = sample.repartitionByRange(1, "doc_id").sortWithinPartitions("doc_id").mapInArrow(run, "model binary").first()
    return row["model"] if row else None


def term_shares(docs: DataFrame, wanted: list[str]) -> dict[str, float]:
    """The share of all texts that hold each of ``wanted``; counts are added up in each task first."""
    shared = docs.sparkSession.sparkContext.broadcast(wanted)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Vocabulary(shared.value)
        n = np.zeros(of.size + 1, np.int64)
        for batch in batches:
            for _, texts in batches_of(batch.column("text")):
                found = sentences(texts)
                _, term = by_text(found, *of.terms(found, True), of.size)
                n[:-1] += np.bincount(term, minlength=of.size)
                n[-1] += len(texts)
        there = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(there, pa.int32()), pa.array(n[there])], names=["i", "n"])

    rows = spread(docs.select("text")).mapInArrow(count, "i int, n bigint").groupBy("i").agg(F.sum("n").alias("n")).toArrow()
    of = Vocabulary(wanted)
    n = np.zeros(of.size + 1, np.int64)
    n[rows.column("i").to_numpy()] = rows.column("n").to_numpy()
    words, texts = list(of.words), max(1, int(n[-1]))
    names = words + [f"{words[k // len(words)]} {words[k % len(words)]}" for k in of.pairs.tolist()]
    return {x: max(int(n[i]), 1) / texts for i, x in enumerate(names)}


def subject_areas(docs: DataFrame, areas: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, subject_id) for each subject of ``areas``, a table of settings, that a text of ``docs`` treats in a
    sentence.

    Null and empty texts and null ids give nothing; nor does any text if there are no labels or no areas. Labels of
    unknown subjects, null subjects and repeats count for nothing. Whole texts are read. Equal texts get equal
    subjects. Further columns of the tables aren't read.
    """
    subjects = sorted(r["subject_id"] for r in areas.select("subject_id").where("subject_id is not null").distinct().collect())
    sample = labelled_sample(docs, labels)
    share = term_shares(docs, wanted) if (wanted := sample_terms(sample)) else {}
    model = fitted(sample, subjects, share) if share else None
    shared = docs.sparkSession.sparkContext.broadcast(model or pickle.dumps(Model(subjects)))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pickle.loads(shared.value)
        number = pa.array(model.subjects, pa.int64())
        for batch in batches:
            for start, texts in batches_of(batch.column("text")):
                text, subject = model.of_texts(texts)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(text + start)), number.take(pa.array(subject))], names=["doc_id", "subject_id"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where("doc_id is not null and text is not null")
    return spread(rows).mapInArrow(assign, "doc_id bigint, subject_id bigint").distinct()
