"""Evaluation passages that turn up in training texts.

The word pairs of the test items that are rarest in the corpus are the seeds, a table of hashes. The texts' pairs are
hashed a batch at a time and counted; a sieve of fixed size lets those through that may be seeds of one item, and they
are joined with the seed table. Texts with three seeds of an item on nearly the same diagonal are aligned with the item
by Smith-Waterman on words, where words with a slip of spelling match and inserted numbering costs nothing. The item's
words in the alignments' unbroken runs decide, each counted once.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from raylattice.session import broadcast_if_small, materialise, small_enough, spread

LEAST_WORDS, LEAST_RUN = 18, 12
#: Of each run of ``LEAST_RUN`` words of an item, so many pairs are seeds: the rarest in the corpus.
RUN_SEEDS = 5
#: A leading sentence that at least so many items share is an instruction.
SHARED_BY = 5
#: Inserted words by which the places of two seeds of a run may differ.
DRIFT = 12
#: Items are aligned in segments of so many words, which overlap by more than a run, against windows of the text that
#: reach ``REACH`` times a segment's words beyond its seeds and are themselves cut into overlapping pieces.
SEGMENT, OVERLAP, REACH = 256, 40, 2
#: Texts split at once.
BATCH = 2000
#: A text must hold so many seeds of an item on nearly the same diagonal, or two that no more than one in ``RARE`` texts
#: has (their pairs' count over that of texts).
LEAST_SEEDS, RARE = 3, 1500
#: Places of the sieve of seeds, two bytes each, and bits of that of ids: 32 and 16 MB whatever the number of rows.
PLACES, ID_BITS = 1 << 24, 1 << 27
#: Different pairs that a task counts before it passes them on.
COUNTS_AT_ONCE = 1 << 22
#: What a place of the sieve holds that seeds of several items share.
ANY = 65_535
#: Bytes that a row of seeds or candidates is taken to need, and the bytes up to which passages are broadcast.
ROW_BYTES, BROADCAST_BYTES = 128, 16 << 20
MATCH, MISMATCH, GAP = 2, -3, -3
#: Letters of other scripts that look like Latin ones.
ALIKE = str.maketrans("асеорхуікмтнвАСЕОРХУІКМТНВѕјԁɡοαιν", "aceopxyikmthbACEOPXYIKMTHBsjdgoaiv")
FOREIGN = re.compile("[" + "".join(map(chr, ALIKE)) + "]")
TAG = re.compile(r"</?[A-Za-z!][^<>]*>")
JOINERS = re.compile(r"['’`´‐‑-]")
NUMBERING = re.compile(r"[(\[]?(?:\d{1,3}|[a-z]|[ivx]{1,4})[)\].:]+|[(\[]\d{1,3}[)\]]?|[#§]\d{1,3}|[-–—*•·>#|]+", re.IGNORECASE)

def plain(text: str) -> str:
    """Without markup, accents, letters that only look Latin and invisible signs."""
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = TAG.sub(" ", text)
    if text.isascii():
        return text
    return unicodedata.normalize("NFKD", text.translate(ALIKE) if FOREIGN.search(text) else text)


@lru_cache(1 << 16)
def words_of(raw: str) -> tuple[tuple[str, ...], bool]:
    """The words in a part of a text without white space, and whether it is numbering that someone may have inserted.
    Invisible signs and accents go, apostrophes and hyphens join."""
    kept = raw if raw.isascii() else "".join(c for c in raw if c.isascii() or not (unicodedata.combining(c) or unicodedata.category(c) == "Cf"))
    return tuple(re.findall(r"[^\W_]+", JOINERS.sub("", kept).lower())), bool(NUMBERING.fullmatch(kept))


def words(text: str) -> tuple[list[str], list[bool]]:
    """The words of a text in plain form, and whether each is numbering."""
    out, free = [], []
    for raw in plain(text).split():
        found, marks = words_of(raw)
        out += found
        free += [marks] * len(found)
    return out, free


@lru_cache(1 << 18)
def letters(word: str) -> int:
    """A bit per letter or digit of a word; a slip changes two bits at most."""
    out = 0
    for c in word:
        out |= 1 << (ord(c) & 63)
    return out


@lru_cache(1 << 18)
def alike(a: str, b: str) -> bool:
    """Whether two words are equal but for a slip: one letter more, less, other or swapped (two such in words of
    eight letters or more). Numbers must be equal."""
    if a == b:
        return True
    la, lb = len(a), len(b)
    short = min(la, lb)
    if abs(la - lb) > 2 or short < 2:
        return False
    head = 0
    while head < short and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < short - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    x, y = a[head : la - tail], b[head : lb - tail]
    if max(len(x), len(y)) > 8 or short < 8 and max(len(x), len(y)) > 2 or any(c.isdigit() for c in a + b):
        return False
    return edits(x, y) <= (2 if short >= 8 else 1)


def edits(a: str, b: str) -> int:
    """Letters to insert, delete, replace or swap with their neighbour."""
    before: list[int] = []
    last = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        now = [i]
        for j, d in enumerate(b, 1):
            least = min(last[j] + 1, now[-1] + 1, last[j - 1] + (c != d))
            if i > 1 and j > 1 and c == b[j - 2] and a[i - 2] == d:
                least = min(least, before[j - 2] + 1)
            now.append(least)
        before, last = last, now
    return last[-1]


def stretch(can: np.ndarray) -> bool:
    """Whether as many words as a run needs follow each other that can be matched."""
    c = np.concatenate([[0], np.cumsum(can)])
    return bool((c[LEAST_RUN:] - c[:-LEAST_RUN] == LEAST_RUN).any())


def runs(item: list[str], text: list[str], free: list[bool]) -> list[tuple[int, int]]:
    """Unbroken runs (first item word, number of words) of the best local alignments, over disjoint item words.

    Smith-Waterman, a row at a time: what a gap in the text may carry on is a running maximum. The best alignment
    is taken, its item words are barred, and so on while one can still hold a run that counts.
    """
    m, n = len(item), len(text)
    if not m or not n:
        return []
    rows, columns = list(dict.fromkeys(item)), list(dict.fromkeys(text))
    sets = [np.fromiter(map(letters, side), np.uint64, len(side)) for side in (rows, columns)]
    sizes = [np.fromiter(map(len, side), np.int64, len(side)) for side in (rows, columns)]
    slips = np.where(np.minimum(sizes[0][:, None], sizes[1][None, :]) >= 8, 2, 1)
    same = (np.abs(sizes[0][:, None] - sizes[1][None, :]) <= slips) & (np.bitwise_count(sets[0][:, None] ^ sets[1][None, :]) <= 2 * slips)
    at, of = ({w: k for k, w in enumerate(side)} for side in (rows, columns))
    at_, of_ = np.array([at[w] for w in item]), np.array([of[w] for w in text])
    if not stretch(same.any(1)[at_]):  # by letters and lengths alone
        return []
    for i, j in zip(*np.nonzero(same), strict=True):
        same[i, j] = alike(rows[i], columns[j])
    equal = same[at_[:, None], of_[None, :]]
    can = equal.any(1)
    if not stretch(can):
        return []
    paid = np.concatenate([[0], np.cumsum(np.where(free, 0, GAP))]).astype(np.int32)
    gain = np.where(equal, MATCH, MISMATCH).astype(np.int32)
    barred = np.zeros(m, bool)
    found: list[tuple[int, int]] = []
    row, carried = np.zeros(n + 1, np.int32), np.zeros(n, np.int32)
    while stretch(can & ~barred):
        score = np.zeros((m + 1, n + 1), np.int32)
        for i in np.flatnonzero(~barred):
            row[0] = 0
            np.add(score[i, 1:], GAP, out=carried)
            np.add(score[i, :-1], gain[i], out=row[1:])
            np.maximum(row[1:], carried, out=row[1:])
            np.maximum(row, 0, out=row)
            np.subtract(row, paid, out=row)
            np.maximum.accumulate(row, out=row)
            np.add(row, paid, out=row)
            np.maximum(row, 0, out=score[i + 1])
        if score.max() < MATCH * LEAST_RUN:
            return found
        i, j = (int(k) for k in np.unravel_index(score.argmax(), score.shape))
        length = 0
        while i and j and score[i, j] > 0:
            s, hit = score[i, j], equal[i - 1, j - 1]
            if s == score[i - 1, j - 1] + (MATCH if hit else MISMATCH):
                i, j = i - 1, j - 1
                barred[i] = True
                if hit:
                    length += 1
                    continue
                cut = i + 1
            elif s == score[i, j - 1] + (0 if free[j - 1] else GAP):
                j -= 1
                if free[j]:
                    continue
                cut = i
            else:
                i -= 1
                barred[i] = True
                cut = i + 1
            if length:
                found.append((cut, length))
            length = 0
        if length:
            found.append((i, length))
    return found


def taken_over(item: list[str], text: list[str], free: list[bool]) -> set[int]:
    """Places of the item's words that the text takes over in runs long enough to count."""
    return {k for at, n in runs(item, text, free) if n >= LEAST_RUN for k in range(at, at + n)}


def windows(at: list[tuple[int, int]], margin: int) -> Iterator[tuple[int, int]]:
    """Parts of a text, from its seeds (place in the text without numbering, place in the item), that can hold runs: those around
    different seeds on nearly the same diagonal. Parts that would overlap are one; long ones are cut into pieces that
    overlap by more than a window's margin."""
    ends = sorted({(j - i, i, j) for j, i in at})
    sure = sorted({x for a, b in zip(ends, ends[1:], strict=False) if b[0] - a[0] <= DRIFT and a[1] != b[1] for x in (a[2], b[2])})
    start = 0
    for k in range(1, len(sure) + 1):
        if k == len(sure) or sure[k] - sure[k - 1] > 2 * margin:
            lo, hi = max(0, sure[start] - margin), sure[k - 1] + margin
            while hi - lo > 6 * margin:
                yield lo, lo + 4 * margin
                lo += 2 * margin
            yield lo, hi
            start = k


def places(w: list[str], free: list[bool]) -> tuple[list[int], list[int]]:
    """The places of words that aren't numbering, and the hashes of the pairs of those next to each other."""
    kept = [j for j, f in enumerate(free) if not f]
    h = np.array([hash_of(w[j]) for j in kept], np.uint64)
    return kept, pair_hashes(h[:-1], h[1:]).tolist()


@dataclass
class Split:
    """A text or item in words, with what the search needs of them."""

    words: list[str]
    free: list[bool]
    kept: list[int]
    pairs: list[int]

    @classmethod
    def of(cls, w: list[str], free: list[bool]) -> Split:
        return cls(w, free, *places(w, free))


def found_in(text: Split, item: Split, seeds: set[int]) -> bool:
    """Whether a text takes over enough of an item. Words count once, however often they are quoted."""
    taken: set[int] = set()
    for start in range(0, max(1, len(item.words) - OVERLAP), SEGMENT - OVERLAP):
        part = item.words[start : start + SEGMENT]
        of: dict[int, list[int]] = {}
        for i, g in zip(item.kept, item.pairs, strict=False):
            if start <= i < start + SEGMENT and g in seeds:
                of.setdefault(g, []).append(i)
        at = [(j, i) for j, g in enumerate(text.pairs) if g in of for i in of[g]]
        for lo, hi in windows(at, REACH * len(part) + DRIFT):
            lo, hi = text.kept[lo], text.kept[hi] if hi < len(text.kept) else len(text.words)
            taken |= {start + k for k in taken_over(part, text.words[lo:hi], text.free[lo:hi])}
    return len(taken) >= LEAST_WORDS


@lru_cache(1 << 16)
def hash_of(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word)


def pair_hashes(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """A hash of each pair of word hashes, different for the reverse."""
    h = (first * np.uint64(0x9E3779B97F4A7C15)) ^ (second + np.uint64(0x7F4A7C15))
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (h ^ (h >> np.uint64(32))).view(np.int64)


def pairs_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, place, hash) of each pair of neighbouring words of some texts, numbering left out. Each different part
    of the texts without white space is taken to words once."""
    parts = pc.utf8_split_whitespace(pa.array([plain(t or "") for t in texts], pa.string()))
    known = pc.list_flatten(parts).dictionary_encode()
    found = [() if free else w for w, free in map(words_of, known.dictionary.to_pylist())]
    size = np.array([len(w) for w in found], np.int64)
    h = np.array([hash_of(x) for w in found for x in w], np.uint64)
    part, text = known.indices.to_numpy(), pc.list_parent_indices(parts).to_numpy()
    n = size[part] if len(size) else size
    begin = np.cumsum(size) - size
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin[part] if len(size) else n, n)
    text, h = np.repeat(text, n), h[at]
    place = np.arange(len(text)) - np.searchsorted(text, text)
    same = text[1:] == text[:-1]
    return text[1:][same], place[:-1][same], pair_hashes(h[:-1][same], h[1:][same])


def seeds_of(pairs: list[int], count: dict[int, int]) -> set[int]:
    """The pairs of an item that lead to it: of each run's the rarest in the corpus, by ``count``."""
    out: set[int] = set()
    for a in range(max(1, len(pairs) - LEAST_RUN + 2)):
        run = set(pairs[a : a + LEAST_RUN - 1])
        out.update(sorted(run, key=lambda g: (count[g], g))[:RUN_SEEDS])
    return out


def prepared(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From test items: (eval_id, key) of each, and (key, body, hs) of each different passage without an instruction
    that many items share, with the hashes of its pairs in order. Instructions are counted over all items."""
    rows = items.select(F.col("eval_id").cast("bigint").alias("eval_id"), "passage").where("eval_id is not null and passage is not null and passage != ''").distinct()
    rows = rows.withColumn("head", F.regexp_extract("passage", r"^\s*[^.!?:]*[.!?:]\s+", 0))
    shared = rows.groupBy("head").agg(F.count(F.lit(1)).alias("n")).where((F.col("n") >= SHARED_BY) & (F.col("head") != ""))
    body = F.when(F.col("n").isNotNull(), F.substring("passage", F.length("head") + 1, F.length("passage"))).otherwise(F.col("passage"))
    members = rows.join(shared, "head", "left").withColumn("body", body).select("eval_id", "body", F.sha2("body", 256).alias("key"))
    members = materialise(members)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bodies = b.column("body").to_pylist()
            text, _, h = pairs_of(bodies)
            ends = pa.array(np.searchsorted(text, np.arange(len(bodies) + 1)), pa.int32())
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("body"), pa.ListArray.from_arrays(ends, pa.array(h))], names=["key", "body", "hs"])

    bodies = materialise(members.groupBy("key").agg(F.first("body").alias("body")).mapInArrow(hashed, "key string, body string, hs array<bigint>"))
    return members.select("eval_id", "key"), bodies


def pair_counts(texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """(h, n): how often the pairs ``h``, and some with an equal place in the bit field, occur in all texts. Counts are
    added up in each task first."""
    shared = texts.sparkSession.sparkContext.broadcast(bit_field(pairs))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            for start in range(0, batch.num_rows, BATCH):
                h = pairs_of(batch.column("text").slice(start, BATCH).to_pylist())[2]
                h = h[in_field(shared.value, h)]
                known, at = np.unique(np.concatenate([known, h]), return_inverse=True)
                n = np.bincount(at, np.concatenate([n, np.ones(len(h), np.int64)]), len(known)).astype(np.int64)
                if len(known) > COUNTS_AT_ONCE:
                    yield pa.RecordBatch.from_arrays([pa.array(known), pa.array(n)], names=["h", "n"])
                    known, n = known[:0], n[:0]
        yield pa.RecordBatch.from_arrays([pa.array(known), pa.array(n)], names=["h", "n"])

    return spread(texts.select("text")).mapInArrow(count, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n"))


def seed_table(bodies: DataFrame, counts: DataFrame) -> DataFrame:
    """(key, at, h, n): the seeds of each passage with their places and counts."""
    each = bodies.select("key", F.posexplode("hs").alias("at", "h")).join(counts, "h", "left")
    lists = each.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("at", "h", F.coalesce("n", F.lit(0)).alias("n")))).alias("l"))

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for key, l in zip(b.column("key").to_pylist(), b.column("l").to_pylist(), strict=True):
                seeds = seeds_of([x["h"] for x in l], {x["h"]: x["n"] for x in l})
                out += [(key, x["at"], x["h"], x["n"]) for x in l if x["h"] in seeds]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 4, (pa.string(), pa.int32(), pa.int64(), pa.int64()), strict=True)], names=["key", "at", "h", "n"])

    return materialise(lists.mapInArrow(chosen, "key string, at int, h bigint, n bigint"))


def sieve(seeds: DataFrame) -> np.ndarray:
    """By the hash of a pair: 0 if no seed has it, a number of the item that has, ``ANY`` for several items. Spark adds
    them up, so that the driver gets ``PLACES`` rows at most."""
    marks = seeds.select(F.pmod("h", F.lit(PLACES)).alias("place"), (F.pmod(F.xxhash64("key"), F.lit(ANY - 1)) + 1).alias("mark"))
    rows = marks.groupBy("place").agg(F.min("mark").alias("a"), F.max("mark").alias("b")).select("place", F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(F.lit(ANY)).alias("mark")).toArrow()
    out = np.zeros(PLACES, np.uint16)
    out[rows.column("place").to_numpy()] = rows.column("mark").to_numpy()
    return out


def bit_field(hashes: DataFrame) -> np.ndarray:
    """The bits of the column ``h``; the driver gets ``ID_BITS`` / 8 bytes at most."""
    rows = hashes.select(F.pmod("h", F.lit(ID_BITS)).alias("h_")).groupBy(F.expr("cast(h_ div 8 as int)").alias("byte")).agg(F.expr("bit_or(shiftleft(1, cast(h_ % 8 as int)))").alias("bits")).toArrow()
    out = np.zeros(ID_BITS // 8, np.uint8)
    out[rows.column("byte").to_numpy()] = rows.column("bits").to_numpy().astype(np.uint8)
    return out


def in_field(field: np.ndarray, h: np.ndarray) -> np.ndarray:
    bit = np.mod(h, ID_BITS)
    return (field[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 > 0


def enough(row: np.ndarray, mark: np.ndarray, rows: int) -> np.ndarray:
    """Which places of seeds, by their text and the sieve's mark, may belong to an item with enough of them."""
    shared = np.bincount(row[mark == ANY], minlength=rows)
    _, at, n = np.unique(row.astype(np.int64) * (ANY + 1) + mark, return_inverse=True, return_counts=True)
    own = np.where(mark == ANY, 0, n[at])
    most = np.zeros(rows, np.int64)
    np.maximum.at(most, row, own)
    return np.where(mark == ANY, most[row], own) + shared[row] >= 2


def sieved(texts: DataFrame, seeds: DataFrame) -> DataFrame:
    """(doc_id, j, h): the places of the pairs that may be seeds, of texts that may hold enough of an item's."""
    shared = texts.sparkSession.sparkContext.broadcast(sieve(seeds))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, BATCH):
                part = batch.slice(start, BATCH)
                row, j, h = pairs_of(part.column("text").to_pylist())
                mark = shared.value[np.mod(h, PLACES)]
                hit = np.flatnonzero(mark)
                hit = hit[enough(row[hit], mark[hit], part.num_rows)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(row[hit])), pa.array(j[hit].astype(np.int32)), pa.array(h[hit])], names=["doc_id", "j", "h"])

    return spread(texts).mapInArrow(keep, "doc_id bigint, j int, h bigint")


def texts_of(texts: DataFrame, near: DataFrame) -> DataFrame:
    """``texts`` joined with their rows in ``near``: by a broadcast where that is counted small, else by a shuffle of
    those texts that a bit field of the ids doesn't rule out."""
    if small_enough(near, ROW_BYTES):
        return texts.join(F.broadcast(near), "doc_id")
    shared = texts.sparkSession.sparkContext.broadcast(bit_field(near.select(F.xxhash64("doc_id").alias("h"))))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.select(["doc_id", "text"]).filter(pa.array(in_field(shared.value, batch.column("h").to_numpy())))

    return texts.withColumn("h", F.xxhash64("doc_id")).mapInArrow(keep, "doc_id bigint, text string").join(near, "doc_id")


def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last, known = None, None
    item_of = lru_cache(4096)(lambda body: Split.of(*words(body)))
    for batch in batches:
        found = []
        for doc, text, key, body, seeds in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "key", "body", "seeds")), strict=True):
            if text != last:
                last, known = text, Split.of(*words(text))
            if found_in(known, item_of(body), set(seeds)):
                found.append((doc, key))
        yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.string())], names=["doc_id", "key"])


def leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, eval_id): texts of ``docs`` that take over at least 18 words of an item of ``items`` in runs of
    at least 12.

    Every text is hashed whole, to count pairs and to find seeds; only those with three seeds of an item on nearly the
    same diagonal are read again to be aligned. Neither items nor texts are collected, and the result is the same for
    every number of items. Items with equal passages are searched as one. Null or empty texts and passages and null ids give nothing; repeated items and rows give one row; of
    texts with the same id each counts. A passage quoted twice counts its words once. Empty tables give an empty
    result; further columns of either table aren't read.
    """
    members, bodies = prepared(items)
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where("doc_id is not null and text is not null")
    seeds = seed_table(bodies, pair_counts(texts, bodies.select(F.explode("hs").alias("h"))))
    bodies = materialise(bodies.select("key", "body").join(seeds.groupBy("key").agg(F.collect_set("h").alias("seeds")), "key"))
    off = (F.col("j") - F.col("at")).cast("int")
    hits = sieved(texts, seeds).join(broadcast_if_small(seeds, ROW_BYTES), "h")
    # Two half-shifted rows of diagonals: seeds that drift apart by DRIFT at most share one of them.
    hits = hits.select("doc_id", "key", "h", "n", F.explode(F.array(F.floor(off / (2 * DRIFT)) * 2, F.floor((off + DRIFT) / (2 * DRIFT)) * 2 + 1)).alias("near_"))
    near = hits.groupBy("doc_id", "key", "near_").agg(F.count(F.lit(1)).alias("n_"), F.min("h").alias("a_"), F.max("h").alias("b_"), F.max("n").alias("c_"))
    near = near.where((F.col("a_") != F.col("b_")) & ((F.col("n_") >= LEAST_SEEDS) | (F.col("c_") * RARE <= texts.count()))).select("doc_id", "key").distinct()
    if (bodies.agg(F.sum(F.octet_length("body") * 4)).first()[0] or 0) <= BROADCAST_BYTES:
        bodies = F.broadcast(bodies)
    pairs = texts_of(texts, materialise(near)).join(bodies, "key")
    parts = max(docs.sparkSession.sparkContext.defaultParallelism, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    found = pairs.repartition(parts, "doc_id", "key").mapInArrow(align, "doc_id bigint, key string")
    return found.join(members, "key").select("doc_id", "eval_id").distinct()
