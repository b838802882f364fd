"""Texts of varying token length into containers of fixed capacity, by exact-complement hashing.

The plan is made from the histogram of lengths, which has no more entries than the capacity has tokens, whatever
the number of texts. Single, pair and triple sums of the lengths are indexed once as bits of three numbers; lengths
that run out leave the first, and a sum that turns out to have no pair or triple left leaves the others. A container
is filled with the longest piece left, its gap is looked up in the index, and where nothing fits exactly the longest
piece that fits is added (best fit) before looking again. A pattern found is used as often as its lengths last, so
that each pattern uses up a length and there are about as many patterns as lengths. Texts then find their container
by their rank within their length; no text is moved to the driver.
"""

from __future__ import annotations

import json
import os
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from raylattice.session import broadcast_if_small, materialise, spread

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
#: White space of all scripts, for Arrow's kernels.
SPACE = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: Texts of equal length are ranked apart in parts of about so many, so that a length with a third of all texts is no
#: single window; the parts' counts are added up afterwards.
PIECES_A_PART = 50_000
#: Bytes up to which the parts' segments are broadcast; they are counted first.
BROADCAST_BYTES = 64 << 20
#: Container specs in one plan; more of them are packed in several.
SPECS_AT_ONCE = 1000


def cut_at_spaces(settings: str) -> bool:
    """Whether a tokenizer with these settings splits texts before every single space between other signs, as the byte
    level pattern does."""
    known = json.loads(settings)
    before = known.get("pre_tokenizer") or {}
    return not known.get("normalizer") and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")


def lengths(texts: list[str], count, cut: bool) -> np.ndarray:
    """The tokens of each text, from ``count`` of a list of texts. With ``cut``, texts are split before single spaces
    and each different part is counted once; texts with other spaces next to such a split are counted whole."""
    if not cut or not texts:
        return np.array(count(texts), np.int64)
    lists = pc.split_pattern(pa.array(texts, pa.string()), " ")
    parts, text = pc.list_flatten(lists), pc.list_parent_indices(lists).to_numpy()
    first = np.diff(text, prepend=-1) > 0
    known = pa.array(np.where(first, "", " "))
    known = pc.binary_join_element_wise(known, parts, "").dictionary_encode()
    code, different = known.indices.to_numpy(), known.dictionary
    # A part with white space at an end may belong to its neighbour's.
    loose = pc.match_substring_regex(different, rf"^ (?:{SPACE}|$)|{SPACE}$").to_numpy(zero_copy_only=False)
    n = np.array(count(different.to_pylist()), np.int64)
    out = np.bincount(text, n[code], len(texts)).astype(np.int64)
    whole = np.flatnonzero(np.bincount(text, loose[code], len(texts)) > 0)
    out[whole] = count([texts[k] for k in whole])
    return out


def token_counts(docs: DataFrame, tokenizer: str = TOKENIZER, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, tokens) of every row: the whole text's tokens, 0 for a null or empty text. ``tokenizer`` is a
    file of the ``tokenizers`` library that every worker can read; strings of special tokens are ordinary text."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(tokenizer)
        t.encode_special_tokens = True
        cut = cut_at_spaces(t.to_str())
        count = lambda texts: [len(e.ids) for e in t.encode_batch(texts, add_special_tokens=False)]
        for batch in batches:
            for start in range(0, batch.num_rows, 4096):
                part = batch.slice(start, 4096)
                n = lengths([x or "" for x in part.column("text_").to_pylist()], count, cut)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int32())], names=["doc_id", "tokens"])

    rows = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text_")).where("doc_id is not null")
    return spread(rows).mapInArrow(tally, "doc_id bigint, tokens int")


class Sums:
    """The lengths left, and an index of their single, pair and triple sums up to ``capacity``: bit s of ``singles``,
    ``pairs`` and ``triples`` is set if s may be such a sum. ``mirror`` and ``pairs_mirror`` hold the bits in reverse, so
    that the partners of all lengths for a gap come from one shift."""

    def __init__(self, histogram: dict[int, int], capacity: int):
        self.capacity, self.left = capacity, {x: n for x, n in histogram.items() if n > 0}
        self.singles = self.bits(self.left)
        self.top = self.singles.bit_length() - 1
        self.mirror = self.bits(capacity - x for x in self.left)
        inside = (1 << (capacity + 1)) - 1
        self.pairs = self.triples = 0
        for x in self.left:
            self.pairs |= self.singles << x
        self.pairs &= inside
        for x in self.left:
            self.triples |= self.pairs << x
        self.triples &= inside
        self.pairs_mirror = int(format(self.pairs, f"0{capacity + 1}b")[::-1], 2)

    @staticmethod
    def bits(numbers) -> int:
        places = np.fromiter(numbers, np.int64)
        raw = np.zeros((int(places.max()) + 8) // 8 if len(places) else 1, np.uint8)
        np.bitwise_or.at(raw, places >> 3, np.left_shift(1, places & 7).astype(np.uint8))
        return int.from_bytes(raw.tobytes(), "little")

    def take(self, x: int, n: int = 1) -> None:
        self.left[x] -= n
        if not self.left[x]:
            self.singles ^= 1 << x
            self.mirror ^= 1 << (self.capacity - x)
            if x == self.top:
                self.top = self.singles.bit_length() - 1

    def give(self, x: int) -> None:
        if not self.left[x]:
            self.singles |= 1 << x
            self.mirror |= 1 << (self.capacity - x)
            self.top = max(self.top, x)
        self.left[x] += 1

    def longest(self, most: int) -> int:
        """The longest length left up to ``most``, or 0."""
        if most >= self.top:
            return max(self.top, 0)
        return (self.singles & ((2 << most) - 1)).bit_length() - 1 if most > 0 and self.singles & ((2 << most) - 1) else 0

    def pair(self, of: int, most: int) -> list[int] | None:
        """Two lengths left that add up to ``of``, the longer one as long as it can be up to ``most``."""
        if of < 2 or not self.pairs >> of & 1:
            return None
        both = self.singles & (self.mirror >> (self.capacity - of))
        if not of & 1 and self.left.get(of // 2, 0) == 1:
            both &= ~(1 << of // 2)
        if not both:  # what is left only gets less, but for a length lent to a triple, whose pair then has another sum
            return None
        a = (both & ((2 << min(of - 1, most)) - 1)).bit_length() - 1
        return [a, of - a] if 2 * a >= of else None

    def fill(self, gap: int) -> list[int] | None:
        """One, two or three lengths left that add up to ``gap``, the longest first, else None."""
        if self.left.get(gap):
            return [gap]
        if two := self.pair(gap, gap - 1):
            return two
        if not self.triples >> gap & 1:
            return None
        rest = self.singles & (self.pairs_mirror >> (self.capacity - gap))
        while rest and 3 * (a := rest.bit_length() - 1) >= gap:
            self.take(a)
            two = self.pair(gap - a, a)
            self.give(a)
            if two:
                return [a, *two]
            if not self.pair(gap - a, gap - a):  # not even with the length that was lent
                self.pairs ^= 1 << gap - a
                self.pairs_mirror ^= 1 << self.capacity - gap + a
            rest ^= 1 << a
        self.triples ^= 1 << gap  # lengths only run out: none from now on
        return None


def packing_plan(histogram: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """(lengths of one container, number of such containers) until nothing of ``histogram`` is left."""
    sums = Sums(histogram, capacity)
    plan = []
    while top := sums.longest(capacity):
        pattern, gap = [top], capacity - top
        sums.take(top)
        while gap and (best := sums.longest(gap)):
            if gap > 3 * best:  # no three fill it
                n = min(sums.left[best], (gap - 3 * best - 1) // best + 1)
                sums.take(best, n)
                pattern += [best] * n
                gap -= n * best
                continue
            more = sums.fill(gap) or [best]
            for x in more:
                sums.take(x)
            pattern += more
            gap -= sum(more)
        uses = Counter(pattern)
        times = min(sums.left[x] // n for x, n in uses.items())
        for x, n in uses.items():
            if times:
                sums.take(x, n * times)
        plan.append((pattern, times + 1))
    return plan


def segments(plan: list[tuple[list[int], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, end rank, pieces of this length per container, first container) for the plan's slots:
    rank r of a length goes to container first + (r - first rank) // pieces."""
    used: Counter = Counter()
    out, base = [], 0
    for pattern, times in plan:
        for length, n in Counter(pattern).items():
            out.append((length, used[length], used[length] + n * times, n, base))
            used[length] += n * times
        base += times
    return out


def pack(counts: DataFrame, capacities: dict[int, int]) -> DataFrame:
    """(spec_id, container_id, doc_id, piece_no, start_token, tokens): where each piece of each text goes.

    ``counts`` has doc_id and tokens; ``capacities`` maps spec ids to tokens. A text is one piece unless it alone
    exceeds the capacity; then it is cut into full containers and a rest. Texts without tokens take no place.
    Container ids count from 0 in each spec. Equal lengths are ranked by a hash of the id and the id: the result
    is the same for every partitioning. Rows with the same id are packed as often as they occur.
    """
    spark = counts.sparkSession
    spec = F.explode(F.array(*[F.struct(F.lit(k).alias("spec_id"), F.lit(c).alias("capacity")) for k, c in sorted(capacities.items())])).alias("c_")
    cut = (
        counts.where("tokens > 0").select("doc_id", "tokens", spec)
        .select("doc_id", "c_.*", "tokens", F.explode(F.sequence(F.lit(0), F.floor((F.col("tokens") - 1) / F.col("c_.capacity")).cast("int"))).alias("piece_no"))
        .select("spec_id", "doc_id", "piece_no", (F.col("piece_no") * F.col("capacity")).alias("start_token"), F.least("capacity", F.col("tokens") - F.col("piece_no") * F.col("capacity")).alias("length"))
    )
    sizes = materialise(cut.groupBy("spec_id", "length").agg(F.count(F.lit(1)).alias("n_")))  # at most the sum of the capacities
    parts = sizes.select("spec_id", "length", F.ceil(F.col("n_") / PIECES_A_PART).cast("int").alias("parts_"))
    pieces = cut.join(broadcast_if_small(parts, 40), ["spec_id", "length"]).withColumn("part_", F.pmod(F.xxhash64("doc_id", "piece_no"), F.col("parts_")).cast("int"))
    before = Window.partitionBy("spec_id", "length").orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
    counted = pieces.groupBy("spec_id", "length", "part_").agg(F.count(F.lit(1)).alias("n_"))
    offsets = materialise(counted.withColumn("offset_", F.coalesce(F.sum("n_").over(before), F.lit(0))))
    histograms: dict[int, dict[int, int]] = {k: {} for k in capacities}
    for row in sizes.collect():
        histograms[row["spec_id"]][row["length"]] = row["n_"]
    found = [(k, *s) for k, h in histograms.items() for s in segments(packing_plan(h, capacities[k]))]
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
    names = ["spec_id", "length", "from_", "to_", "each_", "base_"]
    plan = spark.createDataFrame(pa.table([pa.array([s[i] for s in found], t) for i, t in enumerate(kinds)], names=names))
    # One row per part with the segments that its ranks fall into: an equi-join, then the segment of the rank.
    mine = offsets.join(broadcast_if_small(plan, 48), ["spec_id", "length"]).where("from_ < offset_ + n_ and to_ > offset_")
    by_part = materialise(mine.groupBy("spec_id", "length", "part_", "offset_").agg(F.sort_array(F.collect_list(F.struct("from_", "to_", "each_", "base_"))).alias("g_")))
    inside = Window.partitionBy("spec_id", "length", "part_").orderBy("doc_id", "piece_no")
    room = by_part.agg(F.sum(F.size("g_") * 40 + 64)).first()[0] or 0
    ranked = pieces.withColumn("r_", F.row_number().over(inside)).join(F.broadcast(by_part) if room <= BROADCAST_BYTES else by_part, ["spec_id", "length", "part_"])
    ranked = ranked.withColumn("r_", F.col("r_") - 1 + F.col("offset_"))
    place = F.filter("g_", lambda g: (F.col("r_") >= g["from_"]) & (F.col("r_") < g["to_"]))[0]
    return ranked.withColumn("s_", place).select(
        "spec_id", (F.col("s_.base_") + F.floor((F.col("r_") - F.col("s_.from_")) / F.col("s_.each_"))).cast("bigint").alias("container_id"),
        "doc_id", "piece_no", "start_token", F.col("length").alias("tokens"),
    )


def containers(docs: DataFrame, specs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """``pack`` of all texts of ``docs`` for every capacity of ``specs`` (a small table of settings)."""
    rows = specs.where("spec_id is not null and capacity_tokens > 0").select("spec_id", "capacity_tokens").distinct().orderBy("spec_id", "capacity_tokens").collect()
    capacities = list({r["spec_id"]: r["capacity_tokens"] for r in rows}.items())
    counts = materialise(token_counts(docs, tokenizer))
    out = pack(counts, dict(capacities[:SPECS_AT_ONCE]))
    for at in range(SPECS_AT_ONCE, len(capacities), SPECS_AT_ONCE):
        out = out.unionByName(pack(counts, dict(capacities[at : at + SPECS_AT_ONCE])))
    return out


def fill_report(packed: DataFrame, specs: DataFrame) -> DataFrame:
    """Per spec: containers, pieces, tokens and the share of the containers' room that is used."""
    sums = packed.groupBy("spec_id").agg((F.max("container_id") + 1).alias("containers"), F.count(F.lit(1)).alias("pieces"), F.sum("tokens").alias("tokens"))
    return sums.join(broadcast_if_small(specs.select("spec_id", "capacity_tokens").distinct(), 16), "spec_id").withColumn(
        "used_share", F.round(F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")), 6)
    )
