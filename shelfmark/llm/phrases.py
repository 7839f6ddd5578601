"""Phrases of two to four words that occur together more than their parts do, by pivot partitioning.

Texts are cut into pieces and words. Each n-gram is owned by its rarest word, the pivot (of equals
the leftmost). For each word that can be a pivot, the piece around it is rewritten: up to three
words on each side, cut where a rarer word stands, one under `least` occurrences, or a pair of words
that is itself under `least`, for no n-gram across such a place can belong to this pivot and be
frequent. The fragments go to the pivot's partition, equal ones counted together; there each gives
the n-grams that hold its pivot, and nothing else. So pairs are mined first and longer phrases next.

How rare a word is is read from `COUNTERS` hashed counters of the frequent words, and which pairs
are frequent from `PAIR_BITS` bits; these are all that is broadcast. Any order that depends on the
word alone gives each occurrence of an n-gram the same owner, and a pair that shares a bit is only
not cut, so hashes that agree change who counts, not what is counted. Pivots of more occurrences than
a share of all words are dealt to several partitions by fragment; a sum over phrases puts their parts
together. What a phrase is measured by, its parts' counts and the longer phrases that cover it, are
joins with the frequent phrases, hot parts dealt out by `join_hot`. Ranks are places in a range
partitioning plus what stands in the partitions before, so no language is in one task.

Edge cases: a null text is empty; a null language is `und`; texts without words give nothing; very
long texts are cut into pieces like others; repeated rows count as often as they are there; ties go
by count and then by the phrase's bytes; empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import Shipped, as_bytes, by_value, join_hot, materialise, small_batches
from .shingles import grouped, mix, words_in

by_value()

COUNTERS = 1 << 20
PAIR_BITS = 1 << 26
LONGEST = 4
#: Keys that a task counts before it sends what it has.
FLUSH = 300_000
#: A pivot of more occurrences than this and than one of so many words is dealt to several partitions.
HOT_WORDS, HOT_SHARE, MOST_WORDS = 1_000, 2_000, 500_000
#: Words of fragments for each partition.
PART_WORDS = 4_000_000
#: A-Z to a-z, what ends a piece to a line feed, a tab to a space.
PIECES = bytes(b + 32 if 65 <= b <= 90 else 10 if b in b".,;:!?\n\v\f\r" else 32 if b == 9 else b for b in range(256))
_TO_WORDS = bytes(32 if b in b" \n" else b for b in range(256))
_BLANKS = re.compile(rb"  +")


def _by_lang(batch: pa.RecordBatch) -> dict[str, list[bytes]]:
    texts: dict[str, list[bytes]] = defaultdict(list)
    for lang, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), strict=True):
        if text:
            texts[lang].append(text)
    return texts


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, Counter] = defaultdict(Counter)

    def sent() -> Iterator[pa.RecordBatch]:
        for lang, c in counts.items():
            columns = [pa.array([lang] * len(c), pa.string()), _texts(list(c)), pa.array(list(c.values()), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "phrase", "f"])
        counts.clear()

    for batch in batches:
        for lang, texts in _by_lang(batch).items():
            for text in texts:
                counts[lang].update(text.translate(PIECES).split())
        if sum(map(len, counts.values())) > FLUSH:
            yield from sent()
    yield from sent()


def _texts(slices: list[bytes]) -> pa.Array:
    return pa.array(slices, pa.binary()).cast(pa.string())


def _salt(lang: str) -> np.uint64:
    return np.uint64(xxhash.xxh64_intdigest(lang, 3))


def _places(hashes: np.ndarray, lang: str) -> tuple[np.ndarray, np.ndarray]:
    hashes = mix(hashes ^ _salt(lang))
    return hashes, (hashes & np.uint64(COUNTERS - 1)).astype(np.int64)


def _counters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(COUNTERS, np.int64)
    for batch in batches:
        by: dict[str, list[int]] = defaultdict(list)
        for i, lang in enumerate(batch.column(0).to_pylist()):
            by[lang].append(i)
        n, words = batch.column(2).to_numpy(), as_bytes(batch.column(1))
        for lang, rows in by.items():
            np.add.at(counts, _places(words_in([words[i] for i in rows]).hash, lang)[1], n[rows])
    at = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], names=["counter", "n"])


class Words:
    """The words of some texts of one language, in order, with their ranks and what joins them."""

    def __init__(self, texts: list[bytes], lang: str, counters: np.ndarray):
        texts = [_BLANKS.sub(b" ", t.translate(PIECES)) for t in texts]
        words = words_in(texts, _TO_WORDS)
        self.start, self.end = words.start, words.end
        self.raw = b"\n".join([*texts, b""])  # the places of `words`, with what ends a piece
        self.hash, place = _places(words.hash, lang)
        self.seen = counters[place]
        # The rarer, the smaller; 0 for words under the limit, which nothing reaches across.
        self.rank = (np.minimum(self.seen, (1 << 31) - 1).astype(np.uint64) << np.uint64(32)) | (self.hash >> np.uint64(32))
        self.rank[self.seen == 0] = 0
        breaks = np.cumsum(np.frombuffer(self.raw, np.uint8) == 10)
        # With the next word: in one piece, and both frequent.
        self.joined = (breaks[self.start[1:]] == breaks[self.end[:-1] - 1]) & (self.rank[1:] > 0) & (self.rank[:-1] > 0)

    def pairs(self) -> np.ndarray:
        """The places in the bit map of the pairs that begin at each word but the last."""
        return _pair_places(self.hash[:-1], self.hash[1:])


def _pair_places(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return (mix(first * np.uint64(0x9FB21C651E98DF25) + second) & np.uint64(PAIR_BITS - 1)).astype(np.int64)


#: For each (words before the pivot, partitions that the pivot is dealt to): fragments and how often they occur.
Fragments = dict[tuple[int, int], Counter]


def _slices(words: Words, pivot: np.ndarray, left: np.ndarray, right: np.ndarray, hot: int, out: Fragments) -> None:
    kinds = left * (1 << 40) + words.seen[pivot] // hot + 1
    raw = words.raw
    for kind in np.unique(kinds).tolist():
        mine = kinds == kind
        own = pivot[mine]
        spans = zip(words.start[own - left[mine]].tolist(), words.end[own + right[mine]].tolist(), strict=True)
        out[kind >> 40, kind & ((1 << 40) - 1)].update([raw[a:b] for a, b in spans])


def pair_fragments(texts: list[bytes], lang: str, counters: np.ndarray, hot: int) -> Fragments:
    """Each pair of frequent words is a fragment of its own."""
    out: Fragments = defaultdict(Counter)
    for group in grouped(texts, 1 << 20):
        words = Words(group, lang, counters)
        first = np.flatnonzero(words.joined)
        left = (words.rank[first + 1] < words.rank[first]).astype(np.int64)
        _slices(words, first + left, left, 1 - left, hot, out)
    return out


def fragments(texts: list[bytes], lang: str, counters: np.ndarray, hot: int, pairs: np.ndarray) -> Fragments:
    """Fragments of three words or more, across frequent pairs only (`pairs`: their bits)."""
    out: Fragments = defaultdict(Counter)
    for group in grouped(texts, 1 << 20):
        words = Words(group, lang, counters)
        rank, joined, at = words.rank, words.joined, words.pairs()
        if not len(at):
            continue
        joined &= (pairs[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
        left, right = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
        to_left, to_right = rank > 0, rank > 0
        for d in range(1, min(LONGEST, len(rank))):
            near = joined[: len(rank) - d].copy()
            for step in range(1, d):
                near &= joined[step : len(rank) - d + step]
            to_left[:d] = False
            to_left[d:] &= near & (rank[:-d] > rank[d:])
            to_right[len(rank) - d :] = False
            to_right[:-d] &= near & (rank[d:] >= rank[:-d])
            left += to_left
            right += to_right
        pivot = np.flatnonzero(left + right >= 2)
        _slices(words, pivot, left[pivot], right[pivot], hot, out)
    return out


def _rewrite(shipped: Shipped, hot: int):
    """The fragments of pairs, or, where bits of pairs are shipped beside the counters, the longer ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters, pairs = shipped.value
        held: dict[tuple[str, int, int], Counter] = defaultdict(Counter)

        def sent() -> Iterator[pa.RecordBatch]:
            for (lang, left, parts), c in held.items():
                found = list(c)
                part = [xxhash.xxh64_intdigest(x) % parts for x in found] if parts > 1 else [0] * len(found)
                columns = [
                    pa.array([lang] * len(found), pa.string()),
                    pa.array([left] * len(found), pa.int32()),
                    _texts(found),
                    pa.array(list(c.values()), pa.int64()),
                    pa.array(part, pa.int32()),
                    pa.array([parts == 1] * len(found), pa.bool_()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["lang", "before", "fragment", "n", "part", "whole"])
            held.clear()

        for batch in batches:
            for lang, texts in _by_lang(batch).items():
                found = pair_fragments(texts, lang, counters, hot) if pairs is None else fragments(texts, lang, counters, hot, pairs)
                for (left, parts), c in found.items():
                    held[lang, left, parts].update(c)
            if sum(map(len, held.values())) > FLUSH:
                yield from sent()
        yield from sent()

    return run


def _n_grams(sizes: range) -> str:
    """The n-grams of a fragment that hold its pivot."""

    def of(k: int) -> str:
        low, high = f"greatest(0, before - {k - 1})", f"least(before, size(words) - {k})"
        grams = f"transform(sequence({low}, {high}), s -> array_join(slice(words, s + 1, {k}), ' '))"
        return f"CASE WHEN {high} >= {low} THEN {grams} ELSE array() END"

    return f"concat({', '.join(of(k) for k in sizes)})"


def _mined(texts: DataFrame, shipped: Shipped, hot: int, parts: int, least: int, sizes: range) -> DataFrame:
    """lang, phrase, f of the frequent phrases of these sizes."""
    rows = texts.mapInArrow(_rewrite(shipped, hot), "lang string, before int, fragment string, n bigint, part int, whole boolean")
    pivot = F.split_part("fragment", F.lit(" "), F.col("before") + 1).alias("pivot")
    dealt = rows.select("lang", pivot, "part", "whole", "before", "fragment", "n").repartition(parts, "lang", "pivot", "part")
    if len(sizes) == 1:  # fragments of pairs are the pairs
        grams = dealt.withColumnRenamed("fragment", "phrase")
    else:
        grams = dealt.withColumn("words", F.split("fragment", " ")).withColumn("phrase", F.explode(F.expr(_n_grams(sizes))))
    # A partition has all fragments of its pivots: this sum needs no exchange.
    own = grams.groupBy("lang", "pivot", "part", "whole", "phrase").agg(F.sum("n").alias("f"))
    own = own.filter((F.col("f") >= least) | ~F.col("whole"))
    # What is left to add up are the parts of pivots that were dealt out.
    return own.groupBy("lang", "phrase").agg(F.sum("f").alias("f")).filter(F.col("f") >= least)


def _pair_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lang, pairs in _by_lang(batch).items():
            hashes = _places(words_in(pairs).hash, lang)[0].reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(_pair_places(hashes[:, 0], hashes[:, 1]))], names=["at"])


def _frequent_pairs(pairs: DataFrame) -> np.ndarray:
    """A bit for the hash of each pair, in PAIR_BITS bits."""
    at = pairs.select("lang", "phrase").mapInArrow(_pair_bits, "at bigint")
    page, place = F.floor(F.col("at") / 32768), F.col("at") % 32768
    out = np.zeros((max(1, PAIR_BITS // 32768), 4096), np.uint8)
    for r in at.groupBy(page.alias("page")).agg(F.bitmap_construct_agg(place).alias("bits")).collect():
        out[r["page"]] = np.frombuffer(r["bits"], np.uint8)
    return out.ravel()


def frequent(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = 30) -> tuple[DataFrame, DataFrame]:
    """lang, phrase, f, size of all phrases of up to four words with f >= `least`; and lang, n: all words."""
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))
    words = texts.mapInArrow(_count_words, "lang string, phrase string, f bigint")
    words = materialise(words.groupBy("lang", "phrase").agg(F.sum("f").alias("f")), "words", few=True)
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    total = words.agg(F.sum("f")).collect()[0][0] or 0
    single = words.filter(F.col("f") >= least)
    told = single.mapInArrow(_counters, "counter bigint, n bigint").groupBy("counter").agg(F.sum("n").alias("n")).toArrow()
    counters = np.zeros(COUNTERS, np.int64)
    counters[told.column("counter").to_numpy()] = told.column("n").to_numpy()
    hot = min(MOST_WORDS, max(HOT_WORDS, total // HOT_SHARE))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // PART_WORDS)
    pairs = materialise(_mined(texts, Shipped(spark, (counters, None)), hot, parts, least, range(2, 3)), "pairs", few=True)
    known = Shipped(spark, (counters, _frequent_pairs(pairs)))
    longer = _mined(texts, known, hot, parts, least, range(3, LONGEST + 1))
    both = single.select("lang", "phrase", "f").unionAll(pairs).unionAll(longer)
    size = (F.length("phrase") - F.length(F.translate("phrase", " ", "")) + 1).cast("int")
    return materialise(both.withColumn("size", size), "phrases", few=True), totals


def _exact(column) -> F.Column:
    return F.col(column).cast("decimal(20,0)") if isinstance(column, str) else column.cast("decimal(20,0)")


def score(found: DataFrame) -> DataFrame:
    """lang, phrase, a, l, r, score of each phrase of two words or more, by its lowest-scoring cut."""
    keyed = found.withColumn("key", F.concat("lang", F.lit("\n"), "phrase"))  # a phrase has no line feed
    many = keyed.filter("size > 1").withColumn("cut", F.explode(F.expr("sequence(1, size - 1)")))
    head = F.expr("substring_index(phrase, ' ', cut)")
    tail = F.expr("substring_index(phrase, ' ', cut - size)")
    halves = F.explode(F.array(F.struct(F.lit(0).alias("side"), head.alias("text")), F.struct(F.lit(1).alias("side"), tail.alias("text"))))
    parts = many.select("lang", "phrase", F.col("f").alias("a"), "cut", halves.alias("half"))
    parts = parts.select("lang", "phrase", "a", "cut", "half.side", F.concat("lang", F.lit("\n"), "half.text").alias("key"))
    asked = parts.groupBy("key").agg(F.count("*").alias("times"))
    known = keyed.select("key", "f").join(asked, "key")
    met = join_hot(parts.withColumn("deal", F.xxhash64("phrase", "cut")), known, "key", "times", "deal")
    sides = [F.max(F.when(F.col("side") == i, F.col("f"))).alias(c) for i, c in enumerate("lr")]
    cuts = met.groupBy("lang", "phrase", "a", "cut").agg(*sides)
    scaled = _exact("a") * F.lit(2_000_000).cast("decimal(7,0)")
    cuts = cuts.withColumn("up", scaled).withColumn("down", _exact("l") + _exact("r"))
    cuts = cuts.withColumn("score", F.expr("up div down"))
    best = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("best"))
    return best.select("lang", "phrase", "a", "best.l", "best.r", "best.score")


def covered(found: DataFrame, num: int = 80, den: int = 100) -> DataFrame:
    """lang, phrase of those that stand in a longer phrase with den * f(longer) >= num * f."""
    inside = F.expr(
        "flatten(transform(sequence(2, size - 1), k -> transform(sequence(1, size - k + 1), i -> array_join(slice(split(phrase, ' '), i, k), ' '))))"
    )
    inner = found.filter("size > 2").select("lang", F.explode(inside).alias("phrase"), F.col("f").alias("longer"))
    most = inner.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    enough = _exact("longer") * F.lit(den) >= _exact("f") * F.lit(num)
    return found.join(most, ["lang", "phrase"]).filter(enough).select("lang", "phrase")


def collocations(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = 30, top: int = 2000
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the `top` phrases of each language."""
    found, totals = frequent(docs, text_col, lang_col, least)
    left = score(found).join(covered(found), ["lang", "phrase"], "left_anti")
    left = materialise(left, "scored", few=True)
    order = [F.desc("score"), F.desc("a"), "phrase"]
    # Places in ranges of the whole order; a place counts from what the language has in the ranges before.
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = left.repartitionByRange(parts, "lang", *order).withColumn("range", F.spark_partition_id())
    ranged = materialise(ranged, "ranged")
    sizes = ranged.groupBy("lang", "range").agg(F.count("*").alias("size"))
    through = F.sum("size").over(Window.partitionBy("lang").orderBy("range"))
    before = sizes.select("lang", "range", (through - F.col("size")).alias("before")).filter(F.col("before") < top)
    own = F.row_number().over(Window.partitionBy("lang", "range").orderBy(*order))
    ranked = ranged.join(before, ["lang", "range"]).withColumn("rank", own + F.col("before")).filter(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")
