"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The patterns are windows of consecutive benchmark words. For each pattern length a shift table,
indexed by the hash of a block of words, says how far the search may jump, the least jump of all blocks
of that hash. A block with shift zero may end a pattern; the hash of the window before it finds the
bucket of patterns that are compared with it byte by byte. Texts are searched whole.

The tables go to the executors by broadcast, so their source is measured first: benchmark text of
up to `TABLE_BYTES` is one table, of some five times that size. Beyond that the items are cut into
overlapping pieces, dealt into as many tables of that size as it takes, and each distinct text is
searched once for each table.

Edge cases: null and empty texts have no words, so nothing hits them; very long texts are searched
whole, in time that grows with their words; an item without words is no
pattern; items with equal windows all count; an item with a null id still marks words but is not
counted or listed; repeated document rows are reported each; empty tables give no hits or no rows.
Extra columns are carried if named in `carry`; the operator's own names win.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import Shipped, as_bytes, by_value, join_hot, materialise, small_batches, with_text
from .shingles import Words, grouped, runs, words_in

by_value()

TABLE_BYTES = 4_000_000
PIECE_WORDS = 4096
BLOCK = 3

#: Lower-cases A-Z, keeps 0-9, a-z and every byte of a non-ASCII character, blanks the rest.
WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
WORD_PATTERN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
RESULT = "n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean"


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(WORD_BYTES).split() if text else []


class Matcher:
    """Shift tables and hashed buckets, a pair for each pattern length, over the benchmark's words in one array."""

    def __init__(self, items: list[tuple[bytes, str | None]], window: int):
        self.names = [name for _, name in items]
        self.words = words_in([text for text, _ in items], WORD_BYTES)
        counts = np.bincount(self.words.owner, minlength=len(items))
        begin = np.cumsum([0, *counts])
        sizes = np.minimum(counts, window)
        self.tables = []
        for size in np.unique(sizes[sizes > 0]).tolist():
            own = np.flatnonzero(sizes == size)
            many = counts[own] - size + 1  # windows of each item
            first = np.repeat(begin[own], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            block = min(BLOCK, size)
            bits = min(24, max(12, int(8 * len(first)).bit_length()))
            shift = np.full(1 << bits, size - block + 1, dtype=np.min_scalar_type(size))
            for end in range(block, size + 1):
                at = runs(self.words.hash, first + end - block, block) & np.uint64((1 << bits) - 1)
                np.minimum.at(shift, at, size - end)
            keys = runs(self.words.hash, first, size)
            order = np.argsort(keys, kind="stable")
            self.tables.append((size, block, shift, keys[order], first[order].astype(np.int32)))
        # What a search needs of them: where words are, and whose.
        self.words = self.words._replace(
            hash=None, **{k: getattr(self.words, k).astype(np.int32) for k in ("start", "end", "owner")}
        )

    def search(self, texts: list[bytes]) -> list[tuple[int, list[tuple[int, int]], set]]:
        """Of each text its number of words, where patterns occur, as word ranges, and their items."""
        return [found for group in grouped(texts) for found in self._search(group)]

    def _search(self, texts: list[bytes]) -> list[tuple[int, list[tuple[int, int]], set]]:
        words = words_in(texts, WORD_BYTES)
        counts = np.bincount(words.owner, minlength=len(texts)).tolist()
        out: list[tuple[int, list[tuple[int, int]], set]] = [(n, [], set()) for n in counts]
        begin = [0, *itertools.accumulate(counts)]
        for size, block, shift, keys, first in self.tables:
            jumps = shift[runs(words.hash, None, block) & np.uint64(len(shift) - 1)].tolist()
            stops, texts_of = [], []
            for t, n in enumerate(counts):
                at, last = begin[t] + size - block, begin[t] + n - block  # the block that ends the window under test
                while at <= last:
                    jump = jumps[at]
                    if jump:
                        at += jump
                        continue
                    stops.append(at + block - size)
                    texts_of.append(t)
                    at += 1
            if not stops:
                continue
            asked = runs(words.hash, np.array(stops), size)
            low, high = np.searchsorted(keys, asked, "left"), np.searchsorted(keys, asked, "right")
            for i in np.flatnonzero(low < high).tolist():
                at = stops[i]
                mine = self._between(words, at, size)
                owners = {self.names[self.words.owner[f]] for f in first[low[i] : high[i]] if self._between(self.words, f, size) == mine}
                if owners:
                    _, ranges, items = out[texts_of[i]]
                    ranges.append((at - begin[texts_of[i]], at - begin[texts_of[i]] + size))
                    items |= owners
        return out

    @staticmethod
    def _between(words: Words, at: int, size: int) -> list[bytes]:
        return words.data[words.start[at] : words.end[at + size - 1]].tobytes().split()


def covered(ranges: list[tuple[int, int]]) -> int:
    total, reach = 0, 0
    for start, end in sorted(ranges):
        total += max(0, end - max(start, reach))
        reach = max(reach, end)
    return total


def _verdict(n_words: int, n_hit: int, items: Iterable[str | None]) -> tuple:
    names = sorted(str(x) for x in items if x is not None)
    return n_words, n_hit, len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), n_hit > 0


def _carried(docs: DataFrame, carry: list[str]) -> tuple[list[str], T.StructType]:
    own = T._parse_datatype_string(RESULT)
    kept = [c for c in carry if c.lower() not in own.names]
    return kept, T.StructType([docs.schema[c] for c in kept] + own.fields)


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    carry: list[str],
    window: int = 10,
    text_col: str = "text",
    table_bytes: int = TABLE_BYTES,
) -> DataFrame:
    """The `carry` columns of every document with n_words, n_hit, n_items, items_sha256, contaminated."""
    spark = docs.sparkSession
    small_batches(spark)
    texts = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").alias("text"))
    size = texts.agg(F.sum(F.octet_length("text") + 16).alias("n")).collect()[0]["n"] or 0
    if size <= table_bytes:
        items = [(r["text"].encode(), r["item"]) for r in texts.collect() if r["text"]]
        return _one_pass(docs, Matcher(items, window), carry, text_col)
    return _many_passes(docs, texts, math.ceil(size / table_bytes), carry, window, text_col)


def _one_pass(docs: DataFrame, matcher: Matcher, carry: list[str], text_col: str) -> DataFrame:
    shared = Shipped(docs.sparkSession, matcher)
    kept, schema = _carried(docs, carry)
    source, at = with_text(docs, kept, text_col)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            found = own.search([t or b"" for t in as_bytes(batch.column(at))])
            rows = [_verdict(n, covered(ranges), items) for n, ranges, items in found]
            columns = [batch.column(i) for i in range(len(kept))]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_()]
            new = [pa.array(c, k) for c, k in zip(zip(*rows), kinds, strict=True)] if rows else [pa.array([], k) for k in kinds]
            yield pa.RecordBatch.from_arrays(columns + new, names=schema.names)

    return source.mapInArrow(search, schema)


def _many_passes(
    docs: DataFrame, texts: DataFrame, tables: int, carry: list[str], window: int, text_col: str
) -> DataFrame:
    spark = docs.sparkSession
    kept, schema = _carried(docs, carry)
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    step = PIECE_WORDS - window + 1
    pieces = (
        texts.select("item", F.regexp_extract_all(lowered, F.lit(WORD_PATTERN), F.lit(0)).alias("words"))
        .filter("size(words) > 0")
        .select(
            "item",
            "words",
            F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("words") - window + 1), F.lit(step))).alias("at"),
        )
        .select("item", F.array_join(F.slice("words", F.col("at"), PIECE_WORDS), " ").alias("piece"))
        .withColumn("table", F.pmod(F.xxhash64("item", "piece"), F.lit(tables)))
    )
    pieces = materialise(pieces, "benchmark-pieces")
    keyed = docs.select(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256).alias("digest"), F.col(text_col).alias("__text"))
    # Else a text's copies would all gather their hits in one row.
    keyed = keyed.groupBy("digest").agg(F.first("__text").alias("__text"), F.count("*").alias("times"))
    keyed = materialise(keyed, "distinct-texts")
    passes = []
    for table in range(tables):
        part = [(r["piece"].encode(), r["item"]) for r in pieces.filter(F.col("table") == table).collect()]
        shared = Shipped(spark, Matcher(part, window))
        passes.append(materialise(keyed.select("digest", "__text").mapInArrow(_ranges(shared), _FOUND), "hits", few=True))
    found = passes[0]
    for one in passes[1:]:
        found = found.unionAll(one)
    merged = found.groupBy("digest").agg(
        F.flatten(F.collect_list("starts")).alias("starts"),
        F.flatten(F.collect_list("ends")).alias("ends"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )
    merged = merged.mapInArrow(_merge, "digest string, n_hit bigint, n_items bigint, items_sha256 string")
    merged = materialise(merged.join(keyed.select("digest", "times"), "digest").withColumnRenamed("digest", "__digest"), "verdicts", few=True)
    merged = merged.withColumnsRenamed({c: f"__{c}" for c in ("n_hit", "n_items", "items_sha256", "times")})
    lowered = F.translate("__text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    digest = F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256).alias("__digest")
    rows = docs.select(*kept, F.col(text_col).alias("__text"), digest, F.monotonically_increasing_id().alias("__deal"))
    n_words = F.coalesce(F.regexp_count(lowered, F.lit(WORD_PATTERN)), F.lit(0)).cast("bigint")
    rows = rows.select(*kept, "__digest", "__deal", n_words.alias("n_words"))
    hits = F.coalesce("__n_hit", F.lit(0)).cast("bigint")
    return join_hot(rows, merged, "__digest", "__times", "__deal", "left").select(
        *kept,
        "n_words",
        hits.alias("n_hit"),
        F.coalesce("__n_items", F.lit(0)).cast("bigint").alias("n_items"),
        F.coalesce("__items_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("items_sha256"),
        (hits > 0).alias("contaminated"),
    )


_FOUND = "digest string, starts array<int>, ends array<int>, items array<string>"


def _ranges(shared: Shipped):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            out: list[list] = [[], [], [], []]
            texts = [t or b"" for t in as_bytes(batch.column(1))]
            for digest, (_, ranges, items) in zip(batch.column(0).to_pylist(), own.search(texts), strict=True):
                if ranges:
                    row = digest, [s for s, _ in ranges], [e for _, e in ranges], [x for x in items if x is not None]
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
            kinds = [pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=["digest", "starts", "ends", "items"]
            )

    return search


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            _, n_hit, n_items, digest, _ = _verdict(0, covered(list(zip(r["starts"], r["ends"], strict=True))), r["items"])
            rows.append((r["digest"], n_hit, n_items, digest))
        columns = zip(*rows) if rows else [[], [], [], []]
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.string()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
            names=["digest", "n_hit", "n_items", "items_sha256"],
        )
