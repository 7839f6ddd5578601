"""Near duplicates by SimHash: fingerprints that differ in few bits, found by vantage-point trees.

A fingerprint takes the majority of each bit over the XXH64 of a text's word shingles, repeats
included. Equal fingerprints are one node. A top tree over a hashed sample of the nodes splits
Hamming space into shards: a vantage point's inner part holds the nodes within its radius. Every
node lives in one shard. It also visits, as a guest, each shard that its ball of `bits` overlaps by
the triangle inequality, but of two sides of a boundary on its own way only the outer one: of two
near nodes that part there, the inner one is the guest, so each pair meets once. A task builds a
tree of the same kind over its shard, compares nodes and guests with the leaves that their balls
overlap, and returns not the pairs but a forest of the links it has seen, which keeps components.

What the driver holds: the sample (`SAMPLE` fingerprints of 8 bytes at most) and the tree over it.
The number of shards follows the number of nodes; a task holds one shard's nodes (`SHARD_NODES` on
average), a chunk of guests and a block of distances.

Edge cases: a null, empty or blank text has fingerprint zero and is linked like any other; texts
shorter than a shingle are one shingle; very long texts are counted in chunks; repeated rows share a
node; a null id never names a component that has another id; a component without ids has a null
name; an empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import Links, _edges, components
from .shared import Shipped, as_bytes, by_value, join_hot, materialise, small_batches

by_value()

SEED = 42
SHARD_NODES = 1 << 18
#: Sampled nodes for each shard, and at most in all (8 MB on the driver).
SAMPLE_EACH, SAMPLE = 128, 1 << 20
LEAF = 256
#: Guests held at a time, and rows and columns of a block of distances.
GUESTS, BLOCK = 1 << 18, 2048


def fingerprint(text: bytes, words: int = 3) -> int:
    """The 64-bit fingerprint of a text; 0 without words."""
    found = text.lower().split()  # of bytes: A-Z only, and the blanks \x20 and \x09-\x0D
    if not found:
        return 0
    ends = np.cumsum([len(w) + 1 for w in found]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    span = max(0, min(words, len(found)) - 1)
    joined, of = b" ".join(found), xxhash.xxh64_intdigest
    counts, n = np.zeros(64, np.int64), len(found) - span
    for lo in range(0, n, 1 << 16):
        hi = min(n, lo + (1 << 16))
        pairs = zip(starts[lo:hi].tolist(), ends[lo + span : hi + span].tolist(), strict=True)
        hashes = np.array([of(joined[a:b], SEED) for a, b in pairs], dtype="<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def _fingerprints(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = np.array([fingerprint(t or b"", words) for t in as_bytes(batch.column(1))], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(marks.view(np.int64))], names=["id", "mark"])

    return run


class HammingTree:
    """A vantage-point tree over fingerprints; its leaves are numbered from 0."""

    def __init__(self, points: np.ndarray, leaf: int, seed: int = 7):
        self.points, self.leaves = points, []
        self.rng = np.random.default_rng(seed)
        self.root = self._build(np.arange(len(points)), leaf)

    def _build(self, index: np.ndarray, leaf: int):
        if len(index) > leaf:
            own = self.points[index]
            # Of some vantage points that whose distances spread most; a split cuts near the median.
            tried = own[self.rng.integers(len(own), size=min(8, len(own)))]
            seen = own[self.rng.integers(len(own), size=min(512, len(own)))]
            vantage = tried[np.bitwise_count(tried[:, None] ^ seen[None, :]).astype(float).var(axis=1).argmax()]
            away = np.bitwise_count(own ^ vantage)
            below = np.cumsum(np.bincount(away, minlength=65))[:-1]
            radius = int(np.abs(2 * below - len(own)).argmin())
            inner = away <= radius
            if inner.any() and not inner.all():
                return vantage, radius, self._build(index[inner], leaf), self._build(index[~inner], leaf)
        self.leaves.append(index)
        return len(self.leaves) - 1

    def visits(self, marks: np.ndarray, bits: int, guests: bool = False) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each leaf: who comes, as places in `marks`, and who of them is at home there.

        `guests`: all are guests from elsewhere and go wherever a node within `bits` can be.
        """
        return self._visit(self.root, marks, np.arange(len(marks)), np.full(len(marks), not guests), bits)

    def _visit(self, node, marks, who, home, bits):
        if not len(who):
            return
        if isinstance(node, int):
            yield node, who, home
            return
        vantage, radius, inner, outer = node
        away = np.bitwise_count(marks[who] ^ vantage).astype(np.int64)
        inside = away <= radius
        into = inside | (~home & (away - bits <= radius))
        out = away + bits > radius
        yield from self._visit(inner, marks, who[into], home[into], bits)
        yield from self._visit(outer, marks, who[out], home[out] & ~inside[out], bits)


def _route(shipped: Shipped, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = shipped.value
        for batch in batches:
            marks = batch.column(0).to_numpy().view(np.uint64)
            for leaf, who, home in tree.visits(marks, bits):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(who), leaf, np.int32)), pa.array(~home), pa.array(marks[who].view(np.int64))],
                    names=["shard", "guest", "mark"],
                )

    return run


class Shard:
    """The nodes of a shard in a tree, and the links that were found to them."""

    def __init__(self, points: np.ndarray, bits: int):
        self.points, self.bits, self.links = points, bits, Links()
        self.tree = HammingTree(points, LEAF)
        self.seek(points, False)

    def seek(self, marks: np.ndarray, guests: bool = True) -> None:
        for leaf, who, _ in self.tree.visits(marks, self.bits, guests):
            index = self.tree.leaves[leaf]
            for lo in range(0, len(index), BLOCK):
                points = self.points[index[lo : lo + BLOCK]]
                for at in range(0, len(who), BLOCK):
                    some = marks[who[at : at + BLOCK]]
                    near = np.bitwise_count(some[:, None] ^ points[None, :]) <= self.bits
                    row, col = np.nonzero(near)
                    a, b = some[row].view(np.int64), points[col].view(np.int64)
                    other = a != b
                    if other.any():
                        self.links.add(a[other], b[other])


def _search(bits: int):
    """The links of each shard of a partition that is sorted by shard, guests behind nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, nodes, guests, held, tree = None, [], [], 0, None

        def done() -> Iterator[pa.RecordBatch]:
            nonlocal nodes, guests, held, tree
            if tree is None and nodes:
                tree, nodes = Shard(np.concatenate(nodes), bits), []
            if tree is not None:
                if guests:
                    tree.seek(np.concatenate(guests))
                yield _edges(*tree.links.take())
            nodes, guests, held, tree = [], [], 0, None

        for batch in batches:
            of, guest, marks = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            marks = marks.view(np.uint64)
            cuts = np.flatnonzero((np.diff(of) != 0) | (np.diff(guest.astype(np.int8)) != 0)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(of)], strict=True):
                if lo == hi:
                    continue
                if of[lo] != shard:
                    yield from done()
                    shard = of[lo]
                if not guest[lo]:
                    nodes.append(marks[lo:hi])
                    continue
                if tree is None and nodes:
                    tree, nodes = Shard(np.concatenate(nodes), bits), []
                guests.append(marks[lo:hi])
                held += hi - lo
                if held > GUESTS:
                    if tree is not None:
                        tree.seek(np.concatenate(guests))
                    guests, held = [], 0
        yield from done()

    return run


def _top_tree(spark: SparkSession, nodes: DataFrame, count: int) -> HammingTree:
    """A tree over about SAMPLE_EACH hashed nodes for each shard, whose leaves are the shards."""
    least = 4 * spark.sparkContext.defaultParallelism
    shards = max(1, math.ceil(count / SHARD_NODES), min(least, count // (2 * LEAF)))
    shards = min(shards, SAMPLE // 16)
    wanted = min(SAMPLE, SAMPLE_EACH * shards)
    share = F.pmod(F.xxhash64("mark"), F.lit(1 << 40)) < min(1 << 40, int((1 << 40) * wanted / max(1, count)) + 1)
    sample = nodes.filter(share).select("mark").toArrow().column(0).to_numpy().view(np.uint64)
    sample = np.sort(sample) if shards > 1 else sample[:0]
    return HammingTree(sample, math.ceil(len(sample) / shards * 1.5))


def links(nodes: DataFrame, bits: int = 3) -> DataFrame:
    """a, b: edges that join all of the distinct fingerprints `mark` that differ in at most `bits` bits.

    They have the components of the graph of all such pairs, not all of its edges.
    """
    spark = nodes.sparkSession
    tree = _top_tree(spark, nodes, nodes.count())
    shards = len(tree.leaves)
    visits = nodes.select("mark").mapInArrow(_route(Shipped(spark, tree), bits), "shard int, guest boolean, mark bigint")
    dealt = visits.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "guest")
    return dealt.mapInArrow(_search(bits), "a bigint, b bigint")


def cluster(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, bits: int = 3) -> DataFrame:
    """Per row: id, mark (the fingerprint as a signed long), component_id (smallest id reachable)."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    rows = materialise(rows.mapInArrow(_fingerprints(words), "id bigint, mark bigint"), "fingerprints")
    nodes = rows.groupBy("mark").agg(F.min("id").alias("min_id"), F.count("*").alias("times"))
    nodes = materialise(nodes, "nodes", few=True)
    comp = components(materialise(links(nodes, bits), "links"))
    named = nodes.join(comp, nodes["mark"] == comp["node"], "left").select("mark", "min_id", "times", F.coalesce("comp", "mark").alias("comp"))
    names = named.groupBy("comp").agg(F.min("min_id").alias("component_id"), F.count("*").alias("members"))
    # A component can have any number of fingerprints, and a fingerprint any number of copies.
    by_mark = join_hot(named, names, "comp", "members", "mark").select("mark", "component_id", "times")
    by_mark = materialise(by_mark, "named", few=True)
    deal = rows.withColumn("deal", F.xxhash64("id"))
    return join_hot(deal, by_mark, "mark", "times", "deal").select("id", "mark", "component_id")
