"""Near-duplicate clusters by MinHash with tensored banding, confirmed on full shingle sets.

Every text gets `HALVES` half keys of `WIDTH` minhashes each. A table key is a pair of half keys:
16 halves make 120 tables of 6 minhashes from 48 minhash functions, where independent tables would
need 720. Two texts meet in a table if they agree on two halves; at similarity 0.8 exactly that
fails with probability 2e-4, at 0.85 with 6e-6.

Equal shingle sets are one node from the start, so copies are never paired. In a table the members
of a bucket meet its smallest member, not each other. Links are confirmed on the full sets. Where
members of a bucket then still lie in different components, prefix and position filters on the full
sets, which are exact, find all pairs that could link them: within the buckets no link between
components is lost, and no bucket is paired in full. The filters put frequent shingles last; how
frequent they are is counted in `COUNTERS` counters, not for each shingle, for any order is exact.

Edge cases: null or empty texts have the empty set, are linked with nothing and are their own
component; texts shorter than a shingle are one shingle; very long texts are one set of all their
shingles; repeated rows share a set; a null id never names a component that has another id; empty
tables give empty results. Extra columns are ignored by `cluster` and kept by `deduplicate`,
whatever they are called.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared
from .components import components, merged
from .shared import Shipped, as_bytes, by_value, drop_table, join_hot, materialise, small_batches
from .shingles import mix, shingle_sets

by_value()

HALVES, WIDTH = 16, 3
#: Ids of candidate documents are broadcast up to this count (16 bytes each); beyond, both sides are shuffled.
BROADCAST_IDS = 2_000_000
NODES_PER_TASK = 5_000
#: Counters of shingles by their hash, which the driver adds up and broadcasts (1 MB).
COUNTERS = 1 << 17
#: Longs of a set's bit map, in which a shingle turns the bit of its hash.
LONGS = 8
#: Bits of the map of keys that several nodes have (16 MB); beyond so many keys all keys are shuffled again.
MAP_BITS = 1 << 27
_NO_ID = -(2**63)


def _multipliers() -> tuple[np.ndarray, np.ndarray]:
    seeds = mix(np.arange(1, 2 * HALVES * WIDTH + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))
    return seeds[::2] | np.uint64(1), seeds[1::2]


def half_keys(sets: list[np.ndarray]) -> np.ndarray:
    """An array of len(sets) x HALVES; no set may be empty."""
    flat = np.concatenate(sets)
    starts = np.cumsum([0] + [len(s) for s in sets[:-1]])
    a, b = _multipliers()
    out = np.zeros((len(sets), HALVES), dtype=np.uint64)
    room = np.empty_like(flat)
    for i in range(HALVES * WIDTH):
        np.multiply(flat, a[i], out=room)
        np.add(room, b[i], out=room)
        half = i // WIDTH
        out[:, half] = mix(out[:, half] * np.uint64(0xD1342543DE82EF95) + np.minimum.reduceat(room, starts) + np.uint64(half))
    return out


def _signatures(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = shingle_sets([t or b"" for t in as_bytes(batch.column(1))], k)
            full = [i for i, s in enumerate(sets) if len(s)]
            digest, half = [None] * len(sets), [None] * len(sets)
            if full:
                keys = half_keys([sets[i] for i in full])
                for row, i in enumerate(full):
                    digest[i] = xxhash.xxh3_128_digest(sets[i].tobytes())
                    half[i] = keys[row].tobytes()
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(2),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(digest, pa.binary()),
                    pa.array(half, pa.binary()),
                ],
                names=["id", "key", "n", "digest", "half"],
            )

    return run


def _table_keys(marked: Shipped | None = None):
    """key, node, n of every table; with `marked`, a bit map of keys, only those whose bit is set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, right = np.triu_indices(HALVES, 1)
        bits = marked.value if marked else None
        for batch in batches:
            half = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype=np.uint64).reshape(-1, HALVES)
            keys = mix(half[:, left] * np.uint64(0x9FB21C651E98DF25) + half[:, right]).ravel().view(np.int64)
            node, n = (np.repeat(batch.column(i).to_numpy(), len(left)) for i in (0, 2))
            if bits is not None:
                at = keys & (8 * len(bits) - 1)
                go = (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
                keys, node, n = keys[go], node[go], n[go]
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(node), pa.array(n)], names=["key", "node", "n"])

    return run


def _bit_map(keys: DataFrame) -> Shipped | None:
    """A bit for each key's hash, in at most MAP_BITS bits; None for more keys than bits, which it could not tell apart."""
    count = keys.count()
    if count > MAP_BITS:
        return None
    bits = max(1 << 15, min(MAP_BITS, 1 << (16 * count).bit_length()))
    at = keys.select(F.col("key").bitwiseAND(bits - 1).alias("at"))
    place, page = F.col("at") % 32768, F.floor(F.col("at") / 32768)
    pages = at.groupBy(page.alias("page")).agg(F.bitmap_construct_agg(place).alias("bits")).collect()
    out = np.zeros((bits // 32768, 4096), np.uint8)
    for r in pages:
        out[r["page"]] = np.frombuffer(r["bits"], np.uint8)
    return Shipped(keys.sparkSession, out.ravel())


def _full_sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [s for s in shingle_sets([t or b"" for t in as_bytes(batch.column(0))], k) if len(s)]
            ends = np.cumsum([0] + [len(s) for s in sets]).astype(np.int32)
            flat = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)),
                ],
                names=["digest", "shingles"],
            )

    return run


def _confirm(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """a, b and linked of the pairs, by full sets. A node can be `a` in any number of pairs, which are dealt out."""
    size = pairs.count()
    count = materialise(pairs.groupBy("a").agg(F.count("*").alias("times")), "times", rows=size)
    left = count.join(sets.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("shingles").alias("sa")), "a")
    right = sets.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("shingles").alias("sb"))
    most = count.agg(F.max("times")).collect()[0][0] or 0
    met = join_hot(pairs.join(right, "b"), left, "a", "times", "b", total=size, most=most)
    met = met.select("a", "b", "na", "nb", F.size(F.array_intersect("sa", "sb")).alias("common"))
    linked = den * F.col("common") >= num * (F.col("na") + F.col("nb") - F.col("common"))
    tested = materialise(met.select("a", "b", linked.alias("linked")), "tested", rows=size)
    drop_table(count)
    return tested


def cluster(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = 5,
    num: int = 80,
    den: int = 100,
) -> DataFrame:
    """Per row: id, key (hash of id and text), n (distinct shingles), component_id (smallest id reachable), kept.

    Texts are linked if den * |intersection| >= num * |union| of their `words`-word shingle sets.
    """
    return _clustered(docs, id_col, text_col, words, num, den)[0].drop("comp")


def _clustered(
    docs: DataFrame, id_col: str, text_col: str, words: int, num: int = 80, den: int = 100
) -> tuple[DataFrame, list[DataFrame]]:
    """As `cluster`, with comp: a node that names the component, null where n is 0; and the tables it reads."""
    spark = docs.sparkSession
    small_batches(spark)
    plain = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    plain = plain.withColumn("key", F.xxhash64("id", "text"))
    rows = plain.mapInArrow(_signatures(words), "id bigint, key bigint, n bigint, digest binary, half binary")
    rows = materialise(rows, "signatures")
    nodes = rows.filter("n > 0").groupBy("digest").agg(
        F.min("id").alias("min_id"), F.first("n").alias("n"), F.first("half").alias("half"), F.count("*").alias("times")
    )
    nodes = materialise(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    size = nodes.count()
    comp = _link(plain, nodes, words, num, den)
    named = nodes.select("node", "digest", "min_id", "times").join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    names = named.groupBy("comp").agg(F.min("min_id").alias("component_id"), F.count("*").alias("members"))
    names = materialise(names, "names", rows=size)
    # A component can have any number of texts, and a digest, below, any number of copies.
    by_digest = join_hot(named, names, "comp", "members", "node").select("digest", "component_id", "comp", "times")
    by_digest = materialise(by_digest, "named", rows=size)
    drop_table(nodes)
    drop_table(names)
    # Empty texts have no digest.
    out = join_hot(rows.select("id", "key", "n", "digest").withColumn("deal", F.xxhash64("id", "key")), by_digest, "digest", "times", "deal", "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id")
    out = out.select("id", "key", "n", component, "comp")
    return out.withColumn("kept", F.col("id").eqNullSafe(F.col("component_id"))), [rows, by_digest]


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5) -> DataFrame:
    """The rows of `docs`, one of each component: that with the smallest id, of several the smallest key."""
    found, tables = _clustered(docs, id_col, text_col, words)
    fate = found.groupBy("id", "key").agg(
        F.max("kept").alias("kept"), F.count("*").alias("times"), F.min("comp").alias("comp")
    )
    fate = materialise(fate, "fate")
    for table in tables:
        drop_table(table)
    # Rows of the kept id with other texts of the component; few, for ids seldom repeat.
    stays = F.when(F.col("kept"), F.col("key"))
    first = fate.filter("comp is not null").groupBy("comp").agg(
        F.min(stays).alias("first"), F.count(stays).alias("texts"), F.count("*").alias("members")
    )
    all_fates, first = fate, materialise(first.filter("texts > 1").drop("texts"), "first", few=True)
    if first.limit(1).count():
        told = join_hot(fate.withColumn("deal", F.xxhash64("id", "key")), first, "comp", "members", "deal", "left")
        fate = told.withColumn("kept", F.col("kept") & F.coalesce(F.col("key") == F.col("first"), F.lit(True)))
    fate = materialise(fate.filter(~F.col("kept") | (F.col("times") > 1)).select("id", "key", "kept", "times"), "fate", few=True)
    drop_table(first)
    drop_table(all_fates)
    drop, twins = fate.filter(~F.col("kept")), fate.filter("kept")
    columns = docs.columns
    keyed = docs.withColumns({"__id": F.col(id_col).cast("bigint"), "__key": F.xxhash64(F.col(id_col).cast("bigint"), text_col)})

    def joined(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
        small = right.count() <= BROADCAST_IDS
        right = F.broadcast(right) if small else right
        same = left["__id"].eqNullSafe(right["id"]) & (left["__key"] == right["key"])
        return left.join(right, same, how)

    rest = joined(keyed, drop.select("id", "key"), "left_anti")
    if twins.limit(1).count():
        pair = twins.select("id", "key")
        rest = joined(rest, pair, "left_anti").unionAll(joined(rest, pair, "left_semi").dropDuplicates(["__id", "__key"]))
    return rest.select(*columns)


def _link(plain: DataFrame, nodes: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """node, comp of every node that has a link."""
    # A node becomes 120 keys: small tasks, for the keys are many times the nodes.
    size = nodes.count()
    spread = nodes.select("node", "half", "n").repartition(max(1, math.ceil(size / NODES_PER_TASK)))
    kinds = "key bigint, node bigint, n bigint"
    keys = spread.mapInArrow(_table_keys(), kinds)
    # Most keys have one node: they go in the first aggregate, which adds up hot keys before its shuffle.
    met = keys.groupBy("key").agg(F.min(F.struct("node", "n")).alias("low"), F.max("node").alias("high"), F.count("*").alias("times"))
    met = met.filter("low.node <> high").select("key", F.col("low.node").alias("low"), F.col("low.n").alias("n_low"), "times")
    met = materialise(met, "met", rows=4 * size)
    # The bit map keeps nearly all of the lone keys out of the second shuffle.
    again = spread.mapInArrow(_table_keys(_bit_map(met)), kinds)
    total, most = (x or 0 for x in met.agg(F.sum("times"), F.max("times")).collect()[0])
    every = materialise(join_hot(again, met, "key", "times", "node", total=total, most=most), "members", rows=total)
    drop_table(met)
    # Buckets of equal members are one bucket.
    same = every.groupBy("key", "low").agg(F.count("*").alias("size"), F.bit_xor(F.xxhash64("node")).alias("members"))
    buckets = same.groupBy("low", "size", "members").agg(F.min("key").alias("key")).select("key", "size")
    buckets = materialise(buckets, "buckets", rows=size)
    total, most = (x or 0 for x in buckets.agg(F.sum("size"), F.max("size")).collect()[0])
    member = join_hot(every, buckets, "key", "size", "node", "left_semi", total=total, most=most)
    member = materialise(member, "members", rows=total)
    drop_table(every)
    able = den * F.least("n", "n_low") >= num * F.greatest("n", "n_low")
    pairs = member.filter(F.col("node") != F.col("low")).filter(able).select(F.col("low").alias("a"), F.col("node").alias("b"))
    pairs = materialise(pairs.distinct(), "pairs", rows=size)
    wanted = member.select("node").distinct()
    sets = _sets_of(plain, nodes, wanted, words, size)
    tested = _confirm(pairs, sets, num, den)
    comp = components(tested.filter("linked"), rows=size)
    labelled = member.join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    labelled = materialise(labelled.select("key", "node", "comp"), "labelled", rows=total)
    mixed = labelled.groupBy("key").agg(F.min("comp").alias("least"), F.max("comp").alias("most"), F.count("*").alias("times"))
    mixed = materialise(mixed.filter("least <> most").select("key", "times"), "mixed", rows=size)
    still = join_hot(labelled, mixed, "key", "times", "node", "left_semi").select("node", "comp").distinct()
    still = materialise(still, "open", rows=size)
    used = [member, buckets, pairs, sets, tested, labelled, mixed, still]
    if still.limit(1).count():
        prefixes = _prefixes(still, sets, num, den)
        rest = _across(prefixes, num, den).join(tested.select("a", "b"), ["a", "b"], "left_anti")
        rest = materialise(rest, "pairs", rows=size)
        found = _confirm(rest, sets, num, den)
        used += [prefixes, rest, found]
        comp = merged(comp, found.filter("linked").select("a", "b"))
    for table in used:
        drop_table(table)
    return comp


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(COUNTERS, np.int64)
    for batch in batches:
        counts += np.bincount(batch.column(0).flatten().to_numpy() & (COUNTERS - 1), minlength=COUNTERS)
    at = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], names=["counter", "n"])


_MAPS = [f"m{i}" for i in range(LONGS)]


def _in_order(shipped: Shipped, num: int, den: int):
    """The shingles of each set's prefix, those with the smallest counters first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = shipped.value
        for batch in batches:
            sets = batch.column(3)
            flat, ends = sets.flatten().to_numpy(), np.cumsum([0, *sets.value_lengths().to_numpy()])
            s, row, pos, maps = [], [], [], np.zeros((LONGS, len(sets)), np.int64)
            for i, (lo, hi) in enumerate(zip(ends, ends[1:], strict=False)):
                longest = (hi - lo) - -(-(hi - lo) * num // den) + 1
                own = flat[lo:hi]
                odd = np.bincount(mix(own.view(np.uint64)) & np.uint64(64 * LONGS - 1), minlength=64 * LONGS) & 1
                maps[:, i] = np.packbits(odd, bitorder="little").view(np.int64)
                first = own[np.lexsort((own, counts[own & (COUNTERS - 1)]))[:longest]]
                s.append(first)
                row.append(np.full(len(first), i))
                pos.append(np.arange(1, len(first) + 1))
            at = np.concatenate([np.zeros(0, np.int64), *row])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([np.zeros(0, np.int64), *s]))]
                + [batch.column(i).take(pa.array(at)) for i in range(3)]
                + [pa.array(np.concatenate([np.zeros(0, np.int64), *pos]))]
                + [pa.array(m[at]) for m in maps],
                names=["s", "node", "comp", "n", "pos", *_MAPS],
            )

    return run


def _prefixes(still: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """s, node, comp, n, pos: the shingles of each set's prefix.

    With all sets in one order, frequent shingles last, sets of similarity t share a shingle among
    their first n - ceil(t * n) + 1. A counter holds the occurrences of all shingles of its hash, so
    one that is frequent cannot come early; equal counters go by the shingle itself.
    """
    spark = still.sparkSession
    small = still.count() <= BROADCAST_IDS
    mine = sets.join(F.broadcast(still) if small else still, "node").select("node", "comp", "n", "shingles")
    # At most COUNTERS numbers reach the driver, whatever the sets.
    told = mine.select("shingles").mapInArrow(_counted, "counter bigint, n bigint").groupBy("counter").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(COUNTERS, np.int64)
    counts[told.column("counter").to_numpy()] = told.column("n").to_numpy()
    order = _in_order(Shipped(spark, counts), num, den)
    return materialise(mine.mapInArrow(order, "s bigint, node bigint, comp bigint, n bigint, pos bigint, " + ", ".join(f"{m} bigint" for m in _MAPS)), "prefixes")


def _across(prefix: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs of nodes in different components that can be similar enough, by prefix and position.

    What stands before the first shared shingle bounds the overlap, and the sets' bit maps bound
    what they don't share. This is exact for all pairs of the prefixes' nodes. In the group of a
    shingle, members of its most frequent component meet the others only, so a group of copies is not
    paired with itself.
    """
    groups = prefix.groupBy("s", "comp").agg(F.count("*").alias("k"))
    groups = groups.groupBy("s").agg(
        F.max_by("comp", F.struct("k", "comp")).alias("main"), F.count("*").alias("comps"), F.sum("k").alias("times")
    )
    groups = groups.filter("comps > 1").select("s", "main", "times", F.col("times").alias("all"))
    # A frequent shingle's group is dealt out by one side; the other, without the main component, goes to each piece.
    pieces = F.ceil(F.col("all") / F.lit(shared.HOT_ROWS)).cast("int")
    told = join_hot(prefix, groups, "s", "times", "node").withColumn("pieces", pieces)
    x = told.filter("comp <> main").withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    sides = ("node", "comp", "n", "pos", *_MAPS)
    x = x.select("s", "piece", *[F.col(c).alias(f"x_{c}") for c in sides])
    y = told.withColumn("piece", F.pmod(F.xxhash64("node"), "pieces").cast("int"))
    y = y.select("s", "piece", "main", *[F.col(c).alias(f"y_{c}") for c in sides])
    overlap = 1 + F.least(F.col("x_n") - F.col("x_pos"), F.col("y_n") - F.col("y_pos"))
    # Each bit that differs is of a shingle that one set has and the other lacks.
    differ = sum((F.bit_count(F.col(f"x_{m}").bitwiseXOR(F.col(f"y_{m}"))) for m in _MAPS), F.lit(0))
    able = (
        (x["s"] == y["s"])
        & (x["piece"] == y["piece"])
        & (F.col("x_comp") != F.col("y_comp"))
        & ((F.col("y_comp") == F.col("main")) | (F.col("x_node") < F.col("y_node")))
        & (den * F.least("x_n", "y_n") >= num * F.greatest("x_n", "y_n"))
        & ((num + den) * overlap >= num * (F.col("x_n") + F.col("y_n")))
        & ((num + den) * differ <= (den - num) * (F.col("x_n") + F.col("y_n")))
    )
    return x.join(y, able).select(F.least("x_node", "y_node").alias("a"), F.greatest("x_node", "y_node").alias("b")).distinct()


def _sets_of(plain: DataFrame, nodes: DataFrame, wanted: DataFrame, words: int, size: int) -> DataFrame:
    """node, n, shingles of every node in `wanted`; only their texts are read into sets."""
    wanted = nodes.select("node", "digest", "n", F.coalesce("min_id", F.lit(_NO_ID)).alias("ident")).join(wanted, "node")
    wanted = materialise(wanted, "wanted", rows=size)
    idents = wanted.select("ident").distinct()
    if wanted.count() <= BROADCAST_IDS:
        idents = F.broadcast(idents)
    texts = plain.withColumn("ident", F.coalesce("id", F.lit(_NO_ID))).join(idents, "ident", "left_semi").select("text")
    full = texts.mapInArrow(_full_sets(words), "digest binary, shingles array<bigint>").dropDuplicates(["digest"])
    sets = materialise(wanted.join(full, "digest").select("node", "n", "shingles"), "sets")
    drop_table(wanted)
    return sets
