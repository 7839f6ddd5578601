"""Components, Hamming trees and SimHash clusters against brute force."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from shelfmark.llm import components, queries, shared, simhash

SF = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def brute_components(nodes, edges):
    top = {n: n for n in nodes}

    def find(n):
        while top[n] != n:
            n = top[n]
        return n

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        top[y] = x
    return {n: find(n) for n in nodes}


def brute_mark(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else " " if c in "\t\n\v\f\r" else c for c in text or "").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_clusters(rows):
    marks = [brute_mark(t) for _, t in rows]
    edges = [(i, j) for i in range(len(rows)) for j in range(i) if (marks[i] ^ marks[j]).bit_count() <= 3]
    own = brute_components(range(len(rows)), edges)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[own[i]] = min(d, least.get(own[i], d))
    return [(d, f"{m:016x}", least.get(own[i])) for i, ((d, _), m) in enumerate(zip(rows, marks, strict=True))]


def test_forest_keeps_components():
    rng = np.random.default_rng(1)
    for n, m in ((2, 1), (50, 30), (400, 500), (1000, 400)):
        a, b = rng.integers(n, size=m), rng.integers(n, size=m)
        want = brute_components(set(a.tolist()) | set(b.tolist()), zip(a.tolist(), b.tolist(), strict=True))
        low, top = components.forest(a, b)
        assert {**{x: x for x in want}, **dict(zip(low.tolist(), top.tolist(), strict=True))} == want


@pytest.mark.parametrize("shape", ["hub", "chain", "random", "loops"])
def test_components(spark, shape, monkeypatch):
    """A hub of most nodes, a long chain in random order, a random graph; contraction in small chunks, small hot limits."""
    rng = random.Random(shape)
    ids = rng.sample(range(-(10**6), 10**6), 3000)
    edges = {
        "hub": [(ids[0], x) for x in ids[1:]],
        "chain": list(zip(ids, ids[1:], strict=False)),
        "random": [tuple(rng.sample(ids, 2)) for _ in range(2500)],
        "loops": [(x, x) for x in ids[:5]] + [(ids[0], ids[1])] * 3,
    }[shape]
    monkeypatch.setattr(shared, "HOT_ROWS", 50)
    want = brute_components({n for e in edges for n in e}, edges)
    for chunk in (components.CHUNK, 16) if shape == "random" else (16,):
        monkeypatch.setattr(components, "CHUNK", chunk)
        table = spark.createDataFrame(edges, "a bigint, b bigint").repartition(7)
        got = {r["node"]: r["comp"] for r in components.components(table).collect()}
        assert got == want
    if shape == "random":
        more = [tuple(rng.sample(ids, 2)) for _ in range(300)] + [(ids[0], x) for x in ids[1:200]]
        labels = spark.createDataFrame(sorted(want.items()), "node bigint, comp bigint")
        got = {r["node"]: r["comp"] for r in components.merged(labels, spark.createDataFrame(more, "a bigint, b bigint")).collect()}
        assert got == brute_components({n for e in edges + more for n in e}, edges + more)


def test_every_near_pair_meets_once():
    """Each pair within reach meets in one shard at home or as one guest, whatever the tree."""
    rng = np.random.default_rng(3)
    base = rng.integers(1 << 63, size=40).astype(np.uint64)
    flips = np.uint64(1) << rng.integers(64, size=(40, 12, 3)).astype(np.uint64)
    marks = np.unique(np.concatenate([base, (base[:, None] ^ np.bitwise_xor.reduce(flips, axis=2)).ravel()]))
    near = {(i, j) for i in range(len(marks)) for j in range(i) if int(marks[i] ^ marks[j]).bit_count() <= 3}
    tree = simhash.HammingTree(marks[::3], 10)
    at_home, guests = {}, {}
    for leaf, who, home in tree.visits(marks, 3):
        at_home[leaf] = at_home.get(leaf, []) + who[home].tolist()
        guests[leaf] = guests.get(leaf, []) + who[~home].tolist()
    assert len(at_home) > 10 and sorted(x for v in at_home.values() for x in v) == list(range(len(marks)))
    met = [tuple(sorted((i, j), reverse=True)) for leaf in at_home for i in at_home[leaf] for j in at_home[leaf] if j < i]
    met += [tuple(sorted((i, j), reverse=True)) for leaf in at_home for i in guests[leaf] for j in at_home[leaf]]
    assert near <= set(met) and all(met.count(p) == 1 for p in near)


def near_rows():
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    rows = []
    for _ in range(8):
        base = [word() for _ in range(rng.choice((30, 200, 900)))]
        for _ in range(12):
            text = list(base)
            for _ in range(rng.randrange(3)):
                text[rng.randrange(len(text))] = word()
            rows.append(" ".join(text))
    rows += ["", None, " \t\n", "One", "one", "one two", "ONE\ttwo", "Ä b", "ä b", rows[0], rows[0].upper(), "x " * 70_000]
    return [(i * 7 % 1009, t) for i, t in enumerate(rows)] + [(None, rows[0]), (None, "only here and nowhere else"), (7, "one")]


def test_clusters(spark, monkeypatch):
    rows = near_rows()
    monkeypatch.setattr(simhash, "LEAF", 4)
    monkeypatch.setattr(simhash, "GUESTS", 5)
    monkeypatch.setattr(simhash, "SHARD_NODES", 8)
    table = spark.createDataFrame([(d, t, "en", "s", 1) for d, t in rows], DOCS).withColumn("mark", F.lit(1)).repartition(5)
    got = simhash.cluster(table).collect()
    assert sorted(((r["id"], f"{r['mark'] & (1 << 64) - 1:016x}", r["component_id"]) for r in got), key=repr) == sorted(brute_clusters(rows), key=repr)


def test_query_on_a_whole_table(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = queries.op11_simhash(spark, SF)
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    assert sorted(map(tuple, got.collect())) == sorted(brute_clusters(rows))


def test_no_documents(spark):
    assert simhash.cluster(spark.createDataFrame([], DOCS)).count() == 0


def test_a_large_family_of_near_copies(spark):
    """Thousands of fingerprints within a few bits: one component, and far fewer links than pairs."""
    rng = np.random.default_rng(5)
    bits = rng.permutation(64)[:14]
    marks = np.unique(np.bitwise_or.reduce(rng.integers(2, size=(6000, 14)).astype(np.uint64) << bits.astype(np.uint64), axis=1))
    nodes = spark.createDataFrame([(int(m),) for m in marks.view(np.int64)], "mark bigint").repartition(6)
    found = shared.materialise(simhash.links(nodes), "links")
    assert found.count() <= 60 * len(marks)
    comp = components.components(found).collect()
    assert len(comp) == len(marks) and {r["comp"] for r in comp} == {int(marks.view(np.int64).min())}
