"""Vector codes against Lloyd's rounds done from scratch."""

import hashlib

import numpy as np
from pyspark.sql import functions as F

from shelfmark.llm import codes, queries

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def brute(rows, entries=256, rounds=4, parts=4):
    """Python integers, every sum anew in every round."""
    kept = [(i, v, label) for i, v, label in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    dims = -(-max((len(v) for _, v, _ in kept), default=0) // parts) * parts
    width = dims // parts
    whole = [[int(np.floor(np.float64(np.float32(x)) * 1024)) for x in v] + [0] * (dims - len(v)) for _, v, _ in kept]
    order = sorted(range(len(kept)), key=lambda i: (kept[i][0] is None, kept[i][0] or 0, kept[i][1]))
    part = lambda v, p: v[p * width : (p + 1) * width]
    books = [[part(whole[i], p) for i in order[:entries]] for p in range(parts)]
    away = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    assign = lambda: [[min((away(part(v, p), b), e) for e, b in enumerate(books[p])) for p in range(parts)] for v in whole]
    for _ in range(rounds):
        found = assign()
        for p in range(parts):
            for e in range(len(books[p])):
                own = [part(v, p) for v, f in zip(whole, found, strict=True) if f[p][1] == e]
                if own:
                    books[p][e] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    digest = hashlib.sha256(",".join(str(x) for book in books for entry in book for x in entry).encode()).hexdigest()
    rows = [(i, "".join(f"{e:02x}" for _, e in f), sum(d for d, _ in f), label) for (i, _, label), f in zip(kept, assign(), strict=True)]
    total = {}
    for _, _, d, label in rows:
        total[label] = total.get(label, 0) + d
    return sorted(((i, c, d, total[label], digest) for i, c, d, label in rows), key=repr)


def same(df, want):
    assert df.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted(map(tuple, df.collect()), key=repr) == want


def test_rounds(spark, monkeypatch):
    """Few entries, so that many parts move; hot and null labels, repeated rows, ties, all kinds of unusable vectors."""
    monkeypatch.setattr(codes, "ENTRIES", 6)
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(size=8).astype(np.float32)], int(i % 3 > 0) or None) for i in range(400)]
    rows += rows[:5] + [(1000 + i, [0.0] * 8, 5) for i in range(4)] + [(1, None, 1), (2, [1.0] * 7 + [float("nan")], 1)]
    rows += [(3, [1.0] * 7 + [None], 1), (4, [float("-inf")] + [0.0] * 7, 1), (None, [0.5] * 8, None), (2000, [0.25] * 5, 2)]
    table = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in ("error", "code", "entry", "key")}).repartition(6)
    same(codes.coded(table), brute(rows, 6))


def test_few_and_none(spark):
    same(codes.coded(spark.createDataFrame([], SCHEMA)), [])
    rows = [(2, [1.0, -1.0, 0.5, 0.25], None), (1, [1.0, -1.0, 0.5, -0.25], 3), (3, [], 3)]
    same(codes.coded(spark.createDataFrame(rows, SCHEMA)), brute(rows))


def test_large_components_are_exact_and_bounded(spark):
    """Sums of squares beyond what a double holds; beyond the bound components count as the bound."""
    rows = [(i, [float(x) for x in np.float32(v)], 1) for i, v in enumerate(np.random.default_rng(4).normal(size=(40, 8)) * 90_000)]
    same(codes.coded(spark.createDataFrame(rows, SCHEMA)), brute(rows))
    got = codes.coded(spark.createDataFrame([(1, [3e38] * 8, 1), (2, [-3e38] * 8, 1)], SCHEMA)).collect()
    assert [r["error"] for r in got] == [0, 0]


def test_nearest_takes_the_lower_of_equals():
    book = np.array([[0, 0], [2, 0], [0, 0], [4, 0]])
    entry, away = codes.nearest(np.array([[1, 0], [3, 0], [9, 0], [0, 0]]), book)
    assert entry.tolist() == [0, 1, 3, 0] and away.tolist() == [1, 1, 25, 0]


def test_only_what_moved_is_sent(spark, monkeypatch):
    """After the first round the tasks send changes for entries that some part has come to or left, and no others."""
    sent = []
    moved = codes._moved
    monkeypatch.setattr(codes, "_moved", lambda table: sent.append(moved(table)) or sent[-1])
    table = spark.createDataFrame([(i, [float(i // 10)] * 8, 1) for i in range(100)], SCHEMA)
    monkeypatch.setattr(codes, "ENTRIES", 100)
    same(codes.coded(table), brute([(i, [float(i // 10)] * 8, 1) for i in range(100)], 100))
    assert len(sent) == 4 and sent[0] and not any(sent[1:])


def test_query_holds_every_row(spark):
    sf = "/root/testdata/sf0.001"
    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    assert sorted(r["vec_id"] for r in queries.op13_codes(spark, sf).collect()) == sorted(r["vec_id"] for r in table.collect())
