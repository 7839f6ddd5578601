"""Registered queries against their SQL; the pipeline stage by stage against brute force."""

import math
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from shelfmark.llm import licenses, queries, shared
from test_operators import brute_hits, shingles

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_agrees_with_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "embeddings", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    plain = lambda v: None if isinstance(v, float) and math.isnan(v) else v
    ours = sorted(repr([plain(r[c]) for c in columns]) for r in df.collect())
    found = con.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    assert columns == sorted(names)
    assert ours == sorted(repr([plain(dict(zip(names, r, strict=True))[c]) for c in columns]) for r in found.fetchall())


def test_all_are_registered():
    found = __spark_entry__.queries()
    assert set(queries.QUERIES) <= set(found) and "pipeline" in found
    assert {f"op{n}" for n in range(1, 14)} == {q.split("_")[0] for q in queries.QUERIES}


def test_mixing_returns_whole_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    whole = {r["doc_id"]: tuple(r) for r in docs.collect()}
    got = queries.op6_mixing(spark, SF).collect()
    keys = [r["shuffle_key"] for r in got]
    assert keys == sorted(keys) and all(tuple(r[c] for c in docs.columns) == whole[r["doc_id"]] for r in got)


def test_sharding_digests_what_came_out(spark, monkeypatch):
    shuffle = queries.sharding.shuffle_into_shards
    lost = lambda df, **kw: shuffle(df, **kw).withColumn("text", F.when(F.col("doc_id") % 2 == 0, F.col("text")))
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for change, keeps in ((shuffle, lambda d: True), (lost, lambda d: d % 2 == 0)):
        monkeypatch.setattr(queries.sharding, "shuffle_into_shards", change)
        got = queries.op9_sharding(spark, SF).collect()
        want = {d: t if keeps(d) else b"" for d, t in texts.items()}
        assert sorted((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == sorted((d, len(t) + 8, zlib.crc32(t)) for d, t in want.items())


@pytest.mark.parametrize("name", ["op2_licenses", "op5_quality", "op7_toxicity", "op9_sharding"])
def test_queries_without_sql_run(spark, name):
    """What their contracts say of every row; the operators' values are held against brute force elsewhere."""
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.QUERIES[name](spark, SF).collect()
    if name == "op2_licenses":
        scanner = licenses.Scanner(licenses.TEMPLATES, 0.8)
        want = {(d, f[0]): f[2] for d, t in texts.items() for f in scanner.scan(licenses.words_of(t.encode()))}
        assert want and {(r["doc_id"], r["license"]): r["matched"] for r in rows} == want
        return
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    if name == "op9_sharding":
        assert all(r["law"] == "rows" and r["grown_shard"] is None for r in rows)
        assert all((r["size"], r["text_crc32"]) == (len(texts[r["doc_id"]].encode()) + 8, zlib.crc32(texts[r["doc_id"]].encode())) for r in rows)
        by = {s: sorted(r["slot"] for r in rows if r["shard"] == s) for s in range(24)}
        assert all(v == list(range(len(v))) for v in by.values()) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
        return
    cut = 0.3 if name == "op5_quality" else 0.5
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= cut) for r in rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)


def test_pipeline_runs_whole(spark):
    """`run` gives what its stages give one by one, up to the order of rows."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = docs
    for _, stage in corpus_pipeline.STAGES:
        want = shared.materialise(stage(spark, want, SF), "stage")
    got = corpus_pipeline.run(spark, SF)
    assert got.columns == want.columns
    assert sorted((r["doc_id"], r["text"]) for r in got.collect()) == sorted((r["doc_id"], r["text"]) for r in want.collect())


def test_pipeline_of_empty_and_very_long(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for table in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{table}.parquet").write.parquet(f"{tmp_path}/{table}.parquet")
    docs.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    long = " ".join(f"word{i % 997}x{i}" for i in range(60_000))
    rows = [(1, long, "en", "s", 1), (2, long + " end", "en", "s", 1), (3, "", "en", "s", 0), (4, None, None, None, None)]
    odd = spark.createDataFrame(rows, docs.schema)
    for _, stage in corpus_pipeline.STAGES:
        out = shared.materialise(stage(spark, odd, SF), "stage")
        assert out.columns[: len(docs.columns)] == docs.columns and {r["doc_id"] for r in out.collect()} <= {1, 2, 3, 4}
    kept = dict(corpus_pipeline.STAGES)["MinHash near-dedup"](spark, odd, SF)
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 3, 4]


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumns({c: F.lit(7) for c in ("score", "copy", "kept", "n_words")})
    docs = docs.unionAll(docs.limit(3)).unionAll(
        docs.limit(1).select(*[F.lit(None).cast(t).alias(c) for c, t in docs.dtypes])
    )
    steps = [docs]
    for _, stage in corpus_pipeline.STAGES:
        steps.append(shared.materialise(stage(spark, steps[-1], SF), "stage"))
    assert all(s.columns == docs.columns for s in steps[:-1])
    rows = [[(r["doc_id"], r["text"]) for r in s.collect()] for s in steps]
    assert all(set(after) <= set(before) for before, after in zip(rows, rows[1:], strict=False))
    # Near duplicates: no link is left among the kept, and whoever went has a kept or removed partner.
    sets = [shingles(t, 5) for _, t in rows[2]]
    linked = lambda a, b: bool(a) and 100 * len(a & b) >= 80 * len(a | b)
    assert not any(linked(a, b) for i, a in enumerate(sets) for b in sets[:i])
    before = [shingles(t, 5) for _, t in rows[1]]
    gone = [shingles(t, 5) for d, t in set(rows[1]) - set(rows[2])]
    assert all(sum(linked(a, b) for b in before) > 1 for a in gone)
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = sorted((d for d, _, hit, *_ in brute_hits(rows[2], items, 10) if not hit), key=repr)
    assert sorted((d for d, _ in rows[3]), key=repr) == clean
    assert len(rows[5]) == len(rows[4])
    sizes = [r["count"] for r in steps[-1].groupBy("shard").count().collect()]
    assert max(sizes) - min(sizes) <= 1
