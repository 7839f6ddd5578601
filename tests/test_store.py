"""The store: seed once, add, delete, search, and what it refuses."""

import numpy as np
import pytest
from shelfmark.operators.normalize import normalize
from shelfmark.operators.resolve import resolve
from shelfmark.operators.enrich import without_cards
from shelfmark.plans.catalogue import CANDIDATES, Catalogue
from shelfmark.store import CatalogueStore, InvalidProduct, ProductConflict, ProductInput, ProductNotFound

from test_catalogue import rows


class Keywords:
    """Two dimensions: a constant, and whether the text is about cold."""

    model_name = "keywords"

    def __init__(self, dimensions=2):
        self.dimensions = dimensions

    def embed(self, texts):
        return [[1.0, 3.0 if "cold" in t.lower() else 0.1] + [0.5] * (self.dimensions - 2) for t in texts]


class Broken(Keywords):
    def embed(self, texts):
        raise RuntimeError("no model")


@pytest.fixture
def catalogue(spark):
    records = normalize(
        rows(
            spark,
            {"sku": "XX-10001", "name": "Cold box", "manufacturer": "Łódź Labs"},
            {"sku": "XX-10001A", "name": "Cold box", "manufacturer": "Łódź Labs"},
            {"sku": "XX-10002", "name": "Balance", "category": "chemicals"},
        )
    )
    return Catalogue(without_cards(resolve(records)), spark.createDataFrame([], CANDIDATES), records)


def test_life_of_a_store(spark, tmp_path, catalogue):
    path = str(tmp_path / "store")
    store = CatalogueStore(spark, path, Keywords())
    assert store.search("anything") is None and store.count_products() == 0
    store.seed(catalogue)
    store.seed(catalogue)
    assert store.seeded and store.count_products() == 2
    hits = store.search("something cold", limit=5).collect()
    assert [h["canonical_sku"] for h in hits] == ["XX-10001", "XX-10002"]
    assert hits[0]["explanation"].startswith("score 0.") and "strongest fields: name 1.00" in hits[0]["explanation"]
    assert [h["canonical_sku"] for h in store.search("cold", manufacturer=" lodz ", limit=1).collect()] == ["XX-10001"]
    assert [h["canonical_sku"] for h in store.search("cold", category="lab_chemical").collect()] == ["XX-10002"]
    alias = store.search("xx-10001a").collect()
    assert alias[0]["score"] == 1.0 and "registered alias of XX-10001" in alias[0]["explanation"]
    # An exact hit that a filter removes is no reason to fall back to similarity.
    assert store.search("XX-10001", category="LAB_CHEMICAL").count() == 0
    with pytest.raises(ValueError):
        store.search("x", limit=0)

    added = store.add(ProductInput("yy-1", " New  thing ", "Maker", "pcr_reagent", "5 g", "10", description="cold stuff"))
    assert added["canonical_sku"] == "YY-1" and added["enrichment"]["match_rule"] == "runtime_input"
    assert "description added with the product" in store.search("cold", category="PCR_REAGENT").collect()[0]["explanation"]
    for sku in ("YY-1", "XX-10001A"):
        with pytest.raises(ProductConflict):
            store.add(ProductInput(sku, "n", "m"))
    with pytest.raises(InvalidProduct):
        store.add(ProductInput("ZZ-1", "n", "m", category="nonsense"))
    with pytest.raises(InvalidProduct):
        store.add(ProductInput("ZZ-1", "  ", "m"))

    gone = store.delete("xx-10001a")
    assert (gone.canonical_sku, gone.alias_skus) == ("XX-10001", ["XX-10001A"])
    with pytest.raises(ProductNotFound):
        store.delete("XX-10001")
    again = CatalogueStore(spark, path, Keywords())
    assert again.count_products() == 2
    assert [e["action"] for e in again.events().orderBy("occurred_at").collect()] == ["seed", "add", "delete"]
    again.delete("XX-10002")
    again.delete("YY-1")
    again.seed(catalogue)
    assert again.count_products() == 0

    with pytest.raises(RuntimeError):
        CatalogueStore(spark, path)  # another model


def test_failures_leave_nothing(spark, tmp_path, catalogue):
    store = CatalogueStore(spark, str(tmp_path / "s"), Broken())
    with pytest.raises(Exception, match="no model"):
        store.add(ProductInput("A-1", "n", "m"))
    assert store.count_products() == 0 and store.events() is None
    (tmp_path / "other").mkdir()
    (tmp_path / "other" / "file").write_text("x")
    with pytest.raises(RuntimeError):
        CatalogueStore(spark, str(tmp_path / "other"))


def test_dimension_mismatch(spark, tmp_path, catalogue):
    path = str(tmp_path / "s")
    CatalogueStore(spark, path, Keywords()).seed(catalogue)
    wider = CatalogueStore(spark, path, Keywords(3))
    with pytest.raises(RuntimeError, match="dimension"):
        wider.add(ProductInput("A-1", "n", "m"))
    with pytest.raises(RuntimeError, match="dimension"):
        wider.search("cold")
    assert wider.count_products() == 2


def test_stale_writer_is_refused(spark, tmp_path, catalogue):
    from shelfmark.store import ConcurrentWrite

    store = CatalogueStore(spark, str(tmp_path / "s"), Keywords())
    version, state = store._state()
    store._publish(version + 1, state)
    with pytest.raises(ConcurrentWrite):
        store._publish(version + 1, state)


def test_segments_are_compacted(spark, tmp_path, catalogue, monkeypatch):
    from shelfmark import store as module

    monkeypatch.setattr(module, "COMPACT_SEGMENTS", 2)
    store = CatalogueStore(spark, str(tmp_path / "s"), Keywords())
    store.seed(catalogue)
    store.add(ProductInput("A-1", "cold a", "m"))
    store.delete("XX-10002")
    store.add(ProductInput("A-2", "cold b", "m"))
    state = store._state()[1]
    assert len(state["segments"]) == 1 and state["segments"][0]["dead"] == [] and state["segments"][0]["rows"] == 3
    assert {r["canonical_sku"] for r in store.products().collect()} == {"XX-10001", "A-1", "A-2"}
    assert {h["canonical_sku"] for h in store.search("cold").collect()} == {"XX-10001", "A-1", "A-2"}
    assert store.metadata()["dimensions"] == 2 and store.records().count() == 3 and store.candidates().count() == 0


def test_vectors_of_products_and_groups(spark):
    from shelfmark.operators.vectors import centroids, product_vectors

    rows = [("a", "x", [3.0, 0.0]), ("a", "y", [0.0, 4.0]), ("b", "x", [0.0, 2.0])]
    fields = spark.createDataFrame(rows, "canonical_sku string, field string, vector array<double>")
    want = {"a": [0.6, 0.8], "b": [0.0, 1.0]}
    for found in (product_vectors(fields), centroids(fields, "canonical_sku")):
        assert {r["canonical_sku"]: [round(x, 9) for x in r["vector"]] for r in found.collect()} == want
    bad = fields.unionAll(spark.createDataFrame([("a", "z", [1.0])], fields.schema))
    with pytest.raises(Exception, match="dimensions differ"):
        product_vectors(bad).collect()
    for spread in (bad.coalesce(1), bad.repartition(4, "vector")):
        with pytest.raises(Exception, match="dimensions differ"):
            centroids(spread, "canonical_sku").collect()
    assert centroids(fields.limit(0), "canonical_sku").count() == 0 and product_vectors(fields.limit(0)).count() == 0


def test_centroids_of_many_and_hot_keys(spark, monkeypatch):
    from shelfmark.operators import vectors

    rng = np.random.default_rng(1)
    keys = [None if k > 90 else 0 if k > 40 else int(k) for k in rng.integers(0, 100, size=3000)]
    rows = [(k, [float(x) for x in v]) for k, v in zip(keys, rng.normal(size=(3000, 6)) + 1, strict=True)] + [(5, None)]
    table = spark.createDataFrame(rows, "k int, v array<double>").repartition(5)
    for held in (1000, 7):
        monkeypatch.setattr(vectors, "HELD_KEYS", held)
        got = {r["k"]: r["vector"] for r in vectors.centroids(table, "k", "v").collect()}
        assert set(got) == set(keys)
        for k, vector in got.items():
            mean = np.mean([v for x, v in rows if x == k and v], axis=0)
            assert np.allclose(vector, mean / np.linalg.norm(mean))


@pytest.mark.parametrize("kind", ["random", "ties"])
def test_many_queries_in_one_scan(spark, monkeypatch, kind):
    """Each query's best rows as a full sort gives them, with ties in any number and blocks of queries."""
    from shelfmark.operators import search

    rng = np.random.default_rng(3)
    make = (lambda n: rng.normal(size=(n, 5))) if kind == "random" else (lambda n: rng.integers(-1, 2, size=(n, 5)).astype(float))
    rows, queries = make(700), make(23)
    monkeypatch.setattr(search, "QUERIES", 10)
    table = spark.createDataFrame([(f"k{i}", v.tolist()) for i, v in enumerate(rows)], "sku string, v array<double>").repartition(6)
    got = search.top_k_many(table, "sku", "v", queries.tolist(), 9).orderBy("query", "rank").collect()
    want = []
    for q, query in enumerate(queries):
        scores = []
        for i, v in enumerate(rows):
            total = 0.0
            for x, y in zip(v, query, strict=True):
                total += x * y
            scores.append((-total, f"k{i}"))
        want += [(q, r + 1, key, -s) for r, (s, key) in enumerate(sorted(scores)[:9])]
    assert [tuple(r) for r in got] == want
    assert search.top_k_many(table, "sku", "v", [], 3).count() == 0
    assert search.top_k_many(table.limit(2), "sku", "v", queries.tolist(), 9).count() == 46


def test_searching_many_is_searching_each(spark, tmp_path, catalogue):
    store = CatalogueStore(spark, str(tmp_path / "s"), Keywords())
    assert store.search_many(["a"]) is None
    store.seed(catalogue)
    store.add(ProductInput("A-1", "cold a", "Łódź"))
    queries = ["cold", "xx-10001a", "balance", " A – 1 ", "cold"]
    for given in ({}, {"manufacturer": " lodz "}, {"category": "lab_chemical", "limit": 1}):
        got = sorted(map(tuple, store.search_many(queries, **given).collect()))
        want = []
        for i, q in enumerate(queries):
            for r, hit in enumerate(store.search(q, **given).collect()):
                want.append((i, r + 1, hit["canonical_sku"], hit["score"], hit["match_type"]))
        assert [x[:3] + x[4:] for x in got] == [x[:3] + x[4:] for x in want]
        assert np.allclose([x[3] for x in got], [x[3] for x in want])
