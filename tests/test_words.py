"""Word vectors learnt from a catalogue: counted by hand, factored as NumPy does, and good for more than letters."""

import math
from collections import Counter

import numpy as np
import pytest

from shelfmark import api, store
from shelfmark.operators import words
from shelfmark.operators.normalize import normalize
from shelfmark.operators.enrich import without_cards
from shelfmark.operators.resolve import resolve
from shelfmark.operators.vectors import HashedNgramEmbedder
from shelfmark.plans.catalogue import CANDIDATES, Catalogue

from test_catalogue import rows
from test_store import Keywords

HEADER = "nazwa,nr_katalogowy,producent,kategoria,opakowanie,cena,atrybuty_dodatkowe\n"
# Polish names; the last of each kind has no category and no other row of its name.
GOODS = {
    "plastik laboratoryjny": ["Koncowki filtrowe", "Koncowki do pipet", "Probowki stozkowe", "Plytki dolkowe", "Probowki szklane"],
    "chemia laboratoryjna": ["Etanol czysty", "Chloroform czysty", "Bufor fosforanowy", "Bufor czysty", "Roztwor fosforanowy"],
    "aparatura pomiarowa": ["Waga cyfrowa", "Wirowka cyfrowa", "Termostat blokowy", "Czytnik cyfrowy", "Czytnik blokowy"],
}


def sample(spark):
    made = []
    for k, (label, names) in enumerate(GOODS.items()):
        for i, name in enumerate(names * 3):
            last = i % len(names) == len(names) - 1
            made.append({"sku": f"XX-{k}{i:02d}0", "name": name, "manufacturer": "Acme", "category": "" if last else label})
    records = normalize(rows(spark, *made))
    return Catalogue(without_cards(resolve(records)), spark.createDataFrame([], CANDIDATES), records)


def test_pairs_by_hand(spark, monkeypatch):
    monkeypatch.setattr(words, "WINDOW", 2)
    told = [("Ala ma kota, ŁADNEGO kota", "PCR_REAGENT"), ("ma x y2 ala", None), (None, "PCR_REAGENT"), ("", None)]
    labels = words.anchors()["PCR_REAGENT"]
    assert {"pcr", "reagents", "odczynniki", "do"} == set(labels)
    want = Counter()
    for found, marks in ((["ala", "ma", "kota", "ladnego", "kota"], labels), (["ma", "y2", "ala"], []), ([], labels)):
        pairs = [(a, b) for i, a in enumerate(found) for b in found[i + 1 : i + 3]]
        pairs += [(a, b) for a in found for b in marks] + [(a, b) for i, a in enumerate(marks) for b in marks[i + 1 :]]
        for a, b in pairs:
            if a != b:
                want.update([(a, b), (b, a)])
    got = words.word_pairs(spark.createDataFrame(told, "text string, category string"))
    assert {(r["word"], r["context"]): r["n"] for r in got.collect()} == want
    matrix, counts = words.associations(got)
    total, own = sum(want.values()), Counter()
    for (a, _), n in want.items():
        own[a] += n
    ppmi = {(a, b): math.log(n * total / (own[a] * own[b])) for (a, b), n in want.items()}
    assert {(r["word"], r["context"]): round(r["ppmi"], 9) for r in matrix.collect()} == {k: round(v, 9) for k, v in ppmi.items() if v > 0}
    assert {r["word"]: r["n"] for r in counts.collect()} == own
    few, counts = words.associations(got, 3)
    assert {r["word"] for r in few.collect()} <= {r["word"] for r in counts.collect()} and counts.count() == 3


def test_factors_are_the_largest(spark):
    rng = np.random.default_rng(1)
    n, k = 60, 5
    low = rng.normal(size=(n, k)) * [9, 7, 5, 4, 3]
    whole = low @ low.T
    names = [f"w{i}" for i in range(n)]
    cells = [(names[i], names[j], float(whole[i, j])) for i in range(n) for j in range(n)]
    matrix = spark.createDataFrame(cells, "word string, context string, ppmi double").repartition(5)
    got = words.factors(matrix, names, k)
    assert np.allclose(got @ got.T, whole, atol=1e-6 * np.abs(whole).max())
    assert words.factors(matrix.limit(0), names[:2], k).shape == (2, k)


def ranks(spark, path, catalogue, embedder, query):
    """Places of the products without a category of their own, in the search's order."""
    made = store.CatalogueStore(spark, str(path), embedder)
    made.seed(catalogue)
    found = made.search(query, limit=100).collect()
    bare = {n[-1] for n in GOODS.values()}
    return [r["name"] for r in found if r["name"] in bare]


def test_an_english_query_finds_polish_products_without_a_common_stem(spark, tmp_path):
    """Names that no label was ever beside, through the words they share with others; letters alone don't order them."""
    catalogue = sample(spark)
    assert {r["name"] for r in catalogue.products.filter("category IS NULL").collect()} == {n[-1] for n in GOODS.values()}
    learnt = words.train(catalogue.products)
    queries = {"plasticware": "Probowki szklane", "chemicals": "Roztwor fosforanowy", "measuring equipment": "Czytnik blokowy"}
    for i, (query, name) in enumerate(queries.items()):
        stems = {w[:4] for w in query.split()}
        assert not stems & {w[:4].lower() for w in name.split()}
        found = ranks(spark, tmp_path / f"learnt{i}", catalogue, learnt, query)
        assert found[:3] == [name] * 3
    by_letters = [ranks(spark, tmp_path / f"letters{i}", catalogue, HashedNgramEmbedder(), q)[:3] == [n] * 3 for i, (q, n) in enumerate(queries.items())]
    assert not all(by_letters)


def test_a_model_is_kept_and_words_that_begin_alike_count(spark, tmp_path):
    learnt = words.train(sample(spark).products)
    words.save(learnt, spark, str(tmp_path / "m"))
    again = words.load(spark, str(tmp_path / "m"))
    texts = ["Próbówki szklane", "probowkami", "zzz", "", "plasticware 5 ml"]
    assert again.model_name == learnt.model_name and np.allclose(again.embed(texts), learnt.embed(texts), atol=1e-6)
    vectors = np.array(learnt.embed(["probowki", "probowkami", "qqqqqq"]))
    assert np.allclose((vectors[:2] ** 2).sum(axis=1), 1) and vectors[0] @ vectors[1] > 0.5
    assert not vectors[2][:48].any() and vectors[2].any()
    nothing = words.train(without_cards(resolve(normalize(rows(spark)))))
    assert len(nothing.embed(["a", ""])) == 2


def test_a_store_from_files_learns_first(spark, tmp_path):
    lines = [f"{name},XX-1{k}{i}0,Acme,{label},5 szt,1 zl,\n" for k, (label, names) in enumerate(GOODS.items()) for i, name in enumerate(names)]
    (tmp_path / "p.csv").write_text(HEADER + "".join(lines), encoding="utf-8")
    served = api.from_files(spark, str(tmp_path / "s"), str(tmp_path / "p.csv"))
    found = served.respond("GET", "/api/search", "q=lab+plasticware&limit=3")[1]["results"]
    assert {r["category"] for r in found} == {"LAB_PLASTICWARE"}
    assert served.store.metadata()["embedding_model"].startswith("corpus-words-")
    again = api.from_files(spark, str(tmp_path / "s"), "no such file")
    assert again.store.count_products() == 15
    with pytest.raises(RuntimeError):
        store.CatalogueStore(spark, str(tmp_path / "s"), Keywords())
