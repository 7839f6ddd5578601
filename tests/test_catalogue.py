"""Parsers, inference, merging, variants and cards on small literal inputs."""

import pytest
from pyspark.sql import functions as F

from shelfmark.functions import parse, text
from shelfmark.operators.enrich import as_digits, enrich, is_reading
from shelfmark.operators.normalize import normalize
from shelfmark.operators.resolve import fold_variants, identifiers, merge_same_sku, resolve
from shelfmark.plans.catalogue import build_catalogue
from shelfmark.sources.html_cards import cards_of

HEADER = "nazwa,nr_katalogowy,producent,kategoria,opakowanie,cena,atrybuty_dodatkowe"
COLUMNS = "row_number long, name string, sku string, manufacturer string, category string, package string, price string, attributes string"


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "v string").select(column(F.col("v")).alias("r")).collect()[0]["r"]


def rows(spark, *items):
    """Rows as dicts over defaults, numbered in order."""
    base = {"name": "Thing", "sku": "XX-1", "manufacturer": "Maker", "category": "pomiary", "package": "5 szt", "price": "10", "attributes": ""}
    return spark.createDataFrame(
        [(i, *[(base | item)[k] for k in base]) for i, item in enumerate(items, 1)], COLUMNS
    )


def products(spark, *items):
    found = resolve(normalize(rows(spark, *items))).collect()
    return {p["canonical_sku"]: p for p in found}


@pytest.mark.parametrize(
    ("raw", "quantity", "unit"),
    [
        ("50 rxn", "50", "reaction"),
        ("x50", "50", "item"),
        ("10 szt.", "10", "item"),
        ("2,5 ml", "2.5", "milliliter"),
        ("3 kg", "3", "kilogram"),
        ("20-pack", "20", "item"),
        ("5 -", "5", "unknown"),
        ("", None, "unknown"),
        ("xyz", None, "item"),
        ("1 000 szt", "1", "item"),
        ("50 µl", "50", "liter"),
        ("-5 g", "5", "gram"),
        ("007 l", "7", "liter"),
    ],
)
def test_package(spark, raw, quantity, unit):
    p = one(spark, lambda c: parse.package_of(c, text.casefold(text.squash(c))), raw)
    assert (p["quantity_text"], p["unit"], p["raw"]) == (quantity, unit, raw)


@pytest.mark.parametrize(
    ("raw", "amount", "inferred"),
    [
        ("1021 zl", "1021", False),
        ("3908,00", "3908.00", True),
        ("1 990,00 PLN", "1990.00", False),
        ("12 ZŁ", "12", False),
        ("EUR 10", None, False),
        ("-10 PLN", None, False),
        ("1.990,00", None, False),
        ("3399 PLN plus VAT", None, False),
        ("", None, False),
    ],
)
def test_price(spark, raw, amount, inferred):
    p = one(spark, parse.price_of, raw)
    assert (p["amount_text"], p["currency_inferred"], p["currency"]) == (amount, inferred, "PLN" if amount else None)


def test_attributes_and_their_quirks(spark):
    get = lambda raw: one(spark, lambda c: parse.attributes_of(c, text.casefold(text.squash(c))), raw)
    a = get("Przechowywanie -20 C, chronic  przed swiatlem")
    assert (a["storage_temperature_c"], a["light_sensitive"], a["dry_ice_required"]) == (-20, True, False)
    assert get("przechowywanie 4°C")["storage_temperature_c"] is None
    assert not get("chronić przed światłem")["light_sensitive"]
    assert get("chronić przed swiatlem")["light_sensitive"]
    assert get("termin waznosci 12 mies.")["shelf_life_months"] == 12


def test_text_forms(spark):
    assert one(spark, text.squash, " a \t b\n") == "a b"
    assert one(spark, text.sku_form, " ch – 10248 a ") == "CH-10248 A"
    assert one(spark, text.fold, "Czytnik PŁYTEK ß") == "czytnik plytek ss"
    assert [one(spark, text.quoted, x) for x in ("a", "it's", "\"it's\"", "a\\b\n")] == [
        repr(x) for x in ("a", "it's", "\"it's\"", "a\\b\n")
    ]


def test_category_is_inferred_only_from_agreeing_names(spark):
    found = normalize(
        rows(
            spark,
            {"name": "A", "category": "pomiary"},
            {"name": "a", "category": ""},
            {"name": "B", "category": "pomiary"},
            {"name": "B", "category": "chemicals"},
            {"name": "B", "category": ""},
            {"name": "C", "category": ""},
            {"name": "D", "category": "unheard of"},
        )
    ).orderBy("row_number").collect()
    assert [r["category_source"] for r in found] == ["row", "inferred_from_product_name", "row", "row", "missing", "missing", "missing"]
    assert found[4]["issues"][-1]["detail"] == "ambiguous: ['LAB_CHEMICAL', 'LAB_EQUIPMENT']"
    assert found[5]["issues"][-1]["detail"] == "no other row with this name"
    assert [i["code"] for i in found[6]["issues"]] == ["unknown_category_label", "category_missing"]


def test_rows_of_one_sku_merge_in_row_order(spark):
    p = products(
        spark,
        {"price": "", "attributes": "", "package": "5 g"},
        {"price": "20 PLN", "attributes": "wymaga suchego lodu", "manufacturer": "Other"},
        {"price": "30", "attributes": "temp. pokojowa"},
    )["XX-1"]
    assert p["price"]["amount_text"] == "20" and p["package"]["raw"] == "5 g" and p["source_rows"] == [1, 2, 3]
    assert p["attributes"]["dry_ice_required"] and p["attributes"]["room_temperature"]
    assert p["attributes"]["raw"] == "wymaga suchego lodu"
    details = [i["detail"] for i in p["issues"]]
    assert [i["code"] for i in p["issues"]] == ["price_missing"] + ["duplicate_field_conflict"] * 4 + ["package_unit_implausible"]
    assert details[1] == "manufacturer differs between rows: ['maker', 'other']"
    assert p["resolution_notes"] == ["exact duplicate SKU: merged rows [1, 2, 3] (first non-empty value per field)"]


def test_variants_fold_in_order_into_the_base_as_it_then_is(spark):
    found = products(
        spark,
        {"sku": "XX-10001B", "price": "120"},
        {"sku": "XX-10001", "price": ""},
        {"sku": "XX-10001A", "price": "99"},
        {"sku": "XX-10001-2", "price": "120"},
        {"sku": "XX-10009A"},
    )
    assert set(found) == {"XX-10001", "XX-10001A", "XX-10009A"}
    base = found["XX-10001"]
    assert base["price"]["amount_text"] == "120" and base["alias_skus"] == ["XX-10001B", "XX-10001-2"]
    assert base["source_rows"] == [1, 2, 4]
    assert found["XX-10001A"]["issues"][-1]["detail"] == "XX-10001A looks like a variant of XX-10001 but price differ"


def test_unread_units_are_not_equal(spark):
    found = products(spark, {"sku": "XX-10001", "package": "50 butelek"}, {"sku": "XX-10001A", "package": "50 kartonow"})
    assert len(found) == 2 and "package" in found["XX-10001A"]["issues"][-1]["detail"]


def test_near_numbers_stay_apart_and_scale_counts(spark):
    assert len(products(spark, {"sku": "CH-10248"}, {"sku": "CH-10258"})) == 2
    assert len(products(spark, {"sku": "XX-10001", "price": "1990"}, {"sku": "XX-10001A", "price": "1990.00"})) == 2


def test_confusable_reading_goes_one_way(spark):
    cases = [("NO-103L6", "NO-10316", True), ("NO-10316", "NO-103L6", False), ("NO-LI", "NO-1I", True), ("NO-L", "NO-I", False)]
    df = spark.createDataFrame(cases, "card string, known string, want boolean")
    found = df.select(
        ((as_digits(F.col("card")) == as_digits(F.col("known"))) & is_reading(F.col("card"), F.col("known"))).alias("got"), "want"
    ).collect()
    assert [r["got"] for r in found] == [r["want"] for r in found]


def card(sku, name="Thing", ordinal=0):
    return ("p", ordinal, sku, name, "text", "", "")


CARDS = "page string, ordinal int, sku string, name string, description string, storage string, applications string"


def test_cards_first_wins_aliases_count_and_the_rest_is_kept(spark):
    base = resolve(normalize(rows(spark, {"sku": "XX-10001"}, {"sku": "XX-10001A"}, {"sku": "NO-10316"}, {"sku": "NO-11"}, {"sku": "NO-1I"})))
    cards = spark.createDataFrame(
        [
            card("XX-10001A", "Renamed", 0),
            card("xx-10001", "Thing", 1),
            card("NO-103l6", "thing", 2),
            card("NO-LL", "x", 3),
            card("NO-LI", "x", 4),
            card("ZZ", "x", 5),
        ],
        CARDS,
    )
    enriched, loose = enrich(base, cards)
    found = {p["canonical_sku"]: p for p in enriched.collect()}
    first = found["XX-10001"]
    assert first["enrichment"]["name"] == "Renamed" and first["enrichment"]["match_rule"] == "exact_sku"
    assert first["resolution_notes"][-1] == "manufacturer calls XX-10001A 'Renamed'; catalogue name kept as 'Thing'"
    assert first["issues"][-1]["detail"] == (
        "card 'xx-10001' also resolves to XX-10001, already enriched from 'XX-10001A'; kept the first"
    )
    fixed = found["NO-10316"]
    assert fixed["enrichment"]["match_rule"] == "confusable_character_correction"
    assert fixed["resolution_notes"][-1].endswith("and the product name 'thing' matches 'Thing'")
    assert found["NO-11"]["enrichment"]["source_sku"] == "NO-LL"
    # NO-LI reads as NO-11 and as NO-1I: ambiguous, so it stays outside.
    assert {c["sku"] for c in loose.collect()} == {"NO-LI", "ZZ"}


def test_html_cards():
    html = """<div class="product-card big" data-sku="A-1"><h2 class="product-name">N &lt;1&gt;</h2>
    <p class="product-desc">two\n  lines <b>bold</b></p><ul class="specs"><li>Przechowywanie: 4°C</li><li>Zastosowania: PCR</li></ul></div>
    <div class="product-card"><h2>other</h2></div>"""
    assert cards_of(html) == [("A-1", "N <1>", "two lines bold", "4°C", "PCR"), ("", "", "", "", "")]
    assert cards_of(None) == [] and cards_of("") == []


def test_build_from_files(spark, tmp_path):
    (tmp_path / "p.csv").write_text(
        HEADER + '\n"Thing, ""quoted""\nline",xx-10001,Maker,,x5,1 zl,\nThing,XX-10002,Maker,pomiary,5 g,,\n', encoding="utf-8"
    )
    (tmp_path / "page.html").write_text('<div class="product-card" data-sku="XX-10002"><h2 class="product-name">Thing</h2></div>')
    built = build_catalogue(spark, str(tmp_path / "p.csv"), str(tmp_path / "page.html"))
    records = built.records.orderBy("row_number").collect()
    assert [r["row_number"] for r in records] == [1, 2] and records[0]["name"] == 'Thing, "quoted" line'
    found = {p["canonical_sku"]: p for p in built.products.collect()}
    assert found["XX-10002"]["enrichment_status"] == "enriched" and found["XX-10001"]["enrichment"] is None
    assert {r["sku"] for r in built.by_sku().collect()} == {"XX-10001", "XX-10002"}
    assert build_catalogue(spark, str(tmp_path / "p.csv")).external_candidates.count() == 0


def test_empty_inputs(spark):
    empty = spark.createDataFrame([], COLUMNS)
    merged = merge_same_sku(normalize(empty))
    assert fold_variants(merged).count() == 0 and identifiers(merged).count() == 0
