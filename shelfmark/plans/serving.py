"""Registered queries through the whole engine: files in, the catalogue build, the store, search and changes.

The tables hold no catalogue, so raw rows are made of `part` and manufacturer cards of `supplier`,
with duplicate numbers, variants, gaps, unread units, mistaken characters and renamed products. They
are written as the CSV and HTML files that the engine reads. The store of a session and a folder is
seeded once; its embedder counts letters, which SQL can do as well.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark import workspace
from shelfmark.api import Api
from shelfmark.functions import parse, vocabulary
from shelfmark.operators import enrich
from shelfmark.plans.catalogue import Catalogue, build_catalogue
from shelfmark.plans.registry import PACKAGES, PHRASES, PRICES, _nth, _read, _sql_nth, query
from shelfmark.sources import csv_rows
from shelfmark.store import CatalogueStore, ProductInput

NAMES = ["Cold box", "Analytical balance", "PCR kit, small", "Tube rack", "Czytnik płytek", "RNA kit", "Maker's stand"]
MAKERS = ["Łódź Labs", "Maker GmbH", "Acme"]
LABELS = ["pomiary", "", "odczynniki", "unheard of", "PCR   Reagents", "Plastiki lab."]


def raw_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """row_number and the seven fields of four rows for each number group."""
    k = F.col("p_partkey")
    g = F.expr("p_partkey div 4")
    own = F.concat(F.lit("PA-"), g.cast("string"))
    sku = F.when(k % 7 == 6, own).otherwise(F.concat(own, _nth(["", "A", "-2", "-3X"], k)))
    package = F.when(k % 9 == 4, "5 kartonow").otherwise(F.replace(_nth(PACKAGES, g), F.lit("{}"), F.lit("5")))
    price = F.when(k % 17 == 8, "7 PLN").when(k % 4 == 0, "").otherwise(F.replace(_nth(PRICES, g), F.lit("{}"), F.lit("9")))
    said = F.when(k % 8 == 5, "").when(k % 10 == 6, PHRASES[2]).when(k % 29 == 3, "bez\n uwag").otherwise(_nth(PHRASES, g))
    maker = F.when(k % 11 == 5, "").when(k % 13 == 3, F.upper(_nth(MAKERS, g))).otherwise(_nth(MAKERS, g))
    return _read(spark, sf_dir, "part").select(
        (k + 1).alias("row_number"),
        F.concat(_nth(NAMES, g), F.lit(" "), (g % 50).cast("string")).alias("name"),
        F.when(k % 3 == 1, F.concat(F.lit(" "), F.lower(F.replace(sku, F.lit("-"), F.lit(" – "))))).otherwise(sku).alias("sku"),
        maker.alias("manufacturer"),
        F.when(k % 5 == 3, "").otherwise(_nth(LABELS, F.expr("p_partkey div 8"))).alias("category"),
        package.alias("package"),
        price.alias("price"),
        said.alias("attributes"),
    )


def _cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """at, sku, name, storage and applications of one card for each supplier."""
    s = F.col("s_suppkey")
    number = lambda n: F.concat(F.lit("PA-"), n.cast("string"))
    sku = (
        F.when(s % 6 == 0, number(s))
        .when(s % 6 == 1, F.concat(F.lit("pa – "), (s - 1).cast("string"), F.lit("A")))
        .when(s % 6 == 2, F.concat(F.lit("PA-"), F.translate(s.cast("string"), "10", "lO")))
        .when(s % 6 == 3, F.concat(F.lit("XX-"), s.cast("string")))
        .when(s % 6 == 4, number(s - 4))
        .otherwise(F.concat(number(s), F.lit("-2")))
    )
    same = F.concat(F.lower(F.replace(F.translate(_nth(NAMES, s), "łŁ", "lL"), F.lit("ź"), F.lit("z"))), F.lit(" "), (s % 50).cast("string"))
    name = F.when(s % 4 == 0, same).when(s % 7 == 5, F.concat(F.lit("Maker's card "), s.cast("string"))).otherwise(F.col("s_name"))
    return _read(spark, sf_dir, "supplier").select(
        s.alias("at"),
        sku.alias("sku"),
        name.alias("name"),
        F.when(s % 3 == 0, "-20°C").otherwise("").alias("storage"),
        F.when(s % 2 == 0, "RNA & cold").otherwise("").alias("applications"),
    )


def _escaped(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))


def _write_files(spark: SparkSession, sf_dir: str) -> tuple[str, str]:
    """Folders of CSV files and of pages. Order is part of the formats: rows and cards are in that of the files' names."""
    csv, page = workspace.new_folder(spark, "rows-csv"), workspace.new_folder(spark, "page-html")
    fields = {field: column for column, field in csv_rows.HEADER.items()}
    rows = raw_rows(spark, sf_dir).repartitionByRange("row_number").sortWithinPartitions("row_number").drop("row_number")
    keep = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    rows.select(*[F.col(f).alias(fields[f]) for f in rows.columns]).write.options(header=True, quoteAll=True, escape='"', **keep).csv(csv)
    card = F.concat(
        F.lit('<div class="product-card"  data-sku="'), _escaped(F.col("sku")),
        F.lit('"><h2 class="product-name">'), _escaped(F.col("name")),
        F.lit('</h2><p class="product-desc">cold\n  text '), F.col("at").cast("string"),
        F.lit('</p><ul class="specs"><li>Przechowywanie: '), _escaped(F.col("storage")),
        F.lit("</li><li>Zastosowania: "), _escaped(F.col("applications")), F.lit("</li></ul></div>"),
    )
    cards = _cards(spark, sf_dir).groupBy(F.expr("at div 100").alias("page"))
    cards = cards.agg(F.array_sort(F.collect_list(F.struct("at", card.alias("html")))).alias("all"))
    body = F.concat(F.lit("<html><body>"), F.array_join(F.transform("all", lambda c: c["html"]), "\n"), F.lit("</body></html>"))
    pages = cards.repartitionByRange("page").sortWithinPartitions("page")
    pages.select(body.alias("value")).write.text(page)
    return csv, page


_files: dict[tuple[str, str], tuple[str, str]] = {}
_stores: dict[tuple[str, str], CatalogueStore] = {}


def _paths(spark: SparkSession, sf_dir: str) -> tuple[str, str]:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _files:
        _files[key] = _write_files(spark, sf_dir)
    return _files[key]


def _built(spark: SparkSession, sf_dir: str, with_page: bool = True) -> Catalogue:
    """The build from files, which are written once for a session and a folder."""
    csv, page = _paths(spark, sf_dir)
    return build_catalogue(spark, csv, page if with_page else None)


@dataclass(frozen=True)
class LetterCounts:
    """One more than the count of each letter: an embedder that SQL can follow."""

    letters: str = "aceiklnoprst"
    model_name: str = "letter-counts"

    def embed(self, texts: list[str]) -> list[list[float]]:
        return [[1.0 + text.lower().count(c) for c in self.letters] for text in texts]


def _store(spark: SparkSession, sf_dir: str) -> CatalogueStore:
    """Seeded with the whole build; made once for a session and a folder, and only read afterwards."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _stores:
        store = CatalogueStore(spark, workspace.new_folder(spark, "store"), LetterCounts())
        csv, page = _paths(spark, sf_dir)
        store.seed(lambda save: build_catalogue(spark, csv, page, save))
        _stores[key] = store
    return _stores[key]


# -- SQL of the build ---------------------------------------------------------------------------

_G = "p_partkey // 4"
_RAW_SKU = f"CASE WHEN p_partkey % 7 = 6 THEN 'PA-' || {_G} ELSE 'PA-' || {_G} || {_sql_nth(['', 'A', '-2', '-3X'], 'p_partkey')} END"
_RAW_SQL = f"""SELECT p_partkey + 1 AS n, {_sql_nth(NAMES, _G)} || ' ' || ({_G}) % 50 AS name,
    CASE WHEN p_partkey % 3 = 1 THEN ' ' || lower(replace({_RAW_SKU}, '-', ' – ')) ELSE {_RAW_SKU} END AS sku,
    CASE WHEN p_partkey % 11 = 5 THEN '' WHEN p_partkey % 13 = 3 THEN upper({_sql_nth(MAKERS, _G)}) ELSE {_sql_nth(MAKERS, _G)} END AS manufacturer,
    CASE WHEN p_partkey % 5 = 3 THEN '' ELSE {_sql_nth(LABELS, 'p_partkey // 8')} END AS category,
    CASE WHEN p_partkey % 9 = 4 THEN '5 kartonow' ELSE replace({_sql_nth(PACKAGES, _G)}, '{{}}', '5') END AS package,
    CASE WHEN p_partkey % 17 = 8 THEN '7 PLN' WHEN p_partkey % 4 = 0 THEN '' ELSE replace({_sql_nth(PRICES, _G)}, '{{}}', '9') END AS price,
    CASE WHEN p_partkey % 8 = 5 THEN '' WHEN p_partkey % 10 = 6 THEN {_sql_nth(PHRASES, '2')} WHEN p_partkey % 29 = 3 THEN 'bez' || chr(10) || ' uwag'
        ELSE {_sql_nth(PHRASES, _G)} END AS attributes FROM part"""
_NONE = "CAST([] AS VARCHAR[])"
_FIELDS = ("name", "manufacturer", "category", "package", "price", "attributes")


def _case(of: str, table: dict[str, str], rest: str = "") -> str:
    return f"CASE {of} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + f"{rest} END"


def _told(condition: str, text: str) -> str:
    return f"CASE WHEN {condition} THEN [{text}] ELSE {_NONE} END"


def _concat(*parts: str) -> str:
    out = parts[0]
    for p in parts[1:]:
        out = f"list_concat({out}, {p})"
    return out


_Q = "CASE WHEN contains({0}, '''') AND NOT contains({0}, '\"') THEN '\"' || {0} || '\"' ELSE '''' || {0} || '''' END"
_PRICE = r"^([0-9][0-9 ]*([.,][0-9]+)?)\s*(pln|zl|zł)?$"
_DIGITS = "nullif(regexp_replace(replace(replace({0}, ' ', ''), ',', '.'), '^0+([0-9])', '\\1'), '')"
_UNIT = (
    _case("regexp_replace(CASE WHEN num = '' THEN '' ELSE substr(pt, strpos(pt, num) + length(num)) END, '[^a-z]', '', 'g')", vocabulary.UNIT_SPELLINGS)[:-4]
    + " ELSE CASE WHEN pt LIKE 'x%' THEN 'item' ELSE 'unknown' END END"
)
_ATTRIBUTES_KEY = """CASE WHEN raw_attributes = '' THEN NULL WHEN temp IS NULL AND NOT room AND NOT light AND NOT dry AND shelf IS NULL THEN lower(raw_attributes)
    ELSE 'Attributes(storage_temperature_c=' || coalesce(CAST(temp AS VARCHAR), 'None') || ', room_temperature=' || CASE WHEN room THEN 'True' ELSE 'False' END
    || ', light_sensitive=' || CASE WHEN light THEN 'True' ELSE 'False' END || ', dry_ice_required=' || CASE WHEN dry THEN 'True' ELSE 'False' END
    || ', shelf_life_months=' || coalesce(CAST(shelf AS VARCHAR), 'None') || ', raw='''')' END"""


def _stated(field: str) -> str:
    return f"coalesce(arg_min({field}, n) FILTER (WHERE {field}_key IS NOT NULL), arg_min({field}, n))"


_RECORDS = f"""raw AS ({_RAW_SQL}),
    r1 AS (SELECT n, name, regexp_replace(regexp_replace(upper(trim(sku)), '[‐-―−]', '-', 'g'), ' *- *', '-', 'g') AS sku, manufacturer, category AS label,
        {_case("lower(regexp_replace(category, '\\s+', ' ', 'g'))", vocabulary.CATEGORY_SPELLINGS)} AS cat, package, lower(trim(package)) AS pt, price,
        regexp_extract(lower(price), '{_PRICE}', 1) AS amount_text, regexp_extract(lower(price), '{_PRICE}', 3) AS suffix,
        regexp_replace(attributes, '\\s+', ' ', 'g') AS raw_attributes, lower(regexp_replace(attributes, '\\s+', ' ', 'g')) AS t FROM raw),
    r2 AS (SELECT *, regexp_extract(pt, '[0-9]+([.,][0-9]+)?') AS num FROM r1),
    r3 AS (SELECT n, name, sku, manufacturer, label, cat, package AS raw_package, {_DIGITS.format("num")} AS quantity, {_UNIT} AS unit, price AS raw_price,
        {_DIGITS.format("amount_text")} AS amount, suffix, raw_attributes,
        TRY_CAST(nullif(regexp_extract(t, 'przechowywanie\\s*(-?[0-9]+)\\s*c\\b', 1), '') AS INTEGER) AS temp, regexp_matches(t, 'temp\\w*\\.?\\s*pokojowa') AS room,
        regexp_matches(t, 'chroni\\w*\\s+przed\\s+swiatlem') AS light, regexp_matches(t, 'such\\w+\\s+lod') AS dry,
        TRY_CAST(nullif(regexp_extract(t, 'termin waznosci\\s*([0-9]+)\\s*mies', 1), '') AS INTEGER) AS shelf FROM r2),
    seen AS (SELECT lower(name) AS folded, list(DISTINCT cat ORDER BY cat) AS cats FROM r3 WHERE cat IS NOT NULL GROUP BY 1),
    records AS (SELECT n, name, sku, manufacturer, CASE WHEN cat IS NULL AND len(cats) = 1 THEN cats[1] ELSE cat END AS category,
        CASE WHEN cat IS NOT NULL THEN 'row' WHEN len(cats) = 1 THEN 'inferred_from_product_name' ELSE 'missing' END AS category_source,
        raw_package, quantity, unit, raw_price, amount, suffix, raw_attributes, temp, room, light, dry, shelf, {_concat(
            _told("cat IS NULL AND label <> ''", "'unknown_category_label: ''' || label || ''' is not in CATEGORY_MAP'"),
            _told("unit = 'unknown'", "'package_unit_unknown: cannot read a unit from ''' || raw_package || ''''"),
            _told("amount IS NULL", "'price_missing: no price in ''' || raw_price || ''''"),
            _told("cat IS NULL AND coalesce(len(cats), 0) <> 1", "'category_missing: ' || CASE WHEN cats IS NULL THEN 'no other row with this name' ELSE "
                  "'ambiguous: [' || array_to_string(list_transform(cats, lambda x: '''' || x || ''''), ', ') || ']' END"))} AS issues
        FROM r3 LEFT JOIN seen ON folded = lower(name))"""

_CLASS = _case("package.unit", vocabulary.UNIT_CLASSES)
_PRODUCTS = f"""{_RECORDS},
    keyed AS (SELECT *, struct_pack(raw := raw_package, quantity := quantity, unit := unit) AS package, struct_pack(amount := amount, suffix := suffix) AS price,
        nullif(lower(name), '') AS name_key, nullif(lower(manufacturer), '') AS manufacturer_key, lower(category) AS category_key,
        CASE WHEN unit <> 'unknown' THEN coalesce(quantity, '?') || ' ' || unit WHEN quantity IS NOT NULL THEN quantity || ' unknown of ' || lower(raw_package) END AS package_key,
        amount || ' PLN' AS price_key, {_ATTRIBUTES_KEY} AS attributes_key FROM records),
    g AS (SELECT sku, min(n) AS first_row, {_stated("name")} AS name, {_stated("manufacturer")} AS manufacturer, {_stated("package")} AS package, {_stated("price")} AS price,
        coalesce(arg_min(struct_pack(c := category, s := category_source), n) FILTER (WHERE category IS NOT NULL), arg_min(struct_pack(c := category, s := category_source), n)) AS cat,
        arg_min(temp, n) FILTER (WHERE temp IS NOT NULL) AS temp, bool_or(room) AS room, bool_or(light) AS light, bool_or(dry) AS dry,
        arg_min(shelf, n) FILTER (WHERE shelf IS NOT NULL) AS shelf, coalesce(arg_min(raw_attributes, n) FILTER (WHERE raw_attributes <> ''), '') AS raw_attributes,
        list(n ORDER BY n) AS source_rows, flatten(list(issues ORDER BY n)) AS row_issues,
        {", ".join(f"list(DISTINCT {f}_key ORDER BY {f}_key) FILTER (WHERE {f}_key IS NOT NULL) AS {f}_said" for f in _FIELDS)} FROM keyed GROUP BY sku),
    merged AS (SELECT sku, first_row, name, manufacturer, cat.c AS category, cat.s AS category_source, package, price,
        struct_pack(temp := temp, room := room, light := light, dry := dry, shelf := shelf, raw := raw_attributes) AS attributes, source_rows, {_NONE} AS aliases,
        {_told("len(source_rows) > 1", "'exact duplicate SKU: merged rows [' || array_to_string(source_rows, ', ') || '] (first non-empty value per field)'")} AS notes,
        {_concat("row_issues", *[_told(f"len({f}_said) > 1", f"'duplicate_field_conflict: {f} differs between rows: [' || array_to_string(list_transform({f}_said, lambda x: "
                                       + _Q.format("x") + "), ', ') || ']'") for f in _FIELDS],
                 _told(f"cat.c IN ('LAB_PLASTICWARE', 'LAB_EQUIPMENT') AND {_CLASS} IN ('mass', 'volume')", "'package_unit_implausible: ' || cat.c || ' sold as ''' || package.raw || ''''"))} AS issues,
        nullif(lower(name), '') AS name_key, nullif(lower(manufacturer), '') AS manufacturer_key, lower(cat.c) AS category_key,
        CASE WHEN package.unit <> 'unknown' THEN coalesce(package.quantity, '?') || ' ' || package.unit
            WHEN package.quantity IS NOT NULL THEN package.quantity || ' unknown of ' || lower(package.raw) END AS package_key,
        price.amount || ' PLN' AS price_key, {_ATTRIBUTES_KEY} AS attributes_key FROM g),
    v AS (SELECT m.*, b.sku AS base, row_number() OVER (PARTITION BY b.sku ORDER BY m.first_row) AS turn FROM merged m
        JOIN merged b ON b.sku = regexp_extract(m.sku, '^([A-Z]{{2}}-[0-9]+)([A-Z]|-[0-9]+)$', 1)),
    folds AS (SELECT *, 0 AS turn, CAST(NULL AS VARCHAR) AS judged, {_NONE} AS differing FROM merged WHERE sku IN (SELECT base FROM v)
        UNION ALL SELECT sku, first_row, {", ".join(f"CASE WHEN joins AND {'category' if f.startswith('category') else f}_key IS NULL THEN v_{f} ELSE {f} END" for f in ("name", "manufacturer", "category", "category_source", "package", "price", "attributes"))},
        CASE WHEN joins THEN list_sort(list_concat(source_rows, v_source_rows)) ELSE source_rows END, CASE WHEN joins THEN list_append(aliases, v_sku) ELSE aliases END,
        CASE WHEN joins THEN list_append(list_concat(notes, v_notes), 'near-duplicate: ' || v_sku || ' kept as an alias of ' || sku || '; all normalized fields are identical') ELSE notes END,
        CASE WHEN joins THEN list_concat(issues, v_issues) ELSE issues END, {", ".join(f"CASE WHEN joins THEN coalesce({f}_key, v_{f}_key) ELSE {f}_key END" for f in _FIELDS)},
        v_turn, v_sku, differing2 FROM (SELECT *, len(differing2) = 0 AS joins FROM (SELECT f.*, {", ".join(f"v.{c} AS v_{c}" for c in ("sku", "turn", "name", "manufacturer", "category", "category_source", "package", "price", "attributes", "source_rows", "notes", "issues", *[f + "_key" for f in _FIELDS]))},
            {_concat(*[_told(f"f.{f}_key <> v.{f}_key", f"'{f}'") for f in _FIELDS])} AS differing2
            FROM folds f JOIN v ON v.base = f.sku AND v.turn = f.turn + 1))),
    refused AS (SELECT judged, sku AS base, differing FROM folds WHERE len(differing) > 0),
    products AS (SELECT sku, first_row, name, manufacturer, category, category_source, package, price, attributes, source_rows, aliases, notes, issues
            FROM folds f WHERE turn = (SELECT max(turn) FROM v WHERE v.base = f.sku)
        UNION ALL SELECT m.sku, first_row, name, manufacturer, category, category_source, package, price, attributes, source_rows, aliases, notes,
            CASE WHEN r.judged IS NULL THEN issues ELSE list_append(issues, 'variant_sku_not_merged: ' || m.sku || ' looks like a variant of ' || r.base || ' but ' || array_to_string(differing, ', ') || ' differ') END
            FROM merged m LEFT JOIN refused r ON r.judged = m.sku WHERE m.sku NOT IN (SELECT base FROM v) AND (r.judged IS NOT NULL OR m.sku NOT IN (SELECT sku FROM v)))"""

_CARD_NAME = f"lower(replace(replace(replace({_sql_nth(NAMES, 's_suppkey')}, 'ł', 'l'), 'Ł', 'L'), 'ź', 'z')) || ' ' || s_suppkey % 50"
_FOLDED = "lower(strip_accents(replace(replace({0}, 'ł', 'l'), 'Ł', 'L')))"
_ENRICHED = f"""{_PRODUCTS},
    cards AS (SELECT *, regexp_replace(regexp_replace(upper(sku), '[‐-―−]', '-', 'g'), ' *- *', '-', 'g') AS card FROM (SELECT s_suppkey AS at,
        CASE s_suppkey % 6 WHEN 0 THEN 'PA-' || s_suppkey WHEN 1 THEN 'pa – ' || (s_suppkey - 1) || 'A' WHEN 2 THEN 'PA-' || replace(replace(CAST(s_suppkey AS VARCHAR), '1', 'l'), '0', 'O')
            WHEN 3 THEN 'XX-' || s_suppkey WHEN 4 THEN 'PA-' || (s_suppkey - 4) ELSE 'PA-' || s_suppkey || '-2' END AS sku,
        CASE WHEN s_suppkey % 4 = 0 THEN {_CARD_NAME} WHEN s_suppkey % 7 = 5 THEN 'Maker''s card ' || s_suppkey ELSE s_name END AS name, 'cold text ' || s_suppkey AS description,
        CASE WHEN s_suppkey % 3 = 0 THEN '-20°C' ELSE '' END AS storage, CASE WHEN s_suppkey % 2 = 0 THEN 'RNA & cold' ELSE '' END AS applications FROM supplier)),
    ids AS (SELECT sku AS id, 'canonical' AS kind, sku FROM products UNION ALL SELECT unnest(aliases), 'alias', sku FROM products),
    hits AS (SELECT c.*, coalesce(e.id, x.id) AS matched, coalesce(e.sku, x.sku) AS product,
        CASE WHEN e.id IS NOT NULL THEN 'exact_sku' WHEN x.id IS NOT NULL THEN 'confusable_character_correction' END AS rule
        FROM cards c LEFT JOIN ids e ON e.id = c.card LEFT JOIN ids x ON e.id IS NULL AND x.id <> c.card
        AND x.id = substr(c.card, 1, 3) || replace(replace(replace(substr(c.card, 4), 'L', '1'), 'I', '1'), 'O', '0')),
    turns AS (SELECT h.*, p.name AS own, {_FOLDED.format("p.name")} = {_FOLDED.format("h.name")} AS same, row_number() OVER w AS turn, first_value(h.sku) OVER w AS winner
        FROM hits h JOIN products p ON p.sku = h.product WINDOW w AS (PARTITION BY h.product ORDER BY h.at)),
    said AS (SELECT product, flatten(list({_concat(
        _told("rule <> 'exact_sku'", "'snapshot SKU ''' || sku || ''' read as ' || matched || ' (confusable characters, unique catalogue hit) ' || CASE WHEN same THEN 'and' ELSE 'but' END "
              "|| ' the product name ' || " + _Q.format("name") + " || CASE WHEN same THEN ' matches ' ELSE ' differs from ' END || " + _Q.format("own")),
        _told("turn = 1 AND NOT same", "'manufacturer calls ' || matched || ' ' || " + _Q.format("name") + " || '; catalogue name kept as ' || " + _Q.format("own")))} ORDER BY turn)) AS card_notes,
        flatten(list({_told("turn > 1", "'snapshot_card_conflict: card ''' || sku || ''' also resolves to ' || matched || ', already enriched from ''' || winner || '''; kept the first'")} ORDER BY turn)) AS card_issues,
        arg_min(struct_pack(source_sku := sku, name := name, description := description, storage := storage, applications := applications, rule := rule), turn) AS card
        FROM turns GROUP BY product),
    enriched AS (SELECT p.* EXCLUDE (notes, issues), list_concat(notes, coalesce(card_notes, {_NONE})) AS notes, list_concat(issues, coalesce(card_issues, {_NONE})) AS issues, card
        FROM products p LEFT JOIN said ON product = p.sku)"""

_PACKAGE_TEXT = "coalesce(package.quantity, '?') || ' ' || package.unit"
_PRICE_TEXT = "CASE WHEN price.amount IS NULL THEN 'brak ceny' ELSE price.amount || ' PLN' || CASE WHEN price.suffix = '' THEN ' (waluta domyslna)' ELSE '' END END"
_SHOWN_SQL = f"""sku AS canonical_sku, name, manufacturer, category, category_source, {_PACKAGE_TEXT} AS package, {_PRICE_TEXT} AS price,
    attributes.temp AS storage_temperature_c, attributes.room AS room_temperature, attributes.light AS light_sensitive, attributes.dry AS dry_ice_required,
    attributes.shelf AS shelf_life_months, attributes.raw AS attributes, array_to_string(source_rows, ',') AS source_rows,
    array_to_string(aliases, ',') AS aliases, array_to_string(notes, ' | ') AS notes, array_to_string(issues, ' | ') AS issues"""


def _shown(products: DataFrame) -> list[Column]:
    flags = ("storage_temperature_c", "room_temperature", "light_sensitive", "dry_ice_required", "shelf_life_months")
    return [
        *[F.col(c) for c in ("canonical_sku", "name", "manufacturer", "category", "category_source")],
        parse.package_text(F.col("package")).alias("package"),
        parse.price_text(F.col("price")).alias("price"),
        *[F.col(f"attributes.{c}") for c in flags],
        F.col("attributes.raw").alias("attributes"),
        F.array_join(F.col("source_rows").cast("array<string>"), ",").alias("source_rows"),
        F.array_join("alias_skus", ",").alias("aliases"),
        F.array_join("resolution_notes", " | ").alias("notes"),
        F.array_join(F.transform("issues", parse.issue_text), " | ").alias("issues"),
    ]


# -- files and the build -------------------------------------------------------------------------


@query(f"SELECT n AS row_number, name, sku, manufacturer, category, package, price, attributes FROM ({_RAW_SQL})")
def csv_rows_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reader of raw rows: quotes, commas, line breaks, blanks and row numbers."""
    return csv_rows.read_rows(spark, _paths(spark, sf_dir)[0])


@query(
    f"""WITH {_RECORDS} SELECT n AS row_number, sku, name, manufacturer, category, category_source, coalesce(quantity, '?') || ' ' || unit AS package,
        CASE WHEN amount IS NULL THEN 'brak ceny' ELSE amount || ' PLN' || CASE WHEN suffix = '' THEN ' (waluta domyslna)' ELSE '' END END AS price,
        temp AS storage_temperature_c, raw_attributes AS attributes, array_to_string(issues, ' | ') AS issues FROM records"""
)
def catalogue_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalized rows with inferred categories and all issues."""
    return _built(spark, sf_dir).records.select(
        "row_number",
        "sku",
        "name",
        "manufacturer",
        "category",
        "category_source",
        parse.package_text(F.col("package")).alias("package"),
        parse.price_text(F.col("price")).alias("price"),
        "attributes.storage_temperature_c",
        F.col("attributes.raw").alias("attributes"),
        F.array_join(F.transform("issues", parse.issue_text), " | ").alias("issues"),
    )


@query(f"WITH RECURSIVE {_PRODUCTS} SELECT {_SHOWN_SQL} FROM products")
def catalogue_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The build without a page: rows merged by number, variants folded, conflicts and notes."""
    products = _built(spark, sf_dir, with_page=False).products
    return products.select(*_shown(products))


@query(
    f"""WITH RECURSIVE {_ENRICHED} SELECT {_SHOWN_SQL}, card.source_sku AS card_sku, card.name AS card_name, card.description AS description, card.storage AS storage,
        card.applications AS applications, card.rule AS match_rule, CASE WHEN card IS NULL THEN 'not_found_in_snapshot' ELSE 'enriched' END AS enrichment_status FROM enriched"""
)
def catalogue_enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole build: the first card of a product wins, later ones are conflicts, corrections and renames are noted."""
    products = _built(spark, sf_dir).products
    return products.select(
        *_shown(products),
        F.col("enrichment.source_sku").alias("card_sku"),
        F.col("enrichment.name").alias("card_name"),
        *[F.col(f"enrichment.{c}") for c in ("description", "storage", "applications", "match_rule")],
        "enrichment_status",
    )


@query(
    f"""WITH RECURSIVE {_ENRICHED} SELECT card AS sku, name, description, storage, applications, 'unmatched_external_candidate' AS status
        FROM hits WHERE matched IS NULL"""
)
def external_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards that match no product."""
    return _built(spark, sf_dir).external_candidates


@query(f"WITH RECURSIVE {_ENRICHED} SELECT id AS sku, kind, sku AS canonical_sku FROM ids")
def catalogue_by_sku(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every number that names a product."""
    return _built(spark, sf_dir).by_sku()


@query(
    f"""WITH RECURSIVE {_ENRICHED} SELECT hits.at AS ordinal, card AS card_sku, matched AS matched_sku, rule AS match_rule FROM hits"""
)
def card_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards against all numbers of the catalogue: exact, else one unique reading of mistaken characters."""
    names = _built(spark, sf_dir, with_page=False).by_sku()
    cards = _cards(spark, sf_dir).select(F.lit("page").alias("page"), F.col("at").alias("ordinal"), "sku", "name")
    return enrich.match_cards(cards, names).select("ordinal", "card_sku", "matched_sku", "match_rule")


# -- the store ------------------------------------------------------------------------------------

_LETTERS = LetterCounts().letters
_VECTOR = "[" + ", ".join(f"1.0 + length(t) - length(replace(t, '{c}', ''))" for c in _LETTERS) + "]"
_UNIT_OF = "list_transform({0}, lambda y: y / sqrt(list_dot_product({0}, {0})))"
_SEARCHABLE = f"""{_ENRICHED},
    texts AS (SELECT sku, unnest([struct_pack(field := 'name', t := name), struct_pack(field := 'manufacturer', t := manufacturer),
        struct_pack(field := 'category', t := {_case("category", vocabulary.CATEGORY_LABELS)}), struct_pack(field := 'description', t := card.description),
        struct_pack(field := 'applications', t := card.applications)], recursive := true) FROM enriched),
    fields AS (SELECT sku, field, text, {_UNIT_OF.format("x")} AS vector FROM (SELECT sku, field, t AS text, CAST({_VECTOR.replace("(t", "(lower(t)")} AS DOUBLE[]) AS x FROM texts WHERE t <> '')),
    means AS (SELECT sku, {_UNIT_OF.format("x")} AS vector FROM (SELECT sku,
        list_reduce(list(vector ORDER BY field), lambda a, b: list_transform(list_zip(a, b), lambda z: z[1] + z[2])) AS x FROM fields GROUP BY sku))"""


def _search_sql(text: str, limit: int, manufacturer: str = "", category: str = "") -> str:
    asked = [1.0 + text.lower().count(c) for c in _LETTERS]
    vector = _UNIT_OF.format(f"CAST({asked} AS DOUBLE[])")
    conditions = [f"contains({_FOLDED.format('manufacturer')}, '{manufacturer}')"] * bool(manufacturer) + [f"category = '{category}'"] * bool(category)
    return f"""{_SEARCHABLE}, asked AS (SELECT {vector} AS q),
        top AS (SELECT e.*, list_dot_product(m.vector, q) AS score FROM enriched e JOIN means m USING (sku), asked
            {"WHERE " + " AND ".join(conditions) if conditions else ""} ORDER BY score DESC, sku LIMIT {limit}),
        drivers AS (SELECT sku, string_agg(field || ' ' || printf('%.2f', s), ', ' ORDER BY place) AS drivers FROM (SELECT sku, field, list_dot_product(vector, q) AS s,
            row_number() OVER (PARTITION BY sku ORDER BY list_dot_product(vector, q) DESC, field) AS place FROM fields, asked WHERE sku IN (SELECT sku FROM top)) WHERE place <= 2 GROUP BY sku)"""


def _explained(filters: str = "") -> str:
    return f"""'score ' || printf('%.2f', score) || ' (cosine similarity, not a probability) - strongest fields: ' || drivers
        || CASE WHEN category IS NULL THEN '' ELSE ' - category ' || category || CASE WHEN category_source = 'inferred_from_product_name' THEN ' (inferred)' ELSE '' END END
        || CASE WHEN card IS NULL THEN '' ELSE ' - description harvested from the manufacturer''s page' END || '{" - passed filter: " + filters if filters else ""}'"""


def _hits(found: DataFrame) -> DataFrame:
    return found.select("canonical_sku", F.round("score", 6).alias("score"), "match_type", "explanation")


@query(
    f"""WITH RECURSIVE {_search_sql("cold kit for RNA", 10)} SELECT sku AS canonical_sku, round(score, 6) AS score, 'semantic' AS match_type,
        {_explained()} AS explanation FROM top JOIN drivers USING (sku)"""
)
def store_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No number: cosine top-k over the product vectors, with the strongest fields of each hit."""
    return _hits(_store(spark, sf_dir).search("cold kit for RNA", limit=10))


@query(
    f"""WITH RECURSIVE {_search_sql("analytical balance", 7, "lodz", "LAB_EQUIPMENT")} SELECT sku AS canonical_sku, round(score, 6) AS score,
        'semantic' AS match_type, {_explained("łódź, lab_equipment")} AS explanation FROM top JOIN drivers USING (sku)"""
)
def store_search_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filters come before the ranking; the manufacturer's is a folded substring."""
    return _hits(_store(spark, sf_dir).search("analytical balance", " łódź ", "lab_equipment", limit=7))


_EXACT_SQL = """SELECT sku AS canonical_sku, 1.0::DOUBLE AS score, 'exact_sku' AS match_type, 'score 1.00 - ' || CASE WHEN kind = 'canonical'
    THEN 'exact match on catalogue number ' || id ELSE id || ' is a registered alias of ' || sku END AS explanation FROM ids"""
_ALIAS = "(SELECT coalesce(min(id) FILTER (WHERE kind = 'alias'), min(id)) FROM ids)"


def _alias(store: CatalogueStore) -> str:
    """The first alias in the order of texts, or the first number where there is none."""
    names = store.identifiers()
    told = names.agg(F.min(F.when(F.col("kind") == "alias", F.col("sku"))).alias("alias"), F.min("sku").alias("any")).collect()[0]
    return told["alias"] or told["any"]


@query(f"WITH RECURSIVE {_ENRICHED} {_EXACT_SQL} WHERE id = {_ALIAS}")
def store_search_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A known number, however it is written, gives its product and no ranking."""
    store = _store(spark, sf_dir)
    return _hits(store.search(f"  {_alias(store).lower().replace('-', ' – ')}"))


@query(f"WITH RECURSIVE {_ENRICHED} {_EXACT_SQL} JOIN products USING (sku) WHERE id = 'PA-1' AND category = 'NUCLEIC_ACID_ISOLATION'")
def store_search_exact_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An exact hit that a filter removes gives nothing: there is no fallback to similarity."""
    return _hits(_store(spark, sf_dir).search("PA-1", category="nucleic_acid_isolation"))


_DIMS = ", ".join(f"round(vector[{i + 1}], 6) AS v{i}" for i in range(len(_LETTERS)))


@query(f"WITH RECURSIVE {_SEARCHABLE} SELECT sku AS canonical_sku, field, text, {_DIMS} FROM fields")
def store_field_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The searchable fields of each product and their unit vectors, as stored."""
    stored = _store(spark, sf_dir).field_vectors()
    return stored.select("canonical_sku", "field", "text", *[F.round(F.col("vector")[i], 6).alias(f"v{i}") for i in range(len(_LETTERS))])


@query(f"WITH RECURSIVE {_SEARCHABLE} SELECT sku AS canonical_sku, {_DIMS} FROM means")
def store_product_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The normalized mean of each product's fields, as stored."""
    stored = _store(spark, sf_dir).product_vectors()
    return stored.select("canonical_sku", *[F.round(F.col("vector")[i], 6).alias(f"v{i}") for i in range(len(_LETTERS))])


@query(f"WITH RECURSIVE {_RECORDS} SELECT n AS row_number, sku, category_source, len(issues) AS n_issues FROM records")
def store_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lineage that a seeded store keeps."""
    return _store(spark, sf_dir).records().select("row_number", "sku", "category_source", F.size("issues").cast("bigint").alias("n_issues"))


@query(f"WITH RECURSIVE {_ENRICHED} SELECT card AS sku, name, description, storage, applications FROM hits WHERE matched IS NULL")
def store_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _store(spark, sf_dir).candidates().drop("status")


@query(
    f"""WITH RECURSIVE {_PRODUCTS} SELECT unnest(['schema_version', 'schema_id', 'embedding_model', 'embedding_recipe', 'dimensions', 'seeded', 'products']) AS key,
        unnest(['1', 'shelfmark-catalogue', 'letter-counts', 'unit-field-mean/1', '{len(_LETTERS)}', 'true', CAST((SELECT count(*) FROM products) AS VARCHAR)]) AS value"""
)
def store_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the manifest says, read by a store that is opened again; seeding it once more changes nothing."""
    first = _store(spark, sf_dir)
    again = CatalogueStore(spark, first.path, LetterCounts())
    again.seed(_built(spark, sf_dir))
    told = again.metadata() | {"products": again.count_products()}
    return spark.createDataFrame([(k, str(v).lower() if isinstance(v, bool) else str(v)) for k, v in told.items()], "key string, value string")


def _changed(spark: SparkSession, sf_dir: str) -> CatalogueStore:
    """A store of its own, seeded with the products of the shared one, after two adds and a delete by alias."""
    key = (spark.sparkContext.applicationId, f"{sf_dir} changed")
    if key in _stores:
        return _stores[key]
    first = _store(spark, sf_dir)
    seeded = Catalogue(first.products().drop("product_id", "manufacturer_folded", "source_kind", "created_at"), first.candidates(), first.records())
    store = CatalogueStore(spark, workspace.new_folder(spark, "store"), LetterCounts())
    store.seed(seeded)
    store.add(ProductInput(" zz – 1", " New  thing ", "Maker", "pcr_reagent", "5 g", "10", description="cold stuff"))
    store.add(ProductInput("ZZ-2", "Other", "Łódź", package="5 -"))
    store.delete(_alias(first).lower())
    _stores[key] = store
    return store


_GONE = f"(SELECT sku FROM ids WHERE id = {_ALIAS})"


@query(
    f"""WITH RECURSIVE {_ENRICHED} SELECT sku AS canonical_sku, name, category, {_PACKAGE_TEXT} AS package, {_PRICE_TEXT} AS price, array_to_string(aliases, ',') AS aliases,
        'seed' AS source_kind, CASE WHEN card IS NULL THEN 'not_found_in_snapshot' ELSE 'enriched' END AS enrichment_status, array_to_string(issues, ' | ') AS issues FROM enriched WHERE sku <> {_GONE}
        UNION ALL SELECT 'ZZ-1', 'New thing', 'PCR_REAGENT', '5 gram', '10 PLN (waluta domyslna)', '', 'runtime', 'enriched', ''
        UNION ALL SELECT 'ZZ-2', 'Other', NULL, '5 unknown', 'brak ceny', '', 'runtime', 'not_found_in_snapshot',
        'package_unit_unknown: cannot read a unit from ''5 -'' | price_missing: no price in '''''"""
)
def store_after_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products after adds at run time and a delete by alias."""
    return _changed(spark, sf_dir).products().select(
        "canonical_sku",
        "name",
        "category",
        parse.package_text(F.col("package")).alias("package"),
        parse.price_text(F.col("price")).alias("price"),
        F.array_join("alias_skus", ",").alias("aliases"),
        "source_kind",
        "enrichment_status",
        F.array_join(F.transform("issues", parse.issue_text), " | ").alias("issues"),
    )


@query(
    f"""WITH RECURSIVE {_ENRICHED} SELECT 'seed' AS action, CAST(NULL AS VARCHAR) AS canonical_sku, true AS dated, CAST((SELECT count(*) FROM products) AS VARCHAR) AS told
        UNION ALL SELECT 'add', 'ZZ-1', true, 'New thing' UNION ALL SELECT 'add', 'ZZ-2', true, 'Other'
        UNION ALL SELECT 'delete', sku, true, name FROM products WHERE sku = {_GONE}"""
)
def store_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit log: every change with its time and, for a delete, the whole product."""
    path = F.when(F.col("action") == "seed", "$.products").when(F.col("action") == "add", "$.name").otherwise("$.product.name")
    told = F.coalesce(*[F.when(path == p, F.get_json_object("payload_json", p)) for p in ("$.products", "$.name", "$.product.name")])
    dated = F.col("occurred_at").rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?\+00:00$")
    return _changed(spark, sf_dir).events().select("action", "canonical_sku", dated.alias("dated"), told.alias("told"))


# -- the HTTP surface -------------------------------------------------------------------------------

_API_COLUMNS = "sku string, aliases string, name string, manufacturer string, category string, package string, price string, score double, match_type string, explanation string"


@query(
    f"""WITH RECURSIVE {_search_sql("cold box", 10)} SELECT sku, array_to_string(aliases, ',') AS aliases, name, manufacturer, category, {_PACKAGE_TEXT} AS package,
        {_PRICE_TEXT} AS price, round(score, 6) AS score, 'semantic' AS match_type, {_explained()} AS explanation FROM top JOIN drivers USING (sku)"""
)
def api_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GET /api/search with its default limit, as clients see it."""
    status, body = Api(lambda: _store(spark, sf_dir)).respond("GET", "/api/search", "q=cold+box")
    rows = [tuple(",".join(v) if k == "aliases" else round(v, 6) if k == "score" else v for k, v in hit.items()) for hit in body["results"]]
    return spark.createDataFrame(rows if status == 200 else [], _API_COLUMNS)


@query(
    """SELECT unnest(['blank search', 'bad limit', 'no name', 'unknown category', 'taken number', 'unknown number', 'wrong method', 'no such path']) AS request,
        unnest([200, 422, 422, 422, 409, 404, 405, 404]) AS status"""
)
def api_refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the HTTP surface answers to requests that it refuses; none of them changes the store."""
    api = Api(lambda: _store(spark, sf_dir))
    post = lambda body: ("POST", "/api/products", "", body)
    requests = {
        "blank search": ("GET", "/api/search", "q=+"),
        "bad limit": ("GET", "/api/search", "q=a&limit=x"),
        "no name": post(b'{"sku": "Z-1", "name": " ", "manufacturer": "m"}'),
        "unknown category": post(b'{"sku": "Z-1", "name": "n", "manufacturer": "m", "category": "OTHER"}'),
        "taken number": post(b'{"sku": "pa-1", "name": "n", "manufacturer": "m"}'),
        "unknown number": ("DELETE", "/api/products/none-1"),
        "wrong method": ("PUT", "/api/products"),
        "no such path": ("GET", "/nothing"),
    }
    return spark.createDataFrame([(name, api.respond(*r)[0]) for name, r in requests.items()], "request string, status int")


@query(
    """SELECT r_regionkey AS key, 201 AS added, 'RG-' || r_regionkey AS sku, trim(r_name) AS name, '5 gram' AS package, 409 AS added_again,
        1 AS found, 200 AS deleted, 'RG-' || r_regionkey AS deleted_sku, 404 AS deleted_again, 0 AS found_then FROM region"""
)
def api_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """POST and DELETE for each row of a table: what succeeds, what clients see of it, and that doing it twice is refused."""
    api = Api(lambda: CatalogueStore(spark, workspace.new_folder(spark, "store"), LetterCounts()))
    rows = _read(spark, sf_dir, "region").orderBy("r_regionkey").collect()  # a handful of regions
    number = lambda r: f"RG-{r['r_regionkey']}"
    told = {r["r_regionkey"]: [] for r in rows}
    for turn in range(2):
        for r in rows:
            body = {"sku": f" {number(r).lower()} ", "name": r["r_name"], "manufacturer": "Acme", "package": "5 g"}
            code, made = api.respond("POST", "/api/products", body=json.dumps(body).encode())
            told[r["r_regionkey"]] += [code] if turn else [code, made["product"]["sku"], made["product"]["name"], made["product"]["package"]]
    found = lambda r: len(api.respond("GET", "/api/search", f"q={number(r)}")[1]["results"][:1])
    for turn in range(2):
        for r in rows:
            if not turn:
                told[r["r_regionkey"]].append(found(r))
            code, gone = api.respond("DELETE", f"/api/products/{number(r)}")
            told[r["r_regionkey"]] += [code] if turn else [code, gone["deleted_sku"]]
    out = [(key, *values, found(r)) for (key, values), r in zip(told.items(), rows, strict=True)]
    return spark.createDataFrame(
        out,
        "key int, added int, sku string, name string, package string, added_again int, found int, deleted int, deleted_sku string, deleted_again int, found_then int",
    )
