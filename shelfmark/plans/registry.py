"""The engine's registered queries over the star-schema tables, and the SQL that each must agree with.

The tables hold no catalogue, so each query derives the columns that its operator needs. All run
over whole tables; a limit is there only where it is the operator (top-k).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.functions import parse, text, vocabulary
from shelfmark.operators import enrich, normalize, resolve, vectors
from shelfmark.operators import search as ranking
from shelfmark.sources import html_cards
from shelfmark.streaming import state

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def query(sql: str | None) -> Callable[[Query], Query]:
    def keep(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if sql:
            ORACLE_SQL[function.__name__] = sql
        return function

    return keep


def _nth(choices: list[str], key: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, choices)), (F.pmod(key, F.lit(len(choices))) + 1).cast("int"))


def _sql_nth(choices: list[str], key: str) -> str:
    quoted = ", ".join("'" + c.replace("'", "''") + "'" for c in choices)
    return f"([{quoted}])[({key}) % {len(choices)} + 1]"


# -- text and parsers ------------------------------------------------------------------------


@query(
    r"""SELECT doc_id, md5(trim(regexp_replace(text, '[\s\p{Z}\x1c-\x1f\x0b\x85]+', ' ', 'g'))) AS text_md5,
        CAST(length(trim(regexp_replace(text, '[\s\p{Z}\x1c-\x1f\x0b\x85]+', ' ', 'g'))) AS BIGINT) AS n FROM documents"""
)
def text_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = text.squash(F.col("text"))
    return _read(spark, sf_dir, "documents").select(
        "doc_id", F.md5(flat).alias("text_md5"), F.length(flat).cast("bigint").alias("n")
    )


SKUS = ["ch-10248", " Ch – 10248a", "bi-10220 - 1", "NO−103  16"]


@query(
    f"""SELECT p_partkey, trim(regexp_replace(regexp_replace(regexp_replace(upper(
        {_sql_nth(SKUS, 'p_partkey')} || ' ' || p_brand), '[‐-―−]', '-', 'g'), '\\s*-\\s*', '-', 'g'), '\\s+', ' ', 'g')) AS sku
        FROM part"""
)
def sku_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat_ws(" ", _nth(SKUS, F.col("p_partkey")), "p_brand")
    return _read(spark, sf_dir, "part").select("p_partkey", text.sku_form(raw).alias("sku"))


@query(
    """SELECT lower(replace(strip_accents(replace(replace(w, 'ł', 'l'), 'Ł', 'L')), 'ß', 'ss')) AS folded,
        count(*) AS n FROM (SELECT unnest(string_split(text, ' ')) AS w FROM documents) GROUP BY 1"""
)
def fold_key_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fold runs once per distinct word: the first count shrinks what goes through Arrow."""
    words = _read(spark, sf_dir, "documents").select(F.explode(F.split("text", " ", -1)).alias("w"))
    distinct = words.groupBy("w").agg(F.count("*").alias("n"))
    return distinct.withColumn("folded", text.fold(F.col("w"))).groupBy("folded").agg(F.sum("n").alias("n"))


LABELS = list(vocabulary.CATEGORY_SPELLINGS) + ["", " PCR   Reagents ", "unheard of"]


@query(
    "SELECT p_partkey, CASE label "
    + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in vocabulary.CATEGORY_SPELLINGS.items())
    + f""" END AS category FROM (SELECT p_partkey,
        lower(trim(regexp_replace({_sql_nth(LABELS, 'p_partkey')}, '\\s+', ' ', 'g'))) AS label FROM part)"""
)
def vocab_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = _nth(LABELS, F.col("p_partkey"))
    return _read(spark, sf_dir, "part").select("p_partkey", parse.category_of(label).alias("category"))


PACKAGES = ["x{}", "{} szt.", "{},5 ml", "{} rxn", "{}-pack", "{} -", "{} butelek", "", "xyz", "0{} kg"]


def _packages() -> Column:
    return F.replace(_nth(PACKAGES, F.col("p_partkey")), F.lit("{}"), F.col("p_size").cast("string"))


_PACKAGE_SQL = f"""SELECT p_partkey, p_size, replace({_sql_nth(PACKAGES, 'p_partkey')}, '{{}}', CAST(p_size AS VARCHAR)) AS raw FROM part"""
_UNIT_CASE = (
    "CASE regexp_replace(CASE WHEN num = '' THEN '' ELSE substr(t, strpos(t, num) + length(num)) END, '[^a-z]', '', 'g') "
    + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in vocabulary.UNIT_SPELLINGS.items())
    + " ELSE CASE WHEN t LIKE 'x%' THEN 'item' ELSE 'unknown' END END"
)
_PARSED_SQL = f"""SELECT p_partkey, raw, nullif(regexp_replace(replace(num, ',', '.'), '^0+([0-9])', '\\1'), '') AS quantity,
    {_UNIT_CASE} AS unit FROM (SELECT *, regexp_extract(t, '[0-9]+([.,][0-9]+)?') AS num
    FROM (SELECT *, lower(trim(raw)) AS t FROM ({_PACKAGE_SQL})))"""
_CLASS_CASE = "CASE unit " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in vocabulary.UNIT_CLASSES.items()) + " END"


@query(f"SELECT p_partkey, quantity, unit, {_CLASS_CASE} AS unit_class, coalesce(quantity, '?') || ' ' || unit AS shown FROM ({_PARSED_SQL})")
def quantity_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = _packages()
    package = parse.package_of(raw, text.casefold(text.squash(raw)))
    parsed = _read(spark, sf_dir, "part").select("p_partkey", package.alias("p"))
    return parsed.select(
        "p_partkey",
        F.col("p.quantity_text").alias("quantity"),
        "p.unit",
        "p.unit_class",
        parse.package_text(F.col("p")).alias("shown"),
    )


PRICES = ["{}", "{},50 PLN", "1 {} zl", "EUR {}", "-{} PLN", "{}.25 ZŁ", "", "{} PLN plus VAT", "00{} pln"]
_PRICE = r"^([0-9][0-9 ]*([.,][0-9]+)?)\s*(pln|zl|zł)?$"


@query(
    f"""SELECT p_partkey, amount, CASE WHEN amount IS NOT NULL THEN 'PLN' END AS currency,
        amount IS NOT NULL AND suffix = '' AS currency_inferred,
        CASE WHEN amount IS NULL THEN 'brak ceny' ELSE amount || ' PLN' || CASE WHEN suffix = '' THEN ' (waluta domyslna)' ELSE '' END END AS shown
        FROM (SELECT p_partkey, nullif(regexp_replace(replace(replace(regexp_extract(raw, '{_PRICE}', 1), ' ', ''), ',', '.'), '^0+([0-9])', '\\1'), '') AS amount,
        regexp_extract(raw, '{_PRICE}', 3) AS suffix FROM (SELECT p_partkey,
        lower(replace({_sql_nth(PRICES, 'p_partkey')}, '{{}}', CAST(p_size AS VARCHAR))) AS raw FROM part))"""
)
def price_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.replace(_nth(PRICES, F.col("p_partkey")), F.lit("{}"), F.col("p_size").cast("string"))
    parsed = _read(spark, sf_dir, "part").select("p_partkey", parse.price_of(raw).alias("p"))
    return parsed.select(
        "p_partkey",
        F.col("p.amount_text").alias("amount"),
        "p.currency",
        "p.currency_inferred",
        parse.price_text(F.col("p")).alias("shown"),
    )


PHRASES = [
    "Przechowywanie -20 C, chronic przed swiatlem",
    "temp. pokojowa",
    "wymaga suchego lodu; termin waznosci 12 mies.",
    "przechowywanie 4 c",
    "",
    "bez uwag",
]


@query(
    f"""SELECT p_partkey, TRY_CAST(nullif(regexp_extract(t, 'przechowywanie\\s*(-?[0-9]+)\\s*c\\b', 1), '') AS INTEGER) AS storage_temperature_c,
        regexp_matches(t, 'temp\\w*\\.?\\s*pokojowa') AS room_temperature,
        regexp_matches(t, 'chroni\\w*\\s+przed\\s+swiatlem') AS light_sensitive,
        regexp_matches(t, 'such\\w+\\s+lod') AS dry_ice_required,
        TRY_CAST(nullif(regexp_extract(t, 'termin waznosci\\s*([0-9]+)\\s*mies', 1), '') AS INTEGER) AS shelf_life_months,
        t = 'bez uwag' AS understood_nothing
        FROM (SELECT p_partkey, lower({_sql_nth(PHRASES, 'p_partkey')}) AS t FROM part)"""
)
def flag_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = _nth(PHRASES, F.col("p_partkey"))
    parsed = _read(spark, sf_dir, "part").select("p_partkey", parse.attributes_of(raw, text.casefold(text.squash(raw))).alias("a"))
    return parsed.select("p_partkey", "a.*", parse.understood_nothing(F.col("a")).alias("understood_nothing")).drop("raw")


@query(
    f"""SELECT p_partkey, array_to_string(list_concat(
        CASE WHEN unit = 'unknown' THEN ['package_unit_unknown: cannot read a unit from ''' || raw || ''''] ELSE CAST([] AS VARCHAR[]) END,
        CASE WHEN p_partkey % 3 = 0 AND {_CLASS_CASE} IN ('mass', 'volume') THEN ['package_unit_implausible: LAB_EQUIPMENT sold as ''' || raw || ''''] ELSE CAST([] AS VARCHAR[]) END
        ), ' | ') AS issues FROM ({_PARSED_SQL})"""
)
def issue_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = _packages()
    category = F.when(F.col("p_partkey") % 3 == 0, "LAB_EQUIPMENT").otherwise("LAB_CHEMICAL")
    parsed = _read(spark, sf_dir, "part").select(
        "p_partkey", category.alias("category"), parse.package_of(raw, text.casefold(text.squash(raw))).alias("package")
    )
    unread = F.concat(F.lit("cannot read a unit from "), text.quoted(F.col("package.raw")))
    found = parse.issues(
        (F.col("package.unit") == "unknown", "package_unit_unknown", unread),
        parse.implausible_package(F.col("category"), F.col("package")),
    )
    return parsed.select("p_partkey", F.array_join(F.transform(found, parse.issue_text), " | ").alias("issues"))


# -- inference, merging, variants ---------------------------------------------------------------


@query(
    """WITH t AS (SELECT p_partkey, p_name, CASE WHEN p_partkey % 4 <> 0 THEN p_type END AS kind FROM part),
        seen AS (SELECT p_name, count(DISTINCT kind) AS k, min(kind) AS only_kind FROM t WHERE kind IS NOT NULL GROUP BY 1)
        SELECT p_partkey, CASE WHEN kind IS NULL AND k = 1 THEN only_kind ELSE kind END AS kind,
        CASE WHEN kind IS NOT NULL THEN 'row' WHEN k = 1 THEN 'inferred' WHEN k > 1 THEN 'ambiguous' ELSE 'missing' END AS how
        FROM t LEFT JOIN seen USING (p_name)"""
)
def infer_unique_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = _read(spark, sf_dir, "part").select(
        "p_partkey", "p_name", F.when(F.col("p_partkey") % 4 != 0, F.col("p_type")).alias("kind")
    )
    seen = normalize.infer_unique(parts, F.col("p_name"), "kind")
    known, stated = F.coalesce(F.size("__seen"), F.lit(0)), F.col("kind").isNotNull()
    how = F.when(stated, "row").when(known == 1, "inferred").when(known > 1, "ambiguous").otherwise("missing")
    value = F.when(~stated & (known == 1), F.col("__seen")[0]).otherwise(F.col("kind"))
    return seen.select("p_partkey", value.alias("kind"), how.alias("how"))


@query(
    """SELECT md5(text) AS text_md5, min(doc_id) AS first_doc, arg_min(lang, doc_id) FILTER (WHERE lang <> 'en') AS first_lang,
        arg_min(source, doc_id) AS source, count(*) AS n FROM documents GROUP BY text"""
)
def dedupe_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First stated value per group. Groups are by digest, so texts do not travel."""
    docs = _read(spark, sf_dir, "documents").select(F.md5("text").alias("text_md5"), "doc_id", "lang", "source")
    return docs.groupBy("text_md5").agg(
        F.min("doc_id").alias("first_doc"),
        F.expr("min_by(lang, doc_id) FILTER (WHERE lang <> 'en')").alias("first_lang"),
        F.min_by("source", "doc_id").alias("source"),
        F.count("*").alias("n"),
    )


_VARIANT_SKU = """'PA-' || CAST(p_partkey // 4 AS VARCHAR) || (['', 'A', '-2', '-3X'])[p_partkey % 4 + 1]"""


def _variant_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    sku = F.concat(F.lit("PA-"), F.expr("p_partkey div 4").cast("string"), _nth(["", "A", "-2", "-3X"], F.col("p_partkey")))
    return _read(spark, sf_dir, "part").withColumn("sku", sku)


@query(
    f"""WITH p AS (SELECT p_partkey, {_VARIANT_SKU} AS sku, 'PA-' || p_partkey // 4 AS base,
            CASE WHEN p_partkey % 3 <> 0 THEN CAST(p_size % 2 AS VARCHAR) END AS price FROM part),
        s0 AS (SELECT p_partkey, sku, price FROM p WHERE p_partkey % 4 = 0),
        s1 AS (SELECT s0.*, v.sku AS a, s0.price IS NULL OR v.price IS NULL OR s0.price = v.price AS ok_a, v.price AS pa
            FROM s0 LEFT JOIN p v ON v.p_partkey = s0.p_partkey + 1),
        s2 AS (SELECT s1.*, CASE WHEN a IS NOT NULL AND ok_a THEN coalesce(price, pa) ELSE price END AS p1 FROM s1),
        s3 AS (SELECT s2.*, v.sku AS c, p1 IS NULL OR v.price IS NULL OR p1 = v.price AS ok_c, v.price AS pc
            FROM s2 LEFT JOIN p v ON v.p_partkey = s2.p_partkey + 2)
        SELECT sku AS canonical_sku, concat_ws(',', CASE WHEN ok_a THEN a END, CASE WHEN ok_c THEN c END) AS aliases,
            CASE WHEN c IS NOT NULL AND ok_c THEN coalesce(p1, pc) ELSE p1 END AS price FROM s3
        UNION ALL SELECT a, '', pa FROM s3 WHERE a IS NOT NULL AND NOT ok_a
        UNION ALL SELECT c, '', pc FROM s3 WHERE c IS NOT NULL AND NOT ok_c
        UNION ALL SELECT sku, '', price FROM p WHERE p_partkey % 4 = 3
        UNION ALL SELECT sku, '', price FROM p WHERE p_partkey % 4 IN (1, 2) AND base NOT IN (SELECT sku FROM s0)"""
)
def variant_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ordered fold alone: later variants meet the base as earlier ones left it."""
    raw = F.when(F.col("p_partkey") % 3 != 0, (F.col("p_size") % 2).cast("string")).otherwise("")
    none = F.array().cast("array<string>")
    products = _variant_parts(spark, sf_dir).select(
        F.col("sku").alias("canonical_sku"),
        F.col("p_partkey").alias("first_row"),
        F.lit("Item").alias("name"),
        F.lit("Maker").alias("manufacturer"),
        F.lit("LAB_EQUIPMENT").alias("category"),
        F.lit("row").alias("category_source"),
        parse.package_of(F.lit("x5"), F.lit("x5")).alias("package"),
        parse.price_of(raw).alias("price"),
        parse.attributes_of(F.lit(""), F.lit("")).alias("attributes"),
        F.array("p_partkey").alias("source_rows"),
        none.alias("alias_skus"),
        none.alias("resolution_notes"),
        F.array().cast(f"array<{parse.ISSUE}>").alias("issues"),
    )
    folded = resolve.fold_variants(products)
    return folded.select("canonical_sku", F.array_join("alias_skus", ",").alias("aliases"), F.col("price.amount_text").alias("price"))


_KINDS = ["pomiary", "", "odczynniki"]


@query(
    f"""WITH r AS (SELECT p_partkey AS k, 'PA-' || p_partkey // 3 AS sku, p_brand, CASE {_sql_nth(_KINDS, "p_partkey // 2")} WHEN 'pomiary' THEN 'LAB_EQUIPMENT'
            WHEN 'odczynniki' THEN 'LAB_CHEMICAL' END AS cat, CASE WHEN p_partkey % 4 <> 0 THEN p_size || ' PLN' END AS price,
            p_partkey % {len(PHRASES)} AS phrase FROM part)
        SELECT sku AS canonical_sku, min(k) + 1 AS first_row, arg_min(p_brand, k) AS manufacturer, arg_min(cat, k) FILTER (WHERE cat IS NOT NULL) AS category,
            coalesce(arg_min(price, k) FILTER (WHERE price IS NOT NULL), 'brak ceny') AS price, bool_or(phrase = 2) AS dry_ice_required,
            CAST(arg_min(CASE phrase WHEN 0 THEN -20 ELSE 4 END, k) FILTER (WHERE phrase IN (0, 3)) AS INTEGER) AS storage_temperature_c, count(*) AS n_rows,
            CAST((count(DISTINCT p_brand) > 1)::INT + (count(DISTINCT cat) > 1)::INT + (count(DISTINCT price) > 1)::INT
            + (count(DISTINCT CASE WHEN phrase <> 4 THEN phrase END) > 1)::INT AS BIGINT) AS conflicts FROM r GROUP BY sku"""
)
def merge_same_sku(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of one number merged by the operator itself, over rows made of the part table."""
    key = F.col("p_partkey")
    rows = _read(spark, sf_dir, "part").select(
        (key + 1).alias("row_number"),
        F.lit("Item").alias("name"),
        F.concat(F.lit("PA-"), F.expr("p_partkey div 3").cast("string")).alias("sku"),
        F.col("p_brand").alias("manufacturer"),
        _nth(_KINDS, F.expr("p_partkey div 2")).alias("category"),
        F.lit("x5").alias("package"),
        F.when(key % 4 != 0, F.concat(F.col("p_size").cast("string"), F.lit(" PLN"))).otherwise("").alias("price"),
        _nth(PHRASES, key).alias("attributes"),
    )
    merged = resolve.merge_same_sku(normalize.normalize_rows(rows))
    return merged.select(
        "canonical_sku",
        "first_row",
        "manufacturer",
        "category",
        parse.price_text(F.col("price")).alias("price"),
        "attributes.dry_ice_required",
        "attributes.storage_temperature_c",
        F.size("source_rows").cast("bigint").alias("n_rows"),
        F.size(F.filter("issues", lambda i: i["code"] == "duplicate_field_conflict")).cast("bigint").alias("conflicts"),
    )


# -- cards ------------------------------------------------------------------------------------


@query(
    """SELECT page_id, regexp_extract(html, '<h1>([^<]*)</h1>', 1) AS h1,
        CAST(len(regexp_extract_all(html, '<li>')) AS BIGINT) AS n_items FROM pages"""
)
def html_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regular markup needs no parser: native expressions over the page."""
    return _read(spark, sf_dir, "pages").select(
        "page_id",
        F.regexp_extract("html", "<h1>([^<]*)</h1>", 1).alias("h1"),
        F.regexp_count("html", F.lit("<li>")).cast("bigint").alias("n_items"),
    )


def _supplier_page() -> Column:
    """One page per supplier with two cards; the second has no specification list."""
    key = F.col("s_suppkey").cast("string")
    return F.concat(
        F.lit("<html><div class='product-card x' data-sku='SU-"), key, F.lit("'><h2 class='product-name'>A &lt;"), key,
        F.lit("&gt;</h2><p class='product-desc'>line\n  two</p><ul class='specs'><li>Przechowywanie: 4°C</li>"
              "<li>Zastosowania: PCR</li></ul></div><div class='product-card'><h2 class='product-name'>"),
        F.col("s_name"), F.lit("</h2></div></html>"),
    )


@query(
    """SELECT CAST(s_suppkey AS VARCHAR) AS page, CAST(0 AS INTEGER) AS ordinal, 'SU-' || s_suppkey AS sku, 'A <' || s_suppkey || '>' AS name,
        'line two' AS description, '4°C' AS storage, 'PCR' AS applications FROM supplier
        UNION ALL SELECT CAST(s_suppkey AS VARCHAR), 1, '', s_name, '', '', '' FROM supplier"""
)
def html_cards_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _read(spark, sf_dir, "supplier").select("s_suppkey", _supplier_page().alias("html"))
    return html_cards.parse_cards(pages, "s_suppkey", "html")


_KNOWN_SQL = """SELECT 'SU-' || CAST(s_suppkey * 10 AS VARCHAR) AS sku FROM supplier"""
_CARD_SQL = """SELECT s_suppkey AS ordinal, CASE s_suppkey % 3 WHEN 0 THEN 'su-' || CAST(s_suppkey * 10 AS VARCHAR)
    WHEN 1 THEN 'SU-' || replace(replace(CAST(s_suppkey * 10 AS VARCHAR), '1', 'l'), '0', 'O') ELSE 'SU-x' || s_suppkey END AS sku FROM supplier"""


@query(
    f"""WITH k AS ({_KNOWN_SQL}), c AS (SELECT ordinal, upper(sku) AS sku FROM ({_CARD_SQL})),
        e AS (SELECT c.ordinal, c.sku, k.sku AS hit FROM c LEFT JOIN k USING (sku)),
        r AS (SELECT e.ordinal, min(k.sku) AS hit FROM e JOIN k ON k.sku = 'SU-' || replace(replace(replace(substr(e.sku, 4), 'L', '1'), 'I', '1'), 'O', '0')
        WHERE e.hit IS NULL AND k.sku <> e.sku GROUP BY 1 HAVING count(DISTINCT k.sku) = 1)
        SELECT e.ordinal, e.sku AS card_sku, coalesce(e.hit, r.hit) AS matched_sku,
        CASE WHEN e.hit IS NOT NULL THEN 'exact_sku' WHEN r.hit IS NOT NULL THEN 'confusable_character_correction' END AS match_rule
        FROM e LEFT JOIN r USING (ordinal)"""
)
def key_match_exact_then_fix(spark: SparkSession, sf_dir: str) -> DataFrame:
    suppliers = _read(spark, sf_dir, "supplier")
    number = (F.col("s_suppkey") * 10).cast("string")
    known = suppliers.select(F.concat(F.lit("SU-"), number).alias("sku"))
    sku = (
        F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit("su-"), number))
        .when(F.col("s_suppkey") % 3 == 1, F.concat(F.lit("SU-"), F.translate(number, "10", "lO")))
        .otherwise(F.concat(F.lit("SU-x"), F.col("s_suppkey").cast("string")))
    )
    cards = suppliers.select(F.lit("page").alias("page"), F.col("s_suppkey").alias("ordinal"), sku.alias("sku"))
    return enrich.match_cards(cards, known).select("ordinal", "card_sku", "matched_sku", "match_rule")


@query(
    """WITH i AS (SELECT 'PA-' || p_partkey AS sku, 'canonical' AS kind, p_partkey FROM part
        UNION ALL SELECT 'PA-' || p_partkey || 'A', 'alias', p_partkey FROM part WHERE p_partkey % 5 = 0)
        SELECT l_orderkey, l_linenumber, kind, i.p_partkey FROM lineitem
        JOIN i ON i.sku = 'PA-' || l_partkey || CASE WHEN l_linenumber % 2 = 0 THEN 'A' ELSE '' END"""
)
def alias_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = F.concat(F.lit("PA-"), F.col("p_partkey").cast("string"))
    aliases = F.when(F.col("p_partkey") % 5 == 0, F.array(F.concat(own, F.lit("A")))).otherwise(F.array().cast("array<string>"))
    parts = _read(spark, sf_dir, "part").select("p_partkey", own.alias("canonical_sku"), aliases.alias("alias_skus"))
    names = resolve.identifiers(parts).join(parts.select("p_partkey", "canonical_sku"), "canonical_sku")
    asked = F.concat(
        F.lit("PA-"), F.col("l_partkey").cast("string"), F.when(F.col("l_linenumber") % 2 == 0, "A").otherwise("")
    )
    lines = _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", asked.alias("sku"))
    return lines.join(names, "sku").select("l_orderkey", "l_linenumber", "kind", "p_partkey")


# -- vectors and search -------------------------------------------------------------------------

QUERY_VECTOR = [float(i % 7 - 3) for i in range(64)]
_SQL_VECTOR = "[" + ", ".join(f"{x}::DOUBLE" for x in QUERY_VECTOR) + "]"
_SQL_SCORE = f"list_dot_product(CAST(embedding AS DOUBLE[]), {_SQL_VECTOR})"


@query(f"SELECT vec_id, round({_SQL_SCORE}, 6) AS score FROM embeddings WHERE label = 3 ORDER BY {_SQL_SCORE} DESC, vec_id LIMIT 10")
def filtered_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ranking of the search. The filter is pushed to the scan, the rest is a partial top-k in every task."""
    table = _read(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "canonical_sku")
    hits = ranking.best(ranking.scored(table, "embedding", QUERY_VECTOR, F.col("label") == 3), 10)
    return hits.select(F.col("canonical_sku").alias("vec_id"), F.round("score", 6).alias("score"))


#: Query vectors by rule, so that SQL has them too.
MANY = 40
_MANY_SQL = f"SELECT q, list_transform(range(0, 64), lambda i: CAST((i * (q + 2) + q * q) % 11 - 5 AS DOUBLE)) AS v FROM range(0, {MANY}) AS t(q)"


@query(
    f"""WITH a AS ({_MANY_SQL}), s AS (SELECT q, vec_id, list_dot_product(CAST(embedding AS DOUBLE[]), v) AS score FROM embeddings, a WHERE label IN (1, 3, 5))
        SELECT q AS query, rank, vec_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, CAST(vec_id AS VARCHAR)) AS rank FROM s)
        WHERE rank <= 10"""
)
def filtered_topk_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch of queries in one scan, a filter before the ranking."""
    queries = [[float((i * (q + 2) + q * q) % 11 - 5) for i in range(64)] for q in range(MANY)]
    table = _read(spark, sf_dir, "embeddings").filter(F.col("label").isin(1, 3, 5)).withColumn("sku", F.col("vec_id").cast("string"))
    found = ranking.top_k_many(table, "sku", "embedding", queries, 10)
    return found.select("query", F.col("rank").cast("bigint").alias("rank"), F.col("sku").cast("bigint").alias("vec_id"), F.round("score", 6).alias("score"))


@query(
    """WITH m AS (SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) AS x FROM embeddings, range(1, 65) AS r(i) GROUP BY 1, 2),
        n AS (SELECT label, sqrt(sum(x * x)) AS length FROM m GROUP BY 1)
        SELECT label, i AS dim, round(x / length, 6) AS value FROM m JOIN n USING (label)"""
)
def centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = vectors.centroids(_read(spark, sf_dir, "embeddings"), "label", "embedding")
    flat = found.select("label", F.posexplode("vector").alias("i", "x"))
    return flat.select("label", (F.col("i") + 1).cast("bigint").alias("dim"), F.round("x", 6).alias("value"))


@query(
    f"""SELECT CAST(label AS VARCHAR) AS label, string_agg(vec_id || ' ' || printf('%.2f', score), ', ' ORDER BY place) AS drivers FROM (SELECT label, vec_id,
        {_SQL_SCORE} AS score, row_number() OVER (PARTITION BY label ORDER BY {_SQL_SCORE} DESC, CAST(vec_id AS VARCHAR)) AS place FROM embeddings) WHERE place <= 2 GROUP BY 1"""
)
def top2_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The evidence of the search: labels as hits, their vectors as fields."""
    table = _read(spark, sf_dir, "embeddings")
    names = [F.col("label").cast("string").alias("canonical_sku"), F.col("vec_id").cast("string").alias("field")]
    fields = table.select(*names, F.col("embedding").alias("vector"))
    hits = fields.select("canonical_sku").distinct()
    return ranking.strongest_fields(fields, hits, QUERY_VECTOR).withColumnRenamed("canonical_sku", "label")


@query(
    f"""SELECT vec_id, 'score ' || printf('%.2f', s) || ' (cosine similarity, not a probability) - strongest fields: label ' || printf('%.2f', label / 8.0)
        || CASE WHEN label % 2 = 0 THEN ' - category L' || label || CASE WHEN label % 4 = 0 THEN ' (inferred)' ELSE '' END ELSE '' END
        || CASE WHEN label % 3 = 0 THEN ' - description added with the product' ELSE '' END || ' - passed filter: maker' AS explanation
        FROM (SELECT vec_id, label, round({_SQL_SCORE}, 4) AS s FROM embeddings)"""
)
def explanation_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.col("label").cast("string")
    hits = _read(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("canonical_sku"),
        "label",
        F.round(vectors.dot(F.col("embedding"), F.array(*map(F.lit, QUERY_VECTOR))), 4).alias("score"),
        F.when(F.col("label") % 2 == 0, F.concat(F.lit("L"), label)).alias("category"),
        F.when(F.col("label") % 4 == 0, "inferred_from_product_name").otherwise("row").alias("category_source"),
        F.when(F.col("label") % 3 == 0, F.struct(F.lit("runtime_input").alias("match_rule"))).alias("enrichment"),
        F.concat(F.lit("label "), F.format_number(F.col("label") / 8, 2)).alias("drivers"),
    )
    return hits.select(F.col("canonical_sku").alias("vec_id"), ranking.explanation("maker").alias("explanation"))


# -- state ------------------------------------------------------------------------------------


@query(
    """SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events)
        WHERE rn = 1 AND event_id % 3 <> 0"""
)
def latest_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adds and deletes: the last event of a key decides, and a delete (every third event) removes it."""
    events = _read(spark, sf_dir, "events")
    last = state.newest(events, "user_id", ["ts", "event_id"], ["event_type"])
    return last.filter(F.col("event_id") % 3 != 0).select("user_id", "event_type", "event_id")


_TABLES = "benchmark conversations customer documents embeddings events labels lineitem nation orders pages part region supplier".split()


@query(" UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n FROM {t}" for t in _TABLES))
def count_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = [_read(spark, sf_dir, t).agg(F.count("*").alias("n")).select(F.lit(t).alias("table_name"), "n") for t in _TABLES]
    out = counts[0]
    for one in counts[1:]:
        out = out.unionAll(one)
    return out
