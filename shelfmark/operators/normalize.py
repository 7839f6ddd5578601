"""Rows to records: parsed fields beside the raw ones, and categories inferred from equal names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions import parse
from shelfmark.functions.text import casefold, listed, quoted, sku_form, squash

RAW_FIELDS = ("name", "sku", "manufacturer", "category", "package", "price", "attributes")


def normalize_rows(rows: DataFrame) -> DataFrame:
    """Parsed records of raw rows (row_number and seven strings), without inferred categories.

    The three case-folded texts are computed first, so that each costs one Arrow pass.
    """
    raw = F.struct("row_number", *RAW_FIELDS).alias("raw")
    staged = rows.select(
        raw,
        casefold(squash(F.col("package"))).alias("package_folded"),
        casefold(squash(F.col("attributes"))).alias("attributes_folded"),
        parse.category_of(F.col("category")).alias("category"),
    )
    parsed = staged.select(
        F.col("raw.row_number").alias("row_number"),
        "raw",
        sku_form(F.col("raw.sku")).alias("sku"),
        squash(F.col("raw.name")).alias("name"),
        squash(F.col("raw.manufacturer")).alias("manufacturer"),
        "category",
        F.when(F.col("category").isNull(), "missing").otherwise("row").alias("category_source"),
        parse.package_of(F.col("raw.package"), F.col("package_folded")).alias("package"),
        parse.price_of(F.col("raw.price")).alias("price"),
        parse.attributes_of(F.col("raw.attributes"), F.col("attributes_folded")).alias("attributes"),
    )
    label, package, price = F.col("raw.category"), F.col("raw.package"), F.col("raw.price")
    return parsed.select(
        "*",
        parse.issues(
            (
                F.col("category").isNull() & (squash(label) != ""),
                "unknown_category_label",
                F.concat(quoted(label), F.lit(" is not in CATEGORY_MAP")),
            ),
            (
                F.col("package.unit") == "unknown",
                "package_unit_unknown",
                F.concat(F.lit("cannot read a unit from "), quoted(package)),
            ),
            (F.col("price.amount_text").isNull(), "price_missing", F.concat(F.lit("no price in "), quoted(price))),
        ).alias("issues"),
    )


def infer_unique(rows: DataFrame, key: Column, value: str) -> DataFrame:
    """`rows` with __seen: the distinct values of `value` that other rows of the same key state, sorted.

    The lookup side is one small row per key, summed up before its shuffle.
    """
    keyed = rows.withColumn("__key", key)
    seen = (
        keyed.filter(F.col(value).isNotNull())
        .groupBy("__key")
        .agg(F.array_sort(F.collect_set(value)).alias("__seen"))
    )
    return keyed.join(seen, "__key", "left").drop("__key")


def infer_categories(records: DataFrame) -> DataFrame:
    """A missing category is that of the rows with the same name, if they agree on one."""
    seen = infer_unique(records, casefold(F.col("name")), "category")
    missing = F.col("category").isNull()
    known = F.coalesce(F.size("__seen"), F.lit(0))
    found = missing & (known == 1)
    why = F.when(known < 1, "no other row with this name").otherwise(
        F.concat(F.lit("ambiguous: "), listed(F.transform("__seen", quoted)))
    )
    open_issue = parse.issues((missing & (known != 1), "category_missing", why))
    fields = {
        "category": F.when(found, F.col("__seen")[0]).otherwise(F.col("category")),
        "category_source": F.when(found, "inferred_from_product_name").otherwise(F.col("category_source")),
        "issues": F.concat("issues", open_issue),
    }
    return seen.select(*[fields[c].alias(c) if c in fields else c for c in records.columns])


def normalize(rows: DataFrame) -> DataFrame:
    return infer_categories(normalize_rows(rows))
