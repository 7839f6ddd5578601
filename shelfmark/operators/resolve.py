"""Records to products: rows of one SKU merge; a variant SKU folds into its base if nothing differs.

Similar SKUs never merge by edit distance: two numbers one character apart are two products.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions import parse
from shelfmark.functions.text import casefold, fold, listed, quoted

FIELDS = ("name", "manufacturer", "category", "package", "price", "attributes")
# Fixed value: a base number of two letters and digits, and a variant's suffix.
VARIANT = r"^([A-Z]{2}-[0-9]+)([A-Z]|-[0-9]+)$"


def with_keys(records: DataFrame) -> DataFrame:
    """`records` with a <field>_key for each compared field; null where the field says nothing."""
    return records.withColumns(
        {
            "name_key": parse.blank_to_null(casefold(F.col("name"))),
            "manufacturer_key": parse.blank_to_null(casefold(F.col("manufacturer"))),
            "category_key": parse.blank_to_null(F.lower("category")),
            "package_key": parse.package_key(F.col("package")),
            "price_key": parse.price_key(F.col("price")),
            "attributes_key": parse.attributes_key(F.col("attributes")),
        }
    )


KEYS = tuple(f"{f}_key" for f in FIELDS)


def _first(value: str, order: str, stated: str) -> Column:
    """The value of the lowest row in which it is stated, else that of the lowest row."""
    return F.expr(f"coalesce(min_by({value}, {order}) FILTER (WHERE {stated}), min_by({value}, {order}))")


def merge_same_sku(records: DataFrame) -> DataFrame:
    """One product per SKU: first stated value of each field, flags united, conflicts reported."""
    return _merged(records).drop(*KEYS)


def _merged(records: DataFrame) -> DataFrame:
    """The products of `merge_same_sku` with their keys, which come from the rows' keys, folded once."""
    keyed = with_keys(records).withColumn("raw_folded", fold(F.col("attributes.raw")))
    n = "row_number"
    flags = ("room_temperature", "light_sensitive", "dry_ice_required")
    numbers = ("storage_temperature_c", "shelf_life_months")
    plain = ("name", "manufacturer", "package", "price")
    stated_raw = f"{n}) FILTER (WHERE attributes.raw <> '')"
    merged = keyed.groupBy("sku").agg(
        F.min(n).alias("first_row"),
        *[_first(f, n, f"{f}_key IS NOT NULL").alias(f) for f in plain],
        *[F.expr(f"min_by({f}_key, {n}) FILTER (WHERE {f}_key IS NOT NULL)").alias(f"{f}_key") for f in plain],
        _first("named_struct('c', category, 's', category_source)", n, "category IS NOT NULL").alias("cat"),
        *[F.bool_or(f"attributes.{f}").alias(f) for f in flags],
        *[F.expr(f"min_by(attributes.{f}, {n}) FILTER (WHERE attributes.{f} IS NOT NULL)").alias(f) for f in numbers],
        F.expr(f"coalesce(min_by(attributes.raw, {stated_raw}, '')").alias("raw"),
        F.expr(f"coalesce(min_by(raw_folded, {stated_raw}, '')").alias("raw_folded"),
        F.array_sort(F.collect_list(n)).alias("source_rows"),
        # Only rows that have issues travel; most have none.
        F.array_sort(F.collect_list(F.when(F.size("issues") > 0, F.struct(n, "issues")))).alias("row_issues"),
        *[F.array_sort(F.collect_set(f"{f}_key")).alias(f"{f}_stated") for f in FIELDS],
    )
    several = F.size("source_rows") > 1
    note = F.concat(
        F.lit("exact duplicate SKU: merged rows "), listed(F.col("source_rows")), F.lit(" (first non-empty value per field)")
    )
    conflicts = [
        (
            several & (F.size(f"{f}_stated") > 1),
            "duplicate_field_conflict",
            F.concat(F.lit(f"{f} differs between rows: "), listed(F.transform(f"{f}_stated", quoted))),
        )
        for f in FIELDS
    ]
    attributes = F.struct("storage_temperature_c", *flags, "shelf_life_months", "raw")
    return merged.select(
        F.col("sku").alias("canonical_sku"),
        "first_row",
        "name",
        "manufacturer",
        F.col("cat.c").alias("category"),
        F.col("cat.s").alias("category_source"),
        "package",
        "price",
        attributes.alias("attributes"),
        "source_rows",
        F.array().cast("array<string>").alias("alias_skus"),
        F.when(several, F.array(note)).otherwise(F.array().cast("array<string>")).alias("resolution_notes"),
        F.concat(
            F.flatten(F.transform("row_issues", lambda x: x["issues"])),
            parse.issues(*conflicts, parse.implausible_package(F.col("cat.c"), F.col("package"))),
        ).alias("issues"),
        *[f"{f}_key" for f in plain],
        parse.blank_to_null(F.lower("cat.c")).alias("category_key"),
        parse.attributes_key(attributes, F.col("raw_folded")).alias("attributes_key"),
    )


def fold_variants(products: DataFrame) -> DataFrame:
    """Variants of a base, in order of first appearance, each compared with the base as it then is.

    A variant that agrees with the base in all fields (silence agrees) becomes an alias and fills
    what the base lacks; one that differs stays and says why. A base and its variants meet in one
    group, so there is one shuffle; the fold over them is sequential by nature: one accumulator per
    base, in one native `aggregate`. Numbers without a base of their own pass through.
    """
    return _folded(with_keys(products), products.columns)


def _folded(keyed: DataFrame, columns: list[str]) -> DataFrame:
    base_of = parse.blank_to_null(F.regexp_extract("canonical_sku", VARIANT, 1))
    whole = F.struct(*[F.col(c) for c in columns], *KEYS)
    grouped = (
        keyed.withColumn("base_sku", base_of)
        .groupBy(F.coalesce("base_sku", "canonical_sku").alias("group_sku"))
        .agg(
            F.first(F.when(F.col("base_sku").isNull(), whole), ignorenulls=True).alias("base"),
            F.array_sort(
                F.collect_list(F.when(F.col("base_sku").isNotNull(), F.struct(F.col("first_row").alias("at"), whole.alias("v"))))
            ).alias("variants"),
        )
    )
    out = F.struct(*[F.col(f"base.{c}") for c in columns])
    carried = [c for c in (*columns, *KEYS) if c not in ("canonical_sku", "first_row")]
    shape = keyed.select(F.array(F.struct(*[F.col(c) for c in columns])).alias("x")).schema["x"].dataType
    start = F.struct(*[F.col(f"base.{c}").alias(c) for c in carried], F.array().cast(shape).alias("refused"))

    def step(acc: Column, item: Column) -> Column:
        v = item["v"]
        differing = F.array_compact(
            F.array(*[F.when(acc[f"{f}_key"] != v[f"{f}_key"], F.lit(f)) for f in FIELDS])
        )
        joins = F.size(differing) == 0
        note = F.concat(
            F.lit("near-duplicate: "),
            v["canonical_sku"],
            F.lit(" kept as an alias of "),
            F.col("group_sku"),
            F.lit("; all normalized fields are identical"),
        )
        lists = {
            "alias_skus": F.concat(acc["alias_skus"], F.array(v["canonical_sku"]), v["alias_skus"]),
            "source_rows": F.array_sort(F.concat(acc["source_rows"], v["source_rows"])),
            "issues": F.concat(acc["issues"], v["issues"]),
            "resolution_notes": F.concat(acc["resolution_notes"], v["resolution_notes"], F.array(note)),
        }

        def after(c: str) -> Column:
            if c in lists:
                return F.when(joins, lists[c]).otherwise(acc[c])
            field = "category" if c == "category_source" else c.removesuffix("_key")
            silent = acc["category"].isNull() if field == "category" else acc[f"{field}_key"].isNull()
            return F.when(joins & silent, v[c]).otherwise(acc[c])

        complaint = F.concat(
            v["canonical_sku"],
            F.lit(" looks like a variant of "),
            F.col("group_sku"),
            F.lit(" but "),
            F.array_join(differing, ", "),
            F.lit(" differ"),
        )
        told = F.concat(v["issues"], F.array(parse.issue("variant_sku_not_merged", complaint)).cast(f"array<{parse.ISSUE}>"))
        refusal = F.array(F.struct(*[(told if c == "issues" else v[c]).alias(c) for c in columns]))
        return F.struct(
            *[after(c).alias(c) for c in carried],
            F.when(joins, acc["refused"]).otherwise(F.concat(acc["refused"], refusal)).alias("refused"),
        )

    fold_of = F.aggregate("variants", start, step)
    judged = grouped.withColumn("f", F.when(F.col("base").isNotNull() & (F.size("variants") > 0), fold_of))
    updated = F.struct(*[(F.col(f"base.{c}") if c in ("canonical_sku", "first_row") else F.col(f"f.{c}")).alias(c) for c in columns])
    lone = F.transform("variants", lambda x: F.struct(*[x["v"][c].alias(c) for c in columns]))
    rows = (
        F.when(F.col("base").isNull(), lone)
        .when(F.col("f").isNull(), F.array(out))
        .otherwise(F.concat(F.array(updated), F.col("f.refused")))
    )
    return judged.select(F.inline(rows))


def resolve(records: DataFrame) -> DataFrame:
    merged = _merged(records)
    return _folded(merged, [c for c in merged.columns if c not in KEYS])


def identifiers(products: DataFrame, *carried: str) -> DataFrame:
    """sku, kind (canonical or alias) and canonical_sku of every number that names a product; and carried columns."""
    kinds = F.concat(
        F.array(F.struct(F.col("canonical_sku").alias("sku"), F.lit("canonical").alias("kind"))),
        F.transform("alias_skus", lambda a: F.struct(a.alias("sku"), F.lit("alias").alias("kind"))),
    )
    return products.select("canonical_sku", *carried, F.inline(kinds)).select("sku", "kind", "canonical_sku", *carried)
