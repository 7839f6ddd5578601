"""Manufacturer cards attached to products by catalogue number; what matches nothing is kept apart.

A card's number matches exactly, or after reading mistaken characters (L and I for 1, O for 0,
behind the prefix) as digits, if that hits exactly one known number. Instead of writing out the
2^k readings of a card, both sides are joined on the number with all such characters read as
digits, and a positional test keeps the pairs that differ only by a reading of the card's text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shelfmark.functions.parse import ISSUE, issue
from shelfmark.functions.text import fold, quoted, sku_form
from shelfmark.functions.vocabulary import CONFUSABLE, CONFUSABLE_DIGITS

from .resolve import identifiers

ENRICHMENT = (
    "struct<source_sku:string,name:string,description:string,storage:string,applications:string,match_rule:string>"
)


def as_digits(sku: Column) -> Column:
    """The number with every mistakable character behind its first hyphen read as a digit."""
    at = F.instr(sku, "-")
    tail = F.translate(F.substring(sku, at + 1, F.length(sku)), CONFUSABLE, CONFUSABLE_DIGITS)
    return F.when(at > 0, F.concat(F.substring(sku, F.lit(1), at), tail))


def is_reading(card: Column, known: Column) -> Column:
    """`known` is `card` with some of its mistakable characters replaced by their digit."""
    places = F.sequence(F.lit(1), F.length(card))
    same = lambda i: F.substring(known, i, F.lit(1)) == F.substring(card, i, F.lit(1))
    digit = lambda i: F.substring(known, i, F.lit(1)) == F.substring(as_digits(card), i, F.lit(1))
    return (F.length(card) == F.length(known)) & F.forall(places, lambda i: same(i) | digit(i))


def match_cards(cards: DataFrame, known: DataFrame, page_col: str = "page", ordinal_col: str = "ordinal") -> DataFrame:
    """`cards` with card_sku, matched_sku, match_rule and `of`, the row of `known`; null without a match.

    `known` has a column sku and is read once: a card meets the numbers that equal its own when all
    mistakable characters are read as digits. One that is the card's own is exact; else one reading
    counts if there is no other.
    """
    place = [page_col, ordinal_col]
    normal = cards.withColumn("card_sku", sku_form(F.col("sku")))
    have = known.select(F.struct(*known.columns).alias("of"), F.coalesce(as_digits(F.col("sku")), "sku").alias("digits"))
    exact = F.col("of.sku") == F.col("card_sku")
    found = (
        normal.select(*place, "card_sku", F.coalesce(as_digits(F.col("card_sku")), "card_sku").alias("digits"))
        .join(have, "digits")
        .filter(exact | is_reading(F.col("card_sku"), F.col("of.sku")))
        .groupBy(*place)
        .agg(
            F.first(F.when(exact, F.col("of")), ignorenulls=True).alias("same"),
            F.min(F.when(~exact, F.col("of.sku"))).alias("least"),
            F.max(F.when(~exact, F.col("of.sku"))).alias("most"),
            F.first("of", ignorenulls=True).alias("any"),
        )
    )
    alone = F.col("same").isNull() & (F.col("least") == F.col("most"))
    rule = F.when(F.col("same").isNotNull(), "exact_sku").when(alone, "confusable_character_correction")
    told = found.select(*place, F.coalesce("same", F.when(alone, F.col("any"))).alias("of"), rule.alias("match_rule"))
    return normal.join(told, place, "left").withColumn("matched_sku", F.col("of.sku"))


def enrich(
    products: DataFrame, cards: DataFrame, save: Callable[[DataFrame, str], DataFrame] = lambda table, kind: table
) -> tuple[DataFrame, DataFrame]:
    """Products with `enrichment`, notes and issues; and the cards that match no product.

    The first card of a product in page order wins; later ones are reported as conflicts. `products`
    is read twice: for its numbers and names, and for the result.
    """
    matched = save(match_cards(cards, identifiers(products, "name")), "matched")
    loose = matched.filter(F.col("matched_sku").isNull()).select(
        F.col("card_sku").alias("sku"),
        "name",
        "description",
        "storage",
        "applications",
        F.lit("unmatched_external_candidate").alias("status"),
    )
    hits = (
        matched.filter(F.col("matched_sku").isNotNull())
        .withColumns({"canonical_sku": F.col("of.canonical_sku"), "own_name": F.col("of.name")})
        .withColumn("same_name", fold(F.col("own_name")) == fold(F.col("name")))
    )
    order = Window.partitionBy("canonical_sku").orderBy("page", "ordinal")
    hits = hits.withColumn("turn", F.row_number().over(order)).withColumn("winner", F.first("sku").over(order))
    first = F.col("turn") == 1
    corrected = F.when(
        F.col("match_rule") != "exact_sku",
        F.concat(
            F.lit("snapshot SKU "),
            quoted(F.col("sku")),
            F.lit(" read as "),
            F.col("matched_sku"),
            F.lit(" (confusable characters, unique catalogue hit) "),
            F.when(F.col("same_name"), "and").otherwise("but"),
            F.lit(" the product name "),
            quoted(F.col("name")),
            F.when(F.col("same_name"), " matches ").otherwise(" differs from "),
            quoted(F.col("own_name")),
        ),
    )
    renamed = F.when(
        first & ~F.col("same_name"),
        F.concat(
            F.lit("manufacturer calls "),
            F.col("matched_sku"),
            F.lit(" "),
            quoted(F.col("name")),
            F.lit("; catalogue name kept as "),
            quoted(F.col("own_name")),
        ),
    )
    conflict = F.when(
        ~first,
        issue(
            "snapshot_card_conflict",
            F.concat(
                F.lit("card "),
                quoted(F.col("sku")),
                F.lit(" also resolves to "),
                F.col("matched_sku"),
                F.lit(", already enriched from "),
                quoted(F.col("winner")),
                F.lit("; kept the first"),
            ),
        ),
    )
    card = F.struct(
        F.col("sku").alias("source_sku"), "name", "description", "storage", "applications", "match_rule"
    )
    per_product = hits.groupBy("canonical_sku").agg(
        F.min_by(card, F.col("turn")).cast(ENRICHMENT).alias("enrichment"),
        F.array_sort(
            F.collect_list(
                F.struct("turn", F.array_compact(F.array(corrected, renamed)).alias("notes"), conflict.alias("issue"))
            )
        ).alias("said"),
    )
    notes = F.flatten(F.transform("said", lambda x: x["notes"]))
    issues = F.array_compact(F.transform("said", lambda x: x["issue"])).cast(f"array<{ISSUE}>")
    out = products.join(per_product, "canonical_sku", "left")
    return (
        out.withColumns(
            {
                "resolution_notes": F.concat("resolution_notes", F.coalesce(notes, F.array().cast("array<string>"))),
                "issues": F.concat("issues", F.coalesce(issues, F.array().cast(f"array<{ISSUE}>"))),
                "enrichment_status": F.when(F.col("enrichment").isNull(), "not_found_in_snapshot").otherwise("enriched"),
            }
        ).drop("said"),
        loose,
    )


def without_cards(products: DataFrame) -> DataFrame:
    """The same columns where no page was read."""
    return products.withColumns(
        {"enrichment": F.lit(None).cast(ENRICHMENT), "enrichment_status": F.lit("not_found_in_snapshot")}
    )
