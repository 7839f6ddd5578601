"""Field parsers as pure Column -> Column functions. What a rule does not cover stays unknown.

Known quirks, kept on purpose: `1 000 szt` reads as 1 item, for the number ends at the space;
`50 µl` reads as liters, for only a-z counts in a unit; a sign is dropped; text that starts with
x and has no number is an item of unknown quantity; `1.990,00` is no price.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import casefold, fold, plain_number, quoted, squash
from .vocabulary import CATEGORY_SPELLINGS, COUNTABLE_CATEGORIES, UNIT_CLASSES, UNIT_SPELLINGS, lookup

AMOUNT = "decimal(38,18)"
ISSUE = "struct<code:string,detail:string>"
# What a number and a price look like.
NUMBER = r"[0-9]+(?:[.,][0-9]+)?"
PRICE = r"(?iuU)^([0-9][0-9 ]*(?:[.,][0-9]+)?)\s*(pln|zl|zł)?$"
#: The phrases of the attribute column.
STORAGE = r"(?U)przechowywanie\s*(-?[0-9]+)\s*c\b"
ROOM = r"(?U)temp\w*\.?\s*pokojowa"
LIGHT = r"(?U)chroni\w*\s+przed\s+swiatlem"
DRY_ICE = r"(?U)such\w+\s+lod"
SHELF_LIFE = r"(?U)termin waznosci\s*([0-9]+)\s*mies"


def blank_to_null(text: Column) -> Column:
    return F.when(text != "", text)


def issue(code: str, detail: Column) -> Column:
    return F.struct(F.lit(code).alias("code"), detail.alias("detail"))


def issues(*candidates: tuple[Column, str, Column]) -> Column:
    """array<struct<code, detail>> of the issues whose condition holds, in the order given."""
    held = [F.when(condition, issue(code, detail)) for condition, code, detail in candidates]
    return F.array_compact(F.array(*held)).cast(f"array<{ISSUE}>")


def category_of(label: Column) -> Column:
    return lookup(CATEGORY_SPELLINGS, casefold(squash(label)))


def package_of(raw: Column, folded: Column) -> Column:
    """`folded` is casefold(squash(raw)), computed once by the caller."""
    number = blank_to_null(F.regexp_extract(folded, NUMBER, 0))
    tail = F.regexp_extract(folded, f"(?s)^.*?{NUMBER}(.*)$", 1)
    named = lookup(UNIT_SPELLINGS, F.regexp_replace(tail, "[^a-z]", ""))
    unit = F.coalesce(named, F.when(F.startswith(folded, F.lit("x")), "item"), F.lit("unknown"))
    text = plain_number(number)
    return F.struct(
        text.alias("quantity_text"),
        text.try_cast(AMOUNT).alias("quantity"),
        unit.alias("unit"),
        lookup(UNIT_CLASSES, unit).alias("unit_class"),
        raw.alias("raw"),
    )


def price_of(raw: Column) -> Column:
    flat = squash(raw)
    text = blank_to_null(plain_number(F.replace(F.regexp_extract(flat, PRICE, 1), F.lit(" "), F.lit(""))))
    return F.struct(
        text.alias("amount_text"),
        text.try_cast(AMOUNT).alias("amount"),
        F.when(text.isNotNull(), "PLN").alias("currency"),
        (text.isNotNull() & (F.regexp_extract(flat, PRICE, 2) == "")).alias("currency_inferred"),
        raw.alias("raw"),
    )


def attributes_of(raw: Column, folded: Column) -> Column:
    return F.struct(
        F.regexp_extract(folded, STORAGE, 1).try_cast("int").alias("storage_temperature_c"),
        folded.rlike(ROOM).alias("room_temperature"),
        folded.rlike(LIGHT).alias("light_sensitive"),
        folded.rlike(DRY_ICE).alias("dry_ice_required"),
        F.regexp_extract(folded, SHELF_LIFE, 1).try_cast("int").alias("shelf_life_months"),
        squash(raw).alias("raw"),
    )


def package_text(package: Column) -> Column:
    return F.concat_ws(" ", F.coalesce(package["quantity_text"], F.lit("?")), package["unit"])


def price_text(price: Column) -> Column:
    shown = F.concat_ws(" ", price["amount_text"], price["currency"])
    suffix = F.when(price["currency_inferred"], " (waluta domyslna)").otherwise("")
    return F.coalesce(F.when(price["amount_text"].isNotNull(), F.concat(shown, suffix)), F.lit("brak ceny"))


def issue_text(item: Column) -> Column:
    return F.concat_ws(": ", item["code"], item["detail"])


def understood_nothing(attributes: Column) -> Column:
    """Text was there, but no phrase was recognised."""
    return (
        (attributes["raw"] != "")
        & attributes["storage_temperature_c"].isNull()
        & ~attributes["room_temperature"]
        & ~attributes["light_sensitive"]
        & ~attributes["dry_ice_required"]
        & attributes["shelf_life_months"].isNull()
    )


def package_key(package: Column) -> Column:
    """What two packages are compared by; null says nothing. Unread units differ by their text."""
    unknown = package["unit"] == "unknown"
    shown = package_text(package)
    return F.when(~unknown, shown).when(
        package["quantity_text"].isNotNull(), F.concat_ws(" of ", shown, fold(package["raw"]))
    )


def price_key(price: Column) -> Column:
    return F.when(price["amount_text"].isNotNull(), F.concat_ws(" ", price["amount_text"], price["currency"]))


def attributes_key(attributes: Column, folded: Column | None = None) -> Column:
    """`folded` is fold(raw), if the caller has it."""
    folded = fold(attributes["raw"]) if folded is None else folded
    parts: list[Column] = []
    for field in ("storage_temperature_c", "room_temperature", "light_sensitive", "dry_ice_required", "shelf_life_months"):
        value = F.coalesce(F.initcap(attributes[field].cast("string")), F.lit("None"))
        parts.append(F.concat(F.lit(f"{field}="), value))
    shown = F.concat(F.lit("Attributes("), F.concat_ws(", ", *parts, F.lit("raw=''")), F.lit(")"))
    return F.when(attributes["raw"] == "", F.lit(None)).when(understood_nothing(attributes), folded).otherwise(shown)


def implausible_package(category: Column, package: Column) -> tuple[Column, str, Column]:
    """A piece good sold by mass or volume, as a candidate for `issues`."""
    odd = category.isin(*COUNTABLE_CATEGORIES) & package["unit_class"].isin("mass", "volume")
    return odd, "package_unit_implausible", F.concat_ws(" sold as ", category, quoted(package["raw"]))
