"""Closed vocabularies. Results depend on every entry being exactly this."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# The category keys, and the words that are embedded for them.
CATEGORY_LABELS = {
    "NUCLEIC_ACID_ISOLATION": "izolacja kwasow nukleinowych, nucleic acid isolation",
    "PCR_REAGENT": "odczynniki do PCR, PCR reagents",
    "LAB_CHEMICAL": "chemia laboratoryjna, odczynniki chemiczne, lab chemicals",
    "LAB_PLASTICWARE": "plastik laboratoryjny, sprzet jednorazowy, lab plasticware",
    "LAB_EQUIPMENT": "aparatura pomiarowa, sprzet pomiarowy, measuring equipment",
}

# Spellings of the categories.
CATEGORY_SPELLINGS = {
    "nucleic acid isolation": "NUCLEIC_ACID_ISOLATION",
    "izolacja kwasow nukleinowych": "NUCLEIC_ACID_ISOLATION",
    "izolacja dna/rna": "NUCLEIC_ACID_ISOLATION",
    "izolacja dna": "NUCLEIC_ACID_ISOLATION",
    "pcr reagents": "PCR_REAGENT",
    "pcr - odczynniki": "PCR_REAGENT",
    "odczynniki pcr": "PCR_REAGENT",
    "odczynniki do pcr": "PCR_REAGENT",
    "chemia laboratoryjna": "LAB_CHEMICAL",
    "chemicals": "LAB_CHEMICAL",
    "odczynniki": "LAB_CHEMICAL",
    "odczynniki chemiczne": "LAB_CHEMICAL",
    "plastik laboratoryjny": "LAB_PLASTICWARE",
    "plastiki lab.": "LAB_PLASTICWARE",
    "laboratory plasticware": "LAB_PLASTICWARE",
    "sprzet jednorazowy": "LAB_PLASTICWARE",
    "measuring equipment": "LAB_EQUIPMENT",
    "pomiary": "LAB_EQUIPMENT",
    "aparatura pomiarowa": "LAB_EQUIPMENT",
    "sprzet pomiarowy": "LAB_EQUIPMENT",
}

# Unit spellings, and the class of each unit.
UNIT_SPELLINGS = {
    "rxn": "reaction",
    "reactions": "reaction",
    "reaction": "reaction",
    "reakcji": "reaction",
    "test": "test",
    "testy": "test",
    "szt": "item",
    "pcs": "item",
    "pack": "item",
    "op": "pack",
    "g": "gram",
    "kg": "kilogram",
    "ml": "milliliter",
    "l": "liter",
}
UNIT_CLASSES = {
    "reaction": "count",
    "test": "count",
    "item": "count",
    "pack": "count",
    "gram": "mass",
    "kilogram": "mass",
    "milliliter": "volume",
    "liter": "volume",
    "unknown": "unknown",
}

# Categories that are sold by the piece; characters that are mistaken for digits.
COUNTABLE_CATEGORIES = ("LAB_PLASTICWARE", "LAB_EQUIPMENT")
CONFUSABLE = "LIO"
CONFUSABLE_DIGITS = "110"


def lookup(table: dict[str, str], key: Column) -> Column:
    """The entry for `key`, null if there is none: a literal map, so no join."""
    return F.create_map(*map(F.lit, chain.from_iterable(table.items())))[key]
