"""The build: CSV rows to records to products, cards attached. One lazy plan per output."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from shelfmark.operators.enrich import enrich, without_cards
from shelfmark.operators.normalize import normalize
from shelfmark.operators.resolve import identifiers, resolve
from shelfmark.sources.csv_rows import read_rows
from shelfmark.sources.html_cards import read_cards

CANDIDATES = "sku string, name string, description string, storage string, applications string, status string"


@dataclass(frozen=True)
class Catalogue:
    products: DataFrame
    external_candidates: DataFrame
    records: DataFrame

    def by_sku(self) -> DataFrame:
        """sku, kind, canonical_sku: the lookup by canonical number or alias."""
        return identifiers(self.products)


def _lazy(table: DataFrame, kind: str) -> DataFrame:
    return table


def build_catalogue(
    spark: SparkSession, csv_path: str, html_path: str | None = None, save: Callable[[DataFrame, str], DataFrame] = _lazy
) -> Catalogue:
    """`save` is given each step (a table, and its kind) and returns it, perhaps written and read again."""
    records = save(normalize(read_rows(spark, csv_path)), "records")
    products = save(resolve(records), "merged")
    if html_path is None:
        return Catalogue(without_cards(products), spark.createDataFrame([], CANDIDATES), records)
    enriched, loose = enrich(products, save(read_cards(spark, html_path), "cards"), save)
    return Catalogue(enriched, loose, records)
