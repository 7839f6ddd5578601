"""Hybrid search: an exact number first, else cosine top-k with filters before the ranking."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .vectors import _matrix, dot

#: Queries that go through one scan; more are taken in blocks of so many, a scan for each.
QUERIES = 2_000


def passes(manufacturer: str | None, category: str | None) -> Column:
    """Filter on stored columns, so that it reaches the scan. Arguments are normalized, or None.

    `manufacturer` is folded text that the folded manufacturer must contain; `category` is a key.
    """
    condition = F.lit(True)
    if manufacturer:
        condition = condition & F.contains(F.col("manufacturer_folded"), F.lit(manufacturer))
    if category:
        condition = condition & (F.col("category") == category)
    return condition


def exact(product: DataFrame, sku: str) -> DataFrame:
    """The product that `sku` names, with the reason."""
    reason = F.when(F.col("canonical_sku") == sku, F.lit(f"exact match on catalogue number {sku}")).otherwise(
        F.concat(F.lit(f"{sku} is a registered alias of "), F.col("canonical_sku"))
    )
    return product.withColumns(
        {
            "score": F.lit(1.0),
            "match_type": F.lit("exact_sku"),
            "explanation": F.concat(F.lit("score 1.00 - "), reason),
        }
    )


def scored(table: DataFrame, vector: str, query: list[float], condition: Column) -> DataFrame:
    """The rows that pass `condition`, with score in place of their vector."""
    literal = F.array(*map(F.lit, query))
    return table.filter(condition).withColumn("score", dot(F.col(vector), literal)).drop(vector)


def best(rows: DataFrame, limit: int) -> DataFrame:
    """Ties go to the smaller number."""
    return rows.orderBy(F.desc("score"), "canonical_sku").limit(limit)


def top_k(products: DataFrame, vectors: DataFrame, query: list[float], limit: int, condition: Column) -> DataFrame:
    """The `limit` best products of those that pass `condition`.

    Only numbers and vectors meet and are ranked; whole products are read for the hits alone.
    """
    passing = products.filter(condition).select("canonical_sku").join(vectors.select("canonical_sku", "vector"), "canonical_sku")
    hits = best(scored(passing, "vector", query, F.lit(True)), limit)
    return best(products.join(F.broadcast(hits), "canonical_sku"), limit)


class Best:
    """The best rows of each of some queries so far; of equal scores those with the smaller keys."""

    def __init__(self, queries: np.ndarray, limit: int):
        self.queries, self.limit = queries, limit
        self.place, self.score, self.key = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, object)
        self.worst = np.full(len(queries), -np.inf)
        #: More than rounding can make of a product, however it is summed, for vectors of length one.
        self.slack = 4 * (queries.shape[1] + 4) * np.finfo(float).eps * np.sqrt((queries**2).sum(axis=1))

    def take(self, keys: np.ndarray, rows: np.ndarray) -> None:
        rough = rows @ self.queries.T
        slack = self.slack * np.sqrt((rows**2).sum(axis=1).max(initial=0.0))
        low = self.worst - slack
        if len(rows) >= self.limit:
            low = np.maximum(low, np.partition(rough, len(rows) - self.limit, axis=0)[len(rows) - self.limit] - 2 * slack)
        row, place = np.nonzero(rough >= low)
        score = np.zeros(len(row))  # summed in the order of components, as any engine sums it
        for x, q in zip(rows.T, self.queries.T, strict=True):
            score += x[row] * q[place]
        place, score = np.concatenate([self.place, place]), np.concatenate([self.score, score])
        key = np.concatenate([self.key, keys[row]])
        order = np.lexsort((key, -score, place))
        place = place[order]
        turn = np.arange(len(place)) - np.searchsorted(place, place)
        order, place = order[turn < self.limit], place[turn < self.limit]
        self.place, self.score, self.key = place, score[order], key[order]
        full = turn[turn < self.limit] == self.limit - 1
        self.worst[place[full]] = self.score[full]


def _best_of_each(queries: np.ndarray, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(queries, limit)
        for batch in batches:
            if batch.num_rows:
                best.take(np.array(batch.column(0).to_pylist(), object), _matrix(batch.column(1)))
        yield pa.RecordBatch.from_arrays(
            [pa.array(best.place), pa.array(best.key.tolist(), pa.string()), pa.array(best.score)], names=["query", "key", "score"]
        )

    return run


def top_k_many(table: DataFrame, key: str, vector: str, queries: list[list[float]], limit: int) -> DataFrame:
    """query (its place in `queries`), rank, key, score: the `limit` best rows of each query, ties to the smaller key.

    All queries are scored in one scan, a block of rows at a time; a task sends `limit` rows of each
    query at most. `key` is a string.
    """
    slim = table.select(F.col(key).alias("key"), F.col(vector).alias("vector"))
    out = None
    for at in range(0, len(queries), QUERIES):
        found = slim.mapInArrow(_best_of_each(np.array(queries[at : at + QUERIES], float), limit), "query bigint, key string, score double")
        found = found.withColumn("query", F.col("query") + at)
        out = found if out is None else out.unionAll(found)
    if out is None:
        out = slim.sparkSession.createDataFrame([], "query bigint, key string, score double")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "key")
    ranked = out.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)
    return ranked.select("query", "rank", F.col("key").alias(key), "score")


def strongest_fields(field_vectors: DataFrame, hits: DataFrame, query: list[float], limit: int = 2) -> DataFrame:
    """canonical_sku, drivers: `field 0.12` of the best fields of each hit; only the hits' vectors are read.

    `hits` has as many rows as the search's limit, which bounds the broadcast.
    """
    literal = F.array(*map(F.lit, query))
    order = Window.partitionBy("canonical_sku").orderBy(F.desc("score"), "field")
    ranked = (
        field_vectors.join(F.broadcast(hits.select("canonical_sku")), "canonical_sku", "left_semi")
        .select("canonical_sku", "field", dot(F.col("vector"), literal).alias("score"))
        .withColumn("place", F.row_number().over(order))
        .filter(F.col("place") <= limit)
    )
    shown = F.struct("place", F.concat_ws(" ", "field", F.format_number("score", 2)).alias("text"))
    texts = F.transform(F.array_sort(F.collect_list(shown)), lambda x: x["text"])
    return ranked.groupBy("canonical_sku").agg(F.array_join(texts, ", ").alias("drivers"))


def explanation(filters: str = "") -> Column:
    """Score, strongest fields (`drivers`), category, origin of the description, filters passed."""
    inferred = F.when(F.col("category_source") == "inferred_from_product_name", " (inferred)").otherwise("")
    origin = F.when(F.col("enrichment.match_rule") == "runtime_input", "description added with the product").otherwise(
        "description harvested from the manufacturer's page"
    )
    parts = [
        F.concat(F.lit("score "), F.format_number("score", 2), F.lit(" (cosine similarity, not a probability)")),
        F.concat(F.lit("strongest fields: "), F.coalesce("drivers", F.lit(""))),
        F.when(F.col("category").isNotNull(), F.concat(F.lit("category "), F.col("category"), inferred)),
        F.when(F.col("enrichment").isNotNull(), origin),
    ]
    return F.concat_ws(" - ", *parts, *([F.lit(f"passed filter: {filters}")] if filters else []))


def explain(hits: DataFrame, drivers: DataFrame, manufacturer: str | None, category: str | None) -> DataFrame:
    """`hits` with match_type and explanation."""
    filters = ", ".join(x for x in (manufacturer, category) if x)
    return (
        hits.join(F.broadcast(drivers), "canonical_sku", "left")  # one row per hit
        .withColumn("explanation", explanation(filters))
        .withColumn("match_type", F.lit("semantic"))
        .drop("drivers")
        .orderBy(F.desc("score"), "canonical_sku")
    )
