"""A training corpus from raw documents: five stages, each written as Parquet and reread.

Counted as part of the `llm` subpackage. A stage is (name, function); a function takes (spark,
docs, sf_dir) and returns a DataFrame. All stages but the last keep the columns of the documents.

Every stage takes whole texts of any length, null and empty ones too, rows that repeat, null ids,
empty tables, and extra columns of any name, which it carries unchanged; the last stage's own `shard`
and `slot` replace columns of those names. What each does with such rows is said at the stage.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.llm import decontam, mixing, neardup, quality, sharding, shared

QUALITY_THRESHOLD = 0.3
SHARDS = 24
CORE = ("doc_id", "text", "lang", "source")

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def carrying(stage: Stage) -> Stage:
    """The stage, with columns beyond the core ones renamed meanwhile, so that no name can clash."""

    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        aside = {c: c if c in CORE else f"__extra_{i}" for i, c in enumerate(docs.columns)}
        out = stage(spark, docs.select(*[F.col(f"`{c}`").alias(a) for c, a in aside.items()]), sf_dir)
        added = [c for c in out.columns if c not in aside.values()]
        back = [F.col(a).alias(c) for c, a in aside.items() if c.lower() not in added]
        return out.select(*back, *added)

    return run_stage


@carrying
def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject: a score of 0.3 or more.

    Null and empty texts are scored like any text of no words; copies have equal scores, so all stay
    or go. Without labels to learn from every score is 0.5 and all documents stay.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.fit(docs, labels, "quality")
    scored = quality.add_scores(docs, model, carry=docs.columns, threshold=QUALITY_THRESHOLD)
    return scored.filter("predicted = 1").select(*docs.columns)


@carrying
def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingle sets of similarity 0.8 or more, the smallest id.

    Texts without words are linked with nothing, so they stay, one row for equal id and text; texts
    of fewer than five words are one shingle. Of rows that share the smallest id one stays. A null id
    is kept only where no document of its group has an id.
    """
    return neardup.deduplicate(docs, words=5)


@carrying
def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no ten-word window of a benchmark item occurs.

    Items of fewer words are one window, items without words none. Texts without words stay.
    """
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontam.find_contamination(docs, benchmark, carry=docs.columns, window=10)
    return found.filter(~F.col("contaminated")).select(*docs.columns)


@carrying
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated so that all sources weigh the same on average, in global random order.

    Counts are Poisson draws of the id, so a document can go; rows of one id draw the same count. A
    null source is a source like others, a null id draws as an empty text.
    """
    return mixing.poisson_replicate(docs).select(*docs.columns)


@carrying
def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their shard and slot: a uniform shuffle into shards whose row counts differ by one at most.

    Every row has a place of its own, whatever its text or id; fewer rows than shards leave some empty.
    """
    return sharding.shuffle_into_shards(docs, shards=SHARDS)


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", keep_quality),
    ("MinHash near-dedup", keep_one_of_near_duplicates),
    ("benchmark decontamination", drop_benchmark_passages),
    ("mixing to target weights", mix_sources),
    ("sharding", shard),
]

#: The classifier and the hypergeometric draws are not SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over `documents`. A stage's table goes when the next one's is written."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        docs = shared.materialise(stage(spark, docs, sf_dir), name.split()[0].lower())
        if last is not None:
            shared.drop_table(last)
        last = docs
    return docs
