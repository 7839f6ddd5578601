"""The registered queries of this subpackage: thin forms over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import codes, decontam, licenses, mixing, neardup, phrases, quality, secrets, sharding, shared, simhash, toxicity, vptree, warc
from .oracles import ORACLE_SQL

__all__ = ["ORACLE_SQL", "QUERIES"]


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared.new_path(spark, "warc")
    warc.write_archive(_read(spark, sf_dir, "pages"), path)
    return warc.read_archive(spark, path).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(_read(spark, sf_dir, "documents"), coverage=0.8)


def op3_vptree(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = _read(spark, sf_dir, "embeddings")
    return vptree.nearest(table, F.pmod(F.col("vec_id"), F.lit(20)) == 0, k=20)


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neardup.cluster(_read(spark, sf_dir, "documents"), words=2, num=80, den=100)
    return found.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id", "kept")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    model = quality.fit(docs, _read(spark, sf_dir, "labels"), "quality")
    scored = quality.add_scores(docs, model, carry=["doc_id"], threshold=0.3)
    held = (shared.crc_fold(F.col("doc_id")) == 0).alias("held_out")
    return scored.select("doc_id", held, "score", "predicted")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.poisson_replicate(_read(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    chain = toxicity.fit(docs, _read(spark, sf_dir, "labels"), "toxic")
    scored = toxicity.score_documents(docs, chain, carry=["doc_id"], threshold=0.5)
    held = (shared.crc_fold(F.col("doc_id")) == 0).alias("held_out")
    span = F.transform("spans", lambda x: F.concat_ws(":", x["start"].cast("string"), x["end"].cast("string")))
    return scored.select("doc_id", held, "score", "predicted", F.concat_ws(",", span).alias("toxic_spans"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(_read(spark, sf_dir, "documents"))

    def count(kind: str, of: str = "kind"):
        return F.size(F.filter("spans", lambda x: x[of] == kind)).cast("bigint")

    return found.select(
        "doc_id",
        *[count(kind).alias(f"n_{kind}") for kind in ("assign", "access", "hex")],
        F.sha2(secrets.written(F.filter("spans", lambda x: x["kind"] != "loose")), 256).alias("base_sha256"),
        secrets.written(F.col("spans")).alias("spans"),
        count("live", "class").alias("n_live"),
        count("example", "class").alias("n_example"),
    )


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shuffle_into_shards(_read(spark, sf_dir, "documents"), shards=24)
    text = F.coalesce(F.col("text"), F.lit(""))  # as it came out of the exchange
    return placed.select(
        "doc_id",
        (F.octet_length(text) + 8).cast("bigint").alias("size"),
        F.crc32(text).cast("bigint").alias("text_crc32"),
        F.lit("rows").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark")
    return decontam.find_contamination(docs, benchmark, carry=["doc_id"], window=10)


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.cluster(_read(spark, sf_dir, "documents"), words=3, bits=3)
    mark = F.lower(F.lpad(F.hex("mark"), 16, "0")).alias("fingerprint")
    return found.select(F.col("id").alias("doc_id"), mark, "component_id")


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(_read(spark, sf_dir, "documents"), least=30, top=2000)


def op13_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.coded(_read(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc": op1_warc,
    "op2_licenses": op2_licenses,
    "op3_vptree": op3_vptree,
    "op4_minhash": op4_minhash,
    "op5_quality": op5_quality,
    "op6_mixing": op6_mixing,
    "op7_toxicity": op7_toxicity,
    "op8_secrets": op8_secrets,
    "op9_sharding": op9_sharding,
    "op10_decontamination": op10_decontamination,
    "op11_simhash": op11_simhash,
    "op12_phrases": op12_phrases,
    "op13_codes": op13_codes,
}
