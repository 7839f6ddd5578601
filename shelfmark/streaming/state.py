"""Current state from a stream of add and delete events: the newest event of a key decides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def newest(events: DataFrame, key: str, order: list[str], carry: list[str]) -> DataFrame:
    """One row per key, that of the largest `order`; the same expression for batch and stream.

    In a stream the state is one struct per key, and an event that comes late changes nothing
    unless it is the newest, so no watermark is needed for right results.
    """
    latest = events.groupBy(key).agg(F.max(F.struct(*order, *carry)).alias("latest"))
    return latest.select(key, *[F.col(f"latest.{c}").alias(c) for c in dict.fromkeys([*order, *carry])])


def publish(state: DataFrame, path: str, checkpoint: str, removed: Column) -> StreamingQuery:
    """After each batch, write the keys that it changed as a folder of its own; see `current`.

    A batch that runs again after a failure overwrites its own version, so each counts once.
    """

    def write(batch: DataFrame, version: int) -> None:
        batch.withColumn("removed", removed).write.mode("overwrite").parquet(f"{path}/version={version:010d}")

    return (
        state.writeStream.outputMode("update")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(write)
        .start()
    )


def current(spark: SparkSession, path: str, key: str) -> DataFrame:
    """The state now: of each key the row of its highest version, without removed keys."""
    versions = spark.read.parquet(path)
    rest = [c for c in versions.columns if c not in (key, "version")]
    latest = versions.groupBy(key).agg(F.max_by(F.struct(*rest), "version").alias("latest"))
    return latest.filter(~F.col("latest.removed")).select(key, *[F.col(f"latest.{c}").alias(c) for c in rest if c != "removed"])


def compact(spark: SparkSession, path: str, key: str, into: str) -> None:
    """Write the state now as one version in a new place, for readers to go on from."""
    current(spark, path, key).withColumn("removed", F.lit(False)).write.parquet(f"{into}/version={0:010d}")
