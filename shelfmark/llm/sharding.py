"""Uniform shuffle into shards of exact size, by a hypergeometric communication matrix.

Every partition is first permuted locally and written to the shared folder, so that a row has a
source partition and a place in it that no retry changes. The number of rows that partition p sends
to shard s is then drawn exactly: row p of the matrix is multivariate hypergeometric over what room
the shards still have. Places are cut by that row, whole rows are exchanged once, dealt by ranges of
shard and a hashed key, and every shard is permuted again by sorting on that key. The result is a
uniform permutation, shard sizes differ by one at most, and the rows of a shard lie together in the
order of their slots, so `write_shards` writes each shard as a few files.

Edge cases: the text plays no part, so null, empty and very long texts are rows like others;
repeated rows are separate rows with places of their own; an empty table gives an empty result.
Extra columns are carried, whatever they are called, unless they clash with the output's own names
(shard, slot), which win.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .shared import materialise

#: Rows per block of the second permutation, as a rule: what one ranking group holds on average.
BLOCK_ROWS = 1_024
#: There are no more blocks than this and one for each shard, so their offsets are broadcast (20 bytes each).
MOST_BLOCKS = 1_000_000
#: Numbers of the matrix that are broadcast (8 bytes each); beyond, rows meet them by a shuffle.
BROADCAST_CUTS = 4_000_000


def hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """One exact draw. numpy's sampler ends below 10**9; beyond, the mass is inverted from its mode."""
    if good + bad < 10**9:
        return int(rng.hypergeometric(good, bad, draws)) if draws else 0
    low, high = max(0, draws - bad), min(good, draws)
    if low == high:
        return low
    total = good + bad
    mode = min(high, max(low, (draws + 1) * (good + 1) // (total + 2)))
    sd = math.sqrt(max(1.0, draws * (good / total) * (bad / total) * ((total - draws) / (total - 1))))
    reach = int(40 * sd) + 40  # the mass beyond is below 1e-300
    up = np.arange(mode, min(high, mode + reach), dtype=np.float64)
    down = np.arange(mode, max(low, mode - reach), -1, dtype=np.float64)
    log_up = np.cumsum(np.log((good - up) * (draws - up) / ((up + 1) * (bad - draws + up + 1))))
    log_down = np.cumsum(np.log(down * (bad - draws + down) / ((good - down + 1) * (draws - down + 1))))
    mass = np.exp(np.concatenate([log_down[::-1], [0.0], log_up]))
    return int(mode - len(down) + np.searchsorted(np.cumsum(mass), rng.random() * mass.sum()))


def communication_matrix(counts: list[int], shards: int, seed: int) -> np.ndarray:
    """counts[p] rows of partition p -> matrix[p, s]; column sums differ by one at most."""
    rng = np.random.default_rng(seed)
    total = sum(counts)
    room = np.full(shards, total // shards, dtype=np.int64)
    room[rng.permutation(shards)[: total % shards]] += 1
    matrix = np.zeros((len(counts), shards), dtype=np.int64)
    for p, rows in enumerate(counts):
        left, rest = int(rows), int(room.sum())
        for s in range(shards):
            rest -= int(room[s])
            matrix[p, s] = hypergeometric(rng, int(room[s]), rest, left)
            left -= int(matrix[p, s])
        room -= matrix[p]
    return matrix


def _key(seed: int, salt: str, *of: Column) -> Column:
    return F.xxhash64(F.lit(seed), F.lit(salt), *of)


def shuffle_into_shards(df: DataFrame, shards: int = 24, seed: int = 17) -> DataFrame:
    """`df` with `shard` (0 to shards - 1) and `slot` (0, 1, ... within the shard)."""
    spark = df.sparkSession
    kept = [c for c in df.columns if c.lower() not in ("shard", "slot")]
    keyed = df.select(*kept, _key(seed, "local", F.spark_partition_id(), F.monotonically_increasing_id()).alias("__local"))
    # Sorted within its partition, a row's id holds the partition above bit 33 and the place below.
    placed = keyed.sortWithinPartitions("__local").withColumn("__row", F.monotonically_increasing_id()).drop("__local")
    pinned = materialise(placed, "shard-rows")
    part = F.shiftright("__row", 33).cast("int")
    # One count per input partition: that many numbers reach the driver, not rows.
    sizes = pinned.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()
    counts = sorted((r["part"], r["n"]) for r in sizes)
    total = sum(n for _, n in counts)
    matrix = communication_matrix([n for _, n in counts], shards, seed)
    cuts = spark.createDataFrame(
        [(p, [int(x) for x in np.cumsum(row)[:-1]]) for (p, _), row in zip(counts, matrix, strict=True)],
        T.StructType([T.StructField("__part", T.IntegerType()), T.StructField("__cuts", T.ArrayType(T.LongType()))]),
    )
    place = F.col("__row").bitwiseAND(2**33 - 1)
    blocks = max(1, math.ceil(total / shards / max(BLOCK_ROWS, total / MOST_BLOCKS)))
    cuts = F.broadcast(cuts) if matrix.size <= BROADCAST_CUTS else cuts

    def dealt(rows: DataFrame) -> DataFrame:
        """With shard, key and block."""
        out = rows.join(cuts, part == F.col("__part")).withColumn(
            "shard", F.size(F.filter("__cuts", lambda c: c <= place)).cast("int")
        )
        out = out.withColumn("__key", _key(seed, "shard", F.col("__row"))).drop("__part", "__cuts")
        return out.withColumn("__block", _block("__key", blocks))

    before = Window.partitionBy("shard").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        dealt(pinned.select("__row"))
        .groupBy("shard", "__block")
        .agg(F.count("*").alias("__n"))
        .withColumn("__offset", F.coalesce(F.sum("__n").over(before), F.lit(0)))
        .drop("__n")
    )
    within = Window.partitionBy("shard", "__block").orderBy("__key", "__row")
    ranked = (
        dealt(pinned)
        .repartitionByRange("shard", "__block")
        .sortWithinPartitions("shard", "__block", "__key", "__row")
        .withColumn("__rank", F.row_number().over(within) - 1)
        .join(F.broadcast(offsets), ["shard", "__block"])
    )
    return ranked.select(*kept, "shard", (F.col("__offset") + F.col("__rank")).cast("bigint").alias("slot"))


def write_shards(placed: DataFrame, path: str) -> None:
    """One folder for each shard. Rows come in the order of their slots, so a task writes few shards, one by one."""
    placed.write.partitionBy("shard").parquet(path)


def _block(key: str, blocks: int) -> Column:
    """Equal ranges of the 64-bit key, in order, so that block and rank in the block give the slot."""
    return F.least(
        F.floor((F.shiftright(F.col(key), 32) + F.lit(2**31)) * F.lit(blocks) / F.lit(2**32)), F.lit(blocks - 1)
    ).cast("int")
