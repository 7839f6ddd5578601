"""Mixing sources to target weights by Poisson replication.

A source's mean repetition rate is its target share of the rows over its present share. Each row
draws its count by inverting that Poisson distribution at a uniform number hashed from the seed
and its id, and is repeated so often; a global shuffle on a hashed key follows. The draw depends
on the row alone, so a lost task draws the same again.

Edge cases: a null source is a source of its own, named '' for its weight and its hash; a null id
hashes as ''. Repeated rows draw the same count. Sources that `weights` does not name get no rows;
without `weights` all sources weigh the same. The text plays no part, so null, empty and very long ones
are carried like others. An empty table gives an empty result. Extra columns
are carried unless they clash with the output's own names (copy, n_copies, shuffle_key).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import join_hot, unit_hash

#: Rates above this are drawn as a sum of that many independent parts, each below it.
MAX_RATE = 200.0
#: Up to so many sources their distributions (4 kB each at most) are broadcast; beyond, the join shuffles,
#: with the rows of a large source dealt to several tasks.
BROADCAST_SOURCES = 8_000


def _distribution(rate: Column) -> Column:
    """Cumulative Poisson probabilities P(X <= 0), P(X <= 1), ... up to where they reach one."""
    last = F.ceil(rate + 12 * F.sqrt(rate) + 24).cast("int")
    zero = F.struct(F.exp(-rate).alias("p"), F.exp(-rate).alias("c"), F.array(F.exp(-rate)).alias("all"))

    def step(acc: Column, k: Column) -> Column:
        p = acc["p"] * rate / k
        return F.struct(p.alias("p"), (acc["c"] + p).alias("c"), F.concat(acc["all"], F.array(acc["c"] + p)).alias("all"))

    return F.aggregate(F.sequence(F.lit(1), last), zero, step, lambda acc: acc["all"])


def poisson_replicate(
    docs: DataFrame,
    weights: dict[str, float] | None = None,
    id_col: str = "doc_id",
    source_col: str = "source",
    seed: str = "mix-1",
) -> DataFrame:
    """`docs`, each row repeated by its drawn count, in globally shuffled order.

    Adds copy (from 0), n_copies and shuffle_key; rows are sorted by shuffle_key across partitions.
    """
    spark = docs.sparkSession
    own = {"copy", "n_copies", "shuffle_key"}
    kept = [c for c in docs.columns if c.lower() not in own]
    source = F.coalesce(F.col(source_col).cast("string"), F.lit(""))
    ident = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    rows = docs.select(*kept, source.alias("__source"), ident.alias("__id"))
    sizes = docs.groupBy(source.alias("__source")).agg(F.count("*").alias("__n"))
    if weights is None:
        sizes = sizes.withColumn("__w", F.lit(1.0))
    else:
        table = spark.createDataFrame([(k, float(v)) for k, v in weights.items()], "__source string, __w double")
        sizes = sizes.join(table, "__source")
    told = sizes.agg(F.sum("__w").alias("w"), F.count("*").alias("n")).collect()[0]  # two numbers
    weight_sum = told["w"] or 1.0
    total = docs.count()  # of all rows, those of unnamed sources too
    rate = F.col("__w") / F.lit(weight_sum) * F.lit(float(total)) / F.col("__n")
    parts = F.greatest(F.lit(1), F.ceil(F.col("__rate") / MAX_RATE)).cast("int")
    rates = (
        sizes.select("__source", "__n", rate.alias("__rate"))
        .withColumn("__parts", parts)
        .withColumn("__cdf", _distribution(F.col("__rate") / F.col("__parts")))
        .drop("__rate")
    )

    # Each uniform is hashed once and then compared with the whole distribution.
    uniforms = F.transform(F.sequence(F.lit(1), F.col("__parts")), lambda part: unit_hash(seed, F.col("__id"), part))
    copies = F.aggregate(uniforms, F.lit(0), lambda acc, u: acc + F.size(F.filter("__cdf", lambda c: c <= u)))
    if told["n"] <= BROADCAST_SOURCES:
        met = rows.join(F.broadcast(rates.drop("__n")), "__source")
    else:
        met = join_hot(rows, rates, "__source", "__n", "__id")
    drawn = met.withColumn("n_copies", copies).filter("n_copies > 0")
    out = drawn.select("*", F.explode(F.sequence(F.lit(0), F.col("n_copies") - 1)).alias("copy"))
    out = out.withColumn("shuffle_key", F.md5(F.concat_ws(":", F.lit(f"{seed}-order"), "__id", F.col("copy").cast("string"))))
    return out.select(*kept, "copy", "n_copies", "shuffle_key").repartitionByRange(
        "shuffle_key"
    ).sortWithinPartitions("shuffle_key")
