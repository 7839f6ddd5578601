"""Where intermediate tables live, and small column helpers.

On a cluster every intermediate table is written under ``spark.checkpoint.dir``, which all
executors and the driver share, so a lost executor costs a re-read and never a recomputation
from half-lost blocks.
"""

from __future__ import annotations

import pickle
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one only in single-JVM local mode."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    context = spark.sparkContext
    if not (context.master == "local" or context.master.startswith("local[")):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if context.applicationId not in _own_dirs:
        _own_dirs[context.applicationId] = tempfile.mkdtemp(prefix="shelfmark-")
    return _own_dirs[context.applicationId]


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


#: Narrow rows in a file of a table whose size is known.
FILE_ROWS = 20_000


def materialise(df: DataFrame, tag: str, few: bool = False, rows: int | None = None) -> DataFrame:
    """Write `df` as Parquet in the shared folder and read it back: cuts lineage and pins ids.

    `few`: the rows are small for the tasks that make them, so they are gathered into files of the
    advisory partition size first. Many small files cost more than that exchange. `rows`: about how
    many rows there are, if that is known; then files have `FILE_ROWS` each.
    """
    spark = df.sparkSession
    path = new_path(spark, tag)
    if rows is not None:
        df = df.repartition(min(max(1, -(-rows // FILE_ROWS)), 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    (df.hint("rebalance") if few else df).write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_table(df: DataFrame) -> None:
    """Delete the files behind a table made by `materialise` that nothing reads any more."""
    spark = df.sparkSession
    root = shared_dir(spark)
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if folder.removeprefix("file:").lstrip("/").startswith(root.removeprefix("file:").lstrip("/")):
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: A key of more rows than this and than a share of 1 in HOT_KEYS of all rows is dealt to several tasks.
HOT_ROWS, HOT_KEYS = 500, 1000


def join_hot(
    left: DataFrame, right: DataFrame, key: str, times: str, spread: str, how: str = "inner", total: int | None = None, most: int | None = None
) -> DataFrame:
    """`left` joined with `right`, which has one row per key and in `times` how many rows of `left` have it.

    Rows of a hot key are dealt by the hashed column `spread` to as many tasks as its share of all
    rows asks for, each with a copy of its row of `right`. Fewer than HOT_KEYS keys can be hot, by
    their definition, so those are broadcast. Null keys, which match nothing, are dealt out too.
    Where no key is hot this is a plain join. `total`, `most`: the sum and the maximum of `times`, where known.
    """
    spark = left.sparkSession
    if total is None or most is None:
        total, most = (x or 0 for x in right.agg(F.sum(times), F.max(times)).collect()[0])
    limit = max(HOT_ROWS, total // HOT_KEYS)
    if most <= limit and how != "left":
        return left.join(right.drop(times), key, how)
    pieces = F.ceil(F.col(times) / F.lit(limit)).cast("int")
    hot = right.filter(F.col(times) > limit).select(F.col(key).alias("__hot"), pieces.alias("__pieces"))
    lone = F.when(F.col(key).isNull(), int(spark.conf.get("spark.sql.shuffle.partitions"))).otherwise(1)
    dealt = left.join(F.broadcast(hot), F.col(key) == F.col("__hot"), "left").withColumn(
        "__piece", F.pmod(F.xxhash64(spread), F.coalesce("__pieces", lone)).cast("int")
    )
    copies = F.sequence(F.lit(0), F.greatest(pieces, F.lit(1)) - 1)
    right = right.withColumn("__piece", F.explode(copies)).drop(times)
    return dealt.drop("__hot", "__pieces").join(right, [key, "__piece"], how).drop("__piece")


def unit_hash(*parts: Column | str) -> Column:
    """A double in [0, 1) from the MD5 of the parts joined by ':'; the same in any SQL engine."""
    text = F.concat_ws(":", *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint") / F.lit(float(2**52))


def crc_fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5. Fold 0 is held out; a null id counts as held out."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(5)), F.lit(0))


def by_value() -> None:
    """Ship this package's functions inside the task, so executors need no copy of it on their path."""
    import shelfmark
    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(shelfmark)


class Shipped:
    """A value broadcast with the code of its classes; `value` unpacks it, so a task asks once."""

    def __init__(self, spark: SparkSession, value):
        from pyspark import cloudpickle

        self.box = spark.sparkContext.broadcast(cloudpickle.dumps(value))

    @property
    def value(self):
        return pickle.loads(self.box.value)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Texts can be long: Arrow batches of 1,000 rows, unless the session has its own setting."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(rows))


def as_bytes(column) -> list[bytes | None]:
    """The UTF-8 bytes of an Arrow string column, without decoding them."""
    import pyarrow as pa

    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    return column.cast(pa.large_binary() if large else pa.binary()).to_pylist()


def with_text(docs: DataFrame, kept: list[str], text_col: str) -> tuple[DataFrame, int]:
    """The kept columns with the text among them or behind them, and the text's place."""
    if text_col in kept:
        return docs.select(*kept), kept.index(text_col)
    return docs.select(*kept, F.col(text_col).alias("__text")), len(kept)
