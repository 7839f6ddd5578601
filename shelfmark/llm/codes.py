"""Vector codes of one byte a part: codebooks by Lloyd's rounds that only move what has changed.

Vectors become integers, are cut into `PARTS` parts, and each part position has a codebook. The sums
and counts of each entry's parts are kept from round to round. A round assigns all parts where they
are, keeps the assignments beside the vectors in a table, and of those parts alone whose entry has
changed sends plus to the new entry and minus from the old, added up in each task first. So the
shuffle shrinks as the rounds settle. The driver holds the codebooks and their sums (`ENTRIES` times
the length of a vector), whatever the table's size. Arithmetic is on integers, and exact.

Edge cases: vectors that are null or hold null or non-finite components are dropped; zero vectors
are not. Vectors of other lengths than the longest, or of lengths that the number of parts doesn't
divide, count as if followed by zeros. Components beyond what lets an error fit a long (for 64 of
them, inputs beyond about 130,000) count as that bound. Fewer vectors than entries make fewer
entries. Ties go to the lower entry. Rows that repeat stay rows; a null id sorts last; an empty table
gives an empty result and empty codebooks. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import Shipped, by_value, drop_table, join_hot, materialise

by_value()

PARTS, ENTRIES, SCALE = 4, 256, 1024
#: Rows whose distances a task holds at a time.
BLOCK = 2048
_COLUMNS = ["vec_id", "label", "vector", "code", "error", "part", "entry", "sums"]
_SCHEMA = "vec_id bigint, label string, vector binary, code binary, error bigint, part int, entry int, sums array<bigint>"


def usable(vector: Column) -> Column:
    """Not null, and no component null or not finite."""
    return F.coalesce(~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(False))


def bound(dims: int) -> int:
    """Components up to this have squared distances that fit a long."""
    return int(2.0**31.4 / max(1, dims) ** 0.5 / 2)


def as_integers(vectors: list[np.ndarray], dims: int) -> np.ndarray:
    """floor(SCALE * x) of each component, in rows of `dims`."""
    out = np.zeros((len(vectors), dims), np.float64)
    for row, v in zip(out, vectors, strict=True):
        row[: len(v)] = np.floor(np.asarray(v, np.float64) * SCALE)
    return np.clip(out, -bound(dims), bound(dims)).astype(np.int64)


def nearest(parts: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each row, the lowest of equals, and the squared distance."""
    entry, away = np.zeros(len(parts), np.int64), np.zeros(len(parts), np.int64)
    most = int(max(np.abs(parts).max(initial=0), np.abs(book).max(initial=0)))
    for lo in range(0, len(parts), BLOCK):
        some = parts[lo : lo + BLOCK]
        if 4 * parts.shape[1] * most * most < 1 << 53:  # all sums are whole numbers that a double holds
            p, b = some.astype(np.float64), book.astype(np.float64)
            d = (p * p).sum(axis=1)[:, None] - 2 * (p @ b.T) + (b * b).sum(axis=1)
        else:
            d = np.zeros((len(some), len(book)), np.int64)
            for j in range(parts.shape[1]):
                d += np.square(some[:, j, None] - book[None, :, j])
        best = d.argmin(axis=1)
        entry[lo : lo + BLOCK], away[lo : lo + BLOCK] = best, d[np.arange(len(some)), best]
    return entry, away


def _batch(**columns) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    kinds = [pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64())]
    arrays = [columns[c].cast(k) if c in columns else pa.nulls(n, k) for c, k in zip(_COLUMNS, kinds, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, names=_COLUMNS)


def _round(shipped: Shipped, dims: int, moves: bool):
    """Rows with their codes; then, if `moves`, what the task adds to and takes from the entries' sums and counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = shipped.value
        width = dims // PARTS
        change = np.zeros((PARTS, books.shape[1], width + 1), np.int64)
        touched = np.zeros((PARTS, books.shape[1]), bool)
        for batch in batches:
            if batch.schema.names[2] == "embedding":
                vectors = as_integers(batch.column(2).to_numpy(zero_copy_only=False).tolist(), dims)
                was = None
            else:
                vectors = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.int32).reshape(-1, dims).astype(np.int64)
                was = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint8).reshape(-1, PARTS)
            codes = np.zeros((len(vectors), PARTS), np.uint8)
            error = np.zeros(len(vectors), np.int64)
            for p in range(PARTS):
                own = vectors[:, p * width : (p + 1) * width]
                entry, away = nearest(own, books[p])
                codes[:, p] = entry
                error += away
                if moves:
                    moved = np.ones(len(own), bool) if was is None else entry != was[:, p]
                    plus = np.column_stack([np.ones(moved.sum(), np.int64), own[moved]])
                    np.add.at(change[p], entry[moved], plus)
                    touched[p, entry[moved]] = True
                    if was is not None:
                        np.subtract.at(change[p], was[moved, p], plus)
                        touched[p, was[moved, p]] = True
            blob = vectors.astype(np.int32)
            yield _batch(
                vec_id=batch.column(0),
                label=batch.column(1),
                vector=pa.array([v.tobytes() for v in blob], pa.binary()),
                code=pa.array([c.tobytes() for c in codes], pa.binary()),
                error=pa.array(error),
            )
        part, entry = np.nonzero(touched)
        if len(part):
            yield _batch(part=pa.array(part), entry=pa.array(entry), sums=pa.array(change[part, entry].tolist(), pa.list_(pa.int64())))

    return run


def _moved(table: DataFrame) -> list:
    """part, entry, place (0: the count) and the sum of all tasks' changes there."""
    told = table.filter("sums is not null").select("part", "entry", F.posexplode("sums").alias("place", "sum"))
    return told.groupBy("part", "entry", "place").agg(F.sum(F.col("sum").cast("decimal(38,0)")).alias("sum")).collect()


def encode(
    table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", rounds: int = 4
) -> tuple[DataFrame, np.ndarray]:
    """vec_id, label, code (one byte a part) and error of each usable vector; and the codebooks: part, entry, place."""
    spark = table.sparkSession
    kept = table.filter(usable(F.col(vector_col))).select(
        F.col(id_col).cast("bigint").alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).alias("embedding")
    )
    longest = kept.agg(F.max(F.size("embedding"))).collect()[0][0] or 0
    dims = PARTS * -(-longest // PARTS)
    first = kept.orderBy(F.asc_nulls_last("vec_id"), "embedding").limit(ENTRIES).select("embedding").collect()
    books = as_integers([r[0] for r in first], dims).reshape(len(first), PARTS, dims // PARTS).transpose(1, 0, 2).astype(object)
    # Counts and sums as Python's integers: they grow with the table.
    sums = np.zeros((*books.shape[:2], dims // PARTS + 1), object)
    now = kept
    for turn in range(rounds + 1):
        box, last = Shipped(spark, books.astype(np.int64)), now
        now = materialise(last.select(*last.columns[:4]).mapInArrow(_round(box, dims, turn < rounds), _SCHEMA), "codes")
        if turn:
            drop_table(last.table)
        for r in _moved(now) if turn < rounds else []:
            sums[r["part"], r["entry"], r["place"]] += int(r["sum"])
        used = sums[:, :, :1] > 0
        if turn < rounds:
            books = np.where(used, sums[:, :, 1:] // np.where(used, sums[:, :, :1], 1), books)
        rows = now.filter("sums is null")
        rows.table = now
        now = rows
    return now.select("vec_id", "label", "code", "error"), books.astype(np.int64)


def books_text(books: np.ndarray) -> str:
    return ",".join(map(str, books.ravel().tolist()))


def coded(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, code in hex, error, label_error (the sum over equal labels, nulls together), codebooks_sha256."""
    rows, books = encode(table, id_col, vector_col, label_col)
    rows = rows.withColumn("key", F.coalesce(F.concat(F.lit("="), "label"), F.lit("")))
    by_label = rows.groupBy("key").agg(F.sum("error").alias("label_error"), F.count("*").alias("times"))
    out = join_hot(rows.withColumn("deal", F.xxhash64("vec_id", "code")), by_label, "key", "times", "deal")
    digest = hashlib.sha256(books_text(books).encode()).hexdigest()
    return out.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
