"""Quality classifier: random Fourier features, ridge by partition-summed normal equations, isotonic calibration.

Every text becomes `STATS` numbers about its characters, words and lines. Random Fourier features
of the standardized numbers approximate a Gaussian kernel; each partition sums its part of the
normal equations and the small sums are added. The ridge score is calibrated by isotonic regression
on a fold that the weights never saw.

Labels are learnt from a sample of at most `train_rows` labelled rows, those with the smallest
hashed ids; everything that is scored is scored on its whole text, however long. All sums are
made in one order of rows and partitions, so a fit does not depend on how the input is cut.

Edge cases: null and empty texts have all-zero statistics and a score like any other; null labels
teach nothing, and of several labels for an id the largest counts; of several texts for an id one is
learnt, that of the smallest hash; without labels to learn from every score is 0.5; with one class
only, its value; empty tables give empty results; repeated rows are scored each; a null id counts as
held out; extra columns are carried if named, but for `score` and `predicted`, whose new values win.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import Shipped, as_bytes, by_value, crc_fold, materialise, small_batches, with_text

by_value()

TRAIN_ROWS = 20_000
FEATURES, RIDGE, WIDTH_FACTOR = 256, 1e-3, 1.0
#: Partitions of the training sample, each of which sends one FEATURES x FEATURES sum.
SUMS = 8
CALIBRATION_FOLD = 4

_GROUPS = (b"|", b"!", b"%*$&#@^~", b".", b",", b"?:;", b"<>{}[]()\\/=+_`", b"\"'-")


def _byte_classes() -> np.ndarray:
    classes = np.full(256, 15, dtype=np.int64)
    for b in range(256):
        if 65 <= b <= 90:
            classes[b] = 0
        elif 97 <= b <= 122:
            classes[b] = 1
        elif 48 <= b <= 57:
            classes[b] = 2
        elif b == 10:
            classes[b] = 3
        elif b == 32:
            classes[b] = 4
        elif b >= 128:
            classes[b] = 5
    for i, group in enumerate(_GROUPS):
        for b in group:
            classes[b] = 6 + i
    return classes


STATS = 16 + 11


def statistics(text: bytes | None) -> list[float]:
    text = text or b""
    n = len(text)
    if not n:
        return [0.0] * STATS
    counts = np.bincount(_byte_classes_cached()[np.frombuffer(text, dtype=np.uint8)], minlength=16) / n
    words, lines = text.split(), text.split(b"\n")
    w = len(words)
    distinct = len(set(words))
    pairs = len(set(zip(words, words[1:], strict=False))) if w > 1 else w
    short = sum(len(x) <= 3 for x in words)
    return [
        *counts.tolist(),
        np.log1p(n),
        np.log1p(w),
        (n - w) / max(1, w) / 10,
        distinct / max(1, w),
        pairs / max(1, w - 1),
        np.log1p(w) - np.log1p(distinct),
        short / max(1, w),
        len(set(lines)) / len(lines),
        np.log1p(n / len(lines)),
        np.log1p(len(lines)),
        max(map(len, words), default=0) ** 0.5 / 10,
    ]


_classes: list[np.ndarray] = []


def _byte_classes_cached() -> np.ndarray:
    if not _classes:
        _classes.append(_byte_classes())
    return _classes[0]


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: knots and values of the best non-decreasing fit."""
    spots, at = np.unique(x, return_inverse=True)  # equal scores are one block from the start
    weight, total = np.bincount(at), np.bincount(at, y)
    blocks: list[list[float]] = []  # sum of y, count, sum of x
    for a, n, b in zip(spots, weight, total, strict=True):
        blocks.append([b, n, a * n])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last, strict=True)]
    return np.array([b[2] / b[1] for b in blocks]), np.array([b[0] / b[1] for b in blocks])


def calibrated(raw: np.ndarray, knots: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The isotonic value, interpolated; a thousandth of the raw score keeps ties in order."""
    fit = np.interp(raw, knots, values) if len(knots) else raw
    return np.clip(0.999 * fit + 0.001 * np.clip(raw, 0, 1), 0, 1)


class Model:
    """A fitted classifier; `constant` stands in where there was nothing to learn."""

    def __init__(self, constant: float | None = None):
        self.constant = constant

    def basis(self, stats: np.ndarray) -> np.ndarray:
        z = (stats - self.mean) / self.scale
        waves = np.cos(np.clip(z, -8, 8) @ self.directions + self.phases) * np.sqrt(2 / FEATURES)
        return np.column_stack([np.ones(len(z)), waves])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.basis(stats) @ self.weights

    def score(self, texts: list[bytes | None]) -> np.ndarray:
        if self.constant is not None or not texts:
            return np.full(len(texts), self.constant if self.constant is not None else 0.5)
        stats = np.array([statistics(t) for t in texts])
        return calibrated(self.raw(stats), self.knots, self.values)


def training_sample(docs: DataFrame, labels: DataFrame, label: str, train_rows: int) -> DataFrame:
    """doc_id, h, text, y, fold of documents outside fold 0 that have one of `train_rows` labels.

    The chosen labels are at most `train_rows` rows of three numbers, so they are broadcast. An id
    may repeat here; `one_of_each` leaves one row of an id, so at most `train_rows` in all.
    """
    fold = crc_fold(F.col("doc_id"))
    chosen = (
        labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
        .groupBy("doc_id")
        .agg(F.max(label).alias("y"))
        .select("doc_id", F.col("y").cast("int").alias("y"), fold.cast("int").alias("fold"))
        .filter("fold <> 0")
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(train_rows)
    )
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return texts.join(F.broadcast(chosen), "doc_id").select("doc_id", F.xxhash64("text").alias("h"), "text", "y", "fold")


def one_of_each(sample: DataFrame, value: str) -> DataFrame:
    """doc_id, `value`, y and fold of one row for each id; copies go in the map tasks already."""
    least = sample.groupBy("doc_id", "y", "fold").agg(F.min(F.struct("h", value)).alias("t"))
    return least.select("doc_id", f"t.{value}", "y", "fold")


def _stats_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        stats = [[float(v) for v in statistics(t)] for t in as_bytes(batch.column(2))]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(stats, pa.list_(pa.float64())), batch.column(3), batch.column(4)],
            names=["doc_id", "h", "stats", "y", "fold"],
        )


def _matrix(column) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, STATS)


def _summed(rows: DataFrame, shape: tuple[int, int], add) -> np.ndarray:
    """The sum of add(stats, y) over all rows. Partitions give the rows of their matrices, and each row
    is added up in the order of partitions, so the driver gets a single matrix.
    """

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, part = np.zeros(shape), None
        for batch in batches:
            if len(batch):
                total += add(_matrix(batch.column(1)), batch.column(2).to_numpy())
                part = batch.column(0)[0].as_py()
        if part is not None:
            columns = [pa.array(np.full(shape[0], part, np.int32)), pa.array(np.arange(shape[0], dtype=np.int32))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(list(total), pa.list_(pa.float64()))], names=["part", "row", "total"])

    dealt = rows.repartition(SUMS, "doc_id").sortWithinPartitions("doc_id").select(F.spark_partition_id().alias("part"), "stats", "y")
    parts = dealt.mapInArrow(sums, "part int, row int, total array<double>")
    by_row = parts.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("part", "total"))).alias("all"))
    rest = F.slice("all", 2, F.size("all"))
    added = F.aggregate(rest, F.col("all")[0]["total"], lambda acc, x: F.zip_with(acc, x["total"], lambda a, b: a + b))
    out = np.zeros(shape)
    for r in by_row.select("row", added.alias("total")).collect():
        out[r["row"]] = r["total"]
    return out


def ridge(gram: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Weights that minimize the penalized squared error; the intercept, column 0, is all but free."""
    penalty = RIDGE * max(1.0, gram[0, 0]) * np.eye(len(gram))
    penalty[0, 0] = 1e-9
    return np.linalg.solve(gram + penalty, right)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", train_rows: int = TRAIN_ROWS, seed: int = 11) -> Model:
    small_batches(docs.sparkSession)
    sample = training_sample(docs, labels, label, train_rows)
    kind = f"doc_id {sample.schema['doc_id'].dataType.simpleString()}, h bigint, stats array<double>, y int, fold int"
    # Statistics of the copies of an id leave the map task once, and no text leaves it.
    sample = materialise(one_of_each(sample.mapInArrow(_stats_rows, kind), "stats"), "quality-sample")
    moments = _summed(sample, (3, STATS), lambda x, y: np.stack([np.full(STATS, len(x)), x.sum(axis=0), np.full(STATS, (y == 1).sum())]))
    n, ones = moments[0, 0], moments[2, 0]
    if not n:
        return Model(0.5)
    if ones in (0, n):
        return Model(float(ones / n))
    model = Model()
    model.mean = moments[1] / n
    mean = model.mean
    spread = _summed(sample, (1, STATS), lambda x, y: np.square(x - mean).sum(axis=0)[None])
    model.scale = np.maximum(np.sqrt(spread[0] / n), 1e-6)
    rng = np.random.default_rng(seed)
    model.directions = rng.normal(size=(STATS, FEATURES)) * (WIDTH_FACTOR / np.sqrt(STATS))
    model.phases = rng.uniform(0, 2 * np.pi, FEATURES)
    basis = model.basis
    size = FEATURES + 1

    def normal(stats: np.ndarray, y: np.ndarray) -> np.ndarray:
        x = basis(stats)
        return np.column_stack([x.T @ x, x.T @ (y == 1)])

    total = _summed(sample.filter(F.col("fold") != CALIBRATION_FOLD), (size, size + 1), normal)
    model.weights = ridge(total[:, :size], total[:, size])
    # A part of the bounded sample; isotonic regression sorts, so the order of rows plays no part.
    held = sample.filter(F.col("fold") == CALIBRATION_FOLD).select("stats", "y").toArrow()
    if len(held):
        raw = model.raw(_matrix(held.column(0).combine_chunks()))
        model.knots, model.values = isotonic(raw, (held.column(1).to_numpy() == 1).astype(float))
    else:
        model.knots = model.values = np.zeros(0)
    return model


def add_scores(docs: DataFrame, model, carry: list[str], text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The `carry` columns with score and predicted; `model.score` gets the texts of a batch."""
    small_batches(docs.sparkSession)
    kept = [c for c in carry if c.lower() not in ("score", "predicted")]
    schema = T.StructType(
        [docs.schema[c] for c in kept] + [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]
    )
    shared = Shipped(docs.sparkSession, model)
    rows, at = with_text(docs, kept, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            scores = own.score(as_bytes(batch.column(at)))
            columns = [batch.column(i) for i in range(len(kept))]
            columns += [pa.array(scores, pa.float64()), pa.array((scores >= threshold).astype(np.int32), pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return rows.mapInArrow(run, schema)
