"""Word vectors learnt from a catalogue itself: co-occurrence, positive mutual information, randomized SVD.

Words of a product stand near each other in windows of its text, and near the labels of its category,
which are in two languages: the labels anchor the languages to each other, so a query in one finds
products named in the other, and products without a category through words that others share. What
is learnt is V x k numbers for a vocabulary of V words: pairs are counted by Spark, the matrix stays
a table of its rows, and each of the few products with a dense V x k block is one pass over it.

The driver holds the vocabulary (`VOCABULARY` words at most) and blocks of V x (k + 16) doubles. Words
beyond the vocabulary count by words that begin alike; what is not known at all counts as character
n-grams alone, which stand beside the learnt part of every vector.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark import workspace
from shelfmark.functions.text import _fold, fold
from shelfmark.functions.vocabulary import CATEGORY_LABELS, CATEGORY_SPELLINGS, lookup

from .vectors import HashedNgramEmbedder

VOCABULARY = 50_000
WINDOW = 8
_WORD = "[\\p{L}\\p{N}]{2,}"


def anchors() -> dict[str, list[str]]:
    """The words of each category's labels, in all spellings and languages."""
    texts = {key: [label] + [s for s, k in CATEGORY_SPELLINGS.items() if k == key] for key, label in CATEGORY_LABELS.items()}
    return {key: sorted(set(re.findall(r"[^\W_]{2,}", _fold(" ".join(t))))) for key, t in texts.items()}


def word_pairs(texts: DataFrame) -> DataFrame:
    """word, context, n (both ways) of `texts`, which has text and category: in a window, or a word and a label.

    Rows grow with the length of a text, not with its square; a word is no context of itself.
    """
    words = F.regexp_extract_all(fold(F.coalesce("text", F.lit(""))), F.lit(_WORD), F.lit(0))
    labels = {key: " ".join(found) for key, found in anchors().items()}
    told = F.split(lookup(labels, F.col("category")), " ")
    rows = texts.select(words.alias("words"), F.coalesce(told, F.array().cast("array<string>")).alias("labels"))
    near = F.expr(
        "flatten(transform(sequence(1, size(words)), i -> transform(slice(words, i + 1, "
        f"{WINDOW}), c -> struct(words[i - 1] AS word, c AS context))))"
    )
    named = F.expr("flatten(transform(words, w -> transform(labels, c -> struct(w AS word, c AS context))))")
    beside = F.expr(
        "flatten(transform(sequence(1, size(labels)), i -> transform(slice(labels, i + 1, size(labels)), c -> struct(labels[i - 1] AS word, c AS context))))"
    )
    none = F.array().cast("array<struct<word:string,context:string>>")
    pairs = F.concat(
        F.when(F.size("words") > 0, near).otherwise(none), named, F.when(F.size("labels") > 0, beside).otherwise(none)
    )
    one = rows.select(F.explode(pairs).alias("p")).select("p.word", "p.context").filter("word <> context")
    both = one.groupBy("word", "context").agg(F.count("*").alias("n"))
    both = both.unionAll(both.select(F.col("context").alias("word"), F.col("word").alias("context"), "n"))
    return both.groupBy("word", "context").agg(F.sum("n").alias("n"))


def associations(pairs: DataFrame, vocabulary: int = VOCABULARY) -> tuple[DataFrame, DataFrame]:
    """word, context, ppmi > 0 of the pairs among the most frequent words; and word, n of those words."""
    counts = pairs.groupBy("word").agg(F.sum("n").alias("n"))
    counts = counts.orderBy(F.desc("n"), "word").limit(vocabulary)
    inside = pairs.join(F.broadcast(counts.select("word")), "word", "left_semi")  # `vocabulary` words at most
    inside = inside.join(F.broadcast(counts.select(F.col("word").alias("context"))), "context", "left_semi")
    own = inside.groupBy("word").agg(F.sum("n").alias("of_word"))
    other = own.select(F.col("word").alias("context"), F.col("of_word").alias("of_context"))
    total = own.agg(F.sum("of_word").alias("total"))
    met = inside.join(F.broadcast(own), "word").join(F.broadcast(other), "context").join(F.broadcast(total))  # one row
    ppmi = F.log(F.col("n") * F.col("total") / (F.col("of_word") * F.col("of_context").cast("double")))
    return met.select("word", "context", ppmi.alias("ppmi")).filter("ppmi > 0"), counts


def _times(place: dict[str, int], block: np.ndarray):
    """Rows of the matrix times the block: one row of the product per word that a batch holds, in parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = np.array([place[w] for w in batch.column(0).to_pylist()], np.int64)
            col = np.array([place[w] for w in batch.column(1).to_pylist()], np.int64)
            own, at = np.unique(row, return_inverse=True)
            out = np.zeros((len(own), block.shape[1]))
            np.add.at(out, at, block[col] * batch.column(2).to_numpy()[:, None])
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array([x.tobytes() for x in out], pa.binary())], names=["at", "sum"])

    return run


def _product(matrix: DataFrame, words: list[str], block: np.ndarray) -> np.ndarray:
    place = {w: i for i, w in enumerate(words)}
    told = matrix.mapInArrow(_times(place, block), "at bigint, sum binary").toArrow()
    out = np.zeros_like(block)
    for at, part in zip(told.column("at").to_pylist(), told.column("sum").to_pylist(), strict=True):
        out[at] += np.frombuffer(part)
    return out


def factors(matrix: DataFrame, words: list[str], dimensions: int, rounds: int = 3, seed: int = 3) -> np.ndarray:
    """A row for each word: eigenvectors of the symmetric matrix, times the roots of the largest eigenvalues.

    A random block is multiplied and orthogonalized in turn until it spans what matters (randomized
    subspace iteration); then a small matrix is decomposed on the driver.
    """
    k = min(len(words), dimensions + 16)
    block = np.random.default_rng(seed).normal(size=(len(words), k))
    for _ in range(rounds):
        block = np.linalg.qr(_product(matrix, words, block))[0]
    values, turned = np.linalg.eigh(block.T @ _product(matrix, words, block))
    best = np.argsort(-values)[:dimensions]
    out = (block @ turned[:, best]) * np.sqrt(np.maximum(values[best], 0.0))
    return np.pad(out, ((0, 0), (0, dimensions - out.shape[1])))


class CorpusEmbedder:
    """Learnt word vectors and hashed n-grams side by side; `meaning` is the learnt part's share of a cosine."""

    def __init__(self, words: list[str], vectors: np.ndarray, weights: np.ndarray, meaning: float = 0.7):
        self.vectors, self.weights, self.meaning = np.asarray(vectors, np.float32), np.asarray(weights, np.float32), meaning
        self.place = {w: i for i, w in enumerate(words)}
        self.alike: dict[str, list[int]] = defaultdict(list)
        for w, i in self.place.items():
            self.alike[w[:5]].append(i)
        self.letters = HashedNgramEmbedder()
        digest = hashlib.sha256(" ".join(words).encode() + self.vectors.tobytes() + self.weights.tobytes())
        self.model_name = f"corpus-words-{self.vectors.shape[1]}-{digest.hexdigest()[:12]}"

    def embed(self, texts: list[str]) -> list[list[float]]:
        return [self._one(t) for t in texts]

    def _one(self, text: str) -> list[float]:
        learnt = np.zeros(self.vectors.shape[1])
        for word in re.findall(r"[^\W_]{2,}", _fold(text)):
            own = [self.place[word]] if word in self.place else self.alike.get(word[:5], []) if len(word) >= 5 else []
            for i in own:
                learnt += self.vectors[i] * (self.weights[i] / len(own))
        letters = np.array(self.letters.embed([text])[0])
        size = math.sqrt(float(learnt @ learnt))
        learnt = learnt * (math.sqrt(self.meaning) / size) if size > 0 else learnt
        return [*learnt.tolist(), *(letters * (math.sqrt(1 - self.meaning) / math.sqrt(float(letters @ letters)))).tolist()]


def train(products: DataFrame, dimensions: int = 48, vocabulary: int = VOCABULARY) -> CorpusEmbedder:
    """From name, attributes, enrichment and category of a catalogue's products."""
    spark = products.sparkSession
    text = F.concat_ws(" ", "name", "attributes.raw", "enrichment.description", "enrichment.applications")
    folder = workspace.new_folder(spark, "word-pairs")
    word_pairs(products.select(text.alias("text"), "category")).write.parquet(folder)
    matrix, counts = associations(spark.read.parquet(folder), vocabulary)
    found = counts.collect()  # `vocabulary` rows at most
    words = [r["word"] for r in found]
    folder = workspace.new_folder(spark, "word-matrix")
    matrix.write.parquet(folder)
    share = np.array([r["n"] for r in found], float) / max(1, sum(r["n"] for r in found))
    vectors = factors(spark.read.parquet(folder), words, dimensions) if words else np.zeros((0, dimensions))
    return CorpusEmbedder(words, vectors, 1e-3 / (1e-3 + share))


def save(embedder: CorpusEmbedder, spark: SparkSession, path: str) -> None:
    rows = [(w, i, float(embedder.weights[i]), embedder.vectors[i].tolist()) for w, i in embedder.place.items()]
    table = spark.createDataFrame(rows, "word string, place int, weight float, vector array<float>")
    told = {"meaning": F.lit(embedder.meaning), "dimensions": F.lit(embedder.vectors.shape[1])}
    table.withColumns(told).repartition(1).write.parquet(path)


def load(spark: SparkSession, path: str) -> CorpusEmbedder:
    rows = spark.read.parquet(path).orderBy("place").collect()  # a vocabulary's rows
    if not rows:
        return CorpusEmbedder([], np.zeros((0, 1)), np.zeros(0))
    vectors = np.array([r["vector"] for r in rows], np.float32)
    return CorpusEmbedder([r["word"] for r in rows], vectors, np.array([r["weight"] for r in rows]), rows[0]["meaning"])
