"""Nearest neighbours by largest inner product: a vantage-point tree for each shard of the vectors.

Inner product becomes distance by one more coordinate: with M the largest norm of a shard, a vector
x gets sqrt(M^2 - |x|^2) and a query gets 0, so the nearest augmented vector has the largest inner
product. A subtree is skipped if the triangle inequality puts all of its inner products below the
k-th best so far, with all that rounding can add; `factor` widens that bound. Factor one never skips
a better neighbour. Scores are summed in component order; products of a leaf that are summed
otherwise only tell which points can reach the k-th best. Of equal scores the smaller ids stay.
Vectors of much smaller norm than the largest get trees of their own, as that norm sets the rounding.

Rows are dealt to shards of about `SHARD_ROWS` by hashed id. Every shard gets all queries, as rows
of the same sorted partition behind its vectors; it builds its tree, then streams the queries in
Arrow batches. A task holds one shard and one batch, whatever the table's size. Equal vectors are
one point of the tree that keeps its k + 1 smallest ids, which is all that a top-k can need.

Edge cases: vectors that are null, empty, zero or hold null or non-finite components take no part;
vectors are compared with those of their own length only; of rows that repeat an id the smallest
vector counts; ties go to the smaller id; a null id takes no part; fewer than k candidates are all
returned; an empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import by_value, small_batches

by_value()

SHARD_ROWS = 8192
LEAF = 512
#: Largest norm over smallest within one tree.
NORM_SPAN = 16.0


class VPTree:
    def __init__(self, points: np.ndarray, leaf: int = LEAF, seed: int = 5, index: np.ndarray | None = None):
        self.points, self.leaf = points, leaf
        self.squares = np.einsum("ij,ij->i", points, points)
        self.nodes: list[tuple] = []
        rng = np.random.default_rng(seed)
        self.root = self._build(np.arange(len(points)) if index is None else index, rng)

    def _build(self, index: np.ndarray, rng: np.random.Generator) -> int:
        if len(index) <= self.leaf:
            self.nodes.append((index,))
            return len(self.nodes) - 1
        vantage = self.points[index[rng.integers(len(index))]]
        away = np.sqrt(np.square(self.points[index] - vantage).sum(axis=1))
        order = np.argsort(away, kind="stable")
        half = len(order) // 2
        sides = []
        for part in (order[:half], order[half:]):
            near, far = float(away[part[0]]), float(away[part[-1]])
            sides.append((self._build(index[part], rng), near, far))
        self.nodes.append((vantage, *sides))
        return len(self.nodes) - 1

    def search(self, queries: np.ndarray, k: int, factor: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
        """Indices and distances of about the k nearest points of each query; -1 where there are fewer."""
        self.queries, self.factor = queries, factor
        self.best = np.full((len(queries), k), np.inf)
        self.found = np.full((len(queries), k), -1, dtype=np.int64)
        self.query_squares = np.einsum("ij,ij->i", queries, queries)
        self.visited = 0
        if len(queries):
            self._visit(self.root, np.arange(len(queries)))
        return self.found, self.best

    def _visit(self, node: int, who: np.ndarray) -> None:
        content = self.nodes[node]
        if len(content) == 1:
            return self._leaf(content[0], who)
        vantage, inner, outer = content
        d = np.sqrt(np.square(self.queries[who] - vantage).sum(axis=1))
        first = d <= (inner[2] + outer[1]) / 2
        for side, mine in ((inner, first), (outer, ~first)):
            if mine.any():
                self._visit(side[0], who[mine])
        for side, mine in ((outer, first), (inner, ~first)):
            if mine.any():
                go = self._may_improve(side, d[mine], who[mine])
                if go.any():
                    self._visit(side[0], who[mine][go])
        return None

    def _may_improve(self, side: tuple, d: np.ndarray, who: np.ndarray) -> np.ndarray:
        bound = np.maximum(np.maximum(side[1] - d, d - side[2]), 0.0)
        return bound * self.factor <= self.best[who].max(axis=1) + 1e-9

    def _leaf(self, index: np.ndarray, who: np.ndarray) -> None:
        self.visited += len(index) * len(who)
        k = self.best.shape[1]
        d2 = self.query_squares[who, None] + self.squares[index] - 2 * (self.queries[who] @ self.points[index].T)
        d = np.concatenate([self.best[who], np.sqrt(np.maximum(d2, 0.0))], axis=1)
        ids = np.concatenate([self.found[who], np.broadcast_to(index, (len(who), len(index)))], axis=1)
        keep = np.argpartition(d, k - 1, axis=1)[:, :k]
        self.best[who] = np.take_along_axis(d, keep, axis=1)
        self.found[who] = np.take_along_axis(ids, keep, axis=1)


class ProductTree(VPTree):
    """A tree over the rows `index` of augmented points, searched for the largest inner products."""

    def __init__(self, points: np.ndarray, index: np.ndarray, largest: float):
        super().__init__(points, index=index)
        self.largest = largest  # squared norm without the last coordinate
        #: More than any relative error of a sum over the components, or of a distance.
        self.eps = 8 * (points.shape[1] + 8) * np.finfo(float).eps

    def improve(self, queries: np.ndarray, best: np.ndarray, found: np.ndarray, factor: float) -> None:
        """Take the tree's points into the best scores, in falling order, and the points they are of."""
        self.queries, self.factor, self.best, self.found = np.column_stack([queries, np.zeros(len(queries))]), factor, best, found
        self.query_squares = np.einsum("ij,ij->i", queries, queries)
        self.visited = 0
        tiny = np.finfo(float).tiny
        longest = np.sqrt(self.query_squares) * np.sqrt(self.largest)
        self.slack = self.eps * longest + tiny
        self.loose = self.eps * (self.query_squares + self.largest) + tiny
        who = np.flatnonzero(~(longest + self.slack < best[:, -1]))  # written so that NaN is searched
        if len(who):
            self._visit(self.root, who)

    def _may_improve(self, side: tuple, d: np.ndarray, who: np.ndarray) -> np.ndarray:
        bound = np.maximum(side[1] - d, d - side[2]) - self.eps * (d + side[2]) - 1e-150
        most = (self.query_squares[who] + self.largest - np.square(np.maximum(bound, 0.0) * self.factor)) / 2
        return ~(most + self.loose[who] < self.best[who, -1])

    def _leaf(self, index: np.ndarray, who: np.ndarray) -> None:
        self.visited += len(index) * len(who)
        k = self.best.shape[1]
        queries, vectors = self.queries[who, :-1], self.points[index, :-1]
        rough, slack, low = queries @ vectors.T, self.slack[who], self.best[who, -1]
        if len(index) >= k:
            low = np.maximum(low, np.partition(rough, -k, axis=1)[:, -k] - slack)
        row, col = np.nonzero(~(rough + slack[:, None] < low[:, None]))
        # Summed in component order, as any engine sums it: equal vectors get equal scores.
        scores = np.zeros(len(row))
        for q, v in zip(np.ascontiguousarray(queries.T), np.ascontiguousarray(vectors.T), strict=True):
            scores += v[col] * q[row]
        touched, row = np.unique(row, return_inverse=True)
        at = who[touched]
        place = np.concatenate([np.repeat(np.arange(len(at)), k), row])
        point = np.concatenate([self.found[at].ravel(), index[col]])
        score = np.concatenate([self.best[at].ravel(), scores])
        order = np.lexsort((point, -score, place))
        place = place[order]
        order = order[np.arange(len(place)) - np.searchsorted(place, np.arange(len(at)))[place] < k]
        self.found[at] = point[order].reshape(-1, k)
        self.best[at] = score[order].reshape(-1, k)


class Shard:
    """The distinct vectors of a shard in the order of their smallest ids, and the trees over them."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int, factor: float):
        self.k, self.factor = k, factor
        vectors, inverse = np.unique(vectors, axis=0, return_inverse=True)
        order = np.lexsort((ids, inverse.ravel()))
        groups = np.split(ids[order], np.flatnonzero(np.diff(inverse.ravel()[order])) + 1)
        by_id = np.argsort([g[0] for g in groups], kind="stable")
        self.ids = [groups[i][: k + 1] for i in by_id]
        self.vectors = vectors[by_id]
        squares = np.einsum("ij,ij->i", self.vectors, self.vectors)
        points = np.column_stack([self.vectors, np.zeros(len(squares))])
        self.trees = []
        rest = np.arange(len(squares))
        while len(rest):
            largest = squares[rest].max()
            near = ~(squares[rest] < largest / NORM_SPAN**2)
            index, rest = rest[near], rest[~near]
            points[index, -1] = np.sqrt(np.maximum(largest - squares[index], 0.0))
            self.trees.append(ProductTree(points, index, largest))

    def search(self, ids: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        # One place more for the query's own row. A point that k + 1 others precede by score and
        # smallest id has k ids before all of its own.
        places = min(self.k + 1, len(self.vectors))
        best = np.full((len(queries), places), -np.inf)
        found = np.full((len(queries), places), len(self.vectors), dtype=np.int64)
        for tree in self.trees:
            tree.improve(queries, best, found, self.factor)
        out: list[tuple[int, int, float]] = []
        for q, row, points in zip(ids.tolist(), best.tolist(), found.tolist(), strict=True):
            hits = []
            for score, point in zip(row, points, strict=True):
                if point < len(self.ids):
                    hits += [(-score, v) for v in self.ids[point].tolist() if v != q]
            out += [(q, v, -s) for s, v in sorted(hits)[: self.k]]
        if not out:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        q, v, s = zip(*out, strict=True)
        return np.array(q, np.int64), np.array(v, np.int64), np.array(s)


def _search_partition(k: int, factor: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, ids, vectors, shard = None, [], [], None
        last = None
        for batch in batches:
            part, dim, kind, vec = (batch.column(i).to_numpy() for i in range(4))
            flat = batch.column(4).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            begin = np.concatenate([[0], np.cumsum(dim)])
            edges = np.flatnonzero((np.diff(part) != 0) | (np.diff(dim) != 0) | (np.diff(kind) != 0)) + 1
            for lo, hi in zip([0, *edges], [*edges, len(part)], strict=True):
                if lo == hi:
                    continue
                if (part[lo], dim[lo]) != group:
                    group, ids, vectors, shard, last = (part[lo], dim[lo]), [], [], None, None
                rows = flat[begin[lo] : begin[hi]].reshape(hi - lo, -1)
                fresh = np.diff(vec[lo:hi], prepend=vec[lo]) != 0  # sorted: of an id's rows the first counts
                fresh[0] = (kind[lo], vec[lo]) != last
                last = (kind[lo], vec[hi - 1])
                own, rows = vec[lo:hi][fresh], rows[fresh]
                if kind[lo] == 0:
                    ids.append(own)
                    vectors.append(rows)
                elif ids:
                    if shard is None:
                        shard = Shard(np.concatenate(ids), np.concatenate(vectors), k, factor)
                        ids, vectors = [True], []
                    columns = shard.search(own, rows)
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["query_id", "vec_id", "score"])

    return run


def usable(vector: Column) -> Column:
    """No null, no non-finite component, not zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def nearest(
    table: DataFrame,
    queries: Column,
    k: int = 20,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    factor: float = 1.0,
    shard_rows: int = SHARD_ROWS,
) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest other rows of each row that satisfies `queries`."""
    if factor < 1:
        raise ValueError("factor must be at least 1")
    small_batches(table.sparkSession, 4096)
    vectors = table.filter(F.col(id_col).isNotNull() & usable(F.col(vector_col))).select(
        F.col(id_col).cast("bigint").alias("id"),
        F.col(vector_col).alias("v"),
        F.size(vector_col).alias("dim"),
        queries.alias("asks"),
    )
    shards = max(1, math.ceil(table.count() / shard_rows))
    rows = vectors.select(F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("shard"), "dim", F.lit(0).alias("kind"), "id", "v")
    asked = vectors.filter("asks").select(
        F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), "dim", F.lit(1).alias("kind"), "id", "v"
    )
    found = (
        rows.unionAll(asked)
        .repartition(shards, "shard")
        .sortWithinPartitions("shard", "dim", "kind", "id", "v")
        .mapInArrow(_search_partition(k, factor), "query_id bigint, vec_id bigint, score double")
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
