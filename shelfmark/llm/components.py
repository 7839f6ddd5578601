"""Connected components of a graph that no task or driver can hold.

Every task first contracts the edges it reads to a forest (`forest`), which turns groups of copies
into stars. Rounds of hooking and pointer jumping then join edges with labels. The labels of a hub
and of a large component's root are dealt to several tasks by `join_hot`; all other joins meet one
row per node. Minima are taken by aggregates, which add up before they shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import by_value, drop_table, join_hot, materialise

by_value()

#: Edges that a task holds before it contracts them.
CHUNK = 1_000_000


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from each node to the smallest node of its component in the graph of the edges a-b."""
    nodes, inverse = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = inverse[: len(a)], inverse[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        after = label.copy()
        for end in (label[x], label[y], x, y):
            np.minimum.at(after, end, low)
        while (up := after[after]).tobytes() != after.tobytes():
            after = up
        if np.array_equal(after, label):
            own = np.flatnonzero(label != np.arange(len(nodes)))
            return nodes[own], nodes[label[own]]
        label = after


class Links:
    """Edges that come in pieces; more than CHUNK of them are contracted to a forest."""

    def __init__(self):
        self.a, self.b, self.held = [], [], 0

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        self.a.append(a)
        self.b.append(b)
        self.held += len(a)
        if self.held > CHUNK:
            a, b = self.take()
            self.a, self.b, self.held = [a], [b], min(len(a), CHUNK // 2)

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.a:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return forest(np.concatenate(self.a), np.concatenate(self.b))


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    links = Links()
    for batch in batches:
        links.add(batch.column(0).to_numpy(), batch.column(1).to_numpy())
        if links.held >= CHUNK // 2:
            yield _edges(*links.take())
            links = Links()
    yield _edges(*links.take())


def _edges(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a.astype(np.int64)), pa.array(b.astype(np.int64))], names=["a", "b"])


def components(edges: DataFrame, rows: int | None = None) -> DataFrame:
    """node, comp: the smallest node of each connected component, for all nodes of the edges a, b (bigint).

    Loops and repeated edges do no harm. Every round is written to the shared folder and reread.
    `rows`: about how many edges there are, if that is known.
    """
    short = edges.select("a", "b").mapInArrow(_contracted, "a bigint, b bigint")
    alone = edges.filter("a = b").select("a", "b")  # a node whose only edge is a loop
    both = short.unionAll(short.select(F.col("b").alias("a"), F.col("a").alias("b"))).unionAll(alone)
    both = materialise(both.distinct(), "edges", few=rows is None, rows=rows)
    ends = both.count()
    low = both.groupBy("a").agg(F.min("b").alias("low"), F.count("*").alias("times"))
    labels = low.select(F.col("a").alias("node"), F.least("a", "low").alias("comp"), "times")
    labels = materialise(labels, "labels", rows=ends)
    total, most = labels.agg(F.count("*"), F.max("times")).collect()[0]
    while True:
        # `both` holds each edge both ways, so a node ends as many edges as it begins.
        near = join_hot(both.withColumnRenamed("b", "node"), labels.select("node", "comp", "times"), "node", "times", "a", total=ends, most=most or 0)
        near = near.groupBy("a").agg(F.min("comp").alias("near"))
        met = labels.join(near, labels["node"] == near["a"]).select("node", "comp", F.least("comp", "near").alias("near"))
        # The nodes and the tops of their components both take the neighbours' smallest label.
        told = met.select("node", "near").unionAll(met.filter("near < comp").select("comp", "near"))
        lower = told.groupBy("node").agg(F.min("near").alias("low"))
        hooked = labels.join(lower, "node").select("node", F.col("comp").alias("was"), F.least("comp", "low").alias("comp"), "times")
        hooked = materialise(hooked, "hooked", rows=total)
        if not hooked.filter("was <> comp").limit(1).count():
            drop_table(hooked)
            drop_table(both)
            return labels.select("node", "comp")
        sizes = hooked.groupBy(F.col("comp").alias("top")).agg(F.count("*").alias("size"))
        tops = hooked.select(F.col("node").alias("top"), F.col("comp").alias("above")).join(sizes, "top")
        # In a graph of few nodes no component is hot.
        jumped = join_hot(hooked.withColumnRenamed("comp", "top"), tops, "top", "size", "node", total=total, most=total)
        after = materialise(jumped.select("node", F.least("top", "above").alias("comp"), "times"), "labels", rows=total)
        drop_table(hooked)
        drop_table(labels)
        labels = after


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """The components after further links: those between components join them, as a graph of components."""
    ends = links.select("a", "b")
    size, nodes = ends.count(), labels.count()
    for end, other in (("a", "b"), ("b", "a")):
        count = ends.groupBy(end).agg(F.count("*").alias("times"))
        own = count.join(labels.select(F.col("node").alias(end), "comp"), end)
        ends = join_hot(ends, own, end, "times", other, "left").select(F.coalesce("comp", end).alias(end), other)
    above = components(ends.filter("a <> b"), rows=size)
    sizes = labels.groupBy("comp").agg(F.count("*").alias("times"))
    up = sizes.join(above.select(F.col("node").alias("comp"), F.col("comp").alias("higher")), "comp", "left")
    lifted = join_hot(labels.select("node", "comp"), up, "comp", "times", "node").select("node", F.coalesce("higher", "comp").alias("comp"))
    # Nodes without a label so far are components of their own.
    fresh = above.join(labels, "node", "left_anti")
    return materialise(lifted.unionAll(fresh), "labels", rows=nodes + size)
