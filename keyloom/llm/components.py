"""Connected components by alternating large and small stars, as DataFrames."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, discard, join_uneven, small_enough, written


def _with_least(rows: DataFrame, total: int) -> tuple[DataFrame, DataFrame]:
    """``rows(a, b)`` with ``m``, the least b of their a; and ``a, m, n`` for each a.

    The least is found by partial aggregation. The rows of a star's centre,
    however many, stay in their tasks.
    """
    least = rows.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
    return join_uneven(rows, least, "a", total), least


def _large_star(edges: DataFrame, n: int) -> DataFrame:
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    marked, _ = _with_least(both, 2 * n)
    return marked.filter("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b"))


def _small_star(edges: DataFrame, n: int) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    marked, least = _with_least(down, n)
    return marked.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))


def _settled(edges: DataFrame, label: str) -> DataFrame:
    return written(edges.filter("a <> b").distinct(), label)


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``edges(a, b)``, component the least node.

    Each round is written to the shared folder, so a lost executor costs a task,
    not a chain of rounds; what the next round doesn't need is deleted. The
    rounds grow with the logarithm of the longest chain; they end when one
    changes nothing, and each that changes anything lowers a node, so they do
    end. Self-loops, repeated and reversed edges are allowed; edges with a null
    end link nothing; no edges give no rows. A node of any number of edges is
    no task's alone. Only one number per round reaches the driver.
    """
    edges = _settled(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), "cc")
    before = None
    while True:
        stat = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).collect()[0]
        if stat.n == 0 or before == (stat.n, stat.h):
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
        before = (stat.n, stat.h)
        starred = written(_large_star(edges, stat.n), "cc-large")
        discard(edges)
        edges = _settled(_small_star(starred, stat.n), "cc")
        discard(starred)


def _roots(root: np.ndarray, i: np.ndarray) -> np.ndarray:
    r = root[i]
    while (r != (up := root[r])).any():
        r = up
    return r


def unite(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Join the trees of the linked ``i`` and ``j``; ``root`` points to smaller places, a tree's least to itself."""
    while True:
        i, j = _roots(root, i), _roots(root, j)
        apart = i != j
        if not apart.any():
            return
        i, j = i[apart], j[apart]
        np.minimum.at(root, np.maximum(i, j), np.minimum(i, j))


def few_components(edges: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``connected_components``; edges without nulls that are at most ``limit`` by count are united by one task, without rounds."""
    if not small_enough(edges, limit):
        return connected_components(edges)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            a, b = (pa.Table.from_batches(held)[c].to_numpy() for c in ("a", "b"))
            node, at = np.unique(np.concatenate([a, b]), return_inverse=True)
            root = np.arange(len(node))
            unite(root, at[: len(a)], at[len(a) :])
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(node[_roots(root, np.arange(len(node)))])], ["node", "component"])

    return edges.select("a", "b").filter("a <> b").coalesce(1).mapInArrow(run, "node long, component long")
