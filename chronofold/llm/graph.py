"""Connected components: blocks of edges shrink to stars, which alternating large-star and small-star steps join."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronofold.llm.shared import Scratch

#: Edges that a task takes at a time; a graph of no more needs no step.
BLOCK = 1 << 18


def stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root): the smallest node that these edges reach, for every other node of theirs."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while len(a):
        x, y = root[a], root[b]
        a, b, x, y = (z[x != y] for z in (a, b, x, y))
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]
    moved = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[moved], nodes[root[moved]]


def _shrunk(edges: DataFrame, block: int) -> DataFrame:
    """Edges (u, v) with the components of ``edges``: the stars of each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def found() -> pa.RecordBatch:
            ends = stars(*(np.concatenate([b.column(k).to_numpy() for b in held]) for k in (0, 1)))
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in ends], names=["u", "v"])

        for batch in batches:
            held, n = [*held, batch], n + batch.num_rows
            if n >= block:
                yield found()
                held, n = [], 0
        if held:
            yield found()

    return edges.select("u", "v").mapInArrow(run, "u long, v long")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(low.select("u", F.col("m").alias("v")))


def components(edges: DataFrame, scratch: Scratch, name: str = "components", block: int = BLOCK) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v), both long; the root is the smallest node it reaches.

    Each task first shrinks its edges, ``block`` of them at a time, to stars.  Up to that number they are
    one block, whose stars are the components: without steps, each of which costs the driver plans, threads
    and broadcasts.  Else the steps join the stars of the blocks.

    Both steps are a grouped minimum, which Spark combines before the shuffle, and an equi-join
    that adaptive execution splits where one node has very many edges.  Each round is written to
    the shared folder, so lineage stays short and a lost executor costs one round at most.  Rounds
    grow with the logarithm of the diameter.
    """
    given = scratch.table(f"{name}-edges", edges.select(F.col("u").cast("long"), F.col("v").cast("long")).where("u <> v").distinct())
    n = given.count()
    now = scratch.table(f"{name}-0", _shrunk(given.coalesce(1), n + 1) if n <= block else _shrunk(given, block).distinct())
    scratch.drop(f"{name}-edges")
    mark, k = _mark(now) if n > block else (0, 0), 0
    while mark[0]:
        k += 1
        then = scratch.table(f"{name}-{k}", _small_star(_large_star(now).distinct()).distinct())
        seen, mark = mark, _mark(then)
        scratch.drop(f"{name}-{k - 1}")
        now = then
        if mark == seen:
            break
    nodes = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _mark(edges: DataFrame) -> tuple[int, int]:
    """Count and sum of hashes: equal for equal sets of edges."""
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], int(row[1] or 0)
