"""Connected components of an edge table, by alternating large stars and small stars.

Each round hangs the neighbours of a node on its least neighbour: first the larger ones
(large star), then the smaller ones and the node itself (small star).  When a round
changes nothing every edge leads from a node to its component's least node.  Minima are
aggregated before the shuffle and joined back, so a node with very many neighbours is
no task of its own, and every round is settled in the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from simforge.llm import frames


#: Edges of which a task keeps a forest at a time.
FOREST_EDGES = 500_000


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (node, its root) that connect what the task's edges connect."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = x = root[root[x]]
        return x

    def out() -> pa.RecordBatch:
        pairs = [(x, find(x)) for x in root]
        pairs = [(x, y) for x, y in pairs if x != y]
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in pairs], pa.int64()), pa.array([y for _, y in pairs], pa.int64())], ["a", "b"])

    for batch in batches:
        for a, b in zip(batch["a"].to_pylist(), batch["b"].to_pylist()):
            x, y = find(a), find(b)
            if x != y:
                root[max(x, y)] = min(x, y)
        if len(root) > FOREST_EDGES:
            yield out()
            root.clear()
    yield out()


def thinned(edges: DataFrame) -> DataFrame:
    """Fewer edges (a, b) with the same components, of a settled table: each task replaces what it reads by a forest,
    so a group whose members are linked with one another in very many ways costs its members."""
    parts = max(1, -(-edges.count() // FOREST_EDGES))
    return edges.select("a", "b").coalesce(parts).mapInArrow(_forest, "a long, b long")


def _with_least(edges: DataFrame) -> DataFrame:
    """(u, v, m): m is the least of u and its neighbours v."""
    least = edges.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return edges.join(least, "u")


def _print(edges: DataFrame):
    return edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for the nodes of ``edges`` (a, b), two columns of longs; label is the least node."""
    now = frames.settled(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = _print(now)
    while before[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = _with_least(large)
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        now = frames.settled(small, "edges")
        after = _print(now)
        if after == before:
            break
        before = after
    own = now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(own)
