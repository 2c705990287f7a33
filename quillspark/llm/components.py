"""Connected components of a distributed edge list."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quillspark.llm.common import checkpointed

#: Links that one task contracts to a forest.
CHUNK = 250_000


class Forest:
    """Union-find that tells whether a link joins two trees."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        up = self.up
        root = x
        while (y := up.get(root, root)) != root:
            root = y
        while x != root:
            up[x], x = root, up.get(x, x)
        return root

    def join(self, x: int, y: int) -> bool:
        a, b = self.find(x), self.find(y)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def contract(edges: DataFrame) -> DataFrame:
    """Links with the same components, fewer where many join what is joined already.

    Stored links go in chunks of about CHUNK through a union-find each, which passes on only links that
    join two of its trees.  The number of chunks follows the number of links.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest()
        for batch in batches:
            pairs = [p for p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if forest.join(*p)]
            if pairs:
                u, v = zip(*pairs)
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return edges.select("u", "v").coalesce(max(1, -(-edges.count() // CHUNK))).mapInArrow(run, "u long, v long")


def _closed(edges: DataFrame) -> DataFrame:
    """(node, root) of at most CHUNK links, by one union-find."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, nodes = Forest(), set()
        for batch in batches:
            for p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                nodes.update(p)
                forest.join(*p)
        found = list(nodes)
        for a in range(0, len(found), 10_000):
            part = found[a : a + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([forest.find(x) for x in part], pa.int64())], names=["node", "root"])

    return edges.select("u", "v").coalesce(1).mapInArrow(run, "node long, root long")


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the least node of its neighbourhood."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")


def _small_star(edges: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the least of them (edges have u > v)."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    joined = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return joined.unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node that has an edge; root is the least node reachable.  Nodes are longs.

    Alternating large-star and small-star rounds: each groups by node with map-side
    minima, so a hub costs its neighbours' rows once and no task gathers a component.
    Rounds are logarithmic in the longest path.  Every round ends in a checkpoint.
    As soon as CHUNK links or fewer are left, one union-find ends it without further rounds.
    Self-links and repeated links are harmless; no edges give no rows.
    """
    links = contract(checkpointed(edges.select(F.col("u").cast("long"), F.col("v").cast("long"))))
    state = checkpointed(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct())
    seen = None
    while True:
        mark = state.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if mark == seen or not mark[0]:
            break
        if mark[0] <= CHUNK:
            return checkpointed(_closed(state))
        seen = mark
        state = checkpointed(_small_star(_large_star(state).distinct()).distinct())
    roots = state.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return state.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
