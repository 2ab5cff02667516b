"""Connected components of an edge table, by contraction.

Each partition joins its edges in a union-find of its own, which leaves stars.  A node that different partitions gave
different roots links those roots; these links are a smaller graph over roots, solved the same way, until no link is
left.  Nothing is collected, no group of rows is gathered by component, and a round's tables lie in the shared folder.

Edges may repeat, come in either direction and join a node with itself; nodes without edges have no row; an edge table
without rows gives none.  Ends are never null.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, table


class Forest:
    """Union-find whose roots are the smallest members."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        up = self.up
        root = x
        while (to := up.setdefault(root, root)) != root:
            root = to
        while up[x] != root:
            up[x], x = root, up[x]
        return root

    def union(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    forest = Forest()
    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            forest.union(a, b)
    nodes = list(forest.up)
    for at in range(0, len(nodes), 100_000):
        part = nodes[at : at + 100_000]
        yield table("node long,root long", node=part, root=[forest.find(x) for x in part])


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest reachable node) for every node of edges (a, b); no null ends."""
    levels = []
    links = edges.select(F.col("a").cast("long"), F.col("b").cast("long"))
    while True:
        stars = cut(links.mapInArrow(_stars, "node long, root long"))
        assigned = stars.groupBy("node").agg(F.min("root").alias("root"))
        before = F.lag("root").over(Window.partitionBy("node").orderBy("root"))
        links = cut(stars.withColumn("before", before).where("before is not null and before <> root").select(F.col("root").alias("a"), F.col("before").alias("b")).distinct())
        levels.append(cut(assigned))
        if links.isEmpty():
            break
        links = links.repartition("a")
    out = levels.pop()
    while levels:
        upper = out.select(F.col("node").alias("root"), "component" if "component" in out.columns else F.col("root").alias("component"))
        out = levels.pop().join(upper, "root", "left").select("node", F.coalesce("component", "root").alias("component"))
        if levels:
            out = cut(out)
    return out if "component" in out.columns else out.withColumnRenamed("root", "component")
