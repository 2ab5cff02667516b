"""Book trees as rows: leaves in reading order by a recursive query."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def reading_order(nodes: DataFrame, levels: int = 100) -> DataFrame:
    """root, node, depth, path, place of the leaves of trees of nodes (node, parent, pos), from the nodes without parent
    down: path is the positions on the way, by which a tree's leaves are read, place their number in it from 1.

    Siblings of one position are in order of node.  Trees may be of any depth up to levels; nodes to which no root
    leads, as in a cycle, aren't read.
    """
    kept = nodes.where("node is not null").select("node", "parent", F.struct(F.coalesce(F.col("pos").cast("long"), F.lit(0)).alias("pos"), F.col("node").alias("node")).alias("step"))
    way = nodes.sparkSession.sql(
        f"""WITH RECURSIVE way (root, node, depth, path) MAX RECURSION LEVEL {levels} AS (
              SELECT node, node, 0, array(step) FROM {{kept}} WHERE parent IS NULL AND node IS NOT NULL
              UNION ALL
              SELECT w.root, k.node, w.depth + 1, array_append(w.path, k.step) FROM way w JOIN {{kept}} k ON k.parent = w.node)
            SELECT * FROM way""",
        kept=kept,
    )
    leaves = way.join(nodes.select(F.col("parent").alias("node")).where("node is not null").distinct(), "node", "left_anti")
    place = F.row_number().over(Window.partitionBy("root").orderBy("path"))
    return leaves.select("root", "node", "depth", F.array_join(F.transform("path", lambda s: s["pos"].cast("string")), "/").alias("path"), place.alias("place"))
