"""Merkle dataset manifest by slot pivot, in DataFrame expressions alone.

Every row is a leaf.  The rows of a source, in order of doc_id, are the leaves of a tree; its roots, in order of
source, are the leaves of the tree above.  Up a level, a grouping by (tree, place div fanout) with one conditional
aggregate for each slot spreads a parent's children into fanout columns; the columns put together give the parent's
hash, and put together without the own slot's column they give a child's siblings.  Down again, a node's path is its
own siblings and its parent's path.  No group holds more than fanout rows whatever a source's size, each join meets a
parent with its own children only, and a text is hashed in place and never moved.

Places come without a window over a source: leaves are range-partitioned by (source, doc_id, leaf) and sorted, a row's
number in its partition and the counts of earlier partitions give its place.

Edge cases: null columns are `-` in the leaf; null sources are a source of their own and come first, null doc_ids come
first in theirs and are never tampered with; an empty text counts 0 bytes; long texts are hashed whole; rows that
repeat a doc_id are leaves of their own, in order of their hashes, and equal rows have equal leaves in places side by
side; a source of one row has that leaf as its root, and a table of one source that source's root; a table of one row
has an empty list of siblings; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

FANOUT = 16
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Left and right siblings at each level, the lowest first.
PATH = "array<struct<left:string,right:string>>"


def digest(*parts: Column) -> Column:
    """Lower-case hex SHA-256 of the parts put together."""
    return F.sha2(F.concat(*parts), 256)


def framed(value: Column) -> Column:
    """`-` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(text: Column) -> Column:
    """Hash of a row of documents with this text."""
    return digest(*[framed(c) for c in (F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text)])


def tampered(text: Column) -> Column:
    """The text that the tampering leaves: A-Z lowered."""
    return F.translate(text, UPPER, LOWER)


def placed(leaves: DataFrame) -> DataFrame:
    """Rows of leaves (source, doc_id, leaf, ...) with tree (number of the source, null first and then bytewise), pos
    (place in its source by doc_id and leaf, from 0) and n (rows of the source)."""
    ordered = leaves.repartitionByRange("source", "doc_id", "leaf").sortWithinPartitions("source", "doc_id", "leaf")
    # partition and row in it, fixed by the table: another range partitioning may have other borders
    rows = common.cut(ordered.withColumn("_at", F.monotonically_increasing_id()), "zstd")
    rows = rows.withColumns({"_part": F.shiftrightunsigned("_at", 33), "_row": F.col("_at").bitwiseAND((1 << 33) - 1)})
    # a row for each source and partition that it lies in
    parts = rows.groupBy("source", "_part").agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_n"))
    own = Window.partitionBy("source")
    parts = parts.withColumns({"_before": F.sum("_n").over(own.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), "n": F.sum("_n").over(own), "_begins": F.min("_part").over(own) == F.col("_part")})
    parts = common.cut(parts.withColumn("_before", F.coalesce("_before", F.lit(0))))
    begins = parts.where("_begins").withColumn("_k", F.row_number().over(Window.partitionBy("_part").orderBy("_first")))
    # as many rows as there are partitions
    counts = begins.groupBy("_part").agg(F.count(F.lit(1)).alias("_k"))
    ahead = counts.select("_part", F.coalesce(F.sum("_k").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_ahead"))
    trees = begins.join(ahead, "_part").select(F.col("source").alias("_source"), (F.col("_ahead") + F.col("_k") - 1).alias("tree"))
    parts = parts.join(trees, F.col("source").eqNullSafe(F.col("_source"))).select("_source", "_part", "_first", "_before", "n", "tree").withColumnRenamed("_part", "_of")
    met = rows.join(parts, (F.col("_part") == F.col("_of")) & F.col("source").eqNullSafe(F.col("_source")))
    return met.select(*leaves.columns, "tree", (F.col("_before") + F.col("_row") - F.col("_first")).alias("pos"), "n")


def pivot(nodes: DataFrame, child: Column, fanout: int) -> DataFrame:
    """Nodes (tree, pos, n, ...) by parent: tree, pos (of the parent), n (nodes of its level) and the columns c0, c1, ...
    with what child says of the node in each slot."""
    slots = [F.max(F.when(F.pmod("pos", F.lit(fanout)) == i, child)).alias(f"c{i}") for i in range(fanout)]
    parent = F.floor(F.col("pos") / fanout)
    return nodes.groupBy("tree", parent.alias("_parent")).agg(F.ceil(F.max("n") / fanout).alias("n"), *slots).withColumnRenamed("_parent", "pos")


def _hashes(fanout: int, field: str | None) -> list[Column]:
    """The slots' hashes, empty where a run is short."""
    return [F.coalesce(F.col(f"c{i}")[field] if field else F.col(f"c{i}"), F.lit("")) for i in range(fanout)]


def siblings(fanout: int, field: str | None = None) -> Column:
    """One row for each filled slot, as a struct: slot, child, and the step (left, right) of its siblings: all columns but
    its own."""
    hashes = _hashes(fanout, field)
    rows = []
    for i in range(fanout):
        step = F.struct(F.concat(F.lit(""), *hashes[:i]).alias("left"), F.concat(F.lit(""), *hashes[i + 1 :]).alias("right"))
        rows.append(F.when(F.col(f"c{i}").isNotNull(), F.struct(F.lit(i).alias("slot"), F.col(f"c{i}").alias("child"), step.alias("step"))))
    return F.explode(F.filter(F.array(*rows), lambda x: x.isNotNull()))


def climb(nodes: DataFrame, fanout: int) -> tuple[list[DataFrame], DataFrame]:
    """Pivot tables of the levels above nodes (tree, pos, n, h), the lowest first, and the roots (tree, h).

    A tree ends where one node remains, so each level holds the trees that still have more."""
    levels, roots = [], nodes.where("n = 1").select("tree", "h")
    above = nodes.where("n > 1")
    while not above.isEmpty():
        levels.append(common.cut(pivot(above, F.col("h"), fanout), "zstd"))
        h = digest(*_hashes(fanout, None)).alias("h")
        roots = roots.unionByName(levels[-1].where("n = 1").select("tree", h))
        above = levels[-1].where("n > 1").select("tree", "pos", "n", h)
    return levels, roots


def descend(levels: list[DataFrame], tops: DataFrame, fanout: int) -> DataFrame:
    """tree, pos, path, and tops' further columns of the nodes below the levels, from tops (tree, path, ...): what every
    root hands down.  Trees without levels have one node, at place 0."""
    more = [c for c in tops.columns if c not in ("tree", "path")]
    found = None
    for level in reversed(levels):
        own = level.where("n = 1").select("tree", "pos").join(tops, "tree")
        above = own if found is None else own.unionByName(found)
        met = level.join(above, ["tree", "pos"]).select("tree", "pos", "path", *more, siblings(fanout).alias("_s"))
        found = met.select("tree", (F.col("pos") * fanout + F.col("_s.slot")).alias("pos"), F.concat(F.array("_s.step"), F.col("path")).alias("path"), *more)
    return found


def manifest(docs: DataFrame, fanout: int = FANOUT, tamper_every: int = 5) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified, of documents (doc_id, source, lang, n_chars, text).

    Rows whose crc32(doc_id as text) is divisible by tamper_every are verified with their text lower-cased (A-Z).
    """
    docs = common.need(docs, doc_id="long", source="string", lang="string", n_chars="long", text="string")
    none = F.array().cast(PATH)
    with common.scratch(docs.sparkSession) as keep:
        hit = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % tamper_every == 0, F.lit(False))
        # hashed once; the range partitioning samples this small table and not the texts
        leaves = common.cut(docs.select("doc_id", "source", leaf(F.col("text")).alias("leaf"), F.when(hit, leaf(tampered(F.col("text")))).alias("other")), "zstd")
        nodes = placed(leaves)
        child = F.struct("leaf", "doc_id", "other")
        bottom = keep(common.cut(pivot(nodes.select("tree", "pos", "n", "leaf", "doc_id", "other"), child, fanout), "zstd"))

        # a lone leaf is its source's root; else the run's hash is the lowest node
        lone = bottom.where("n = 1 and c1 is null")
        above = bottom.where("n > 1 or c1 is not null").select("tree", "pos", "n", digest(*_hashes(fanout, "leaf")).alias("h"))
        levels, roots = climb(above, fanout)
        subroots = common.cut(roots.unionByName(lone.select("tree", F.col("c0.leaf").alias("h"))))
        n = subroots.count()
        upper, top = climb(subroots.select(F.lit(0).alias("tree"), F.col("tree").alias("pos"), F.lit(n).alias("n"), "h"), fanout)
        root = top.first()  # one hash
        start = docs.sparkSession.createDataFrame([(0,)], "tree long").withColumn("path", none)
        paths = descend(upper, start, fanout) if upper else start.withColumn("pos", F.lit(0))
        paths = paths.select(F.col("pos").alias("tree"), "path").join(subroots.withColumnRenamed("h", "subroot"), "tree")
        paths = common.cut(paths, "zstd")

        # paths of the runs: of trees of one run straight from the roots
        runs = descend(levels, paths, fanout)
        ends = bottom.where("n = 1").select("tree", "pos").join(paths, "tree")
        runs = keep(common.cut(ends if runs is None else ends.unionByName(runs), "zstd"))
    rows = bottom.join(runs, ["tree", "pos"]).select("path", "subroot", siblings(fanout, "leaf").alias("_s"))
    # a lone leaf's empty step adds nothing to its list of siblings, but is no level to fold
    step = F.when((F.col("_s.step.left") == "") & (F.col("_s.step.right") == "") & F.col("_s.child.leaf").eqNullSafe(F.col("subroot")), none).otherwise(F.array("_s.step"))
    rows = rows.select(F.col("_s.child.*"), "subroot", F.concat(step, F.col("path")).alias("path"))
    folded = F.aggregate("path", F.coalesce("other", "leaf"), lambda h, s: digest(s["left"], h, s["right"]))
    proof = F.sha2(F.array_join(F.transform("path", lambda s: F.concat(s["left"], s["right"])), ""), 256)
    rows = rows.select("doc_id", "leaf", "subroot", F.lit(root.h if root else None).cast("string").alias("root"), proof.alias("proof_sha256"), folded.alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))
