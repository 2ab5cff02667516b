"""Knowledge graph: edges, upserts, statistics, traversal, PageRank.  A graph is nodes (name, importance, ...) and edges
(source, target, type, weight, ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..params import SETTINGS
from ..schema import EDGE_TYPES
from .tables import passing, reliable

# --------------------------------------------------------------------------- building


#: Rows of a group beyond which it is dealt into tiles.
LIGHT = 1024


def numbered(names: DataFrame, name: str = "name") -> DataFrame:
    """name, id: the distinct names as a table, numbered in their order.  What joins, sorts and counts many rows does so by
    eight bytes, and comes to the same order."""
    return reliable(names.select(F.col(name).alias("name")).where("name is not null").distinct().orderBy("name").withColumn("id", F.monotonically_increasing_id()))


def named(edges: DataFrame, known: DataFrame) -> DataFrame:
    """Edges whose ends are ids of numbered(), by name."""
    for end in ("source", "target"):
        edges = edges.join(known.select(F.col("id").alias(end), F.col("name").alias(f"{end}_name")), end)
    rest = [c for c in edges.columns if c not in ("source", "target", "source_name", "target_name")]
    return edges.select(F.col("source_name").alias("source"), F.col("target_name").alias("target"), *rest)


def related(members: DataFrame, group: str, name: str, threshold: int = SETTINGS.related_threshold, light: int = LIGHT) -> DataFrame:
    """RELATED edges between names that share threshold groups: weight n / 10, 1 at most.

    Names are numbered first, so pairs are two numbers; whole numbers stay as they are, and their members are read more
    than once.  Names in fewer groups than the threshold have no edges and go first where they are a quarter of the rows.
    The threshold - 1 largest groups form no pairs: two names that share enough groups share another one too, by which
    they meet, and are then looked up in those.  Of the rest, groups of up to light rows are dealt once by group and pair
    up in place; larger ones are cut into blocks of members, and each two blocks of a group are a tile of their own, so no
    task holds a group.
    """
    rows = members.select(F.col(group).alias("g"), F.col(name).alias("name")).where("g is not null and name is not null")
    with passing(rows.sparkSession) as keep:
        known = None
        if dict(rows.dtypes)["name"] not in ("int", "bigint"):
            rows = reliable(rows.distinct())
            often = rows.groupBy("name").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= threshold)
            known = numbered(often)
            rows = reliable(rows.join(known, "name").select("g", F.col("id").alias("name")))
        elif threshold > 1:
            often = rows.groupBy("name").agg(F.count(F.lit(1)).alias("n"))
            share = often.agg(F.sum("n").alias("n"), F.sum(F.when(F.col("n") < threshold, F.col("n"))).alias("rare")).first()
            if 4 * (share.rare or 0) > (share.n or 0):
                rows = reliable(rows.join(often.where(F.col("n") >= threshold).select("name"), "name", "left_semi"))
        large = reliable(rows.groupBy("g").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > light))
        aside = [r.g for r in large.orderBy(F.desc("size"), "g").limit(threshold - 1).collect()] if threshold > 1 else []
        rest = rows
        if aside:
            large, rest = large.where(~F.col("g").isin(aside)), rows.where(~F.col("g").isin(aside))
        large = large.select("g", F.ceil(F.col("size") / light).cast("int").alias("blocks"))
        any_large = not large.isEmpty()
        small = (rest.join(large, "g", "left_anti") if any_large else rest).repartition("g").dropDuplicates(["g", "name"])
        a, b = small.select("g", F.col("name").alias("source")), small.select("g", F.col("name").alias("target"))
        pairs = a.join(b, "g").where("source < target").select("source", "target")
        if any_large:
            pairs = pairs.unionByName(_tiled(rest.distinct().join(large, "g")))
        pairs = pairs.groupBy("source", "target").agg(F.count(F.lit(1)).alias("n"))
        if aside:
            pairs = pairs.where(F.col("n") >= threshold - len(aside))
            in_them = reliable(rows.where(F.col("g").isin(aside)).groupBy("name").agg(F.collect_set("g").alias("gs")))
            for end in ("source", "target"):
                pairs = pairs.join(in_them.select(F.col("name").alias(end), F.col("gs").alias(f"of_{end}")), end, "left")
            more = F.coalesce(F.size(F.array_intersect("of_source", "of_target")), F.lit(0))
            pairs = pairs.select("source", "target", (F.col("n") + F.when(F.col("of_source").isNull() | F.col("of_target").isNull(), 0).otherwise(more)).alias("n"))
        pairs = pairs.where(F.col("n") >= threshold)
        if known is not None:
            pairs = named(reliable(pairs), known)
        return keep(reliable(pairs.select("source", "target", F.lit("RELATED").alias("type"), F.least(F.col("n") / 10.0, F.lit(1.0)).alias("weight"), F.lit(0.7).alias("confidence"), "n")))


def _tiled(rows: DataFrame) -> DataFrame:
    """source, target of every two members (g, name, blocks) of a group, once: members are in blocks by hash, and two
    blocks i <= j of a group meet by (g, i, j)."""
    own = rows.withColumn("own", F.pmod(F.xxhash64("name"), F.col("blocks")).cast("int"))
    a = own.select("g", F.col("own").alias("i"), F.explode(F.sequence("own", F.col("blocks") - 1)).alias("j"), F.col("name").alias("a"))
    b = own.select("g", F.explode(F.sequence(F.lit(0), "own")).alias("i"), F.col("own").alias("j"), F.col("name").alias("b"))
    met = a.join(b, ["g", "i", "j"]).where("i < j or a < b")
    return met.select(F.least("a", "b").alias("source"), F.greatest("a", "b").alias("target"))


def covers(mentions: DataFrame, retained: DataFrame) -> DataFrame:
    """COVERS edges from modules to retained concepts."""
    return mentions.select(F.col("module_id").alias("source"), F.col("name").alias("target")).distinct().join(retained.select(F.col("name").alias("target")), "target", "left_semi").select("source", "target", F.lit("COVERS").alias("type"))


def merge_edges(edges: DataFrame, seq: str = "seq") -> DataFrame:
    """One edge for each (source, target, type): the largest weight, other attributes of the first."""
    return edges.groupBy("source", "target", "type").agg(F.max("weight").alias("weight"), F.min_by("confidence", seq).alias("confidence"))


def canonical(edges: DataFrame) -> DataFrame:
    """RELATED edges with ends in order; others as they are."""
    swap = (F.col("type") == "RELATED") & (F.col("source") > F.col("target"))
    return edges.withColumns({"source": F.when(swap, F.col("target")).otherwise(F.col("source")), "target": F.when(swap, F.col("source")).otherwise(F.col("target"))})


def upsert_edges(edges: DataFrame, nodes: DataFrame, types: tuple[str, ...] = ("COVERS", "RELATED", "PREREQ"), name: str = "name") -> DataFrame:
    """Edges of these types whose two ends exist, each once."""
    ends = nodes.select(F.col(name).alias("_end"))
    kept = canonical(edges.where(F.col("type").isin(*types)))
    kept = kept.join(ends.withColumnRenamed("_end", "source"), "source", "left_semi").join(ends.withColumnRenamed("_end", "target"), "target", "left_semi")
    return kept.dropDuplicates(["source", "target", "type"])


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Rows of old without those that new replaces, and new."""
    return old.join(new.select(*key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def latest(df: DataFrame, key: list[str], order: list) -> DataFrame:
    """One row a key, the last in order."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def statistics(edges: DataFrame, starts: DataFrame | None = None, **counts: DataFrame) -> DataFrame:
    """name, n: entities, and edges of each type (0 where there are none).

    starts (name): count only the edges that leave these nodes, as the statistics of one subject do, whose edges of a
    type are summed over the labels that they leave.
    """
    spark = edges.sparkSession
    if starts is not None:
        edges = edges.join(starts.select(F.col("name").alias("source")).distinct(), "source", "left_semi")
    kinds = spark.createDataFrame([(t,) for t in EDGE_TYPES], "type string")
    out = kinds.join(edges.groupBy("type").agg(F.count(F.lit(1)).alias("n")), "type", "left").select(F.concat(F.lower("type"), F.lit("_relationships")).alias("name"), F.coalesce("n", F.lit(0).cast("long")).alias("n"))
    for label, df in counts.items():
        out = out.unionByName(df.agg(F.lit(label).alias("name"), F.count(F.lit(1)).alias("n")).select("name", "n"))
    return out


# --------------------------------------------------------------------------- traversal


def both_ways(edges: DataFrame, id_col: str = "edge_id") -> DataFrame:
    """(at, to, edge_id) in both directions."""
    return edges.select(F.col("source").alias("at"), F.col("target").alias("to"), id_col).unionByName(edges.select(F.col("target").alias("at"), F.col("source").alias("to"), id_col))


def with_ids(edges: DataFrame) -> DataFrame:
    """An id for each edge, of its ends and type, so that trails can tell edges apart."""
    return edges.withColumn("edge_id", F.xxhash64("source", "target", "type"))


def trails(steps: DataFrame, starts: DataFrame, depth: int) -> DataFrame:
    """start, node, depth for each depth of 1..depth at which a trail (no edge twice) of steps (at, to, edge_id) from
    starts (name) reaches the node.

    A trail remembers only edges that it could come to again within depth, and trails that remember the same are one:
    where nothing leads back, a front holds each (start, node) once, however many trails there are.
    """
    if depth <= 1:
        again = None
    elif depth > 3:
        again = steps.select("edge_id")  # a longer way back may lead to any edge
    else:  # loops, and edges with one straight back
        back = steps.select(F.col("to").alias("at"), F.col("at").alias("to")).distinct()
        again = steps.where("at = to").select("edge_id").unionByName(steps.join(back, ["at", "to"], "left_semi").select("edge_id"))
    if again is not None:
        steps = steps.join(again.distinct().withColumn("again", F.lit(True)), "edge_id", "left")
    else:
        steps = steps.withColumn("again", F.lit(None).cast("boolean"))
    front = starts.select(F.col("name").alias("start"), F.col("name").alias("node"), F.array().cast("array<bigint>").alias("path")).distinct()
    out = None
    for d in range(1, depth + 1):
        met = front.join(steps, front["node"] == steps["at"]).where(~F.array_contains("path", F.col("edge_id")))
        path = F.when(F.col("again"), F.array_sort(F.array_append("path", F.col("edge_id")))).otherwise(F.col("path"))
        front = met.select("start", F.col("to").alias("node"), path.alias("path")).distinct()
        part = front.select("start", "node", F.lit(d).alias("depth"))
        out = part if out is None else out.unionByName(part)
    return out.distinct()


def reach(steps: DataFrame, starts: DataFrame, hops: int) -> DataFrame:
    """start, node: the distinct nodes that trails (no edge twice) of 1..hops steps (at, to, edge_id) in both directions
    reach from starts (name).

    Fronts go out level by level and hold a (start, node) once, with the edge by which its way left the start, and at
    most one more way that left by another edge.  That is enough: any other node within hops is reached by a shortest
    way, and the start itself by an edge other than that by which the way left it.
    """
    first = starts.select(F.col("name").alias("start")).distinct()
    met = first.join(steps, first["start"] == steps["at"]).select("start", F.col("to").alias("node"), F.col("edge_id").alias("left"))
    out = met.where("node = start").select("start", "node")
    new = met.where("node <> start").groupBy("start", "node").agg(F.slice(F.array_sort(F.collect_set("left")), 1, 2).alias("lefts"))
    if hops == 1:
        return out.unionByName(new.select("start", "node")).distinct()
    with passing(steps.sparkSession) as keep:
        steps = reliable(steps)
        seen = front = reliable(new)
        for _ in range(1, hops):
            met = front.join(steps, front["node"] == steps["at"]).select("start", F.col("to").alias("node"), "edge_id", F.explode("lefts").alias("left"))
            out = out.unionByName(met.where("node = start and edge_id <> left").select("start", "node"))
            new = met.where("node <> start").groupBy("start", "node").agg(F.slice(F.array_sort(F.collect_set("left")), 1, 4).alias("new"))
            both = seen.join(new, ["start", "node"], "full")
            known = F.coalesce("lefts", F.array().cast("array<bigint>"))
            lefts = F.slice(F.array_distinct(F.concat(known, F.coalesce("new", F.array().cast("array<bigint>")))), 1, 2)
            seen = reliable(both.select("start", "node", lefts.alias("lefts"), F.array_except(lefts, known).alias("fresh")))
            front = seen.where(F.size("fresh") > 0).select("start", "node", F.col("fresh").alias("lefts"))
            seen = seen.drop("fresh")
        return keep(reliable(out.distinct().unionByName(seen.select("start", "node"))))


def neighbors(edges: DataFrame, nodes: DataFrame, starts: DataFrame, hops: int = 1, limit: int | None = 20, types: tuple[str, ...] | None = None) -> DataFrame:
    """start, name, importance, rank: distinct nodes within hops edges in either direction, most important first; all for
    no limit."""
    kept = edges.where(F.col("type").isin(*types)) if types else edges
    return top_nodes(reach(both_ways(kept), starts, hops), nodes, limit)


def top_nodes(found: DataFrame, nodes: DataFrame, limit: int | None) -> DataFrame:
    joined = found.join(nodes.select(F.col("name").alias("node"), "importance"), "node")
    order = Window.partitionBy("start").orderBy(F.desc_nulls_first("importance"), "node")
    ranked = joined.withColumn("rank", F.row_number().over(order)).select("start", F.col("node").alias("name"), "importance", "rank")
    return ranked if limit is None else ranked.where(F.col("rank") <= limit)


def chain(edges: DataFrame, nodes: DataFrame, starts: DataFrame, depth: int = 3, forward: bool = False) -> DataFrame:
    """start, name, depth, importance over PREREQ edges: what leads to starts, or (forward) what starts lead to.

    A node comes once for each depth at which a trail reaches it.
    """
    kept = edges.where("type = 'PREREQ'")
    steps = kept.select((F.col("source") if forward else F.col("target")).alias("at"), (F.col("target") if forward else F.col("source")).alias("to"), "edge_id")
    found = trails(steps, starts, depth)
    return found.join(nodes.select(F.col("name").alias("node"), F.coalesce("importance", F.lit(0.5)).alias("importance")), "node").select("start", F.col("node").alias("name"), "depth", "importance")


# --------------------------------------------------------------------------- order of learning


def _spread(label: DataFrame, arcs: DataFrame) -> DataFrame:
    """node, label (the largest that reaches it along arcs (a, b)), round by round until none changes."""
    label = reliable(label)
    while True:
        got = label.join(arcs, label["node"] == arcs["a"]).groupBy(F.col("b").alias("to")).agg(F.max("label").alias("got"))
        label = reliable(label.join(got, F.col("node") == F.col("to"), "left").select("node", F.greatest("label", F.coalesce("got", "label")).alias("label"), (F.col("got") > F.col("label")).alias("changed")))
        if label.where("changed").isEmpty():
            return label.select("node", "label")


def _trimmed(arcs: DataFrame) -> tuple[DataFrame, int]:
    """Arcs (a, b) on ways that go on at both ends, and their number: without any that no cycle feeds or that feed none."""
    n, arcs = None, reliable(arcs)
    while n != (left := arcs.count()):
        n = left
        arcs = reliable(arcs.join(arcs.select(F.col("b").alias("a")).distinct(), "a", "left_semi").join(arcs.select(F.col("a").alias("b")).distinct(), "b", "left_semi").select("a", "b"))
    return arcs, n


def cycles(edges: DataFrame) -> DataFrame:
    """node, cycle of the ends of edges (source, target): strongly connected components by their smallest names.

    Arcs that lead into no cycle or out of none go first.  On what stays the largest label that reaches each node goes
    forward, and of each label's nodes those that lead back to its owner are one component; they go, and the rest starts
    anew.
    """
    with passing(edges.sparkSession) as keep:
        every = edges.select(F.col("source").alias("a"), F.col("target").alias("b")).where("a is not null and b is not null").distinct()
        every = reliable(every)
        done, (arcs, n) = None, _trimmed(every.where("a <> b"))
        while n:
            color = _spread(arcs.select(F.col("a").alias("node")).union(arcs.select("b")).distinct().select("node", F.col("node").alias("label")), arcs)
            same = arcs.join(color.select(F.col("node").alias("a"), F.col("label").alias("x")), "a").join(color.select(F.col("node").alias("b"), F.col("label").alias("y")), "b").where("x = y")
            # the owner's mark goes backward along arcs of its color
            back = reliable(same.select(F.col("b").alias("a"), F.col("a").alias("b")))
            home = _spread(color.select("node", (F.col("node") == F.col("label")).cast("int").alias("label")), back)
            own = home.where("label = 1").select("node").join(color, "node")
            out = reliable(own.join(own.groupBy("label").agg(F.min("node").alias("cycle")), "label").select("node", "cycle"))
            done = out if done is None else done.unionByName(out)
            gone = out.select("node")
            arcs, n = _trimmed(arcs.join(gone.withColumnRenamed("node", "a"), "a", "left_anti").join(gone.withColumnRenamed("node", "b"), "b", "left_anti").select("a", "b"))
        nodes = every.select(F.col("a").alias("node")).union(every.select("b")).distinct()
        if done is None:
            return keep(nodes.select("node", F.col("node").alias("cycle")))
        return keep(nodes.join(done, "node", "left").select("node", F.coalesce("cycle", "node").alias("cycle")))


def layers(edges: DataFrame) -> DataFrame:
    """node, cycle, layer of the ends of edges (source before target): the number of steps of the longest way to a node's
    cycle, where a cycle is one step.  Layer 0 has no prerequisites but its own.

    Round n keeps the arcs whose beginning ends a way of n steps; a node's layer is the number of rounds that end in it.
    """
    with passing(edges.sparkSession) as keep:
        found = reliable(cycles(edges))
        arcs = edges.select("source", "target").join(found.select(F.col("node").alias("source"), F.col("cycle").alias("a")), "source").join(found.select(F.col("node").alias("target"), F.col("cycle").alias("b")), "target")
        arcs = reliable(arcs.where("a <> b").select("a", "b").distinct())
        ends = None
        while not arcs.isEmpty():  # no cycle is left, so ways end
            own = arcs.select(F.col("b").alias("cycle")).distinct()
            ends = own if ends is None else ends.unionByName(own)
            arcs = reliable(arcs.join(arcs.select(F.col("b").alias("a")).distinct(), "a", "left_semi").select("a", "b"))
        if ends is None:
            return keep(found.withColumn("layer", F.lit(0)))
        depth = ends.groupBy("cycle").agg(F.count(F.lit(1)).cast("int").alias("layer"))
        return keep(reliable(found.join(depth, "cycle", "left").select("node", "cycle", F.coalesce("layer", F.lit(0)).alias("layer"))))


def learning_order(edges: DataFrame, nodes: DataFrame, starts: DataFrame, depth: int = 3) -> DataFrame:
    """start, name, position, layer, cycle, importance: each start's prerequisites (distinct, within depth) in an order in
    which none comes before its own: by layer, members of a cycle together, then the more important, then by name."""
    needed = reliable(edges.where("type = 'PREREQ'"))
    found = chain(needed, nodes, starts, depth).select("start", "name", "importance").distinct()
    placed = found.join(layers(needed).withColumnRenamed("node", "name"), "name")
    order = Window.partitionBy("start").orderBy("layer", "cycle", F.desc("importance"), "name")
    return placed.select("start", "name", F.row_number().over(order).alias("position"), "layer", "cycle", "importance")


def prerequisites_first(found: DataFrame) -> DataFrame:
    """Rows of chain() in the order of learning: the deepest first, then the more important, then by name."""
    return found.orderBy("start", F.desc("depth"), F.desc("importance"), "name")


def paths(edges: DataFrame, starts: DataFrame, depth: int = 3) -> DataFrame:
    """start, node, names ('a > b > c') of every trail of up to depth edges in either direction."""
    steps = both_ways(edges)
    front = starts.select(F.col("name").alias("start"), F.col("name").alias("node"), F.array().cast("array<bigint>").alias("path"), F.array("name").alias("names"))
    out = None
    for _ in range(depth):
        front = front.join(steps, front["node"] == steps["at"]).where(~F.array_contains("path", F.col("edge_id"))).select("start", F.col("to").alias("node"), F.array_append("path", F.col("edge_id")).alias("path"), F.array_append("names", F.col("to")).alias("names"))
        part = front.select("start", "node", F.array_join("names", " > ").alias("names"))
        out = part if out is None else out.unionByName(part)
    return out


def direct(edges: DataFrame, nodes: DataFrame, starts: DataFrame, kind: str, limit: int | None = 5) -> DataFrame:
    """Top neighbours by kind: prerequisites, dependents or related."""
    start = starts.select(F.col("name").alias("start"))
    if kind == "related":
        steps = both_ways(edges.where("type = 'RELATED'"))
    else:
        here, there = ("target", "source") if kind == "prerequisites" else ("source", "target")
        steps = edges.where("type = 'PREREQ'").select(F.col(here).alias("at"), F.col(there).alias("to"))
    found = start.join(steps, start["start"] == steps["at"]).select("start", F.col("to").alias("node")).distinct()
    return top_nodes(found, nodes, limit)


def induced(edges: DataFrame, nodes: DataFrame, n: int = 100) -> tuple[DataFrame, DataFrame]:
    """The n most important nodes, and the edges between them with weight 1 where there is none."""
    top = nodes.orderBy(F.desc_nulls_first("importance"), "name").limit(n).select("name", F.coalesce("importance", F.lit(0.5)).alias("importance"))
    ends = top.select(F.col("name").alias("_end"))
    kept = edges.join(ends.withColumnRenamed("_end", "source"), "source", "left_semi").join(ends.withColumnRenamed("_end", "target"), "target", "left_semi")
    return top, kept.withColumn("weight", F.coalesce("weight", F.lit(1.0)))


def display_edges(edges: DataFrame, order: list) -> DataFrame:
    """Edges of a picture: id e0, e1, ..., label of the type."""
    n = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)) - 1
    return edges.select(F.concat(F.lit("e"), n.cast("string")).alias("id"), "source", "target", F.lower(F.replace("type", F.lit("_"), F.lit(" "))).alias("label"), "weight")


def pagerank(nodes: DataFrame, edges: DataFrame, iterations: int = 100, damping: float = SETTINGS.pagerank_damping, tolerance: float = 1e-6) -> DataFrame:
    """name, rank (sums to 1), importance (rank / largest rank) on the undirected weighted graph; nodes without edges
    take part and spread their rank evenly.

    Rounds go on until the ranks change by less than tolerance a node, summed over all, or iterations are reached.
    Lineage is cut in each round.
    """
    with passing(nodes.sparkSession) as keep:
        n = nodes.count()
        kept = edges.where(F.col("type").isin("RELATED", "PREREQ")).groupBy(F.least("source", "target").alias("x"), F.greatest("source", "target").alias("y")).agg(F.max_by("weight", "type").alias("weight"))
        arcs = kept.select(F.col("x").alias("at"), F.col("y").alias("to"), "weight").unionByName(kept.where("x <> y").select(F.col("y").alias("at"), F.col("x").alias("to"), "weight"))
        out = arcs.groupBy("at").agg(F.sum("weight").alias("out"))
        arcs = reliable(arcs.join(out, "at").select("at", "to", (F.col("weight") / F.col("out")).alias("share")))
        names = reliable(nodes.select("name").join(arcs.select(F.col("at").alias("name"), F.lit(True).alias("linked")).distinct(), "name", "left").select("name", F.col("linked").isNull().alias("dangling")))
        ranks = names.withColumn("rank", F.lit(1.0 / max(n, 1)))
        lost = ranks.where("dangling").count() / max(n, 1)
        for _ in range(iterations):
            got = arcs.join(ranks, arcs["at"] == ranks["name"]).groupBy(F.col("to").alias("name")).agg(F.sum(F.col("rank") * F.col("share")).alias("got"))
            rank = F.lit((1 - damping) / max(n, 1)) + damping * (F.coalesce("got", F.lit(0.0)) + F.lit(lost / max(n, 1)))
            ranks = reliable(ranks.withColumnRenamed("rank", "before").join(got, "name", "left").select("name", "dangling", rank.alias("rank"), "before"))
            seen = ranks.agg(F.sum(F.abs(F.col("rank") - F.col("before"))).alias("change"), F.sum(F.when(F.col("dangling"), F.col("rank"))).alias("lost")).first()
            ranks, lost = ranks.drop("before"), seen.lost or 0.0
            if (seen.change or 0.0) < n * tolerance:
                break
        top = ranks.agg(F.max("rank").alias("top"))
        return keep(ranks.join(F.broadcast(top)).select("name", "rank", (F.col("rank") / F.col("top")).alias("importance")))


def important(nodes: DataFrame, above: float = 0.5, limit: int = 20) -> DataFrame:
    return nodes.where(F.col("importance") > above).orderBy(F.desc("importance"), "name").limit(limit)


def relabel(df: DataFrame, subject: str, column: str = "subject_id") -> DataFrame:
    """Rows without a subject get this one; others stay."""
    value: Column = F.coalesce(F.col(column), F.lit(subject)) if column in df.columns else F.lit(subject)
    return df.withColumn(column, value)
