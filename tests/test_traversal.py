"""Co-occurrence, fronts, cycles and layers against plain versions on random graphs, and at hubs."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from graphloom.operators import graph


@pytest.mark.parametrize("threshold, light", [(1, 1024), (1, 4), (2, 4), (3, 2), (5, 1024)])
def test_related_against_plain(spark, threshold, light):
    rng = random.Random(threshold)
    rows = [(rng.randrange(25), f"n{min(rng.randrange(30), rng.randrange(30)):02}") for _ in range(500)] + [(99, f"n{i:02}") for i in range(30)] + [(98, f"n{i:02}") for i in range(20)] + [(None, "n1"), (3, None)]
    by = defaultdict(set)
    for g, n in rows:
        if g is not None and n:
            by[n].add(g)
    want = {(a, b): len(by[a] & by[b]) for a in by for b in by if a < b and len(by[a] & by[b]) >= threshold}
    got = graph.related(spark.createDataFrame(rows, "g int, name string").repartition(3), "g", "name", threshold, light).collect()
    assert {(r.source, r.target): r.n for r in got} == want and len(got) == len(want)


def test_related_of_one_huge_group(spark):
    """10^5 names in one group, of which only those that share another one are related: the group forms no pairs."""
    one = spark.range(100_000).select(F.lit(0).alias("g"), F.concat(F.lit("n"), F.col("id").cast("string")).alias("name"))
    pairs = spark.range(300).select((F.col("id") % 100 + 1).cast("int").alias("g"), F.concat(F.lit("n"), F.col("id").cast("string")).alias("name"))
    got = graph.related(one.unionByName(pairs), "g", "name", 2).collect()
    assert len(got) == 300 and {r.n for r in got} == {2}


def plain_reach(steps, start, hops):
    out, front = set(), [(start, ())]
    for _ in range(hops):
        front = [(b, (*path, e)) for node, path in front for a, b, e in steps if a == node and e not in path]
        out |= {n for n, _ in front}
    return out


@pytest.mark.parametrize("hops", [1, 2, 3, 4])
def test_reach_is_what_trails_reach(spark, hops):
    rng = random.Random(hops)
    edges = [(f"v{rng.randrange(12)}", f"v{rng.randrange(12)}", rng.choice("AB")) for _ in range(16)] + [("x", "x", "A"), ("y", "z", "A"), ("y", "z", "B"), ("p", "q", "A")]
    df = graph.with_ids(spark.createDataFrame(edges, "source string, target string, type string").distinct())
    ids = {(r.source, r.target, r.type): r.edge_id for r in df.collect()}
    steps = [(a, b, e) for (a, b, _), e in ids.items()] + [(b, a, e) for (a, b, _), e in ids.items()]
    names = sorted({a for a, _, _ in steps})
    got = defaultdict(set)
    for r in graph.reach(graph.both_ways(df), spark.createDataFrame([(n,) for n in names], "name string"), hops).collect():
        assert r.node not in got[r.start]
        got[r.start].add(r.node)
    assert {n: got[n] for n in names} == {n: plain_reach(steps, n, hops) for n in names}


@pytest.mark.parametrize("depth", [1, 2, 3, 4])
def test_depths_are_those_of_trails(spark, depth):
    rng = random.Random(10 + depth)
    edges = sorted({(f"v{rng.randrange(8)}", f"v{rng.randrange(8)}") for _ in range(18)})
    df = graph.with_ids(spark.createDataFrame([(*e, "PREREQ") for e in edges], "source string, target string, type string"))
    want, front = set(), [(a, a, ()) for a, _ in edges]
    for d in range(1, depth + 1):
        front = [(s, b, (*path, (a, b))) for s, node, path in front for a, b in edges if a == node and (a, b) not in path]
        want |= {(s, n, d) for s, n, _ in front}
    steps = df.select(F.col("source").alias("at"), F.col("target").alias("to"), "edge_id")
    got = graph.trails(steps, df.select(F.col("source").alias("name")), depth).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_fronts_hold_a_node_once_at_hubs(spark):
    """Six levels of forty nodes, each level joined to all of the next: 40^5 trails, 40 rows a front."""
    level = spark.range(40).select(F.col("id").alias("i"))
    edges = None
    for d in range(5):
        part = level.crossJoin(level.withColumnRenamed("i", "j")).select(F.format_string(f"{d}-%d", "i").alias("source"), F.format_string(f"{d + 1}-%d", "j").alias("target"), F.lit("PREREQ").alias("type"))
        edges = part if edges is None else edges.unionByName(part)
    edges = graph.with_ids(edges)
    steps = edges.select(F.col("source").alias("at"), F.col("target").alias("to"), "edge_id")
    start = spark.createDataFrame([("0-0",)], "name string")
    assert graph.trails(steps, start, 3).count() == 120
    assert graph.reach(graph.both_ways(edges), start, 5).count() == 40 + 40 * 5


def test_cycles_and_layers_against_plain(spark):
    for seed in (0, 2):
        rng = random.Random(seed)
        edges = sorted({(f"v{rng.randrange(14):02}", f"v{rng.randrange(14):02}") for _ in range(20)})
        names = sorted({x for e in edges for x in e})
        reach = {a: plain_reach([(x, y, (x, y)) for x, y in edges], a, 14) for a in names}
        cycle = {a: min([a, *[b for b in names if b in reach[a] and a in reach[b]]]) for a in names}
        arcs = {(cycle[a], cycle[b]) for a, b in edges if cycle[a] != cycle[b]}
        layer = {c: 0 for c in cycle.values()}
        for _ in names:
            for a, b in arcs:
                layer[b] = max(layer[b], layer[a] + 1)
        got = graph.layers(spark.createDataFrame([*edges, (None, "v00")], "source string, target string")).collect()
        assert {r.node: (r.cycle, r.layer) for r in got} == {a: (cycle[a], layer[cycle[a]]) for a in names} and len(got) == len(names)
    assert graph.layers(spark.createDataFrame([], "source string, target string")).count() == 0
