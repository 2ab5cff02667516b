"""Steps whose cost must not grow faster than the tables."""

import random
import time

import pyarrow as pa
from pyspark.sql import functions as F

from graphloom import plugins
from graphloom.functions.text import tokens
from graphloom.operators import concepts, fulltext, graph, tables
from graphloom.plans import recommend
from graphloom.queries import app, graphs, retrieval, text


def test_one_long_text_is_tokenised_in_one_pass(spark):
    long = spark.range(1).select(F.repeat(F.lit("Ab-c "), 200_000).alias("text"))
    began = time.monotonic()
    assert long.select(F.size(tokens(F.col("text"))).alias("n")).first().n == 400_000
    assert time.monotonic() - began < 20  # each match copied the text


def test_top_words_are_counted_once(spark, small):
    files = text.top_words(spark, small).inputFiles() + text._known(spark, small).inputFiles()
    assert files and not any("documents" in f or "part.parquet" in f for f in files)


def test_batches_of_texts_come_in_parts():
    parts = list(tables.pieces(iter([pa.RecordBatch.from_pydict({"x": list(range(300))})])))
    assert [p.num_rows for p in parts] == [128, 128, 44] and parts[2].column(0)[0].as_py() == 256


def test_readings_ask_for_no_more_than_they_give(spark, monkeypatch):
    asked = []
    own = recommend.R.bm25
    monkeypatch.setattr(recommend.R, "bm25", lambda *a, **k: asked.append(k.get("k")) or own(*a, **k))
    docs = spark.createDataFrame([(i, "a b") for i in range(5)], "id long, text string")
    rows = recommend.readings(spark.createDataFrame([(1, "a")], "query_id long, text string"), docs).collect()
    assert asked == [2] and sorted(r.id for r in rows) == [0, 1]


def test_a_fuzzy_index_holds_terms_near_the_queries_alone(spark):
    docs = spark.createDataFrame([(1, "widget wigdet gadget"), (2, "bolt far away"), (3, "blot widgets")], "id long, text string")
    asked = spark.createDataFrame([(1, "widget"), (2, "widget blt")], "query_id long, text string")
    index = fulltext.build_text_index(docs, "id", "text", near=asked)
    assert {r.token for r in index.postings.collect()} == {"widget", "wigdet", "widgets", "gadget", "bolt", "blot"} and index.n == 3
    found = fulltext.fuzzy_terms(spark.createDataFrame([("widgets",)], "token string"), asked).collect()
    assert sorted((r.query_id, r.asked, r.token, r.edits) for r in found) == [(1, "widget", "widgets", 1), (2, "widget", "widgets", 1)]


def test_keywords_of_one_file_are_many_tasks(spark):
    docs = spark.range(8).coalesce(1).select("id", F.lit("Red widgets turn. Blue bolts hold red widgets.").alias("text"))
    found = plugins.keywords(docs, "id", "text", 3)
    assert found.rdd.getNumPartitions() >= 4 and found.count() == 24


def test_edges_are_made_once_and_by_number(spark, small):
    for made in (graphs.edges(spark, small), graphs.needed(spark, small)):
        files = made.inputFiles()
        assert files and not any("lineitem" in f or "part.parquet" in f for f in files)  # each reader made them again
    own = graphs.numbered(spark, small)
    assert dict(own.edges.dtypes)["source"] == dict(own.items.dtypes)["name"] == "bigint"
    names = [r.name for r in own.names.orderBy("id").collect()]
    assert names == sorted(names)


def test_related_numbers_are_the_related_names(spark):
    rows = spark.range(400).select((F.col("id") % 37).alias("g"), (F.col("id") * F.col("id") % 23).alias("i"))
    rows = rows.unionByName(rows.limit(50)).withColumn("name", F.format_string("n%03d", "i"))  # members come again
    by_name, by_number = (sorted((r.source, r.target, r.n) for r in graph.related(rows, "g", c, 3, 8).collect()) for c in ("name", "i"))
    assert by_name and by_name == [(f"n{a:03}", f"n{b:03}", n) for a, b, n in by_number]


def test_recommendation_blocks_go_by_number(spark, small, monkeypatch):
    seen = []
    own = app.P.blocks
    monkeypatch.setattr(app.P, "blocks", lambda *a: seen.append([dict(df.dtypes) for df in a]) or own(*a))
    app.recommendation_blocks(spark, small)
    results, edges, nodes, state = seen[0]
    assert results["concept"] == edges["source"] == nodes["name"] == state["concept"] == "bigint"  # names were shuffled


def test_names_inside_names_are_sorted_not_scanned(spark, monkeypatch):
    monkeypatch.setattr(concepts, "containing", None)  # one scan of all names for each shard of them
    rng = random.Random(7)
    names = ["", "a", "Ab", "ABC", "xabcx", "ba\U0001f600ba\U0001f600", "A\U0001f600BA", "same name", "Same Name", "same name too"]
    names += ["".join(rng.choice("abC ") for _ in range(rng.randrange(1, 9))) for _ in range(300)]
    names = sorted({n.strip() for n in names})
    lows = {n.lower() for n in names}
    want = [n for n in names if not n or not any(n.lower() in low and n.lower() != low for low in lows)]
    got = concepts.drop_substrings(spark.createDataFrame([(n,) for n in names], "name string").repartition(3)).collect()
    assert sorted(r.name for r in got) == want


def test_texts_are_indexed_once_for_two_rankings(spark, small, monkeypatch):
    made = []
    own = fulltext.build_text_index
    monkeypatch.setattr(fulltext, "build_text_index", lambda *a, **k: made.append(a[2]) or own(*a, **k))
    assert retrieval.precision_intervals(spark, small).count() == 3
    assert sorted(made) == ["lang", "source", "text"]
