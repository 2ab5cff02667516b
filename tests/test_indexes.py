"""The vector and the text index against exhaustive search."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.operators import fulltext, tables, vectors


def clustered(n, d=24, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((20, d))
    return (centres[rng.integers(0, 20, n)] + 0.6 * rng.standard_normal((n, d))).astype(np.float32)


@pytest.mark.parametrize("n, shard_rows", [(300, 16384), (1500, 400), (6000, 3000)])
def test_index_finds_nine_of_ten(spark, n, shard_rows):
    rows = clustered(n)
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(rows)], "id long, vector array<float>").repartition(4)
    index = tables.reliable(vectors.build_index(df, "id", "vector", shard_rows=shard_rows))
    assert index.count() == n and index.select("id").distinct().count() == n
    asked = df.where("id % 50 = 0").withColumnRenamed("id", "query_id")
    exact = tables.reliable(vectors.knn_many(df, asked, 10, "id", "vector"))
    assert sorted(map(tuple, vectors.search_index(index, asked, 10, exact=True).collect())) == sorted(map(tuple, exact.collect()))
    found = vectors.search_index(index, asked, 10)
    recall = [r.recall for r in vectors.recall(found, exact).collect()]
    assert len(recall) == -(-n // 50) and sum(recall) / len(recall) >= 0.9
    scores = {(r.query_id, r.id): r.score for r in exact.collect()}
    assert all(scores[r.query_id, r.id] == r.score for r in found.collect() if (r.query_id, r.id) in scores)


def test_index_of_odd_vectors(spark):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [float("nan"), 1.0]), (5, [0.6, 0.8]), (6, [])]
    df = spark.createDataFrame(rows, "id long, vector array<double>")
    index = vectors.build_index(df, "id", "vector")
    assert sorted(r.id for r in index.collect()) == [1, 1, 5]
    asked = spark.createDataFrame([("a", [1.0, 0.0]), ("z", [0.0, 0.0]), ("n", None)], "query_id string, vector array<double>")
    assert [(r.query_id, r.id, r.score) for r in vectors.search_index(index, asked, 5).collect()] == [("a", 1, 1.0), ("a", 1, 1.0), ("a", 5, 0.6)]
    assert vectors.build_index(df.limit(0), "id", "vector").count() == 0


def test_links_are_spaced_and_capped():
    rows = vectors._unit(clustered(500, 8).astype(float))
    level, links = vectors.build(rows, 6, 40, 1)
    assert level[0] == level.max() and len(links) == level.max() + 1
    for layer, of_layer in enumerate(links):
        assert of_layer.shape[1] == (12 if layer == 0 else 6)
        for i in range(len(rows)):
            own = of_layer[i][of_layer[i] >= 0]
            assert len(set(own)) == len(own) and i not in own and (level[own] >= layer).all()
            assert level[i] >= layer or not len(own)


# --------------------------------------------------------------------------- text


def plain_bm25(docs, queries, digits=6):
    words = [(d, re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))) for d, t in docs]
    n, average = len(words), sum(len(w) for _, w in words) / len(words)
    df = Counter(t for d, w in words if d is not None for t in set(w))
    out = {}
    for q, text in queries:
        scores = defaultdict(float)
        for t in dict.fromkeys(re.findall(r"\w+", (text or "").lower())):
            for d, w in words:
                if d is not None and (tf := w.count(t)):
                    scores[d] += math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w) / average))
        out[q] = {d: round(s, digits) for d, s in scores.items()}
    return out


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(120)]
    weights = [1 / (i + 1) for i in range(120)]
    docs = [(f"d{i:04}", " ".join(rng.choices(vocabulary, weights, k=rng.randrange(1, 40)))) for i in range(900)]
    docs += [("x0", None), ("x1", ""), ("x2", "W1 w1,w1;W2"), ("x3", docs[7][1]), ("x4", docs[7][1]), (None, "w1 w2 w3")]
    queries = [(i, " ".join(rng.sample(vocabulary, rng.randrange(1, 9)))) for i in range(40)] + [(90, "nothing here"), (91, ""), (92, None), (93, "w1 w1 W1 w2")]
    return docs, queries


@pytest.mark.parametrize("k", [1, 5, 50, None])
@pytest.mark.parametrize("shard_docs", [65536, 200])
def test_text_index_against_plain(spark, corpus, k, shard_docs):
    docs, queries = corpus
    df = spark.createDataFrame(docs, "id string, text string").repartition(3)
    asked = spark.createDataFrame(queries, "query_id int, text string")
    index = fulltext.build_text_index(df, "id", "text", shard_docs=shard_docs)
    found = defaultdict(list)
    for r in fulltext.search_text(index, asked, k).collect():
        found[r.query_id].append((-round(r.score, 6), r.id))
    for q, want in plain_bm25(docs, queries).items():
        best = sorted((-s, d) for d, s in want.items())[:k]
        assert sorted(found[q])[:k] == [(pytest.approx(s, abs=2e-6), d) for s, d in best]
        if k:
            shards = index.postings.agg(F.max("shard")).first()[0] + 1
            assert len(found[q]) <= k * shards  # no other pair leaves a task


def test_text_index_is_stored(spark, corpus, tmp_path):
    docs, queries = corpus
    df, asked = spark.createDataFrame(docs, "id string, text string"), spark.createDataFrame(queries, "query_id int, text string")
    index = fulltext.build_text_index(df, "id", "text")
    index.save(f"file://{tmp_path}/index")
    again = fulltext.TextIndex.load(spark, f"file://{tmp_path}/index")
    assert (again.n, again.average) == (index.n, index.average)
    assert sorted(map(tuple, fulltext.search_text(again, asked, 3).collect())) == sorted(map(tuple, fulltext.search_text(index, asked, 3).collect()))
    few = fulltext.build_text_index(df, "id", "text", asked=fulltext.asked_tokens(asked).withColumnRenamed("asked", "token"))
    assert few.postings.count() < index.postings.count()
    assert sorted(map(tuple, fulltext.search_text(few, asked, 3).collect())) == sorted(map(tuple, fulltext.search_text(index, asked, 3).collect()))


def test_fuzzy_takes_the_best_term(spark):
    docs = [(1, "horse horses"), (2, "house"), (3, "mouse mice"), (4, "apple")]
    df, asked = spark.createDataFrame(docs, "id int, text string"), spark.createDataFrame([(1, "horse")], "query_id int, text string")
    idf, impact = math.log(1 + 3.5 / 1.5), lambda size: 2.2 / (1 + 1.2 * (0.25 + 0.75 * size / 1.5))
    # one document's best term is what counts, not the sum of its terms; house is one edit of five letters off
    want = {1: idf * impact(2), 2: 0.8 * idf * impact(1)}
    assert {r.id: pytest.approx(r.score) for r in fulltext.bm25(df, asked, "id", "text", fuzzy=True).collect()} == want
    assert {r.id for r in fulltext.bm25(df, asked, "id", "text", fuzzy=True, k=1).collect()} == {max(want, key=want.get)}


def test_passing_tables_go(spark):
    with tables.passing(spark) as keep:
        a, b = tables.reliable(spark.range(3)), keep(tables.reliable(spark.range(4)).where("id > 0"))
        path = a.inputFiles()[0].rsplit("/", 1)[0]
    assert b.count() == 3
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    assert not there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there)
