"""Reranking by a model, evaluation, reading order and keyed state."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.operators import evaluate, rerank, tree
from graphloom.streaming import learners


def models():
    """Made here, so that they travel to the workers by value: those don't import this module."""

    class ByLength:
        def predict(self, questions, texts):
            return np.array([float(len(t)) for t in texts])

    class Fails(ByLength):
        def predict(self, questions, texts):
            if any("bad" in q for q in questions):
                raise RuntimeError("no")
            return super().predict(questions, texts)

    def no_model():
        raise OSError("weights aren't there")

    return ByLength, Fails, no_model


ByLength, Fails, no_model = models()


@pytest.fixture
def hits(spark):
    rows = [(q, f"{name} question", f"{'x' * n}", i + 1, f"s{n}") for q, name in ((1, "good"), (2, "bad")) for i, n in enumerate((2, 5, 5, 3))] + [(3, "one", None, 1, "s")]
    return spark.createDataFrame(rows, "query_id int, question string, text string, rank int, section string")


def ranked(df, q):
    return [(r["rank"], r.section, r.rerank_score) for r in sorted(df.where(f"query_id = {q}").collect(), key=lambda r: r["rank"])]


def test_hits_are_reordered_cut_and_keep_their_columns(hits):
    got = rerank.rerank_model(hits, 3, ByLength)
    assert set(got.columns) == set(hits.columns) | {"rerank_score"}
    assert ranked(got, 1) == [(1, "s5", 5.0), (2, "s5", 5.0), (3, "s3", 3.0)] and ranked(got, 3) == [(1, "s", 0.0)]
    assert rerank.rerank_model(hits.limit(0), 3, ByLength).count() == 0


def test_failures_pass_hits_through(hits):
    got = rerank.rerank_model(hits, 3, no_model)
    assert ranked(got, 1) == [(1, "s2", None), (2, "s5", None), (3, "s5", None)]
    got = rerank.rerank_model(hits.repartition(2, "query_id").sortWithinPartitions("query_id"), 4, Fails, batch=1)
    assert [s for _, s, _ in ranked(got, 2)] == ["s2", "s5", "s5", "s3"] and [s for _, s, _ in ranked(got, 1)] == ["s5", "s5", "s3", "s2"]


def test_trained_pairs(spark):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(50)]
    rows = []
    for i in range(300):
        asked = rng.sample(words, 5)
        good = i % 2 == 0
        text = (asked if good else []) + rng.choices(words, k=20)
        rows.append((" ".join(asked), " ".join(text), int(good)))
    judged = spark.createDataFrame(rows, "question string, text string, relevant int")
    model = rerank.fit_pairs(judged)
    p = model.predict(*(np.array([r[i] for r in rows], object) for i in (0, 1)))
    assert ((p >= 0.5) == [bool(r[2]) for r in rows]).mean() > 0.95
    assert rerank.fit_pairs(judged.where("relevant = 1")).weights.tolist() == [2.0, 1.0, 0.0]
    assert rerank.fit_pairs(judged.limit(0)).bias == 0.0


def test_precision_counts_ranks(spark):
    rows = [(1, 1, 1), (1, 2, 0), (1, 3, 1), (2, 1, 0), (2, 2, None), (3, 1, 0), (3, 2, 1)]
    got = {r.query_id: (r.context_precision, r.precision, r.n) for r in evaluate.context_precision(spark.createDataFrame(rows, "query_id int, rank int, relevant int")).collect()}
    assert got == {1: (pytest.approx((1 + 2 / 3) / 2), pytest.approx(2 / 3), 3), 2: (0.0, 0.0, 2), 3: (0.5, 0.5, 2)}


def test_answers_are_compared(spark):
    rows = [("The sun is a star", "a STAR, the sun", [1.0, 0.0], [1.0, 1.0]), ("", "x", [0.0, 0.0], [1.0, 0.0]), ("moon", None, [1.0, 0.0], [-1.0, 0.0]), (None, "x", None, [1.0])]
    df = spark.createDataFrame(rows, "a string, c string, v array<double>, w array<double>")
    got = df.select(evaluate.faithfulness(F.col("a"), F.col("c")).alias("f"), evaluate.answer_similarity(F.col("v"), F.col("w")).alias("s")).collect()
    assert [r.f for r in got] == [0.8, 1.0, 0.0, 1.0] and [pytest.approx(r.s) for r in got] == [math.sqrt(0.5), 0.0, 0.0, 0.0]


def test_intervals_hold_the_difference(spark):
    rng = random.Random(2)
    rows = [(i, rng.random(), rng.random() + 0.1) for i in range(400)] + [(999, None, 1.0)]
    df = spark.createDataFrame(rows, "query_id int, first double, second double")
    weights = spark.range(2000).select(evaluate.poisson_weight(F.col("id"), F.lit(1)).alias("w")).agg(F.avg("w"), F.var_samp("w")).first()
    assert abs(weights[0] - 1) < 0.1 and abs(weights[1] - 1) < 0.15
    got = {r.name: r for r in evaluate.bootstrap(df, 300).collect()}
    d = [b - a for _, a, b in rows[:-1]]
    mean, error = sum(d) / 400, np.std(d) / 20
    assert got["difference"].mean == pytest.approx(mean) and got["difference"].low < mean < got["difference"].high
    assert got["difference"].high - got["difference"].low == pytest.approx(2 * 1.96 * error, rel=0.25)
    again = {r.name: r for r in evaluate.bootstrap(df.repartition(5), 300).collect()}
    assert all(again[n].low == pytest.approx(got[n].low) for n in got)
    assert evaluate.bootstrap(df.limit(0)).count() == 0


def test_reading_order_of_deep_trees(spark):
    rows = [("a", None, 0), ("a2", "a", 2), ("a1", "a", 1), ("b", "a1", None), ("c", "a1", None), ("z", None, 3), ("x", "y", 0), ("y", "x", 0), (None, "a", 5), ("d0", "a2", 10)]
    rows += [(f"d{i + 1}", f"d{i}", 10 - i) for i in range(40)]
    got = {r.node: (r.root, r.depth, r.path, r.place) for r in tree.reading_order(spark.createDataFrame(rows, "node string, parent string, pos int")).collect()}
    assert set(got) == {"b", "c", "d40", "z"}
    assert [got[n][3] for n in ("b", "c", "d40")] == [1, 2, 3] and got["z"] == ("z", 0, "3", 1) and got["d40"][1] == 42


# --------------------------------------------------------------------------- keyed state


ANSWERS = "student long, concept string, correct boolean, ts timestamp, event_id long"


def put(spark, folder, n, rows):
    spark.createDataFrame(rows, ANSWERS).coalesce(1).write.parquet(f"{folder}/part{n}.parquet")


def run(spark, folder):
    stream = spark.readStream.schema(ANSWERS).parquet(f"{folder}/*.parquet")
    assert learners.write_updates(learners.mastery(stream), f"{folder}-out", f"{folder}-checkpoint").awaitTermination(90)
    return {(r.student, r.concept): (r.p_known, r.attempts) for r in learners.latest(spark.read.parquet(f"{folder}-out")).collect()}


def test_states_go_on_from_a_checkpoint(spark, tmp_path):
    from datetime import datetime, timedelta

    at = lambda i: datetime(2024, 1, 1) + timedelta(seconds=i)
    folder = f"file://{tmp_path}/answers"
    put(spark, folder, 1, [(1, "a", False, at(2), 2), (1, "a", True, at(1), 1), (1, None, True, at(3), 3), (2, "a", True, at(1), 4)])
    p = learners.bkt(learners.bkt(0.3, True), False)
    got = run(spark, folder)
    assert got[1, "a"] == (pytest.approx(p), 2) and got[1, None] == (pytest.approx(learners.bkt(0.3, True)), 1)
    put(spark, folder, 2, [(1, "a", True, at(9), 9)])
    assert run(spark, folder)[1, "a"] == (pytest.approx(learners.bkt(p, True)), 3)  # a new query, the same checkpoint
    assert "RocksDB" not in (spark.conf.get("spark.sql.streaming.stateStore.providerClass", "") or "")


def test_idle_states_start_anew(spark, tmp_path):
    from datetime import datetime
    from time import monotonic, sleep

    folder = f"file://{tmp_path}/idle"
    put(spark, folder, 1, [(1, "a", True, datetime(2024, 1, 1), 1)])
    stream = spark.readStream.schema(ANSWERS).parquet(f"{folder}/*.parquet")
    query = learners.write_updates(learners.mastery(stream, 1000), f"{folder}-out", f"{folder}-checkpoint", "200 milliseconds")

    def seen(n):
        end = monotonic() + 60
        while monotonic() < end:
            if (tmp_path / "idle-out").exists():
                rows = spark.read.schema("p_known double, attempts long, batch long").parquet(f"{folder}-out").orderBy("batch").collect()
                if len(rows) >= n:
                    return rows
            sleep(0.5)
        raise AssertionError("no batch came")

    try:
        assert [r.attempts for r in seen(1)] == [1]
        sleep(3)
        put(spark, folder, 2, [(1, "a", True, datetime(2024, 1, 2), 2)])
        last = seen(2)[-1]
        assert last.attempts == 1 and last.p_known == pytest.approx(learners.bkt(0.3, True))
    finally:
        query.stop()
