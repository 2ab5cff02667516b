"""Exact values of the learner model, labels and recommendations."""

import pytest
from pyspark.sql import functions as F

from graphloom.functions import learner as L
from graphloom.operators import learner as O
from graphloom.streaming.learners import bkt, run_to_end


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first().x


@pytest.mark.parametrize(("step", "correct", "want"), [(L.bkt_step, True, 0.6461), (L.bkt_step, False, 0.14865), (L.linear_step, True, 0.45), (L.linear_step, False, 0.20)])
def test_one_step(spark, step, correct, want):
    assert one(spark, step(F.lit(0.3), F.lit(correct))) == pytest.approx(want, abs=5e-5)


def test_folds(spark):
    def after(step, answers):
        return one(spark, L.fold(F.array(*[F.lit(a) for a in answers]), step))

    assert after(L.bkt_step, [True] * 5) >= 0.95
    assert after(L.bkt_step, [True] * 15) > 0.9
    assert 0.01 <= after(L.bkt_step, [False] * 50) <= 0.99
    assert after(L.linear_step, [False] * 10) == pytest.approx(0.1)
    assert after(L.linear_step, [True] * 10) == pytest.approx(1.0)


def test_overall_ability(spark):
    rows = [(1, "a", True, 1), (1, "b", True, 2), (1, "b", False, 3)]
    events = spark.createDataFrame(rows, "s int, c string, ok boolean, t int")
    state = O.mastery(O.answers(events, "s", "c", "ok", ["t"]), "linear")
    assert O.overall_ability(state).first().overall_ability == pytest.approx(0.40)


@pytest.mark.parametrize(("pct", "want"), [(40, "remediation"), (50, "mixed"), (60, "mixed"), (80, "mixed"), (90, "advancement")])
def test_path_type(spark, pct, want):
    assert one(spark, L.path_type(F.lit(pct))) == want


def test_labels(spark):
    assert [one(spark, L.target_difficulty(F.lit(m))) for m in (0.39, 0.4, 0.7, 0.71)] == ["easy", "medium", "medium", "hard"]
    assert [one(spark, L.difficulty_label(F.lit(m))) for m in (0.34, 0.35, 0.65)] == ["easy", "medium", "hard"]
    assert [one(spark, L.difficulty_score(F.lit(m))) for m in (" Easy", "HARD", "x")] == [0.25, 0.75, 0.5]


def test_weak_then_strong_is_both(spark):
    rows = [(1, "a", False, 1), (1, "a", True, 2), (1, "b", True, 0)]
    r = O.weak_and_strong(spark.createDataFrame(rows, "q int, concept string, correct boolean, place int"), "q", "place").first()
    assert (r.weak, r.strong) == (["a"], ["b", "a"])


def test_quiz_reply(spark):
    def parsed(text):
        return O.parse_quiz(spark.createDataFrame([(1, text)], "id int, t string"), "id", "t").collect()

    question = '{"questions":[{"text":"q","options":[{"id":"a","text":"x"}],"correct_option_id":"a","explanation":"","difficulty":"hard"%s}]}'
    assert [(r.difficulty_score, r.difficulty) for r in parsed("```json\n" + question % ',"difficulty_score":0.2' + "\n```")] == [(0.2, "easy")]
    assert [(r.difficulty_score, r.difficulty) for r in parsed(question % "")] == [(0.75, "hard")]
    assert parsed("no") == []


def test_stream_agrees_with_batch(spark, small):
    from graphloom.queries.learners import state

    batch = {(r.student, r.concept): r.p_known for r in state(spark, small).collect()}
    stream = {(r.student, r.concept): r.p_known for r in run_to_end(spark, small).collect()}
    assert stream.keys() == batch.keys()
    assert all(stream[k] == pytest.approx(batch[k]) for k in batch)
    assert bkt(0.3, True) == pytest.approx(0.6461, abs=5e-5)
