"""Learner state: mastery by ordered folds, profiles, recommendations, quizzes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import learner as L
from ..functions.text import fenced_json
from ..params import SETTINGS
from ..schema import QUIZ
from .concepts import first_non_empty

_STEPS = {"bkt": L.bkt_step, "linear": L.linear_step}


def answers(events: DataFrame, student: str, concept: str, correct: str, order: list[str]) -> DataFrame:
    """student, concept, answers: booleans in order.  One row a key; an array holds one learner's answers on one concept."""
    rows = F.array_sort(F.collect_list(F.struct(*order, F.col(correct).alias("correct"))))
    return events.groupBy(F.col(student).alias("student"), F.col(concept).alias("concept")).agg(F.transform(rows, lambda r: r["correct"]).alias("answers"), F.max(order[0]).alias("last_assessed"))


def mastery(history: DataFrame, model: str = SETTINGS.mastery_model) -> DataFrame:
    """student, concept, mastery_level (within [.1, 1]), p_known, attempts, correct_attempts, last_assessed."""
    p = L.fold(F.col("answers"), _STEPS[model])
    return history.select("student", "concept", F.greatest(F.lit(0.1), F.least(F.lit(1.0), p)).alias("mastery_level"), p.alias("p_known"), F.size("answers").cast("long").alias("attempts"), F.size(F.filter("answers", lambda x: x)).cast("long").alias("correct_attempts"), "last_assessed")


def mastery_trace(history: DataFrame, model: str = SETTINGS.mastery_model) -> DataFrame:
    """student, concept, attempt (from 1), p_known after it."""
    return history.select("student", "concept", F.posexplode(L.trace(F.col("answers"), _STEPS[model])).alias("attempt", "p_known")).withColumn("attempt", F.col("attempt") + 1)


def overall_ability(state: DataFrame) -> DataFrame:
    return state.groupBy("student").agg(F.avg("mastery_level").alias("overall_ability"), F.count(F.lit(1)).alias("concepts"))


def accuracy(state: DataFrame) -> DataFrame:
    return state.withColumn("accuracy", F.when(F.col("attempts") == 0, 0.0).otherwise(F.col("correct_attempts") / F.col("attempts")))


def rollup(state: DataFrame) -> DataFrame:
    """student, mastered (.7 and more), in_progress (.3 to .7), mean."""
    m = F.col("mastery_level")
    return state.groupBy("student").agg(F.count_if(m >= 0.7).alias("mastered"), F.count_if((m >= 0.3) & (m < 0.7)).alias("in_progress"), F.avg(m).alias("mean"))


def lookup(wanted: DataFrame, state: DataFrame, default: float = SETTINGS.initial_mastery) -> DataFrame:
    """wanted (student, concept) with mastery_level, the default where there is none, to 3 places."""
    return wanted.join(state.select("student", "concept", "mastery_level"), ["student", "concept"], "left").withColumn("mastery_level", F.round(F.coalesce("mastery_level", F.lit(default)), 3))


def profiles(state: DataFrame) -> DataFrame:
    """student, overall_ability, concepts: one row a learner."""
    return overall_ability(state)


def reset(profiles: DataFrame, student: int | str, default: float = SETTINGS.initial_mastery) -> DataFrame:
    """Profiles (student, overall_ability, concepts) with one learner's put back to the default one."""
    own = F.col("student") == student
    return profiles.withColumns({"overall_ability": F.when(own, F.lit(default)).otherwise(F.col("overall_ability")), "concepts": F.when(own, F.lit(0).cast("long")).otherwise(F.col("concepts"))})


def forget(state: DataFrame, student: int | str) -> DataFrame:
    """The state without one learner's concepts, as it is after reset()."""
    return state.where(F.col("student") != student)


def first_entries(state: DataFrame, n: int = 6) -> DataFrame:
    """The first n concepts of each learner, by name, as a progress list shows them."""
    order = Window.partitionBy("student").orderBy("concept")
    return state.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)


def grade(results: DataFrame, by: str) -> DataFrame:
    """by, score_pct (0 without results), path_type."""
    pct = F.round(F.coalesce(F.avg(F.col("correct").cast("double")) * 100, F.lit(0.0)), 1)
    return results.groupBy(by).agg(pct.alias("score_pct")).withColumn("path_type", L.path_type(F.col("score_pct")))


def weak_and_strong(results: DataFrame, by: str, place: str) -> DataFrame:
    """by, weak, strong: concepts answered wrong and right, each once, in order of first occurrence; a concept can be
    in both."""
    firsts = results.groupBy(by, "concept", "correct").agg(F.min(place).alias("first"))

    def side(value: bool):
        rows = F.array_sort(F.collect_list(F.when(F.col("correct") == value, F.struct("first", "concept"))))
        return F.transform(rows, lambda r: r["concept"])

    return firsts.groupBy(by).agg(side(False).alias("weak"), side(True).alias("strong"))


def with_fallback(preferred: DataFrame, fallback: DataFrame) -> DataFrame:
    """start, name, importance, rank: prerequisites (or dependents) of a start, or related concepts if it has none."""
    return first_non_empty(preferred, fallback, "start")


def parse_quiz(replies: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row a question of a model's reply: quiz_id, place, text, n_options, correct_option_id, difficulty, difficulty_score.

    A reply that is no JSON has no question.  The score decides the label if there is one, else the label the score.
    """
    quiz = F.from_json(fenced_json(F.col(text_col)), QUIZ)
    rows = replies.select(F.col(id_col).alias("quiz_id"), F.posexplode(quiz["questions"]).alias("place", "q"))
    score = F.coalesce(F.col("q.difficulty_score"), L.difficulty_score(F.coalesce(F.col("q.difficulty"), F.lit("medium"))))
    return rows.select("quiz_id", "place", F.col("q.text").alias("text"), F.size("q.options").alias("n_options"), F.col("q.correct_option_id").alias("correct_option_id"), F.when(F.col("q.difficulty_score").isNotNull(), L.difficulty_label(F.col("q.difficulty_score"))).otherwise(L.difficulty_label(score)).alias("difficulty"), score.alias("difficulty_score"))


def average_difficulty(questions: DataFrame, by: str = "quiz_id") -> DataFrame:
    return questions.groupBy(by).agg(F.round(F.coalesce(F.avg("difficulty_score"), F.lit(0.5)), 2).alias("average_difficulty"))


def merge_profiles(old: DataFrame, new: DataFrame, key: str = "student_id") -> DataFrame:
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def events_rate(events: DataFrame, ts: str, key: str, width: str = "1 minute") -> DataFrame:
    """Requests of each key in each window."""
    return events.groupBy(F.window(ts, width).alias("w"), F.col(key).alias("key")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), "key", "n")


def over_limit(rates: DataFrame, limit: int) -> DataFrame:
    return rates.where(F.col("n") > limit)
