"""Learner-model functions: one-step updates, folds and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..params import SETTINGS
from .scoring import clamp


def bkt_step(p: Column, correct: Column, transit: float = SETTINGS.p_transit, slip: float = SETTINGS.p_slip, guess: float = SETTINGS.p_guess) -> Column:
    """Bayesian knowledge tracing: the posterior after an answer, then learning, within [.01, .99]."""
    right = p * (1 - slip) / (p * (1 - slip) + (1 - p) * guess)
    wrong = p * slip / (p * slip + (1 - p) * (1 - guess))
    post = F.when(correct, right).otherwise(wrong)
    return clamp(post + (1 - post) * transit, 0.01, 0.99)


def linear_step(p: Column, correct: Column) -> Column:
    return clamp(p + F.when(correct, 0.15).otherwise(-0.10), 0.1, 1.0)


def fold(answers: Column, step, start: float = SETTINGS.initial_mastery) -> Column:
    """Mastery after an ordered array of booleans."""
    return F.aggregate(answers, F.lit(float(start)), lambda p, correct: step(p, correct))


def trace(answers: Column, step, start: float = SETTINGS.initial_mastery) -> Column:
    """Mastery after each answer of an ordered array of booleans."""
    begin = F.array(F.lit(float(start)))
    walked = F.aggregate(answers, begin, lambda acc, correct: F.concat(acc, F.array(step(F.element_at(acc, -1), correct))))
    return F.slice(walked, 2, F.greatest(F.size(answers), F.lit(1)))


def target_difficulty(mastery: Column) -> Column:
    return F.when(mastery < 0.4, "easy").when(mastery <= 0.7, "medium").otherwise("hard")


def difficulty_label(score: Column) -> Column:
    return F.when(score < 0.35, "easy").when(score < 0.65, "medium").otherwise("hard")


def difficulty_score(label: Column) -> Column:
    name = F.lower(F.trim(label))
    return F.when(name == "easy", 0.25).when(name == "hard", 0.75).otherwise(0.5)


def path_type(score_pct: Column) -> Column:
    return F.when(score_pct < 50, "remediation").when(score_pct > 80, "advancement").otherwise("mixed")


def is_correct(selected: Column, correct: Column) -> Column:
    """Whether the option that was selected is the correct one; no selection is wrong."""
    return F.coalesce(selected == correct, F.lit(False))


def learning_status(mastery: Column) -> Column:
    return F.when(mastery >= 0.7, "complete").when(mastery >= 0.3, "current").otherwise("pending")


def result_band(share: Column) -> Column:
    return F.when(share >= 0.7, "high").when(share >= 0.4, "middle").otherwise("low")


def node_size(importance: Column) -> Column:
    return 25 + 45 * importance


def summary(path: Column, score_pct: Column, weak: Column, strong: Column) -> Column:
    """The text that goes with a recommendation; weak and strong are arrays of names."""
    # The sentences.
    score = F.bround(score_pct.cast("double"), 0).cast("long").cast("string")  # half to even

    def names(c: Column, n: int, other: str) -> Column:
        joined = F.array_join(F.slice(c, 1, n), ", ")
        return F.when(joined == "", other).otherwise(joined)

    remedy = F.concat(F.lit("You scored "), score, F.lit("%. We recommend reviewing "), names(weak, 3, "the quiz topics"), F.lit(" and their prerequisites before moving on."))
    advance = F.concat(F.lit("Excellent! You scored "), score, F.lit("%. You've demonstrated strong mastery of "), names(strong, 3, "the quiz topics"), F.lit(". Explore the advanced topics below to deepen your understanding."))
    mixed = F.concat(F.lit("You scored "), score, F.lit("%. You're doing well on "), names(strong, 2, "other areas"), F.lit(", but could strengthen "), names(weak, 2, "some areas"), F.lit(". See targeted recommendations below."))
    return F.when(path == "remediation", remedy).when(path == "advancement", advance).otherwise(mixed)


def mastery_band(mastery: Column) -> Column:
    """Colour band of a mastery level."""
    return F.when(mastery >= 0.7, "green").when(mastery >= 0.4, "yellow").otherwise("red")
