"""Adaptive quizzes: difficulty of a learner's concepts, and the prompts for a generator."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.learner import target_difficulty
from ..operators import retrieve as R
from ..plugins import Embedder, embed

# Score ranges that the prompts ask for.
SCORE_RANGES = {"easy": "0.1 and 0.3", "medium": "0.35 and 0.6", "hard": "0.65 and 0.9"}


#: What a question of each level asks of a learner.
LEVELS = {
    "easy": "Ask for single facts that the text states outright, in plain words; nothing has to be inferred, and one option is clearly right.",
    "medium": "Ask for understanding: two facts of the text may have to be put together or applied; the wrong options sound possible.",
    "hard": "Ask for analysis: several ideas of the text have to be weighed, carried over to a new case or thought further; telling the options apart takes care.",
}
#: The form of a reply that operators.learner.parse_quiz reads.
FORM = """Reply with one JSON object and nothing else:
{"questions": [{"text": "...", "options": [{"id": "a", "text": "..."}, {"id": "b", "text": "..."}, {"id": "c", "text": "..."}, {"id": "d", "text": "..."}], "correct_option_id": "b", "explanation": "...", "difficulty": "LEVEL", "difficulty_score": 0.5}]}
Four options each, one of them right; the explanation says why by the text; difficulty_score lies between RANGE."""


def user_prompt(n: int, context: Column, difficulty: Column) -> Column:
    """The prompt for n questions of a level about a context: what the level asks for, the text, the form of the reply."""
    out = F.lit(None).cast("string")
    for level, wants in LEVELS.items():
        head = f"Write {n} {level.upper()} multiple-choice questions on the text below, from the text alone.\n{wants}\n\nTEXT:\n"
        tail = "\n\n" + FORM.replace("LEVEL", level).replace("RANGE", SCORE_RANGES[level])
        out = F.when(difficulty == level, F.concat(F.lit(head), context, F.lit(tail))).otherwise(out)
    return out


def score_range(difficulty: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, text in SCORE_RANGES.items():
        out = F.when(difficulty == name, text).otherwise(out)
    return out


def contexts(concepts: DataFrame, docs: DataFrame, vectors: DataFrame, embedder: Embedder | None = None) -> DataFrame:
    """concept, context: of the two texts (id, text) that words and vectors find for a concept the first one."""
    asked = concepts.select(F.col("concept").alias("query_id"), F.col("concept").alias("text")).distinct()
    near = embed(asked, "text", embedder).select("query_id", F.col("embedding").alias("vector"))
    hits = R.hybrid_many(vectors, near, docs, asked, 2, {"text": 3.0}).where("rank = 1")
    return hits.join(docs, "id").select(F.col("query_id").alias("concept"), F.col("text").alias("context"))


def prompts(state: DataFrame, found: DataFrame, n: int = 3) -> DataFrame:
    """student, concept, difficulty, score_range, prompt for each concept of each learner; found: concept, context."""
    level = target_difficulty(F.col("mastery_level"))
    rows = state.join(found, "concept", "left")
    return rows.select("student", "concept", level.alias("difficulty"), score_range(level).alias("score_range"), user_prompt(n, F.coalesce("context", F.lit("")), level).alias("prompt"))
