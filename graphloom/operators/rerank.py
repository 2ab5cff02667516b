"""Reranking by a model over pairs of question and text, and its training.

A model is loaded once in each worker and asked for batches of pairs.  If it can't be loaded, or fails on a batch, the
hits of those questions keep their order and have no score.
"""

from __future__ import annotations

import logging
import re
from collections.abc import Callable
from typing import Protocol

import numpy as np
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

BATCH = 32
_TOKEN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


class PairModel(Protocol):
    """Scores of pairs; higher is better."""

    def predict(self, questions: np.ndarray, texts: np.ndarray) -> np.ndarray: ...


#: Called once in a worker.
Load = Callable[[], PairModel]


def pair_features(question: str | None, text: str | None) -> tuple[float, float, float]:
    """Shares of the question's distinct words and of its distinct pairs of neighbouring words that the text holds, and
    of the text's words that are the question's."""
    asked, words = (_TOKEN.findall((x or "").translate(_LOWER)) for x in (question, text))
    own, there = set(asked), set(words)
    pairs, those = set(zip(asked, asked[1:])), set(zip(words, words[1:]))
    return len(own & there) / max(1, len(own)), len(pairs & those) / max(1, len(pairs)), sum(w in own for w in words) / max(1, len(words))


class LinearPairs:
    """A logistic model of pair_features; the default weights ask for words and, half as much, for their order."""

    def __init__(self, weights: tuple[float, ...] = (2.0, 1.0, 0.0), bias: float = 0.0):
        self.weights, self.bias = np.array(weights), bias

    def predict(self, questions: np.ndarray, texts: np.ndarray) -> np.ndarray:
        x = np.array([pair_features(q, t) for q, t in zip(questions, texts)]).reshape(-1, 3)
        return 1 / (1 + np.exp(-(x @ self.weights + self.bias)))


def fit_pairs(judged: DataFrame, limit: int = 4000, rounds: int = 25, ridge: float = 1e-2) -> LinearPairs:
    """LinearPairs from judged pairs (question, text, relevant 0 or 1) by Newton's method, on at most limit rows, those of
    the smallest hashes; without both kinds of rows the default."""
    chosen = judged.where("relevant in (0, 1)").orderBy(F.xxhash64("question", "text"), "relevant").limit(limit)
    features = F.udf(pair_features, "struct<a double, b double, c double>")
    rows = chosen.select(features("question", "text").alias("x"), F.col("relevant").cast("double").alias("y")).collect()  # numbers only
    y = np.array([r.y for r in rows])
    if not len(y) or y.min() == y.max():
        return LinearPairs()
    x = np.c_[np.array([tuple(r.x) for r in rows]), np.ones(len(y))]
    w = np.zeros(4)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(4), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return LinearPairs(tuple(w[:3].tolist()), float(w[3]))


def _predictor(load: Load):
    """The function that predict_batch_udf calls once in a worker; failures are scores that are no number."""

    def make():
        try:
            model = load()
        except Exception as e:  # noqa: BLE001 - whatever a model's loading raises
            logging.getLogger(__name__).warning("reranker not loaded: %s", e)
            model = None

        def predict(questions: np.ndarray, texts: np.ndarray) -> np.ndarray:
            if model is None:
                return np.full(len(questions), np.nan)
            try:
                return np.asarray(model.predict(questions, texts), np.float64)
            except Exception as e:  # noqa: BLE001
                logging.getLogger(__name__).warning("reranker failed: %s", e)
                return np.full(len(questions), np.nan)

        return predict

    return make


def rerank_model(hits: DataFrame, top_k: int, load: Load = LinearPairs, by: tuple[str, ...] = ("query_id",), batch: int = BATCH, digits: int | None = None) -> DataFrame:
    """Hits (question, text, rank, ...) with rerank_score, each question's top_k by it and then by rank; rank is the new one.

    A question of which any hit has no score keeps its order, and its scores are null."""
    score = predict_batch_udf(_predictor(load), return_type=T.DoubleType(), batch_size=batch)
    scored = hits.withColumn("rerank_score", score(F.coalesce("question", F.lit("")), F.coalesce("text", F.lit(""))))
    if digits is not None:
        scored = scored.withColumn("rerank_score", F.round("rerank_score", digits))
    whole = F.bool_and(F.col("rerank_score").isNotNull() & ~F.isnan("rerank_score")).over(Window.partitionBy(*by))
    scored = scored.withColumn("_whole", whole).withColumn("rerank_score", F.when(F.col("_whole"), F.col("rerank_score")))
    order = Window.partitionBy(*by).orderBy(F.desc_nulls_last("rerank_score"), "_before")
    return scored.withColumnRenamed("rank", "_before").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_k).drop("_before", "_whole")
