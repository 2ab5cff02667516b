"""Concepts of texts by several strategies, each matched to the known ones: name tags, keywords, vectors, full text."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import plugins
from ..functions.scoring import fulltext_similarity, yake_similarity
from ..functions.text import tokens
from . import concepts as C
from . import retrieve as R

#: Terms of a query that full text asks for, and concepts that each may bring.
TERMS, PER_TERM = 10, 5
#: Least similarity of a concept's vector, and least full-text score.
LEAST_SIMILAR, LEAST_SCORE = 0.5, 0.5
STRATEGIES = ("ner", "yake", "embedding", "fulltext", "ensemble")


def _known(found: DataFrame, known: DataFrame) -> DataFrame:
    """id, name, score, strategy of found (id, name, score, strategy), with the known concept (name) that each name is,
    or that contains it or is contained in it."""
    match = C.known_match(found.select(F.col("name").alias("text")), known).withColumnRenamed("name", "known")
    rows = found.join(match, found["name"] == match["text"]).select("id", F.col("known").alias("name"), "score", "strategy")
    return rows.groupBy("id", "name", "strategy").agg(F.max("score").alias("score")).select("id", "name", "score", "strategy")


def by_tags(texts: DataFrame, known: DataFrame, tagger: plugins.EntityTagger | None = None) -> DataFrame:
    """Entities and noun chunks of texts (id, text)."""
    return _known(plugins.entities(texts, "id", "text", tagger), known)


def by_keywords(texts: DataFrame, known: DataFrame, top: int = 20) -> DataFrame:
    """Keywords of texts (id, text); a keyword of score s is worth 1 / (1 + s)."""
    found = plugins.keywords(texts, "id", "text", top)
    return _known(found.select("id", "name", yake_similarity(F.col("score")).alias("score"), F.lit("yake").alias("strategy")), known)


def by_vectors(asked: DataFrame, vectors: DataFrame, k: int | None = None) -> DataFrame:
    """The concepts (name, vector) whose vectors are similar to those of the texts (id, vector)."""
    found = R.knn_many(vectors, asked.select(F.col("id").alias("query_id"), "vector"), k, "name", "vector", least=LEAST_SIMILAR, epsilon=1e-8)
    return found.select(F.col("query_id").alias("id"), F.col("id").alias("name"), "score", F.lit("embedding").alias("strategy"))


def search_terms(texts: DataFrame, top: int = TERMS) -> DataFrame:
    """id, term: the keywords of texts (id, text), or where a text has none its words of more than three characters."""
    words = plugins.keywords(texts, "id", "text", top).select("id", F.col("name").alias("term"), F.col("rank").alias("place"))
    plain = texts.select("id", F.posexplode(R.search_terms(F.col("text"))).alias("place", "term")).where(F.col("place") < top).select("id", "term", F.col("place") + 1)
    return C.first_non_empty(words, plain.toDF("id", "term", "place"), "id").select("id", "term", "place")


def fulltext(names: DataFrame, queries: DataFrame, limit: int | None = None, fuzzy: bool = True) -> DataFrame:
    """query_id, name, score: concepts (name) that queries (query_id, text) find by their words, best first; the limit is
    for each query."""
    scores = R.bm25(names.select("name").distinct().withColumn("text", F.col("name")), queries, "name", "text", fuzzy=fuzzy, k=limit)
    if limit is not None:
        scores = R.top_per_query(scores, limit)
    return scores.select("query_id", F.col("id").alias("name"), "score")


def by_fulltext(texts: DataFrame, known: DataFrame) -> DataFrame:
    """Up to five concepts for each of up to ten search terms of texts (id, text)."""
    terms = search_terms(texts).select("id", F.struct("id", "place").alias("query_id"), F.col("term").alias("text"))
    found = fulltext(known, terms.select("query_id", "text"), PER_TERM).where(F.col("score") > LEAST_SCORE)
    rows = found.select(F.col("query_id.id").alias("id"), "name", fulltext_similarity(F.col("score")).alias("score"), F.lit("fulltext").alias("strategy"))
    return rows.groupBy("id", "name", "strategy").agg(F.max("score").alias("score")).select("id", "name", "score", "strategy")


def extract(texts: DataFrame, known: DataFrame, strategy: str = "ensemble", top: int = 10, vectors: DataFrame | None = None, asked: DataFrame | None = None, tagger: plugins.EntityTagger | None = None) -> DataFrame:
    """id, name, score, strategies, rank: the top concepts of texts (id, text) by a strategy; the ensemble fuses tags and
    keywords.  The embedding strategy needs the vectors of concepts (name, vector) and texts (id, vector)."""
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy}")
    if strategy == "embedding":
        if vectors is None or asked is None:
            raise ValueError("the embedding strategy needs vectors")
        found = by_vectors(asked, vectors)
    elif strategy == "fulltext":
        found = by_fulltext(texts, known)
    else:
        parts = [by_tags(texts, known, tagger)] if strategy in ("ner", "ensemble") else []
        parts += [by_keywords(texts, known)] if strategy in ("yake", "ensemble") else []
        found = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    n = F.count_distinct("strategy")
    fused = found.groupBy("id", "name").agg(F.round(F.least(F.max("score") * (1 + 0.2 * (n - 1)), F.lit(1.0)), 6).alias("score"), n.alias("strategies"))
    order = Window.partitionBy("id").orderBy(F.desc("score"), "name")
    return fused.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def query_concepts(queries: DataFrame, known: DataFrame, strategy: str = "ensemble", limit: int = 5, **more) -> DataFrame:
    """query_id, name, place: the strategy's best concepts of each query (query_id, text), or where it finds none those
    that the query contains, longest first."""
    found = extract(queries.select(F.col("query_id").alias("id"), "text"), known, strategy, limit, **more)
    preferred = found.select(F.col("id").alias("query_id"), "name", F.col("rank").alias("place"))
    return C.first_non_empty(preferred, C.query_concepts(queries, known, limit), "query_id")


def vocabulary(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """token: the distinct words of texts."""
    return texts.select(F.explode(tokens(F.col(text_col))).alias("token")).distinct()
