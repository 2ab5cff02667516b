"""Retrieval: exact vector search, BM25, rank fusion, window and graph expansion, reranking."""

from __future__ import annotations

import warnings
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scoring import cosine, rrf_term
from ..functions.text import tokens
from ..params import SETTINGS
from .fulltext import TextIndex, bm25
from .vectors import knn_many


def ranked(df: DataFrame, order: list, by: list[str] | None = None, name: str = "rank") -> DataFrame:
    """A 1-based rank in order; within groups, or else over a result list that is a top-k already."""
    return df.withColumn(name, F.row_number().over((Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy(*order)))


def knn(vectors: DataFrame, query: Sequence[float], k: int, id_col: str, vector_col: str, digits: int = 6) -> DataFrame:
    """The k rows most similar to one query vector: id, score, rank.  The query is a literal, so the scan prunes to id and
    vector and the top-k is taken without a shuffle of rows."""
    scored = vectors.select(F.col(id_col).alias("id"), F.round(cosine(F.col(vector_col), F.array(*[F.lit(float(x)) for x in query])), digits).alias("score"))
    return ranked(scored.orderBy(F.desc("score"), "id").limit(k), [F.desc("score"), F.col("id")])


def knn_filtered(vectors: DataFrame, query: Sequence[float], k: int, id_col: str, vector_col: str, condition: Column) -> DataFrame:
    """knn() and then the filter, so fewer than k rows may stay."""
    hits = knn(vectors, query, k, id_col, vector_col)
    return hits.join(vectors.withColumnRenamed(id_col, "id"), "id").where(condition)


def vector_of(vectors: DataFrame, key: int, id_col: str, vector_col: str) -> list[float]:
    """One vector (a single row) for use as a query."""
    return list(vectors.where(F.col(id_col) == key).select(vector_col).first()[0])


def bm25_best_field(docs: DataFrame, queries: DataFrame, id_col: str, fields: dict[str, float], fuzzy: bool = False, k: int | None = None, indexes: dict[str, TextIndex] | None = None) -> DataFrame:
    """query_id, id, score: the best of the fields' BM25 scores, each times its boost; a field's index may be given.

    The first k by the best score are among the first k of the field that gives it, so each field's k are enough."""
    parts = [bm25(docs, queries, id_col, f, fuzzy, k, boost, (indexes or {}).get(f)) for f, boost in fields.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("query_id", "id").agg(F.max("score").alias("score"))


def top_per_query(scores: DataFrame, k: int, by: str = "query_id", digits: int = 6) -> DataFrame:
    rounded = scores.withColumn("score", F.round("score", digits))
    return ranked(rounded, [F.desc("score"), F.col("id")], [by]).where(F.col("rank") <= k)


def rrf(lists: Sequence[DataFrame], k: int = SETTINGS.rrf_k, top_k: int | None = None) -> DataFrame:
    """id, rrf_score of lists (id, rank): the sum of 1 / (k + rank); ties by the rank in the first list, the second, and
    so on, then id."""
    out = None
    for i, ids in enumerate(lists):
        own = ids.select("id", rrf_term(F.col("rank"), k).alias("part"), *[(F.col("rank") if j == i else F.lit(None).cast("int")).alias(f"rank{j}") for j in range(len(lists))])
        out = own if out is None else out.unionByName(own)
    ranks = [f"rank{j}" for j in range(len(lists))]
    fused = out.groupBy("id").agg(F.sum("part").alias("rrf_score"), *[F.min(r).alias(r) for r in ranks]).withColumn("rrf_score", F.round("rrf_score", 9))
    order = [F.desc("rrf_score"), *[F.asc_nulls_last(r) for r in ranks], F.col("id")]
    if top_k is None:
        return fused.select("id", "rrf_score")
    return ranked(fused.orderBy(*order).limit(top_k), order).select("id", "rrf_score", "rank")


def hybrid(vectors: DataFrame, query: Sequence[float], docs: DataFrame, text: DataFrame, k: int, fields: dict[str, float], fuzzy: bool = False) -> DataFrame:
    """RRF of the vector list and the best-field BM25 list: id, rrf_score, rank."""
    near = knn(vectors, query, k, "id", "vector")
    found = bm25_best_field(docs, text, "id", fields, fuzzy, k).select("id", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "id").limit(k)
    return rrf([near, ranked(found, [F.desc("score"), F.col("id")])], top_k=k)


def hybrid_many(vectors: DataFrame, asked: DataFrame, docs: DataFrame, questions: DataFrame, k: int, fields: dict[str, float], fuzzy: bool = True, rrf_k: int = SETTINGS.rrf_k) -> DataFrame:
    """query_id, id, rrf_score, rank: hybrid() for each of the questions (query_id, text) and their vectors (query_id,
    vector)."""
    near = knn_many(vectors, asked, k, "id", "vector").select("query_id", "id", F.col("rank").alias("near"), F.lit(None).cast("int").alias("found"))
    found = top_per_query(bm25_best_field(docs, questions, "id", fields, fuzzy, k), k).select("query_id", "id", F.lit(None).cast("int").alias("near"), F.col("rank").alias("found"))
    both = near.unionByName(found).groupBy("query_id", "id").agg(F.min("near").alias("near"), F.min("found").alias("found"))
    score = F.coalesce(rrf_term(F.col("near"), rrf_k), F.lit(0.0)) + F.coalesce(rrf_term(F.col("found"), rrf_k), F.lit(0.0))
    order = [F.desc("rrf_score"), F.asc_nulls_last("near"), F.asc_nulls_last("found"), F.col("id")]
    return ranked(both.withColumn("rrf_score", F.round(score, 9)), order, ["query_id"]).where(F.col("rank") <= k).select("query_id", "id", "rrf_score", "rank")


def window(chunks: DataFrame, hits: DataFrame, size: int, dedupe: bool = True, by: tuple[str, ...] = ()) -> DataFrame:
    """Chunks (chunk_id, module_id, chunk_index) within size places of the hits (chunk_id, hit_rank, score).

    With dedupe a chunk comes once (for each value of the hits' columns by), from the hit of the best rank that reaches
    it, and is_original_hit says whether that hit is the chunk itself; original_score is that hit's score.  An equi-join
    on the place, not a range join.
    """
    centre = hits.join(chunks.select("chunk_id", "module_id", "chunk_index"), "chunk_id").select("module_id", F.col("chunk_index").alias("at"), "hit_rank", F.col("score").alias("original_score"), F.col("chunk_id").alias("hit_id"), *by)
    reach = centre.withColumn("chunk_index", F.explode(F.sequence(F.col("at") - size, F.col("at") + size)))
    out = reach.join(chunks, ["module_id", "chunk_index"]).withColumn("is_original_hit", F.col("hit_id") == F.col("chunk_id"))
    if not dedupe:
        return out
    first = Window.partitionBy(*by, "chunk_id").orderBy("hit_rank")
    return out.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def retrieve_window(vectors: DataFrame, query: Sequence[float], chunks: DataFrame, k: int, size: int = SETTINGS.window_size) -> DataFrame:
    """The k chunks most similar to a query, with the chunks around them (none for size 0); warns if there is none."""
    near = knn(vectors, query, k, "id", "vector").select(F.col("id").alias("chunk_id"), F.col("rank").alias("hit_rank"), "score")
    if near.isEmpty():
        warnings.warn("vector search found nothing", stacklevel=2)
    return window(chunks, near, size)


def merge_windows(expanded: DataFrame, separator: str = "\n\n", by: tuple[str, ...] = ()) -> DataFrame:
    """One row a module (and value of by): texts in reading order, number of chunks and of hits, ids."""
    rows = F.array_sort(F.collect_list(F.struct("chunk_index", "chunk_id", "text", "is_original_hit")))
    out = expanded.groupBy(*by, "module_id").agg(rows.alias("rows"), F.min("hit_rank").alias("hit_rank"))
    return out.select(*by, "module_id", F.array_join(F.transform("rows", lambda r: r["text"]), separator).alias("text"), F.size("rows").alias("chunk_count"), F.size(F.filter("rows", lambda r: r["is_original_hit"])).alias("hit_count"), F.array_join(F.transform("rows", lambda r: r["chunk_id"].cast("string")), ",").alias("chunk_ids"), "hit_rank")


def graph_context(hits: DataFrame, mentions: DataFrame, edges: DataFrame, hops: int = 1) -> DataFrame:
    """chunk_id with its concepts and the concepts within hops RELATED or PREREQ edges of those, each a sorted set."""
    near = edges.where(F.col("type").isin("RELATED", "PREREQ"))
    both = near.select(F.col("source").alias("name"), F.col("target").alias("other")).unionByName(near.select(F.col("target").alias("name"), F.col("source").alias("other"))).distinct()
    own = hits.select("chunk_id").join(mentions.select("chunk_id", F.col("concept").alias("name")), "chunk_id", "left")
    front, reached = own, None
    for _ in range(hops):
        front = front.join(both, "name").select("chunk_id", F.col("other").alias("name")).distinct()
        reached = front if reached is None else reached.unionByName(front)
    sets = own.groupBy("chunk_id").agg(F.array_sort(F.collect_set("name")).alias("concepts"))
    more = reached.groupBy("chunk_id").agg(F.array_sort(F.collect_set("name")).alias("related"))
    return sets.join(more, "chunk_id", "left").withColumn("related", F.coalesce("related", F.array().cast("array<string>")))


def lexical(query: Column, text: Column) -> Column:
    """Share of a query's tokens that a text holds."""
    asked = F.array_distinct(tokens(query))
    return F.size(F.array_intersect(asked, tokens(text))) / F.greatest(F.size(asked), F.lit(1))


def rerank(hits: DataFrame, query: str, top_k: int, scorer: Callable[[Column, Column], Column] = lexical) -> DataFrame:
    """Hits (id, text, rank) by the scorer's values (columns of query and text to a column), then by rank."""
    return hits.withColumn("rerank_score", scorer(F.lit(query), F.col("text"))).orderBy(F.desc("rerank_score"), "rank").limit(top_k)


def rerank_many(hits: DataFrame, top_k: int, scorer: Callable[[Column, Column], Column] = lexical) -> DataFrame:
    """rerank() for hits (query_id, question, text, rank) of many questions; rank is the new one."""
    scored = hits.withColumn("rerank_score", scorer(F.col("question"), F.col("text"))).withColumnRenamed("rank", "before")
    return ranked(scored, [F.desc("rerank_score"), F.col("before")], ["query_id"]).where(F.col("rank") <= top_k).drop("before")


def precision(judged: DataFrame, by: str = "query_id") -> DataFrame:
    """Share of relevant rows of each query's list (column relevant)."""
    return judged.groupBy(by).agg(F.avg(F.col("relevant").cast("double")).alias("precision"), F.count(F.lit(1)).alias("n"))


def collection_info(df: DataFrame, vector_col: str | None = None) -> DataFrame:
    """doc_count, exists, and with a vector column embedded and missing."""
    more = [F.count(vector_col).alias("embedded"), F.count_if(F.col(vector_col).isNull()).alias("missing")] if vector_col else []
    return df.agg(F.count(F.lit(1)).alias("doc_count"), F.lit(True).alias("exists"), *more)


#: Columns of a hit, and what stands in for missing ones.
HIT = {"id": "", "text": "", "module_id": "", "module_title": "", "section": "", "attribution": ""}


def standard_hits(hits: DataFrame, mode: str = "hybrid") -> DataFrame:
    """Hits with the standard columns: missing ones get their defaults."""
    out = {k: F.coalesce(F.col(k).cast("string"), F.lit(v)) if k in hits.columns else F.lit(v) for k, v in HIT.items()}
    terms = F.coalesce("key_terms", F.array().cast("array<string>")) if "key_terms" in hits.columns else F.array().cast("array<string>")
    return hits.select(*[c.alias(k) for k, c in out.items()], terms.alias("key_terms"), F.col("score").cast("double").alias("score"), F.lit(mode).alias("retrieval_mode"))


def hit_key(text: Column, key: Column) -> Column:
    """The id of a hit, or a hash of the text's first 50 characters where it has none: what hits are the same by."""
    return F.coalesce(key.cast("string"), F.md5(F.substring(F.coalesce(text, F.lit("")), 1, 50)))


def search_terms(text: Column) -> Column:
    """Words of more than three characters."""
    return F.filter(F.split(text, r"\s+"), lambda w: F.length(w) > 3)


def retrieve(vectors: DataFrame, query: Sequence[float], docs: DataFrame, text: DataFrame, k: int = SETTINGS.top_k, mode: str = SETTINGS.retrieval_mode, backend: str = SETTINGS.vector_backend, fields: dict[str, float] | None = None, fuzzy: bool = False, chunks: DataFrame | None = None, window_size: int = SETTINGS.window_size) -> DataFrame:
    """id, score, rank by mode (knn or hybrid) and backend: the graph store only searches vectors, hybrid fuses both and,
    where chunks are given, adds the chunks around the hits (module_id, chunk_index, is_original_hit; window())."""
    near = knn(vectors, query, k, "id", "vector")
    if backend == "neo4j" or (backend == "opensearch" and mode == "knn"):
        return near.select("id", "score", "rank")
    both = hybrid(vectors, query, docs, text, k, fields or {"text": 3.0}, fuzzy)
    if backend == "hybrid":
        both = rrf([near, both], top_k=k)
    hits = both.select("id", F.col("rrf_score").alias("score"), "rank")
    if backend == "hybrid" and chunks is not None:
        return window(chunks, hits.select(F.col("id").alias("chunk_id"), F.col("rank").alias("hit_rank"), "score"), window_size)
    return hits
