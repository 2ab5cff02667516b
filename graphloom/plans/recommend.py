"""What to do after a quiz: remediation and advancement blocks, readings, deep dives, quiz assembly, demo profiles."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import learner as L
from ..functions.text import preview
from ..operators import graph as G
from ..operators import learner as O
from ..operators import retrieve as R
from ..params import SETTINGS
from ..plugins import Embedder, Generator, embed, generate


def blocks(results: DataFrame, edges: DataFrame, nodes: DataFrame, state: DataFrame, limit: int = 5) -> DataFrame:
    """quiz, side, concept, name, importance, rank, mastery_level for results (quiz, student, concept, correct, place).

    A weak concept gets its prerequisites, a strong one its dependents, either its related concepts if it has none; each
    with the learner's mastery, the default where it is unknown.
    """
    sides = results.groupBy("quiz", "student", "concept", "correct").agg(F.min("place").alias("first")).select("quiz", "student", "concept", F.when(F.col("correct"), "strong").otherwise("weak").alias("side"))
    starts = sides.select(F.col("concept").alias("name")).distinct()
    related = G.direct(edges, nodes, starts, "related", limit)
    found = None
    for side, kind in (("weak", "prerequisites"), ("strong", "dependents")):
        part = O.with_fallback(G.direct(edges, nodes, starts, kind, limit), related).withColumn("side", F.lit(side))
        found = part if found is None else found.unionByName(part)
    joined = sides.join(found.withColumnRenamed("start", "concept"), ["concept", "side"])
    known = state.select("student", F.col("concept").alias("name"), "mastery_level")
    return joined.join(known, ["student", "name"], "left").select("quiz", "side", "concept", "name", "importance", "rank", F.round(F.coalesce("mastery_level", F.lit(SETTINGS.initial_mastery)), 3).alias("mastery_level"))


def readings(concepts: DataFrame, docs: DataFrame, top: int = 2, vectors: DataFrame | None = None, embedder: Embedder | None = None) -> DataFrame:
    """query_id, id, score, rank, preview: the best texts for each concept (query_id, text); by words, or by words and
    vectors where the texts' vectors (id, vector) are given."""
    if vectors is None:
        hits = R.top_per_query(R.bm25(docs, concepts, "id", "text", k=top), top)
    else:
        asked = embed(concepts, "text", embedder).select("query_id", F.col("embedding").alias("vector"))
        hits = R.hybrid_many(vectors, asked, docs, concepts, top, {"text": 3.0}).withColumnRenamed("rrf_score", "score")
    return hits.join(docs, "id").select("query_id", "id", "score", "rank", preview(F.col("text")).alias("preview"))


def deep_dive(concept: str, generator: Generator, temperature: float = 0.7, max_tokens: int = 512, timeout: float = 30.0) -> str | None:
    """A generator's text on a concept; None if it fails or takes longer.  A generator with a method configured() is
    asked for one with these settings."""
    own = generator.configured(temperature=temperature, max_tokens=max_tokens) if hasattr(generator, "configured") else generator
    pool = ThreadPoolExecutor(1)
    try:
        return pool.submit(own.generate, f"Write a deep dive on {concept}.").result(timeout)
    except (ConnectionError, TimeoutError):
        return None
    finally:
        pool.shutdown(wait=False, cancel_futures=True)


def recommend(results: DataFrame, edges: DataFrame, nodes: DataFrame, state: DataFrame, docs: DataFrame, generator: Generator, vectors: DataFrame | None = None) -> DataFrame:
    """The rows of blocks() with readings (ids of two texts) of each weak concept and a deep dive on each strong one
    (null where the generator fails)."""
    found = blocks(results, edges, nodes, state)
    asked = found.where("side = 'weak'").select(F.col("concept").alias("query_id"), F.col("concept").alias("text")).distinct()
    read = readings(asked, docs, 2, vectors).groupBy(F.col("query_id").alias("concept")).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda r: r["id"]).alias("readings")).withColumn("side", F.lit("weak"))
    strong = found.where("side = 'strong'").select("concept", "side").distinct().withColumn("prompt", F.concat(F.lit("Write a deep dive on "), "concept", F.lit(".")))
    dives = generate(strong, "prompt", generator, retries=1).select("concept", "side", F.col("reply").alias("deep_dive"))
    return found.join(read, ["concept", "side"], "left").join(dives, ["concept", "side"], "left")


def assemble(questions: DataFrame, topic: str) -> DataFrame:
    """Parsed questions with ids and the topic as their concept."""
    return questions.withColumns({"question_id": F.concat_ws("-", F.col("quiz_id").cast("string"), F.col("place").cast("string")), "related_concept": F.lit(topic)})


def optimistic(level: Column, correct: Column) -> Column:
    """The client's own update before the server answers: always the linear one."""
    return L.linear_step(level, correct)


def seed(concepts: DataFrame, now: Column) -> DataFrame:
    """A demo profile: mastery and times before now (a timestamp column) from each concept's place (name, place)."""
    level = F.round(0.1 + (F.col("place") % 9) / 10, 2)
    return concepts.select(F.col("name").alias("concept"), level.alias("mastery_level"), (3 + F.col("place") % 5).alias("attempts"), (now - F.make_interval(hours=F.col("place").cast("int"))).alias("last_assessed"))
