"""Concepts: extraction, filters, fusion, frequencies."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import title_case
from ..params import SETTINGS, STOP_CONCEPTS
from .contain import containing


def clean_names(df: DataFrame, name: str = "name") -> DataFrame:
    """Title case, trimmed, 3 characters and at most 4 words, no structural term."""
    c = title_case(F.trim(F.col(name)))
    return df.withColumn(name, c).where((F.length(name) >= 3) & (F.size(F.split(F.col(name), " +")) <= 4) & ~F.lower(name).isin(*STOP_CONCEPTS))


#: Characters by which drop_substrings() deals the ends of names.
HEAD = 4


def drop_substrings(names: DataFrame, name: str = "name") -> DataFrame:
    """Names that are no proper part of another name, case aside.

    A name is a part of another one where an end of that one begins with it.  So the ends of all names, each once, are
    sorted among those that begin alike, where a name stands just before the ends that it begins; names too short to be
    dealt so are looked up among all parts of their size.
    """
    low = names.select(F.lower(F.col(name)).alias("low")).distinct().where("low <> ''")
    ends = low.select("low", F.length("low").alias("n"), F.explode(F.sequence(F.lit(1), F.length("low"))).alias("i"))
    ends = ends.select("low", "n", "i", (F.col("n") - F.col("i") + 1).alias("size"))
    cut = ends.where(F.col("size") >= HEAD).select(F.substring("low", F.col("i"), F.col("size")).alias("end"), (F.col("i") == 1).alias("whole"))
    cut = cut.groupBy("end").agg(F.bool_or("whole").alias("whole"), F.bool_or(~F.col("whole")).alias("part"))
    following = F.lead("end").over(Window.partitionBy(F.substring("end", 1, HEAD)).orderBy("end"))
    long = cut.withColumn("following", following).where(F.col("whole") & (F.col("part") | F.coalesce(F.startswith("following", "end"), F.lit(False)))).select(F.col("end").alias("low"))
    parts = ends.select("low", "n", "i", F.explode(F.sequence(F.lit(1), F.least("size", F.lit(HEAD - 1)))).alias("k")).where("k < n")
    short = low.where(F.length("low") < HEAD).join(parts.select(F.substring("low", F.col("i"), F.col("k")).alias("low")).distinct(), "low", "left_semi")
    return names.join(long.unionByName(short), F.lower(F.col(name)) == F.col("low"), "left_anti")


def module_groups(records: DataFrame) -> DataFrame:
    """One row a module: number of records, first record's title and key terms, sections, texts in order of id.

    A module's texts are one row, as they are in its book.
    """
    terms = [F.min_by("key_terms", "id").alias("key_terms")] if "key_terms" in records.columns else []
    texts = [F.transform(F.array_sort(F.collect_list(F.struct("id", "text"))), lambda r: r["text"]).alias("texts")] if "text" in records.columns else []
    return records.groupBy("module_id").agg(F.count(F.lit(1)).alias("n_records"), F.min_by("module_title", "id").alias("title"), F.array_join(F.array_sort(F.collect_set("section")), ",").alias("sections"), *terms, *texts)


def document_frequency(mentions: DataFrame) -> DataFrame:
    """name, doc_frequency (number of modules), key_term (any), source_modules, of mentions (module_id, name, key_term)."""
    return mentions.groupBy("name").agg(F.count_distinct("module_id").alias("doc_frequency"), F.bool_or("key_term").alias("key_term"), F.array_sort(F.collect_set("module_id")).alias("source_modules"))


def merge_concepts(old: DataFrame, new: DataFrame) -> DataFrame:
    """Concepts added again: frequencies add up, modules unite, key_term if any."""
    both = old.unionByName(new)
    return both.groupBy("name").agg(F.sum("frequency").alias("frequency"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("source_modules")))).alias("source_modules"), F.bool_or("key_term").alias("key_term"))


def most_common(names: DataFrame, n: int = SETTINGS.max_concepts) -> DataFrame:
    """name, n of the n most frequent names; ties: longer first, then by name."""
    return names.groupBy("name").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc(F.length("name")), "name").limit(n)


def mentions(texts: DataFrame, concepts: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """id, name for each concept (name) that a text contains, case aside."""
    names = concepts.select("name", F.lower("name").alias("low")).distinct()
    lower = texts.select(F.col(id_col).alias("id"), F.lower(F.col(text_col)).alias("text"))
    return containing(lower, names, ["id"]).join(names, "low").select("id", "name")


def query_concepts(queries: DataFrame, concepts: DataFrame, limit: int = SETTINGS.max_query_concepts) -> DataFrame:
    """query_id, name: concepts inside a query, longest first, at most limit."""
    found = mentions(queries, concepts, "query_id")
    order = Window.partitionBy("id").orderBy(F.desc(F.length("name")), "name")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit).select(F.col("id").alias("query_id"), "name", "place")


def known_match(texts: DataFrame, concepts: DataFrame) -> DataFrame:
    """text, name: the known concept that a text is, else the first by name that contains it or is contained in it."""
    names = concepts.select("name", F.lower("name").alias("known")).distinct().where("name <> ''")
    asked = texts.select(F.col("text").alias("said"), F.lower("text").alias("low")).distinct().where("said <> ''")
    forward = containing(asked.select("said", F.col("low").alias("text")), names.select(F.col("known").alias("low")), ["said"])
    forward = forward.join(names, F.col("low") == F.col("known")).select("said", "name")
    backward = containing(names.select("name", F.col("known").alias("text")), asked, ["name"])
    backward = backward.join(asked, "low").select("said", "name")
    kind = F.when(F.lower("said") == F.lower("name"), 0).otherwise(1)
    return forward.unionByName(backward).groupBy(F.col("said").alias("text")).agg(F.min_by("name", F.struct(kind, "name")).alias("name"))


def highlighted(nodes: DataFrame, labels: DataFrame) -> DataFrame:
    """Nodes (name) that one of the labels (label) is or is a part of, case aside."""
    hit = containing(nodes.select("name", F.lower("name").alias("text")), labels.select(F.lower("label").alias("low")), ["name"]).select("name").distinct()
    return nodes.join(hit, "name", "left_semi")


def fuse(matches: DataFrame) -> DataFrame:
    """name, score, strategies of matches (name, score, strategy): the best score, a fifth more for every further strategy,
    1 at most."""
    n = F.count_distinct("strategy")
    return matches.groupBy("name").agg(F.least(F.max("score") * (1 + 0.2 * (n - 1)), F.lit(1.0)).alias("score"), n.alias("strategies"))


def best_per_name(matches: DataFrame) -> DataFrame:
    return matches.groupBy("name").agg(F.max("score").alias("score"), F.max_by("strategy", F.struct("score", "strategy")).alias("strategy"))


def first_non_empty(preferred: DataFrame, fallback: DataFrame, by: str) -> DataFrame:
    """Rows of preferred, and of fallback for keys that preferred lacks."""
    both = preferred.withColumn("_p", F.lit(0)).unionByName(fallback.withColumn("_p", F.lit(1)))
    return both.withColumn("_m", F.min("_p").over(Window.partitionBy(by))).where("_p = _m").drop("_p", "_m")
