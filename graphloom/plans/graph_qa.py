"""Questions about the graph: a router to named queries, guarded SQL for others, previews and the schema."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import asks_to_write, contains_ci
from ..operators import graph as G
from .sql_guard import check


@dataclass(frozen=True)
class Tables:
    """nodes (name, importance, module_id) and edges (source, target, type, weight, edge_id)."""

    nodes: DataFrame
    edges: DataFrame


def _starts(t: Tables, name: str) -> DataFrame:
    return t.nodes.where(F.lower("name") == name.lower()).select("name")


def prerequisites_of(t: Tables, name: str) -> DataFrame:
    return G.direct(t.edges, t.nodes, _starts(t, name), "prerequisites", None).select("name", "importance")


def modules_covering(t: Tables, text: str) -> DataFrame:
    return t.nodes.where(contains_ci(F.col("name"), F.lit(text))).select("module_id").distinct()


def related_to(t: Tables, name: str) -> DataFrame:
    return G.direct(t.edges, t.nodes, _starts(t, name), "related", 10).select("name", "importance")


def most_important(t: Tables, _: str = "") -> DataFrame:
    return G.important(t.nodes).select("name", "importance")


def concepts_of(t: Tables, module: str) -> DataFrame:
    return t.nodes.where(F.lower("module_id") == module.lower()).select("name", "importance")


def path_between(t: Tables, names: str) -> DataFrame:
    """names: 'a -> b'; every trail of up to three PREREQ edges from a to b."""
    first, _, last = (x.strip() for x in names.partition("->"))
    return G.paths(t.edges.where("type = 'PREREQ'"), _starts(t, first)).where(F.lower("node") == last.lower()).select("names")


#: Patterns of questions in the order in which they are tried; the groups are the query's argument.
ROUTES: tuple[tuple[str, Callable[[Tables, str], DataFrame]], ...] = (
    (r"path (?:from|between) (.+?) (?:to|and) (.+?)\??$", path_between),
    (r"prerequisites? (?:of|for) (.+?)\??$", prerequisites_of),
    (r"(?:modules?|chapters?) (?:cover|covering|that cover|about) (.+?)\??$", modules_covering),
    (r"(?:related|similar) to (.+?)\??$", related_to),
    (r"concepts (?:of|in) (?:module |chapter )?(.+?)\??$", concepts_of),
    (r"(?:most )?important concepts", most_important),
)


def route(question: str) -> tuple[Callable[[Tables, str], DataFrame], str] | None:
    """The named query that a question asks for and its argument; None if no pattern fits."""
    for pattern, found in ROUTES:
        if m := re.search(pattern, question.strip(), re.IGNORECASE):
            return found, " -> ".join(m.groups()) if m.groups() else ""
    return None


def refused(spark: SparkSession, question: str) -> bool:
    """Whether a question asks for a change of the data."""
    return bool(spark.range(1).select(asks_to_write(F.lit(question)).alias("x")).first().x)


def execute(spark: SparkSession, sql: str, tables: Tables) -> DataFrame:
    """A SELECT over nodes and edges; ValueError for anything else (see sql_guard).

    The two relations stand under names of their own while the statement is analysed, and the session's views stay as
    they are."""
    check(spark, sql, ("nodes", "edges"))
    own = uuid.uuid4().hex
    views = {name: f"{name}_{own}" for name in ("nodes", "edges")}
    tables.nodes.createOrReplaceTempView(views["nodes"])
    tables.edges.createOrReplaceTempView(views["edges"])
    try:
        named = ", ".join(f"{name} AS (SELECT * FROM {view})" for name, view in views.items())
        return spark.sql(f"WITH {named} SELECT * FROM (\n{sql.strip().rstrip(';')}\n)")
    finally:
        for view in views.values():
            spark.catalog.dropTempView(view)


def ask(spark: SparkSession, question: str, tables: Tables, to_sql: Callable[[str], str] | None = None, limit: int = 20) -> DataFrame:
    """Rows that answer a question: by a named query, else by the SQL that to_sql (a model) makes of it; a preview of
    limit rows."""
    if refused(spark, question):
        raise ValueError("questions don't change the graph")
    found = route(question)
    if found:
        return found[0](tables, found[1]).limit(limit)
    if to_sql is None:
        raise ValueError("no query for this question")
    return execute(spark, to_sql(question), tables).limit(limit)


def schema(tables: Tables) -> DataFrame:
    """entity, property, type: what a question can be about; relationship types are properties of edges."""
    spark = tables.nodes.sparkSession
    rows = [(entity, f.name, f.dataType.simpleString()) for entity, df in (("nodes", tables.nodes), ("edges", tables.edges)) for f in df.schema]
    kinds = tables.edges.select(F.lit("relationship").alias("entity"), F.col("type").alias("property"), F.lit("edge").alias("type")).distinct()
    return spark.createDataFrame(rows, "entity string, property string, type string").unionByName(kinds)
