"""Queries of the operators over whole tables, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: ASCII lower-casing and tokens, the same in both engines.
SQL_LOW = "translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SQL_TOKENS = "regexp_extract_all(" + SQL_LOW + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def low(c: str) -> str:
    return SQL_LOW.format(c)


def toks(c: str) -> str:
    return SQL_TOKENS.format(c)


from . import app, chunks, graphs, learners, retrieval, text  # noqa: E402, F401
