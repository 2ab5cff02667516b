"""Every query against its SQL at the smallest scale; the others give rows."""

import pytest
from oracle import duck, sparks

from graphloom.queries import ORACLE, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_against_sql(spark, small, name):
    names, rows = sparks(QUERIES[name](spark, small))
    want_names, want = duck(small, ORACLE[name])
    assert names == want_names
    assert rows == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_gives_rows(spark, small, name):
    assert QUERIES[name](spark, small).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 20
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_last_part_beyond_a_million(spark, tmp_path):
    """The SQL's order is one number, to which a part of a million and more adds a line."""
    import duckdb

    c = duckdb.connect()
    rows = "(1, 1, 3000000), (1, 2, 5), (2, 1, 5), (2, 2, 4), (3, 7, 1999999), (3, 7, 1), (4, null, 8), (4, 1, 9), (5, null, 8)"
    c.execute(f"create table lineitem as select a::bigint as l_orderkey, b::integer as l_linenumber, p::bigint as l_partkey from (values {rows}) v(a, b, p)")
    c.execute(f"copy lineitem to '{tmp_path}/lineitem.parquet' (format parquet)")
    got = sorted(tuple(r) for r in QUERIES["chunk_upsert"](spark, str(tmp_path)).collect())
    assert got == sorted(c.execute(ORACLE["chunk_upsert"]).fetchall())


def test_first_of_parts_that_tie(spark, tmp_path):
    """A part beyond a million ties with another of the next line; DuckDB's one thread keeps the first in the files' order."""
    import duckdb

    c = duckdb.connect()
    c.execute("set threads = 1")
    (tmp_path / "lineitem.parquet").mkdir()
    for file, rows in (("b", 3000), ("a", 20)):  # by path the small one comes first, and its parts stand the other way
        high = f"(i + f) % 2 = {int(file == 'a')}"
        sql = f"select (i // 2 % 1000)::bigint as l_orderkey, case when {high} then 6 else 7 end::integer as l_linenumber, (i // 2 % 1000 + case when {high} then 1000000 else 0 end)::bigint as l_partkey from (select i, i // 6 % 2 as f from range({rows}) t(i))"
        c.execute(f"copy ({sql}) to '{tmp_path}/lineitem.parquet/{file}.parquet' (format parquet)")
    c.execute(f"create view lineitem as select * from '{tmp_path}/lineitem.parquet/*.parquet'")
    got = sorted(tuple(r) for r in QUERIES["chunk_upsert"](spark, str(tmp_path)).collect())
    assert got == sorted(c.execute(ORACLE["chunk_upsert"]).fetchall())
    assert {part >= 1000000 for _, part in got} == {True, False}
