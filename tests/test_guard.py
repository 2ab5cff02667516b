"""SQL of a model: what is run and what isn't."""

import pytest

from graphloom.plans import graph_qa, sql_guard


@pytest.fixture(scope="module")
def tables(spark):
    nodes = spark.createDataFrame([("a", 0.9, "m1"), ("b", 0.4, "m1"), ("c", None, "m2")], "name string, importance double, module_id string")
    edges = spark.createDataFrame([("a", "b", "PREREQ", 0.8, 1), ("b", "c", "RELATED", 0.5, 2)], "source string, target string, type string, weight double, edge_id long")
    return graph_qa.Tables(nodes, edges)


@pytest.mark.parametrize(
    "sql, rows",
    [
        ("select name from nodes where importance > 0.5", [("a",)]),
        ("SELECT n.name, e.type FROM nodes n JOIN edges e ON e.source = n.name ORDER BY n.name DESC LIMIT 1;", [("b", "RELATED")]),
        ("with top as (select name from nodes where importance is not null) select count(*) from top", [(2,)]),
        ("select name from nodes where name in (select target from edges) and not exists (select 1 from edges e where e.source = name) order by 1", [("c",)]),
        ("select case when weight between 0.6 and 1 then upper(type) else 'x' end as k, sum(weight) over (partition by type) as w from edges order by k", [("PREREQ", 0.8), ("x", 0.5)]),
        ("select (select max(importance) from nodes) as m, count(distinct type) from edges having count(*) > 1", [(0.9, 2)]),
        ("select name || '!' as n from nodes where name like 'a%' union select 'reflect' -- drop table", [("a!",), ("reflect",)]),
        ("select transform(array(weight, 1.0D), x -> x + 1)[0] as w from edges where cast(edge_id as string) = '1'", [(1.8,)]),
        ("select filter(collect_list(name), x -> x <> 'a') as names from nodes where module_id = 'm1'", [(["b"],)]),
    ],
)
def test_reading_is_run(spark, tables, sql, rows):
    assert sorted(tuple(r) for r in graph_qa.execute(spark, sql, tables).collect()) == rows


@pytest.mark.parametrize(
    "sql",
    [
        "select reflect('java.lang.System', 'getProperty', 'user.home')",
        "select java_method('java.lang.System', 'exit', 1) from nodes",
        "select try_reflect('java.lang.System', 'getProperty', 'user.home') from nodes",
        "select name from nodes where name = (select reflect('java.lang.System', 'getProperty', 'user.home'))",
        "with x as (select java_method('a', 'b') as y) select * from x",
        "select max(reflect('a', 'b')) over (order by name) from nodes",
        "select count(*) from parquet.`/root/testdata/sf0.001/part.parquet`",
        "select * from text.`/etc/passwd`",
        "select * from other",
        "select * from default.nodes",
        "select * from nodes join secrets on true",
        "with nodes as (select 1) select * from nodes",
        "with nodes2 as (select * from other) select * from nodes2",
        "select * from range(1000000000)",
        "select * from nodes, lateral (select * from other)",
        "select explode(sequence(1, 1000000000)) from nodes",
        "select input_file_name(), current_user() from nodes",
        "select transform(name) using 'cat' as (x) from nodes",
        "select * from nodes; drop table nodes",
        "drop table nodes",
        "insert into nodes values (1)",
        "create table t as select * from nodes",
        "create temporary view v as select * from nodes",
        "set spark.sql.ansi.enabled = false",
        "execute immediate 'select 1'",
        "/* select */ truncate table nodes",
        "explain select * from nodes",
        "show tables",
        "select",
        "",
        "from_json of nothing",
    ],
)
def test_anything_else_is_refused(spark, tables, sql):
    with pytest.raises(ValueError):
        graph_qa.execute(spark, sql, tables)


def test_views_of_the_session_stay(spark, tables):
    spark.range(3).createOrReplaceTempView("nodes")
    try:
        assert graph_qa.execute(spark, "select name from nodes", tables).count() == 3
        assert spark.table("nodes").columns == ["id"]
        assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("edges_")]
    finally:
        spark.catalog.dropTempView("nodes")


def test_lists_hold_nothing_that_calls_or_reads():
    for name in ("reflect", "java_method", "try_reflect", "input_file_name", "current_user", "version", "from_json", "explode", "read_files", "session_user", "uuid", "rand"):
        assert name not in sql_guard.FUNCTIONS
