"""Web pages, tables in place of stores, recommendations."""

import pytest
from pyspark.sql import functions as F

from graphloom.operators import chunks, retrieve
from graphloom.plans import recommend
from graphloom.plugins import EchoGenerator
from graphloom.sources import files, store, web


def test_fetch(spark, tmp_path):
    (tmp_path / "a.html").write_text("<p>hi</p>")
    urls = spark.createDataFrame([(f"file://{tmp_path}/a.html",), (f"file://{tmp_path}/none.html",), ("not a url",), (None,)], "url string")
    got = [(r.ok, r.n_bytes) for r in web.fetch(urls).orderBy(F.desc("ok")).collect()]
    assert got[0] == (True, 9) and all(not ok for ok, _ in got[1:])


def test_body_text():
    html = "<html><nav>menu</nav><main><h1>Title</h1><p>One  two</p><div class='note'>aside <div>inner</div></div><script>x()</script>\n\n\n\n<p>Three</p></main><footer>end</footer></html>"
    text = web.body_text(html)
    assert "Title" in text and "One two" in text and "Three" in text
    assert not any(x in text for x in ("menu", "aside", "inner", "x()", "end", "\n\n\n", "  "))
    assert web.body_text("") == ""


def test_tree_leaves():
    state = '{"content": {"book": {"tree": {"contents": [{"slug": "p", "title": "Part", "contents": [{"slug": "a", "title": "<span>A</span>"}]}, {"slug": "b", "title": "B"}]}}}}'
    assert web.tree_leaves(state) == [{"title": "A", "slug": "a"}, {"title": "B", "slug": "b"}]
    assert web.tree_leaves("{") == []


@pytest.fixture
def chunked(spark):
    rows = [(f"{m}_{i}", m, i, f"text {i}") for m in "ab" for i in range(3)]
    return spark.createDataFrame(rows, "chunk_id string, module_id string, chunk_index int, text string")


def test_tables(spark, chunked):
    store.drop(spark, "gl_test")
    assert store.create(chunked, "gl_test_chunks") and not store.create(chunked, "gl_test_chunks")
    store.merge(spark, "gl_test_chunks", chunked.limit(1).withColumn("text", F.lit("new")), ["chunk_id"])
    t = spark.table("gl_test_chunks")
    assert t.count() == 6 and t.where("text = 'new'").count() == 1
    assert store.reindex(spark, "gl_test_chunks", "gl_test_copy", subject_id="s")
    assert not store.reindex(spark, "gl_test_chunks", "gl_test_copy", subject_id="s")
    store.clear(spark, "gl_test_copy", "s")
    assert spark.table("gl_test_copy").isEmpty()
    assert store.index(chunked.union(chunked), "gl_test_index", "chunk_id", [F.desc("text")]) == 6
    counts = store.migrate(chunked, spark.createDataFrame([("a_0", "x"), ("a_0", "x")], "chunk_id string, concept string"), "gl_test_m", dry_run=True)
    assert counts == {"chunks": 6, "next": 4, "first": 2, "mentions": 1} and "gl_test_m_next" not in store.names(spark)
    store.migrate(chunked, spark.createDataFrame([("a_0", "x")], "chunk_id string, concept string"), "gl_test_m")
    assert spark.table("gl_test_m_next").count() == 4
    assert "gl_test_chunks" not in store.drop(spark, "gl_test", keep=("gl_test_chunks",))
    store.drop(spark, "gl_test")
    assert store.names(spark, "gl_test") == []


def test_modes(spark):
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "id long, vector array<float>")
    docs = spark.createDataFrame([(1, "sun"), (2, "moon light")], "id long, text string")
    asked = spark.createDataFrame([(0, "moon")], "query_id int, text string")
    get = lambda **kw: [r.id for r in retrieve.retrieve(vectors, [1.0, 0.1], docs, asked, 2, **kw).orderBy("rank").collect()]
    assert get(mode="knn") == [1, 2] and get(backend="neo4j") == [1, 2]
    assert get() == [2, 1] and get(backend="hybrid") == [1, 2]


def test_deep_dive_and_assembly(spark):
    class Broken:
        def generate(self, prompt):
            raise TimeoutError

    assert recommend.deep_dive("x", EchoGenerator()) and recommend.deep_dive("x", Broken()) is None
    q = spark.createDataFrame([(1, 0)], "quiz_id int, place int")
    assert recommend.assemble(q, "t").first().question_id == "1-0"
    assert spark.range(1).select(recommend.optimistic(F.lit(0.3), F.lit(True)).alias("x")).first().x == pytest.approx(0.45)


def test_first_chunk_ids_are_numeric_order(spark):
    rows = [(f"m_{i}", "m", i, "") for i in (10, 2, 0)]
    c = spark.createDataFrame(rows, "chunk_id string, module_id string, chunk_index int, text string")
    linked = {r.chunk_id: r.next_chunk_id for r in chunks.link(c).collect()}
    assert linked == {"m_0": "m_2", "m_2": "m_10", "m_10": None}


def test_an_interrupted_change_is_finished(spark):
    rows = spark.createDataFrame([(1, "a", "s"), (2, "b", "t")], "id int, text string, subject_id string")
    name = "gl_test_change"
    for t in (name, f"{name}__staged"):
        spark.sql(f"DROP TABLE IF EXISTS {t}")
    store.create(rows, f"{name}__staged", partition="subject_id")  # a change that stopped before the table was whole
    store.create(rows.limit(0), name, partition="subject_id")
    try:
        new = spark.createDataFrame([(2, "B", "t"), (3, "c", "t")], "id int, text string, subject_id string")
        store.merge(spark, name, new, ["id"])
        assert sorted((r.id, r.text) for r in spark.table(name).collect()) == [(1, "a"), (2, "B"), (3, "c")]
        assert [c.name for c in spark.catalog.listColumns(name) if c.isPartition] == ["subject_id"]
        store.clear(spark, name, "t")
        assert [r.id for r in spark.table(name).collect()] == [1] and not store.exists(spark, f"{name}__staged")
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def test_cut_references_stand_for_themselves():
    html = "<title>a&amp;&amp;&amp b &lt;c&gt; &ampd; e&#x27;s &amp</title><p>one &amp; two &copy three, four and five</p>"
    page = files.parse_html(html)
    assert page["title"] == "a&&&amp b <c> &ampd; e's &amp"
    assert page["paragraphs"][0]["text"] == "one & two &copy three, four and five"
