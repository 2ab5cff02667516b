"""Operators against plain models on small random inputs, and sources and sinks."""

import random

import pytest
from pyspark.sql import functions as F

from graphloom.operators import chunks, concepts, graph, retrieve
from graphloom.params import Question, Settings
from graphloom.plans import ask
from graphloom.sources import files


def test_rrf_exact(spark):
    a = spark.createDataFrame([("x", 1), ("y", 2)], "id string, rank int")
    b = spark.createDataFrame([("x", 1), ("z", 2)], "id string, rank int")
    got = {r.id: r.rrf_score for r in retrieve.rrf([a, b]).collect()}
    assert got["x"] == pytest.approx(2 / 61) and got["y"] == pytest.approx(1 / 62)
    assert [r.id for r in retrieve.rrf([a, b], top_k=2).orderBy("rank").collect()] == ["x", "y"]


def test_drop_substrings(spark):
    rng = random.Random(1)
    names = sorted({"".join(rng.choice("abAB ") for _ in range(rng.randrange(1, 7))).strip() for _ in range(60)} - {""})
    want = {a for a in names if not any(a.lower() in b.lower() and a.lower() != b.lower() for b in names)}
    assert {r.name for r in concepts.drop_substrings(spark.createDataFrame([(n,) for n in names], "name string")).collect()} == want


def test_query_concepts_longest_first(spark):
    names = spark.createDataFrame([(n,) for n in ("Sun", "Sunlight", "Cell", "Water", "Leaf", "Root", "Stem")], "name string")
    asked = spark.createDataFrame([(1, "sunlight and water reach leaf, root, stem and cell")], "query_id int, text string")
    got = [r.name for r in concepts.query_concepts(asked, names).orderBy("place").collect()]
    assert got == ["Sunlight", "Water", "Cell", "Leaf", "Root"]


def test_trails(spark):
    rng = random.Random(2)
    edges = sorted({(rng.choice("abcde"), rng.choice("abcde")) for _ in range(9)})
    df = graph.with_ids(spark.createDataFrame([(s, t, "PREREQ", 1.0) for s, t in edges], "source string, target string, type string, weight double"))
    nodes = spark.createDataFrame([(n, 0.5) for n in "abcde"], "name string, importance double")
    want = set()

    def walk(start, node, used, depth):
        for e in edges:
            if e[1] == node and e not in used and depth < 3:
                want.add((start, e[0], depth + 1))
                walk(start, e[0], used | {e}, depth + 1)

    for n in "abcde":
        walk(n, n, frozenset(), 0)
    got = {(r.start, r.name, r.depth) for r in graph.chain(df, nodes, nodes.select("name"), 3).collect()}
    assert got == want


def test_pagerank_against_plain(spark):
    edges = [("a", "b", 1.0), ("b", "c", 2.0), ("c", "a", 0.5)]
    nodes = ["a", "b", "c", "d"]
    weight = {}
    for s, t, w in edges:
        weight[s, t] = weight[t, s] = w
    rank = dict.fromkeys(nodes, 0.25)
    out = {n: sum(w for (s, _), w in weight.items() if s == n) for n in nodes}
    for _ in range(7):
        lost = sum(rank[n] for n in nodes if not out[n])
        rank = {n: 0.15 / 4 + 0.85 * (sum(rank[s] * w / out[s] for (s, t), w in weight.items() if t == n) + lost / 4) for n in nodes}
    df = spark.createDataFrame([(s, t, "RELATED", w) for s, t, w in edges], "source string, target string, type string, weight double")
    got = {r.name: r.rank for r in graph.pagerank(spark.createDataFrame([(n,) for n in nodes], "name string"), df, 7, tolerance=0.0).collect()}
    assert got == pytest.approx(rank)
    for _ in range(100):
        lost = sum(rank[n] for n in nodes if not out[n])
        rank = {n: 0.15 / 4 + 0.85 * (sum(rank[s] * w / out[s] for (s, t), w in weight.items() if t == n) + lost / 4) for n in nodes}
    got = {r.name: r.rank for r in graph.pagerank(spark.createDataFrame([(n,) for n in nodes], "name string"), df).collect()}
    assert got == pytest.approx(rank, abs=1e-4)  # until the ranks stay


def test_window(spark):
    rows = [(f"{m}{i}", m, i, f"t{m}{i}") for m in "pq" for i in range(6)]
    c = spark.createDataFrame(rows, "chunk_id string, module_id string, chunk_index int, text string")
    hits = spark.createDataFrame([("p1", 1, 0.9), ("p2", 2, 0.8), ("q0", 3, 0.7)], "chunk_id string, hit_rank int, score double")
    got = {r.chunk_id: (r.hit_rank, r.is_original_hit) for r in retrieve.window(c, hits, 1).collect()}
    assert got == {"p0": (1, False), "p1": (1, True), "p2": (1, False), "p3": (2, False), "q0": (3, True), "q1": (3, False)}
    assert {r.chunk_id for r in retrieve.window(c, hits, 0).collect()} == {"p1", "p2", "q0"}
    merged = {r.module_id: (r.text, r.hit_count) for r in retrieve.merge_windows(retrieve.window(c, hits, 1)).collect()}
    assert merged["q"] == ("tq0\n\ntq1", 1)


def test_chunks_cover_the_text():
    text = "A sentence here. Another one! And? " * 60
    offsets = chunks.chunk_offsets(text, 100, 20)
    assert offsets[0][0] == 0 and offsets[-1][1] >= len(text)
    assert all(b <= e0 for (_, e0), (b, _) in zip(offsets, offsets[1:]))
    assert all(text[e - 2 : e] in (". ", "! ", "? ") for _, e in offsets[:-1])
    assert chunks.chunk_offsets("", 10, 2) == [] and chunks.chunk_offsets("abc", 10, 2) == [(0, 10)]


def test_chunk_ids_and_links(spark):
    records = spark.createDataFrame([("m", "x " * 300), ("n", ""), ("o", None)], "module_id string, text string")
    rows = chunks.link(chunks.chunk_chars(records, 100, 10)).orderBy("chunk_index").collect()
    assert rows[0].chunk_id == "m_0" and rows[0].previous_chunk_id is None and rows[0].next_chunk_id == "m_1" and {r.module_id for r in rows} == {"m"}


def test_edges(spark):
    e = spark.createDataFrame([("b", "a", "RELATED", 0.2, 0.7, 1), ("a", "b", "RELATED", 0.9, 0.1, 2), ("a", "x", "PREREQ", 1.0, 1.0, 3), ("a", "b", "NEXT", 1.0, 1.0, 4)], "source string, target string, type string, weight double, confidence double, seq int")
    n = spark.createDataFrame([("a",), ("b",)], "name string")
    assert [(r.source, r.target) for r in graph.upsert_edges(e, n).collect()] == [("a", "b")]
    merged = graph.merge_edges(graph.canonical(e)).where("type = 'RELATED'").first()
    assert (merged.weight, merged.confidence) == (0.9, 0.7)


def test_html_page():
    html = "<title> </title><h1>Head</h1><div class='learning-objectives'><li>know it</li></div><p>This paragraph is long enough.<p>short</p><h2>Part</h2><p>Another paragraph that <b>is long</b> enough</p><dl><dt>Term</dt></dl><script>var t='</p>'</script><strong>one two three four five</strong>"
    page = files.parse_html(html)
    assert page["title"] == "Head" and page["objectives"] == ["know it"] and page["key_terms"] == ["Term", "is long"]
    assert page["paragraphs"] == [{"section": "Introduction", "text": "This paragraph is long enough."}, {"section": "Part", "text": "Another paragraph that is long enough"}]
    assert files.parse_html("")["title"] == "Untitled"


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "r.jsonl").write_text('{"id": "1", "text": "a"}\n\n{"id": "2", "text": "b"}\n')
    records = files.read_jsonl(spark, str(tmp_path / "r.jsonl"), "id string, text string")
    assert records.count() == 2
    files.write_jsonl(records.withColumn("chunks", F.lit(1)), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).columns == ["id", "text"]
    (tmp_path / "p.json").write_text('{"s1": {"student_id": "s1", "mastery_map": {"old": 0.7, "new": {"mastery_level": 0.4, "attempts": 3, "correct_attempts": 2, "last_assessed": "2024-01-02T03:04:05"}}}}')
    got = {r.concept: (r.mastery_level, r.attempts) for r in files.read_profiles(spark, str(tmp_path / "p.json")).collect()}
    assert got == {"old": (0.7, 0), "new": (0.4, 3)}
    (tmp_path / "broken.json").write_text("{")
    assert files.read_profiles(spark, str(tmp_path / "broken.json")).count() == 0
    (tmp_path / "s.yaml").write_text("default_subject: a\nsubjects:\n  a: {name: A, books: [{title: T}]}\n  b: {name: B}\n")
    subjects = files.read_subjects(spark, str(tmp_path / "s.yaml"))
    assert files.subject(subjects).first().name == "A"
    with pytest.raises(KeyError):
        files.subject(subjects, "zz")
    files.write_partitioned(subjects, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).where("subject_id = 'b'").count() == 1


def test_stream_lines(spark):
    lines = spark.createDataFrame([('data: {"token": "a"}',), ("data: [DONE]",), ("broken",), ('{"response": "b"}',)], "value string")
    assert [r.content for r in ask.parse_stream(lines).collect()] == ["a", "b"]


def test_bounds():
    with pytest.raises(ValueError):
        Question("x")
    with pytest.raises(ValueError):
        Question("valid", top_k=21)
    with pytest.raises(ValueError):
        Settings(retrieval_mode="none")
    assert Question("valid", window_size=0).window_size == 0


def test_guards(spark):
    from graphloom.functions import text as X

    rows = [("MATCH (n) RETURN n", True), ("match (n) set n.x = 1", False), ("RETURN 'delete SET'", True), ("CALL { x }", False), ("RETURN offset", True)]
    df = spark.createDataFrame(rows, "q string, ok boolean")
    assert all(r.got == r.ok for r in df.withColumn("got", X.read_only(F.col("q"))).collect())


def test_long_lists_of_concepts_are_used_whole(spark):
    from graphloom.plans import build_kg

    names = spark.range(10_050).select(F.format_string("c%06d", "id").alias("name"))
    last = [f"c{i:06d}" for i in range(10_000, 10_050)]
    texts = spark.createDataFrame([(n,) for n in last], "text string")
    assert {(r.text, r.name) for r in concepts.known_match(texts, names).collect()} == {(n, n) for n in last}
    said = spark.createDataFrame([("1", f"{last[0]} builds on {last[-1]}.")], "id string, text string")
    assert [(r.source, r.target) for r in build_kg.prerequisites(said, names).collect()] == [(last[0], last[-1])]
    few = spark.createDataFrame([(w,) for w in "Ab cd ef gh ij kl mn op qr".split()], "name string")
    rows = spark.createDataFrame([(1, "ab ef qr"), (2, "kl"), (3, "none"), (4, None)], "id int, text string")
    assert sorted(map(tuple, concepts.mentions(rows, few, "id").collect())) == [(1, "Ab"), (1, "ef"), (1, "qr"), (2, "kl")]
    assert concepts.mentions(rows, few.where("false"), "id").count() == 0


def test_every_label_has_its_neighbours(spark, tmp_path):
    from graphloom.queries import retrieval

    angle = F.col("id") * 0.001
    spark.range(1100).select(F.col("id").alias("vec_id"), F.format_string("l%d", "id").alias("label"), F.array(F.cos(angle), F.sin(angle)).cast("array<float>").alias("embedding")).write.parquet(f"{tmp_path}/embeddings.parquet")
    assert retrieval.vector_neighbors(spark, str(tmp_path)).select("query_id").distinct().count() == 1100
    found = retrieval.concept_embedding_match(spark, str(tmp_path))
    assert found.select("name").distinct().count() == 1100 and found.where("id = 0").count() == 1048  # angles up to 60 degrees
