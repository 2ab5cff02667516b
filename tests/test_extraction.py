"""Keywords, tags, strategies, fuzzy and vector search, answers, caches and questions about the graph."""

import json
import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from graphloom import plugins
from graphloom.functions.text import title_case
from graphloom.operators import concepts, contain, extract, fulltext, graph, retrieve, vectors as nearest
from graphloom.params import Question
from graphloom.plans import ask, cache, graph_qa, quiz, recommend
from graphloom.sources import files, services, store


def test_yake_by_hand():
    """One sentence, each word once: the statistics are known."""
    got = dict(plugins.yake("Solar panels convert light"))
    # every word: one neighbour a side at most, the first sentence, frequency 1 of mean 1 and deviation 0
    position = math.log(math.log(3))
    inner, outer = 1 + 2.0, 1 + 1.0  # words with two sides and with one
    weight = {w: r * position / (0 + 1 / r + 1 / r) for w, r in (("Solar", outer), ("panels", inner), ("convert", inner), ("light", outer))}
    for w, x in weight.items():
        assert got[w] == pytest.approx(x / (1 * (1 + x)))
    a, b = weight["Solar"], weight["panels"]
    assert got["Solar panels"] == pytest.approx(a * b / (1 + a + b)) and "Solar panels convert" in got
    assert plugins.yake("") == [] and plugins.yake("the of and") == []


def test_yake_phrases_and_copies():
    text = "Plate tectonics moves continents. Plate tectonics shapes mountains. The theory of plate tectonics explains earthquakes. Earthquake waves travel."
    found = [k.lower() for k, _ in plugins.yake(text, top=30, limit=0.85)]
    assert "plate tectonics" in found[:5] and not {"earthquake", "earthquakes"} <= set(found)
    assert not any(k.split()[0] in plugins.FUNCTION_WORDS or k.split()[-1] in plugins.FUNCTION_WORDS for k in found)


def test_tags():
    tags = plugins.CapitalTagger().tag("The battle of Gettysburg changed the civil war.")
    assert ("Gettysburg", "ENTITY") in tags and ("civil war", "CHUNK") in tags


def test_strategies(spark):
    known = spark.createDataFrame([("Civil War",), ("Gettysburg",), ("Battle",), ("Trade",)], "name string")
    texts = spark.createDataFrame([(1, "The battle of Gettysburg changed the civil war."), (2, "Nothing here"), (3, None)], "id long, text string")
    ner = {(r.id, r.name): r.score for r in extract.extract(texts, known, "ner").collect()}
    assert ner[1, "Gettysburg"] == 0.8 and ner[1, "Civil War"] == 0.6
    both = {(r.id, r.name): (r.score, r.strategies) for r in extract.extract(texts, known).collect()}
    assert both[1, "Gettysburg"][1] == 2 and both[1, "Gettysburg"][0] == pytest.approx(min(1.0, max(0.8, dict(extract.extract(texts, known, "yake").select(F.concat("id", F.lit("x")).alias("i"), "score").where("i = '1x'").collect() or [("", 0)]).get("1x", 0)) * 1.2), abs=0.3)
    assert {r.name for r in extract.extract(texts, known, "fulltext").collect()} >= {"Gettysburg"}
    vectors = spark.createDataFrame([("Trade", [1.0, 0.0]), ("Battle", [0.6, 0.8])], "name string, vector array<double>")
    asked = spark.createDataFrame([(1, [1.0, 0.0])], "id long, vector array<double>")
    assert [(r.name, r.score) for r in extract.extract(texts, known, "embedding", vectors=vectors, asked=asked).orderBy("rank").collect()] == [("Trade", 1.0), ("Battle", 0.6)]
    with pytest.raises(ValueError):
        extract.extract(texts, known, "other")
    asked = spark.createDataFrame([(1, "The battle of Gettysburg"), (2, "we trade")], "query_id long, text string")
    found = {(r.query_id, r.name) for r in extract.query_concepts(asked, known, "ner").collect()}
    assert (1, "Gettysburg") in found and (2, "Trade") in found
    assert extract.extract(texts.limit(0), known).count() == 0


def test_fuzzy_terms_against_all_pairs(spark):
    rng = random.Random(6)
    words = sorted({"".join(rng.choice("abcdé") for _ in range(rng.randrange(1, 10))) for _ in range(400)})
    asked = words[:60] + ["abcdefghij" * 8]
    known = words[30:] + ["abcdefghij" * 7 + "abxdefghi"]

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    limit = lambda w: 0 if len(w) < 3 else 1 if len(w) < 6 else 2
    want = {(a, b, distance(a, b)) for a in asked for b in known if abs(len(a) - len(b)) <= 2 and distance(a, b) <= limit(a)}
    q = spark.createDataFrame([(i, w) for i, w in enumerate(asked)], "query_id int, text string")
    got = fulltext.fuzzy_terms(spark.createDataFrame([(w,) for w in known], "token string"), q).collect()
    assert {(r.asked, r.token, r.edits) for r in got} == want and len(got) == len(want) > 50


@pytest.mark.parametrize("small", [4096, 30, 0])
def test_knn_many_by_either_side_and_in_blocks(spark, monkeypatch, small):
    """Queries broadcast, vectors broadcast (7 queries a vector set of 30), and blocks that all queries visit."""
    monkeypatch.setattr(nearest, "SMALL", small)
    monkeypatch.setattr(nearest, "BLOCK", 10)
    rng = random.Random(7)
    rows = [(i, [rng.gauss(0, 1) for _ in range(5)]) for i in range(25)] + [(60, None), (61, [0.0] * 5), (62, [1.0, None, 1.0, 1.0, 1.0])]
    rows += [(70, rows[3][1]), (71, rows[3][1])]  # ties
    vectors = spark.createDataFrame(rows, "id long, vector array<float>").repartition(3)
    asked = spark.createDataFrame([(f"q{i}", [rng.gauss(0, 1) for _ in range(5)]) for i in range(40)] + [("same", rows[3][1]), ("none", None)], "query_id string, vector array<float>")
    got = defaultdict(list)
    for r in retrieve.knn_many(vectors, asked, 4, "id", "vector").collect():
        got[r.query_id].append((r["rank"], r.id, r.score))
    for q in asked.collect():
        if q.vector:
            one = retrieve.knn(vectors.where("id not in (61, 62)"), list(q.vector), 4, "id", "vector").collect()
            assert sorted(got[q.query_id]) == [(r["rank"], r.id, pytest.approx(r.score, abs=2e-6)) for r in sorted(one, key=lambda r: r["rank"])]
    assert [i for _, i, _ in sorted(got["same"])[:3]] == [3, 70, 71] and "none" not in got
    assert retrieve.knn_many(vectors, asked.limit(0), 4, "id", "vector").count() == 0
    assert retrieve.knn_many(vectors.limit(0), asked, 4, "id", "vector").count() == 0
    least = retrieve.knn_many(vectors, asked.where("query_id = 'same'"), None, "id", "vector", least=0.999).collect()
    assert {r.id for r in least} == {3, 70, 71}


def test_names_inside_texts(spark):
    rng = random.Random(8)
    names = sorted({"".join(rng.choice("abÄ ") for _ in range(rng.randrange(1, 6))).strip() for _ in range(40)} - {""})
    texts = [(i, "".join(rng.choice("AbäB ") for _ in range(rng.randrange(0, 30)))) for i in range(50)] + [(99, None)]
    known = spark.createDataFrame([(n,) for n in names], "name string")
    got = {(r.id, r.name) for r in concepts.mentions(spark.createDataFrame(texts, "id int, text string"), known, "id").collect()}
    assert got == {(i, n) for i, t in texts for n in names if t and n.lower() in t.lower()}
    low = spark.createDataFrame([(n.lower(),) for n in names] + [("",), (None,)], "low string")
    rows = spark.createDataFrame(texts, "id int, text string").selectExpr("id", "lower(text) as text")
    parts = {(r.id, r.low) for r in contain.containing(rows, low, ["id"], shard=20).collect()}
    assert parts == {(i, n.lower()) for i, n in got} and contain.containing(rows, low.limit(0), ["id"]).count() == 0
    said = [t for _, t in texts if t]
    got = {r.text: r.name for r in concepts.known_match(spark.createDataFrame([(t,) for t in said], "text string"), known).collect()}
    want = {t: min((n for n in names if n.lower() in t.lower() or t.lower() in n.lower()), key=lambda n: (n.lower() != t.lower(), n), default=None) for t in said}
    assert got == {t: n for t, n in want.items() if n}


def test_title_case(spark):
    words = ["post-war boom", "o'neill's", "2nd law", "ÉTÉ", "", "a  b"]
    got = [r[0] for r in spark.createDataFrame([(w,) for w in words], "w string").select(title_case(F.col("w"))).collect()]
    assert got == [w.title() for w in words]


@pytest.fixture
def shelf(spark):
    rows = [("a0", "a", 0, "the sun is a star"), ("a1", "a", 1, "it shines on the moon"), ("a2", "a", 2, "planets go around"), ("b0", "b", 0, "bread needs flour"), ("b1", "b", 1, "and water")]
    return spark.createDataFrame(rows, "chunk_id string, module_id string, chunk_index int, text string")


def test_answers_use_the_whole_path(spark, shelf):
    names = spark.createDataFrame([("sun",), ("flour",)], "name string")
    edges = spark.createDataFrame([("flour", "water")], "source string, target string")
    asked = spark.createDataFrame([(1, "what is the sun"), (2, "bread needs flour")], "query_id int, text string")

    class Loud:
        def generate(self, prompt):
            return prompt.upper()

    plain = ask.answers(asked, shelf, names, Question("any", use_window_retrieval=False, top_k=1), generator=Loud(), attribution="me").collect()
    assert {(r.query_id, r.id) for r in plain} == {(1, "a0"), (2, "b0")}
    # asked about one subject, the other's chunks aren't there
    of = shelf.withColumn("subject_id", F.col("module_id"))
    own = ask.answers(asked, of, names, Question("any", subject="b", use_window_retrieval=False, top_k=5), generator=Loud(), attribution="me").collect()
    assert {r.id for r in own} == {"b0", "b1"}
    one = next(r for r in plain if r.query_id == 1)
    assert one.preview == "the sun is a star" and "[1] THE SUN IS A STAR" in one.reply and "ME" in one.reply and "WHAT IS THE SUN" in one.reply
    wide = ask.answers(asked, shelf, names, Question("any", window_size=1, top_k=1, use_kg_expansion=False)).collect()
    assert {(r.query_id, r.id) for r in wide} == {(1, "a0,a1"), (2, "b0,b1")}
    again = ask.answers(asked, shelf, names, Question("any", window_size=1, top_k=1), edges, rerank=True).collect()
    assert {(r.query_id, r.id[:2], r["rank"]) for r in again} == {(1, "a0", 1), (2, "b0", 1)}
    misspelt = spark.createDataFrame([(0, "flourr")], "query_id int, text string")
    assert [r.id for r in retrieve.bm25(shelf, misspelt, "chunk_id", "text", fuzzy=True).collect()] == ["b0"]
    assert retrieve.bm25(shelf, misspelt, "chunk_id", "text").count() == 0
    assert ask.answer(Question("bread needs flour", use_window_retrieval=False, top_k=1), shelf, names).first().id == "b0"

    class Broken:
        def generate(self, prompt):
            raise ConnectionError

    assert {r.reply for r in ask.answers(asked, shelf, names, Question("any"), generator=plugins.Retrying(Broken(), attempts=1)).collect()} == {None}


def test_retries_fall_back():
    waits, calls = [], []

    class Flaky:
        def __init__(self, fails):
            self.fails = fails

        def generate(self, prompt):
            calls.append(prompt)
            self.fails -= 1
            if self.fails >= 0:
                raise ConnectionError
            return "fine reply"

    assert plugins.Retrying(Flaky(2), sleep=waits.append).generate("x") == "fine reply" and waits == [1.0, 2.0]
    assert plugins.Retrying(Flaky(9), plugins.EchoGenerator(), sleep=waits.append).generate("a\nb") == "b"
    with pytest.raises(ConnectionError):
        plugins.Retrying(Flaky(9), sleep=waits.append).generate("x")
    assert list(plugins.Retrying(Flaky(0)).stream("x")) == ["fine", " reply"]


def test_events_of_a_stream(spark):
    hits = spark.createDataFrame([("b", 2), ("a", 1)], "id string, rank int")
    assert list(ask.stream_events(hits, ["x", " y"])) == [("metadata", "a,b"), ("token", "x"), ("token", " y"), ("done", "[DONE]")]

    def broken():
        yield "x"
        raise ConnectionError("gone")

    assert list(ask.stream_events(hits, broken()))[-2:] == [("token", "x"), ("error", "gone")]


def test_cache(spark):
    now, made = [0.0], []
    held = cache.Cache(ttl=10, clock=lambda: now[0])

    def make():
        made.append(1)
        return spark.range(3)

    name = cache.key(None, 100)
    assert name == "data:default:100" and held.get(name, make).count() == 3 and held.get(name, make).count() == 3 and len(made) == 1
    now[0] = 11
    held.get(name, make)
    assert len(made) == 2
    marks = [cache.fingerprint(spark.createDataFrame([(x,) for x in own], "name string"), "name") for own in ("ab", "ba", "abc")]
    assert marks[0] == marks[1] != marks[2]
    held.get(name, make, marks[0])
    held.get(name, make, marks[1])
    held.get(name, make, marks[2])
    assert len(made) == 4
    held.drop()


def test_questions_about_the_graph(spark):
    nodes = spark.createDataFrame([("A", 0.9, "m1"), ("B", 0.4, "m1"), ("C", 0.6, "m2")], "name string, importance double, module_id string")
    edges = graph.with_ids(spark.createDataFrame([("A", "B", "PREREQ", 1.0), ("B", "C", "PREREQ", 1.0), ("A", "C", "RELATED", 0.5)], "source string, target string, type string, weight double"))
    t = graph_qa.Tables(nodes, edges)
    rows = lambda q, **kw: sorted(tuple(r)[0] for r in graph_qa.ask(spark, q, t, **kw).collect())
    assert rows("What are the prerequisites of b?") == ["A"] and rows("What is related to A") == ["C"]
    assert rows("Show the path from A to C") == ["A > B > C"] and rows("concepts in module m1") == ["A", "B"]
    assert rows("Which modules cover c?") == ["m2"] and rows("most important concepts") == ["A", "C"]
    assert rows("how many?", to_sql=lambda q: "select count(*) from nodes") == [3]
    for bad in ("delete everything", "how many?"):
        with pytest.raises(ValueError):
            rows(bad)
    with pytest.raises(ValueError):
        graph_qa.execute(spark, "drop table nodes", t)
    assert {r.property for r in graph_qa.schema(t).where("entity = 'relationship'").collect()} == {"PREREQ", "RELATED"}
    deep = graph.prerequisites_first(graph.chain(edges, nodes, nodes.where("name = 'C'").select("name"), 3))
    assert [r.name for r in deep.collect()] == ["A", "B"]


def test_recommendations_with_readings(spark, shelf):
    results = spark.createDataFrame([(1, 7, "flour", False, 1), (1, 7, "sun", True, 2)], "quiz int, student int, concept string, correct boolean, place int")
    edges = graph.with_ids(spark.createDataFrame([("bread", "flour", "PREREQ", 1.0), ("sun", "star", "PREREQ", 1.0)], "source string, target string, type string, weight double"))
    nodes = spark.createDataFrame([(n, 0.5) for n in ("bread", "flour", "sun", "star")], "name string, importance double")
    state = spark.createDataFrame([(7, "bread", 0.82)], "student int, concept string, mastery_level double")
    docs = shelf.select(F.col("chunk_id").alias("id"), "text")
    got = {r.side: r for r in recommend.recommend(results, edges, nodes, state, docs, plugins.EchoGenerator()).collect()}
    assert (got["weak"].name, got["weak"].mastery_level, got["weak"].readings) == ("bread", 0.82, ["b0"])
    assert (got["strong"].name, got["strong"].mastery_level, got["strong"].deep_dive) == ("star", 0.3, "Write a deep dive on sun.")
    vectors = plugins.embed(docs, "text").select("id", F.col("embedding").alias("vector"))
    levels = spark.createDataFrame([(7, "sun", 0.9), (7, "flour", 0.1)], "student int, concept string, mastery_level double")
    found = {r.concept: r for r in quiz.prompts(levels, quiz.contexts(levels, docs, vectors)).collect()}
    for r in found.values():  # the level's instructions, and a form of reply that is JSON with the fields that are read
        assert quiz.LEVELS[r.difficulty] in r.prompt and r.prompt.count(f"between {r.score_range}") == 1
        form = json.loads(r.prompt[r.prompt.index('{"questions"') : r.prompt.rindex("}") + 1])["questions"][0]
        assert len(form["options"]) == 4 and set(form) == {"text", "options", "correct_option_id", "explanation", "difficulty", "difficulty_score"} and form["difficulty"] == r.difficulty
    assert "the sun is a star" in found["sun"].prompt and found["sun"].difficulty == "hard" and "bread needs flour" in found["flour"].prompt and "EASY" in found["flour"].prompt


def test_services_and_subjects(spark, tmp_path):
    ticks = iter(range(100))
    got = {r.service: r for r in services.probe(spark, {"a": lambda: services.colour_status("green"), "b": lambda: 1 // 0}, lambda: next(ticks)).collect()}
    assert (got["a"].status, got["a"].latency_ms) == ("ok", 1000.0) and got["b"].status == "error" and "zero" in got["b"].detail
    assert services.model_status(["llama3:8b"], "mistral") == "degraded"
    (tmp_path / "s.yaml").write_text("default_subject: a\nsubjects:\n  a: {name: A, theme: {primary: red}, books: [{title: T}, {title: U}]}\n  b: {name: B}\n")
    subjects = files.read_subjects(spark, str(tmp_path / "s.yaml"))
    assert [r.subject_id for r in files.subject_ids(subjects).collect()] == ["a", "b"]
    assert [tuple(r) for r in files.theme(subjects).collect()] == [("primary", "red")]
    assert [r.title for r in files.books(subjects, "a").collect()] == ["T", "U"]


def test_saved_profiles_and_tables(spark, tmp_path):
    state = spark.createDataFrame([("s", "c", 0.4, 3, 2, "2024-01-02 03:04:05")], "student string, concept string, mastery_level double, attempts long, correct_attempts long, t string").withColumn("last_assessed", F.to_timestamp("t"))
    files.write_profiles(state, str(tmp_path / "p"))
    got = files.read_saved_profiles(spark, str(tmp_path / "p")).first()
    assert (got.student_id, got.concept, got.mastery_level, got.attempts, str(got.last_assessed)) == ("s", "c", 0.4, 3, "2024-01-02 03:04:05")
    rows = spark.createDataFrame([(None, "x"), (None, "y"), ("k", "z")], "chunk_id string, text string")
    store.drop(spark, "gl_ids")
    ids = []
    for _ in range(2):
        assert store.index(rows.repartition(3), "gl_ids", "chunk_id", [F.col("text")]) == 3
        ids.append({r.chunk_id for r in spark.table("gl_ids").collect()})
    assert ids[0] == ids[1] and store.create_for_subject(rows, "s1", "hist", "Chunk", True) == "hist_chunk"
    assert spark.table("hist_chunk").where("subject_id = 's1'").count() == 3
    store.drop(spark, "gl_ids")
    store.drop(spark, "hist_chunk")
    records = spark.createDataFrame([("b", "m", "t2"), ("a", "m", "t1"), ("c", "n", "t3")], "id string, module_id string, text string")
    row = files.summary(records).first()
    assert (row.total_records, row.total_modules, row.modules) == (3, 2, {"m": 2, "n": 1}) and '"id":"a"' in row.first_record
    assert files.first_records(records, 0, []).count() == 3 and [r.id for r in files.first_records(records, 2, [F.col("id")]).collect()] == ["a", "b"]
    groups = {r.module_id: r.texts for r in concepts.module_groups(records.withColumns({"module_title": F.lit("t"), "section": F.lit("s")})).collect()}
    assert groups == {"m": ["t1", "t2"], "n": ["t3"]}
