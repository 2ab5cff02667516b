"""Use cases across operators, service rollups, rates, streaming twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import learner as L
from ..functions import text as X
from ..operators import chunks as C
from ..operators import graph as G
from ..operators import learner as O
from ..operators import retrieve as R
from ..operators.tables import passing, reliable
from ..params import Question
from ..plans import ask as A
from ..plans import build_kg as B
from ..plans import quiz as Z
from ..plans import recommend as P
from ..plugins import embed
from ..sources import web as W
from ..streaming import learners as T
from . import graphs, learners, query, read, retrieval, text


@query("select time_bucket(interval 1 minute, ts) as window_start, event_type as key, count(*) as n from events group by all")
def rate_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.events_rate(read(spark, sf_dir, "events"), "ts", "event_type")


@query("select time_bucket(interval 1 hour, ts) as window_start, event_type as key, count(*) as n from events group by all having count(*) > 3")
def over_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.over_limit(O.events_rate(read(spark, sf_dir, "events"), "ts", "event_type", "1 hour"), 3)


@query("select w + k * interval 5 minute as window_start, event_type, count(*) as n, round(sum(value), 4) as total from (select *, time_bucket(interval 5 minute, ts) as w from events), (select unnest([0, -1]) as k) group by all")
def sliding_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = F.window("ts", "10 minutes", "5 minutes").alias("w")
    return read(spark, sf_dir, "events").groupBy(w, "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


@query("with s as (select *, case when ts - lag(ts) over (partition by user_id order by ts, event_id) < interval 2 hour then 0 else 1 end as fresh from events), t as (select *, sum(fresh) over (partition by user_id order by ts, event_id) as session from s) select user_id, min(ts) as session_start, count(*) as n from t group by user_id, session")
def session_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = F.session_window("ts", "2 hours").alias("w")
    return read(spark, sf_dir, "events").groupBy("user_id", w).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("session_start"), "n")


@query("select c_custkey, case when c_custkey % 3 = 0 then '10.0.0.' || (c_custkey % 256) else c_name end as client from customer")
def client_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    forwarded = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit(" 10.0.0."), (F.col("c_custkey") % 256).cast("string"), F.lit(" , 192.168.0.1")))
    return read(spark, sf_dir, "customer").select("c_custkey", X.client_key(forwarded, F.col("c_name")).alias("client"))


@query("with s as (select s_suppkey // 3 as check_id, case when s_suppkey % 3 = 2 then 'ollama' when s_suppkey % 3 = 1 then 'opensearch' else 'neo4j' end as service, case when s_acctbal < 0 then 'error' when s_acctbal < 4000 then 'degraded' else 'ok' end as status from supplier) select check_id, case when bool_and(status = 'ok') then 'healthy' when bool_or(status = 'error' and service <> 'ollama') then 'unhealthy' else 'degraded' end as status from s group by check_id")
def health_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    service = F.element_at(F.array(F.lit("neo4j"), F.lit("opensearch"), F.lit("ollama")), (F.col("s_suppkey") % 3 + 1).cast("int"))
    status = F.when(F.col("s_acctbal") < 0, "error").when(F.col("s_acctbal") < 4000, "degraded").otherwise("ok")
    rows = read(spark, sf_dir, "supplier").select(F.floor(F.col("s_suppkey") / 3).alias("check_id"), service.alias("service"), status.alias("status"))
    return A.health(rows, "check_id")


@query(
    """select s.*, count(d.doc_id) as n_docs from (select 'us_history' as subject_id, 'US History' as name, 'us_history' as label_prefix, 'textbook_chunks_us_history' as index_name, true as is_default) s
left join (select doc_id, coalesce(case when doc_id % 2 = 0 then source end, 'us_history') as subject_id from documents) d on d.subject_id = s.subject_id group by all"""
)
def subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The configured subjects, each with the number of documents that are its own (those without a subject go to it)."""
    docs = G.relabel(read(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.col("source")).alias("subject_id")), "us_history")
    n = docs.groupBy("subject_id").agg(F.count("doc_id").alias("n_docs"))
    return A.subjects(spark).join(n, "subject_id", "left").withColumn("n_docs", F.coalesce("n_docs", F.lit(0)))


_NEXT = "ranked as (select name, row_number() over (order by n desc, length(name) desc, name) as k from c), e as (select a.name as s, b.name as t from ranked a join ranked b on b.k = a.k + 1), sides as (select s, t from e union all select t, s from e)"


def _word_edges(words: DataFrame) -> DataFrame:
    """Edges from each frequent word (name, n) to the next one."""
    order = Window.orderBy(F.desc("n"), F.desc(F.length("name")), "name")  # of fifty words
    return words.select(F.col("name").alias("source"), F.lead("name").over(order).alias("target")).where("target is not null")


@query(
    f"""with c as ({text._TOP}), {_NEXT}, own as (select b.item_id as query_id, c.name, length(c.name) as size from benchmark b join c on contains(lower(b.text), lower(c.name))),
five as (select * from (select *, row_number() over (partition by query_id order by size desc, name) as place from own) where place <= 5),
u as (select query_id, name, min(place) as place from (select query_id, name, place from five union all select f.query_id, s.t, 1048576 from five f join sides s on s.s = f.name) group by all)
select query_id, count(*) as n_concepts, count(*) filter (where place = 1048576) as expansion_count, any_value(b.text) || ' ' || string_agg(name, ' ' order by place, name) as expanded_query from u join benchmark b on b.item_id = u.query_id group by query_id"""
)
def query_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items with the words that they contain and those next to them in the graph."""
    asked = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    words = text.top_words(spark, sf_dir)
    return A.expand(asked, words, _word_edges(words)).select("query_id", "n_concepts", "expansion_count", "expanded_query")


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("module_id"), "text")
    return C.chunk_chars(records).select("chunk_id", "module_id", "chunk_index", "text")


@query()
def ask_question(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item as a question to all documents' chunks: expansion, hybrid retrieval, windows, reranking,
    prompt and reply."""
    asked = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    words = text.top_words(spark, sf_dir)
    return A.answers(asked, reliable(_chunks(spark, sf_dir)), words, Question("any question"), _word_edges(words), rerank=True, attribution="the corpus")


@query()
def built_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records to concepts, edges and importance: the graph's statistics."""
    return B.statistics(B.build(read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), F.col("source").alias("module_id"), "text")))


@query()
def prerequisite_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that end in a prerequisite's phrase on their second word: the mined edges."""
    names = text.top_words(spark, sf_dir)
    sentences = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.concat("text", F.lit(" This builds on "), F.get(F.split("text", " "), F.lit(1)), F.lit(".")).alias("text"))
    return B.prerequisites(sentences, names)


@query()
def adaptive_quiz_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts at each learner's level, with the best document on the concept as their text."""
    from .learners import state

    rows = state(spark, sf_dir)
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    vectors = embed(docs, "text").select("id", F.col("embedding").alias("vector"))
    return Z.prompts(rows, Z.contexts(rows.select("concept").distinct(), docs, vectors))


@query("select sum(case when e.k % 4 = e.k % 3 then 1 else 0 end)::bigint as n_correct, count(*) as n from (select json_extract_string(props, '$.k')::integer as k from events) e")
def answer_correctness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Selected against correct options."""
    k = F.get_json_object("props", "$.k").cast("int")
    right = L.is_correct((k % 4).cast("string"), (k % 3).cast("string"))
    return read(spark, sf_dir, "events").agg(F.count_if(right).alias("n_correct"), F.count(F.lit(1)).alias("n"))


@query(f"with recursive {learners._STATE} select student, concept, round(mastery_level, 6) as mastery_level, attempts, correct_attempts from state")
def stream_mastery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stateful stream over the events table, run to its end."""
    return T.run_to_end(spark, sf_dir).select("student", "concept", F.round("mastery_level", 6).alias("mastery_level"), "attempts", "correct_attempts")


@query("select * from (select time_bucket(interval 1 minute, ts) as window_start, event_type as key, count(*) as n from events group by 1, 2) where window_start + interval 1 minute <= (select max(ts) from events) - interval 10 minute")
def stream_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The windows that are final ten minutes before the last event."""
    return T.rates_to_end(spark, sf_dir)


@query("select doc_id::varchar as id, text, source as module_id, '' as module_title, lang as section, '' as attribution, 0 as n_terms, n_chars::double as score, 'knn' as retrieval_mode from documents")
def standard_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", F.col("source").alias("module_id"), F.col("lang").alias("section"), F.col("n_chars").alias("score"))
    return R.standard_hits(hits, "knn").withColumn("n_terms", F.size("key_terms")).drop("key_terms")


@query("select item_id, array_to_string(list_filter(regexp_split_to_array(text, '[ \\t\\n\\x0b\\f\\r]+'), lambda w: length(w) > 3), ' ') as terms from benchmark")
def search_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "benchmark").select("item_id", F.array_join(R.search_terms(F.col("text")), " ").alias("terms"))


@query(retrieval._rrf_sql([retrieval._knn_sql(0, 20), retrieval._hybrid_sql().replace("select id, rrf_score, row_number", "select id, row_number")], 20).replace("select id, rrf_score, row_number", "select id, rrf_score as score, row_number"))
def cross_backend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vector list fused with the hybrid list."""
    vectors = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    asked = read(spark, sf_dir, "benchmark").where("item_id = 0").select(F.col("item_id").alias("query_id"), "text")
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return R.retrieve(vectors, R.vector_of(vectors, 0, "id", "vector"), docs, asked, backend="hybrid")


_CROSS = retrieval._rrf_sql([retrieval._knn_sql(0, 20), retrieval._hybrid_sql().replace("select id, rrf_score, row_number", "select id, row_number")], 20)


@query(
    f"""with k as ({_CROSS}), c as (select doc_id as chunk_id, doc_id // 10 as module_id, doc_id % 10 as chunk_index from documents),
e as (select c.chunk_id, k.rank as hit_rank, k.id = c.chunk_id as hit from k join c h on h.chunk_id = k.id join c on c.module_id = h.module_id and c.chunk_index between h.chunk_index - 1 and h.chunk_index + 1)
select chunk_id, hit_rank, hit as is_original_hit from (select *, row_number() over (partition by chunk_id order by hit_rank) as n from e) where n = 1"""
)
def cross_backend_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fused list with the chunks around its hits; ten documents in a row are a module."""
    vectors = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    asked = read(spark, sf_dir, "benchmark").where("item_id = 0").select(F.col("item_id").alias("query_id"), "text")
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    chunks = docs.select(F.col("id").alias("chunk_id"), F.floor(F.col("id") / 10).alias("module_id"), (F.col("id") % 10).alias("chunk_index"))
    return R.retrieve(vectors, R.vector_of(vectors, 0, "id", "vector"), docs, asked, backend="hybrid", chunks=chunks).select("chunk_id", "hit_rank", "is_original_hit")


@query(f"select item_id as query_id, id, score, rank, case when length(text) > 200 then left(text, 200) || '...' else text end as preview from ({retrieval._top_sql(retrieval._bm25_sql('text'), 2)}) h join benchmark b on b.item_id = h.query_id join (select doc_id, text as t from documents) d on d.doc_id = h.id".replace("case when length(text) > 200 then left(text, 200) || '...' else text end", "case when length(t) > 200 then left(t, 200) || '...' else t end"))
def reading_materials(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return P.readings(asked, read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"))


_RES = "res as (select o.o_custkey as quiz, o.o_custkey as student, i.name as concept, i.n >= 4 as correct, o.o_orderkey * 10 + i.n as place from orders o join i on i.g = o.o_orderkey)"
_KNOWN = "known as (select o.o_custkey as student, p.p_name || ' ' || p.p_partkey as name, max(l.l_quantity) / 50.0::double as m from orders o join lineitem l on l.l_orderkey = o.o_orderkey join part p on p.p_partkey = l.l_partkey group by all)"


@query(
    f"""with {graphs._E}, {_RES}, {_KNOWN}, sides as (select distinct quiz, student, concept, case when correct then 'strong' else 'weak' end as side from res), starts as (select distinct concept as name from sides),
p as (select distinct s.name as start, p.source as node from starts s join pre p on p.target = s.name), d as (select distinct s.name as start, p.target as node from starts s join pre p on p.source = s.name),
r as (select distinct s.name as start, case when r.source = s.name then r.target else r.source end as node from starts s join rel r on s.name in (r.source, r.target)),
f as (select 'weak' as side, start, node from p union all select 'weak', start, node from r where start not in (select start from p) union all select 'strong', start, node from d union all select 'strong', start, node from r where start not in (select start from d)),
k as (select f.side, f.start, n.name, n.importance, row_number() over (partition by f.side, f.start order by n.importance desc nulls first, n.name) as rank from f join nodes n on n.name = f.node)
select s.quiz, s.side, count(*) as n, round(sum(k.importance), 4) as importance, round(min(round(coalesce(m.m, 0.3), 3)), 3) as least_mastery, round(sum(round(coalesce(m.m, 0.3), 3)), 3) as total_mastery
from sides s join k on k.start = s.concept and k.side = s.side left join known m on m.student = s.student and m.name = k.name where k.rank <= 5 group by s.quiz, s.side"""
)
def recommendation_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as quizzes of their customers, who master the parts that they have ordered by the largest quantity; parts go
    by number, of which the result holds none."""
    orders = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("g"), F.col("o_custkey").alias("quiz"))
    with passing(spark) as keep:
        own = graphs.numbered(spark, sf_dir)
        results = orders.join(own.items, "g").select("quiz", F.col("quiz").alias("student"), F.col("name").alias("concept"), (F.col("n") >= 4).alias("correct"), (F.col("g") * 10 + F.col("n")).alias("place"))
        parts = read(spark, sf_dir, "part").select("p_partkey", F.concat_ws(" ", "p_name", F.col("p_partkey").cast("string")).alias("name")).join(own.names, "name").select("p_partkey", F.col("id").alias("concept"))
        bought = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("g"), "l_partkey", "l_quantity").join(orders, "g").join(parts, F.col("l_partkey") == F.col("p_partkey"))
        state = bought.groupBy(F.col("quiz").alias("student"), "concept").agg((F.max("l_quantity") / 50.0).cast("double").alias("mastery_level"))
        found = P.blocks(results, own.edges, own.nodes, state)
        total = F.round(F.sum("mastery_level"), 3).alias("total_mastery")
        return keep(found.groupBy("quiz", "side").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("importance"), 4).alias("importance"), F.round(F.min("mastery_level"), 3).alias("least_mastery"), total))


@query("select p_partkey, 25 + 45 * (p_size / 50.0::double) as node_size, case when p_size >= 35 then 'green' when p_size >= 20 then 'yellow' else 'red' end as band from part")
def node_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    share = F.col("p_size") / 50.0
    return read(spark, sf_dir, "part").select("p_partkey", L.node_size(share).alias("node_size"), L.mastery_band(share).alias("band"))


@query("select n_name as concept, round(0.1 + (n_nationkey % 9) / 10.0, 2)::double as mastery_level, 3 + n_nationkey % 5 as attempts, timestamp '2024-01-31 12:00:00' - n_nationkey * interval 1 hour as last_assessed from nation")
def seeded_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    concepts = read(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("place"))
    return P.seed(concepts, F.lit("2024-01-31 12:00:00").cast("timestamp_ntz"))


@query()
def page_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.bodies(read(spark, sf_dir, "pages")).select("id", F.length("text").alias("n"))
