"""Vector search, BM25, fusion, reranking, evaluation."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scoring import l2_normalize, norm
from ..functions.text import numbered_context
from ..operators import evaluate as EV
from ..operators import extract as E
from ..operators import fulltext
from ..operators import retrieve as R
from ..operators import vectors as V
from ..operators.rerank import rerank_model as rerank_pairs
from ..operators.tables import passing, reliable
from . import query, read, toks

_COS = "list_sum(list_transform(list_zip({a}, {b}), lambda z: z[1]::double * z[2]::double)) / (sqrt(list_sum(list_transform({a}, lambda x: x::double * x::double))) * sqrt(list_sum(list_transform({b}, lambda x: x::double * x::double))){e})"


def _cos(a: str, b: str, e: str = "") -> str:
    return _COS.format(a=a, b=b, e=e)


def _knn_sql(key: int, k: int) -> str:
    return f"""select id, score, row_number() over (order by score desc, id)::integer as rank from (
  select e.vec_id as id, round({_cos("e.embedding", "q.embedding")}, 6) as score
  from embeddings e, (select embedding from embeddings where vec_id = {key}) q order by score desc, id limit {k})"""


def _near(spark: SparkSession, sf_dir: str, key: int, k: int) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings")
    return R.knn(vectors, R.vector_of(vectors, key, "vec_id", "embedding"), k, "vec_id", "embedding")


@query(_knn_sql(0, 10))
def knn_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _near(spark, sf_dir, 0, 10)


@query(f"select k.id, k.score, k.rank, e.label from ({_knn_sql(0, 20)}) k join embeddings e on k.id = e.vec_id where e.label = (select label from embeddings where vec_id = 0)")
def knn_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings")
    first = vectors.where("vec_id = 0").select("embedding", "label").first()
    return R.knn_filtered(vectors, list(first.embedding), 20, "vec_id", "embedding", F.col("label") == first.label).select("id", "score", "rank", "label")


@query(
    f"""with q as (select label, min(vec_id) as query_id from embeddings group by label),
s as (select q.query_id, e.vec_id as id, round({_cos("e.embedding", "v.embedding")}, 6) as score
  from q join embeddings v on v.vec_id = q.query_id, embeddings e)
select query_id, id, score, rank from (select *, row_number() over (partition by query_id order by score desc, id)::integer as rank from s) where rank <= 3"""
)
def vector_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One query a label."""
    vectors = read(spark, sf_dir, "embeddings")
    asked = vectors.groupBy("label").agg(F.min("vec_id").alias("query_id"), F.min_by("embedding", "vec_id").alias("vector"))
    return R.knn_many(vectors, asked, 3, "vec_id", "embedding").select("query_id", "id", "score", "rank")


_FIFTIETH = f"""with q as (select vec_id as query_id, embedding as v from embeddings where vec_id % 50 = 0),
s as (select query_id, e.vec_id as id, round({_cos("e.embedding", "q.v")}, 6) as score from q, embeddings e)
select query_id, id, score, rank from (select *, row_number() over (partition by query_id order by score desc, id)::integer as rank from s) where rank <= 10"""


def _fiftieth(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    vectors = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return vectors, vectors.where("id % 50 = 0").withColumnRenamed("id", "query_id")


@query(_FIFTIETH)
def vector_index_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fiftieth vector against every row of every shard of the index."""
    vectors, asked = _fiftieth(spark, sf_dir)
    with passing(spark) as keep:
        return keep(V.search_index(reliable(V.build_index(vectors, "id", "vector")), asked, 10, exact=True)).select("query_id", "id", "score", "rank")


@query(f"select count(*) as n_queries, true as nine_of_ten, count(*) * 10 as n_hits from (select distinct query_id from ({_FIFTIETH}))")
def vector_index_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beam search of the index held against exact search: whether nine of ten of the nearest ten are found."""
    vectors, asked = _fiftieth(spark, sf_dir)
    with passing(spark) as keep:
        index = reliable(V.build_index(vectors, "id", "vector"))
        found = V.search_index(index, asked, 10)
        recall = reliable(V.recall(found, V.knn_many(vectors, asked, 10, "id", "vector")))
        return keep(recall).agg(F.count(F.lit(1)).alias("n_queries"), (F.avg("recall") >= 0.9).alias("nine_of_ten"), F.lit(found.count()).cast("long").alias("n_hits"))


def _rrf_sql(lists: list[str], k: int) -> str:
    union = " union all ".join(f"select id, 1.0::double / (60 + rank) as part, {', '.join(('rank' if j == i else 'null::integer') + f' as r{j}' for j in range(len(lists)))} from ({s})" for i, s in enumerate(lists))
    order = ", ".join(f"r{j} nulls last" for j in range(len(lists)))
    return f"""with u as ({union}), g as (select id, round(sum(part), 9) as rrf_score, {", ".join(f"min(r{j}) as r{j}" for j in range(len(lists)))} from u group by id)
select id, rrf_score, row_number() over (order by rrf_score desc, {order}, id)::integer as rank from g order by rank limit {k}"""


@query(_rrf_sql([_knn_sql(0, 20), _knn_sql(1, 20)], 10))
def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.rrf([_near(spark, sf_dir, i, 20) for i in (0, 1)], top_k=10)


@query(_rrf_sql([_knn_sql(i, 20) for i in (0, 1, 2)], 15))
def rrf_n_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.rrf([_near(spark, sf_dir, i, 20) for i in (0, 1, 2)], top_k=15)


@query(
    f"""with c as (select label, min(vec_id) as vec_id from embeddings group by label),
s as (select e.vec_id as id, 'label ' || c.label as name, round({_cos("e.embedding", "v.embedding", " + 1e-8")}, 6) as score from c join embeddings v on v.vec_id = c.vec_id, embeddings e)
select id, name, score from s where score >= 0.5"""
)
def concept_embedding_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector as a text that asks for the concepts (labels, by their first vectors) that are similar to it."""
    vectors = read(spark, sf_dir, "embeddings")
    names = vectors.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("vector")).select(F.concat(F.lit("label "), F.col("label").cast("string")).alias("name"), "vector")
    return E.by_vectors(vectors.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")), names).select("id", "name", "score")


@query("select label, count(*) as n, round(avg(sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double)))), 6) as mean_norm from embeddings group by label")
def embedding_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(norm(F.col("embedding"))), 6).alias("mean_norm"))


@query("select vec_id, round(list_sum(list_transform(embedding, lambda x: x::double / sqrt(list_sum(list_transform(embedding, lambda y: y::double * y::double))))), 5) as total from embeddings")
def l2_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit = l2_normalize(F.col("embedding"))
    return read(spark, sf_dir, "embeddings").select("vec_id", F.round(F.aggregate(unit, F.lit(0.0), lambda s, x: s + x), 5).alias("total"))


def _bm25_sql(text: str, docs: str = "documents", key: str = "doc_id", queries: str = "select item_id as query_id, text from benchmark") -> str:
    return f"""select query_id, id, sum(w) as score from (
  with w as (select {key} as id, {toks(text)} as words from {docs}),
  sizes as (select count(*) as n, avg(len(words)) as avgdl from w),
  asked as (select distinct query_id, unnest({toks("text")}) as token from ({queries})),
  terms as (select id, token, count(*) as tf, any_value(dl) as dl from (select id, len(words) as dl, unnest(words) as token from w) where token in (select token from asked) group by id, token),
  df as (select token, count(*) as df from terms group by token)
  select a.query_id, t.id, ln(1 + (s.n - df.df + 0.5) / (df.df + 0.5)) * t.tf * 2.2 / (t.tf + 1.2 * (0.25 + 0.75 * t.dl / s.avgdl)) as w
  from terms t join df on t.token = df.token join asked a on a.token = t.token, sizes s) group by query_id, id"""


def _top_sql(scores: str, k: int, key: str = "query_id") -> str:
    return f"select {key}, id, score, rank from (select *, row_number() over (partition by {key} order by score desc, id)::integer as rank from (select {key}, id, round(score, 6) as score from ({scores}))) where rank <= {k}"


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


@query(_top_sql(_bm25_sql("text"), 3))
def bm25_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = R.bm25(read(spark, sf_dir, "documents"), _items(spark, sf_dir), "doc_id", "text", k=3)
    return R.top_per_query(scores, 3).select("query_id", "id", "score", "rank")


_FIELDS = {"text": 3.0, "source": 2.0, "lang": 1.0}
_ASKED = "select item_id as query_id, text || ' src' || (item_id % 20) as text from benchmark"


def _best_sql() -> str:
    parts = " union all ".join(f"select query_id, id, score * {b} as score from ({_bm25_sql(f, queries=_ASKED)})" for f, b in _FIELDS.items())
    return f"select query_id, id, max(score) as score from ({parts}) group by query_id, id"


@query(_top_sql(_best_sql(), 3))
def bm25_multifield(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = _items(spark, sf_dir).withColumn("text", F.concat("text", F.lit(" src"), (F.col("query_id") % 20).cast("string")))
    return R.top_per_query(R.bm25_best_field(read(spark, sf_dir, "documents"), asked, "doc_id", _FIELDS, k=3), 3).select("query_id", "id", "score", "rank")


_ONE = "select item_id as query_id, text from benchmark where item_id = 0"


def _hybrid_sql() -> str:
    found = f"select id, row_number() over (order by score desc, id)::integer as rank from (select id, round(score * 3.0, 6) as score from ({_bm25_sql('text', queries=_ONE)}) order by score desc, id limit 20)"
    return _rrf_sql([_knn_sql(0, 20), found], 20)


@query(_hybrid_sql())
def hybrid_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first benchmark item and the first vector against all documents and vectors."""
    vectors = read(spark, sf_dir, "embeddings")
    asked = _items(spark, sf_dir).where("query_id = 0")
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return R.hybrid(vectors.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")), R.vector_of(vectors, 0, "vec_id", "embedding"), docs, asked, 20, {"text": 3.0})


@query(
    f"""with q as (select b.item_id as query_id, e.embedding as v from benchmark b join embeddings e on e.vec_id = b.item_id),
near as (select query_id, id, row_number() over (partition by query_id order by score desc, id) as near from (select q.query_id, e.vec_id as id, round({_cos("e.embedding", "q.v")}, 6) as score from q, embeddings e)),
found as (select query_id, id, rank as found from ({_top_sql("select query_id, id, score * 3.0 as score from (" + _bm25_sql("text") + ")", 10)})),
u as (select query_id, id, near, null as found from near where near <= 10 union all select query_id, id, null, found from found),
g as (select query_id, id, min(near) as near, min(found) as found from u group by all),
s as (select *, round(coalesce(1.0::double / (60 + near), 0) + coalesce(1.0::double / (60 + found), 0), 9) as rrf_score from g)
select query_id, id, rrf_score, rank from (select *, row_number() over (partition by query_id order by rrf_score desc, near nulls last, found nulls last, id)::integer as rank from s) where rank <= 10"""
)
def hybrid_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item, with the vector of its number, against all documents and vectors."""
    vectors = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    items = _items(spark, sf_dir)
    asked = vectors.withColumnRenamed("id", "query_id").join(items.select("query_id"), "query_id")
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return R.hybrid_many(vectors, asked, docs, items, 10, {"text": 3.0}, fuzzy=False)


@query(f"with h as ({_top_sql(_bm25_sql('text'), 3)}) select query_id, string_agg('[' || rank || '] ' || coalesce(text, ''), chr(10) || chr(10) order by rank) as context from h join documents d on d.doc_id = h.id group by query_id")
def prompt_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole texts of each item's three best documents, numbered."""
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    hits = R.top_per_query(R.bm25(docs, _items(spark, sf_dir), "id", "text", k=3), 3).join(docs, "id")
    rows = F.array_sort(F.collect_list(F.struct("rank", F.coalesce("text", F.lit("")).alias("text"))))
    return hits.groupBy("query_id").agg(numbered_context(F.transform(rows, lambda r: r["text"])).alias("context"))


def _fuzzy_sql(text: str, docs: str, key: str, queries: str) -> str:
    """BM25 in which a token finds terms within its edit distance; the best of them counts."""
    return f"""select query_id, id, sum(w) as score from (
  with w as (select {key} as id, {toks(text)} as words from {docs}),
  sizes as (select count(*) as n, avg(len(words)) as avgdl from w),
  vocabulary as (select distinct unnest(words) as token from w),
  asked as (select distinct query_id, unnest({toks("text")}) as asked from ({queries})),
  near as (select a.query_id, a.asked, v.token, 1 - levenshtein(a.asked, v.token) / least(length(a.asked), length(v.token))::double as boost from asked a, vocabulary v
    where abs(length(a.asked) - length(v.token)) <= 2 and levenshtein(a.asked, v.token) <= case when length(a.asked) < 3 then 0 when length(a.asked) < 6 then 1 else 2 end),
  terms as (select id, token, count(*) as tf, any_value(dl) as dl from (select id, len(words) as dl, unnest(words) as token from w) where token in (select token from near) group by id, token),
  df as (select token, count(*) as df from terms group by token)
  select a.query_id, t.id, a.asked, max(a.boost * ln(1 + (s.n - df.df + 0.5) / (df.df + 0.5)) * t.tf * 2.2 / (t.tf + 1.2 * (0.25 + 0.75 * t.dl / s.avgdl))) as w
  from terms t join df on t.token = df.token join near a on a.token = t.token, sizes s group by a.query_id, t.id, a.asked) group by query_id, id"""


_TERMS = "select 'red widget' as text, 1 as query_id union all select 'gren bolt', 2 union all select 'smal rng', 3 union all select 'blue', 4 union all select 'stel gadgte', 5"
_NAMES = "(select distinct p_name as name from part)"


@query(f"select query_id, id as name, round(score, 6) as score from ({_fuzzy_sql('name', _NAMES, 'name', _TERMS)})")
def concept_fulltext(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fuzzy full text on concept names."""
    asked = spark.createDataFrame([("red widget", 1), ("gren bolt", 2), ("smal rng", 3), ("blue", 4), ("stel gadgte", 5)], "text string, query_id int")
    found = E.fulltext(read(spark, sf_dir, "part").select(F.col("p_name").alias("name")), asked)
    return found.withColumn("score", F.round("score", 6))


_MISSPELT = "select item_id as query_id, regexp_replace(replace(replace(text, 'th', 'ht'), 'ion', 'oin'), '[^\\x00-\\x7F]', '', 'g') as text from benchmark"


_ASCII = "(select doc_id, regexp_replace(text, '[^\\x00-\\x7F]', '', 'g') as text from documents)"


@query(_top_sql(_fuzzy_sql("text", _ASCII, "doc_id", _MISSPELT), 3))
def bm25_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Misspelt items against all documents; without letters beyond ASCII, whose edits the two engines count apart."""
    plain = lambda c: F.regexp_replace(c, r"[^\x00-\x7F]", "")
    asked = _items(spark, sf_dir).withColumn("text", plain(F.replace(F.replace("text", F.lit("th"), F.lit("ht")), F.lit("ion"), F.lit("oin"))))
    docs = read(spark, sf_dir, "documents").withColumn("text", plain(F.col("text")))
    return R.top_per_query(R.bm25(docs, asked, "doc_id", "text", fuzzy=True, k=3), 3).select("query_id", "id", "score", "rank")


@query(
    f"""with s as ({_top_sql(_bm25_sql("text", queries=_ONE), 20)}),
d as (select s.id, s.rank, len(list_intersect(list_distinct({toks("b.text")}), {toks("d.text")})) / greatest(len(list_distinct({toks("b.text")})), 1)::double as rerank_score
  from s join documents d on d.doc_id = s.id join benchmark b on b.item_id = s.query_id)
select id, rank, round(rerank_score, 6) as rerank_score from d order by rerank_score desc, rank limit 5"""
)
def rerank_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = _items(spark, sf_dir).where("query_id = 0")
    docs = read(spark, sf_dir, "documents")
    hits = R.top_per_query(R.bm25(docs, asked, "doc_id", "text", k=20), 20).join(docs.select(F.col("doc_id").alias("id"), "text"), "id")
    return R.rerank(hits, asked.first().text, 5).select("id", "rank", F.round("rerank_score", 6).alias("rerank_score"))


@query(f"select query_id, round(avg(coalesce(l.quality, 0)), 6) as precision, count(*) as n from ({_top_sql(_bm25_sql('text'), 10)}) s left join labels l on l.doc_id = s.id group by query_id")
def precision_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = R.top_per_query(R.bm25(read(spark, sf_dir, "documents"), _items(spark, sf_dir), "doc_id", "text", k=10), 10)
    labels = read(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.col("quality").alias("relevant"))
    judged = hits.join(labels, "id", "left").withColumn("relevant", F.coalesce("relevant", F.lit(0)))
    return R.precision(judged).withColumn("precision", F.round("precision", 6))


_PAIRS = "list_distinct(list_transform(range(1, len({0})), lambda i: {0}[i] || ' ' || {0}[i + 1]))"


@query(
    f"""with s as ({_top_sql(_bm25_sql("text"), 20)}),
w as (select s.query_id, s.id, s.rank as before, {toks("b.text")} as q, {toks("d.text")} as t from s join documents d on d.doc_id = s.id join benchmark b on b.item_id = s.query_id),
f as (select query_id, id, before, len(list_intersect(list_distinct(q), t)) / greatest(1, len(list_distinct(q)))::double as x, len(list_intersect({_PAIRS.format("q")}, {_PAIRS.format("t")})) / greatest(1, len({_PAIRS.format("q")}))::double as y from w),
p as (select query_id, id, before, round(1 / (1 + exp(-(2.0::double * x + y))), 6) as rerank_score from f)
select query_id, id, rank, rerank_score from (select *, row_number() over (partition by query_id order by rerank_score desc, before)::integer as rank from p) where rank <= 5"""
)
def rerank_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each item's twenty best documents by a model over pairs, in batches, with its default weights."""
    docs, asked = read(spark, sf_dir, "documents"), _items(spark, sf_dir)
    hits = R.top_per_query(R.bm25(docs, asked, "doc_id", "text", k=20), 20).select("query_id", "id", "rank")
    hits = hits.join(docs.select(F.col("doc_id").alias("id"), "text"), "id").join(asked.select("query_id", F.col("text").alias("question")), "query_id")
    return rerank_pairs(hits, 5, digits=6).select("query_id", "id", "rank", "rerank_score")


def _precision_sql(scores: str) -> str:
    return f"""select query_id, case when sum(r) > 0 then sum(r * p) / sum(r) else 0 end as value from (
  select query_id, r, avg(r) over (partition by query_id order by rank rows unbounded preceding) as p from (select s.query_id, s.rank, coalesce(l.quality, 0)::double as r from ({_top_sql(scores, 10)}) s left join labels l on l.doc_id = s.id)) group by query_id"""


_CUTS = [sum(math.exp(-1) / math.factorial(j) for j in range(k + 1)) for k in range(12)]
_DRAWN = "list_sum(list_transform(range(1, 9), lambda i: (instr('0123456789abcdef', substr(h, i, 1)) - 1) * pow(16, 8 - i))) / 4294967296.0::double"


@query(
    f"""with a as ({_precision_sql(_bm25_sql("text", queries=_ASKED))}), b as ({_precision_sql(_best_sql())}),
d as (select a.query_id, a.value as first, b.value as second from a join b on a.query_id = b.query_id),
h as (select d.*, r, md5(query_id || ':' || r) as h from d, (select unnest(range(0, 201)) as r)),
u as (select r, first, second, {_DRAWN} as u from h),
w as (select r, first, second, case when r = 0 then 1 else {" + ".join(f"(u >= {c!r})::integer" for c in _CUTS)} end as w from u),
m as (select r, sum(w * first) / sum(w) as first, sum(w * second) / sum(w) as second from w group by r having sum(w) > 0),
v as (select r, 'first' as name, first as value from m union all select r, 'second', second from m union all select r, 'difference', second - first from m)
select name, round(max(value) filter (r = 0), 6) as mean, round(quantile_cont(value, 0.025) filter (r > 0), 6) as low, round(quantile_cont(value, 0.975) filter (r > 0), 6) as high from v group by name"""
)
def precision_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Context precision of BM25 over texts and over all fields, and of their difference, with bootstrap intervals."""
    docs = read(spark, sf_dir, "documents")
    asked = _items(spark, sf_dir).withColumn("text", F.concat("text", F.lit(" src"), (F.col("query_id") % 20).cast("string")))
    labels = read(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.col("quality").alias("relevant"))

    def judged(scores: DataFrame, name: str) -> DataFrame:
        hits = R.top_per_query(scores, 10).join(labels, "id", "left")
        return EV.context_precision(hits).select("query_id", F.col("context_precision").alias(name))

    with passing(spark) as keep:
        index = fulltext.build_text_index(docs, "doc_id", "text", fulltext.asked_tokens(asked).select(F.col("asked").alias("token")))
        first = judged(R.bm25(docs, asked, "doc_id", "text", k=10, index=index), "first")
        second = judged(R.bm25_best_field(docs, asked, "doc_id", _FIELDS, k=10, indexes={"text": index}), "second")
        found = EV.bootstrap(reliable(first.join(second, "query_id")))
        return keep(found.select("name", *[F.round(c, 6).alias(c) for c in ("mean", "low", "high")]))


@query(f"with a as ({_knn_sql(0, 20)}), b as ({_knn_sql(1, 20)}) select (select count(*) from (select id from a intersect select id from b)) as both, (select count(*) from (select id from a except select id from b)) as only_first, (select count(*) from (select id from b except select id from a)) as only_second")
def compare_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlap of two result lists."""
    a, b = (_near(spark, sf_dir, i, 20).select("id", F.lit(1).alias(n)) for i, n in ((0, "a"), (1, "b")))
    both = a.join(b, "id", "full")
    return both.agg(F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("both"), F.count_if(F.col("b").isNull()).alias("only_first"), F.count_if(F.col("a").isNull()).alias("only_second"))


@query("select key, count(*) as n, min(doc_id) as first_doc from (select doc_id, coalesce(case when doc_id % 3 > 0 then doc_id::varchar end, md5(left(coalesce(text, ''), 50))) as key from documents) group by key")
def hit_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as hits, every third without an id: those that begin alike are one."""
    docs = read(spark, sf_dir, "documents")
    keyed = docs.select("doc_id", R.hit_key(F.col("text"), F.when(F.col("doc_id") % 3 > 0, F.col("doc_id"))).alias("key"))
    return keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_doc"))


@query("select count(*) as doc_count, true as exists, count(embedding) as embedded, count(*) - count(embedding) as missing from embeddings")
def collection_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.collection_info(read(spark, sf_dir, "embeddings"), "embedding")


@query(
    f"""with k as ({_knn_sql(0, 10)}), c as (select vec_id as chunk_id, vec_id // 10 as module_id, vec_id % 10 as chunk_index from embeddings),
e as (select c.chunk_id, c.module_id, c.chunk_index, k.rank as hit_rank, k.score, k.id = c.chunk_id as hit from k join c h on h.chunk_id = k.id join c on c.module_id = h.module_id and c.chunk_index between h.chunk_index - 1 and h.chunk_index + 1)
select chunk_id, module_id, chunk_index, hit_rank, score as original_score, hit as is_original_hit from (select *, row_number() over (partition by chunk_id order by hit_rank) as n from e) where n = 1"""
)
def vector_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks most similar to the first vector, with their neighbours; ten vectors in a row are a module."""
    vectors = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    chunks = vectors.select(F.col("id").alias("chunk_id"), F.floor(F.col("id") / 10).alias("module_id"), (F.col("id") % 10).alias("chunk_index"))
    return R.retrieve_window(vectors, R.vector_of(vectors, 0, "id", "vector"), chunks, 10, 1).select("chunk_id", "module_id", "chunk_index", "hit_rank", "original_score", "is_original_hit")
