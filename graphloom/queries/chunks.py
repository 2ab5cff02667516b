"""Chunks, their links and windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import chunks as C
from ..operators import retrieve as R
from . import query, read

_CHUNKS = "select conv_id || '_' || turn as chunk_id, conv_id as module_id, turn as chunk_index, text from conversations"
#: One hit a conversation: its second turn, or the first if there is no other.
_HITS = f"select module_id || '_' || least(1, max(chunk_index)) as chunk_id, 1 + module_id as hit_rank, round(1.0 / (1 + module_id), 6) as score from ({_CHUNKS}) group by module_id union all select module_id || '_' || min(chunk_index), 100000000 + module_id, 0.5 from ({_CHUNKS}) group by module_id having count(*) > 2"


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "conversations").select(F.concat_ws("_", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("chunk_id"), F.col("conv_id").alias("module_id"), F.col("turn").alias("chunk_index"), "text")


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = turns(spark, sf_dir).groupBy("module_id").agg(F.min("chunk_index").alias("a"), F.max("chunk_index").alias("b"), F.count(F.lit(1)).alias("n"))
    key = lambda at: F.concat_ws("_", F.col("module_id").cast("string"), at.cast("string")).alias("chunk_id")
    first = c.select(key(F.least(F.lit(1), F.col("b"))), (1 + F.col("module_id")).alias("hit_rank"), F.round(1.0 / (1 + F.col("module_id")), 6).alias("score"))
    return first.unionByName(c.where("n > 2").select(key(F.col("a")), (100000000 + F.col("module_id")).alias("hit_rank"), F.lit(0.5).alias("score")))


_WINDOW = f"""with c as ({_CHUNKS}), h as (select h.*, c.module_id, c.chunk_index as at from ({_HITS}) h join c using (chunk_id)),
e as (select c.*, h.hit_rank, h.score as original_score, h.chunk_id = c.chunk_id as is_original_hit from h join c on c.module_id = h.module_id and c.chunk_index between h.at - 1 and h.at + 1),
d as (select * from (select *, row_number() over (partition by chunk_id order by hit_rank) as n from e) where n = 1)"""


@query("select doc_id as id, i - 1 as chunk_index, array_to_string(list_slice(w, (i - 1) * 512 + 1, i * 512), ' ') as text from (select doc_id, w, unnest(generate_series(1, ((len(w) + 511) // 512))) as i from (select doc_id, list_filter(regexp_split_to_array(text, '[ \\t\\n\\x0b\\f\\r]+'), lambda x: x <> '') as w from documents))")
def chunk_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.chunk_words(read(spark, sf_dir, "documents"), "doc_id").withColumn("chunk_index", F.col("chunk_index").cast("long"))


_SPACE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def _ends_sql(rows: str, size: int = 512) -> str:
    """rows (doc_id, t, n, b) with e: where the chunk that begins at b ends."""
    marks = ["'. '", "'! '", "'? '", "'.' || chr(10)", "'!' || chr(10)", "'?' || chr(10)"]
    out = f"select *, b + {size // 2} as best0, substr(t, b + {size // 2} + 1, {size - size // 2}) as tail from ({rows})"
    for i, mark in enumerate(marks):
        at = f"case when strpos(reverse(tail), reverse({mark})) = 0 then -1 else b + {size // 2} + length(tail) - strpos(reverse(tail), reverse({mark})) - 1 end"
        out = f"select *, case when {at} > best{i} then {at} + 2 else best{i} end as best{i + 1} from ({out})"
    return f"select doc_id, t, n, b, case when b + {size} < n and best6 > b + {size // 2} then best6 else b + {size} end as e from ({out})"


@query(
    f"""with recursive d as (select doc_id, text as t, length(text) as n from documents where length(text) > 0),
w as (select doc_id, t, n, 0::bigint as b from d union all select doc_id, t, n, greatest(e - 128, b + 1) from ({_ends_sql("select * from w")}) where greatest(e - 128, b + 1) < n - 128)
select doc_id::varchar as module_id, count(*) as chunks, max(e) as last_end, sum(length(trim(substr(t, b + 1, e - b), {_SPACE})))::bigint as chars from ({_ends_sql("select * from w")}) where trim(substr(t, b + 1, e - b), {_SPACE}) <> '' group by doc_id"""
)
def chunk_chars(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("module_id"), "text")
    return C.chunk_chars(records).groupBy("module_id").agg(F.count(F.lit(1)).alias("chunks"), F.max("end_char").alias("last_end"), F.sum(F.length("text")).alias("chars"))


@query(f"select chunk_id, lag(chunk_id) over w as previous_chunk_id, lead(chunk_id) over w as next_chunk_id, (row_number() over w - 1)::integer as chunk_no from ({_CHUNKS}) window w as (partition by module_id order by chunk_index, chunk_id)")
def sequence_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.link(turns(spark, sf_dir)).select("chunk_id", "previous_chunk_id", "next_chunk_id", "chunk_no")


@query(f"select * from (select lag(chunk_id) over (partition by module_id order by chunk_index, chunk_id) as source, chunk_id as target, 'NEXT' as type from ({_CHUNKS})) where source is not null")
def next_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.next_edges(C.link(turns(spark, sf_dir))).select("source", "target", "type")


@query(f"select module_id as source, arg_min(chunk_id, chunk_index) as target, 'FIRST_CHUNK' as type from ({_CHUNKS}) group by module_id")
def first_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.first_chunk_edges(turns(spark, sf_dir))


@query(f"{_WINDOW} select module_id, chunk_id, chunk_index, hit_rank, is_original_hit from e")
def chunk_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.window(turns(spark, sf_dir), hits(spark, sf_dir), 1, dedupe=False).select("module_id", "chunk_id", "chunk_index", "hit_rank", "is_original_hit")


@query(f"{_WINDOW} select chunk_id, hit_rank, is_original_hit from d")
def window_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.window(turns(spark, sf_dir), hits(spark, sf_dir), 1).select("chunk_id", "hit_rank", "is_original_hit")


@query(f"{_WINDOW} select chunk_id, original_score::double as original_score, not is_original_hit as is_window_context from d")
def window_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.window(turns(spark, sf_dir), hits(spark, sf_dir), 1).select("chunk_id", F.col("original_score").cast("double").alias("original_score"), (~F.col("is_original_hit")).alias("is_window_context"))


@query(f"{_WINDOW} select module_id, string_agg(text, chr(10) || chr(10) order by chunk_index) as text, count(*)::integer as chunk_count, (count(*) filter (where is_original_hit))::integer as hit_count, string_agg(chunk_id, ',' order by chunk_index) as chunk_ids from d group by module_id")
def window_text_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.merge_windows(R.window(turns(spark, sf_dir), hits(spark, sf_dir), 1)).drop("hit_rank")
