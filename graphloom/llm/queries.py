"""The operators' queries over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontam, jaccard, langid, licenses, lines, lm, merkle, pieces, secrets, topk, toxicity, warc, whiten


def model_path() -> str:
    """The public BPE model; the path is a parameter of the operator."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(_read(spark, sf_dir, "documents"))


def op1_ngram_jaccard_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1 with the number of links of each document: every pair of different sets is settled."""
    return jaccard.links(_read(spark, sf_dir, "documents"))


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(_read(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _read(spark, sf_dir, "documents")
    return toxicity.score(documents, toxicity.fit(documents, _read(spark, sf_dir, "labels")))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digest(_read(spark, sf_dir, "documents"), model_path())


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(_read(spark, sf_dir, "documents"))


def op6_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(_read(spark, sf_dir, "embeddings"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_read(spark, sf_dir, "documents"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.digest(_read(spark, sf_dir, "documents"))


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.digest(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_read(spark, sf_dir, "pages"))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten.whiten(_read(spark, sf_dir, "embeddings"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(_read(spark, sf_dir, "documents"))


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_ngram_jaccard, op2_lm_score, op3_toxicity, op4_sentencepiece, op5_secret_scan, op6_exact_topk, op7_language_id, op8_line_dedup,
        op9_benchmark_decontamination, op10_warc, op11_embedding_whitening, op12_merkle_manifest, op13_license_scan, op1_ngram_jaccard_links,
    )
}

ORACLE: dict[str, str] = {
    "op1_ngram_jaccard": r"""
with recursive w as materialized (
  select row_number() over () as r, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w
  from documents),
sh as (select distinct r, array_to_string(w[i : i + 4], ' ') as s from (select r, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) as i from w where len(w) > 0)),
n as (select r, count(*) as n, md5(string_agg(s, chr(10) order by s)) as mark from sh group by r),
pairs as (select a.r as x, b.r as y, count(*) as c from sh a join sh b on a.s = b.s and a.r < b.r group by all),
links as (select x, y from pairs join n p on p.r = x join n q on q.r = y where 100 * c >= 80 * (p.n + q.n - c)),
both_ways as (select x, y from links union all select y, x from links),
steps as (select x, y from both_ways union all select a.r, b.r from w a join w b on a.doc_id = b.doc_id and a.r <> b.r),
reach as (select r as x, r as y from w union select r.x, b.y from reach r join steps b on b.x = r.y),
least as (select x, min(doc_id) as component_id from reach join w on w.r = y group by x),
classes as (select mark, min(doc_id) as class_id from n join w on w.r = n.r group by mark)
select w.doc_id, coalesce(n.n, 0) as n_shingles, l.component_id, c.class_id
from w left join n on n.r = w.r left join classes c on c.mark = n.mark join least l on l.x = w.r""",
    "op6_exact_topk": """
with v as (
  select row_number() over () as r, vec_id, list_transform(embedding, lambda x: floor(256.0 * x::double)::bigint) as w from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (
  select q.r, q.vec_id as query_id, c.vec_id, list_sum(list_transform(list_zip(q.w, c.w), lambda z: z[1] * z[2]))::bigint as score
  from v q, v c where q.vec_id % 50 = 0 and c.vec_id <> q.vec_id)
select query_id, rank::integer as rank, vec_id, score
from (select *, row_number() over (partition by r order by score desc, vec_id) as rank from scored) where rank <= 5""",
    "op8_line_dedup": r"""
with lines as (
  select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as pos
  from documents),
keyed as (
  select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
  from lines),
firsts as (select key, min(doc_id) as holder from keyed where length(key) >= 10 group by key),
marked as (select k.*, coalesce(k.doc_id > f.holder, false) as gone from keyed k left join firsts f on k.key = f.key)
select doc_id, count(*) as n_lines, count(*) filter (where gone) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not gone), '')) as kept_sha256
from marked group by doc_id""",
    "op9_benchmark_decontamination": r"""
with dw as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from documents),
iw as (
  select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from benchmark),
windows as (
  select distinct item_id, least(len(w), 10) as size, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') as win
  from (select item_id, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) as i from iw where len(w) > 0)),
sizes as (select distinct size from windows),
grams as (
  select doc_id, i, s.size, array_to_string(w[i : i + s.size - 1], ' ') as win
  from (select doc_id, w, unnest(generate_series(1, len(w))) as i from dw) d, sizes s where i + s.size - 1 <= len(w)),
hits as (select g.doc_id, g.i, g.size, x.item_id from grams g join windows x on g.win = x.win and g.size = x.size),
covered as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(generate_series(i, i + size - 1)) as p from hits) group by doc_id),
items as (select doc_id, count(distinct item_id) as n_items, string_agg(distinct item_id::varchar, ',' order by item_id::varchar) as list from hits group by doc_id)
select d.doc_id, len(d.w)::bigint as n_words, coalesce(c.n_hit, 0) as n_hit, coalesce(i.n_items, 0) as n_items,
       sha256(coalesce(i.list, '')) as items_sha256, coalesce(c.n_hit, 0) > 0 as contaminated
from dw d left join covered c on d.doc_id = c.doc_id left join items i on d.doc_id = i.doc_id""",
    "op10_warc": """
with p as (
  select page_id, coalesce(html, '') as html, octet_length(encode(coalesce(html, ''))) as n, sha1(coalesce(html, '')) as digest from pages),
t as (select digest, max(page_id) as target from p where n >= 1000 group by digest)
select page_id, n::bigint as payload_bytes, p.digest as payload_digest,
       case when t.target is not null and t.target <> page_id then 'revisit' else 'response' end as record_type,
       case when t.target <> page_id then t.target end as refers_to
from p left join t on p.digest = t.digest""",
    "op12_merkle_manifest": r"""
with recursive d as (select row_number() over () as r, * from documents),
framed as (
  select *, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as low,
         concat(coalesce(octet_length(encode(doc_id::varchar)) || ':' || doc_id, '-'), coalesce(octet_length(encode(source)) || ':' || source, '-'),
                coalesce(octet_length(encode(lang)) || ':' || lang, '-'), coalesce(octet_length(encode(n_chars::varchar)) || ':' || n_chars, '-')) as head,
         xor(4294967295, list_reduce(list_prepend(4294967295::bigint, flatten(list_transform(string_split(doc_id::varchar, ''), lambda c: [ascii(c)::bigint, -1, -1, -1, -1, -1, -1, -1, -1]))),
           lambda a, x: case when x >= 0 then xor(a, x) when a & 1 = 1 then xor(a >> 1, 3988292384) else a >> 1 end)) as crc
  from d),
leaves as (
  select r, doc_id, source, sha256(head || coalesce(octet_length(encode(text)) || ':' || text, '-')) as leaf,
         case when crc % 5 = 0 then sha256(head || coalesce(octet_length(encode(low)) || ':' || low, '-')) end as other
  from framed),
placed as (
  select *, dense_rank() over (order by source nulls first) - 1 as tree, row_number() over (partition by source order by doc_id nulls first, leaf, other) - 1 as pos,
         count(*) over (partition by source) as n
  from leaves),
lv as (
  select tree, 0 as lvl, pos, n, leaf as h from placed
  union all
  select tree, lvl + 1, pos // 16, (max(n) + 15) // 16, sha256(string_agg(h, '' order by pos)) from lv where n > 1 group by tree, lvl, pos // 16),
sub as (select tree, h from lv where n = 1),
up as (
  select 0 as lvl, tree as pos, count(*) over () as n, h from sub
  union all
  select lvl + 1, pos // 16, (max(n) + 15) // 16, sha256(string_agg(h, '' order by pos)) from up where n > 1 group by lvl, pos // 16),
both_ways as (select tree, lvl, pos, n, h from lv union all select -1, lvl, pos, n, h from up),
steps as (
  select a.tree, a.lvl, a.pos, coalesce(string_agg(b.h, '' order by b.pos) filter (b.pos < a.pos), '') as l, coalesce(string_agg(b.h, '' order by b.pos) filter (b.pos > a.pos), '') as r
  from both_ways a join both_ways b on a.tree = b.tree and a.lvl = b.lvl and a.pos // 16 = b.pos // 16 where a.n > 1 group by all),
way as (
  select p.r as id, s.lvl as k, s.l, s.r from placed p join steps s on s.tree = p.tree and s.pos = p.pos // pow(16, s.lvl)::bigint
  union all
  select p.r, 1000 + s.lvl, s.l, s.r from placed p join steps s on s.tree = -1 and s.pos = p.tree // pow(16, s.lvl)::bigint),
paths as (select id, list({'l': l, 'h': '', 'r': r} order by k) as path, string_agg(l || r, '' order by k) as proof from way group by id),
folded as (
  select doc_id, leaf, tree, coalesce(proof, '') as proof,
         list_reduce(list_prepend({'l': '', 'h': coalesce(other, leaf), 'r': ''}, coalesce(path, [])), lambda a, x: {'l': '', 'h': sha256(x.l || a.h || x.r), 'r': ''}).h as folded_root
  from placed left join paths on id = r)
select doc_id, leaf, s.h as subroot, u.h as root, sha256(proof) as proof_sha256, folded_root, folded_root = u.h as verified
from folded f join sub s on s.tree = f.tree, (select h from up where n = 1) u""",
}

_LINKS = "select doc_id, n_shingles, component_id, class_id, coalesce(k, 0)::bigint as n_links from (select w.r, w.doc_id, coalesce(n.n, 0)"
ORACLE["op1_ngram_jaccard_links"] = ORACLE["op1_ngram_jaccard"].replace("select w.doc_id, coalesce(n.n, 0)", _LINKS) + ") left join (select x, count(*) as k from both_ways group by x) on x = r"
