"""Documents and pages: cleaning, parsing, concepts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import plugins
from ..functions import text as X
from ..operators import concepts as C
from ..operators import extract as E
from ..operators.tables import reliable
from ..operators.tree import reading_order
from ..sources import files as S
from . import low, query, read, toks

_WORDS = f"select doc_id, source as module_id, unnest({toks('text')}) as name from documents"
_TOP = f"select name, n from (select name, count(*) as n from ({_WORDS}) where length(name) >= 4 group by name) order by n desc, length(name) desc, name limit 50"


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("module_id"), F.explode(X.tokens(F.col("text"))).alias("name"))


def top_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifty most frequent words of four letters and more stand for concepts: a table, so that they are counted once
    however often a query reads them."""
    return reliable(C.most_common(_words(spark, sf_dir).where(F.length("name") >= 4), 50))


@query(_TOP)
def top_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_words(spark, sf_dir)


@query(f"select name, count(distinct module_id) as doc_frequency, bool_or(length(name) > 8) as key_term, array_to_string(list_sort(list_distinct(list(module_id))), ',') as modules from ({_WORDS}) group by name")
def doc_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    mentions = _words(spark, sf_dir).withColumn("key_term", F.length("name") > 8)
    return C.document_frequency(mentions).select("name", "doc_frequency", "key_term", F.array_join("source_modules", ",").alias("modules"))


@query(
    """select source as module_id, count(*) as n_records, arg_min(text, doc_id) as title, array_to_string(list_sort(list_distinct(list(lang))), ',') as sections,
arg_min(lang || ',' || source, doc_id) as key_terms, md5(string_agg(text, '|' order by doc_id)) as texts_md5 from documents group by source"""
)
def module_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts of each source, in order of id; the first one stands for its title."""
    records = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("module_id"), F.col("text").alias("module_title"), F.col("lang").alias("section"), F.array("lang", "source").alias("key_terms"), "text")
    return C.module_groups(records).select("module_id", "n_records", "title", "sections", F.array_join("key_terms", ",").alias("key_terms"), F.md5(F.array_join("texts", "|")).alias("texts_md5"))


@query(f"with c as ({_TOP}) select query_id, name, place from (select b.item_id as query_id, c.name, row_number() over (partition by b.item_id order by length(c.name) desc, c.name)::integer as place from benchmark b join c on contains(lower(b.text), lower(c.name))) where place <= 5")
def substring_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return C.query_concepts(asked, top_words(spark, sf_dir), 5)


@query(f"with c as ({_TOP}) select name from c a where not exists (select 1 from c b where contains(lower(b.name), lower(a.name)) and lower(a.name) <> lower(b.name))")
def substring_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.drop_substrings(top_words(spark, sf_dir).select("name"))


@query(f"with c as ({_TOP}), l as (select left(name, 3) as label from c where length(name) > 6) select name from c where exists (select 1 from l where contains(lower(c.name), lower(label)))")
def highlight_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = top_words(spark, sf_dir).select("name")
    return C.highlighted(names, names.where("length(name) > 6").select(F.substring("name", 1, 3).alias("label")))


@query(f"with c as ({_TOP}) select c.name, count(*) as n_docs, min(d.doc_id) as first_doc from documents d join c on contains(lower(d.text), lower(c.name)) group by c.name")
def mentions_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = C.mentions(read(spark, sf_dir, "documents"), top_words(spark, sf_dir), "doc_id")
    return found.groupBy("name").agg(F.count(F.lit(1)).alias("n_docs"), F.min("id").alias("first_doc"))


@query(f"with c as ({_TOP}), t as (select distinct p_type as text from part union select name || 's' from c union select name from c) select text, arg_min(name, (case when lower(text) = lower(name) then '0' else '1' end) || name) as name from t join c on contains(lower(text), lower(name)) or contains(lower(name), lower(text)) group by text")
def known_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = top_words(spark, sf_dir).select("name")
    texts = read(spark, sf_dir, "part").select(F.col("p_type").alias("text")).union(names.select(F.concat("name", F.lit("s")))).union(names).distinct()
    return C.known_match(texts, names)


_CASED = "array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(left(w, 1)) || lower(substr(w, 2))), ' ')"


@query(f"select distinct {_CASED} as name from part where length(p_name) >= 3 and len(string_split(p_name, ' ')) <= 4 union select 'Post-War Boom' union select 'O''Neill''S 2Nd Law'")
def concept_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names in title case."""
    more = [("Key Terms",), ("ab",), ("a b c d e",), (" post-war boom ",), ("o'neill's 2nd law",)]
    return C.clean_names(read(spark, sf_dir, "part").select(F.col("p_name").alias("name")).distinct().union(spark.createDataFrame(more, "name string"))).distinct()


@query("with m as (select p_name as name, p_size / 50.0::double as score, p_type as strategy from part) select name, round(least(max(score) * (1 + 0.2 * (count(distinct strategy) - 1)), 1.0), 6) as score, count(distinct strategy) as strategies from m group by name")
def strategy_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    matches = read(spark, sf_dir, "part").select(F.col("p_name").alias("name"), (F.col("p_size") / 50.0).alias("score"), F.col("p_type").alias("strategy"))
    return C.fuse(matches).withColumn("score", F.round("score", 6))


@query("select name, max(score) as score, arg_max(strategy, lpad((score * 50)::integer::varchar, 3, '0') || strategy) as strategy from (select p_name as name, p_size / 50.0::double as score, p_type as strategy from part) group by name")
def best_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.best_per_name(read(spark, sf_dir, "part").select(F.col("p_name").alias("name"), (F.col("p_size") / 50.0).alias("score"), F.col("p_type").alias("strategy")))


_MARKUP = "'---' || chr(10) || 'id: ' || doc_id || chr(10) || '---' || chr(10) || '<div class=\"x\">' || text || '</div><!-- ' || lang || ' -->![img](a/b.png)'"


@query(
    f"""select doc_id, length(t) as n, md5(t) as text_md5 from (select doc_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace({_MARKUP}, '^---[\\s\\S]*?---', ''), '<!--[\\s\\S]*?-->', '', 'g'), '</?div[^>]*>', '', 'g'), '!\\[[^\\]]*\\]\\([^)]*\\)', '', 'g'), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as t from documents)"""
)
def clean_markup(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.lit("---\nid: "), F.col("doc_id").cast("string"), F.lit('\n---\n<div class="x">'), "text", F.lit("</div><!-- "), "lang", F.lit(" -->![img](a/b.png)"))
    return read(spark, sf_dir, "documents").select("doc_id", X.clean_markdown(raw).alias("t")).select("doc_id", F.length("t").cast("long").alias("n"), F.md5("t").alias("text_md5"))


def _parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.parse_pages(read(spark, sf_dir, "pages")).withColumn("page_id", F.col("module_id").cast("long"))


def _plain(c: str) -> str:
    """SQL of a page's text with its entities read and its spaces collapsed."""
    return f"trim(regexp_replace(replace(replace(replace(replace(replace({c}, '&lt;', '<'), '&gt;', '>'), '&quot;', chr(34)), '&#x27;', chr(39)), '&amp;', '&'), '\\s+', ' ', 'g'))"


@query(f"select page_id, coalesce(nullif({_plain("regexp_extract(html, '<title>([^<]*)</title>', 1)")}, ''), nullif({_plain("regexp_extract(html, '<h1>([^<]*)</h1>', 1)")}, ''), 'Untitled') as title from pages")
def parse_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parsed(spark, sf_dir).select("page_id", "title")


@query(
    f"""with h as (select page_id, string_split(regexp_replace(html, '(?s)<(footer|nav|script|style|figure)[^>]*>.*?</(footer|nav|script|style|figure)>', '', 'g'), '<b>') as parts from pages),
t as (select page_id, unnest(parts[2:]) as part, generate_subscripts(parts[2:], 1) as pos, len(parts) - 1 as n from h),
b as (select page_id, pos, case when contains(part, '</b>') then left(part, strpos(part, '</b>') - 1) when pos = n then part end as raw from t),
f as (select page_id, {_plain("regexp_replace(raw, '<[^>]*>', '', 'g')")} as term, min(pos) as pos from b where raw is not null group by 1, 2),
k as (select *, row_number() over (partition by page_id order by pos) as n from f where term <> '' and len(string_split(term, ' ')) <= 4)
select p.page_id, coalesce(string_agg(term, '|' order by pos) filter (where n <= 50), '') as terms from pages p left join k on k.page_id = p.page_id group by p.page_id"""
)
def key_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parsed(spark, sf_dir).select("page_id", F.array_join("key_terms", "|").alias("terms"))


_SECTIONED = f"""with h as (select page_id, regexp_replace(html, '</?(b|i|em|strong|br|a|span)( [^>]*)?/?>', '', 'g') as html from pages),
b as (select page_id, unnest(regexp_extract_all(html, '<(h[23]|p)>[^<]*', 0)) as block, generate_subscripts(regexp_extract_all(html, '<(h[23]|p)>[^<]*', 0), 1) as pos from h),
t as (select page_id, pos, block[2:2] as kind, {_plain("substr(block, strpos(block, '>') + 1)")} as text from b),
s as (select page_id, pos, kind, text, last_value(case when kind = 'h' and text <> '' then text end ignore nulls) over (partition by page_id order by pos rows unbounded preceding) as section from t),
paragraphs as (select page_id, (row_number() over (partition by page_id order by pos))::integer as place, coalesce(section, 'Introduction') as section, text from s where kind = 'p' and length(text) > 20)"""


@query(f"{_SECTIONED} select * from paragraphs")
def paragraphs_sectioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _parsed(spark, sf_dir).select("page_id", F.posexplode("paragraphs").alias("n", "p"))
    return rows.select("page_id", (F.col("n") + 1).alias("place"), F.col("p.section").alias("section"), F.col("p.text").alias("text"))


@query()
def parse_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The HTML parser: title, objectives, key terms, paragraphs."""
    return S.parse_pages(read(spark, sf_dir, "pages")).select("module_id", "title", F.size("key_terms").alias("n_terms"), F.size("paragraphs").alias("n_paragraphs"))


@query(f"{_SECTIONED} select page_id || '_p' || (place - 1) as id, page_id::varchar as module_id, section, text from paragraphs")
def normalized_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.normalize(S.parse_pages(read(spark, sf_dir, "pages"))).select("id", "module_id", "section", "text")


@query(f"{_SECTIONED} select count(*) as total_records, count(distinct page_id) as total_modules from paragraphs")
def book_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.summary(S.normalize(S.parse_pages(read(spark, sf_dir, "pages")))).select("total_records", "total_modules")


@query("select page_id, url from pages order by page_id limit 7")
def scan_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.first_records(read(spark, sf_dir, "pages").select("page_id", "url"), 7, [F.col("page_id")])


@query("select page_id, position, file from (select page_id, unnest(f) as file, generate_subscripts(f, 1) - 1 as position from (select page_id, ['m' || page_id || '.md', 'm' || (page_id + 1) || '.md', 'mx.md'] as f from pages))")
def toc_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = lambda c: F.concat(F.lit("* [A](contents/"), c, F.lit(".md)\n"))
    a, b = F.concat(F.lit("m"), F.col("page_id").cast("string")), F.concat(F.lit("m"), (F.col("page_id") + 1).cast("string"))
    text = F.concat(part(a), part(b), F.lit("* [x](other/m.md)\n"), part(a), part(F.lit("mx")))
    return read(spark, sf_dir, "pages").select("page_id", F.posexplode(X.toc_links(text)).alias("position", "file")).select("page_id", F.col("position").cast("long").alias("position"), "file")


@query("select page_id, url as slug from pages")
def preloaded_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    html = F.concat(F.lit('<script>window.__PRELOADED_STATE__ = {"book": {"slug": "'), "url", F.lit('"}};</script>'))
    state = F.from_json(S.preloaded_state(html), "book struct<slug: string>")
    return read(spark, sf_dir, "pages").select("page_id", state["book"]["slug"].alias("slug"))


@query("select 'n' || n_nationkey as id, n_name as title from nation")
def leaf_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    regions = read(spark, sf_dir, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("id"), F.lit(None).cast("string").alias("parent"), F.col("r_name").alias("title"))
    nations = read(spark, sf_dir, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("id"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("parent"), F.col("n_name").alias("title"))
    used = regions.join(nations.select(F.col("parent").alias("id")).distinct(), "id", "left_semi")
    return S.leaf_pages(used.unionByName(nations)).select("id", "title")


_TREE = "select page_id as node, case when page_id >= 5 then page_id // 5 - 1 end as parent, (page_id * 7) % 5 as pos from pages"


@query(
    f"""with recursive n as ({_TREE}), way as (
  select node as root, node, 0 as depth, lpad(pos::varchar, 6, '0') || lpad(node::varchar, 12, '0') as key, pos::varchar as path from n where parent is null
  union all select w.root, n.node, w.depth + 1, w.key || lpad(n.pos::varchar, 6, '0') || lpad(n.node::varchar, 12, '0'), w.path || '/' || n.pos from way w join n on n.parent = w.node)
select root, node, depth, path, row_number() over (partition by root order by key)::integer as place from way where node not in (select parent from n where parent is not null)"""
)
def book_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves of trees in which five pages have one parent, in reading order."""
    page = F.col("page_id")
    nodes = read(spark, sf_dir, "pages").select(page.alias("node"), F.when(page >= 5, F.floor(page / 5) - 1).alias("parent"), (page * 7 % 5).alias("pos"))
    return reading_order(nodes)


@query("select doc_id, case when length(text) > 200 then left(text, 200) || '...' else text end as preview from documents")
def answer_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", X.preview(F.col("text")).alias("preview"))


@query(f"select conv_id, turn, not regexp_matches(regexp_replace(text || ' SET', '''[^'']*''|\"[^\"]*\"', '', 'g'), '(?i)\\b(CREATE|DELETE|DETACH|REMOVE|SET|MERGE|DROP|CALL\\s*\\{{)') as read_only, regexp_matches({low('text')}, '\\b(delete|remove|drop|destroy|truncate|erase|wipe|detach)\\b') as asks from conversations")
def read_only_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", X.read_only(F.concat("text", F.lit(" SET"))).alias("read_only"), X.asks_to_write(F.col("text")).alias("asks"))


@query()
def yake_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keywords of up to three words of every document."""
    return plugins.keywords(read(spark, sf_dir, "documents"), "doc_id", "text", 20).select("id", "name", F.round("score", 9).alias("score"), "rank")


@query()
def entity_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities and noun chunks of every document."""
    return plugins.entities(read(spark, sf_dir, "documents"), "doc_id", "text")


@query()
def embedded_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plugins.embed(read(spark, sf_dir, "documents"), "text").select("doc_id", "embedding")


@query("select doc_id, list_last(string_split(trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), chr(10))) as reply from documents")
def generated_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies of the generator that needs no model: a prompt's last line."""
    return plugins.generate(read(spark, sf_dir, "documents"), "text").select("doc_id", "reply")


def _known(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reliable(top_words(spark, sf_dir).select("name").union(read(spark, sf_dir, "part").select("p_type")).distinct())


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text")


@query()
def extract_ner(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.extract(_texts(spark, sf_dir), _known(spark, sf_dir), "ner")


@query()
def extract_yake(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.extract(_texts(spark, sf_dir), _known(spark, sf_dir), "yake")


@query()
def extract_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.extract(_texts(spark, sf_dir), _known(spark, sf_dir), "ensemble")


@query()
def extract_fulltext(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.extract(_texts(spark, sf_dir), _known(spark, sf_dir), "fulltext")


@query()
def query_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ensemble's five best concepts of each item, or those that it contains."""
    asked = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return E.query_concepts(asked, _known(spark, sf_dir))
