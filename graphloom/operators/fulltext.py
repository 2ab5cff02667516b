"""Full text: an inverted index with block maxima, BM25 top-k by MaxScore, terms within an edit distance.

Documents are dealt over shards of bounded size.  A row of the index is a token's postings in a shard: ids in order,
their impacts (BM25 without idf), the largest impact of each block of BLOCK postings and of all.  A search takes the
rows of the tokens asked for to their shards, where all queries visit them.  Terms are taken by what they can bring at
most; once the rest can bring no new document among the k best, only documents that can still get there are looked up,
block by block where the block's maximum lets them.  A shard gives k rows a query, so no other pair of query and
document leaves a task.

Null and empty texts are documents without tokens; rows that repeat an id add up; rows without id count among the
documents and are never found; queries without tokens find nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.text import tokens
from ..params import SETTINGS
from .tables import passing, reliable, spread
from .vectors import _flat, _runs, best

BLOCK = 128
#: Documents in the lists of query tokens that a shard keeps: 24 bytes each.
KEPT = 8 << 20
#: Distinct tokens of queries up to which other words are left out before they are counted.
FEW = 2000


class TextIndex(NamedTuple):
    """postings: shard, token, n, ids, impacts, tops (of blocks), top; and the number and mean size of documents."""

    postings: DataFrame
    n: int
    average: float

    def save(self, path: str) -> None:
        self.postings.write.parquet(f"{path}/postings")
        self.postings.sparkSession.createDataFrame([(self.n, self.average)], "n long, average double").write.parquet(f"{path}/sizes")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> TextIndex:
        return cls(spark.read.parquet(f"{path}/postings"), *spark.read.parquet(f"{path}/sizes").first())


def build_text_index(docs: DataFrame, id_col: str, text_col: str, asked: DataFrame | None = None, near: DataFrame | None = None, k1: float = SETTINGS.bm25_k1, b: float = SETTINGS.bm25_b, shard_docs: int = 65536) -> TextIndex:
    """The index of docs; with asked (token), of those tokens alone, with near, of the terms within the edit distance of a
    token of these queries (query_id, text) alone.  Texts are tokenised once, in place."""
    with passing(docs.sparkSession) as keep:
        words = tokens(F.col(text_col))
        size = F.size("words").alias("dl")
        kept = F.col("words")
        few = [r.token for r in asked.select("token").distinct().limit(FEW + 1).collect()] if asked is not None else []
        if asked is not None and len(few) <= FEW:
            kept = F.filter("words", lambda w: w.isin(*few)) if few else F.array().cast("array<string>")
        rows = spread(docs.select(F.col(id_col), F.col(text_col))).select(F.col(id_col).alias("id"), words.alias("words"))
        rows = reliable(rows.select("id", size, kept.alias("words")))
        sizes = rows.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("average")).first()
        n, average = sizes.n, sizes.average or 1.0
        shard = F.pmod(F.xxhash64("id"), F.lit(max(1, -(-n // shard_docs)))).cast("int")
        terms = rows.where("id is not null").select(shard.alias("shard"), "id", "dl", F.explode("words").alias("token"))
        if near is not None:
            asked = reliable(fuzzy_terms(rows.select(F.explode("words").alias("token")).distinct(), near).select("token").distinct())
        if near is not None or len(few) > FEW:
            terms = terms.join(asked.select("token").distinct(), "token", "left_semi")
        terms = terms.groupBy("shard", "token", "id", "dl").agg(F.count(F.lit(1)).alias("tf"))
        impact = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / average))
        lists = terms.groupBy("shard", "token").agg(F.array_sort(F.collect_list(F.struct("id", impact.alias("impact")))).alias("p"))
        impacts = F.col("p.impact")
        starts = F.sequence(F.lit(1), F.size("p"), F.lit(BLOCK))
        tops = F.transform(starts, lambda i: F.array_max(F.slice(impacts, i, F.lit(BLOCK))))
        postings = lists.select("shard", "token", F.size("p").alias("n"), F.col("p.id").alias("ids"), impacts.alias("impacts"), tops.alias("tops"), F.array_max(impacts).alias("top"))
        return TextIndex(keep(reliable(postings)), n, average)


# --------------------------------------------------------------------------- terms


def edits_of(length: Column) -> Column:
    """Edits that a query token of this length allows: 0 to 2 characters: none, 3 to 5: one, more: two."""
    return F.when(length < 3, 0).when(length < 6, 1).otherwise(2)


def _segment(length: Column, i: Column) -> tuple[Column, Column]:
    """Begin (from 0) and size of segment i of a query token that is cut into one more segment than it allows edits."""
    parts = edits_of(length) + 1
    begin = F.floor(length * i / parts).cast("int")
    return begin, F.floor(length * (i + 1) / parts).cast("int") - begin


def asked_tokens(queries: DataFrame) -> DataFrame:
    """query_id, asked: the distinct tokens of queries (query_id, text)."""
    return queries.select("query_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("asked")).where("asked <> ''")


def fuzzy_terms(vocabulary: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, asked (its token), token (of the vocabulary), edits: terms within the edit distance that the query
    token's length allows.

    Of one segment more than there are edits one is left whole, moved by no more places than there are edits.  So the
    terms meet by an equi-join on segments, whose number doesn't depend on the terms' lengths, and are compared where they
    meet: each query token once, however many queries have it.
    """
    asked = asked_tokens(queries)
    cut = asked.select("asked", F.length("asked").alias("size")).distinct()
    cut = cut.select("asked", "size", F.explode(F.sequence(F.lit(0), edits_of(F.col("size")))).alias("i"))
    begin, size = _segment(F.col("size"), F.col("i"))
    cut = cut.select("asked", "size", "i", F.substring("asked", begin + 1, size).alias("part"))

    known = vocabulary.select("token", F.length("token").alias("n"))
    known = known.select("token", "n", F.explode(F.sequence(F.greatest(F.col("n") - 2, F.lit(1)), F.col("n") + 2)).alias("size"))
    known = known.where(F.abs(F.col("n") - F.col("size")) <= edits_of(F.col("size")))
    known = known.select("token", "n", "size", F.explode(F.sequence(F.lit(0), edits_of(F.col("size")))).alias("i"))
    known = known.select("token", "n", "size", "i", F.explode(F.sequence(-edits_of(F.col("size")), edits_of(F.col("size")))).alias("shift"))
    begin, size = _segment(F.col("size"), F.col("i"))
    known = known.withColumn("at", begin + F.col("shift")).where((F.col("at") >= 0) & (F.col("at") + size <= F.col("n")))
    known = known.select("token", "size", "i", F.substring("token", F.col("at") + 1, size).alias("part"))
    edits = F.levenshtein("asked", "token")
    near = known.join(cut, ["size", "i", "part"]).where(edits <= edits_of(F.length("asked"))).select("asked", "token", edits.alias("edits")).distinct()
    return asked.join(near, "asked").select("query_id", "asked", "token", "edits")


# --------------------------------------------------------------------------- search


class Shard:
    """Postings of the tokens asked for in one shard; documents are numbered in order of id.

    A query token's terms and their weights are the same in every query, so what they bring together is made once and
    kept while KEPT documents of all such lists last.
    """

    def __init__(self, rows: pa.Table):
        lists = _flat(rows.column("ids"))
        coded = pc.dictionary_encode(lists.flatten())
        order = pc.sort_indices(coded.dictionary).to_numpy()
        number = np.empty(len(order), np.int64)
        number[order] = np.arange(len(order))
        self.ids, codes = coded.dictionary.take(pa.array(order)), number[coded.indices.to_numpy()]
        impacts = _flat(rows.column("impacts")).flatten().to_numpy()
        blocks = _flat(rows.column("tops"))
        ends = np.concatenate([[0], np.cumsum(rows.column("n").to_numpy())])
        cuts = np.concatenate([[0], np.cumsum(pc.list_value_length(blocks).to_numpy())])
        tops = blocks.flatten().to_numpy()
        self.lists = {t: (codes[ends[i] : ends[i + 1]], impacts[ends[i] : ends[i + 1]], tops[cuts[i] : cuts[i + 1]]) for i, t in enumerate(rows.column("token").to_pylist())}
        self.scores = np.zeros(len(self.ids))
        self.merged: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        self.room = KEPT

    def list_of(self, asked: str, group: list[tuple[str, float]]) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        """Documents in order, what the best of a query token's terms brings to each, the largest of each block of them."""
        if asked not in self.merged:
            known = [(self.lists[t], w) for t, w in group if t in self.lists]
            if not known:
                return None
            at, own = self._best(known)
            made = at, own, np.maximum.reduceat(own, np.arange(0, len(own), BLOCK))
            if len(at) > self.room:
                return made
            self.room -= len(at)
            self.merged[asked] = made
        return self.merged[asked]

    def top(self, groups: dict[str, list[tuple[str, float]]], k: int | None, digits: int | None) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores) of the k best, or all for None; of a query token's terms the best counts."""
        known = [x for a, g in groups.items() if (x := self.list_of(a, g)) is not None]
        known = sorted(((x[2].max(), x) for x in known), key=lambda x: -x[0])
        rest = np.cumsum([m for m, _ in known][::-1])[::-1].tolist() + [0.0]
        # scores that are equal when rounded are ties: none of them may go before the ids decide
        slack = 10.0**-digits if digits is not None else 0.0
        scores, seen, touched, open_ = self.scores, np.zeros(len(self.ids), bool), np.zeros(0, np.int64), True
        for i, (_, own) in enumerate(known):
            if open_:
                scores[own[0]] += own[1]
                seen[own[0]] = True
                touched = np.flatnonzero(seen)
            else:
                scores[touched] += self._looked_up(own, touched, border - slack - scores[touched] - rest[i + 1])
            if k is not None and len(touched) > k:
                value = scores[touched]
                border = np.partition(value, len(value) - k)[len(value) - k]
                if not open_ or rest[i + 1] < border - slack:
                    open_ = False
                    stays = value + rest[i + 1] >= border - slack
                    scores[touched[~stays]] = 0.0
                    touched = touched[stays]
        value = scores[touched].copy()
        scores[touched] = 0.0
        if digits is not None:
            value = np.round(value, digits)
        b = best(value, touched, k, None)
        return touched[b], value[b]

    def _best(self, group) -> tuple[np.ndarray, np.ndarray]:
        """The best term of each document; a repeated id has one sum for each term."""
        out = np.zeros(len(self.ids))
        for (codes, impacts, _), w in group:
            at, first = np.unique(codes, return_index=True) if len(codes) > 1 and (codes[1:] == codes[:-1]).any() else (codes, None)
            own = w * impacts if first is None else np.add.reduceat(w * impacts, first)
            out[at] = np.maximum(out[at], own)
        at = np.unique(np.concatenate([x[0] for x, _ in group]))
        return at, out[at]

    @staticmethod
    def _looked_up(own, at: np.ndarray, needs: np.ndarray) -> np.ndarray:
        """What a list brings to documents at; where a block's maximum is below what a document needs, nothing."""
        codes, values, tops = own
        place = np.minimum(np.searchsorted(codes, at), len(codes) - 1)
        there = (codes[place] == at) & (tops[place // BLOCK] >= needs)
        return np.where(there, values[place], 0.0)


def _search(kind: pa.Schema, k: int | None, digits: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, held, shard = -1, [], None
        for p, asks, part in _runs(batches):
            if p != place:
                place, held, shard = p, [], None
            if not asks:
                held.append(part)
                continue
            if not held:
                continue
            shard = shard or Shard(pa.Table.from_batches(held))
            found = []
            for i, terms in enumerate(part.column("terms").to_pylist()):
                groups: dict[str, list[tuple[str, float]]] = {}
                for t in terms:
                    groups.setdefault(t["asked"], []).append((t["token"], t["weight"]))
                found.append((i, *shard.top(groups, k, digits)))
                if sum(len(f[1]) for f in found) > 1 << 16:
                    yield _hits(kind, part, shard, found)
                    found = []
            if found:
                yield _hits(kind, part, shard, found)

    return run


def _hits(kind: pa.Schema, part: pa.RecordBatch, shard: Shard, found: list) -> pa.RecordBatch:
    q = np.concatenate([np.full(len(at), i) for i, at, _ in found])
    at, scores = (np.concatenate([f[j] for f in found]) for j in (1, 2))
    return pa.RecordBatch.from_arrays([part.column("query_id").take(pa.array(q, pa.int64())), shard.ids.take(pa.array(at, pa.int64())), pa.array(scores)], schema=kind)


def search_text(index: TextIndex, queries: DataFrame, k: int | None, fuzzy: bool = False, boost: float = 1.0, digits: int = 6) -> DataFrame:
    """query_id, id, score: the k documents of the highest scores for each of the queries (query_id, text) in each shard,
    scores rounded; or all that hold a token, not rounded, for None.  Tokens of a query count once.

    With fuzzy, a query's token also finds the index's terms within its edit distance, each worth 1 - edits / the
    shorter length, and counts in a document by the best of them.
    """
    postings = index.postings
    known = postings.groupBy("token").agg(F.sum("n").alias("df"))
    if fuzzy:
        asked = fuzzy_terms(known, queries).withColumn("boost", 1 - F.col("edits") / F.least(F.length("asked"), F.length("token")))
    else:
        asked = asked_tokens(queries).withColumns({"token": F.col("asked"), "boost": F.lit(1.0)})
    idf = F.log(1 + (index.n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    asked = asked.join(known, "token").select("query_id", "asked", "token", (idf * F.col("boost") * boost).alias("weight"))
    asked = reliable(asked)
    terms = asked.groupBy("query_id").agg(F.collect_list(F.struct("asked", "token", "weight")).alias("terms"))
    wanted = postings.join(asked.select("token").distinct(), "token", "left_semi")
    shards = (postings.agg(F.max("shard").alias("n")).first().n or 0) + 1
    kinds = {c: postings.schema[c].dataType for c in ("token", "n", "ids", "impacts", "tops")}
    here = wanted.select(F.col("shard").alias("place"), F.lit(False).alias("asks"), *kinds, F.lit(None).cast(queries.schema["query_id"].dataType).alias("query_id"), F.lit(None).cast(terms.schema["terms"].dataType).alias("terms"))
    visits = terms.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("place"), F.lit(True).alias("asks"), *[F.lit(None).cast(t).alias(c) for c, t in kinds.items()], "query_id", "terms")
    met = here.unionByName(visits).repartition(shards, "place").sortWithinPartitions("place", "asks")
    schema = T.StructType([T.StructField("query_id", queries.schema["query_id"].dataType), T.StructField("id", kinds["ids"].elementType), T.StructField("score", T.DoubleType())])
    return met.mapInArrow(_search(to_arrow_schema(schema), k, None if k is None else digits), schema)


def bm25(docs: DataFrame, queries: DataFrame, id_col: str, text_col: str, fuzzy: bool = False, k: int | None = None, boost: float = 1.0, index: TextIndex | None = None) -> DataFrame:
    """query_id, id, score: search_text() over an index made for these queries, or over the given one; its rows are k for
    each query and shard, of which the caller takes the first k."""
    asked = None if fuzzy else asked_tokens(queries).select(F.col("asked").alias("token"))
    with passing(docs.sparkSession) as keep:
        return keep(search_text(index or build_text_index(docs, id_col, text_col, asked, queries if fuzzy else None), queries, k, fuzzy, boost))
