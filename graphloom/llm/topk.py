"""Exact top-k search by exhaustive term-at-a-time accumulation.

A term is a dimension, a posting a vector's non-zero weight in it.  Candidates lie in blocks of bounded size, each an
inverted index; sparse query rows come in bounded blocks too and visit every candidate block.  For each term the
weights of the queries that have it are scattered, times the term's postings, into dense score arrays; a partition
selection keeps k of a block, and a ranked merge k of all blocks.

Edge cases: a vector that is null, or holds null or non-finite components (components that overflow when scaled among
them), or whose id is null, takes no part (an empty one is a vector of zeros); vectors of other lengths are padded with
zeros; ties go to the smaller id; rows that repeat an id are candidates of their own and queries of their own, each with
its own ranking, except that the rows of the query's id are never its candidates; scores beyond the integers that
doubles hold are summed as exact integers, and those beyond 64 bits are the largest or smallest 64-bit number; fewer
than k candidates give fewer rows; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import need, table, tidy

CANDIDATES, QUERIES = 8192, 256


def weights(batch: pa.RecordBatch, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """(places in the batch, one row of whole numbers each) of the vectors that take part."""
    ids, vectors = batch.column(0), batch.column(1)
    ok = np.flatnonzero(pc.and_(ids.is_valid(), vectors.is_valid()).to_numpy(zero_copy_only=False).astype(bool))
    vectors = vectors.take(pa.array(ok))
    flat, sizes = vectors.flatten(), pc.list_value_length(vectors).to_numpy(zero_copy_only=False).astype(np.int64)
    with np.errstate(over="ignore", invalid="ignore"):
        values = np.floor(flat.to_numpy(zero_copy_only=False).astype(np.float64) * scale)
    out = np.zeros((len(sizes), max(1, int(sizes.max(initial=0)))))
    row = np.repeat(np.arange(len(sizes)), sizes)
    column = np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[row, column] = values
    good = np.isfinite(out).all(1)
    return ok[good], out[good]


_PACKED = "place int,width int,ids binary,marks binary,rows binary"
_FOUND = "query_id long,mark long,times long,vec_id long,score long"


def _blocks(scale: float, blocks: int):
    """Candidate rows (place 0..blocks - 1), each with the vectors of a batch that go there; equal ids go to places of
    their own, one after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows = weights(batch, scale)
            ids = batch.column(0).fill_null(0).to_numpy()[at]
            order = np.argsort(ids, kind="stable")
            begin = np.searchsorted(ids[order], ids[order])
            again = np.empty(len(ids), np.int64)
            again[order] = np.arange(len(ids)) - begin
            place = ((ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) + again) % blocks
            order = np.argsort(place, kind="stable")
            ends = np.searchsorted(place[order], np.arange(blocks + 1))
            groups = [(i, order[ends[i] : ends[i + 1]]) for i in np.flatnonzero(np.diff(ends))]
            yield table(_PACKED, place=[p for p, _ in groups], width=[rows.shape[1]] * len(groups), ids=[ids[g].astype(np.int64).tobytes() for _, g in groups], marks=[b""] * len(groups), rows=[rows[g].tobytes() for _, g in groups])

    return run


def _asking(scale: float):
    """Query rows (id, vector, mark, times), with up to QUERIES vectors each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows = weights(batch, scale)
            ids = batch.column(0).fill_null(0).to_numpy()[at].astype(np.int64)
            marks = np.stack([batch.column(i).to_numpy()[at] for i in (2, 3)], 1).astype(np.int64)
            groups = [slice(i, i + QUERIES) for i in range(0, len(ids), QUERIES)]
            yield table(_PACKED, place=[-1] * len(groups), width=[rows.shape[1]] * len(groups), ids=[ids[g].tobytes() for g in groups], marks=[marks[g].tobytes() for g in groups], rows=[rows[g].tobytes() for g in groups])

    return run


def _stacked(blobs: list[tuple[int, bytes, bytes]]) -> tuple[np.ndarray, np.ndarray]:
    width = max(w for w, _, _ in blobs)
    ids = np.concatenate([np.frombuffer(i, np.int64) for _, i, _ in blobs])
    out, at = np.zeros((len(ids), width)), 0
    for w, i, r in blobs:
        n = len(i) // 8
        out[at : at + n, :w] = np.frombuffer(r, np.float64).reshape(n, w)
        at += n
    return ids, out


class Block:
    """Postings of the candidates of one block."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, rows = ids[order], rows[order]
        self.most = float(np.abs(rows).sum(1).max(initial=0))
        self.postings = [(at, rows[at, t].copy()) for t in range(rows.shape[1]) for at in (np.flatnonzero(rows[:, t]),)]
        self.full = [len(at) == len(ids) for at, _ in self.postings]

    def search(self, ids: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place of the query, candidate ids, scores) of the k best of each query here."""
        out = []
        for lo in range(0, len(ids), 64):
            query_ids, queries = ids[lo : lo + 64], rows[lo : lo + 64]
            scores = self._scores(queries)
            for q, query in enumerate(query_ids):
                score = scores[q]
                own = np.ones(len(score), bool)
                own[slice(*np.searchsorted(self.ids, [query, query + 1]))] = False
                # places are in order of id, so of equal scores at the border the first are taken
                at = np.flatnonzero(own)
                score = score[at]
                if len(score) > k:
                    border = np.partition(score, len(score) - k)[len(score) - k]
                    over, even = np.flatnonzero(score > border), np.flatnonzero(score == border)
                    best = np.concatenate((over, even[: k - len(over)]))
                else:
                    best = np.arange(len(score))
                out.append((np.full(len(best), lo + q), self.ids[at[best]], score[best].astype(np.int64)))
        return tuple(np.concatenate([o[i] for o in out]) if out else np.zeros(0, np.int64) for i in range(3))

    def _scores(self, queries: np.ndarray) -> np.ndarray:
        """Dense scores of each query: doubles where they hold every sum exactly, else clipped exact integers."""
        exact = self.most * np.abs(queries).max(initial=0) < 2**53
        scores = np.zeros((len(queries), len(self.ids)), np.float64 if exact else object)
        for t, (at, weight) in enumerate(self.postings[: queries.shape[1]]):
            has = np.flatnonzero(queries[:, t])
            if not len(has) or not len(at):
                continue
            if not exact:
                weight = np.array([int(x) for x in weight], object)
            for q in has:  # one scatter a query row: no copy of all scores
                asked = queries[q, t] if exact else int(queries[q, t])
                if self.full[t]:
                    scores[q] += asked * weight
                else:
                    scores[q, at] += asked * weight
        return scores if exact else np.clip(scores, -(2**63), 2**63 - 1).astype(np.int64)


def _search(k: int):
    """Rows in order of place, candidates before queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, held, block = None, [], None
        for batch in batches:
            for p, asks, width, ids, marks, rows in zip(*(c.to_pylist() for c in batch.columns)):
                if p != place:
                    place, held, block = p, [], None
                if not asks:
                    held.append((width, ids, rows))
                    continue
                if not held:
                    continue
                block = block or Block(*_stacked(held))
                asked, asking = _stacked([(width, ids, rows)])
                query, found, score = block.search(asked, asking, k)
                mark, times = np.frombuffer(marks, np.int64).reshape(-1, 2)[query].T
                yield table(_FOUND, query_id=asked[query], mark=mark, times=times, vec_id=found, score=score)

    return run


def search(vectors: DataFrame, k: int = 5, every: int = 50, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for every row whose id is divisible by every, the k highest inner products with
    the rows of all other ids, of components floor(scale * x).

    Equal query rows are searched for once, and their result comes as often as they do.
    """
    rows = need(vectors, **{id_col: "long", vector_col: "array<double>"})
    blocks = max(1, -(-rows.count() // CANDIDATES))
    candidates = rows.mapInArrow(tidy(_blocks(scale, blocks)), _PACKED.replace(",", ", ")).withColumn("asks", F.lit(False))
    asked = rows.where(F.col(id_col) % every == 0).select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector"), F.xxhash64(vector_col).alias("mark"))
    times = asked.groupBy("id", "vector", "mark").agg(F.count(F.lit(1)).alias("times")).select("id", "vector", "mark", "times")
    queries = times.mapInArrow(tidy(_asking(scale)), _PACKED.replace(",", ", "))
    queries = queries.withColumn("place", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("asks", F.lit(True))
    ordered = candidates.unionByName(queries).select("place", "asks", "width", "ids", "marks", "rows").repartition(blocks, "place").sortWithinPartitions("place", "asks")
    found = ordered.mapInArrow(tidy(_search(k)), _FOUND.replace(",", ", "))
    best = Window.partitionBy("query_id", "mark").orderBy(F.desc("score"), "vec_id")
    found = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return found.withColumn("_", F.explode(F.sequence(F.lit(1), F.col("times")))).select("query_id", "rank", "vec_id", "score")
