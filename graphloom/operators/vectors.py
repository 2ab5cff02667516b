"""Nearest neighbours of many vectors: exact, and by a hierarchical navigable small-world index of shards.

Exact: a side of at most SMALL rows (counted) is broadcast to a scan of the other; two large sides meet in blocks, each
block of vectors in one place, which all blocks of queries visit.  Either way a task gives k rows a query and block.

Index: vectors are dealt over shards of bounded size.  A task builds a shard's graph: every node draws its top layer,
its candidates in a layer are its nearest among the nodes before it, of which those stay that are nearer to it than to
one that stays already, and links go both ways up to a cap.  A search enters each shard at its topmost node, walks down
greedily and keeps a beam in the lowest layer; all queries of a block step together.  The k best of each shard are
merged.  The index is a table, one row a vector, and may be written and read as any other.

Vectors that are null, empty or hold null or non-finite entries take no part; those without length have no direction
and are similar to nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

SMALL, BLOCK, ROWS = 4096, 8192, 1024
#: Links of a node (twice as many in the lowest layer), candidates of a new node, beam of a search: fixed values.
M, EF_CONSTRUCTION, EF_SEARCH = 24, 128, 100


def matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(places, rows) of the vectors that take part; they have the length of the first."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    ok = np.flatnonzero(sizes > 0)
    if not len(ok):
        return ok, np.zeros((0, 0))
    width = int(sizes[ok[0]])
    if (sizes[ok] != width).any():
        raise ValueError("vectors of different lengths")
    rows = column.take(pa.array(ok)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)
    good = np.isfinite(rows).all(1)
    return ok[good], rows[good]


def similarity(rows: np.ndarray, asked: np.ndarray, digits: int, epsilon: float) -> np.ndarray:
    """Rounded cosines of each row with each of the asked; nan where a length is 0."""
    with np.errstate(divide="ignore", invalid="ignore"):
        lengths = np.sqrt((rows * rows).sum(1))[:, None] * np.sqrt((asked * asked).sum(1))[None, :]
        return np.round((rows @ asked.T) / (lengths + epsilon), digits)


def places(ids: pa.Array) -> np.ndarray:
    """Place of each id in their order."""
    out = np.empty(len(ids), np.int64)
    out[pc.sort_indices(ids).to_numpy()] = np.arange(len(ids))
    return out


def best(scores: np.ndarray, order: np.ndarray, k: int | None, least: float | None) -> np.ndarray:
    """The k highest finite scores of least or more, ties by order, highest first."""
    good = np.flatnonzero(np.isfinite(scores) if least is None else scores >= least)
    if k is not None and len(good) > k:
        border = np.partition(scores[good], len(good) - k)[len(good) - k]
        good = good[scores[good] >= border]
    return good[np.lexsort((order[good], -scores[good]))][:k]


class _Out(NamedTuple):
    """Schema of hits, with the ids' own types."""

    spark: str
    arrow: pa.Schema

    @classmethod
    def of(cls, vectors: DataFrame, id_col: str, queries: DataFrame) -> _Out:
        text = f"query_id {queries.schema['query_id'].dataType.simpleString()}, id {vectors.schema[id_col].dataType.simpleString()}, score double"
        return cls(text, to_arrow_schema(T._parse_datatype_string(text)))

    def batch(self, queries: pa.Array, ids: pa.Array, found: list[tuple[int, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        """found: place of the query, places of its hits, their scores."""
        q = np.concatenate([np.full(len(at), i) for i, at, _ in found]) if found else np.zeros(0, np.int64)
        at, scores = (np.concatenate([f[i] for f in found]) if found else np.zeros(0) for i in (1, 2))
        return pa.RecordBatch.from_arrays([queries.take(pa.array(q, pa.int64())).cast(self.arrow.field(0).type), ids.take(pa.array(at, pa.int64())).cast(self.arrow.field(1).type), pa.array(scores, pa.float64())], schema=self.arrow)


def _flat(column) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def _small(df: DataFrame, names: tuple[str, str]) -> pa.Table | None:
    """The two columns if df has no more than SMALL rows."""
    found = df.select(*[F.col(n).alias(a) for n, a in zip(names, ("key", "vector"))]).limit(SMALL + 1).toArrow()
    return found if found.num_rows <= SMALL else None


def knn_many(vectors: DataFrame, queries: DataFrame, k: int | None, id_col: str, vector_col: str, digits: int = 6, least: float | None = None, epsilon: float = 0.0) -> DataFrame:
    """query_id, id, score, rank: the k rows most similar to each of the queries (query_id, vector), or all for None; with
    least, only those of this score or more; ties by id."""
    out = _Out.of(vectors, id_col, queries)
    vectors = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector"))
    queries = queries.select("query_id", "vector")
    if (few := _small(queries, ("query_id", "vector"))) is not None:
        found = vectors.mapInArrow(_over(few, out, k, digits, least, epsilon, rows_ask=False), out.spark)
    elif (few := _small(vectors, ("id", "vector"))) is not None:
        found = queries.mapInArrow(_over(few, out, k, digits, least, epsilon, rows_ask=True), out.spark)
    else:
        n = max(1, -(-vectors.count() // BLOCK))
        found = _met(vectors, queries, n).mapInArrow(_blocks(out, k, digits, least, epsilon), out.spark)
    return ranked_hits(found, k)


def ranked_hits(found: DataFrame, k: int | None) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    ranked = found.withColumn("rank", F.row_number().over(order))
    return ranked if k is None else ranked.where(F.col("rank") <= k)


def _over(few: pa.Table, out: _Out, k: int | None, digits: int, least: float | None, epsilon: float, rows_ask: bool):
    """A scan of one side, against all of the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _flat(few.column(0))
        at, here = matrix(few.column(1))
        own = own.take(pa.array(at))
        order = places(own)
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                part = batch.slice(lo, ROWS)
                at, rows = matrix(part.column(1))
                if not len(rows) or not len(here):
                    continue
                ids = part.column(0).take(pa.array(at))
                scores = similarity(rows, here, digits, epsilon)
                if rows_ask:
                    found = [(i, b, scores[i][b]) for i in range(len(rows)) for b in (best(scores[i], order, k, least),)]
                    yield out.batch(ids, own, found)
                else:
                    mine = places(ids)
                    found = [(j, b, scores[b, j]) for j in range(len(here)) for b in (best(scores[:, j], mine, k, least),)]
                    yield out.batch(own, ids, found)

    return run


def _met(vectors: DataFrame, queries: DataFrame, n: int) -> DataFrame:
    """Rows place, asks, query_id, id, vector: in each of n places a part of the vectors, and then all queries."""
    here = vectors.select(F.pmod(F.xxhash64("id"), F.lit(n)).cast("int").alias("place"), F.lit(False).alias("asks"), F.lit(None).cast(queries.schema["query_id"].dataType).alias("query_id"), "id", F.col("vector").cast("array<double>").alias("vector"))
    asked = queries.select(F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("place"), F.lit(True).alias("asks"), "query_id", F.lit(None).cast(vectors.schema["id"].dataType).alias("id"), F.col("vector").cast("array<double>").alias("vector"))
    return here.unionByName(asked).repartition(n, "place").sortWithinPartitions("place", "asks")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bool, pa.RecordBatch]]:
    """Parts of batches (place, asks, ...) of one place and kind."""
    for batch in batches:
        place, asks = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        if not len(place):
            continue
        cuts = np.flatnonzero((np.diff(place) != 0) | (np.diff(asks.astype(np.int8)) != 0)) + 1
        for lo, hi in zip([0, *cuts], [*cuts, len(place)]):
            yield int(place[lo]), bool(asks[lo]), batch.slice(lo, hi - lo)


def _blocks(out: _Out, k: int | None, digits: int, least: float | None, epsilon: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, held, block = -1, [], None
        for p, asks, part in _runs(batches):
            if p != place:
                place, held, block = p, [], None
            if not asks:
                held.append(part)
                continue
            if block is None:
                whole = pa.Table.from_batches(held) if held else None
                at, rows = matrix(whole.column("vector")) if whole is not None else (None, np.zeros((0, 0)))
                ids = _flat(whole.column("id")).take(pa.array(at)) if len(rows) else None
                block = (rows, ids, places(ids) if len(rows) else None)
            rows, ids, order = block
            for lo in range(0, part.num_rows, 256):
                asked = part.slice(lo, 256)
                at, asking = matrix(asked.column("vector"))
                if len(rows) and len(asking):
                    scores = similarity(asking, rows, digits, epsilon)
                    yield out.batch(asked.column("query_id").take(pa.array(at)), ids, [(i, b, scores[i][b]) for i in range(len(asking)) for b in (best(scores[i], order, k, least),)])

    return run


# --------------------------------------------------------------------------- index


def spaced(node: np.ndarray, near: np.ndarray, order: np.ndarray, keep: int) -> np.ndarray:
    """Of the candidates near each node (rows, unit vectors, best first; order holds their numbers, -1 for none) up to
    keep that are nearer to the node than to a kept one: their numbers, the rest -1."""
    own = np.einsum("bd,bcd->bc", node, near)
    between = near @ near.transpose(0, 2, 1)
    gone = order < 0
    kept = np.zeros_like(gone)
    for c in range(order.shape[1]):
        new = ~gone[:, c] & (kept.sum(1) < keep)
        kept[:, c] = new
        gone |= new[:, None] & (between[:, c] > own)
    out = np.full((len(order), keep), -1, np.int64)
    at = np.cumsum(kept, 1) - 1
    row, column = np.nonzero(kept)
    out[row, at[row, column]] = order[row, column]
    return out


def _layer(rows: np.ndarray, m: int, cap: int, ef: int, block: int = 64) -> np.ndarray:
    """Links of one layer's nodes (unit vectors in the order in which they come), cap for each, the rest -1."""
    n = len(rows)
    forward = np.full((n, m), -1, np.int64)
    for lo in range(0, n, block):
        hi = min(lo + block, n)
        scores = rows[lo:hi] @ rows[:hi].T
        scores[np.arange(hi)[None, :] >= np.arange(lo, hi)[:, None]] = -np.inf  # nodes before it alone
        c = min(ef, hi)
        top = np.argpartition(-scores, c - 1, axis=1)[:, :c]
        value = np.take_along_axis(scores, top, 1)
        by = np.argsort(-value, axis=1, kind="stable")
        top, value = np.take_along_axis(top, by, 1), np.take_along_axis(value, by, 1)
        top[~np.isfinite(value)] = -1
        forward[lo:hi] = spaced(rows[lo:hi], rows[top], top, m)
    row, column = np.nonzero(forward >= 0)
    ends = forward[row, column]
    pairs = np.unique(np.concatenate([np.stack([row, ends], 1), np.stack([ends, row], 1)]), axis=0)
    links = np.full((n, cap), -1, np.int64)
    first = np.searchsorted(pairs[:, 0], np.arange(n + 1))
    for i in range(n):
        own = pairs[first[i] : first[i + 1], 1]
        if len(own) > cap:  # the cap takes the spaced ones, nearest first
            own = own[np.argsort(-(rows[own] @ rows[i]), kind="stable")[: 4 * cap]]
            chosen = spaced(rows[i][None], rows[own][None], own[None], cap)[0]
            chosen = chosen[chosen >= 0]
            own = np.concatenate([chosen, own[~np.isin(own, chosen)][: cap - len(chosen)]])
        links[i, : len(own)] = own
    return links


def build(rows: np.ndarray, m: int, ef: int, seed: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """(top layer of each node, links of each layer by node) of unit vectors; the first node is in all layers."""
    rng = np.random.default_rng(seed)
    level = np.floor(-np.log(rng.uniform(1e-12, 1, len(rows))) / np.log(m)).astype(np.int64)
    if len(level):
        level[0] = level.max()
    links = []
    for layer in range(int(level.max(initial=-1)) + 1):
        own = np.flatnonzero(level >= layer)
        local = _layer(rows[own], m, m if layer else 2 * m, ef)
        out = np.full((len(rows), local.shape[1]), -1, np.int64)
        out[own] = np.where(local >= 0, own[local], -1)
        links.append(out)
    return level, links


def search(rows: np.ndarray, links: list[np.ndarray], asked: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, similarities) in each query's beam of ef, in no order; -1 where it isn't full.  Queries step together."""
    q = len(asked)
    here = np.zeros(q, np.int64)
    score = rows[here[:1]] @ asked.T
    score = score[0]
    for layer in reversed(links[1:]):
        moving = np.ones(q, bool)
        while moving.any():
            at = np.flatnonzero(moving)
            near = layer[here[at]]
            value = np.where(near >= 0, np.einsum("qd,qcd->qc", asked[at], rows[near]), -np.inf)
            top = value.argmax(1)
            better = value[np.arange(len(at)), top] > score[at]
            moving[at[~better]] = False
            here[at[better]] = near[better, top[better]]
            score[at[better]] = value[better, top[better]]
    beam, values, open_ = np.full((q, ef), -1, np.int64), np.full((q, ef), -np.inf), np.zeros((q, ef), bool)
    beam[:, 0], values[:, 0], open_[:, 0] = here, score, True
    seen = np.zeros((q, len(rows)), bool)
    seen[np.arange(q), here] = True
    while True:
        at = np.flatnonzero(open_.any(1))
        if not len(at):
            return beam, values
        pick = np.where(open_[at], values[at], -np.inf).argmax(1)
        open_[at, pick] = False
        near = links[0][beam[at, pick]]
        fresh = (near >= 0) & ~seen[at[:, None], near]
        seen[at[:, None], near] |= near >= 0
        value = np.where(fresh, np.einsum("qd,qcd->qc", asked[at], rows[near]), -np.inf)
        every = np.concatenate([values[at], value], 1)
        keep = np.argpartition(-every, ef - 1, axis=1)[:, :ef]
        values[at] = np.take_along_axis(every, keep, 1)
        beam[at] = np.take_along_axis(np.concatenate([beam[at], np.where(fresh, near, -1)], 1), keep, 1)
        open_[at] = np.take_along_axis(np.concatenate([open_[at], fresh], 1), keep, 1)


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.sqrt((rows * rows).sum(1, keepdims=True))


def build_index(vectors: DataFrame, id_col: str, vector_col: str, m: int = M, ef_construction: int = EF_CONSTRUCTION, shard_rows: int = 16384, seed: int = 0) -> DataFrame:
    """The index as a table: shard, node, id, vector, level, links (an array for each layer up to the node's own).

    A vector's shard is the hash of its id, so shards hold about shard_rows; write the table and read it for later
    searches.  Rows that repeat an id lie in one shard."""
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector"))
    shards = max(1, -(-rows.count() // shard_rows))
    rows = rows.select(F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("shard"), "id", F.col("vector").cast("array<double>").alias("vector"))
    schema = f"shard int, node int, id {rows.schema['id'].dataType.simpleString()}, vector array<double>, level int, links array<array<int>>"
    arrow = to_arrow_schema(T._parse_datatype_string(schema))

    def graph(group: pa.Table) -> pa.Table:
        at, vectors = matrix(group.column("vector"))
        long = (vectors * vectors).sum(1) > 0 if len(vectors) else np.zeros(0, bool)
        group, vectors = group.take(pa.array(at[long])), vectors[long]
        if not len(vectors):
            return arrow.empty_table()
        shuffle = np.lexsort((places(_flat(group.column("id"))), np.random.default_rng(seed).random(len(vectors))))
        group, vectors = group.take(pa.array(shuffle)), vectors[shuffle]
        level, links = build(_unit(vectors), m, ef_construction, seed)
        lists = [[layer[i][layer[i] >= 0].tolist() for layer in links[: level[i] + 1]] for i in range(len(level))]
        columns = [group.column("shard"), pa.array(np.arange(len(level)), pa.int32()), group.column("id"), group.column("vector"), pa.array(level, pa.int32()), pa.array(lists, arrow.field("links").type)]
        return pa.Table.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow)], schema=arrow)

    return rows.groupBy("shard").applyInArrow(graph, schema)


def search_index(index: DataFrame, queries: DataFrame, k: int, ef: int = EF_SEARCH, digits: int = 6, exact: bool = False) -> DataFrame:
    """query_id, id, score, rank: about the k rows of the index most similar to each of the queries (query_id, vector);
    exact: compared with every row of every shard.

    A shard's rows lie in one place in order of node, and every block of queries visits it."""
    out = _Out.of(index, "id", queries)
    shards = (index.agg(F.max("shard").alias("n")).first().n or 0) + 1
    kinds = {c: index.schema[c].dataType for c in ("node", "id", "vector", "level", "links")}
    here = index.select(F.col("shard").alias("place"), F.lit(False).alias("asks"), F.lit(None).cast(queries.schema["query_id"].dataType).alias("query_id"), *kinds)
    empty = [F.lit(None).cast(t).alias(c) for c, t in kinds.items() if c != "vector"]
    asked = queries.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("place"), F.lit(True).alias("asks"), "query_id", F.col("vector").cast("array<double>").alias("vector"), *empty)
    met = here.unionByName(asked).repartition(shards, "place").sortWithinPartitions("place", "asks", "node")
    return ranked_hits(met.mapInArrow(_visit(out, k, max(ef, k), digits, exact), out.spark), k)


def _visit(out: _Out, k: int, ef: int, digits: int, exact: bool):
    def load(held: list[pa.RecordBatch]):
        whole = pa.Table.from_batches(held)
        _, rows = matrix(whole.column("vector"))
        level = whole.column("level").to_numpy()
        links = [np.full((len(rows), 0), -1, np.int64) for _ in range(int(level.max()) + 1)]
        if not exact:
            lists = _flat(whole.column("links"))
            sizes = pc.list_value_length(lists.flatten()).to_numpy(zero_copy_only=False)
            flat, layer_of = lists.flatten().flatten().to_numpy(), np.concatenate([np.arange(x + 1) for x in level])
            node_of, first = np.repeat(np.arange(len(level)), level + 1), np.concatenate([[0], np.cumsum(sizes)])
            for layer in range(len(links)):
                at = np.flatnonzero(layer_of == layer)
                links[layer] = np.full((len(rows), max(1, int(sizes[at].max()))), -1, np.int64)
                own = np.repeat(at, sizes[at])
                place = np.arange(len(own)) - np.repeat(np.cumsum(sizes[at]) - sizes[at], sizes[at])
                links[layer][node_of[own], place] = flat[first[own] + place]
        ids = _flat(whole.column("id"))
        return rows, _unit(rows), links, ids, places(ids)

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
            shard = shard or load(held)
            rows, unit, links, ids, order = shard
            for lo in range(0, part.num_rows, 128):
                asked = part.slice(lo, 128)
                at, asking = matrix(asked.column("vector"))
                keep = (asking * asking).sum(1) > 0 if len(asking) else np.zeros(0, bool)
                at, asking = at[keep], asking[keep]
                if not len(asking):
                    continue
                found = []
                beams = None if exact else search(unit, links, _unit(asking), ef)[0]
                for i in range(len(asking)):
                    near = np.arange(len(rows)) if exact else beams[i][beams[i] >= 0]
                    scores = similarity(asking[i : i + 1], rows[near], digits, 0.0)[0]
                    b = best(scores, order[near], k, None)
                    found.append((i, near[b], scores[b]))
                yield out.batch(asked.column("query_id").take(pa.array(at)), ids, found)

    return run


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """query_id, recall: share of the exact hits (query_id, id) that were found."""
    hits = found.select("query_id", "id", F.lit(1.0).alias("hit"))
    return exact.select("query_id", "id").join(hits, ["query_id", "id"], "left").groupBy("query_id").agg(F.avg(F.coalesce("hit", F.lit(0.0))).alias("recall"))
