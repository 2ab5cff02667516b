"""Line deduplication with per-document keep bitmaps.

Every batch of documents settles its own repeats first: of a key it sends one row, for its smallest doc_id.  These
rows are range-partitioned by the key's hash and the document and sorted within; one pass over a partition streams the
first occurrence of each key and names the losers.  A key that a third of all documents hold costs one row a batch, not
one a document, and may fill many partitions: what each partition holds first of its first and its last key stands in a
small table besides, in which the holder before all others is found.  What comes back is a compressed bitmap per document
that loses lines.

Edge cases: a null or empty text is one empty line; keys shorter than min_chars code points never drop; very long texts
and lines are read whole; of rows with the same doc_id each keeps its own lines (they count as one document); rows
without doc_id keep all lines and hold none; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, fanout, free, map_rows, need, scratch, slices, table, text_bytes, tidy

_TRIM = b" \t\n\x0b\x0c\r"
_OFFERS = "kind int, high long, low long, doc_id long, row_id long, positions binary"


def _code_points(b: bytes) -> int:
    return len(b) if b.isascii() else len(b.decode())


def _offers(min_chars: int):
    """Rows of kind 0 (a key of this batch, with its smallest document's lines) and 1 (lines already lost here)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offs = text_bytes(batch.column(1))
            ids, rows = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            raw = buf.tobytes()
            for lo, hi in slices(offs, 4 << 20):
                first: dict[bytes, tuple[int, list]] = {}
                lost: dict[int, list[int]] = {}
                for i in range(lo, hi):
                    if (doc := ids[i]) is None:
                        continue
                    for at, line in enumerate(raw[offs[i] : offs[i + 1]].split(b"\n")):
                        key = line.strip(_TRIM).lower()
                        if len(key) < min_chars or (len(key) < 4 * min_chars and _code_points(key) < min_chars):
                            continue
                        h = xxhash.xxh3_128_digest(key)
                        held = first.get(h)
                        if held is None or doc < held[0]:
                            if held is not None:
                                for r, p in held[1]:
                                    lost.setdefault(r, []).append(p)
                            first[h] = (doc, [(i, at)])
                        elif doc == held[0]:
                            held[1].append((i, at))
                        else:
                            lost.setdefault(i, []).append(at)
                kind, high, low, doc_id, row_id, positions = [], [], [], [], [], []
                for h, (doc, at) in first.items():
                    by_row: dict[int, list[int]] = {}
                    for r, p in at:
                        by_row.setdefault(r, []).append(p)
                    for r, p in by_row.items():
                        kind.append(0)
                        high.append(int.from_bytes(h[:8], "big", signed=True))
                        low.append(int.from_bytes(h[8:], "big", signed=True))
                        doc_id.append(doc)
                        row_id.append(rows[r])
                        positions.append(np.array(p, np.uint32).tobytes())
                for r, p in lost.items():
                    kind.append(1)
                    high.append(0)
                    low.append(0)
                    doc_id.append(ids[r])
                    row_id.append(rows[r])
                    positions.append(np.array(p, np.uint32).tobytes())
                yield table(_OFFERS, kind=kind, high=high, low=low, doc_id=doc_id, row_id=row_id, positions=positions)

    return run


_LOST = "high long, low long, doc_id long, row_id long, positions binary, border boolean"


def _losers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows in order of key and document: those whose document isn't the key's first here.  Marked as border: those of
    the first document of the first key, which an earlier partition may hold, and a row that names the last key and its
    first document, for a later partition."""
    opening = last = None
    holder = 0
    for batch in batches:
        high, low, doc = (batch.column(i).to_numpy() for i in range(3))
        if not len(doc):
            continue
        opening = opening or (high[0], low[0])
        fresh = np.concatenate(([(high[0], low[0]) != last], (high[1:] != high[:-1]) | (low[1:] != low[:-1])))
        at = np.maximum.accumulate(np.where(fresh, np.arange(len(doc)), -1))
        own = np.where(at >= 0, doc[np.maximum(at, 0)], holder)
        last, holder = (high[-1], low[-1]), own[-1]
        lost = doc > own
        out = lost | ((high == opening[0]) & (low == opening[1]))
        chosen = batch.filter(pa.array(out))
        yield pa.RecordBatch.from_arrays([*chosen.columns, pa.array(~lost[out])], [*batch.schema.names, "border"])
    if last:
        yield table(_LOST, high=[last[0]], low=[last[1]], doc_id=[holder], row_id=[None], positions=[None], border=[True])


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out, n = [], []
        for parts in batch.column(2).to_pylist():
            lost = np.unique(np.concatenate([np.frombuffer(p, np.uint32) for p in parts]))
            bits = np.zeros(int(lost[-1]) + 1, bool)
            bits[lost] = True
            n.append(len(lost))
            out.append(zlib.compress(np.packbits(bits, bitorder="little").tobytes(), 6))
        yield table("doc_id long, row_id long, n_dropped long, dropped binary", doc_id=batch.column(0), row_id=batch.column(1), n_dropped=n, dropped=out)


def keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10) -> DataFrame:
    """doc_id, row_id, n_dropped, dropped for the documents that lose lines.

    dropped is a zlib-compressed bitmap (bit i of byte i / 8: line i goes; lines beyond it stay); row_id is the
    xxhash64 of the text, so that a result can be joined with the rows it belongs to (see with_bitmaps).
    """
    rows = need(docs, **{id_col: "long", text_col: "string"}).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    with scratch(docs.sparkSession) as hold:
        offers = hold(cut(rows.select("doc_id", "text", F.xxhash64("text").alias("row_id")).mapInArrow(tidy(_offers(min_chars)), _OFFERS)))
        contest = offers.where("kind = 0").select("high", "low", "doc_id", "row_id", "positions")
        contest = contest.repartitionByRange(fanout(docs), "high", "low", "doc_id").sortWithinPartitions("high", "low", "doc_id")
        lost = hold(cut(contest.mapInArrow(tidy(_losers), _LOST)))
    border = lost.where("border").drop("border")
    holders = border.groupBy("high", "low").agg(F.min("doc_id").alias("holder"))
    late = border.where("positions is not null").join(holders, ["high", "low"]).where("doc_id > holder")
    every = [x.select("doc_id", "row_id", "positions") for x in (lost.where("not border"), late, offers.where("kind = 1"))]
    gone = every[0].unionByName(every[1]).unionByName(every[2])
    return gone.groupBy("doc_id", "row_id").agg(F.collect_list("positions").alias("parts")).mapInArrow(tidy(_bitmaps), "doc_id long, row_id long, n_dropped long, dropped binary")


def with_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10) -> tuple[DataFrame, str, str]:
    """docs with two more columns, and their names: how many lines go, and which (null where nothing goes)."""
    with scratch(docs.sparkSession) as hold:
        maps = hold(cut(keep_bitmaps(docs, id_col, text_col, min_chars)))
    doc, row, of, at, n, dropped = free(docs, "_doc", "_row", "_of", "_at", "_n_dropped", "_dropped")
    maps = maps.select(F.col("doc_id").alias(of), F.col("row_id").alias(at), F.col("n_dropped").alias(n), F.col("dropped").alias(dropped))
    keyed = docs.withColumns({doc: F.col(f"`{id_col}`").cast("long"), row: F.xxhash64(F.col(f"`{text_col}`").cast("string"))})
    # always merged: texts move once at any size, and a hot half is split
    same = (keyed[doc] == maps[of]) & (keyed[row] == maps[at])
    return keyed.join(maps.hint("merge"), same, "left").drop(doc, row, of, at), n, dropped


def keep(text: str | None, dropped: bytes | None) -> str:
    """The lines that stay."""
    if not text or dropped is None:
        return text or ""
    bits = zlib.decompress(dropped)
    n = 8 * len(bits)
    return "\n".join([x for i, x in enumerate(text.split("\n")) if i >= n or not bits[i >> 3] >> (i & 7) & 1])


def digest(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256."""
    schema = "doc_id long, n_lines long, n_dropped long, kept_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, n, maps = (c.to_pylist() for c in batch.columns)
            yield table(schema, doc_id=ids, n_lines=[(t or "").count("\n") + 1 for t in texts], n_dropped=[x or 0 for x in n], kept_sha256=[hashlib.sha256(keep(t, m).encode()).hexdigest() for t, m in zip(texts, maps)])

    rows = need(docs, doc_id="long", text="string")
    marked, n, dropped = with_bitmaps(rows, min_chars=min_chars)
    return marked.select("doc_id", "text", n, dropped).mapInArrow(tidy(run), schema)


def deduplicate(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """docs with the kept lines as text; all other columns stay as they are, whatever their names.

    Null and empty texts stay; a row without doc_id keeps all its lines and takes none from others; rows that repeat a
    doc_id keep what the smallest doc_id keeps, all of them; long texts are split whole; an empty table stays empty.
    """
    at, n = docs.columns.index("text"), len(docs.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t if m is None else keep(t, m) for t, m in zip(batch.column(at).to_pylist(), batch.column(n).to_pylist())]
            columns = [pa.array(texts, c.type) if i == at else c for i, c in enumerate(batch.columns[:n])]
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names[:n])

    marked, counted, _ = with_bitmaps(docs, min_chars=min_chars)
    return map_rows(marked.drop(counted), tidy(run), docs.columns)
