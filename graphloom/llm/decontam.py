"""Benchmark decontamination with a generalised suffix automaton of the test items' words.

Items are dealt into shards of a bounded size (an item beyond it in pieces that overlap by a window less one word), and
tasks build each shard's automaton.  A bounded group of shards goes to the tasks that scan the documents; a benchmark of
more shards takes a scan for each group, and the spans that these find are joined by row.  Runs of document words that
occur in any item at all are found with numpy; only those runs pass through the automaton, which tracks the longest
match ending at each word.

Edge cases: null and empty texts have no words; very long texts are streamed whole; an item without words has no window;
an item shorter than the window is one window; repeated items count once per item_id; windows of an item without
item_id hit words but name no item; items with equal windows all count; an empty benchmark hits nothing; an empty table
gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import pickle
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NONWORD, cut, free, map_rows, need, scratch, slices, table, text_bytes, tidy, word_ends, words

#: Bytes of item texts in one shard, some 60 000 words; its automaton takes about ten times that.
SHARD_BYTES = 400_000
#: Shards in one broadcast.
GROUP = 8


class Automaton:
    """Suffix automaton of several word sequences; for each state the items that hold its longest string.

    A state's only move lies in two arrays, the moves of the fewer states with several in a dictionary each.
    """

    def __init__(self, items: list[tuple[int | None, list[int]]], window: int):
        self.window = window
        moves: list[dict[int, int]] = [{}]
        link, length = [-1], [0]
        held: dict[int, set] = {}
        for item, seq in items:
            last = 0
            for i, w in enumerate(seq):
                last = _extended(moves, link, length, last, w)
                if i + 1 >= window and item is not None:
                    held.setdefault(last, set()).add(item)
        whole: dict[int, dict[int, set]] = {}
        for item, seq in items:  # short items are windows of their own
            if 0 < len(seq) < window:
                state = 0
                for w in seq:
                    state = moves[state][w]
                own = whole.setdefault(state, {}).setdefault(len(seq), set())
                if item is not None:
                    own.add(item)
        order = sorted(range(1, len(length)), key=length.__getitem__, reverse=True)
        for s in order:
            if s in held and length[link[s]] >= window:
                held.setdefault(link[s], set()).update(held[s])
        #: Items of the states whose strings are of the window's length first.
        self.items = {s: tuple(x) for s, x in held.items() if length[link[s]] < window}
        #: Short windows that end where a state's strings end: (length, items), the state's own and its suffixes'.
        self.short: dict[int, tuple] = {}
        for s in reversed(order):
            ends = (*((n, tuple(x)) for n, x in whole.get(s, {}).items()), *self.short.get(link[s], ()))
            if ends:
                self.short[s] = ends
        self.link, self.length = array("i", link), array("i", length)
        self.word, self.to = array("i", [-1] * len(link)), array("i", [-1] * len(link))
        self.several: dict[int, dict[int, int]] = {}
        for s, own in enumerate(moves):
            if len(own) == 1:
                ((self.word[s], self.to[s]),) = own.items()
            elif own:
                self.several[s] = own

    def move(self, state: int, w: int) -> int:
        """The state after a word; -1: none."""
        if self.word[state] == w:
            return self.to[state]
        own = self.several.get(state)
        return -1 if own is None else own.get(w, -1)

    def stream(self, seq: list[int]) -> tuple[list[tuple[int, int]], set]:
        """Windows in a sequence of words: (begin, end) of merged spans, and the items they belong to."""
        window, link, length, move = self.window, self.link, self.length, self.move
        state = n = 0
        spans: list[tuple[int, int]] = []
        found: set = set()
        for i, w in enumerate(seq):
            to = move(state, w)
            while to < 0 and state:
                state = link[state]
                n = length[state]
                to = move(state, w)
            if to < 0:
                n = 0
                continue
            state, n = to, n + 1
            widest = 0
            if n >= window:
                widest, s = window, state
                while length[link[s]] >= window:
                    s = link[s]
                found.update(self.items.get(s, ()))
            for size, own in self.short.get(state, ()):
                if size <= n:
                    widest = max(widest, size)
                    found.update(own)
            if widest:
                begin = i + 1 - widest
                while spans and spans[-1][1] >= begin:
                    begin = min(begin, spans.pop()[0])
                spans.append((begin, i + 1))
        return spans, found


def _extended(moves: list[dict[int, int]], link: list[int], length: list[int], last: int, w: int) -> int:
    """The state of last's longest string and a word, made if it isn't there."""

    def state(n: int, own: dict, to: int) -> int:
        moves.append(own)
        length.append(n)
        link.append(to)
        return len(length) - 1

    def split(p: int, q: int) -> int:
        if length[q] == length[p] + 1:
            return q
        copy = state(length[p] + 1, dict(moves[q]), link[q])
        link[q] = copy
        while p >= 0 and moves[p].get(w) == q:
            moves[p][w] = copy
            p = link[p]
        return copy

    if (q := moves[last].get(w)) is not None:
        return split(last, q)
    new, p = state(length[last] + 1, {}, 0), last
    while p >= 0 and w not in moves[p]:
        moves[p][w] = new
        p = link[p]
    if p >= 0:
        link[new] = split(p, moves[p][w])
    return new


def _dealt(parts: int, window: int, size: int):
    """Items as sequences of word hashes, and the shard of each; long ones in overlapping pieces of size words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offs = text_bytes(batch.column(1))
            for lo, hi in slices(offs):
                h, _, first = words(buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo], NONWORD)
                shard, items, seqs = [], [], []
                for i, item in enumerate(batch.column(0)[lo:hi].to_pylist()):
                    for b in range(first[i], max(first[i] + 1, first[i + 1] - window + 1), size):
                        seq = h[b : min(b + size + window - 1, first[i + 1])].tobytes()
                        if seq:
                            shard.append(zlib.crc32(seq, 0 if item is None else item & 0xFFFFFFFF) % parts)
                            items.append(item)
                            seqs.append(seq)
                yield table("shard int,item_id long,seq binary", shard=shard, item_id=items, seq=seqs)

    return run


def _built(window: int):
    def run(group: pa.Table) -> pa.Table:
        own = sorted(zip(group.column("item_id").to_pylist(), group.column("seq").to_pylist()), key=lambda x: (x[1], x[0] is None, x[0] or 0))
        part = [(item, np.frombuffer(seq, np.uint64)) for item, seq in own]
        vocabulary = np.unique(np.concatenate([seq for _, seq in part]))
        auto = Automaton([(item, np.searchsorted(vocabulary, seq).tolist()) for item, seq in part], window)
        blob = pickle.dumps((vocabulary, auto, min(window, *(len(seq) for _, seq in part))), pickle.HIGHEST_PROTOCOL)
        return pa.Table.from_batches([table("shard int,automaton binary", shard=[group.column("shard")[0].as_py()], automaton=[blob])])

    return run


def shards(benchmark: DataFrame, id_col: str, text_col: str, window: int) -> tuple[DataFrame, int]:
    """shard, automaton (the sorted hashes of its words, its automaton over places in them, its shortest window; pickled)
    of the shards that have words, and how many shards there are."""
    rows = need(benchmark, **{id_col: "long", text_col: "string"})
    parts = -(-(rows.agg(F.sum(F.octet_length(text_col))).first()[0] or 0) // SHARD_BYTES)
    if not parts:
        return benchmark.sparkSession.createDataFrame([], "shard int, automaton binary"), 0
    dealt = rows.mapInArrow(tidy(_dealt(parts, window, max(1, SHARD_BYTES // 20))), "shard int, item_id long, seq binary")
    return cut(dealt.groupBy("shard").applyInArrow(tidy(_built(window)), "shard int, automaton binary")), parts


class Scanner:
    """Finds spans of item windows in a slice of documents."""

    def __init__(self, found: list):
        self.shards = found

    def scan(self, h: np.ndarray, first: np.ndarray) -> dict[int, tuple[list, set]]:
        """By row: merged spans of words within the row, and items."""
        out: dict[int, tuple[list, set]] = {}
        for vocabulary, auto, least in self.shards:
            at = np.minimum(np.searchsorted(vocabulary, h), len(vocabulary) - 1)
            known = vocabulary[at] == h
            # runs of known words within a row
            fresh = np.zeros(len(h) + 1, bool)
            fresh[first] = True
            begin = np.flatnonzero(known & np.concatenate(([True], ~known[:-1] | fresh[1 : len(h)])))
            end = np.flatnonzero(known & np.concatenate((~known[1:] | fresh[1 : len(h)], [True]))) + 1 if len(h) else begin
            wide = end - begin >= least
            for b, e in zip(begin[wide].tolist(), end[wide].tolist()):
                spans, items = auto.stream(at[b:e].tolist())
                if spans:
                    row = int(np.searchsorted(first, b, "right")) - 1
                    own = out.setdefault(row, ([], set()))
                    own[0].extend((s + b - int(first[row]), t + b - int(first[row])) for s, t in spans)
                    own[1].update(items)
        for row, (spans, items) in out.items():
            out[row] = (_merged(spans), items)
        return out


_SPANS = "array<struct<begin:long,end:long>>"
_PAIRS = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))


def _found(rows: DataFrame, group: list) -> DataFrame:
    """of and at (doc_id and a hash of the text), spans, items of the rows with windows of this group of shards."""
    shared = rows.sparkSession.sparkContext.broadcast(group)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(shared.value)
        for batch in batches:
            buf, offs = text_bytes(batch.column(0))
            for lo, hi in slices(offs):
                h, _, first = words(buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo], NONWORD)
                found = sorted(scanner.scan(h, first).items())
                pairs = pa.array([[{"begin": s, "end": t} for s, t in spans] for _, (spans, _) in found], _PAIRS)
                own = pa.array([lo + i for i, _ in found], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(1).take(own), batch.column(2).take(own), pairs, pa.array([sorted(x) for _, (_, x) in found], pa.list_(pa.int64()))], ["of", "at", "spans", "items"])

    return rows.mapInArrow(tidy(run), f"of long, at long, spans {_SPANS}, items array<long>")


class _Finder:
    """Spans and items of a batch's rows, by a scanner or from columns."""

    def __init__(self, group: list | None):
        self.scanner = Scanner(group) if group is not None else None

    def rows(self, batch: pa.RecordBatch, text: int, extra: int) -> Iterator[tuple]:
        """lo, hi, bytes, offsets, word starts, first words, {row: (spans, items)} of each slice."""
        buf, offs = text_bytes(batch.column(text))
        for lo, hi in slices(offs):
            part, own = buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
            h, starts, first = words(part, own, NONWORD)
            if self.scanner:
                found = self.scanner.scan(h, first)
            else:
                columns = (batch.column(extra)[lo:hi].to_pylist(), batch.column(extra + 1)[lo:hi].to_pylist())
                found = {i: (_merged([(x["begin"], x["end"]) for x in spans]), set(items)) for i, (spans, items) in enumerate(zip(*columns)) if spans}
            yield lo, hi, part, own, starts, first, found


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, t in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(t, out[-1][1]))
        else:
            out.append((s, t))
    return out


def _prepared(docs: DataFrame, benchmark: DataFrame, window: int) -> tuple[DataFrame, list | None]:
    """docs and a group of shards, where one group holds the benchmark; else docs with two more columns, the spans and
    the items found group by group, and None."""
    with scratch(docs.sparkSession) as hold:
        found, parts = shards(benchmark, "item_id", "text", window)

        def group(at: int) -> list:  # of bounded size
            return [pickle.loads(x.automaton) for x in found.where(F.col("shard").between(at, at + GROUP - 1)).orderBy("shard").collect()]

        if parts <= GROUP:
            return docs, group(0)
        rows = docs.select(F.col("text").cast("string").alias("text"), F.col("doc_id").cast("long").alias("of")).withColumn("at", F.xxhash64("text"))
        rows, pieces = rows.select("text", "of", "at"), None
        for at in range(0, parts, GROUP):
            own = cut(_found(rows, group(at)))
            pieces = own if pieces is None else pieces.unionByName(own)
        of, at, spans, items, doc, row = free(docs, "_of", "_at", "_spans", "_items", "_doc", "_row")
        # a row that comes often has the same spans each time, so the sets hold no more than one array a group of shards
        whole = pieces.groupBy(F.col("of").alias(of), F.col("at").alias(at)).agg(F.flatten(F.collect_set("spans")).alias(spans), F.flatten(F.collect_set("items")).alias(items))
        whole = hold(cut(whole))
    keyed = docs.withColumns({doc: F.col("doc_id").cast("long"), row: F.xxhash64(F.col("text").cast("string"))})
    return keyed.join(whole, keyed[doc].eqNullSafe(whole[of]) & (keyed[row] == whole[at]), "left").drop(doc, row, of, at), None


def digest(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    schema = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
    rows, group = _prepared(need(docs, doc_id="long", text="string"), benchmark, window)
    shared = docs.sparkSession.sparkContext.broadcast(group)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = _Finder(shared.value)
        for batch in batches:
            for lo, hi, _, _, _, first, found in finder.rows(batch, 1, 2):
                hit = [sum(t - s for s, t in found[i][0]) if i in found else 0 for i in range(hi - lo)]
                items = [sorted(map(str, found[i][1])) if i in found else [] for i in range(hi - lo)]
                yield table(schema, doc_id=batch.column(0)[lo:hi], n_words=np.diff(first), n_hit=hit, n_items=[len(x) for x in items], items_sha256=[hashlib.sha256(",".join(x).encode()).hexdigest() for x in items], contaminated=[x > 0 for x in hit])

    return rows.mapInArrow(tidy(run), schema)


def clean(docs: DataFrame, benchmark: DataFrame, window: int = 10, max_coverage: float = 0.5) -> DataFrame:
    """docs without the spans of benchmark windows.

    A document of which more than max_coverage of the words are hit goes; the others lose the bytes from the first to
    the last word of each span.  All columns stay, whatever their names; n_chars is left to the caller.  Null and empty
    texts have no words and stay as they are; long texts are searched whole; rows that repeat, or have no doc_id, are
    cleaned each by themselves; without benchmark items all stay; an empty table stays empty.
    """
    rows, group = _prepared(docs, benchmark, window)
    shared = docs.sparkSession.sparkContext.broadcast(group)
    at, n = docs.columns.index("text"), len(docs.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = _Finder(shared.value)
        for batch in batches:
            texts, stay = batch.column(at).to_pylist(), np.ones(batch.num_rows, bool)
            for lo, _, part, own, starts, first, found in finder.rows(batch, at, n):
                ends = word_ends(part, own, NONWORD) if found else None
                for i, (spans, _) in found.items():
                    if sum(t - s for s, t in spans) > max_coverage * (first[i + 1] - first[i]):
                        stay[lo + i] = False
                        continue
                    raw, out, last = part[own[i] : own[i + 1]].tobytes(), [], 0
                    for s, t in spans:
                        out.append(raw[last : starts[first[i] + s] - own[i]])
                        last = ends[first[i] + t - 1] - own[i]
                    texts[lo + i] = b"".join([*out, raw[last:]]).decode()
            columns = [pa.array(texts, c.type) if i == at else c for i, c in enumerate(batch.columns[:n])]
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names[:n]).filter(pa.array(stay))

    return map_rows(rows, tidy(run), docs.columns)


def report(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """doc_id, spans (array of begin and end word), items (array of item_id), for documents with hits."""
    rows, group = _prepared(need(docs, doc_id="long", text="string"), benchmark, window)
    shared = docs.sparkSession.sparkContext.broadcast(group)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = _Finder(shared.value)
        for batch in batches:
            for lo, _, _, _, _, _, found in finder.rows(batch, 1, 2):
                hits = sorted(found.items())
                pairs = pa.array([[{"begin": s, "end": t} for s, t in spans] for _, (spans, _) in hits], _PAIRS)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([lo + i for i, _ in hits], pa.int64())), pairs, pa.array([sorted(x) for _, (_, x) in hits], pa.list_(pa.int64()))], ["doc_id", "spans", "items"])

    return rows.mapInArrow(tidy(run), f"doc_id long, spans {_SPANS}, items array<long>")
