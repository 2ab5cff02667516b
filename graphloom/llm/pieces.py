"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

A text is cut into units (a run of spaces and what follows up to the next space).  No piece of a supported model
reaches over such a border, so units are encoded alone, each distinct one once while a task's cache holds it.  All new
units of a slice lie in one flat array of symbols; each round finds every unit's best pair rank by a segmented minimum
and merges all its pairs of that rank at once, the leftmost first where they overlap; symbols that are gone are skipped
by links and compacted away when they are many, until no pair remains.  Of a unit's pairs those behind a merge that
brings up a better pair wait for the next round, so the merges are the library's in any model.  Long units take rounds
of their own, so that short ones don't wait for them.

Edge cases: null and empty texts have no ids and decode to ''; very long texts and words are encoded whole; repeated
rows each get their row; a character outside the model becomes its UTF-8 byte pieces (or the unknown id, without byte
fallback); an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import contextlib
import hashlib
import re
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import need, slices, table, text_bytes, tidy

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Units beyond this many symbols take rounds of their own.
LONG_UNIT = 400
CACHE = 400_000
_NONE = np.iinfo(np.int32).max


def _fields(b: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a protocol buffer message."""
    i, n = 0, len(b)

    def varint() -> int:
        nonlocal i
        value = shift = 0
        while True:
            x = b[i]
            i += 1
            value |= (x & 127) << shift
            shift += 7
            if x < 128:
                return value

    while i < n:
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        elif kind == 2:
            size = varint()
            yield key >> 3, b[i : i + size]
            i += size
        else:
            size = 8 if kind == 1 else 4
            yield key >> 3, b[i : i + size]
            i += size


def read_model(path: str) -> dict:
    """Pieces, scores and settings of a .model file of the BPE kind."""
    pieces, scores, kinds, spec = [], [], [], {}
    for number, value in _fields(open(path, "rb").read()):
        if number == 1:
            piece = dict(_fields(value))
            pieces.append(piece[1].decode())
            scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
            kinds.append(piece.get(3, NORMAL))
        elif number == 2:
            spec |= {f"trainer{k}": v for k, v in _fields(value)}
        elif number == 3:
            spec |= {f"normalizer{k}": v for k, v in _fields(value)}
    if spec.get("trainer3", 1) != 2:
        raise ValueError("only BPE models are supported")
    if spec.get("normalizer2") or spec.get("normalizer4", 1) or not spec.get("normalizer5", 1) or spec.get("trainer24", 0):
        raise ValueError("only models with identity normalisation, kept spaces and space marks in front are supported")
    if USER in kinds or UNUSED in kinds:
        raise ValueError("user-defined and unused pieces are not supported")
    if any(MARK in p.lstrip(MARK) for p, k in zip(pieces, kinds) if k == NORMAL):
        raise ValueError("pieces across spaces are not supported")
    return {"pieces": pieces, "scores": scores, "kinds": kinds, "dummy": bool(spec.get("normalizer3", 1)), "byte_fallback": bool(spec.get("trainer35", 0))}


class Codec:
    """Encoder and decoder of one model; made once per task from the broadcast model."""

    def __init__(self, model: dict):
        self.pieces, kinds = model["pieces"], model["kinds"]
        self.dummy, self.byte_fallback = model["dummy"], model["byte_fallback"]
        normal = [i for i, k in enumerate(kinds) if k == NORMAL]
        self.ids = {self.pieces[i]: i for i in normal}
        self.unknown = kinds.index(UNKNOWN)
        self.bytes_ = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, kinds)) if k == BYTE}
        self.byte_of = {i: v for v, i in self.bytes_.items()}
        self.plain = {i: p.replace(MARK, " ") for p, i in self.ids.items()}
        self.plain |= {i: "" for i, k in enumerate(kinds) if k == CONTROL} | {self.unknown: " ⁇ "}
        # symbols: ids of pieces, then characters that only occur inside pieces, then (per call) unknown characters
        self.symbols = dict(self.ids)
        for p in self.ids:
            for ch in p:
                self.symbols.setdefault(ch, len(self.pieces) + len(self.symbols))
        by_score = {s: r for r, s in enumerate(sorted({model["scores"][i] for i in normal}, reverse=True))}
        self.span = max(self.symbols.values()) + 2
        keys, merged = [], []
        for p, i in self.ids.items():
            for k in range(1, len(p)):
                a, b = self.symbols.get(p[:k]), self.symbols.get(p[k:])
                if a is not None and b is not None:
                    keys.append(a * self.span + b)
                    merged.append(i)
        order = np.argsort(np.array(keys, np.int64))
        self.keys, self.merged = np.array(keys, np.int64)[order], np.array(merged, np.int64)[order]
        self.rank_of = np.zeros(self.span, np.int64)
        for i in normal:
            self.rank_of[i] = by_score[model["scores"][i]]
        #: By code point; a character of no piece is never part of a pair.
        self.symbol_of = np.full(0x110000, self.span - 1, np.int64)
        for ch, i in self.symbols.items():
            if len(ch) == 1:
                self.symbol_of[ord(ch)] = i
        self.cache: dict[str, tuple[str, int, str]] = {}

    # -- encoding

    def units(self, text: str) -> list[str]:
        """The units of a text, each without its first space mark (there is always one)."""
        marked = text.replace(" ", MARK)
        if not self.dummy and not marked.startswith(MARK):
            raise ValueError("models without a dummy prefix are not supported")
        if marked.startswith(MARK) or MARK * 2 in marked:
            return [u[1:] for u in re.findall(f"{MARK}+[^{MARK}]*", MARK + marked)]
        return marked.split(MARK)

    def _pairs(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(merged piece, rank) of each pair; where there is none, rank is the largest number."""
        key = a * self.span + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        found = self.keys[at] == key
        piece = np.where(found, self.merged[at], 0)
        return piece, np.where(found, self.rank_of[piece], _NONE)

    def rounds(self, units: list[str]) -> list[list[int]]:
        """Symbols of each unit after all merges."""
        sizes = np.fromiter(map(len, units), np.int64, len(units)) + 1
        flat = self.symbol_of[np.frombuffer((MARK + MARK.join(units)).encode("utf-32-le"), np.uint32)]
        out: list = [None] * len(units)
        unit = np.repeat(np.arange(len(units)), sizes)
        char = np.arange(len(flat))  # where each symbol starts, for characters of no piece
        begin = np.concatenate(([0], np.cumsum(sizes)))
        piece, rank = np.zeros(len(flat), np.int64), np.full(len(flat), _NONE, np.int64)
        inside = np.flatnonzero(unit[:-1] == unit[1:])
        piece[inside], rank[inside] = self._pairs(flat[inside], flat[inside + 1])
        done_sym, done_unit, done_char = [], [], []
        while len(flat):
            # places of the symbols before and behind each one in its unit; -1: none
            heads = np.flatnonzero(np.concatenate(([True], unit[1:] != unit[:-1])))
            sizes = np.diff(np.append(heads, len(flat)))
            before, behind = np.arange(-1, len(flat) - 1), np.arange(1, len(flat) + 1)
            before[heads], behind[heads + sizes - 1] = -1, -1
            gone, number = [], 0
            while True:
                least = np.minimum.reduceat(rank, heads)
                live = least < _NONE
                if 2 * (number + sizes[~live].sum()) > len(flat) or not live.any():
                    break
                best = np.flatnonzero(rank == np.repeat(np.where(live, least, -1), sizes))
                gone.append(self._merge(best, flat, unit, before, behind, piece, rank))
                number += len(gone[-1])
            keep = np.ones(len(flat), bool)
            if gone:
                keep[np.concatenate(gone)] = False
            alive = np.repeat(live, sizes)
            over = keep & ~alive
            done_sym.append(flat[over])
            done_unit.append(unit[over])
            done_char.append(char[over])
            keep &= alive
            flat, unit, char, piece, rank = (x[keep] for x in (flat, unit, char, piece, rank))
        sym, unit, char = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (done_sym, done_unit, done_char))
        order = np.argsort(char, kind="stable")
        sym, unit, char = sym[order], unit[order], char[order]
        ends = np.searchsorted(unit, np.arange(len(units) + 1))
        lists = sym.tolist()
        outside = set(unit[sym >= len(self.pieces)].tolist())
        for u in range(len(units)):
            own = lists[ends[u] : ends[u + 1]]
            if u in outside:
                own = [x for s, c in zip(own, char[ends[u] : ends[u + 1]].tolist()) for x in ([s] if s < len(self.pieces) else self.outside((MARK + units[u])[c - begin[u]]))]
            out[u] = own
        return out

    def _merge(self, best, flat, unit, before, behind, piece, rank) -> np.ndarray:
        """Merges the pairs that begin at these places, all of their unit's best rank; returns the places that go."""
        # of pairs in a row that overlap every second one
        run = np.flatnonzero(np.concatenate(([True], behind[best[:-1]] != best[1:])))
        best = best[(np.arange(len(best)) - np.repeat(run, np.diff(np.append(run, len(best))))) % 2 == 0]
        right = behind[best]
        left, after = before[best], behind[right]
        # pairs of the merged piece with what is before it (a piece merged just now, if that touches) and behind it
        touch = np.concatenate(([False], (left[1:] >= 0) & (left[1:] == right[:-1])))
        merged = piece[best]
        with_left = np.where(touch, np.concatenate(([0], merged[:-1])), flat[left])
        piece_l, rank_l = self._pairs(with_left, merged)
        piece_r, rank_r = self._pairs(merged, flat[after])
        rank_l[left < 0] = _NONE
        rank_r[after < 0] = _NONE
        own = unit[best]
        better = np.minimum(rank_l, rank_r) < rank[best]
        if better.any():  # what lies behind the first merge that brings up a better pair waits
            first = np.searchsorted(own, own)
            number = np.cumsum(better) - better
            stay = number == number[first]
            best, right, left, after, touch, merged = (x[stay] for x in (best, right, left, after, touch, merged))
            piece_l, rank_l, piece_r, rank_r = (x[stay] for x in (piece_l, rank_l, piece_r, rank_r))
        flat[best] = merged
        behind[best] = after
        some = after >= 0
        before[after[some]] = best[some]
        rank[right] = _NONE
        next_touches = np.append(touch[1:], False)
        piece[best] = np.where(next_touches, np.append(piece_l[1:], 0), piece_r)
        rank[best] = np.where(next_touches, np.append(rank_l[1:], 0), rank_r)
        alone = (left >= 0) & ~touch
        piece[left[alone]], rank[left[alone]] = piece_l[alone], rank_l[alone]
        return right

    def outside(self, ch: str) -> list[int]:
        """Ids of a character that is no piece."""
        return [self.bytes_[b] for b in ch.encode()] if self.byte_fallback else [self.unknown]

    def learn(self, units: Iterable[str]) -> None:
        """Encodes the units that the cache lacks."""
        new = [u for u in dict.fromkeys(units) if u not in self.cache]
        short = [u for u in new if len(u) < LONG_UNIT]
        for group in ([short] if short else []) + [[u] for u in new if len(u) >= LONG_UNIT]:
            for u, ids in zip(group, self.rounds(group)):
                self.cache[u] = (",".join(map(str, ids)), len(ids), self.spell(ids))

    def encode(self, text: str) -> list[int]:
        if not text:
            return []
        units = self.units(text)
        self.learn(units)
        return [int(x) for u in units for x in self.cache[u][0].split(",")]

    # -- decoding

    def spell(self, ids: Iterable[int]) -> str:
        """Text of ids, the leading space of the first piece included; broken byte runs become U+FFFD."""
        with contextlib.suppress(KeyError):
            return "".join([self.plain[i] for i in ids])
        out, run = [], bytearray()
        for i in ids:
            if (b := self.byte_of.get(i)) is not None:
                run.append(b)
                continue
            if run:
                out.append(_utf8(run))
                run = bytearray()
            out.append(self.plain[i])
        if run:
            out.append(_utf8(run))
        return "".join(out)

    def decode(self, ids: Iterable[int]) -> str:
        ids = list(ids)
        text = self.spell(ids)
        return text[1:] if self.dummy and ids and ids[0] not in self.byte_of and text.startswith(" ") else text

    def digests(self, text: str) -> tuple[int, str, str]:
        """Number of ids, SHA-256 of the ids, SHA-256 of the decoded text; the units must be learnt."""
        if not text:
            return 0, hashlib.sha256(b"").hexdigest(), hashlib.sha256(b"").hexdigest()
        found = list(map(self.cache.__getitem__, self.units(text)))
        decoded = "".join([x[2] for x in found])
        if self.dummy and decoded.startswith(" "):
            decoded = decoded[1:]
        return sum([x[1] for x in found]), hashlib.sha256(",".join([x[0] for x in found]).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()


def _utf8(run: bytes) -> str:
    """Each byte that is part of no character becomes one U+FFFD."""
    out, i = [], 0
    while i < len(run):
        for size in (1, 2, 3, 4):
            try:
                out.append(bytes(run[i : i + size]).decode())
                i += size
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            i += 1
    return "".join(out)


def _texts(batches: Iterator[pa.RecordBatch], codec: Codec) -> Iterator[tuple[list, list[str]]]:
    """(ids of rows, texts) by slices, with all their units in the codec's cache."""
    for batch in batches:
        keys, column = batch.column(0), batch.column(1)
        _, offs = text_bytes(column)
        for lo, hi in slices(offs):
            texts = [x or "" for x in column[lo:hi].to_pylist()]
            if len(codec.cache) > CACHE:
                codec.cache.clear()
            codec.learn(u for t in texts if t for u in codec.units(t))
            yield keys[lo:hi].to_pylist(), texts


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (array of int), decoded (string)."""
    model = docs.sparkSession.sparkContext.broadcast(read_model(model_path))

    def run(batches):
        codec = Codec(model.value)
        for keys, texts in _texts(batches, codec):
            ids = [[int(x) for u in codec.units(t) for x in codec.cache[u][0].split(",")] if t else [] for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array([codec.decode(i) for i in ids], pa.string())], ["doc_id", "ids", "decoded"])

    return need(docs, **{id_col: "long", text_col: "string"}).mapInArrow(tidy(run), "doc_id long, ids array<int>, decoded string")


def digest(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encode() and decode() without carrying ids and texts."""
    model = docs.sparkSession.sparkContext.broadcast(read_model(model_path))
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"

    def run(batches):
        codec = Codec(model.value)
        for keys, texts in _texts(batches, codec):
            n, a, b = zip(*map(codec.digests, texts)) if texts else ((), (), ())
            yield table(schema, doc_id=keys, n_tokens=n, ids_sha256=a, decoded_sha256=b)

    return need(docs, **{id_col: "long", text_col: "string"}).mapInArrow(tidy(run), schema)
