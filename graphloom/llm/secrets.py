"""Secret scans: patterns, and character Markov models compared by log-likelihood ratio.

Two models of the next character given the last are trained from labelled samples: strings that are random (generated
ones and the values that the patterns find), and ordinary words and identifiers (all other runs of key characters, but
for those that hold a candidate).  A candidate is a run of 16 key characters or more; it is a span of kind markov if
its log-likelihood ratio passes a threshold for each character and one for the whole run, unless it lies within a
pattern's span.  All counts are sums over documents, so the models don't depend on how rows are dealt.

Edge cases: null and empty texts have no spans; very long texts are scanned whole; offsets are code points; overlapping
kinds all stay; ties in begin go by kind; repeated rows each get their row and each teach; a table without matches to
learn from uses the generated samples alone, and an empty one gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
import re
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import need, slices, table, text_bytes

KINDS = ("assign", "access", "hex", "markov")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
# A run shorter than the limit holds no longer match, so the limit can stand in the pattern.
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
_HEX = re.compile(r"[0-9a-f]{16,}")
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
#: A whole run of known characters that may hold a candidate.
_RUN = re.compile(r"[A-Za-z0-9+/_=.-]{16,}")
_ALPHABET = string.ascii_letters + string.digits + "+/_=-."
_N = len(_ALPHABET) + 1
_PLACES = np.zeros(256, np.int64)
_PLACES[[ord(c) for c in _ALPHABET]] = range(1, _N)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the patterns, in order of begin and then kind."""
    out = [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text)]
    out += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def base_values(text: str) -> list[str]:
    """What the patterns take for secrets: of an assignment its right side alone."""
    return [m.group(2) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12] + [text[b:e] for kind, b, e in base_spans(text) if kind != "assign"]


def uncovered(spans: list[tuple[str, int, int]], candidates: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The candidates that lie within none of the spans, which are in order of begin."""
    begins, ends = [b for _, b, _ in spans], list(itertools.accumulate((e for _, _, e in spans), max))
    out = []
    for b, e in candidates:
        k = bisect.bisect_right(begins, b)
        if not k or ends[k - 1] < e:
            out.append((b, e))
    return out


def _pairs(sample: str) -> tuple[np.ndarray, np.ndarray]:
    """Places of each character and of the next, the sample's borders (place 0) among them."""
    x = np.zeros(len(sample) + 2, np.int64)
    x[1:-1] = _PLACES[np.frombuffer(sample.encode(), np.uint8)]
    return x[:-1], x[1:]


def count(samples: list[str]) -> np.ndarray:
    """Counts of each character after each other (place 0: the border of a sample); samples are ASCII."""
    out = np.zeros((_N, _N), np.int64)
    for s in samples:
        np.add.at(out, _pairs(s), 1)
    return out


def ratios(random: np.ndarray, ordinary: np.ndarray, weight: float = 20.0) -> np.ndarray:
    """Log-likelihood ratio of each character after each other, of the two models with these counts.

    A rare context leans on how frequent the next character is at all, with the weight of so many observations.
    """
    logs = []
    for c in (random, ordinary):
        alone = (c.sum(0) + 0.5) / (c.sum() + 0.5 * _N)
        logs.append(np.log((c + weight * alone) / (c.sum(1, keepdims=True) + weight)))
    return logs[0] - logs[1]


def generated(n: int = 2000, seed: int = 17) -> list[str]:
    """Random strings over the alphabets that keys use, the positive samples that need no corpus."""
    rng = np.random.default_rng(seed)
    kinds = (string.ascii_letters + string.digits, string.ascii_uppercase + string.digits, string.digits + "abcdef", string.ascii_letters + string.digits + "+/")
    return ["".join(rng.choice(list(kinds[i % len(kinds)]), int(rng.integers(16, 48)))) for i in range(n)]


def _learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts from this partition's labelled strings: values of pattern spans (kind 1), all other runs of key characters
    that hold no candidate (kind 0)."""
    total = np.zeros((2, _N, _N), np.int64)
    for batch in batches:
        buf, offs = text_bytes(batch.column(0))
        for lo, hi in slices(offs, 4 << 20):
            # a border before and behind each document, so that none depends on its neighbours
            place = np.insert(_PLACES[buf[offs[lo] : offs[hi]]], offs[lo : hi + 1] - offs[lo], 0)
            total[0] += np.bincount(place[:-1] * _N + place[1:], minlength=_N * _N).reshape(_N, _N)
            for text in batch.column(0)[lo:hi].to_pylist():
                total[1] += count(base_values(text or ""))
                # what the scan will ask about is no sample of ordinary strings
                total[0] -= count([m.group() for m in _RUN.finditer(text or "") if _CANDIDATE.search(m.group())])
    total[0, 0, 0] = 0
    yield table("kind int,counts binary", kind=[0, 1], counts=[x.tobytes() for x in total])


def _add(group: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(b, np.int64) for b in group.column("counts").to_pylist())
    return pa.Table.from_batches([table("kind int,counts binary", kind=[group.column("kind")[0].as_py()], counts=[total.tobytes()])])


def learn(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """The ratios from all documents, with the generated strings added to the random ones; tables of fixed size."""
    parts = need(docs, **{text_col: "string"}).mapInArrow(_learn, "kind int, counts binary").groupBy("kind").applyInArrow(_add, "kind int, counts binary")
    found = {kind: np.frombuffer(b, np.int64).reshape(_N, _N) for kind, b in parts.collect()}
    none = np.zeros((_N, _N), np.int64)
    return ratios(found.get(1, none) + count(generated()), found.get(0, none))


def likely(ratio: np.ndarray, sample: str, threshold: float, whole: float) -> bool:
    """Whether the ratio speaks for a random string: by its mean and by its sum."""
    own = ratio[_pairs(sample)]
    return float(own.mean()) > threshold and float(own.sum()) > whole


def scan(docs: DataFrame, threshold: float = 2.0, whole: float = 32.0) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_markov.

    The models are counted over all documents in a pass of its own, before every text is scanned.  threshold is the mean
    log-likelihood ratio of a character and whole the ratio of a run from which it is a span.
    """
    ratio = docs.sparkSession.sparkContext.broadcast(learn(docs))
    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_markov long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, offs = text_bytes(batch.column(1))
            for lo, hi in slices(offs, 4 << 20):
                out = []
                for text in batch.column(1)[lo:hi].to_pylist():
                    base = base_spans(text or "")
                    runs = uncovered(base, [m.span() for m in _CANDIDATE.finditer(text or "")])
                    more = [("markov", b, e) for b, e in runs if likely(ratio.value, text[b:e], threshold, whole)]
                    every = sorted([*base, *more], key=lambda x: (x[1], KINDS.index(x[0])))
                    show = [",".join(f"{k}:{b}:{e}" for k, b, e in spans) for spans in (base, every)]
                    out.append((*(sum(k == kind for k, _, _ in base) for kind in KINDS[:3]), hashlib.sha256(show[0].encode()).hexdigest(), show[1], len(more)))
                columns = list(zip(*out)) if out else [()] * 6
                yield table(schema, doc_id=batch.column(0)[lo:hi], n_assign=columns[0], n_access=columns[1], n_hex=columns[2], base_sha256=columns[3], spans=columns[4], n_markov=columns[5])

    return need(docs, doc_id="long", text="string").mapInArrow(run, schema)
