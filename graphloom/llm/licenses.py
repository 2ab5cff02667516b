"""License scans: ordered signature rules behind a keyword prefilter; priorities and containment settle overlaps.

The words of a slice of documents are hashed at once, and only texts that hold a keyword of some rule are looked at
further: their words, put together with one space, are searched by the rules whose keywords they hold.  Of two
detections of which one lies within the other, that of lower priority goes; of equal priority the inner one, and of
equal intervals the later rule.  Detections that only overlap both stay.  The phrases of BASE are found whatever the
rules say, and nothing suppresses them.

Edge cases: null and empty texts, and texts without words, have no detections, no labels and score 0; very long texts
are searched whole, with gaps of bounded length in the rules; a phrase that repeats counts at each place; repeated rows
each get their row; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import LOWER, NONWORD, need, slices, table, text_bytes, tidy, words
from .license_rules import RULES, Rule, parse

#: Phrases and their labels: fixed values.
BASE = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))
#: How sure a detection of each priority makes one that the text is licensed so.
SURE = {1: 0.3, 2: 0.7, 3: 0.9, 4: 0.95, 5: 0.99}

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_LOWER = bytes(LOWER)


def normalized(text: bytes) -> bytes:
    """The words in lower case (A-Z), with one space before each and one at the end."""
    return b" " + b" ".join(_WORD.findall(text.translate(_LOWER))) + b" "


def places(text: bytes, phrase: str) -> list[int]:
    """Where in a normalized text the phrase's words begin."""
    return [m.start() for m in re.finditer(b"(?<= )" + phrase.encode() + b"(?= )", text)]


Detection = tuple[int, int, int, int, str]


def detect(text: bytes, rules: list[tuple[int, Rule]]) -> list[Detection]:
    """(begin, end, priority, place of the rule, label) of all matches of the numbered rules in a normalized text."""
    out = []
    for k, rule in rules:
        for m in rule.pattern.finditer(text):
            label = rule.label.format(*[g.decode().replace(" ", "-") for g in m.groups() if g]) if "{" in rule.label else rule.label
            out.append((m.start(), m.end(), rule.priority, k, label))
    return out


def settle(found: list[Detection]) -> list[Detection]:
    """The detections that no other of the same or a higher priority contains, in order of begin."""
    far: dict[int, int] = {}  # priority: the furthest end so far
    out = []
    for d in sorted(found, key=lambda d: (d[0], -d[1], -d[2], d[3])):
        if all(end < d[1] for priority, end in far.items() if priority >= d[2]):
            out.append(d)
        far[d[2]] = max(far.get(d[2], -1), d[1])
    # of two that begin alike the longer came first; a shorter one of higher priority stays beside it
    return out


@functools.cache
def _rules() -> tuple[list[Rule], np.ndarray, list[list[int]]]:
    """Rules, sorted hashes of the keywords and the rules of each keyword."""
    rules = parse(RULES)
    by_word: dict[str, list[int]] = {}
    for k, rule in enumerate(rules):
        for word in rule.keywords:
            by_word.setdefault(word, []).append(k)
    # the base phrases' rarest words bring a text into the second look
    for word in ("gnu", "apache", "cc", "license"):
        by_word.setdefault(word, [])
    names = sorted(by_word)
    column = pa.array(names, pa.string())
    buf, offs = text_bytes(column)
    h, _, _ = words(buf, offs, NONWORD)
    order = np.argsort(h)
    return rules, h[order], [by_word[names[i]] for i in order]


def scan_text(text: bytes, rules: list[tuple[int, Rule]]) -> tuple[int, int | None, int | None, list[str], list[str], float, list[Detection]]:
    """n_base, first_word, last_word, base labels, labels, score and detections (begin, end in words) of one text."""
    whole = normalized(text)
    base = [(at, label) for phrase, label in BASE for at in places(whole, phrase)]
    kept = settle(detect(whole, rules))
    gaps = np.flatnonzero(np.frombuffer(whole, np.uint8) == 32)

    def word(at: int) -> int:
        return int(np.searchsorted(gaps, at, "left")) - 1

    at = [word(b) for b, _ in base]
    best: dict[str, float] = {}
    for _, _, priority, _, label in kept:
        best[label] = max(best.get(label, 0.0), SURE[priority])
    for _, label in base:
        best[label] = max(best.get(label, 0.0), SURE[2])
    doubt = 1.0
    for label in sorted(best):
        doubt *= 1.0 - best[label]
    spans = [(word(b), word(e) + 1, p, k, label) for b, e, p, k, label in kept]
    return len(base), min(at, default=None), max(at, default=None), sorted({x for _, x in base}), sorted(best), 1.0 - doubt, spans


_OUT = "doc_id long,n_words long,n_base long,first_word long,last_word long,base_labels string,labels string,score double,spans string"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rules, keys, of_key = _rules()
    for batch in batches:
        buf, offs = text_bytes(batch.column(1))
        for lo, hi in slices(offs):
            own = buf[offs[lo] : offs[hi]]
            h, _, first = words(own, offs[lo : hi + 1] - offs[lo], NONWORD)
            at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            hit = np.flatnonzero(keys[at] == h)
            pairs = np.unique(np.stack([np.searchsorted(first, hit, "right") - 1, at[hit]], 1), axis=0)
            out: list = [(0, None, None, "", "", 0.0, "")] * (hi - lo)
            ends = np.flatnonzero(np.diff(pairs[:, 0], append=-1))
            begin = 0
            for end in ends:
                row = int(pairs[begin, 0])
                asked = sorted({k for key in pairs[begin : end + 1, 1] for k in of_key[key]})
                n, a, b, base, labels, score, spans = scan_text(buf[offs[lo + row] : offs[lo + row + 1]].tobytes(), [(k, rules[k]) for k in asked])
                out[row] = (n, a, b, ",".join(base), ",".join(labels), score, ",".join(f"{x}:{i}:{j}" for i, j, _, _, x in spans))
                begin = int(end) + 1
            cols = list(zip(*out))
            yield table(_OUT, doc_id=batch.column(0)[lo:hi], n_words=np.diff(first), n_base=cols[0], first_word=cols[1], last_word=cols[2], base_labels=cols[3], labels=cols[4], score=cols[5], spans=cols[6])


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans (label:begin:end of the detections
    that stay, in words, end exclusive), of documents (doc_id, text).

    score is one less the product of the doubts that each label's surest detection leaves.
    """
    return need(docs, doc_id="long", text="string").mapInArrow(tidy(_scan), _OUT.replace(",", ", "))
