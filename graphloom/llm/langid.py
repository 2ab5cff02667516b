"""Language identification by sparse multinomial logistic regression on TF-IDF character n-grams.

Character n-grams (1 to 3, letters and single spaces only) are hashed to a fixed number of features.  Document
frequencies are counted over all training texts.  Rows are sparse from the counting to the scoring.  The regression is
trained by follow-the-regularised-leader with elastic-net penalties on a bounded, per-language sample, and its
temperature is fitted on a fifth of that sample.

Edge cases: null texts and texts without a letter are `und` with score 0; a language without training texts is never
predicted; very long texts are counted whole, in a slice of their own; with no training text at all every prediction is `und`; ties go to the language that sorts first; repeated
rows each get their row; rows without doc_id are held out of training; an empty table gives an empty result; further
columns are ignored.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold_of, need, pack, slices, table, text_bytes, tidy, unpack

FEATURES = 1 << 14
_SLICE = 1 << 18
_LETTER = re.compile(r"[^\W\d_]")
_CODE = (np.random.default_rng(11).integers(1, 2**62, 3, dtype=np.uint64) << np.uint64(1)) + np.uint64(1)


@functools.cache
def _letters() -> np.ndarray:
    """Which code points are letters; all others become spaces."""
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def has_letter(text: str | None) -> bool:
    """Whether a text has a letter; numbers of any script (2, ½, Ⅷ) are none."""
    return any(m.group().isalpha() for m in _LETTER.finditer(text or ""))


def counts(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """By slice: rows lo..hi and their n-gram counts as sparse rows: begins (hi - lo + 1 longs), features, counts.

    What it holds follows the slice's characters, not its rows, so many short or empty texts take no more than long ones.
    """
    _, offs = text_bytes(column)
    for lo, hi in slices(offs + np.arange(len(offs)), _SLICE):
        texts = [(t or "").lower() for t in column[lo:hi].to_pylist()]
        sizes = np.array([len(t) for t in texts], np.int64)
        code = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.uint64)
        row = np.repeat(np.arange(hi - lo), sizes)
        code = np.where(_letters()[code.astype(np.int64)], code, np.uint64(32))
        if len(code):  # runs of spaces are one space
            keep = np.ones(len(code), bool)
            keep[1:] = (code[1:] != 32) | (code[:-1] != 32) | (row[1:] != row[:-1])
            code, row = code[keep], row[keep]
        gram, found = np.zeros(len(code), np.uint64), []
        for n in range(3):
            if len(code) <= n:
                break
            gram = gram[: len(code) - n] * np.uint64(0x100000001B3) + code[n:]
            inside = row[: len(code) - n] == row[n:]
            feature = ((gram * _CODE[n]) >> np.uint64(64 - 14)).astype(np.int64)
            found.append((row[: len(code) - n] * FEATURES + feature)[inside])
        places = np.sort(np.concatenate(found)) if found else np.zeros(0, np.int64)
        head = np.flatnonzero(np.concatenate(([True], places[1:] != places[:-1]))) if len(places) else places
        n = np.diff(np.append(head, len(places)))
        places = places[head]
        yield lo, hi, np.searchsorted(places, np.arange(hi - lo + 1) * FEATURES), places % FEATURES, n


def weigh(begin: np.ndarray, at: np.ndarray, n: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Values of sublinear TF-IDF rows of unit length."""
    x = np.log1p(n.astype(np.float32)) * idf[at]
    total = np.concatenate(([0.0], np.cumsum(x.astype(np.float64) ** 2)))
    return x / np.repeat(np.maximum(np.sqrt(total[begin[1:]] - total[begin[:-1]]), 1e-9), np.diff(begin))


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(FEATURES, np.int64)
    langs: dict[str, int] = {}
    for batch in batches:
        for _, _, _, at, _ in counts(batch.column(0)):
            total += np.bincount(at, minlength=FEATURES)
        for x in batch.column(1).to_pylist():
            langs[x] = langs.get(x, 0) + 1
    yield table("lang string,n long,total binary", lang=["", *langs], n=[0, *langs.values()], total=[pack(total), *[None] * len(langs)])


def _add(group: pa.Table) -> pa.Table:
    lang = group.column("lang")[0].as_py()
    blobs = [b for b in group.column("total").to_pylist() if b is not None]
    total = pack(sum(unpack(b, np.int64) for b in blobs)) if blobs else None
    return pa.Table.from_batches([table("lang string,n long,total binary", lang=[lang], n=[sum(group.column("n").to_pylist())], total=[total])])


def _sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, begin, at, n in counts(batch.column(0)):
            own = [slice(begin[i], begin[i + 1]) for i in range(hi - lo)]
            yield table("by long,lang string,at binary,n binary", by=batch.column(2)[lo:hi], lang=batch.column(1)[lo:hi], at=[pack(at[e].astype(np.uint16)) for e in own], n=[pack(n[e].astype(np.uint32)) for e in own])


def fit_ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int, epochs: int = 3, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.01) -> np.ndarray:
    """Weights (FEATURES + 1 x classes; the last row is the intercept) by FTRL-proximal."""
    z, n = np.zeros((FEATURES + 1, classes)), np.zeros((FEATURES + 1, classes))

    def weights(at) -> np.ndarray:
        zz = z[at]
        return np.where(np.abs(zz) <= l1, 0.0, -(zz - np.sign(zz) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2))

    for _ in range(epochs):
        for at, x, y in rows:
            w = weights(at)
            score = x @ w
            p = np.exp(score - score.max())
            p /= p.sum()
            p[y] -= 1
            g = x[:, None] * p[None, :]
            more = n[at] + g * g
            z[at] += g - (np.sqrt(more) - np.sqrt(n[at])) / alpha * w
            n[at] = more
    return weights(slice(None))


def fit(docs: DataFrame, limit: int = 3000, parts: int = 4, held: int = 2) -> dict:
    """The model: languages, idf, weights, temperature.  limit bounds the documents that the regression sees."""
    rows = need(docs, doc_id="long", text="string", lang="string").where("lang is not null and text is not null and doc_id is not null").where(fold_of("doc_id", parts) != held)
    found = rows.select("text", "lang").mapInArrow(tidy(_frequencies), "lang string, n long, total binary").groupBy("lang").applyInArrow(_add, "lang string, n long, total binary").collect()
    total = sum((unpack(r.total, np.int64) for r in found if r.total is not None), np.zeros(FEATURES, np.int64))
    by_lang = {r.lang: r.n for r in found if r.n}
    langs = sorted(by_lang)
    idf = np.log((1 + sum(by_lang.values())) / (1 + total)).astype(np.float32) + 1
    if not langs:
        return {"langs": [], "idf": idf, "weights": np.zeros((FEATURES + 1, 0)), "temperature": 1.0}
    share = F.lit(0.0)
    for lang in langs:  # every language has the same room
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, limit / len(langs) / by_lang[lang]))).otherwise(share)
    chance = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 30)) / float(1 << 30)
    sample = rows.where(chance < share).select("text", "lang", F.xxhash64("doc_id", F.lit(6)).alias("by")).mapInArrow(tidy(_sample), "by long, lang string, at binary, n binary").collect()
    sample.sort(key=lambda r: (r.by, r.lang, r.at))
    data = []
    for r in sample:
        at = unpack(r.at, np.uint16).astype(np.int64)
        x = np.log1p(unpack(r.n, np.uint32).astype(np.float64)) * idf[at]
        x /= max(np.sqrt((x * x).sum()), 1e-9)
        data.append((np.append(at, FEATURES), np.append(x, 1.0), langs.index(r.lang)))
    train, check = [d for i, d in enumerate(data) if i % 5], data[::5]
    weights = fit_ftrl(train or data, len(langs))
    scores = np.array([x @ weights[at] for at, x, _ in check]) if check else np.zeros((0, len(langs)))
    truth = np.array([y for _, _, y in check], np.int64)

    def loss(t: float) -> float:
        s = scores / t
        return float((np.log(np.exp(s - s.max(1, keepdims=True)).sum(1)) + s.max(1) - s[np.arange(len(truth)), truth]).mean())

    temperature = min(np.geomspace(0.02, 5, 120), key=loss) if len(truth) else 1.0
    return {"langs": langs, "idf": idf, "weights": weights, "temperature": float(temperature)}


def _scores(begin: np.ndarray, at: np.ndarray, x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Sparse rows times weights (rows x classes)."""
    out = np.zeros((len(begin) - 1, weights.shape[1]))
    for lo, hi in slices(begin, (1 << 21) // weights.shape[1]):
        some = lo + np.flatnonzero(np.diff(begin[lo : hi + 1]))
        if len(some):
            own = slice(begin[lo], begin[hi])
            out[some] = np.add.reduceat(weights[at[own]] * x[own, None], begin[some] - begin[lo], 0)
    return out


def predict(docs: DataFrame, model: dict, parts: int = 4, held: int = 2) -> DataFrame:
    """doc_id, held_out, lang_pred, score."""
    schema = "doc_id long, held_out boolean, lang_pred string, score double"
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        langs, weights, bias = m["langs"], m["weights"][:-1].astype(np.float32), m["weights"][-1]
        for batch in batches:
            for lo, hi, begin, at, n in counts(batch.column(1)):
                named = np.array([bool(langs) and has_letter(t) for t in batch.column(1)[lo:hi].to_pylist()])
                pred, score = np.full(hi - lo, "und", object), np.zeros(hi - lo)
                if langs:
                    s = (_scores(begin, at, weigh(begin, at, n, m["idf"]), weights) + bias) / m["temperature"]
                    p = np.exp(s - s.max(1, keepdims=True))
                    p /= p.sum(1, keepdims=True)
                    best = p.argmax(1)
                    pred[named] = np.array(langs, object)[best[named]]
                    score[named] = p[np.arange(hi - lo), best][named]
                yield table(schema, doc_id=batch.column(0)[lo:hi], held_out=batch.column(2)[lo:hi], lang_pred=pred, score=score)

    rows = need(docs, doc_id="long", text="string").select("doc_id", "text", (fold_of("doc_id", parts) == held).alias("held_out"))
    return rows.mapInArrow(tidy(run), schema)


def identify(docs: DataFrame, limit: int = 3000) -> DataFrame:
    """Trains on docs (text, lang) and predicts docs."""
    return predict(docs, fit(docs, limit))
