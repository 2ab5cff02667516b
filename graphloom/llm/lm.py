"""Language-model scoring by deleted interpolation.

Maximum-likelihood n-grams of every order up to the given one (trigrams by default) are mixed from below: a uniform
share, then unigrams, then each higher order with the model below it, with weights by buckets of the context's
frequency.  The weights are learned by expectation-maximisation on deleted counts, one order after the other: over a
fold of the training documents, every token is predicted from the counts without itself.  The likelihood of a weight
depends on a token only by the ratio of its n-gram's share to the share below, so a histogram of that ratio for each
bucket (of fixed size, 200 steps a decade) is all that the maximisation has to see.

All counts are exact and cover all training documents.  A batch of documents sends each hash bucket its distinct
n-grams once, sorted and packed, with its own counts, and gets their totals back; so a frequent word costs one number a
batch, no table of n-grams is broadcast, and what is gathered grows with the input.  Batches are told apart by a hash
of what they hold; words by 64 bits of a hash, longer n-grams by 56.

Edge cases: null and empty texts are one end token; unknown words have the uniform share; rows without doc_id are
scored and not learned from; repeated rows each count and each get their row; very long texts are batches of their own;
with no training text the counts are 0 and the uniform share is 1; an empty table gives an empty result; further columns
are ignored.  docs must give the same rows each time it is read (cut it first if it doesn't).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, cut, fanout, fold_of, mix, need, pack, pack_sorted, scratch, slices, table, text_bytes, tidy, unpack, unpack_sorted, words

BATCH_BYTES = 4 << 20
_END, _START = np.uint64(0x517CC1B727220A95), np.uint64(0x2545F4914F6CDD1D)
_PREV, _NEXT = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)
#: Frequency buckets of contexts (powers of two; 0: unseen).
BUCKETS = 48
#: Decades and steps a decade of the ratios that EM reads; their first place is for a ratio of 0.
DECADES, STEPS = 15, 200
PLACES = 2 * DECADES * STEPS + 2


class Batch:
    """Documents that travel together: ids, folds, texts."""

    def __init__(self, ids: np.ndarray, nulls: np.ndarray, folds: np.ndarray, buf: np.ndarray, offs: np.ndarray):
        self.ids, self.nulls, self.folds, self.buf, self.offs = ids, nulls, folds, buf, offs

    def key(self) -> int:
        x = xxhash.xxh3_64(self.buf.tobytes())
        for a in (self.ids, self.nulls, self.folds, self.offs):
            x.update(np.ascontiguousarray(a).tobytes())
        return int(np.array([x.intdigest()], np.uint64).view(np.int64)[0])

    def pack(self) -> bytes:
        head = np.array([len(self.ids), len(self.buf)], np.int64)
        raw = b"".join(np.ascontiguousarray(a).tobytes() for a in (head, self.ids, self.offs, self.nulls, self.folds, self.buf))
        return np.int64(len(raw)).tobytes() + pa.compress(raw, codec="zstd", asbytes=True)

    @staticmethod
    def unpack(b: bytes) -> Batch:
        raw = pa.decompress(b[8:], decompressed_size=int(np.frombuffer(b, np.int64, 1)[0]), codec="zstd", asbytes=True)
        n, size = np.frombuffer(raw, np.int64, 2)
        at, out = 16, []
        for kind, m in ((np.int64, n), (np.int64, n + 1), (bool, n), (np.int8, n), (np.uint8, size)):
            out.append(np.frombuffer(raw, kind, int(m), at))
            at += int(m) * np.dtype(kind).itemsize
        ids, offs, nulls, folds, buf = out
        return Batch(ids, nulls, folds, buf, offs)

    def grams(self, order: int) -> None:
        """Fills: end (of each document's tokens), and of each order up to this one n-grams (sorted) and which (of each token)."""
        hashes, sizes = [], []
        for lo, hi in slices(self.offs):
            h, _, first = words(self.buf[self.offs[lo] : self.offs[hi]], self.offs[lo : hi + 1] - self.offs[lo], SPACE)
            hashes.append(h)
            sizes.append(np.diff(first))
        n = np.concatenate(sizes)
        self.end = np.cumsum(n + 1)
        token = np.full(int(self.end[-1]), _END, np.uint64)
        inner = np.ones(len(token), bool)
        inner[self.end - 1] = False
        token[inner] = np.concatenate(hashes)
        self.size = n + 1
        found = [token]
        for _ in range(order - 1):  # an n-gram is the one before it, shorter by a token, and the token
            before = np.concatenate(([_START], found[-1][:-1]))
            before[self.end[:-1]] = _START
            found.append(mix(before * _PREV + token * _NEXT))
        self.ngrams, self.which = zip(*(np.unique(h, return_inverse=True) for h in found))
        self.train = np.repeat(self.folds >= 0, self.size)


def _batches(column_batches: Iterator[pa.RecordBatch], fold: int) -> Iterator[Batch]:
    """Batches of a partition (doc_id, text, fold: -1 for rows that aren't learned from); the fold for EM goes apart."""
    for batch in column_batches:
        folds = batch.column(2).to_numpy().astype(np.int8)
        for own in (folds == fold, folds != fold):
            part = batch.filter(pa.array(own)) if own.any() else None
            if part is None:
                continue
            buf, offs = text_bytes(part.column(1))
            nulls = part.column(0).is_null().to_numpy(zero_copy_only=False)
            ids = part.column(0).fill_null(0).to_numpy()
            for lo, hi in slices(offs, BATCH_BYTES):
                yield Batch(ids[lo:hi], nulls[lo:hi], folds[own][lo:hi], buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])


def _split(h: np.ndarray, parts: int) -> np.ndarray:
    """Where sorted hashes pass from bucket to bucket."""
    return np.searchsorted(((h >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32), np.arange(parts + 1).astype(np.uint64))


_ASKED = "bucket int,batch long,teaches boolean,n int,grams binary,counts binary"
_ANSWER = "batch long,teaches boolean,bucket int,n long,counts binary,types long,docs long"


def _ask(parts: int, fold: int, order: int):
    """A row for each batch, order and bucket; buckets of a higher order come after those of the lower one.  Batches of
    the fold for EM teach the weights."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _batches(batches, fold):
            b.grams(order)
            key, out = b.key(), []
            for k, (grams, which) in enumerate(zip(b.ngrams, b.which)):
                counts = np.bincount(which[b.train], minlength=len(grams)).astype(np.uint32)
                ends = _split(grams, parts)
                for i in np.flatnonzero(np.diff(ends)):
                    own = slice(ends[i], ends[i + 1])
                    out.append((k * parts + i, key, bool(b.folds[0] == fold), ends[i + 1] - ends[i], pack_sorted(grams[own], 8 * min(k, 1)), pack(counts[own])))
            yield table(_ASKED, **dict(zip(("bucket", "batch", "teaches", "n", "grams", "counts"), zip(*out))))

    return run


def _answer(parts: int):
    """Totals for each asking row (in its order), and a row (batch null) with the bucket's types, tokens and ends."""

    def run(group: pa.Table) -> pa.Table:
        bucket = group.column("bucket")[0].as_py()
        seen: set = set()
        rows = [r for r in group.to_pylist() if not (r["batch"] in seen or seen.add(r["batch"]))]  # equal batches ask alike
        times: dict[int, int] = {}
        for x in group.column("batch").to_pylist():
            times[x] = times.get(x, 0) + 1
        grams = [unpack_sorted(r["grams"], r["n"]) for r in rows]
        counts = [unpack(r["counts"], np.uint32).astype(np.int64) * times[r["batch"]] for r in rows]
        keys, which = np.unique(np.concatenate(grams), return_inverse=True)
        total = np.bincount(which, np.concatenate(counts), len(keys)).astype(np.int64)
        at = np.cumsum([0, *(len(g) for g in grams)])
        kind = np.uint32 if total.max(initial=0) < 1 << 32 else np.int64
        found = [pack(total[which[at[i] : at[i + 1]]].astype(kind)) for i in range(len(rows))]
        ends = int(total[keys == _END].sum()) if bucket < parts else 0
        none = [None]
        return pa.Table.from_batches([table(_ANSWER, batch=[*(r["batch"] for r in rows), *none], teaches=[*(r["teaches"] for r in rows), *none], bucket=[bucket] * (len(rows) + 1), n=[*(r["n"] for r in rows), int(total.sum())], counts=[*found, *none], types=[0] * len(rows) + [int((total > 0).sum())], docs=[0] * len(rows) + [ends])])

    return run


def _carry(fold: int, only: bool):
    """Rows (batch, bucket -1, packed batch): only the batches of the fold for EM, or all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _batches(batches, fold):
            if not only or b.folds[0] == fold:
                yield table("batch long,bucket int,counts binary", batch=[b.key()], bucket=[-1], counts=[b.pack()])

    return run


def _totals(blob: bytes, n: int) -> np.ndarray:
    """n numbers of 32 or 64 bits."""
    raw = zlib.decompress(blob)
    return np.frombuffer(raw, np.uint32 if len(raw) == 4 * n else np.int64).astype(np.int64)


class Counted:
    """Tokens with the totals of the n-grams that end in them (counts: c(w), c(v, w), ...) and those of the contexts
    before them (contexts: all tokens, c(v), c(u, v), ...)."""

    def __init__(self, counts: list[np.ndarray], end: np.ndarray, docs: int, tokens: int):
        self.counts, self.end = counts, end
        self.contexts = [np.full(len(counts[0]), tokens)]
        for below in counts[:-1]:
            context = np.concatenate(([docs], below[:-1]))
            context[end[:-1]] = docs
            self.contexts.append(context)

    @staticmethod
    def of(rows: list[tuple[int, bytes]], parts: int, docs: int, tokens: int, order: int) -> tuple[Counted, Batch, int]:
        """From a packed batch and its answers; with the batch and how many equal ones there are."""
        own = [b for bucket, b in rows if bucket < 0]
        batch = Batch.unpack(own[0])
        batch.grams(order)
        by = {bucket: b for bucket, b in rows if bucket >= 0}
        counts = []
        for k, (grams, which) in enumerate(zip(batch.ngrams, batch.which)):
            ends, total = _split(grams, parts), np.zeros(len(grams), np.int64)
            for i in np.flatnonzero(np.diff(ends)):
                if (blob := by.get(k * parts + int(i))) is None:
                    raise ValueError("the documents differ between two passes over them; cut() them first")
                total[ends[i] : ends[i + 1]] = _totals(blob, ends[i + 1] - ends[i])
            counts.append(total[which])
        return Counted(counts, batch.end, docs, tokens), batch, len(own)

    def share(self, k: int, gone: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Maximum-likelihood share of each token in order k + 1, and its context's frequency; gone: 1 if the token is
        deleted from the counts."""
        context = self.contexts[k] - gone
        return (self.counts[k] - gone) / np.maximum(context, 1), context

    def mixed(self, weights: list[np.ndarray], types: int, gone: int = 0) -> np.ndarray:
        """Probability of each token by the orders that have weights."""
        out = np.full(len(self.counts[0]), 1 / (types + 1))
        for k, weight in enumerate(weights):
            own, context = self.share(k, gone)
            w = weight[_bucket_of(context)]
            out = w * own + (1 - w) * out
        return out


def _bucket_of(context: np.ndarray) -> np.ndarray:
    return np.minimum(np.where(context > 0, np.floor(np.log2(np.maximum(context, 1))) + 1, 0), BUCKETS - 1).astype(np.int64)


def _place(ratio: np.ndarray) -> np.ndarray:
    """Place of a ratio on the logarithmic scale; 0 for none."""
    step = np.round((np.log10(np.maximum(ratio, 1e-300)) + DECADES) * STEPS)
    return np.where(ratio > 0, np.clip(step, 0, PLACES - 2) + 1, 0).astype(np.int64)


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[int, bytes]]]:
    last, held = None, []
    for batch in batches:
        for key, bucket, blob in zip(*(c.to_pylist() for c in batch.columns[:3])):
            if key != last and held:
                yield held
                held = []
            last = key
            held.append((bucket, blob))
    if held:
        yield held


def _deleted(parts: int, docs: int, tokens: int, order: int):
    """A row for each batch of the fold for EM: how often it comes, its documents' ends, and all counts of its tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _grouped(batches):
            if any(bucket < 0 for bucket, _ in rows):
                c, _, times = Counted.of(rows, parts, docs, tokens, order)
                yield table("times long,ends binary,counts binary", times=[times], ends=[pack(c.end.astype(np.int64))], counts=[pack(np.concatenate(c.counts))])

    return run


def _ratios(docs: int, tokens: int, types: int, order: int, weights: list[np.ndarray]):
    """Histogram of the ratios (n-gram's share over the share below) by context bucket, every token deleted from the
    counts, for the first order without weights."""
    k = len(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS * PLACES, np.int64)
        for batch in batches:
            for times, ends, counts in zip(*(c.to_pylist() for c in batch.columns)):
                c = Counted(list(unpack(counts, np.int64).reshape(order, -1)), unpack(ends, np.int64), docs, tokens)
                own, context = c.share(k, 1)
                place = _bucket_of(context) * PLACES + _place(own / c.mixed(weights, types, 1))
                total += np.bincount(place, minlength=len(total)) * times
        by = total.reshape(BUCKETS, -1)
        used = np.flatnonzero(by.any(1))
        yield table("part int,total binary", part=used, total=[pack(by[i]) for i in used])

    return run


def _add(group: pa.Table) -> pa.Table:
    total = sum(unpack(b, np.int64) for b in group.column("total").to_pylist())
    return pa.Table.from_batches([table("part int,total binary", part=[group.column("part")[0].as_py()], total=[pack(total)])])


def blend(total: np.ndarray, rounds: int = 200) -> np.ndarray:
    """Weight of an order against the model below it in each context bucket, by EM on histograms (BUCKETS x PLACES)."""
    ratio = np.concatenate(([0.0], 10.0 ** (np.arange(PLACES - 1) / STEPS - DECADES)))
    out = np.zeros(BUCKETS)
    for k in range(1, BUCKETS):  # an unseen context has no n-grams
        n = total[k].astype(np.float64)
        if not n.any():
            out[k] = out[k - 1]
            continue
        used, w = np.flatnonzero(n), 0.5
        r, n = ratio[used], n[used]
        for _ in range(rounds):
            w = float((n * w * r / (w * r + 1 - w)).sum() / n.sum())
        out[k] = min(w, 1 - 1e-6)
    return out


_SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _score(parts: int, docs: int, tokens: int, types: int, order: int, weights: list[np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _grouped(batches):
            c, b, times = Counted.of(rows, parts, docs, tokens, order)
            word, begin = c.counts[0], b.end - b.size
            base = np.add.reduceat(np.log10((word + 1) / (tokens + types + 1)), begin)
            score, known = np.add.reduceat(np.log10(c.mixed(weights, types)), begin), np.add.reduceat((word > 0).astype(np.int64), begin)
            ids = pa.array(b.ids, mask=b.nulls)
            for _ in range(times):
                yield table(_SCORES, doc_id=ids, held_out=b.folds == -2, n_tokens=b.size, n_known=known, train_tokens=np.full(len(b.ids), tokens), base_score=base, score=score)

    return run


def score(docs: DataFrame, parts: int = 7, held: int = 2, fold: int = 3, order: int = 3) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Rows whose crc32 of doc_id modulo parts is held teach nothing; those where it is fold teach the mixture weights
    (and count, with each token deleted while it is predicted).  Where no row is in that fold the next one with rows
    takes its place.  order is the length of the longest n-grams.
    """
    if order < 1:
        raise ValueError("order must be 1 or more")
    own = fold_of("doc_id", parts)
    rows = need(docs, doc_id="long", text="string").select("doc_id", "text", F.when(own == held, -2).otherwise(own).cast("int").alias("fold"))
    buckets = fanout(rows)
    # every document has an end, so a fold with rows has tokens to predict
    there = {r.fold for r in rows.groupBy("fold").agg(F.count(F.lit(1)).alias("n")).collect()}
    fold = next((f for f in ((fold + i) % parts for i in range(parts)) if f in there), fold)
    with scratch(docs.sparkSession) as keep:
        asked = rows.mapInArrow(tidy(_ask(buckets, fold, order)), _ASKED.replace(",", ", "))
        answers = keep(cut(asked.groupBy("bucket").applyInArrow(tidy(_answer(buckets)), _ANSWER.replace(",", ", "))))
        found = answers.where("batch is null").agg(F.sum(F.when(F.col("bucket") < buckets, F.col("n"))).alias("tokens"), F.sum(F.when(F.col("bucket") < buckets, F.col("types"))).alias("types"), F.sum("docs").alias("docs")).first()
        tokens, types, ends = found.tokens or 0, found.types or 0, found.docs or 0
        answers = answers.where("batch is not null")

        def together(only: bool) -> DataFrame:
            both = rows.mapInArrow(_carry(fold, only), "batch long, bucket int, counts binary").unionByName((answers.where("teaches") if only else answers).select("batch", "bucket", "counts"))
            return both.repartition(buckets, "batch").sortWithinPartitions("batch", "bucket")

        taught = cut(together(True).mapInArrow(tidy(_deleted(buckets, ends, tokens, order)), "times long, ends binary, counts binary"))
        weights: list[np.ndarray] = []
        for _ in range(order):
            total = np.zeros((BUCKETS, PLACES), np.int64)  # of fixed size
            found = taught.mapInArrow(tidy(_ratios(ends, tokens, types, order, weights)), "part int, total binary").groupBy("part").applyInArrow(_add, "part int, total binary")
            for part, blob in found.collect():
                total[part] = unpack(blob, np.int64)
            weights.append(blend(total))
    return together(False).mapInArrow(tidy(_score(buckets, ends, tokens, types, order, weights)), _SCORES)
