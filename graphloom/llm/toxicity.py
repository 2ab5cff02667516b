"""Toxicity by weak supervision.

1. Voters, each of which votes toxic, votes clean or abstains.  Fixed lexicons of common insults, by kind; mined
   lexicons; patterns (shouting, exclamation, doubled punctuation, long words).  A mined lexicon is a share of the words
   and word beginnings, found once or found again in a document, that toxic documents of a bounded labelled sample have
   far more often.  They are mined in folds: a document's votes come from lexicons for which its own label wasn't read.
2. Label model.  A generative model of the unknown label and the votes: each voter has the rates of its three votes
   under both labels (its accuracy and coverage), and depends on one other voter as well; this tree of correlations is
   the one of the largest conditional mutual information, and is estimated anew in each round of the
   expectation-maximisation, together with the rates and the share of label 1.  It starts from the majority of the votes.
   The labels of two folds of five calibrate it; those of the others it never sees.
3. Classifier.  A logistic regression over the lexicons' entries and the patterns, trained on the posterior labels;
   it scores every document by its whole text.  The given labels only set its intercept.

Only labels of training rows (crc32 of doc_id modulo parts is not held) are read; lang, source and doc_id are never
inputs.

Edge cases: null and empty texts get the score of no feature; very long texts are scored whole; documents with several
labels take the largest; labels without a toxic value are no labels; without a toxic training label every score is 0;
repeated rows each get their row; a null doc_id is held out of training; an empty table gives an empty result; further
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .common import LOWER, NONWORD, fold_of, need, pack, slices, table, text_bytes, unpack, word_ends, words

#: Bytes of a word's beginnings that are features beside the whole word.
BEGINNINGS = (4, 5, 6, 7)
KINDS = 1 + len(BEGINNINGS)
PATTERNS = 4
#: Marks a feature that a document holds twice or more.
_TWICE = np.uint64(8)
#: Evidence (sum of log odds of the entries found) from which a mined lexicon votes toxic; with less it abstains.
ENOUGH = 3.0
#: Voters among which the mined entries are dealt, and folds whose labels calibrate the label model.
SHARES, CALIBRATE = 4, 2
ABSTAIN, CLEAN, TOXIC = 0, 1, 2
#: Folds in which lexicons are mined.
FOLDS = 5
# Common insults, by kind.
INSULTS = {
    "mind": "idiot idiots idiotic moron morons stupid dumb dumbass fool fools imbecile cretin retard braindead halfwit dimwit",
    "worth": "loser losers worthless pathetic useless clown clowns nobody failure coward",
    "disgust": "scum trash garbage filth filthy disgusting vermin pig pigs swine ugly vile",
    "threat": "kill hate strangle hang shoot slaughter",
    "other": "idiota idiote imbécile crétin ordure estúpido basura escoria trottel abschaum dumm dreck",
}
_SKETCH = np.random.default_rng(29).integers(1, 2**63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SALT = np.random.default_rng(23).integers(1, 2**63, KINDS, dtype=np.uint64)


def features(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of a slice's features, one for each place, with their kind in the lowest four bits; the row of each;
    pattern votes by row."""
    rows = len(offs) - 1
    h, starts, first = words(buf, offs, NONWORD)
    ends = word_ends(buf, offs, NONWORD)
    row = np.repeat(np.arange(rows), np.diff(first))
    out, owner = [common.mix(h ^ _SALT[0]) & ~np.uint64(15)], [row]
    low = LOWER[buf]
    power, inverse = common._powers(len(buf) + 1)
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(common._BYTE[low] * power[: len(buf)], out=total[1:])
    for k, n in enumerate(BEGINNINGS, 1):
        long = np.flatnonzero(ends - starts > n)
        begin = common.mix(((total[starts[long] + n] - total[starts[long]]) * inverse[starts[long]]) ^ _SALT[k])
        out.append(begin & ~np.uint64(15) | np.uint64(k))
        owner.append(row[long])
    votes = np.zeros((rows, PATTERNS), bool)
    sizes = np.maximum(np.diff(first), 1)

    def per_row(mask: np.ndarray) -> np.ndarray:
        c = np.concatenate(([0], np.cumsum(mask)))
        return c[offs[1:]] - c[offs[:-1]]

    letters = np.maximum(per_row((low >= 97) & (low <= 122)), 1)
    votes[:, 0] = per_row((buf >= 65) & (buf <= 90)) > 0.3 * letters
    votes[:, 1] = per_row(buf == 33) > 0.2 * sizes
    votes[:, 2] = per_row(np.concatenate(((buf[1:] == buf[:-1]) & NONWORD[buf[1:]] & (buf[1:] > 32), [False])) if len(buf) else buf.astype(bool)) > 0.1 * sizes
    votes[:, 3] = np.diff(offs) > 12 * sizes
    return np.concatenate(out), np.concatenate(owner), votes


def _slices(column: pa.Array):
    buf, offs = text_bytes(column)
    for lo, hi in slices(offs):
        yield lo, hi, *features(buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])


def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """by, toxic, features (distinct, and those that come twice or more once again), votes of sampled documents."""
    for batch in batches:
        for lo, hi, h, row, votes in _slices(batch.column(0)):
            order = np.lexsort((h, row))
            h, row = h[order], row[order]
            fresh = np.ones(len(h), bool)
            fresh[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
            again = np.zeros(len(h), bool)
            again[:-1] = fresh[:-1] & ~fresh[1:]
            ends = np.searchsorted(row, np.arange(hi - lo + 1))
            own = [np.concatenate((x[f], x[g] | _TWICE)) for x, f, g in ((h[e], fresh[e], again[e]) for e in (slice(ends[i], ends[i + 1]) for i in range(hi - lo)))]
            least = [np.array([(x * k).min() if len(x) else 0 for k in _SKETCH], np.uint64).tobytes() for x in own]
            yield table("by long,toxic int,features binary,votes binary,least binary", by=batch.column(1)[lo:hi], toxic=batch.column(2)[lo:hi], features=[x.tobytes() for x in own], votes=[v.tobytes() for v in votes], least=least)


def one_of_each(sketches: list[tuple[int, bytes]]) -> set[int]:
    """Names of the documents (name, minimum hashes) of which no earlier one has half of the hashes: copies, near ones
    too, teach nothing and would make any of their words look like a sign."""
    index: dict[tuple[int, int], list[int]] = {}
    kept: set[int] = set()
    for name, blob in sorted(sketches):
        least = list(enumerate(np.frombuffer(blob, np.uint64).tolist()))
        alike: dict[int, int] = {}
        for key in least:
            for other in index.get(key, ()):
                alike[other] = alike.get(other, 0) + 1
        if max(alike.values(), default=0) < len(_SKETCH) // 2:
            kept.add(name)
            for key in least:
                index.setdefault(key, []).append(name)
    return kept


class LabelModel:
    """Label and votes: P(label) * P(root's vote | label) * product of P(vote | vote of the voter's parent, label)."""

    def __init__(self, voters: int):
        self.prior, self.parent, self.order = 0.5, np.full(voters, -1), list(range(voters))
        self.rates = np.full((2, voters, 3, 3), 1 / 3)  # label, voter, parent's vote, vote

    def estimate(self, votes: np.ndarray, post: np.ndarray, smooth: float = 0.5) -> None:
        """Share of labels, tree and rates from votes with these shares of label 1."""
        n, m = votes.shape
        one = np.eye(3)[votes].reshape(n, 3 * m)
        both = np.stack([(one * p[:, None]).T @ one for p in (1 - post, post)]).reshape(2, m, 3, m, 3)
        self.prior = float(np.clip(post.mean(), 1e-4, 1 - 1e-4))
        joint = (both + smooth / 9) / (np.array([(1 - post).sum(), post.sum()])[:, None, None, None, None] + smooth)
        single = np.stack([(one * p[:, None]).sum(0) for p in (1 - post, post)]).reshape(2, m, 3)
        alone = (single + smooth / 3) / (single.sum(2, keepdims=True) + smooth)
        share = np.array([1 - self.prior, self.prior])
        information = (share[:, None, None, None, None] * joint * np.log(joint / (alone[:, :, :, None, None] * alone[:, None, None, :, :]))).sum((0, 2, 4))
        self.parent, self.order, inside = np.full(m, -1), [0], {0}
        while len(inside) < m:  # the tree of the most information
            rest = [j for j in range(m) if j not in inside]
            i, j = max(((i, j) for i in self.order for j in rest), key=lambda x: (information[x], -x[0], -x[1]))
            self.parent[j] = i
            self.order.append(j)
            inside.add(j)
        for j in range(m):
            if self.parent[j] < 0:
                self.rates[:, j] = alone[:, j][:, None, :]
            else:  # few observations of the parent's vote lean on the voter's own rates
                pairs = both[:, self.parent[j], :, j, :]
                self.rates[:, j] = (pairs + smooth * alone[:, j][:, None, :]) / (pairs.sum(2, keepdims=True) + smooth)

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row of votes."""
        odds = np.full(len(votes), np.log(self.prior / (1 - self.prior)))
        for j, i in enumerate(self.parent):
            before = votes[:, i] if i >= 0 else np.zeros(len(votes), np.int64)
            odds += np.log(self.rates[1, j, before, votes[:, j]]) - np.log(self.rates[0, j, before, votes[:, j]])
        return 1 / (1 + np.exp(-np.clip(odds, -50, 50)))

    def fit(self, votes: np.ndarray, known: np.ndarray | None = None, rounds: int = 25) -> np.ndarray:
        """The posterior after expectation-maximisation from the majority of the votes, voters that say the same weighing
        less in it.

        known: labels of the few rows that calibrate the model (nan: unknown).
        """
        known = np.full(len(votes), np.nan) if known is None else known
        weight = 1 / _shared(votes).sum(1)
        for_, against = (votes == TOXIC) @ weight, (votes == CLEAN) @ weight
        post = np.clip((for_ + 0.25) / (for_ + against + 1), 0.02, 0.98)
        for _ in range(rounds):
            self.estimate(votes, np.where(np.isnan(known), post, known))
            post = self.posterior(votes)
        return post


def _shared(votes: np.ndarray) -> np.ndarray:
    """Share of each voter's information that each voter has as well."""
    n, m = votes.shape
    one = np.eye(3)[votes].reshape(n, 3 * m)
    joint = (one.T @ one).reshape(m, 3, m, 3) / max(n, 1)
    alone = one.mean(0).reshape(m, 3)
    with np.errstate(divide="ignore", invalid="ignore"):
        information = np.where(joint > 0, joint * np.log(joint / (alone[:, :, None, None] * alone[None, None])), 0).sum((1, 3))
    return np.clip(information / np.maximum(np.diag(information)[:, None], 1e-12), 0, 1)


def fit_linear(x: np.ndarray, y: np.ndarray, l2: float = 5e-5, rounds: int = 500, rate: float = 0.1) -> tuple[np.ndarray, float]:
    """Weights and intercept of a logistic regression on soft labels (Adam on all rows)."""
    w, b = np.zeros(x.shape[1], np.float32), 0.0
    m, s = np.zeros(x.shape[1] + 1), np.zeros(x.shape[1] + 1)
    for t in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-np.clip(x @ w + b, -50, 50)))
        e = ((p - y) / len(y)).astype(np.float32)
        g = np.append(x.T @ e + l2 * w, e.sum())
        m, s = 0.9 * m + 0.1 * g, 0.999 * s + 0.001 * g * g
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-8)
        w, b = (w - step[:-1]).astype(np.float32), b - float(step[-1])
    return w, b


def insults() -> dict[str, np.ndarray]:
    """Feature hashes of the fixed lexicons' words."""
    out = {}
    for kind, listed in INSULTS.items():
        h, _, _ = words(*text_bytes(pa.array([listed], pa.string())), NONWORD)
        out[kind] = np.unique(common.mix(h ^ _SALT[0]) & ~np.uint64(15))
    return out


def mined(at: list[np.ndarray], toxic: np.ndarray, size: int, keys: int, few: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the features that toxic documents have far more often than chance explains, the strongest first, and the
    log odds of all features."""
    every = np.zeros((2, keys))
    for t, a in zip(toxic, at):
        every[t, a] += 1
    total = np.array([(toxic == 0).sum(), (toxic == 1).sum()])
    odds = np.log((every[1] + 0.5) / (total[1] + 1)) - np.log((every[0] + 0.5) / (total[0] + 1))
    sure = odds - 1.64 * np.sqrt(1 / (every[1] + 0.5) + 1 / (every[0] + 0.5))
    good = np.flatnonzero((sure > 1.5) & (every[1] >= few))
    return good[np.argsort(-(odds * np.sqrt(every[1]))[good], kind="stable")][:size], odds


def fit(docs: DataFrame, labels: DataFrame, toxic_docs: int = 1500, other_docs: int = 3000, parts: int = 5, held: int = 0, size: int = 2000) -> dict:
    """The model: sorted feature hashes, weights, weights of the patterns, intercept.

    toxic_docs and other_docs bound the labelled documents that it is fitted on, size its features.
    """
    with common.scratch(docs.sparkSession):
        return _fit(docs, labels, toxic_docs, other_docs, parts, held, size)


def _fit(docs: DataFrame, labels: DataFrame, toxic_docs: int, other_docs: int, parts: int, held: int, size: int) -> dict:
    none = {"hashes": np.zeros(0, np.uint64), "weights": np.zeros((2, 0)), "patterns": np.zeros(PATTERNS), "intercept": -50.0}
    truth = need(labels, doc_id="long", toxic="int").where("toxic in (0, 1) and doc_id is not null").where(fold_of("doc_id", parts) != held)
    truth = truth.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    there = {r.toxic: r.n for r in truth.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not there.get(1):
        return none
    chance = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 30)) / float(1 << 30)
    share = F.when(F.col("toxic") == 1, F.lit(toxic_docs / there[1])).otherwise(F.lit(other_docs / max(1, there.get(0, 0))))
    room = 2 * (toxic_docs + other_docs)  # the expected number is half of it; so the broadcast is bounded
    chosen = F.broadcast(truth.where(chance < share).withColumnRenamed("doc_id", "chosen").orderBy(F.xxhash64("chosen", F.lit(5)), "chosen").limit(room))
    rows = need(docs, doc_id="long", text="string")
    sample = common.cut(rows.join(chosen, rows["doc_id"] == chosen["chosen"]).select("text", F.xxhash64("doc_id", F.lit(6)).alias("by"), "toxic").mapInArrow(common.tidy(_distinct), "by long, toxic int, features binary, votes binary, least binary"))
    kept = {t: one_of_each([(r.by, r.least) for r in sample.where(F.col("toxic") == t).select("by", "least").collect()]) for t in (0, 1)}

    hashes, tally = [], []
    for r in sample.where("toxic = 1").select("by", "features").toLocalIterator():
        if r.by in kept[1]:
            hashes.append(np.frombuffer(r.features, np.uint64))
            if len(hashes) >= 300:
                tally.append(np.unique(np.concatenate(hashes), return_counts=True))
                hashes = []
    if hashes:
        tally.append(np.unique(np.concatenate(hashes), return_counts=True))
    if not tally:  # no document has a toxic label
        return none
    keys, which = np.unique(np.concatenate([k for k, _ in tally]), return_inverse=True)
    n1 = np.zeros(len(keys), np.int64)
    np.add.at(n1, which, np.concatenate([c for _, c in tally]))
    few = max(3, min(5, len(kept[1]) // 20))
    fixed = insults()
    keys = np.union1d(keys[n1 >= few - 1], np.concatenate(list(fixed.values())))
    shared = docs.sparkSession.sparkContext.broadcast(keys)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            at = []
            for b in batch.column(2).to_pylist():
                own = np.frombuffer(b, np.uint64)
                i = np.minimum(np.searchsorted(known, own), len(known) - 1)
                at.append(pack(i[known[i] == own].astype(np.uint32)))
            yield table("by long,toxic int,votes binary,at binary", by=batch.column(0), toxic=batch.column(1), votes=batch.column(3), at=at)

    data = sample.mapInArrow(places, "by long, toxic int, votes binary, at binary").collect()
    data = [r for _, r in sorted({(r.toxic, r.by): r for r in data if r.by in kept[r.toxic]}.items())]
    return learn([unpack(r.at, np.uint32) for r in data], np.array([r.toxic for r in data]), np.array([r.by % FOLDS for r in data]), np.array([np.frombuffer(r.votes, bool) for r in data]), keys, size, few, there[1] / sum(there.values())) or none


def learn(at: list[np.ndarray], toxic: np.ndarray, fold: np.ndarray, patterns: np.ndarray, keys: np.ndarray, size: int, few: int, real: float) -> dict | None:
    """Voters, label model and classifier of documents with these features (places in keys), labels, folds and patterns;
    real: the share of toxic ones among all."""
    good = np.sort(mined(at, toxic, size, len(keys), few)[0])
    if not len(good):
        return None
    share = (common.mix(keys) % np.uint64(SHARES)).astype(np.int64)
    fixed = [np.isin(keys, h) for h in insults().values()]
    first = len(fixed)
    votes = np.full((len(at), first + SHARES + PATTERNS), ABSTAIN)
    for f in range(FOLDS):
        others = np.flatnonzero(fold != f)
        chosen, odds = mined([at[i] for i in others], toxic[others], size, len(keys), max(2, few - 1))
        worth = np.zeros(len(keys))
        worth[chosen] = odds[chosen]
        for i in np.flatnonzero(fold == f):
            own = at[i]
            for k, listed in enumerate(fixed):
                if listed[own].any():
                    votes[i, k] = TOXIC
            evidence = np.bincount(share[own], worth[own], SHARES)
            votes[i, first : first + SHARES] = np.where(evidence >= ENOUGH, TOXIC, np.where(evidence > 0, ABSTAIN, CLEAN))
    votes[:, first + SHARES :] = np.where(patterns, TOXIC, ABSTAIN)
    votes = votes[:, (votes != votes[:1]).any(0)]  # voters that never differ say nothing
    post = LabelModel(votes.shape[1]).fit(votes, np.where(fold < CALIBRATE, toxic, np.nan)) if votes.shape[1] else toxic.astype(np.float64)

    place = np.full(len(keys), -1)
    place[good] = np.arange(len(good))
    x = np.zeros((len(at), len(good) + PATTERNS), np.float32)
    for i, a in enumerate(at):
        p = place[a]
        x[i, p[p >= 0]] = 1
    x[:, len(good) :] = patterns
    weights, intercept = fit_linear(x, post)
    mean = float(np.clip(post.mean(), 1e-6, 1 - 1e-6))
    intercept += np.log(real / (1 - real) if real < 1 else 1e3) - np.log(mean / (1 - mean))
    hashes = np.unique(keys[good] & ~_TWICE)
    both = np.zeros((2, len(hashes)))
    np.add.at(both, ((keys[good] & _TWICE > 0).astype(int), np.searchsorted(hashes, keys[good] & ~_TWICE)), weights[:-PATTERNS])
    return {"hashes": hashes, "weights": both, "patterns": weights[-PATTERNS:].astype(np.float64), "intercept": float(intercept)}


def score(docs: DataFrame, model: dict, threshold: float = 0.5, parts: int = 5, held: int = 0) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    schema = "doc_id long, held_out boolean, score double, predicted int"
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            for lo, hi, s in scorer.slices(batch.column(1)):
                yield table(schema, doc_id=batch.column(0)[lo:hi], held_out=batch.column(2)[lo:hi], score=s, predicted=(s >= threshold).astype(np.int32))

    rows = need(docs, doc_id="long", text="string").select("doc_id", "text", (fold_of("doc_id", parts) == held).alias("held_out"))
    return rows.mapInArrow(common.tidy(run), schema)


class Scorer:
    """Scores of whole texts: the logistic of the intercept and the weights of the distinct features and patterns."""

    def __init__(self, model: dict):
        self.model = model
        self.filter = np.zeros(1 << 20, bool)
        self.filter[(model["hashes"] >> np.uint64(44)).astype(np.int64)] = True

    def slices(self, column: pa.Array) -> Iterator[tuple[int, int, np.ndarray]]:
        hashes, weights = self.model["hashes"], self.model["weights"]
        for lo, hi, h, row, votes in _slices(column):
            maybe = np.flatnonzero(self.filter[(h >> np.uint64(44)).astype(np.int64)])
            total = self.model["intercept"] + votes @ self.model["patterns"]
            if len(maybe):
                at = np.minimum(np.searchsorted(hashes, h[maybe]), len(hashes) - 1)
                hit = hashes[at] == h[maybe]
                pairs, times = np.unique(row[maybe][hit] * len(hashes) + at[hit], return_counts=True)
                place = pairs % max(1, len(hashes))
                np.add.at(total, pairs // max(1, len(hashes)), weights[0, place] + np.where(times > 1, weights[1, place], 0))
            yield lo, hi, 1 / (1 + np.exp(-np.clip(total, -50, 50)))


def reject(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **limits) -> DataFrame:
    """docs without the rows that are scored toxic, all columns as they are, whatever their names.

    Null and empty texts are scored like any other by the intercept and stay where that is below the threshold; long
    texts are scored whole; rows without doc_id are scored and teach nothing; repeated rows stay or go together; without
    labels of toxic rows all stay; an empty table stays empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, **limits))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            for lo, hi, s in scorer.slices(batch.column(at)):
                keep[lo:hi] = s < threshold
            yield batch.filter(pa.array(keep))

    return common.map_rows(docs, common.tidy(run), docs.columns)
