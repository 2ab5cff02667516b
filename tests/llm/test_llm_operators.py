"""The operators against plain versions, with nulls, empty and long texts, ties, repeated rows, empty tables and
columns of clashing names."""

import hashlib
import math
import os
import random
import zlib
from collections import Counter, defaultdict

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import common, decontam, jaccard, langid, lines, lm, pieces, secrets, topk, toxicity, warc
from graphloom.llm.components import components
from graphloom.llm.queries import model_path

DOCS = "doc_id long, text string"


def docs(spark, rows):
    """Documents with further columns whose names the operators use themselves."""
    df = spark.createDataFrame(rows, DOCS)
    return df.withColumns({n: F.lit(n) for n in ("__text", "_text", "_OF", "_at", "_least", "_doc", "_row_id", "_dropped", "_n_dropped", "_spans", "_items")}).withColumns({"node": F.lit("x"), "row_id": F.lit(1), "n": F.lit(None).cast("string"), "score": F.lit(0), "_row": F.lit(2), "kept": F.lit("k"), "a.b": F.lit(1)})


def by_doc(rows, *names):
    out = defaultdict(list)
    for r in rows:
        out[r.doc_id].append(tuple(r[n] for n in names))
    return {k: sorted(v, key=repr) for k, v in out.items()}


def odd_texts():
    return [None, "", " ", "\n", "a", "A", "a b c d", "é É ß 你好", "x" * 5000, "word " * 4000, "tab\tand\x0bmore\r\nlines", "\x00nul"]


# --------------------------------------------------------------------------- kernels


def test_words_and_shingles_are_whole():
    import pyarrow as pa

    texts = odd_texts() + ["one two three four five six", "ONE two\nthree four five six"]
    buf, offs = common.text_bytes(pa.array(texts, pa.string()))
    h, starts, first = common.words(buf, offs, common.SPACE)
    ends = common.word_ends(buf, offs, common.SPACE)
    for i, t in enumerate(texts):
        want = (t or "").encode().lower().split()
        assert [bytes(common.LOWER[buf[starts[k] : ends[k]]]) for k in range(first[i], first[i + 1])] == want
    s, to = common.shingles(h, first)
    assert list(s[to[-3] : to[-2]]) == list(s[to[-2] : to[-1]]) and to[-1] - to[-2] == 2


def test_packing():
    h = np.sort(np.random.default_rng(1).integers(0, 2**63, 500, dtype=np.uint64))
    assert (common.unpack_sorted(common.pack_sorted(h), 500) == h >> np.uint64(8)).all()
    assert (common.unpack_sorted(common.pack_sorted(h, 0), 500) == h).all()
    assert len(common.unpack_sorted(common.pack_sorted(h[:0]), 0)) == 0
    assert (jaccard.unpack_prefix(jaccard.pack_prefix(h)) == h >> np.uint64(16) << np.uint64(16)).all()


def test_scratch_tables_go(spark):
    made = []
    with common.scratch(spark) as keep:
        a, b = common.cut(spark.range(3)), keep(common.cut(spark.range(4)))
        made += [a._table_path, b._table_path]
    assert b.count() == 4
    there = spark._jvm.org.apache.hadoop.fs.Path(made[0])
    assert not there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there)


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 400)]
    df = spark.createDataFrame(edges, "a long, b long").repartition(7)
    up = {x: x for e in edges for x in e}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        up[y] = x
    assert {r.node: r.component for r in components(df).collect()} == {x: find(x) for x in up}


# --------------------------------------------------------------------------- 1


def near_copies(seed=5):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]

    def text(n):
        return [rng.choice(vocabulary) for _ in range(n)]

    rows, base, hot = [], text(90), text(40)
    for i in range(160):
        t = list(base)
        for _ in range(rng.randrange(0, 5)):
            t[rng.randrange(len(t))] = rng.choice(vocabulary)
        rows.append((i, " ".join(t)))
    rows += [(i, " ".join(text(rng.randrange(1, 60)) + (hot if rng.random() < 0.5 else []))) for i in range(200, 280)]
    at = text(60)
    for i in range(300, 340):  # a chain of small changes
        at = list(at)
        at[rng.randrange(len(at))] = rng.choice(vocabulary)
        rows.append((i, " ".join(at)))
    rows += [(400 + i, t) for i, t in enumerate(odd_texts())] + [(400, "a b c d"), (3, rows[3][1]), (500, rows[0][1].upper())]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("block_rows", [16, 128])
def test_jaccard_against_brute_force(spark, block_rows):
    rows = near_copies()
    got = by_doc(jaccard.join(docs(spark, rows), block_rows=block_rows).collect(), "n_shingles", "component_id")
    assert got == {k: sorted(v) for k, v in brute.jaccard_components(rows).items()}


def test_jaccard_edges(spark):
    got = by_doc(jaccard.join(docs(spark, [(None, "a b c d e f"), (2, "a b c d e f"), (1, None)])).collect(), "n_shingles", "component_id")
    assert got == {None: [(2, None)], 2: [(2, 2)], 1: [(0, 1)]}
    assert jaccard.join(docs(spark, [])).count() == 0
    rows = [(3, "a b c d e f"), (3, "q r s t u v"), (1, "q r s t u v"), (3, None), (7, None), (7, "")]  # one id, several texts
    got = by_doc(jaccard.join(docs(spark, rows)).collect(), "n_shingles", "component_id")
    assert got == {k: sorted(v, key=repr) for k, v in brute.jaccard_components(rows).items()} == {3: [(0, 1), (2, 1), (2, 1)], 1: [(2, 1)], 7: [(0, 7), (0, 7)]}
    assert {r.component_id for r in jaccard.links(docs(spark, rows)).where("doc_id < 7").collect()} == {1}
    kept = jaccard.representatives(docs(spark, near_copies()))
    assert kept.columns == docs(spark, []).columns
    want = brute.jaccard_components(near_copies())
    assert sorted(r.doc_id for r in kept.select("doc_id").collect()) == sorted(d for d, v in want.items() if v[0][1] == d)


def test_signature_tree_bound_never_drops_a_link():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 80, dtype=np.uint64)
    sets = []
    for _ in range(60):
        s = base.copy()
        at = rng.integers(0, 80, int(rng.integers(0, 20)))
        s[at] = rng.integers(0, 2**63, len(at), dtype=np.uint64)
        sets.append(np.unique(s[: int(rng.integers(40, 81))]))
    tree = jaccard.SignatureTree(sets)
    found = set()
    label = np.arange(len(sets))
    for i, j in jaccard.link_trees(tree, tree, label, label, 80):  # labels stay apart, so every link must come
        found.add(frozenset((tree.order[i], tree.order[j])))
    want = {frozenset((i, j)) for i in range(60) for j in range(i) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 80 * len(np.union1d(sets[i], sets[j]))}
    assert found == want and want


@pytest.mark.parametrize("block_rows", [16, 128])
def test_jaccard_links_and_pairs_are_whole(spark, block_rows):
    rows = [(d, t) for d, t in near_copies() if d not in (3, 400)]  # ids that come once
    rows += [(3, near_copies()[0][1]), (None, "a b c d e f")]
    sets = {}
    for d, t in rows:
        w = (t or "").encode().lower().split()
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}
    known = [d for d in sets if d is not None]
    linked = {(a, b) for a in known for b in known if a != b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    degree = Counter(a for a, _ in linked)
    found = jaccard.links(docs(spark, rows), block_rows=block_rows).collect()
    assert {r.doc_id: r.n_links for r in found} == {d: None if d is None else degree[d] for d in sets} and len(found) == len(rows)
    same = lambda df: by_doc(df.collect(), "n_shingles", "component_id", "class_id")
    assert by_doc(found, "n_shingles", "component_id", "class_id") == same(jaccard.join(docs(spark, rows), block_rows=block_rows))
    first = {r.doc_id: r.class_id for r in found}
    want = {(a, b): (len(sets[a]), len(sets[b]), len(sets[a] & sets[b])) for a, b in linked if a < b and first[a] == a and first[b] == b}
    got = jaccard.pairs(docs(spark, rows), block_rows=block_rows).collect()
    assert {(r.a, r.b): (r.n_a, r.n_b, r.shared) for r in got} == want and len(got) == len(want) > 200


# --------------------------------------------------------------------------- 2


def test_lm_counts_are_exact_and_model_is_better(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(["the cat", "sat on", "a mat", "dogs bark", f"u{rng.randrange(500)}"]) for _ in range(rng.randrange(0, 40)))) for i in range(300)]
    rows += [(1000 + i, t) for i, t in enumerate(odd_texts())] + [(1, rows[1][1]), (None, "the cat")]
    got = by_doc(lm.score(docs(spark, rows).repartition(3, "doc_id")).collect(), "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
    tokens = lambda t: [*(t or "").encode().lower().split(), None]
    fold = lambda d: zlib.crc32(str(d).encode()) % 7
    counts = Counter(w for d, t in rows if d is not None and fold(d) != 2 for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    want = defaultdict(list)
    for d, t in rows:
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens(t))
        want[d].append((d is not None and fold(d) == 2, len(tokens(t)), sum(counts[w] > 0 for w in tokens(t)), n, base))
    assert got.keys() == want.keys()
    held = [0.0, 0.0]
    for d, own in want.items():
        own.sort(key=repr)
        for a, b in zip(got[d], own):
            assert a[:4] == b[:4] and a[4] == pytest.approx(b[4], abs=1e-6) and a[5] < 0
            if a[0]:
                held[0] += a[4]
                held[1] += a[5]
    assert held[1] > held[0]


@pytest.mark.parametrize("order", [1, 2, 3])
def test_lm_score_against_brute_force(spark, order):
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choice(["a b c", "b c a", "c c", "d e", "d f", f"u{rng.randrange(40)}"]) for _ in range(rng.randrange(0, 12)))) for i in range(220)]
    rows += [(500, "a b c d e " * 300), (501, None), (502, ""), (None, "a b zz")]
    fold = lambda d: -1 if d is None else zlib.crc32(str(d).encode()) % 7
    tokens = {d: [*(t or "").split(), ""] for d, t in rows}
    train = [tokens[d] for d, _ in rows if d is not None and fold(d) != 2]
    want = brute.lm_scores(train, [tokens[d] for d, _ in rows if fold(d) == 3], [tokens[d] for d, _ in rows], order)
    got = {r.doc_id: r.score for r in lm.score(docs(spark, rows), order=order).collect()}
    for (d, _), w in zip(rows, want):
        assert got[d] == pytest.approx(w, abs=3e-3 * len(tokens[d]))  # ratios are rounded to a 200th of a decade


def test_lm_totals_beyond_32_bits():
    n = 10
    for big in (7, 2**40 + 3):
        assert (lm._totals(common.pack(np.full(n, big, np.uint32 if big < 2**32 else np.int64)), n) == big).all()
    rows = [{"bucket": 0, "batch": i, "teaches": False, "n": 1, "grams": common.pack_sorted(np.array([5], np.uint64), 0), "counts": common.pack(np.array([2**32 - 1], np.uint32))} for i in range(3)]
    import pyarrow as pa

    out = lm._answer(4)(pa.Table.from_pylist(rows)).to_pylist()
    assert [int(lm._totals(r["counts"], 1)[0]) for r in out if r["batch"] is not None] == [3 * (2**32 - 1)] * 3 and out[-1]["n"] == 3 * (2**32 - 1)


def test_lm_trigrams_tell_what_bigrams_cannot(spark):
    rng = random.Random(2)
    phrases = ["a x b", "c x d", "e x f", "g x h"]  # only the word before x tells the word after it
    rows = [(i, " ".join(rng.choice(phrases) for _ in range(30))) for i in range(300)]
    held = {}
    for order in (2, 3, 4):
        found = lm.score(docs(spark, rows), order=order).where("held_out").agg(F.sum("score"), F.sum("n_tokens")).first()
        held[order] = found[0] / found[1]
    # of three words one is free; bigrams take the word after x as free as well
    assert held[3] > held[2] + 0.15 and held[3] == pytest.approx(math.log10(1 / 4) / 3, abs=0.05) and held[4] == pytest.approx(held[3], abs=0.05)
    default = lm.score(docs(spark, rows)).where("held_out").agg(F.sum("score"), F.sum("n_tokens")).first()
    assert default[0] / default[1] == pytest.approx(held[3])
    with pytest.raises(ValueError):
        lm.score(docs(spark, rows), order=0)


def test_lm_empty(spark):
    assert lm.score(docs(spark, [])).count() == 0
    held = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 7 == 2)
    row = lm.score(docs(spark, [(held, "a b")])).first()  # nothing to learn from
    assert (row.train_tokens, row.n_known, row.n_tokens) == (0, 0, 3) and row.score == pytest.approx(0)


# --------------------------------------------------------------------------- 3


def test_toxicity_on_held_out_rows(spark):
    rng = random.Random(2)
    mild = [f"word{i}" for i in range(400)]
    rows, labels = [], []
    for i in range(1500):
        bad = i % 5 < 2
        w = [rng.choice(mild) for _ in range(rng.randrange(20, 80))]
        if bad:
            for _ in range(3):
                w[rng.randrange(len(w))] = rng.choice(["vilething", "vilest", "nastybit", "gruff"])
        rows.append((i, " ".join(w)))
        labels.append((i, int(bad), "x"))
    df = docs(spark, rows)
    truth = spark.createDataFrame([*labels, (None, 1, "x"), (0, None, "x")], "doc_id long, toxic int, text string")
    model = toxicity.fit(df, truth)
    got = {r.doc_id: r for r in toxicity.score(df, model).collect()}
    held = [(got[i].predicted, bad) for i, bad, _ in labels if got[i].held_out]
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 for i, r in got.items())
    assert sum(p == b for p, b in held) / len(held) > 0.97
    assert toxicity.score(docs(spark, list(enumerate(odd_texts()))), model).where("predicted = 0").count() == len(odd_texts())
    kept = toxicity.reject(df, truth)
    assert kept.columns == df.columns and {r.doc_id for r in kept.select("doc_id").collect()} == {i for i, r in got.items() if not r.predicted}


def test_toxicity_edges(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.fit(docs(spark, [(1, "a")]), none)
    assert toxicity.score(docs(spark, [(1, "a"), (None, None)]), model).where("predicted = 0").count() == 2
    assert toxicity.score(docs(spark, []), model).count() == 0


def test_label_model_against_brute_force():
    """The tree's posterior is that of the joint distribution, written out; correlated voters don't count twice."""
    rng = np.random.default_rng(4)
    n, truth = 3000, np.random.default_rng(5).random(3000) < 0.3
    votes = np.zeros((n, 5), np.int64)
    for k, (right, speaks) in enumerate(((0.9, 0.9), (0.8, 0.7), (0.85, 0.8))):
        vote = np.where(rng.random(n) < right, truth, ~truth) + 1
        votes[:, k] = np.where(rng.random(n) < speaks, vote, toxicity.ABSTAIN)
    votes[:, 3] = np.where(rng.random(n) < 0.95, votes[:, 1], toxicity.ABSTAIN)  # copies of the second voter
    votes[:, 4] = np.where(rng.random(n) < 0.95, votes[:, 1], toxicity.ABSTAIN)
    model = toxicity.LabelModel(5)
    post = model.fit(votes)
    best = toxicity.LabelModel(5)
    best.estimate(votes, truth.astype(float))  # no label model can do better than with the labels given
    best = ((best.posterior(votes) > 0.5) == truth).mean()
    assert ((post > 0.5) == truth).mean() > best - 0.05
    assert best > ((votes[:, 1] == toxicity.TOXIC) == truth).mean() + 0.05
    known = np.where(np.arange(n) % 5 < 2, truth, np.nan)  # some labels calibrate it
    assert ((toxicity.LabelModel(5).fit(votes, known) > 0.5) == truth).mean() > best - 0.015
    tied = {frozenset((j, int(i))) for j, i in enumerate(model.parent) if i >= 0}
    assert {frozenset((1, 3)), frozenset((1, 4))} <= tied  # the copies hang on what they copy
    for row in np.unique(votes, axis=0):
        joint = []
        for y in (0, 1):
            p = model.prior if y else 1 - model.prior
            for j, i in enumerate(model.parent):
                p *= model.rates[y, j, row[i] if i >= 0 else 0, row[j]]
            joint.append(p)
        assert model.posterior(row[None])[0] == pytest.approx(joint[1] / sum(joint), abs=1e-9)
    assert model.rates.sum(3) == pytest.approx(1)
    alone = toxicity.LabelModel(3)
    alone.fit(votes[:, :3], known)
    assert alone.rates[1, 0, 0, toxicity.TOXIC] == pytest.approx(0.81, abs=0.06)  # speaks in 0.9 of the rows, right in 0.9 of those


def test_toxicity_finds_most_of_a_larger_table(spark):
    folder = "/root/testdata/sf0.1"
    if not os.path.isdir(folder):
        pytest.skip("no such table")
    documents, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    found = toxicity.score(documents, toxicity.fit(documents, labels)).where("held_out").join(labels.where("toxic is not null"), "doc_id")
    by = {(r.toxic, r.predicted): r.n for r in found.groupBy("toxic", "predicted").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert by.get((1, 1), 0) >= 0.85 * (by.get((1, 0), 0) + by.get((1, 1), 0)) and by.get((0, 1), 0) <= 0.02 * by[0, 0]


# --------------------------------------------------------------------------- 4


def test_pieces_equal_the_library(spark):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_path())
    rng = random.Random(1)
    codec = pieces.Codec(pieces.read_model(model_path()))
    vocabulary = [p.replace(pieces.MARK, " ") for p in codec.pieces]
    texts = [t or "" for t in odd_texts()] + ["  a  b ", "▁x", "<0x0A> <s>", "ab" * 700 + " x", "🎉 é"]
    texts += ["".join(rng.choice("abcdeé ▁你\n🎉thing.AB0<>") for _ in range(rng.randrange(40))) for _ in range(500)]
    texts += ["".join(rng.choice(vocabulary) for _ in range(rng.randrange(12))) for _ in range(500)]
    for t in texts:
        ids = sp.encode(t)
        assert codec.encode(t) == ids
        assert codec.decode(ids) == sp.decode(ids)
    for _ in range(500):
        ids = [rng.randrange(3, 259) if rng.random() < 0.5 else rng.randrange(259, 32000) for _ in range(rng.randrange(9))]
        assert codec.decode(ids) == sp.decode(ids)
    rows = list(enumerate(odd_texts())) + [(1, "again"), (1, "again")]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = defaultdict(list)
    for d, t in rows:
        ids = sp.encode(t or "")
        want[d].append((len(ids), sha(",".join(map(str, ids))), sha(sp.decode(ids))))
    assert by_doc(pieces.digest(docs(spark, rows), model_path()).collect(), "n_tokens", "ids_sha256", "decoded_sha256") == {k: sorted(v, key=repr) for k, v in want.items()}
    got = pieces.encode(docs(spark, rows), model_path()).where("doc_id = 1").first()
    assert got.decoded in ("", "again")
    assert pieces.digest(docs(spark, []), model_path()).count() == 0


def test_long_units_take_the_same_merges():
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_path())
    codec = pieces.Codec(pieces.read_model(model_path()))
    rng = random.Random(2)
    units = ["internationalisation" * 30, "a" * 3001, "ab" * 2000] + ["".join(rng.choice(alphabet) for _ in range(4000)) for alphabet in ("ab", "etaoinshr", "你好abc", "0123456789abcdef+/")]
    for unit in units:
        assert codec.encode(unit) == sp.encode(unit)
        assert codec.rounds([unit, "a", unit])[0] == codec.rounds([unit])[0]  # neighbours don't matter


def test_a_better_pair_stops_the_round():
    """A model in which a merge brings up a better pair: 'ab' ranks behind 'abc', though it is a part of it."""
    names = ["<unk>", "▁", "a", "b", "c", "abc", "ab", "abab"]
    model = {"pieces": names, "scores": [0.0, -9.0, -10.0, -11.0, -12.0, -1.0, -2.0, -3.0], "kinds": [pieces.UNKNOWN] + [pieces.NORMAL] * 7, "dummy": True, "byte_fallback": False}
    codec = pieces.Codec(model)
    spelt = lambda t: [names[i] for i in codec.encode(t)]
    assert spelt("abcab") == ["▁", "abc", "ab"] and spelt("abab") == ["▁", "abab"] and spelt("ababc") == ["▁", "ab", "abc"] and spelt("ababab") == ["▁", "abab", "ab"]


# --------------------------------------------------------------------------- 5


def test_secrets_base_is_the_definition(spark):
    rng = random.Random(3)
    parts = ["password", "PASSWD", "secret", "ToKeN", "api_key", "apikey", '"', "'", " ", ":", "=", "abc", "0123456789abcdef", "AKIA", "ABCDEFGHIJKLMN", "Xy.z-", "é", "\n", "ſecret", "deadbeef"]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randrange(25)))) for i in range(800)] + [(900 + i, t) for i, t in enumerate(odd_texts())]
    found = secrets.scan(docs(spark, rows)).collect()
    text = dict(rows)
    for r in found:
        want = brute.secrets(text[r.doc_id] or "")
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert ",".join(s for s in r.spans.split(",") if not s.startswith("markov")) == want
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(want.count(k + ":") for k in ("assign", "access", "hex"))
    assert secrets.scan(docs(spark, [])).count() == 0


def test_secrets_models_tell_keys_from_names(spark):
    rows = [(i, "ordinary words and identifiers like get_user_account or international_organisation in a sentence") for i in range(50)]
    rows += [(100, "key ghq_16C7e42F292c6912E7710c838347Ae178B4a here"), (101, "see internationalization_of_the_things_2 here")]
    got = {r.doc_id: r.n_markov for r in secrets.scan(docs(spark, rows)).collect()}
    assert got[100] == 1 and got[101] == 0 and got[0] == 0


def test_secrets_models_depend_on_no_dealing(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice(["ab", "cd", "some.name", "x" * 20, "token=abcdefgh12345678", "", "é"]) for _ in range(6))) for i in range(60)] + [(90, None), (91, "")]
    first = secrets.learn(docs(spark, rows).coalesce(1))
    assert (secrets.learn(docs(spark, rows[::-1]).repartition(7)) == first).all()
    found = [{(r.doc_id, r.spans) for r in secrets.scan(docs(spark, rows).repartition(n)).collect()} for n in (1, 5)]
    assert found[0] == found[1]


def test_secrets_recall_of_random_strings(spark):
    """Keys of 16 characters and more, with digits or without, are found; long words and a key's surroundings are not."""
    rng = random.Random(4)
    kinds = ["abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"]
    words = "ordinary words and identifiers such as user account by identifier stand in sentences of things get_user_account_by_identifier ordinary_words_of_things".split()
    rows = [(i, " ".join(rng.choice(words) for _ in range(40))) for i in range(300)]
    keys = ["".join(rng.choice(kinds[i % 3]) for _ in range(rng.randrange(16, 41))) for i in range(300)]
    rows += [(1000 + i, f"here {k} there") for i, k in enumerate(keys)] + [(2000, "0123456789abcdef" + keys[0])]
    got = {r.doc_id: r for r in secrets.scan(docs(spark, rows)).collect()}
    assert sum(got[i].n_markov for i in range(300)) == 0
    assert sum(f"markov:5:{5 + len(k)}" in got[1000 + i].spans for i, k in enumerate(keys)) >= 0.97 * 300
    assert f"markov:0:{16 + len(keys[0])}" in got[2000].spans and "hex:0:" in got[2000].spans


# --------------------------------------------------------------------------- 6


def test_topk_against_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) if rng.random() < 0.7 else 0.0 for x in rng.normal(size=8)]) for i in range(400)]
    rows += [(401, [float("nan")] * 8), (402, None), (403, [None] * 8), (404, []), (None, [1.0] * 8), (405, [1.0] * 5), (406, rows[0][1]), (407, rows[0][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"label": F.lit(1), "rank": F.lit(2), "score": F.lit(0)})
    ok = {i: [math.floor(256 * x) for x in v] for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    want = set()
    for q in (i for i in ok if i % 50 == 0):
        ranked = sorted(((-sum(a * b for a, b in zip(ok[q], ok[i])), i) for i in ok if i != q))[:5]
        want |= {(q, k, i, -s) for k, (s, i) in enumerate(ranked, 1)}
    assert {tuple(r) for r in topk.search(df).collect()} == want
    twice = spark.createDataFrame([(0, [1.0]), (0, [1.0]), (0, [-1.0]), *[(i, [float(i)]) for i in range(1, 7)], (6, [6.0])], "vec_id long, embedding array<double>")
    own, minus = [6, 6, 5, 4, 3], [1, 2, 3, 4, 5]  # each row of id 0 has its ranking; both rows of id 6 are candidates
    want = sorted([(0, k, v) for k, v in enumerate(own, 1)] * 2 + [(0, k, v) for k, v in enumerate(minus, 1)])
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in topk.search(twice).collect()) == want
    huge = spark.createDataFrame([(0, [1e15, 3.0]), (1, [1e15, 1.0]), (2, [1e15, 2.0]), (3, [1e306, 0.0])], "vec_id long, embedding array<double>")
    assert [(r.vec_id, r.score) for r in topk.search(huge).collect()] == [(1, 2**63 - 1), (2, 2**63 - 1)]
    wide = spark.createDataFrame([(0, [1e6, 3.0]), (1, [1e6, 1.0]), (2, [1e6, 2.0])], "vec_id long, embedding array<double>")
    assert [(r.vec_id, r.score) for r in topk.search(wide, scale=2.0**10).collect()] == [(2, (10**6 * 2**10) ** 2 + 6 * 2**20), (1, (10**6 * 2**10) ** 2 + 3 * 2**20)]
    hot = spark.createDataFrame([(7, [float(i)]) for i in range(300)] + [(0, [1.0])], "vec_id long, embedding array<double>")
    assert [(r.vec_id, r.score) for r in topk.search(hot).collect()] == [(7, 65536 * (299 - i)) for i in range(5)]
    few = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in topk.search(few).collect()] == [(0, 1, 1, 256 * 512)]
    assert topk.search(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


# --------------------------------------------------------------------------- 7


def test_language_id(spark):
    rng = random.Random(6)
    words = {"xx": ["alpha", "bravo", "gamma", "delta"], "yy": ["jota", "queso", "lluvia", "nino"], "zz": ["schloss", "burg", "stadt", "wasser"]}
    rows = [(i, " ".join(rng.choice(words[k]) for _ in range(20)), k) for i in range(900) for k in [("xx", "yy", "zz")[i % 3]]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("source", F.lit("s"))
    got = {r.doc_id: r for r in langid.identify(df, 300).collect()}
    held = [got[i].lang_pred == k for i, _, k in rows if got[i].held_out]
    assert sum(held) / len(held) > 0.98 and all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    model = langid.fit(df, 300)
    odd = {r.doc_id: r for r in langid.predict(docs(spark, [(1, None), (2, ""), (3, "12 ! 34"), (4, "wasser burg"), (None, "queso")]), model).collect()}
    assert [odd[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and odd[4].lang_pred == "zz" and odd[None].lang_pred == "yy"
    assert all(0 <= r.score <= 1 for r in odd.values())
    empty = df.limit(0)
    assert langid.identify(empty).count() == 0
    assert langid.identify(df.where("doc_id < 9").withColumn("lang", F.lit(None).cast("string"))).where("lang_pred = 'und'").count() == 9


def test_ftrl_against_plain_updates():
    """Follow-the-regularised-leader, a coordinate at a time."""
    rng = random.Random(3)
    rows = [(np.array(sorted(rng.sample(range(30), 4)) + [langid.FEATURES]), np.array([rng.random() for _ in range(4)] + [1.0]), rng.randrange(3)) for _ in range(60)]
    alpha, beta, l1, l2 = 0.3, 1.0, 0.05, 0.1
    z, n = defaultdict(float), defaultdict(float)

    def weight(i, k):
        if abs(z[i, k]) <= l1:
            return 0.0
        return -(z[i, k] - math.copysign(l1, z[i, k])) / ((beta + math.sqrt(n[i, k])) / alpha + l2)

    for _ in range(2):
        for at, x, y in rows:
            w = {(i, k): weight(i, k) for i in at for k in range(3)}
            score = [sum(v * w[i, k] for i, v in zip(at, x)) for k in range(3)]
            p = [math.exp(s) / sum(math.exp(t) for t in score) for s in score]
            for i, v in zip(at, x):
                for k in range(3):
                    g = v * (p[k] - (k == y))
                    z[i, k] += g - (math.sqrt(n[i, k] + g * g) - math.sqrt(n[i, k])) / alpha * w[i, k]
                    n[i, k] += g * g
    got = langid.fit_ftrl(rows, 3, 2, alpha, beta, l1, l2)
    want = np.zeros_like(got)
    for i, k in list(z):
        want[i, k] = weight(i, k)
    assert np.abs(got - want).max() < 1e-9 and (want == 0).sum() > want.size / 2


def test_language_id_of_many_short_and_long_texts(spark):
    import tracemalloc

    import pyarrow as pa

    for texts in ([""] * 10_000, ["abcdefghij klmnopqrs"] * 10_000, ["wasser burg " * 60_000]):
        tracemalloc.start()
        found = list(langid.counts(pa.array(texts)))
        assert tracemalloc.get_traced_memory()[1] < 100 << 20
        tracemalloc.stop()
        assert found[-1][1] == len(texts) and (np.concatenate([np.diff(f[2]) for f in found]) > 0).all() == bool(texts[0])
    rows = [(i, "", "xx") for i in range(3000)] + [(5000 + i, w * 3, k) for i in range(300) for w, k in [(("wasser burg ", "zz"), ("alpha bravo ", "xx"))[i % 2]]] + [(9000, "wasser burg " * 30_000, "zz")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(1)
    got = {r.doc_id: r.lang_pred for r in langid.identify(df).collect()}
    assert got[0] == "und" and got[9000] == "zz" and all(got[d] == k for d, _, k in rows if 5000 <= d < 9000)


# --------------------------------------------------------------------------- 8


def test_lines_against_brute_force(spark):
    rng = random.Random(7)
    pool = ["a common line here", " A COMMON LINE HERE\t", "short", "another longer line", "ünïcödé line ø", "nine char", "tencharsxx", "", "é" * 9, "é" * 10]
    rows = [(rng.randrange(120), "\n".join(rng.choice(pool) + (f" {rng.randrange(60)}" if rng.random() < 0.4 else "") for _ in range(rng.randrange(0, 9)))) for _ in range(150)]
    rows += [(None, "a common line here"), (3, None), (4, "")] + [(500 + i, t) for i, t in enumerate(odd_texts())]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = defaultdict(list)
    for (d, kept, n), (_, t) in zip(brute.keep_lines(rows), rows):
        want[d].append(((t or "").count("\n") + 1, n, sha(kept)))
    got = by_doc(lines.digest(docs(spark, rows).repartition(5)).collect(), "n_lines", "n_dropped", "kept_sha256")
    assert got == {k: sorted(v, key=repr) for k, v in want.items()}
    assert lines.digest(docs(spark, [])).count() == 0
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:  # a line in all documents fills several partitions
        every = [(d, f"one line that all hold\n{'another one that all hold' if d % 2 else d}") for d in range(200, 0, -1)] + [(1, "one line that all hold"), (None, "one line that all hold")]
        want = Counter((d, n) for d, _, n in brute.keep_lines(every))
        found = lines.digest(docs(spark, every).repartition(60)).collect()
        assert Counter((r.doc_id, r.n_dropped) for r in found) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    kept = lines.deduplicate(docs(spark, rows))
    assert kept.columns == docs(spark, []).columns
    assert Counter((r.doc_id, r.text or "") for r in kept.select("doc_id", "text").collect()) == Counter((d, k) for d, k, _ in brute.keep_lines(rows))


# --------------------------------------------------------------------------- 9


def test_decontamination_against_brute_force(spark, monkeypatch):
    rng = random.Random(8)
    texts = [" ".join(rng.choice("abcde") for _ in range(rng.randrange(0, 60))) for _ in range(150)]
    items = [(i, " ".join(rng.choice("abcde") for _ in range(rng.randrange(0, 14)))) for i in range(25)] + [(3, "B, a! c"), (None, "a b"), (99, None), (98, "zz zz")]
    rows = list(enumerate(texts)) + [(200 + i, t) for i, t in enumerate(odd_texts())] + [(None, texts[0]), (5, texts[5])]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1))
    want = defaultdict(list)
    for d, n, hit, found in brute.hits(rows, items):
        want[d].append((n, hit, len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), hit > 0))
    got = by_doc(decontam.digest(docs(spark, rows), bench).collect(), "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert got == {k: sorted(v, key=repr) for k, v in want.items()}
    long = [(500, " ".join(rng.choice("abcde") for _ in range(90))), (None, " ".join(rng.choice("abcde") for _ in range(40)))]  # in pieces
    more = bench.union(spark.createDataFrame(long, "item_id long, text string").withColumn("doc_id", F.lit(1)))
    rows += [(900, "x " + long[0][1]), (901, long[1][1][7:])]
    want = defaultdict(list)
    for d, n, hit, found in brute.hits(rows, items + long):
        want[d].append((n, hit, len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), hit > 0))
    for size, group in ((400_000, 8), (100, 2)):
        monkeypatch.setattr(decontam, "SHARD_BYTES", size)
        monkeypatch.setattr(decontam, "GROUP", group)
        got = by_doc(decontam.digest(docs(spark, rows), more).collect(), "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
        assert got == {k: sorted(v, key=repr) for k, v in want.items()}
    assert decontam.digest(docs(spark, rows), bench.limit(0)).where("contaminated").count() == 0
    assert decontam.digest(docs(spark, []), bench).count() == 0


def test_decontamination_cuts_spans(spark, monkeypatch):
    item = "one two three four five six seven eight nine ten"
    clean = "Nothing to see here, move along."
    rows = [(1, f"Before. {item.upper()}! After it come many more words than the item had, so that it stays."), (2, item), (3, clean), (4, None)]
    bench = spark.createDataFrame([(7, item)], "item_id long, text string")
    bench = bench.union(spark.createDataFrame([(8, "unseen words here"), (9, "five six seven eight nine ten")], bench.schema))
    for size, group in ((400_000, 8), (20, 8), (20, 1)):  # one shard, one group, more groups
        monkeypatch.setattr(decontam, "SHARD_BYTES", size)
        monkeypatch.setattr(decontam, "GROUP", group)
        got = {r.doc_id: r.text for r in decontam.clean(docs(spark, rows), bench).select("doc_id", "text").collect()}
        assert got == {1: "Before. ! After it come many more words than the item had, so that it stays.", 3: clean, 4: None}
    spans = {r.doc_id: (r.spans[0].begin, r.spans[0].end, r["items"]) for r in decontam.report(docs(spark, rows), bench).collect()}
    assert spans == {1: (1, 11, [7, 9]), 2: (0, 10, [7, 9])}
    assert decontam.report(docs(spark, []), bench).count() == 0 and decontam.clean(docs(spark, []), bench).count() == 0


# --------------------------------------------------------------------------- 10


@pytest.mark.parametrize("zip64", [False, True])
def test_zip_directories(zip64, tmp_path):
    import io
    import zipfile

    members = [("a.txt", b"alpha"), ("dir/é.bin", bytes(range(256)) * 10), ("empty", b"")]
    raw = warc.zip_stored(members, zip64)
    with zipfile.ZipFile(io.BytesIO(raw)) as z:  # another reader agrees
        assert [(i.filename, z.read(i)) for i in z.infolist()] == members and z.testzip() is None
    found = warc.zip_members(lambda at, n: raw[at : at + n], len(raw))
    assert {k: raw[a : a + n] for k, (a, n) in found.items()} == dict(members)
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:  # and we read others' archives
        z.writestr("x", "stored")
        z.writestr("y", "packed" * 100, zipfile.ZIP_DEFLATED)
        z.comment = b"PK\x05\x06 in a comment"
    raw = buffer.getvalue()
    assert set(warc.zip_members(lambda at, n: raw[at : at + n], len(raw))) == {"x"}
    with pytest.raises(ValueError):
        warc.zip_members(lambda at, n: b"nothing"[at : at + n], 7)


def test_warc_round_trip(spark, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 3000)
    big, other = "é" * 600, "\r\n\r\nWARC/1.1\r\n" * 90
    rows = [(1, "http://a", big), (2, None, big), (3, "u\nv", other), (4, "x", "small"), (5, "x", "small"), (6, "x", None), (7, "", ""), (2, None, big), (None, "n", big), (8, "h", other)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"target": F.lit(1), "digest": F.lit("d")})
    want = []
    for p, _, h in rows:
        data = (h or "").encode()
        top = max((q for q, _, x in rows if x == h and q is not None), default=None) if len(data) >= 1000 else None
        revisit = p is not None and top is not None and top != p
        want.append((p, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", top if revisit else None))
    got = [tuple(r) for r in warc.round_trip(df).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    full = warc.read_archives(common.cut(warc.write_archives(df))).where("record_type = 'response'")
    assert {(r.page_id, bytes(r.payload)) for r in full.collect()} == {(p, (h or "").encode()) for (p, _, h), w in zip(rows, want) if w[3] == "response"}
    assert warc.round_trip(df.limit(0)).count() == 0


def test_warc_reads_files_by_ranges(spark, tmp_path, monkeypatch):
    import gzip
    import io
    import zipfile

    made = set()
    for name in ("one", "two", "big"):
        payloads = [f"{name} {i} ".encode() * (i + 1) for i in range(40 if name == "big" else 3)]
        records = [warc.record(i, f"http://{name}/{i}", p, hashlib.sha1(p).hexdigest(), None) for i, p in enumerate(payloads)]
        (tmp_path / f"{name}.wacz").write_bytes(warc.archive(records, zip64=name == "big"))
        made |= {(f"http://{name}/{i}", p) for i, p in enumerate(payloads)}
    # an archive of another writer: other names, two data members, a gzipped index, members that are none of ours
    other = [warc.record(None, f"http://other/{i}", b"payload %d" % i, "", None).replace(b"WARC-Payload-Digest: sha1:\r\n", b"").replace(b"X-Payload-Length: 9\r\n", b"").replace(b"<urn:page:>", b"<urn:uuid:1-2-3>") for i in range(4)]
    packed = [gzip.compress(r) for r in other]
    index = "".join(f'com,other)/{i} 2024 {{"filename": "{"ab"[i // 2]}.warc.gz", "offset": {len(packed[i - 1]) if i % 2 else 0}, "length": "{len(packed[i])}"}}\n' for i in range(4))
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("datapackage.json", "{}" * 50, zipfile.ZIP_DEFLATED)
        z.writestr("archive/a.warc.gz", packed[0] + packed[1])
        z.writestr("archive/b.warc.gz", packed[2] + packed[3])
        z.writestr("indexes/index.cdx.gz", gzip.compress(b'!meta 0 "no record"\n'.replace(b'"', b"") + index.encode()))
    (tmp_path / "other.wacz").write_bytes(buffer.getvalue())
    made |= {(f"http://other/{i}", b"payload %d" % i) for i in range(4)}
    got = warc.read_files(spark, str(tmp_path / "*.wacz")).collect()
    assert {(r.url, bytes(r.payload)) for r in got} == made and len(got) == len(made)
    assert {r.page_id for r in got if r.url.startswith("http://other")} == {None}
    assert all(r.payload_digest == hashlib.sha1(r.payload).hexdigest() and r.payload_bytes == len(r.payload) for r in got)
    # only ranges are read: the directory, the index, and the records asked for
    raw, asked = (tmp_path / "big.wacz").read_bytes(), []
    places = list(warc.record_ranges(lambda at, n: asked.append(n) or raw[at : at + n], len(raw)))
    fields, payload = warc.read_record(lambda at, n: asked.append(n) or raw[at : at + n], *places[7])
    assert fields["WARC-Target-URI"] == "http://big/7" and asked[-1] == places[7][1] < len(raw) / 10
    broken = warc.zip_stored([("archive/data.warc.gz", b"x"), ("indexes/index.cdxj", b'k t {"filename": "data.warc.gz", "offset": "0", "length": "9"}\n')])
    with pytest.raises(ValueError):
        list(warc.record_ranges(lambda at, n: broken[at : at + n], len(broken)))
