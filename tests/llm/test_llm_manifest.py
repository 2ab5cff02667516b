"""Whitening, the Merkle manifest and license scans against plain versions, with nulls, empty and long texts, ties,
repeated rows, empty tables and columns of clashing names."""

import hashlib
import math
import random
import re
import zlib
from collections import defaultdict
from fractions import Fraction

import brute
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from graphloom.llm import common, license_rules, licenses, merkle, whiten

# --------------------------------------------------------------------------- 11


def plain_whitening(rows):
    """{place: (deviation, x - mean)}, covariance by exact numbers, of lists of numbers of one length."""
    x = [[math.floor(64 * float(c)) + 1_000_000 for c in row] for row in rows]
    n, d = len(x), len(x[0])
    sums = [sum(r[j] for r in x) for j in range(d)]
    deviation = [sum((n * r[j] - sums[j]) ** 2 for j in range(d)) for r in x]
    centred = [[Fraction(n * r[j] - sums[j], n) for j in range(d)] for r in x]
    v = np.array([[float(sum(r[i] * r[j] for r in centred) / n) for j in range(d)] for i in range(d)])
    return deviation, np.array(centred, float), v


def test_whitening_against_eigh(spark):
    rng = np.random.default_rng(3)
    rows = (rng.standard_normal((150, 6)) * [9, 5, 3, 2, 1, 0.5] @ rng.standard_normal((6, 6)) + 40).astype(np.float32).tolist()
    odd = [None, rows[0][:3] + [None] + rows[0][4:], rows[1][:5] + [float("nan")], [float("inf")] * 6]
    table = [(i, r, 1) for i, r in enumerate(rows)] + [(900 + i, r, 2) for i, r in enumerate(odd)] + [(3, rows[3], 9), (None, rows[4], 0)]
    df = spark.createDataFrame(table, "vec_id long, embedding array<float>, component int").withColumns({"n": F.lit("n"), "a.b": F.lit(0)}).repartition(5)
    got = whiten.whiten(df, wanted=4).collect()
    used = [*rows, rows[3], rows[4]]
    deviation, centred, v = plain_whitening(used)
    e, u = np.linalg.eigh(v)
    e, u = e[::-1], u[:, ::-1]
    found = defaultdict(list)
    for r in got:
        found[r.vec_id].append(r)
    assert len(got) == 4 * len(used) and not set(found) & set(range(900, 904)) and len(found[3]) == 8 and len(found[None]) == 4
    signs = {}
    for i in range(len(rows)):
        for r in found[i]:
            k = r.component - 1
            want = centred[i] @ u[:, k] / math.sqrt(e[k])
            signs.setdefault(k, np.sign(want * r.whitened))
            assert r.n == len(used) and r.deviation == deviation[i]
            assert r.whitened == pytest.approx(signs[k] * want, abs=1e-9)
            assert r.explained == pytest.approx(e[k] / np.trace(v), rel=1e-9) and r.identity_error < 1e-9


def test_whitening_of_odd_tables(spark):
    def run(rows):
        return whiten.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()

    assert run([]) == [] and run([(1, None), (2, [None])]) == []
    one = run([(1, [0.5, 0.25])])
    assert [(r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [(1, 1, 0, None, 0.0, 0.0), (2, 1, 0, None, 0.0, 0.0)]
    # a shorter vector has zeros for the rest; along the only direction with variance both lie one deviation off
    short = {(r.vec_id, r.component): r.whitened for r in run([(1, [1.0, 1.0]), (2, [1.0])])}
    assert abs(short[1, 1]) == pytest.approx(1) and short[1, 1] == -short[2, 1] and short[1, 2] is None
    # beyond 64 bits: clipped, whole result
    wide = run([(1, [1e300]), (2, [-1e300]), (3, [0.0])])
    assert {r.vec_id: r.deviation for r in wide} == {1: 2**63 - 1, 2: 2**63 - 1, 3: 0}
    assert {r.vec_id: round(r.whitened, 6) for r in wide if r.vec_id == 3} == {3: 0.0} and wide[0].identity_error < 1e-9


def test_whitening_sums_are_exact():
    rng = np.random.default_rng(1)
    small, large = rng.integers(-90, 90, (50, 4)), rng.integers(-(2**40), 2**40, (50, 4))
    for x in (small, large):
        assert whiten.products(x).tolist() == [[sum(int(a) * int(b) for a, b in zip(x[:, i], x[:, j])) for j in range(4)] for i in range(4)]
        n, rest = 50, [int(s) for s in x.sum(0)]
        model = whiten.Whitening(n, rest, whiten.covariance([int(p) for p in whiten.products(x - model_centre(rest, n)).ravel()], n, [s - n * c for s, c in zip(rest, model_centre(rest, n).tolist())]), 4, 64.0)
        want = [min(sum((n * int(a) - s) ** 2 for a, s in zip(r, rest)), 2**63 - 1) for r in x]
        assert model.deviations(x).tolist() == want
        assert np.allclose(model.values, np.sort(np.linalg.eigvalsh(np.cov(x.T.astype(float), bias=True)))[::-1], rtol=1e-9)


def model_centre(sums, n):
    return np.array([(2 * s + n) // (2 * n) for s in sums], np.int64)


@pytest.mark.parametrize("kind", ["spread", "equal", "close", "rank", "signs"])
def test_spectrum_slicing(kind):
    rng = np.random.default_rng(8)
    q, _ = np.linalg.qr(rng.standard_normal((24, 24)))
    e = {"spread": np.geomspace(1e-6, 1e6, 24), "equal": np.repeat([1.0, 2.0, 5.0, 9.0], 6), "close": 3 + np.arange(24) * 1e-11, "rank": np.r_[np.zeros(20), 1, 2, 3, 4], "signs": np.arange(24) - 9.5}[kind]
    a = (q * e) @ q.T
    a = (a + a.T) / 2
    want = np.linalg.eigvalsh(a)
    scale = np.abs(want).max()
    values, vectors = whiten.components(a, 10)
    assert np.allclose(values, want[::-1][:10], atol=1e-13 * scale, rtol=0)
    assert np.allclose(vectors @ vectors.T, np.eye(10), atol=1e-11)
    assert np.abs(a @ vectors.T - vectors.T * values).max() < 1e-12 * scale
    for shift in (e.min() - 1, e.mean() + 0.123, e.max() + 1):
        assert whiten.inertia(a, shift) == int((want < shift).sum())
    with pytest.raises(ArithmeticError):
        whiten.certify(a / scale, (want[0] - scale) / scale, 0, 1e-12)


def test_whitening_query(spark, small):
    got = whiten.whiten(spark.read.parquet(f"{small}/embeddings.parquet")).collect()
    rows = spark.read.parquet(f"{small}/embeddings.parquet").select("vec_id", "embedding").collect()
    x = np.floor(64 * np.array([r.embedding for r in rows], np.float64)) + 1_000_000
    v = np.cov((x - x.mean(0)).T, bias=True)
    e = np.linalg.eigvalsh(v)[::-1]
    assert len(got) == 32 * len(rows)
    assert {(r.component, round(r.explained, 9)) for r in got} == {(k + 1, round(e[k] / np.trace(v), 9)) for k in range(32)}
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9
    xs = x.astype(np.int64)
    deviation = dict(zip([r.vec_id for r in rows], ((len(xs) * xs - xs.sum(0)) ** 2).sum(1).tolist()))
    assert all(r.deviation == deviation[r.vec_id] and r.n == len(rows) for r in got)


# --------------------------------------------------------------------------- 12


def hashed(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_manifest(rows, fanout=16):
    """Rows of manifest() of (doc_id, source, lang, n_chars, text), by rebuilding each proof from the lists of nodes."""

    def leaf(d, s, g, n, t):
        return hashed(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (d, s, g, n, t)])

    def levels(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([hashed(*out[-1][i : i + fanout]) for i in range(0, len(out[-1]), fanout)])
        return out

    def way(levels, i):
        out = []
        for nodes in levels[:-1]:
            run = i // fanout * fanout
            out.append(("".join(nodes[run:i]), "".join(nodes[i + 1 : run + fanout])))
            i //= fanout
        return out

    by = defaultdict(list)
    for row in rows:
        d, s, g, n, t = row
        hit = d is not None and zlib.crc32(str(d).encode()) % 5 == 0
        low = None if t is None else re.sub("[A-Z]", lambda m: m[0].lower(), t)
        by[s].append((d is not None, d or 0, leaf(*row), leaf(d, s, g, n, low) if hit else leaf(*row)))
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = [levels([x[2] for x in sorted(by[s])]) for s in sources]
    top = levels([t[-1][0] for t in trees])
    out = []
    for k, s in enumerate(sources):
        for i, (known, d, own, other) in enumerate(sorted(by[s])):
            path = way(trees[k], i) + way(top, k)
            h = other
            for left, right in path:
                h = hashed(left, h, right)
            out.append((d if known else None, own, trees[k][-1][0], top[-1][0], hashed(*[a + b for a, b in path]), h, h == top[-1][0]))
    return sorted(out, key=repr)


def manifest_rows(sizes, seed=0):
    rng = random.Random(seed)
    rows = []
    for k, (s, n) in enumerate(sizes.items()):
        for i in range(n):
            rows.append((i * 31 % 10_007 + 10_007 * k, s, rng.choice(["en", None]), rng.choice([None, 5]), rng.choice(["Some Text", "plain", "É A", "", None])))
    rng.shuffle(rows)
    return rows


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


@pytest.mark.parametrize(
    "sizes",
    [{"a": 1}, {"a": 17}, {None: 3, "": 2, "a": 300, "Z": 16, "é": 1, "b": 33}, {f"s{i}": 1 + i % 3 for i in range(40)}],
)
def test_manifest_against_plain(spark, sizes):
    rows = manifest_rows(sizes)
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"tree": F.lit("t"), "pos": F.lit(1), "leaf": F.lit(0), "_at": F.lit(2), "a.b": F.lit(3)}).repartition(6)
    assert sorted(map(tuple, merkle.manifest(df).collect()), key=repr) == plain_manifest(rows)


def test_manifest_of_odd_rows(spark):
    rows = [(None, None, None, None, None), (None, "a", "en", 3, "x" * 200_000), (7, "a", None, 1, "Same"), (7, "a", None, 1, "Same"), (7, "a", "de", 1, "Other"), (5, "a", "de", 0, "")]
    assert sorted(map(tuple, merkle.manifest(spark.createDataFrame(rows, SCHEMA)).collect()), key=repr) == plain_manifest(rows)
    assert merkle.manifest(spark.createDataFrame([], SCHEMA)).collect() == []


def test_manifest_needs_no_python_and_no_large_group(spark):
    rows = manifest_rows({"hot": 3000, "b": 20})
    got = merkle.manifest(spark.createDataFrame(rows, SCHEMA).repartition(8), fanout=4)
    assert sorted(map(tuple, got.collect()), key=repr) == plain_manifest(rows, 4)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Window" not in plan


# --------------------------------------------------------------------------- 13


def test_base_phrases_against_plain(spark):
    rng = random.Random(2)
    pieces = ["GNU General Public License", "apache", "License", "CC", "by", "CC-BY", "MIT", "mit license", "gnu", "general", "public", "die", "mit", "Lizenz", "é", "1.0", "\n", "licensed"]
    rows = [(i, " ".join(rng.choice(pieces) for _ in range(rng.randrange(0, 40)))) for i in range(300)]
    rows += [(400, None), (401, ""), (402, "..."), (403, "word " * 50_000 + "Apache\nLicense" + " mit license" * 2000), (0, rows[0][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"n_words": F.lit("n"), "labels": F.lit(1), "a.b": F.lit(1)}).repartition(4)
    want = []
    for d, t in rows:
        w = brute.words(t)
        at = [(i, label) for phrase, label in licenses.BASE for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
        want.append((d, len(w), len(at), min((i for i, _ in at), default=None), max((i for i, _ in at), default=None), ",".join(sorted({x for _, x in at}))))
    got = licenses.scan(df).collect()
    assert sorted([(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got], key=repr) == sorted(want, key=repr)
    for r in got:
        assert set(r.base_labels.split(",")) - {""} <= set(r.labels.split(",")) and 0 <= r.score <= 1 and (r.score > 0) == bool(r.labels)
        # the prefilter loses nothing: all rules over the same text give the same
    rules = list(enumerate(license_rules.parse(license_rules.RULES)))
    for r, t in ((r, dict(rows)[r.doc_id]) for r in got if r.doc_id < 60):
        assert r.labels == ",".join(licenses.scan_text((t or "").encode(), rules)[4])
    assert licenses.scan(df.where("doc_id = -1")).collect() == []


@pytest.mark.parametrize(
    "text, labels",
    [
        ("Licensed under CC BY-NC 4.0.", "cc-by,cc-by-nc-4.0"),
        ("Creative Commons Attribution-ShareAlike 3.0 Unported License", "cc-by-sa-3.0"),
        ("https://creativecommons.org/licenses/by-nc-sa/4.0/", "cc-by-nc-sa-4.0"),
        ("the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version", "gpl,gpl-2.0-or-later"),
        ("GNU Lesser General Public License v2.1", "lgpl-2.1"),
        ("SPDX-License-Identifier: MIT", "spdx-mit"),
        ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "mit"),
        ("BSD 3-Clause License", "bsd-3-clause"),
        ("Mozilla Public License, v. 2.0", "mpl-2.0"),
        ("das Boot mit Lizenz", ""),
        ("The Unlicense", "unlicense"),
        ("Apache-2.0", "apache-2.0"),
        ("AGPLv3", "agpl-3.0"),
    ],
)
def test_license_labels(text, labels):
    assert ",".join(licenses.scan_text(text.encode(), list(enumerate(license_rules.parse(license_rules.RULES))))[4]) == labels


def test_every_rule_is_behind_its_keywords():
    """A text without any of a rule's keywords can't match: taking the keywords out of the pattern leaves no whole match."""
    rules = license_rules.parse(license_rules.RULES)
    assert len(rules) > 200
    for rule in rules:
        assert re.fullmatch("[a-z0-9{}.+-]+", rule.label) and rule.priority in licenses.SURE
        # on words of every other rule's keywords alone
        others = sorted({k for r in rules for k in r.keywords} - set(rule.keywords))
        assert not rule.pattern.search(f" {' '.join(others)} ".encode())


def test_containment_settles_overlaps():
    rng = random.Random(6)
    for _ in range(200):
        found = []
        for k in range(rng.randrange(12)):
            b = rng.randrange(20)
            found.append((b, b + rng.randrange(1, 12), rng.randrange(1, 4), k, f"l{k}"))
        want = []
        for d in found:
            gone = False
            for o in found:
                inside = o[0] <= d[0] and d[1] <= o[1] and o is not d
                if inside and (o[2] > d[2] or (o[2] == d[2] and ((o[0], o[1]) != (d[0], d[1]) or o[3] < d[3]))):
                    gone = True
            if not gone:
                want.append(d)
        assert sorted(licenses.settle(found)) == sorted(want)


def test_words_agree_with_normalized_text():
    text = "Ünï ÄÖ a1-b2_C3\x00é{x}"
    buf, offs = common.text_bytes(pa.array([text]))
    assert len(common.words(buf, offs, common.NONWORD)[0]) == len(licenses.normalized(text.encode()).split()) == len(brute.words(text))
