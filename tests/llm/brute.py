"""Plain versions of the operators, for small inputs."""

import re
from collections import defaultdict


def jaccard_components(rows, width=5, percent=80):
    """{doc_id: (n_shingles, component_id)}; rows with one doc_id are one node."""
    sets, out = [], {}
    for doc, text in rows:
        w = [x for x in re.split("[ \t-\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
        s = {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
        sets.append((doc, s))
    up = {doc: doc for doc, _ in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    index = defaultdict(list)
    for k, (_, s) in enumerate(sets):
        for x in s:
            index[x].append(k)
    for k, (doc, s) in enumerate(sets):
        shared = defaultdict(int)
        for x in s:
            for j in index[x]:
                if j < k:
                    shared[j] += 1
        for j, n in shared.items():
            if 100 * n >= percent * (len(s) + len(sets[j][1]) - n):
                a, b = sorted((find(doc), find(sets[j][0])))
                up[b] = a
    for doc, s in sets:
        out.setdefault(doc, []).append((len(s), find(doc)))
    return out


def keep_lines(rows, min_chars=10):
    """[(doc_id, kept text, dropped)] in the order of rows."""
    strip = " \t\n\x0b\x0c\r"
    key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(strip))
    holder = {}
    for doc, text in rows:
        if doc is not None:
            for line in (text or "").split("\n"):
                if len(key(line)) >= min_chars:
                    holder[key(line)] = min(doc, holder.get(key(line), doc))
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if doc is None or len(key(x)) < min_chars or holder[key(x)] == doc]
        out.append((doc, "\n".join(kept), len(lines) - len(kept)))
    return out


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def hits(rows, items, window=10):
    """[(doc_id, n_words, n_hit, sorted item ids)]."""
    wins = []
    for item, text in items:
        w = words(text)
        if w:
            n = min(window, len(w))
            wins += [(item, tuple(w[i : i + n])) for i in range(len(w) - n + 1)]
    out = []
    for doc, text in rows:
        w, hit, found = words(text), set(), set()
        for item, x in wins:
            for i in range(len(w) - len(x) + 1):
                if tuple(w[i : i + len(x)]) == x:
                    hit |= set(range(i, i + len(x)))
                    if item is not None:
                        found.add(item)
        out.append((doc, len(w), len(hit), sorted(found)))
    return out


def secrets(text):
    """Base spans by the letter of the definition."""
    out = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A):
        if len(m[2]) >= 12:
            out.append((m.start(), 0, f"assign:{m.start()}:{m.end()}"))
    for k, (name, pattern, least) in enumerate((("access", r"AKIA[A-Z0-9]+", 18), ("hex", r"[0-9a-f]+", 16)), 1):
        for m in re.finditer(pattern, text):
            if len(m[0]) >= least:
                out.append((m.start(), k, f"{name}:{m.start()}:{m.end()}"))
    return ",".join(x[2] for x in sorted(out))


def lm_scores(train, fold, rows, order, rounds=200):
    """[score] of rows (lists of tokens) by recursive interpolation; weights by EM on the texts of fold, each token
    deleted from the counts.  Contexts are bucketed by powers of two."""
    import math

    counts = [defaultdict(int) for _ in range(order + 1)]  # by length; the empty n-gram counts all tokens
    for t in train:
        for i in range(len(t)):
            counts[0][()] += 1
            for n in range(1, order + 1):
                counts[n][_gram(t, i, n)] += 1
    contexts = [defaultdict(int) for _ in range(order + 1)]
    for n in range(2, order + 1):  # what stands before a token, the beginning of a text as well
        contexts[n] = defaultdict(int, counts[n - 1])
        contexts[n][("<s>",)] = len(train)
    types = len(counts[1])
    bucket = lambda c: int(math.floor(math.log2(c))) + 1 if c > 0 else 0

    def parts(t, i, n, gone):
        above = counts[0][()] if n == 1 else len(train) if i == 0 else counts[n - 1][_gram(t, i - 1, n - 1)]
        above -= gone
        return (counts[n][_gram(t, i, n)] - gone) / max(above, 1), bucket(above)

    weights = []

    def mixed(t, i, gone):
        p = 1 / (types + 1)
        for n, w in enumerate(weights, 1):
            own, b = parts(t, i, n, gone)
            p = w[b] * own + (1 - w[b]) * p
        return p

    for n in range(1, order + 1):
        seen = defaultdict(list)
        for t in fold:
            for i in range(len(t)):
                own, b = parts(t, i, n, 1)
                seen[b].append((own, mixed(t, i, 1)))
        w, last = {0: 0.0}, 0.0
        for b in range(1, 64):
            if seen[b]:
                last = 0.5
                for _ in range(rounds):
                    last = sum(last * a / (last * a + (1 - last) * c) for a, c in seen[b]) / len(seen[b])
                last = min(last, 1 - 1e-6)
            w[b] = last
        weights.append(w)
    return [sum(math.log10(mixed(t, i, 0)) for i in range(len(t))) for t in rows]


def _gram(t, i, n):
    """The n-gram that ends at i; one that would begin before the text begins with a mark."""
    return tuple(t[i - n + 1 : i + 1]) if i - n + 1 >= 0 else ("<s>", *t[: i + 1])
