"""Near duplicates equal brute force over all pairs; parts of the method hold alone."""

import random
import re

import numpy as np
import pytest

from quarry.llm import minhash


def shingle_set(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return set()
    return {tuple(w)} if len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def brute(rows):
    sets = [(d, shingle_set(t)) for d, t in rows]
    comp = list(range(len(sets)))

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            a, b = sets[i][1], sets[j][1]
            if a and b and 100 * len(a & b) >= 85 * len(a | b):
                comp[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(sets):
        r = root(i)
        if d is not None:
            least[r] = min(least.get(r, d), d)
    return sorted(((d, len(s), least.get(root(i)) if s else d) for i, (d, s) in enumerate(sets)), key=str)


def corpus(seed, n=160):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    rows = []
    for base in range(n // 8):
        w = [r.choice(vocab) for _ in range(r.choice([3, 6, 40, 120, 300]))]
        for _ in range(8):
            v = list(w)
            for _ in range(r.choice([0, 0, 1, 1, 2, 3, 6])):
                v[r.randrange(len(v))] = r.choice(vocab).upper() if r.random() < 0.3 else r.choice(vocab)
            rows.append((len(rows), " ".join(v)))
    r.shuffle(rows)
    return [(i, t) for i, (_, t) in enumerate(rows)]


@pytest.mark.parametrize("together", [minhash.TOGETHER, 700])
def test_components_equal_brute_force(spark, together):
    rows = corpus(3) + [(900, None), (901, ""), (902, " \n"), (903, "one"), (904, "ONE"), (905, "a b c d e f"), (905, "a b c d e f"), (None, "one"), (906, "x" * 300_000)]
    docs = spark.createDataFrame([(d, t, "clash") for d, t in rows], "doc_id long, text string, h1 string")
    got = sorted(((g.doc_id, g.n_shingles, g.component_id) for g in minhash.near_duplicates(docs, together).collect()), key=str)
    assert got == brute(rows)


def test_empty_table_and_dedup(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert minhash.near_duplicates(docs).count() == 0
    docs = spark.createDataFrame([(1, "a b c d e f g", "z"), (2, "a b c d e f g", "y"), (3, "q", None)], "doc_id long, text string, lang string")
    assert sorted(map(tuple, minhash.deduplicated(docs).collect())) == [(1, "a b c d e f g", "z"), (3, "q", None)]


def test_exact_links_connect_all_that_links_do():
    r = np.random.default_rng(1)
    for _ in range(60):
        base = r.choice(10_000, 60, replace=False).astype(np.uint64)
        sets = []
        for _ in range(12):
            s = base.copy()
            k = r.integers(0, 9)
            s[r.choice(60, k, replace=False)] = r.integers(20_000, 90_000, k)
            sets.append(np.unique(s))
        want = np.arange(12)
        for i in range(12):
            for j in range(i):
                both = len(np.intersect1d(sets[i], sets[j]))
                if 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
                    want[want == want[i]] = want[j]
        got = np.arange(12)
        for i, j in minhash.exact_links(sets):
            got[got == got[i]] = got[j]
        assert all((got[i] == got[j]) == (want[i] == want[j]) for i in range(12) for j in range(12))


def test_sketches_estimate_and_bands_agree():
    r = np.random.default_rng(2)
    hit = 0
    for _ in range(200):
        a = np.sort(r.integers(0, 1 << 63, 100).astype(np.uint64) * np.uint64(2))
        b = a.copy()
        b[r.choice(100, 8, replace=False)] = r.integers(0, 1 << 63, 8).astype(np.uint64)
        b = np.sort(b)  # similarity 92 / 108
        m = minhash.minima(np.r_[a, b], np.array([0, 100, 200]))
        s = minhash.sketches(m)
        assert np.bitwise_count(s[0] ^ s[1]).sum() < minhash.most_ones(minhash.NEAR)
        hit += (minhash.bands(m)[0] == minhash.bands(m)[1]).any()
    assert hit == 200


def by_brute_force(rows, percent):
    """The smallest id of each document's component."""
    sets = [(d, shingle_set(t)) for d, t in rows]
    of = {d: d for d, _ in sets}
    for i, (d, a) in enumerate(sets):
        for e, b in sets[:i]:
            if a and b and of[d] != of[e] and 100 * len(a & b) >= percent * len(a | b):
                low, high = sorted((of[d], of[e]))
                of = {x: low if y == high else y for x, y in of.items()}
    return of


def edited(seed, n=60):
    """Texts of 204 words with copies whose similarity is mostly between 0.75 and 0.9: each edit changes five shingles."""
    r = random.Random(seed)
    rows = []
    for _ in range(n):
        w = [f"w{r.randrange(5000)}" for _ in range(204)]
        rows.append(w)
        for edits in r.sample([2, 3, 4, 5, 6], 2):
            v = list(w)
            for x in r.sample(range(4, 200, 6), edits):
                v[x] = f"e{r.randrange(10**9)}"
            rows.append(v)
    r.shuffle(rows)
    return [(i, " ".join(w)) for i, w in enumerate(rows)]


@pytest.mark.parametrize("together", [minhash.TOGETHER, 700])
def test_components_at_another_percent(spark, together):
    rows = edited(5)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = by_brute_force(rows, 80)
    assert want != by_brute_force(rows, 85)
    assert {g.doc_id: g.component_id for g in minhash.near_duplicates(docs, together, 80).collect()} == want


def test_layout_follows_the_percent():
    assert minhash.layout(85) == (28, 6) and minhash.layout(80) == (34, 5)
    for percent in range(40, 101):
        bands, rows = minhash.layout(percent)
        assert (1 - (percent / 100) ** rows) ** bands <= minhash.MISS and bands * rows <= minhash.SAMPLES
