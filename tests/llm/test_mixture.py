"""Mixture: targets by a plain water level, words near them, copies within bounds, the same at every run."""

import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import mixture


def plain_targets(sizes):
    """Target of each source: excess above twice its size is shared again by weight until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    target, left, open_ = {}, 1.5 * sum(sizes.values()), set(names)
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level > 2 * sizes[s]}
        if not full:
            return target | {s: weight[s] * level for s in open_}
        for s in full:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        open_ -= full
    return target


@pytest.fixture(scope="module")
def docs(spark):
    source = lambda i: None if i % 20 == 19 else "hot" if i % 3 else f"s{i % 4}"
    text = lambda i: None if i % 97 == 0 else "" if i % 89 == 0 else "w x " * (1 + i * i % 60) + "\x0bend"
    return spark.createDataFrame([(i, text(i), source(i)) for i in range(3000)], "doc_id bigint, text string, source string").cache()


def test_targets_and_taken(docs):
    rows = mixture.mix(docs).collect()
    texts = {d.doc_id: d for d in docs.collect()}
    sizes, taken, target, longest = defaultdict(int), defaultdict(int), {}, defaultdict(int)
    for r in rows:
        d = texts[r.doc_id]
        assert r.size == len(re.findall(r"[^\x20\x09-\x0D]+", d.text or ""))
        assert 0 <= r.copies <= 2 and r.taken == r.size * r.copies
        sizes[d.source] += r.size
        taken[d.source] += r.taken
        target[d.source] = r.target
        longest[d.source] = max(longest[d.source], r.size)
    want = plain_targets(sizes)
    assert len(rows) == 3000 and want.keys() == target.keys()
    for s in want:
        assert target[s] == pytest.approx(want[s], rel=1e-9)
        assert abs(taken[s] - want[s]) <= 2 * longest[s] + 1
    assert all(r.source_size == sizes[texts[r.doc_id].source] for r in rows)


def test_reruns_agree(docs):
    key = lambda df: sorted((r.doc_id, r.taken) for r in df.collect())
    assert key(mixture.mix(docs)) == key(mixture.mix(docs.repartition(9)))


def test_mixed_rows_are_the_copies(docs):
    n = mixture.mix(docs).agg(F.sum("copies")).first()[0]
    out = mixture.mixed(docs)
    assert out.columns == docs.columns
    # The hash differs (all columns there), so counts agree only nearly.
    assert abs(out.count() - n) <= 10


def test_empty_without_words_and_repeated(spark, docs):
    assert mixture.mix(docs.where(F.lit(False))).collect() == []
    assert mixture.mixed(docs.where(F.lit(False))).collect() == []
    none = spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id bigint, text string, source string")
    assert [r.taken for r in mixture.mix(none).collect()] == [0, 0]
    same = spark.createDataFrame([(1, "a b", "x", 1)] * 10, "doc_id bigint, text string, source string, taken int")
    assert sum(r.taken for r in mixture.mix(same).collect()) == pytest.approx(30, abs=4)


def plain_tilt(sizes, target):
    """Bisection on least(2, exp(tilt * size / mean)) for the sum of rate * size."""
    x, mean = sizes.astype(float), sizes.mean()
    lo, hi = -1e4, 1e4
    for _ in range(300):
        mid = (lo + hi) / 2
        got = (x * np.minimum(2.0, np.exp(np.minimum(mid * x / mean, 50)))).sum()
        lo, hi = (mid, hi) if got < target else (lo, mid)
    return (lo + hi) / 2


def test_rates_are_the_entropy_balance_and_words_hit_the_target(spark):
    r = np.random.default_rng(3)
    rows = []
    for k, (source, n, scale) in enumerate((("a", 400, 30), ("b", 900, 60), ("c", 700, 8), (None, 300, 200), ("tiny", 40, 3))):
        for size in np.minimum(9000, np.maximum(1, r.lognormal(np.log(scale), 1.2, n))).astype(int):
            rows.append((len(rows), "w " * int(size), source))
    table = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = defaultdict(list)
    for d in mixture.mix(table).collect():
        got[rows[d.doc_id][2]].append(d)
    tilted = 0
    for source, own in got.items():
        sizes = np.array([d.size for d in own])
        target = own[0].target
        if target >= 2 * sizes.sum() - 1e-6:
            assert all(d.rate == 2 and d.copies == 2 for d in own)
            continue
        tilt = plain_tilt(sizes, target)
        want = np.minimum(2.0, np.exp(tilt * sizes / sizes.mean()))
        assert np.allclose([d.rate for d in own], want, rtol=1e-4)
        tilted += len({round(d.rate, 6) for d in own}) > 5
        assert abs(sum(d.taken for d in own) - target) <= np.quantile(sizes, 0.2) + 1, source
    assert tilted >= 2


def test_any_column_names_come_back(spark):
    names = ["doc_id", "text", "source", "h", "copy", "d", "c", "g", "__h", "__c", "c0", "text"]
    rows = [(i if i % 5 else None, "w " * (i % 9), "s" if i % 2 else None, *[f"{k}-{i}" for k in range(9)]) for i in range(60)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string, source string, " + ", ".join(f"x{k} string" for k in range(9))).toDF(*names)
    out = mixture.mixed(table)
    assert out.columns == names
    assert out.count() > 60 and {tuple(x) for x in out.collect()} <= set(rows)
