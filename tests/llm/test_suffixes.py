"""Repeated bytes equal brute force; the family of suffix arrays marks what a plain count marks."""

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from quarry.llm import suffixes


def brute(rows, n=suffixes.LENGTH):
    data = [(t or "").encode() for _, t in rows]
    count = Counter(b[i : i + n] for b in data for i in range(len(b) - n + 1))
    out = []
    for (d, _), b in zip(rows, data, strict=True):
        gone = bytearray(len(b))
        for i in range(len(b) - n + 1):
            if count[b[i : i + n]] > 1:
                gone[i : i + n] = b"\1" * n
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def corpus(seed):
    r = random.Random(seed)
    prose = lambda n: " ".join("".join(r.choice("abcdeéß") for _ in range(r.randint(1, 7))) for _ in range(n))
    passages = [prose(r.randint(20, 160)) for _ in range(8)]
    rows = []
    for i in range(60):
        t = prose(r.randint(0, 80))
        for _ in range(r.choice([0, 1, 2])):
            t += r.choice(["", " "]) + r.choice(passages) + " " + prose(r.randint(0, 30))
        rows.append((i, t))
    base = prose(120)
    for i in range(12):
        w = base.split(" ")
        w[r.randrange(len(w))] = prose(1)
        rows.append((100 + i, " ".join(w)))
    rows += [(200, "the " * 150), (201, "the " * 80), (202, "x" * 199), (203, "y" * 200), (204, "z" * 201), (205, None), (206, ""), (207, rows[3][1]), (207, rows[3][1]), (None, rows[70][1]), (None, "q" * 450)]
    return rows


@pytest.mark.parametrize(("seed", "hot"), [(1, suffixes.HOT), (2, 4), (5, 1), (6, 12)])
def test_equals_brute_force(spark, seed, hot):
    rows = corpus(seed)
    docs = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, first int")
    got = sorted(map(tuple, suffixes.without_repeats(docs, hot).collect()), key=str)
    assert got == brute(rows)
    assert suffixes.without_repeats(docs.limit(0)).count() == 0


def test_family_marks_repeats_across_batches():
    r = np.random.default_rng(3)
    texts = [r.integers(97, 99, 400).astype(np.uint8) for _ in range(9)]
    family = suffixes.Family(length=12, batch=100)
    for t in texts:
        family.add(t, np.arange(len(t) - 11))
    count = Counter(t[i : i + 12].tobytes() for t in texts for i in range(len(t) - 11))
    for t, got in zip(texts, family.repeated, strict=True):
        assert got.tolist() == [count[t[i : i + 12].tobytes()] > 1 for i in range(len(t) - 11)]
    sizes = [len(x) for x in family.levels]
    assert sum(sizes) == 9 * 389 and all(a >= 2 * b for a, b in zip(sizes, sizes[1:], strict=False))


def test_anchors_do_not_depend_on_stretches(monkeypatch):
    data = np.frombuffer(("abc def " * 40 + "".join(map(str, range(900)))).encode(), np.uint8)
    at = np.array([0, 300, len(data)])
    want = suffixes.anchors(data, at)
    monkeypatch.setattr(suffixes, "_STEP", 97)
    got = suffixes.anchors(data, at)
    every = lambda x: [(r, f + k, g) for r, f, c, g, _ in zip(*(y.tolist() for y in x), strict=True) for k in range(c)]
    assert every(got) == every(want)


def test_levels_are_suffix_arrays_and_merges_are_scans():
    r = np.random.default_rng(8)
    family = suffixes.Family(length=9)
    for n in (700, 90, 800, 40, 1500, 60):
        family.add(r.integers(0, 3, n).astype(np.uint8), np.arange(n - 8))
        for level in family.levels:
            strings = [level.text[i : i + 9].tobytes() for i in level.at]
            assert strings == sorted(strings)
    assert sorted(np.concatenate([x.window for x in family.levels]).tolist()) == list(range(family.windows))


def test_small_families_and_parts_give_the_same(monkeypatch):
    rows = corpus(7)
    data = pa.array([(t or "") for _, t in rows])
    raw, at = suffixes.utf8(data)
    row, first, count, g, c = suffixes.anchors(raw, at)
    order = np.argsort(g.view(np.int64), kind="stable")
    contexts = [raw[at[row[i]] + first[i] : at[row[i]] + first[i] + count[i] + suffixes.LENGTH - 1].tobytes() for i in order]
    batch = pa.record_batch({"a": g.view(np.int64)[order], "c": np.arange(len(order)), "n": np.ones(len(order), np.int64), "context": pa.array(contexts, pa.binary())})
    found = lambda **k: sorted(tuple(x.values()) for b in suffixes._matched(iter([batch.slice(0, 50), batch.slice(50)]), **k) for x in b.to_pylist())
    want = found()
    assert want
    monkeypatch.setattr(suffixes, "_PART", 64)
    assert found(held=1, batch_size=300) == want == found(held=5000, batch_size=1)


def test_a_very_long_repeated_text(spark):
    r = random.Random(4)
    text = "".join(r.choice("abcdefgh ") for _ in range(2_000_000))
    docs = spark.createDataFrame([(1, text), (2, text), (3, "head " + text[1_000_000:1_000_500] + " tail")], "doc_id long, text string")
    got = {x.doc_id: x for x in suffixes.without_repeats(docs).collect()}
    assert [got[k].n_removed for k in (1, 2, 3)] == [2_000_000, 2_000_000, 500]


def test_crowded_anchors_are_split_by_what_stands_beside_them(spark):
    """One phrase of 90 bytes in very many surroundings, some of which repeat."""
    r = random.Random(12)
    prose = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    phrase, near = prose(90), [(prose(120), prose(120)) for _ in range(6)]
    rows = [(i, prose(150) + phrase + prose(150)) for i in range(60)]
    rows += [(100 + i, prose(40) + a + phrase + b + prose(30)) for i, (a, b) in enumerate(r.choice(near) for _ in range(20))]
    rows += [(200 + i, prose(150) + phrase + near[i % 6][1]) for i in range(12)] + [(7, rows[3][1]), (7, rows[3][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, suffixes.without_repeats(docs, 40).collect()), key=str)
    assert got == brute(rows)
