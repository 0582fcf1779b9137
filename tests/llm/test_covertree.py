"""Threshold pairs equal brute force over all vectors, whatever the blocks."""

import numpy as np
import pytest

from quarry.llm import covertree


def brute(rows, cosine=0.9):
    def good(v):
        return v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)

    n = len(rows)
    u = [np.array(v, np.float64) / np.linalg.norm(np.array(v, np.float64)) if good(v) else None for _, v in rows]
    links, comp = np.zeros(n, int), np.arange(n)
    for i in range(n):
        for j in range(i):
            if u[i] is not None and u[j] is not None and len(u[i]) == len(u[j]) and u[i] @ u[j] >= cosine:
                links[i] += 1
                links[j] += 1
                comp[comp == comp[i]] = comp[j]
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [rows[k][0] for k in np.flatnonzero(comp == comp[i]) if rows[k][0] is not None]
        c = min(ids) if ids else None
        out.append((d, int(links[i]), c if u[i] is not None else d, d == (c if u[i] is not None else d)))
    return sorted(out, key=str)


def vectors(seed, n=260, dim=12):
    r = np.random.default_rng(seed)
    out = []
    for k in range(n):
        if k % 3 == 0:
            centre = r.normal(size=dim) if k % 30 == 0 else centre  # noqa: F821
            v = centre + r.normal(size=dim) * r.choice([0.0, 0.01, 0.1, 0.25])
        else:
            v = r.normal(size=dim)
        out.append((k, [float(x) for x in v.astype(np.float32) * r.choice([1, 1, 2.5])]))
    return out


@pytest.mark.parametrize(("seed", "block"), [(1, 4096), (2, 40)])
def test_equals_brute_force(spark, seed, block):
    rows = vectors(seed)
    rows += [(900, None), (901, [0.0] * 12), (902, [float("nan")] * 12), (903, [None, *[1.0] * 11]), (904, [float("inf"), *[1.0] * 11]), (905, [1.0, 2.0]), (906, [1.0, 2.1]), (907, []), (3, rows[3][1]), (3, rows[3][1]), (None, rows[3][1])]
    table = spark.createDataFrame([(d, v, 0) for d, v in rows], "vec_id long, embedding array<float>, n long")
    got = sorted((tuple(g) for g in covertree.near_vectors(table, block=block).collect()), key=str)
    assert got == brute(rows)


def test_empty(spark):
    table = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert covertree.near_vectors(table).count() == 0


def test_bounds_prune_and_whole_nodes_count():
    r = np.random.default_rng(5)
    centres = covertree.unit(r.normal(size=(30, 16)))
    x = covertree.unit(np.concatenate([c + 0.004 * r.normal(size=(60, 16)) for c in centres]))
    order, nodes = covertree.build(x)
    tree = covertree.Tree(x[order], nodes, np.ones(len(x), np.int64))
    for (first, last, far, _, _), radius in zip(tree.levels, covertree.RADII, strict=True):
        assert far.max() <= radius + 1e-6 and (last > first).all()
    got = covertree.Pairs(tree, tree, True)
    want = (x[order] @ x[order].T >= 0.9).sum(1) - 1
    assert (got.links[0] == want).all()
    assert got.compared < len(x) ** 2 / 4


@pytest.mark.parametrize(("block", "pivots"), [(8, 2), (30, 1)])
def test_cells_of_several_levels_equal_brute_force(spark, monkeypatch, block, pivots):
    monkeypatch.setattr(covertree, "PIVOTS", pivots)
    made = []
    finer = covertree._finer
    monkeypatch.setattr(covertree, "_finer", lambda *a: made.append(1) or finer(*a))
    r = np.random.default_rng(9)
    rows = vectors(3, 200) + [(1000 + k, [float(x) for x in (np.eye(12)[0] + 0.01 * r.normal(size=12)).astype(np.float32)]) for k in range(150)]
    rows += [(2000, rows[-1][1]), (2001, [1.0, 2.0]), (2002, [1.0, 2.1]), (None, rows[-1][1])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted((tuple(g) for g in covertree.near_vectors(table, block=block).collect()), key=str)
    assert got == brute(rows) and made
