"""Geometry from columns equals the plain functions, on texts of all kinds."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarry.functions import geometry as G
from quarry.plans import QUERIES

from .oracle import DATA


def texts(seed, n=400):
    r = random.Random(seed)
    number = lambda: r.choice([str(r.randint(-99, 999)), f"{r.uniform(-50, 500):.3f}", "0", "-0.01", ".5", "1e2", "7.", "0.05", "12345.65"])
    sep = lambda: r.choice([" ", ",", ", ", " ,\n"])
    paths, moves, declared = [None, "", "M", "z"], [None, "", "none"], [None, "", ";", "fill:red"]
    for _ in range(n):
        p = "".join(r.choice("MmLlHhVvCcSsQqTtZz" + "Aa" * (r.random() < 0.2)) + sep().join(number() for _ in range(r.choice([0, 1, 2, 3, 4, 6, 7, 8, 14]))) + r.choice(["", " "]) for _ in range(r.randint(1, 5)))
        paths.append(r.choice(["", "12 "]) + p.replace("999", r.choice(["NaN", "999"])))
        moves.append(sep().join(r.choice(["translate", "rotate", "scale", "matrix", "skewX", "Translate"]) + r.choice(["", " "]) + "(" + sep().join(number() + r.choice(["", "", "px", "deg", "null"]) for _ in range(r.randint(0, 6))) + ")" for _ in range(r.randint(1, 3))))
        declared.append(r.choice([";", "; ", " ;"]).join(r.choice(["font-size", "stroke-width", "fill", "Font-Size"]) + r.choice([":", ": ", " : "]) + r.choice([number(), number() + "px", number() + "em", number() + " rem", "thin", "12%"]) for _ in range(r.randint(1, 4))))
    return paths, moves, declared


def test_native_equals_plain(spark):
    paths, moves, declared = texts(3)
    for scale in (0.37, 2.0, 1.0):
        s = F.lit(scale)
        cases = [
            (paths, G.scale_path, lambda t: G.path_scaled(t, scale)),  # noqa: B023
            (paths, G.unscale_path, lambda t: G.path_unscaled(t, scale)),  # noqa: B023
            (moves, G.scale_transform, lambda t: G.transform_mapped(t, lambda v: round(v * scale, 1))),  # noqa: B023
            (moves, G.unscale_transform, lambda t: G.transform_mapped(t, lambda v: round(v / scale, 2))),  # noqa: B023
            (declared, G.scale_style, lambda t: G.style_mapped(t, lambda v: round(v * scale, 1))),  # noqa: B023
            (declared, G.unscale_style, lambda t: G.style_mapped(t, lambda v: round(v / scale, 2))),  # noqa: B023
        ]
        for own, native, plain in cases:
            table = spark.createDataFrame(list(enumerate(own)), "i int, t string")
            got = {r.i: r.x for r in table.select("i", native(F.col("t"), s).alias("x")).collect()}
            for i, t in enumerate(own):
                assert got[i] == plain(t), (t, got[i], plain(t))


def test_no_scale(spark):
    one = spark.createDataFrame([("M1 2", "translate(1)", "font-size: 2px")], "p string, t string, s string")
    z = F.lit(0.0)
    assert tuple(one.select(G.unscale_path(F.col("p"), z), G.unscale_transform(F.col("t"), z), G.unscale_style(F.col("s"), z)).first()) == ("M1 2", "translate(1)", "font-size: 2px")


def compact(seed, n=600):
    """Paths whose numbers and flags stick together, and texts that are nearly paths."""
    r = random.Random(seed)
    some = lambda: r.choice(["5", ".5", "-1.5", "1.", "06", "10"])
    flag = lambda: r.choice(["0", "1", "0 ", "1,", "5 ", "-1 ", ".5 ", "1."])
    arcs = lambda: "".join(f"{some()} {some()}{r.choice([' ', ',', ''])}{r.randint(0, 90)} {flag()}{flag()}{r.choice(['', ' ', '-', '.', '1'])}{r.randint(0, 99)} {some()} " for _ in range(r.choice([1, 2, 3, 30])))
    letters = "MmLlHhVvCcZzAaAa" + "01.-+ ," * 5 + "23456789"
    return [r.choice(["", "1 ", "M0 0"]) + r.choice("Aa") + arcs() if i % 2 else "".join(r.choice(letters) for _ in range(r.randint(0, 60))) for i in range(n)] + ["", "M", "M1e2 3", "Mnull 1", "M\u0663 \u0664", "M\u00e91 2"]


@pytest.mark.parametrize("portion", [1, 2000, G._PORTION])
def test_batches_equal_plain(monkeypatch, portion):
    monkeypatch.setattr(G, "_PORTION", portion)
    own, read = compact(portion), []
    plain = lambda t: read.append(t) or G.path_scaled(t, 0.37)
    got = G._paths_mapped(pa.array(["skipped", *own]).slice(1), G._Numbers(lambda v: G._one_decimal(v * 0.37)), plain).to_pylist()
    assert got == [G.path_scaled(t, 0.37) for t in own]
    assert len(read) < len(own) * 0.6


def test_numbers_remembered_are_bounded(monkeypatch):
    monkeypatch.setattr(G, "_REMEMBERED", 10)
    numbers = G._Numbers(lambda v: G._two_decimals(v / 0.5))
    own = [f"M{i} {i}.25h{i + 1}" for i in range(500)]
    assert G._paths_mapped(pa.array(own), numbers, lambda t: G.path_unscaled(t, 0.5)).to_pylist() == [G.path_unscaled(t, 0.5) for t in own]
    assert len(numbers) <= 10


def test_scales_of_rows(spark):
    """Each row has its scale; no path or no scale gives none, a scale of 0 undoes nothing. Large numbers keep their digits, in arcs too."""
    rows = [(i, t, s) for i, t in enumerate(texts(5, 100)[0]) for s in (0.37, 2.0, 0.0, float("nan"), None)] + [(999, "M1 2", i / 7) for i in range(1, 60)]
    table = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, i int, t string, s double")
    both = table.select("k", G.scale_path(F.col("t"), F.col("s")).alias("x"), G.unscale_path(F.col("t"), F.col("s")).alias("y"))
    got = {r.k: (r.x, r.y) for r in both.collect()}
    for k, (_, t, s) in enumerate(rows):
        assert got[k] == ((None, None) if s is None else (G.path_scaled(t, s), G.path_unscaled(t, s))), (t, s)
    fixed = table.select("k", G.unscale_path(G.scale_path(F.col("t"), 0.37), 2).alias("x"))
    assert {r.k: r.x for r in fixed.collect()} == {k: G.path_unscaled(G.path_scaled(t, 0.37), 2) for k, (_, t, _) in enumerate(rows)}
    large = spark.createDataFrame([("M1e16 1L5 5",), ("M1e16 1A5 5 0 015 5",)], "t string")
    assert [r.x.split()[1] for r in large.select(G.scale_path(F.col("t"), F.lit(1.0)).alias("x")).collect()] == ["10000000000000000.0"] * 2


def test_paths_are_read_once(spark):
    """Scaling and its inverse share one trip to Python; no pattern is evaluated again for each use of its result."""
    plan = QUERIES["path_unscale_roundtrip"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "regexp" not in plan.lower(), plan
