"""Mixing sources to target weights by entropy balancing, with DataFrame functions only."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .base import checkpoint, columns, place_of, placed, row_hash, shuffled, stage

WORD = r"[^\x20\x09-\x0D]+"
#: Documents of one source and size that one task ranks together, about.
RANKED = 512


def targets(sizes: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """s (rank of the source), source, source_size, documents, target; from source and size of each document.

    Sources by code point, null last, take the weights in turn and share `share` times all sizes; a target stops at
    `most` times its source's size and the excess is reshared by weight. That ends where all targets below the stop
    have the same ratio to weight (the water level), found by one pass over the sources sorted by stop / weight. The
    sums run over one row for each source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("documents"))
    per = per.withColumn("s", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())).cast("long"))
    list_ = F.array(*[F.lit(float(w)) for w in weights])
    per = per.withColumn("w", F.element_at(list_, ((F.col("s") - 1) % len(weights) + 1).cast("int")))
    per = per.withColumn("stop", F.col("source_size") * F.lit(float(most))).withColumn("ratio", F.col("stop") / F.col("w"))
    every = W.partitionBy()
    upto = W.orderBy("ratio", "s").rowsBetween(W.unboundedPreceding, -1)
    per = per.withColumn("budget", F.sum("source_size").over(every) * F.lit(float(share)))
    per = per.withColumn("level", (F.col("budget") - F.coalesce(F.sum("stop").over(upto), F.lit(0.0))) / (F.sum("w").over(every) - F.coalesce(F.sum("w").over(upto), F.lit(0.0))))
    # The first source that the level does not fill sets it; below it all are full.
    level = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "s", "level"))).over(every)["level"]
    per = per.withColumn("at", level)
    return per.select("s", "source", "source_size", "documents", F.least("stop", F.coalesce(F.col("w") * F.col("at"), F.col("stop"))).alias("target"))


def solve(sizes: DataFrame, per: DataFrame, most: int, rounds: int = 80, near: float = 1e-12) -> DataFrame:
    """s, tilt: the dual solution of entropy balancing for each source that has words and a target below its stop.

    Of all rates from 0 to `most` that document k may have, those with sum of rate * size = target that are nearest to
    1 in relative entropy are least(most, exp(tilt * size / mean size)): the dual has one variable for each source's
    token constraint, and the bound is part of it, not cut off afterwards. Newton steps on the logarithm of the sum,
    each one aggregate over the histogram of sizes for all sources at once, kept inside a bracket that every step
    shrinks (a step that leaves it, or follows one that did not halve the residual, is a bisection). Only the number of
    open sources and the largest residual come to the driver. Raises if a source does not settle.
    """
    x = F.col("size") * F.col("documents") / F.col("source_size")
    open_ = per.where((F.col("source_size") > 0) & (F.col("target") < F.col("source_size") * F.lit(float(most)) * (1 - 1e-12)))
    fixed = open_.select("s", "documents", "source_size", F.greatest("target", F.lit(1e-9)).alias("target"))
    hist = stage(sizes.where("size > 0").join(fixed, "s").select("s", "size", x.alias("x"), F.col("n").cast("double").alias("n")), "mix-sizes")
    least = hist.groupBy("s").agg(F.min("x").alias("x0"))
    ratio = F.col("target") / F.col("source_size")
    # Below lo the sum is under the target as size * exp(-a * size) is at most 1 / (e * a); at hi every rate is `most`.
    state = fixed.join(least, "s").select(
        "s",
        "target",
        F.when(ratio < 1, -1 / (F.lit(math.e) * ratio)).otherwise(0.0).alias("lo"),
        F.when(ratio > 1, F.log(F.lit(float(most))) / F.col("x0")).otherwise(0.0).alias("hi"),
        F.log(ratio).alias("tilt"),
    )
    state = checkpoint(state.withColumn("tilt", F.greatest("lo", F.least("hi", "tilt"))).withColumn("was", F.lit(float("inf"))))
    for _ in range(rounds):
        rate = F.least(F.lit(float(most)), F.exp(F.col("tilt") * F.col("x")))
        words = F.col("n") * F.col("size") * rate
        slope = F.when(rate < float(most), words * F.col("x")).otherwise(0.0)
        sums = hist.join(state, "s").groupBy("s", "target", "lo", "hi", "tilt", "was").agg(F.sum(words).alias("g"), F.sum(slope).alias("dg"))
        off = F.log(F.col("g") / F.col("target"))
        sums = sums.withColumn("off", F.coalesce(off, F.lit(-1.0)))
        sums = sums.withColumn("lo", F.when(F.col("off") < 0, F.col("tilt")).otherwise(F.col("lo"))).withColumn("hi", F.when(F.col("off") > 0, F.col("tilt")).otherwise(F.col("hi")))
        new = F.col("tilt") - F.col("off") * F.col("g") / F.nullif("dg", F.lit(0.0))
        half = (F.col("lo") + F.col("hi")) / 2
        good = new.isNotNull() & (new >= F.col("lo")) & (new <= F.col("hi")) & (F.abs("off") <= F.col("was") / 2)
        done = (F.abs("off") < near) | (F.col("hi") - F.col("lo") <= 1e-15 * F.abs("tilt"))
        state = checkpoint(sums.select("s", "target", "lo", "hi", F.when(done, F.col("tilt")).when(good, new).otherwise(half).alias("tilt"), F.abs("off").alias("off"), F.when(good, F.abs("off")).otherwise(F.lit(float("inf"))).alias("was"), done.alias("done")))
        left = state.where("not done").agg(F.count("*"), F.max("off")).first()
        if not left[0]:
            # Sums of the last bits may differ between runs; what is rounded here does not.
            return state.select("s", F.expr("double(format_string('%.7e', tilt))").alias("tilt"))
        state = state.drop("off", "done")
    raise RuntimeError(f"entropy balancing: {left[0]} sources did not settle in {rounds} rounds (off by {left[1]:.3g})")


def rounded(rates: DataFrame, most: int) -> DataFrame:
    """s, size, total: copies of all documents of one source and size together, whole numbers.

    The running sum of rates over the sizes of a source is cut at whole numbers. What a source's words then miss its
    target by is made up in a few groups: one size for each power of two, the longest that fits first, so the rest is
    less than the shortest of these sizes as long as groups have copies to give or take. One row for each source and
    size; the array that is walked has at most 64 entries.
    """
    mass = F.col("n") * F.col("rate")
    upto = F.sum(mass).over(W.partitionBy("s").orderBy("size"))
    cut = rates.withColumn("upto", upto).withColumn("total", F.floor(F.col("upto") + 0.5) - F.floor(F.col("upto") - mass + 0.5))
    cut = checkpoint(cut.select("s", "size", "n", "target", F.greatest(F.lit(0), F.least(F.col("total"), F.col("n") * most)).cast("long").alias("total")))
    miss = cut.groupBy("s").agg((F.max("target") - F.sum(F.col("size") * F.col("total"))).alias("miss"))
    spare = F.when(F.col("miss") > 0, F.col("n") * most - F.col("total")).otherwise(F.col("total"))
    room = cut.where("size > 0").join(miss, "s").select("s", "miss", "size", spare.alias("spare")).where("spare > 0 and size <= abs(miss)")
    best = room.groupBy("s", "miss", F.floor(F.log2("size")).alias("scale")).agg(F.max(F.struct("spare", -F.col("size"))).alias("top"))
    best = best.groupBy("s", "miss").agg(F.sort_array(F.collect_list(F.struct((-F.col("top.col2")).alias("size"), F.col("top.spare").alias("spare"))), asc=False).alias("sizes"))
    walk = """aggregate(sizes, named_struct('left', abs(miss), 'took', cast(array() as array<struct<z: bigint, k: bigint>>)),
        (a, e) -> named_struct('left', a.left - least(e.spare, cast(floor(a.left / e.size) as bigint)) * e.size,
            'took', concat(a.took, array(named_struct('z', e.size, 'k', least(e.spare, cast(floor(a.left / e.size) as bigint)))))),
        a -> a.took)"""
    took = best.select("s", "miss", F.explode(F.expr(walk)).alias("e")).select("s", F.col("e.z").alias("size"), (F.signum("miss") * F.col("e.k")).cast("long").alias("more"))
    return cut.join(took, ["s", "size"], "left").select("s", "size", (F.col("total") + F.coalesce("more", F.lit(0))).alias("total"))


def mix(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: int = 2, seed: int = 0) -> DataFrame:
    """doc_id, size (words), source_size, target, rate (six decimals), copies and taken (size * copies) of every document.

    Rates are those of `solve`; at a source's stop all of its documents have rate `most`. All documents of one source
    and size have one rate; `rounded` gives their number of copies together, dealt out evenly over them in the order of
    a seeded hash, so copies are the floor or ceiling of their mean and at most `most`. Within a source and size,
    documents are ranked in parts of about RANKED by their hash, so a large group of equal sizes is not gathered.

    A null text has size 0; null sources are one source, the last; documents of size 0 take no words and have one copy;
    equal rows are mixed as separate documents and may get different numbers of copies; other columns are not read; an
    empty table gives an empty result. Reruns agree: nothing depends on partitions or their order.
    """
    docs = columns(docs, ["doc_id", "source", "text"])
    return _mix(docs, ("doc_id",), shuffled(seed, F.col("doc_id"), F.col("text")), row_hash(seed, *docs.columns), weights, share, most)


def _mix(docs: DataFrame, keep: Sequence[str], h: Column, g: Column, weights: Sequence[float], share: float, most: int) -> DataFrame:
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    rows = stage(docs.select(*keep, F.col("source").alias("__source"), size.alias("__size"), h.alias("__h"), g.alias("__g")), "mix")
    per = checkpoint(targets(rows.select(F.col("__source").alias("source"), F.col("__size").alias("size")), weights, share, most))
    by_size = rows.groupBy("__source", F.col("__size").alias("size")).agg(F.count("*").alias("n"))
    by_size = by_size.join(per.select("source", "s"), F.col("__source").eqNullSafe(F.col("source"))).select("s", "size", "n")
    by_size = checkpoint(by_size)
    tilt = solve(by_size, per, most)
    # A row for each source and size; a source without a tilt is at its stop or has no words.
    rate = F.least(F.lit(float(most)), F.exp(F.col("tilt") * F.col("size") * F.col("documents") / F.col("source_size")))
    rates = by_size.join(per.join(tilt, "s", "left"), "s")
    rates = rates.withColumn("rate", F.when(F.col("size") == 0, 1.0).otherwise(F.coalesce(rate, F.lit(float(most)))))
    rates = checkpoint(rates.select("s", F.col("source").alias("o"), "size", "n", "source_size", "target", "rate"))
    total = rounded(rates.select("s", "size", "n", "target", "rate"), most)
    rates = checkpoint(rates.join(total, ["s", "size"]).withColumn("parts", F.ceil(F.col("n") / RANKED).cast("long")).drop("s"))
    found = rows.join(rates, F.col("__source").eqNullSafe(F.col("o")) & (F.col("__size") == F.col("size"))).drop("o")
    found = found.withColumn("part", F.floor(F.col("__h") * F.lit(2.0**-60) * F.col("parts")))
    own = ["__source", "__size", "part"]
    part = found.groupBy(*own).agg(F.count("*").alias("m"))
    part = part.select(F.col("__source").alias("o"), F.col("__size").alias("z"), F.col("part").alias("p"), (F.sum("m").over(W.partitionBy("__source", "__size").orderBy("part")) - F.col("m")).alias("k0"))
    k = F.row_number().over(W.partitionBy(*own).orderBy("__h", "__g")) - 1
    found = found.withColumn("k", k).join(part, F.col("__source").eqNullSafe(F.col("o")) & (F.col("__size") == F.col("z")) & (F.col("part") == F.col("p")))
    found = found.withColumn("j", F.col("k0") + F.col("k"))
    found = found.withColumn("copies", F.expr("cast(((j + 1) * total) div n - (j * total) div n as int)"))
    return found.select(*keep, *(["__h", "__g"] if not keep else []), "size", "source_size", "target", F.round("rate", 6).alias("rate"), "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mixed(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: int = 2, seed: int = 0) -> DataFrame:
    """The documents of the mix themselves, each as many times as it has copies.

    Copies are found without the texts, which are shuffled once, to meet them, by 124 bits of hash of the whole row.
    Rows equal in every column share theirs: they are written as often as they have copies together. Columns are known
    by their place here, so any names, clashing ones too, come back as they were; of several columns named doc_id,
    source or text the first counts. Nulls, empty texts and empty tables: as in `mix`.
    """
    place, names = placed(docs)
    read = place.select(*[F.col(place_of(names, c)).alias(c) for c in ("source", "text")], "*")
    h, g = row_hash(seed, *place.columns).bitwiseAND(F.lit((1 << 60) - 1)), row_hash(seed + 1, *place.columns)
    total = _mix(read, (), h, g, weights, share, most).where("copies > 0").groupBy("__h", "__g").agg(F.sum("copies").cast("int").alias("__c"))
    once = place.withColumn("__h", h).withColumn("__g", g).dropDuplicates(["__h", "__g"])
    found = once.join(total, ["__h", "__g"])
    return found.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__c")))).select(*place.columns).toDF(*names)
