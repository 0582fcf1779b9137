"""Toxicity as an ordinal severity: cumulative-link regression on the words of a text."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import columns, lower_ascii, placed, portions, span_hashes, stage, utf8, words

#: Labelled documents that the model is fitted on, at most; those with the least hashes of their ids.
SAMPLE = 12_000
#: A word is a feature if it is in so many documents of the sample and its presence depends on the label by more than
#: chance: so many standard deviations. There may be any number of them.
LEAST, CHANCE = 2, 3.5
GRADES = 4
#: Probability of any grade above 0 from which a text is rejected, where texts are as often toxic as among the labels.
REJECT = 0.2

_EDGE = np.zeros(256, bool)
_EDGE[[*b".,;:!?\"'()[]{}*#$%&|-_"]] = True


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every word, lower-cased (A-Z), without punctuation at its ends."""
    data = lower_ascii(data)
    starts, ends, row = words(data, offsets)
    for _ in range(4):
        cut = (ends - starts > 1) & _EDGE[data[np.maximum(ends - 1, 0)]] if len(ends) else np.zeros(0, bool)
        ends = ends - cut
    if len(starts):
        starts = starts + ((ends - starts > 1) & _EDGE[data[starts]])
    return span_hashes(data, starts, ends).view(np.int64), row


@dataclass(frozen=True)
class Model:
    """P(grade > k) = sigmoid(x . weights - cuts[k]): one weight vector for all thresholds, cuts in increasing order."""

    hashes: np.ndarray  # int64, sorted
    weights: np.ndarray
    cuts: np.ndarray

    def above(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """P(grade > k) of each row for each threshold k."""
        n = len(offsets) - 1
        h, row = word_hashes(data, offsets)
        score = np.zeros(n)
        if len(self.hashes) and len(h):
            at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
            hit = self.hashes[at] == h
            pair = np.unique(row[hit] * np.int64(len(self.hashes)) + at[hit])
            np.add.at(score, pair // len(self.hashes), self.weights[pair % len(self.hashes)])
        return 1 / (1 + np.exp(np.clip(self.cuts[None, :] - score[:, None], -40, 40)))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit_ordinal(x: np.ndarray | tuple[np.ndarray, np.ndarray, int], y: np.ndarray, grades: int, ridge: float = 1e-3, rounds: int = 400) -> tuple[np.ndarray, np.ndarray]:
    """Weights and increasing cuts by likelihood; y: grades from 0.

    x: rows of features, or for features that are there or not, the row and number of each one that is, by row, and how
    many features there are. cuts[0] and the logarithms of the gaps between cuts are free, so the order holds.
    Full-batch Adam, no randomness.
    """
    n = len(y)
    if isinstance(x, tuple):
        row, col, d = x
        forward, back = lambda w: np.bincount(row, w[col], n), lambda s: np.bincount(col, s[row], d)
    else:
        d = x.shape[1]
        forward, back = lambda w: x @ w, lambda s: x.T @ s
    p = np.zeros(d + grades - 1)
    base = np.clip(np.mean(y > 0), 1e-3, 1 - 1e-3)
    p[d] = np.log((1 - base) / base)
    m, v = np.zeros_like(p), np.zeros_like(p)
    for t in range(1, rounds + 1):
        gaps = np.exp(np.clip(p[d + 1 :], -8, 3))
        cuts = p[d] + np.r_[0, np.cumsum(gaps)]
        s = forward(p[:d])
        # P(y) = F(upper) - F(lower) with F the logistic distribution at cut - s
        top, low = np.r_[cuts, np.inf][y], np.r_[-np.inf, cuts][y]
        fu, fl = np.where(np.isinf(top), 1.0, _sigmoid(np.where(np.isinf(top), 0, top) - s)), np.where(np.isinf(low), 0.0, _sigmoid(np.where(np.isinf(low), 0, low) - s))
        prob = np.maximum(fu - fl, 1e-12)
        du, dl = fu * (1 - fu) / prob, fl * (1 - fl) / prob
        ds = (du - dl) / n  # of the negative log-likelihood by s
        dcut = np.array([(-(du * (y == k)).sum() + (dl * (y == k + 1)).sum()) / n for k in range(grades - 1)])
        g = np.r_[back(ds) + ridge * p[:d], dcut.sum(), [dcut[k + 1 :].sum() * gaps[k] for k in range(grades - 2)]]
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        p -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
    gaps = np.exp(np.clip(p[d + 1 :], -8, 3))
    return p[:d], p[d] + np.r_[0, np.cumsum(gaps)]


def graded(row: np.ndarray, col: np.ndarray, d: int, toxic: np.ndarray, grades: int) -> np.ndarray:
    """Grades from labels that only say toxic or not: 0, and 1 up to `grades` - 1 by how toxic others make a text look.

    The sample is cut in two; each half's texts are scored by a model of the two classes that is fitted on the other
    half, so no text has a say in its own grade. Toxic texts are then cut at quantiles of that score, in either half.
    """
    half = np.arange(len(toxic)) % 2
    y = toxic.astype(np.int64)
    for k in (0, 1):
        own = np.flatnonzero((half == k) & (toxic == 1))
        other = half != k
        if not len(own) or not toxic[other].any():
            continue
        number = np.cumsum(other) - 1
        kept = other[row]
        weights, _ = fit_ordinal((number[row[kept]], col[kept], d), toxic[other].astype(np.int64), 2, rounds=200)
        score = np.bincount(row, weights[col], len(toxic))[own]
        y[own] = 1 + np.searchsorted(np.quantile(score, np.arange(1, grades - 1) / (grades - 1)), score, "left")
    return y


def fit(docs: DataFrame, labels: DataFrame, grades: int = GRADES, sample: int = SAMPLE) -> Model:
    """Fit on at most `sample` labelled documents: half toxic ones, as far as there are so many.

    Grades come from `graded`. Counts of words are taken over the whole sample; of the sampled texts only which features
    they have come to the driver, as numbers.
    """
    labels = columns(labels, ["doc_id", "toxic"]).where("doc_id is not null and toxic is not null")
    whole = labels.agg(F.count("*"), F.sum(F.col("toxic").cast("int"))).first()
    half = sample // 2
    order = F.xxhash64(F.lit(17), "doc_id")
    chosen = labels.where("toxic = 1").orderBy(order, "doc_id").limit(half).unionAll(labels.where("toxic = 0").orderBy(order, "doc_id").limit(half))
    chosen = chosen.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    rows = columns(docs, ["doc_id", "text"]).join(F.broadcast(chosen), "doc_id")  # at most `sample` rows of two numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, "text"):
            h, row = word_hashes(*utf8(batch.column("text")))
            order = np.lexsort((h, row))
            h, row = h[order], row[order]
            first = np.r_[True, (h[1:] != h[:-1]) | (row[1:] != row[:-1])] if len(h) else np.zeros(0, bool)
            h, row = h[first], row[first]
            at = np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), pa.ListArray.from_arrays(pa.array(at), pa.array(h))], ["doc_id", "toxic", "h"])

    id_type = rows.schema["doc_id"].dataType.simpleString()
    held = stage(rows.mapInArrow(run, f"doc_id {id_type}, toxic int, h array<bigint>"), "toxic-sample")
    of = held.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    n, n1 = int(of[0]), int(of[1])
    if not n1 or n1 == n:
        return Model(np.zeros(0, np.int64), np.zeros(0), np.full(grades - 1, 30.0 if not n1 else -30.0) + np.arange(grades - 1))
    count = held.select("toxic", F.explode("h").alias("w")).groupBy("w").agg(F.sum("toxic").alias("t"), F.count("*").alias("c")).where(F.col("c") >= LEAST)
    a, b = F.col("t") / n1, (F.col("c") - F.col("t")) / (n - n1)
    mean = F.col("c") / n
    z = F.abs(a - b) / F.sqrt(mean * (1 - mean + 1e-9) * (1 / n1 + 1 / (n - n1)))
    hashes = np.sort(np.asarray(count.where(z > CHANCE).select("w").toArrow()["w"]).astype(np.int64))
    if not len(hashes):
        return Model(hashes, np.zeros(0), np.full(grades - 1, 30.0) + np.arange(grades - 1))

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, many = np.asarray(batch.column("h").flatten()), np.asarray(pa.compute.list_value_length(batch.column("h")))
            at = np.minimum(np.searchsorted(hashes, flat), len(hashes) - 1)
            hit = hashes[at] == flat
            cut = np.r_[0, np.cumsum(hit)][np.r_[0, np.cumsum(many)]].astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), pa.ListArray.from_arrays(pa.array(cut), pa.array(at[hit].astype(np.int32)))], ["doc_id", "toxic", "f"])

    got = held.mapInArrow(known, f"doc_id {id_type}, toxic int, f array<int>").orderBy("doc_id", F.hash("f")).toArrow()
    toxic = np.asarray(got["toxic"]).astype(np.int64)
    lists = got["f"].combine_chunks()
    row = np.repeat(np.arange(len(toxic)), np.asarray(pa.compute.list_value_length(lists)))
    col = np.asarray(lists.flatten()).astype(np.int64)
    y = graded(row, col, len(hashes), toxic, grades)
    weights, cuts = fit_ordinal((row, col, len(hashes)), y, grades)
    # The sample has more toxic texts than the labels where there are many; probabilities are those of the labels.
    cuts = cuts + np.log(n1 / (n - n1)) - np.log(whole[1] / (whole[0] - whole[1]))
    return Model(hashes, weights, cuts)


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep`, severity (the expected grade), p_toxic (of any grade above 0), grade (the likeliest), rejected.

    One pass without a shuffle; the model goes out with the code. Null and empty texts have
    no words and get the score of that; repeated rows and null ids are scored as any other; an empty table gives an
    empty result.
    """
    kept = columns(docs, list(dict.fromkeys([*keep, "text"])))
    schema = ", ".join([f"`{c}` {kept.schema[c].dataType.simpleString()}" for c in keep] + ["severity double, p_toxic double, grade int, rejected boolean"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, "text"):
            above = model.above(*utf8(batch.column("text")))
            each = np.c_[np.ones(len(above)), above] - np.c_[above, np.zeros(len(above))]
            cols = [pa.array(above.sum(1)), pa.array(above[:, 0]), pa.array(each.argmax(1).astype(np.int32)), pa.array(above[:, 0] >= REJECT)]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + cols, [*keep, "severity", "p_toxic", "grade", "rejected"])

    return kept.mapInArrow(run, schema)


def clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the model, fitted on `labels`, does not reject; all columns, whatever they are called.

    Null and empty texts have no words and stay; repeated rows and null ids are judged as any other; of several columns
    named text the first counts; without toxic labels all stay; an empty table gives an empty result.
    """
    model = fit(docs, labels)
    place, names = placed(docs)
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, at):
            yield batch.filter(pa.array(model.above(*utf8(batch.column(at)))[:, 0] < REJECT))

    return place.mapInArrow(run, place.schema).toDF(*names)
