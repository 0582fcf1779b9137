"""Document quality from line labels: a linear-chain conditional random field over the lines of a text."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import columns, portions, span_hashes, stage, utf8, words

#: Labelled documents that the model is fitted on, at most; those with the least hashes of their ids.
SAMPLE = 6_000
THRESHOLD = 0.7
BINS = 6
#: Steps of the fit: first on lines that bear their document's label, then on labels of their own.
ROUNDS, FIRST, EVERY = 160, 40, 8
#: A good document has at least this share of its bytes in good lines, a bad one at most the rest.
SHARE = 0.7
_CHUNK = 1 << 21

_CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "digit": b"0123456789",
    "stop": b".,;:?'\"-()",
    "mark": b"!*#$%&@^~+=_`\\/",
    "frame": b"|<>{}[]",
    "blank": b" \t\x0b\x0c\r",
}
_CODE = np.full(256, len(_CLASSES), np.uint8)
for _k, _v in enumerate(_CLASSES.values()):
    _CODE[[*_v]] = _k
_CODE[128:] = len(_CLASSES) + 1
N_RAW = len(_CLASSES) + 8


def parts(offsets: np.ndarray, limit: int = _CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of rows with at most `limit` bytes, or one row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, j
        i = j


def lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each line, and its row; a row has a line more than it has line feeds."""
    n = len(offsets) - 1
    feed = np.flatnonzero(data == 10)
    row = np.searchsorted(offsets, feed, "right") - 1
    starts = np.r_[offsets[:-1], feed + 1]
    of = np.r_[np.arange(n), row]
    order = np.lexsort((starts, of))
    starts, of = starts[order], of[order]
    ends = np.empty(len(starts), np.int64)
    last = np.r_[of[1:] != of[:-1], True] if len(of) else np.zeros(0, bool)
    ends[last] = offsets[of[last] + 1]
    ends[~last] = starts[1:][~last[:-1]] - 1
    return starts, ends, of


def line_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(numbers that describe each line, its length, its row): shares of byte classes, words and repetition."""
    starts, ends, of = lines(data, offsets)
    n, size = len(starts), np.maximum(ends - starts, 1)
    x = np.zeros((n, N_RAW), np.float32)
    code = _CODE[data]
    for k in range(len(_CLASSES)):
        total = np.r_[0, np.cumsum(code == k, dtype=np.int64)]
        x[:, k] = (total[ends] - total[starts]) / size
    total = np.r_[0, np.cumsum(code == len(_CLASSES) + 1, dtype=np.int64)]
    x[:, 6] = (total[ends] - total[starts]) / size
    x[:, 7] = np.log1p(ends - starts)
    ws, we, _ = words(data, offsets)
    line = np.searchsorted(starts, ws, "right") - 1
    h = span_hashes(data, ws, we)
    count = np.bincount(line, minlength=n)
    x[:, 8] = np.log1p(count)
    x[:, 9] = np.bincount(line, we - ws, minlength=n) / np.maximum(count, 1)
    again = np.zeros(len(ws), bool)
    again[1:] = (h[1:] == h[:-1]) & (line[1:] == line[:-1])
    x[:, 10] = np.bincount(line, again, minlength=n) / np.maximum(count, 1)
    if len(ws):
        order = np.lexsort((h, line))
        a, b = h[order], line[order]
        first = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]
        x[:, 11] = np.bincount(b[first], minlength=n) / np.maximum(count, 1)
    # Whether the same line came before in the document, and whether it closes like a sentence.
    lh = span_hashes(data, starts, ends)
    order = np.lexsort((np.arange(n), lh, of))
    same = np.zeros(n, bool)
    same[order[1:]] = (lh[order[1:]] == lh[order[:-1]]) & (of[order[1:]] == of[order[:-1]])
    x[:, 12] = same & (ends > starts)
    if len(data):
        x[:, 13] = (ends > starts) & (data[np.maximum(ends - 1, 0)] == 46)
    return x, size, of


def _span(of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First line and number of lines of each row; rows are numbered from 0 and all have lines."""
    n = of[-1] + 1 if len(of) else 0
    at = np.searchsorted(of, np.arange(n + 1))
    return at[:-1], np.diff(at)


def _add(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.logaddexp(a, b)


def marginals(score: np.ndarray, of: np.ndarray, move: np.ndarray, pairs: bool = False) -> tuple[np.ndarray, np.ndarray | None, float]:
    """P(line is good) by forward and backward passes over all rows at once; expected moves; log of the partition.

    `score` is the evidence for good against bad, move[a, b] that of label b after a. All rows advance a line at a
    time; those that have ended drop out, so the passes take as many steps as the longest row has lines.
    """
    first, length = _span(of)
    order = np.argsort(-length, kind="stable")
    first, length = first[order], length[order]
    n = len(score)
    alpha, beta = np.zeros((n, 2)), np.zeros((n, 2))
    alpha[:, 1] = score
    most = int(length[0]) if len(length) else 0
    alive = len(length) - np.searchsorted(length[::-1], np.arange(1, most + 1), "left")
    for t in range(1, most):
        i = first[: alive[t]] + t
        a = alpha[i - 1]
        for b in (0, 1):
            alpha[i, b] += _add(a[:, 0] + move[0, b], a[:, 1] + move[1, b])
    for t in range(most - 2, -1, -1):
        i = first[: alive[t + 1]] + t
        nxt = beta[i + 1].copy()
        nxt[:, 1] += score[i + 1]
        for a in (0, 1):
            beta[i, a] = _add(nxt[:, 0] + move[a, 0], nxt[:, 1] + move[a, 1])
    both = alpha + beta
    z = _add(both[:, 0], both[:, 1])
    good = np.exp(both[:, 1] - z)
    if not pairs:
        return good, None, 0.0
    after = np.flatnonzero(np.r_[False, of[1:] == of[:-1]])
    expected = np.zeros((2, 2))
    for a in (0, 1):
        for b in (0, 1):
            expected[a, b] = np.exp(alpha[after - 1, a] + move[a, b] + (score[after] if b else 0) + beta[after, b] - z[after]).sum()
    return good, expected, float(z[first].sum())


def _neighbours(x: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Features of the line before, the line and the line after; zeros beyond a row's ends."""
    before, after = np.zeros_like(x), np.zeros_like(x)
    if len(x) > 1:
        same = (of[1:] == of[:-1])[:, None]
        before[1:] = x[:-1] * same
        after[:-1] = x[1:] * same
    return np.hstack([before, x, after])


@dataclass(frozen=True)
class Model:
    edges: np.ndarray  # of bins, a row for each number
    weights: np.ndarray
    bias: float
    move: np.ndarray
    slope: float
    shift: float

    def evidence(self, raw: np.ndarray, of: np.ndarray) -> np.ndarray:
        """Line scores: the sum of the weights of the bins of the line and its neighbours."""
        w = self.weights.reshape(3, N_RAW, BINS)
        own = np.zeros((3, len(raw)))
        for k in range(N_RAW):
            at = np.searchsorted(self.edges[k], raw[:, k], "right")
            own += w[:, k][:, at]
        out = own[1] + self.bias
        if len(raw) > 1:
            same = of[1:] == of[:-1]
            out[1:] += own[0][:-1] * same
            out[:-1] += own[2][1:] * same
        return out

    def quality(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        out = np.empty(len(offsets) - 1)
        for i, j in parts(offsets):
            at = offsets[i : j + 1]
            raw, size, of = line_features(data[at[0] : at[-1]], at - at[0])
            good, _, _ = marginals(self.evidence(raw, of), of, self.move)
            out[i:j] = np.bincount(of, good * size) / np.bincount(of, size)
        return self.calibrated(out)

    def calibrated(self, mean: np.ndarray) -> np.ndarray:
        p = np.clip(mean, 1e-6, 1 - 1e-6)
        return 1 / (1 + np.exp(-np.clip(self.slope * np.log(p / (1 - p)) + self.shift, -40, 40)))


def binned(raw: np.ndarray, edges: np.ndarray) -> np.ndarray:
    out = np.zeros((len(raw), N_RAW * BINS), np.float32)
    for k in range(N_RAW):
        out[np.arange(len(raw)), k * BINS + np.searchsorted(edges[k], raw[:, k], "right")] = 1
    return out


def bagged(score: np.ndarray, of: np.ndarray, move: np.ndarray, size: np.ndarray, good: np.ndarray, share: float = SHARE) -> tuple[np.ndarray, np.ndarray]:
    """Line marginals and expected moves of the labellings nearest to the model's that agree with the documents' labels.

    The length-weighted mean of a good document's marginals is at least `share`, that of a bad one at most 1 - `share`.
    Of all distributions that keep this, the one nearest in relative entropy adds to each line's evidence a multiple of
    its length, one number for each document; it is 0 where the model keeps it already, else found by bisection.
    """
    first, _ = _span(of)
    total = np.add.reduceat(size, first)
    weight = size / np.maximum.reduceat(size, first)[of]
    sign = np.where(good > 0, 1.0, -1.0)
    mean = lambda q: np.add.reduceat(q * size, first) / total
    kept = lambda m: sign * (m - 0.5) >= share - 0.5
    lo, hi = np.zeros(len(first)), np.full(len(first), 60.0)
    hi[kept(mean(marginals(score, of, move)[0]))] = 0.0
    for _ in range(12):
        mid = (lo + hi) / 2
        ok = kept(mean(marginals(score + (sign * mid)[of] * weight, of, move)[0]))
        lo, hi = np.where(ok, lo, mid), np.where(ok, mid, hi)
    q, moves, _ = marginals(score + (sign * hi)[of] * weight, of, move, pairs=True)
    assert moves is not None
    return q, moves


def fit_chain(raw: np.ndarray, size: np.ndarray, of: np.ndarray, good: np.ndarray, prior: float, ridge: float = 2e-3) -> Model:
    """Fit on documents of known label whose lines have labels of their own, not known; rows of `of` are numbered from 0.

    For the FIRST steps all lines bear the document's label. From then on the labels of lines are those that the model
    itself thinks likeliest among all that the document's label allows (see bagged), found anew EVERY steps; so a good
    document may hold bad lines and moves between the two are learned. Likelihood by full-batch Adam, no randomness.
    The mean of the marginals, weighted by length, is then calibrated by a logistic curve in which the two classes weigh
    as in the labels (`prior`: the share of good ones).
    """
    edges = np.stack([np.quantile(raw[:, k], np.arange(1, BINS) / BINS) for k in range(N_RAW)])
    edges[12:14] = np.linspace(0.5, 0.9, BINS - 1)
    x = _neighbours(binned(raw, edges), of)
    y = good[of].astype(np.float64)
    same = of[1:] == of[:-1]
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[:-1][same].astype(int), y[1:][same].astype(int)), 1)
    n, d = len(x), x.shape[1]
    p = np.zeros(d + 5)
    m, v = np.zeros_like(p), np.zeros_like(p)
    for t in range(1, ROUNDS + 1):
        score = (x @ p[:d].astype(np.float32) + p[d]).astype(np.float64)
        move = p[d + 1 :].reshape(2, 2)
        if t > FIRST and (t - FIRST) % EVERY == 1:
            y, seen = bagged(score, of, move, size, good)
        q, expected, _ = marginals(score, of, move, pairs=True)
        g = np.r_[x.T @ (q - y).astype(np.float32), (q - y).sum(), (expected - seen).ravel()] / n + ridge * p
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        p -= 0.08 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
    model = Model(edges, p[:d], float(p[d]), p[d + 1 :].reshape(2, 2), 1.0, 0.0)
    q, _, _ = marginals(model.evidence(raw, of), of, model.move)
    mean = np.clip(np.bincount(of, q * size) / np.bincount(of, size), 1e-6, 1 - 1e-6)
    z, share = np.log(mean / (1 - mean)), good.mean()
    w = np.where(good == 1, prior / share, (1 - prior) / (1 - share))
    a, b = 1.0, 0.0
    for _ in range(50):  # Newton with a weak pull to slope 1
        r = 1 / (1 + np.exp(-np.clip(a * z + b, -40, 40)))
        h = w * np.maximum(r * (1 - r), 1e-9)
        grad = np.array([(w * (r - good) * z).sum() + 0.1 * (a - 1), (w * (r - good)).sum() + 0.01 * b])
        hess = np.array([[(h * z * z).sum() + 0.1, (h * z).sum()], [(h * z).sum(), h.sum() + 0.01]])
        step = np.linalg.solve(hess, grad)
        step /= max(1.0, np.abs(step).max())
        a, b = a - step[0], b - step[1]
    return Model(edges, model.weights, model.bias, model.move, max(a, 1e-3), b)


def fold(doc_id: Column) -> Column:
    """The remainder by which rows are held out: CRC-32 of the id as text, modulo 4 (null ids: null)."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, held: int = 2) -> Model:
    """Fit on at most `sample` labelled documents outside the fold `held`, half of them bad as far as there are so many.

    Only numbers of their lines come to the driver. With labels of one kind only, every document gets that kind's score.
    """
    labels = columns(labels, ["doc_id", "quality"]).where("doc_id is not null and quality is not null").where(fold(F.col("doc_id")) != held)
    labels = labels.groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
    prior = labels.agg(F.avg((F.col("quality") > 0).cast("double"))).first()[0]
    order = F.xxhash64(F.lit(29), "doc_id")
    half = sample // 2
    chosen = labels.where("quality > 0").orderBy(order, "doc_id").limit(half).unionAll(labels.where("quality <= 0").orderBy(order, "doc_id").limit(half))
    rows = columns(docs, ["doc_id", "text"]).join(F.broadcast(chosen), "doc_id")  # at most `sample` rows of two numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, "text"):
            data, offsets = utf8(batch.column("text"))
            x, size, of = line_features(data, offsets)
            at = np.searchsorted(of, np.arange(batch.num_rows + 1))
            raw = pa.ListArray.from_arrays(pa.array((at * (N_RAW + 1)).astype(np.int32)), pa.array(np.c_[x, size].astype(np.float32).ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("quality"), raw], ["doc_id", "quality", "raw"])

    id_type = rows.schema["doc_id"].dataType.simpleString()
    got = stage(rows.mapInArrow(run, f"doc_id {id_type}, quality int, raw array<float>"), "quality-sample").orderBy("doc_id", "quality").toArrow()
    good = np.asarray(got["quality"]).astype(int) > 0
    if not len(good) or good.all() or not good.any():
        flat = 6.0 if not len(good) or good.all() else -6.0
        return Model(np.tile(np.arange(BINS - 1.0), (N_RAW, 1)), np.zeros(3 * N_RAW * BINS), 0.0, np.zeros((2, 2)), 1e-3, flat)
    raw = got["raw"].combine_chunks()
    count = np.diff(np.asarray(raw.offsets)) // (N_RAW + 1)
    numbers = np.asarray(raw.flatten()).reshape(-1, N_RAW + 1)
    return fit_chain(numbers[:, :-1], numbers[:, -1].astype(np.float64), np.repeat(np.arange(len(good)), count), good.astype(np.float64), float(prior))


def score(docs: DataFrame, model: Model, held: int = 2) -> DataFrame:
    """doc_id, held_out, score (0 to 1, higher: good likelier) and predicted (1 from THRESHOLD on) of every document.

    One pass without a shuffle; the score looks at the text only. A null or empty text is one empty line; repeated rows
    score alike; a null id is in no fold; an empty table gives an empty result; other columns are not read.
    """
    kept = columns(docs, ["doc_id", "text"])
    id_type = kept.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, "text", 1 << 23):
            q = model.quality(*utf8(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(q)], ["doc_id", "score"])

    found = kept.mapInArrow(run, f"doc_id {id_type}, score double")
    return found.select("doc_id", F.coalesce(fold(F.col("doc_id")) == held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
