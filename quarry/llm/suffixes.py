"""Removal of long repeated byte strings with a logarithmic family of suffix arrays."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import columns, mix64, portions, powers, release, stage, utf8

#: Bytes of a string that counts as repeated, and of the grams that anchor its windows.
LENGTH, GRAM = 200, 64
#: Windows of a batch of the index, about, and windows from which a family ends with the anchor.
BATCH, HELD = 1 << 16, 1 << 20
#: Suffixes of one array that are written out at a time while two are scanned.
_PART = 1 << 13
#: Contexts of one anchor beyond which its windows are dealt out one by one.
HOT = 100_000
_STEP = 1 << 17
_U = np.uint64
_BYTE = mix64(np.arange(7001, 7257, dtype=_U))
_LOW = _U((1 << 20) - 1)


class Rolling:
    """Hashes of any spans of a buffer in constant time each."""

    def __init__(self, data: np.ndarray):
        up, self.down = powers(len(data) + 1)
        self.total = np.zeros(len(data) + 1, _U)
        np.cumsum(_BYTE[data] * up[:-1], out=self.total[1:])

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mix64((self.total[b] - self.total[a]) * self.down[a] + (b - a).astype(_U) * _U(0x8CB92BA72F3D8DD7))


def _least(x: np.ndarray, w: int) -> np.ndarray:
    """The minimum of each w neighbours, from running minima of blocks of w in both directions."""
    n = len(x) - w + 1
    size = -(-len(x) // w) * w
    y = np.full(size, _U(0xFFFFFFFFFFFFFFFF))
    y[: len(x)] = x
    y = y.reshape(-1, w)
    up = np.minimum.accumulate(y, axis=1).ravel()
    down = np.minimum.accumulate(y[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(down[:n], up[w - 1 : w - 1 + n])


def anchors(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """Runs of windows that share an anchor: row, first window (in the row), windows, anchor's hash, context's hash.

    Each window of `length` bytes is anchored at the gram in it of least hash, the leftmost of equals, so equal windows
    anywhere have equal anchors at equal places. Neighbouring windows mostly share one; their run's context is all bytes
    of its windows. One pass over the buffer, a stretch at a time; windows never cross rows.
    """
    out: list[list[np.ndarray]] = [[], [], [], [], []]
    total = len(data) - length + 1
    for lo in range(0, max(0, total), _STEP):
        n = min(_STEP, total - lo)
        part = data[lo : lo + n + length - 1]
        roll = Rolling(part)
        at = np.arange(len(part) - gram + 1)
        g = roll.of(at, at + gram)
        best = _least((g & ~_LOW) | at.astype(_U), length - gram + 1)
        place = (best & _LOW).astype(np.int64)
        row = np.searchsorted(offsets, np.arange(lo, lo + n), "right") - 1
        ok = np.arange(lo, lo + n) + length <= offsets[row + 1]
        key = np.where(ok, place, -1)
        cut = np.flatnonzero((key[1:] != key[:-1]) | (row[1:] != row[:-1])) + 1
        a, b = np.r_[0, cut], np.r_[cut, n]
        keep = key[a] >= 0
        a, b = a[keep], b[keep]
        if len(a):
            place = place[a]
            for k, x in enumerate((row[a], lo + a - offsets[row[a]], b - a, g[place], mix64(roll.of(a, b + length - 1) ^ (place - a).astype(_U)))):
                out[k].append(x)
    return [np.concatenate(x) if x else np.zeros(0, np.int64) for x in out]


def _anchored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in portions(batches, "text"):
        row, first, count, g, c = anchors(*utf8(batch.column("text")))
        r = batch.column("r").take(pa.array(row))
        yield pa.RecordBatch.from_arrays([pa.array(g.view(np.int64)), pa.array(c.view(np.int64)), r, pa.array(first, pa.int32()), pa.array(count.astype(np.int32))], ["a", "c", "r", "first", "count"])


class Level:
    """A suffix array: places of a text in the order of the `length` bytes that begin there, and the window at each."""

    def __init__(self, text: np.ndarray, at: np.ndarray, window: np.ndarray, length: int):
        self.text, self.at, self.window, self.length = text, at, window, length

    def __len__(self) -> int:
        return len(self.at)

    def strings(self, i: int, j: int) -> np.ndarray:
        """The suffixes of a part of the array, as byte strings of `length` each (compared like these, zeros too)."""
        return np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(self.text, self.length)[self.at[i:j]]).view(f"S{self.length}").ravel()

    def places(self, other: Level) -> tuple[np.ndarray, np.ndarray]:
        """A scan of both arrays side by side: how many of these suffixes are less than each of the others, and whether
        one equals it. Both are in order, so a part of one meets only the parts of the other that overlap it."""
        out, equal = np.full(len(other), len(self)), np.zeros(len(other), bool)
        x = 0
        for i in range(0, len(other), _PART):
            theirs = other.strings(i, i + _PART)
            k = 0  # those before it are placed
            while x < len(self):
                mine = self.strings(x, x + _PART)
                if not mine[-1] < theirs[k]:
                    at = np.searchsorted(mine, theirs[k:])
                    done = int(np.searchsorted(at, len(mine)))
                    own = slice(i + k, i + k + done)
                    out[own], equal[own] = x + at[:done], mine[at[:done]] == theirs[k : k + done]
                    k += done
                    if k == len(theirs):
                        break
                x += _PART
        return out, equal


class Family:
    """Suffix arrays of geometrically growing sizes over the contexts seen so far; finds windows seen more than once.

    The suffixes are those at the windows of the contexts, in the order of their first `length` bytes: a new batch gets
    an array of its own, whose neighbours with a common prefix of `length` bytes are repeats. It is then scanned side by
    side with each level for equals, and levels of about equal size are merged by the same scan. Nothing is hashed.
    """

    def __init__(self, length: int = LENGTH, batch: int = BATCH):
        self.length, self.batch = length, batch
        self.levels: list[Level] = []
        self.repeated: list[np.ndarray] = []
        self.ends: list[int] = []
        self.windows = 0

    def add(self, text: np.ndarray, starts: np.ndarray) -> None:
        """A batch: its suffix array is built, scanned against itself and every level, and merged with equals."""
        if not len(starts):
            return
        own = Level(text, starts, np.arange(len(starts)) + self.windows, self.length)
        strings = own.strings(0, len(own))
        order = np.argsort(strings, kind="stable")
        strings = strings[order]
        own.at, own.window = starts[order], own.window[order]
        self.repeated.append(np.zeros(len(starts), bool))
        self.windows += len(starts)
        self.ends.append(self.windows)
        same = np.flatnonzero(strings[1:] == strings[:-1])
        del strings
        self._mark(own.window[same])
        self._mark(own.window[same + 1])
        for level in self.levels:
            at, hit = level.places(own)
            self._mark(own.window[hit])
            self._mark(level.window[at[hit]])
        self.levels.append(own)
        while len(self.levels) > 1 and len(self.levels[-1]) * 2 > len(self.levels[-2]):
            b, a = self.levels.pop(), self.levels.pop()
            at, _ = a.places(b)
            at += np.arange(len(b))  # where the second array's suffixes come in the merged one
            first = np.ones(len(a) + len(b), bool)
            first[at] = False
            merged = Level(np.concatenate([a.text, b.text]), np.empty(len(first), np.int64), np.empty(len(first), np.int64), self.length)
            merged.at[first], merged.at[at] = a.at, b.at + len(a.text)
            merged.window[first], merged.window[at] = a.window, b.window
            self.levels.append(merged)

    def _mark(self, window: np.ndarray) -> None:
        which = np.searchsorted(self.ends, window, "right")
        for k in np.unique(which):
            self.repeated[k][window[which == k] - (self.ends[k] - len(self.repeated[k]))] = True


def _matched(batches: Iterator[pa.RecordBatch], held: int = HELD, batch_size: int = BATCH) -> Iterator[pa.RecordBatch]:
    """Runs of repeated windows of each context of a partition, which holds all contexts of its anchors, sorted by them.

    Equal windows have equal anchors, so a family may end between any two anchors: it does once it has `held` windows.
    What a task holds is bounded by that and by the contexts of one anchor.
    """
    family = Family(batch=batch_size)
    known: list[tuple[pa.RecordBatch, np.ndarray]] = []
    parts, starts, size, windows = [], [], 0, 0
    last: int | None = None

    def flush() -> None:
        nonlocal parts, starts, size, windows
        if parts:
            family.add(np.concatenate(parts), np.concatenate(starts))
        parts, starts, size, windows = [], [], 0, 0

    def ended() -> Iterator[pa.RecordBatch]:
        nonlocal family, known
        flush()
        count = np.concatenate([c for _, c in known])
        flag = np.concatenate(family.repeated) | np.repeat(np.concatenate([np.asarray(b.column("n")) > 1 for b, _ in known]), count)
        of = np.repeat(np.arange(len(count)), count)
        pos = np.arange(len(flag)) - np.repeat(np.cumsum(count) - count, count)
        begin = np.flatnonzero(np.r_[True, (flag[1:] != flag[:-1]) | (of[1:] != of[:-1])])
        end = np.r_[begin[1:], len(flag)]
        begin, end = begin[flag[begin]], end[flag[begin]]
        a, c = (pa.concat_arrays([b.column(k) for b, _ in known]) for k in ("a", "c"))
        for i in range(0, len(begin), 100_000):
            s = slice(i, i + 100_000)
            take = pa.array(of[begin[s]])
            yield pa.RecordBatch.from_arrays([a.take(take), c.take(take), pa.array(pos[begin[s]], pa.int32()), pa.array((end - begin)[s], pa.int32())], ["a", "c", "skip", "windows"])
        family, known = Family(batch=batch_size), []
        release()

    for whole in batches:
        if not whole.num_rows:
            continue
        anchor = np.asarray(whole.column("a"))
        edge = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
        # Cut where an anchor begins, and into stretches of some rows.
        every = np.arange(0, whole.num_rows, 2048)
        cuts = np.unique(np.r_[every, edge[np.minimum(np.searchsorted(edge, every), len(edge) - 1)], whole.num_rows])
        for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if known and family.windows + windows >= held and anchor[i] != last:
                yield from ended()
            last = int(anchor[j - 1])
            rows = whole.slice(i, j - i)
            data, at = utf8(rows.column("context"))
            own = np.diff(at) - LENGTH + 1
            parts.append(data)
            starts.append(np.repeat(at[:-1], own) + np.arange(own.sum()) - np.repeat(np.cumsum(own) - own, own) + size)
            known.append((rows.select(["a", "c", "n"]), own))
            size += len(data)
            windows += int(own.sum())
            if windows >= batch_size:
                flush()
    if known:
        yield from ended()


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of all contexts that each text was asked for; a text comes once with the list of them."""
    for batch in portions(batches, "text", 1 << 23):
        data, offsets = utf8(batch.column("text"))
        asked = batch.column("asked")
        flat, many = asked.flatten(), np.asarray(pa.compute.list_value_length(asked))
        first, count = (np.asarray(flat.field(x)).astype(np.int64) for x in ("first", "count"))
        row = np.repeat(np.arange(batch.num_rows), many)
        begin = offsets[row] + first
        ends = begin + count + LENGTH - 1
        fits = ends <= offsets[row + 1]  # else another text has the same hash
        for i in range(0, len(row), 4_000):
            j = min(len(row), i + 4_000)
            keep = np.flatnonzero(fits[i:j]) + i
            size = ends[keep] - begin[keep]
            idx = np.repeat(begin[keep] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            blob = pa.Array.from_buffers(pa.binary(), len(keep), [None, pa.py_buffer(np.r_[0, np.cumsum(size)].astype(np.int32)), pa.py_buffer(data[idx])])
            yield pa.RecordBatch.from_arrays([flat.field(x).take(pa.array(keep)) for x in ("a", "c", "n")] + [blob], ["a", "c", "n", "context"])


def _refined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of windows of crowded anchors, anchored again at their anchor and GRAM bytes beside it.

    Windows that begin less than a certain way before the anchor hold that many bytes behind it, the others before it;
    so each run is cut in two at most, and equal windows have equal new anchors.
    """
    side = (LENGTH - GRAM) // 2
    for batch in portions(batches, "text"):
        data, offsets = utf8(batch.column("text"))
        out: list[tuple] = []
        for i, (r, asked) in enumerate(zip(batch.column("r").to_pylist(), batch.column("asked").to_pylist(), strict=True)):
            for x in asked:
                begin, count = int(offsets[i]) + x["first"], x["count"]
                if begin + count + LENGTH - 1 > offsets[i + 1]:
                    continue  # another text has the same hash
                own = data[begin : begin + count + LENGTH - 1]
                roll = Rolling(own)
                at = np.arange(len(own) - GRAM + 1)
                found = np.flatnonzero(roll.of(at, at + GRAM).view(np.int64) == x["a"])
                if not len(found):
                    continue
                place, old = int(found[0]), _U(x["a"] % 2**64)
                middle = min(max(0, place - side), count)
                for lo, hi, b, salt in ((0, middle, place - GRAM, 1), (middle, count, place + GRAM, 2)):
                    if lo < hi:
                        ends = np.array([[b, b + GRAM], [lo, hi + LENGTH - 1]])
                        beside, whole = roll.of(ends[:, 0], ends[:, 1])
                        out.append((mix64(np.array([beside ^ mix64(np.array([old]))[0] ^ _U(salt)]))[0], mix64(np.array([whole ^ _U(place - lo)]))[0], r, x["first"] + lo, hi - lo))
        for lo in range(0, len(out), 100_000):
            part = out[lo : lo + 100_000]
            cols = [np.array([p[k] for p in part], _U).view(np.int64) for k in (0, 1)] + [np.array([p[k] for p in part], t) for k, t in ((2, np.int64), (3, np.int32), (4, np.int32))]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["a", "c", "r", "first", "count"])


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every window of a crowded anchor by itself: 128 bits of hash of its bytes."""
    for batch in portions(batches, "text"):
        data, offsets = utf8(batch.column("text"))
        for i, (r, asked) in enumerate(zip(batch.column("r").to_pylist(), batch.column("asked").to_pylist(), strict=True)):
            for x in asked:
                begin = int(offsets[i]) + x["first"]
                if begin + x["count"] + LENGTH - 1 > offsets[i + 1]:
                    continue  # another text has the same hash
                digest = [hashlib.blake2b(data[k : k + LENGTH].tobytes(), digest_size=16).digest() for k in range(begin, begin + x["count"])]
                yield pa.RecordBatch.from_arrays([pa.array(digest, pa.binary()), pa.array([r] * len(digest), pa.int64()), pa.array(np.arange(x["first"], x["first"] + len(digest)), pa.int32())], ["h", "r", "first"])


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in portions(batches, "text"):
        data, offsets = utf8(batch.column("text"))
        removed, spans, digest = [], [], []
        lists = [batch.column(x).to_pylist() for x in ("firsts", "windows")]
        for i, (f, w) in enumerate(zip(*lists, strict=True)):
            own = data[offsets[i] : offsets[i + 1]]
            if f:
                cover = np.zeros(len(own) + 1, np.int32)
                f, w = np.array(f), np.array(w)
                np.add.at(cover, f, 1)
                np.add.at(cover, f + w + LENGTH - 1, -1)
                gone = np.cumsum(cover[:-1]) > 0
                removed.append(int(gone.sum()))
                spans.append(int((gone & ~np.r_[False, gone[:-1]]).sum()))
                own = own[~gone]
            else:
                removed.append(0)
                spans.append(0)
            digest.append(hashlib.sha256(own.tobytes()).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(offsets), pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digest, pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def repeated_windows(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """r (hash of doc_id and text), first, windows: runs of windows of LENGTH bytes that start elsewhere too.

    1. Each text gives its anchors and their contexts' hashes in one pass; anchors found once in the corpus go, as
       none of their windows can be elsewhere. What stays is proportional to what is repeated.
    2. Equal contexts are one row with a count. Their bytes are fetched from one document each, all that a document is
       asked for at once.
    3. Contexts are dealt and sorted by anchor, so equal windows meet in one partition, where a Family takes them in
       batches (see _matched).
    4. An anchor with more than `hot` different contexts (a common string shorter than LENGTH in many surroundings) is
       split by the bytes beside it (see _refined). What is crowded still is not gathered: its windows are dealt out and
       counted one by one, by their hashes of 128 bits.
    """
    texts = columns(docs, ["doc_id", "text"]).where("text is not null").select(F.xxhash64("doc_id", "text").alias("r"), "text")
    found = texts.where(F.octet_length("text") >= LENGTH).mapInArrow(_anchored, "a bigint, c bigint, r bigint, first int, count int")
    # Written, so that both sides of the join come straight from a shuffle and a frequent anchor can be split.
    shared = stage(found.groupBy("a").agg(F.count("*").alias("n")).where("n > 1").select("a"), "shared")
    places = stage(found.hint("merge").join(shared.hint("merge"), "a", "left_semi"), "anchors")
    grouped = lambda p: p.groupBy("a", "c").agg(F.min(F.struct("r", "first", "count")).alias("at"), F.count("*").alias("n")).select("a", "c", "n", F.col("at.r").alias("r"), F.col("at.first").alias("first"), F.col("at.count").alias("count"))
    over = lambda c: stage(c.groupBy("a").agg(F.count("*").alias("k")).where(F.col("k") > hot).select("a"), "hot")
    contexts = grouped(places)
    crowded = over(contexts)
    any_hot = crowded.limit(1).count() > 0
    if any_hot:
        # Rows of equal r are equal texts, each of which meets the places of all of them once.
        mine = places.join(crowded, "a", "left_semi").select("r", "a", "first", "count").distinct()
        mine = mine.groupBy("r").agg(F.collect_list(F.struct("a", "first", "count")).alias("asked"))
        again = stage(mine.join(texts.hint("merge"), "r").select("r", "asked", "text").mapInArrow(_refined, "a bigint, c bigint, r bigint, first int, count int"), "refined")
        shared = again.groupBy("a").agg(F.count("*").alias("n")).where("n > 1").select("a")
        places = places.join(crowded, "a", "left_anti").unionAll(again.join(shared, "a", "left_semi"))
        contexts = grouped(places)
        crowded = over(contexts)
        any_hot = crowded.limit(1).count() > 0
        if any_hot:
            contexts = contexts.join(crowded, "a", "left_anti")
    # Documents of equal r are equal: one stands for all.
    asked = contexts.groupBy("r").agg(F.collect_list(F.struct("a", "c", "n", "first", "count")).alias("asked"))
    bytes_ = asked.join(texts.hint("merge"), "r").select("asked", "text").mapInArrow(_contexts, "a bigint, c bigint, n bigint, context binary")
    runs = bytes_.repartition("a").sortWithinPartitions("a").mapInArrow(_matched, "a bigint, c bigint, skip int, windows int")
    out = places.hint("merge").join(runs, ["a", "c"]).select("r", (F.col("first") + F.col("skip")).alias("first"), "windows")
    if any_hot:
        mine = places.join(crowded, "a", "left_semi").select("r", "first", "count").distinct().groupBy("r").agg(F.collect_list(F.struct("first", "count")).alias("asked"))
        each = mine.join(texts.hint("merge"), "r").select("r", "asked", "text").mapInArrow(_windows, "h binary, r bigint, first int")
        many = each.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h")
        out = out.unionAll(each.join(many, "h", "left_semi").select("r", "first", F.lit(1).alias("windows")))
    return out


def without_repeats(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 (of the remaining bytes).

    Removes each byte covered by a string of LENGTH bytes that also starts anywhere else in the table, in the same text
    or another; all places go, the first too. Null and empty texts have no bytes; texts shorter than LENGTH lose none;
    repeated rows are separate documents and lose all they have from LENGTH bytes on; null ids are documents like others;
    an empty table gives an empty result; other columns are not read.
    """
    spans = repeated_windows(docs, hot).groupBy("r").agg(F.collect_list("first").alias("firsts"), F.collect_list("windows").alias("windows"))
    texts = columns(docs, ["doc_id", "text"]).withColumn("r", F.xxhash64("doc_id", "text"))
    joined = texts.hint("merge").join(spans, "r", "left").select("doc_id", "text", "firsts", "windows")
    id_type = joined.schema["doc_id"].dataType.simpleString()
    return joined.mapInArrow(_kept, f"doc_id {id_type}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")
