"""Substring dedup over sliding runs of sentences."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import columns, lower_ascii, mix64, place_of, placed, portions, powers, row_hash, span_hashes, stage, utf8, words

#: A run is the fewest sentences from a given one on that are at least so many and have at least so many words. Where
#: both ends are asked for, so is a run the fewest up to a given sentence, and one sentence of at least so many words.
SENTENCES, WORDS = 2, 20
_CHUNK = 1 << 20
_U = np.uint64
_STOP = np.zeros(256, bool)
_STOP[[*b".!?;:,"]] = True
_CLOSE = np.zeros(256, bool)
_CLOSE[[*b"\"')]}"]] = True


def sentences(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each word, and the number of the first word of each sentence.

    A sentence ends after a word that ends in . ! ? ; : , (and closing quotes or brackets) or in their full-width
    forms, and at a line break. Clauses of a long sentence thus count as sentences, so that a passage set into another
    sentence still starts with whole ones soon.
    """
    starts, ends, row = words(data, offsets)
    if not len(starts):
        return starts, ends, row, np.zeros(0, np.int64)
    tail = ends - 1
    for _ in range(2):
        tail = tail - ((tail > starts) & _CLOSE[data[tail]])
    stop = _STOP[data[tail]]
    wide = np.flatnonzero((ends - starts >= 3) & (data[tail] >= 128))
    for i in wide:
        stop[i] |= data[max(starts[i], tail[i] - 2) : tail[i] + 1].tobytes() in (b"\xe3\x80\x82", b"\xef\xbc\x81", b"\xef\xbc\x9f", b"\xef\xbc\x8c")
    feeds = np.r_[0, np.cumsum(data == 10)]
    broken = np.r_[feeds[starts[1:]] > feeds[ends[:-1]], True] | np.r_[row[1:] != row[:-1], True]
    last = np.flatnonzero(stop | broken)
    return starts, ends, row, np.r_[0, last[:-1] + 1]


def runs(data: np.ndarray, offsets: np.ndarray, least: int = SENTENCES, size: int = WORDS, both_ends: bool = False):
    """Row, number of its first sentence in the row, sentences and hash of each run, then what `sentences` returns.

    The shortest runs from each sentence on leave the end of a repeated passage uncovered where what is behind the last
    of them has under `size` words. With `both_ends` the shortest runs up to each sentence and single sentences of
    `size` words are runs too; then any whole sentences that repeat together and have `size` words are covered.
    """
    starts, ends, row, first = sentences(data, offsets)
    none = np.zeros(0, np.int64)
    if not len(first):
        return none, none, none, none, starts, row, first
    of = row[first]
    begin = np.searchsorted(of, of)  # the number of the row's first sentence
    upto = np.r_[first[1:], len(starts)]
    n = len(first)
    last = np.maximum(np.arange(n) + least - 1, np.searchsorted(upto, first + size, "left"))
    ok = last < n
    ok[ok] = of[last[ok]] == of[ok]
    i, j = np.flatnonzero(ok), last[ok]
    if both_ends:
        head = np.minimum(np.arange(n) - least + 1, np.searchsorted(first, upto - size, "right") - 1)
        back = head >= 0
        back[back] = of[head[back]] == of[back]
        alone = np.flatnonzero(upto - first >= size)
        key = np.unique(np.r_[i * n + j, head[back] * n + np.flatnonzero(back), alone * (n + 1)])
        i, j = key // n, key % n
    h = span_hashes(lower_ascii(data), starts, ends)
    up, down = powers(len(h) + 1)
    total = np.r_[_U(0), np.cumsum(h * up[:-1])]
    a, b = first[i], upto[j]
    mixed = mix64((total[b] - total[a]) * down[a] ^ ((b - a).astype(_U) * _U(0xA24BAED4963EE407)))
    return of[i], i - begin[i], j - i + 1, mixed.view(np.int64), starts, row, first


def _parts(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + _CHUNK, "right")) - 1)
        yield i, j
        i = j


def _explode(batches: Iterator[pa.RecordBatch], both_ends: bool = False) -> Iterator[pa.RecordBatch]:
    for batch in portions(batches, "text", 1 << 23):
        data, offsets = utf8(batch.column("text"))
        for i, j in _parts(offsets):
            at = offsets[i : j + 1]
            row, pos, _, h, *_ = runs(data[at[0] : at[-1]], at - at[0], both_ends=both_ends)
            if len(row):
                take = pa.array(row + i)
                yield pa.RecordBatch.from_arrays([pa.array(h), batch.column("d").take(take), batch.column("k").take(take), pa.array(pos.astype(np.int32))], ["h", "d", "k", "pos"])


def repeated(docs: DataFrame, both_ends: bool = False) -> DataFrame:
    """d (doc_id), k (hash of id and text), pos, h: every run whose words also appear as a run before it.

    Before: by doc_id (null first), then k, then place. The first place of each hash is a min by key, combined before
    the shuffle. Only hashes that occur again are kept, in a written table: adaptive execution splits a join's large
    partition, where a passage is in very many documents, only if both sides come straight from a shuffle. Texts are
    not shuffled.
    """
    kept = columns(docs, ["doc_id", "text"]).select(F.col("doc_id").alias("d"), row_hash(0, "doc_id", "text").alias("k"), "text")
    id_type = kept.schema["d"].dataType.simpleString()
    every = kept.mapInArrow(lambda batches: _explode(batches, both_ends), f"h bigint, d {id_type}, k bigint, pos int")
    first = every.groupBy("h").agg(F.min(F.struct("d", "k", "pos")).alias("first"), F.count("*").alias("n")).where("n > 1")
    first = stage(first.select("h", F.col("first.k").alias("k0"), F.col("first.d").alias("d0"), F.col("first.pos").alias("p0")), "substrings")
    found = every.hint("merge").join(first.hint("merge"), "h")
    return found.where(~(F.col("d").eqNullSafe(F.col("d0")) & (F.col("k") == F.col("k0")) & (F.col("pos") == F.col("p0")))).select("d", "k", "pos", "h")


def deduplicated(docs: DataFrame, both_ends: bool = False) -> DataFrame:
    """All columns of `docs`, with text cut, and n_sentences, n_removed, n_spans (maximal removed stretches).

    Every sentence that a repeated run covers, other than the run's first place in the table, is removed with the white
    space after it; op1_substrings and the pipeline ask for runs from `both_ends` (see runs). Each document's repeated
    runs, at most one a sentence (three with `both_ends`), are gathered by the hash of its id and text and meet the
    texts in one join, a merge at any size; they are looked up by place and hash in the text, so no document can be cut
    for another. Rows that repeat both doc_id and text are one place and are cut alike; rows that share only the id, or
    have none, are documents of their own. Null and empty texts stay as they are; a text all of whose sentences are
    removed becomes empty (or the white space it begins with); runs never cross documents; an empty table gives an
    empty result. Columns are known by their place, so any names come back as they were, but where `docs` has columns
    of the added names, these replace them; of several columns named doc_id or text the first counts.
    """
    added = ["n_sentences", "n_removed", "n_spans"]
    place, names = placed(docs)
    who, what = place_of(names, "doc_id"), place_of(names, "text")
    stay = [f"c{i}" for i, c in enumerate(names) if c not in added]
    cuts = repeated(docs, both_ends).groupBy("k").agg(F.collect_list("pos").alias("__pos"), F.collect_list("h").alias("__h")).withColumnRenamed("k", "__k")
    joined = place.select(*stay).withColumn("__key", row_hash(0, who, what)).hint("merge").join(cuts, F.col("__key") == F.col("__k"), "left").drop("__k", "__key")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in place.select(*stay).schema.fields) + ", n_sentences bigint, n_removed bigint, n_spans bigint"
    where = stay.index(what)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, what, 1 << 23):
            data, offsets = utf8(batch.column(what))
            texts: list = [None] * batch.num_rows
            counts = np.zeros((3, batch.num_rows), np.int64)
            asked = batch.column("__pos").is_valid().to_numpy(zero_copy_only=False)
            for i, j in _parts(offsets):
                at = offsets[i : j + 1] - offsets[i]
                part = data[offsets[i] : offsets[j]]
                row, pos, count, h, starts, word_row, first = runs(part, at, both_ends=both_ends)
                of = word_row[first] if len(first) else np.zeros(0, np.int64)
                s0 = np.searchsorted(of, np.arange(j - i + 1))
                r0 = np.searchsorted(row, np.arange(j - i + 1))
                counts[0, i:j] = np.diff(s0)
                for k in np.flatnonzero(asked[i:j]):
                    want = set(zip(batch.column("__pos")[i + k].as_py(), batch.column("__h")[i + k].as_py(), strict=True))
                    n = s0[k + 1] - s0[k]
                    if not n:
                        continue  # another text with the same hash
                    cover = np.zeros(n + 1, np.int64)
                    for p, c, x in zip(pos[r0[k] : r0[k + 1]].tolist(), count[r0[k] : r0[k + 1]].tolist(), h[r0[k] : r0[k + 1]].tolist(), strict=True):
                        if (p, x) in want:
                            cover[p] += 1
                            cover[p + c] -= 1
                    gone = np.cumsum(cover[:-1]) > 0
                    counts[1, i + k], counts[2, i + k] = gone.sum(), (gone & ~np.r_[False, gone[:-1]]).sum()
                    begin = starts[first[s0[k] : s0[k + 1]]]
                    stops = np.r_[begin[1:], at[k + 1]]
                    texts[i + k] = part[at[k] : begin[0]].tobytes() + b"".join(part[a:b].tobytes() for a, b in zip(begin[~gone].tolist(), stops[~gone].tolist(), strict=True))
            text = batch.column(what)
            cut_ = np.array([t is not None for t in texts], bool)
            if cut_.any():
                new = pa.array([t.decode("utf-8") if t is not None else None for t in texts], text.type)
                text = pa.compute.if_else(pa.array(cut_), new, text)
            cols = [batch.column(c) for c in stay]
            cols[where] = text
            yield pa.RecordBatch.from_arrays([*cols, *map(pa.array, counts)], [*stay, *added])

    return joined.mapInArrow(run, schema).toDF(*[c for c in names if c not in added], *added)


def cut(docs: DataFrame) -> DataFrame:
    """The columns of `docs`: texts without repeats and n_chars to match; documents that lost all their text go.

    Any column names come back as they were, in their order; nulls, repeated rows, empty texts and tables are handled
    as in `deduplicated`. Of several columns named doc_id, text or n_chars the first counts.
    """
    place, names = placed(docs)
    found, _ = placed(deduplicated(place.withColumnsRenamed({place_of(names, c): c for c in ("doc_id", "text")}), both_ends=True))
    total, removed = (f"c{len(names) + k}" for k in (0, 1))
    found = found.where(f"not ({removed} > 0 and {removed} = {total})")
    if "n_chars" in names:
        size, text = place_of(names, "n_chars"), place_of(names, "text")
        new = F.when(F.col(removed) > 0, F.length(text).cast(docs.schema.fields[names.index("n_chars")].dataType)).otherwise(F.col(size))
        found = found.withColumn(size, new)
    return found.select(*place.columns).toDF(*names)
