"""BPE encoding and decoding with a given byte-level vocabulary; texts are encoded as trees of halves.

A text is cut at the strings of added tokens. Each stretch between them is halved, at whatever character is in the
middle, down to leaves of at most LEAF characters, which are split by the vocabulary's pattern and merged each by
itself; halves of texts above SPREAD bytes are rows of their own, so they are encoded in parallel tasks. Neighbours
are then joined level by level. The split scans from left to right, decides each piece by at most two characters behind
its end and never looks back. So pieces of the left side that end three characters before its end stand, and a window
from there on is split again; as soon as a piece of the window ends where one of the right side ends too, and the cut
end of the window is too far to matter, both agree on all that follows. Otherwise the window grows fourfold.

A single piece of more than PIECE bytes is a tree in the same way, over bytes: windows of tokens around a join are merged
again and grow until the tokens on both sides agree, that is until the last token left of the window and the window's
first, and the window's last and the first one after it, encode to just themselves. A sequence all of whose neighbouring
pairs do that is the encoding of its bytes. The result equals that of splitting and merging the whole text.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import columns, portions

#: Bytes of a leaf of a piece, and characters of a leaf of a text.
PIECE, LEAF = 192, 2048
#: Bytes of a text from which its halves are rows of their own.
SPREAD = 1 << 16
#: Characters behind a piece that its end may depend on, and one more.
_AHEAD = 3
#: The pieces of a text and the packed ids of each.
Part = tuple[list[str], list[bytes]]
CACHED = 400_000
#: Fixed value: the split pattern of byte-level BPE vocabularies of this kind.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters of which every Unicode version in use has the same classes; other texts are split by the library itself.
_OTHER = regex.compile(r"[^\t\n\x0b\x0c\r\x20-\x7e\x85\xa0-ɏΑ-ΡΣ-ώА-я‐-‧一-龥]")


def byte_chars() -> dict[str, int]:
    """The character that stands for each byte in byte-level vocabularies: itself if printable, else from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(rest)}


class Codec:
    """Encoder and decoder for a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str, piece: int = PIECE, leaf: int = LEAF):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        chars = byte_chars()
        raw = lambda token: bytes(chars[c] for c in token)
        vocab = spec["model"]["vocab"]
        self.piece, self.leaf = max(2, piece), max(1, leaf)
        self.joins = self.grown = 0
        self.path = path
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", ())}
        self.token = [b""] * (1 + max([*vocab.values(), *self.added.values()]))
        for t, i in vocab.items():
            if t not in self.added:
                self.token[i] = raw(t)
        for t, i in self.added.items():
            self.token[i] = t.encode()
        self.single = [0] * 256
        for c, b in chars.items():
            self.single[b] = vocab[c]
        self.merges = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[vocab[a], vocab[b]] = (rank, vocab[a + b])
        self.cut = regex.compile("|".join(regex.escape(t) for t in sorted(self.added, key=len, reverse=True))) if self.added else None
        self.pieces = regex.compile(PATTERN).findall
        self.fits: dict[tuple[int, int], bool] = {}
        self.known: dict[str, bytes] = {}
        self._library = None

    def merge(self, data: bytes) -> list[int]:
        """Merge the lowest rank first, the leftmost of equals first."""
        ids: list[int] = [self.single[b] for b in data]
        n = len(ids)
        if n <= 24:
            # Few enough to look through all pairs for each merge.
            known = self.merges.get
            pairs = [known(p) for p in zip(ids, ids[1:])]  # noqa: B905
            while (best := min(filter(None, pairs), default=None)) is not None:
                i = pairs.index(best)
                ids[i : i + 2] = [best[1]]
                del pairs[i]
                if i:
                    pairs[i - 1] = known((ids[i - 1], best[1]))
                if i < len(pairs):
                    pairs[i] = known((best[1], ids[i + 1]))
            return ids
        after, before, live = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        merges = self.merges
        heap = [(m[0], i, ids[i], ids[i + 1], m[1]) for i in range(n - 1) if (m := merges.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, to = heapq.heappop(heap)
            if not live[i] or ids[i] != a or (j := after[i]) >= n or ids[j] != b:
                continue
            ids[i], live[j] = to, False
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if m := merges.get((to, ids[k])):
                    heapq.heappush(heap, (m[0], i, to, ids[k], m[1]))
            if (h := before[i]) >= 0 and (m := merges.get((ids[h], to))):
                heapq.heappush(heap, (m[0], h, ids[h], to, m[1]))
        return [x for x, ok in zip(ids, live, strict=True) if ok]

    def agree(self, a: int, b: int) -> bool:
        """Whether the bytes of two tokens encode to just these two."""
        if (got := self.fits.get((a, b))) is None:
            if len(self.fits) > CACHED // 4:
                self.fits.clear()
            got = self.fits[a, b] = self.merge(self.token[a] + self.token[b]) == [a, b]
        return got

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of both sides' bytes, from the encodings of each."""
        if not left or not right or self.agree(left[-1], right[0]):
            return left + right
        wide = 2
        while True:
            i, j = max(0, len(left) - wide), min(len(right), wide)
            mid = self.merge(b"".join(self.token[t] for t in (*left[i:], *right[:j])))
            if (i == 0 or self.agree(left[i - 1], mid[0])) and (j == len(right) or self.agree(mid[-1], right[j])):
                return left[:i] + mid + right[j:]
            wide *= 2

    def encode_piece(self, data: bytes) -> list[int]:
        if len(data) <= self.piece:
            return self.merge(data)
        parts = [data]
        while len(parts[0]) > self.piece:
            parts = [half for p in parts for half in (p[: (len(p) + 1) // 2], p[(len(p) + 1) // 2 :])]
        level = [self.merge(p) for p in parts]
        while len(level) > 1:
            level = [self.join(level[k], level[k + 1]) if k + 1 < len(level) else level[k] for k in range(0, len(level), 2)]
        return level[0]

    def split(self, text: str) -> list[str]:
        if _OTHER.search(text) is None:
            return self.pieces(text)
        if self._library is None:
            from tokenizers import pre_tokenizers

            self._library = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
        return [text[a:b] for _, (a, b) in self._library.pre_tokenize_str(text)]

    def _packed(self, pieces: list[str]) -> list[bytes]:
        known = self.known
        try:
            return [known[p] for p in pieces]
        except KeyError:
            pass
        out = []
        for p in pieces:
            if (got := known.get(p)) is None:
                ids = self.encode_piece(p.encode())
                got = struct.pack(f"<{len(ids)}I", *ids)
                if len(p) <= 64:
                    if len(known) >= CACHED:
                        known.clear()
                    known[p] = got
            out.append(got)
        return out

    def concatenated(self, left: Part, right: Part) -> Part:
        """The pieces of both sides' text, and the ids of each, from those of each side."""
        if not left[0] or not right[0]:
            return right if not left[0] else left
        self.joins += 1
        i, back = len(left[0]), 0
        while i and back < _AHEAD:
            i -= 1
            back += len(left[0][i])
        tail, most = "".join(left[0][i:]), len(right[0])
        j, at, ends = 0, 0, {0: 0}
        want = 32
        while True:
            while j < most and at < want:
                at += len(right[0][j])
                j += 1
                ends[at] = j
            window = self.split(tail + "".join(right[0][:j]))
            limit = at if j == most else at - _AHEAD
            pos = -len(tail)
            for k, piece in enumerate(window):
                pos += len(piece)
                if pos > limit:
                    break
                if pos in ends:
                    window = window[: k + 1]
                    return left[0][:i] + window + right[0][ends[pos] :], left[1][:i] + self._packed(window) + right[1][ends[pos] :]
            self.grown += 1
            want *= 4

    def encode_part(self, text: str) -> Part:
        """Pieces of a stretch without added tokens, and the ids of each: leaves first, then joins level by level."""
        if len(text) <= self.leaf:
            pieces = self.split(text)
            return pieces, self._packed(pieces)
        return self.joined([self.encode_part(t) for t in halves(text, self.leaf)])

    def joined(self, level: list[Part]) -> Part:
        while len(level) > 1:
            level = [self.concatenated(*level[k : k + 2]) if k + 1 < len(level) else level[k] for k in range(0, len(level), 2)]
        return level[0] if level else ([], [])

    def stretches(self, text: str) -> list[tuple[int, str]]:
        """Stretches of a text as (-1, stretch), and added tokens as (id, string)."""
        if self.cut is None or self.cut.search(text) is None:
            return [(-1, text)]
        out, at = [], 0
        for m in self.cut.finditer(text):
            out += [(-1, text[at : m.start()]), (self.added[m[0]], m[0])]
            at = m.end()
        return [*out, (-1, text[at:])]

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        return b"".join([b"".join(self.encode_part(t)[1]) if i < 0 else np.array([i], "<u4").tobytes() for i, t in self.stretches(text)])

    def decode(self, ids: bytes) -> str:
        token = self.token
        return b"".join([token[i] for i in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", "replace")


def halves(text: str, most: int) -> list[str]:
    """The leaves of a text that is halved until none has more than so many characters."""
    parts = [text]
    while len(parts[0]) > most:
        parts = [half for p in parts for half in (p[: (len(p) + 1) // 2], p[(len(p) + 1) // 2 :])]
    return parts


_codecs: dict[tuple[str, int, int], Codec] = {}


def codec(path: str, piece: int = PIECE, leaf: int = LEAF) -> Codec:
    if (path, piece, leaf) not in _codecs:
        _codecs[path, piece, leaf] = Codec(path, piece, leaf)
    return _codecs[path, piece, leaf]


def _digests(own: Codec, packed: bytes) -> tuple[int, str, str]:
    return len(packed) // 4, hashlib.sha256(packed).hexdigest(), hashlib.sha256(own.decode(packed).encode("utf-8")).hexdigest()


def _columns(found: list[tuple[int, str, str]], packed: list[bytes] | None) -> list[pa.Array]:
    cols = [pa.array([f[k] for f in found], t) for k, t in enumerate((pa.int64(), pa.string(), pa.string()))]
    if packed is not None:
        at = np.r_[0, np.cumsum([f[0] for f in found], dtype=np.int64)].astype(np.int32)
        cols.append(pa.ListArray.from_arrays(pa.array(at), pa.array(np.frombuffer(b"".join(packed), "<i4"))))
    return cols


def encode_documents(docs: DataFrame, tokenizer: str, piece: int = PIECE, leaf: int = LEAF, spread: int = SPREAD, ids: bool = True, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Encode every whole text and decode it again: `keep`, n_tokens, ids_sha256, decoded_sha256 and, if asked, ids.

    Texts of up to `spread` bytes are encoded in one pass without a shuffle. Longer ones are halved to rows of at most
    that many characters, which are dealt out, encoded each in its own task, and gathered by text to be joined; equal
    rows among them are one, with a count. `tokenizer` is the path of a vocabulary file that every executor has. A null
    text is empty and has no tokens; repeated rows and null ids are encoded as any other; an empty table gives an empty
    result; other columns are not read.
    """
    kept = columns(docs, [*keep, "text"])
    head = ", ".join(f"`{c}` {kept.schema[c].dataType.simpleString()}" for c in keep)
    found = "n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids
    names = ["n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(tokenizer, piece, leaf)
        for batch in portions(batches, "text"):
            packed = [own.encode(text.as_py() or "") for text in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + _columns([_digests(own, p) for p in packed], packed if ids else None), [*keep, *names])

    long = F.coalesce(F.octet_length("text"), F.lit(0)) > spread
    short = kept.where(~long).mapInArrow(run, f"{head}, {found}")

    # Internal names that no column of `keep` has.
    k = {c: f"{c}_{max(map(len, keep), default=0) * '_'}" for c in ("a", "b", "n", "part", "stretch", "added", "t", "lens", "toks", "ids")}
    place = F.concat(*[F.when(F.col(c).isNull(), "0").otherwise("1") for c in [*keep, "text"]])
    once = kept.where(long).withColumns({k["a"]: F.xxhash64(place, *keep, "text"), k["b"]: F.xxhash64(F.lit(1), place, *keep, "text")})
    once = once.groupBy(k["a"], k["b"]).agg(*[F.any_value(c).alias(c) for c in [*keep, "text"]], F.count("*").alias(k["n"]))
    by = [k["a"], k["b"], *keep, k["n"]]
    row = f"{k['a']} bigint, {k['b']} bigint, {head}, {k['n']} bigint, {k['stretch']} int, {k['part']} int, {k['added']} int, {k['t']} string"

    def halved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(tokenizer, piece, leaf)
        for batch in batches:
            rows = [(i, s, p, a, t) for i, text in enumerate(batch.column("text")) for s, (a, stretch) in enumerate(own.stretches(text.as_py())) for p, t in enumerate(halves(stretch, spread) if a < 0 else [stretch])]
            for lo in range(0, len(rows), 256):
                some = rows[lo : lo + 256]
                take = pa.array([r[0] for r in some])
                cols = [batch.column(c).take(take) for c in by] + [pa.array([r[c] for r in some], pa.int32()) for c in (1, 2, 3)] + [pa.array([r[4] for r in some], pa.string())]
                yield pa.RecordBatch.from_arrays(cols, [*by, k["stretch"], k["part"], k["added"], k["t"]])

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(tokenizer, piece, leaf)
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                added, text = one.column(k["added"])[0].as_py(), one.column(k["t"])[0].as_py()
                pieces, packed = own.encode_part(text) if added < 0 else ([text], [np.array([added], "<u4").tobytes()])
                blobs = [np.array([len(x) for x in pieces], "<i4").tobytes(), np.array([len(x) // 4 for x in packed], "<i4").tobytes(), b"".join(packed)]
                yield pa.RecordBatch.from_arrays([*one.columns, *[pa.array([x], pa.binary()) for x in blobs]], [*one.schema.names, k["lens"], k["toks"], k["ids"]])

    def gathered(rows: pa.Table) -> pa.Table:
        own = codec(tokenizer, piece, leaf)
        rows = rows.sort_by([(k["stretch"], "ascending"), (k["part"], "ascending")])
        levels: dict[int, list[Part]] = {}
        for s, t, lens, toks, blob in zip(*[rows[k[c]].to_pylist() for c in ("stretch", "t", "lens", "toks", "ids")], strict=True):
            cut, tok = np.r_[0, np.cumsum(np.frombuffer(lens, "<i4"))].tolist(), np.r_[0, np.cumsum(np.frombuffer(toks, "<i4")) * 4].tolist()
            levels.setdefault(s, []).append(([t[x:y] for x, y in zip(cut[:-1], cut[1:], strict=True)], [blob[x:y] for x, y in zip(tok[:-1], tok[1:], strict=True)]))
        packed = b"".join(b"".join(own.joined(level)[1]) for _, level in sorted(levels.items()))
        one = rows.slice(0, 1)
        return pa.table([*[one[c].combine_chunks() for c in keep], one[k["n"]].combine_chunks(), *_columns([_digests(own, packed)], [packed] if ids else None)], [*keep, k["n"], *names])

    parts = once.mapInArrow(halved, row).repartition(k["a"], k["b"], k["stretch"], k["part"])
    parts = parts.mapInArrow(encoded, f"{row}, {k['lens']} binary, {k['toks']} binary, {k['ids']} binary")
    joined = parts.groupBy(k["a"], k["b"]).applyInArrow(gathered, f"{head}, {k['n']} bigint, {found}")
    joined = joined.withColumn(k["a"], F.explode(F.sequence(F.lit(1), F.col(k["n"]).cast("int")))).select(*keep, *names)
    return short.unionAll(joined)
