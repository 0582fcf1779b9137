"""Near duplicates by MinHash bands and odd sketches, links confirmed on full shingle sets."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .base import checkpoint, columns, connected_components, groups, lower_ascii, mix64, place_of, placed, portions, release, row_hash, span_hashes, stage, utf8, words

WIDTH = 5
#: A pair is linked if 100 * intersection >= percent * union; the percent of op8_minhash.
PERCENT = 85
#: A pair of just that similarity shares no band with at most this probability; samples there are at most.
MISS, SAMPLES = 2e-6, 192


def layout(percent: int) -> tuple[int, int]:
    """Bands and minima in each: the most minima in a band that SAMPLES allow. 28 of 6 at 85 %, 34 of 5 at 80 %."""
    for rows in range(16, 0, -1):
        same = (percent / 100) ** rows
        count = 1 if same == 1 else int(np.ceil(np.log(MISS) / np.log1p(-same)))
        if count * rows <= SAMPLES:
            return count, rows
    raise ValueError(f"{percent} % needs more than {SAMPLES} samples")


BANDS, ROWS = layout(PERCENT)
K = BANDS * ROWS
BITS = 512
#: Estimated similarity from which a member of a band needs no canopy of its own.
OWN = 0.82


def nearness(percent: int) -> float:
    """Estimated similarity from which two members of a band are candidates.

    Distances obey the triangle inequality, so what links to a member within OWN of a leader is within OWN less the
    distance of a link; 0.22 below that (0.45 at 85 %, 0.40 at 80 %) leaves a wide margin for the sketch's error.
    """
    return round(OWN - (1 - percent / 100) - 0.22, 9)


NEAR = nearness(PERCENT)
#: Shingles of a candidate group that one task confirms together.
TOGETHER = 2_000_000
HUBS = 16
_CHUNK = 1 << 20
_U = np.uint64
_C = mix64(np.arange(1000, 1016, dtype=_U)) | _U(1)
_FEW = mix64(np.arange(2000, 2000 + WIDTH + 1, dtype=_U))
_PROBES = 64
_bin_salt = mix64(np.arange(5000, 5000 + SAMPLES, dtype=_U))
_NONE = _U(0xFFFFFFFFFFFFFFFF)


@functools.cache
def _probe(k: int) -> np.ndarray:
    return (mix64(np.arange(k * _PROBES, dtype=_U)) % _U(k)).astype(np.int64).reshape(_PROBES, k)


def shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingle hashes of all rows, and the n + 1 offsets of the rows in them.

    Words are runs of other bytes than ASCII white space, A-Z lower-cased. A row of fewer than WIDTH words has its whole
    sequence as its only shingle; a row without words has none.
    """
    n = len(offsets) - 1
    starts, ends, row = words(data, offsets)
    h = span_hashes(lower_ascii(data), starts, ends)
    count = np.bincount(row, minlength=n) if len(row) else np.zeros(n, np.int64)
    first = np.r_[0, np.cumsum(count)]
    parts, at = [], np.zeros(n + 1, np.int64)
    if len(h) >= WIDTH:
        m = len(h) - WIDTH + 1
        s = np.zeros(m, _U)
        for j in range(WIDTH):
            s += h[j : j + m] * _C[j]
        s = mix64(s)
    for i in range(n):
        a, c = first[i], count[i]
        if c >= WIDTH:
            own = np.sort(s[a : a + c - WIDTH + 1])
            if len(own) > 1:
                own = own[np.r_[True, own[1:] != own[:-1]]]
        elif c:
            own = mix64(((h[a : a + c] * _C[:c]).sum(dtype=_U) ^ _FEW[c]).reshape(1))
        else:
            own = np.zeros(0, _U)
        parts.append(own)
        at[i + 1] = at[i] + len(own)
    return (np.concatenate(parts) if parts else np.zeros(0, _U)), at


def minima(sets: np.ndarray, at: np.ndarray, k: int = K) -> np.ndarray:
    """k MinHash samples of each (non-empty) row by one permutation: the least hash in each of k ranges.

    An empty range copies the first non-empty one on its own fixed sequence of ranges; where a small set has none of
    those, the sample is the set's member of least hash with the range's number. Equal sets get equal samples and each
    sample agrees with the probability of their similarity.
    """
    n = len(at) - 1
    row = np.repeat(np.arange(n), np.diff(at))
    key = row * k + (((sets >> _U(32)) * _U(k)) >> _U(32)).astype(np.int64)
    out = np.full(n * k, _NONE, _U)
    if len(key):
        first = np.r_[True, key[1:] != key[:-1]]
        out[key[first]] = sets[first]
    out = out.reshape(n, k)
    whole = out.copy()
    open_ = np.flatnonzero((out == _NONE).any(1))
    for t in range(_PROBES):
        if not len(open_):
            break
        part = out[open_]
        part = np.where(part == _NONE, whole[open_][:, _probe(k)[t]], part)
        out[open_] = part
        open_ = open_[(part == _NONE).any(1)]
    for i in open_:
        own = sets[at[i] : at[i + 1]]
        if len(own):
            gap = np.flatnonzero(out[i] == _NONE)
            out[i, gap] = own[mix64(own[:, None] ^ _bin_salt[gap][None, :]).argmin(0)]
    return out


def bands(samples: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """A hash of each band of so many samples, different for each band's number."""
    x = samples.reshape(len(samples), samples.shape[1] // rows, rows)
    return mix64((x * _C[:rows]).sum(2, dtype=_U) + _bin_salt[: x.shape[1]])


def sketches(samples: np.ndarray) -> np.ndarray:
    """Odd sketches: bit b is the parity of the number of samples that hash to b. One row of BITS / 64 words each."""
    n = len(samples)
    bit = (mix64(samples + _bin_salt[None, : samples.shape[1]]) % _U(BITS)).astype(np.int64)
    odd = np.bincount((bit + np.arange(n)[:, None] * BITS).ravel(), minlength=n * BITS) & 1
    return np.packbits(odd.reshape(n, BITS).astype(np.uint8), axis=1).view(_U)


def most_ones(similarity: float, k: int = K) -> float:
    """Ones expected in the XOR of two odd sketches of sets that similar: samples that differ are 2 k (1 - J)."""
    return BITS / 2 * (1 - np.exp(-4 * k * (1 - similarity) / BITS))


def signatures(docs: DataFrame, percent: int = PERCENT, keep: tuple[str, ...] | None = None) -> DataFrame:
    """doc_id (or `keep`), n_shingles, h1 and h2 (hash of the set), bands, sketch; the last four null for sets without members."""
    kept = columns(docs, ["doc_id", "text"]) if keep is None else docs.select(*keep, "text")
    keep = keep or ("doc_id",)
    types = ", ".join(f"{c} {kept.schema[c].dataType.simpleString()}" for c in keep)
    names = [*keep, "n_shingles", "h1", "h2", "bands", "sketch"]
    n_bands, rows = layout(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, "text", 1 << 23):
            data, offsets = utf8(batch.column("text"))
            i, n = 0, batch.num_rows
            while i < n:
                j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + _CHUNK, "right")) - 1)
                at = offsets[i : j + 1]
                sets, where = shingles(data[at[0] : at[-1]], at - at[0])
                size = np.diff(where)
                full = size > 0
                samples = minima(sets, where, n_bands * rows)[full]
                ids = [xxhash.xxh3_128_intdigest(sets[a:b].tobytes()) for a, b in zip(where[:-1], where[1:], strict=True)]
                h = np.array([[x >> 64, x & 0xFFFFFFFFFFFFFFFF] for x in ids], _U).reshape(-1, 2).view(np.int64)
                none = pa.array(~full)
                ends = np.r_[0, np.cumsum(full * n_bands)].astype(np.int32)
                bits = np.r_[0, np.cumsum(full * (BITS // 8))].astype(np.int32)
                list_ = pa.ListArray.from_arrays(pa.array(ends), pa.array(bands(samples, rows).view(np.int64).ravel()))
                blob = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(bits), pa.py_buffer(sketches(samples).tobytes())])
                null = lambda a, none=none: pa.compute.if_else(none, None, a)
                cols = [*[batch.column(c).slice(i, j - i) for c in keep], pa.array(size, pa.int64()), null(pa.array(h[:, 0])), null(pa.array(h[:, 1])), list_, blob]
                yield pa.RecordBatch.from_arrays(cols, names)
                i = j

    return kept.mapInArrow(run, f"{types}, n_shingles bigint, h1 bigint, h2 bigint, bands array<bigint>, sketch binary")


def _canopies(batches: Iterator[pa.RecordBatch], percent: int = PERCENT) -> Iterator[pa.RecordBatch]:
    """Candidate links (node, leader) from rows sorted by band: one pass, only a band's leaders are held.

    Each member is compared with the leaders of its band by sketch. It is in the canopies of all that are near; unless one
    is within OWN, it becomes a leader itself. A linked pair is never parted: if one of them is within OWN of a leader,
    the other is near it. Canopies that share a member are one group, so a member links to the first leader
    of its own only, and a leader to one that its canopy meets if these are not connected yet: a band has fewer links
    than members and leaders together.
    """
    samples = int(np.prod(layout(percent)))
    near, own = most_ones(nearness(percent), samples), most_ones(OWN, samples)
    key: int | None = None
    heads: list[tuple[int, np.ndarray]] = []
    up: list[int] = []

    def root(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for batch in batches:
        k = np.asarray(batch.column("band"))
        ids = np.asarray(batch.column("h1"))
        blob = batch.column("sketch")
        at = np.frombuffer(blob.buffers()[1], np.int32)[blob.offset : blob.offset + len(blob) + 1]
        sk = np.frombuffer(blob.buffers()[2], np.uint8)[at[0] : at[-1]].reshape(-1, BITS // 8).view(_U) if len(blob) else np.zeros((0, BITS // 64), _U)
        a, b = [], []
        lo, hi = groups(k)
        alone = hi - lo == 1
        if len(alone):
            alone[-1] = False
            alone[0] &= k[0] != key
        for i, j in zip(lo[~alone].tolist(), hi[~alone].tolist(), strict=True):
            if k[i] != key:
                key, heads, up = int(k[i]), [], []
            left, covered, first, done = np.arange(i, j), np.zeros(j - i, bool), np.full(j - i, -1), 0
            while len(left):
                if done == len(heads):
                    free = np.flatnonzero(~covered)
                    if not len(free):
                        break
                    # Members before the new leader have met all leaders; it links to the first one near it.
                    f = free[0]
                    heads.append((int(ids[left[f]]), sk[left[f]].copy()))
                    up.append(int(first[f]) if first[f] >= 0 else done)
                    seen = first[:f] >= 0
                    a.append(ids[left[:f]][seen])
                    b.append(np.array([heads[h][0] for h in first[:f][seen]], np.int64))
                    if first[f] >= 0:
                        a.append(np.array([heads[done][0]]))
                        b.append(np.array([heads[first[f]][0]]))
                    left, covered, first = left[f + 1 :], covered[f + 1 :], first[f + 1 :]
                head, bits = heads[done]
                ones = np.bitwise_count(sk[left] ^ bits).sum(1)
                hit = (ones <= near) & (ids[left] != head)
                for other in np.unique(first[hit]):
                    if other >= 0 and root(other) != root(done):
                        up[root(other)] = root(done)
                        a.append(np.array([head]))
                        b.append(np.array([heads[other][0]]))
                first[hit & (first < 0)] = done
                covered |= ones <= own
                done += 1
            seen = first >= 0
            a.append(ids[left[seen]])
            b.append(np.array([heads[h][0] for h in first[seen]], np.int64))
        if a:
            pair = np.unique(np.stack([np.concatenate(a), np.concatenate(b)], 1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1])], ["node", "leader"])


def exact_links(sets: list[np.ndarray], percent: int = PERCENT) -> list[tuple[int, int]]:
    """Links that connect just what all links among the sets connect, each found on full sets.

    One member after the other, those with the most common shingles first, is compared with all others at once. A
    member is skipped if some earlier comparison shows that whatever it could link to (within a link's distance of its own) is
    in its component already; nothing is left to compare when all are in one.
    """
    n, size = len(sets), np.array([len(s) for s in sets])
    values, at = np.concatenate(sets), np.r_[0, np.cumsum(size)]
    if n == 2:
        both = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return [(0, 1)] if 100 * both >= percent * (size.sum() - both) else []
    _, inv, freq = np.unique(values, return_inverse=True, return_counts=True)
    common = np.add.reduceat(freq[inv], at[:-1]) / size
    comp, out, seen = np.arange(n), [], []
    slack = 1 - percent / 100 + 1e-9
    mark = np.zeros(len(freq), np.int32)
    for p in np.argsort(-common, kind="stable"):
        if (comp == comp[p]).all():
            break
        if any((comp[np.abs(d - d[p]) <= slack] == comp[p]).all() for d in seen):
            continue
        own = inv[at[p] : at[p + 1]]
        mark[own] = 1
        both = np.add.reduceat(mark[inv], at[:-1])
        mark[own] = 0
        union = size + size[p] - both
        for j in np.flatnonzero(100 * both >= percent * union):
            if comp[j] != comp[p]:
                out.append((int(p), int(j)))
                comp[comp == comp[j]] = comp[p]
        seen = [*seen[-31:], 1 - both / union]
    return out


def _confirm(found: pa.Table, percent: int = PERCENT) -> pa.Table:
    """Confirmed links among the rows (h1, h2, text) of one candidate group."""
    data, offsets = utf8(found["text"])
    sets, ids, known = [], [], set()
    h1, h2 = found["h1"].to_pylist(), found["h2"].to_pylist()
    for i in range(found.num_rows):
        own, _ = shingles(data[offsets[i] : offsets[i + 1]], np.array([0, offsets[i + 1] - offsets[i]]))
        x = xxhash.xxh3_128_intdigest(own.tobytes())
        mine = np.array([x >> 64, x & 0xFFFFFFFFFFFFFFFF], _U).view(np.int64).tolist()
        # A repeated id brings in other texts, and copies of one set come once.
        if mine == [h1[i], h2[i]] and x not in known:
            known.add(x)
            sets.append(own)
            ids.append(h1[i])
    pairs = exact_links(sets, percent) if len(sets) > 1 else []
    if sum(map(len, sets)) > 1 << 16:
        release()
    return pa.table({"a": pa.array([ids[i] for i, _ in pairs], pa.int64()), "b": pa.array([ids[j] for _, j in pairs], pa.int64())})


def near_duplicates(docs: DataFrame, together: int = TOGETHER, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable over links), kept (doc_id = component_id).

    Texts are linked from a similarity of `percent` on, which sets bands and canopies too (see layout and nearness).

    1. Every text's shingle set gives MinHash samples, bands of them and an odd sketch (one pass). Equal sets are one
       class from here on, so exact copies, however many, are one row.
    2. Classes are dealt by band. Within a band a single pass over sorted rows compares each with the band's leaders by
       sketch (see _canopies), so a band of any size costs rows times leaders and never all pairs.
    3. Components over these candidate links are candidate groups. Their texts, one for each class, are fetched once by
       128 bits of hash of id and text and confirmed on full sets (see exact_links). A group of more than `together`
       shingles is dealt out in parts, each confirmed with the HUBS busiest leaders; if it isn't one component then,
       each pair of its parts is confirmed.
    4. Components over confirmed links are the result.

    A text without words (or null) is linked with nothing and is its own component. Rows that share a doc_id, or have
    none, are documents of their own for links; a null id takes the smallest id of its component, and is kept only if
    all of it has none. Repeated rows get equal results; an empty table gives an empty result; other columns are not
    read, and of several columns named doc_id or text the first counts.
    """
    rows = columns(docs, ["doc_id", "text"]).withColumns({f"k{i}": row_hash(i, "doc_id", "text") for i in (1, 2)})
    sig, classes = _components(rows, together, percent)
    least = classes.groupBy("component").agg(F.min("best.doc_id").alias("component_id"))
    ids = checkpoint(classes.join(least, "component").select("h1", "h2", "component_id"))
    found = sig.select("doc_id", "n_shingles", "h1", "h2").join(ids, ["h1", "h2"], "left")
    found = found.withColumn("component_id", F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id")))
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def _components(rows: DataFrame, together: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Signatures of rows (doc_id, k1, k2, text), and of each class: h1, h2, best, component (the h1 of a class).

    `best` is the class's row of smallest doc_id, nulls last: (none, doc_id, k1, k2).
    """
    sig = stage(signatures(rows, percent, ("doc_id", "k1", "k2")), "minhash")
    full = sig.where("n_shingles > 0")
    classes = full.groupBy("h1", "h2").agg(F.any_value("bands").alias("bands"), F.any_value("sketch").alias("sketch"))
    members = classes.select("h1", "sketch", F.explode("bands").alias("band"))
    members = members.repartition(F.col("band")).sortWithinPartitions("band", "h1")
    candidates = stage(members.select("band", "h1", "sketch").mapInArrow(lambda batches: _canopies(batches, percent), "node bigint, leader bigint").distinct(), "candidates")
    parts = connected_components(candidates).select(F.col("node").alias("h1"), F.col("component").alias("g"))

    ids = full.groupBy("h1", "h2").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k1", "k2")).alias("best"), F.max("n_shingles").alias("n"))
    inside = ids.join(parts, "h1")
    sizes = inside.groupBy("g").agg(F.ceil(F.sum("n") / together).cast("int").alias("m"))
    inside = stage(inside.join(sizes, "g").select("g", "m", "h1", "h2", F.col("best.k1").alias("x1"), F.col("best.k2").alias("x2")), "groups")
    # Not left to sizes: a broadcast of small candidate groups would be another plan than that of large ones.
    same = (F.col("k1") == F.col("x1")) & (F.col("k2") == F.col("x2"))
    texts = rows.select("k1", "k2", "text").hint("merge").join(inside, same).select("g", "m", "h1", "h2", "text")
    large = inside.where("m > 1").limit(1).count() > 0
    if large:
        texts = stage(texts, "texts")

    def confirmed(found: pa.Table) -> pa.Table:
        return _confirm(found, percent)

    confirm = lambda rows, *by: rows.groupBy(*by).applyInArrow(confirmed, "a bigint, b bigint")
    links = confirm(texts.where("m = 1") if large else texts, "g")
    if large:
        hubs = candidates.groupBy("leader").agg(F.count("*").alias("deg")).join(inside.where("m > 1"), F.col("leader") == F.col("h1"))
        hubs = hubs.withColumn("k", F.row_number().over(W.partitionBy("g").orderBy(F.desc("deg"), "h1"))).where(F.col("k") <= HUBS).select("h1")
        rest = texts.where("m > 1").withColumn("c", F.pmod("h2", "m").cast("int"))
        spread = rest.join(hubs, "h1", "left_semi").withColumn("c", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
        first = confirm(rest.join(hubs, "h1", "left_anti").unionByName(spread), "g", "c")
        links = stage(links.unionAll(first), "links")
        now = inside.where("m > 1").join(connected_components(links).withColumnRenamed("node", "h1"), "h1", "left")
        broken = now.groupBy("g").agg(F.min(F.coalesce("component", "h1")).alias("x"), F.max(F.coalesce("component", "h1")).alias("y")).where("x <> y").select("g")
        pairs = rest.join(broken, "g", "left_semi").withColumn("e", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
        pairs = pairs.withColumn("p", F.least("c", "e")).withColumn("q", F.greatest("c", "e"))
        links = links.unionAll(confirm(pairs, "g", "p", "q"))
    joined = connected_components(links).select(F.col("node").alias("h1"), "component")
    return sig, checkpoint(ids.select("h1", "h2", "best").join(joined, "h1", "left").withColumn("component", F.coalesce("component", "h1")))


def deduplicated(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One row of each component: that of smallest doc_id, nulls last (of equal ones, that of least hash).

    Texts without words are linked with nothing and all stay. Rows are known by 128 bits of hash of all their columns,
    so null and repeated ids are no matter: of rows that are equal in every column one stays, and no text goes for
    another's id. Columns are known by their place, so any names come back as they were; of several columns named
    doc_id or text the first counts; an empty table gives an empty result.
    """
    place, names = placed(docs)
    who, what = place_of(names, "doc_id"), place_of(names, "text")
    keys = {f"k{i}": row_hash(i, *place.columns) for i in (1, 2)}
    rows = place.select(F.col(who).alias("doc_id"), F.col(what).alias("text"), *[v.alias(k) for k, v in keys.items()])
    _, classes = _components(rows, TOGETHER, percent)
    best = classes.groupBy("component").agg(F.min("best").alias("best")).select("best.k1", "best.k2")
    worded = F.coalesce(F.col(what).rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    kept = place.where(worded).withColumns(keys).hint("merge").join(best.distinct(), ["k1", "k2"], "left_semi").dropDuplicates(["k1", "k2"])
    return kept.select(*place.columns).unionAll(place.where(~worded)).toDF(*names)
