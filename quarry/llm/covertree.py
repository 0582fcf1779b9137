"""Embedding near-duplicates: exact threshold pairs by traversing two cover trees at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import checkpoint, columns, connected_components, stage

COSINE = 0.9
#: Vectors of a block, about; a block has a tree of its own.
BLOCK = 8192
#: Cells of the first level, at most; their centres and radii are all that comes to the driver.
PIVOTS = 1024
#: A cell of more than so many blocks is dealt to at most so many cells of its own, over so many levels at most.
SPLIT, KIDS, LEVELS = 4, 256, 5
#: Covering radii of the levels, halved from one to the next; distances are chords between unit vectors (0 to 2).
RADII = (1.0, 0.5, 0.25, 0.125)
#: Bounds are loosened by this, so rounding prunes no pair; pairs themselves are compared by cosine.
SLACK = 1e-9
#: Node pairs of at most so many vector pairs are compared outright.
DIRECT = 1 << 14
_ROWS = 512


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(1))[:, None]


def chord(dot: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * dot))


def margin(dim: int) -> float:
    """More than a product of two unit vectors in single precision can be off; closer calls are made in double."""
    return max(2e-5, 2.0**-22 * dim)


def _net(u: np.ndarray, rows: np.ndarray, radius: float) -> list[np.ndarray]:
    """The rows of each node of a greedy net, its centre first: every row joins the first centre within the radius.

    Candidates for centres are taken some at a time, so their distances are one product of matrices.
    """
    near, out = np.float32(1.0 - (radius * radius) / 2.0 + margin(u.shape[1])), []
    while len(rows):
        head = min(256, len(rows))
        close = u[rows[:head]] @ u[rows].T >= near
        close[np.arange(head), np.arange(head)] = True
        centres, covered = [], np.zeros(head, bool)
        for i in range(head):
            if not covered[i]:
                centres.append(i)
                covered |= close[i, :head]
        own = close[centres]
        # A centre that an earlier one covers would not be one.
        own[:, centres] = np.eye(len(centres), dtype=bool)
        which, taken = own.argmax(0), own.any(0)
        at = np.flatnonzero(taken)
        at = at[np.lexsort((at != np.array(centres)[which[at]], which[at]))]
        out += np.split(rows[at], np.flatnonzero(np.diff(which[at])) + 1)
        rows = rows[~taken]
    return out


def build(u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order of the rows and, for each level, the node of each ordered row: nested nets of halving radii.

    A node's rows are neighbours in the order, its centre first; all lie within the level's radius of the centre. The
    centre of a node is also that of its first child.
    """
    u = u.astype(np.float32)
    n = len(u)
    nodes, found = np.zeros((len(RADII), n), np.int32), [np.arange(n)] if n else []
    for level, radius in enumerate(RADII):
        found = [part for own in found for part in (_net(u, own, radius) if len(own) > 1 else [own])]
        nodes[level] = np.repeat(np.arange(len(found)), [len(x) for x in found])
    return (np.concatenate(found) if found else np.arange(0)), nodes


class Tree:
    """Levels of nodes over ordered unit vectors: first and last row, covering radius, mass, children."""

    def __init__(self, u: np.ndarray, nodes: np.ndarray, mass: np.ndarray):
        self.u, self.mass = u, mass
        self.small = u.astype(np.float32)
        self.levels = []
        total = np.r_[0, np.cumsum(mass)]
        for k, ids in enumerate(nodes):
            first = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
            last = np.r_[first[1:], len(ids)]
            centre = np.repeat(first, last - first)
            far = np.maximum.reduceat(chord(np.einsum("ij,ij->i", u, u[centre])), first)
            child = np.searchsorted(np.flatnonzero(np.r_[True, nodes[k + 1][1:] != nodes[k + 1][:-1]]), np.r_[first, len(ids)]) if k + 1 < len(nodes) else None
            self.levels.append((first, last, np.where(last - first == 1, 0.0, far + SLACK), total[last] - total[first], child))


def _labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least row of each row's component over the links a-b."""
    label = np.arange(n)
    while len(a):
        least = np.minimum(label[a], label[b])
        np.minimum.at(label, a, least)
        np.minimum.at(label, b, least)
        while (label[label] != label).any():
            label = label[label]
        apart = label[a] != label[b]
        a, b = label[a[apart]], label[b[apart]]
    return label


class Pairs:
    """Links between the rows of two trees (or within one): how much mass each row links with, and components."""

    def __init__(self, a: Tree, b: Tree, same: bool, cosine: float = COSINE):
        self.a, self.b, self.same, self.cosine = a, b, same, cosine
        self.reach = float(np.sqrt(2.0 - 2.0 * cosine)) + SLACK
        self.close = margin(a.u.shape[1])
        n, m = len(a.u), len(b.u)
        self.links = [np.zeros(n, np.int64), np.zeros(0 if same else m, np.int64)]
        self.compared = self.descended = 0
        self._edges: list[tuple[np.ndarray, np.ndarray]] = []
        self._walk()
        x, y = (np.concatenate(e) if self._edges else np.zeros(0, np.int64) for e in (list(zip(*self._edges, strict=True)) or [(), ()]))
        self.label = _labels(n if same else n + m, x, y if same else y + n)

    def _walk(self) -> None:
        a, b = self.a.levels, self.b.levels
        # Coarse levels that have about as many nodes as a finer one bound nothing that it does not bound better.
        top = max(k for k in range(len(RADII)) if all(len(t[k][0]) <= 2 * len(t[0][0]) for t in (a, b)))
        i, j, d = self._top(top)
        for level in range(top, len(RADII)):
            (fa, la, ra, ma, ca), (fb, lb, rb, mb, cb) = a[level], b[level]
            if level > top:
                d = chord(np.einsum("ij,ij->i", self.a.u[fa[i]], self.b.u[fb[j]]))
                self.compared += len(d)
                keep = d <= ra[i] + rb[j] + self.reach
                i, j, d = i[keep], j[keep], d[keep]
            if not len(i):
                return
            # All of one node links with all of the other.
            whole = d + ra[i] + rb[j] <= self.reach - 4 * SLACK
            if self.same:
                whole &= i != j
            for p, q in zip(i[whole], j[whole], strict=True):
                self.links[0][fa[p] : la[p]] += mb[q]
                self.links[0 if self.same else 1][fb[q] : lb[q]] += ma[p]
                x, y = np.arange(fa[p], la[p]), np.arange(fb[q], lb[q])
                self._edges += [(x, np.full(len(x), y[0])), (np.full(len(y), x[0]), y)]
            i, j = i[~whole], j[~whole]
            small = (la[i] - fa[i]) * (lb[j] - fb[j]) <= DIRECT
            if level + 1 == len(RADII):
                small[:] = True
            for p, q in zip(i[small], j[small], strict=True):
                self._compare(fa[p], la[p], fb[q], lb[q])
            i, j = i[~small], j[~small]
            if not len(i):
                return
            self.descended += len(i)
            na, nb = ca[i + 1] - ca[i], cb[j + 1] - cb[j]
            k = np.repeat(np.arange(len(i)), na * nb)
            within = np.arange(len(k)) - np.repeat(np.cumsum(na * nb) - na * nb, na * nb)
            own = self.same & (i == j)
            i, j, own = ca[i][k] + within // nb[k], cb[j][k] + within % nb[k], (own[k] if self.same else None)
            if self.same:
                keep = ~own | (i <= j)
                i, j = i[keep], j[keep]

    def _top(self, level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pairs of nodes of a level within reach, and their distances: a product of some centres with all.

        Single precision only prunes here, by bounds that are loosened accordingly. Nodes of one vector have radius 0,
        so one number bounds their pairs; what is left of them is settled at once.
        """
        (fa, _, ra, *_), (fb, _, rb, *_) = self.a.levels[level], self.b.levels[level]
        one_b, found = rb == 0, []
        for one in (True, False):
            for lo in range(0, len(fa), _ROWS):
                rows = np.flatnonzero((ra[lo : lo + _ROWS] == 0) == one) + lo
                for cols in (np.flatnonzero(one_b), np.flatnonzero(~one_b)):
                    if not len(rows) or not len(cols):
                        continue
                    dot = self.a.small[fa[rows]] @ self.b.small[fb[cols]].T
                    self.compared += dot.size
                    if one and one_b[cols[0]]:
                        x, y = np.divmod(np.flatnonzero(dot >= np.float32(self.cosine - self.close)), len(cols))
                    else:
                        far = np.minimum(2.0, ra[rows][:, None] + rb[cols] + self.reach)
                        x, y = np.divmod(np.flatnonzero(dot >= (1.0 - far * far / 2.0 - self.close).astype(np.float32)), len(cols))
                    found.append((rows[x], cols[y]))
        i, j = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in (0, 1))
        if self.same:
            keep = i <= j
            i, j = i[keep], j[keep]
        d = np.empty(len(i))
        for lo in range(0, len(i), 1 << 16):
            s = slice(lo, lo + (1 << 16))
            d[s] = np.einsum("ij,ij->i", self.a.u[fa[i[s]]], self.b.u[fb[j[s]]])
        single = (ra[i] == 0) & (rb[j] == 0)
        linked = single & (d >= self.cosine)
        if self.same:
            linked &= i != j
        x, y = fa[i[linked]], fb[j[linked]]
        np.add.at(self.links[0], x, self.b.mass[y])
        np.add.at(self.links[0 if self.same else 1], y, self.a.mass[x])
        self._edges.append((x, y))
        return i[~single], j[~single], chord(d[~single])

    def _compare(self, a0: int, a1: int, b0: int, b1: int) -> None:
        inner = self.same and a0 == b0
        for lo in range(a0, a1, 1024):
            hi = min(a1, lo + 1024)
            dot = self.a.small[lo:hi] @ self.b.small[b0:b1].T
            hit = dot >= self.cosine
            x, y = np.nonzero(np.abs(dot - np.float32(self.cosine)) <= self.close)
            hit[x, y] = np.einsum("ij,ij->i", self.a.u[x + lo], self.b.u[y + b0]) >= self.cosine
            self.compared += hit.size
            if inner:
                hit[np.arange(lo - a0, hi - a0), np.arange(lo - a0, hi - a0)] = False
            if not hit.any():
                continue
            self.links[0][lo:hi] += hit @ self.b.mass[b0:b1]
            if not inner:
                self.links[0 if self.same else 1][b0:b1] += self.a.mass[lo:hi] @ hit
            open_ = hit.any(1)
            while open_.any():
                rows = np.zeros(hi - lo, bool)
                new = np.zeros(hi - lo, bool)
                new[open_.argmax()] = True
                cols = np.zeros(b1 - b0, bool)
                while new.any():
                    rows |= new
                    more = hit[new].any(0) & ~cols
                    cols |= more
                    new = hit[:, more].any(1) & ~rows
                open_ &= ~rows
                x, y = np.flatnonzero(rows) + lo, np.flatnonzero(cols) + b0
                self._edges += [(x, np.full(len(x), y[0])), (np.full(len(y), x[0]), y)]


def _valid(c: str) -> str:
    return f"{c} is not null and size({c}) > 0 and not exists({c}, x -> x is null or isnan(x) or abs(x) = double('infinity')) and exists({c}, x -> x <> 0)"


def _centres(x: list[bytes], kind: str, dim: int) -> np.ndarray:
    return unit(np.frombuffer(b"".join(x), kind).reshape(-1, dim)) if x else np.zeros((0, dim))


def _finer(dealt: DataFrame, cells: DataFrame, near: DataFrame, centres: DataFrame, block: int, cosine: float, kind: str, turn: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One level more: cells of more than SPLIT blocks are dealt to cells of their own, about one a block but at most
    KIDS, by the nearest of some of their vectors; and pairs of cells are replaced by the pairs of their children that
    are within reach. Returns the vectors, the pairs and the centres as they are then.

    A cell's centres meet its vectors in a stream: they come first in each part of the cell, so a task holds one cell's
    centres and a batch of vectors, however many the cell has.
    """
    big = cells.where(F.col("n") > SPLIT * block)
    big = big.select("dim", "cell", F.greatest(F.lit(1), F.floor(F.col("n") / F.least(F.lit(KIDS), F.ceil(F.col("n") / block)))).alias("each"), F.ceil(F.col("n") / (SPLIT * block)).cast("int").alias("salts"))
    rows = dealt.join(big, ["dim", "cell"])
    first = rows.where(F.pmod(F.xxhash64("node", F.lit(turn)), "each") == 0)
    first = first.select("dim", "cell", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("kind"), "node", "mass", "x")
    rest = rows.select("dim", "cell", F.pmod(F.xxhash64("node", F.lit(-1)), "salts").cast("int").alias("salt"), F.lit(1).alias("kind"), "node", "mass", "x")
    stream = first.unionByName(rest).repartition("dim", "cell", "salt").sortWithinPartitions("dim", "cell", "salt", "kind", "node")

    def deal(batches):
        key, held, centre = None, [], np.zeros((0, 0))
        for batch in batches:
            keys = list(zip(*[batch.column(c).to_pylist() for c in ("dim", "cell", "salt", "kind")], strict=True))
            xs = batch.column("x").to_pylist()
            kid, far = np.zeros(len(keys), np.int64), np.full(len(keys), 2.0)
            cuts = [i for i in range(len(keys)) if i == 0 or keys[i] != keys[i - 1]] + [len(keys)]
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                dim, cell, salt, which = keys[i]
                if (dim, cell, salt) != key:
                    key, held = (dim, cell, salt), []
                if which == 0:
                    kid[i:j], far[i:j] = cell * 4096 + 1 + np.arange(len(held), len(held) + j - i), 0.0
                    held += xs[i:j]
                    centre = _centres(held, kind, dim)
                    continue
                kid[i:j] = cell * 4096 + 1
                for lo in range(i, j, 4096) if held else ():
                    hi = min(j, lo + 4096)
                    dots = _centres(xs[lo:hi], kind, dim) @ centre.T
                    kid[lo:hi], far[lo:hi] = cell * 4096 + 1 + dots.argmax(1), chord(dots.max(1))
            keep = pa.array([k[3] == 1 or k[2] == 0 for k in keys])
            cols = [batch.column(c) for c in ("node", "mass", "dim", "cell")] + [pa.array(kid), pa.array(far), batch.column("x"), batch.column("kind")]
            yield pa.RecordBatch.from_arrays(cols, ["node", "mass", "dim", "parent", "cell", "far", "x", "kind"]).filter(keep)

    made = stage(stream.mapInArrow(deal, "node bigint, mass bigint, dim int, parent bigint, cell bigint, far double, x binary, kind int"), "finer")
    kids = made.select("dim", "parent", "cell").distinct()
    dealt = stage(dealt.join(big, ["dim", "cell"], "left_anti").unionByName(made.where("kind = 1").drop("parent", "kind")), "dealt")
    centres = centres.join(big, ["dim", "cell"], "left_anti").unionByName(made.where("kind = 0").select("dim", "cell", "x"))

    all_ = cells.select("dim", F.col("cell").alias("parent")).join(kids, ["dim", "parent"], "left").select("dim", "parent", F.coalesce("cell", "parent").alias("kid"))
    pairs = near.join(all_.withColumnRenamed("parent", "cell").withColumnRenamed("kid", "a"), ["dim", "cell"])
    pairs = pairs.join(all_.withColumnRenamed("parent", "other").withColumnRenamed("kid", "b"), ["dim", "other"]).where("cell <> other or a <= b")
    far = dealt.groupBy("dim", "cell").agg(F.max("far").alias("far")).join(centres, ["dim", "cell"], "left")
    side = lambda c: far.select("dim", F.col("cell").alias(c), F.col("far").alias(f"far_{c}"), F.col("x").alias(f"x_{c}"))
    pairs = pairs.select("dim", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().join(side("a"), ["dim", "a"]).join(side("b"), ["dim", "b"])
    reach = float(np.sqrt(2.0 - 2.0 * cosine)) + SLACK

    def within(batches):
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            cols = {c: batch.column(c).to_pylist() for c in ("dim", "x_a", "x_b", "far_a", "far_b")}
            for dim in set(cols["dim"]):
                own = [i for i in range(batch.num_rows) if cols["dim"][i] == dim and cols["x_a"][i] is not None and cols["x_b"][i] is not None]
                if own:
                    dot = np.einsum("ij,ij->i", _centres([cols["x_a"][i] for i in own], kind, dim), _centres([cols["x_b"][i] for i in own], kind, dim))
                    keep[own] = chord(dot) <= np.array([cols["far_a"][i] + cols["far_b"][i] for i in own]) + reach
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("dim", "a", "b")], ["dim", "cell", "other"]).filter(pa.array(keep))

    near = stage(pairs.select("dim", "a", "b", "far_a", "far_b", "x_a", "x_b").mapInArrow(within, "dim int, cell bigint, other bigint"), "pairs")
    return dealt, near, centres


def near_vectors(vectors: DataFrame, cosine: float = COSINE, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links (other vectors of cosine >= `cosine`), component_id (smallest vec_id reachable), kept.

    1. Equal vectors are one class with a mass; classes are dealt to cells by the nearest of at most PIVOTS centres, a
       fixed sample, and large cells again to cells of their own (see _finer): the upper levels of a tree, held in
       tables. Pairs of cells go level by level if their centres are farther than both radii and the threshold.
    2. Cells are cut into blocks of about `block` vectors by hash, so none has to fit in a task, and each block builds a
       cover tree: nested levels with halving radii. A cell of several blocks that is so small that all of its vectors
       link is counted as a whole.
    3. Pairs of blocks whose cells are within reach are compared by a dual traversal: a pair of nodes goes if their centres are farther than both covering radii and the threshold, counts
       as a whole if they are closer than the threshold less both radii, and is replaced by the pairs of their children
       otherwise. Pairs of vectors are compared in double precision where no bound decides.
    4. A block pair returns sums and a spanning set of links: a row or two for each vector, never its pairs.

    Bounds prune what structure separates: clusters that are apart by more than their radii and the threshold. Vectors
    spread evenly in many dimensions have no such structure; every node then is one vector, and the pairs that are left
    are compared as products of matrices in single precision, of which those too close to call are taken in double.
    Vectors that are null, zero or hold null or non-finite
    components link with nothing; vectors of different lengths do not link. Repeated rows are separate vectors. A null
    vec_id is never the smallest; an empty table gives an empty result.
    """
    vectors = columns(vectors, ["vec_id", "embedding"])
    spark = vectors.sparkSession
    kind = "<f8" if "double" in vectors.schema["embedding"].dataType.simpleString() else "<f4"
    classes = vectors.where(_valid("embedding")).groupBy("embedding").agg(F.min("vec_id").alias("d"), F.count("*").alias("mass"))
    classes = stage(classes.withColumn("node", F.monotonically_increasing_id()), "vectors")
    n = classes.count()
    most = max(1, min(PIVOTS, n // block))
    pivots = [np.array(r[0], np.float64) for r in classes.orderBy(F.xxhash64("embedding"), "node").limit(most).select("embedding").collect()]
    raw = {k: np.stack([p for p in pivots if len(p) == k]) for k in sorted({len(p) for p in pivots})}
    by_dim = {k: unit(p) for k, p in raw.items()}

    def deal(batches):
        for batch in batches:
            col = batch.column("embedding")
            size = np.diff(np.asarray(col.offsets))
            flat = np.asarray(col.flatten())
            cell, far = np.zeros(batch.num_rows, np.int32), np.full(batch.num_rows, 2.0)
            at = np.r_[0, np.cumsum(size)]
            for k in np.unique(size):
                if k in by_dim:
                    own = np.flatnonzero(size == k)
                    x = unit(flat[at[own][:, None] + np.arange(k)])
                    for lo in range(0, len(own), 4096):
                        dots = x[lo : lo + 4096] @ by_dim[k].T
                        cell[own[lo : lo + 4096]], far[own[lo : lo + 4096]] = dots.argmax(1), chord(dots.max(1))
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("mass"), pa.array(size, pa.int32()), pa.array(cell.astype(np.int64)), pa.array(far), pa.array([flat[at[i] : at[i + 1]].astype(kind).tobytes() for i in range(batch.num_rows)], pa.binary())], ["node", "mass", "dim", "cell", "far", "x"])

    dealt = stage(classes.select("node", "mass", "embedding").mapInArrow(deal, "node bigint, mass bigint, dim int, cell bigint, far double, x binary"), "dealt")
    sized = lambda d: checkpoint(d.groupBy("dim", "cell").agg(F.count("*").alias("n"), F.max("far").alias("far"), F.sum("mass").alias("total")))
    cells = sized(dealt)

    # Pairs of cells within reach: found for each cell from the centres and radii of at most PIVOTS cells.
    reach = float(np.sqrt(2.0 - 2.0 * cosine)) + SLACK
    radii = {(r.dim, r.cell): r.far for r in cells.where(F.col("dim").isin(list(by_dim))).select("dim", "cell", "far").collect()}

    def within(batches):
        for batch in batches:
            out: list[tuple[int, int, int]] = []
            for k, i in zip(batch.column("dim").to_pylist(), batch.column("cell").to_pylist(), strict=True):
                if k not in by_dim:
                    out.append((k, i, i))
                    continue
                far = np.array([radii.get((k, j), -np.inf) for j in range(len(by_dim[k]))])
                d = chord(by_dim[k] @ by_dim[k][i])
                out += [(k, i, int(j)) for j in np.flatnonzero(d <= far + far[i] + reach) if j >= i]
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int32()), *[pa.array([o[c] for o in out], pa.int64()) for c in (1, 2)]], ["dim", "cell", "other"])

    near = checkpoint(cells.select("dim", "cell").repartition("cell").mapInArrow(within, "dim int, cell bigint, other bigint"))
    centres = spark.createDataFrame([(k, i, bytearray(v.astype(kind).tobytes())) for k, p in raw.items() for i, v in enumerate(p)], "dim int, cell bigint, x binary")
    for turn in range(1, LEVELS):
        before = cells.where(F.col("n") > SPLIT * block).count()
        if not before:
            break
        dealt, near, centres = _finer(dealt, cells, near, centres, block, cosine, kind, turn)
        cells = sized(dealt)
    # All vectors of a small cell link with each other: nothing of it has to be compared with itself.
    tight = (2 * F.col("far") <= reach - 4 * SLACK) & (F.col("n") > block)
    whole = checkpoint(cells.where(tight).select("dim", "cell", "total"))
    near = near.join(whole.select("dim", "cell", F.col("cell").alias("other")), ["dim", "cell", "other"], "left_anti")
    parts = cells.select("dim", "cell", F.ceil(F.col("n") / block).cast("int").alias("parts"))
    tagged = dealt.join(parts, ["dim", "cell"]).withColumn("part", F.pmod(F.xxhash64("node"), "parts").cast("int"))

    def tree(found: pa.Table) -> pa.Table:
        dim = found["dim"][0].as_py()
        x = np.frombuffer(b"".join(found["x"].to_pylist()), kind).reshape(-1, dim)
        first = np.argsort(np.asarray(found["node"]), kind="stable")
        x = x[first]
        order, nodes = build(unit(x))
        ids, mass = (np.asarray(found[c])[first][order] for c in ("node", "mass"))
        return pa.table({"dim": pa.array([dim], pa.int32()), "cell": found["cell"].slice(0, 1), "part": found["part"].slice(0, 1), **{c: pa.array([v.tobytes()], pa.binary()) for c, v in (("x", x[order]), ("nodes", nodes), ("ids", ids), ("mass", mass))}})

    trees = tagged.groupBy("dim", "cell", "part").applyInArrow(tree, "dim int, cell bigint, part int, x binary, nodes binary, ids binary, mass binary")
    trees = stage(trees.withColumn("block", F.monotonically_increasing_id()), "trees")

    blocks = trees.select("dim", "cell", "block")
    pairs = blocks.join(near, ["dim", "cell"]).join(blocks.select("dim", F.col("cell").alias("other"), F.col("block").alias("b")), ["dim", "other"])
    pairs = pairs.where("cell <> other or block <= b").select(F.least("block", "b").alias("a"), F.greatest("block", "b").alias("b"))
    sides = pairs.select("a", "b", F.col("a").alias("block")).unionAll(pairs.where("a <> b").select("a", "b", F.col("b").alias("block")))
    sent = sides.join(trees.drop("cell", "part"), "block")

    def traverse(found: pa.Table) -> pa.Table:
        rows = sorted(found.to_pylist(), key=lambda r: r["block"])
        made = []
        for r in rows:
            x = np.frombuffer(r["x"], kind).reshape(-1, r["dim"])
            made.append((Tree(unit(x), np.frombuffer(r["nodes"], np.int32).reshape(len(RADII), -1), np.frombuffer(r["mass"], np.int64)), np.frombuffer(r["ids"], np.int64)))
        got = Pairs(made[0][0], made[-1][0], len(made) == 1, cosine)
        ids = np.concatenate([m[1] for m in made])
        links = np.concatenate(got.links)
        hit = np.flatnonzero(links)
        return pa.table({"node": pa.array(ids[hit]), "n": pa.array(links[hit]), "to": pa.array(ids[got.label[hit]])})

    found = stage(sent.groupBy("a", "b").applyInArrow(traverse, "node bigint, n bigint, to bigint"), "vector-links")
    inside = dealt.join(whole, ["dim", "cell"]).select("node", (F.col("total") - F.col("mass")).alias("n"), "dim", "cell")
    hub = inside.groupBy("dim", "cell").agg(F.min("node").alias("to"))
    found = found.unionByName(inside.join(hub, ["dim", "cell"]).select("node", "n", "to"))
    joined = connected_components(found.select("node", "to")).select("node", "component")
    known = classes.select("node", "embedding", "d", "mass").join(found.groupBy("node").agg(F.sum("n").alias("n")), "node", "left").join(joined, "node", "left")
    known = known.select("embedding", "d", (F.coalesce("n", F.lit(0)) + F.col("mass") - 1).alias("n"), F.coalesce("component", "node").alias("component"))
    least = known.groupBy("component").agg(F.min("d").alias("least"))
    known = known.join(least, "component").select(F.col("embedding").alias("e"), F.col("n").cast("long"), "least")
    out = vectors.join(known, F.col("embedding") == F.col("e"), "left")
    component = F.when(F.col("e").isNull(), F.col("vec_id")).otherwise(F.col("least"))
    return out.select("vec_id", F.coalesce("n", F.lit(0)).alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
