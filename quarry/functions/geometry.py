"""Path, transform and style geometry of vector markup.

What patterns can read (points, extents, token text, styles, translations and rotations) is built from columns. Other
transforms are read in sequence: only texts with these go to Arrow-batched functions. Paths are read whole batches at a
time, as arrays of bytes and of tokens. Each is also a plain function of one value.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf, pandas_udf

from .numeric import fixed, token_number
from .text import COORDINATE, every

#: Arguments of each path command.
ARGUMENTS = {"M": 2, "L": 2, "H": 1, "V": 1, "C": 6, "S": 4, "Q": 4, "T": 2, "A": 7, "Z": 0}

_ITEM = re.compile(r"([MmLlHhVvCcSsQqTtAaZz])|([-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?)")
_BAD = re.compile(r"NaN|nan|NAN|null")


def parse_path(d: str) -> list[tuple[str, list[str]]]:
    """Commands with their arguments as text. The two flags of an arc are single digits and may stick to what follows."""
    out: list[tuple[str, list[str]]] = []
    pos, d = 0, _BAD.sub("0", d)
    while pos < len(d):
        flag = out and out[-1][0] in "Aa" and len(out[-1][1]) % 7 in (3, 4)
        m = _ITEM.match(d, pos)
        if m is None:
            pos += 1
        elif m[1]:
            out.append((m[1], []))
            pos = m.end()
        elif flag and d[pos] in "01":
            out[-1][1].append(d[pos])
            pos += 1
        else:
            if out:
                out[-1][1].append(m[2])
            pos = m.end()
    return out


def _mapped(d: str, scale: Callable[[float, bool], str], plain: Callable[[float], str]) -> str:
    """Path data with every length passed through `scale` (value, whether absolute) and rotations through `plain`.

    Arguments beyond whole sets of their command are dropped. Vertical and horizontal values are treated alike.
    """
    out: list[str] = []
    for cmd, args in parse_path(d):
        out.append(cmd)
        n = ARGUMENTS[cmd.upper()]
        if not n:
            continue
        values = [float(a) for a in args[: len(args) // n * n]]
        for k, v in enumerate(values):
            at = k % n
            if cmd in "Aa" and at == 2:
                out.append(plain(v))
            elif cmd in "Aa" and at in (3, 4):
                out.append(str(int(v)))
            else:
                out.append(scale(v, cmd.isupper() and not (cmd == "A" and at < 2)))
    return " ".join(out)


def _one_decimal(v: float) -> str:
    return f"{v:.1f}"


def _two_decimals(v: float) -> str:
    """At most two decimals, at least one."""
    s = f"{v:.2f}"
    return s[:-1] if s[-1] == "0" else s


def path_scaled(d: str | None, scale: float) -> str | None:
    if d is None or len(d) < 2:
        return d
    return _mapped(d, lambda v, _: _one_decimal(v * scale), str)


def path_unscaled(d: str | None, scale: float) -> str | None:
    if d is None or len(d) < 2 or not scale:
        return d
    return _mapped(d, lambda v, _: _two_decimals(v / scale), str)


_CALL = re.compile(r"([a-zA-Z]+)\s*\(([^)]*)\)")


def transform_mapped(t: str | None, length: Callable[[float], float]) -> str | None:
    """A transform list with its lengths mapped: translations, centres of rotations, the last two of a matrix.

    Angles and factors have no unit and stay; factors of scale keep eight decimals, other functions one.
    """

    def one(m: re.Match) -> str:
        args = []
        for x in re.split(r"[,\s]+", m[2].strip()):
            if x:
                try:
                    args.append(float(x.lower().replace("deg", "").replace("px", "").replace("null", "0")))
                except ValueError:
                    args.append(0.0)
        name = m[1].lower()
        if not args or (name == "matrix" and len(args) != 6):
            return m[0]
        if name == "translate":
            args = [length(v) for v in args[:2]]
        elif name == "matrix":
            args = [*args[:4], *map(length, args[4:])]
        elif name == "rotate":
            args = [args[0], *map(length, args[1:3])]
        else:
            args = [round(v, 8 if name == "scale" else 1) for v in args]
        return f"{m[1]}({', '.join(map(str, args))})"

    return _CALL.sub(one, t) if t else t


_LENGTH = re.compile(r"^([-+]?(?:\d+\.?\d*|\.\d+)(?:e[-+]?\d+)?)\s*(px|rem|em)?$")


def style_mapped(style: str | None, length: Callable[[float], float]) -> str | None:
    """A declaration list with font-size and stroke-width mapped to pixels; what is no length stays."""
    if not style:
        return style
    out = []
    for item in (p.strip() for p in style.split(";")):
        key, colon, value = item.partition(":")
        key = key.strip()
        m = _LENGTH.match(value.strip().lower()) if colon and key.lower() in ("font-size", "stroke-width") else None
        if m:
            out.append(f"{key}: {length(float(m[1]) * (16.0 if m[2] in ('em', 'rem') else 1.0))}px")
        elif item:
            out.append(item)
    return "; ".join(out)


def _udf(f: Callable[[str, float], str]):
    def run(values: pd.Series, scales: pd.Series) -> pd.Series:
        return pd.Series([f(v, s) if v is not None else None for v, s in zip(values, scales, strict=True)], dtype="object")

    run.__annotations__ = {"values": pd.Series, "scales": pd.Series, "return": pd.Series}
    return pandas_udf(run, "string")


def _either(c: Column, plain: Column, native: Column, f: Callable[[str, float], str], scale: Column) -> Column:
    """The native expression where a text is plain enough for it; only the other texts go to Python."""
    plain = F.coalesce(plain, F.lit(True))
    return F.when(plain, native).otherwise(_udf(f)(F.when(~plain, c), scale.cast("double")))


#: Kinds of bytes in paths: digits, the point, signs, commands, arcs; _ODD ones (exponents, NaN and null, not ASCII) are left to the plain function.
_DIGIT, _POINT, _SIGN, _COMMAND, _ARC_COMMAND, _ODD = 1, 2, 3, 4, 5, 6
_KINDS = bytes(
    next((k for k, own in ((_DIGIT, b"0123456789"), (_POINT, b"."), (_SIGN, b"+-"), (_ARC_COMMAND, b"Aa"), (_COMMAND, b"MmLlHhVvCcSsQqTtZz"), (_ODD, b"eENn")) if c in own), _ODD if c > 127 else 0)
    for c in range(256)
)
#: Arguments of each command as a token; -1 is what looks like a number and has no digit. All other tokens are numbers.
_TOKENS = {x: n for k, n in ARGUMENTS.items() for x in (k, k.lower())} | dict.fromkeys((".", "-.", "+."), -1)
_NUMBER = 99
#: Bytes read at a time, numbers remembered, rounds of parting flags, and how many texts of one scale are worth arrays.
_PORTION, _REMEMBERED, _ROUNDS, _FEW = 1 << 19, 100_000, 16, 32


class _Numbers(dict):
    """The text of a number to its mapped text; what is a command stays."""

    def __init__(self, f: Callable[[float], str]):
        super().__init__()
        self.f = f

    def __missing__(self, token: str) -> str:
        if len(self) >= _REMEMBERED:
            self.clear()
        self[token] = out = token if token in _TOKENS else self.f(float(token))
        return out


def _ranges(starts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of ranges beside each other: each item, and its place in its range."""
    place = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    return np.repeat(starts, counts) + place, place


def _part_flags(data: np.ndarray, kind: np.ndarray, run: np.ndarray, first: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """Marks in `first` where what sticks to a flag of an arc begins. Returns the bytes of flags that are left as they are."""
    for _ in range(_ROUNDS):
        at = np.flatnonzero(first)
        k = kind[at]
        edge = k >= _COMMAND
        edge[(t := np.searchsorted(at, texts))[t < len(at)]] = True
        edges = np.flatnonzero(edge)
        arcs = k[edges] == _ARC_COMMAND
        counts = np.diff(edges, append=len(at))[arcs] - 1
        items, place = _ranges(edges[arcs] + 1, counts)
        place %= 7
        flags = at[items]
        more = np.minimum(flags + 1, len(data) - 1)
        stuck = ((place == 3) | (place == 4)) & (data[flags] >> 1 == 24) & (more > flags) & run[more] & ~first[more]
        if not stuck.any():
            return flags[:0]
        own = np.repeat(np.arange(len(counts)), counts)[stuck]
        first[flags[stuck][np.r_[True, own[1:] != own[:-1]]] + 1] = True
    return flags[stuck]


def _mapped_portion(data: np.ndarray, ends: np.ndarray, numbers: _Numbers) -> tuple[pa.Array, np.ndarray]:
    """Mapped paths of texts that lie beside each other, and which of them have to be read by the plain function."""
    texts, n = ends[:-1], len(data)
    kind = np.frombuffer(data.tobytes().translate(_KINDS), np.uint8)
    odd = np.zeros(len(texts), bool)
    of = lambda at: np.searchsorted(texts, at, "right") - 1
    if len(at := np.flatnonzero(kind == _ODD)):
        odd[of(at)] = True
    begins = np.zeros(n + 1, bool)
    begins[texts] = True
    # a token is a command, or a run of digits and points with the sign before it; a second point begins another token
    run = (kind == _DIGIT) | (kind == _POINT)
    sign = kind == _SIGN
    sign[:-1] &= run[1:] & ~begins[1:n]
    sign[-1:] = False
    first = run.copy()
    first[1:] &= ~run[:-1] | begins[1:n]
    points = np.flatnonzero(kind == _POINT)
    of_run = np.cumsum(first, dtype=np.int32)[points]
    first[points[1:][of_run[1:] == of_run[:-1]]] = True
    first[1:] &= ~sign[:-1]
    command = (kind == _COMMAND) | (kind == _ARC_COMMAND)
    first |= sign | command
    has_arcs = bool((kind == _ARC_COMMAND).any())
    if has_arcs and len(left := _part_flags(data, kind, run, first, texts)):
        odd[of(left)] = True
    inside = run | sign | command
    starts = np.flatnonzero(first[inside])
    held = data[inside]
    bounds = np.append(starts, len(held)).astype(np.int32)
    tokens = pa.StringArray.from_buffers(len(starts), pa.py_buffer(bounds), pa.py_buffer(held)).dictionary_encode()
    codes, distinct = tokens.indices.to_numpy(), tokens.dictionary.to_pylist()
    arity = np.array([_TOKENS.get(t, _NUMBER) for t in distinct], np.int8)
    per = np.searchsorted(np.flatnonzero(first), ends)
    takes = arity[codes]
    if (arity == -1).any():
        odd[np.searchsorted(per[:-1], np.flatnonzero(takes == -1), "right") - 1] = True
    # parts of a command and what follows it; numbers before the first command have none, and are dropped
    edge = takes < 8
    edge[(t := per[:-1])[t < len(codes)]] = True
    edges = np.flatnonzero(edge)
    counts, wants = np.diff(edges, append=len(codes)), takes[edges]
    used = np.where(wants == _NUMBER, 0, 1 + np.where(wants > 0, (counts - 1) // np.maximum(wants, 1) * wants, 0))
    outs = list(map(numbers.__getitem__, distinct))
    if has_arcs:
        codes = codes.copy()
        arcs = wants == 7
        items, place = _ranges(edges[arcs] + 1, used[arcs] - 1)
        place %= 7
        for at, say in ((items[place == 2], lambda t: str(float(t))), (items[(place == 3) | (place == 4)], lambda t: str(int(float(t))))):
            here = np.zeros(len(distinct), bool)
            here[codes[at]] = True
            own = np.flatnonzero(here)
            new = np.zeros(len(distinct), codes.dtype)
            new[own] = len(outs) + np.arange(len(own))
            codes[at] = new[codes[at]]
            outs += [say(distinct[i]) for i in own]
    if (used != counts).any():
        items, _ = _ranges(edges, used)
        codes, per = codes[items], np.searchsorted(items, per)
    said = pa.array(outs, pa.large_string()).take(pa.array(codes))
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(per, pa.int32()), said), pa.scalar(" ", pa.large_string())), odd


def _paths_mapped(paths: pa.Array, numbers: _Numbers, plain: Callable[[str], str]) -> pa.Array:
    """Paths, none of them null, in portions of some hundred thousand bytes or of one path."""
    paths = paths.cast(pa.large_string())
    ends = np.frombuffer(paths.buffers()[1], np.int64)[paths.offset : paths.offset + len(paths) + 1]
    data = np.frombuffer(paths.buffers()[2] or b"", np.uint8)
    out, i = [], 0
    while i < len(paths):
        j = max(i + 1, int(np.searchsorted(ends, ends[i] + _PORTION, "right")) - 1)
        own = ends[i : j + 1]
        done, odd = _mapped_portion(data[own[0] : own[-1]], own - own[0], numbers) if own[-1] > own[0] else (paths.slice(i, j - i), np.zeros(j - i, bool))
        odd |= np.diff(own) < 2
        if odd.any():
            done = pc.replace_with_mask(done, pa.array(odd), pa.array([plain(paths[i + int(k)].as_py()) for k in np.flatnonzero(odd)], pa.large_string()))
        out.append(done)
        i = j
    return pa.concat_arrays(out)


def _path(c: Column, scale: Column | float, f: Callable[[str, float], str], number: Callable[[float, float], str]) -> Column:
    """Paths mapped in batches; `f` is the plain function of one path, `number` that of one number. No scale, no path.

    By a scale that is a plain number, one mapping of another's result shares its trip to Python.
    """
    known: dict[float, _Numbers] = {}

    def by_one(paths: pa.Array, s: float) -> pa.Array:
        if len(paths) < _FEW or not s:
            return pa.array([f(t, s) for t in paths.to_pylist()], pa.large_string())
        if s not in known:
            if len(known) >= 4:
                known.clear()
            known[s] = _Numbers(lambda v: number(v, s))
        return _paths_mapped(paths, known[s], lambda t: f(t, s))

    def spread(done: pa.Array, there: pa.Array) -> pa.Array:
        if len(done) == len(there):
            return done
        there = there.to_numpy(zero_copy_only=False)
        return done.take(pa.array(np.cumsum(there) - 1, mask=~there))

    def run(paths: pa.Array) -> pa.Array:
        there = paths.is_valid()
        return spread(by_one(paths.filter(there), scale), there).cast(paths.type)

    def run_by(paths: pa.Array, scales: pa.Array) -> pa.Array:
        there = pc.and_(paths.is_valid(), scales.is_valid())
        paths, scales = paths.filter(there), scales.filter(there).to_numpy(zero_copy_only=False)
        order = np.argsort(scales, kind="stable")
        at = np.split(order, np.flatnonzero(np.diff(scales[order]) != 0) + 1)
        done = pa.concat_arrays([by_one(paths.take(pa.array(i)), float(scales[i[0]])) for i in at if len(i)] or [pa.array([], pa.large_string())])
        return spread(done.take(pa.array(np.argsort(order))), there).cast(paths.type)

    if isinstance(scale, Column):
        run_by.__annotations__ = {"paths": pa.Array, "scales": pa.Array, "return": pa.Array}
        return arrow_udf(run_by, "string")(c, scale.cast("double"))
    run.__annotations__ = {"paths": pa.Array, "return": pa.Array}
    return arrow_udf(run, "string")(c)


def _two(v: Column) -> Column:
    """At most two decimals, at least one."""
    return F.regexp_replace(fixed(v, 2), "0$", "")


def scale_path(c: Column, scale: Column | float) -> Column:
    return _path(c, scale, path_scaled, lambda v, s: _one_decimal(v * s))


def unscale_path(c: Column, scale: Column | float) -> Column:
    return _path(c, scale, path_unscaled, lambda v, s: _two_decimals(v / s))


#: Translations and rotations by numbers of usual size; other functions, and numbers that print otherwise, go to Python.
_USUAL = r"^(?:[\s,]*(?:translate|rotate)\s*\((?:[\s,]*[-+]?(?:\d{1,6}(?:\.\d*)?|\.\d+)(?:deg|px)?)+[\s,]*\))*[\s,]*$"
_TINY = r"(?<![\d.])0*\.00"


def _transform(c: Column, f: Callable[[str, float], str], scale: Column, number: Callable[[Column], Column]) -> Column:
    def one(name: Column, inner: Column) -> Column:
        args = F.regexp_extract_all(inner, F.lit(r"[-+]?(?:\d+\.?\d*|\.\d+)"), F.lit(0))
        turn = name == "rotate"
        said = F.transform(F.slice(args, 1, F.when(turn, 3).otherwise(2)), lambda x, i: F.when(turn & (i == 0), x.cast("double").cast("string")).otherwise(number(x.cast("double"))))
        return F.concat(name, F.lit("("), F.array_join(said, ", "), F.lit(")"))

    call = F.lit(_CALL.pattern)
    calls = F.zip_with(F.regexp_extract_all(c, call, F.lit(1)), F.regexp_extract_all(c, call, F.lit(2)), one)
    between = F.split(c, _CALL.pattern)
    native = F.array_join(F.zip_with(between, calls, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    return _either(c, c.rlike(_USUAL) & ~c.rlike(_TINY), native, f, scale)


def scale_transform(c: Column, scale: Column) -> Column:
    return _transform(c, lambda t, s: transform_mapped(t, lambda v: round(v * s, 1)), scale, lambda v: fixed(v * scale, 1))


def unscale_transform(c: Column, scale: Column) -> Column:
    native = _transform(c, lambda t, s: transform_mapped(t, lambda v: round(v / s, 2)) if s else t, scale, lambda v: _two(v / F.nullif(scale, F.lit(0.0))))
    return F.when(scale == 0, c).otherwise(native)


def _style(c: Column, number: Callable[[Column], Column]) -> Column:
    """Declarations as an array; only those of a length of font-size or stroke-width change."""
    items = F.filter(F.transform(F.split(c, ";"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")
    pattern = r"(?i)^(font-size|stroke-width)\s*:\s*([-+]?(?:\d+\.?\d*|\.\d+)(?:e[-+]?\d+)?)\s*(px|rem|em)?$"

    def one(x: Column) -> Column:
        unit = F.when(F.lower(F.regexp_extract(x, pattern, 3)).isin("em", "rem"), 16.0).otherwise(1.0)
        v = F.regexp_extract(x, pattern, 2).try_cast("double") * unit
        return F.when(x.rlike(pattern), F.concat(F.regexp_extract(x, pattern, 1), F.lit(": "), number(v), F.lit("px"))).otherwise(x)

    return F.when(c == "", c).otherwise(F.array_join(F.transform(items, one), "; "))


def scale_style(c: Column, scale: Column) -> Column:
    return _style(c, lambda v: fixed(v * scale, 1))


def unscale_style(c: Column, scale: Column) -> Column:
    return F.when(scale == 0, c).otherwise(_style(c, lambda v: _two(v / F.nullif(scale, F.lit(0.0)))))


def scale_points(c: Column, scale: Column) -> Column:
    """Points as x,y pairs, scaled to one decimal; an odd number at the end is dropped."""
    v = F.transform(every(c, COORDINATE), lambda x: fixed(x.try_cast("double") * scale, 1))
    pairs = F.transform(F.filter(v, lambda x, i: i % 2 == 0), lambda x, i: F.concat(x, F.lit(","), F.get(v, 2 * i + 1)))
    return F.array_join(F.filter(pairs, lambda x: x.isNotNull()), " ")


_ARC = r"(?i)^\s*M\s+([\d.\-]+)\s+([\d.\-]+)\s+A\s+([\d.\-]+)\s+([\d.\-]+)\s+0\s+1\s+1\s+([\d.\-]+)\s+([\d.\-]+)\s*Z\s*$"
_NUM = r"([-+]?(?:\d+(?:\.\d*)?|\.\d+)(?:[eE][-+]?\d+)?)"
_FULL = rf"^\s*M\s*{_NUM}[ ,]+{_NUM}\s*A\s*{_NUM}[ ,]+{_NUM}[ ,]+{_NUM}[ ,]+1[ ,]+1[ ,]+{_NUM}[ ,]+{_NUM}\s*[zZ]?\s*$"


def arc_circle(d: Column) -> Column:
    """(cx, cy, r) of a path that is one large arc back to nearly its start, drawn from the top; else null."""
    x1, y1, rx, ry, x2, y2 = (F.regexp_extract(d, _ARC, k).try_cast("double") for k in range(1, 7))
    ok = d.rlike(_ARC) & (F.abs(rx - ry) < 0.01) & (F.abs(x1 - x2) < 0.1) & (F.abs(y1 - y2) < 0.1)
    return F.when(ok, F.struct(x1.alias("cx"), (y1 + rx).alias("cy"), rx.alias("r")))


def arc_ellipse(d: Column) -> Column:
    """(cx, cy, rx, ry) of a path that is one arc of a full turn, drawn from the right, axes upright; else null."""
    x1, y1, rx, ry, turn, x2, y2 = (F.regexp_extract(d, _FULL, k).try_cast("double") for k in range(1, 8))
    upright = F.abs(turn % 360) <= 1e-9
    close = lambda a, b: F.abs(a - b) <= F.greatest(F.lit(1e-7), 1e-9 * F.greatest(F.abs(a), F.abs(b)))
    ok = d.rlike(_FULL) & (rx > 0) & (ry > 0) & upright & close(x1, x2) & close(y1, y2)
    return F.when(ok, F.struct((x1 - rx).alias("cx"), y1.alias("cy"), rx.alias("rx"), ry.alias("ry")))


def axis_extent(d: Column) -> Column:
    """The largest number of an axis path: where its line ends."""
    return F.array_max(F.transform(every(d, _NUM, 0), lambda x: x.try_cast("double")))


def numbers_text(c: Column) -> Column:
    return F.array_join(F.transform(every(c, COORDINATE), token_number), " ")


def path_token_text(d: Column) -> Column:
    """[command]numbers of each command; the exponent of a number is no command."""
    pattern = rf"([MmLlHhVvCcSsQqTtAaZz])((?:[\s,]*{COORDINATE})*)"
    parts = F.zip_with(every(d, pattern, 1), every(d, pattern, 2), lambda c, a: F.concat(F.lit("["), c, F.lit("]"), numbers_text(a), F.lit(" ")))
    return F.array_join(parts, "")
