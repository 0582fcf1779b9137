"""A small rasterizer: shapes, lines and paths of a drawing as pixels.

No text, no gradients, no smoothing of edges; lines have round ends and corners.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quarry.functions.geometry import ARGUMENTS, parse_path

from .tree import Element, parse, styles, unit_pixels, view_box

#: Markup longer than this is not rendered.
LONGEST = 150_000
NAMED = {"black": 0x000000, "white": 0xFFFFFF, "red": 0xFF0000, "green": 0x008000, "blue": 0x0000FF, "gray": 0x808080, "grey": 0x808080, "yellow": 0xFFFF00, "orange": 0xFFA500}
_STEPS = 16
_NUMBER = re.compile(r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?")


def colour(text: str | None) -> tuple[int, int, int] | None:
    """Red, green and blue of a paint; null for none and for what is no plain colour."""
    t = (text or "").strip().lower()
    if m := re.fullmatch(r"#([0-9a-f]{3}|[0-9a-f]{6})", t):
        h = m[1] if len(m[1]) == 6 else "".join(2 * c for c in m[1])
        v = int(h, 16)
    elif m := re.fullmatch(r"rgb\(\s*(\d+)\s*,\s*(\d+)\s*,\s*(\d+)\s*\)", t):
        return min(255, int(m[1])), min(255, int(m[2])), min(255, int(m[3]))
    elif t in NAMED:
        v = NAMED[t]
    else:
        return None
    return v >> 16, v >> 8 & 255, v & 255


def matrix(text: str | None) -> np.ndarray:
    """The 3 x 3 matrix of a transform list."""
    out = np.eye(3)
    for name, inner in re.findall(r"(\w+)\s*\(([^)]*)\)", text or ""):
        a = [float(x) for x in _NUMBER.findall(inner)]
        m = np.eye(3)
        if name == "translate" and a:
            m[:2, 2] = a[0], a[1] if len(a) > 1 else 0.0
        elif name == "scale" and a:
            m[0, 0], m[1, 1] = a[0], a[1] if len(a) > 1 else a[0]
        elif name == "rotate" and a:
            c, s = math.cos(math.radians(a[0])), math.sin(math.radians(a[0]))
            m[:2, :2] = [[c, -s], [s, c]]
            if len(a) == 3:
                x, y = a[1:]
                m[:2, 2] = x - c * x + s * y, y - s * x - c * y
        elif name == "matrix" and len(a) == 6:
            m[:2] = [[a[0], a[2], a[4]], [a[1], a[3], a[5]]]
        out = out @ m
    return out


def _curve(points: list[complex]) -> list[complex]:
    """Points along a Bezier curve, without the first."""
    out = []
    for k in range(1, _STEPS + 1):
        row, t = points, k / _STEPS
        while len(row) > 1:
            row = [p + (q - p) * t for p, q in zip(row[:-1], row[1:], strict=True)]
        out.append(row[0])
    return out


def _arc(a: complex, rx: float, ry: float, turn: float, large: bool, sweep: bool, b: complex) -> list[complex]:
    """Points along an elliptical arc from a to b, without the first."""
    rx, ry = abs(rx), abs(ry)
    if not rx or not ry or a == b:
        return [b]
    spin = complex(math.cos(math.radians(turn)), math.sin(math.radians(turn)))
    d = (a - b) / 2 / spin
    x, y = d.real / rx, d.imag / ry
    over = x * x + y * y
    if over > 1:
        rx, ry, over = rx * math.sqrt(over), ry * math.sqrt(over), 1.0
        x, y = d.real / rx, d.imag / ry
    k = math.sqrt(max(0.0, 1 / over - 1)) * (-1 if large == sweep else 1)
    centre = complex(k * y, -k * x)  # on the unit circle
    at = lambda p: math.atan2(p.imag, p.real)
    first, last = at(complex(x, y) - centre), at(complex(-x, -y) - centre)
    if sweep and last < first:
        last += 2 * math.pi
    if not sweep and last > first:
        last -= 2 * math.pi
    middle = (a + b) / 2
    out = []
    for step in range(1, 2 * _STEPS + 1):
        w = first + (last - first) * step / (2 * _STEPS)
        p = centre + complex(math.cos(w), math.sin(w))
        out.append(complex(p.real * rx, p.imag * ry) * spin + middle)
    return out


def outlines(d: str) -> list[tuple[list[complex], bool]]:
    """The subpaths of a path as lines of points, and whether each is closed."""
    out: list[tuple[list[complex], bool]] = []
    now, start, last, kind = 0j, 0j, 0j, ""
    for cmd, args in parse_path(d):
        upper, n = cmd.upper(), ARGUMENTS[cmd.upper()]
        if upper == "Z":
            if out:
                out[-1] = (out[-1][0], True)
            now = start
            kind = "Z"
            continue
        v = [float(a) for a in args]
        for k in range(0, len(v) - n + 1, n):
            own, at = v[k : k + n], 0j if cmd.isupper() else now
            if upper == "M" and k == 0:
                now = start = at + complex(*own)
                out.append(([now], False))
                kind = "M"
                continue
            if not out or out[-1][1]:
                out.append(([now], False))
            if upper in "ML" or upper == "M":
                points = [at + complex(*own)]
            elif upper == "H":
                points = [complex(own[0] + at.real, now.imag)]
            elif upper == "V":
                points = [complex(now.real, own[0] + at.imag)]
            elif upper == "A":
                points = _arc(now, own[0], own[1], own[2], bool(own[3]), bool(own[4]), at + complex(*own[5:]))
            else:
                given = [at + complex(*own[i : i + 2]) for i in range(0, n, 2)]
                if upper in "ST":
                    given = [2 * now - last if kind in ("CS" if upper == "S" else "QT") else now, *given]
                points, last = _curve([now, *given]), given[-2]
            out[-1][0].extend(points)
            now, kind = points[-1], upper
    return out


def _inside(shapes: list[np.ndarray], x: np.ndarray, y: np.ndarray, even_odd: bool) -> np.ndarray:
    """Which pixel centres lie inside the closed lines, by winding number (or its parity)."""
    wind = np.zeros((len(y), len(x)), np.int32)
    for p in shapes:
        for a, b in zip(p, np.roll(p, -1), strict=True):
            if a.imag == b.imag:
                continue
            up = 1 if b.imag > a.imag else -1
            lo, hi = sorted((a.imag, b.imag))
            rows = np.flatnonzero((y >= lo) & (y < hi))
            if len(rows):
                cross = a.real + (y[rows] - a.imag) * (b.real - a.real) / (b.imag - a.imag)
                wind[rows] += up * (x[None, :] > cross[:, None])
    return wind % 2 != 0 if even_odd else wind != 0


def _near(shapes: list[tuple[np.ndarray, bool]], x: np.ndarray, y: np.ndarray, reach: float) -> np.ndarray:
    """Which pixel centres lie within `reach` of the lines."""
    hit = np.zeros((len(y), len(x)), bool)
    for p, closed in shapes:
        for a, b in zip(p if closed else p[:-1], np.roll(p, -1) if closed else p[1:], strict=True):
            rows = np.flatnonzero((y >= min(a.imag, b.imag) - reach) & (y <= max(a.imag, b.imag) + reach))
            cols = np.flatnonzero((x >= min(a.real, b.real) - reach) & (x <= max(a.real, b.real) + reach))
            if not len(rows) or not len(cols):
                continue
            z = x[cols][None, :] + 1j * y[rows][:, None]
            d = b - a
            t = np.clip(((z - a) * np.conj(d)).real / abs(d) ** 2, 0, 1) if d else 0.0
            hit[np.ix_(rows, cols)] |= np.abs(z - a - t * d) <= reach
    return hit


def _lines(e: Element) -> list[tuple[list[complex], bool]]:
    number = lambda k, d=0.0: unit_pixels(e.get(k)) if unit_pixels(e.get(k)) is not None else d
    if e.tag == "rect":
        x, y, w, h = (number(k) for k in ("x", "y", "width", "height"))
        return [([complex(x, y), complex(x + w, y), complex(x + w, y + h), complex(x, y + h)], True)] if w > 0 and h > 0 else []
    if e.tag in ("circle", "ellipse"):
        rx, ry = (number("r"),) * 2 if e.tag == "circle" else (number("rx"), number("ry"))
        w = np.linspace(0, 2 * np.pi, 16 * _STEPS, endpoint=False)
        return [(list(number("cx") + rx * np.cos(w) + 1j * (number("cy") + ry * np.sin(w))), True)] if rx > 0 and ry > 0 else []
    if e.tag == "line":
        return [([complex(number("x1"), number("y1")), complex(number("x2"), number("y2"))], False)]
    if e.tag in ("polyline", "polygon"):
        v = [float(k) for k in _NUMBER.findall(e.get("points", ""))]
        points = [complex(a, b) for a, b in zip(v[::2], v[1::2], strict=False)]
        return [(points, e.tag == "polygon")] if points else []
    return outlines(e.get("d", "")) if e.tag == "path" else []


def render(text: str, size: tuple[int, int] | None = None) -> np.ndarray:
    """Height x width x 3 bytes on white, at the drawing's own size or a given one. Raises ValueError for no drawing."""
    root, mode = parse(text)
    if root is None or mode != "strict" or root.tag != "svg":
        raise ValueError("not a drawing")
    box = view_box(root.get("viewBox"))
    w, h = unit_pixels(root.get("width")), unit_pixels(root.get("height"))
    if box is None and not (w and h):
        raise ValueError("neither a view box nor a size in numbers")
    box = box or [0.0, 0.0, float(w or 0), float(h or 0)]
    if box[2] <= 0 or box[3] <= 0:
        raise ValueError("an empty view box")
    wide, high = size or (round(w or box[2]), round(h or box[3]))
    if not 0 < wide <= 8192 or not 0 < high <= 8192:
        raise ValueError("a size out of range")
    scale = min(wide / box[2], high / box[3])
    frame = np.array([[scale, 0, (wide - box[2] * scale) / 2 - box[0] * scale], [0, scale, (high - box[3] * scale) / 2 - box[1] * scale], [0, 0, 1]])
    out = np.full((high, wide, 3), 255, np.uint8)
    x, y = np.arange(wide) + 0.5, np.arange(high) + 0.5

    def put(mask: np.ndarray, paint: tuple[int, int, int], alpha: float) -> None:
        out[mask] = np.round(out[mask] * (1 - alpha) + np.array(paint) * alpha).astype(np.uint8)

    def walk(e: Element, given: dict[str, str], m: np.ndarray, alpha: float) -> None:
        own = {**given, **{k: v for k, v in e.attrib.items() if k in _PAINT}, **{k: v for k, v in styles(e.get("style")).items() if k in _PAINT}}
        if e.tag in ("defs", "clipPath", "text", "linearGradient", "radialGradient") or own.get("display") == "none" or own.get("visibility") == "hidden":
            return
        m = m @ matrix(e.get("transform"))
        alpha *= float(own.pop("opacity", 1) or 1)
        lines = [((np.array([p.real for p in points]) * m[0, 0] + np.array([p.imag for p in points]) * m[0, 1] + m[0, 2]) + 1j * (np.array([p.real for p in points]) * m[1, 0] + np.array([p.imag for p in points]) * m[1, 1] + m[1, 2]), closed) for points, closed in _lines(e)]
        if lines:
            fill = colour(own.get("fill", "black"))
            if fill and e.tag != "line":
                put(_inside([p for p, _ in lines], x, y, own.get("fill-rule") == "evenodd"), fill, alpha * float(own.get("fill-opacity", 1)))
            stroke = colour(own.get("stroke"))
            width = unit_pixels(own.get("stroke-width", "1")) or 0.0
            if stroke and width:
                put(_near(lines, x, y, width * math.sqrt(abs(np.linalg.det(m[:2, :2]))) / 2), stroke, alpha * float(own.get("stroke-opacity", 1)))
        for c in e:
            walk(c, own, m, alpha)

    walk(root, {}, frame, 1.0)
    return out


_PAINT = ("fill", "stroke", "stroke-width", "fill-opacity", "stroke-opacity", "opacity", "fill-rule", "display", "visibility")


def rendered(df: DataFrame, column: str, size: tuple[int, int] | None = None, longest: int = LONGEST) -> DataFrame:
    """`df` with ok, height, width, px (rows of three bytes a pixel) and error for the drawings of a column.

    A drawing that is too long, or fails, has its error and no pixels; the others go on.
    """
    names = [c for c in df.columns if c not in ("ok", "height", "width", "px", "error")]
    schema = ", ".join([f"`{c}` {df.schema[c].dataType.simpleString()}" for c in names] + ["ok boolean, height int, width int, px binary, error string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[tuple] = []
            for text in batch.column(column).to_pylist():
                try:
                    if text is None or len(text) > longest:
                        raise ValueError("too long" if text else "no text")
                    px = render(text, size)
                    found.append((True, px.shape[0], px.shape[1], px.tobytes(), None))
                except (ValueError, IndexError, OverflowError) as e:
                    found.append((False, None, None, None, str(e)))
            kinds = (pa.bool_(), pa.int32(), pa.int32(), pa.binary(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in names] + [pa.array([f[k] for f in found], t) for k, t in enumerate(kinds)], [*names, "ok", "height", "width", "px", "error"])

    return df.select(*names).mapInArrow(run, schema)
