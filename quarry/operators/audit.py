"""Audit of charts against drawing rules, with repairs where asked for, and its summary by dataset."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, fields

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tree import Element, classes, parents, parse, serialize, styles

# Values that are none, classes of axes and traces, overflows that clip, the dataset whose traces are checked.
INVALID = ("null", "undefined", "nan", "infinity", "-infinity")
INVALID_STYLE = r"(?:^|;)\s*[-\w]+\s*:\s*(?:null|undefined|nan|[-+]?infinity)\s*(?=;|$)"
X_AXIS = r"(?:^|[\s_-])x(?:axis|axes)(?:$|[\s_-])|xaxislayer|highcharts-xaxis|axis-grid\s+x"
Y_AXIS = r"(?:^|[\s_-])y(?:axis|axes)(?:$|[\s_-])|yaxislayer|highcharts-yaxis|axis-grid\s+y"
TRACE = r"(?:^|\s)(?:trace|scatter|bar|box|violin|histogram)(?:\s|$)"
CLIPPED = ("hidden", "clip", "auto")
TRACED = "plotly_export"
CANVAS = "512"

_style, _x, _y, _trace = (re.compile(p, re.I) for p in (INVALID_STYLE, X_AXIS, Y_AXIS, TRACE))


@dataclass
class Findings:
    parse_error: str = ""
    invalid_attributes: int = 0
    canvas_not_512: int = 0
    root_overflow_unclipped: int = 0
    has_x_axis: int = 0
    has_y_axis: int = 0
    missing_cartesian_axis: str = ""
    unclipped_plotly_layers: int = 0
    fixed: int = 0


def invalid_values(root: Element, fix: bool) -> int:
    """Attributes whose value is none, and styles with declarations of none: one for each of either."""
    found = 0
    for e in root.iter():
        none = [k for k, v in e.attrib.items() if v.strip().lower() in INVALID]
        style = _style.sub("", e.get("style", "")).strip(" ;")
        spoilt = style != e.get("style", "").strip(" ;")
        found += len(none) + spoilt
        if fix:
            if spoilt and style:
                e.set("style", style)
            for k in [*none, *(["style"] if spoilt and not style else [])]:
                e.attrib.pop(k, None)
    return found


def off_canvas(root: Element) -> bool:
    """Whether the drawing lacks a view box of positive size or is not shown at 512 by 512."""
    box = root.get("viewBox", "").replace(",", " ").split()
    try:
        good = len(box) == 4 and float(box[2]) > 0 and float(box[3]) > 0
    except ValueError:
        good = False
    return not (good and root.get("width") == root.get("height") == CANVAS)


def overflows(root: Element) -> bool:
    """Whether the root says an overflow that does not clip; the attribute counts before the style."""
    said = root.get("overflow") or {k.lower(): v for k, v in styles(root.get("style")).items()}.get("overflow", "")
    return bool(said) and said.lower() not in CLIPPED


def axes(root: Element) -> tuple[bool, bool]:
    """Whether the classes of all elements, as one text in document order, name an x and a y axis."""
    text = " ".join(e.get("class", "") for e in root.iter())
    return bool(_x.search(text)), bool(_y.search(text))


def plot_clip(root: Element) -> str | None:
    """The id of the clip of the plot, where there is just one that holds a rectangle."""
    found = [c.get("id") for c in root.iter("clipPath") if c.get("id") and ("plotclip" in c.get("class", "").lower() or "plot" in c.get("id", "").lower()) and c.find("rect") is not None]
    return found[0] if len(found) == 1 else None


def unclipped_layers(root: Element, fix: bool) -> tuple[int, bool]:
    """Traces that neither they nor any element around them clip, and whether a clip was set for one.

    The clip goes to the nearest element around a trace (or itself) with the class of plots, else to the trace.
    """
    up, clip, found, changed = parents(root), plot_clip(root), 0, False
    for e in root.iter():
        if not _trace.search(e.get("class", "")):
            continue
        chain = [e]
        while chain[-1] in up:
            chain.append(up[chain[-1]])
        if any(a.get("clip-path") for a in chain):
            continue
        found += 1
        if fix and clip:
            next((a for a in chain if a is not root and "plot" in classes(a)), e).set("clip-path", f"url(#{clip})")
            changed = True
    return found, changed


def audit(text: str, dataset: str | None, fix: bool = False) -> tuple[Findings, str]:
    """What breaks the rules, and the document: with `fix`, repaired where it can be. Only well-formed ones are read."""
    try:
        ET.fromstring(text.encode("utf-8") if text.lstrip().startswith("<?xml") else text)
    except (ET.ParseError, ValueError) as x:
        return Findings(parse_error=f"{type(x).__name__}: {x}"), text
    root, _ = parse(text)
    assert root is not None
    out = Findings(invalid_attributes=invalid_values(root, fix))
    changed = out.invalid_attributes > 0
    if off_canvas(root):
        out.canvas_not_512, changed = 1, True
        if fix:
            root.attrib |= {"viewBox": f"0 0 {CANVAS} {CANVAS}", "width": CANVAS, "height": CANVAS}
    if overflows(root):
        out.root_overflow_unclipped, changed = 1, True
        if fix:
            root.set("overflow", "hidden")
    x, y = axes(root)
    out.has_x_axis, out.has_y_axis = int(x), int(y)
    out.missing_cartesian_axis = "" if x == y else "y" if x else "x"
    if dataset == TRACED and x and y:
        out.unclipped_plotly_layers, clipped = unclipped_layers(root, fix)
        changed |= clipped
    out.fixed = int(fix and changed)
    return out, serialize(root) if out.fixed else text


_KINDS = {f.name: (pa.string() if f.type == "str" else pa.int32()) for f in fields(Findings)}


def audited(df: DataFrame, column: str, dataset: str, fix: bool = False) -> DataFrame:
    """`df` with the findings for each document of a column, and with `fix` the column repaired.

    One pass without a shuffle; each document is parsed once more than checked. A null document is one of no text.
    """
    names = [c for c in df.columns if c not in _KINDS]
    schema = ", ".join([f"`{c}` {df.schema[c].dataType.simpleString()}" for c in names] + [f"{k} {'string' if pa.types.is_string(t) else 'int'}" for k, t in _KINDS.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [audit(text or "", d, fix) for text, d in zip(batch.column(column).to_pylist(), batch.column(dataset).to_pylist(), strict=True)]
            cols = [pa.array([t for _, t in found], pa.string()) if fix and c == column else batch.column(c) for c in names]
            cols += [pa.array([getattr(f, k) for f, _ in found], t) for k, t in _KINDS.items()]
            yield pa.RecordBatch.from_arrays(cols, [*names, *_KINDS])

    return df.select(*names).mapInArrow(run, schema)


def summary(findings: DataFrame, by: Sequence[str] = ("dataset",)) -> DataFrame:
    """Counts of findings for each dataset; partial sums before the shuffle."""
    total = lambda c: F.sum(c).alias(c)
    some = lambda c, name: F.count_if(F.col(c) != "").alias(name)
    return findings.groupBy(*by).agg(
        F.count("*").alias("checked"),
        some("parse_error", "parse_errors"),
        total("invalid_attributes"),
        total("canvas_not_512"),
        total("root_overflow_unclipped"),
        some("missing_cartesian_axis", "missing_cartesian_axis"),
        total("unclipped_plotly_layers"),
        F.sum("fixed").alias("files_fixed"),
    )
