"""Vector markup as trees: parsing with recovery, cleaning, repairs, and the node table.

A document is parsed once and serialized once, in one pass over Arrow batches, however many steps work on it. Trees
have local names; the namespace is written on the root again, and that of links where links are used.
"""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterable, Iterator, Sequence
from html.parser import HTMLParser
from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa
from pyspark.sql import DataFrame

from quarry.functions import geometry as G
from quarry.functions.text import BRANDING_CLASSES, FONT_STACK, INVALID_VALUES

SVG_NS = "http://www.w3.org/2000/svg"
XLINK_NS = "http://www.w3.org/1999/xlink"
CANVAS = 512

# The stylesheet that charts are drawn with where they bring none.
DEFAULT_CSS = """
.axis path, .axis line, .tick line, .domain { fill: none; stroke: #333333; stroke-width: 1px; shape-rendering: crispEdges; }
.grid-line, .grid line, .axis-grid line { stroke: #e6e6e6; stroke-width: 1px; stroke-dasharray: 2, 2; }
text, .axis text, .tick text, .legend text { font-family: sans-serif; font-size: 10px; fill: #333333; }
.highcharts-axis-line, .highcharts-tick, .highcharts-grid-line { stroke: #ccd6eb; fill: none; }
.highcharts-grid-line { stroke-dasharray: 2, 2; }
.highcharts-axis-title, .highcharts-title, .highcharts-subtitle { fill: #333333; font-family: sans-serif; }
.background, .plot-background { fill: #ffffff; }
.gfx-hl-axis .tick line { stroke-dasharray: 2, 2; stroke: #e6e6e6; }
"""
# Attributes that scale with the drawing.
LENGTHS = ("x", "cx", "x1", "x2", "y", "cy", "y1", "y2", "width", "height", "r", "rx", "ry", "font-size", "stroke-width")
STROKES = ("stroke", "stroke-width", "stroke-opacity", "stroke-linecap", "stroke-linejoin", "stroke-miterlimit", "stroke-dasharray", "stroke-dashoffset")
# Labels of ticks that were lost, by chart and place.
TICK_LABELS = {
    "0a7d7e7b-3870-4da2-9bbc-808b205b5bc3": {0: "Q1 '16", 1: "Q2 '16", 2: "Q3 '16", 3: "Q4 '16"},
    "0cc0d53a-afec-447e-95f3-36cf0f0e2508": {2: "Q1 '05", 19: "Q2 '09", 32: "Q2 '12", 47: "Q4 '16"},
}

Element = ET.Element


# --- parsing and writing -------------------------------------------------------------------------------------------


def _local(name: str) -> str:
    if name.startswith("{" + XLINK_NS + "}"):
        return "xlink:" + name.rpartition("}")[2]
    return name.rpartition("}")[2]


class _Recovering(HTMLParser):
    """A tree from text that is not well-formed: unknown closings are ignored, open elements close with their parent."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root: Element | None = None
        self.open: list[Element] = []
        self.names: dict[str, str] = {}

    def handle_starttag(self, tag: str, attrs: list) -> None:
        e = ET.Element(self._case(tag), {self._case(k): v or "" for k, v in attrs if not k.startswith("xmlns")})
        if self.open:
            self.open[-1].append(e)
        elif self.root is None:
            self.root = e
        else:
            return
        self.open.append(e)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        depth = len(self.open)
        self.handle_starttag(tag, attrs)
        del self.open[depth:]

    def handle_endtag(self, tag: str) -> None:
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i].tag.lower() == tag:
                del self.open[i:]
                return

    def handle_data(self, data: str) -> None:
        if self.open:
            e = self.open[-1]
            if len(e):
                e[-1].tail = (e[-1].tail or "") + data
            else:
                e.text = (e.text or "") + data

    def _case(self, name: str) -> str:
        return self.names.get(name, name)

    def feed(self, data: str) -> None:
        self.names = {m.lower(): m for m in re.findall(r"[A-Za-z][\w:.-]*", data) if m != m.lower()}
        super().feed(data)


def parse(text: str) -> tuple[Element | None, str]:
    """(root, mode): strict where the text is well-formed, recovered where not, and None where there is no element."""
    try:
        root = ET.fromstring(text.encode("utf-8") if text.lstrip().startswith("<?xml") else text)
        mode = "strict"
    except (ET.ParseError, ValueError):
        p = _Recovering()
        p.feed(text)
        p.close()
        root, mode = p.root, "recovered"
    if root is not None:
        for e in root.iter():
            if isinstance(e.tag, str):
                e.tag = _local(e.tag)
            if any("}" in k for k in e.attrib):
                e.attrib = {_local(k): v for k, v in e.attrib.items()}
    return root, mode if root is not None else "none"


def serialize(root: Element) -> str:
    out: list[str] = []

    def put(e: Element, attrs: dict[str, str]) -> None:
        out.append("<" + e.tag + "".join(f" {k}={quoteattr(v)}" for k, v in attrs.items()))
        if e.text or len(e):
            out.append(">" + escape(e.text or ""))
            for c in e:
                put(c, c.attrib)
                out.append(escape(c.tail or ""))
            out.append(f"</{e.tag}>")
        else:
            out.append("/>")

    head = {"xmlns": SVG_NS}
    if any(k.startswith("xlink:") for e in root.iter() for k in e.attrib):
        head["xmlns:xlink"] = XLINK_NS
    put(root, head | {k: v for k, v in root.attrib.items() if not k.startswith("xmlns")})
    return "".join(out)


def parents(root: Element) -> dict[Element, Element]:
    return {c: p for p in root.iter() for c in p}


def classes(e: Element) -> list[str]:
    return e.get("class", "").split()


def styles(text: str | None) -> dict[str, str]:
    items = (i.split(":", 1) for i in (text or "").split(";") if ":" in i)
    return {k.strip(): v.strip() for k, v in items}


def style_text(decl: dict[str, str]) -> str:
    return "; ".join(f"{k}: {v}" for k, v in decl.items())


def remove_where(root: Element, cond: Callable[[Element], bool]) -> int:
    """Remove elements (not the root) with all they hold; the text after them stays."""
    gone = 0
    for p in list(root.iter()):
        for i in range(len(p) - 1, -1, -1):
            if cond(p[i]):
                if p[i].tail:
                    if i:
                        p[i - 1].tail = (p[i - 1].tail or "") + p[i].tail
                    else:
                        p.text = (p.text or "") + p[i].tail
                del p[i]
                gone += 1
    return gone


# --- stylesheets ----------------------------------------------------------------------------------------------------


def rules(css: str) -> list[tuple[list[list[tuple[str, frozenset[str]]]], dict[str, str]]]:
    """Selectors (each a list of compounds from ancestor to element) and declarations; names and classes only."""
    out = []
    for heads, body in re.findall(r"([^{}]+)\{([^{}]*)\}", re.sub(r"/\*.*?\*/", "", css, flags=re.S)):
        chains = []
        for head in heads.split(","):
            chain = [re.fullmatch(r"([\w-]*|\*)((?:\.[\w-]+)*)", part) for part in head.split()]
            if chain and all(chain):
                chains.append([(m[1] if m[1] != "*" else "", frozenset(m[2].split(".")[1:])) for m in chain])
        if chains:
            out.append((chains, styles(body)))
    return out


def _fits(chain: list[tuple[str, frozenset[str]]], path: Sequence[Element]) -> bool:
    one = lambda part, e: (not part[0] or part[0] == e.tag) and part[1] <= set(classes(e))
    if not one(chain[-1], path[-1]):
        return False
    left = len(chain) - 2
    for e in reversed(path[:-1]):
        if left >= 0 and one(chain[left], e):
            left -= 1
    return left < 0


def inline_css(root: Element, default: str = DEFAULT_CSS) -> None:
    """Turn stylesheets into style attributes: inline declarations first, then the document's, then the default ones.

    Within a sheet the first rule that sets a property counts. The document's style elements are removed.
    """
    own = "".join("".join(e.itertext()) for e in root.iter("style"))
    ordered = rules(own) + rules(default)
    remove_where(root, lambda e: e.tag == "style")

    def walk(e: Element, path: list[Element]) -> None:
        path = [*path, e]
        decl = styles(e.get("style"))
        for chains, body in ordered:
            if any(_fits(c, path) for c in chains):
                for k, v in body.items():
                    decl.setdefault(k, v)
        if decl:
            e.set("style", style_text(decl))
        for c in e:
            walk(c, path)

    walk(root, [])


# --- cleaning -------------------------------------------------------------------------------------------------------


def _invalid_style(values: Iterable[str]) -> re.Pattern:
    return re.compile(r"(?:^|;)\s*[-\w]+\s*:\s*(?:" + "|".join(map(re.escape, values)) + r")\s*(?=;|$)", re.I)


def drop_invalid_values(root: Element, values: Sequence[str] = ("null", "undefined", "nan")) -> int:
    """Remove attributes, and declarations of styles, whose value is no value."""
    pattern, n = _invalid_style([*values, *(["+infinity"] if "infinity" in values else [])]), 0
    for e in root.iter():
        for k in [k for k, v in e.attrib.items() if v.strip().lower() in values]:
            del e.attrib[k]
            n += 1
        if "style" in e.attrib:
            new = pattern.sub("", e.attrib["style"]).strip(" ;")
            n += new != e.attrib["style"].strip(" ;")
            e.set("style", new)
            if not new:
                del e.attrib["style"]
    return n


def href(e: Element) -> str:
    return e.get("xlink:href") or e.get("href") or ""


def drop_vector_fonts(root: Element) -> None:
    """Remove glyph outlines of known fonts in definitions, and what uses them."""
    glyphs = {p.get("id") for d in root.iter("defs") for p in d if p.tag == "path" and ("DejaVu" in p.get("id", "") or "Bitstream" in p.get("id", ""))}
    remove_where(root, lambda e: (e.tag == "path" and e.get("id") in glyphs) or (e.tag == "use" and href(e)[:1] == "#" and href(e)[1:] in glyphs))


def drop_accessibility(root: Element) -> None:
    """Remove descriptions, aria attributes, roles, and attributes that say the default."""
    remove_where(root, lambda e: e.tag in ("desc", "title", "accessibility"))
    for e in root.iter():
        a = {k: v.strip() for k, v in e.attrib.items()}
        gone = {k for k in a if k.startswith("aria-") or k == "role"}
        gone |= {k for k in ("opacity", "fill-opacity", "stroke-opacity") if a.get(k) in ("1", "1.0")}
        gone |= {"stroke-dasharray"} if a.get("stroke-dasharray") == "none" else set()
        gone |= {"stroke-width", "stroke"} if a.get("stroke-width") in ("0", "0.0", "0px") else set()
        for k in gone & a.keys():
            del e.attrib[k]


def drop_line_markers(root: Element) -> None:
    """Remove the markers of series that are drawn as lines."""
    lines = set()
    for e in root.iter():
        if "highcharts-series" in e.get("class", ""):
            for g in e.iter():
                if g is not e and "highcharts-graph" in g.get("class", ""):
                    width = g.get("stroke-width") or styles(g.get("style")).get("stroke-width", "")
                    m = re.match(r"\d*\.?\d+", width)
                    if m and float(m[0]) > 0:
                        lines |= {c for c in classes(e) if re.fullmatch(r"highcharts-series-\d+", c)}
    remove_where(root, lambda e: "highcharts-markers" in e.get("class", "") and bool(lines & set(classes(e))))


_NEAR_CIRCLE = re.compile(r"^\s*M\s+([\d.\-]+)\s+([\d.\-]+)\s+A\s+([\d.\-]+)\s+([\d.\-]+)\s+0\s+1\s+1\s+([\d.\-]+)\s+([\d.\-]+)\s*Z\s*$", re.I)


def circles_from_arcs(root: Element) -> int:
    n = 0
    for e in root.iter("path"):
        if m := _NEAR_CIRCLE.match(e.get("d", "")):
            x, y, rx, ry, x2, y2 = map(float, m.groups())
            if abs(rx - ry) < 0.01 and abs(x - x2) < 0.1 and abs(y - y2) < 0.1:
                del e.attrib["d"]
                e.tag = "circle"
                e.attrib |= {"cx": str(x), "cy": str(y + rx), "r": str(rx)}
                n += 1
    return n


def drop_images(root: Element) -> int:
    return remove_where(root, lambda e: e.tag == "image")


def drop_branding(root: Element) -> int:
    marks = [*BRANDING_CLASSES.split("|")[:2], "gfx-mouse-target"]
    return remove_where(root, lambda e: any(m in e.get("class", "") for m in marks))


def prune_ids(root: Element) -> int:
    """Remove ids that nothing refers to."""
    used = {r for e in root.iter() for v in e.attrib.values() for r in re.findall(r"#([\w.-]+)", v)}
    n = 0
    for e in root.iter():
        if "id" in e.attrib and e.attrib["id"] not in used:
            del e.attrib["id"]
            n += 1
    return n


_LENGTH = re.compile(r"^\s*([-+]?(?:\d+\.?\d*|\.\d+)(?:e[-+]?\d+)?)(px|rem|em)?\s*$")


def length_scaled(value: str, scale: float) -> str:
    m = _LENGTH.match(value.lower())
    return str(round(float(m[1]) * (16.0 if m[2] in ("rem", "em") else 1.0) * scale, 1)) if m else value


def scale_geometry(root: Element, scale: float) -> None:
    number = re.compile(r"[-+]?\d*\.?\d+(?:[eE][-+]?\d+)?")
    for e in root.iter():
        for k in LENGTHS:
            if k in e.attrib:
                e.attrib[k] = length_scaled(e.attrib[k], scale)
        if "d" in e.attrib:
            e.attrib["d"] = G.path_scaled(e.attrib["d"], scale)
        if "points" in e.attrib:
            v = [round(float(x) * scale, 1) for x in number.findall(e.attrib["points"])]
            e.attrib["points"] = " ".join(f"{a},{b}" for a, b in zip(v[::2], v[1::2], strict=False))
        if "transform" in e.attrib:
            e.attrib["transform"] = G.transform_mapped(e.attrib["transform"], lambda x: round(x * scale, 1))
        if "style" in e.attrib:
            e.attrib["style"] = G.style_mapped(e.attrib["style"], lambda x: round(x * scale, 1))
        if e is not root and "viewBox" in e.attrib and (box := view_box(e.attrib["viewBox"])):
            e.attrib["viewBox"] = " ".join(str(round(x * scale, 1)) for x in box)


def view_box(text: str | None) -> list[float] | None:
    try:
        v = [float(x) for x in re.split(r"[,\s]+", (text or "").strip()) if x and x.lower() != "null"]
    except ValueError:
        return None
    return v if len(v) == 4 else None


def unit_pixels(text: str | None) -> float | None:
    m = re.match(r"^\s*([-+]?(?:\d+\.?\d*|\.\d+)(?:e[-+]?\d+)?)(px|pt|em|rem)?\s*$", (text or "").lower())
    return float(m[1]) * {None: 1.0, "px": 1.0, "pt": 1.3333, "em": 16.0, "rem": 16.0}[m[2]] if m else None


def dimensions(root: Element) -> tuple[float | None, float | None]:
    if box := view_box(root.get("viewBox")):
        return box[2], box[3]
    w, h = unit_pixels(root.get("width")), unit_pixels(root.get("height"))
    return (w, h) if w and h else (None, None)


def fit(root: Element, target: int = CANVAS) -> tuple[float, float, float]:
    """(scale, pad_x, pad_y) to fit the drawing into a square; without dimensions it stays as it is."""
    w, h = dimensions(root)
    if not w or not h:
        return 1.0, 0.0, 0.0
    s = target / max(w, h)
    return s, (target - w * s) / 2, (target - h * s) / 2


def set_viewport(root: Element, pad_x: float, pad_y: float, scale: float = 1.0, target: int = CANVAS) -> None:
    """A square canvas with a white ground; all but definitions moves into one group with the paddings, and with the
    origin of the old view box taken off."""
    box = view_box(root.get("viewBox")) or [0.0, 0.0, 0.0, 0.0]
    dx, dy = pad_x - box[0] * scale, pad_y - box[1] * scale
    for k in ("width", "height", "viewBox"):
        root.attrib.pop(k, None)
    root.attrib |= {"viewBox": f"0 0 {target} {target}", "width": str(target), "height": str(target)}
    ground = ET.Element("rect", {"width": str(target), "height": str(target), "x": "0", "y": "0", "fill": "white"})
    if abs(dx) > 1e-6 or abs(dy) > 1e-6:
        group = ET.Element("g", {"transform": f"translate({round(dx, 1)} {round(dy, 1)})"})
        moved = [c for c in root if c.tag != "defs"]
        for c in moved:
            root.remove(c)
        group.extend(moved)
        root.append(group)
    root.insert(0, ground)


def drop_identity_transforms(root: Element) -> None:
    for e in root.iter():
        if re.fullmatch(r"matrix\(\s*1(\.0*)?\s*(,\s*0(\.0*)?\s*){2},\s*1(\.0*)?\s*(,\s*0(\.0*)?\s*){2}\)", e.get("transform", "")):
            del e.attrib["transform"]


def normalize(text: str, scale: float | None = None, pad_x: float | None = None, pad_y: float | None = None) -> str:
    """Clean a chart and fit it into the square canvas; text without any element stays as it is."""
    root, _ = parse(text)
    if root is None:
        return text
    inline_css(root)
    drop_invalid_values(root)
    drop_vector_fonts(root)
    drop_accessibility(root)
    drop_line_markers(root)
    circles_from_arcs(root)
    drop_images(root)
    drop_branding(root)
    prune_ids(root)
    s, x, y = fit(root) if scale is None else (scale, pad_x or 0.0, pad_y or 0.0)
    box = root.attrib.get("viewBox")
    scale_geometry(root, s)
    if box is not None:
        root.set("viewBox", box)
    set_viewport(root, x, y, s)
    drop_identity_transforms(root)
    return serialize(root)


def denormalize(text: str, w: float | None, h: float | None, scale: float | None, pad_x: float | None, pad_y: float | None) -> str:
    """Frame a drawing on the canvas by its paddings and give it its old size; without these, the whole canvas."""
    root, _ = parse(re.sub(r"\s+", " ", text.replace("\xa0", " ").replace("​", "")))
    if root is None:
        return text
    for c in list(root):
        if c.tag in ("path", "rect") and (("512" in c.get("d", "") and "H 0" in c.get("d", "")) or (c.get("width"), c.get("height"), c.get("fill")) == ("512", "512", "white")):
            root.remove(c)
            break
    for k in ("width", "height", "viewBox", "x", "y"):
        root.attrib.pop(k, None)
    if None in (w, h, scale, pad_x, pad_y):
        root.attrib |= {"viewBox": "0 0 512 512", "width": "512", "height": "512"}
    else:
        root.attrib |= {"viewBox": f"{pad_x:.2f} {pad_y:.2f} {CANVAS - 2 * pad_x:.2f} {CANVAS - 2 * pad_y:.2f}", "width": str(int(w)), "height": str(int(h))}
    return serialize(root)


def optimize(text: str, digits: int = 1) -> str:
    """A subset of what vector optimizers do: no comments or blank text, numbers rounded, styles as attributes."""
    root, _ = parse(text)
    if root is None:
        return text
    for e in root.iter():
        if e.tag not in ("text", "tspan", "style"):
            e.text = (e.text or "").strip() or None
        e.tail = (e.tail or "") if (e.tail or "").strip() else None
        for k, v in styles(e.attrib.pop("style", None)).items():
            e.attrib.setdefault(k, v)
        for k in LENGTHS:
            if re.fullmatch(r"[-+]?\d*\.\d+", e.get(k, "")):
                e.set(k, f"{round(float(e.get(k)), digits):g}")
        if "d" in e.attrib:
            e.set("d", " ".join(c + (" " if a else "") + " ".join(f"{round(float(x), digits):g}" for x in a) for c, a in G.parse_path(e.get("d"))))
    return serialize(root)


# --- repairs --------------------------------------------------------------------------------------------------------


def domain_axes(root: Element) -> int:
    """Axis domains as plain lines from 0 to their extent, across or down as the axis around them says."""
    up, n = parents(root), 0
    for e in list(root.iter()):
        if e.tag not in ("path", "line") or "domain" not in classes(e):
            continue
        numbers = [float(x) for x in re.findall(r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?", e.get("d", "") or " ".join(e.get(k, "") for k in ("x1", "y1", "x2", "y2")))]
        kind, p = "", up.get(e)
        while p is not None and not kind:
            own = set(classes(p))
            if "axis" in own:
                kind = "across" if own & {"bottom", "top"} else "down" if own & {"left", "right"} else ""
            p = up.get(p)
        if not numbers or not kind:
            continue
        far = f"{max(numbers):g}"
        line = {"x1": "0", "y1": "-0.5", "x2": far, "y2": "-0.5"} if kind == "across" else {"x1": "0", "y1": "0", "x2": "0", "y2": far}
        if e.tag == "line" and all(e.get(k) == v for k, v in line.items()):
            continue
        e.tag = "line"
        e.attrib.pop("d", None)
        e.attrib |= line | {"fill": "none", "stroke": "#bcbcbc", "stroke-width": "1"}
        rest = {k: v for k, v in styles(e.get("style")).items() if k not in ("stroke", "stroke-width", "shape-rendering")}
        e.attrib.pop("style", None)
        if rest:
            e.set("style", style_text(rest))
        n += 1
    return n


def digits12(v: float) -> str:
    return f"{0.0 if abs(v) < 1e-12 else v:.12g}"


_N = r"([-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?)"
_FULL = re.compile(rf"^\s*M\s*{_N}[ ,]+{_N}\s*A\s*{_N}[ ,]+{_N}[ ,]+{_N}[ ,]+1[ ,]+1[ ,]+{_N}[ ,]+{_N}\s*[zZ]?\s*$")
_REVEAL = re.compile(rf"^\s*M\s*{_N}[ ,]+{_N}\s*l\s*0[ ,]+0\s*l\s*0[ ,]+{_N}\s*l\s*0[ ,]+0\s*z\s*$", re.I)


def full_circles(root: Element) -> int:
    """Arcs of a full turn, which renderers drop, as ellipses."""
    n = 0
    for e in root.iter("path"):
        if m := _FULL.match(e.get("d", "")):
            x, y, rx, ry, turn, x2, y2 = map(float, m.groups())
            if rx > 0 and ry > 0 and min(turn % 360, 360 - turn % 360) <= 1e-9 and abs(x - x2) <= 1e-7 and abs(y - y2) <= 1e-7:
                e.tag = "ellipse"
                own = {k: v for k, v in e.attrib.items() if k != "d"}
                e.attrib = {"cx": digits12(x - rx), "cy": digits12(y), "rx": digits12(rx), "ry": digits12(ry)} | own
                n += 1
    return n


def split_paint_order(root: Element) -> int:
    """Where the stroke is painted first, a copy with the stroke only comes before the element without it."""
    import copy

    n = 0
    for p in list(root.iter()):
        for e in list(p):
            if "stroke" in e.get("paint-order", "") and e.get("stroke", "none") not in ("", "none"):
                under = copy.deepcopy(e)
                under.tail = None
                under.set("fill", "none")
                for k in ("paint-order", "id"):
                    under.attrib.pop(k, None)
                for k in (*STROKES, "paint-order"):
                    e.attrib.pop(k, None)
                p.insert(list(p).index(e), under)
                n += 1
    return n


def reveal_clips(root: Element) -> int:
    """Clips of an animation's first frame, of no width, open to the whole canvas; a white ground then comes first."""
    n = 0
    for clip in root.iter("clipPath"):
        for e in clip:
            if e.tag == "path" and _REVEAL.match(e.get("d", "")):
                e.set("d", "M0 0H512V512H0Z")
                n += 1
    if n:
        root.insert(0, ET.Element("rect", {"x": "0", "y": "0", "width": "512", "height": "512", "fill": "white"}))
        root.attrib |= {"viewBox": "0 0 512 512", "width": "512", "height": "512"}
    return n


def line_fills(root: Element) -> int:
    n = 0
    for e in root.iter("path"):
        if "gfx-ln-path" in classes(e) and e.get("fill", "").strip().lower() in ("", *INVALID_VALUES):
            e.set("fill", "none")
            n += 1
    return n


def tick_labels(root: Element, labels: dict[int, str]) -> int:
    """Ticks before the first money label get their label by place; those without one are hidden."""
    n = 0
    for g in (e for e in root.iter("g") if "tick" in classes(e)):
        if "".join(g.itertext()).strip().startswith("$"):
            break
        if n in labels:
            g.attrib.pop("display", None)
            for t in g.iter("text"):
                t.text = labels[n]
                for c in list(t):
                    t.remove(c)
                break
        else:
            g.set("display", "none")
        n += 1
    return n


_CJK = re.compile("[⺀-⿿぀-ヿㇰ-ㇿ㐀-䶿一-鿿豈-﫿]")


def cjk_fonts(root: Element) -> int:
    n = 0
    for e in root.iter("text"):
        if _CJK.search("".join(e.itertext())):
            decl = styles(e.get("style")) | {"font-family": FONT_STACK}
            n += e.get("font-family") != FONT_STACK
            e.attrib |= {"style": style_text(decl), "font-family": FONT_STACK}
    return n


def wrap_raw(text: str) -> str:
    """A drawing set into the canvas as it is, in its own viewport; raises ValueError where it has no size."""
    root, mode = parse(text)
    if root is None or mode != "strict":
        raise ValueError("not well-formed")
    if view_box(root.get("viewBox")) is None:
        size = [re.match(r"\s*[-+]?(\d+\.?\d*|\.\d+)", root.get(k, "")) for k in ("width", "height")]
        if not all(size) or not all(float(m[0]) for m in size):
            raise ValueError("neither a view box nor a size in numbers")
        root.set("viewBox", "0 0 " + " ".join(f"{float(m[0]):g}" for m in size))
    root.attrib |= {"x": "0", "y": "0", "width": "512", "height": "512", "preserveAspectRatio": "xMidYMid meet"}
    out = ET.Element("svg", {"viewBox": "0 0 512 512", "width": "512", "height": "512", "preserveAspectRatio": "xMidYMid meet", "data-raw-normalized": "true", "data-preserve-rendering": "true"})
    out.append(ET.Element("rect", {"x": "0", "y": "0", "width": "512", "height": "512", "fill": "white"}))
    out.append(root)
    return serialize(out)


# --- groups and gradients -------------------------------------------------------------------------------------------


def flatten_groups(root: Element) -> None:
    """Put the children of groups in their place; they inherit what they lack, and transforms are composed."""
    for p in [e for e in root.iter() if e is root or e.tag != "g"]:  # groups are taken apart from what holds them
        i = 0
        while i < len(p):
            g = p[i]
            if g.tag != "g":
                i += 1
                continue
            for c in g:
                both = [t for t in (g.get("transform"), c.get("transform")) if t]
                c.attrib = {**g.attrib, **c.attrib}
                if both:
                    c.set("transform", " ".join(both))
            p[i : i + 1] = list(g)


def simplify_gradients(root: Element, empty: str = "previous") -> None:
    """References to gradients become the first stop's colour, followed through links; gradients are removed.

    A path without a fill takes the mean of all valid fills before it, those given here too ("previous"), stays
    ("skip") or becomes black ("default").
    """
    found = {e.get("id"): e for e in root.iter() if e.tag in ("linearGradient", "radialGradient") and e.get("id")}

    def colour(i: str, seen: frozenset = frozenset()) -> str | None:
        e = found.get(i)
        if e is None or i in seen:
            return None
        stop = next(e.iter("stop"), None)
        if stop is not None and (stop.get("stop-color") or styles(stop.get("style")).get("stop-color")):
            return stop.get("stop-color") or styles(stop.get("style"))["stop-color"]
        return colour(href(e)[1:], seen | {i})

    sums, n = [0, 0, 0], 0
    for e in root.iter("path"):
        fill = e.get("fill")
        if fill and fill.startswith("url(#"):
            if c := colour(fill[5:].rstrip(") ").rstrip("'\"")):
                e.set("fill", c)
        elif fill is None and empty == "previous" and n:
            e.set("fill", "#" + "".join(f"{s // n:02x}" for s in sums))
        elif fill is None and empty == "default":
            e.set("fill", "#000000")
        if m := re.fullmatch(r"#?([0-9a-fA-F]{6})", e.get("fill", "")):
            sums = [s + int(m[1][k : k + 2], 16) for s, k in zip(sums, (0, 2, 4), strict=True)]
            n += 1
    remove_where(root, lambda e: e.tag in ("linearGradient", "radialGradient"))


def unwrap(root: Element) -> str:
    """What the root element holds, without the root."""
    if root.tag != "svg":
        return serialize(root)
    whole = serialize(root)
    return whole[whole.index(">") + 1 : whole.rindex("<")] if len(root) or root.text else ""


# --- DataFrame operators ---------------------------------------------------------------------------------------------


def edited(df: DataFrame, column: str, steps: Sequence[Callable[[Element], object]], out: str = "svg", report: str = "repaired") -> DataFrame:
    """`df` with the documents of a column after the steps, how many changes they report, and parse_mode.

    Each document is parsed and written once. A document without any element stays as it is; nulls stay null.
    """
    names = [c for c in df.columns if c not in (out, report, "parse_mode")]
    kept = df.select(*names) if column in names else df.select(*names, column)
    schema = ", ".join([f"`{c}` {df.schema[c].dataType.simpleString()}" for c in names] + [f"`{out}` string, `{report}` int, parse_mode string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made: list[tuple] = []
            for text in batch.column(column).to_pylist():
                root, mode = parse(text) if text is not None else (None, None)
                if root is None:
                    made.append((text, 0, mode))
                    continue
                n = sum(int(step(root) or 0) for step in steps)
                made.append((serialize(root), n, mode))
            cols = [pa.array([m[k] for m in made], t) for k, t in enumerate((pa.string(), pa.int32(), pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in names] + cols, [*names, out, report, "parse_mode"])

    return kept.mapInArrow(run, schema)


def _made(df: DataFrame, columns: Sequence[str], f: Callable[..., str | None], out: str) -> DataFrame:
    names = [c for c in df.columns if c != out]
    schema = ", ".join([f"`{c}` {df.schema[c].dataType.simpleString()}" for c in names] + [f"`{out}` string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = zip(*[batch.column(c).to_pylist() for c in columns], strict=True)
            made = pa.array([None if v[0] is None else f(*v) for v in values], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in names] + [made], [*names, out])

    return df.select(*names).mapInArrow(run, schema)


def rewritten(df: DataFrame, column: str, f: Callable[[str], str | None], out: str = "svg") -> DataFrame:
    """`df` with each document of a column passed through a function of whole texts; nulls stay null."""
    return _made(df, [column], f, out)


def denormalized(df: DataFrame, column: str, meta: Sequence[str], out: str = "svg") -> DataFrame:
    """`df` with documents framed as before they were normalized; `meta`: width, height, scale and both paddings."""
    return _made(df, [column, *meta], denormalize, out)


def unwrapped(text: str) -> str:
    root, _ = parse(text)
    return text if root is None else unwrap(root)


def wrapped(text: str) -> str | None:
    """As wrap_raw, but null where that fails."""
    try:
        return wrap_raw(text)
    except ValueError:
        return None


NODES = "node_id int, parent_id int, depth int, ord int, tag string, attrs map<string,string>, text string, tail string, path array<int>"


def nodes(df: DataFrame, key: str, column: str) -> DataFrame:
    """The node table: a row for each element in document order, with the ids of its ancestors and its own."""
    kept = df.select(key, column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[dict] = []
            for k, text in zip(batch.column(key).to_pylist(), batch.column(column).to_pylist(), strict=True):
                root, _ = parse(text or "")
                if root is None:
                    continue
                todo, n = [(root, None, 0, 0, [])], 0
                while todo:
                    e, parent, depth, at, path = todo.pop()
                    own = [*path, n]
                    rows.append({key: k, "node_id": n, "parent_id": parent, "depth": depth, "ord": at, "tag": e.tag, "attrs": list(e.attrib.items()), "text": e.text, "tail": e.tail, "path": own})
                    todo += [(c, n, depth + 1, i, own) for i, c in reversed(list(enumerate(e)))]
                    n += 1
            kinds = [batch.schema.field(key).type, pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.map_(pa.string(), pa.string()), pa.string(), pa.string(), pa.list_(pa.int32())]
            fields = [key, "node_id", "parent_id", "depth", "ord", "tag", "attrs", "text", "tail", "path"]
            yield pa.RecordBatch.from_arrays([pa.array([r[f] for r in rows], t) for f, t in zip(fields, kinds, strict=True)], fields)

    return kept.mapInArrow(run, f"`{key}` {kept.schema[key].dataType.simpleString()}, {NODES}")
