"""Charts as strings of semantic tokens, and back.

A token is `[<|name|>]`, followed by its content up to the next one. Elements open and close with a token, attributes are
tokens that end in `=`, and each command of a path is a token of its own. Tokens are written straight from the tree, so
text that looks like an attribute stays text; ids and classes keep their underscores.
"""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.geometry import parse_path

from .tree import Element, parse, serialize, style_text, styles

# The names of the tokens.
COMMANDS = {
    "m": "moveto_rel", "M": "moveto_abs",
    "l": "lineto_rel", "L": "lineto_abs",
    "h": "horizontal_lineto_rel", "H": "horizontal_lineto_abs",
    "v": "vertical_lineto_rel", "V": "vertical_lineto_abs",
    "c": "curveto_rel", "C": "curveto_abs",
    "s": "smooth_curveto_rel", "S": "smooth_curveto_abs",
    "q": "quadratic_bezier_curve_rel", "Q": "quadratic_bezier_curve_abs",
    "t": "smooth_quadratic_bezier_curveto_rel", "T": "smooth_quadratic_bezier_curveto_abs",
    "a": "elliptical_arc_rel", "A": "elliptical_arc_abs",
    "z": "close_path", "Z": "close_path",
}
OPEN = {"svg": "START_OF_SVG", "g": "START_OF_GROUP"}
CLOSE = {"svg": "END_OF_SVG", "g": "END_OF_GROUP"}
SHAPES = ("circle", "rect", "ellipse", "polygon", "line", "polyline", "use")
GRADIENTS = ("linearGradient", "radialGradient", "stop")
OTHERS = ("path", "text", "tspan", "svg", "g", "clipPath", "defs")
# The order in which attributes are written, those of paths, those of the root, those that groups keep.
ATTRIBUTES = (
    "fill", "stroke-width", "stroke", "opacity", "transform",
    "cx", "cy", "r", "rx", "ry", "width", "height", "points",
    "x1", "y1", "x2", "y2", "x", "y", "dx", "dy", "rotate", "font-size",
    "textLength", "font-style", "font-family",
    "fill-opacity", "stroke-opacity", "stroke-dasharray",
    "text-anchor", "preserveAspectRatio", "viewBox", "class", "clip-path",
    "href", "id", "style", "visibility", "display", "dominant-baseline",
    "font-weight", "stroke-linecap",
)
PATH_ATTRIBUTES = (
    "id", "fill", "stroke", "stroke-width", "opacity", "transform", "class", "style", "clip-path",
    "fill-opacity", "stroke-opacity", "stroke-dasharray", "stroke-linecap", "visibility", "display",
)
ROOT_ATTRIBUTES = ("width", "height", "viewBox", "preserveAspectRatio", "xmlns", "version", "x", "y")
OWN = frozenset((
    "transform", "clip-path", "opacity", "mask", "filter", "id", "class",
    "x", "y", "dx", "dy", "width", "height", "cx", "cy", "r", "rx", "ry",
    "x1", "y1", "x2", "y2", "d", "points", "viewBox", "href", "style",
))
# Attributes written as numbers, in shapes and in texts; those copied into a style attribute on the way back.
SHAPE_NUMBERS = frozenset(("x", "y", "cx", "cy", "r", "width", "height", "x1", "y1", "x2", "y2", "stroke-width", "opacity"))
TEXT_NUMBERS = frozenset(("x", "y", "width", "height", "font-size", "stroke-width", "opacity", "dy", "dx"))
STYLED = ("text-anchor", "dominant-baseline", "font-family", "font-size", "visibility", "display", "fill", "stroke", "opacity")
FILLED, DRAWN = ("rect", "circle", "ellipse", "polygon"), ("path", "line", "polyline")
LEAVES = frozenset(("rect", "circle", "ellipse", "line", "polyline", "polygon", "path", "stop", "use"))

_NUMBER = re.compile(r"[-+]?\d*\.?\d+(?:e[-+]?\d+)?")
_LETTER = {v: k for k, v in COMMANDS.items() if k != "Z"}
_TAG = {OPEN.get(t, t): t for t in (*SHAPES, *GRADIENTS, *OTHERS)}
_END = {CLOSE.get(t, f"/{t}"): t for t in (*SHAPES, *GRADIENTS, *OTHERS)}
_NAME = re.compile(r"[A-Za-z_:][\w:.-]*")


def number(text: str) -> str:
    """A number without decimals if whole, else with one; px and % go. Other text, and lengths in em, stay."""
    if "em" in text:
        return text
    try:
        v = float(text.lower().replace("px", "").replace("%", ""))
        return str(int(v)) if v.is_integer() else f"{v:.1f}"
    except (ValueError, OverflowError):
        return text


def kept_units(text: str) -> str:
    return text if "em" in text.lower() or "%" in text else number(text)


def numbers_within(text: str) -> str:
    """Every number in a text, such as a transform, in the form of tokens."""
    return _NUMBER.sub(lambda m: number(m[0]), text)


def number_list(text: str) -> str:
    return " ".join(number(x) for x in _NUMBER.findall(text))


def replaced(text: str, words: Mapping[str, str]) -> str:
    """All occurrences of the keys, the longest first where several begin, by their values; one pass, left to right."""
    if not words:
        return text
    return re.sub("|".join(map(re.escape, sorted(words, key=len, reverse=True))), lambda m: words[m[0]], text)


def path_tokens(d: str) -> str:
    """The commands of a path as tokens; numbers are read before letters, so exponents are no commands."""
    return "".join(f"[<|{COMMANDS[c]}|>]" + " ".join(map(number, args)) for c, args in parse_path(d))


def encode(text: str | None, path_only: bool = False, groups: bool = True, inherit: bool = True, stops: bool = False, ignore_tags: Sequence[str] = (), ignore_attributes: Sequence[str] = ("gradientUnits",)) -> str:
    """The tokens of a chart; empty where the text is not well-formed.

    Elements other than the known ones go with all they hold. Nested drawings are groups. Children inherit what they
    lack from groups, other than placement and identity; declarations of a style count over attributes. With `groups`
    off, groups are not written; with `path_only`, shapes are written without attributes; with `stops`, gradients with
    theirs.
    """
    root, mode = parse(text) if text else (None, "none")
    if root is None or mode != "strict":
        return ""
    out: list[str] = []

    def put(name: str, value: str = "") -> None:
        out.append(f"[<|{name}|>]{' '.join(value.split()) if name != 'text-content=' else value.strip()}")

    def put_all(attrs: Mapping[str, str], names: Sequence[str], form: Callable[[str, str], str]) -> None:
        for k in names:
            if k in attrs and k not in ignore_attributes:
                put(f"{k}=", form(k, attrs[k]))

    plain = lambda k, v: v
    shape = lambda k, v: number_list(v) if k in ("points", "viewBox") else number(v) if k in SHAPE_NUMBERS else numbers_within(v) if k == "transform" else v
    lettered = lambda k, v: kept_units(v) if k in TEXT_NUMBERS else numbers_within(v) if k == "transform" else v

    def walk(e: Element, level: int, given: dict[str, str]) -> None:
        tag = e.tag if isinstance(e.tag, str) else ""
        if tag == "svg" and level:
            tag = "g"
        if tag in ignore_tags or tag not in _TAG.values():
            return
        passed = {k: v for k, v in e.attrib.items() if k not in OWN}
        shown = tag != "g" or groups
        if shown:
            put(OPEN.get(tag, tag))
        if tag == "defs":
            pass
        elif tag == "g":
            if shown:
                put_all({**e.attrib, **styles(e.get("style"))}, ATTRIBUTES, plain)
            given = {**given, **passed} if inherit else given
        elif tag == "clipPath":
            for k in ("id", "class"):
                if k in e.attrib:
                    put(f"{k}=", e.attrib[k])
                    break
        else:
            attrs = {**given, **e.attrib}
            if "xlink:href" in attrs:
                attrs["href"] = attrs.pop("xlink:href")
            attrs |= {k: v for k, v in styles(attrs.get("style")).items() if k in ATTRIBUTES}
            if tag in ("text", "tspan"):
                own = [k for k in ATTRIBUTES if not (tag == "tspan" and k == "y" and "dy" in e.attrib and "y" not in e.attrib)]
                put_all(attrs, own, lettered)
                given = {**given, **passed}
                if (e.text or "").strip():
                    put("text-content=", e.text or "")
            elif tag == "path":
                if "d" in attrs:
                    put("d=")
                    out.append(path_tokens(attrs["d"]))
                    put_all(attrs, PATH_ATTRIBUTES, plain)
            elif tag == "svg":
                put_all(attrs, [k for k in attrs if k in ROOT_ATTRIBUTES], lambda k, v: number_list(v) if k == "viewBox" else number(v) if k in ("width", "height", "x", "y") else v)
            elif tag in GRADIENTS:
                put_all(attrs, list(attrs), plain)
            elif not path_only:
                put_all(attrs, ATTRIBUTES, shape)
        if tag in ("defs", "g", "clipPath", "text", "tspan", "svg") or (stops and tag in GRADIENTS):
            for c in e:
                walk(c, level + 1, given)
                if tag in ("text", "tspan") and (c.tail or "").strip():
                    put("text-content=", c.tail or "")
        if shown:
            put(CLOSE.get(tag, f"/{tag}"))

    walk(root, 0, {})
    return "".join(out)


def _painted(e: Element) -> None:
    """What a renderer should not guess: no fill of shapes, black lines and texts, where neither is said."""
    a = e.attrib
    fill, stroke = "fill" in a or "style" in a, "stroke" in a or "style" in a
    if e.tag in FILLED and not fill:
        a["fill"] = "none"
    elif e.tag in DRAWN:
        if not stroke and not fill:
            a |= {"stroke": "#000000", "fill": "none"}
        if "stroke-width" not in a and ("stroke" in a or stroke) and (a.get("fill") == "none" or not fill):
            a["stroke-width"] = "1.0"
    elif e.tag == "text" and not fill:
        a["fill"] = "#000000"


def decode(tokens: str | None, spaces: bool = False) -> str:
    """The drawing that tokens describe; always one with a root, a namespace and a view box.

    Elements that are left open close with what holds them, shapes with whatever follows; a closing that fits nothing
    open is ignored. A group's x and y become a translation, and attributes that a style lacks go into it. With `spaces`,
    underscores in contents are read as spaces.
    """
    top = ET.Element("")
    stack: list[Element] = [top]
    commands: dict[Element, list[str]] = {}
    for piece in (tokens or "").split("[<|")[1:]:
        name, found, content = piece.partition("|>]")
        if not found:
            continue
        name, content = name.strip(), content.strip()
        content = content.replace("_", " ") if spaces else content
        if name in _END:
            at = max((k for k, e in enumerate(stack) if e.tag == _END[name]), default=0)
            if at:
                del stack[at:]
                if name == CLOSE["svg"] and at == 1:
                    break
            continue
        if name in _TAG:
            if stack[-1].tag in LEAVES:
                stack.pop()
            stack.append(ET.SubElement(stack[-1], _TAG[name]))
            name = "text-content"
            if not content:
                continue
        e, key = stack[-1], name.removesuffix("=")
        if e is top:
            continue
        if key == "text-content":
            if len(e):
                e[-1].tail = f"{e[-1].tail} {content}" if e[-1].tail else content
            else:
                e.text = f"{e.text} {content}" if e.text else content
        elif key in _LETTER:
            commands.setdefault(e, []).append(f"{_LETTER[key]} {content}".strip())
        elif _NAME.fullmatch(key):
            e.set(key, content)

    def finish(e: Element, structural: bool) -> None:
        if e in commands and e.tag == "path":
            e.set("d", " ".join(commands[e]))
        if e.tag == "g" and ("x" in e.attrib or "y" in e.attrib):
            move = f"translate({e.attrib.pop('x', '0')}, {e.attrib.pop('y', '0')})"
            e.set("transform", f"{e.get('transform')} {move}" if e.get("transform") else move)
        if not structural:
            _painted(e)
        if "style" in e.attrib:
            decl = styles(e.get("style"))
            more = {k: e.attrib[k] for k in STYLED if k in e.attrib and k not in decl}
            if more:
                e.set("style", style_text(decl | more))
        for c in e:
            finish(c, structural or e.tag in ("clipPath", "defs"))

    for e in top:
        finish(e, False)
    whole = len(top) == 1 and top[0].tag == "svg"
    root = top[0] if whole else ET.Element("svg")
    if not whole:
        root.extend(list(top))
    for k, v in (("height", "512"), ("width", "512"), ("viewBox", "0 0 512 512"), ("overflow", "visible")):
        if not whole or "viewBox" not in root.attrib or k == "viewBox":
            root.attrib.setdefault(k, v)
    root.tail = None
    return serialize(root)


#: Semantic tokens, numbers, words, and any other character but white space.
TOKEN = r"\[<\|[^|]*\|>\]|[-+]?[0-9]*\.?[0-9]+|[A-Za-z]+|[^\sA-Za-z0-9]"


def token_list(c: Column) -> Column:
    """A string of tokens as an array."""
    return F.regexp_extract_all(c, F.lit(TOKEN), F.lit(0))


def _mapped(df: DataFrame, column: str, f: Callable[[str | None], str], out: str) -> DataFrame:
    names = [c for c in df.columns if c != out]
    kept = df.select(*names) if column in names else df.select(*names, column)
    schema = ", ".join([f"`{c}` {df.schema[c].dataType.simpleString()}" for c in names] + [f"`{out}` string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = pa.array([None if v is None else f(v) for v in batch.column(column).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in names] + [made], [*names, out])

    return kept.mapInArrow(run, schema)


def encoded(df: DataFrame, column: str, out: str = "tokens", **options: object) -> DataFrame:
    """`df` with the tokens of a column of drawings (see encode); nulls stay null. One pass, no shuffle."""
    return _mapped(df, column, lambda text: encode(text, **options), out)  # type: ignore[arg-type]


def decoded(df: DataFrame, column: str, out: str = "svg", spaces: bool = False) -> DataFrame:
    """`df` with the drawings that a column of tokens describes (see decode); nulls stay null. One pass, no shuffle."""
    return _mapped(df, column, lambda text: decode(text, spaces), out)


def mapped_words(df: DataFrame, column: str, words: Mapping[str, str], out: str) -> DataFrame:
    """`df` with the keys of a dictionary replaced in a column (see replaced); nulls stay null."""
    return _mapped(df, column, lambda text: replaced(text or "", words), out)
