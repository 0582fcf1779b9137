"""Queries that clean, repair, normalize and audit charts; several shapes of document in each, chosen by the row."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import audit, tree

from .registry import query, read

_NS = '<svg xmlns="http://www.w3.org/2000/svg"'


class _Expr:
    """A SQL expression of a document's row; columns themselves can only be made once there is a session."""

    def __init__(self, text: str):
        self.text = text


def _join(*parts: Column | str | _Expr) -> Column:
    made = [F.lit(p) if isinstance(p, str) else F.expr(p.text).cast("string") if isinstance(p, _Expr) else p.cast("string") for p in parts]
    return F.concat(*made)


def _shapes(key: str, shapes: Sequence[Column]) -> Column:
    return F.coalesce(*[F.when(F.col(key) % len(shapes) == i, s) for i, s in enumerate(shapes)])


def _repair(name: str, steps: Sequence[Callable], shapes: Sequence[tuple], expected: Sequence[str], doc: str) -> None:
    """A query over `part`: shape p_partkey % n of the documents, through the steps; `expected` is SQL for each shape."""
    cases = " ".join(f"when {i} then {e}" for i, e in enumerate(expected))

    def run(spark: SparkSession, d: str) -> DataFrame:
        svg = _shapes("p_partkey", [_join(*s) for s in shapes])
        p = read(spark, d, "part").select("p_partkey", svg.alias("svg"))
        return tree.edited(p, "svg", steps).select("p_partkey", "svg")

    run.__doc__ = doc
    query(name, f"select p_partkey, case p_partkey % {len(shapes)} {cases} end svg from part")(run)


_n, _k = _Expr("p_size"), _Expr("p_partkey")

_repair(
    "css_inlined",
    [tree.inline_css],
    [
        ("<svg><style>.a rect, .b { fill: red; stroke: blue } .a rect { fill: green }</style><g class='a'><rect width='", _n, "' style='stroke: #00f'/></g></svg>"),
        ("<svg><g class='grid'><line x1='", _n, "'/></g><text>t", _n, "</text></svg>"),
        ("<svg><style>text { fill: red } rect > g { fill: blue }</style><text style='font-size: ", _n, "px'>x</text></svg>"),
    ],
    [
        f"""'{_NS}><g class="a"><rect width="' || p_size || '" style="stroke: #00f; fill: red"/></g></svg>'""",
        f"""'{_NS}><g class="grid"><line x1="' || p_size || '" style="stroke: #e6e6e6; stroke-width: 1px; stroke-dasharray: 2, 2"/></g><text style="font-family: sans-serif; font-size: 10px; fill: #333333">t' || p_size || '</text></svg>'""",
        f"""'{_NS}><text style="font-size: ' || p_size || 'px; fill: red; font-family: sans-serif">x</text></svg>'""",
    ],
    "Stylesheets as style attributes: inline declarations, then the document's rules, the first first, then the default ones.",
)
_repair(
    "vector_fonts_dropped",
    [tree.drop_vector_fonts],
    [
        ('<svg><defs><path id="DejaVuSans-', _k, '" d="M0 0"/><path id="mark" d="M1 1"/></defs><use href="#DejaVuSans-', _k, '"/><use href="#mark" x="', _n, '"/></svg>'),
        ('<svg xmlns:xlink="http://www.w3.org/1999/xlink"><defs><path id="BitstreamVera-1"/></defs><g><use xlink:href="#BitstreamVera-1"/>', _n, "</g></svg>"),
    ],
    [
        f"""'{_NS}><defs><path id="mark" d="M1 1"/></defs><use href="#mark" x="' || p_size || '"/></svg>'""",
        f"""'{_NS}><defs/><g>' || p_size || '</g></svg>'""",
    ],
    "Glyph outlines of fonts and what uses them go; other definitions and uses stay.",
)
_repair(
    "accessibility_dropped",
    [tree.drop_accessibility],
    [
        ('<svg role="img"><title>t', _n, '</title><desc>d</desc><rect aria-label="x" opacity="1" fill-opacity="0.5" width="', _n, '"/></svg>'),
        ('<svg><line stroke="red" stroke-width="0" x1="', _n, '"/><line stroke="red" stroke-width="0.5" stroke-dasharray="none" stroke-opacity="1.0"/></svg>'),
    ],
    [
        f"""'{_NS}><rect fill-opacity="0.5" width="' || p_size || '"/></svg>'""",
        f"""'{_NS}><line x1="' || p_size || '"/><line stroke="red" stroke-width="0.5"/></svg>'""",
    ],
    "Descriptions, aria attributes, roles and attributes that say the default go.",
)
_repair(
    "line_markers_dropped",
    [tree.drop_line_markers],
    [
        ('<svg><g class="highcharts-series highcharts-series-0"><path class="highcharts-graph" stroke-width="2"/></g><g class="highcharts-markers highcharts-series-0"><path d="M', _n, ' 1"/></g><g class="highcharts-markers highcharts-series-1"/></svg>'),
        ('<svg><g class="highcharts-series highcharts-series-0"><path class="highcharts-graph" style="stroke-width: 0"/></g><g class="highcharts-markers highcharts-series-0"><path d="M', _n, ' 1"/></g></svg>'),
    ],
    [
        f"""'{_NS}><g class="highcharts-series highcharts-series-0"><path class="highcharts-graph" stroke-width="2"/></g><g class="highcharts-markers highcharts-series-1"/></svg>'""",
        f"""'{_NS}><g class="highcharts-series highcharts-series-0"><path class="highcharts-graph" style="stroke-width: 0"/></g><g class="highcharts-markers highcharts-series-0"><path d="M' || p_size || ' 1"/></g></svg>'""",
    ],
    "Markers of series that are drawn as lines go; those of series without a visible line stay.",
)
_repair(
    "images_and_branding_dropped",
    [tree.drop_images, tree.drop_branding, tree.drop_identity_transforms],
    [
        ('<svg><image href="x"/><g class="highcharts-credits-box"><text>', _n, '</text></g><g transform="matrix(1 , 0, 0, 1, 0, 0)" id="m', _n, '"/></svg>'),
        ('<svg><rect transform="matrix(1,0.0,0,1.0,0,0)" x="', _n, '"/><g class="gfx-mouse-target"/><g transform="matrix(2,0,0,1,0,0)"/></svg>'),
    ],
    [
        f"""'{_NS}><g id="m' || p_size || '"/></svg>'""",
        f"""'{_NS}><rect x="' || p_size || '"/><g transform="matrix(2,0,0,1,0,0)"/></svg>'""",
    ],
    "Bitmaps, branding and targets of the mouse go with all they hold, transforms that change nothing too.",
)
_repair(
    "paint_order_split",
    [tree.split_paint_order],
    [
        ('<svg><text id="t" paint-order="stroke" stroke="white" stroke-width="3" fill="black" x="', _n, '">a</text><text paint-order="stroke" stroke="none">b</text></svg>'),
        ('<svg><text stroke="white" x="', _n, '">a</text></svg>'),
    ],
    [
        f"""'{_NS}><text stroke="white" stroke-width="3" fill="none" x="' || p_size || '">a</text><text id="t" fill="black" x="' || p_size || '">a</text><text paint-order="stroke" stroke="none">b</text></svg>'""",
        f"""'{_NS}><text stroke="white" x="' || p_size || '">a</text></svg>'""",
    ],
    "Where the stroke is painted first, a copy with only the stroke comes before the element without it.",
)
_repair(
    "reveal_clips_opened",
    [tree.reveal_clips],
    [
        ('<svg width="9"><clipPath id="c"><path d="M ', _n, ' 2 l 0 0 l 0 50 l 0 0 z"/></clipPath></svg>'),
        ('<svg width="9"><clipPath id="c"><path d="M ', _n, ' 2 l 10 0 l 0 50 l 0 0 z"/></clipPath></svg>'),
    ],
    [
        f"""'{_NS} width="512" viewBox="0 0 512 512" height="512"><rect x="0" y="0" width="512" height="512" fill="white"/><clipPath id="c"><path d="M0 0H512V512H0Z"/></clipPath></svg>'""",
        f"""'{_NS} width="9"><clipPath id="c"><path d="M ' || p_size || ' 2 l 10 0 l 0 50 l 0 0 z"/></clipPath></svg>'""",
    ],
    "A clip without width, as of an animation's first frame, opens to the whole canvas, on a white ground.",
)
_repair(
    "axis_domains",
    [tree.domain_axes],
    [
        ('<svg><g class="axis bottom"><g><path class="domain" d="M2,0V0H', _Expr("p_size + 100"), 'V0" style="fill: none; stroke: red"/></g></g></svg>'),
        ('<svg><g class="axis left"><line class="domain" x1="0" y2="', _n, '.5"/></g><path class="domain" d="M0 9"/></svg>'),
        ('<svg><g class="axis top"><line class="domain" x1="0" y1="-0.5" x2="', _n, '" y2="-0.5"/></g></svg>'),
    ],
    [
        f"""'{_NS}><g class="axis bottom"><g><line class="domain" x1="0" y1="-0.5" x2="' || (p_size + 100) || '" y2="-0.5" fill="none" stroke="#bcbcbc" stroke-width="1" style="fill: none"/></g></g></svg>'""",
        f"""'{_NS}><g class="axis left"><line class="domain" x1="0" y2="' || p_size || '.5" y1="0" x2="0" fill="none" stroke="#bcbcbc" stroke-width="1"/></g><path class="domain" d="M0 9"/></svg>'""",
        f"""'{_NS}><g class="axis top"><line class="domain" x1="0" y1="-0.5" x2="' || p_size || '" y2="-0.5"/></g></svg>'""",
    ],
    "Axis domains as plain lines, across or down by the nearest axis around them; without one they stay.",
)
_repair(
    "line_fills",
    [tree.line_fills],
    [
        ('<svg><path class="gfx-ln-path" fill=" NaN " d="M0 ', _n, '"/><path class="gfx-ln-path" fill="red"/></svg>'),
        ('<svg><path class="other" fill="null" d="M0 ', _n, '"/><path class="gfx-ln-path"/></svg>'),
    ],
    [
        f"""'{_NS}><path class="gfx-ln-path" fill="none" d="M0 ' || p_size || '"/><path class="gfx-ln-path" fill="red"/></svg>'""",
        f"""'{_NS}><path class="other" fill="null" d="M0 ' || p_size || '"/><path class="gfx-ln-path" fill="none"/></svg>'""",
    ],
    "Lines of series whose fill is no value have none.",
)
_repair(
    "ticks_relabelled",
    [lambda root: tree.tick_labels(root, {0: "Q1", 2: "Q3"})],
    [
        ('<svg><g class="tick" display="none"><text>a<tspan>b</tspan></text></g><g class="tick"><text>', _n, '</text></g><g class="tick"><text>z</text></g><g class="tick"><text>$5</text></g><g class="tick"><text>q</text></g></svg>'),
        ('<svg><g class="tick"><text> $', _n, '</text></g><g class="tick"><text>q</text></g></svg>'),
    ],
    [
        f"""'{_NS}><g class="tick"><text>Q1</text></g><g class="tick" display="none"><text>' || p_size || '</text></g><g class="tick"><text>Q3</text></g><g class="tick"><text>$5</text></g><g class="tick"><text>q</text></g></svg>'""",
        f"""'{_NS}><g class="tick"><text> $' || p_size || '</text></g><g class="tick"><text>q</text></g></svg>'""",
    ],
    "Ticks before the first money label get their label by place or are hidden.",
)
_repair(
    "cjk_fonts",
    [tree.cjk_fonts],
    [
        ('<svg><text style="font-size: ', _n, 'px">日本</text><text>latin</text></svg>'),
        ('<svg><text font-family="Arial" style="font-family: Arial">x<tspan>한', _n, "</tspan></text></svg>"),
    ],
    [
        f"""'{_NS}><text style="font-size: ' || p_size || 'px">日本</text><text>latin</text></svg>'""".replace("px\">", f"px; font-family: {tree.FONT_STACK.replace(chr(39), chr(39) * 2)}\" font-family=\"{tree.FONT_STACK.replace(chr(39), chr(39) * 2)}\">"),
        f"""'{_NS}><text font-family="Arial" style="font-family: Arial">x<tspan>한' || p_size || '</tspan></text></svg>'""",
    ],
    "Texts with Chinese, Japanese or (by syllables of jamo only) such characters get fonts that have them.",
)


def _whole(name: str, sql: str, shapes: Sequence[tuple], doc: str, f: Callable[[str], str]) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        svg = _shapes("p_partkey", [_join(*s) for s in shapes])
        p = read(spark, d, "part").select("p_partkey", svg.alias("raw"))
        return tree.rewritten(p, "raw", f).select("p_partkey", "svg")

    run.__doc__ = doc
    query(name, sql)(run)


_whole(
    "normalized",
    f"""
    with a as (select p_partkey, p_size + 50 w from part), s as (select p_partkey, w, 512.0::double / (2 * w) k from a)
    select p_partkey, case p_partkey % 2 when 0 then '{_NS} viewBox="0 0 512 512" width="512" height="512"><rect width="512" height="512" x="0" y="0" fill="white"/><g transform="translate(0.0 128.0)"><rect width="'
        || format('{{:.1f}}', 10 * k) || '" height="' || format('{{:.1f}}', w * k) || '" fill="red"/></g></svg>'
    else '{_NS} viewBox="0 0 512 512" width="512" height="512"><rect width="512" height="512" x="0" y="0" fill="white"/><circle r="256.0"/><path d="M 256.0 0.0 l 2.0 4.0"/></svg>' end svg from s""",
    [
        ('<svg width="', _Expr("2 * (p_size + 50)"), 'px" height="', _Expr("p_size + 50"), '"><title>t</title><rect id="x" width="10" height="', _Expr("p_size + 50"), '" fill="red" stroke="null" opacity="1"/><image href="q"/></svg>'),
        ('<svg viewBox="0 0 256 256"><circle r="128" class="highcharts-x"/><path d="M128,0l1,2"/></svg>'.replace(' class="highcharts-x"', ""),),
    ],
    "A chart cleaned and fitted into the square canvas, by the longer side, in the middle of the shorter.",
    tree.normalize,
)
_whole(
    "optimized",
    f"""
    select p_partkey, case p_partkey % 2 when 0 then '{_NS}><g><rect width="' || p_size || '.3" fill="red"/></g><text> a </text></svg>'
    else '{_NS}><path d="M 1 2 L ' || p_size || ' 4.1 z" stroke="blue"/></svg>' end svg from part""",
    [
        ("<svg>\n  <!-- note --><g>\n <rect width='", _n, ".26' style='fill: red'/>\n</g><text> a </text></svg>"),
        ('<svg><path d="M1.04,2.0L', _n, ' 4.12z" style="stroke: red" stroke="blue"/></svg>'),
    ],
    "Comments and blank text go, numbers are rounded, declarations become attributes unless these are there.",
    tree.optimize,
)
_whole(
    "unwrapped",
    """
    select p_partkey, case p_partkey % 3 when 0 then '<rect width="' || p_size || '"/>t' when 1 then '' else '<g xmlns="http://www.w3.org/2000/svg"><a/></g>' end svg from part""",
    [('<svg width="1"><rect width="', _n, '"/>t</svg>'), ('<svg id="', _n, '"/>'), ("<g><a/></g>",)],
    "What the root holds, without the root; a root of another name stays.",
    tree.unwrapped,
)
_whole(
    "wrapped_raw",
    f"""
    select p_partkey, case p_partkey % 3 when 0 then '{_NS} viewBox="0 0 512 512" width="512" height="512" preserveAspectRatio="xMidYMid meet" data-raw-normalized="true" data-preserve-rendering="true"><rect x="0" y="0" width="512" height="512" fill="white"/><svg width="512" height="512" viewBox="0 0 '
        || (p_size + 1) || ' 7.5" x="0" y="0" preserveAspectRatio="xMidYMid meet"><g/></svg></svg>'
    when 1 then '{_NS} viewBox="0 0 512 512" width="512" height="512" preserveAspectRatio="xMidYMid meet" data-raw-normalized="true" data-preserve-rendering="true"><rect x="0" y="0" width="512" height="512" fill="white"/><svg viewBox="1 2 '
        || (p_size + 1) || ' 4" x="0" y="0" width="512" height="512" preserveAspectRatio="xMidYMid meet"/></svg>' end svg from part""",
    [('<svg width="', _Expr("p_size + 1"), 'px" height="7.5"><g/></svg>'), ('<svg viewBox="1 2 ', _Expr("p_size + 1"), ' 4"/>'), ('<svg width="auto" id="', _n, '"/>')],
    "A drawing set into the canvas as it is; null where it says no size.",
    tree.wrapped,
)


@query(
    "denormalized",
    f"""
    with a as (select o_orderkey k, case when o_orderkey % 3 <> 0 then (o_custkey % 97) / 4.0::double end px, (o_custkey % 31) / 8.0::double py, o_custkey % 700 + 1 w from orders)
    select k o_orderkey, '{_NS} id="a" ' || case when px is null then 'viewBox="0 0 512 512" width="512" height="512"'
        else 'viewBox="' || format('{{:.2f}}', px) || ' ' || format('{{:.2f}}', py) || ' ' || format('{{:.2f}}', 512 - 2 * px) || ' ' || format('{{:.2f}}', 512 - 2 * py) || '" width="' || w || '" height="77"' end
        || '><rect width="' || w || '"/></svg>' svg from a""",
)
def denormalized(spark: SparkSession, d: str) -> DataFrame:
    """The frame and size of before from the paddings; the white ground goes; without paddings the whole canvas."""
    w = F.col("o_custkey") % 700 + 1
    px = F.when(F.col("o_orderkey") % 3 != 0, (F.col("o_custkey") % 97) / 4.0)
    ground = F.when(F.col("o_orderkey") % 2 == 0, '<path d="M 0 0 H 512 V 512 H 0 Z"/>').otherwise('<rect width="512" height="512" fill="white"/>')
    svg = _join('<svg id="a" width="512" height="512" viewBox="0 0 512 512">', ground, '<rect width="', w, '"/></svg>')
    o = read(spark, d, "orders").select("o_orderkey", svg.alias("raw"), w.cast("double").alias("w"), F.lit(77.0).alias("h"), F.lit(0.5).alias("scale"), px.alias("px"), ((F.col("o_custkey") % 31) / 8.0).alias("py"))
    return tree.denormalized(o, "raw", ("w", "h", "scale", "px", "py")).select("o_orderkey", "svg")


# --- audit ------------------------------------------------------------------------------------------------------------


def _audited(spark: SparkSession, d: str, fix: bool) -> DataFrame:
    """One of eight documents for each order, some of them of the dataset whose traces are checked."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    good = 'viewBox="0 0 512 512" width="512" height="512"'
    shapes = [
        _join(f"<svg {good}><rect width='", c, "'/></svg>"),
        _join(f'<svg {good}><rect fill="NULL" x=" nan " style="fill: undefined; stroke: red" width="', c, '"/><g style="x: -infinity"/></svg>'),
        _join('<svg viewBox="0,0,5,5" width="512" height="', c, '"/>'),
        _join(f'<svg {good} overflow="visible"><g class="xaxislayer-above" id="g', c, '"/></svg>'),
        _join(f'<svg {good} style="overflow: Hidden"><g class="a my-yaxis"/><g id="g', c, '"/></svg>'),
        _join("<svg><g></svg>", c),
        _join(f'<svg {good}><clipPath id="plot1"><rect/></clipPath><g class="xaxis yaxis"/><g class="plot"><g class="trace"/><g class="bar trace" clip-path="url(#z)"/></g><g class="scatter" id="g', c, '"/></svg>'),
        _join(f'<svg {good}><clipPath id="plot1"><rect/></clipPath><clipPath id="c" class="xyPlotClip"><rect/></clipPath><g class="xaxis"/><g class="axis axis-grid  y"/><g class="trace box" id="g', c, '"/></svg>'),
    ]
    dataset = F.when(k % 3 == 0, audit.TRACED).when(k % 3 == 1, "echarts").otherwise("fusion_clean")
    o = read(spark, d, "orders").select("o_orderkey", dataset.alias("dataset"), _shapes("o_orderkey", shapes).alias("svg"))
    return audit.audited(o, "svg", "dataset", fix)


_AUDIT = """
    with a as (select o_orderkey, o_custkey c, o_orderkey % 8 k, case o_orderkey % 3 when 0 then 'plotly_export' when 1 then 'echarts' else 'fusion_clean' end dataset from orders),
    f as (select *, (k = 5)::int broken, case k when 1 then 4 else 0 end::int invalid_attributes, (k = 2 and c <> 512)::int canvas_not_512, (k = 3)::int root_overflow_unclipped,
        (k in (3, 6, 7))::int has_x_axis, (k in (4, 6, 7))::int has_y_axis, case k when 3 then 'y' when 4 then 'x' else '' end missing_cartesian_axis,
        case when dataset <> 'plotly_export' then 0 when k = 6 then 2 when k = 7 then 1 else 0 end::int unclipped_plotly_layers from a)"""


@query(
    "rule_audit",
    _AUDIT + """
    select o_orderkey, dataset, broken, invalid_attributes, canvas_not_512, root_overflow_unclipped, has_x_axis, has_y_axis, missing_cartesian_axis, unclipped_plotly_layers, 0::int fixed from f""",
)
def rule_audit(spark: SparkSession, d: str) -> DataFrame:
    """Findings for each document; one that is not well-formed has only its error."""
    return _audited(spark, d, False).withColumn("broken", (F.col("parse_error") != "").cast("int")).drop("parse_error", "svg")


@query(
    "audit_summary",
    _AUDIT + """
    select dataset, count(*)::bigint checked, sum(broken)::bigint parse_errors, sum(invalid_attributes)::bigint invalid_attributes, sum(canvas_not_512)::bigint canvas_not_512,
        sum(root_overflow_unclipped)::bigint root_overflow_unclipped, count(*) filter (missing_cartesian_axis <> '')::bigint missing_cartesian_axis,
        sum(unclipped_plotly_layers)::bigint unclipped_plotly_layers, 0::bigint files_fixed from f group by dataset""",
)
def audit_summary(spark: SparkSession, d: str) -> DataFrame:
    return audit.summary(_audited(spark, d, False))


@query(
    "audit_repairs",
    _AUDIT + f"""
    select o_orderkey, (k in (1, 3) or (k = 2 and c <> 512) or (k = 6 and dataset = 'plotly_export'))::int fixed, case
        when k = 1 then '{_NS} viewBox="0 0 512 512" width="512" height="512"><rect style="stroke: red" width="' || c || '"/><g/></svg>'
        when k = 2 and c <> 512 then '{_NS} viewBox="0 0 512 512" width="512" height="512"/>'
        when k = 3 then '{_NS} viewBox="0 0 512 512" width="512" height="512" overflow="hidden"><g class="xaxislayer-above" id="g' || c || '"/></svg>'
        when k = 6 and dataset = 'plotly_export' then '{_NS} viewBox="0 0 512 512" width="512" height="512"><clipPath id="plot1"><rect/></clipPath><g class="xaxis yaxis"/><g class="plot" clip-path="url(#plot1)"><g class="trace"/><g class="bar trace" clip-path="url(#z)"/></g><g class="scatter" id="g' || c || '" clip-path="url(#plot1)"/></svg>'
        end svg from f""",
)
def audit_repairs(spark: SparkSession, d: str) -> DataFrame:
    """What the audit repairs: values that are none, the canvas, the overflow, and traces under the only plot clip.

    Not null for repaired documents only; with several plot clips none is set.
    """
    found = _audited(spark, d, True)
    return found.select("o_orderkey", "fixed", F.when(F.col("fixed") == 1, F.col("svg")).alias("svg"))


@query(
    "class_text",
    """
    select o_orderkey, 'root a' || o_custkey || ' b' class_text from orders""",
)
def class_text(spark: SparkSession, d: str) -> DataFrame:
    """The classes of all elements in document order, from the node table; elements without any add nothing."""
    svg = _join('<svg class="root"><g class="a', F.col("o_custkey"), '"><rect/></g><text class="b"/></svg>')
    found = tree.nodes(read(spark, d, "orders").select("o_orderkey", svg.alias("svg")), "o_orderkey", "svg")
    own = found.select("o_orderkey", F.struct("node_id", F.try_element_at("attrs", F.lit("class")).alias("c")).alias("n")).where("n.c is not null")
    listed = own.groupBy("o_orderkey").agg(F.array_sort(F.collect_list("n")).alias("n"))
    return listed.select("o_orderkey", F.array_join(F.transform("n", lambda n: n["c"]), " ").alias("class_text"))


@query(
    "nearest_ancestors",
    """
    select o_orderkey, 3::int node_id, 2::int axis_node, case when o_orderkey % 2 = 0 then 1 end::int clip_node from orders
    union all select o_orderkey, 4::int, null::int, null::int from orders""",
)
def nearest_ancestors(spark: SparkSession, d: str) -> DataFrame:
    """For each line, the nearest element around it (or itself) with the class of axes, and that with a clip."""
    clip = F.when(F.col("o_orderkey") % 2 == 0, ' clip-path="url(#c)"').otherwise("")
    svg = _join('<svg><g class="axis"', clip, '><g class="big axis"><line/></g></g><line/></svg>')
    n = tree.nodes(read(spark, d, "orders").select("o_orderkey", svg.alias("svg")), "o_orderkey", "svg")
    marks = n.select("o_orderkey", F.col("node_id").alias("m"), F.array_contains(F.split(F.coalesce(F.try_element_at("attrs", F.lit("class")), F.lit("")), " "), "axis").alias("axis"), F.try_element_at("attrs", F.lit("clip-path")).isNotNull().alias("clip"))
    lines = n.where("tag = 'line'").select("o_orderkey", "node_id", F.explode("path").alias("m"))
    found = lines.join(marks, ["o_orderkey", "m"]).groupBy("o_orderkey", "node_id")
    return found.agg(F.max(F.when(F.col("axis"), F.col("m"))).alias("axis_node"), F.max(F.when(F.col("clip"), F.col("m"))).alias("clip_node"))


@query(
    "running_fills",
    f"""
    with a as (select p_partkey k, p_size * 5 r, p_partkey % 256 g from part),
    h as (select *, '#' || lpad(lower(to_hex(r::bigint)), 2, '0') || lpad(lower(to_hex(g::bigint)), 2, '0') || '10' first, (r + 0) // 1 a1 from a)
    select k p_partkey, '{_NS}><path d="a"/><path d="b" fill="' || first || '"/><path d="c" fill="' || first || '"/><path d="d" fill="#000000"/><path d="e" fill="#' ||
        lpad(lower(to_hex((2 * r // 3)::bigint)), 2, '0') || lpad(lower(to_hex((2 * g // 3)::bigint)), 2, '0') || '0a"/></svg>' svg from h""",
)
def running_fills(spark: SparkSession, d: str) -> DataFrame:
    """A path without a fill takes the mean of all fills before it, those given here too; the first has none to take."""
    rgb = F.concat(F.lit("#"), *[F.lpad(F.lower(F.hex(c)), 2, "0") for c in (F.col("p_size") * 5, F.col("p_partkey") % 256)], F.lit("10"))
    svg = _join('<svg><path d="a"/><path d="b" fill="', rgb, '"/><path d="c"/><path d="d" fill="#000000"/><path d="e"/></svg>')
    p = read(spark, d, "part").select("p_partkey", svg.alias("svg"))
    return tree.edited(p, "svg", [tree.simplify_gradients]).select("p_partkey", "svg")


@query(
    "nested_view_boxes",
    f"""
    select p_partkey, '{_NS} viewBox="0 0 512 512" width="512" height="512"><rect width="512" height="512" x="0" y="0" fill="white"/><g transform="translate(-20.0 -10.0)"><svg viewBox="0.0 2.0 ' || format('{{:.1f}}', p_size * 2.0::double) || ' 8.0" width="'
        || format('{{:.1f}}', p_size * 2.0::double) || '"/></g></svg>' svg from part""",
)
def nested_view_boxes(spark: SparkSession, d: str) -> DataFrame:
    """Drawings inside a drawing scale with it, and the origin of the outer view box is taken off."""
    svg = _join('<svg viewBox="10 5 256 256"><svg viewBox="0,1 ', F.col("p_size"), ' 4" width="', F.col("p_size"), '"/></svg>')
    return tree.rewritten(read(spark, d, "part").select("p_partkey", svg.alias("raw")), "raw", tree.normalize).select("p_partkey", "svg")
