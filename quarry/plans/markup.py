"""Queries over vector markup made from the columns of tables: node tables, repairs, simplifications."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import tree

from .registry import query, read

_OPEN = '<svg xmlns="http://www.w3.org/2000/svg">'


def _markup(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


@query(
    "node_table",
    """
    select o_orderkey, 0::int node_id, null::int parent_id, 0::int depth, 0::int ord, 'svg' tag, null::varchar width, null::varchar "text" from orders
    union all select o_orderkey, 1::int, 0::int, 1::int, 0::int, 'g', null, null from orders
    union all select o_orderkey, 2::int, 1::int, 2::int, 0::int, 'rect', o_custkey::varchar, null from orders
    union all select o_orderkey, 3::int, 0::int, 1::int, 1::int, 'text', null, 'n' || o_orderkey from orders""",
)
def node_table(spark: SparkSession, d: str) -> DataFrame:
    o = read(spark, d, "orders")
    svg = _markup('<svg><g id="a"><rect width="', F.col("o_custkey"), '"/></g><text>n', F.col("o_orderkey"), "</text></svg>")
    found = tree.nodes(o.select("o_orderkey", svg.alias("svg")), "o_orderkey", "svg")
    return found.select("o_orderkey", "node_id", "parent_id", "depth", "ord", "tag", F.col("attrs")["width"].alias("width"), "text")


@query(
    "id_prune",
    f"""
    select o_orderkey, '{_OPEN}<rect width="' || o_custkey || '"/><use href="#b"/><rect id="b"/></svg>' svg, 1::int removed, 'strict' parse_mode from orders""",
)
def id_prune(spark: SparkSession, d: str) -> DataFrame:
    o = read(spark, d, "orders")
    svg = _markup('<svg><rect id="a', F.col("o_orderkey"), '" width="', F.col("o_custkey"), '"/><use href="#b"/><rect id="b"/></svg>')
    return tree.edited(o.select("o_orderkey", svg.alias("svg")), "svg", [tree.prune_ids], report="removed")


@query(
    "full_circle_repair",
    f"""
    with a as (select o_orderkey, o_custkey x, o_orderkey y, o_custkey % 50 + 1 r from orders)
    select o_orderkey, case when o_orderkey % 3 = 0
        then '{_OPEN}<path d="M ' || x || ' ' || y || ' L 5 5"/></svg>'
        else '{_OPEN}<ellipse cx="' || (x - r) || '" cy="' || y || '" rx="' || r || '" ry="' || (r + 1) || '" fill="red"/></svg>' end svg,
        (o_orderkey % 3 <> 0)::int repaired, 'strict' parse_mode from a""",
)
def full_circle_repair(spark: SparkSession, d: str) -> DataFrame:
    x, y, r = F.col("o_custkey"), F.col("o_orderkey"), F.col("o_custkey") % 50 + 1
    arc = _markup('<svg><path d="M ', x, " ", y, " A ", r, " ", r + 1, " 0 1 1 ", x, " ", y, '" fill="red"/></svg>')
    line = _markup('<svg><path d="M ', x, " ", y, ' L 5 5"/></svg>')
    o = read(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, line).otherwise(arc).alias("svg"))
    return tree.edited(o, "svg", [tree.full_circles])


@query(
    "group_flattening",
    f"""
    select p_partkey, '{_OPEN}<rect fill="red" transform="translate(1 2) scale(3)" width="' || p_size || '"/><circle fill="blue" transform="translate(1 2)" r="' || p_size || '"/></svg>' svg from part""",
)
def group_flattening(spark: SparkSession, d: str) -> DataFrame:
    """Children inherit what they lack, their own attributes count, and transforms are composed from outside in."""
    svg = _markup('<svg><g fill="red" transform="translate(1 2)"><rect transform="scale(3)" width="', F.col("p_size"), '"/><g fill="blue"><circle r="', F.col("p_size"), '"/></g></g></svg>')
    p = read(spark, d, "part").select("p_partkey", svg.alias("svg"))
    return tree.edited(p, "svg", [tree.flatten_groups]).select("p_partkey", "svg")


@query(
    "gradient_colours",
    f"""
    select p_partkey, '{_OPEN}<defs/><path fill="#' || lpad((p_partkey % 1000000)::varchar, 6, '0') || '" d="M0 0"/></svg>' svg from part""",
)
def gradient_colours(spark: SparkSession, d: str) -> DataFrame:
    """The first stop's colour, found through a link from one gradient to another, replaces the reference."""
    colour = F.lpad((F.col("p_partkey") % 1000000).cast("string"), 6, "0")
    svg = _markup('<svg><defs><linearGradient id="g"><stop stop-color="#', colour, '"/></linearGradient><linearGradient id="h" href="#g"/></defs><path fill="url(#h)" d="M0 0"/></svg>')
    p = read(spark, d, "part").select("p_partkey", svg.alias("svg"))
    return tree.edited(p, "svg", [tree.simplify_gradients]).select("p_partkey", "svg")


@query(
    "invalid_value_removal",
    f"""
    select p_partkey, '{_OPEN}<rect height="' || p_size || '" style="stroke: #111111"/></svg>' svg, 2::int repaired from part""",
)
def invalid_value_removal(spark: SparkSession, d: str) -> DataFrame:
    svg = _markup('<svg><rect width="null" height="', F.col("p_size"), '" style="fill: undefined; stroke: #111111"/></svg>')
    p = read(spark, d, "part").select("p_partkey", svg.alias("svg"))
    return tree.edited(p, "svg", [tree.drop_invalid_values]).select("p_partkey", "svg", "repaired")


@query(
    "page_nodes",
    r"""
    with p as (select page_id, regexp_replace(regexp_replace(html, '(?is)<!--.*?-->', '', 'g'), '(?is)(<(script|style)\b[^>]*>).*?</(script|style)>', '\1', 'g') h from pages),
    e as (select page_id, lower(unnest(regexp_extract_all(h, '<([A-Za-z][^\s/>]*)', 1))) tag from p),
    n as (select page_id, tag, count(*) n from e group by all)
    select tag, sum(n)::bigint n, count(*)::bigint n_pages from n group by tag""",
)
def page_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Elements of whole web pages, mostly not well-formed, by tag: how many, and in how many pages."""
    found = tree.nodes(read(spark, d, "pages"), "page_id", "html")
    per = found.groupBy("page_id", F.lower("tag").alias("tag")).agg(F.count("*").alias("n"))
    return per.groupBy("tag").agg(F.sum("n").alias("n"), F.count("*").alias("n_pages"))
