"""Queries that encode charts as tokens, decode them, and take the tokens apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.numeric import token_number
from quarry.operators import codec

from .registry import query, read


def _join(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


_HEAD = "[<|START_OF_SVG|>][<|width=|>]512[<|height=|>]512[<|viewBox=|>]0 0 512 512"
# Numbers of the tables with one decimal at most: k / 4 has up to two.
_Q = "case when {0} % 4 = 0 then ({0} // 4)::varchar else format('{{:.1f}}', {0} / 4.0::double) end"


@query(
    "svg_encode_shapes",
    f"""
    with a as (select o_orderkey k, o_custkey c, {_Q.format("o_custkey")} q, o_orderkey % 5 shape from orders)
    select k o_orderkey, '{_HEAD}[<|START_OF_GROUP|>][<|stroke=|>]red[<|transform=|>]translate(' || q || ' 2)[<|class=|>]a_b' || case shape
        when 0 then '[<|rect|>][<|fill=|>]blue[<|stroke-width=|>]2[<|stroke=|>]red[<|width=|>]' || q || '[<|height=|>]' || c || '[<|x=|>]1[<|id=|>]r_' || k || '[<|/rect|>]'
        when 1 then '[<|circle|>][<|fill=|>]#fff[<|stroke=|>]red[<|cx=|>]' || q || '[<|cy=|>]' || c || '[<|r=|>]3[<|/circle|>]'
        when 2 then '[<|line|>][<|stroke=|>]red[<|x1=|>]' || q || '[<|y1=|>]0[<|x2=|>]5[<|y2=|>]' || c || '[<|/line|>]'
        when 3 then '[<|polyline|>][<|stroke=|>]red[<|points=|>]' || q || ' ' || c || ' 7.5 8[<|/polyline|>]'
        else '[<|path|>][<|d=|>][<|moveto_abs|>]' || q || ' ' || c || '[<|lineto_rel|>]1000 2[<|elliptical_arc_abs|>]5 5 0 1 0 9 ' || q || '[<|close_path|>][<|moveto_rel|>]1 1[<|fill=|>]none[<|stroke=|>]red[<|/path|>]'
        end || '[<|END_OF_GROUP|>][<|END_OF_SVG|>]' tokens
    from a""",
)
def svg_encode_shapes(spark: SparkSession, d: str) -> DataFrame:
    """One shape of five kinds in a group whose stroke it inherits; numbers lose units and decimals beyond one."""
    c, k = F.col("o_custkey"), F.col("o_orderkey")
    q = F.format_string("%.2f", c / 4.0)
    shapes = [
        _join('<rect id="r_', k, '" fill="red" style="fill: blue; stroke-width: 2px" x="1.0" width="', q, 'px" height="', c, '"/>'),
        _join('<circle cx="', q, '" cy="', c, '" r="3.00" fill="#fff"/>'),
        _join('<line x1="', q, '" y1="0" x2="5" y2="', c, '.0"/>'),
        _join('<polyline points="', q, ",", c, ' 7.5,8.0"/>'),
        _join('<path fill="none" d="M', q, " ", c, "l1e3,2 A5 5 0 109 ", q, 'Zm1 1"/>'),
    ]
    # A style is written as it is, too.
    shape = F.coalesce(*[F.when(k % 5 == i, s) for i, s in enumerate(shapes)])
    svg = _join('<svg xmlns="http://www.w3.org/2000/svg" width="512px" height="512" viewBox="0 0 512.0 512"><g class="a_b" stroke="red" transform="translate(', F.col("g"), ' 2)"><desc>gone</desc>', F.col("shape"), "</g></svg>")
    o = read(spark, d, "orders").select("o_orderkey", token_number(q).alias("g"), shape.alias("shape"))
    found = codec.encoded(o.select("o_orderkey", svg.alias("svg")), "svg")
    return found.select("o_orderkey", F.regexp_replace("tokens", r"\[<\|style=\|>\][^\[]*", "").alias("tokens"))


@query(
    "svg_encode_texts",
    """
    select p_partkey, '[<|START_OF_SVG|>][<|text|>][<|x=|>]' || p_size || '[<|font-size=|>]1.2em[<|text-content=|>]size ' || p_size || ' & id=7'
        || '[<|tspan|>][<|dy=|>]1.5[<|font-size=|>]1.2em[<|text-content=|>]two[<|/tspan|>][<|text-content=|>]tail[<|/text|>][<|defs|>][<|clipPath|>][<|id=|>]c' || p_partkey
        || '[<|rect|>][<|width=|>]5[<|/rect|>][<|/clipPath|>][<|/defs|>][<|START_OF_GROUP|>][<|x=|>]3[<|END_OF_GROUP|>][<|use|>][<|href=|>]#c[<|/use|>][<|END_OF_SVG|>]' tokens
    from part""",
)
def svg_encode_texts(spark: SparkSession, d: str) -> DataFrame:
    """Texts keep what looks like an attribute; nested drawings are groups; uses and definitions stay."""
    n, k = F.col("p_size"), F.col("p_partkey")
    svg = _join('<svg xmlns:xlink="http://www.w3.org/1999/xlink"><text x="', n, '.0px" font-size="1.2em">size ', n, ' &amp; id=7<tspan dy="1.5">two</tspan> tail</text><script>no</script><defs><clipPath id="c', k, '" class="z"><rect width="5"/></clipPath></defs><svg x="3"/><use xlink:href="#c"/></svg>')
    p = read(spark, d, "part").select("p_partkey", svg.alias("svg"))
    return codec.encoded(p, "svg").select("p_partkey", "tokens")


_SVG = '<svg xmlns="http://www.w3.org/2000/svg" width="512" height="512" viewBox="0 0 512 512">'


@query(
    "svg_decode_shapes",
    f"""
    with a as (select o_orderkey k, o_custkey c, o_orderkey % 5 shape from orders)
    select k o_orderkey, '{_SVG}<g class="a_b" transform="rotate(5) translate(' || c || ', 4)">' || case shape
        when 0 then '<rect width="' || c || '" height="9" fill="none"/>'
        when 1 then '<circle r="' || c || '" fill="red"/><line x1="' || c || '" stroke="#000000" fill="none" stroke-width="1.0"/>'
        when 2 then '<text x="1" fill="#000000">a_' || c || ' &lt; b<tspan dy="2">two</tspan>tail</text>'
        when 3 then '<path d="M ' || c || ' 2 L 3 4 z" stroke="red" stroke-width="1.0"/>'
        else '<defs><clipPath id="p"><rect width="' || c || '"/></clipPath></defs><polygon points="1 2" style="opacity: 0.5; fill: blue" fill="blue"/>' end
        || '</g></svg>' svg
    from a""",
)
def svg_decode_shapes(spark: SparkSession, d: str) -> DataFrame:
    """Open elements close by themselves, paints that are not said are set, and styles take what they lack."""
    c, k = F.col("o_custkey"), F.col("o_orderkey")
    shapes = [
        _join("[<|rect|>][<|width=|>]", c, "[<|height=|>]9[<|/rect|>]"),
        _join("[<|circle|>][<|r=|>]", c, "[<|fill=|>]red[<|line|>][<|x1=|>]", c),
        _join("[<|text|>][<|x=|>]1[<|text-content=|>]a_", c, " < b[<|tspan|>][<|dy=|>]2[<|text-content=|>]two[<|/tspan|>][<|text-content=|>]tail[<|/text|>]"),
        _join("[<|path|>][<|d=|>][<|moveto_abs|>]", c, " 2[<|lineto_abs|>]3 4[<|close_path|>][<|stroke=|>]red[<|/path|>][<|/rect|>]"),
        _join("[<|defs|>][<|clipPath|>][<|id=|>]p[<|rect|>][<|width=|>]", c, "[<|/rect|>][<|/defs|>][<|polygon|>][<|points=|>]1 2[<|style=|>]opacity: 0.5[<|fill=|>]blue[<|/polygon|>]"),
    ]
    shape = F.coalesce(*[F.when(k % 5 == i, s) for i, s in enumerate(shapes)])
    tokens = _join(_HEAD, "[<|START_OF_GROUP|>][<|class=|>]a_b[<|transform=|>]rotate(5)[<|x=|>]", c, "[<|y=|>]4", shape, "[<|END_OF_GROUP|>][<|END_OF_SVG|>]")
    o = read(spark, d, "orders").select("o_orderkey", tokens.alias("tokens"))
    return codec.decoded(o, "tokens").select("o_orderkey", "svg")


@query(
    "svg_roundtrip",
    f"""
    select o_orderkey, '{_SVG}<g fill="red"><rect fill="blue" width="' || o_custkey || '" height="' || (o_orderkey % 500) || '" x="0.5" y="2"/><path d="M 1 ' || o_custkey || ' h 4 z" fill="red" stroke="#00f" stroke-width="2"/><text fill="red" x="3" font-size="10">o' || o_orderkey || '</text></g></svg>' svg
    from orders""",
)
def svg_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """A drawing whose every paint is said comes back from its tokens, with what groups hand down written out."""
    svg = _join(_SVG, '<g fill="red"><rect x="0.50" y="2" width="', F.col("o_custkey"), '" height="', F.col("o_orderkey") % 500, '" fill="blue"/><path d="M1 ', F.col("o_custkey"), 'h4z" stroke="#00f" stroke-width="2"/><text x="3" font-size="10">o', F.col("o_orderkey"), "</text></g></svg>")
    o = read(spark, d, "orders").select("o_orderkey", svg.alias("text"))
    return codec.decoded(codec.encoded(o, "text").drop("text"), "tokens").select("o_orderkey", "svg")


_TOKENS = "[<|rect|>][<|width=|>]12 [<|num|>] -3.5 ab_c[<|/rect|>]"


@query(
    "token_ids",
    """
    with v(id, token) as (values (0::bigint, '[<|rect|>]'), (1, '[<|width=|>]'), (2, '[<|/rect|>]'), (3, '[<|num|>]'), (4, 'ab'), (5, '_'), (6, '-3.5')),
    t as (select o_orderkey, unnest(['[<|rect|>]', '[<|width=|>]', o_custkey::varchar, '[<|num|>]', '-3.5', 'ab', '_', 'c', '[<|/rect|>]']) token,
        unnest(range(9))::int pos from orders)
    select o_orderkey, pos, t.token, id from t left join v using (token)""",
)
def token_ids(spark: SparkSession, d: str) -> DataFrame:
    """Semantic tokens whole, the rest by numbers, words and single characters; ids where the vocabulary has them."""
    vocab = ["[<|rect|>]", "[<|width=|>]", "[<|/rect|>]", "[<|num|>]", "ab", "_", "-3.5"]
    v = spark.createDataFrame(list(enumerate(vocab)), "id bigint, token string")
    text = _join("[<|rect|>][<|width=|>]", F.col("o_custkey"), " [<|num|>] -3.5 ab_c[<|/rect|>]")
    t = read(spark, d, "orders").select("o_orderkey", F.posexplode(codec.token_list(text)).alias("pos", "token"))
    return t.join(F.broadcast(v), "token", "left").select("o_orderkey", "pos", "token", "id")


@query(
    "special_token_ids",
    """
    select * from (values ('[<|number|>]', 7::bigint), ('[<|color|>]', 8), ('[<|mask|>]', null), (' ', 220)) t(token, id)""",
)
def special_token_ids(spark: SparkSession, d: str) -> DataFrame:
    """Ids of the tokens for spaces, numbers, colours and masks; null where the vocabulary lacks one."""
    asked = spark.createDataFrame([("[<|number|>]",), ("[<|color|>]",), ("[<|mask|>]",), (" ",)], "token string")
    vocab = spark.createDataFrame([(7, "[<|number|>]"), (8, "[<|color|>]"), (220, " "), (9, "x")], "id bigint, token string")
    return asked.join(F.broadcast(vocab), "token", "left").select("token", "id")


@query(
    "token_words",
    """
    select p_partkey, 'rect at ' || p_size || ', rect wide; circle @ ' || p_size text from part""",
)
def token_words(spark: SparkSession, d: str) -> DataFrame:
    """A dictionary's keys by its values in one pass, the longest key first, values not read again."""
    p = read(spark, d, "part").select("p_partkey", _join("<r> at ", F.col("p_size"), ", <r>w; <c> @ ", F.col("p_size")).alias("raw"))
    words = {"<r>": "rect", "<r>w": "rect wide", "<c>": "circle", "rect": "never"}
    return codec.mapped_words(p, "raw", words, "text").select("p_partkey", "text")


@query(
    "token_contents",
    """
    select p_partkey, '[<|START_OF_SVG|>][<|text|>][<|id=|>]a_' || p_size as open_ended, 'a b' || p_size as spaced, 'a_b' || p_size as kept, 9::int n_tokens,
        '[<|text|>] [<|id=|>] a _ b ' || p_size || ' [<|/text|>]' joined from part""",
)
def token_contents(spark: SparkSession, d: str) -> DataFrame:
    """Tokens without an end run to the end; underscores are spaces where asked; a list of tokens joins to a text again."""
    from quarry.functions import text as T

    n = F.col("p_size")
    tokens = _join("[<|START_OF_SVG|>][<|text|>][<|id=|>]a_b", n, "[<|/text|>][<|END_OF_SVG|>]")
    p = read(spark, d, "part").select("p_partkey", _join("so: [<|START_OF_SVG|>][<|text|>][<|id=|>]a_", n).alias("said"), tokens.alias("tokens"))
    p = codec.decoded(codec.decoded(p, "tokens", "plain"), "tokens", "wide", spaces=True)
    own = lambda c: F.regexp_extract(c, 'id="([^"]*)"', 1)
    listed = codec.token_list(F.col("tokens"))
    return p.select("p_partkey", T.outer_svg(F.col("said")).alias("open_ended"), own("wide").alias("spaced"), own("plain").alias("kept"), F.size(listed).alias("n_tokens"), F.array_join(F.slice(listed, 2, 7), " ").alias("joined"))
