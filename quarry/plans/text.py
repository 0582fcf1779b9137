"""Queries over text functions: markup cleaning, style lists, completions, numbers in text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import text as T

from .registry import query, read


@query(
    "repeat_penalty",
    r"""
    with t as (select page_id, regexp_extract_all(trim(regexp_replace(html, '\s+', ' ', 'g')), '<[^>]+?>') tags from pages)
    select page_id, len(tags)::bigint tags, len(list_distinct(tags))::bigint unique_tags,
           case when len(tags) = 0 then 1.0::double else greatest(0.8::double, 1.0::double - 0.5::double * (len(tags) - len(list_distinct(tags))) / len(tags)) end penalty
    from t""",
)
def repeat_penalty(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "pages").select("page_id", T.repeat_penalty(F.col("html")).alias("p")).select("page_id", "p.*")


@query(
    "strip_script_style_blocks",
    r"""
    with a as (select page_id, html, regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', '', 'g'), '(?is)<style[^>]*>.*?</style>', '', 'g') c from pages),
    b as (select page_id, html, regexp_replace(regexp_replace(c, '(?i)<image[^>]*?/>', '', 'g'), '(?is)<image[^>]*?>.*?</image>', '', 'g') c from a)
    select page_id, length(html)::bigint raw_chars, length(c)::bigint clean_chars, md5(c) digest from b""",
)
def strip_script_style_blocks(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "pages").withColumn("c", T.strip_images(T.strip_blocks(F.col("html"), ["script", "style"])))
    return p.select("page_id", F.length("html").cast("long").alias("raw_chars"), F.length("c").cast("long").alias("clean_chars"), F.md5("c").alias("digest"))


@query(
    "strip_branding",
    r"""
    with s as (select o_orderkey, '<svg><text class="highcharts-credits" x="' || o_orderkey || '">h</text><g class="x">' || o_orderpriority || '</g><text>Created with Highcharts 5</text><a class="creditgroup">q</a></svg>' svg from orders)
    select o_orderkey, '<svg><g class="x">' || regexp_extract(svg, '<g class="x">(.*?)</g>', 1) || '</g></svg>' clean from s""",
)
def strip_branding(spark: SparkSession, d: str) -> DataFrame:
    svg = F.concat(F.lit('<svg><text class="highcharts-credits" x="'), F.col("o_orderkey").cast("string"), F.lit('">h</text><g class="x">'), F.col("o_orderpriority"), F.lit('</g><text>Created with Highcharts 5</text><a class="creditgroup">q</a></svg>'))
    return read(spark, d, "orders").select("o_orderkey", T.strip_branding(svg).alias("clean"))


@query(
    "html_masquerade_filter",
    r"""
    with u as (select 'page' kind, page_id id, html body from pages union all select 'document', doc_id, text from documents),
    h as (select kind, id, lower(regexp_replace(substring(body, 1, 500), '^\s+|\s+$', '', 'g')) head from u)
    select kind, id, starts_with(head, '<!doctype html') or contains(head, '<html') or contains(head, 'parsererror') or contains(head, 'xml parsing error') masquerade from h""",
)
def html_masquerade_filter(spark: SparkSession, d: str) -> DataFrame:
    pages = read(spark, d, "pages").select(F.lit("page").alias("kind"), F.col("page_id").alias("id"), F.col("html").alias("body"))
    docs = read(spark, d, "documents").select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), F.col("text").alias("body"))
    return pages.unionAll(docs).select("kind", "id", T.is_html_masquerade(F.col("body")).alias("masquerade"))


@query(
    "xml_declaration_and_xlink",
    """
    select p_partkey, case when p_size % 2 = 0
        then '<svg xmlns:xlink="http://www.w3.org/1999/xlink"><use xlink:href="#a' || p_size || '"/></svg>'
        else '<svg><use href="#a' || p_size || '"/></svg>' end svg from part""",
)
def xml_declaration_and_xlink(spark: SparkSession, d: str) -> DataFrame:
    size = F.col("p_size").cast("string")
    raw = F.concat(F.lit('<?xml version="1.0"?>\n<svg><use '), F.when(F.col("p_size") % 2 == 0, "xlink:").otherwise(""), F.lit('href="#a'), size, F.lit('"/></svg>\n'))
    return read(spark, d, "part").select("p_partkey", T.declare_xlink(T.strip_xml_declaration(raw)).alias("svg"))


@query(
    "identity_transforms",
    """select o_orderkey, '<g /><g transform="matrix(1,0,0,1,' || (o_orderkey + 1) || ',0)"/>' svg from orders""",
)
def identity_transforms(spark: SparkSession, d: str) -> DataFrame:
    g = F.when(F.col("o_orderkey") % 2 == 0, "matrix(1.0, 0.0, 0.0, 1.0, 0.0, 0.0)").otherwise("matrix( 1, 0 ,0,1,0,0 )")
    svg = F.concat(F.lit('<g transform="'), g, F.lit('"/><g transform="matrix(1,0,0,1,'), (F.col("o_orderkey") + 1).cast("string"), F.lit(',0)"/>'))
    return read(spark, d, "orders").select("o_orderkey", T.strip_identity_transforms(svg).alias("svg"))


@query(
    "completion_extract",
    r"""
    select o_orderkey, '<svg id="' || o_orderkey || '"></svg>' first_svg,
        '<svg id="' || o_orderkey || '"></svg> mid <svg></svg>' outer_svg,
        '[<|START_OF_SVG|>]' || o_orderpriority || '[<|END_OF_SVG|>]' token_svg, o_orderpriority bare, ''  absent from orders""",
)
def completion_extract(spark: SparkSession, d: str) -> DataFrame:
    svg = F.concat(F.lit('<svg id="'), F.col("o_orderkey").cast("string"), F.lit('"></svg>'))
    both = F.concat(F.lit("Here: ```svg\n"), svg, F.lit(" mid <svg></svg>\n``` done"))
    token = F.concat(F.lit("x [<|START_OF_SVG|>]"), F.col("o_orderpriority"), F.lit("[<|END_OF_SVG|>] y"))
    fenced = F.concat(F.lit("```xml\n"), F.col("o_orderpriority"), F.lit("\n```"))
    return read(spark, d, "orders").select(
        "o_orderkey", T.first_svg(both).alias("first_svg"), T.outer_svg(both).alias("outer_svg"), T.outer_svg(token).alias("token_svg"), T.first_svg(fenced).alias("bare"), T.outer_svg(F.col("o_orderpriority")).alias("absent")
    )


@query(
    "invisible_cleanup",
    r"""select doc_id, md5(regexp_replace(replace(replace(text || chr(160) || 'x' || chr(8203) || 'y', chr(160), ' '), chr(8203), ''), '\s+', ' ', 'g')) digest from documents""",
)
def invisible_cleanup(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", F.md5(T.clean_invisible(F.concat("text", F.lit(" x​y")))).alias("digest"))


@query(
    "style_parse",
    """
    select p_partkey, 'c' || p_size fill, p_size || 'px' stroke_width, 3::bigint n,
        'fill: c' || p_size || '; stroke-width: ' || p_size || 'px' cleaned from part""",
)
def style_parse(spark: SparkSession, d: str) -> DataFrame:
    size = F.col("p_size").cast("string")
    style = F.concat(F.lit("fill: c"), size, F.lit("; stroke-width: "), size, F.lit("px;opacity:NaN"))
    m = T.style_map(F.concat(F.lit("fill: old;"), style))
    return read(spark, d, "part").select(
        "p_partkey", F.element_at(m, "fill").alias("fill"), F.element_at(m, "stroke-width").alias("stroke_width"), F.size(m).cast("long").alias("n"), T.drop_invalid_styles(style).alias("cleaned")
    )


@query(
    "cjk_detect",
    r"""select doc_id, regexp_matches(text, '[\x{2e80}-\x{2fff}\x{3040}-\x{30ff}\x{31f0}-\x{31ff}\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{f900}-\x{faff}]') cjk, regexp_matches(text, '[^\x00-\x7f]') nonascii,
        regexp_matches(text || case when doc_id % 3 = 0 then chr(26085) else '' end, '[\x{2e80}-\x{2fff}\x{3040}-\x{30ff}\x{31f0}-\x{31ff}\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{f900}-\x{faff}]') planted from documents""",
)
def cjk_detect(spark: SparkSession, d: str) -> DataFrame:
    planted = F.concat("text", F.when(F.col("doc_id") % 3 == 0, "日").otherwise(""))
    return read(spark, d, "documents").select("doc_id", T.has_cjk(F.col("text")).alias("cjk"), F.col("text").rlike(r"[^\x00-\x7f]").alias("nonascii"), T.has_cjk(planted).alias("planted"))


@query(
    "font_assignment",
    """select p_partkey, case when p_size % 3 = 0 then 'fill: red; font-family: ''PingFang TC'',''PingFang SC'',''Songti TC'',''Songti SC'',sans-serif; x: y'
        when p_size % 3 = 1 then 'fill: red; font-family: ''PingFang TC'',''PingFang SC'',''Songti TC'',''Songti SC'',sans-serif'
        else 'font-family: ''PingFang TC'',''PingFang SC'',''Songti TC'',''Songti SC'',sans-serif' end style from part""",
)
def font_assignment(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_size") % 3
    style = F.when(k == 0, "fill: red; font-family:Arial; x: y").when(k == 1, "fill: red; ").otherwise("")
    return read(spark, d, "part").select("p_partkey", T.set_font(style).alias("style"))


@query(
    "bracket_tidy",
    r"""select o_orderkey, '[a]' || o_orderkey || ' 5[b][c]' tidy, 'x [a] ' || o_orderkey || ' [b]' padded, 'xa' || o_orderkey || 'b' bare from orders""",
)
def bracket_tidy(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("o_orderkey").cast("string")
    return read(spark, d, "orders").select(
        "o_orderkey", T.tidy_brackets(F.concat(F.lit(" [ a ] "), key, F.lit("   5 [b]  [ c ]"))).alias("tidy"), T.pad_brackets(F.concat(F.lit("x[a]"), key, F.lit("[b]"))).alias("padded"), T.drop_square_brackets(F.concat(F.lit("x[a]"), key, F.lit("[b]"))).alias("bare")
    )


@query(
    "colour_extract",
    r"""select p_partkey, '#0a' || lpad((p_size)::varchar, 2, '0') || 'ff,#abc' colours, 2::bigint n,
        'fill [<|color|>] stroke [<|color|>] end' marked from part""",
)
def colour_extract(spark: SparkSession, d: str) -> DataFrame:
    s = F.concat(F.lit("fill #0a"), F.lpad(F.col("p_size").cast("string"), 2, "0"), F.lit("ff stroke #abc end"))
    found = T.every(s, T.COLOUR)
    return read(spark, d, "part").select("p_partkey", F.array_join(found, ",").alias("colours"), F.size(found).cast("long").alias("n"), F.regexp_replace(s, T.COLOUR, "[<|color|>]").alias("marked"))


@query(
    "number_channel",
    r"""
    with n as (select doc_id, regexp_extract_all(text, '-?\d*\.?\d+') found, regexp_replace(text, '-?\d*\.?\d+', '<|num|>', 'g') marked from documents),
    k as (select doc_id, found, marked, list_transform(found, lambda x: x::double) v from n)
    select doc_id, len(found)::bigint n, coalesce(list_sum(v), 0)::double total, array_to_string(found, ' ') numbers, md5(marked) digest from k""",
)
def number_channel(spark: SparkSession, d: str) -> DataFrame:
    found = T.every(F.col("text"), T.NUMBER)
    values = F.transform(found, lambda x: x.try_cast("double"))
    return read(spark, d, "documents").select(
        "doc_id", F.size(found).cast("long").alias("n"), F.aggregate(values, F.lit(0.0), lambda s, x: s + x).alias("total"), F.array_join(found, " ").alias("numbers"), F.md5(F.regexp_replace("text", T.NUMBER, "<|num|>")).alias("digest")
    )


@query(
    "aligned_numbers",
    r"""
    with t as (select o_orderkey, ['[<|x=|>]', o_orderkey::varchar, '[<|y=|>]', o_custkey::varchar] tok from orders)
    select o_orderkey, array_to_string(list_transform(tok, lambda x: case when regexp_matches(x, '^-?\d*\.?\d+$') then '<|num|>' else x end), ' ') ids,
        array_to_string(list_transform(tok, lambda x: case when regexp_matches(x, '^-?\d*\.?\d+$') then x else '-10000' end), ' ') numbers from t""",
)
def aligned_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Number channel beside tokens: the value where a token is a number, -10000 elsewhere."""
    text = F.concat(F.lit("[<|x=|>]"), F.col("o_orderkey").cast("string"), F.lit("[<|y=|>]"), F.col("o_custkey").cast("string"))
    tok = F.split(T.pad_brackets(text), " ")
    number = lambda x: x.rlike(rf"^{T.NUMBER}$")
    return read(spark, d, "orders").select(
        "o_orderkey", F.array_join(F.transform(tok, lambda x: F.when(number(x), "<|num|>").otherwise(x)), " ").alias("ids"), F.array_join(F.transform(tok, lambda x: F.when(number(x), x).otherwise("-10000")), " ").alias("numbers")
    )


@query("num_reinsert", """select o_orderkey, 'x ' || o_orderkey || ' y ' || o_custkey || ' z <missing_num> e' filled from orders""")
def num_reinsert(spark: SparkSession, d: str) -> DataFrame:
    numbers = F.array(F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string"))
    return read(spark, d, "orders").select("o_orderkey", T.reinsert_numbers(F.lit("x <|num|> y <|num|> z <|num|> e"), numbers).alias("filled"))


@query(
    "score_extract",
    """select o_orderkey, (o_custkey % 13) / 10.0::double as raw, least(greatest((o_custkey % 13) / 10.0, 0.0), 1.0)::double bracketed,
        least((o_custkey % 7) / 10.0, 1.0)::double as at_end, 0.0::double as absent, case when o_custkey % 2 = 0 then 1.0 else 0.0 end::double as yes from orders""",
)
def score_extract(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_custkey")
    return read(spark, d, "orders").select(
        "o_orderkey", ((k % 13) / 10.0).alias("raw"), T.bracketed_score(F.concat(F.lit("So [["), (k % 13).cast("string"), F.lit("]] then 3"))).alias("bracketed"), T.bracketed_score(F.concat(F.lit("Final "), (k % 7).cast("string"), F.lit(" \n"))).alias("at_end"),
        T.bracketed_score(F.lit("no score here")).alias("absent"), T.yes_no(F.when(k % 2 == 0, "same [[YES]]").otherwise("not [[NO]]")).alias("yes"),
    )


@query(
    "answer_equality",
    """select conv_id, turn, case when turn % 2 = 0 then 1.0 else 0.0 end::double reward from conversations""",
)
def answer_equality(spark: SparkSession, d: str) -> DataFrame:
    """String half of answer checking: the text in answer tags, or the whole, must be equal after trimming."""
    k = F.col("turn").cast("string")
    said = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("<think>t</think><answer> "), k, F.lit(" </answer>"))).otherwise(F.concat(k, F.lit(" or so")))
    return read(spark, d, "conversations").select("conv_id", "turn", (T.answer(said) == T.answer(F.concat(F.lit(" "), k))).cast("double").alias("reward"))


@query(
    "format_gate",
    """select conv_id, turn, case when turn % 4 <> 3 then 1.0 else 0.0 end::double reward, turn % 2 = 0 code_ok from conversations""",
)
def format_gate(spark: SparkSession, d: str) -> DataFrame:
    k, body = F.col("turn"), F.regexp_replace("text", "[<>]", "")
    think = F.concat(F.lit("<think>"), body, F.lit("</think>"))
    call, says = F.lit("\n<tool_call>{}</tool_call>"), F.lit("<response>ok</response>")
    response = F.when(k % 4 == 0, F.concat(think, says)).when(k % 4 == 1, F.concat(think, call)).when(k % 4 == 2, F.concat(think, call, F.lit("\n"), says)).otherwise(F.concat(think, says, says))
    solution = F.when(k % 4 == 1, "<tool_call>").when(k % 4 == 2, "<tool_call><response>").otherwise("<response>")
    code = F.concat(think, F.lit("\n<answer>```"), F.when(k % 2 == 0, "python").otherwise("perl"), F.lit("\nx```</answer>"))
    return read(spark, d, "conversations").select("conv_id", "turn", T.format_ok(response, solution).cast("double").alias("reward"), T.code_format_ok(code, "python").alias("code_ok"))


@query(
    "think_length_reward",
    r"""
    with w as (select conv_id, turn, regexp_replace(replace(replace(text, '<', ''), '>', ''), '^\s+|\s+$', '', 'g') b from conversations),
    c as (select conv_id, turn, case when b = '' then 0 else len(regexp_split_to_array(b, '\s+')) end n from w)
    select conv_id, turn, n::bigint words, least(format('{:.2f}', n / 512.0::double)::double, 1.0::double) reward from c""",
)
def think_length_reward(spark: SparkSession, d: str) -> DataFrame:
    from quarry.operators.rewards import think_length

    said = F.concat(F.lit("<think>skip</think> <think>"), F.regexp_replace("text", "[<>]", ""), F.lit("</think> <response>x</response>"))
    return read(spark, d, "conversations").select("conv_id", "turn", T.word_count(F.regexp_replace("text", "[<>]", "")).cast("long").alias("words"), think_length(said).alias("reward"))


@query(
    "code_blocks",
    """select o_orderkey, 'print(' || o_orderkey || ')' || chr(10) as code, '' as missing, case when o_custkey % 3 = 0 then 54 when o_custkey % 3 = 1 then 71 else 71 end::int as language_id from orders""",
)
def code_blocks(spark: SparkSession, d: str) -> DataFrame:
    said = F.concat(F.lit("```python\nold\n``` then ```python\nprint("), F.col("o_orderkey").cast("string"), F.lit(")\n``` end"))
    k = F.col("o_custkey") % 3
    language = F.when(k == 0, " C++ ").when(k == 1, "unknown")
    return read(spark, d, "orders").select("o_orderkey", T.last_code_block(said, "python").alias("code"), T.last_code_block(said, "rust").alias("missing"), T.language_id(language).cast("int").alias("language_id"))


@query(
    "tool_call_extract",
    """select conv_id, turn, 2::bigint as calls, 'search' as tool, 'q' || turn as params, null::bigint as without from conversations""",
)
def tool_call_extract(spark: SparkSession, d: str) -> DataFrame:
    said = F.concat(F.lit("Thought.\nAction: search \nAction Input:  q"), F.col("turn").cast("string"), F.lit("\nObservation\nAction: calc\nAction Input: 1+1"))
    calls = T.tool_calls(said)
    none = F.when(T.tool_calls(F.lit("nothing")).isNotNull(), F.lit(1).cast("long"))
    return read(spark, d, "conversations").select("conv_id", "turn", F.size(calls).cast("long").alias("calls"), calls[0]["tool"].alias("tool"), calls[0]["params"].alias("params"), none.alias("without"))


@query(
    "xml_quoting",
    """select doc_id, md5(replace(replace(replace(t, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')) body,
        case when doc_id % 2 = 0 then '''a "b" &amp;''' else '"it&quot;s ''b''"' end attribute
        from (select doc_id, text || '<&>' t from documents)""",
)
def xml_quoting(spark: SparkSession, d: str) -> DataFrame:
    value = F.when(F.col("doc_id") % 2 == 0, 'a "b" &').otherwise("it\"s 'b'")
    return read(spark, d, "documents").select("doc_id", F.md5(T.escape_text(F.concat("text", F.lit("<&>")))).alias("body"), T.quote_attribute(value).alias("attribute"))


@query(
    "prompt_between",
    """select doc_id, trim(source) question, null::varchar as absent, lang || '. ' || source as prompt from documents""",
)
def prompt_between(spark: SparkSession, d: str) -> DataFrame:
    problem = F.concat(F.lit("<text>intro</text>  "), "source", F.lit(" \nFormat your response as follows: x"))
    return read(spark, d, "documents").select("doc_id", T.between(problem, "</text>", "Format your response as follows:").alias("question"), T.between(F.col("lang"), "</text>", "Format").alias("absent"), F.concat_ws(". ", "lang", "source").alias("prompt"))


@query(
    "path_names",
    r"""select page_id, regexp_extract(url, '([^/]*)$', 1) base, regexp_replace(regexp_extract(url || 'a.b.png', '([^/]*)$', 1), '\.[^.]*$', '') stem, '.hidden' as dotfile, page_id % 2 = 0 closed from pages""",
)
def path_names(spark: SparkSession, d: str) -> DataFrame:
    path = F.when(F.col("page_id") % 2 == 0, "M0 0L1 1Z ").otherwise("M0 0L1 1")
    return read(spark, d, "pages").select("page_id", T.basename(F.col("url")).alias("base"), T.stem(F.concat("url", F.lit("a.b.png"))).alias("stem"), T.stem(F.lit("a/.hidden")).alias("dotfile"), T.path_is_closed(path).alias("closed"))


@query(
    "stable_hash_shard",
    """
    with h as (select page_id, url, list_reduce(list_prepend(0::bigint, list_transform(string_split(url, ''), lambda x: unicode(x)::bigint)), lambda a, x: (a * 31 + x) & 4294967295) h from pages)
    select page_id, h, (h % 8)::bigint shard from h""",
)
def stable_hash_shard(spark: SparkSession, d: str) -> DataFrame:
    h = T.stable_hash(F.col("url"))
    return read(spark, d, "pages").select("page_id", h.alias("h"), (h % 8).alias("shard"))


@query(
    "glob_protect",
    """select p_partkey, p_name, (p_name like '%a%e%' or p_name like 'b_%') keep from part""",
)
def glob_protect(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "part").select("p_partkey", "p_name", T.glob_match(F.col("p_name"), ["*a*e*", "b?*"]).alias("keep"))


@query(
    "marker_select",
    r"""select page_id from pages where contains(html, 'class="nav') or contains(html, 'cookie')""",
)
def marker_select(spark: SparkSession, d: str) -> DataFrame:
    html = F.col("html")
    return read(spark, d, "pages").where(html.contains('class="nav') | html.contains("cookie")).select("page_id")
