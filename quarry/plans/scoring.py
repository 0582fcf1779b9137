"""Queries that score completions, run tools, compare pictures, and shape texts and records around that."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import geometry as G
from quarry.functions import numeric as N
from quarry.functions import text as T
from quarry.operators import metrics, raster, records, rewards
from quarry.operators.tree import digits12

from .registry import query, read


def _join(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _of(key: str, *cases: Column) -> Column:
    return F.coalesce(*[F.when(F.col(key) % len(cases) == i, c) for i, c in enumerate(cases)])


# --- rewards ------------------------------------------------------------------------------------------------------------


@query(
    "countdown_reward",
    """
    select o_orderkey, case when o_orderkey % 7 in (0, 1) then 1.0 else 0.0 end::double score from orders""",
)
def countdown_reward(spark: SparkSession, d: str) -> DataFrame:
    """Right answers with brackets and with division; a wrong result, other numbers, other characters, no answer, a fault."""
    a, b = F.col("o_custkey") % 9 + 1, F.col("o_orderkey") % 50 + 1
    answer = _of(
        "o_orderkey",
        _join("so <answer>(", a, " + ", b, ") * 3 = ?</answer>"),
        _join("<answer>", b, " * 3 + ", a, "*3 - ", a, " * 0</answer>"),
        _join("<answer>", a, " + ", b, " * 3 + 0</answer>"),
        _join("<answer>(", a, " + ", b, ") * 3 + 9 - 9</answer>"),
        _join("<answer>(", a, " + ", b, ") * 3 + x</answer>"),
        _join("(", a, " + ", b, ") * 3"),
        _join("<answer>", a, " / (", b, " - ", b, ")</answer>"),
    )
    numbers = _of("o_orderkey", *[F.array(*[x.cast("int") for x in own]) for own in ((F.lit(3), a, b), (a, F.lit(3), b, F.lit(3), a, F.lit(0)), (a, b, F.lit(3), F.lit(0)), (a, b, F.lit(3)), (a, b, F.lit(3)), (a, b, F.lit(3)), (a, b, b))])
    o = read(spark, d, "orders")
    return o.select("o_orderkey", rewards.countdown(answer, ((a + b) * 3 + F.when(F.col("o_orderkey") % 7 == 2, 7777).otherwise(0)).cast("double"), numbers).alias("score"))


@query(
    "tool_correct_reward",
    """
    select o_orderkey, case o_orderkey % 8 when 0 then 3.0 when 1 then 1.5 when 2 then 0.75 when 3 then -3.0 when 4 then -3.0 when 5 then -3.0 when 6 then 0.0 else 3.0 end::double fine,
        case when o_orderkey % 8 in (0, 7) then 3.0 when o_orderkey % 8 in (1, 2) then 0.0 when o_orderkey % 8 = 6 then 0.0 else -3.0 end::double intermediate,
        case when o_orderkey % 8 in (0, 7) then 3.0 when o_orderkey % 8 = 6 then 0.0 else -3.0 end::double coarse from orders""",
)
def tool_correct_reward(spark: SparkSession, d: str) -> DataFrame:
    """Equal calls, another value, a missing parameter, another tool, no call, no JSON, nothing asked, calls in a list."""
    c = F.col("o_custkey")
    call = lambda inner, name="f": _join('<tool_call>\n{"name": "', name, '", "parameters": {', inner, "}}\n</tool_call>")
    right = call(_join('"a": ', c, ', "b": "x"'))
    said = _of("o_orderkey", right, call(_join('"a": ', c, ', "b": "y"')), call(_join('"a": ', c)), call(_join('"a": ', c, ', "b": "x"'), "g"), F.lit("none"), F.lit("<tool_call>oh</tool_call>"), right, F.concat(F.lit("<think>a</think>"), right))
    asked = F.when(F.col("o_orderkey") % 8 == 6, "just text").otherwise(right)
    return read(spark, d, "orders").select("o_orderkey", *[rewards.tool_correct(said, asked, g).alias(g) for g in ("fine", "intermediate", "coarse")])


@query(
    "tool_observations",
    """
    select o_orderkey, case o_orderkey % 4 when 0 then 'Result: ' || (o_custkey * 3 - 1) || '|Result: 2.5' when 1 then 'unknown tool search|Error: unmatched parentheses.'
        when 2 then 'Error: expression contains disallowed characters.|Calculation error: division by zero' end observations from orders""",
)
def tool_observations(spark: SparkSession, d: str) -> DataFrame:
    """What the tools of a text answer, in order; unknown tools and failures are answers too; null without any call."""
    c = F.col("o_custkey")
    text = _of(
        "o_orderkey",
        _join("Action: calculator\nAction Input: ", c, " * 3 - 1\nthen\nAction: calculator \nAction Input: 5/(1+1)"),
        F.lit("Action: search\nAction Input: x\nAction: calculator\nAction Input: (1"),
        F.lit("Action: calculator\nAction Input: import os\nAction: calculator\nAction Input: 1/0\n"),
        F.lit("no tool"),
    )
    o = read(spark, d, "orders").select("o_orderkey", rewards.run_tools(text).alias("found"))
    return o.select("o_orderkey", F.array_join("found", "|").alias("observations"))


@query(
    "visual_reward",
    """
    with a as (select l_orderkey, l_linenumber, l_discount i, l_tax s, l_quantity / 50 p, l_linenumber % 4 <> 0 ok from lineitem)
    select l_orderkey, l_linenumber, case when ok then (i + s + p) / 3 else -1.0 end::double visual, case when ok then 0.2 + 0.6::double * ((i + s + p) / 3) + 0.2::double * 0.9::double else -1.0 end::double weighted from a""",
)
def visual_reward(spark: SparkSession, d: str) -> DataFrame:
    i, s, p, ok = F.col("l_discount"), F.col("l_tax"), F.col("l_quantity") / 50, F.col("l_linenumber") % 4 != 0
    v = rewards.REGISTRY["visual"](i, s, p, ok)
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", v.alias("visual"), rewards.REGISTRY["weighted"](v, F.lit(0.9), ok).alias("weighted"))


@query(
    "reward_registry",
    """
    select conv_id, turn, 'answer' reward, case when turn % 2 = 0 then 1.0 else 0.0 end::double score from conversations
    union all select conv_id, turn, 'code_format', case when turn % 3 = 0 then 1.0 else 0.0 end::double from conversations
    union all select conv_id, turn, 'judge_score', least(1.0, turn / 10.0::double) from conversations
    union all select conv_id, turn, 'judge_verdict', 2 / 3.0::double from conversations
    union all select conv_id, turn, 'pass_rate', 0.25::double from conversations
    union all select conv_id, turn, 'repeat_penalty', 0.9::double from conversations""",
)
def reward_registry(spark: SparkSession, d: str) -> DataFrame:
    """Scores by name, each a function of columns."""
    turn = F.col("turn")
    code = F.when(turn % 3 == 0, "<think>a</think>\n<answer>\n```python\nx = 1\n```\n</answer>").otherwise("```python\nx = 1\n```")
    scores = {
        "answer": (_join("<answer>", turn, "</answer>"), _join(F.when(turn % 2 == 0, "").otherwise("1"), turn)),
        "code_format": (code,),
        "judge_score": (_join("fine [[", turn, "]]"),),
        "judge_verdict": (F.array(F.lit("so [YES]"), F.lit("[NO]"), F.lit("[YES] indeed")),),
        "pass_rate": (F.array(F.lit(True), F.lit(False), F.lit(False), F.lit(False)),),
        "repeat_penalty": (F.lit("<svg><a/><b/><a/></svg>"),),
    }
    named = F.array(*[F.struct(F.lit(k).alias("reward"), rewards.REGISTRY[k](*v).alias("score")) for k, v in scores.items()])
    found = read(spark, d, "conversations").select("conv_id", "turn", F.explode(named).alias("s"))
    return found.select("conv_id", "turn", "s.*")


# --- pictures -----------------------------------------------------------------------------------------------------------


@query(
    "rendered_shapes",
    """
    with a as (select p_partkey k, p_size % 20 + 1 w, p_partkey % 15 + 1 h, p_partkey % 5 shape from part)
    select k p_partkey, shape <> 4 ok, case when shape <> 4 then 64 end::int height, case when shape = 0 then w * h when shape = 1 then 4 * w * h when shape = 2 then (w + 2) * (h + 2) - w * h when shape = 3 then 2 * w + 4 end::bigint painted,
        case when shape = 4 then 'not a drawing' end error from a""",
)
def rendered_shapes(spark: SparkSession, d: str) -> DataFrame:
    """Pixels of a rectangle, a scaled path, a ring by the even-odd rule and a thick line; one that is no drawing fails."""
    w, h = F.col("p_size") % 20 + 1, F.col("p_partkey") % 15 + 1
    svg = _of(
        "p_partkey",
        _join('<svg viewBox="0 0 64 64" width="64" height="64"><rect x="3" y="2" width="', w, '" height="', h, '" fill="red"/></svg>'),
        _join('<svg viewBox="0 0 64 64" width="64" height="64"><g transform="translate(1 2) scale(2)"><path d="M1 1h', w, "v", h, "h-", w, 'z" style="fill: #00f"/></g></svg>'),
        _join('<svg viewBox="0 0 64 64" width="64" height="64"><path fill-rule="evenodd" d="M9 9h', w + 2, "v", h + 2, "H9zM10 10h", w, "v", h, 'H10z"/></svg>'),
        _join('<svg viewBox="0 0 64 64" width="64" height="64"><polyline points="10,10 ', w + 10, ',10" fill="none" stroke="green" stroke-width="1.99"/><text>no</text></svg>'),
        F.lit("<g/>"),
    )
    p = read(spark, d, "part").select("p_partkey", svg.alias("svg"))
    found = raster.rendered(p, "svg").withColumn("hex", F.hex("px"))
    # Pixels that are not white; a line's round ends reach one more on each side.
    pixels = F.regexp_extract_all("hex", F.lit("(.{6})"), F.lit(1))
    return found.select("p_partkey", "ok", "height", F.when(F.col("ok"), F.size(F.filter(pixels, lambda x: x != "FFFFFF")).cast("long")).alias("painted"), "error")


@query(
    "render_guard",
    """
    select lang, count(*)::bigint n, count(*) filter (n_chars + 11 > 3000)::bigint too_long, count(*) filter (n_chars + 11 <= 3000)::bigint failed from documents where "text" is not null group by lang""",
)
def render_guard(spark: SparkSession, d: str) -> DataFrame:
    """Drawings that are too long are not read; failures are counted, and the others go on."""
    docs = read(spark, d, "documents").where("text is not null").select("lang", F.concat(F.lit("<svg><text>"), "text").alias("svg"))
    found = raster.rendered(docs, "svg", longest=3000)
    return found.groupBy("lang").agg(F.count("*").alias("n"), F.count_if(F.col("error") == "too long").alias("too_long"), F.count_if(~F.col("ok") & (F.col("error") != "too long")).alias("failed"))


_PIX = """
    with p as (select a.vec_id a, b.vec_id b, a.embedding x, b.embedding y from embeddings a join embeddings b on b.vec_id = a.vec_id + 1 and a.label = b.label),
    e as (select a, b, unnest(x)::double * 100 + 128 x, unnest(y)::double * 100 + 128 y, generate_subscripts(x, 1) - 1 k from p),
    q as (select a, b, k % 8 c, k // 8 r, x, y from e)"""


@query(
    "windowed_ssim",
    _PIX + """,
    w as (select a, b, r0, c0, avg(x) mx, avg(y) my, var_samp(x) vx, var_samp(y) vy, covar_samp(x, y) cv from q, range(2) s(r0), range(2) t(c0) where r between r0 and r0 + 6 and c between c0 and c0 + 6 group by all),
    s as (select a, b, avg((2 * mx * my + 6.5025) * (2 * cv + 58.5225) / ((mx * mx + my * my + 6.5025) * (vx + vy + 58.5225))) ssim from w group by a, b),
    d as (select a, b, x < 245 dx, y < 245 dy, r, c from q),
    box as (select a, b, min(r) r0, max(r) r1, min(c) c0, max(c) c1 from q where x < 250 or y < 250 group by a, b),
    i as (select d.a, d.b, d.r, d.c, d.dx, d.dy from d join box using (a, b) where d.r between r0 and r1 and d.c between c0 and c1),
    g as (select i.a, i.b, i.r, i.c, i.dy, bool_or(n.dx) near from i join i n on n.a = i.a and n.b = i.b and abs(n.r - i.r) <= 2 and abs(n.c - i.c) <= 2 group by all),
    iou as (select i.a, i.b, count(*) filter (g.near and g.dy) / (count(*) filter (i.dx or i.dy) + 1e-6) v, count(*) filter (i.dx or i.dy) u from i join g using (a, b, r, c) group by all),
    m as (select a, b, avg(abs(x - y)) / 255 mae from q group by a, b)
    select s.a, s.b, round(ssim, 6) ssim_windowed, round(mae, 6) mae, round(case when u = 0 then 0.0 else least(1.0, v) end, 6) iou from s join m using (a, b) join iou using (a, b)""",
)
def windowed_ssim(spark: SparkSession, d: str) -> DataFrame:
    """Similarity over 7 x 7 windows of 8 x 8 images, error, and the overlap of dark pixels grown by two, cropped."""
    pairs = metrics.neighbour_pairs(read(spark, d, "embeddings"))
    found = metrics.image_scores(pairs, "x", "y", (8, 8), keep=("a", "b"))
    return found.select("a", "b", *[F.round(c, 6).alias(c) for c in ("ssim_windowed", "mae", "iou")])


@query(
    "blurred_ssim",
    _PIX + """,
    k as (select o, exp(-0.5 * (o / 1.5) ** 2) v from range(-6, 7) t(o)), kn as (select o, v / (select sum(v) from k) v from k),
    m as (select i, o, case when (i + o) < 0 then -(i + o) - 1 when (i + o) > 7 then 15 - (i + o) else i + o end j, v from range(8) t(i), kn),
    rows_ as (select q.a, q.b, q.c, m.i r, sum(q.x * m.v) x, sum(q.y * m.v) y from q join m on q.r = m.j group by all),
    bl as (select z.a, z.b, z.r, m.i c, sum(z.x * m.v) x, sum(z.y * m.v) y from rows_ z join m on z.c = m.j group by all),
    s as (select a, b, avg(x) mx, avg(y) my, var_pop(x) vx, var_pop(y) vy, covar_pop(x, y) cv from bl group by a, b),
    er as (select a, b, avg((x - y) * (x - y)) mse from q group by a, b)
    select a, b, round(greatest(0.0, least(1.0, (2 * mx * my + 6.5025) / (mx * mx + my * my + 6.5025) * (2 * abs(cv) + 58.5225) / (vx + vy + 58.5225))), 6) ssim_global_abs,
        round(least((20 * log10(255.0) - 10 * log10(mse)) / 40, 1.0), 6) psnr from s join er using (a, b)""",
)
def blurred_ssim(spark: SparkSession, d: str) -> DataFrame:
    """The reward's similarity of blurred images and signal to noise; every pixel here is content, so nothing is cropped."""
    pairs = metrics.neighbour_pairs(read(spark, d, "embeddings"))
    found = metrics.image_scores(pairs, "x", "y", (8, 8), keep=("a", "b"))
    return found.select("a", "b", *[F.round(c, 6).alias(c) for c in ("ssim_global_abs", "psnr")])


@query(
    "gray_values",
    """select p_partkey, round(0.299::double * (p_size * 5) + 0.587::double * (p_partkey % 256) + 0.114::double * 7, 9) gray from part""",
)
def gray_values(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "part").select("p_partkey", F.round(N.gray(F.col("p_size") * 5, F.col("p_partkey") % 256, F.lit(7)), 9).alias("gray"))


# --- numbers and texts --------------------------------------------------------------------------------------------------


@query(
    "unscaled_attributes",
    """
    with a as (select p_partkey, p_size, p_size / 0.37::double s, regexp_replace(format('{:.2f}', p_size / 0.37::double), '0$', '') t from part)
    select p_partkey, 'translate(' || t || ', ' || t || ') rotate(45.0, ' || t || ')' transform, 'font-size: ' || regexp_replace(format('{:.2f}', p_size * 16.0 / 0.37::double), '0$', '') || 'px; fill: red' style from a""",
)
def unscaled_attributes(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("p_size")
    t = G.unscale_transform(_join("translate(", s, " ", s, ") rotate(45,", s, ")"), F.lit(0.37))
    return read(spark, d, "part").select("p_partkey", t.alias("transform"), G.unscale_style(_join("font-size:", s, "em; fill: red"), F.lit(0.37)).alias("style"))


@query(
    "point_numbers",
    """select p_partkey, p_size || ' ' || p_size || '.5 -2 1000' points from part""",
)
def point_numbers(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("p_size")
    return read(spark, d, "part").select("p_partkey", G.numbers_text(_join(s, ".0,", s, ".50 -2.00, 1e3")).alias("points"))


@query("twelve_digits", "select * from (values (0, '0'), (1, '1.5'), (2, '0.333333333333'), (3, '1e+20'), (4, '-2')) t(k, shown)")
def twelve_digits(spark: SparkSession, d: str) -> DataFrame:
    rows = [(k, digits12(v)) for k, v in enumerate((-1e-13, 1.5, 1 / 3, 1e20, -2.0))]
    return spark.createDataFrame(rows, "k int, shown string")


@query(
    "balanced_slice",
    """
    select o_orderkey, case o_orderkey % 4 when 0 then '<svg a="' || o_custkey || '"><svg></svg>x</svg>' when 1 then '<svg/></svg>' end svg from orders""",
)
def balanced_slice(spark: SparkSession, d: str) -> DataFrame:
    """The first drawing of a text with all that is nested in it; null where it is not closed or there is none."""
    c = F.col("o_custkey")
    text = _of("o_orderkey", _join('</svg> t <svg a="', c, '"><svg></svg>x</svg> <svg></svg>'), _join("<svg/></svg>", c), _join("<svg><svg></svg>", c), _join("text ", c))
    return read(spark, d, "orders").select("o_orderkey", T.balanced_svg(text).alias("svg"))


@query(
    "prompt_texts",
    """
    select conv_id, turn, 'Question: ' || "text" || chr(10) || 'By: ' || role || '.' prompt, '<|im_start|>user' || chr(10) || "text" || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) chat from conversations""",
)
def prompt_texts(spark: SparkSession, d: str) -> DataFrame:
    """A template around two columns, and the marks of a chat around a turn."""
    messages = F.array(F.struct(F.lit("user").alias("role"), F.col("text").alias("content")))
    p = T.prompt("Question: {q}\nBy: {who}.", q=F.col("text"), who=F.col("role"))
    return read(spark, d, "conversations").select("conv_id", "turn", p.alias("prompt"), F.when(F.col("text").isNotNull(), T.chat_text(messages)).alias("chat"))


@query(
    "joined_prompts",
    """select doc_id, concat_ws('. ', lang, source) prompt, lang || '. ' || source strict, 'kept' as other from documents""",
)
def joined_prompts(spark: SparkSession, d: str) -> DataFrame:
    """Columns joined by a full stop, nulls skipped, or null where one is; unused columns are dropped."""
    docs = read(spark, d, "documents").withColumn("other", F.lit("kept")).drop("text", "n_chars")
    return docs.select("doc_id", F.concat_ws(". ", "lang", "source").alias("prompt"), F.concat("lang", F.lit(". "), "source").alias("strict"), "other")


@query(
    "tool_lines",
    """
    select o_orderkey, case when o_orderkey % 3 <> 2 then 2 end::int calls, case when o_orderkey % 3 <> 2 then 'f' end as name, case when o_orderkey % 3 = 0 then 1 when o_orderkey % 3 = 1 then 0 end::int shared from orders""",
)
def tool_lines(spark: SparkSession, d: str) -> DataFrame:
    """JSON objects, one a line, in a tag; a line that is none is null; parameters that two calls share."""
    c = F.col("o_custkey")
    text = _of("o_orderkey", _join('<tool_call>\n{"name": "f", "parameters": {"a": "', c, '", "b": "1"}}\noops\n</tool_call>'), _join('<tool_call>{"name": "f", "parameters": {"a": "x', c, '"}}\n{"name": "g"}</tool_call>'), F.lit("none"))
    calls = T.tagged_json(text, "tool_call", "name string, parameters map<string,string>")
    first = F.get(calls, F.lit(0))
    shared = T.shared_pairs(first["parameters"], F.create_map(F.lit("a"), c.cast("string"), F.lit("b"), F.lit("2")))
    return read(spark, d, "orders").select("o_orderkey", F.when(calls.isNotNull(), F.size(calls)).alias("calls"), first["name"].alias("name"), F.when(calls.isNotNull(), shared).alias("shared"))


@query(
    "message_parts",
    """select conv_id, turn, coalesce("text", '') || '!' said from conversations""",
)
def message_parts(spark: SparkSession, d: str) -> DataFrame:
    """A message's parts flattened and joined; parts without text are skipped."""
    parts = F.flatten(F.array(F.array(F.col("text"), F.lit(None).cast("string")), F.array(F.lit("!"))))
    return read(spark, d, "conversations").select("conv_id", "turn", T.text_parts(parts).alias("said"))


# --- records ------------------------------------------------------------------------------------------------------------


@query(
    "consistency_report",
    """
    with a as (select vec_id, case when vec_id % 11 = 0 then 'no image' end error, round(embedding[1]::double, 6) s, round(embedding[2]::double, 6) m, round(embedding[3]::double, 6) i from embeddings)
    select row_number() over (order by error is not null, case when error is null then s end, case when error is null then m end desc, case when error is null then i end, vec_id)::bigint as place,
        vec_id, error, case when error is null then s end ssim from a""",
)
def consistency_report(spark: SparkSession, d: str) -> DataFrame:
    """Worst first by three keys, failures last: the place of each row in the report."""
    at = lambda k: F.when(F.col("error").isNull(), F.round(F.col("embedding")[k].cast("double"), 6))
    e = read(spark, d, "embeddings").withColumn("error", F.when(F.col("vec_id") % 11 == 0, "no image"))
    e = e.select("vec_id", "error", at(0).alias("ssim"), (-at(1)).alias("mae"), at(2).alias("iou"), F.col("error").isNotNull().alias("failed"))
    found = records.ranked(e, ["failed", "ssim", "mae", "iou", "vec_id"])
    return found.select((F.col("rank") + 1).alias("place"), "vec_id", "error", "ssim")


@query(
    "render_shards",
    """select n_nationkey::bigint n_nationkey, n_nationkey::bigint % 4 shard, (select count(*) from nation m where m.n_nationkey % 4 = n.n_nationkey % 4)::bigint as of from nation n""",
)
def render_shards(spark: SparkSession, d: str) -> DataFrame:
    """Rows dealt to shards by a stated key, one task for each, with how many rows the shard has."""
    n = read(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("n_nationkey"), (F.col("n_nationkey") % 4).cast("long").alias("shard"))
    dealt = n.repartition(4, "shard")
    return dealt.join(dealt.groupBy("shard").agg(F.count("*").alias("of")), "shard").select("n_nationkey", "shard", "of")


@query(
    "changed_ids",
    """
    select lang, string_agg(doc_id::varchar, ',' order by doc_id) ids, count(*)::bigint n from documents where contains("text", chr(10)) group by lang""",
)
def changed_ids(spark: SparkSession, d: str) -> DataFrame:
    """Ids of the documents that a repair changes, by language; here it joins lines."""
    docs = read(spark, d, "documents")
    found = docs.where(F.regexp_replace("text", "\\n+", " ") != F.col("text")).groupBy("lang").agg(F.array_sort(F.collect_list("doc_id")).alias("ids"))
    return found.select("lang", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"), F.size("ids").cast("long").alias("n"))


@query(
    "optimizer_bypass",
    """
    with a as (select o_orderkey, case o_orderkey % 3 when 0 then '<svg data-preserve-rendering="true"><g> </g></svg>' when 1 then '<svg><g fill="red"/></svg>' else '<svg><!-- long ' || repeat('x', 40) || ' --><g/></svg>' end svg from orders)
    select o_orderkey, case when o_orderkey % 3 = 1 then '<svg xmlns="http://www.w3.org/2000/svg"><g fill="red"/></svg>' else svg end svg, (o_orderkey % 3 = 1) as optimized from a""",
)
def optimizer_bypass(spark: SparkSession, d: str) -> DataFrame:
    """Drawings that ask to be preserved, and those too long, pass the optimizer as they are."""
    from quarry.operators import pipeline

    svg = _of("o_orderkey", F.lit('<svg data-preserve-rendering="true"><g> </g></svg>'), F.lit('<svg><!-- note --><g style="fill: red"/></svg>'), F.lit(f"<svg><!-- long {'x' * 40} --><g/></svg>"))
    o = read(spark, d, "orders").select("o_orderkey", svg.alias("svg"))
    return pipeline.optimized(o, "svg", longest=50).select("o_orderkey", "svg", "optimized")


@query(
    "clean_pipeline",
    """
    with a as (select p_partkey k, p_size w, case p_partkey % 3 when 0 then 'graphiq' when 1 then 'echarts' else 'other' end dataset from part)
    select k p_partkey, dataset, case when k % 7 = 6 then 'rejected' else 'kept' end state, case when k % 7 <> 6 then '<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 512 512" width="512" height="512"><rect width="512" height="512" x="0" y="0" fill="white"/><path class="gfx-ln-path" d="M 0 '
        || (w * 2) || '"' || case when dataset = 'graphiq' then ' fill="none"' else '' end || '/></svg>' end svg, case when k % 7 <> 6 then 0 end::int canvas_not_512 from a where dataset <> 'other'""",
)
def clean_pipeline(spark: SparkSession, d: str) -> DataFrame:
    """The whole cleaning of charts: rejected pages, normalizing, each data set's own repairs, optimizing, the audit."""
    from quarry.operators import pipeline

    dataset = _of("p_partkey", F.lit("graphiq"), F.lit("echarts"), F.lit("other"))
    svg = F.when(F.col("p_partkey") % 7 == 6, "<!DOCTYPE html><html></html>").otherwise(_join('<svg width="256" height="256"><title>t</title><path class="gfx-ln-path" d="M0 ', F.col("p_size"), '"/></svg>'))
    charts = read(spark, d, "part").select("p_partkey", dataset.alias("dataset"), svg.alias("svg"))
    return pipeline.clean(charts, datasets=("graphiq", "echarts")).select("p_partkey", "dataset", "state", "svg", "canvas_not_512")


@query(
    "training_records",
    """
    with a as (select p_partkey k, p_size w, case p_partkey % 2 when 0 then 'graphiq_clean' else 'echarts' end dataset from part),
    t as (select *, '[<|START_OF_SVG|>][<|viewBox=|>]0 0 512 512[<|width=|>]512[<|height=|>]512[<|rect|>][<|fill=|>]white[<|width=|>]512[<|height=|>]512[<|x=|>]0[<|y=|>]0[<|/rect|>][<|circle|>][<|fill=|>]red[<|r=|>]' || (2 * w) || '[<|/circle|>][<|END_OF_SVG|>]' tokens from a)
    select k chart_id, case when k % 5 = 4 then 'rejected' else 'kept' end state, case when k % 5 <> 4 then 'images/' || case dataset when 'graphiq_clean' then 'graphiq' else dataset end || '/' || k || '.png' end image, case when k % 5 <> 4 then tokens end answer from t""",
)
def training_records(spark: SparkSession, d: str) -> DataFrame:
    """Charts of two data sets cleaned, encoded and made into chat records; what is no chart stays, with its state."""
    from quarry.operators import pipeline

    svg = F.when(F.col("p_partkey") % 5 == 4, " <!doctype HTML>x").otherwise(_join('<svg width="256" height="256"><circle r="', F.col("p_size"), '" fill="red"/></svg>'))
    charts = read(spark, d, "part").select(F.col("p_partkey").alias("chart_id"), _of("p_partkey", F.lit("graphiq_clean"), F.lit("echarts")).alias("dataset"), svg.alias("svg"))
    found = pipeline.prepared(charts)
    return found.select("chart_id", "state", F.col("record.images")[0].alias("image"), F.element_at("record.messages", -1)["content"].alias("answer"))


@query(
    "task_report",
    """
    select case p_partkey % 2 when 0 then 'graphiq_clean' else 'echarts' end dataset, count(*)::bigint charts, count(*) filter (p_partkey % 5 <> 4)::bigint kept, count(*) filter (p_partkey % 5 = 4)::bigint failed, min(p_partkey) filter (p_partkey % 5 = 4) first_failed from part group by 1""",
)
def task_report(spark: SparkSession, d: str) -> DataFrame:
    """Outcomes by data set, over one plan for all of them; without the last stages."""
    from quarry.operators import pipeline

    svg = F.when(F.col("p_partkey") % 5 == 4, "<svg><g></svg>").otherwise("<svg/>")
    charts = read(spark, d, "part").select(F.col("p_partkey").alias("chart_id"), _of("p_partkey", F.lit("graphiq_clean"), F.lit("echarts")).alias("dataset"), svg.alias("svg"))
    return pipeline.outcome(pipeline.prepared(charts, stages=("encode",)))


@query(
    "zipped_truths",
    """
    with m as (select conv_id, list("text" order by turn) t, list(role order by turn) r from conversations group by conv_id)
    select conv_id, k::int as place, t[k] completion, r[k] truth from (select conv_id, t, r, unnest(range(1, least(len(t), 3) + 1)) k from m)""",
)
def zipped_truths(spark: SparkSession, d: str) -> DataFrame:
    """Completions and truths by place; the longer list loses what has no partner."""
    turn = F.struct("turn", "role", "text")
    m = read(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("m"))
    pairs = records.scored_pairs(F.transform("m", lambda x: x["text"]), F.slice(F.transform("m", lambda x: x["role"]), 1, 3))
    return m.select("conv_id", F.posexplode(pairs).alias("p", "x")).select("conv_id", (F.col("p") + 1).alias("place"), "x.completion", "x.truth")


@query(
    "debug_projection",
    """select 's' || doc_id as svg, concat_ws('. ', lang, source) prompt, source, lang || '/' || source prompts, length('s' || doc_id)::int raw_length from documents""",
)
def debug_projection(spark: SparkSession, d: str) -> DataFrame:
    """Rows for prompts with, for debugging, what they are made of."""
    docs = read(spark, d, "documents").withColumn("svg", F.concat(F.lit("s"), F.col("doc_id").cast("string")))
    found = records.prompt_rows(docs, ["lang", "source"], debug=True)
    return found.withColumn("prompts", F.concat_ws("/", "prompts.lang", "prompts.source"))


@query(
    "rendered_square",
    """select p_partkey, 32::int height, 32::int width, (p_size % 4 + 1) * 8 * 8::bigint painted from part""",
)
def rendered_square(spark: SparkSession, d: str) -> DataFrame:
    """Drawings of other sizes fitted into a square of 32 pixels."""
    w = F.col("p_size") % 4 + 1
    p = read(spark, d, "part").select("p_partkey", _join('<svg viewBox="0 0 4 2" width="99" height="9"><rect width="', w, '" height="1" fill="blue"/></svg>').alias("svg"))
    found = raster.rendered(p, "svg", (32, 32))
    blue = F.size(F.filter(F.regexp_extract_all(F.hex("px"), F.lit("(.{6})"), F.lit(1)), lambda x: x == "0000FF")).cast("long")
    return found.select("p_partkey", "height", "width", blue.alias("painted"))


@query(
    "resampled_images",
    """
    with e as (select vec_id, unnest(embedding)::double v, generate_subscripts(embedding, 1) - 1 k from embeddings), q as (select vec_id, k % 8 c, k // 8 r, v from e),
    w as (select i, j, greatest(0.0, 1 - abs((j + 0.5) - (i + 0.5) * 2.0) / 2.0) w from range(4) s(i), range(8) t(j)), n as (select i, j, w / sum(w) over (partition by i) w from w),
    z as (select q.vec_id, a.i r, b.i c, sum(v * a.w * b.w) v from q join n a on a.j = q.r join n b on b.j = q.c group by all)
    select vec_id, round(max(v), 6) top, round(max(v) filter (r = 1 and c = 2), 6) one from z group by vec_id""",
)
def resampled_images(spark: SparkSession, d: str) -> DataFrame:
    """8 x 8 images at 4 x 4 by smoothing between neighbours."""
    found = metrics.resampled(read(spark, d, "embeddings"), "vec_id", "embedding", (8, 8), (4, 4), "bilinear")
    return found.select("vec_id", F.round(F.array_max("px"), 6).alias("top"), F.round(F.col("px")[6], 6).alias("one"))


@query("requested_scores", """select conv_id, turn, case when turn % 3 = 0 then 0.0 else length("text") end::double score from conversations""")
def requested_scores(spark: SparkSession, d: str) -> DataFrame:
    """What a service answers for each turn; one that fails or takes too long has the default."""
    import asyncio

    from quarry import streaming

    async def ask(value: str) -> float:
        if value.startswith("0:"):
            await asyncio.sleep(0 if len(value) % 2 else 60)
            raise ValueError("no answer")
        return len(value) - 2

    asked = F.concat((F.col("turn") % 3).cast("string"), F.lit(":"), F.coalesce("text", F.lit("")))
    found = streaming.scored(read(spark, d, "conversations").select("conv_id", "turn", F.when(F.col("text").isNotNull(), asked).alias("asked")), "asked", ask, seconds=0.05)
    return found.select("conv_id", "turn", "score")
