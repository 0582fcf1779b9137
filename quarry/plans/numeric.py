"""Queries over numbers: formats, boxes, colours, scaling, pixel arrays."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import geometry as G
from quarry.functions import numeric as N
from quarry.operators import metrics

from .registry import query, read


@query(
    "fit_scale_pad",
    """
    with s as (select o_orderkey, p_partkey, (p_size * 20 + 7)::double w, (o_custkey % 900 + 1)::double h from orders join part on o_orderkey % 200 + 1 = p_partkey),
    k as (select *, 512 / greatest(w, h) scale from s),
    z as (select *, trunc(w * scale)::int nw, trunc(h * scale)::int nh from k)
    select o_orderkey, scale, nw new_w, nh new_h, (512 - nw) / 2::double pad_x, (512 - nh) / 2::double pad_y from z""",
)
def fit_scale_pad(spark: SparkSession, d: str) -> DataFrame:
    o, p = read(spark, d, "orders"), read(spark, d, "part")
    both = o.join(p, F.col("o_orderkey") % 200 + 1 == F.col("p_partkey"))
    size = N.fit((F.col("p_size") * 20 + 7).cast("double"), (F.col("o_custkey") % 900 + 1).cast("double"))
    return both.select("o_orderkey", size.alias("f")).select("o_orderkey", "f.*")


@query(
    "unit_lengths",
    """
    with u as (select l_orderkey, l_linenumber, l_quantity q, l_linenumber % 6 k from lineitem)
    select l_orderkey, l_linenumber, case when k in (0, 5) then q when k = 1 then q * 1.3333 when k in (2, 3) then q * 16.0 end::double px,
        case when k in (2, 3) then format('{:.1f}', q * 16.0 * 0.37) when k in (0, 5) then format('{:.1f}', q * 0.37) when k = 1 then format('{:.1f}', q) || 'pt' else format('{:.1f}', q) || '%' end scaled,
        case when k = 4 then null else q end::double as lead_num
    from u""",
)
def unit_lengths(spark: SparkSession, d: str) -> DataFrame:
    k, q = F.col("l_linenumber") % 6, N.fixed(F.col("l_quantity"), 1)
    text = F.when(k == 0, F.concat(q, F.lit("px"))).when(k == 1, F.concat(q, F.lit("pt"))).when(k == 2, F.concat(q, F.lit("em"))).when(k == 3, F.concat(q, F.lit("rem"))).when(k == 4, F.concat(q, F.lit("%"))).otherwise(q)
    lead = F.when(k == 4, F.concat(F.lit("w"), q)).otherwise(F.concat(F.lit(" "), q, F.lit("px")))
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", N.unit_length(text).alias("px"), N.scale_length(text, 0.37).alias("scaled"), N.leading_number(lead).alias("lead_num"))


@query(
    "token_numbers",
    """
    with u as (select l_orderkey, l_linenumber, l_extendedprice / 100 v from lineitem)
    select l_orderkey, l_linenumber, case when v = floor(v) then format('{:.0f}', v) else format('{:.1f}', v) end num, format('{:.1f}', l_linenumber / 4.0::double) as quarters, '2em' as em, 'auto' as word from u""",
)
def token_numbers(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("l_extendedprice") / 100
    text = F.concat(v.cast("decimal(30,12)").cast("string"), F.lit("px"))
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", N.token_number(text).alias("num"), N.fixed(F.col("l_linenumber") / 4.0, 1).alias("quarters"), N.token_number(F.lit("2em")).alias("em"), N.token_number(F.lit("auto")).alias("word"))


@query(
    "denormalized_viewbox",
    """
    with s as (select o_orderkey, case when o_orderkey % 5 <> 0 then (o_custkey % 97) / 4.0::double end px, (o_custkey % 31) / 8.0::double py from orders)
    select o_orderkey, case when px is null then '0 0 512 512' else format('{:.2f}', px) || ' ' || format('{:.2f}', py) || ' ' || format('{:.2f}', 512 - 2 * px) || ' ' || format('{:.2f}', 512 - 2 * py) end view_box from s""",
)
def denormalized_viewbox(spark: SparkSession, d: str) -> DataFrame:
    px = F.when(F.col("o_orderkey") % 5 != 0, (F.col("o_custkey") % 97) / 4.0)
    return read(spark, d, "orders").select("o_orderkey", N.denormalized_viewbox(px, (F.col("o_custkey") % 31) / 8.0).alias("view_box"))


@query(
    "bbox_iou",
    """
    with b as (select l_orderkey, l_linenumber, case when l_linenumber = 7 then null else (l_quantity % 20)::int end ax0, 3::int ay0, ((l_quantity % 20) + 10)::int ax1, 13::int ay1,
        case when l_linenumber >= 6 then null else (l_partkey % 20)::int end bx0, 5::int by0, ((l_partkey % 20) + 8)::int bx1, (5 + l_suppkey % 9)::int by1 from lineitem),
    i as (select *, greatest(0, least(ax1, bx1) - greatest(ax0, bx0)) * greatest(0, least(ay1, by1) - greatest(ay0, by0)) inter from b)
    select l_orderkey, l_linenumber, case when ax0 is null and bx0 is null then 1.0 when ax0 is null or bx0 is null then 0.0
        when (ax1 - ax0) * (ay1 - ay0) + (bx1 - bx0) * (by1 - by0) - inter = 0 then 1.0
        else inter::double / ((ax1 - ax0) * (ay1 - ay0) + (bx1 - bx0) * (by1 - by0) - inter) end::double iou from i""",
)
def bbox_iou(spark: SparkSession, d: str) -> DataFrame:
    q, p, n = F.col("l_quantity") % 20, F.col("l_partkey") % 20, F.col("l_linenumber")
    a = (F.when(n != 7, q.cast("int")), F.lit(3), (q + 10).cast("int"), F.lit(13))
    b = (F.when(n < 6, p.cast("int")), F.lit(5), (p + 8).cast("int"), (5 + F.col("l_suppkey") % 9).cast("int"))
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", N.box_iou(a, b).alias("iou"))


@query(
    "avg_colour",
    """
    with c as (select p_brand, (p_partkey % 256) r, (p_size * 5) g, (p_partkey % 100) b from part)
    select p_brand, '#' || lpad(lower(to_hex(sum(r)::bigint // count(*))), 2, '0') || lpad(lower(to_hex(sum(g)::bigint // count(*))), 2, '0') || lpad(lower(to_hex(sum(b)::bigint // count(*))), 2, '0') mean, count(*)::bigint n from c group by p_brand""",
)
def avg_colour(spark: SparkSession, d: str) -> DataFrame:
    colour = N.rgb_to_hex(F.col("p_partkey") % 256, F.col("p_size") * 5, F.col("p_partkey") % 100)
    rgb = N.hex_to_rgb(F.col("c"))
    per = read(spark, d, "part").select("p_brand", colour.alias("c")).select("p_brand", rgb.alias("rgb")).groupBy("p_brand")
    sums = per.agg(F.count("*").alias("n"), *[F.floor(F.sum(F.col("rgb")[i]) / F.count("*")).alias(f"c{i}") for i in range(3)])
    return sums.select("p_brand", N.rgb_to_hex(F.col("c0"), F.col("c1"), F.col("c2")).alias("mean"), "n")


@query(
    "colour_lists",
    """select o_orderkey, '#' || lpad(lower(to_hex((o_custkey % 256 + 10) // 2)), 2, '0') || lpad(lower(to_hex((o_orderkey % 256 + 20) // 2)), 2, '0') || '14' mean, null::varchar as none from orders""",
)
def colour_lists(spark: SparkSession, d: str) -> DataFrame:
    own = F.array(N.rgb_to_hex(F.col("o_custkey") % 256, F.col("o_orderkey") % 256, F.lit(10)), F.lit("#0a141e"), F.lit("#abc"), F.lit("red"))
    return read(spark, d, "orders").select("o_orderkey", N.average_colour(own).alias("mean"), N.average_colour(F.array(F.lit("red"))).alias("none"))


@query(
    "png_header",
    """select o_orderkey, case when o_orderkey % 7 = 0 then null else o_custkey end::bigint width, case when o_orderkey % 7 = 0 then null else o_orderkey end::bigint height from orders""",
)
def png_header(spark: SparkSession, d: str) -> DataFrame:
    word = lambda c: F.unhex(F.lpad(F.hex(c), 8, "0"))
    head = F.when(F.col("o_orderkey") % 7 == 0, F.unhex(F.lit("89504E470D0A1A0B"))).otherwise(F.unhex(F.lit("89504E470D0A1A0A")))
    png = F.concat(head, F.unhex(F.lit("0000000D49484452")), word(F.col("o_custkey")), word(F.col("o_orderkey")))
    return read(spark, d, "orders").select("o_orderkey", N.png_size(png).alias("s")).select("o_orderkey", "s.*")


@query(
    "reward_schedule",
    """select l_orderkey, l_linenumber, greatest(1.0, 2 - (2 - 1.0) * s / 150)::double format_max, least(-1.0, -2 + (2 + 0.0) * s / 150)::double format_min,
        least(3.0, (3.0 - 2) * s / 150 + 2)::double correct_max, greatest(-3.0, (-3.0 + 2) * s / 150 - 2)::double correct_min from (select l_orderkey, l_linenumber, (l_partkey % 200)::double s from lineitem)""",
)
def reward_schedule(spark: SparkSession, d: str) -> DataFrame:
    s = (F.col("l_partkey") % 200).cast("double")
    f, c = N.scheduled(1.0, 0.0, s), N.scheduled_correctness(3.0, -3.0, s)
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", f["max_reward"].alias("format_max"), f["min_reward"].alias("format_min"), c["max_reward"].alias("correct_max"), c["min_reward"].alias("correct_min"))


@query(
    "path_scale_ml",
    """select l_orderkey, l_linenumber, 'M ' || format('{:.1f}', l_quantity::double * 0.37::double) || ' ' || format('{:.1f}', l_extendedprice::double * 0.37::double) || ' L ' || format('{:.1f}', l_partkey::double * 0.37::double) || ' ' || format('{:.1f}', l_suppkey::double * 0.37::double) path,
        'M ' || format('{:.1f}', l_partkey::double * 0.37::double) || ' 0.0 Z M ' || format('{:.1f}', l_suppkey::double * 0.37::double) || ' 0.0 l 0.4 0.4' multi from lineitem""",
)
def path_scale_ml(spark: SparkSession, d: str) -> DataFrame:
    """Scale paths; the second one starts again after a close, which must not be lost."""
    text = lambda c: F.col(c).cast("decimal(20,4)").cast("string")
    path = F.concat(F.lit("M"), text("l_quantity"), F.lit(","), text("l_extendedprice"), F.lit("L"), text("l_partkey"), F.lit(" "), text("l_suppkey"))
    multi = F.concat(F.lit("M"), text("l_partkey"), F.lit(" 0ZM"), text("l_suppkey"), F.lit(" 0l1 1"))
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", G.scale_path(path, 0.37).alias("path"), G.scale_path(multi, 0.37).alias("multi"))


@query(
    "path_unscale_roundtrip",
    """
    with a as (select l_orderkey, l_linenumber, format('{:.1f}', l_quantity::double * 0.37::double)::double / 0.37::double x, format('{:.1f}', l_suppkey::double * 0.37::double)::double / 0.37::double y, format('{:.1f}', 5 * 0.37::double)::double / 0.37::double r from lineitem),
    f as (select l_orderkey, l_linenumber, regexp_replace(format('{:.2f}', x), '0$', '') x, regexp_replace(format('{:.2f}', y), '0$', '') y, regexp_replace(format('{:.2f}', r), '0$', '') r from a)
    select l_orderkey, l_linenumber, 'M ' || x || ' ' || y as line, 'M ' || x || ' 0.0 A ' || r || ' ' || r || ' 30.0 0 1 ' || y || ' ' || x || ' a ' || r || ' ' || r || ' 0.0 1 0 ' || x || ' ' || y as arcs,
        'C ' || x || ' ' || y || ' ' || x || ' ' || y || ' ' || x || ' ' || y || ' S ' || x || ' ' || y || ' ' || y || ' ' || x || ' q ' || x || ' ' || y || ' ' || x || ' ' || y || ' T ' || y || ' ' || x || ' H ' || x || ' v ' || y || ' Z' as curves from f""",
)
def path_unscale_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Scaling and its inverse: what scaling rounds to one decimal comes back to two. All commands; flags stick."""
    x, y = F.col("l_quantity").cast("string"), F.col("l_suppkey").cast("string")
    join = lambda *p: F.concat(*[F.lit(v) if isinstance(v, str) else v for v in p])
    line = join("M ", x, " ", y)
    arcs = join("M", x, " 0A5 5 30 01", y, ",", x, "a5,5,0 10", x, " ", y, " 7")
    curves = join("C", x, " ", y, ",", x, " ", y, ",", x, " ", y, "S", x, " ", y, " ", y, " ", x, "q", x, ",", y, ",", x, ",", y, " 1T", y, " ", x, "H", x, "v", y, "Z")
    back = lambda p: G.unscale_path(G.scale_path(p, 0.37), 0.37)
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", back(line).alias("line"), back(arcs).alias("arcs"), back(curves).alias("curves"))


@query(
    "transform_scale",
    """select l_orderkey, l_linenumber, 'translate(' || format('{:.1f}', l_quantity::double * 0.5::double) || ', ' || format('{:.1f}', l_suppkey::double * 0.5::double) || ') rotate(' || format('{:.1f}', l_quantity) || ', ' || format('{:.1f}', l_partkey::double * 0.5::double) || ', 0.0)' scaled from lineitem""",
)
def transform_scale(spark: SparkSession, d: str) -> DataFrame:
    t = F.concat(F.lit("translate("), F.col("l_quantity").cast("string"), F.lit(","), F.col("l_suppkey").cast("string"), F.lit(") rotate("), F.col("l_quantity").cast("string"), F.lit("deg "), F.col("l_partkey").cast("string"), F.lit(" 0)"))
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", G.scale_transform(t, F.lit(0.5)).alias("scaled"))


@query(
    "style_scale",
    """select p_partkey, 'font-size: ' || format('{:.1f}', p_size::double * 16.0 * 0.25::double) || 'px; fill: red; stroke-width: ' || format('{:.1f}', p_size::double * 0.25::double) || 'px; stroke-width: thin' style from part""",
)
def style_scale(spark: SparkSession, d: str) -> DataFrame:
    size = F.col("p_size").cast("string")
    style = F.concat(F.lit("font-size: "), size, F.lit("em;fill: red; stroke-width:"), size, F.lit("px;; stroke-width: thin"))
    return read(spark, d, "part").select("p_partkey", G.scale_style(style, F.lit(0.25)).alias("style"))


@query(
    "points_scale",
    """select o_orderkey, format('{:.1f}', o_orderkey::double * 0.25::double) || ',' || format('{:.1f}', o_custkey::double * 0.25::double) || ' ' || format('{:.1f}', o_custkey::double * 0.25::double) || ',0.0' points from orders""",
)
def points_scale(spark: SparkSession, d: str) -> DataFrame:
    points = F.concat(F.col("o_orderkey").cast("string"), F.lit(","), F.col("o_custkey").cast("string"), F.lit(" "), F.col("o_custkey").cast("string"), F.lit(" 0 77"))
    return read(spark, d, "orders").select("o_orderkey", G.scale_points(points, F.lit(0.25)).alias("points"))


@query(
    "arc_to_circle",
    """select l_orderkey, l_linenumber, l_quantity::double cx, (l_suppkey + l_linenumber)::double cy, l_linenumber::double r, case when l_linenumber % 2 = 0 then l_quantity - l_linenumber end::double ellipse_cx from lineitem""",
)
def arc_to_circle(spark: SparkSession, d: str) -> DataFrame:
    x, y, r = (F.col(c).cast("string") for c in ("l_quantity", "l_suppkey", "l_linenumber"))
    near = F.concat(F.lit("M "), x, F.lit(" "), y, F.lit(" A "), r, F.lit(" "), r, F.lit(" 0 1 1 "), x, F.lit(" "), y, F.lit(" Z"))
    turn = F.when(F.col("l_linenumber") % 2 == 0, "720").otherwise("45")
    full = F.concat(F.lit("M"), x, F.lit(" "), y, F.lit("A"), r, F.lit(" "), r, F.lit(" "), turn, F.lit(" 1 1 "), x, F.lit(","), y, F.lit("z"))
    c = G.arc_circle(near)
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", c["cx"].alias("cx"), c["cy"].alias("cy"), c["r"].alias("r"), G.arc_ellipse(full)["cx"].alias("ellipse_cx"))


@query(
    "axis_domain_extent",
    """select o_orderkey, greatest(o_custkey, 2)::double extent, greatest(o_custkey, 2)::varchar as x2 from orders""",
)
def axis_domain_extent(spark: SparkSession, d: str) -> DataFrame:
    path = F.concat(F.lit("M2,0V0H"), F.col("o_custkey").cast("string"), F.lit("V0"))
    return read(spark, d, "orders").select("o_orderkey", G.axis_extent(path).alias("extent"), N.shortest(G.axis_extent(path)).alias("x2"))


@query(
    "path_tokens",
    """select l_orderkey, l_linenumber, '[M]' || l_linenumber || ' ' || format('{:.1f}', l_linenumber + 0.25::double) || ' [l]' || l_linenumber || ' 100 [Z] ' as tokens from lineitem""",
)
def path_tokens(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("l_linenumber").cast("string")
    path = F.concat(F.lit("M"), n, F.lit(","), (F.col("l_linenumber") + 0.25).cast("string"), F.lit("l"), n, F.lit(" 1e2Z"))
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", G.path_token_text(path).alias("tokens"))


_PAIRS = """
    with p as (select a.vec_id a, b.vec_id b, a.embedding x, b.embedding y from embeddings a join embeddings b on b.vec_id = a.vec_id + 1 and a.label = b.label),
    e as (select a, b, unnest(x)::double * 100 + 128 x, unnest(y)::double * 100 + 128 y from p)"""


@query(
    "mae_psnr_pairs",
    _PAIRS + """, s as (select a, b, avg(abs(x - y)) / 255 mae, avg((x - y) * (x - y)) mse from e group by a, b)
    select a, b, round(mae, 9) mae, round(case when mse = 0 then 1.0 else least((20 * log10(255.0) - 10 * log10(mse)) / 40, 1.0) end, 9) psnr from s""",
)
def mae_psnr_pairs(spark: SparkSession, d: str) -> DataFrame:
    pairs = metrics.neighbour_pairs(read(spark, d, "embeddings"))
    e = metrics.array_errors(F.col("x"), F.col("y"))
    return pairs.select("a", "b", e.alias("e")).select("a", "b", F.round(F.col("e.mae") / 255, 9).alias("mae"), F.round(N.psnr_score(F.col("e.mse")), 9).alias("psnr"))


@query(
    "ssim_global",
    _PAIRS + """, s as (select a, b, avg(x) mx, avg(y) my, var_pop(x) vx, var_pop(y) vy, covar_pop(x, y) c from e group by a, b)
    select a, b, round(greatest(0.0, least(1.0, (2 * mx * my + 6.5025) / (mx * mx + my * my + 6.5025) * (2 * abs(c) + 58.5225) / (vx + vy + 58.5225))), 9) ssim from s""",
)
def ssim_global(spark: SparkSession, d: str) -> DataFrame:
    pairs = metrics.neighbour_pairs(read(spark, d, "embeddings"))
    m = metrics.array_moments(F.col("x"), F.col("y"))
    return pairs.select("a", "b", m.alias("m")).select("a", "b", F.round(N.ssim_global_abs(*[F.col(f"m.{k}") for k in ("mx", "my", "vx", "vy", "cov")]), 9).alias("ssim"))


@query(
    "mask_iou",
    _PAIRS + """, s as (select a, b, count(*) filter (x < 125 and y < 125) i, count(*) filter (x < 125 or y < 125) u from e group by a, b)
    select a, b, round(case when u = 0 then 0.0 else i / (u + 1e-6) end, 9) iou from s""",
)
def mask_iou(spark: SparkSession, d: str) -> DataFrame:
    pairs = metrics.neighbour_pairs(read(spark, d, "embeddings"))
    return pairs.select("a", "b", F.round(metrics.mask_iou(F.col("x"), F.col("y"), 125.0), 9).alias("iou"))


@query(
    "content_bbox",
    """
    with e as (select vec_id, unnest(embedding)::double v, generate_subscripts(embedding, 1) - 1 k from embeddings),
    m as (select vec_id, k % 8 x, k // 8 y from e where v < -0.2)
    select v.vec_id, min(x)::bigint x0, min(y)::bigint y0, (max(x) + 1)::bigint x1, (max(y) + 1)::bigint y1 from embeddings v left join m using (vec_id) group by v.vec_id""",
)
def content_bbox(spark: SparkSession, d: str) -> DataFrame:
    return metrics.bbox(read(spark, d, "embeddings"), "vec_id", "embedding", 8, -0.2)


@query(
    "centroid_init",
    """
    with e as (select label, unnest(embedding)::double v, generate_subscripts(embedding, 1) - 1 dim from embeddings)
    select label, dim::bigint dim, round(avg(v), 9) mean, count(*)::bigint n from e group by label, dim""",
)
def centroid_init(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("dim", "v"))
    return e.groupBy("label", F.col("dim").cast("long").alias("dim")).agg(F.round(F.avg(F.col("v").cast("double")), 9).alias("mean"), F.count("*").alias("n"))
