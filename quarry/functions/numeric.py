"""Numbers as the data format writes them, geometry that needs no parsing, and scores."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import FLOAT, strip

TARGET = 512


def fixed(c: Column, digits: int = 1) -> Column:
    """A number with so many decimals, rounded from its exact binary value, half to even, as Python formats it."""
    return F.call_function("format_number", c.cast("double"), F.lit("0." + "0" * digits))


def rounded(c: Column, digits: int = 1) -> Column:
    return fixed(c, digits).cast("double")


def shortest(c: Column) -> Column:
    """Whole numbers without decimals, others with one."""
    return F.when(c == F.floor(c), F.call_function("format_number", c, F.lit("0"))).otherwise(fixed(c, 1))


def parse_float(c: Column) -> Column:
    """The number that a text is, or null: no suffixes or underscores count."""
    return F.when(c.rlike(FLOAT), strip(c).try_cast("double"))


def leading_number(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, r"^\s*([-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?)", 1), F.lit("")).try_cast("double")


def unit_length(c: Column) -> Column:
    """A length in pixels: px, pt (1.3333), em and rem (16); per cent and other texts are null."""
    v = F.lower(strip(c))
    for unit, factor in (("px", 1.0), ("pt", 1.3333), ("rem", 16.0), ("em", 16.0)):
        hit = parse_float(F.regexp_replace(v, f"{unit}$", "")) * factor
        c = F.when(v.endswith(unit), hit) if unit == "px" else c.when(v.endswith(unit), hit)
    return c.otherwise(parse_float(v))


def scale_length(c: Column, scale: Column | float) -> Column:
    """A length attribute scaled to one decimal, its unit resolved; texts that are no lengths stay."""
    v = F.lower(strip(c))
    factor = F.when(v.rlike("r?em$"), 16.0).otherwise(1.0)
    number = parse_float(F.regexp_replace(v, r"(px|rem|em)$", ""))
    return F.coalesce(fixed(number * factor * scale, 1), c)


def token_number(c: Column) -> Column:
    """A number as tokens write it: px and % go, em stays, whole numbers bare, others with one decimal."""
    number = parse_float(F.replace(F.replace(F.lower(c), F.lit("px"), F.lit("")), F.lit("%"), F.lit("")))
    return F.when(c.contains("em"), c).otherwise(F.coalesce(shortest(number), c))


def fit(w: Column, h: Column, target: int = TARGET) -> Column:
    """(scale, w, h, pad_x, pad_y) to fit an image into a square; scaled sides are cut to whole pixels."""
    scale = target / F.greatest(w, h)
    nw, nh = (w * scale).cast("int"), (h * scale).cast("int")
    return F.struct(scale.alias("scale"), nw.alias("new_w"), nh.alias("new_h"), ((target - nw) / 2).alias("pad_x"), ((target - nh) / 2).alias("pad_y"))


def denormalized_viewbox(pad_x: Column, pad_y: Column, target: int = TARGET) -> Column:
    """The view box that frames the content of a padded square; without paddings, the whole square."""
    box = F.concat_ws(" ", fixed(pad_x, 2), fixed(pad_y, 2), fixed(target - 2 * pad_x, 2), fixed(target - 2 * pad_y, 2))
    return F.when(pad_x.isNull() | pad_y.isNull(), F.lit(f"0 0 {target} {target}")).otherwise(box)


def box_iou(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Intersection over union of boxes with exclusive maxima; both null 1, one null 0, an empty union 1."""
    ax0, ay0, ax1, ay1 = a
    bx0, by0, bx1, by1 = b
    inter = F.greatest(F.lit(0), F.least(ax1, bx1) - F.greatest(ax0, bx0)) * F.greatest(F.lit(0), F.least(ay1, by1) - F.greatest(ay0, by0))
    union = (ax1 - ax0) * (ay1 - ay0) + (bx1 - bx0) * (by1 - by0) - inter
    iou = F.when(union == 0, 1.0).otherwise(F.try_divide(inter.cast("double"), union.cast("double")))
    return F.when(ax0.isNull() & bx0.isNull(), 1.0).when(ax0.isNull() | bx0.isNull(), 0.0).otherwise(iou)


def hex_to_rgb(c: Column) -> Column:
    """[r, g, b] of a colour of exactly six hexadecimal digits, else null."""
    part = lambda i: F.conv(F.substring(c, i, 2), 16, 10).cast("int")
    return F.when(c.rlike("^#[0-9a-fA-F]{6}$"), F.array(part(2), part(4), part(6)))


def rgb_to_hex(r: Column, g: Column, b: Column) -> Column:
    return F.concat(F.lit("#"), *[F.lpad(F.lower(F.hex(x.cast("long"))), 2, "0") for x in (r, g, b)])


def average_colour(colours: Column) -> Column:
    """The mean of a list of colours, each channel cut to a whole number; colours that aren't valid don't count."""
    rgb = F.filter(F.transform(colours, hex_to_rgb), lambda x: x.isNotNull())
    channel = lambda i: F.aggregate(rgb, F.lit(0).cast("long"), lambda s, x: s + x[i])
    mean = [F.floor(channel(i) / F.size(rgb)) for i in range(3)]
    return F.when(F.size(rgb) > 0, rgb_to_hex(*mean))


def gray(r: Column, g: Column, b: Column) -> Column:
    return 0.299 * r + 0.587 * g + 0.114 * b


def psnr_score(mse: Column) -> Column:
    """Peak signal to noise in decibels over 40, at most 1; no error at all is 1."""
    return F.when(mse == 0, 1.0).otherwise(F.least((20 * math.log10(255.0) - 10 * F.log10(F.nullif(mse, F.lit(0.0)))) / 40.0, F.lit(1.0)))


def ssim_global_abs(mx: Column, my: Column, vx: Column, vy: Column, cov: Column) -> Column:
    """Similarity of two whole images from their moments; the covariance counts without its sign."""
    c1, c2 = (0.01 * 255) ** 2, (0.03 * 255) ** 2
    value = (2 * mx * my + c1) / (mx * mx + my * my + c1) * (2 * F.abs(cov) + c2) / (vx + vy + c2)
    return F.greatest(F.lit(0.0), F.least(value, F.lit(1.0)))


def scheduled(best: Column | float, worst: Column | float, step: Column) -> Column:
    """(max, min) of the format reward, interpolated over 150 steps and held at 1 and -1."""
    hi = F.greatest(F.lit(1.0), 2 - (2 - F.lit(best)) * step / 150)
    lo = F.least(F.lit(-1.0), -2 + (2 + F.lit(worst)) * step / 150)
    return F.struct(hi.alias("max_reward"), lo.alias("min_reward"))


def scheduled_correctness(best: Column | float, worst: Column | float, step: Column) -> Column:
    hi = F.least(F.lit(3.0), (F.lit(best) - 2) * step / 150 + 2)
    lo = F.greatest(F.lit(-3.0), (F.lit(worst) + 2) * step / 150 - 2)
    return F.struct(hi.alias("max_reward"), lo.alias("min_reward"))


def percentage(value: Column, total: Column) -> Column:
    return F.when(total > 0, F.concat(fixed(100.0 * value / total, 2), F.lit("%"))).otherwise("0.00%")


def png_size(c: Column) -> Column:
    """(width, height) of PNG bytes from the header, or nulls where the signature is another."""
    ok = F.hex(F.substring(c, 1, 8)) == "89504E470D0A1A0A"
    number = lambda at: F.when(ok & (F.octet_length(c) >= 24), F.conv(F.hex(F.substring(c, at, 4)), 16, 10).cast("long"))
    return F.struct(number(17).alias("width"), number(21).alias("height"))
