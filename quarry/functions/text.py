"""Text functions over markup, completions and style lists: columns in, columns out, no Python per row.

Where Java's and Python's regular expressions differ, the pattern here is the one that gives the intended result in
Java: $1 for groups, (?s) for dots that match line breaks, ASCII classes unless (?U) is given.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names and limits that the data format defines.
CJK = r"[\u2e80-\u2fff\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff]"
FONT_STACK = "'PingFang TC','PingFang SC','Songti TC','Songti SC',sans-serif"
BRANDING_CLASSES = "highcharts-credits|branding|creditgroup|messageGroup"
BRANDING_TEXTS = ("FusionCharts XT Trial", "Loading chart. Please wait", "Created with Highcharts", "www.highcharts.com")
INVALID_VALUES = ("null", "undefined", "nan", "infinity", "-infinity")
IMAGE_KEYS = ("path", "image", "image_path", "file", "filepath", "file_path", "url")
XLINK = "http://www.w3.org/1999/xlink"
LANGUAGE_IDS = {
    "assembly": 45, "bash": 46, "basic": 47, "c": 50, "c++": 54, "clojure": 86, "c#": 51, "cobol": 77,
    "common lisp": 55, "d": 56, "elixir": 57, "erlang": 58, "executable": 44, "f#": 87, "fortran": 59, "go": 60,
    "groovy": 88, "haskell": 61, "java": 62, "javascript": 63, "kotlin": 78, "lua": 64, "multi-file program": 89,
    "objective-c": 79, "ocaml": 65, "octave": 66, "pascal": 67, "perl": 85, "php": 68, "plain text": 43,
    "prolog": 69, "python": 71, "python2": 70, "python3": 71, "r": 80, "ruby": 72, "rust": 73, "scala": 81,
    "sql": 82, "swift": 83, "typescript": 74, "visual basic.net": 84,
}
PYTHON_ID = 71

NUMBER = r"-?\d*\.?\d+"
COORDINATE = r"[-+]?\d*\.?\d+(?:[eE][-+]?\d+)?"
COLOUR = r"#(?:[0-9a-fA-F]{3}){1,2}"
FLOAT = r"^\s*[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?\s*$"


def strip(c: Column) -> Column:
    """Remove white space of any kind (ASCII) at both ends; trim() knows the blank only."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def nonempty(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def every(c: Column, pattern: str, group: int = 0) -> Column:
    """All matches of a pattern, in order."""
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(group))


def strip_xml_declaration(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"<\?xml.*?\?>", ""))


def strip_images(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"(?i)<image[^>]*?/>", ""), r"(?is)<image[^>]*?>.*?</image>", "")


def strip_blocks(c: Column, tags: Sequence[str]) -> Column:
    """Remove elements of these names with all they hold, up to the first closing tag."""
    for tag in tags:
        c = F.regexp_replace(c, rf"(?is)<{tag}[^>]*>.*?</{tag}>", "")
    return c


def strip_branding(c: Column, classes: str = BRANDING_CLASSES, texts: Sequence[str] = BRANDING_TEXTS) -> Column:
    """Remove text, g and a elements with a branding class, then elements around branding texts."""
    for tag in ("text", "g", "a"):
        c = F.regexp_replace(c, rf'(?is)<{tag}[^>]*class="[^"]*(?:{classes})[^"]*"[^>]*>.*?</{tag}>', "")
    for text in texts:
        quoted = "".join(ch if ch.isalnum() or ch == " " else "\\" + ch for ch in text)
        c = F.regexp_replace(c, rf"(?i)<[^>]+>[^<]*{quoted}[^<]*</[^>]+>", "")
    return c


def strip_identity_transforms(c: Column) -> Column:
    c = F.regexp_replace(c, r'transform="matrix\(1\.0*,\s*0\.0*,\s*0\.0*,\s*1\.0*,\s*0\.0*,\s*0\.0*\)"', "")
    return F.regexp_replace(c, r'transform="matrix\(\s*1\s*,\s*0\s*,\s*0\s*,\s*1\s*,\s*0\s*,\s*0\s*\)"', "")


def is_html_masquerade(c: Column) -> Column:
    """Whether what claims to be SVG starts as an HTML page or an XML parser's error page."""
    head = F.lower(strip(F.substring(c, 1, 500)))
    return head.startswith("<!doctype html") | head.contains("<html") | head.contains("parsererror") | head.contains("xml parsing error")


def declare_xlink(c: Column) -> Column:
    """Declare the xlink prefix on the root element where it is used but not declared."""
    missing = c.contains("xlink:") & ~c.contains("xmlns:xlink")
    at = F.instr(c, "<svg")
    put = F.concat(F.substring(c, F.lit(1), at + 3), F.lit(f' xmlns:xlink="{XLINK}"'), F.substring(c, at + 4, F.length(c)))
    return F.when(missing & (at > 0), put).otherwise(c)


def first_svg(c: Column) -> Column:
    """The first whole SVG element, or the text without its code fences."""
    found = F.regexp_extract(c, r"(?i)(<svg[\s\S]*?</svg>)", 1)
    bare = strip(F.regexp_replace(F.regexp_replace(c, r"```(?:xml|svg)?\n", ""), r"```\s*$", ""))
    return F.coalesce(nonempty(found), bare)


def outer_svg(c: Column) -> Column:
    """From the first <svg to the last </svg>; else from the start token through the end token; else nothing."""
    svg = F.regexp_extract(c, r"(?s)(<svg.*</svg>)", 1)
    token = F.regexp_extract(c, r"(?s)(\[<\|START_OF_SVG\|>\].*?\[<\|END_OF_SVG\|>\])", 1)
    rest = F.regexp_extract(c, r"(?s)(\[<\|START_OF_SVG\|>\].*)", 1)
    return F.when(c.contains("<svg") & c.contains("</svg>"), svg).otherwise(F.coalesce(nonempty(token), rest))


def clean_invisible(c: Column) -> Column:
    """No-break spaces become blanks, zero-width spaces go, white space is collapsed."""
    return F.regexp_replace(F.translate(c, " ​", " "), r"\s+", " ")


def style_map(c: Column) -> Column:
    """A declaration list as a map: items without a colon are dropped, the last of equal names counts."""
    items = F.filter(F.split(F.coalesce(c, F.lit("")), ";"), lambda x: x.contains(":"))
    entries = F.transform(items, lambda x: F.struct(strip(F.substring_index(x, ":", 1)).alias("key"), strip(F.substring(x, F.instr(x, ":") + 1, F.length(x))).alias("value")))
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda later: later["key"] == e["key"]))
    return F.map_from_entries(last)


def drop_invalid_styles(c: Column, values: str = r"null|undefined|nan|[-+]?infinity") -> Column:
    c = F.regexp_replace(c, rf"(?i)(?:^|;)\s*[-\w]+\s*:\s*(?:{values})\s*(?=;|$)", "")
    return F.regexp_replace(c, r"^[ ;]+|[ ;]+$", "")


def has_cjk(c: Column) -> Column:
    return c.rlike(CJK)


def set_font(style: Column, family: str = FONT_STACK) -> Column:
    """Replace the font-family of a declaration list, or append one."""
    body = F.regexp_replace(style, r"[ ;]+$", "")
    put = F.when(body == "", F.lit(f"font-family: {family}")).otherwise(F.concat(body, F.lit(f"; font-family: {family}")))
    return F.when(style.rlike(r"(?i)(?:^|;)\s*font-family\s*:"), F.regexp_replace(style, r"(?i)((?:^|;)\s*font-family\s*:)\s*[^;]*", f"$1 {family}")).otherwise(put)


def tidy_brackets(c: Column) -> Column:
    """No white space around square brackets, one blank after digits."""
    c = F.regexp_replace(F.regexp_replace(c, r"\s*\[\s*", "["), r"\s*\]\s*", "]")
    return F.regexp_replace(F.regexp_replace(c, r"(\d)\s+", "$1 "), r"\]\s*\[", "][")


def pad_brackets(c: Column) -> Column:
    return strip(F.regexp_replace(F.replace(F.replace(c, F.lit("["), F.lit(" [")), F.lit("]"), F.lit("] ")), r"\s+", " "))


def reinsert_numbers(c: Column, numbers: Column, mark: str = "<|num|>") -> Column:
    """Put the numbers back for their marks, in order; marks beyond them become <missing_num>."""
    parts = F.split(c, mark.replace("|", "\\|"))
    filled = F.transform(parts, lambda p, i: F.when(i == 0, p).otherwise(F.concat(F.coalesce(F.get(numbers, i - 1), F.lit("<missing_num>")), p)))
    return F.array_join(filled, "")


def last_code_block(c: Column, language: str) -> Column:
    return F.coalesce(F.try_element_at(every(c, rf"(?s)```{language}\n(.*?)```", 1), F.lit(-1)), F.lit(""))


def bracketed_score(c: Column) -> Column:
    """[[n]] or else a number at the end, over 10, within 0 and 1; else 0."""
    found = F.coalesce(nonempty(F.regexp_extract(c, r"\[\[(\d+(?:\.\d+)?)\]\]", 1)), nonempty(F.regexp_extract(strip(c), r"(\d+(?:\.\d+)?)$", 1)))
    return F.coalesce(F.least(F.greatest(found.cast("double") / 10.0, F.lit(0.0)), F.lit(1.0)), F.lit(0.0))


def yes_no(c: Column) -> Column:
    return F.when(F.regexp_extract(c, r"\[([A-Z]+)\]", 1) == "YES", 1.0).otherwise(0.0)


def answer(c: Column) -> Column:
    """What stands between answer tags on one line, or the whole text, trimmed."""
    return F.when(c.rlike(r"<answer>(.*?)</answer>"), strip(F.regexp_extract(c, r"<answer>(.*?)</answer>", 1))).otherwise(strip(c))


def format_ok(response: Column, solution: Column) -> Column:
    """Whether a response has just the sections that the solution has: think, then tool_call, then response."""
    once = lambda *tags: [F.regexp_count(response, F.lit(t)) == 1 for tag in tags for t in (f"<{tag}>", f"</{tag}>")]

    def fits(*tags: str) -> Column:
        body = r"\s*".join(rf"<{t}>.*?</{t}>" for t in ("think", *tags))
        ok = response.rlike(rf"(?s)^{body}$")
        for cond in once(*tags):
            ok = ok & cond
        return ok

    says, calls = solution.contains("<response>"), solution.contains("<tool_call>")
    return F.when(says & ~calls, fits("response")).when(~says & calls, fits("tool_call")).when(says & calls, fits("tool_call", "response")).otherwise(fits())


def code_format_ok(c: Column, language: str) -> Column:
    return c.rlike(rf"(?sm)\A<think>.*?</think>\s*<answer>.*?```{language}.*?```.*?</answer>(?![\s\S])")


def word_count(c: Column) -> Column:
    """Words between white space; an empty text has none."""
    body = strip(c)
    return F.when(body == "", 0).otherwise(F.size(F.split(body, r"\s+")))


def tool_calls(c: Column) -> Column:
    """Action / Action Input pairs of a ReAct text, or null where there are none."""
    pattern = r"(?s)Action:\s*(.*?)\s*\nAction Input:\s*(.*?)(?:\n|$)"
    found = F.zip_with(every(c, pattern, 1), every(c, pattern, 2), lambda a, b: F.struct(strip(a).alias("tool"), strip(b).alias("params")))
    return F.when(F.size(found) > 0, found)


def escape_text(c: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return c


def quote_attribute(c: Column) -> Column:
    """A quoted attribute value: double quotes unless the value holds these and no single ones."""
    safe = escape_text(c)
    for raw, code in (("\n", "&#10;"), ("\r", "&#13;"), ("\t", "&#9;")):
        safe = F.replace(safe, F.lit(raw), F.lit(code))
    double, single = c.contains('"'), c.contains("'")
    return F.when(double & ~single, F.concat(F.lit("'"), safe, F.lit("'"))).otherwise(F.concat(F.lit('"'), F.replace(safe, F.lit('"'), F.lit("&quot;")), F.lit('"')))


def language_id(c: Column) -> Column:
    known = F.create_map(*[F.lit(x) for kv in LANGUAGE_IDS.items() for x in kv])
    return F.coalesce(F.try_element_at(known, F.lower(strip(c))), F.lit(PYTHON_ID))


def between(c: Column, start: str, end: str) -> Column:
    """What stands between two marks; null where one is absent."""
    a, b = F.instr(c, start), F.instr(c, end)
    return F.when((a > 0) & (b > 0), strip(F.substring(c, a + len(start), F.greatest(b - a - len(start), F.lit(0)))))


def drop_square_brackets(c: Column) -> Column:
    return F.translate(c, "[]", "")


def path_is_closed(c: Column) -> Column:
    return c.rlike(r"[Zz]\s*$")


def text_parts(parts: Column) -> Column:
    """The strings of a list of message parts, joined; parts that are null are skipped."""
    return F.array_join(F.filter(parts, lambda x: x.isNotNull()), "")


def basename(c: Column) -> Column:
    return F.regexp_extract(c, r"([^/]*)$", 1)


def stem(c: Column) -> Column:
    """The file name without its last extension; a leading dot starts no extension."""
    return F.regexp_replace(basename(c), r"(?<=[^.])\.[^.]*$", "")


def stable_hash(c: Column) -> Column:
    """h = h * 31 + code point, modulo 2^32, over all characters."""
    codes = F.transform(F.split(c, ""), lambda x: F.ascii(x).cast("long"))
    return F.aggregate(codes, F.lit(0).cast("long"), lambda h, x: (h * 31 + x).bitwiseAND(F.lit(4294967295)))


def glob_match(c: Column, patterns: Sequence[str]) -> Column:
    out = F.lit(False)
    for p in patterns:
        like = p.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_").replace("*", "%").replace("?", "_")
        out = out | c.like(like)
    return out


def repeat_penalty(c: Column, floor: float = 0.8, weight: float = 0.5) -> Column:
    """(tags, distinct tags, penalty): one less `weight` times the share of repeated tags, not under the floor."""
    tags = every(strip(F.regexp_replace(c, r"\s+", " ")), r"<[^>]+?>")
    n, u = F.size(tags), F.size(F.array_distinct(tags))
    penalty = F.when(n > 0, F.greatest(F.lit(floor), 1.0 - weight * (n - u) / n)).otherwise(1.0)
    return F.struct(n.cast("long").alias("tags"), u.cast("long").alias("unique_tags"), penalty.alias("penalty"))


def balanced_svg(c: Column) -> Column:
    """From the first <svg to the </svg> that closes it, nested ones counted; null where none does."""
    own = F.substring(c, F.instr(c, "<svg"), F.length(c))
    tags, gaps = every(own, "<svg|</svg>"), F.split(own, "<svg|</svg>")
    steps = F.zip_with(tags, F.slice(gaps, 1, F.size(tags)), lambda t, g: F.struct(F.when(t == "<svg", 1).otherwise(-1).alias("way"), (F.length(g) + F.length(t)).alias("n")))

    def step(s: Column, x: Column) -> Column:
        depth, at = s["depth"] + x["way"], s["at"] + x["n"]
        return F.when(s["end"] > 0, s).otherwise(F.struct(depth.alias("depth"), at.alias("at"), F.when(depth == 0, at).otherwise(0).alias("end")))

    end = F.aggregate(steps, F.struct(F.lit(0).alias("depth"), F.lit(0).alias("at"), F.lit(0).alias("end")), step)["end"]
    return F.when((F.instr(c, "<svg") > 0) & (end > 0), strip(F.substring(own, F.lit(1), end)))


def prompt(template: str, **values: Column) -> Column:
    """A template with {name} replaced by columns; null where one of them is null."""
    out, parts = template, []
    for name in re.findall(r"\{(\w+)\}", template):
        before, _, out = out.partition("{" + name + "}")
        parts += [F.lit(before), values[name].cast("string")]
    return F.concat(*parts, F.lit(out))


def chat_text(messages: Column, ask: bool = True) -> Column:
    """Messages as one text with marks around each turn, and with `ask` the opening of the answer."""
    turn = F.transform(messages, lambda m: F.concat(F.lit("<|im_start|>"), m["role"], F.lit("\n"), F.coalesce(m["content"], F.lit("")), F.lit("<|im_end|>\n")))
    return F.concat(F.array_join(turn, ""), F.lit("<|im_start|>assistant\n" if ask else ""))


def tagged_json(c: Column, tag: str, schema: str) -> Column:
    """The objects in the lines of the first section of a tag; lines that are no such JSON are null."""
    body = strip(F.regexp_extract(c, rf"(?s)<{tag}>(.*?)</{tag}>", 1))
    return F.when(c.contains(f"<{tag}>"), F.transform(F.split(body, "\n"), lambda x: F.from_json(x, schema)))


def shared_pairs(a: Column, b: Column) -> Column:
    """How many keys of one map have an equal value in another."""
    return F.size(F.map_filter(a, lambda k, v: F.try_element_at(b, k) == v))
