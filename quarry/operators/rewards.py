"""Scores of completions: a registry of named functions from columns to a column of doubles."""

from __future__ import annotations

import ast
import json
import operator
import re
from collections import Counter
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from quarry.functions import numeric as N
from quarry.functions import text as T

REGISTRY: dict[str, Callable[..., Column]] = {}


def reward(name: str) -> Callable[[Callable[..., Column]], Callable[..., Column]]:
    def add(f: Callable[..., Column]) -> Callable[..., Column]:
        REGISTRY[name] = f
        return f

    return add


@reward("think_length")
def think_length(completion: Column, longest: float = 512.0) -> Column:
    """Words after the last <think>, up to </think>, over `longest`: two decimals, at most 1, 0 without the tags."""
    body = F.element_at(F.split(F.element_at(F.split(completion, "<think>"), -1), "</think>"), 1)
    share = N.rounded(T.word_count(body) / F.lit(longest), 2)
    return F.when(completion.contains("<think>") & completion.contains("</think>"), F.least(share, F.lit(1.0))).otherwise(0.0)


@reward("tool_format")
def tool_format(completion: Column, solution: Column, best: float = 1.0, worst: float = 0.0) -> Column:
    return F.when(T.format_ok(completion, solution), best).otherwise(worst)


@reward("code_format")
def code_format(completion: Column, language: str = "python") -> Column:
    return T.code_format_ok(completion, language).cast("double")


@reward("answer")
def answer(completion: Column, solution: Column) -> Column:
    return (T.answer(completion) == T.answer(solution)).cast("double")


@reward("judge_score")
def judge_score(response: Column) -> Column:
    return T.bracketed_score(response)


@reward("judge_verdict")
def judge_verdict(choices: Column) -> Column:
    """Mean of the verdicts of an array of answers; 0 where there is none."""
    return F.when(F.size(choices) > 0, F.aggregate(choices, F.lit(0.0), lambda s, c: s + T.yes_no(c)) / F.size(choices)).otherwise(0.0)


@reward("pass_rate")
def pass_rate(passed: Column) -> Column:
    """Share of true values in an array of test results."""
    return F.coalesce(F.try_divide(F.size(F.filter(passed, lambda p: p)).cast("double"), F.size(passed).cast("double")), F.lit(0.0))


@reward("repeat_penalty")
def repeat_penalty(markup: Column) -> Column:
    return T.repeat_penalty(T.outer_svg(markup))["penalty"]


@reward("visual")
def visual(iou: Column, ssim: Column, psnr: Column, valid: Column) -> Column:
    """Mean of three image scores; -1 where the markup does not render."""
    return F.when(valid, (iou + ssim + psnr) / 3).otherwise(-1.0)


@reward("weighted")
def weighted(visual_: Column, penalty: Column, valid: Column, weights: tuple[float, float, float] = (0.2, 0.6, 0.2)) -> Column:
    """Syntax, image and repetition by weight; -1 where the markup does not render."""
    a, b, c = weights
    return F.when(valid, a + b * visual_ + c * penalty).otherwise(-1.0)


# --- scores that walk through structures ---------------------------------------------------------------------------

_OPS = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: operator.truediv, ast.USub: operator.neg, ast.UAdd: operator.pos}


def evaluate(expression: str) -> float:
    """The value of an arithmetic expression; anything but numbers, + - * / and parentheses raises ValueError."""

    def value(node: ast.AST) -> float:
        if isinstance(node, ast.Constant) and type(node.value) in (int, float):
            return node.value
        if isinstance(node, ast.BinOp) and type(node.op) in _OPS:
            return _OPS[type(node.op)](value(node.left), value(node.right))
        if isinstance(node, ast.UnaryOp) and type(node.op) in _OPS:
            return _OPS[type(node.op)](value(node.operand))
        raise ValueError(f"not arithmetic: {type(node).__name__}")

    return value(ast.parse(expression.strip(), mode="eval").body)


def calculate(expression: str) -> str:
    """The calculator tool: a result or an error as text."""
    text = expression.replace(" ", "").strip()
    if not re.fullmatch(r"[0-9+\-*/().\s]+", text):
        return "Error: expression contains disallowed characters."
    if text.count("(") != text.count(")"):
        return "Error: unmatched parentheses."
    try:
        return f"Result: {evaluate(text)}"
    except Exception as e:  # noqa: BLE001  every failure is an answer of the tool
        return f"Calculation error: {e}"


TOOLS: dict[str, Callable[[str], str]] = {"calculator": calculate}


def dispatch(tool: str, params: str) -> str:
    if tool not in TOOLS:
        return f"unknown tool {tool}"
    try:
        return TOOLS[tool](params)
    except Exception as e:  # noqa: BLE001
        return f"tool error {e}"


def countdown_score(completion: str | None, target: float | None, numbers: list[int] | None) -> float:
    """1 if the answer uses just the given numbers and evaluates to the target, else 0."""
    m = re.search(r"<answer>(.*?)</answer>", completion or "")
    if m is None or target is None or numbers is None:
        return 0.0
    equation = m[1].strip().split("=")[0]
    if sorted(map(int, re.findall(r"\d+", equation))) != sorted(numbers) or not re.match(r"^[\d+\-*/().\s]+$", equation):
        return 0.0
    try:
        return float(abs(evaluate(equation) - float(target)) < 1e-5)
    except (ValueError, SyntaxError, ZeroDivisionError, OverflowError, TypeError):
        return 0.0


def overlap(a: list, b: list) -> float:
    """Multiset intersection over union."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    both = sum((Counter(a) & Counter(b)).values())
    return both / (len(a) + len(b) - both)


def tool_score(truth: list[dict], found: list[dict], best: float = 3.0, worst: float = -3.0, granularity: str = "fine") -> float:
    """How well found tool calls match the true ones, between `worst` and `best`.

    Names score by multiset overlap. Each true call then takes the unused found call of its name that agrees best, the
    first of equals: by names of parameters and equal values ("fine"), or only if all is equal ("intermediate"). With
    "coarse" any difference at all is the worst score.
    """
    if truth == found:
        return best
    if granularity == "coarse":
        return worst
    total, most, free = overlap([t["name"] for t in truth], [f["name"] for f in found]), 1.0, list(found)
    for t in truth:
        most += 1.0 + (len(t["parameters"]) if granularity == "fine" else 0)
        top, at = 0.0, None
        for i, f in enumerate(free):
            if f is None or f["name"] != t["name"]:
                continue
            if granularity == "fine":
                own = f["parameters"]
                s = overlap(list(t["parameters"]), list(own)) + sum(k in own and own[k] == v for k, v in t["parameters"].items())
            else:
                s = float(t == f)
            if s > top:
                top, at = s, i
        if at is not None:
            free[at] = None
            total += top
    return (best - worst) * total / most + worst


def tool_text_score(completion: str | None, solution: str | None, **options) -> float:
    """Calls stand in the first tool_call section, a JSON object a line; a solution without one scores 0."""
    calls = lambda s: [json.loads(x) for x in s.split("<tool_call>")[1].split("</tool_call>")[0].strip().split("\n")]
    if "<tool_call>" not in (solution or ""):
        return 0.0
    worst = options.get("worst", -3.0)
    if "<tool_call>" not in (completion or "") or "</tool_call>" not in completion:
        return worst
    try:
        return tool_score(calls(solution), calls(completion), **options)
    except (ValueError, KeyError, TypeError, AttributeError, IndexError):
        return worst


@reward("countdown")
def countdown(completion: Column, target: Column, numbers: Column) -> Column:
    @pandas_udf("double")
    def run(c: pd.Series, t: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([countdown_score(x, y, None if z is None else list(z)) for x, y, z in zip(c, t, n, strict=True)])

    return run(completion, target.cast("double"), numbers)


@reward("tool_correct")
def tool_correct(completion: Column, solution: Column, granularity: str = "fine") -> Column:
    @pandas_udf("double")
    def run(c: pd.Series, s: pd.Series) -> pd.Series:
        return pd.Series([tool_text_score(x, y, granularity=granularity) for x, y in zip(c, s, strict=True)])

    return run(completion, solution)


def run_tools(text: Column) -> Column:
    """Observations of the tool calls of a ReAct text, in order; null where it has none."""

    @pandas_udf("array<string>")
    def run(calls: pd.Series) -> pd.Series:
        return pd.Series([None if c is None else [dispatch(x["tool"], x["params"]) for x in c] for c in calls])

    return run(T.tool_calls(text))
