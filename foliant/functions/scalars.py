"""Scalars that the built-in functions cannot state: evaluation of arithmetic text, parsing of literal lists."""
from __future__ import annotations

import ast
import re

import pandas as pd
from pyspark.sql import functions as F

_TOKEN = re.compile(r"\s*(?:(?P<num>(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)|(?P<op>\*\*|//|[-+*/%()]))\s*")
# strength of each operator and its value; ** binds to the right and before a sign on its left
_BINARY = {
    "+": (1, lambda a, b: a + b), "-": (1, lambda a, b: a - b), "*": (2, lambda a, b: a * b), "/": (2, lambda a, b: a / b),
    "//": (2, lambda a, b: a // b), "%": (2, lambda a, b: a % b), "**": (4, lambda a, b: _power(a, b)),
}
_SIGN = 3
_DEPTH = 200


def _power(a, b):
    if abs(b) > 64 or abs(a) > 10**6:
        raise ValueError("power out of bounds")
    return a**b


def _scan(text: str) -> list:
    """Numbers as values, operators as strings, an empty string behind the last."""
    out, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError(f"not allowed at {at}")
        n = m["num"]
        out.append(m["op"] if n is None else int(n) if n.isdigit() else float(n))
        at = m.end()
    return out + [""]


def _value(tokens: list, at: int, least: int, depth: int = 0):
    """(value, place behind it) of the longest expression from ``at`` whose operators are at least so strong."""
    if depth > _DEPTH:
        raise ValueError("nested too deep")
    head = tokens[at]
    if head == "(":
        left, at = _value(tokens, at + 1, 1, depth + 1)
        if tokens[at] != ")":
            raise SyntaxError("bracket")
        at += 1
    elif head in ("+", "-"):
        left, at = _value(tokens, at + 1, _SIGN, depth + 1)
        left = -left if head == "-" else left
    elif isinstance(head, str):
        raise SyntaxError("number expected")
    else:
        left, at = head, at + 1
    while isinstance(tokens[at], str) and tokens[at] in _BINARY and _BINARY[tokens[at]][0] >= least:
        strength, f = _BINARY[tokens[at]]
        right, at = _value(tokens, at + 1, _SIGN if strength > _SIGN else strength + 1, depth + 1)
        left = f(left, right)
    return left, at


def evaluate(text: str | None) -> str | None:
    """Value of + - * / // % ** with signs and brackets by operator precedence; anything else is an error text. Powers are bounded."""
    if text is None:
        return None
    try:
        tokens = _scan(text)
        value, at = _value(tokens, 0, 1)
        if tokens[at] != "":
            raise SyntaxError("operator expected")
        return str(value)
    except (ValueError, SyntaxError, ArithmeticError) as e:
        return f"error: {type(e).__name__}"


def plan_list(text: str | None) -> list[str]:
    """The literal list of the first fenced python block; no block or no list gives none."""
    m = re.search(r"```python\s*(.*?)```", text or "", re.S)
    try:
        v = ast.literal_eval(m.group(1).strip()) if m else []
        return [str(x) for x in v] if isinstance(v, list) else []
    except (ValueError, SyntaxError):
        return []


def evaluate_udf(col):
    def f(s: pd.Series) -> pd.Series:
        return s.map(evaluate)

    return F.pandas_udf(f, "string")(col)


def plan_list_udf(col):
    def f(s: pd.Series) -> pd.Series:
        return s.map(plan_list)

    return F.pandas_udf(f, "array<string>")(col)
