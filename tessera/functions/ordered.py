"""Ordered folds over short arrays that no built-in expresses, and a safe evaluator of arithmetic."""

from __future__ import annotations

import ast
import operator
import re
from bisect import bisect_right
from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType


def longest_non_decreasing(numbers: list[int]) -> list[int]:
    """Positions of a longest non-decreasing subsequence; of several, the one that ends first."""
    lengths: list[int] = []
    tails: list[int] = []
    before = [-1] * len(numbers)
    ends: list[int] = []
    for i, x in enumerate(numbers):
        k = bisect_right(tails, x)
        before[i] = ends[k - 1] if k else -1
        if k == len(tails):
            tails.append(x)
            ends.append(i)
        else:
            tails[k], ends[k] = x, i
        lengths.append(k + 1)
    out, i = [], lengths.index(max(lengths)) if lengths else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def longest_run_of_ones(numbers: list[int]) -> list[int]:
    """Positions of the longest chain n, n+1, n+2, ... that takes the first next number; all positions if none has two.

    From the last number to the first: the chain of a number is that of the first number after it that is one more.
    """
    length, after, nearest = [1] * len(numbers), [-1] * len(numbers), {}
    for i in range(len(numbers) - 1, -1, -1):
        if (j := nearest.get(numbers[i] + 1)) is not None:
            after[i], length[i] = j, length[j] + 1
        nearest[numbers[i]] = i
    if max(length, default=0) < 2:
        return [*range(len(numbers))]
    out = [length.index(max(length))]
    while after[out[-1]] >= 0:
        out.append(after[out[-1]])
    return out


@F.pandas_udf(ArrayType(IntegerType()))
def non_decreasing(numbers: pd.Series) -> pd.Series:
    return numbers.map(lambda x: longest_non_decreasing(list(x)) if x is not None else None)


@F.pandas_udf(ArrayType(IntegerType()))
def chain_of_ones(numbers: pd.Series) -> pd.Series:
    return numbers.map(lambda x: longest_run_of_ones(list(x)) if x is not None else None)


_OPERATIONS = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: operator.truediv, ast.USub: operator.neg, ast.UAdd: operator.pos}
_PLAIN = re.compile(r"[\d+\-*/().]+")
_SIGNS = str.maketrans({"×": "*", "x": "*", "÷": "/"})
_WHOLE = re.compile(r" *(?:0|[1-9][0-9]{0,14}) *")
#: Expressions whose values a worker holds.
HELD = 65_536


@lru_cache(HELD)
def arithmetic(expression: str) -> float | None:
    """The value of an expression of numbers, + - * / × x ÷, ** and brackets; None for anything else, or no finite value."""
    if _WHOLE.fullmatch(expression):
        return float(expression)

    def value(node: ast.AST) -> float:
        if isinstance(node, ast.Constant) and isinstance(node.value, int | float):
            return float(node.value)
        if isinstance(node, ast.BinOp) and isinstance(node.op, ast.Pow):
            out = value(node.left) ** value(node.right)
            if isinstance(out, complex):
                raise ValueError(node)
            return out
        if isinstance(node, ast.BinOp) and type(node.op) in _OPERATIONS:
            return _OPERATIONS[type(node.op)](value(node.left), value(node.right))
        if isinstance(node, ast.UnaryOp) and type(node.op) in _OPERATIONS:
            return _OPERATIONS[type(node.op)](value(node.operand))
        raise ValueError(node)

    plain = re.sub(r"\s+", "", expression).translate(_SIGNS)
    if not _PLAIN.fullmatch(plain):
        return None
    try:
        out = value(ast.parse(plain, mode="eval").body)
    except (SyntaxError, ValueError, ZeroDivisionError, OverflowError, RecursionError, MemoryError):
        return None
    return out if abs(out) < float("inf") else None


_INEQUALITY = re.compile(r"(<=|>=|<|>)")
_HOLDS = {"<": operator.lt, ">": operator.gt, "<=": operator.le, ">=": operator.ge}
_WORDS = re.compile(r"[A-Za-z가-힣\\_^]")
TOLERANCE = 1e-9


def chain_faults(line: str) -> list[str]:
    """Codes of a line without letters (but for x between numbers) whose equalities or inequalities do not hold.

    E_ARITH_MISMATCH: one equality of two values; E_CHAIN_EQ_MISMATCH: three and more values; E_INEQ_CHAIN_MISMATCH:
    two and more signs of inequality, up to the first part that is no value.
    """
    plain = line.replace("$", "").strip()
    if _WORDS.search(plain):
        return []
    out = []
    parts = [x for x in plain.split("=") if x.strip()]
    values = [arithmetic(x) for x in parts]
    if None not in values:
        equal = all(abs(a - b) <= TOLERANCE for a, b in zip(values, values[1:], strict=False))
        if plain.count("=") == 1 and len(values) == 2 and not equal:
            out.append("E_ARITH_MISMATCH")
        if plain.count("=") >= 2 and len(values) >= 3 and not equal:
            out.append("E_CHAIN_EQ_MISMATCH")
    pieces = [x for x in _INEQUALITY.split(plain) if x.strip()]
    if len(pieces) >= 5 and len(pieces) % 2:
        for a, sign, b in zip(pieces[::2], pieces[1::2], pieces[2::2], strict=False):
            left, right = arithmetic(a), arithmetic(b)
            if left is None or right is None or sign not in _HOLDS:
                break
            if not _HOLDS[sign](left, right):
                out.append("E_INEQ_CHAIN_MISMATCH")
                break
    return out


@F.pandas_udf(ArrayType(StringType()))
def arithmetic_issues(text: pd.Series) -> pd.Series:
    """Codes of the lines whose equalities or inequalities between plain numbers do not hold."""
    codes = {t: [c for line in re.split(r"\r?\n", t or "") for c in chain_faults(line)] for t in text.unique()}  # equal texts of a batch once
    return pd.Series([codes[t] for t in text])
