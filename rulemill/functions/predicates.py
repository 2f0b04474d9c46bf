"""The seven condition shapes as boolean columns. A null operand never violates a rule."""
from __future__ import annotations

import operator
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from rulemill.functions.text import is_blank

COMPARE: dict[str, Callable[[Column, Column], Column]] = {
    ">": operator.gt, "<": operator.lt, ">=": operator.ge,
    "<=": operator.le, "==": operator.eq, "!=": operator.ne,
}


def _holds(left: Column, op: str, right: Column) -> Column:
    return F.coalesce(COMPARE[op](left, right), F.lit(False))


def field_comparison(left: Column, op: str, right: Column) -> Column:
    return _holds(left, op, right)


def field_threshold(left: Column, op: str, threshold: float) -> Column:
    return _holds(left, op, F.lit(float(threshold)))


def missing_field(field: Column, blank: Callable[[Column], Column] = is_blank) -> Column:
    return blank(field)


def scaled_comparison(left: Column, op: str, right: Column, factor: float) -> Column:
    return _holds(left, op, right * F.lit(float(factor)))


def affine_comparison(left: Column, op: str, right: Column, factor: float, offset: float) -> Column:
    return _holds(left, op, F.lit(float(factor)) * right + F.lit(float(offset)))


def sum_comparison(a: Column, b: Column, op: str, right: Column, offset: float, minus: bool = False) -> Column:
    return _holds(a - b if minus else a + b, op, right + F.lit(float(offset)))


def compound_and(clauses: Sequence[tuple[Column, str, float]]) -> Column:
    return reduce(operator.and_, [field_threshold(*clause) for clause in clauses])
