"""Comparisons with a tolerance, for floats and for columns alike.

All are strict against the shifted bound, so with a tolerance of 0 ``is_eq`` never holds and
``is_geq`` refuses equality.
"""

from __future__ import annotations

from pyspark.sql import Column

EPSILON = 1e-9


def is_geq(a, b, tol=EPSILON):
    return a > b - tol


def is_gt(a, b, tol=EPSILON):
    return a > b + tol


def is_leq(a, b, tol=EPSILON):
    return a < b + tol


def is_lt(a, b, tol=EPSILON):
    return a < b - tol


def is_eq(a, b, tol=EPSILON):
    return _abs(a - b) < tol


def is_neq(a, b, tol=EPSILON):
    return _abs(a - b) >= tol


def is_between(a, lower, upper, tol=EPSILON):
    return is_geq(a, lower, tol) & is_leq(a, upper, tol)


def is_not_between(a, lower, upper, tol=EPSILON):
    return is_lt(a, lower, tol) | is_gt(a, upper, tol)


def is_zero(a, tol=EPSILON):
    return _abs(a) < tol


def is_positive(a, tol=EPSILON):
    return a > tol


def is_negative(a, tol=EPSILON):
    return a < -tol


def _abs(x):
    if isinstance(x, Column):
        from pyspark.sql import functions as F

        return F.abs(x)
    return abs(x)


def within_tol(a: float, b: float, rel_tol=None, abs_tol=None) -> bool:
    """Whether a is near b, by exactly one of a relative and an absolute tolerance."""
    if (rel_tol is None) == (abs_tol is None):
        raise ValueError("Give exactly one of rel_tol and abs_tol")
    return abs(a - b) < abs_tol if rel_tol is None else abs(a - b) < rel_tol * abs(b)


PREDICATES = {f.__name__: f for f in (is_geq, is_gt, is_leq, is_lt, is_eq, is_neq, is_between, is_not_between, is_zero, is_positive, is_negative)}
