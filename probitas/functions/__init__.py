"""Scalar functions: tolerant comparisons, the expression algebra, and helpers."""

from .compare import EPSILON, PREDICATES, within_tol
from .expr import Expr, coalesce, const, exp, function, log, maximum_of, minimum_of, pct, sqrt

__all__ = ["EPSILON", "PREDICATES", "Expr", "coalesce", "const", "exp", "function", "log", "maximum_of", "minimum_of", "pct", "sqrt", "within_tol"]
