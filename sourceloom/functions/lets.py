"""Bind an intermediate value inside one column expression.

``let(x, f)`` evaluates ``x`` once and hands it to ``f``.  Without it a chain of regular
expressions over the same text would be expanded (and evaluated) once per use.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def none_if_blank(col: Column) -> Column:
    return F.when(col != "", col)
