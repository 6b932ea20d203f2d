"""Binding a value once inside an expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once per row.

    An expression used inside a lambda is otherwise evaluated again for every element.
    """
    return F.transform(F.array(value), body)[0]
