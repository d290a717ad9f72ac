"""Small helpers for nested columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), lambda v: body(v)), 1)


def distinct_by(items: Column, key: Callable[[Column], Column]) -> Column:
    """First item per key, in order; sorts inside the row, so nothing is shuffled."""

    def pick(keyed: Column) -> Column:
        heads = F.filter(keyed, lambda s, i: (i == 0) | (F.get(keyed, i - 1)["k"] != s["k"]))
        return F.array_sort(F.transform(heads, lambda s: s["i"]))

    return bind(items, lambda xs: F.transform(bind(_keyed(xs, key), pick), lambda i: F.get(xs, i)))


def _keyed(items: Column, key: Callable[[Column], Column]) -> Column:
    return F.array_sort(F.transform(items, lambda x, i: F.struct(key(x).alias("k"), i.alias("i"))))
