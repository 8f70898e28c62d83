"""Window frames over trading days. Rows are keyed by (market, symbol) and ordered by date; frames count rows, not days."""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

KEYS = ("market", "symbol")


def by_date(*keys: str) -> WindowSpec:
    return Window.partitionBy(*(keys or KEYS)).orderBy("date")


def trailing(k: int, skip: int = 0, keys: tuple[str, ...] = KEYS) -> WindowSpec:
    """The last k rows, of which the newest is `skip` rows back."""
    return by_date(*keys).rowsBetween(-(k - 1) - skip, -skip)


def forward(h: int, keys: tuple[str, ...] = KEYS) -> WindowSpec:
    """The next h rows, today excluded."""
    return by_date(*keys).rowsBetween(1, h)


def full(value: Column, of: Column | str, k: int, frame: WindowSpec) -> Column:
    """value over the frame, or null unless the frame holds k non-null values of `of`."""
    return F.when(F.count(of).over(frame) == k, value.over(frame))


def mean(c: str, k: int, skip: int = 0, keys: tuple[str, ...] = KEYS) -> Column:
    return full(F.avg(c), c, k, trailing(k, skip, keys))


def rounded(c: Column, digits: int = 6) -> Column:
    """Rounded, and without a negative zero."""
    return F.when(F.abs(c) < 0.5 * 10**-digits, F.lit(0.0)).otherwise(F.round(c, digits))
