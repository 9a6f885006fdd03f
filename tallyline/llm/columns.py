"""Small column helpers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body uses it inside lambdas."""
    return F.get(F.transform(F.array(value), body), 0)


def small(frame: DataFrame, most_rows: int) -> DataFrame:
    """Marks a frame for broadcast if it has at most so many rows, which are counted first. The rows must be narrow."""
    return F.broadcast(frame) if frame.count() <= most_rows else frame
