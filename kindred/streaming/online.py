"""A mean that can grow, shrink and merge; and key counts of a stream."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from statistics import StatisticsError

from pyspark.sql import Column, DataFrame, functions as F


@dataclass
class OnlineMean:
    total: float = 0.0
    n: int = 0

    def add(self, x: float) -> None:
        self.total, self.n = self.total + x, self.n + 1

    def subtract(self, x: float) -> None:
        self.total, self.n = self.total - x, self.n - 1

    def merge(self, other: OnlineMean) -> OnlineMean:
        return OnlineMean(self.total + other.total, self.n + other.n)

    @property
    def mean(self) -> float:
        if self.n < 1:
            raise StatisticsError("no data point")
        return self.total / self.n


def mean_state(column: Column | str) -> list[Column]:
    """The aggregates (total, n) of a column; they can be summed again."""
    c = F.col(column) if isinstance(column, str) else column
    return [F.sum(c).alias("total"), F.count(c).alias("n")]


def key_counts(stream: DataFrame, key: Callable[[Column], Column], column: str = "value") -> DataFrame:
    """(key, n) of a batch or a stream: the state is one row per key."""
    return stream.groupBy(key(F.col(column)).alias("key")).agg(F.count("*").alias("n"))
