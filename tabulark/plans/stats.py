"""Table statistics: rows, distinct counts, equi-width histograms, selectivity."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def width_of(low: int, high: int, buckets: int) -> int:
    return max(1, math.ceil((high - low) / buckets))


def histogram_bucket(value: Column, low: int, high: int, buckets: int) -> Column:
    """Number of the equi-width bucket; values outside fall into the end ones."""
    raw = F.floor((F.greatest(value, F.lit(low)) - low) / F.lit(float(width_of(low, high, buckets))))
    return F.least(raw, F.lit(buckets - 1)).cast("int")


def histogram(df: DataFrame, column: str, low: int, high: int, buckets: int) -> DataFrame:
    """bucket, cnt of a column."""
    return df.groupBy(histogram_bucket(F.col(column), low, high, buckets).alias("bucket")).agg(F.count("*").alias("cnt"))


@dataclass
class Histogram:
    low: int
    high: int
    counts: list[int]

    @property
    def width(self) -> int:
        return width_of(self.low, self.high, len(self.counts))

    @property
    def total(self) -> int:
        return sum(self.counts)

    def _at(self, v: int) -> int:
        return min(max((v - self.low) // self.width, 0), len(self.counts) - 1)

    def point(self, v: int) -> float:
        """Share of rows equal to v, taking a bucket's values as even."""
        return self.counts[self._at(v)] / self.width / self.total if self.total else 0.0

    def between(self, a: int, b: int) -> float:
        """Share of rows from a to b, each bucket by its overlap; the last one ends at the highest value."""
        if not self.total or a > b:
            return 0.0
        part = 0.0
        for i, n in enumerate(self.counts):
            start = self.low + i * self.width
            end = min(start + self.width - 1, self.high)
            if start <= end:
                part += n * max(0, min(b, end) - max(a, start) + 1) / (end - start + 1)
        return min(1.0, part / self.total)


@dataclass
class TableStats:
    rows: int
    distinct: dict[str, int] = field(default_factory=dict)
    histograms: dict[str, Histogram] = field(default_factory=dict)

    def equal(self, column: str, value=None) -> float:
        """Selectivity of an equality: by the histogram of an INT column, else 1 / distinct."""
        h = self.histograms.get(column)
        if h is not None and isinstance(value, int) and not isinstance(value, bool):
            return h.point(value)
        return 1 / max(1, self.distinct.get(column, 1))

    def range(self, column: str, op: str, a, b=None) -> float:
        h = self.histograms.get(column)
        if h is None or not isinstance(a, int):
            return 0.3 if op == "between" else 0.5
        if op == "between":
            return h.between(a, b)
        return h.between(h.low, a - 1) if op == "<" else h.between(a + 1, h.high)


def collect(df: DataFrame, ints: list[str], others: list[str], buckets: int = 10) -> TableStats:
    """Statistics in two passes: counts, sketched distinct counts and ranges, then all histograms at once."""
    aggs = [F.count("*").alias("n")]
    for c in ints + others:
        aggs.append(F.approx_count_distinct(F.col(c), 0.02).alias(f"d_{c}"))
    for c in ints:
        aggs += [F.min(c).alias(f"l_{c}"), F.max(c).alias(f"h_{c}")]
    one = df.agg(*aggs).first().asDict()
    out = TableStats(one["n"], {c: one[f"d_{c}"] for c in ints + others})
    ranged = [c for c in ints if one[f"l_{c}"] is not None]
    if ranged:
        sums = [F.sum((histogram_bucket(F.col(c), one[f"l_{c}"], one[f"h_{c}"], buckets) == i).cast("long")).alias(f"{k}_{i}") for k, c in enumerate(ranged) for i in range(buckets)]
        got = df.agg(*sums).first().asDict()
        for k, c in enumerate(ranged):
            out.histograms[c] = Histogram(one[f"l_{c}"], one[f"h_{c}"], [got[f"{k}_{i}"] or 0 for i in range(buckets)])
    return out


def distinct_count(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.count_distinct(column).alias("ndv"), F.count("*").alias("row_count"))


def categorical_selectivity(df: DataFrame, column: str) -> DataFrame:
    return df.agg((F.lit(1.0) / F.count_distinct(column)).alias("selectivity"))
