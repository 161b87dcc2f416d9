"""Relational operators, each a DataFrame function; Catalyst plans them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A side is broadcast only if its estimated size is under this.
BROADCAST_BYTES = 64 << 20

COMPARE = {
    "=": lambda c, v: c == v,
    "<": lambda c, v: c < v,
    ">": lambda c, v: c > v,
    "<=": lambda c, v: c <= v,
    ">=": lambda c, v: c >= v,
}


def compare(column: str | Column, op: str, value, high=None, strict_bounds: bool = False) -> Column:
    """A comparison with a literal; op is =, <, >, <=, >= or between (both ends in).

    strict_bounds reads <= and >= as < and >, the documented quirk.
    """
    c = F.col(column) if isinstance(column, str) else column
    if op.lower() == "between":
        return c.between(value, high)
    if strict_bounds and op in ("<=", ">="):
        op = op[0]
    return COMPARE[op](c, value)


def where(df: DataFrame, *conditions: Column) -> DataFrame:
    """Rows that meet all conditions."""
    return df.filter(reduce(lambda a, b: a & b, conditions)) if conditions else df


def project(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*columns)


def sort(df: DataFrame, *columns: str) -> DataFrame:
    return df.sort(*columns)


def distinct(df: DataFrame, ordered: bool = False) -> DataFrame:
    """Rows once each; ordered also sorts by all columns."""
    out = df.distinct()
    return out.sort(*out.columns) if ordered else out


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of a relation's size."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def join(left: DataFrame, right: DataFrame, on: list[tuple[str, str]], prefer: str | None = None, names: tuple[str, str] | None = None) -> DataFrame:
    """Inner equi-join on pairs of (left column, right column).

    prefer="bnl" asks for the small side to be held whole: it is broadcast if
    its estimate is small enough, otherwise the planner decides; "merge" asks
    for a sort-merge join.  With names the output columns are
    <name>_<column>, left first, so that equal names do not meet.
    """
    left_names = {c: f"{names[0]}_{c}" if names else c for c in left.columns}
    right_names = {c: f"{names[1]}_{c}" if names else c for c in right.columns}
    a, b = left.withColumnsRenamed(left_names), right.withColumnsRenamed(right_names)
    if prefer == "merge":
        b = b.hint("merge")
    elif prefer == "bnl":
        size_a, size_b = estimated_bytes(a), estimated_bytes(b)
        if min(size_a, size_b) <= BROADCAST_BYTES:
            a, b = (a, F.broadcast(b)) if size_b <= size_a else (F.broadcast(a), b)
    elif prefer is not None:
        raise ValueError(f"no join method {prefer!r}")
    condition = reduce(lambda x, y: x & y, [a[left_names[x]] == b[right_names[y]] for x, y in on])
    return a.join(b, condition, "inner")


def self_join(df: DataFrame, on: str, columns: list[str], names: tuple[str, str]) -> DataFrame:
    """df with itself; the two sides' columns carry their names as prefixes."""
    side = df.select(on, *[c for c in columns if c != on])
    return join(side, side, [(on, on)], names=names)


def _same_shape(a: DataFrame, b: DataFrame) -> None:
    kinds = [[f.dataType for f in x.schema.fields] for x in (a, b)]
    if kinds[0] != kinds[1]:
        raise ValueError(f"set operation on different columns: {a.dtypes} and {b.dtypes}")


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of either side, once each."""
    _same_shape(a, b)
    return a.union(b).distinct()


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of both sides, once each."""
    _same_shape(a, b)
    return a.intersect(b)


def subtract(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of a that b lacks, once each."""
    _same_shape(a, b)
    return a.subtract(b)


def subtract_keeping(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of a that b lacks, as often as a has them (nulls are equal)."""
    _same_shape(a, b)
    other = b.toDF(*[f"__b{i}" for i in range(len(b.columns))])
    condition = reduce(lambda x, y: x & y, [F.col(f"`{c}`").eqNullSafe(F.col(f"__b{i}")) for i, c in enumerate(a.columns)])
    return a.join(other, condition, "left_anti")


def subtract_counting(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of a, less one for each equal row of b."""
    _same_shape(a, b)
    return a.exceptAll(b)


def write_sorted(df: DataFrame, table: str, column: str, buckets: int) -> DataFrame:
    """df as a table in buckets of a column, one sorted file each: joins of two
    such tables on their columns, with as many buckets, need no shuffle, and each
    task sorts rows that are in order already (Spark does not rely on it)."""
    df.repartition(buckets, column).write.bucketBy(buckets, column).sortBy(column).mode("overwrite").saveAsTable(table)
    return df.sparkSession.table(table)


def join_presorted(left: DataFrame, right: DataFrame, keys: list[tuple[str, str]]) -> DataFrame:
    """Merge join of two tables of write_sorted(), which are read in their buckets."""
    return join(left, right, keys, "merge")
