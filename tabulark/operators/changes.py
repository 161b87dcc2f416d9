"""Insert, update and delete as functions from rows to rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def inserted(df: DataFrame, rows: DataFrame) -> DataFrame:
    """df and the new rows, matched by position and cast to df's types."""
    if len(rows.columns) != len(df.columns):
        raise ValueError(f"{len(rows.columns)} values for {len(df.columns)} columns")
    return df.union(rows.select(*[F.col(r).cast(f.dataType).alias(f.name) for r, f in zip(rows.columns, df.schema.fields)]))


def _sure(condition: Column | None) -> Column:
    """True only where the condition is; unknown counts as no."""
    return F.lit(True) if condition is None else F.coalesce(condition, F.lit(False))


def updated(df: DataFrame, changes: dict[str, Column], condition: Column | None = None) -> DataFrame:
    """df with changes where the condition is true; all read the old row."""
    known = {c.lower(): c for c in df.columns}
    for name in changes:
        if name.lower() not in known:
            raise ValueError(f"no column {name}")
    new = {known[k.lower()]: v for k, v in changes.items()}
    hit = _sure(condition)
    kinds = {f.name: f.dataType for f in df.schema.fields}
    return df.select(*[F.when(hit, new[c].cast(kinds[c])).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in df.columns])


def deleted(df: DataFrame, condition: Column | None = None) -> DataFrame:
    """The rows that stay: those for which the condition is false or unknown."""
    return df.filter(~_sure(condition))


def matching(df: DataFrame, condition: Column | None = None) -> DataFrame:
    """The rows that an update or delete would touch."""
    return df.filter(_sure(condition))
