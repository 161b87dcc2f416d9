"""A query builder: conditions, a join, distinct and join hints."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame

from ..operators import relational as R


@dataclass(frozen=True)
class Query:
    """Built step by step; each step gives a new Query, build() the DataFrame."""

    left: DataFrame
    left_name: str = "left"
    right: DataFrame | None = None
    right_name: str = "right"
    on_pairs: tuple[tuple[str, str], ...] = ()
    left_where: tuple[Column, ...] = ()
    right_where: tuple[Column, ...] = ()
    unique: bool = False
    hint: str | None = None

    def where(self, *conditions: Column) -> Query:
        return replace(self, left_where=self.left_where + conditions)

    where_left = where

    def where_right(self, *conditions: Column) -> Query:
        return replace(self, right_where=self.right_where + conditions)

    def join(self, other: DataFrame, name: str = "right") -> Query:
        return replace(self, right=other, right_name=name)

    def on(self, left: str, right: str) -> Query:
        return replace(self, on_pairs=(*self.on_pairs, (left, right)))

    def distinct(self) -> Query:
        return replace(self, unique=True)

    def prefer(self, method: str) -> Query:
        """bnl or merge."""
        return replace(self, hint=method)

    def build(self) -> DataFrame:
        out = R.where(self.left, *self.left_where)
        if self.right is not None:
            if not self.on_pairs:
                raise ValueError("a join needs an equality of columns")
            out = R.join(out, R.where(self.right, *self.right_where), list(self.on_pairs), self.hint, (self.left_name, self.right_name))
        return R.distinct(out, ordered=self.right is not None) if self.unique else out
