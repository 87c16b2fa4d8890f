"""Compute derived columns once per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def pinned(df: DataFrame, cols: dict[str, Column]) -> DataFrame:
    """``withColumns`` for costly expressions that later filters and columns repeat.

    Catalyst copies a column's expression into every filter pushed below it; a
    deep chain (closest approach, local motion) then grows past what generated
    code can hold.  Exploding a one-element array gives the values a place of
    their own, inside whole-stage code and without a shuffle.
    """
    packed = F.array(F.struct(*[c.alias(n) for n, c in cols.items()]))
    kept = [c for c in df.columns if c not in cols]
    return df.select(*kept, F.inline(packed))
