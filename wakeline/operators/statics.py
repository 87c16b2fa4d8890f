"""Static and voyage data: latest values, type 24 parts, enrichment."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

VOYAGE = ("name", "call_sign", "imo", "ship_type", "to_bow", "to_stern", "to_port", "to_starboard", "draught")


def _latest(col: str, rows: Column | None = None) -> Column:
    known = F.col(col).isNotNull() if rows is None else F.col(col).isNotNull() & rows
    return F.max_by(col, F.when(known, F.struct("time", "event_id")))


def latest_static(static: DataFrame, cols: Sequence[str] = VOYAGE) -> DataFrame:
    """Last known value of every column per vessel."""
    return static.groupBy("mmsi").agg(*[_latest(c).alias(c) for c in cols])


def merged_parts(static: DataFrame) -> DataFrame:
    """Latest type 24 part A (name) and part B (call sign, type, size) side by side.

    A vessel with only one of the parts keeps NULLs for the other, as a full
    outer join would give, but with one aggregation.
    """
    a, b = F.col("partno") == 0, F.col("partno") == 1
    part_b = ("call_sign", "ship_type", "to_bow", "to_stern", "to_port", "to_starboard")
    return static.filter(F.col("msg_type") == 24).groupBy("mmsi").agg(
        _latest("name", a).alias("name"), *[_latest(c, b).alias(c) for c in part_b])


def merged_static(static: DataFrame) -> DataFrame:
    """One row per vessel; type 5 wins over type 24, column by column."""
    five, parts = F.col("msg_type") == 5, F.col("msg_type") == 24
    merged = static.groupBy("mmsi").agg(*[
        F.coalesce(_latest(c, five), _latest(c, parts)).alias(c) for c in VOYAGE])
    size = lambda x, y: F.coalesce(F.col(x), F.lit(0)) + F.coalesce(F.col(y), F.lit(0))
    return merged.withColumns({"length": size("to_bow", "to_stern"), "width": size("to_port", "to_starboard")})


def enrich(df: DataFrame, static: DataFrame) -> DataFrame:
    """Left join on mmsi that adds only columns the frame lacks.

    No broadcast hint: adaptive execution broadcasts the static side when its
    measured size allows and otherwise splits a skewed vessel.
    """
    new = [c for c in static.columns if c not in df.columns]
    return df.join(static.select("mmsi", *new), "mmsi", "left")
