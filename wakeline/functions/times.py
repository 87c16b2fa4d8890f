"""Time parts, cyclic encodings and calendar flags."""

from __future__ import annotations

from math import pi

from pyspark.sql import Column, functions as F


def epoch_us(time: Column) -> Column:
    return F.unix_micros(time)


def seconds_between(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later) - F.unix_micros(earlier)) / 1e6


def time_features(time: Column) -> dict[str, Column]:
    """Normalised and cyclic hour, weekday (Monday is 0) and month."""
    hour, day, month = F.hour(time), F.weekday(time), F.month(time)
    return {
        "hour_norm": hour / 24.0,
        "weekday_norm": day / 7.0,
        "month_norm": month / 12.0,
        "hour_sin": F.sin(hour * (2 * pi) / 24),
        "hour_cos": F.cos(hour * (2 * pi) / 24),
        "weekday_sin": F.sin(day * (2 * pi) / 7),
        "weekday_cos": F.cos(day * (2 * pi) / 7),
    }


def is_night(time: Column) -> Column:
    return (F.hour(time) < 6) | (F.hour(time) > 18)


def is_weekend(time: Column) -> Column:
    return F.weekday(time) >= 5


def parse_rxtime(text: Column) -> Column:
    """`yyyyMMddHHmmss` in UTC; NULL when any part is out of range."""
    shaped = F.when(text.rlike(r"^\d{14}$"), text)
    parts = F.concat_ws(
        " ",
        F.concat_ws("-", F.substring(shaped, 1, 4), F.substring(shaped, 5, 2), F.substring(shaped, 7, 2)),
        F.concat_ws(":", F.substring(shaped, 9, 2), F.substring(shaped, 11, 2), F.substring(shaped, 13, 2)),
    )
    return F.try_to_timestamp(F.when(shaped.isNotNull(), parts), F.lit("yyyy-MM-dd HH:mm:ss"))
