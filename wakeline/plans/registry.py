"""Registered queries: a Spark callable and, where SQL can say it, a checking SQL text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def tidy(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round doubles: JVM and C trigonometry may differ in the last bit."""
    doubles = [c for c, t in df.dtypes if t == "double"]
    return df.withColumns({c: F.round(c, digits) + 0.0 for c in doubles})


def query(name: str, sql: str | None = None, doubles: str = "", digits: int = 6):
    """Register ``fn(spark, sf_dir)``; ``doubles`` names the SQL columns to round."""

    def add(fn):
        def run(spark, sf_dir):
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return tidy(fn(spark, sf_dir), digits)

        run.__name__, run.__doc__ = fn.__name__, fn.__doc__
        QUERIES[name] = run
        if sql:
            rounded = ", ".join(f"round({c}, {digits}) + 0.0 AS {c}" for c in doubles.split())
            replace = f" REPLACE ({rounded})" if rounded else ""
            ORACLES[name] = f"SELECT *{replace} FROM (\n{sql}\n)"
        return fn

    return add
