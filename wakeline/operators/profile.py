"""Dataset profiles: summaries, distributions, histograms, correlations, warnings."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame, Window, functions as F

from wakeline.functions import codes, times
from wakeline.operators import quantiles as Q

# Message type descriptions.
TYPE_NAMES = {
    1: "Position Report Class A (Scheduled)",
    2: "Position Report Class A (Assigned)",
    3: "Position Report Class A (Response)",
    4: "Base Station Report",
    5: "Static and Voyage Related Data",
    18: "Standard Class B Position Report",
    19: "Extended Class B Position Report",
    21: "Aid-to-Navigation Report",
    24: "Static Data Report",
}


def dataset_summary(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count("*").alias("messages"), F.count_distinct("mmsi").alias("vessels"),
        F.min("time").alias("first_time"), F.max("time").alias("last_time"),
        (times.seconds_between(F.max("time"), F.min("time")) / 86400).alias("duration_days"),
        F.min("lat").alias("min_lat"), F.max("lat").alias("max_lat"),
        F.min("lon").alias("min_lon"), F.max("lon").alias("max_lon"),
        F.array_join(F.sort_array(F.collect_set("msg_type")), ",").alias("msg_types"))


def _long(df: DataFrame, cols: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    return df.select(*keep, *[F.col(c).cast("double").alias(c) for c in cols]).unpivot(
        list(keep), list(cols), "feature", "value")


def kinematic_statistics(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Count, moments, extremes, quartiles and valid share per column, in one long pass."""
    long = _long(df, cols)
    moments = long.groupBy("feature").agg(
        F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"),
        (100.0 * F.count("value") / F.count("*")).alias("valid_percent"))
    quartiles = Q.percentiles(long, ["feature"], "value", {"q25": 0.25, "median": 0.5, "q75": 0.75})
    return moments.join(quartiles, "feature", "left")


def type_distribution(df: DataFrame) -> DataFrame:
    counts = df.groupBy("msg_type").agg(F.count("*").alias("n"))
    share = 100.0 * F.col("n") / F.sum("n").over(Window.partitionBy())  # one row per message type
    return counts.select("msg_type", "n", F.round(share, 2).alias("percent"),
                         codes.lookup(F.col("msg_type"), TYPE_NAMES, F.lit("Unknown")).alias("description"))


def static_completeness(static: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Vessels with a known value per static field, and their share."""
    one = static.groupBy("mmsi").agg(*[F.max(F.col(c).isNotNull()).alias(c) for c in cols]).agg(
        F.count("*").alias("vessels"), *[F.count_if(c).alias(c) for c in cols])
    return one.unpivot(["vessels"], list(cols), "field", "known").select(
        "field", "known", (100.0 * F.col("known") / F.col("vessels")).alias("percent"))


def funnel(df: DataFrame, gates: dict[str, Column]) -> DataFrame:
    """Rows left after each gate, gates applied one after another, in one pass."""
    passed, left = F.lit(True), {}
    for name, gate in gates.items():
        passed = passed & F.coalesce(gate, F.lit(False))
        left[name] = passed
    one = df.agg(F.count("*").alias("raw"), *[F.count_if(c).alias(n) for n, c in left.items()])
    stages = F.array(*[F.struct(F.lit(i).alias("stage"), F.lit(n).alias("gate"), F.col(n).alias("n"))
                       for i, n in enumerate(["raw", *left])])
    return one.select("raw", F.inline(stages)).select("stage", "gate", "n", (100.0 * F.col("n") / F.col("raw")).alias("percent"))


def hourly_activity(df: DataFrame) -> DataFrame:
    return df.groupBy(F.hour("time").alias("hour")).agg(F.count("*").alias("n"), F.avg("sog").alias("mean_sog"))


def weekday_activity(df: DataFrame) -> DataFrame:
    return df.groupBy(F.date_format("time", "EEEE").alias("day")).agg(F.count("*").alias("n"))


def hour_type_matrix(df: DataFrame, types: Sequence[int]) -> DataFrame:
    """Rows per hour (rows) and ship type (columns), zeros filled in."""
    wide = df.groupBy(F.hour("time").alias("hour")).pivot("ship_type", list(types)).count().na.fill(0)
    return wide.withColumnsRenamed({str(t): f"type_{t}" for t in types})


def histogram(df: DataFrame, col: str, bins: int, low: float | None = None, high: float | None = None) -> DataFrame:
    """Counts in equal bins; the range defaults to the column's, the last bin is closed."""
    if low is None or high is None:
        span = df.agg(F.min(col).alias("lo"), F.max(col).alias("hi")).first()
        low = span["lo"] if low is None else low
        high = span["hi"] if high is None else high
    if low is None:
        low, high = 0.0, 1.0
    width = (high - low) / bins or 1.0
    index = F.least(F.floor((F.col(col) - low) / width), F.lit(bins - 1)).cast("int")
    kept = df.filter(F.col(col).between(low, high))
    return kept.groupBy(index.alias("bin")).agg(F.count("*").alias("n")).withColumn("left", F.lit(low) + F.col("bin") * width)


def trimmed_histogram(df: DataFrame, col: str, bins: int = 50, share: float = 0.01) -> DataFrame:
    """Histogram between two percentiles (driver row with two numbers)."""
    ends = Q.percentiles(df, [], col, {"lo": share, "hi": 1 - share}).first()
    return histogram(df, col, bins, ends["lo"], ends["hi"])


def correlations(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Pearson correlation of every pair of columns, one aggregation."""
    pairs = list(combinations_with_replacement(cols, 2))
    one = df.agg(*[F.corr(a, b).alias(f"{a}~{b}") for a, b in pairs])
    both = [F.struct(F.lit(x).alias("a"), F.lit(y).alias("b"), F.col(f"{a}~{b}").alias("corr"))
            for a, b in pairs for x, y in {(a, b), (b, a)}]
    return one.select(F.inline(F.array(*both)))


def cube_statistics(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Extent of the (time x vessel) grid and how full it is per column."""
    one = df.agg(
        F.count_distinct("mmsi").alias("vessels"), F.count_distinct("time").alias("timestamps"),
        F.min("lat").alias("min_lat"), F.max("lat").alias("max_lat"), F.min("lon").alias("min_lon"),
        F.max("lon").alias("max_lon"), *[F.count(c).alias(f"n_{c}") for c in cols])
    cells = F.col("vessels") * F.col("timestamps")
    return one.withColumns({f"complete_{c}": F.col(f"n_{c}") / F.nullif(cells, F.lit(0)) for c in cols}).drop(*[f"n_{c}" for c in cols])


def column_profile(df: DataFrame, threshold: int = 1000) -> DataFrame:
    """Type, distinct count and, up to the threshold, the values of every column."""
    kinds = dict(df.dtypes)
    text = df.select(*[F.col(c).cast("string").alias(c) for c in df.columns]).unpivot([], df.columns, "column", "value")
    values = text.groupBy("column", "value").agg(F.count("*").alias("n"))
    sizes = values.groupBy("column").agg(F.count("value").alias("distinct"))
    few = sizes.filter(F.col("distinct") <= threshold)
    lists = values.join(few.select("column"), "column", "left_semi").groupBy("column").agg(
        F.sort_array(F.collect_list("value")).alias("values"))
    kind = codes.lookup(F.col("column"), kinds)
    return sizes.join(lists, "column", "left").select("column", kind.alias("type"), "distinct", "values")


# ------------------------------------------------------------- warnings

def warning_times(events: DataFrame, severity: str | None = None) -> DataFrame:
    """Distribution of the lead time in minutes."""
    if severity is not None:
        events = events.filter(F.col("severity") == severity)
    t = "warning_time"
    moments = events.agg(F.avg(t).alias("mean"), F.stddev_pop(t).alias("std"), F.min(t).alias("min"),
                         F.max(t).alias("max"), F.count("*").alias("n"))
    shares = {"median": 0.5, "p10": 0.1, "p25": 0.25, "p75": 0.75, "p90": 0.9}
    return Q.side_by_side(moments, Q.percentiles(events, [], t, shares, again=True))


def false_alerts(events: DataFrame, hours: float = 24.0) -> DataFrame:
    """Overall and per-severity false alert rates (severity `all` is the total)."""
    wrong = F.count_if("false_positive")
    rolled = events.rollup("severity").agg(F.count("*").alias("total"), wrong.alias("false_positives"), F.grouping("severity").alias("g"))
    return rolled.select(
        F.when(F.col("g") == 1, "all").otherwise(F.col("severity")).alias("severity"), "total", "false_positives",
        (F.col("total") - F.col("false_positives")).alias("true_positives"),
        (F.col("false_positives") / F.col("total")).alias("rate"), (F.col("false_positives") / hours).alias("false_per_hour"))


def traffic_coverage(vessels: DataFrame) -> DataFrame:
    """Handled share in total and by vessel type (`all` is the total)."""
    rolled = vessels.rollup("vessel_type").agg(
        F.count("*").alias("total"), F.count_if("handled").alias("handled"), F.grouping("vessel_type").alias("g"))
    return rolled.select(F.when(F.col("g") == 1, "all").otherwise(F.col("vessel_type")).alias("vessel_type"),
                         "total", "handled", (100.0 * F.col("handled") / F.col("total")).alias("percent"))


def unhandled_reasons(vessels: DataFrame) -> DataFrame:
    return vessels.filter(~F.col("handled")).groupBy("reason").agg(F.count("*").alias("n"))


def warning_patterns(events: DataFrame, hours: int = 1) -> DataFrame:
    """Warnings per time bin: count, false rate, lead time and critical rate, 3 digits."""
    binned = events.withColumn("time_bin", F.window("time", f"{hours} hours")["start"])
    stats = binned.groupBy("time_bin").agg(
        F.count("*").alias("warning_count"), F.avg(F.col("false_positive").cast("int")).alias("false_positive_rate"),
        F.avg("warning_time").alias("mean_warning_time"), F.stddev_samp("warning_time").alias("std_warning_time"),
        F.avg((F.col("severity") == "critical").cast("int")).alias("critical_rate"))
    median = Q.percentiles(binned, ["time_bin"], "warning_time", {"median_warning_time": 0.5}, again=True)
    out = stats.join(median, "time_bin", "left")
    return out.withColumns({c: F.round(c, 3) for c, t in out.dtypes if t == "double"})


