"""Exact ranks and percentiles without holding a group in one task.

The built-in exact percentile keeps every distinct value of a group in memory.
Here values are counted first, counts are summed per value bin, and values are
ordered only inside their bin (for percentiles: only in the bins that hold a
wanted rank).
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from wakeline.session import saved

BINS = 128
_ALL = "_all"


def side_by_side(*one_row: DataFrame) -> DataFrame:
    """Join single-row results into one row."""
    keyed = [d.withColumn("_k", F.lit(0)) for d in one_row]
    return reduce(lambda a, b: a.join(b, "_k"), keyed).drop("_k")


def _with_bins(counts: DataFrame, value: str, keys: Sequence[str]) -> DataFrame:
    """A bin of each row, between borders that share out the key's distinct values.

    The borders are approximate percentiles, so a value far from the others takes a
    bin of its own instead of all bins; they steer the work and not the result.
    """
    number = F.col(value).cast("double")
    shares = F.array(*[F.lit(i / BINS) for i in range(1, BINS)])
    spans = counts.groupBy(*keys).agg(F.percentile_approx(number, shares, F.lit(20 * BINS)).alias("_borders"))
    # how many borders the value reaches, by halving steps
    steps = F.array(*[F.lit(BINS >> i) for i in range(1, BINS.bit_length())])
    bin_ = F.aggregate(steps, F.lit(0), lambda low, step: low + F.when(F.get("_borders", low + step - 1) <= number, step).otherwise(0))
    return counts.join(spans, list(keys)).withColumn("_bin", bin_).drop("_borders")


def with_running_counts(counts: DataFrame, value: str, cols: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """For each distinct value add ``_before<col>``: the sum of ``col`` over smaller values."""
    own = list(keys) or [_ALL]
    binned = _with_bins(counts if keys else counts.withColumn(_ALL, F.lit(0)), value, own)
    ahead = Window.partitionBy(*own).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = binned.groupBy(*own, "_bin").agg(*[F.sum(c).alias(f"_in{c}") for c in cols])
    bins = bins.select(*own, "_bin", *[F.coalesce(F.sum(f"_in{c}").over(ahead), F.lit(0)).alias(f"_pre{c}") for c in cols])
    inside = Window.partitionBy(*own, "_bin").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    out = binned.join(bins, [*own, "_bin"]).withColumns(
        {f"_before{c}": F.col(f"_pre{c}") + F.coalesce(F.sum(c).over(inside), F.lit(0)) for c in cols})
    return out.drop("_bin", _ALL, *[f"_pre{c}" for c in cols])


def with_extreme_so_far(rows: DataFrame, order: str, value: str, keys: Sequence[str], out: str, falling: bool = False) -> DataFrame:
    """Largest ``value`` up to each row in ascending ``order``, or smallest from each row on if ``falling``."""
    binned = _with_bins(rows, order, keys)
    best, pick = (F.min, F.least) if falling else (F.max, F.greatest)
    by = (lambda c: F.col(c).desc()) if falling else F.col
    ahead = Window.partitionBy(*keys).orderBy(by("_bin")).rowsBetween(Window.unboundedPreceding, -1)
    bins = binned.groupBy(*keys, "_bin").agg(best(value).alias("_own")).withColumn("_ahead", best("_own").over(ahead)).drop("_own")
    inside = Window.partitionBy(*keys, "_bin").orderBy(by(order)).rowsBetween(Window.unboundedPreceding, 0)
    # least and greatest skip NULL, which the first bin has
    return binned.join(bins, [*keys, "_bin"]).withColumn(out, pick(best(value).over(inside), F.col("_ahead"))).drop("_bin", "_ahead")


def _octave_bin(value: str) -> Column:
    """Number of a double's bin in ascending order, BINS of them between two powers of two."""
    v = F.col(value).cast("double")
    place = F.floor(F.least(F.log2(F.abs(v)) * BINS, F.lit(1e6))) + 2000 * BINS
    return F.when(v == 0, 0).when(F.isnan(v), 1 << 41).when(v < 0, -place).otherwise(place).cast("long")


def percentiles(df: DataFrame, keys: Sequence[str], value: str, wanted: dict[str, float],
                weight: str | None = None, again: bool = False) -> DataFrame:
    """Linearly interpolated percentiles of ``value`` per key, one column each.

    ``wanted`` maps column names to shares in [0, 1]; NULL values are ignored;
    ``weight`` counts a row several times.  ``again``: for few keys and more values
    than should be stored, ``df`` is computed twice, once to count the values of each
    bin and once for those of the bins that hold a wanted rank.
    """
    own = list(keys) or [_ALL]
    base = df if keys else df.withColumn(_ALL, F.lit(0))
    n = F.count("*") if weight is None else F.sum(weight)
    if again:
        weights = [] if weight is None else [weight]
        binned = base.select(*own, F.col(value).alias("_v"), *weights).filter(F.col("_v").isNotNull()).withColumn("_bin", _octave_bin("_v"))
        inside_bins = binned.groupBy(*own, "_bin").agg(n.alias("_in"))
    else:
        counts = base.filter(F.col(value).isNotNull()).groupBy(*own, F.col(value).alias("_v")).agg(n.alias("_n"))
        binned = _with_bins(counts, "_v", own)
        inside_bins = binned.groupBy(*own, "_bin").agg(F.sum("_n").alias("_in"))
    ahead = Window.partitionBy(*own).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = inside_bins.withColumns({
        "_ahead": F.coalesce(F.sum("_in").over(ahead), F.lit(0)), "_total": F.sum("_in").over(Window.partitionBy(*own))})
    ranks = F.array(*[F.struct(F.lit(i).alias("i"), (F.lit(float(p)) * (F.col("_total") - 1)).alias("rank"))
                      for i, p in enumerate(wanted.values())])
    hit = lambda r, n: (F.floor(r["rank"]) < F.col("_ahead") + F.col(n)) & (F.ceil(r["rank"]) >= F.col("_ahead"))
    bins = bins.withColumn("_ranks", F.filter(ranks, lambda r: hit(r, "_in"))).filter(F.size("_ranks") > 0)
    inside = Window.partitionBy(*own, "_bin").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.select(*own, "_bin", "_ahead", "_ranks")
    if again:
        # at most two bins for each key and wanted rank; the rows must not cross a shuffle to meet them
        few = saved(bins, "bins")
        binned = binned.join(F.broadcast(few.select(*own, "_bin")), [*own, "_bin"]).groupBy(*own, "_bin", "_v").agg(n.alias("_n"))
        bins = few
    near = binned.join(bins, [*own, "_bin"])
    near = near.withColumn("_ahead", F.col("_ahead") + F.coalesce(F.sum("_n").over(inside), F.lit(0)))
    rows = near.select(*own, "_v", "_n", "_ahead", F.inline(F.filter("_ranks", lambda r: hit(r, "_n"))))
    holds = lambda at: (at >= F.col("_ahead")) & (at < F.col("_ahead") + F.col("_n"))
    ends = rows.groupBy(*own, "i").agg(
        F.max(F.when(holds(F.floor("rank")), F.col("_v"))).alias("a"),
        F.max(F.when(holds(F.ceil("rank")), F.col("_v"))).alias("b"), F.first("rank").alias("rank"))
    value_at = F.col("a") + (F.col("b") - F.col("a")) * (F.col("rank") - F.floor("rank"))
    out = ends.groupBy(*own).agg(*[F.max(F.when(F.col("i") == i, value_at)).alias(c) for i, c in enumerate(wanted)])
    return out.drop(_ALL)
