"""Bootstrap intervals, paired tests, effect sizes and corrections."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from math import comb, erfc, exp, lgamma, log, sqrt
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from wakeline.functions.pin import pinned
from wakeline.operators import quantiles as Q
from wakeline.session import saved

NORMAL = NormalDist()

# Upper ends of "negligible", "small" and "medium" effects.
COHEN = (0.2, 0.5, 0.8)
RANK_R = (0.1, 0.3, 0.5)
CLIFF = (0.147, 0.33, 0.474)


def effect_label(effect: Column, ends: Sequence[float]) -> Column:
    size = F.abs(effect)
    return (F.when(size < ends[0], "negligible").when(size < ends[1], "small")
            .when(size < ends[2], "medium").when(size.isNotNull(), "large"))


# ------------------------------------------------------------- tail probabilities

def _beta_share(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta_share(1 - x, b, a)
    tiny, f, c, d = 1e-300, 1.0, 1.0, 0.0
    for i in range(400):
        m = i // 2
        if i == 0:
            num = 1.0
        elif i % 2 == 0:
            num = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            num = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 + num * d
        d = 1 / (d if abs(d) > tiny else tiny)
        c = 1 + num / (c if abs(c) > tiny else tiny)
        f *= c * d
        if abs(1 - c * d) < 1e-14:
            break
    front = exp(a * log(x) + b * log(1 - x) + lgamma(a + b) - lgamma(a) - lgamma(b)) / a
    return front * (f - 1)


def student_p(t: float, df: float) -> float:
    """Two-sided Student probability."""
    return _beta_share(df / (df + t * t), df / 2, 0.5)


def normal_p(z: float) -> float:
    return erfc(abs(z) / sqrt(2))


def chi2_one_p(x: float) -> float:
    return erfc(sqrt(max(x, 0.0) / 2))


def binomial_half_cdf(k: int, n: int) -> float:
    return sum(comb(n, i) for i in range(k + 1)) / 2**n


def signed_rank_exact_p(w: float, n: int) -> float:
    """Two-sided exact probability of a signed-rank sum without ties."""
    ways = np.zeros(n * (n + 1) // 2 + 1)
    ways[0] = 1
    for r in range(1, n + 1):
        ways[r:] = ways[r:] + ways[:-r].copy()
    return min(1.0, 2 * ways[: int(w) + 1].sum() / 2.0**n)


def _per_row(fn: Callable, returns: str = "double"):
    """Vectorised column function for the few rows of a result table."""
    def call(*cols: Column) -> Column:
        @F.pandas_udf(returns)
        def run(*series: pd.Series) -> pd.Series:
            rows = zip(*series)
            return pd.Series([None if any(pd.isna(v) for v in r) else fn(*r) for r in rows], dtype="float64")
        return run(*cols)
    return call


# ------------------------------------------------------------- bootstrap

# Cumulative probabilities of a Poisson(1) count, times 2**32.
_POISSON = [int(p * 2**32) for p in np.cumsum([exp(-1.0 - lgamma(k + 1)) for k in range(10)])]
# Odd multipliers of a 32-bit integer mixer, and the replicate stride.
_MIX = (569420461, 1935289751)
_STRIDE = 2654435769


def poisson_weight(base: Column, replicate: Column) -> Column:
    """Poisson(1) draw of a row (its 32-bit ``base``) in one replicate."""
    x = (base + replicate * _STRIDE) % 2**32
    for shift, factor in ((16, _MIX[0]), (15, _MIX[1])):
        x = (x.bitwiseXOR(F.shiftright(x, shift)) * factor) % 2**32
    return x.bitwiseXOR(F.shiftright(x, 15))


def row_base(row: Column, seed: int) -> Column:
    """32 hash bits of the row key and the seed, computed once per row."""
    return F.conv(F.substring(F.md5(F.concat_ws("-", row.cast("string"), F.lit(str(seed)))), 1, 8), 16, 10).cast("long")


def _draws(df: DataFrame, keys: Sequence[str], value: str, row: str, n: int, seed: int) -> DataFrame:
    """(keys, replicate, x, w): each row weighs itself in every replicate by a hash."""
    slim = pinned(df.filter(F.col(value).isNotNull()).select(*keys, F.col(row).alias("_row"), F.col(value).cast("double").alias("_x")),
                  {"_base": row_base(F.col("_row"), seed)})
    drawn = slim.select(*keys, "_x", "_base", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("replicate"))
    drawn = pinned(drawn, {"_u": poisson_weight(F.col("_base"), F.col("replicate"))})
    weight = sum((F.col("_u") >= edge).cast("int") for edge in _POISSON[1:]) + (F.col("_u") >= _POISSON[0]).cast("int")
    return drawn.select(*keys, "_x", "replicate", weight.alias("w")).filter(F.col("w") > 0)


def weighted_mean(x: Column, w: Column) -> Column:
    return F.sum(w * x) / F.sum(w)


def replicates(df: DataFrame, keys: Sequence[str], value: str, row: str, n: int = 200, seed: int = 42,
               statistic: Callable[[Column, Column], Column] = weighted_mean) -> DataFrame:
    """Mean (or a user's weighted aggregate) of every bootstrap replicate per key.

    The draws are the same under any partitioning, and sums are combined before
    the shuffle: only (key, replicate) totals travel.
    """
    drawn = _draws(df, keys, value, row, n, seed)
    return drawn.groupBy(*keys, "replicate").agg(statistic(F.col("_x"), F.col("w")).alias("mean"))


def bootstrap_ci(df: DataFrame, keys: Sequence[str], value: str, row: str, n: int = 200, seed: int = 42,
                 confidence: float = 0.95, method: str = "percentile",
                 statistic: Callable[[Column, Column], Column] = weighted_mean) -> DataFrame:
    """Interval of the mean per key: percentile, basic or BCa.

    ``statistic`` may be any aggregate of (values, weights) columns; BCa is for
    the mean only and falls back to the percentile method otherwise.
    """
    if method not in ("percentile", "basic", "BCa"):
        raise ValueError(f"unknown method {method!r}")
    if statistic is not weighted_mean and method == "BCa":
        method = "percentile"
    alpha = (1 - confidence) / 2
    reps = replicates(df, keys, value, row, n, seed, statistic)
    mean = statistic is weighted_mean
    own = F.avg(value) if mean else statistic(F.col(value), F.when(F.col(value).isNotNull(), 1))
    observed = df.groupBy(*keys).agg(own.alias("value"), F.count(value).alias("n"))
    if method != "BCa":
        ends = reps.groupBy(*keys).agg(  # n numbers per key
            F.percentile("mean", F.lit(alpha)).alias("_a"), F.percentile("mean", F.lit(1 - alpha)).alias("_b"))
        out = observed.join(ends, list(keys)) if keys else Q.side_by_side(observed, ends)
        if method == "basic":
            return out.select(*keys, "value", "n", (2 * F.col("value") - F.col("_b")).alias("low"), (2 * F.col("value") - F.col("_a")).alias("high"))
        return out.select(*keys, "value", "n", F.col("_a").alias("low"), F.col("_b").alias("high"))
    return _bca(df, reps, observed, list(keys), value, alpha)


def _bca(df: DataFrame, reps: DataFrame, observed: DataFrame, keys: list[str], value: str, alpha: float) -> DataFrame:
    """Bias from the replicates below the mean, acceleration from leave-one-out means.

    For a mean those differ from it by (mean - x) / (n - 1), which leaves
    skewness / (6 sqrt(n)): no refits, no second pass over the rows.
    """
    own = keys or ["_all"]
    if not keys:
        df, reps, observed = (d.withColumn("_all", F.lit(0)) for d in (df, reps, observed))
    bend = df.groupBy(*own).agg((F.skewness(value) / (6 * F.sqrt(F.count(value)))).alias("_a"))
    below = reps.join(observed.select(*own, "value"), own).groupBy(*own).agg(
        F.avg((F.col("mean") < F.col("value")).cast("int")).alias("_share"),
        F.sort_array(F.collect_list("mean")).alias("_means"))  # one number per replicate
    out = observed.join(bend, own).join(below, own)

    def shifted(p):
        def level(share, a):
            if not 0 < share < 1:
                return p  # degenerate: plain percentile
            z, z0 = NORMAL.inv_cdf(p), NORMAL.inv_cdf(share)
            return NORMAL.cdf(z0 + (z0 + z) / (1 - a * (z0 + z)))
        return _per_row(level)(F.col("_share"), F.coalesce(F.nanvl("_a", F.lit(0.0)), F.lit(0.0)))

    def at(level):
        rank = level * (F.size("_means") - 1)
        low = F.element_at("_means", (F.floor(rank) + 1).cast("int"))
        high = F.element_at("_means", (F.ceil(rank) + 1).cast("int"))
        return low + (high - low) * (rank - F.floor(rank))

    out = out.withColumns({"_p": shifted(alpha), "_q": shifted(1 - alpha)})
    return out.select(*keys, "value", "n", at(F.col("_p")).alias("low"), at(F.col("_q")).alias("high"))


def bootstrap_difference(df: DataFrame, group: str, a, b, value: str, row: str, n: int = 200, seed: int = 42,
                         confidence: float = 0.95) -> DataFrame:
    """Interval of the difference of two groups' means."""
    alpha = (1 - confidence) / 2
    reps = replicates(df.filter(F.col(group).isin(a, b)), [group], value, row, n, seed)
    pick = lambda g: F.max(F.when(F.col(group) == g, F.col("mean")))
    gaps = reps.groupBy("replicate").agg((pick(a) - pick(b)).alias("gap"))
    mean = lambda g: F.avg(F.when(F.col(group) == g, F.col(value)))
    ends = gaps.agg(F.percentile("gap", F.lit(alpha)).alias("low"), F.percentile("gap", F.lit(1 - alpha)).alias("high"))
    return Q.side_by_side(df.agg((mean(a) - mean(b)).alias("difference")), ends)


def bootstrap_medians(df: DataFrame, group: str, a, b, value: str, row: str, n: int = 100, seed: int = 42,
                      confidence: float = 0.95) -> DataFrame:
    """Interval of the difference of two groups' medians (weighted exact medians)."""
    alpha = (1 - confidence) / 2
    rows = df.filter(F.col(group).isin(a, b) & F.col(value).isNotNull())
    drawn = _draws(rows, [group], value, row, n, seed)
    medians = Q.percentiles(drawn, [group, "replicate"], "_x", {"median": 0.5}, weight="w")
    pick = lambda g: F.max(F.when(F.col(group) == g, F.col("median")))
    gaps = medians.groupBy("replicate").agg((pick(a) - pick(b)).alias("gap"))
    own = Q.percentiles(rows, [group], value, {"median": 0.5}).agg((pick(a) - pick(b)).alias("difference"))
    ends = gaps.agg(F.percentile("gap", F.lit(alpha)).alias("low"), F.percentile("gap", F.lit(1 - alpha)).alias("high"))
    return Q.side_by_side(own, ends)


# ------------------------------------------------------------- paired tests

def paired_t(df: DataFrame, a: str, b: str, keys: Sequence[str] = (), alpha: float = 0.05) -> DataFrame:
    """t, p, degrees of freedom and Cohen's d per key; no difference at all gives t 0, p 1."""
    d = F.col(a) - F.col(b)
    s = df.groupBy(*keys).agg(F.avg(d).alias("mean_difference"), F.stddev_samp(d).alias("_sd"),
                              F.count(d).alias("n"), F.max(F.abs(d)).alias("_most"))
    spread = F.nullif(F.col("_sd"), F.lit(0.0))
    t = F.when(F.col("_most") == 0, 0.0).otherwise(F.col("mean_difference") / (spread / F.sqrt("n")))
    out = s.withColumns({"t": t, "df": F.col("n") - 1, "effect": F.coalesce(F.col("mean_difference") / spread, F.lit(0.0))})
    p = F.when(F.col("_most") == 0, 1.0).otherwise(_per_row(student_p)(F.col("t"), F.col("df")))
    out = out.withColumns({"p": p, "effect_label": effect_label(F.col("effect"), COHEN)})
    return out.withColumn("significant", F.col("p") < alpha).drop("_sd", "_most")


def wilcoxon(df: DataFrame, a: str, b: str, keys: Sequence[str] = (), alpha: float = 0.05) -> DataFrame:
    """Signed-rank test: zeros dropped, tied sizes share their average rank.

    Sizes are counted first; ranks come from running counts, not from sorting
    all rows in one task.  Exact probability up to 50 untied pairs, normal
    approximation with tie correction beyond.
    """
    d = F.col(a) - F.col(b)
    all_pairs = df.groupBy(*keys).agg(F.count(d).alias("pairs"))
    sizes = df.filter(d != 0).groupBy(*keys, F.abs(d).alias("_v")).agg(
        F.count("*").alias("_n"), F.count_if(d > 0).alias("_up"))
    ranked = Q.with_running_counts(sizes, "_v", ["_n"], keys)
    rank = F.col("_before_n") + (F.col("_n") + 1) / 2
    s = ranked.groupBy(*keys).agg(
        F.sum(rank * F.col("_up")).alias("w_plus"), F.sum(rank * (F.col("_n") - F.col("_up"))).alias("w_minus"),
        F.sum("_n").alias("n"), F.sum(F.col("_n") * F.col("_n") * F.col("_n") - F.col("_n")).alias("_ties"))
    s = all_pairs.join(s, list(keys), "left") if keys else Q.side_by_side(all_pairs, s)
    w, n = F.least("w_plus", "w_minus"), F.col("n")
    z = (w - n * (n + 1) / 4) / F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("_ties") / 48)
    m = F.col("pairs").cast("double")
    r = F.when(m > 20, F.abs(w - m * (m + 1) / 4) / F.sqrt(m * (m + 1) * (2 * m + 1) / 24) / F.sqrt(m))
    s = s.withColumns({"w": w, "z": z, "effect": r})
    exact = (n <= 50) & (F.col("_ties") == 0) & (n == F.col("pairs"))
    p = F.when(exact, _per_row(lambda w, n: signed_rank_exact_p(w, int(n)))(
        F.when(exact, F.col("w")), F.when(exact, n))).otherwise(_per_row(normal_p)(F.col("z")))
    s = s.withColumns({"p": p, "effect_label": effect_label(F.col("effect"), RANK_R)})
    return s.withColumn("significant", F.col("p") < alpha).drop("_ties")


def cliffs_delta(df: DataFrame, group: str, a, b, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """(pairs with a above b - below) / all pairs, from counts per value, not from pairs."""
    counts = df.filter(F.col(group).isin(a, b) & F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v")).agg(
        F.count_if(F.col(group) == a).alias("_a"), F.count_if(F.col(group) == b).alias("_b"))
    run = Q.with_running_counts(counts, "_v", ["_a", "_b"], keys)
    s = run.groupBy(*keys).agg(
        F.sum(F.col("_a") * F.col("_before_b") - F.col("_b") * F.col("_before_a")).alias("dominance"),
        F.sum("_a").alias("n1"), F.sum("_b").alias("n2"))
    s = s.withColumn("delta", F.col("dominance") / (F.col("n1").cast("double") * F.col("n2")))
    return s.withColumn("effect_label", effect_label(F.col("delta"), CLIFF))


def mcnemar(df: DataFrame, right_1: str, right_2: str, alpha: float = 0.05) -> DataFrame:
    """Discordant pairs of two classifiers; exact below 25, else chi-square with correction."""
    one, two = F.col(right_1), F.col(right_2)
    s = df.agg(F.count_if(one & ~two).alias("b"), F.count_if(~one & two).alias("c"),
               F.count_if(one & two).alias("both"), F.count_if(~one & ~two).alias("neither"))
    b, c = F.col("b"), F.col("c")
    exact = b + c < 25
    stat = F.when(exact, F.least(b, c).cast("double")).otherwise(F.pow(F.abs(b - c) - 1, F.lit(2)) / F.nullif(b + c, F.lit(0)))
    s = s.withColumns({"test": F.when(exact, "exact").otherwise("chi-square"), "statistic": stat})

    def p_value(stat, b, c):
        if b + c < 25:
            return min(1.0, 2 * binomial_half_cdf(int(stat), int(b + c)))
        return chi2_one_p(stat)

    s = s.withColumn("p", _per_row(p_value)(F.col("statistic"), b, c))
    return s.withColumn("significant", F.col("p") < alpha)


# ------------------------------------------------------------- corrections

EULER = 0.5772156649015329
METHODS = ("bonferroni", "sidak", "holm", "holm-sidak", "simes-hochberg", "fdr_bh", "fdr_by")


def corrected(df: DataFrame, method: str = "holm", family: str = "family", p: str = "p", test: str = "test_id",
              alpha: float = 0.05) -> DataFrame:
    """Corrected p-values per family (one row per hypothesis test); tests without p aren't counted.

    Ranks and running extremes come from bins of the distinct p-values, so no
    family is sorted in one task.
    """
    if method not in METHODS:
        raise ValueError(f"method must be one of {METHODS}")
    # equal p-values get equal results, so each is one row with the places its tests take
    sizes = df.filter(F.col(p).isNotNull()).groupBy(F.col(family).alias("_f"), F.col(p).alias("_p")).agg(F.count("*").alias("_n"))
    sizes = saved(sizes, "sizes")
    totals = sizes.groupBy("_f").agg(F.sum("_n").alias("_m"))
    if method == "fdr_by":
        few = F.aggregate(F.sequence(F.lit(1).cast("long"), F.least("_m", F.lit(1000))), F.lit(0.0), lambda a, k: a + F.lit(1.0) / k)
        m = F.col("_m").cast("double")
        series = F.log(m) + EULER + 1 / (2 * m) - 1 / (12 * m * m)  # exact to a double from 1,000 on
        totals = totals.withColumn("_harmonic", F.when(F.col("_m") <= 1000, few).otherwise(series))
    ranked = saved(Q.with_running_counts(sizes, "_p", ["_n"], ["_f"]).join(totals, "_f"), "ranked")
    x, n = F.col("_p"), F.col("_m")
    first, last = F.col("_before_n") + 1, F.col("_before_n") + F.col("_n")
    plain = {"bonferroni": x * n, "sidak": 1 - F.pow(1 - x, n)}
    upward = {"holm": x * (n - first + 1), "holm-sidak": 1 - F.pow(1 - x, n - first + 1)}
    downward = {"simes-hochberg": x * (n - last + 1), "fdr_bh": x * n / last, "fdr_by": x * n * F.col("_harmonic") / last if method == "fdr_by" else x}
    if method in plain:
        values = ranked.withColumn("corrected", plain[method])
    elif method in upward:
        values = Q.with_extreme_so_far(ranked.withColumn("_v", upward[method]), "_p", "_v", ["_f"], "corrected")
    else:
        values = Q.with_extreme_so_far(ranked.withColumn("_v", downward[method]), "_p", "_v", ["_f"], "corrected", falling=True)
    values = values.select("_f", "_p", F.least("corrected", F.lit(1.0)).alias("corrected"))
    same = df[family].eqNullSafe(F.col("_f")) & (df[p] == F.col("_p"))
    out = df.join(values, same, "left").drop("_f", "_p")
    return out.withColumn("significant", F.col("corrected") <= alpha)


# ------------------------------------------------------------- model comparison

def model_summary(scores: DataFrame, row: str | None = None, n: int = 200, seed: int = 42) -> DataFrame:
    """Mean, sample deviation, folds, interval and best flag per (metric, model); lowest is best."""
    base = scores.groupBy("metric", "model").agg(F.avg("score").alias("mean"), F.stddev_samp("score").alias("std"), F.count("*").alias("n"))
    key = F.concat_ws("-", "model", "fold") if row is None else F.col(row)
    ci = bootstrap_ci(scores.withColumn("_key", key), ["metric", "model"], "score", "_key", n, seed).select("metric", "model", "low", "high")
    best = base.groupBy("metric").agg(F.min_by("model", F.struct("mean", "model")).alias("best"))
    return base.join(ci, ["metric", "model"]).join(best, "metric").withColumn("best", F.col("best") == F.col("model"))


def compare_models(scores: DataFrame, method: str = "holm", alpha: float = 0.05) -> DataFrame:
    """All model pairs per metric: paired t (Wilcoxon below 20 folds), Cliff's delta, corrected p."""
    a = scores.select("metric", "fold", F.col("model").alias("model_a"), F.col("score").alias("a"))
    b = scores.select("metric", "fold", F.col("model").alias("model_b"), F.col("score").alias("b"))
    pairs = a.join(b, ["metric", "fold"]).filter(F.col("model_a") < F.col("model_b"))
    keys = ["metric", "model_a", "model_b"]
    t = paired_t(pairs, "a", "b", keys).select(*keys, "n", "mean_difference", "t", F.col("p").alias("t_p"))
    w = wilcoxon(pairs, "a", "b", keys).select(*keys, "w", F.col("p").alias("w_p"))
    long = pairs.select(*keys, F.explode(F.array(F.struct(F.lit("a").alias("g"), F.col("a").alias("s")),
                                                  F.struct(F.lit("b").alias("g"), F.col("b").alias("s")))).alias("x")).select(*keys, "x.*")
    delta = cliffs_delta(long, "g", "a", "b", "s", keys).select(*keys, "delta")
    out = t.join(w, keys, "left").join(delta, keys, "left")
    out = out.withColumn("p", F.when(F.col("n") < 20, F.col("w_p")).otherwise(F.col("t_p")))
    return corrected(out.withColumn("test_id", F.concat_ws("-", *keys)), method, "metric", alpha=alpha).drop("test_id")
