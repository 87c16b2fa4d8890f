"""Scoring forecasts, classifiers and anomaly detectors.

Forecast rows are long: ``sample_id, step, pred_*, true_*``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from wakeline.functions import geo
from wakeline.functions.pin import pinned
from wakeline.operators import quantiles as Q
from wakeline.operators import stats as ST

FOUR = ("lat", "lon", "sog", "cog")


def match(predictions: DataFrame, truth: DataFrame, keys: Sequence[str] = ("sample_id", "step")) -> DataFrame:
    """Predictions next to the truth; steps that only one side has are left out."""
    return predictions.join(truth, list(keys))


def with_errors(fc: DataFrame) -> DataFrame:
    """Great-circle (km), planar (degrees), speed and circular course error per step."""
    dlat, dlon = F.col("pred_lat") - F.col("true_lat"), F.col("pred_lon") - F.col("true_lon")
    return pinned(fc, {
        "km": geo.haversine_km(F.col("pred_lat"), F.col("pred_lon"), F.col("true_lat"), F.col("true_lon")),
        "degrees": F.sqrt(dlat * dlat + dlon * dlon), "square": dlat * dlat + dlon * dlon,
        "sog_error": F.abs(F.col("pred_sog") - F.col("true_sog")),
        "cog_error": geo.circular_error(F.col("pred_cog"), F.col("true_cog")),
        "cog_delta": geo.angle_delta(F.col("pred_cog") - F.col("true_cog")),
    })


def _last_step(value: str) -> Column:
    return F.max_by(value, "step")


def position_metrics(fc: DataFrame) -> DataFrame:
    """ADE, FDE and RMSE in km, and circular course RMSE."""
    e = with_errors(fc)
    finals = e.groupBy("sample_id").agg(_last_step("km").alias("f")).agg(F.avg("f").alias("fde_km"))
    means = e.agg(F.avg("km").alias("ade_km"), F.sqrt(F.avg(F.col("km") * F.col("km"))).alias("rmse_km"),
                  F.sqrt(F.avg(F.col("cog_delta") * F.col("cog_delta"))).alias("course_rmse"))
    return Q.side_by_side(means, finals)


def planar_metrics(fc: DataFrame, steps: Sequence[int] = (1, 5, 10, 20)) -> DataFrame:
    """Metrics on plain degrees over all four features, and errors at some steps."""
    e = with_errors(fc)
    gap = lambda c: F.col(f"pred_{c}") - F.col(f"true_{c}")
    squares = sum((F.sum(gap(c) * gap(c)) for c in FOUR[1:]), F.sum(gap("lat") * gap("lat")))
    sizes = sum((F.sum(F.abs(gap(c))) for c in FOUR[1:]), F.sum(F.abs(gap("lat"))))
    number = sum((F.count(gap(c)) for c in FOUR[1:]), F.count(gap("lat")))
    one = e.agg((squares / number).alias("mse"), (sizes / number).alias("mae"), F.avg("degrees").alias("ade"),
                (F.sqrt(F.avg("square") / 2) * 111).alias("position_rmse_km"), F.avg("sog_error").alias("speed_mae"),
                F.avg("cog_error").alias("course_mae"),
                *[F.avg(F.when(F.col("step") == k, F.col("degrees"))).alias(f"error_{k}step") for k in steps])
    finals = e.groupBy("sample_id").agg(_last_step("degrees").alias("f")).agg(F.avg("f").alias("fde"))
    return Q.side_by_side(one.withColumn("rmse", F.sqrt("mse")), finals)


def sample_metrics(fc: DataFrame) -> DataFrame:
    """Mean distance and course RMSE per sample."""
    e = with_errors(fc)
    return e.groupBy("sample_id").agg(
        F.avg("km").alias("mean_km"), F.sqrt(F.avg(F.col("cog_delta") * F.col("cog_delta"))).alias("course_rmse"))


def metric_summary(samples: DataFrame, metrics: Sequence[str], row: str = "sample_id", n: int = 200, seed: int = 42) -> DataFrame:
    """Value, spread, quartiles and interval width of per-sample metrics."""
    long = samples.unpivot([row], list(metrics), "metric", "score")
    base = long.groupBy("metric").agg(F.stddev_pop("score").alias("std"), F.min("score").alias("min"), F.max("score").alias("max"))
    parts = Q.percentiles(long, ["metric"], "score", {"q25": 0.25, "median": 0.5, "q75": 0.75})
    ci = ST.bootstrap_ci(long, ["metric"], "score", row, n, seed)
    return ci.join(base, "metric").join(parts, "metric").withColumn("ci_width", F.col("high") - F.col("low"))


def best_of_n(candidates: DataFrame) -> DataFrame:
    """Per step: distribution of the smallest error over each sample's candidates."""
    e = with_errors(candidates).groupBy("sample_id", "step").agg(F.min("km").alias("best"))
    base = e.groupBy("step").agg(F.avg("best").alias("mean"), F.max("best").alias("max"), F.count("*").alias("n"))
    return base.join(Q.percentiles(e, ["step"], "best", {"median": 0.5, "p90": 0.9}), "step")


def multi_hypothesis(candidates: DataFrame, candidate: str = "candidate") -> DataFrame:
    """Per sample: its best candidate by mean distance, that one's errors, and the spread over all."""
    e = with_errors(candidates)
    each = e.groupBy("sample_id", candidate).agg(
        F.avg("km").alias("mean_km"), F.avg("square").alias("mse"), F.max("km").alias("max_km"))
    each = each.withColumn("rmse", F.sqrt("mse"))
    best = F.min_by(F.struct(candidate, "mean_km", "mse", "rmse", "max_km"), F.struct("mean_km", candidate)).alias("b")
    return each.groupBy("sample_id").agg(
        best, F.avg("rmse").alias("mean_rmse"), F.stddev_pop("rmse").alias("std_rmse"), F.min("rmse").alias("min_rmse")
    ).select("sample_id", F.col(f"b.{candidate}").alias("best_candidate"), "b.mean_km", F.col("b.mse").alias("best_mse"),
             F.col("b.rmse").alias("best_rmse"), F.col("b.max_km").alias("best_max_km"), "mean_rmse", "std_rmse", "min_rmse")


# ------------------------------------------------------------- classification

def classification_metrics(df: DataFrame, label: str, score: str, threshold: float = 0.5) -> DataFrame:
    """Precision, recall and F1 at the threshold (0 on empty) and the rank-based ROC area.

    The area uses counts per distinct score with ties at half weight.
    """
    hit, pos = F.col(score) >= threshold, F.col(label) == 1
    one = df.agg(F.count_if(hit & pos).alias("tp"), F.count_if(hit & ~pos).alias("fp"), F.count_if(~hit & pos).alias("fn"),
                 F.avg(score).alias("mean_score"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    one = one.withColumns({"precision": zero(tp / F.nullif(tp + fp, F.lit(0))), "recall": zero(tp / F.nullif(tp + fn, F.lit(0))),
                           "f1": zero(2 * tp / F.nullif(2 * tp + fp + fn, F.lit(0)))})
    counts = df.filter(F.col(score).isNotNull()).groupBy(F.col(score).cast("double").alias("_v")).agg(
        F.count_if(pos).alias("_p"), F.count_if(~pos).alias("_q"))
    run = Q.with_running_counts(counts, "_v", ["_q"])
    area = run.agg((F.sum(F.col("_p") * (F.col("_before_q") + F.col("_q") / 2)) / F.nullif(
        F.sum("_p").cast("double") * F.sum("_q"), F.lit(0.0))).alias("roc_auc"))
    return Q.side_by_side(one, area)


def reconstruction_scores(df: DataFrame, original: str, rebuilt: str, threshold: float) -> DataFrame:
    """Mean squared reconstruction error per row and whether it passes the threshold."""
    square = F.zip_with(original, rebuilt, lambda a, b: (a - b) * (a - b))
    score = F.aggregate(square, F.lit(0.0), lambda s, v: s + F.coalesce(v, F.lit(0.0))) / F.size(original)
    return df.withColumn("score", score).withColumn("anomaly", F.col("score") > threshold)


def detection_summary(scored: DataFrame) -> DataFrame:
    return scored.agg(F.count("*").alias("n"), F.avg(F.col("anomaly").cast("int")).alias("detection_rate"), F.avg("score").alias("mean_score"))


# ------------------------------------------------------------- slices

def sample_errors(fc: DataFrame, metric: str = "mae", cols: Sequence[str] = ("lat", "lon")) -> DataFrame:
    """One error per sample over all its steps and the given columns."""
    gap = lambda c: F.col(f"pred_{c}") - F.col(f"true_{c}")
    part = (lambda c: F.abs(gap(c))) if metric == "mae" else (lambda c: gap(c) * gap(c))
    total = sum((F.avg(part(c)) for c in cols[1:]), F.avg(part(cols[0]))) / len(cols)
    return fc.groupBy("sample_id").agg((F.sqrt(total) if metric == "rmse" else total).alias("error"))


def density_bins(df: DataFrame, count: str = "vessel_count_5km") -> Column:
    """low / medium / high by the 33rd and 67th percentile of the counts."""
    ends = Q.percentiles(df, [], count, {"a": 0.33, "b": 0.67}).first()
    return F.when(F.col(count) <= ends["a"], "low").when(F.col(count) >= ends["b"], "high").otherwise("medium")


def port_bins(km: Column) -> Column:
    return F.when(km < 5, "<5km").when(km < 20, "5-20km").otherwise(">20km")


BINS = {
    "vessel_type": ("cargo", "tanker", "fishing", "passenger", "other"),
    "traffic_density": ("low", "medium", "high"),
    "port_distance": ("<5km", "5-20km", ">20km"),
}


def sliced_errors(errors: DataFrame, slices: dict[str, Column], bins: dict[str, Sequence[str]],
                  n: int = 200, seed: int = 42) -> DataFrame:
    """Errors per (dimension, bin): count, mean, spread, interval from 10 samples on.

    ``slices`` maps a dimension to a column expression, the user's own included;
    bins without samples are listed with n = 0.
    """
    dims = F.array(*[F.struct(F.lit(d).alias("dim"), c.cast("string").alias("bin")) for d, c in slices.items()])
    long = errors.select("sample_id", "error", F.inline(dims))
    stats = long.groupBy("dim", "bin").agg(F.count("*").alias("n"), F.avg("error").alias("mean"), F.stddev_pop("error").alias("std"))
    ci = ST.bootstrap_ci(long, ["dim", "bin"], "error", "sample_id", n, seed).filter(F.col("n") >= 10).select("dim", "bin", "low", "high")
    known = F.array(*[F.struct(F.lit(d).alias("dim"), F.lit(b).alias("bin")) for d in slices for b in bins[d]])
    listed = errors.sparkSession.range(1).select(F.inline(known))
    return listed.join(stats, ["dim", "bin"], "left").join(ci, ["dim", "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def horizon_curve(fc: DataFrame, keys: Sequence[str] = (), n: int = 0, seed: int = 42, value: str = "abs_error") -> DataFrame:
    """Error per step (and key): mean, spread, count, rise over the step before, interval if n > 0."""
    curve = fc.groupBy(*keys, "step").agg(
        F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.count(value).alias("n"))
    steps = Window.partitionBy(*keys).orderBy("step")  # one row per step
    before = F.lag("mean").over(steps)
    curve = curve.withColumn("rise", F.when(before > 0, (F.col("mean") - before) / before))
    curve = curve.withColumn("critical", F.coalesce(F.col("rise") > 0.10, F.lit(False)))
    if n:
        ci = ST.bootstrap_ci(fc, [*keys, "step"], value, "sample_id", n, seed).select(*keys, "step", "low", "high")
        curve = curve.join(ci, [*keys, "step"], "left")
    return curve


def with_step_error(fc: DataFrame, metric: str = "mae", cols: Sequence[str] = ("lat", "lon")) -> DataFrame:
    gap = lambda c: F.col(f"pred_{c}") - F.col(f"true_{c}")
    part = (lambda c: F.abs(gap(c))) if metric == "mae" else (lambda c: gap(c) * gap(c))
    mean = sum((part(c) for c in cols[1:]), part(cols[0])) / len(cols)
    return fc.withColumn("abs_error", F.sqrt(mean) if metric == "rmse" else mean)


def degradation(curve: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Slope of the log error over the steps (plain change per step when any error is 0)."""
    ends = F.struct("step", "mean")
    first, last = F.min_by(ends, "step"), F.max_by(ends, "step")
    out = curve.groupBy(*keys).agg(
        F.min("mean").alias("_least"), F.regr_slope(F.log(F.when(F.col("mean") > 0, F.col("mean"))), F.col("step").cast("double")).alias("_log"),
        first.alias("_a"), last.alias("_b"), F.count("*").alias("steps"))
    change = (F.col("_b.mean") - F.col("_a.mean")) / F.nullif(F.col("_b.step") - F.col("_a.step"), F.lit(0))
    rate = F.when(F.col("steps") < 2, 0.0).when(F.col("_least") > 0, F.col("_log")).otherwise(change)
    return out.select(*keys, "steps", F.col("_b.mean").alias("final_error"), rate.alias("degradation"))


def sliced_curves(fc: DataFrame, dim: str, min_n: int = 5) -> DataFrame:
    """Curves per bin; bins with too few samples go."""
    enough = fc.groupBy(dim).agg(F.count_distinct("sample_id").alias("samples")).filter(F.col("samples") >= min_n)
    return horizon_curve(fc.join(enough, dim), [dim])


def best_and_worst(curves: DataFrame, dim: str) -> DataFrame:
    rates = degradation(curves, [dim])
    return rates.agg(F.min_by(dim, F.struct("final_error", dim)).alias("best"), F.max_by(dim, F.struct("final_error", dim)).alias("worst"),
                     F.min("final_error").alias("best_error"), F.max("final_error").alias("worst_error"), F.count("*").alias("bins"))


def compare_curves(curves: DataFrame, name: str = "model") -> DataFrame:
    """Per pair of curves and step: difference, relative difference, interval overlap."""
    a = curves.select(F.col(name).alias("a"), "step", F.col("mean").alias("mean_a"), F.col("low").alias("low_a"), F.col("high").alias("high_a"))
    b = curves.select(F.col(name).alias("b"), "step", F.col("mean").alias("mean_b"), F.col("low").alias("low_b"), F.col("high").alias("high_b"))
    j = a.join(b, "step").filter(F.col("a") < F.col("b"))
    overlap = ~((F.col("high_a") < F.col("low_b")) | (F.col("high_b") < F.col("low_a")))
    return j.select("a", "b", "step", (F.col("mean_a") - F.col("mean_b")).alias("mean_diff"),
                    ((F.col("mean_a") - F.col("mean_b")) / F.nullif("mean_b", F.lit(0.0))).alias("relative_diff"), overlap.alias("ci_overlap"))


def better_curve(curves: DataFrame, name: str = "model") -> DataFrame:
    """Overall winner per pair: lower final error and slower growth, else their weighted sum."""
    d = degradation(curves, [name]).withColumn("_j", F.lit(0))
    a = d.select("_j", F.col(name).alias("a"), F.col("final_error").alias("fa"), F.col("degradation").alias("da"))
    b = d.select("_j", F.col(name).alias("b"), F.col("final_error").alias("fb"), F.col("degradation").alias("db"))
    j = a.join(b, "_j").filter(F.col("a") < F.col("b"))  # one row per curve
    f, g = F.col("fa") - F.col("fb"), F.col("da") - F.col("db")
    winner = (F.when((f < 0) & (g < 0), F.col("a")).when((f > 0) & (g > 0), F.col("b"))
              .when(f + 0.5 * g < 0, F.col("a")).otherwise(F.col("b")))
    return j.select("a", "b", winner.alias("better"), g.alias("degradation_diff"))


def worst_cases(errors: DataFrame, k: int) -> DataFrame:
    """The k largest errors, descending (ties by sample)."""
    return errors.orderBy(F.desc("error"), "sample_id").limit(k)


def weighted_error(fc: DataFrame, decay: bool = False, position: float = 1.0, movement: float = 0.5, boosted: int = 6) -> DataFrame:
    """Position MSE plus half the speed and circular course MSE, steps weighted if asked."""
    t = F.col("step") - 1
    w = F.exp(-0.1 * t) * F.when(t < boosted, 2.0).otherwise(1.0) if decay else F.lit(1.0)
    gap = lambda c: F.col(f"pred_{c}") - F.col(f"true_{c}")
    turn = geo.angle_delta(gap("cog"))
    place = F.avg(w * (gap("lat") * gap("lat") + gap("lon") * gap("lon")) / 2)
    motion = F.avg(w * (gap("sog") * gap("sog") + turn * turn) / 2)
    return fc.agg((position * place + movement * motion).alias("loss"), place.alias("position"), motion.alias("movement"))


def feasibility(fc: DataFrame, max_turn: float = 5.0, max_acceleration: float = 0.5, step_s: float = 5.0) -> DataFrame:
    """Mean excess of turn rate and acceleration over the limits, step by step of each forecast."""
    w = Window.partitionBy("sample_id").orderBy("step")  # one forecast horizon
    turn = F.abs(geo.angle_delta(F.col("pred_cog") - F.lag("pred_cog").over(w))) / step_s
    change = F.abs(F.col("pred_sog") - F.lag("pred_sog").over(w)) / step_s
    over = lambda c, limit: F.greatest(c - limit, F.lit(0.0))
    e = fc.withColumns({"_t": turn, "_a": change}).filter(F.col("_t").isNotNull() & F.col("_a").isNotNull())
    return e.agg(F.avg(over(F.col("_t"), max_turn) + over(F.col("_a"), max_acceleration)).alias("penalty"))


ERROR_WORDS = ("error", "rmse", "mae", "mse", "ade", "fde")


def rank_models(scores: DataFrame) -> DataFrame:
    """Rank of each model per metric, ties averaged; error metrics rank upward, others downward."""
    lower = F.lit(False)
    for word in ERROR_WORDS:
        lower = lower | F.lower("metric").contains(word)
    key = F.when(lower, F.col("value")).otherwise(-F.col("value"))
    w = Window.partitionBy("metric").orderBy("_key")  # one row per model
    same = F.count("*").over(Window.partitionBy("metric", "_key"))
    return scores.withColumn("_key", key).withColumn("rank", F.rank().over(w) + (same - 1) / 2).drop("_key")


def model_ranking(ranks: DataFrame) -> DataFrame:
    return ranks.groupBy("model").agg(F.avg("rank").alias("average_rank"), F.count_if(F.col("rank") < 2).alias("wins"))


def best_models(ranks: DataFrame) -> DataFrame:
    return ranks.groupBy("metric").agg(F.min_by("model", F.struct("rank", "model")).alias("best"))
