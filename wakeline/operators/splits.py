"""Train / validation / test splits, folds and their checks.

Ordered splits need only the border rows, not a global sort: :func:`cut_points`
finds the row at each wanted position by narrowing histograms, and every row is
then labelled by comparing it with the borders.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window, functions as F

from wakeline.functions import times
from wakeline.operators.quantiles import with_running_counts
from wakeline.session import saved

BINS = 4096
FEW = 20_000


def cut_points(df: DataFrame, order: Sequence[Column], positions: Sequence[int],
               among: Sequence[Column] | None = None) -> list[tuple[int, ...]]:
    """Order key of the rows at 0-based ``positions`` in ascending order of ``order``.

    ``order`` are integer columns; ``among`` restricts each position to some rows.
    Each pass counts rows in at most BINS intervals per position and keeps the one
    that holds it, until at most FEW rows are left to look at; so the driver sees
    a bounded number of values and no task sees the whole order.
    """
    keys = [f"_o{i}" for i in range(len(order))]
    marks = {f"_a{i}": c for i, c in enumerate(among or ())}
    slim = df.select(*[c.cast("long").alias(k) for c, k in zip(order, keys)], *[c.alias(m) for m, c in marks.items()])
    slim = saved(slim, "order")  # every pass reads these few columns only
    found: list[tuple[int, ...] | None] = [None] * len(positions)
    fixed: list[list[int]] = [[] for _ in positions]
    span: list[tuple[int, int] | None] = [None] * len(positions)
    left, inside = list(positions), [FEW + 1] * len(positions)

    def within(i):
        tests = ([f"_a{i}"] if among else []) + [f"{k} = {v}" for k, v in zip(keys, fixed[i])]
        if span[i]:
            tests.append(f"{keys[len(fixed[i])]} BETWEEN {span[i][0]} AND {span[i][1]}")
        return F.expr(" AND ".join(tests) or "true")

    def tagged(which, value):
        """(i, value) for every position i a row may still decide."""
        marked = [F.when(within(i), F.struct(F.lit(i).alias("i"), value(i).alias("v"))) for i in which]
        return slim.select(F.explode(F.array_compact(F.array(*marked))).alias("p")).select("p.i", "p.v")

    while True:
        few = [i for i, f in enumerate(found) if f is None and inside[i] <= FEW]
        if few:
            rows = tagged(few, lambda i: F.struct(*keys)).collect()
            for i in few:
                found[i] = sorted(tuple(r["v"]) for r in rows if r["i"] == i)[left[i]]
        many = [i for i, f in enumerate(found) if f is None]
        if not many:
            return found
        unknown = [i for i in many if span[i] is None]
        if unknown:
            ends = tagged(unknown, lambda i: F.col(keys[len(fixed[i])])).groupBy("i").agg(F.min("v").alias("lo"), F.max("v").alias("hi")).collect()
            for r in ends:
                span[r["i"]] = (r["lo"], r["hi"])
        width = {i: max(1, -(-(span[i][1] - span[i][0] + 1) // BINS)) for i in many}
        bin_ = lambda i: F.floor((F.col(keys[len(fixed[i])]) - span[i][0]) / F.lit(width[i])).cast("long")
        counts = tagged(many, bin_).groupBy("i", "v").count().collect()
        for i in many:
            for v, n in sorted((r["v"], r["count"]) for r in counts if r["i"] == i):
                if left[i] < n:
                    low = span[i][0] + v * width[i]
                    span[i], inside[i] = (low, min(span[i][1], low + width[i] - 1)), n
                    break
                left[i] -= n
            if span[i][0] == span[i][1]:  # one value holds the position: go on with the next key
                fixed[i].append(span[i][0])
                span[i] = None
                if len(fixed[i]) == len(keys):
                    found[i] = tuple(fixed[i])


def _before(order: Sequence[Column], border: tuple[int, ...]) -> Column:
    left = F.struct(*[c.cast("long").alias(f"c{i}") for i, c in enumerate(order)])
    return left < F.struct(*[F.lit(v).cast("long").alias(f"c{i}") for i, v in enumerate(border)])


def _by_borders(df: DataFrame, order: Sequence[Column], labels: Sequence[str], ends: Sequence[int], n: int) -> DataFrame:
    """Label rows by position: the i-th label up to (not including) the i-th end."""
    usable = [(label, end) for label, end in zip(labels, ends) if end < n]
    borders = cut_points(df, order, [e for _, e in usable]) if usable else []
    out = F
    for (label, _), border in zip(usable, borders):
        out = out.when(_before(order, border), label)
    last = labels[len(usable)]
    return df.withColumn("split", out.otherwise(last) if usable else F.lit(last))


def random_key(seed: int, key: str) -> Column:
    """60 hash bits of the row key and the seed: a reproducible random order."""
    text = F.md5(F.concat(F.col(key).cast("string"), F.lit(f"-{seed}")))
    return F.conv(F.substring(text, 1, 15), 16, 10).cast("long")


def random_split(df: DataFrame, key: str, seed: int = 42, test: float = 0.1, val: float = 0.2,
                 ties: Sequence[Column] | None = None) -> DataFrame:
    """Exact shares in a seeded random order: test, then validation, the rest train.

    ``ties``: integer columns that tell rows with equal hash bits apart (the key, if it is a number).
    """
    n = df.count()
    n_test, n_val = int(n * test), int(n * val)
    order = [random_key(seed, key), *(ties or [F.col(key)])]
    return _by_borders(df, order, ["test", "validation", "train"], [n_test, n_test + n_val], n)


def ordered_split(df: DataFrame, order: Sequence[Column], train: float = 0.7, val: float = 0.15) -> DataFrame:
    n = df.count()
    first, second = int(n * train), int(n * (train + val))
    return _by_borders(df, order, ["train", "validation", "test"], [first, second], n)


def by_cut_date(df: DataFrame, time: str, cut: str, val_days: float = 7.0, test_days: float | None = None) -> DataFrame:
    """Train before the cut, validation for the days after it, test next (half-open)."""
    at = datetime.fromisoformat(cut)
    val_end = at + timedelta(days=val_days)
    stamp = lambda d: F.lit(d.strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp")
    label = F.when(F.col(time) < stamp(at), "train").when(F.col(time) < stamp(val_end), "validation").otherwise("test")
    out = df.withColumn("split", label)
    return out if test_days is None else out.filter(F.col(time) < stamp(val_end + timedelta(days=test_days)))


def _time_order(time: str, key: str) -> list[Column]:
    return [F.unix_micros(F.col(time)), F.col(key)]


def time_series_folds(df: DataFrame, folds: int = 5, time: str = "time", key: str = "event_id",
                      gap_minutes: float = 60.0) -> DataFrame:
    """Expanding train part, next block as test; test rows too close to the train end go.

    One output row per (row, fold) the row takes part in: ``fold``, ``side``.
    """
    n = df.count()
    size = n // (folds + 1)
    order = _time_order(time, key)
    starts = [n - (folds - f) * size for f in range(folds)]
    wanted = starts + [s + size for s in starts[:-1]] + [s - 1 for s in starts]
    at = dict(zip(wanted, cut_points(df, order, wanted)))
    parts = []
    for f, s in enumerate(starts):
        train_end = F.timestamp_micros(F.lit(at[s - 1][0]))
        clear = times.seconds_between(F.col(time), train_end) >= gap_minutes * 60
        until = _before(order, at[s + size]) if s + size < n else F.lit(True)
        side = F.when(_before(order, at[s]), "train").when(until & clear, "test")
        parts.append(F.when(side.isNotNull(), F.struct(F.lit(f).alias("fold"), side.alias("side"))))
    return df.select("*", F.inline(F.array_compact(F.array(*parts))))


def group_folds(df: DataFrame, folds: int = 5, group: str = "mmsi") -> DataFrame:
    """Fold of every group: sizes in descending order dealt back and forth.

    Only the distinct sizes pass through one ordered window; groups of one size
    are numbered by running counts over bins of their (numeric) ids.
    """
    sizes = df.groupBy(group).agg(F.count("*").alias("rows"))
    per_size = sizes.groupBy("rows").agg(F.count("*").alias("groups"))
    larger = Window.orderBy(F.desc("rows")).rowsBetween(Window.unboundedPreceding, -1)
    per_size = per_size.withColumn("ahead", F.coalesce(F.sum("groups").over(larger), F.lit(0)))
    numbered = with_running_counts(sizes.withColumn("one", F.lit(1)), group, ["one"], ["rows"])
    ranked = numbered.join(per_size.drop("groups"), "rows").withColumn("rank", F.col("ahead") + F.col("_beforeone"))
    lap, seat = F.floor(F.col("rank") / folds), F.col("rank") % folds
    fold = F.when(lap % 2 == 0, seat).otherwise(folds - 1 - seat)
    return ranked.select(group, "rows", fold.cast("int").alias("test_fold"))


def _sides(folds: int) -> Column:
    side = lambda f: F.when(F.col("test_fold") == f, "test").otherwise("train")
    return F.array(*[F.struct(F.lit(f).alias("fold"), side(f).alias("side")) for f in range(folds)])


def group_k_fold(df: DataFrame, folds: int = 5, group: str = "mmsi") -> DataFrame:
    """(row, fold, side) with no group on both sides of a fold."""
    tagged = df.join(group_folds(df, folds, group).drop("rows"), group)
    return tagged.select("*", F.inline(_sides(folds))).drop("test_fold")


def group_distribution(df: DataFrame, folds: int = 5, group: str = "mmsi") -> DataFrame:
    """(group, rows, fold, side) table of the group folds."""
    return group_folds(df, folds, group).select(group, "rows", F.inline(_sides(folds)))


def combined_folds(df: DataFrame, folds: int = 5, inner: int = 3, group: str = "mmsi", time: str = "time",
                   key: str = "event_id", gap_minutes: float = 60.0) -> DataFrame:
    """Vessel folds whose train side is cut by the first inner temporal split."""
    tagged = df.join(group_folds(df, folds, group).drop("rows"), group)
    order = _time_order(time, key)
    counts = tagged.groupBy("test_fold").count().collect()  # one row per fold
    rows = {r["test_fold"]: r["count"] for r in counts}
    sizes = [sum(rows.values()) - rows.get(f, 0) for f in range(folds)]
    borders = cut_points(tagged, order, [n - inner * (n // (inner + 1)) for n in sizes],
                         [F.col("test_fold") != f for f in range(folds)])
    parts = []
    for f, border in enumerate(borders):
        side = F.when(F.col("test_fold") == f, "test").when(_before(order, border), "train")
        parts.append(F.when(side.isNotNull(), F.struct(F.lit(f).alias("fold"), side.alias("side"))))
    return tagged.select("*", F.inline(F.array_compact(F.array(*parts)))).drop("test_fold")


def _purged_spans(n: int, folds: int, gap_rows: int, max_train: int | None, test_rows: int | None):
    size = test_rows or n // (folds + 1)
    for f in range(folds):
        test = (n - f * size - size, n - f * size)
        train_end = test[0] - gap_rows
        train_start = max(0, train_end - max_train) if max_train else 0
        if train_end > train_start and test[0] >= 0:
            yield f, (train_start, train_end), test


def purged_folds(df: DataFrame, folds: int = 5, gap_rows: int = 0, max_train: int | None = None,
                 test_rows: int | None = None, time: str = "time", key: str = "event_id") -> DataFrame:
    """Test blocks taken from the end backwards, with a gap in rows and a longest train part."""
    n = df.count()
    return _row_spans(df, list(_purged_spans(n, folds, gap_rows, max_train, test_rows)), n, _time_order(time, key))


def blocking_folds(df: DataFrame, folds: int = 5, gap_rows: int = 0, time: str = "time",
                   key: str = "event_id") -> DataFrame:
    """Consecutive test blocks, each trained on the rows before it."""
    n = df.count()
    test_size = n // (2 * folds)
    train_size = n - test_size * folds
    spans = []
    for f in range(folds):
        start = f * (test_size + gap_rows)
        train_end = start - gap_rows
        if start + test_size <= n and train_end > max(0, train_end - train_size):
            spans.append((f, (max(0, train_end - train_size), train_end), (start, start + test_size)))
    return _row_spans(df, spans, n, _time_order(time, key))


def vessel_time_folds(df: DataFrame, folds: int = 3, share: float = 0.8, seed: int = 42, gap_rows: int = 0,
                      group: str = "mmsi", time: str = "time", key: str = "event_id") -> DataFrame:
    """Purged folds that train on a random share of the vessels and test on the others."""
    n = df.count()
    tagged = _row_spans(df, list(_purged_spans(n, folds, gap_rows, None, None)), n, _time_order(time, key))
    limit = int(share * 16**15)
    chosen = F.lit(False)
    for f in range(folds):
        chosen = F.when(F.col("fold") == f, random_key(seed + f, group) < limit).otherwise(chosen)
    return tagged.filter(chosen == (F.col("side") == "train"))


def _row_spans(df: DataFrame, spans, n: int, order: Sequence[Column]) -> DataFrame:
    wanted = sorted({p for _, *pair in spans for span in pair for p in span if 0 < p < n})
    at = dict(zip(wanted, cut_points(df, order, wanted)))

    def within(span):
        after = F.lit(True) if span[0] <= 0 else ~_before(order, at[span[0]])
        until = F.lit(True) if span[1] >= n else _before(order, at[span[1]])
        return (after & until) if span[0] < span[1] else F.lit(False)

    parts = []
    for f, train, test in spans:
        side = F.when(within(train), "train").when(within(test), "test")
        parts.append(F.when(side.isNotNull(), F.struct(F.lit(f).alias("fold"), side.alias("side"))))
    return df.select("*", F.inline(F.array_compact(F.array(*parts))))


def split_quality(folded: DataFrame, group: str = "mmsi", time: str = "time") -> DataFrame:
    """Per fold: sizes, ratio, groups on both sides, time overlap and gap in minutes."""
    train, test = F.col("side") == "train", F.col("side") == "test"
    sides = folded.groupBy("fold").agg(
        F.count_if(train).alias("train_rows"), F.count_if(test).alias("test_rows"),
        F.max(F.when(train, F.col(time))).alias("train_end"), F.min(F.when(test, F.col(time))).alias("test_start"))
    shared = folded.groupBy("fold", group).agg(F.count_distinct("side").alias("s")).groupBy("fold").agg(
        F.count_if(F.col("s") > 1).alias("group_overlap"))
    gap = times.seconds_between(F.col("test_start"), F.col("train_end")) / 60
    return sides.join(shared, "fold").select(
        "fold", "train_rows", "test_rows", "group_overlap", gap.alias("gap_minutes"), (gap < 0).alias("time_overlap"),
        (F.col("test_rows") / F.nullif("train_rows", F.lit(0))).alias("ratio"))


def shared_groups(folded: DataFrame, group: str = "mmsi") -> DataFrame:
    """Groups that appear on both sides of a fold."""
    one = lambda s: folded.filter(F.col("side") == s).select("fold", group)
    return one("train").intersect(one("test"))
