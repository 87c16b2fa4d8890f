"""Reading and writing track tables, vessel documents and datasets."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from wakeline import schema as S
from wakeline.operators import clean as C
from wakeline.operators import ordered as O

SEGMENT = ("mmsi", "segment_id")
TIME_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"


def read_tracks(spark: SparkSession, paths: Sequence[str], csv_types: Mapping[str, str] = S.CSV_TYPES) -> DataFrame:
    """Parquet and CSV files as one table; columns a file lacks are NULL.

    CSV columns get the type named for them and are text otherwise, so all files
    agree and none is read twice.  Whole numbers may be written with a point (``70.0``).
    ``unread`` of a CSV row holds the values that have no such type, as a JSON object,
    and is NULL where there is none.  The files of a Parquet path may differ in columns.
    """
    frames = []
    for p in paths:
        if not p.endswith((".csv", ".csv.gz")):
            frames.append(C.rename_aliases(spark.read.option("mergeSchema", True).parquet(p)))
            continue
        plain = C.rename_aliases(spark.read.csv(p, header=True))
        typed = {c: _typed(F.col(c), csv_types[c]) for c in plain.columns if c in csv_types}
        failed = [F.when(F.col(c).isNotNull() & v.isNull(), F.col(c)).alias(c) for c, v in typed.items()]
        # JSON leaves out NULLs
        unread = F.when(F.coalesce(*failed).isNotNull(), F.to_json(F.struct(*failed))) if failed else F.lit(None).cast("string")
        frames.append(plain.select(*[typed[c].alias(c) if c in typed else F.col(c) for c in plain.columns], unread.alias("unread")))
    return union_all(frames)


def _typed(text: Column, kind: str) -> Column:
    """Text as a type; whole numbers also from ``70.0`` and ``7e1``. NULL where it doesn't parse."""
    if kind not in ("int", "bigint"):
        return text.try_cast(kind)
    exact = text.try_cast("decimal(38,10)")
    return F.coalesce(text.try_cast("bigint"), F.when(exact == F.floor(exact), exact)).try_cast(kind)


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def read_vessel_documents(spark: SparkSession, path: str) -> DataFrame:
    """Vessel JSON lines to flat points with the static values on every point."""
    docs = spark.read.schema(S.VESSEL_DOCUMENT).option("timestampFormat", TIME_FORMAT).json(path)
    return docs.select("mmsi", "segment_id", "static.*", F.explode("trajectory").alias("p")).select(
        "mmsi", "segment_id", "name", "call_sign", "ship_type", "length", "width", "p.*")


def vessel_documents(segments: DataFrame, max_points: int = 10_000,
                     static: Sequence[str] = ("name", "call_sign", "ship_type", "length", "width"),
                     derived: Sequence[str] = ()) -> DataFrame:
    """One document per segment: static values and its points in time order.

    A segment beyond ``max_points`` continues in further documents with the next
    ``part`` number, so no document outgrows a task.
    """
    df = O.with_positions(segments, SEGMENT, out="_pos")
    df = df.withColumn("part", F.floor(F.col("_pos") / max_points))
    point = F.struct("time", F.col("event_id").alias("seq"), "lat", "lon", "sog", "cog", *derived)
    have = [c for c in static if c in df.columns]
    docs = df.groupBy(*SEGMENT, "part").agg(
        *[F.min_by(c, F.col("_pos")).alias(c) for c in have], F.sort_array(F.collect_list(point)).alias("trajectory"))
    return docs.select(*SEGMENT, "part", F.struct(*have).alias("static") if have else F.lit(None).alias("static"), "trajectory")


def write_vessel_documents(docs: DataFrame, path: str) -> None:
    docs.write.option("timestampFormat", TIME_FORMAT).json(path)


def write_daily(df: DataFrame, path: str, log: str, files_per_day: int = 16) -> None:
    """Parquet partitioned by day and ``log``, the name of what the rows come from.

    Many logs add up to a day; a log written again replaces its own rows of the
    days it holds, and nothing else.  A day is spread over a few files by vessel
    and hour, so neither a busy day nor a busy vessel is one task.
    """
    day = df.withColumns({"date": F.to_date("time"), "log": F.lit(log)})
    spread = F.pmod(F.hash("mmsi", F.hour("time")), F.lit(files_per_day))
    (day.repartition("date", spread).sortWithinPartitions("date", "mmsi", "time")
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date", "log").parquet(path))


def write_flat(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    out = df.write.option("header", "true") if fmt == "csv" else df.write
    out.format(fmt).save(path)


def static_sidecar(segments: DataFrame, cols: Sequence[str] = ("name", "call_sign", "ship_type", "length", "width")) -> DataFrame:
    """Static values of each segment's first row."""
    at = F.struct("time", "event_id")
    return segments.groupBy(*SEGMENT).agg(*[F.min_by(c, at).alias(c) for c in cols if c in segments.columns])


def write_dataset(samples: DataFrame, path: str, flatten: bool = False) -> None:
    """Samples as Parquet by split, arrays kept or spread into numbered columns."""
    out = flat_samples(samples) if flatten else samples
    out.write.mode("overwrite").partitionBy("split").parquet(f"{path}/samples")


def flat_samples(samples: DataFrame) -> DataFrame:
    """``input`` and ``target`` arrays as columns ``x_<i>_<name>`` and ``y_<i>_<name>``."""
    # the longest arrays of the table give the width; shorter ones end in NULL
    widest = samples.agg(*[F.max(F.size(c)).alias(c) for c in ("input", "target")]).first()
    lengths = {c: max(0, widest[c] or 0) for c in ("input", "target")}
    cols: list[Column] = [F.col(c) for c in samples.columns if c not in lengths]
    for array, mark in (("input", "x"), ("target", "y")):
        names = [f.name for f in samples.schema[array].dataType.elementType.fields if f.name != "time"]
        cols += [F.get(array, F.lit(i))[n].alias(f"{mark}_{i}_{n}") for i in range(lengths[array]) for n in names]
    return samples.select(*cols)


def dataset_metadata(samples: DataFrame, points: DataFrame) -> DataFrame:
    """Sample and vessel counts, time range, bounds and column names: one row."""
    names = lambda c: F.array(*[F.lit(f.name) for f in samples.schema[c].dataType.elementType.fields])
    counts = samples.agg(F.count("*").alias("samples"), F.count_distinct("mmsi").alias("sample_vessels"))
    bounds = points.agg(
        F.count("*").alias("rows"), F.count_distinct("mmsi").alias("vessels"),
        F.min("time").alias("first_time"), F.max("time").alias("last_time"),
        *[f(c).alias(f"{n}_{c}") for c in ("lat", "lon") for n, f in (("min", F.min), ("max", F.max))])
    row, total = bounds.first(), counts.first()
    one = samples.sparkSession.range(1)
    return one.select(*[F.lit(total[c]).alias(c) for c in counts.columns], *[F.lit(row[c]).alias(c) for c in bounds.columns],
                      names("input").alias("features"), names("target").alias("targets"))


def write_metadata(meta: DataFrame, path: str, config: dict[str, str] | None = None) -> None:
    items = [x for k, v in (config or {}).items() for x in (F.lit(k), F.lit(str(v)))]
    out = meta.withColumn("config", F.create_map(*items)) if items else meta
    out.coalesce(1).write.mode("overwrite").json(f"{path}/metadata")


def read_dataset(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Samples (the split is a partition column) and the metadata row."""
    return spark.read.parquet(f"{path}/samples"), spark.read.json(f"{path}/metadata")


def write_scores(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """Forecast or anomaly rows as CSV or JSON."""
    if fmt not in ("csv", "json"):
        raise ValueError("fmt must be csv or json")
    write_flat(df, path, fmt)
