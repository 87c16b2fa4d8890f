"""Receiver log text to message tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from wakeline import schema as S
from wakeline.functions import times
from wakeline.operators import clean as C
from wakeline.operators import splits as SP

STAMPED = r"^\d{4}-\d{2}-\d{2} .* - "


def read_lines(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Log files as text; `.gz` is read natively and several paths are one scan."""
    return spark.read.text(path)


def parse_lines(lines: DataFrame, fields: T.StructType = S.LOG_FIELDS) -> DataFrame:
    """Split `<stamp> - {json}` lines into the log time and the payload fields.

    ``reject`` says why a line holds no message (NULL when it does): ``noise``
    for lines without stamp or JSON object, ``malformed`` for broken JSON,
    ``no_type`` and ``no_time`` for missing fields.  The cheap pattern test comes
    first, so JSON is parsed only where there is some.
    """
    value = F.col("value")
    cut = F.instr(value, " - ")
    body = F.when(value.rlike(STAMPED), F.trim(F.substring(value, cut + 3, F.length(value))))
    payload = F.when(F.startswith(body, F.lit("{")), body)
    wanted = T.StructType([*fields, T.StructField("_bad", T.StringType())])
    df = lines.withColumns({"_payload": payload, "_stamp": F.substring(value, 1, 23)})
    renamed = {"name": "aid_name"}  # the ship's name comes as shipname
    # exploding a one-element array keeps filters from parsing the JSON again
    parsed = F.from_json("_payload", wanted, {"columnNameOfCorruptRecord": "_bad"})
    df = df.select("*", F.explode(F.array(parsed)).alias("_m"))
    df = df.select(
        F.try_to_timestamp("_stamp", F.lit("yyyy-MM-dd HH:mm:ss,SSS")).alias("log_time"), "_payload",
        F.col("_m._bad").alias("_bad"), *[F.col(f"_m.{f.name}").alias(renamed.get(f.name, f.name)) for f in fields])
    if "rxtime" in fields.names:
        df = df.withColumn("time", times.parse_rxtime(F.col("rxtime")))
    reject = (F.when(F.col("_payload").isNull(), "noise").when(F.col("_bad").isNotNull(), "malformed")
              .when(F.col("type").isNull(), "no_type"))
    if "rxtime" in fields.names:
        reject = reject.when(F.col("time").isNull(), "no_time")
    return df.withColumn("reject", reject).drop("_payload", "_bad")


def read_ais_log(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Messages with a type and a receive time, sentinels and ranges nulled, classified."""
    return records(parse_lines(read_lines(spark, path)))


def records(parsed: DataFrame) -> DataFrame:
    df = C.rename_aliases(parsed.filter(F.col("reject").isNull()).drop("reject"), S.LOG_ALIASES)
    return C.with_message_class(C.null_out_of_range(C.null_sentinels(df)), "basic")


def receiver_records(parsed: DataFrame) -> DataFrame:
    """Messages of `class = AIS` lines that have a type and a log time."""
    return parsed.filter((F.col("class") == "AIS") & F.col("log_time").isNotNull() & F.col("type").isNotNull())


def first_records(records: DataFrame, n: int) -> DataFrame:
    """The first ``n`` messages by log time; ties go by the receiver's ``seq``, then by a hash of the whole message.

    The border is found by counting in ever narrower intervals, so nothing is sorted as a whole and a second
    with very many messages costs no more than others. Equal messages are interchangeable: at the border as
    many of them stay as there is room for.
    """
    seq = F.coalesce("seq", F.lit(0)) if "seq" in records.columns else F.lit(0)
    whole = [F.col(c) for c in records.columns]
    order = {"_o0": F.unix_micros("log_time"), "_o1": seq.cast("long"), "_o2": F.xxhash64(*whole), "_o3": F.xxhash64(F.lit(1), *whole)}
    keyed = records.withColumns(order)
    if n <= 0 or n >= records.count():
        return records.limit(0) if n <= 0 else records
    border = SP.cut_points(keyed, [F.col(o) for o in order], [n - 1])[0]
    earlier, same = F.lit(False), F.lit(True)
    for o, value in zip(order, border):
        earlier = earlier | (same & (F.col(o) < value))
        same = same & (F.col(o) == value)
    before = keyed.filter(earlier)
    return before.unionByName(keyed.filter(same).limit(n - before.count())).drop(*order)


def read_receiver_log(spark: SparkSession, path: str | Sequence[str], max_records: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Position and static tables of a receiver's log, of its first ``max_records`` messages or of all."""
    return receiver_tables(parse_lines(read_lines(spark, path)), max_records)


def receiver_tables(parsed: DataFrame, max_records: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Position and static tables keyed on the log time, from `class = AIS` lines."""
    ais = receiver_records(parsed)
    if max_records is not None:
        ais = first_records(ais, max_records)
    ais = C.rename_aliases(ais.drop("time", "reject").withColumnRenamed("log_time", "time"), S.LOG_ALIASES)
    valid = ais.filter(C.valid_mmsi(F.col("mmsi"), "text"))
    places = C.repair_motion(C.filter_positions(valid.filter(F.col("msg_type").isin(*S.RECEIVER_POSITION_TYPES))))
    static = valid.filter(F.col("msg_type").isin(*S.METADATA_TYPES))
    return places, static


def reject_counts(parsed: DataFrame) -> DataFrame:
    """Why lines and messages were refused, one pass, plus the accepted count."""
    position = F.col("type").isin(*S.RECEIVER_POSITION_TYPES)
    sog, cog = F.col("speed"), F.col("course")
    reason = (
        F.when(F.col("reject").isNotNull(), F.col("reject"))
        .when(~F.coalesce(C.valid_mmsi(F.col("mmsi"), "text"), F.lit(False)), "bad_mmsi")
        .when(position & ~C.valid_position(F.col("lat"), F.col("lon")), "bad_position")
        .when(position & ~F.coalesce(sog.between(0, 50), F.lit(False)), "bad_speed")
        .when(position & ~F.coalesce((cog >= 0) & (cog < 360), F.lit(False)), "bad_course")
        .otherwise("valid"))
    return parsed.groupBy(reason.alias("reason"), F.col("type").alias("msg_type")).agg(F.count("*").alias("n"))


def task_fields(tasks: Sequence[str]) -> T.StructType:
    """Log fields any of the tasks needs; JSON parsing reads only these."""
    names = {"class", "mmsi", "type", "rxtime", "channel", "lat", "lon"}
    for task in tasks:
        for group in S.TASKS[task]["fields"]:
            names |= set(S.FIELD_GROUPS[group])
    return T.StructType([f for f in S.LOG_FIELDS if f.name in names])


def read_for_task(lines: DataFrame, tasks: Sequence[str]) -> DataFrame:
    """Only the message types and fields that the requested tasks use."""
    types = sorted({t for task in tasks for t in S.TASKS[task]["types"]})
    parsed = parse_lines(lines, task_fields(tasks)).filter(F.col("reject").isNull() & F.col("type").isin(*types))
    return C.with_message_class(C.rename_aliases(parsed.drop("reject"), S.LOG_ALIASES), "task")


def task_coverage(messages: DataFrame, tasks: Sequence[str]) -> DataFrame:
    """Share of accepted messages that each task keeps."""
    kept = {t: S.TASKS[t]["classes"] for t in tasks}
    one = messages.agg(F.count("*").alias("total"), *[
        F.count_if(F.lit(True) if c is None else F.col("msg_class").isin(*c)).alias(t) for t, c in kept.items()])
    pairs = F.array(*[F.struct(F.lit(t).alias("task"), F.col(t).alias("n")) for t in tasks])
    return one.select("total", F.inline(pairs)).select("task", "n", (100.0 * F.col("n") / F.nullif("total", F.lit(0))).alias("percent"))
