"""Who is near whom: distance joins over time buckets and grid cells.

A distance predicate alone would compare everything with everything.  Here a row
meets only rows of the same time bucket whose grid cell its search circle can
touch (an equi join), and the exact distance is checked afterwards.  A crowded
cell is spread over several tasks by a salt taken from its row count.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil, degrees, pi, sin

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from wakeline.functions import geo
from wakeline.operators import blocks as B
from wakeline.session import saved

CROWDED = 5000
STATE = ("event_id", "mmsi", "time", "lat", "lon", "sog", "cog")
_SLACK = 1 + 1e-9


def _cells_in_band(band: Column, step: float) -> Column:
    """Grid columns of a latitude band: fewer toward the poles."""
    middle = (band + 0.5) * step - 90.0
    return F.greatest(F.lit(1), F.floor(F.cos(F.radians(middle)) * (360.0 / step))).cast("long")


def _column(lon: Column, n: Column) -> Column:
    return F.floor((lon + 180.0) / (F.lit(360.0) / n))


def with_own_cell(df: DataFrame, step: float) -> DataFrame:
    """Add the grid cell (``band``, ``col``) of each row."""
    df = df.withColumn("band", F.floor((F.col("lat") + 90.0) / step)).withColumn("_n", _cells_in_band(F.col("band"), step))
    return df.withColumn("col", F.pmod(_column(F.col("lon"), F.col("_n")), F.col("_n"))).drop("_n")


def with_reachable_cells(df: DataFrame, radius_km: float, step: float) -> DataFrame:
    """One row per cell that a circle around the row can touch (up to three bands, any longitude)."""
    angle = radius_km / geo.EARTH_KM * _SLACK
    lat, lon, n = F.col("lat"), F.col("lon"), F.col("_n")
    ratio = F.lit(sin(angle)) / F.cos(F.radians(lat))
    half = F.when(F.abs(lat) + degrees(angle) >= 90, 180.0).otherwise(
        F.degrees(F.asin(F.least(F.lit(1.0), ratio))) * _SLACK)
    reach = degrees(angle)
    bands = F.sequence(F.floor((lat - reach + 90.0) / step), F.floor((lat + reach + 90.0) / step))
    df = df.withColumn("_half", half).select(*[c for c in df.columns if c != "band"], "_half", F.explode(bands).alias("band"))
    df = df.filter(F.col("band").between(0, ceil(180.0 / step))).withColumn("_n", _cells_in_band(F.col("band"), step))
    df = df.withColumns({"_lo": _column(lon - F.col("_half"), n), "_hi": _column(lon + F.col("_half"), n)})
    cells = F.when(F.col("_hi") - F.col("_lo") + 1 >= n, F.sequence(F.lit(0).cast("long"), n - 1)).otherwise(
        F.sequence("_lo", "_hi"))
    df = df.select("*", F.explode(cells).alias("_at")).withColumn("col", F.pmod(F.col("_at"), n))
    return df.drop("_half", "_n", "_lo", "_hi", "_at")


def _bucket(bucket_s: int) -> Column:
    return F.floor(F.unix_micros("time") / F.lit(bucket_s * 1_000_000)) * bucket_s


def _salts(mine: DataFrame, key: Sequence[str], crowded: int) -> DataFrame:
    """Cells with more rows than one task should take, and to how many they go."""
    hot = mine.groupBy(*key).agg(F.count("*").alias("n")).filter(F.col("n") > crowded).select(
        *key, F.ceil(F.col("n") / crowded).cast("int").alias("salts"))
    return saved(hot, "crowded")


def _with_vector(df: DataFrame, lat: str, lon: str, label: str) -> DataFrame:
    """Add the place on the unit sphere."""
    phi, lam = F.radians(lat), F.radians(lon)
    return df.withColumns({f"_x{label}": F.cos(phi) * F.cos(lam), f"_y{label}": F.cos(phi) * F.sin(lam), f"_z{label}": F.sin(phi)})


def near_pairs(df: DataFrame, radius_nm: float = 10.0, bucket_s: int = 60, same_vessel: bool = False,
               state: Sequence[str] = STATE, crowded: int = CROWDED, other_state: Sequence[str] | None = None) -> DataFrame:
    """Ordered pairs of rows in one time bucket closer than the radius.

    The first row keeps its column names, the second has ``other_`` names; the
    distance is ``distance_nm``.  ``same_vessel`` also pairs a vessel's own rows.
    ``other_state``: columns kept of the second row, if not those of the first.
    """
    radius_km = radius_nm * geo.KM_PER_NM
    # wide cells need few copies; most of what meets in vain fails a comparison of squared chords
    step = 2 * degrees(radius_km / geo.EARTH_KM) * _SLACK
    other_state = state if other_state is None else other_state
    df = df.select(*state).dropna(subset=["lat", "lon"]).withColumn("bucket", _bucket(bucket_s))
    key = ["bucket", "band", "col"]
    # pairs outgrow their rows, so keep all tasks: partitions merged by input size would be too few
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    mine = with_own_cell(df, step)
    hot = _salts(mine, key, crowded)
    mine = mine.join(hot, key, "left").withColumn(
        "salt", F.when(F.col("salts").isNull(), 0).otherwise(F.pmod(F.hash("event_id"), F.col("salts")))).drop("salts")
    theirs = with_reachable_cells(df.select("bucket", *other_state), radius_km, step).withColumnsRenamed({c: f"other_{c}" for c in other_state})
    theirs = theirs.join(hot, key, "left").withColumn(
        "salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))).drop("salts")
    mine = _with_vector(mine.repartition(tasks, *key, "salt"), "lat", "lon", "")
    theirs = _with_vector(theirs.repartition(tasks, *key, "salt"), "other_lat", "other_lon", "2")
    apart = F.col("event_id") != F.col("other_event_id")
    if not same_vessel:
        apart = apart & (F.col("mmsi") != F.col("other_mmsi"))
    squared = lambda c: (F.col(f"_{c}") - F.col(f"_{c}2")) * (F.col(f"_{c}") - F.col(f"_{c}2"))
    limit = 4 * sin(min(radius_km / geo.EARTH_KM, pi) / 2) ** 2
    met = mine.join(theirs, [*key, "salt"]).filter((squared("x") + squared("y") + squared("z") < limit) & apart)
    distance = geo.haversine_nm(F.col("lat"), F.col("lon"), F.col("other_lat"), F.col("other_lon"))
    return met.select("bucket", *state, *[f"other_{c}" for c in other_state], distance.alias("distance_nm"))


def _in_blocks(df: DataFrame, radius_nm: float, bucket_s: int, same_vessel: bool, state: Sequence[str], crowded: int) -> tuple[DataFrame, list[str]]:
    """Rows dealt into blocks (see ``blocks``) and sorted by the block's key."""
    radius_km = radius_nm * geo.KM_PER_NM
    step = 4 * degrees(radius_km / geo.EARTH_KM) * _SLACK
    key = ["bucket", "band", "col", "salt"]
    whole = ["event_id", "lat", "lon", "time"] + ([] if same_vessel else ["mmsi"])  # a row without them is in no pair
    df = df.dropna(subset=whole).withColumn("bucket", _bucket(bucket_s)).select(*dict.fromkeys(["bucket", *state]))
    mine = with_own_cell(df, step)
    hot = _salts(mine, key[:3], crowded)
    home = mine.withColumns({"_band": F.col("band"), "_col": F.col("col")})
    rows = with_reachable_cells(home, radius_km, step).join(hot, key[:3], "left")
    there = (F.col("band") == F.col("_band")) & (F.col("col") == F.col("_col"))
    turn = F.pmod(F.hash("event_id"), F.coalesce("salts", F.lit(1)))
    rows = rows.withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)))
    rows = rows.withColumn("_home", there & (turn == F.col("salt"))).select(*key, "_home", *state)
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(tasks, *key).sortWithinPartitions(*key), key


def near_summaries(df: DataFrame, radius_nm: float = 10.0, bucket_s: int = 60, same_vessel: bool = False, state: Sequence[str] = STATE,
                   pick: str | None = None, measured: bool = False, crowded: int = CROWDED) -> DataFrame:
    """What the pairs of :func:`near_pairs` amount to for each row that has one, without making them.

    ``n``: number of pairs.  ``pick`` "nearest" (by distance) or "worst" (by closest approach) adds the other row
    under ``other_`` names; where several differ by rounding only, each has a row and ``n`` stands at the first, so
    that the caller compares them exactly.  "worst" and ``measured`` add the least positive ``tcpa_min`` in seconds,
    ``measured`` also ``distance_sum``, ``distance_min`` and ``knots_sum`` and, like "worst", needs rows with sog and cog.
    """
    rows, key = _in_blocks(df, radius_nm, bucket_s, same_vessel, state, crowded)
    kept = [rows.schema[c] for c in state]
    numbers = ["tcpa_min"] if pick == "worst" or measured else []
    numbers += ["distance_sum", "distance_min", "knots_sum"] if measured else []
    fields = kept + ([T.StructField(f"other_{f.name}", f.dataType) for f in kept] if pick else [])
    schema = T.StructType(fields + [T.StructField("n", T.LongType())] + [T.StructField(c, T.DoubleType()) for c in numbers])
    radius_km, state = radius_nm * geo.KM_PER_NM, list(state)

    def run(batches):
        made = (B.summaries(t, state, radius_km, same_vessel, pick, measured) for t in B.blocks(batches, key))
        return B.gathered(t for t in made if t is not None)

    return rows.mapInArrow(run, schema)


def near_triangles(df: DataFrame, radius_nm: float = 10.0, bucket_s: int = 60, same_vessel: bool = False, crowded: int = CROWDED) -> DataFrame:
    """Per bucket with a pair: ``ends``, the sum of degrees in the graph of near pairs, and ``c``, that of the local clustering.

    Row numbers must be unique in their bucket.
    """
    state = ("event_id", "lat", "lon") if same_vessel else ("event_id", "mmsi", "lat", "lon")
    rows, key = _in_blocks(df, radius_nm, bucket_s, same_vessel, state, crowded)
    radius_km = radius_nm * geo.KM_PER_NM

    def run(batches):
        for t in B.blocks(batches, key):
            ends, c = B.triangles(t, radius_km, same_vessel)
            if ends:
                yield pa.RecordBatch.from_pydict({"bucket": t.column("bucket")[:1].combine_chunks(), "ends": [ends], "c": [c]})

    return rows.mapInArrow(run, "bucket long, ends long, c double").groupBy("bucket").agg(F.sum("ends").alias("ends"), F.sum("c").alias("c"))


def with_distance(pairs: DataFrame) -> DataFrame:
    distance = geo.haversine_nm(F.col("lat"), F.col("lon"), F.col("other_lat"), F.col("other_lon"))
    return pairs.withColumn("distance_nm", distance)


def nearest_pairs(df: DataFrame, radius_nm: float = 10.0, bucket_s: int = 60, same_vessel: bool = False,
                  state: Sequence[str] = STATE, crowded: int = CROWDED) -> DataFrame:
    """Of :func:`near_pairs` those that can be a row's nearest, for :func:`nearest_neighbours`."""
    return with_distance(near_summaries(df, radius_nm, bucket_s, same_vessel, state, "nearest", crowded=crowded).drop("n"))


def nearest_neighbours(pairs: DataFrame) -> DataFrame:
    """The closest other row per row (ties: lower row number)."""
    other = [c for c in pairs.columns if c.startswith("other_")]
    return pairs.groupBy("event_id").agg(
        F.min_by(F.struct("distance_nm", *other), F.struct("distance_nm", "other_event_id")).alias("n")
    ).select("event_id", "n.*")


def near_places(df: DataFrame, places: DataFrame, place_id: str, radius_nm: float,
                row_id: str = "event_id") -> DataFrame:
    """(row, place, distance) for every place within the radius, by grid cell."""
    radius_km = radius_nm * geo.KM_PER_NM
    step = degrees(radius_km / geo.EARTH_KM) * _SLACK
    rows = with_own_cell(df.select(row_id, "lat", "lon"), step)
    there = with_reachable_cells(places.select(place_id, "lat", "lon"), radius_km, step)
    there = there.withColumnsRenamed({"lat": "p_lat", "lon": "p_lon"})
    distance = geo.haversine_nm(F.col("lat"), F.col("lon"), F.col("p_lat"), F.col("p_lon"))
    return rows.join(there, ["band", "col"]).select(row_id, place_id, distance.alias("distance_nm")).filter(
        F.col("distance_nm") <= radius_nm)


def in_port(df: DataFrame, ports: DataFrame, radius_nm: float = 1.0, row_id: str = "event_id") -> DataFrame:
    """Flag rows with any port inside the radius."""
    hits = near_places(df, ports, "port_id", radius_nm, row_id).select(row_id).distinct().withColumn("in_port", F.lit(True))
    return df.join(hits, row_id, "left").withColumn("in_port", F.coalesce("in_port", F.lit(False)))


def nearest_place(df: DataFrame, places: DataFrame, place_id: str, out_id: str, out_distance: str,
                  planar: bool = False, row_id: str = "event_id") -> DataFrame:
    """Closest place per row, in km, or in plain degrees if ``planar``.

    Rows without position, and all rows if no place has one, get NULLs.  Among
    equally near places the smallest id wins.
    """
    known = lambda t: t.filter("lat IS NOT NULL AND lon IS NOT NULL AND NOT isnan(lat) AND NOT isnan(lon)")
    spots = known(places.select(place_id, "lat", "lon"))
    if spots.isEmpty():
        return df.withColumns({out_id: F.lit(None).cast(places.schema[place_id].dataType), out_distance: F.lit(None).cast("double")})
    found = _search_rings(known(df), spots, place_id, out_id, out_distance, planar, row_id)
    return df.join(found, row_id, "left")


def _distance(lat1: Column, lon1: Column, lat2: Column, lon2: Column, planar: bool) -> Column:
    if not planar:
        return geo.haversine_km(lat1, lon1, lat2, lon2)
    return F.sqrt((lat1 - lat2) * (lat1 - lat2) + (lon1 - lon2) * (lon1 - lon2))


def _search_rings(df: DataFrame, places: DataFrame, place_id: str, out_id: str, out_distance: str,
                  planar: bool, row_id: str, first: float = 0.25) -> DataFrame:
    """Nearest place by circles that double until every row has one inside.

    A place found inside a circle is the nearest one overall, because every
    place inside that circle was compared.
    """
    spots = places.select(F.col(place_id).alias("_id"), F.col("lat").alias("_lat"), F.col("lon").alias("_lon"))
    left, radius, done = df.select(row_id, "lat", "lon"), first, None
    while True:
        if planar:
            cell = lambda c, s=0: F.floor(F.col(c) / radius) + s
            near = F.array(*[F.struct(cell("_lat", i).alias("cy"), cell("_lon", j).alias("cx")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
            met = left.withColumns({"cy": cell("lat"), "cx": cell("lon")}).join(spots.select("*", F.inline(near)), ["cy", "cx"])
        else:
            km = radius * degrees_to_km()
            step = degrees(km / geo.EARTH_KM) * _SLACK
            there = with_reachable_cells(spots.select("_id", F.col("_lat").alias("lat"), F.col("_lon").alias("lon")), km, step)
            met = with_own_cell(left, step).join(there.withColumnsRenamed({"lat": "_lat", "lon": "_lon"}), ["band", "col"])
        limit = radius if planar else radius * degrees_to_km()
        d = _distance(F.col("lat"), F.col("lon"), F.col("_lat"), F.col("_lon"), planar)
        best = met.withColumn("_d", d).filter(F.col("_d") <= limit).groupBy(row_id).agg(F.min(F.struct("_d", "_id")).alias("_b"))
        best = saved(best.select(row_id, F.col("_b._id").alias(out_id), F.col("_b._d").alias(out_distance)), "ring")
        done = best if done is None else done.unionByName(best)
        left = left.join(best.select(row_id), row_id, "left_anti")
        if left.isEmpty():
            return done
        radius *= 2


def degrees_to_km() -> float:
    return geo.M_PER_DEG / 1000


def nearest_port(df: DataFrame, ports: DataFrame) -> DataFrame:
    return nearest_place(df, ports, "port_id", "port_id", "port_km")
