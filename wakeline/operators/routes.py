"""Track simplification, waypoint clusters and the route graph between them."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from wakeline.operators import ordered as O
from wakeline.session import saved

SEGMENT = ("mmsi", "segment_id")
LOCAL_POINTS = 100_000


# ------------------------------------------------------------- simplification

def _keep(lat: np.ndarray, lon: np.ndarray, eps: float) -> np.ndarray:
    """Which points of one track survive: ends, and farthest points beyond eps."""
    keep = np.zeros(len(lat), dtype=bool)
    keep[[0, -1]] = True
    todo = [(0, len(lat) - 1)]
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        d = _chord_distance(lat[a + 1:b], lon[a + 1:b], lat[a], lon[a], lat[b], lon[b])
        far = int(np.argmax(d))
        if d[far] > eps:
            cut = a + 1 + far
            keep[cut] = True
            todo += [(a, cut), (cut, b)]
    return keep


def _chord_distance(x, y, x1, y1, x2, y2):
    if x1 == x2 and y1 == y2:
        return np.sqrt((x - x1) ** 2 + (y - y1) ** 2)
    area = np.abs((y2 - y1) * x - (x2 - x1) * y + x2 * y1 - y2 * x1)
    return area / np.sqrt((y2 - y1) ** 2 + (x2 - x1) ** 2)


def _local_simplify(points: DataFrame, keys: Sequence[str], eps: float) -> DataFrame:
    """Simplify many short tracks per task.

    Tracks are kept together and in order by the shuffle; a batch of rows may end
    inside a track, so its last track waits for the next batch.
    """
    keys = list(keys)

    def done(rows: pd.DataFrame) -> pd.DataFrame:
        lat, lon = rows["lat"].to_numpy(), rows["lon"].to_numpy()
        keep = np.zeros(len(rows), dtype=bool)
        starts = _starts(rows)
        for a, b in zip(starts, [*starts[1:], len(rows)]):
            keep[a:b] = _keep(lat[a:b], lon[a:b], eps)
        return rows[keep]

    def _starts(rows: pd.DataFrame) -> list[int]:
        change = np.ones(len(rows), dtype=bool)
        change[1:] = np.any([rows[k].to_numpy()[1:] != rows[k].to_numpy()[:-1] for k in keys], axis=0)
        return np.flatnonzero(change).tolist()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting = None
        for batch in batches:
            if waiting is not None:
                batch = pd.concat([waiting, batch], ignore_index=True)
            if len(batch) == 0:
                continue
            last = _starts(batch)[-1]
            if last:
                yield done(batch.iloc[:last])
            waiting = batch.iloc[last:]
        if waiting is not None and len(waiting):
            yield done(waiting)

    tracks = points.repartition(*keys).sortWithinPartitions(*keys, "position")
    return tracks.mapInPandas(run, points.schema)


def _spark_distance() -> Column:
    x, y = F.col("lat"), F.col("lon")
    x1, y1, x2, y2 = (F.col(c) for c in ("a.lat", "a.lon", "b.lat", "b.lon"))
    area = F.abs((y2 - y1) * x - (x2 - x1) * y + x2 * y1 - y2 * x1)
    line = F.sqrt((y2 - y1) * (y2 - y1) + (x2 - x1) * (x2 - x1))
    point = F.sqrt((x - x1) * (x - x1) + (y - y1) * (y - y1))
    return F.when((x1 == x2) & (y1 == y2), point).otherwise(area / line)


def simplify(segments: DataFrame, eps: float = 0.03, local_points: int = LOCAL_POINTS) -> DataFrame:
    """Douglas-Peucker per segment, in degrees: the points that survive.

    Segments of up to ``local_points`` are done one per task.  Longer ones are
    first split by Spark, level by level, at their farthest points, until every
    piece is short enough; a piece depends on its own points only, so the result
    is the same.
    """
    cols = ["event_id", "mmsi", "segment_id", "time", "lat", "lon", "position"]
    # the ordered points are read twice (short and long tracks), so they are written once
    points = saved(O.with_positions(segments, SEGMENT).select(*cols, "segment_points"), "points")
    short = _local_simplify(points.filter(F.col("segment_points") <= local_points).drop("segment_points"), SEGMENT, eps)
    long = points.filter(F.col("segment_points") > local_points).drop("segment_points")
    if long.isEmpty():
        return short
    return short.unionByName(_simplify_long(long, eps, local_points))


def _simplify_long(points: DataFrame, eps: float, local_points: int) -> DataFrame:
    place = F.struct(*[F.col(c) for c in points.columns])
    pieces = saved(points.groupBy(*SEGMENT).agg(
        F.min_by(place, "position").alias("a"), F.max_by(place, "position").alias("b")), "pieces")
    ends = pieces.select(F.col("a.*")).unionByName(pieces.select(F.col("b.*")))
    kept = [ends]
    border = pieces.select(*SEGMENT, F.col("a.position").alias("start"), F.col("b.position").alias("stop"))
    inner = points.join(border, list(SEGMENT)).filter((F.col("position") > F.col("start")) & (F.col("position") < F.col("stop"))).drop("stop")
    inner = saved(inner, "inner")
    pieces = pieces.withColumn("start", F.col("a.position"))
    key = [*SEGMENT, "start"]
    while True:
        measured = inner.join(pieces.select(*key, "a", "b"), key).withColumn("d", _spark_distance())
        far = measured.groupBy(*key).agg(
            F.max_by(F.struct(*[F.col(c) for c in points.columns]), F.struct("d", -F.col("position"))).alias("far"),
            F.max("d").alias("d"), F.count("*").alias("n"))
        cuts = saved(far.filter(F.col("d") > eps), "cuts")
        if cuts.isEmpty():
            break
        kept.append(cuts.select("far.*"))
        divided = pieces.join(cuts.select(*key, "far"), key)
        left = divided.select(*SEGMENT, "start", "a", F.col("far").alias("b"))
        right = divided.select(*SEGMENT, F.col("far.position").alias("start"), F.col("far").alias("a"), "b")
        pieces = saved(left.unionByName(right), "pieces")
        at = F.col("cut")
        moved = inner.join(cuts.select(*key, F.col("far.position").alias("cut")), key)
        moved = moved.filter(F.col("position") != at).withColumn("start", F.when(F.col("position") > at, at).otherwise(F.col("start")))
        inner = saved(moved.drop("cut"), "inner")
        sizes = inner.groupBy(*key).agg(F.count("*").alias("n"))
        small = sizes.filter(F.col("n") <= local_points).drop("n")
        # short pieces, with their ends, are finished in one task each
        done = pieces.join(small, key, "left_semi")
        body = inner.join(small, key, "left_semi").select(*key, *[c for c in points.columns if c not in SEGMENT])
        rims = [done.select(*key, *[F.col(f"{e}.{c}").alias(c) for c in points.columns if c not in SEGMENT]) for e in ("a", "b")]
        whole = body.unionByName(rims[0]).unionByName(rims[1])
        kept.append(saved(_local_simplify(whole, key, eps).select(*points.columns), "short"))
        inner = inner.join(small, key, "left_anti")
        pieces = pieces.join(small, key, "left_anti")
        if inner.isEmpty():
            break
    out = kept[0]
    for k in kept[1:]:
        out = out.unionByName(k)
    return out.dropDuplicates(["event_id"])


# ------------------------------------------------------------- waypoint clusters

_REACH = [(i, j) for i in range(-2, 3) for j in range(-2, 3) if abs(i) + abs(j) < 4]


def _cell(side: float) -> list[Column]:
    return [F.floor(F.col("lat") / side).alias("cy"), F.floor(F.col("lon") / side).alias("cx")]


def _around() -> Column:
    """The cells whose points can lie within eps of the row's cell."""
    return F.inline(F.array(*[F.struct((F.col("cy") + i).alias("ny"), (F.col("cx") + j).alias("nx")) for i, j in _REACH]))


def _planar2(a: str, b: str) -> Column:
    dy, dx = F.col(f"{a}lat") - F.col(f"{b}lat"), F.col(f"{a}lon") - F.col(f"{b}lon")
    return dy * dy + dx * dx


def cluster_points(points: DataFrame, eps: float, min_samples: int) -> DataFrame:
    """DBSCAN in plain degrees: distinct (lat, lon), their count ``n`` and ``cluster`` (noise left out).

    Cells have side eps / sqrt(2), so points of a cell are all within eps of each
    other: a cell with ``min_samples`` points needs no distances at all, and a
    core cell is one node of the cluster graph.  Only points of thin cells (fewer
    than ``min_samples``) look for neighbours, and links between crowded cells
    are decided by representatives (:func:`_links`).  A border point joins the
    cluster of its nearest core point.
    """
    side = eps / 2**0.5
    spots = points.groupBy("lat", "lon").agg(F.count("*").alias("n")).select("lat", "lon", "n", *_cell(side))
    spots = saved(spots, "spots")
    crowd = spots.groupBy("cy", "cx").agg(F.sum("n").alias("held"))
    spots = spots.join(crowd, ["cy", "cx"])
    thin, dense = spots.filter(F.col("held") < min_samples), spots.filter(F.col("held") >= min_samples)
    there = spots.select(F.col("cy").alias("ny"), F.col("cx").alias("nx"), F.col("lat").alias("t_lat"), F.col("lon").alias("t_lon"), F.col("n").alias("t_n"))
    near = thin.withColumnsRenamed({"lat": "s_lat", "lon": "s_lon"}).select("s_lat", "s_lon", "n", "cy", "cx", _around()).join(there, ["ny", "nx"])
    counted = near.filter(_planar2("s_", "t_") <= eps * eps).groupBy("s_lat", "s_lon", "cy", "cx", "n").agg(F.sum("t_n").alias("seen"))
    judged = counted.select(F.col("s_lat").alias("lat"), F.col("s_lon").alias("lon"), "n", "cy", "cx", (F.col("seen") >= min_samples).alias("core"))
    judged = saved(judged.unionByName(dense.select("lat", "lon", "n", "cy", "cx", F.lit(True).alias("core"))), "judged")
    core = judged.filter("core").drop("core")
    labels = components(core.select("cy", "cx").distinct(), _links(core, eps))
    core = core.join(labels, ["cy", "cx"])
    target = core.select(F.col("cy").alias("ny"), F.col("cx").alias("nx"), F.col("lat").alias("t_lat"), F.col("lon").alias("t_lon"), "cluster")
    edge = judged.filter("not core").withColumnsRenamed({"lat": "s_lat", "lon": "s_lon"}).select("s_lat", "s_lon", "n", _around()).join(target, ["ny", "nx"])
    edge = edge.withColumn("d", _planar2("s_", "t_")).filter(F.col("d") <= eps * eps).groupBy("s_lat", "s_lon", "n").agg(
        F.min_by("cluster", F.struct("d", "cluster")).alias("cluster"))
    return core.select("lat", "lon", "n", "cluster").unionByName(
        edge.select(F.col("s_lat").alias("lat"), F.col("s_lon").alias("lon"), "n", "cluster"))


def _links(core: DataFrame, eps: float, split: int = 4) -> DataFrame:
    """Pairs of core cells that hold two core points within eps.

    Each level cuts the cells finer and compares one point per subcell: a close
    pair proves the link, subcells too far apart are dropped, and only the pairs
    still undecided go on with the next level.  Where every subcell holds one
    point the comparison is the exact one.
    """
    cells = core.select("cy", "cx").distinct()
    other = cells.select(F.col("cy").alias("ny"), F.col("cx").alias("nx"))
    open_pairs = cells.select("cy", "cx", _around()).join(other, ["ny", "nx"]).filter(F.struct("cy", "cx") < F.struct(F.col("ny").alias("cy"), F.col("nx").alias("cx")))
    open_pairs = saved(open_pairs.select("cy", "cx", "ny", "nx"), "pairs")
    pair = ["cy", "cx", "ny", "nx"]
    side, proven, undecided = eps / 2**0.5, [], None
    while True:
        side = side / split
        sub = lambda c: F.floor(F.col(c) / side)
        boxes = core.select("cy", "cx", sub("lat").alias("sy"), sub("lon").alias("sx"), "lat", "lon").groupBy("cy", "cx", "sy", "sx").agg(
            F.min(F.struct("lat", "lon")).alias("p"), F.min("lat").alias("y0"), F.max("lat").alias("y1"), F.min("lon").alias("x0"), F.max("lon").alias("x1"))
        a = boxes.select("cy", "cx", *[F.col(c).alias(f"a_{c}") for c in ("sy", "sx", "p", "y0", "y1", "x0", "x1")])
        b = boxes.select(F.col("cy").alias("ny"), F.col("cx").alias("nx"), *[F.col(c).alias(f"b_{c}") for c in ("sy", "sx", "p", "y0", "y1", "x0", "x1")])
        if undecided is None:
            met = open_pairs.join(a, ["cy", "cx"]).join(b, ["ny", "nx"])
        else:
            up = lambda c: F.floor(F.col(c) / split)
            a, b = (d.withColumns({f"{m}_uy": up(f"{m}_sy"), f"{m}_ux": up(f"{m}_sx")}) for d, m in ((a, "a"), (b, "b")))
            met = undecided.join(a, ["cy", "cx", "a_uy", "a_ux"]).join(b, ["ny", "nx", "b_uy", "b_ux"])
        gap = lambda lo, hi: F.greatest(F.col(f"b_{lo}") - F.col(f"a_{hi}"), F.col(f"a_{lo}") - F.col(f"b_{hi}"), F.lit(0.0))
        closest = gap("y0", "y1") * gap("y0", "y1") + gap("x0", "x1") * gap("x0", "x1")
        dy, dx = F.col("a_p.lat") - F.col("b_p.lat"), F.col("a_p.lon") - F.col("b_p.lon")
        single = (F.col("a_y0") == F.col("a_y1")) & (F.col("a_x0") == F.col("a_x1")) & (F.col("b_y0") == F.col("b_y1")) & (F.col("b_x0") == F.col("b_x1"))
        met = saved(met.select(*pair, "a_sy", "a_sx", "b_sy", "b_sx", (dy * dy + dx * dx <= eps * eps).alias("close"),
                               ((closest <= eps * eps) & ~single).alias("open")).filter("close OR open"), "met")
        found = met.filter("close").select(*pair).distinct()
        proven.append(found)
        undecided = met.filter("open").join(found, pair, "left_anti").select(
            *pair, F.col("a_sy").alias("a_uy"), F.col("a_sx").alias("a_ux"), F.col("b_sy").alias("b_uy"), F.col("b_sx").alias("b_ux"))
        if undecided.isEmpty():
            break
    out = proven[0]
    for p in proven[1:]:
        out = out.unionByName(p)
    return out


def components(cells: DataFrame, links: DataFrame) -> DataFrame:
    """Connected components of cells: ``cluster`` is the smallest cell of each.

    Labels spread along links and then jump to their label's label, so long
    chains take few rounds; every round is written out.
    """
    name = lambda y, x: F.concat_ws(":", F.format_string("%020d", F.col(y) + 10**15), F.format_string("%020d", F.col(x) + 10**15))
    labels = saved(cells.select("cy", "cx", name("cy", "cx").alias("cell")).withColumn("cluster", F.col("cell")), "labels")
    e = links.select(name("cy", "cx").alias("u"), name("ny", "nx").alias("v"))
    edges = saved(e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))), "edges")
    while True:
        heard = edges.join(labels.select(F.col("cell").alias("v"), F.col("cluster").alias("other")), "v").groupBy("u").agg(F.min("other").alias("other"))
        spread = labels.join(heard.withColumnRenamed("u", "cell"), "cell", "left").withColumn("next", F.least("cluster", "other"))
        jump = spread.select(F.col("cell").alias("next"), F.col("next").alias("beyond"))
        stepped = saved(spread.join(jump, "next", "left").select(
            "cy", "cx", "cell", F.least("next", "beyond").alias("cluster"), (F.least("next", "beyond") != F.col("cluster")).alias("moved")), "labels")
        labels = stepped.drop("moved")
        if stepped.filter("moved").isEmpty():
            return labels.select("cy", "cx", "cluster")


def waypoints(clustered: DataFrame) -> DataFrame:
    """Centroid and size of every cluster, numbered by cluster name."""
    n = F.col("n")
    out = clustered.groupBy("cluster").agg(
        (F.sum(F.col("lat") * n) / F.sum(n)).alias("lat"), (F.sum(F.col("lon") * n) / F.sum(n)).alias("lon"), F.sum(n).alias("points"))
    return out.select(F.col("cluster").alias("waypoint_id"), "lat", "lon", "points")


def route_graph(tagged: DataFrame) -> DataFrame:
    """Undirected edges between waypoints visited one after the other, weighted by count.

    ``tagged`` are segment rows with their ``waypoint_id``.
    """
    df = O.with_next(tagged, ["waypoint_id"], keys=SEGMENT)
    here, there = F.col("waypoint_id"), F.col("next.waypoint_id")
    hops = df.filter(there.isNotNull() & (here != there))
    return hops.groupBy(F.least(here, there).alias("a"), F.greatest(here, there).alias("b")).agg(F.count("*").alias("weight"))
