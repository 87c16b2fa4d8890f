"""Forecasts: dead reckoning, Kalman filters, tree ensembles, user models."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import Column, DataFrame, functions as F, types as T

from wakeline.functions import geo, times
from wakeline.functions.pin import pinned
from wakeline.operators import ordered as O
from wakeline.session import saved

MAX_MPS = 50.0 * geo.KNOTS_TO_MPS
SEGMENT = ("mmsi", "segment_id")


def dead_reckoning(df: DataFrame, horizon: int = 5, keys: Sequence[str] = SEGMENT) -> DataFrame:
    """Forecast every fix ``horizon`` steps ahead at its last velocity, next to the truth.

    The step length is the mean of the last two gaps, speed is capped at 50 kn.
    One row per (sample, step); samples without the full future are left out.
    """
    df = O.with_margins(df, before=2, after=horizon, keys=keys)
    w = O.frame_window(df, keys)
    ahead = w.rowsBetween(1, horizon)
    gap1 = times.seconds_between(F.col("time"), F.lag("time").over(w))
    gap2 = times.seconds_between(F.lag("time").over(w), F.lag("time", 2).over(w))
    df = df.withColumns({
        "_gap": F.greatest(gap1, F.lit(1e-6)),
        "_dt": F.greatest(F.coalesce((gap1 + gap2) / 2, gap1), F.lit(1e-6)),
        "_plat": F.lag("lat").over(w), "_plon": F.lag("lon").over(w),
        "_future": F.collect_list(F.struct("time", "lat", "lon", "sog", "cog")).over(ahead),
    })
    df = O.drop_margins(df).filter((F.size("_future") == horizon) & F.col("_plat").isNotNull())
    dx, dy = geo.to_local(F.col("lat"), F.col("lon"), F.col("_plat"), F.col("_plon"))
    vx, vy = geo.cap_speed(dx / F.col("_gap"), dy / F.col("_gap"), MAX_MPS)
    df = pinned(df, {"_vx": vx, "_vy": vy}).select(
        *keys, F.col("event_id").alias("sample_id"), "time", "lat", "lon", "sog", "cog", "_vx", "_vy", "_dt",
        F.posexplode("_future").alias("_i", "_t"))
    seconds = F.col("_dt") * (F.col("_i") + 1)
    lat, lon = geo.from_local(F.col("_vx") * seconds, F.col("_vy") * seconds, F.col("lat"), F.col("lon"))
    return df.select(
        *keys, "sample_id", (F.col("_i") + 1).alias("step"), F.col("time").alias("origin_time"),
        lat.alias("pred_lat"), lon.alias("pred_lon"), F.col("sog").alias("pred_sog"), F.col("cog").alias("pred_cog"),
        *[F.col(f"_t.{c}").alias(f"true_{c}") for c in ("time", "lat", "lon", "sog", "cog")])


# ------------------------------------------------------------- Kalman filters

# Noise and starting uncertainty of the motion models.
NOISE = {"position": 0.1, "velocity": 0.01, "acceleration": 0.001, "turn": 0.1}
MEASURED_M = 10.0
START = {"position": 100.0, "velocity": 5.0, "acceleration": 1.0, "turn": 0.1}
MAX_ACCELERATION = 0.5
MAX_TURN = np.radians(5.0)


def _let(name: str, fields: dict[str, str], body: str) -> str:
    """SQL that computes a struct once and uses it as ``name`` in the body."""
    return f"element_at(transform(array({_struct(fields)}), {name} -> {body}), 1)"


def _struct(fields: dict[str, str]) -> str:
    return "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in fields.items()) + ")"


def _number(value: float) -> str:
    return f"{float(value)!r}D"


class _Motion:
    """A motion model as SQL over a state struct: ``x0..`` and the cells ``cij`` of its covariance.

    ``move`` is the transition, row by row without its zeros; ``noise`` the process noise. Cells that stay
    zero, as between the axes of the straight models, are never written. ``dt`` names the time step.
    """

    def __init__(self, kind: str):
        self.kind, self.size = kind, {"velocity": 4, "turn": 5, "acceleration": 6}[kind]
        self.iy = 3 if kind == "acceleration" else 2
        self.speed = (1, self.iy + 1)
        if kind == "turn":
            # the turn rate turns the course clockwise: east' = cos east + sin north, north' = cos north - sin east;
            # the way travelled is the integral of that over dt
            self.spread = ["position", "velocity"] * 2 + ["turn"]
            self.move = [{0: "1D", 1: "m.along", 3: "m.across"}, {1: "m.c", 3: "m.s"}, {2: "1D", 1: "-m.across", 3: "m.along"}, {1: "-m.s", 3: "m.c"}, {4: "1D"}]
            power = ["m.dt * m.dt", "m.dt"] * 2 + ["m.dt"]
            self.noise = {(i, i): f"{_number(NOISE[n] ** 2)} * {power[i]}" for i, n in enumerate(self.spread)}
        else:
            one = ["1D", "m.dt", "m.dt * m.dt / 2"]
            n = self.size // 2
            self.spread = ["position", "velocity", "acceleration"][:n] * 2
            self.move = [{k + j: one[j - i] for j in range(i, n)} for k in (0, n) for i in range(n)]
            input_ = ["(m.dt * m.dt / 2)", "m.dt", "1D"]
            self.noise = {(k + i, k + j): f"{_number(NOISE[kind] ** 2)} * {input_[i]} * {input_[j]}" for k in (0, n) for i in range(n) for j in range(i, n)}
        cells = {(i, i) for i in range(self.size)}
        while True:  # what transition and noise fill
            more = cells | set(self.noise) | {(i, j) for i in range(self.size) for j in range(i, self.size)
                                              if any((min(k, m), max(k, m)) in cells for k in self.move[i] for m in self.move[j])}
            if more == cells:
                break
            cells = more
        self.cells = sorted(cells)

    def cell(self, name: str, i: int, j: int) -> str | None:
        pair = (min(i, j), max(i, j))
        return f"{name}.c{pair[0]}{pair[1]}" if pair in self.cells else None

    def state(self, x: dict[int, str], cov: dict[tuple[int, int], str]) -> dict[str, str]:
        return {f"x{i}": v for i, v in sorted(x.items())} | {f"c{i}{j}": v for (i, j), v in sorted(cov.items())}

    def advanced(self, of: str, dt: str, name: str, body: str) -> str:
        """``body`` with ``name``, the state ``of`` moved on by ``dt``."""
        rate = f"if(abs({of}.x4) > 1e-6D, {of}.x4, 1e-6D)"
        x = {i: " + ".join(f"{c} * {of}.x{k}" for k, c in row.items()) for i, row in enumerate(self.move)}
        cov = {}
        for i, j in self.cells:
            terms = [f"{a} * {b} * {c}" for k, a in self.move[i].items() for m, b in self.move[j].items() if (c := self.cell(of, k, m))]
            cov[i, j] = " + ".join(terms + ([self.noise[i, j]] if (i, j) in self.noise else []))
        moved = _let(name, self.state(x, cov), body)
        if self.kind != "turn":
            return _let("m", {"dt": dt}, moved)
        swept = _let("m", {"dt": "q.dt", "s": "sin(q.w * q.dt)", "c": "cos(q.w * q.dt)", "along": "sin(q.w * q.dt) / q.w", "across": "(1D - cos(q.w * q.dt)) / q.w"}, moved)
        return _let("q", {"dt": dt, "w": rate}, swept)

    def corrected(self, of: str, x: str, y: str) -> str:
        """The state after seeing a position; ``of`` is the state moved to its time."""
        iy, seen = self.iy, _number(MEASURED_M**2)
        cross = self.cell(of, 0, iy)
        spread = {"a": f"{of}.c00 + {seen}", "b": cross or "0D", "d": f"{self.cell(of, iy, iy)} + {seen}", "x": f"{x} - {of}.x0", "y": f"{y} - {of}.x{iy}"}
        zero = lambda c: c or "0D"
        gain = {}
        for i in range(self.size):
            cx, cy = zero(self.cell(of, i, 0)), zero(self.cell(of, i, iy))
            gain[f"x{i}"] = f"({cx} * h.d - {cy} * h.b) / (h.a * h.d - h.b * h.b)"
            gain[f"y{i}"] = f"({cy} * h.a - {cx} * h.b) / (h.a * h.d - h.b * h.b)"
        state = {i: f"{of}.x{i} + g.x{i} * h.x + g.y{i} * h.y" for i in range(self.size)}
        cov = {(i, j): f"{self.cell(of, i, j)} - g.x{i} * {zero(self.cell(of, 0, j))} - g.y{i} * {zero(self.cell(of, iy, j))}" for i, j in self.cells}
        return _let("h", spread, _let("g", gain, _struct(self.state(state, cov))))

    def capped(self, of: str) -> str:
        """The state within the limits of speed, acceleration and turn rate."""
        def limit(i: int, j: int, most: float) -> str:
            long = f"sqrt({of}.x{i} * {of}.x{i} + {of}.x{j} * {of}.x{j})"
            return f"if({long} > {_number(most)}, {_number(most)} / {long}, 1D)"

        x = {i: f"{of}.x{i}" for i in range(self.size)}
        for i in self.speed:
            x[i] = f"{of}.x{i} * l.v"
        limits = {"v": limit(*self.speed, MAX_MPS)}
        if self.kind == "acceleration":
            limits["a"] = limit(2, 5, MAX_ACCELERATION)
            x |= {i: f"{of}.x{i} * l.a" for i in (2, 5)}
        if self.kind == "turn":
            x[4] = f"greatest(least({of}.x4, {_number(MAX_TURN)}), {_number(-MAX_TURN)})"
        return _let("l", limits, _struct(self.state(x, {c: self.cell(of, *c) for c in self.cells})))

    def begun(self) -> str:
        """The state before filtering, from the arrays x, y, dt, vx, vy: last position and velocity, latest change."""
        last = {"position": "element_at({0}, -1)", "velocity": "element_at(v{0}, -1)",
                "acceleration": "if(size(v{0}) > 1, (element_at(v{0}, -1) - try_element_at(v{0}, -2)) / element_at(dt, -1), 0D)"}
        x = {i: last[n].format("y" if i >= self.iy else "x") if n != "turn" else "turn" for i, n in enumerate(self.spread)}
        cov = {(i, j): _number(START[self.spread[i]] ** 2) if i == j else "0D" for i, j in self.cells}
        return _struct(self.state(x, cov))


def kalman_forecast(sequences: DataFrame, horizon: int, kind: str = "velocity", key: str = "sample_id") -> DataFrame:
    """Kalman forecast of each row's ``input`` track (models velocity, turn, acceleration).

    A recursive filter over the latest five fixes (three for turn) as a fold over the row's array, then
    ``horizon`` steps of the mean of the last two gaps. Tracks may differ in length; one of two fixes begins
    without turn or acceleration, one with fewer fixes or an unknown position has no forecast.
    """
    model, latest = _Motion(kind), 3 if kind == "turn" else 5
    f = lambda name, of: F.expr(f"transform(input, p -> {of})").alias(name)
    known = sequences.filter("size(input) > 1 and forall(input, p -> p.lat is not null and p.lon is not null and p.time is not null)")
    df = known.select(key, f("lat", "p.lat"), f("lon", "p.lon"), f("us", "unix_micros(p.time)"))
    mean = lambda c: F.expr(f"aggregate({c}, 0D, (a, v) -> a + v) / size({c})")
    df = pinned(df, {"ref_lat": mean("lat"), "ref_lon": mean("lon")})
    df = pinned(df, {"ky": F.lit(geo.M_PER_DEG), "kx": F.lit(geo.M_PER_DEG) * F.cos(F.radians("ref_lat"))})
    df = pinned(df, {"x": F.expr("transform(lon, v -> (v - ref_lon) * kx)"), "y": F.expr("transform(lat, v -> (v - ref_lat) * ky)"),
                     "dt": F.expr("transform(sequence(1, size(us) - 1), i -> greatest((us[i] - us[i - 1]) / 1e6D, 1e-6D))")})
    df = pinned(df, {f"v{c}": F.expr(f"transform(dt, (w, i) -> ({c}[i + 1] - {c}[i]) / w)") for c in "xy"})
    if kind == "turn":
        df = pinned(df, {"course": F.expr("transform(vx, (v, i) -> atan2(v, vy[i]))")})
        # a track that turns straight back on itself turns clockwise, whatever the last bits of its courses say
        swing = f"pmod(course[i] - course[i - 1] + {_number(np.pi - 1e-9)}, {_number(2 * np.pi)}) - {_number(np.pi - 1e-9)}"
        df = pinned(df, {"turns": F.expr(f"if(size(course) > 1, slice(transform(sequence(1, greatest(size(course) - 1, 1)), i -> if(i < size(course), ({swing}) / dt[i], 0D)), -least(3, size(course) - 1), 3), array(0D))")})
        df = pinned(df, {"turn": mean("turns")})
    seen = F.expr(f"transform(sequence(greatest(1, size(x) - {latest}), size(x) - 1), i -> named_struct('w', dt[i - 1], 'x', x[i], 'y', y[i]))")
    df = pinned(df, {"begun": F.expr(model.begun()), "seen": seen, "gap": mean("slice(dt, -least(2, size(dt)), 2)")})
    df = pinned(df, {"state": F.expr(f"aggregate(seen, begun, (s, z) -> {model.advanced('s', 'z.w', 'p', model.corrected('p', 'z.x', 'z.y'))})")})
    ahead = model.advanced("s.now", "gap", "p", model.capped("p"))
    steps = f"aggregate(sequence(1, {horizon}), named_struct('now', state, 'out', array()), (s, i) -> " + _let(
        "n", {"now": ahead}, "named_struct('now', n.now, 'out', concat(s.out, array(n.now)))") + ", s -> s.out)"
    steps = steps.replace("array())", f"slice(array(state), 1, 0))")
    out = df.select(key, "ref_lat", "ref_lon", "kx", "ky", F.posexplode(F.expr(steps)).alias("_i", "_s"))
    at = lambda c: F.col(f"_s.{c}")
    iy = model.iy
    cross = at(f"c0{iy}") if (0, iy) in model.cells else F.lit(0.0)
    return out.select(key, (F.col("_i") + 1).alias("step"), (at(f"x{iy}") / F.col("ky") + F.col("ref_lat")).alias("pred_lat"),
                      (at("x0") / F.col("kx") + F.col("ref_lon")).alias("pred_lon"), at("c00").alias("var_x"), at(f"c{iy}{iy}").alias("var_y"), cross.alias("cov_xy"))


# ------------------------------------------------------------- tree models

def _features(cols: Sequence[str]) -> list[str]:
    names = []
    for c in cols:
        names += [c, f"{c}_lag1", f"{c}_lag2", f"{c}_lag3", f"{c}_diff"]
        names += [f"{c}_{s}{r}" for r in (3, 5, 10) for s in ("mean", "std")]
    return names


def fit_forest(matrix: DataFrame, horizons: Sequence[int] = (1, 3), cols: Sequence[str] = ("lat", "lon"),
               trees: int = 20, depth: int = 6, seed: int = 42) -> dict:
    """One random forest per (horizon, column) on design-matrix rows with delta targets."""
    names = _features(cols)
    # every model passes over the rows several times, so they are written once
    matrix = saved(matrix.select(*names, *[f"{c}_t{h}" for h in horizons for c in cols]), "matrix")
    ready = VectorAssembler(inputCols=names, outputCol="features", handleInvalid="skip").transform(matrix)
    return {(h, c): RandomForestRegressor(featuresCol="features", labelCol=f"{c}_t{h}", predictionCol=f"pred_{c}_t{h}",
                                          numTrees=trees, maxDepth=depth, seed=seed).fit(
        ready.filter(F.col(f"{c}_t{h}").isNotNull()).select("features", f"{c}_t{h}")) for h in horizons for c in cols}


def apply_forest(models: dict, matrix: DataFrame, cols: Sequence[str] = ("lat", "lon")) -> DataFrame:
    """Predicted change and absolute value per horizon."""
    df = VectorAssembler(inputCols=_features(cols), outputCol="features", handleInvalid="skip").transform(matrix)
    for (h, c), model in models.items():
        df = model.transform(df).withColumn(f"pred_{c}_h{h}", F.col(c) + F.col(f"pred_{c}_t{h}"))
    return df.drop("features")


def _squared_from(centre: Column):
    # a second parameter of the function itself would be taken for the element's index
    return lambda v: (v - centre) * (v - centre)


def _state_features(cols: Sequence[str]) -> dict[str, Column]:
    """The same features from arrays ``hist_*`` holding the latest ten values."""
    out = {}
    for c in cols:
        h = F.col(f"hist_{c}")
        now = F.element_at(h, -1)
        out |= {c: now, **{f"{c}_lag{k}": F.element_at(h, -1 - k) for k in (1, 2, 3)}, f"{c}_diff": now - F.element_at(h, -2)}
        for r in (3, 5, 10):
            part = F.slice(h, F.greatest(F.size(h) - r + 1, F.lit(1)), r)
            n = F.size(part)
            mean = F.aggregate(part, F.lit(0.0), lambda a, v: a + v) / n
            out[f"{c}_mean{r}"] = mean
            out[f"{c}_std{r}"] = F.sqrt(F.aggregate(F.transform(part, _squared_from(mean)), F.lit(0.0), lambda a, v: a + v) / n)
    return out


def roll_forest(models: dict, states: DataFrame, horizon: int, cols: Sequence[str] = ("lat", "lon")) -> DataFrame:
    """Autoregressive forecast: each predicted step joins the history of the next one.

    ``states`` holds ``sample_id`` and ``hist_*`` arrays; uses the one-step models.
    """
    df = states
    assembler = VectorAssembler(inputCols=_features(cols), outputCol="features", handleInvalid="skip")
    steps = []
    for h in range(1, horizon + 1):
        df = assembler.transform(pinned(df, _state_features(cols)))
        for c in cols:
            df = models[(1, c)].transform(df)
        df = pinned(df, {f"step{h}_{c}": F.col(c) + F.col(f"pred_{c}_t1") for c in cols})
        kept = lambda c: F.when(F.size(f"hist_{c}") >= 10, F.slice(f"hist_{c}", -9, 9)).otherwise(F.col(f"hist_{c}"))
        df = pinned(df, {f"hist_{c}": F.concat(kept(c), F.array(f"step{h}_{c}")) for c in cols})
        df = df.drop("features", *_features(cols), *[f"pred_{c}_t1" for c in cols])
        steps.append(F.struct(F.lit(h).alias("step"), *[F.col(f"step{h}_{c}").alias(f"pred_{c}") for c in cols]))
    return df.select("sample_id", F.inline(F.array(*steps)))


def importances(models: dict, cols: Sequence[str] = ("lat", "lon")) -> list[tuple[int, str, str, float]]:
    """(horizon, target, feature, importance) of every fitted forest."""
    names = _features(cols)
    return [(h, c, n, float(v)) for (h, c), m in models.items() for n, v in zip(names, m.featureImportances.toArray())]


def _flat(cols: Sequence[str]) -> Column:
    return array_to_vector(F.flatten(F.transform("input", lambda p: F.array(*[p[c] for c in cols]))))


def fit_boosted(sequences: DataFrame, steps: Sequence[int], targets: Sequence[str] = ("lat", "lon"),
                cols: Sequence[str] = ("lat", "lon", "cog"), rounds: int = 10, depth: int = 4, seed: int = 42) -> dict:
    """One boosted regressor per (step, target) on flattened windows."""
    rows = sequences.select(_flat(cols).alias("features"),
                            *[F.element_at("target", s)[c].alias(f"y_{c}_{s}") for s in steps for c in targets])
    rows = saved(rows, "windows")
    return {(s, c): GBTRegressor(featuresCol="features", labelCol=f"y_{c}_{s}", predictionCol=f"pred_{c}_{s}",
                                 maxIter=rounds, maxDepth=depth, seed=seed).fit(rows.select("features", f"y_{c}_{s}"))
            for s in steps for c in targets}


def apply_boosted(models: dict, sequences: DataFrame, cols: Sequence[str] = ("lat", "lon", "cog")) -> DataFrame:
    df = sequences.withColumn("features", _flat(cols))
    for model in models.values():
        df = model.transform(df)
    return df.drop("features")


def score_batches(df: DataFrame, model: Callable[[pd.DataFrame], pd.Series], key: str = "sample_id",
                  out: str = "score") -> DataFrame:
    """Apply a user model batch by batch; a failing sample gets an error, not the job.

    A batch that fails is scored row by row to find the bad sample.
    """
    schema = T.StructType([df.schema[key], T.StructField(out, T.DoubleType()), T.StructField("error", T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            try:
                yield pd.DataFrame({key: b[key], out: model(b).astype(float).to_numpy(), "error": None})
            except Exception:  # noqa: BLE001
                rows = []
                for i in range(len(b)):
                    one = b.iloc[i:i + 1]
                    try:
                        rows.append((one[key].iloc[0], float(model(one).iloc[0]), None))
                    except Exception as e:  # noqa: BLE001
                        rows.append((one[key].iloc[0], None, f"{type(e).__name__}: {e}"))
                yield pd.DataFrame(rows, columns=schema.names)

    return df.mapInPandas(run, schema)
