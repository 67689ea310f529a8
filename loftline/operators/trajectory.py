"""Track operators: speed, gates, smoothing, gap filling, as-of interpolation, runs and dwell times."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

LEAST_DT = 0.01


def _by(order: list[str], keys: list[str] | None = None):
    return W.partitionBy(*(keys or ["track_id"])).orderBy(*order)


def step_speed(track: DataFrame, ground: Column | float = 1.0) -> DataFrame:
    """track (track_id, seq, t, x, y) with speed: distance to the row before over at least LEAST_DT seconds."""
    w = _by(["seq"])
    scale = ground if isinstance(ground, Column) else F.lit(ground)
    step = F.hypot(F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w)) * scale
    return track.withColumn("speed", step / F.greatest(F.col("t") - F.lag("t").over(w), F.lit(LEAST_DT)))


def outliers_raw(track: DataFrame, most: float, z: float, least_delta: float = 15.0, window: int = 10) -> DataFrame:
    """With is_outlier over a window of raw speeds: too fast, or far from the mean of the speeds before.

    The standard deviation is that of a population, at least 1; fewer than two speeds before make no outlier by z.
    """
    before = _by(["seq"]).rowsBetween(-(window - 1), -1)
    rows = step_speed(track)
    mean, sd, n = (f("speed").over(before) for f in (F.avg, F.stddev_pop, F.count))
    away = F.abs(F.col("speed") - mean)
    odd = (n >= 2) & (away / F.greatest(sd, F.lit(1.0)) > z) & (away > least_delta)
    return rows.withColumn("is_outlier", F.coalesce((F.col("speed") > most) | odd, F.lit(False)))


def ema(track: DataFrame, column: str, alpha: float = 0.7, low: float = 0.3, high: float = 3.5) -> DataFrame:
    """Per track the final exponential mean: the first value in range starts it, values out of range are skipped.

    A fold over the ordered values of a track; alpha weighs the old mean.
    """
    rows = track.groupBy("track_id").agg(F.array_sort(F.collect_list(F.struct("seq", F.col(column).alias("v")))).alias("a"))

    def step(acc: Column, e: Column) -> Column:
        v = e["v"]
        new = F.when(acc.isNull(), v).otherwise(acc * alpha + v * (1 - alpha))
        return F.when(v.isNull() | (v < low) | (v > high), acc).otherwise(new)

    return rows.select("track_id", F.aggregate("a", F.lit(None).cast("double"), step).alias("ema"))


def fill_linear(rows: DataFrame, at: str, columns: list[str], keys: list[str]) -> DataFrame:
    """rows with gaps (nulls of all columns) filled on the line between known neighbours, by `at`; edges repeat them.

    A row is known when the first column is.
    """
    known = F.col(columns[0]).isNotNull()
    back = W.partitionBy(*keys).orderBy(at).rowsBetween(W.unboundedPreceding, 0)
    ahead = W.partitionBy(*keys).orderBy(at).rowsBetween(0, W.unboundedFollowing)
    point = F.when(known, F.struct(F.col(at).cast("double").alias("__at"), *columns))
    rows = rows.withColumns({"__a": F.last(point, True).over(back), "__b": F.first(point, True).over(ahead)})
    share = F.try_divide(F.col(at) - F.col("__a.__at"), F.col("__b.__at") - F.col("__a.__at"))
    line = {
        c: F.coalesce(F.col(c), F.col(f"__a.{c}") + (F.col(f"__b.{c}") - F.col(f"__a.{c}")) * share, F.col(f"__a.{c}"), F.col(f"__b.{c}"))
        for c in columns
    }
    return rows.withColumns(line).drop("__a", "__b")


def asof_linear(samples: DataFrame, asked: DataFrame, columns: list[str], keys: list[str], at: str = "t") -> DataFrame:
    """asked with the samples' columns on the line between the samples before and after; null outside their range.

    One sort of the union instead of a range join; a sample at the very time decides alone.
    """
    names = [c for c in asked.columns if c not in (*keys, at)]
    left = samples.select(*keys, at, F.struct(F.col(at).alias("__at"), *columns).alias("__s"), *[F.lit(None).alias(c) for c in names])
    right = asked.select(*keys, at, F.lit(None).alias("__s"), *names).withColumn("__asked", F.lit(1))
    rows = left.withColumn("__asked", F.lit(0)).unionByName(right)
    back = W.partitionBy(*keys).orderBy(at, "__asked").rowsBetween(W.unboundedPreceding, 0)
    ahead = W.partitionBy(*keys).orderBy(at, F.col("__asked").desc()).rowsBetween(0, W.unboundedFollowing)
    rows = rows.withColumns({"__a": F.last("__s", True).over(back), "__b": F.first("__s", True).over(ahead)}).where("__asked = 1")
    share = F.coalesce(F.try_divide(F.col(at) - F.col("__a.__at"), F.col("__b.__at") - F.col("__a.__at")), F.lit(0.0))
    values = [(F.col(f"__a.{c}") + (F.col(f"__b.{c}") - F.col(f"__a.{c}")) * share).alias(c) for c in columns]
    return rows.select(*keys, at, *names, *values)


def nearest(points: DataFrame, anchors: DataFrame, keys: list[str], at: str = "seq") -> DataFrame:
    """points with the nearest anchor on their line, and its distance; ties go to the lower one."""
    rows = points.select(*keys, at, F.lit(None).cast("double").alias("__a"), F.lit(1).alias("__p")).unionByName(
        anchors.select(*keys, at, F.col(at).cast("double").alias("__a"), F.lit(0).alias("__p"))
    )
    back = W.partitionBy(*keys).orderBy(at, "__p").rowsBetween(W.unboundedPreceding, 0)
    ahead = W.partitionBy(*keys).orderBy(at, F.col("__p").desc()).rowsBetween(0, W.unboundedFollowing)
    rows = rows.withColumns({"__l": F.last("__a", True).over(back), "__r": F.first("__a", True).over(ahead)}).where("__p = 1")
    left, right = F.col(at) - F.col("__l"), F.col("__r") - F.col(at)
    lower = F.col("__r").isNull() | (left <= right)
    return rows.select(*keys, at, F.when(lower, F.col("__l")).otherwise(F.col("__r")).cast("long").alias("anchor"), F.when(lower, left).otherwise(right).alias("distance"))


def turns(track: DataFrame, column: str, least: float = 3.0) -> DataFrame:
    """With is_turn: the heading changes by so many degrees to the row before or after."""
    from ..functions.geo import wrap_deg

    w = _by(["seq"])
    rate = F.abs(wrap_deg(F.col(column) - F.lag(column).over(w)))
    rows = track.withColumn("rate", rate)
    return rows.withColumn("is_turn", F.coalesce(F.greatest("rate", F.lead("rate").over(w)) >= least, F.lit(False)))


def unwrap(track: DataFrame, column: str) -> DataFrame:
    """With `unwrapped`: the first angle plus the sum of the wrapped steps."""
    from ..functions.geo import wrap_deg

    w = _by(["seq"])
    step = F.coalesce(wrap_deg(F.col(column) - F.lag(column).over(w)), F.col(column))
    return track.withColumn("__step", step).withColumn("unwrapped", F.sum("__step").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("__step")


def runs(rows: DataFrame, state: str, keys: list[str], at: str, tie: str) -> DataFrame:
    """Runs of equal states: keys, state, run, starts, rows, and ends: when the next run starts, or the last row."""
    w = W.partitionBy(*keys).orderBy(at, tie)
    new = F.when(F.lag(state).over(w).eqNullSafe(F.col(state)), 0).otherwise(1)
    rows = rows.withColumn("__new", new).withColumn("run", F.sum("__new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    found = rows.groupBy(*keys, "run", state).agg(F.min(at).alias("starts"), F.max(at).alias("last"), F.count(F.lit(1)).alias("rows"))
    after = F.lead("starts").over(W.partitionBy(*keys).orderBy("run"))
    return found.withColumn("recovered", after.isNotNull()).withColumn("ends", F.coalesce(after, "last")).drop("last")


def failure_resets(rows: DataFrame, failed: Column, keys: list[str], order: list[str], most: int) -> DataFrame:
    """With failures in a row so far and out_of_coverage at every most-th of them, where the count starts anew."""
    w = W.partitionBy(*keys).orderBy(*order)
    rows = rows.withColumn("__f", failed.cast("int"))
    rows = rows.withColumn("__g", F.sum(1 - F.col("__f")).over(w.rowsBetween(W.unboundedPreceding, 0)))
    run = W.partitionBy(*keys, "__g").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    n = F.sum("__f").over(run)
    return rows.withColumn("failures", F.when(F.col("__f") == 1, (n - 1) % most + 1).otherwise(0)).withColumn(
        "out_of_coverage", (F.col("__f") == 1) & (F.col("failures") == most)
    ).drop("__f", "__g")


# --- operators whose state depends on their own decisions: one track is one ordered group ---


def _per_track(track: DataFrame, fold: Callable[[pd.DataFrame], pd.DataFrame], extra: str) -> DataFrame:
    """fold over the rows of each track in order; a track must fit a task."""
    schema = track.selectExpr("*", *[f"cast(null as {x.split()[1]}) as {x.split()[0]}" for x in extra.split(", ")]).schema
    return track.groupBy("track_id").applyInPandas(lambda rows: fold(rows.sort_values(["seq"]).reset_index(drop=True)), schema)


class Kalman:
    """Constant-velocity filter of [x, y, vx, vy]; the second fix seeds the velocity."""

    def __init__(self, process: float = 2.0, noise: float = 5.0):
        self.process, self.noise = process, noise
        self.reset()

    def reset(self) -> None:
        self.x, self.p, self.first = None, np.eye(4) * 1000.0, None

    def shift(self, dx: float, dy: float) -> None:
        if self.x is not None:
            self.x[:2] += (dx, dy)

    def _predict(self, dt: float):
        dt = min(max(dt, LEAST_DT), 5.0)
        f = np.eye(4)
        f[0, 2] = f[1, 3] = dt
        q = np.kron(np.array([[dt**4 / 4, dt**3 / 2], [dt**3 / 2, dt**2]]), np.eye(2)) * self.process
        return f @ self.x, f @ self.p @ f.T + q

    def distance(self, z, dt: float, scale: float = 1.0) -> float | None:
        """Squared Mahalanobis distance of a measurement; the state stays."""
        if self.x is None:
            return None
        x, p = self._predict(dt)
        y, s = np.asarray(z) - x[:2], p[:2, :2] + np.eye(2) * self.noise * float(np.clip(scale, 0.25, 25.0))
        d = float(y @ np.linalg.solve(s, y)) if abs(np.linalg.det(s)) > 0 else float("nan")
        return d if np.isfinite(d) and d >= 0 else None

    def update(self, z, dt: float, scale: float = 1.0) -> tuple[float, float]:
        z = np.asarray(z, float)
        if self.x is None:
            self.x, self.first = np.array([*z, 0.0, 0.0]), z
            return tuple(z)
        if self.first is not None:
            self.x[2:] = (z - self.first) / max(dt, LEAST_DT)
            self.first = None
        x, p = self._predict(dt)
        s = p[:2, :2] + np.eye(2) * self.noise * float(np.clip(scale, 0.25, 25.0))
        gain = p[:, :2] @ np.linalg.inv(s)
        self.x = x + gain @ (z - x[:2])
        keep = np.eye(4) - np.hstack([gain, np.zeros((4, 2))])
        self.p = keep @ p @ keep.T + gain @ (np.eye(2) * self.noise * float(np.clip(scale, 0.25, 25.0))) @ gain.T
        return float(self.x[0]), float(self.x[1])


class Gate:
    """Outlier gate over accepted positions: speed, z score of the speed, Mahalanobis distance."""

    def __init__(self, most=50.0, z=3.0, window=10, in_a_row=5, chi2=13.816, least_delta=15.0):
        self.most, self.z, self.size, self.in_a_row, self.chi2, self.delta = most, z, window, in_a_row, chi2, least_delta
        self.window: list[tuple[np.ndarray, float]] = []
        self.misses = 0

    def rejects(self, point, dt: float, d2: float | None = None) -> bool:
        point, bad = np.asarray(point, float), d2 is not None and d2 > self.chi2
        if len(self.window) >= 3:
            speed = float(np.linalg.norm(point - self.window[-1][0])) / max(dt, LEAST_DT)
            past = [float(np.linalg.norm(b - a)) / t for (a, _), (b, t) in zip(self.window, self.window[1:], strict=False)]
            away = abs(speed - np.mean(past))
            bad = bad or speed > self.most or (away / max(np.std(past), 1.0) > self.z and away > self.delta)
            if not bad:
                self.misses = 0
        if not bad:
            return False
        self.misses += 1
        if self.misses < self.in_a_row:
            return True
        self.window, self.misses = [], 0
        return False

    def accept(self, point, dt: float) -> None:
        self.window = [*self.window, (np.asarray(point, float), max(dt, LEAST_DT))][-self.size :]


def gate_fold(rows: pd.DataFrame, **limits) -> pd.DataFrame:
    gate, out = Gate(**limits), []
    for x, y, dt in zip(rows["x"], rows["y"], rows["t"].diff().fillna(1.0), strict=True):
        out.append(gate.rejects((x, y), dt))
        if not out[-1]:
            gate.accept((x, y), dt)
    return rows.assign(rejected=out)


def outlier_gate(track: DataFrame, **limits) -> DataFrame:
    """track with rejected; the window holds accepted positions only, and a series of misses is accepted."""
    return _per_track(track, lambda rows: gate_fold(rows, **limits), "rejected boolean")


def kalman_fold(rows: pd.DataFrame, process: float = 2.0, noise: float = 5.0) -> pd.DataFrame:
    found, filter_ = [], Kalman(process, noise)
    for x, y, dt in zip(rows["x"], rows["y"], rows["t"].diff().fillna(1.0), strict=True):
        d2 = filter_.distance((x, y), dt)
        found.append((*filter_.update((x, y), dt), d2))
    fx, fy, d2 = zip(*found, strict=True) if found else ((), (), ())
    return rows.assign(fx=fx, fy=fy, d2=pd.Series(d2, dtype="float64"))


#: Columns of the state of a track: fixes seen, position, velocity, first fix, covariance of one axis (both are alike), time.
_STATE = ["seen", "x", "y", "vx", "vy", "x0", "y0", "p00", "p01", "p11", "t"]


def _kalman_step(s: dict, x: np.ndarray, y: np.ndarray, t: np.ndarray, process: float, noise: float) -> tuple[np.ndarray, ...]:
    """One fix of many tracks at once: changes the state and gives positions and squared distances before the update."""
    new = s["seen"] == 0
    raw = np.where(new, 1.0, t - s["t"])
    dt = np.minimum(np.maximum(raw, LEAST_DT), 5.0)
    p00 = s["p00"] + 2 * dt * s["p01"] + dt**2 * s["p11"] + process * dt**4 / 4
    p01 = s["p01"] + dt * s["p11"] + process * dt**3 / 2
    p11 = s["p11"] + process * dt**2
    total = p00 + noise
    d2 = ((x - s["x"] - dt * s["vx"]) ** 2 + (y - s["y"] - dt * s["vy"]) ** 2) / total
    second = s["seen"] == 1
    for v, z, first in (("vx", x, "x0"), ("vy", y, "y0")):
        s[v] = np.where(second, (z - s[first]) / np.maximum(raw, LEAST_DT), s[v])
    k0, k1 = p00 / total, p01 / total
    for c, v, z in (("x", "vx", x), ("y", "vy", y)):
        off = z - s[c] - dt * s[v]
        s[c], s[v] = np.where(new, z, s[c] + dt * s[v] + k0 * off), np.where(new, 0.0, s[v] + k1 * off)
    keep = 1.0 - k0
    s["p00"] = np.where(new, s["p00"], keep**2 * p00 + k0**2 * noise)
    s["p01"] = np.where(new, s["p01"], keep * (p01 - k1 * p00) + k0 * k1 * noise)
    s["p11"] = np.where(new, s["p11"], p11 - 2 * k1 * p01 + k1**2 * p00 + k1**2 * noise)
    s["x0"], s["y0"] = np.where(new, x, s["x0"]), np.where(new, y, s["y0"])
    s["seen"], s["t"] = s["seen"] + 1, t
    return s["x"], s["y"], np.where(new, np.nan, d2)


def kalman(track: DataFrame, process: float = 2.0, noise: float = 5.0) -> DataFrame:
    """track with the filtered position fx, fy and the squared Mahalanobis distance before the update.

    Rows come sorted by track, in batches; all tracks of a batch take their steps together, and the state of the
    last one goes on into the next batch, so that a track of any length is never held whole.
    """

    def run(batches):
        held: dict[str, float] | None = None
        last = None
        for rows in batches:
            ids, x, y, t = (rows[c].to_numpy() for c in ("track_id", "x", "y", "t"))
            starts = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]][: len(ids)])
            sizes = np.diff(np.r_[starts, len(ids)])
            state = {c: np.full(len(starts), 1000.0 if c in ("p00", "p11") else 0.0) for c in _STATE}
            if held is not None and len(ids) and ids[0] == last:
                for c in _STATE:
                    state[c][0] = held[c]
            out = np.zeros((3, len(ids)))
            for step in range(sizes.max(initial=0)):
                on = np.flatnonzero(sizes > step)
                at = starts[on] + step
                part = {c: v[on] for c, v in state.items()}
                out[:, at] = _kalman_step(part, x[at].astype(float), y[at].astype(float), t[at].astype(float), process, noise)
                for c in _STATE:
                    state[c][on] = part[c]
            if len(ids):
                held, last = {c: state[c][-1] for c in _STATE}, ids[-1]
            yield rows.assign(fx=out[0], fy=out[1], d2=out[2])

    schema = track.selectExpr("*", *[f"cast(null as double) as {c}" for c in ("fx", "fy", "d2")]).schema
    return track.repartition("track_id").sortWithinPartitions("track_id", "seq").mapInPandas(run, schema)


def _window_ends(z: np.ndarray, before: np.ndarray, size: int, huber: float, stiffness: float, rounds: int) -> np.ndarray:
    """Last position of the fit to the window that ends at each row; before: rows of the same track ahead of it.

    All windows take their steps together: the system has five diagonals, and a short window is that of full length whose first places
    are tied to nothing.
    """
    at = np.arange(len(z)) + np.arange(1 - size, 1)[:, None]
    live = at >= np.arange(len(z)) - before
    w = np.where(live[:, :, None], z[np.maximum(at, 0)], 0.0)
    tied = live[: max(size - 2, 0)] * float(stiffness)  # the bend of a place and the two behind it
    diagonal, one, two = np.zeros((3, size, len(z)))
    diagonal[: len(tied)] += tied
    diagonal[1 : len(tied) + 1] += 4 * tied
    diagonal[2 : len(tied) + 2] += tied
    one[: len(tied)] -= 2 * tied
    one[1 : len(tied) + 1] -= 2 * tied
    two[: len(tied)] += tied
    weight, fit = np.ones(w.shape[:2]), w
    for _ in range(rounds):
        fit = weight[:, :, None] * w
        d, l1, l2 = np.zeros((3, size, len(z)))
        for k in range(size):
            d[k] = diagonal[k] + weight[k]
            next_ = one[k].copy()
            if k:
                d[k] -= l1[k - 1] ** 2 * d[k - 1]
                next_ -= l1[k - 1] * l2[k - 1] * d[k - 1]
                fit[k] -= l1[k - 1, :, None] * fit[k - 1]
            if k > 1:
                d[k] -= l2[k - 2] ** 2 * d[k - 2]
                fit[k] -= l2[k - 2, :, None] * fit[k - 2]
            l1[k], l2[k] = next_ / d[k], two[k] / d[k]
        fit /= d[:, :, None]
        for k in range(size - 2, -1, -1):
            fit[k] -= l1[k, :, None] * fit[k + 1]
            if k + 2 < size:
                fit[k] -= l2[k, :, None] * fit[k + 2]
        weight = np.minimum(1.0, huber / np.maximum(np.hypot(*np.moveaxis(w - fit, 2, 0)), 1e-9))
    return fit[-1]


def smooth_fold(rows: pd.DataFrame, size: int = 60, huber: float = 3.0, stiffness: float = 1.0, rounds: int = 5) -> pd.DataFrame:
    """For each row the last position of a robust least-squares fit to the window that ends there."""
    z = rows[["x", "y"]].to_numpy(float)
    out = _window_ends(z, np.minimum(np.arange(len(z)), size - 1), size, huber, stiffness, rounds)
    return rows.assign(sx=out[:, 0], sy=out[:, 1])


def smoother(track: DataFrame, size: int = 60, huber: float = 3.0) -> DataFrame:
    """track with sx, sy: iteratively reweighted (Huber) smoothing over a sliding window.

    Rows come sorted by track, in batches; all windows of a batch are fitted together, and the last rows of a track that goes on are
    kept for the next batch, so a track may be of any length.
    """

    def run(batches):
        tail, last = np.zeros((0, 2)), None
        for rows in batches:
            if not len(rows):
                continue
            ids, z = rows["track_id"].to_numpy(), rows[["x", "y"]].to_numpy(float)
            kept = tail if ids[0] == last else tail[:0]
            starts = np.r_[True, ids[1:] != ids[:-1]]
            since = np.arange(len(ids)) - np.maximum.accumulate(np.where(starts, np.arange(len(ids)), 0))
            first = np.logical_and.accumulate(ids == ids[0])
            before = np.r_[np.zeros(len(kept), int), np.minimum(since + len(kept) * first, size - 1)]
            both = np.r_[kept, z]
            out = _window_ends(both, before, size, huber, 1.0, 5)[len(kept) :]
            tail, last = both[len(both) - min(before[-1] + 1, size - 1) :], ids[-1]
            yield rows.assign(sx=out[:, 0], sy=out[:, 1])

    schema = track.selectExpr("*", *[f"cast(null as double) as {c}" for c in ("sx", "sy")]).schema
    return track.repartition("track_id").sortWithinPartitions("track_id", "seq").mapInPandas(run, schema)


def pchip_slopes(t: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Slopes of the shape-preserving cubic: weighted harmonic means inside, one-sided three-point ends."""
    h, d = np.diff(t), np.diff(v) / np.diff(t)
    if len(t) == 2:
        return np.array([d[0], d[0]])
    w1, w2 = 2 * h[1:] + h[:-1], h[1:] + 2 * h[:-1]
    with np.errstate(divide="ignore", invalid="ignore"):
        inner = np.where(d[:-1] * d[1:] > 0, (w1 + w2) / (w1 / d[:-1] + w2 / d[1:]), 0.0)

    def end(h0, h1, d0, d1):
        s = ((2 * h0 + h1) * d0 - h0 * d1) / (h0 + h1)
        if np.sign(s) != np.sign(d0):
            return 0.0
        return 3 * d0 if np.sign(d0) != np.sign(d1) and abs(s) > 3 * abs(d0) else s

    return np.array([end(h[0], h[1], d[0], d[1]), *inner, end(h[-1], h[-2], d[-1], d[-2])])


def pchip(t: np.ndarray, v: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Values at places that are clamped to the range of t."""
    at = np.clip(at, t[0], t[-1])
    m = pchip_slopes(t, v)
    i = np.clip(np.searchsorted(t, at, side="right") - 1, 0, len(t) - 2)
    h = t[i + 1] - t[i]
    s = (at - t[i]) / h
    return (
        (1 + 2 * s) * (1 - s) ** 2 * v[i] + s * (1 - s) ** 2 * h * m[i]
        + s**2 * (3 - 2 * s) * v[i + 1] + s**2 * (s - 1) * h * m[i + 1]
    )


def fill_pchip(track: DataFrame, columns: list[str]) -> DataFrame:
    """track with nulls of the columns filled by the shape-preserving cubic over seq; one known row is repeated."""

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        for c in columns:
            known = rows[c].notna().to_numpy()
            at, v = rows["seq"].to_numpy(float), rows[c].to_numpy(float)
            if known.sum() >= 2:
                rows[c] = np.where(known, v, pchip(at[known], v[known], at))
            elif known.sum() == 1:
                rows[c] = v[known][0]
        return rows

    return track.groupBy("track_id").applyInPandas(lambda rows: fold(rows.sort_values("seq").reset_index(drop=True)), track.schema)
