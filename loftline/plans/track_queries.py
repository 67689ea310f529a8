"""Track queries: speed, gates, filters, gap filling, as-of values, runs and states."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scores import operating_state
from ..operators import trajectory as T
from .views import SQL_TRACK, r6, track


def track_speed(spark, sf_dir):
    rows = T.step_speed(track(spark, sf_dir)).where("speed is not null")
    return rows.select("event_id", "track_id", r6("speed").alias("speed"))


def track_outlier_stateless(spark, sf_dir):
    rows = T.outliers_raw(track(spark, sf_dir).withColumn("t", F.col("seq").cast("double")), most=300.0, z=2.0)
    return rows.select("event_id", "is_outlier")


def _clock(spark, sf_dir):
    """Tracks with a step of one second."""
    return track(spark, sf_dir).withColumn("t", F.col("seq").cast("double"))


def track_outlier_gate(spark, sf_dir):
    return T.outlier_gate(_clock(spark, sf_dir), most=300.0, z=2.0).select("event_id", "rejected")


def track_kalman(spark, sf_dir):
    found = T.kalman(_clock(spark, sf_dir))
    return found.select("event_id", r6("fx", 4).alias("fx"), r6("fy", 4).alias("fy"), r6("d2", 4).alias("d2"))


def track_smoother(spark, sf_dir):
    found = T.smoother(_clock(spark, sf_dir), size=20)
    return found.select("event_id", r6("sx", 4).alias("sx"), r6("sy", 4).alias("sy"))


def track_ema(spark, sf_dir):
    rows = track(spark, sf_dir).withColumn("scale", F.col("x") / 100.0)
    return T.ema(rows, "scale").select("track_id", r6("ema").alias("ema"))


def _gappy(spark, sf_dir):
    known = F.col("event_type").isin("click", "purchase")
    return track(spark, sf_dir).select(
        "track_id", "seq", "event_id", F.when(known, F.col("x")).alias("x"), F.when(known, F.col("y")).alias("y")
    )


def gap_fill_linear(spark, sf_dir):
    found = T.fill_linear(_gappy(spark, sf_dir), "seq", ["x", "y"], ["track_id"])
    return found.select("event_id", r6("x").alias("x"), r6("y").alias("y"))


def gap_fill_pchip(spark, sf_dir):
    """To eight digits, as values at quarters of a gap have so many."""
    found = T.fill_pchip(_gappy(spark, sf_dir), ["x", "y"])
    return found.select("event_id", r6("x", 8).alias("x"), r6("y", 8).alias("y"))


def asof_interpolate(spark, sf_dir):
    """The signal of clicks at the times of purchases."""
    rows = track(spark, sf_dir)
    asked = rows.where("event_type = 'purchase'").select("track_id", "t", "event_id")
    found = T.asof_linear(rows.where("event_type = 'click'"), asked, ["x"], ["track_id"])
    return found.select("event_id", r6("x", 4).alias("x"))


def turn_segments(spark, sf_dir):
    rows = track(spark, sf_dir).withColumn("heading", (F.col("y") * 7.3) % 360 - 180)
    return T.turns(rows, "heading", 90.0).select("event_id", r6("rate").alias("rate"), "is_turn")


def heading_unwrap(spark, sf_dir):
    rows = track(spark, sf_dir).withColumn("heading", (F.col("y") * 7.3) % 360 - 180)
    return T.unwrap(rows, "heading").select("event_id", r6("unwrapped", 4).alias("unwrapped"))


def nearest_anchor(spark, sf_dir):
    rows = track(spark, sf_dir)
    anchors = rows.where("event_type = 'signup'").select("track_id", "seq")
    found = T.nearest(rows, anchors, ["track_id"])
    return found.select("track_id", "seq", "anchor", F.col("distance").cast("long").alias("distance"))


def _states(spark, sf_dir):
    state = F.when(F.col("event_type") == "error", "LOST").when(F.col("event_type") == "signup", "DEGRADED").otherwise("TRACKING")
    return track(spark, sf_dir).withColumn("state", state)


def state_dwell(spark, sf_dir):
    found = T.runs(_states(spark, sf_dir), "state", ["track_id"], "t", "event_id")
    return found.groupBy("track_id", "state").agg(
        F.count(F.lit(1)).alias("runs"), r6(F.sum(F.col("ends") - F.col("starts")), 3).alias("dwell")
    )


def lost_episodes(spark, sf_dir):
    found = T.runs(_states(spark, sf_dir), "state", ["track_id"], "t", "event_id").where("state = 'LOST'")
    return found.select(
        "track_id", r6("starts", 3).alias("starts"), r6(F.col("ends") - F.col("starts"), 3).alias("duration"), "recovered"
    )


def failure_runs(spark, sf_dir):
    rows = T.failure_resets(track(spark, sf_dir), F.col("event_type").isin("error", "view"), ["track_id"], ["seq"], 3)
    return rows.select("event_id", F.col("failures").cast("long").alias("failures"), "out_of_coverage")


def operating_states(spark, sf_dir):
    """State at each row: the fix is the last purchase, its age in hours, the quality that of the row."""
    from pyspark.sql import Window as W

    w = W.partitionBy("track_id").orderBy("seq").rowsBetween(W.unboundedPreceding, 0)
    fix = F.last(F.when(F.col("event_type") == "purchase", F.col("t")), True).over(w)
    rows = track(spark, sf_dir).withColumn("age", (F.col("t") - fix) / 3600.0)
    state = operating_state(
        F.col("event_type") != "signup", F.col("age"), F.col("event_id") % 60, F.col("x") / 500.0, F.lit(None).cast("double"),
        stale=24.0, least_inliers=10, least_confidence=0.1,
    )
    return rows.select("event_id", state.alias("state"))


NAMES = [
    track_speed, track_outlier_stateless, track_outlier_gate, track_kalman, track_smoother, track_ema, gap_fill_linear,
    gap_fill_pchip, asof_interpolate, turn_segments, heading_unwrap, nearest_anchor, state_dwell, lost_episodes, failure_runs,
    operating_states,
]
QUERIES = {f.__name__: f for f in NAMES}

_T = "(partition by track_id order by seq)"
_KALMAN = f"""{SQL_TRACK}, s as materialized (select track_id, seq, event_id, seq::double as t, x as zx, y as zy from track),
 k as (select track_id, seq, event_id, t, 1 as seen, zx as x, zy as y, 0.0::double as vx, 0.0::double as vy, zx as x0, zy as y0, 1000.0::double as p00, 0.0::double as p01, 1000.0::double as p11, null::double as d2 from s where seq = 1
 union all select track_id, seq, event_id, t, seen + 1, x + dt * ux + k0 * (zx - x - dt * ux), y + dt * uy + k0 * (zy - y - dt * uy), ux + k1 * (zx - x - dt * ux), uy + k1 * (zy - y - dt * uy), x0, y0,
   (1 - k0) ** 2 * q00 + k0 ** 2 * 5, (1 - k0) * (q01 - k1 * q00) + k0 * k1 * 5, q11 - 2 * k1 * q01 + k1 ** 2 * q00 + k1 ** 2 * 5, d2
 from (select *, q00 / (q00 + 5) as k0, q01 / (q00 + 5) as k1, ((zx - x - dt * vx) ** 2 + (zy - y - dt * vy) ** 2) / (q00 + 5) as d2,
     case when seen = 1 then (zx - x0) / greatest(raw, 0.01) else vx end as ux, case when seen = 1 then (zy - y0) / greatest(raw, 0.01) else vy end as uy
   from (select *, p00 + 2 * dt * p01 + dt ** 2 * p11 + 2 * dt ** 4 / 4 as q00, p01 + dt * p11 + 2 * dt ** 3 / 2 as q01, p11 + 2 * dt ** 2 as q11
     from (select s.track_id, s.seq, s.event_id, s.t, s.zx, s.zy, s.t - k.t as raw, least(greatest(s.t - k.t, 0.01), 5.0)::double as dt, k.* exclude (track_id, seq, event_id, t, d2)
       from k join s on s.track_id = k.track_id and s.seq = k.seq + 1))))"""
_GATE = f"""{SQL_TRACK}, s as materialized (select track_id, seq, event_id, x, y from track),
 g as (select track_id, seq, event_id, [{{'x': x, 'y': y}}] as win, 0 as misses, false as rejected from s where seq = 1
 union all select track_id, seq, event_id, case when rejected then win when bad then [{{'x': x, 'y': y}}] else list_append(win, {{'x': x, 'y': y}})[-10:] end,
   case when bad and m >= 5 then 0 else m end, rejected
 from (select *, bad and m < 5 as rejected from (select *, case when bad then misses + 1 when len(win) >= 3 then 0 else misses end as m
   from (select *, len(win) >= 3 and (speed > 300 or (abs(speed - list_avg(past)) / greatest(list_stddev_pop(past), 1.0) > 2 and abs(speed - list_avg(past)) > 15)) as bad
     from (select s.track_id, s.seq, s.event_id, s.x, s.y, g.win, g.misses, sqrt((s.x - g.win[-1].x) ** 2 + (s.y - g.win[-1].y) ** 2) as speed,
         list_transform(range(2, len(g.win) + 1), lambda i: sqrt((g.win[i].x - g.win[i - 1].x) ** 2 + (g.win[i].y - g.win[i - 1].y) ** 2)) as past
       from g join s on s.track_id = g.track_id and s.seq = g.seq + 1)))))"""


def _end(h0: str, h1: str, d0: str, d1: str) -> str:
    """Slope at an end of the shape-preserving cubic."""
    e = f"(((2 * {h0} + {h1}) * {d0} - {h0} * {d1}) / ({h0} + {h1}))"
    return f"case when sign({e}) <> sign({d0}) then 0.0 when sign({d0}) <> sign({d1}) and abs({e}) > 3 * abs({d0}) then 3 * {d0} else {e} end"


def _pchip_sql(c: str) -> str:
    """CTEs that give f_{c} (event_id, v) for gappy (track_id, seq, event_id, {c})."""
    return f"""k1_{c} as (select track_id, seq::double as t, {c} as v, count(*) over (partition by track_id) as n, seq - lag(seq) over w as h0, lead(seq) over w - seq as h1,
   ({c} - lag({c}) over w) / (seq - lag(seq) over w) as d0, (lead({c}) over w - {c}) / (lead(seq) over w - seq) as d1 from gappy where {c} is not null window w as (partition by track_id order by seq)),
 k2_{c} as (select *, lead(h1) over w as h2, lead(d1) over w as d2, lag(h0) over w as hb, lag(d0) over w as db from k1_{c} window w as (partition by track_id order by t)),
 k_{c} as (select track_id, t, v, case when n <= 2 then coalesce(d0, d1) when d0 is null then {_end("h1", "h2", "d1", "d2")} when d1 is null then {_end("h0", "hb", "d0", "db")}
   when d0 * d1 > 0 then (3 * h1 + 3 * h0) / ((2 * h1 + h0) / d0 + (h1 + 2 * h0) / d1) else 0.0 end as m from k2_{c}),
 a_{c} as (select g.track_id, g.seq::double as t, g.event_id, g.{c} as v, case when k.t is not null then struct_pack(t := k.t, v := k.v, m := k.m) end as p from gappy g left join k_{c} k on k.track_id = g.track_id and k.t = g.seq),
 b_{c} as (select *, last_value(p ignore nulls) over (partition by track_id order by t) as l, first_value(p ignore nulls) over (partition by track_id order by t rows between current row and unbounded following) as r from a_{c}),
 c_{c} as (select *, (t - l.t) / (r.t - l.t) as s, r.t - l.t as h from b_{c}),
 f_{c} as (select event_id, case when v is not null then v when l is null then r.v when r is null then l.v
   else (1 + 2 * s) * (1 - s) ** 2 * l.v + s * (1 - s) ** 2 * h * l.m + s ** 2 * (3 - 2 * s) * r.v + s ** 2 * (s - 1) * h * r.m end as v from c_{c})"""


_STATES = f"""{SQL_TRACK}, s as (select *, case event_type when 'error' then 'LOST' when 'signup' then 'DEGRADED' else 'TRACKING' end as state from track),
 c as (select *, case when lag(state) over (partition by track_id order by t, event_id) is not distinct from state then 0 else 1 end as nw from s),
 g as (select *, sum(nw) over (partition by track_id order by t, event_id rows unbounded preceding) as run from c),
 r as (select track_id, run, state, min(t) as starts, max(t) as last from g group by 1, 2, 3),
 e as (select *, lead(starts) over (partition by track_id order by run) as nxt from r)"""
SQL = {
    "track_speed": f"""with {SQL_TRACK}, v as (select *, sqrt((x - lag(x) over w) ** 2 + (y - lag(y) over w) ** 2) / greatest(t - lag(t) over w, 0.01) as speed from track window w as {_T})
 select event_id, track_id, round(speed, 6) as speed from v where speed is not null""",
    "track_outlier_stateless": f"""with {SQL_TRACK}, v as (select *, sqrt((x - lag(x) over w) ** 2 + (y - lag(y) over w) ** 2) as speed from track window w as {_T}),
 z as (select *, avg(speed) over b as m, stddev_pop(speed) over b as d, count(speed) over b as n from v window b as (partition by track_id order by seq rows between 9 preceding and 1 preceding))
 select event_id, coalesce(speed > 300 or (n >= 2 and abs(speed - m) / greatest(d, 1) > 2 and abs(speed - m) > 15), false) as is_outlier from z""",
    "track_ema": f"""with {SQL_TRACK}, k as (select track_id, seq, x / 100.0::double as v from track where x / 100.0::double between 0.3 and 3.5),
 a as (select track_id, list(v order by seq) as l from k group by 1), i as (select distinct track_id from track)
 select i.track_id, round(list_reduce(l, lambda p, q: p * 0.7::double + q * 0.3::double), 6) as ema from i left join a on a.track_id = i.track_id""",
    "gap_fill_linear": f"""with {SQL_TRACK}, k as (select *, case when event_type in ('click', 'purchase') then seq end as ks from track),
 n as (select *, last_value(ks ignore nulls) over (partition by track_id order by seq rows between unbounded preceding and current row) as a,
   first_value(ks ignore nulls) over (partition by track_id order by seq rows between current row and unbounded following) as b from k)
 select n.event_id, round(case when n.ks is not null then n.x when a.seq is null then b.x when b.seq is null then a.x else a.x + (b.x - a.x) * ((n.seq - a.seq)::double / (b.seq - a.seq)) end, 6) as x,
   round(case when n.ks is not null then n.y when a.seq is null then b.y when b.seq is null then a.y else a.y + (b.y - a.y) * ((n.seq - a.seq)::double / (b.seq - a.seq)) end, 6) as y
 from n left join track a on a.track_id = n.track_id and a.seq = n.a left join track b on b.track_id = n.track_id and b.seq = n.b""",
    "asof_interpolate": f"""with {SQL_TRACK}, c as (select * from track where event_type = 'click'), p as (select * from track where event_type = 'purchase'),
 a as (select p.track_id, p.t, p.event_id, c.t as t0, c.x as x0 from p asof left join c on p.track_id = c.track_id and p.t >= c.t),
 b as (select a.*, c.t as t1, c.x as x1 from a asof left join c on a.track_id = c.track_id and a.t <= c.t)
 select event_id, round(case when t0 is null or t1 is null then null when t1 = t0 then x0 else x0 + (x1 - x0) * ((t - t0) / (t1 - t0)) end, 4) as x from b""",
    "turn_segments": f"""with {SQL_TRACK}, h as (select *, (y * 7.3::double) % 360 - 180 as hd from track),
 d as (select *, hd - lag(hd) over {_T} + 180 as q from h), r as (select *, abs(q - 360 * floor(q / 360) - 180) as rate from d)
 select event_id, round(rate, 6) as rate, coalesce(greatest(rate, lead(rate) over {_T}) >= 90, false) as is_turn from r""",
    "heading_unwrap": f"""with {SQL_TRACK}, h as (select *, (y * 7.3::double) % 360 - 180 as hd from track),
 d as (select *, hd - lag(hd) over {_T} + 180 as q from h)
 select event_id, round(sum(coalesce(q - 360 * floor(q / 360) - 180, hd)) over (partition by track_id order by seq rows unbounded preceding), 4) as unwrapped from d""",
    "nearest_anchor": f"""with {SQL_TRACK}, a as (select *, case when event_type = 'signup' then seq end as k from track),
 n as (select *, last_value(k ignore nulls) over (partition by track_id order by seq rows between unbounded preceding and current row) as l,
   first_value(k ignore nulls) over (partition by track_id order by seq rows between current row and unbounded following) as r from a)
 select track_id, seq, case when r is null or seq - l <= r - seq then l else r end as anchor, case when r is null or seq - l <= r - seq then seq - l else r - seq end as distance from n""",
    "state_dwell": f"with {_STATES} select track_id, state, count(*) as runs, round(sum(coalesce(nxt, last) - starts), 3) as dwell from e group by 1, 2",
    "lost_episodes": f"with {_STATES} select track_id, round(starts, 3) as starts, round(coalesce(nxt, last) - starts, 3) as duration, nxt is not null as recovered from e where state = 'LOST'",
    "failure_runs": f"""with {SQL_TRACK}, f as (select *, case when event_type in ('error', 'view') then 1 else 0 end as f from track),
 g as (select *, sum(1 - f) over (partition by track_id order by seq rows unbounded preceding) as g from f),
 n as (select *, case when f = 1 then (sum(f) over (partition by track_id, g order by seq rows unbounded preceding) - 1) % 3 + 1 else 0 end as n from g)
 select event_id, n::bigint as failures, f = 1 and n = 3 as out_of_coverage from n""",
    "operating_states": f"""with {SQL_TRACK}, f as (select *, (t - last_value(case when event_type = 'purchase' then t end ignore nulls) over (partition by track_id order by seq rows between unbounded preceding and current row)) / 3600.0::double as age from track)
 select event_id, case when event_type = 'signup' then 'IDLE' when age is null then 'ACQUIRING' when age > 24 then 'LOST' when event_id % 60 < 10 or x / 500.0::double < 0.1 then 'DEGRADED' else 'TRACKING' end as state from f""",
    "track_kalman": f"with recursive {_KALMAN} select event_id, round(x, 4) as fx, round(y, 4) as fy, round(d2, 4) as d2 from k",
    "track_outlier_gate": f"with recursive {_GATE} select event_id, rejected from g",
    "gap_fill_pchip": f"""with {SQL_TRACK}, gappy as (select track_id, seq, event_id, case when event_type in ('click', 'purchase') then x end as x, case when event_type in ('click', 'purchase') then y end as y from track),
 {_pchip_sql("x")}, {_pchip_sql("y")} select x.event_id, round(x.v, 8) as x, round(y.v, 8) as y from f_x x join f_y y on y.event_id = x.event_id""",
}
