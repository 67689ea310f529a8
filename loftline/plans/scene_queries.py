"""Scene queries: lookups, predictions against truth, anchors, fields of view, comparison of runs and timings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import affine
from ..operators import metrics, scenes
from ..session import table
from ..sources import logs
from .views import FRAME_H, FRAME_W, SQL_FIXES, SQL_MATRICES, SQL_TRACK, fixes, matrices, matrix, r6, track

MATRIX = ["a", "b", "tx", "c", "d", "ty"]


def frame_lookup(spark, sf_dir):
    """Matrices of asked frames, a few of them out of range or not valid, and the size of each with its defaults."""
    e = F.col("event_id")
    asked = matrices(spark, sf_dir).select((e * 2).alias("event_id"))
    found = scenes.lookup(asked, matrices(spark, sf_dir), "event_id", ["a", "tx"], e % 9 != 0)
    own = F.when(e % 3 == 0, e % 700 + 300), F.when(e % 4 != 1, e % 900 + 300)
    stored = F.when(e % 5 != 0, F.lit(720)), F.when(e % 7 != 0, F.lit(1280))
    height, width = scenes.frame_size(own, stored)
    return found.select("event_id", r6("a").alias("a"), r6("tx").alias("tx"), height.cast("long").alias("height"), width.cast("long").alias("width"))


def _truth(spark, sf_dir):
    """Truths are the matrices, predictions the valid ones of them, moved, scaled and sometimes mirrored."""
    e = F.col("event_id")
    truth = matrices(spark, sf_dir).select("event_id", *MATRIX)
    pred = truth.where(e % 9 != 0).select(
        "event_id", (F.col("a") * 1.1).alias("a"), F.when(e % 8 == 0, -F.col("b")).otherwise(F.col("b")).alias("b"), (F.col("tx") + e % 13).alias("tx"),
        F.col("c"), F.when(e % 8 == 0, -F.col("d")).otherwise(F.col("d")).alias("d"), (F.col("ty") - e % 17).alias("ty"),
    )
    return truth, scenes.center_errors(pred, truth, "event_id", FRAME_W, FRAME_H, 0.6641)


def truth_error_table(spark, sf_dir):
    """Centre errors of all frames, at anchors (every tenth), between them, and in the gap of 100 to 200."""
    e = F.col("event_id")
    cuts = {"all": F.lit(True), "at_anchors": e % 10 == 0, "between_anchors": e % 10 != 0, "gap_100_200": e.between(100, 200)}
    found = metrics.cut_report(_truth(spark, sf_dir)[1], "error", cuts)
    return found.select("cut", "n", *[r6(c, 4).alias(c) for c in ("median", "p95", "max", "mean")])


def truth_worst_slots(spark, sf_dir):
    rows = _truth(spark, sf_dir)[1].orderBy(F.col("error").desc(), F.col("event_id").desc()).limit(10)
    return rows.select("event_id", r6("error", 4).alias("error"), r6("angle_error", 4).alias("angle_error"))


def scene_metrics(spark, sf_dir):
    """By the last digit of the frame, as if each were a scene."""
    truth, errors = _truth(spark, sf_dir)
    sizes = truth.groupBy((F.col("event_id") % 10).alias("scene")).agg(F.count(F.lit(1)).alias("truths"))
    rows = errors.withColumn("scene", F.col("event_id") % 10).join(sizes, "scene")
    found = scenes.scene_metrics(rows, F.first("truths"), ["scene"])
    return found.select("scene", "n", *[r6(c, 4).alias(c) for c in ("coverage", "median", "p95", "max", "det_sign_ok", "scale_drift")])


def chain_angles(spark, sf_dir):
    """Rotation between the matrices of a row and the one with its id doubled, and the angles to try from it."""
    names = [F.col(n).alias(f"o_{n}") for n in MATRIX]
    other = matrices(spark, sf_dir).where("event_id % 2 = 0").select((F.col("event_id") / 2).cast("long").alias("event_id"), *names)
    both = matrices(spark, sf_dir).join(other, "event_id", "left")
    rel = scenes.relative_angle(matrix(), affine.Affine(*[F.col(f"o_{n}") for n in MATRIX]))
    angles = scenes.retry_angles(F.round(rel, 4))
    return both.select("event_id", r6(rel, 4).alias("angle"), F.size(angles).cast("long").alias("n"), r6(F.get(angles, F.lit(0)), 4).alias("first_angle"))


def crop_mapping(spark, sf_dir):
    e = F.col("event_id")
    there, back = scenes.crop_affine(e % 50, e % 30, e % 640, e % 480, F.lit(1024.0), F.lit(768.0))
    x, y = affine.apply(there, F.col("x"), F.col("y"))
    u, v = affine.apply(back, F.col("u"), F.col("v"))
    rows = track(spark, sf_dir).select("event_id", "x", "y", x.alias("u"), y.alias("v"))
    return rows.select("event_id", r6("u", 4).alias("u"), r6("v", 4).alias("v"), ((F.abs(u - F.col("x")) < 1e-6) & (F.abs(v - F.col("y")) < 1e-6)).alias("returns"))


def fov_polygon(spark, sf_dir):
    """Corners in metres; some homographies explode and fall back to the box of the inliers."""
    e = F.col("event_id")
    h = [F.lit(v) for v in (1.0, 0.0, 3.0, 0.0, 1.0, -4.0)] + [F.when(e % 6 == 0, -5.2e-4).otherwise(1e-5), F.lit(0.0), F.lit(1.0)]
    box = tuple(F.lit(v) for v in (400.0, 200.0, 900.0, 700.0))
    corners, exploded = scenes.fov_corners(h, matrix(), FRAME_W, FRAME_H, box)
    rows = matrices(spark, sf_dir).select("event_id", corners.alias("p"), exploded.alias("exploded"))
    return rows.select("event_id", "exploded", *[r6(F.col("p")[i][c], 3).alias(f"{c}{i}") for i in range(4) for c in "xy"])


def anchor_interpolation(spark, sf_dir):
    """Metres of the frame's centre between anchors, every tenth row of a track but those of the last few."""
    rows = track(spark, sf_dir).select("event_id", "track_id", "seq")
    at = matrices(spark, sf_dir).select("event_id", *MATRIX).join(rows, "event_id")
    found = scenes.interpolate_anchors(rows, at.where("seq % 10 = 3").select("track_id", "seq", *MATRIX), "track_id", "seq", 960.0, 540.0)
    return found.select("event_id", r6("mx", 3).alias("mx"), r6("my", 3).alias("my"))


def gap_fallback(spark, sf_dir):
    rows = track(spark, sf_dir).select("track_id", "seq", "x", "y")
    ends = [rows.where("seq % 20 = 1").select("track_id", F.col("seq").alias("lo"), (F.col("seq") + 10).alias("hi"), F.col("x").alias("x0"), F.col("y").alias("y0"))]
    ends.append(rows.where("seq % 20 = 11").select("track_id", F.col("seq").alias("hi"), F.col("x").alias("x1"), F.col("y").alias("y1")))
    found = scenes.gap_fallback(rows, ends[0].join(ends[1], ["track_id", "hi"]), "track_id", "seq", 150.0)
    return found.select("track_id", "seq", r6("off", 4).alias("off"))


def kinematic_triples(spark, sf_dir):
    """All rows of a track as nodes, in slots of which every eighth is empty."""
    slot = F.col("seq") + F.floor(F.col("seq") / 7).cast("long")
    nodes = track(spark, sf_dir).withColumns({"slot": slot, "fixed": F.col("seq") % 10 < 4})
    found = scenes.kinematic_triples(nodes, "track_id", "slot", "fixed", 0.8)
    return found.select("track_id", "a", "b", "c", r6("alpha").alias("alpha"), r6("weight").alias("weight"))


def anchor_quality(spark, sf_dir):
    """Points of a track in blocks of eight against a distorted copy, the third of some blocks far off."""
    e, s = F.col("event_id"), F.col("seq")
    rows = track(spark, sf_dir).select(
        "track_id", F.floor((s - 1) / 8).cast("long").alias("block"), "event_id", "x", "y",
        (F.col("x") * 2 - F.col("y") * 0.5 + e % 5 + F.when((s % 8 == 3) & (s % 3 == 0), 400.0).otherwise(0.0)).alias("u"),
        (F.col("x") * 0.5 + F.col("y") * 2 + e % 3).alias("v"),
    )
    fit = metrics.affine_fit(rows, ["track_id", "block"])
    found = scenes.anchor_quality(rows, ["track_id", "block"], fit)
    return found.select("event_id", r6("error", 3).alias("error"), r6("loo", 3).alias("loo"), "suspicious")


def depth_hints(spark, sf_dir):
    """Median depth scale of each type, where it is positive, and the levels to try for rows of one of them."""
    scale = F.when(F.col("event_id") % 11 != 0, F.col("x") / 100.0).otherwise(0.0)
    rows = track(spark, sf_dir).select("event_id", "event_type", scale.alias("depth"))
    stored = rows.where("depth > 0").groupBy("event_type").agg(F.percentile("depth", 0.5).alias("stored"))
    both = rows.join(stored, "event_type").withColumn("hint", scenes.depth_hint(F.col("depth"), F.col("stored")))
    levels = scenes.scale_candidates(F.when(F.col("event_id") % 4 == 0, F.lit(0.9)), F.col("hint"), (1.0, 0.7, 1.4, 0.5, 2.0))
    both = both.withColumn("levels", levels)  # beside the rounded hint, the lambdas would take that one by its name
    return both.select("event_id", r6("hint", 5).alias("hint"), F.get("levels", F.lit(0)).alias("first"), F.size("levels").cast("long").alias("n"))


def sign_majority(spark, sf_dir):
    rows = matrices(spark, sf_dir).withColumn("scene", F.col("event_id") % 3 + F.when(F.col("event_id") % 2 == 0, 3).otherwise(F.col("event_id") % 7))
    d, gsd = affine.det(matrix()), affine.isotropic_scale(matrix())
    found = rows.groupBy("scene").agg(
        scenes.majority_sign(d).alias("sign"), ((F.min(d) < 0) & (F.max(d) > 0)).alias("mixed"), F.percentile(gsd, 0.5).alias("gsd")
    )
    return found.select("scene", "sign", "mixed", r6("gsd").alias("gsd"), r6(F.greatest(F.col("gsd") * 0.05 * FRAME_W, F.lit(3.0)), 4).alias("threshold"))


def grid_tiles(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * 13 + 200).alias("w"), (F.col("p_size") * 7 + 150).alias("h"))
    rows = rows.withColumn("tiles", scenes.grid_tiles(F.col("w"), F.col("h"), [(1, 1), (2, 2), (3, 3)]))
    return rows.select("p_partkey", F.posexplode("tiles").alias("tile", "b")).select("p_partkey", "tile", "b.*")


def _runs(spark, sf_dir):
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        F.when(k % 2 == 0, "a").otherwise("b").alias("run"), (k % F.when(k % 2 == 0, 20).otherwise(7) != 1).alias("ok"),
        F.col("o_custkey").alias("frame"), (F.col("o_totalprice") / F.when(k % 2 == 0, 100).otherwise(104)).alias("inliers"),
    )


def ab_verdict(spark, sf_dir):
    found = scenes.run_verdict(_runs(spark, sf_dir), "frame", "inliers")
    return found.select("n_a", "n_b", r6("median_a", 4).alias("median_a"), r6("median_b", 4).alias("median_b"), r6("jaccard").alias("jaccard"), "worse")


def stage_timings(spark, sf_dir):
    found = scenes.timings(table(spark, sf_dir, "events").where("value is not null"), "event_type", "value")
    return found.select("event_type", "calls", *[r6(c, 4).alias(c) for c in ("total", "mean", "least", "most", "median", "p95")])


def benchmark_ratio(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_linenumber", "l_returnflag", "l_quantity")
    a, b = (scenes.timings(rows.where(c), "l_linenumber", "l_quantity") for c in ("l_returnflag = 'N'", "l_returnflag <> 'N'"))
    found = scenes.compare_timings(a, b, "l_linenumber", 1.0)
    return found.select("l_linenumber", "a", "b", r6("ratio").alias("ratio"), "slower")


def spread_statistics(spark, sf_dir):
    rows = track(spark, sf_dir).groupBy("track_id").agg(metrics.inlier_spread("x", "y", FRAME_W, FRAME_H).alias("spread")).where("spread is not null")
    low = F.count_if(F.col("spread") < 0.02) * 100.0 / F.count(F.lit(1))
    return rows.agg(F.count(F.lit(1)).alias("n"), r6(F.avg("spread")).alias("mean"), r6(F.min("spread")).alias("least"), r6(low, 4).alias("low"))


def candidate_order(spark, sf_dir):
    """The five best candidates of each supplier's parts: most matches first, then the higher score."""
    rows = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_partkey").agg(
        F.count(F.lit(1)).alias("matches"), F.max(F.col("l_quantity") * 1000 + F.col("l_linenumber")).alias("score")
    )
    rank = F.row_number().over(scenes.W.partitionBy("l_suppkey").orderBy(F.col("matches").desc(), F.col("score").desc(), "l_partkey"))
    return rows.withColumn("place", rank).where("place <= 5").select("l_suppkey", "l_partkey", "matches", "place")


def active_set_changes(spark, sf_dir):
    """Rows of a track at which the set of active cells, the two coarse ones of a fix, is another than before."""
    cells = F.array(F.floor(F.col("lat") * 20), F.floor(F.col("lon") * 20))
    rows = fixes(spark, sf_dir).select("event_id", "track_id", "seq", F.concat_ws(",", cells.cast("array<string>")).alias("active"))
    before = F.lag("active").over(scenes.W.partitionBy("track_id").orderBy("seq"))
    return rows.select("event_id", "active", (~before.eqNullSafe(F.col("active"))).alias("changed")).where("changed").select("event_id", "active")


def log_temporal_prior(spark, sf_dir):
    e = F.col("event_id")
    line = F.when(e % 10 == 0, F.format_string("INFO [temporal-prior] tries=%d hits=%d", e, e - e % 7)).otherwise("noise")
    return logs.temporal_prior(track(spark, sf_dir).select("event_id", line.alias("line")), "event_id").select("tries", "hits", r6("hit_rate").alias("hit_rate"))


def reprojection_errors(spark, sf_dir):
    e = F.col("event_id")
    h = [F.col("a"), F.col("b"), F.col("tx"), F.col("c"), F.col("d"), F.col("ty"), e % 5 * 1e-4, e % 3 * 1e-4, F.lit(1.0)]
    u, v = affine.apply_homography(h, F.col("x"), F.col("y"))
    return matrices(spark, sf_dir).select("event_id", r6(F.sqrt((u - F.col("y")) ** 2 + (v - F.col("x")) ** 2), 4).alias("error"))


NAMES = [
    frame_lookup, truth_error_table, truth_worst_slots, scene_metrics, chain_angles, crop_mapping, fov_polygon, anchor_interpolation, gap_fallback,
    kinematic_triples, anchor_quality, depth_hints, sign_majority, grid_tiles, ab_verdict, stage_timings, benchmark_ratio, spread_statistics,
    candidate_order, active_set_changes, log_temporal_prior, reprojection_errors,
]
QUERIES = {f.__name__: f for f in NAMES}

_ERR = SQL_MATRICES + """, pr as (select event_id, a * 1.1::double as a, case when event_id % 8 = 0 then -b else b end as b, tx + event_id % 13 as tx, c,
   case when event_id % 8 = 0 then -d else d end as d, ty - event_id % 17 as ty from matrices where event_id % 9 <> 0),
 err as (select g.event_id, sqrt(((p.a - g.a) * 960 + (p.b - g.b) * 540 + p.tx - g.tx) ** 2 + ((p.c - g.c) * 960 + (p.d - g.d) * 540 + p.ty - g.ty) ** 2) * 0.6641::double as error,
   degrees(atan2(p.c, p.a)) - degrees(atan2(g.c, g.a)) + 180 as turn, sqrt(abs(p.a * p.d - p.b * p.c)) as sp, sqrt(abs(g.a * g.d - g.b * g.c)) as sg,
   sign(p.a * p.d - p.b * p.c) = sign(g.a * g.d - g.b * g.c) as same from pr p join matrices g on g.event_id = p.event_id)"""
_SUM = "count(*) as n, round(median(error), 4) as median, round(quantile_cont(error, 0.95), 4) as p95, round(max(error), 4) as max, round(avg(error), 4) as mean"
_CORNERS = [(0, 0), (1, 0), (1, 1), (0, 1)]
_RUNS = """runs as (select case when o_orderkey % 2 = 0 then 'a' else 'b' end as run, case when o_orderkey % 2 = 0 then o_orderkey % 20 <> 1 else o_orderkey % 7 <> 1 end as ok,
 o_custkey as frame, o_totalprice / case when o_orderkey % 2 = 0 then 100.0::double else 104.0::double end as inliers from orders)"""
_TIMES = "count(*) as calls, sum({v}) as total, avg({v}) as mean, min({v}) as least, max({v}) as most, median({v}) as median"


def _fov_sql() -> str:
    out = []
    for i, (x, y) in enumerate(_CORNERS):
        sx, sy = (350.0, 950.0)[x], (150.0, 750.0)[y]
        px, py = f"(case when ex then {sx} else {x * 1920.0} end)", f"(case when ex then {sy} else {y * 1080.0} end)"
        u, v = f"(({px} + 3) / (k * {px} + 1))", f"(({py} - 4) / (k * {px} + 1))"
        out.append(f"round(a * {u} + b * {v} + tx, 3) as x{i}, round(c * {u} + d * {v} + ty, 3) as y{i}")
    return ", ".join(out)


SQL = {
    "frame_lookup": f"""with {SQL_MATRICES}, q as (select event_id * 2 as e from matrices)
 select e as event_id, round(m.a, 6) as a, round(m.tx, 6) as tx,
  case when e % 3 = 0 and e % 4 <> 1 then e % 700 + 300 when e % 5 <> 0 then 720 else 1080 end as height,
  case when e % 3 = 0 and e % 4 <> 1 then e % 900 + 300 when e % 7 <> 0 then 1280 else 1920 end as width
 from q left join matrices m on m.event_id = e and e % 9 <> 0""",
    "truth_error_table": f"""with {_ERR}, c as (select 'all' as cut, error from err union all select 'at_anchors', error from err where event_id % 10 = 0
  union all select 'between_anchors', error from err where event_id % 10 <> 0 union all select 'gap_100_200', error from err where event_id between 100 and 200)
 select cut, {_SUM} from c group by 1""",
    "truth_worst_slots": f"with {_ERR} select event_id, round(error, 4) as error, round(abs(turn - 360 * floor(turn / 360) - 180), 4) as angle_error from err order by err.error desc, event_id desc limit 10",
    "scene_metrics": f"""with {_ERR}, n as (select event_id % 10 as scene, count(*) as truths from matrices group by 1)
 select event_id % 10 as scene, count(*) as n, round(count(*) / any_value(truths)::double, 4) as coverage, round(median(error), 4) as median, round(quantile_cont(error, 0.95), 4) as p95,
  round(max(error), 4) as max, round(avg(same::int), 4) as det_sign_ok, round(coalesce(median(case when sg > 0 then abs(sp - sg) / sg end), 0), 4) as scale_drift
 from err join n on n.scene = event_id % 10 group by 1""",
    "chain_angles": f"""with {SQL_MATRICES}, r as (select m.event_id, degrees(atan2((m.a * o.c - m.c * o.a) / (m.a * m.d - m.b * m.c), (m.d * o.a - m.b * o.c) / (m.a * m.d - m.b * m.c))) as an
   from matrices m left join matrices o on o.event_id = m.event_id * 2), n as (select *, (round(an, 4) + 180) - 360 * floor((round(an, 4) + 180) / 360) - 180 as q from r),
 s as (select *, q is not null and abs(q) >= 1e-6 as own, q is not null and abs(q) >= 1e-6 and (abs(q - 90) < 1 or abs(q + 90) < 1 or 180 - abs(q) < 1) as near from n)
 select event_id, round(an, 4) as angle, 3 + own::int - near::int as n, round(case when own then q else 90 end, 4) as first_angle from s""",
    "crop_mapping": f"""with {SQL_TRACK}, c as (select event_id, x, y, event_id % 50 as cx, event_id % 30 as cy, event_id % 640 as w, event_id % 480 as h from track)
 select event_id, round(case when w = 0 or h = 0 then x else (x - cx) * 1024.0::double / w end, 4) as u, round(case when w = 0 or h = 0 then y else (y - cy) * 768.0::double / h end, 4) as v, true as returns from c""",
    "fov_polygon": f"""with {SQL_MATRICES}, k as (select *, case when event_id % 6 = 0 then -5.2e-4::double else 1e-5::double end as k, event_id % 6 = 0 as ex from matrices)
 select event_id, ex as exploded, {_fov_sql()} from k""",
    "anchor_interpolation": f"""with {SQL_MATRICES}, t as (select m.*, track_id, seq, m.a * 960 + m.b * 540 + m.tx as px, m.c * 960 + m.d * 540 + m.ty as py from matrices m join track on track.event_id = m.event_id),
 an as (select track_id, seq, px, py, count(*) over (partition by track_id) as k, lead(seq) over w as s2, lead(px) over w as px2, lead(py) over w as py2 from t where seq % 10 = 3 window w as (partition by track_id order by seq))
 select t.event_id, round(case when an.k = 1 or t.seq = an.seq then an.px else an.px * (an.s2 - t.seq) / (an.s2 - an.seq) + an.px2 * (t.seq - an.seq) / (an.s2 - an.seq) end, 3) as mx,
  round(case when an.k = 1 or t.seq = an.seq then an.py else an.py * (an.s2 - t.seq) / (an.s2 - an.seq) + an.py2 * (t.seq - an.seq) / (an.s2 - an.seq) end, 3) as my
 from t left join an on an.track_id = t.track_id and (an.k = 1 or t.seq >= an.seq and (t.seq < an.s2 or an.s2 is null and t.seq = an.seq))""",
    "gap_fallback": f"""with {SQL_TRACK}, g as (select a.track_id, a.seq as lo, b.seq as hi, a.x as x0, a.y as y0, b.x as x1, b.y as y1 from track a join track b on b.track_id = a.track_id and b.seq = a.seq + 10 where a.seq % 20 = 1),
 o as (select t.track_id, t.seq, sqrt((t.x - (x0 + (t.seq - lo) / 10.0::double * (x1 - x0))) ** 2 + (t.y - (y0 + (t.seq - lo) / 10.0::double * (y1 - y0))) ** 2) as off from track t join g on g.track_id = t.track_id and t.seq > lo and t.seq < hi)
 select track_id, seq, round(off, 4) as off from o where o.off > 150""",
    "kinematic_triples": f"""with {SQL_TRACK}, s as (select track_id, seq, seq + seq // 7 as slot, seq % 10 < 4 as fixed from track),
 n as (select track_id, slot as a, lead(slot, 1) over w as b, lead(slot, 2) over w as c, fixed and lead(fixed, 1) over w and lead(fixed, 2) over w as f from s window w as (partition by track_id order by seq))
 select track_id, a, b, c, round((c - b) / (c - a)::double, 6) as alpha, round(1.6::double / (c - a), 6) as weight from n where c is not null and not f""",
    "anchor_quality": f"""with {SQL_TRACK}, p as (select track_id, (seq - 1) // 8 as block, event_id, x, y, x * 2 - y * 0.5 + event_id % 5 + case when seq % 8 = 3 and seq % 3 = 0 then 400 else 0 end as u, x * 0.5 + y * 2 + event_id % 3 as v from track),
 o as (select event_id as left_out, track_id, block from p union all select null, track_id, block from (select distinct track_id, block from p)),
 q as (select o.left_out, p.* from o join p on p.track_id = o.track_id and p.block = o.block and p.event_id is distinct from o.left_out),
 m as (select left_out, track_id, block, count(*) as n, avg(x) as mx, avg(y) as my, avg(u) as mu, avg(v) as mv from q group by 1, 2, 3),
 s as (select q.left_out, q.track_id, q.block, any_value(n) as n, any_value(mx) as mx, any_value(my) as my, any_value(mu) as mu, any_value(mv) as mv,
   sum((x - mx) ** 2) as xx, sum((x - mx) * (y - my)) as xy, sum((y - my) ** 2) as yy, sum((x - mx) * (u - mu)) as xu, sum((y - my) * (u - mu)) as yu, sum((x - mx) * (v - mv)) as xv, sum((y - my) * (v - mv)) as yv
   from q join m on m.left_out is not distinct from q.left_out and m.track_id = q.track_id and m.block = q.block group by 1, 2, 3),
 f as (select *, case when n >= 3 and xx * yy - xy * xy > 1e-9 then xx * yy - xy * xy end as de from s),
 e as (select p.event_id, p.track_id, p.block, f.left_out, n, sqrt(((xu * yy - yu * xy) / de * (x - mx) + (yu * xx - xu * xy) / de * (y - my) + mu - u) ** 2 + ((xv * yy - yv * xy) / de * (x - mx) + (yv * xx - xv * xy) / de * (y - my) + mv - v) ** 2) as er
   from p join f on f.track_id = p.track_id and f.block = p.block and (f.left_out is null or f.left_out = p.event_id)),
 b as (select event_id, any_value(track_id) as track_id, any_value(block) as block, max(case when left_out is null then er end) as error, max(case when left_out is not null and n + 1 between 5 and 12 then er end) as loo from e group by 1),
 d as (select *, median(loo) over (partition by track_id, block) as mid from b)
 select event_id, round(error, 3) as error, round(loo, 3) as loo, coalesce(loo > greatest(mid * 3, 6), false) as suspicious from d""",
    "depth_hints": f"""with {SQL_TRACK}, d as (select event_id, event_type, case when event_id % 11 <> 0 then x / 100.0::double else 0 end as depth from track),
 s as (select event_type, median(depth) as stored from d where depth > 0 group by 1), h as (select event_id, greatest(0.3::double, least(3.5::double, depth / stored)) as hint from d join s on s.event_type = d.event_type)
 select event_id, round(hint, 5) as hint, case when event_id % 4 = 0 then 0.9::double else list_sort(list_transform([1.0::double, 0.7, 1.4, 0.5, 2.0], lambda r, i: {{'d': abs(r - hint), 'i': i, 'r': r}}))[1].r end as first,
  case when event_id % 4 = 0 then 1 else 5 end as n from h""",
    "sign_majority": f"""with {SQL_MATRICES}, s as (select event_id % 3 + case when event_id % 2 = 0 then 3 else event_id % 7 end as scene, a * d - b * c as de from matrices)
 select scene, case when count(case when de < 0 then 1 end) * 2 >= count(*) then -1.0::double else 1.0::double end as sign, min(de) < 0 and max(de) > 0 as mixed, round(median(sqrt(abs(de))), 6) as gsd,
  round(greatest(median(sqrt(abs(de))) * 0.05 * 1920, 3), 4) as threshold from s group by 1""",
    "grid_tiles": """with p as (select p_partkey, p_size * 13 + 200 as w, p_size * 7 + 150 as h from part), g as (select unnest([1, 2, 3]) as k), i as (select k, unnest(range(0, k * k)) as c from g)
 select p_partkey, cast(c + case k when 1 then 0 when 2 then 1 else 5 end as int) as tile, cast((c % k) * (w // k) as int) as x1, cast((c // k) * (h // k) as int) as y1,
  cast(case when c % k = k - 1 then w else (c % k + 1) * (w // k) end as int) as x2, cast(case when c // k = k - 1 then h else (c // k + 1) * (h // k) end as int) as y2 from p, i""",
    "ab_verdict": f"""with {_RUNS}, t as (select count(case when run = 'a' then 1 end) as ta, count(case when run = 'b' then 1 end) as tb, count(case when run = 'a' and ok then 1 end) as n_a, count(case when run = 'b' and ok then 1 end) as n_b,
   median(case when run = 'a' and ok then inliers end) as ma, median(case when run = 'b' and ok then inliers end) as mb from runs),
 f as (select frame, bool_or(run = 'a') as a, bool_or(run = 'b') as b from runs where ok group by 1), j as (select count(case when a and b then 1 end) / count(*)::double as j from f)
 select n_a, n_b, round(ma, 4) as median_a, round(mb, 4) as median_b, round(j, 6) as jaccard,
  concat_ws(',', case when n_b / tb::double < n_a / ta::double - 0.02 then 'success' end, case when j < 0.9 then 'frames' end, case when mb < ma - 50 then 'inliers' end) as worse from t, j""",
    "stage_timings": f"""with r as (select event_type, value, row_number() over (partition by event_type order by value) - 1 as i, count(*) over (partition by event_type) as n from events where value is not null),
 s as (select event_type, {_TIMES.format(v="value")}, max(case when i = least(n - 1, floor(n * 0.95::double)) then value end) as p95 from r group by 1)
 select event_type, calls, round(total, 4) as total, round(mean, 4) as mean, round(least, 4) as least, round(most, 4) as most, round(median, 4) as median, round(p95, 4) as p95 from s""",
    "benchmark_ratio": """with m as (select l_linenumber, median(case when l_returnflag = 'N' then l_quantity end) as a, median(case when l_returnflag <> 'N' then l_quantity end) as b from lineitem group by 1)
 select l_linenumber, a, b, round(b / a, 6) as ratio, b / a > 1.0 as slower from m where a <> 0 and b is not null""",
    "spread_statistics": f"""with {SQL_TRACK}, s as (select case when count(*) >= 2 then least(stddev_pop(x), stddev_pop(y)) / 1080.0 end as s from track group by track_id)
 select count(s) as n, round(avg(s), 6) as mean, round(min(s), 6) as least, round(count(case when s < 0.02 then 1 end) * 100.0::double / count(s), 4) as low from s""",
    "candidate_order": """with c as (select l_suppkey, l_partkey, count(*) as matches, max(l_quantity * 1000 + l_linenumber) as score from lineitem group by 1, 2),
 r as (select *, row_number() over (partition by l_suppkey order by matches desc, score desc, l_partkey) as place from c) select l_suppkey, l_partkey, matches, place from r where place <= 5""",
    "active_set_changes": f"""with {SQL_FIXES}, a as (select event_id, track_id, seq, cast(floor(lat * 20) as bigint) || ',' || cast(floor(lon * 20) as bigint) as active from fixes),
 b as (select event_id, active, lag(active) over (partition by track_id order by seq) as was from a) select event_id, active from b where was is distinct from active""",
    "log_temporal_prior": f"with {SQL_TRACK}, m as (select max(event_id) as e from track where event_id % 10 = 0) select e as tries, e - e % 7 as hits, round(case when e > 0 then 100.0::double * (e - e % 7) / e else 0 end, 6) as hit_rate from m",
    "reprojection_errors": f"""with {SQL_MATRICES}, s as (select *, (event_id % 5) * 1e-4::double * x + (event_id % 3) * 1e-4::double * y + 1 as w from matrices)
 select event_id, round(sqrt(((a * x + b * y + tx) / w - y) ** 2 + ((c * x + d * y + ty) / w - x) ** 2), 4) as error from s""",
}
