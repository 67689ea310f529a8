"""Queries on stored frames, features and calibrations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import affine, geo
from ..operators import calibrated, graph, scenes
from ..sources import calibrations, exports, frames, schema
from .graph_queries import _RES
from .views import FRAME_H, FRAME_W, SQL_EDGES, SQL_FIXES, SQL_MATRICES, SQL_TRACK, edges, fixes, matrices, matrix, poses, r6, track, vectors

#: Keypoints that a stored frame has room for.
ROOM = 12


def frame_features(spark, sf_dir):
    """Vectors in pieces of four are the keypoints of a frame, as many as its label tells; they are padded, stored and trimmed again.

    Each frame asks for the fifth after it, so that some ask for frames that are not there.
    """
    rows = vectors(spark, sf_dir).withColumnRenamed("ref_id", "frame_id")
    pieces = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.slice("vector", i * 4 + 1, 4))
    held = rows.select("frame_id", F.slice(pieces, 1, (F.col("label") % 17).cast("int")).alias("keypoints"))
    stored = frames.padded(held, ROOM, {"keypoints": F.array_repeat(F.lit(0.0).cast("float"), 4)})
    asked = rows.select((F.col("frame_id") + 5).alias("frame_id"))
    found = frames.frame_features(asked, rows, stored, ["keypoints"], (F.lit(None).cast("int"), F.lit(1280)))
    total = F.aggregate(F.flatten("keypoints"), F.lit(0.0), lambda s, v: s + v.cast("double"))
    return found.select("frame_id", "kp_count", "status", r6(total, 5).alias("total"), "height", "width")


def _texts(spark, sf_dir) -> DataFrame:
    """A calibration for each matrix, in turn of the first, second and third version, broken, and with a frame size that is none."""
    m = F.array(F.array("a", "b", "tx"), F.array("c", "d", "ty"))
    e = F.col("event_id")
    anchor = lambda frame, **more: F.struct(frame.alias("frame_id"), m.alias("affine_matrix"), *[v.alias(n) for n, v in more.items()])
    rmse = (e % 13 / 10.0).alias("rmse_m")
    first = F.to_json(F.struct(e.alias("calib_frame_id"), m.alias("affine_matrix")))
    second = F.struct(F.lit("2.0").alias("version"), F.array("x", "y").alias("reference_gps"), F.array(F.lit(1920), F.lit(1080)).alias("frame_size"))
    second = F.to_json(second.withField("anchors", F.array(anchor(e, rmse_m=rmse), anchor(e + 1, rmse_m=rmse))))
    third = F.struct(F.lit("3.0").alias("version"), F.struct(F.lit("UTM").alias("mode"), F.array("x", "y").alias("reference_gps")).alias("projection"))
    third = F.to_json(third.withField("anchors", F.array(anchor(e, qa_data=F.struct(rmse)))))
    sizeless = F.struct(F.lit("3.0").alias("version"), F.array(F.lit(0), F.lit(1080)).alias("frame_size"), F.array(anchor(e)).alias("anchors"))
    text = F.when(e % 5 == 0, first).when(e % 5 == 1, second).when(e % 5 == 2, third).when(e % 5 == 3, F.substring(first, 1, 20)).otherwise(F.to_json(sizeless))
    return matrices(spark, sf_dir).select("event_id", text.alias("text"))


def calibration_versions(spark, sf_dir):
    found = calibrations.anchors(_texts(spark, sf_dir), "text", ["event_id"])
    return found.select("event_id", "frame_id", "mode", r6("ref_lat").alias("ref_lat"), "width", r6(affine.det(matrix())).alias("det"), r6("rmse_m").alias("rmse_m"))


def calibration_saved(spark, sf_dir):
    """The solution of a track, of which rows of type `error` were not reached and are filled."""
    slots = track(spark, sf_dir).select("track_id", "seq", F.col("event_id").alias("node"), "event_type")
    reached = slots.where("event_type <> 'error'").select("node")
    results = matrices(spark, sf_dir).withColumnRenamed("event_id", "node").join(reached, "node")
    out = calibrated.solution_table(slots, results, edges(spark, sf_dir), ["track_id"], "seq", FRAME_W, FRAME_H)
    return out.select(
        F.col("node").alias("event_id"), "valid", "filled", *[r6(n, 5).alias(n) for n in calibrated.MATRIX], "matches", r6("rmse").alias("rmse"),
        r6("disagreement", 5).alias("disagreement"), r6("lat", 9).alias("lat"), r6("lon", 9).alias("lon"),
    )


def graph_geojson(spark, sf_dir):
    """Points and lines of the pose graph, read back from their GeoJSON; every tenth row of a track is an anchor."""
    places = fixes(spark, sf_dir).select(F.col("event_id").alias("node"), "lat", "lon", (F.col("seq") % 10 == 1).alias("anchor"))
    found = exports.graph_features(places, graph.residuals(edges(spark, sf_dir), poses(spark, sf_dir), FRAME_W / 2))
    of = lambda path: F.get_json_object("feature", f"$.{path}")
    number = lambda path, name, digits=6: F.round(of(path).cast("double"), digits).alias(name)
    start = lambda i: F.round(F.coalesce(of(f"geometry.coordinates[0][{i}]"), of(f"geometry.coordinates[{i}]")).cast("double"), 6)
    return found.select(
        "kind", "id", of("geometry.type").alias("shape"), start(0).alias("lon"), start(1).alias("lat"), number("geometry.coordinates[1][0]", "to_lon"),
        number("geometry.coordinates[1][1]", "to_lat"), number("properties.weight", "weight"), number("properties.residual", "residual", 4),
    )


def paired_runs(spark, sf_dir):
    """Rows of type `click` of a track are one run and those of type `view` another; equally long ones are paired by position."""
    side = F.when(F.col("event_type") == "click", "a").when(F.col("event_type") == "view", "b")
    runs = fixes(spark, sf_dir).select("track_id", side.alias("side"), "seq", "event_id", "lat", "lon").where("side is not null")
    pairs = scenes.pair_runs(runs, ["track_id"], "side", ["seq"], ["event_id", "lat", "lon"])
    metres = geo.haversine(F.col("a_lat"), F.col("a_lon"), F.col("b_lat"), F.col("b_lon"))
    return pairs.select("track_id", "place", F.col("a_event_id").alias("a"), F.col("b_event_id").alias("b"), r6(metres, 3).alias("metres"))


def schema_gate(spark, sf_dir):
    """Each row is a source with three components, of which its type may differ from the first row's; some know nothing."""
    e = F.col("event_id")
    known = lambda v: F.when(e % 11 != 7, v)
    rows = track(spark, sf_dir).select(e.alias("source_id"), known(F.col("event_type")).alias("kind"), known((e % 3).cast("string")).alias("step"), known((e % 2).cast("string")).alias("dim"))
    base = rows.join(F.broadcast(rows.agg(F.min("source_id").alias("source_id"))), "source_id")  # one row
    return schema.gate(rows, base, {"kind"})


NAMES = [frame_features, calibration_versions, calibration_saved, graph_geojson, paired_runs, schema_gate]
QUERIES = {f.__name__: f for f in NAMES}

_LINE = "(l.{0} * (1 - z) + r.{0} * z)"
_SQL_FILL = f"""{SQL_MATRICES}{SQL_EDGES[len(SQL_TRACK):]},
 res as (select m.event_id, m.a, m.b, m.tx, m.c, m.d, m.ty from matrices m join track t on t.event_id = m.event_id where t.event_type <> 'error'),
 k as (select t.track_id, t.seq, t.event_id, case when r.a is not null then struct_pack(s := t.seq, a := r.a, b := r.b, tx := r.tx, c := r.c, d := r.d, ty := r.ty,
   u := sqrt(r.a * r.a + r.c * r.c), v := sqrt(r.b * r.b + r.d * r.d), g := atan2(r.c, r.a)) end as o from track t left join res r on r.event_id = t.event_id),
 w as (select *, last_value(o ignore nulls) over (partition by track_id order by seq rows between unbounded preceding and current row) as l,
   first_value(o ignore nulls) over (partition by track_id order by seq rows between current row and unbounded following) as r from k),
 z as (select *, o is null and l is not null and r is not null as inside, case when r.s > l.s then (seq - l.s)::double / (r.s - l.s) end as z from w),
 y as (select *, greatest(1e-6, least(1e6, {_LINE.format('u')})) as sx, greatest(1e-6, least(1e6, {_LINE.format('v')})) as sy, case when l.a * l.d - l.b * l.c < 0 then -1.0::double else 1.0::double end as sg,
   l.g + (r.g - l.g - 2 * pi() * floor((r.g - l.g + pi()) / (2 * pi()))) * z as g from z),
 f as (select event_id, coalesce(o, l, r) is not null as valid, o is null and coalesce(l, r) is not null as filled,
   case when inside then cos(g) * sx else coalesce(o, l, r).a end as a, case when inside then -sin(g) * sg * sy else coalesce(o, l, r).b end as b,
   case when inside then {_LINE.format('tx')} else coalesce(o, l, r).tx end as tx, case when inside then sin(g) * sx else coalesce(o, l, r).c end as c,
   case when inside then cos(g) * sg * sy else coalesce(o, l, r).d end as d, case when inside then {_LINE.format('ty')} else coalesce(o, l, r).ty end as ty from y),
 ends as (select edge_id, from_id as node, to_id as other, 0 as side, inliers, rmse from edges union all select edge_id, to_id, from_id, 1, inliers, rmse from edges),
 tot as (select node, floor(avg(inliers))::int as matches, coalesce(avg(case when rmse > 0 then rmse end), 0) as rmse from ends group by node),
 fst as (select *, row_number() over (partition by node order by edge_id, side) as n from ends),
 spr as (select e.node, stddev_pop(res.tx) as disagreement from fst e join res on res.event_id = e.other where e.n <= 5 group by e.node)"""
SQL = {
    "frame_features": """with p as (select vec_id, least(label % 17, 12)::int as n, embedding::double[] as v from embeddings),
 q as (select a.vec_id + 5 as frame_id, p.n, p.v from embeddings a left join p on p.vec_id = a.vec_id + 5)
 select frame_id, coalesce(n, 0) as kp_count, case when n is null then 'unknown frame' when n = 0 then 'no keypoints' else 'ok' end as status,
 case when n > 0 then round(list_sum(v[1 : n * 4]), 5) end as total, 1080 as height, 1280 as width from q""",
    "graph_geojson": f"""with {_RES}, p as (select event_id, seq, x / 1000.0::double + 48.0 as lat, y / 1000.0::double + 25.0 as lon from track)
 select case when seq % 10 = 1 then 'anchor' else 'frame' end as kind, event_id as id, 'Point' as shape, round(lon, 6) as lon, round(lat, 6) as lat,
   null::double as to_lon, null::double as to_lat, null::double as weight, null::double as residual from p
 union all select 'edge', edge_id, 'LineString', round(i.lon, 6), round(i.lat, 6), round(j.lon, 6), round(j.lat, 6), round(weight, 6), round(residual, 4)
 from res join p i on i.event_id = from_id join p j on j.event_id = to_id""",
    "paired_runs": f"""with {SQL_FIXES}, s as (select *, case event_type when 'click' then 'a' else 'b' end as side from fixes where event_type in ('click', 'view')),
 n as (select *, row_number() over (partition by track_id, side order by seq) - 1 as place, count(*) over (partition by track_id, side) as n from s),
 q as (select a.track_id, a.place, a.event_id as a, b.event_id as b, sin(radians(b.lat - a.lat) / 2) ** 2 + cos(radians(a.lat)) * cos(radians(b.lat)) * sin(radians(b.lon - a.lon) / 2) ** 2 as h
   from n a join n b on a.track_id = b.track_id and a.place = b.place and a.n = b.n and a.side = 'a' and b.side = 'b')
 select track_id, place, a, b, round(2 * 6371000.0 * atan2(sqrt(h), sqrt(greatest(0, 1 - h))), 3) as metres from q""",
    "schema_gate": """with c as (select event_id as i, event_id % 11 <> 7 as known, case when event_id % 11 <> 7 then event_type end as k, case when event_id % 11 <> 7 then event_id % 3 end as s, case when event_id % 11 <> 7 then event_id % 2 end as d from events),
 b as (select known as bknown, k as bk, s as bs, d as bd from c where i = (select min(event_id) from events)),
 t as (select *, (s is distinct from bs)::int + (d is distinct from bd)::int as confounders, (k is distinct from bk)::int as kd from c, b)
 select i as source_id, kd + confounders as differing, confounders, case when not (known and bknown) then 'incomparable' when kd + confounders = 0 then 'identical' when confounders > 0 then 'confounded' else 'valid' end as verdict from t""",
    "calibration_versions": f"""with {SQL_MATRICES}, m as (select event_id, event_id % 5 as k, x, round(a * d - b * c, 6) as det, round((event_id % 13) / 10.0::double, 6) as rmse from matrices)
 select event_id, event_id + j as frame_id, case when k in (1, 2) then 'UTM' else 'WEB_MERCATOR' end as mode, case when k in (1, 2) then round(x, 6) end as ref_lat,
 case when k = 1 then 1920 end as width, det, case when k in (1, 2) then rmse end as rmse_m from m, range(0, 2) t(j) where k <> 3 and (j = 0 or k = 1)""",
    "calibration_saved": f"""with {_SQL_FILL}
 select f.event_id, valid, filled, round(a, 5) as a, round(b, 5) as b, round(tx, 5) as tx, round(c, 5) as c, round(d, 5) as d, round(ty, 5) as ty,
 case when valid then coalesce(matches, 0) else 0 end as matches, round(case when valid then coalesce(rmse, 0) else 0 end, 6) as rmse,
 round(case when valid then coalesce(disagreement, 0) else 0 end, 5) as disagreement,
 case when valid then round(degrees(atan(exp((c * 960 + d * 540 + ty) / 6378137.0)) * 2 - pi() / 2), 9) end as lat, case when valid then round(degrees((a * 960 + b * 540 + tx) / 6378137.0), 9) end as lon
 from f left join tot on tot.node = f.event_id left join spr on spr.node = f.event_id""",
}
