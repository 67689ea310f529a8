"""Pose-graph queries over edges between the rows of a track."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import affine
from ..functions.scores import edge_weight, spread_weight
from ..operators import graph as G
from .views import FRAME_H, FRAME_W, SQL_EDGES, edges, poses, r6


def _residuals(spark, sf_dir):
    return G.residuals(edges(spark, sf_dir), poses(spark, sf_dir), 960.0)


def edge_residuals(spark, sf_dir):
    rows = _residuals(spark, sf_dir)
    return rows.select("edge_id", *[r6(f"r{k}", 4).alias(f"r{k}") for k in range(5)], r6("residual", 4).alias("residual"))


def edge_residual_stats(spark, sf_dir):
    stats = G.residual_stats(_residuals(spark, sf_dir))
    return stats.select("edge_type", "n", *[r6(c, 4).alias(c) for c in ("median", "p95", "max")])


def worst_edges(spark, sf_dir):
    rows = _residuals(spark, sf_dir).where("residual is not null")
    return rows.orderBy(F.col("residual").desc(), "edge_id").limit(20).select("edge_id", r6("residual", 4).alias("residual"))


def anchor_stress(spark, sf_dir):
    anchors = poses(spark, sf_dir).where("seq % 10 = 1")
    return G.anchor_stress(_residuals(spark, sf_dir), anchors).select("node", r6("stress", 4).alias("stress"))


def _step_matrix():
    return affine.compose(F.col("dx") * 10, F.col("dy") * 10, F.exp(F.col("log_dsx") * 15), F.exp(F.col("log_dsy") * 15), F.col("dtheta") * 20)


def edge_gates(spark, sf_dir):
    m = _step_matrix()
    reason = affine.temporal_edge_reason(m, F.lit(1), FRAME_W, FRAME_H, shift=0.2)
    ok = affine.passes_gate(m, F.col("inliers"), F.lit(100), F.lit(None).cast("double"), ratio=1.2)
    return edges(spark, sf_dir).select("edge_id", reason.alias("reason"), ok.alias("passes"))


def edge_weights(spark, sf_dir):
    w = edge_weight(F.col("weight"), F.col("inliers"), F.col("rmse")) * spread_weight(F.col("rmse") / 10.0)
    return edges(spark, sf_dir).select("edge_id", r6(w).alias("weight"))


def cluster_support(spark, sf_dir):
    pairs = edges(spark, sf_dir).where("edge_type = 'spatial'").select("edge_id", F.col("from_id").alias("i"), F.col("to_id").alias("j"))
    return G.cluster_support(pairs).select("edge_id", "factor")


def gap_downweight(spark, sf_dir):
    """Gaps of 40 ids from every multiple of 100 on."""
    rows = edges(spark, sf_dir)
    gaps = rows.select((F.floor(F.col("to_id") / 100) * 100).cast("long").alias("lo")).distinct().withColumn("hi", F.col("lo") + 40)
    near = rows.withColumn("from_id", F.col("to_id") - F.col("to_id") % 3)
    return G.gap_downweight(near, gaps).select("edge_id", r6("weight").alias("weight"))


def frame_qa(spark, sf_dir):
    return G.frame_quality(edges(spark, sf_dir)).select("node", "matches", r6("rmse").alias("rmse"))


def frame_disagreement(spark, sf_dir):
    rows = G.disagreement(edges(spark, sf_dir), poses(spark, sf_dir))
    return rows.select("node", r6("disagreement", 4).alias("disagreement"), "n")


def prune_spatial(spark, sf_dir):
    rows = _residuals(spark, sf_dir).select("edge_id", "from_id", "to_id", "edge_type", "residual")
    return G.prune(rows, poses(spark, sf_dir).where("seq % 10 = 1")).select("edge_id", "pruned")


def odometry_factors(spark, sf_dir):
    """Spatial edges, some of them stretched, against the chain; frames are small, so that some are off."""
    nodes = poses(spark, sf_dir)
    rows = edges(spark, sf_dir).where("edge_type = 'spatial'").withColumn("dx", F.col("dx") * F.when(F.col("to_id") % 5 == 0, 40.0).otherwise(8.0))
    found = G.odometry_factors(rows, nodes, F.lit(3), G.usual_step(nodes, "track_id", "seq"), 64.0, 48.0)
    return found.select("edge_id", "factor")


def reachability(spark, sf_dir):
    """Hops along temporal edges from the nearest anchor, every tenth row of a track."""
    links = edges(spark, sf_dir).where("edge_type = 'temporal'")
    anchors = poses(spark, sf_dir).where("seq % 10 = 1")
    return G.reachable(links, anchors).select("node", F.col("hop").cast("long").alias("hop"))


def bfs_propagation(spark, sf_dir):
    links = edges(spark, sf_dir).where("edge_type = 'temporal'")
    anchors = poses(spark, sf_dir).where("seq % 10 = 1")
    return G.propagate(links, anchors).select("node", "hop", *[r6(n, 4).alias(n) for n in G.POSE])


def anchor_gap_check(spark, sf_dir):
    rows = poses(spark, sf_dir)
    steps = edges(spark, sf_dir).where("edge_type = 'temporal'").select(
        "track_id", "seq", (F.col("dx") * 10).alias("dx"), (F.col("dy") * 10 + F.when(F.col("to_id") % 19 == 0, 50.0).otherwise(0.0)).alias("dy")
    )
    return G.chain_gaps(steps, rows.where("seq % 10 = 1"), 20.0)


def pose_graph_solve(spark, sf_dir):
    """Least squares of all rows of each track, which form one component; every tenth row is an anchor."""
    nodes = poses(spark, sf_dir).select(
        F.col("track_id").alias("component"), "node", *G.POSE, (F.col("seq") % 10 == 1).alias("is_anchor")
    )
    links = edges(spark, sf_dir).withColumn("component", F.col("track_id"))
    return G.solve(nodes, links, 960.0).select("node", *[r6(n, 3).alias(n) for n in G.POSE])


NAMES = [
    edge_residuals, edge_residual_stats, worst_edges, anchor_stress, edge_gates, edge_weights, cluster_support, gap_downweight,
    frame_qa, frame_disagreement, prune_spatial, odometry_factors, reachability, bfs_propagation, anchor_gap_check, pose_graph_solve,
]
QUERIES = {f.__name__: f for f in NAMES}

_RES = f"""{SQL_EDGES}, q as (select e.*, i.x as ix, i.y as iy, i.log_sx as ilx, i.log_sy as ily, i.theta as ith, j.x as jx, j.y as jy, j.log_sx as jlx, j.log_sy as jly, j.theta as jth
   from edges e left join poses i on i.node = e.from_id left join poses j on j.node = e.to_id),
 r as (select *, weight / exp(ilx) * (jx - (ix + cos(ith) * exp(ilx) * dx - sin(ith) * exp(ily) * dy)) as r0,
   weight / exp(ily) * (jy - (iy + sin(ith) * exp(ilx) * dx + cos(ith) * exp(ily) * dy)) as r1,
   weight * 960 * (jlx - ilx - log_dsx) as r2, weight * 960 * (jly - ily - log_dsy) as r3,
   weight * 960 * atan2(sin(jth - ith - dtheta), cos(jth - ith - dtheta)) as r4 from q),
 res as (select *, sqrt(r0 ** 2 + r1 ** 2 + r2 ** 2 + r3 ** 2 + r4 ** 2) as residual from r)"""
_BOTH = """links as (select from_id as node, to_id as other, true as fw, * exclude (from_id, to_id) from edges union all select to_id, from_id, false, * exclude (from_id, to_id) from edges)"""
SQL = {
    "edge_residuals": f"with {_RES} select edge_id, round(r0, 4) as r0, round(r1, 4) as r1, round(r2, 4) as r2, round(r3, 4) as r3, round(r4, 4) as r4, round(residual, 4) as residual from res",
    "edge_residual_stats": f"with {_RES} select edge_type, count(*) as n, round(median(residual), 4) as median, round(quantile_cont(residual, 0.95), 4) as p95, round(max(residual), 4) as max from res where residual is not null group by 1",
    "worst_edges": f"with {_RES} select edge_id, round(residual, 4) as residual from res where residual is not null order by res.residual desc, edge_id limit 20",
    "anchor_stress": f"""with {_RES}, ends as (select from_id as node, residual from res union all select to_id, residual from res)
 select ends.node, round(avg(residual) / (select median(residual) from res), 4) as stress from ends join poses on poses.node = ends.node and seq % 10 = 1 where residual is not null group by 1""",
    "edge_gates": f"""with {SQL_EDGES}, m as (select edge_id, inliers, dx * 10 as tx, dy * 10 as ty, exp(log_dsx * 15) as sx, exp(log_dsy * 15) as sy, dtheta * 20 as an from edges),
 c as (select *, cos(an) * sx * 960 - sin(an) * sy * 540 + tx - 960 as ox, sin(an) * sx * 960 + cos(an) * sy * 540 + ty - 540 as oy, abs(degrees(atan2(sin(an) * sx, cos(an) * sx))) as rot from m)
 select edge_id, case when rot > 30 then 'rotation' when abs(ln(sx)) > ln(1.4) or abs(ln(sy)) > ln(1.4) then 'scale' when sqrt(ox ** 2 + oy ** 2) > 0.2 * sqrt(1920.0 ** 2 + 1080.0 ** 2) then 'shift' end as reason,
   rot <= 40 and inliers / 100.0 >= 0.25 and abs(ln(sx)) <= ln(1.2) and abs(ln(sy)) <= ln(1.2) as passes from c""",
    "edge_weights": f"with {SQL_EDGES} select edge_id, round(weight * sqrt(greatest(inliers::double, 1)) / (rmse + 1) * (1 / (1 + 10 * greatest(0, 0.15 - rmse / 10.0))), 6) as weight from edges",
    "cluster_support": f"""with {SQL_EDGES}, p as (select edge_id, from_id as i, to_id as j from edges where edge_type = 'spatial')
 select a.edge_id, case when exists (select 1 from p b where b.edge_id <> a.edge_id and least(abs(a.i - b.i) + abs(a.j - b.j), abs(a.i - b.j) + abs(a.j - b.i)) <= 6) then 1.0::double else 0.5::double end as factor from p a""",
    "gap_downweight": f"with {SQL_EDGES} select edge_id, round(weight * case when edge_type = 'temporal' and (to_id - to_id % 3) >= (to_id // 100) * 100 and to_id % 100 <= 40 then 0.05::double else 1.0::double end, 6) as weight from edges",
    "frame_qa": f"with {SQL_EDGES}, e as (select from_id as node, inliers, rmse from edges union all select to_id, inliers, rmse from edges) select node, trunc(avg(inliers))::int as matches, round(avg(case when rmse > 0 then rmse end), 6) as rmse from e group by 1",
    "frame_disagreement": f"""with {SQL_EDGES}, {_BOTH}, g as (select l.other, l.fw, p.x, p.y, p.theta, p.log_sx, p.log_sy,
   case when l.fw then l.dx else exp(-l.log_dsx) * (-(cos(l.dtheta) * l.dx + sin(l.dtheta) * l.dy)) end as dx,
   case when l.fw then l.dy else exp(-l.log_dsy) * (sin(l.dtheta) * l.dx - cos(l.dtheta) * l.dy) end as dy from links l join poses p on p.node = l.node),
 h as (select other, x + cos(theta) * exp(log_sx) * dx - sin(theta) * exp(log_sy) * dy as px, y + sin(theta) * exp(log_sx) * dx + cos(theta) * exp(log_sy) * dy as py from g),
 m as (select other, avg(px) as mx, avg(py) as my, count(*) as n from h group by 1 having count(*) >= 2)
 select h.other as node, round(avg(sqrt((px - mx) ** 2 + (py - my) ** 2)), 4) as disagreement, max(n) as n from h join m on m.other = h.other group by 1""",
    "prune_spatial": f"""with {_RES}, k as (select edge_id, residual from res where edge_type = 'spatial' and residual is not null),
 m as (select median(residual) as m, count(*) as n from k), d as (select median(abs(residual - m)) as d, any_value(m) as m, any_value(n) as n from k, m),
 b as (select edge_id, row_number() over (order by residual desc, edge_id) as r from k, d where residual > m + d * (5.0 * 1.4826))
 select e.edge_id, b.edge_id is not null as pruned from edges e left join b on b.edge_id = e.edge_id and b.r <= (select floor(n * 0.2) from d)""",
    "odometry_factors": f"""with {SQL_EDGES}, l as (select sqrt((x - lag(x) over w) ** 2 + (y - lag(y) over w) ** 2) as way from poses window w as (partition by track_id order by seq)),
 s as (select edge_id, from_id, to_id, dx * case when to_id % 5 = 0 then 40.0::double else 8.0::double end as dx, dy from edges where edge_type = 'spatial'),
 o as (select edge_id, i.log_sx, sqrt((i.x + cos(i.theta) * exp(i.log_sx) * dx - sin(i.theta) * exp(i.log_sy) * dy - j.x) ** 2 + (i.y + sin(i.theta) * exp(i.log_sx) * dx + cos(i.theta) * exp(i.log_sy) * dy - j.y) ** 2) as away
   from s join poses i on i.node = s.from_id join poses j on j.node = s.to_id)
 select edge_id, case when away > exp(log_sx) * 80 * 1.5 + 3 * 0.25 * (select coalesce(median(way), 0) from l) then 0.3::double else 1.0::double end as factor from o""",
    "reachability": f"""with {SQL_EDGES}, l as (select track_id, max(seq) as n from poses group by 1)
 select node, case when ((seq - 1) // 10) * 10 + 11 <= n then least((seq - 1) % 10, 10 - (seq - 1) % 10) else (seq - 1) % 10 end as hop from poses join l on l.track_id = poses.track_id""",
    "bfs_propagation": f"""with recursive {SQL_EDGES}, t as (select * from edges where edge_type = 'temporal'),
 a as (select node, node as parent, 0 as hop, x, y, log_sx, log_sy, theta from poses where seq % 10 = 1),
 fw as (select * from a union all select t.to_id, t.from_id, hop + 1, x + cos(theta) * exp(log_sx) * dx - sin(theta) * exp(log_sy) * dy,
   y + sin(theta) * exp(log_sx) * dx + cos(theta) * exp(log_sy) * dy, log_sx + log_dsx, log_sy + log_dsy, theta + dtheta from fw join t on t.from_id = fw.node where hop < 10),
 iv as (select from_id, to_id, exp(-log_dsx) * (-(cos(dtheta) * dx + sin(dtheta) * dy)) as dx, exp(-log_dsy) * (sin(dtheta) * dx - cos(dtheta) * dy) as dy, log_dsx, log_dsy, dtheta from t),
 bw as (select * from a union all select iv.from_id, iv.to_id, hop + 1, x + cos(theta) * exp(log_sx) * dx - sin(theta) * exp(log_sy) * dy,
   y + sin(theta) * exp(log_sx) * dx + cos(theta) * exp(log_sy) * dy, log_sx - log_dsx, log_sy - log_dsy, theta - dtheta from bw join iv on iv.to_id = bw.node where hop < 10),
 r as (select *, row_number() over (partition by node order by hop, parent) as r from (select * from fw union all select * from bw))
 select node, hop, round(x, 4) as x, round(y, 4) as y, round(log_sx, 4) as log_sx, round(log_sy, 4) as log_sy, round(theta, 4) as theta from r where r = 1""",
    "anchor_gap_check": f"""with {SQL_EDGES}, s as (select track_id, seq, dx * 10 as dx, dy * 10 + case when to_id % 19 = 0 then 50.0::double else 0 end as dy from edges where edge_type = 'temporal'),
 a as (select track_id, seq, x, y, lead(seq) over w as nxt, lead(x) over w as tx, lead(y) over w as ty from poses where seq % 10 = 1 window w as (partition by track_id order by seq)),
 g as (select a.track_id, a.seq, a.nxt, any_value(tx - x) as ex, any_value(ty - y) as ey, count(s.seq) as steps, sum(dx) as sx, sum(dy) as sy from a left join s on s.track_id = a.track_id and s.seq > a.seq and s.seq <= a.nxt where a.nxt is not null group by 1, 2, 3)
 select track_id, seq, nxt as to, steps, case when steps < nxt - seq then 'broken' when sqrt((ex - sx) ** 2 + (ey - sy) ** 2) > 20 then 'inconsistent' else 'ok' end as state from g""",
}
