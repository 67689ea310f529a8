"""Evaluation queries: error summaries, gates, percentiles, comparison of runs, schema checks, exports and parsing."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scores
from ..operators import metrics
from ..session import table
from ..sources import exports, logs, schema
from .views import FRAME_H, FRAME_W, SQL_FIXES, SQL_TRACK, fixes, r6, track


def latency_nearest_rank(spark, sf_dir):
    return metrics.nearest_ranks(table(spark, sf_dir, "events"), "value", {"p50": 0.5, "p95": 0.95, "p99": 0.99}, ["event_type"])


def percentile_floor_index(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_type", "value")
    return metrics.floor_index(rows, "value", 0.95, ["event_type"])


def mad_outliers(spark, sf_dir):
    rows = track(spark, sf_dir).select("event_id", "event_type", "x")
    return metrics.mad_outliers(rows, "x", ["event_type"], k=0.5).select("event_id", r6("limit").alias("limit"), "keep")


def spread_by_group(spark, sf_dir):
    rows = track(spark, sf_dir).groupBy("track_id").agg(metrics.inlier_spread("x", "y", FRAME_W, FRAME_H).alias("spread"))
    return rows.select(
        "track_id", r6("spread").alias("spread"), r6(scores.spread_confidence(F.col("spread"))).alias("confidence"),
        r6(scores.spread_weight(F.col("spread"))).alias("weight"),
    )


def confidence_score(spark, sf_dir):
    e = F.col("event_id")
    c = scores.confidence(e % 120, e % 120 + 30, e % 9 / 2.0, e % 12, e % 7)
    flow = scores.flow_confidence(F.col("x") / 400.0)
    return track(spark, sf_dir).select("event_id", r6(c).alias("confidence"), r6(flow, 8).alias("flow"), r6(scores.flow_noise_scale(flow)).alias("noise_scale"))


def affine_lsq_by_group(spark, sf_dir):
    """Fit of an affine to a distorted copy of each track."""
    x, y, e = F.col("x"), F.col("y"), F.col("event_id")
    rows = track(spark, sf_dir).select("track_id", "x", "y", (x * 2 - y * 0.5 + 10 + e % 5).alias("u"), (x * 0.5 + y * 2 - 7 + e % 3).alias("v"))
    fit = metrics.affine_fit(rows, ["track_id"])
    return fit.select("track_id", "n", *[r6(c, 4).alias(c) for c in ("a", "b", "tx", "c", "d", "ty")])


def _errors(spark, sf_dir):
    """The signal against its value three rows before, as a prediction against the truth."""
    w = W.partitionBy("track_id").orderBy("seq")
    return track(spark, sf_dir).withColumn("error", F.abs(F.col("x") - F.lag("x", 3).over(w)))


def error_cuts_report(spark, sf_dir):
    near = F.least((F.col("seq") - 1) % 10, 10 - (F.col("seq") - 1) % 10)
    cuts = {"overall": F.lit(True), "near_anchor": near <= 1, "mid_leg": near >= 4, "turn_arcs": F.col("y") >= 50, "straights": F.col("y") < 50}
    found = metrics.cut_report(_errors(spark, sf_dir), "error", cuts)
    return found.select("cut", "n", *[r6(c, 4).alias(c) for c in ("median", "p95", "max", "mean")])


def pred_vs_gt_metrics(spark, sf_dir):
    found = metrics.summarize(_errors(spark, sf_dir), "error", ["track_id"])
    return found.select("track_id", "n", *[r6(c, 4).alias(c) for c in ("median", "p95", "max", "mean")])


def regression_gate(spark, sf_dir):
    rows = _errors(spark, sf_dir)
    now = metrics.summarize(rows.where("event_id % 2 = 0"), "error", ["event_type"])
    base = metrics.summarize(rows.where("event_id % 2 = 1"), "error", ["event_type"])
    found = metrics.regression_gate(now, base, ["event_type"], median=0.02)
    return found.select("event_type", *[r6(c, 4).alias(c) for c in ("median", "base_median", "max", "base_max")], "passed")


def _runs(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return tuple(orders.where(F.col("o_orderkey") % 2 == i).select("o_custkey", "o_totalprice") for i in (0, 1))


def matched_jaccard(spark, sf_dir):
    a, b = _runs(spark, sf_dir)
    found = metrics.set_jaccard(a, b, "o_custkey")
    return found.select(F.col("shared").cast("long").alias("shared"), "all", r6("jaccard").alias("jaccard"))


def only_in_b(spark, sf_dir):
    a, b = _runs(spark, sf_dir)
    return b.select("o_custkey").subtract(a.select("o_custkey")).orderBy("o_custkey").limit(12)


def ab_compare(spark, sf_dir):
    """Both runs by number of fixes, mean and floor-index percentile."""
    a, b = _runs(spark, sf_dir)
    both = a.withColumn("run", F.lit("a")).unionByName(b.withColumn("run", F.lit("b")))
    p = metrics.floor_index(both, "o_totalprice", 0.95, ["run"]).withColumnRenamed("value", "p95")
    found = both.groupBy("run").agg(F.count(F.lit(1)).alias("n"), F.avg("o_totalprice").alias("mean")).join(p, "run")
    return found.select("run", "n", r6("mean", 2).alias("mean"), r6("p95", 2).alias("p95"))


def schema_fingerprint(spark, sf_dir):
    return schema.fingerprints(_components(spark, sf_dir))


def _components(spark, sf_dir):
    n = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").select(
        F.col("n_name").alias("source_id"), F.lit("v2").alias("schema"), (n % 2 * 64 + 64).cast("string").alias("dim"),
        F.when(n % 7 == 0, "sift").otherwise("neural").alias("extractor"),
    )


def schema_diff(spark, sf_dir):
    return schema.differences(_components(spark, sf_dir), "NATION_1")


def log_parse_roundtrip(spark, sf_dir):
    lines = fixes(spark, sf_dir).select("event_id", logs.fix_line(F.col("lat"), F.col("lon"), F.col("seq"), F.col("event_id") % 90, F.col("confidence")).alias("line"))
    return logs.parse(lines).select("event_id", r6("lat").alias("lat"), r6("lon").alias("lon"), "frame", "inliers", r6("confidence").alias("confidence"))


def failure_counts(spark, sf_dir):
    e = F.col("event_type")
    text = F.when(e == "error", "WARN Outlier filtered: out_of_coverage").when(e == "view", "Not enough valid inliers (3)")
    text = text.when(e == "click", "No candidates found").otherwise("not enough valid inliers")
    return logs.failure_counts(track(spark, sf_dir).select(text.alias("line")))


def export_geojson(spark, sf_dir):
    return fixes(spark, sf_dir).select("event_id", exports.point_feature(F.col("lat"), F.col("lon"), {"seq": F.col("seq")}).alias("feature"))


def history_tail(spark, sf_dir):
    """The last five rows of each track."""
    w = W.partitionBy("track_id").orderBy(F.col("seq").desc())
    return track(spark, sf_dir).withColumn("age", F.row_number().over(w)).where("age <= 5").select("track_id", "event_id", "age")


NAMES = [
    latency_nearest_rank, percentile_floor_index, mad_outliers, spread_by_group, confidence_score, affine_lsq_by_group,
    error_cuts_report, pred_vs_gt_metrics, regression_gate, matched_jaccard, only_in_b, ab_compare, schema_fingerprint, schema_diff,
    log_parse_roundtrip, failure_counts, export_geojson, history_tail,
]
QUERIES = {f.__name__: f for f in NAMES}

_ERR = SQL_TRACK + ", err as (select *, abs(x - lag(x, 3) over (partition by track_id order by seq)) as error from track)"
_SUM = "count(*) as n, round(median(error), 4) as median, round(quantile_cont(error, 0.95), 4) as p95, round(max(error), 4) as max, round(avg(error), 4) as mean"
_COMP = "comp as (select n_name as source_id, 'v2' as schema, cast(n_nationkey % 2 * 64 + 64 as varchar) as dim, case when n_nationkey % 7 = 0 then 'sift' else 'neural' end as extractor from nation)"
SQL = {
    "latency_nearest_rank": "select event_type, count(*) as n, quantile_disc(value, 0.5) as p50, quantile_disc(value, 0.95) as p95, quantile_disc(value, 0.99) as p99, max(value) as max from events group by 1",
    "percentile_floor_index": "with r as (select event_type, value, row_number() over (partition by event_type order by value) - 1 as i, count(*) over (partition by event_type) as n from events) select event_type, value from r where i = least(n - 1, floor(n * 0.95::double))",
    "mad_outliers": f"""with {SQL_TRACK}, m as (select event_type, median(x) as m from track group by 1), d as (select track.event_type, any_value(m) + median(abs(x - m)) * (0.5::double * 1.4826::double) as l from track join m on m.event_type = track.event_type group by 1)
 select event_id, round(greatest(l, 1), 6) as limit, x <= greatest(l, 1) or sum(case when x <= greatest(l, 1) then 1 else 0 end) over (partition by track.event_type) < 4 as keep from track join d on d.event_type = track.event_type""",
    "spread_by_group": f"""with {SQL_TRACK}, s as (select track_id, case when count(*) >= 2 then least(stddev_pop(x), stddev_pop(y)) / 1080.0 end as s from track group by 1)
 select track_id, round(s, 6) as spread, round(case when s is null then 1.0 else greatest(0.35, least(1.0, s / 0.15::double)) end, 6) as confidence, round(case when s is null then 1.0 else 1 / (1 + 10 * greatest(0.0, 0.15::double - s)) end, 6) as weight from s""",
    "confidence_score": f"""with {SQL_TRACK}, f as (select *, event_id % 120 as i, event_id % 120 + 30 as m, (event_id % 9) / 2.0 as r, greatest(0, least(1, x / 400.0::double)) * 0.35::double + 0.5 as fl from track)
 select event_id, round(greatest(0.05, least(1.0, greatest(0, least(1, 1 - (least(event_id % 12, 10) / 10.0 * 0.5 + least(event_id % 7, 5) / 5.0 * 0.5))) * 0.3::double + least(1, i / 80.0) * 0.4::double + (i / (m + 1e-6) * 0.5 + 0.5 / (r / (3 + 1e-6) + 1)) * 0.3::double)), 6) as confidence,
 round(fl, 8) as flow, round(1.5 / greatest(fl, 0.25), 6) as noise_scale from f""",
    "affine_lsq_by_group": f"""with {SQL_TRACK}, p as (select track_id, x, y, x * 2 - y * 0.5 + 10 + event_id % 5 as u, x * 0.5 + y * 2 - 7 + event_id % 3 as v from track),
 m as (select track_id, count(*) as n, avg(x) as mx, avg(y) as my, avg(u) as mu, avg(v) as mv from p group by 1),
 s as (select p.track_id, any_value(n) as n, any_value(mx) as mx, any_value(my) as my, any_value(mu) as mu, any_value(mv) as mv, sum((x - mx) * (x - mx)) as xx, sum((x - mx) * (y - my)) as xy, sum((y - my) * (y - my)) as yy,
   sum((x - mx) * (u - mu)) as xu, sum((y - my) * (u - mu)) as yu, sum((x - mx) * (v - mv)) as xv, sum((y - my) * (v - mv)) as yv from p join m on m.track_id = p.track_id group by 1),
 f as (select *, case when n >= 3 and xx * yy - xy * xy > 1e-9 then xx * yy - xy * xy end as de from s),
 g as (select *, (xu * yy - yu * xy) / de as a, (yu * xx - xu * xy) / de as b, (xv * yy - yv * xy) / de as c, (yv * xx - xv * xy) / de as d from f)
 select track_id, n, round(a, 4) as a, round(b, 4) as b, round(mu - a * mx - b * my, 4) as tx, round(c, 4) as c, round(d, 4) as d, round(mv - c * mx - d * my, 4) as ty from g""",
    "error_cuts_report": f"""with {_ERR}, n as (select *, least((seq - 1) % 10, 10 - (seq - 1) % 10) as near from err where error is not null),
 c as (select 'overall' as cut, error from n union all select 'near_anchor', error from n where near <= 1 union all select 'mid_leg', error from n where near >= 4 union all select 'turn_arcs', error from n where y >= 50 union all select 'straights', error from n where y < 50)
 select cut, {_SUM} from c group by 1""",
    "pred_vs_gt_metrics": f"with {_ERR} select track_id, {_SUM} from err where error is not null group by 1",
    "regression_gate": f"""with {_ERR}, s as (select event_type, event_id % 2 as k, median(error) as m, max(error) as x from err where error is not null group by 1, 2)
 select a.event_type, round(a.m, 4) as median, round(b.m, 4) as base_median, round(a.x, 4) as max, round(b.x, 4) as base_max, a.m <= b.m * 1.02::double + 1e-9 and a.x <= b.x * 1.2::double + 1e-9 as passed from s a join s b on a.event_type = b.event_type and a.k = 0 and b.k = 1""",
    "matched_jaccard": """with a as (select distinct o_custkey k from orders where o_orderkey % 2 = 0), b as (select distinct o_custkey k from orders where o_orderkey % 2 = 1),
 f as (select a.k as x, b.k as y from a full join b on a.k = b.k) select count(case when x is not null and y is not null then 1 end) as shared, count(*) as all, round(count(case when x is not null and y is not null then 1 end) / count(*)::double, 6) as jaccard from f""",
    "only_in_b": "select o_custkey from (select distinct o_custkey from orders where o_orderkey % 2 = 1 except select o_custkey from orders where o_orderkey % 2 = 0) order by 1 limit 12",
    "ab_compare": """with r as (select case when o_orderkey % 2 = 0 then 'a' else 'b' end as run, o_totalprice as v from orders), i as (select *, row_number() over (partition by run order by v) - 1 as i, count(*) over (partition by run) as n from r)
 select run, count(*) as n, round(avg(v), 2) as mean, round(max(case when i = least(n - 1, floor(n * 0.95::double)) then v end), 2) as p95 from i group by 1""",
    "schema_fingerprint": f"""with {_COMP} select source_id, substr(sha256('{{"dim":"' || dim || '","extractor":"' || extractor || '","schema":"' || schema || '"}}'), 1, 16) as fingerprint from comp""",
    "schema_diff": f"""with {_COMP}, u as (select source_id, 'dim' as field, dim as value from comp union all select source_id, 'extractor', extractor from comp union all select source_id, 'schema', schema from comp)
 select u.source_id, u.field, u.value, b.value as expected from u join u b on b.source_id = 'NATION_1' and b.field = u.field where u.value is distinct from b.value""",
    "log_parse_roundtrip": f"with {SQL_FIXES} select event_id, round(lat, 6) as lat, round(lon, 6) as lon, seq as frame, (event_id % 90)::bigint as inliers, round(confidence, 6) as confidence from fixes",
    "failure_counts": """with c as (select case event_type when 'error' then 'Outlier filtered' when 'view' then 'Not enough valid inliers' else 'No candidates found' end as failure, count(*) as n from events where event_type in ('error', 'view', 'click') group by 1)
 select failure, n, row_number() over (order by n desc, case failure when 'Not enough valid inliers' then 1 when 'Outlier filtered' then 3 else 5 end) as place from c""",
    "export_geojson": f"""with {SQL_FIXES} select event_id, '{{"type":"Feature","geometry":{{"type":"Point","coordinates":[' || lon || ',' || lat || ']}},"properties":{{"seq":' || seq || '}}}}' as feature from fixes""",
    "history_tail": f"with {SQL_TRACK}, r as (select track_id, event_id, row_number() over (partition by track_id order by seq desc) as age from track) select * from r where age <= 5",
}
