"""Queries of the shortcut by the last match. They ask with every row whose id is divisible by 20, in tracks of 400 ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import shortcut
from .views import r6, vectors

WINDOW, LEAST, EVERY = 40, 0.55, 5


def _matches(spark, sf_dir) -> DataFrame:
    """Distorted copies of the stated rows; a track visits every second of its rows first, then those between."""
    refs = vectors(spark, sf_dir)
    noise = F.transform(F.col("vector"), lambda v, i: v.cast("double") + ((F.col("ref_id") * 31 + i * 17) % 13 - 6) / 24.0)
    ids = {"track_id": F.floor(F.col("ref_id") / 400), "at": F.col("ref_id") % 40 * 400 + F.col("ref_id") % 400, "query_id": F.col("ref_id")}
    asked = refs.where("ref_id % 20 = 0").select(*[c.cast("bigint").alias(n) for n, c in ids.items()], noise.alias("vector"))
    return shortcut.matches(asked, refs, WINDOW, LEAST, EVERY)


def prior_matches(spark, sf_dir):
    return _matches(spark, sf_dir).select("track_id", "query_id", "n", "route", "ref_id", r6("score").alias("score"), "last_id")


def prior_hit_rates(spark, sf_dir):
    found = shortcut.hit_rates(_matches(spark, sf_dir), WINDOW, ["track_id"])
    return found.withColumn("hit_rate", r6("hit_rate"))


QUERIES = {f.__name__: f for f in (prior_matches, prior_hit_rates)}

_WALK = f"""recursive a as (select vec_id // 400 as track_id, vec_id, vec_id % 40 * 400 + vec_id % 400 as place,
   list_transform(embedding::double[], lambda v, i: v + ((vec_id * 31 + (i - 1) * 17) % 13 - 6) / 24.0::double) as v from embeddings where vec_id % 20 = 0),
 q as (select track_id, vec_id as query_id, row_number() over (partition by track_id order by place, vec_id) as n,
   list_transform(v, lambda x: x / (sqrt(list_inner_product(v, v)) + 1e-8)) as v from a),
 r as (select vec_id, embedding::double[] as e, list_transform(e, lambda x: x / (sqrt(list_inner_product(e, e)) + 1e-8)) as v from embeddings),
 s as materialized (select q.track_id, q.n, r.vec_id as ref_id, round(list_inner_product(q.v, r.v), 9) as score from q, r),
 best as materialized (select track_id, n, min({{'s': -score, 'r': ref_id}}) as b from s group by 1, 2),
 walk as (
  select track_id, n, 'full' as route, b.r as ref_id, -b.s as score, null::bigint as last_id from best where n = 1
  union all
  select track_id, n, case when n % {EVERY} = 0 then 'audit' when -p.s >= {LEAST} then 'prior' else 'full' end,
    case when n % {EVERY} <> 0 and -p.s >= {LEAST} then p.r else b.r end, case when n % {EVERY} <> 0 and -p.s >= {LEAST} then -p.s else -b.s end, last_id
  from (select s.track_id, s.n, any_value(best.b) as b, any_value(w.ref_id) as last_id,
      min({{'s': -s.score, 'p': case when s.ref_id < w.ref_id then 2 * (w.ref_id - s.ref_id) - 1 else 2 * (s.ref_id - w.ref_id) end, 'r': s.ref_id}}) as p
    from walk w join s on s.track_id = w.track_id and s.n = w.n + 1 and abs(s.ref_id - w.ref_id) <= {WINDOW}
    join best on best.track_id = s.track_id and best.n = s.n group by 1, 2) x)"""

SQL = {
    "prior_matches": f"""with {_WALK} select w.track_id, q.query_id, w.n, w.route, w.ref_id, round(w.score, 6) as score, w.last_id
 from walk w join q on q.track_id = w.track_id and q.n = w.n""",
    "prior_hit_rates": f"""with {_WALK}, c as (select track_id, count(*) filter (route <> 'audit') as tries, count(*) filter (route = 'prior') as hits,
   count(*) filter (route = 'audit') as audits, count(*) filter (route = 'audit' and abs(ref_id - last_id) > {WINDOW}) as misses from walk group by 1)
 select track_id, tries, hits, round(case when tries > 0 then 100.0::double * hits / tries else 0 end, 6) as hit_rate, audits, misses from c""",
}
