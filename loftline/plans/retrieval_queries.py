"""Retrieval queries. Searches ask with every row whose id is divisible by 20, against all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import metrics, retrieval, spatial
from .views import SQL_FIXES, SQL_KNN, fixes, r6, vectors


def _found(spark, sf_dir, k: int) -> DataFrame:
    """Top k without the query itself, with both labels."""
    refs = vectors(spark, sf_dir)
    queries = refs.where("ref_id % 20 = 0").select(F.col("ref_id").alias("query_id"), "vector")
    found = retrieval.topk(queries, refs, k + 1).where("query_id <> ref_id")
    found = retrieval.ranked(found.drop("rank"), k)
    q = refs.select(F.col("ref_id").alias("query_id"), F.col("label").alias("query_label"))
    return found.join(refs.select("ref_id", F.col("label").alias("ref_label")), "ref_id").join(q, "query_id")


def _asked(spark, sf_dir) -> DataFrame:
    return vectors(spark, sf_dir).where("ref_id % 20 = 0").select(F.col("ref_id").alias("query_id"))


def knn_exact_topk(spark, sf_dir):
    return _found(spark, sf_dir, 5).select("query_id", "ref_id", "rank", r6("score").alias("score"))


def _distances(found: DataFrame) -> DataFrame:
    """Distances stand for relevance: 0 for the same label, else one metre per label step."""
    d = F.abs(F.col("query_label") - F.col("ref_label")).cast("double")
    return found.withColumns({"d_m": d, "w_m": F.lit(4.0)})


def retrieval_metrics_at_k(spark, sf_dir):
    per = metrics.retrieval_metrics(_distances(_found(spark, sf_dir, 10)), _asked(spark, sf_dir), 5, 0.5, 0.5)
    out = metrics.macro(per, ["recall", "sdm"])
    return out.select("n", r6("recall").alias("recall"), r6("sdm").alias("sdm"))


def retrieval_pdm(spark, sf_dir):
    per = metrics.retrieval_metrics(_distances(_found(spark, sf_dir, 10)), _asked(spark, sf_dir), 10, 0.5, 0.5)
    return per.select("query_id", r6("pdm").alias("pdm"))


def retrieval_rank_of_truth(spark, sf_dir):
    """Rank of the own row for a distorted copy of each query."""
    refs = vectors(spark, sf_dir)
    noise = F.transform(F.col("vector"), lambda v, i: v.cast("double") + ((F.col("ref_id") * 31 + i * 17) % 13 - 6) / 24.0)
    asked = refs.where("ref_id % 20 = 0").select(F.col("ref_id").alias("query_id"), noise.alias("vector"))
    return retrieval.truth_ranks(asked, refs)


def knn_multi_source_best(spark, sf_dir):
    found = retrieval.ranked(_found(spark, sf_dir, 50).select("query_id", "ref_id", "score", F.col("ref_label").alias("source_id")))
    w = W.partitionBy("query_id", "source_id").orderBy("rank")
    found = found.withColumn("place", F.row_number().over(w)).where("place <= 3")
    sources = vectors(spark, sf_dir).select(F.col("label").alias("source_id")).distinct().withColumn("priority", F.col("source_id") % 3)
    best = retrieval.best_source(found, sources)
    return best.select("query_id", "source_id", "ref_id", r6("score").alias("score"))


def knn_patch_aggregate(spark, sf_dir):
    """Four slices of each vector vote; a slice of the query meets the slices in the same place."""
    refs = vectors(spark, sf_dir)
    parts = None
    for p in range(4):
        cut = refs.select("ref_id", F.slice("vector", p * 16 + 1, 16).alias("vector"))
        asked = cut.where("ref_id % 20 = 0").select(F.col("ref_id").alias("query_id"), "vector")
        hit = retrieval.topk(asked, cut, 9).select("query_id", "ref_id", "score")
        parts = hit if parts is None else parts.unionByName(hit)
    votes = retrieval.patch_votes(parts, 4)
    return votes.select("query_id", "ref_id", "hits", r6("score").alias("score"))


def fuse_ranked_lists(spark, sf_dir):
    found = _found(spark, sf_dir, 10)
    a = found.where("rank <= 5")
    b = found.where("rank % 2 = 1").withColumn("score", F.col("score") * 0.9)
    return retrieval.fuse(a, b).select("query_id", "ref_id", r6("score").alias("score"))


def loop_closure_candidates(spark, sf_dir):
    found = _found(spark, sf_dir, 8)
    out = retrieval.loop_closures(found, 10, 0.2)
    return out.select("i", "j", r6("score").alias("score"), "rank", "mutual")


def _descriptor_pairs(spark, sf_dir) -> DataFrame:
    """Frames are runs of eight vectors, which are their descriptors; a frame meets the next one."""
    d = vectors(spark, sf_dir).select(
        F.floor(F.col("ref_id") / 8).alias("frame"), F.col("ref_id"), F.col("vector").alias("v")
    )
    a = d.select(F.col("frame").alias("pair_id"), F.col("ref_id").alias("q"), F.col("v").alias("qv"))
    b = d.select((F.col("frame") - 1).alias("pair_id"), F.col("ref_id").alias("r"), F.col("v").alias("rv"))
    return a.join(b, "pair_id").select("pair_id", "q", "r", F.round(V.cosine(F.col("qv"), F.col("rv")), 9).alias("score"))


def mutual_nn_match(spark, sf_dir):
    found = retrieval.mutual_matches(_descriptor_pairs(spark, sf_dir), 0.95)
    return found.select("pair_id", "q", "r", r6("score").alias("score"))


def mnn_counts(spark, sf_dir):
    pairs = _descriptor_pairs(spark, sf_dir)
    counts = retrieval.mutual_matches(pairs, 0.95).groupBy("pair_id").count()
    return pairs.select("pair_id").distinct().join(counts, "pair_id", "left").select(
        "pair_id", F.coalesce("count", F.lit(0)).cast("long").alias("matches")
    )


def verify_early_stop(spark, sf_dir):
    found = _found(spark, sf_dir, 10).withColumn("inliers", ((F.col("query_id") * 7 + F.col("ref_id") * 13) % 60).cast("long"))
    return retrieval.first_good(found).select("query_id", "ref_id", "inliers", "rank", "tried")


#: Each row is indexed in so many of its nearest cells, and each query probes this share of all cells.
COPIES, PROBED = 4, 0.25


def knn_cells_approximate(spark, sf_dir):
    """Approximate search; the index is fitted on a sample and holds every row. Cells grow as the root of the rows."""
    refs = vectors(spark, sf_dir).select("ref_id", "vector")
    centroids = retrieval.fit_centroids(refs, retrieval.cell_count(refs.count()))
    asked = refs.where("ref_id % 20 = 0").select(F.col("ref_id").alias("query_id"), "vector")
    probes = max(1, int(len(centroids) * PROBED))
    return retrieval.topk_cells(asked, retrieval.cells(refs, centroids, COPIES), centroids, 10, probes)


def _frames(spark, sf_dir) -> DataFrame:
    """Vectors with the place of the fix of the same id."""
    places = fixes(spark, sf_dir).select(F.col("event_id").alias("ref_id"), "lat", "lon")
    return vectors(spark, sf_dir).select("ref_id", "vector").join(places, "ref_id")


def knn_geo_descriptors(spark, sf_dir):
    """For every 20th frame the three frames of highest cosine in the tiles around it, itself included."""
    frames = _frames(spark, sf_dir)
    asked = frames.where("ref_id % 20 = 0").withColumnRenamed("ref_id", "query_id")
    return spatial.scoped_topk(asked, frames, 2, 3).select("query_id", "ref_id", "rank", r6("score").alias("score"))


NAMES = [
    knn_exact_topk, retrieval_metrics_at_k, retrieval_pdm, retrieval_rank_of_truth, knn_multi_source_best, knn_patch_aggregate,
    fuse_ranked_lists, loop_closure_candidates, mutual_nn_match, mnn_counts, verify_early_stop, knn_cells_approximate, knn_geo_descriptors,
]
QUERIES = {f.__name__: f for f in NAMES}

_MATCH = """d as (select vec_id // 8 as frame, vec_id, embedding::double[] as v from embeddings),
 u as (select frame, vec_id, list_transform(v, lambda x: x / (sqrt(list_inner_product(v, v)) + 1e-8)) as v from d),
 s as (select a.frame as pair_id, a.vec_id as q, b.vec_id as r, round(list_inner_product(a.v, b.v), 9) as score from u a join u b on b.frame = a.frame + 1),
 w as (select *, sqrt(greatest(0, 2 - 2 * score)) as l2, row_number() over fq as rq, row_number() over (partition by pair_id, r order by score desc, q) as rr,
   lead(sqrt(greatest(0, 2 - 2 * score))) over fq as second from s window fq as (partition by pair_id, q order by score desc, r)),
 m as (select pair_id, q, r, score from w where rq = 1 and rr = 1 and second is not null and l2 < second * 0.95)"""
_PDM = "case when d / 4.0 >= 1.67 then 0.0 else 1 / (exp(greatest(-500, least(500, (d / 4.0 - 0.85) * 6.0))) + 1) end"
SQL = {
    "knn_exact_topk": f"with {SQL_KNN} select query_id, ref_id, rank, round(score, 6) as score from ranked where rank <= 5",
    "retrieval_metrics_at_k": f"""with {SQL_KNN},
 t as (select query_id, rank, abs(query_label - ref_label)::double as d, count(*) over (partition by query_id) - rank + 1 as w from ranked where rank <= 5),
 p as (select query_id, max(case when d <= 0.5 then 1.0::double else 0 end) as recall, sum(w * exp(-0.5 * d)) / sum(w) as sdm from t group by query_id)
 select count(*) as n, round(avg(recall), 6) as recall, round(avg(sdm), 6) as sdm from p""",
    "retrieval_pdm": f"""with {SQL_KNN},
 t as (select query_id, rank, abs(query_label - ref_label)::double as d, count(*) over (partition by query_id) - rank + 1 as w from ranked where rank <= 10)
 select query_id, round(sum(w * {_PDM}) / sum(w), 6) as pdm from t group by query_id""",
    "retrieval_rank_of_truth": """with n as (select vec_id, list_transform(embedding::double[], lambda v: v / (sqrt(list_inner_product(embedding::double[], embedding::double[])) + 1e-8)) as v from embeddings),
 a as (select vec_id, list_transform(embedding::double[], lambda v, i: v + ((vec_id * 31 + (i - 1) * 17) % 13 - 6) / 24.0::double) as v from embeddings where vec_id % 20 = 0),
 q as (select vec_id, list_transform(v, lambda x: x / (sqrt(list_inner_product(v, v)) + 1e-8)) as v from a),
 s as (select q.vec_id as query_id, n.vec_id as ref_id, round(list_inner_product(q.v, n.v), 9) as score from q, n),
 t as (select query_id, score as truth from s where query_id = ref_id)
 select s.query_id, sum(case when score > truth then 1 else 0 end)::bigint + 1 as truth_rank from s join t on s.query_id = t.query_id group by s.query_id""",
    "knn_multi_source_best": f"""with {SQL_KNN},
 t as (select *, row_number() over (partition by query_id, ref_label order by rank) as place from ranked where rank <= 50),
 f as (select * from t where place <= 3),
 b as (select query_id, ref_label, max(score) as best from f group by 1, 2),
 c as (select query_id, ref_label, row_number() over (partition by query_id order by best desc, ref_label % 3, ref_label) as r from b)
 select f.query_id, f.ref_label as source_id, f.ref_id, round(f.score, 6) as score from f join c on c.query_id = f.query_id and c.ref_label = f.ref_label and c.r = 1""",
    "knn_patch_aggregate": """with d as (select vec_id, p, embedding[p * 16 + 1 : p * 16 + 16]::double[] as v from embeddings, range(0, 4) t(p)),
 u as (select vec_id, p, list_transform(v, lambda x: x / (sqrt(list_inner_product(v, v)) + 1e-8)) as v from d),
 s as (select q.vec_id as query_id, r.vec_id as ref_id, q.p, round(list_inner_product(q.v, r.v), 9) as score from u q join u r on q.p = r.p where q.vec_id % 20 = 0),
 t as (select *, row_number() over (partition by query_id, p order by score desc, ref_id) as k from s)
 select query_id, ref_id, count(*) as hits, round((count(*) / 4.0::double) * (sum(score) / count(*)), 6) as score from t where k <= 9 group by 1, 2""",
    "knn_geo_descriptors": f"""with {SQL_FIXES},
 f as (select vec_id, cast(trunc(lat / 0.005::double) as int) as ta, cast(trunc(lon / 0.005::double) as int) as tb,
   list_transform(embedding::double[], lambda x: x / (sqrt(list_inner_product(embedding::double[], embedding::double[])) + 1e-8)) as v from embeddings join fixes on vec_id = event_id),
 s as (select a.vec_id as query_id, b.vec_id as ref_id, round(list_inner_product(a.v, b.v), 9) as score from f a join f b on abs(a.ta - b.ta) <= 2 and abs(a.tb - b.tb) <= 2 where a.vec_id % 20 = 0),
 r as (select *, row_number() over (partition by query_id order by score desc, ref_id) as rank from s)
 select query_id, ref_id, rank, round(score, 6) as score from r where rank <= 3""",
    "fuse_ranked_lists": f"""with {SQL_KNN}, a as (select query_id, ref_id, score from ranked where rank <= 5),
 b as (select query_id, ref_id, score * 0.9::double as score from ranked where rank <= 10 and rank % 2 = 1)
 select coalesce(a.query_id, b.query_id) as query_id, coalesce(a.ref_id, b.ref_id) as ref_id,
   round(case when a.score is not null and b.score is not null then a.score * 0.6::double + b.score * 0.4::double else coalesce(a.score, b.score) end, 6) as score
 from a full join b on a.query_id = b.query_id and a.ref_id = b.ref_id""",
    "loop_closure_candidates": f"""with {SQL_KNN}, f as (select query_id as i, ref_id as j, score, rank from ranked where rank <= 8),
 g as (select *, row_number() over (partition by least(i, j), greatest(i, j) order by i, rank) as r from f where abs(i - j) > 10 and score >= 0.2)
 select g.i, g.j, round(g.score, 6) as score, g.rank, b.i is not null as mutual from g left join f b on b.i = g.j and b.j = g.i where g.r = 1""",
    "mutual_nn_match": f"with {_MATCH} select pair_id, q, r, round(score, 6) as score from m",
    "mnn_counts": f"with {_MATCH} select s.pair_id, count(distinct case when m.q is not null then m.q end) as matches from (select distinct pair_id from s) s left join m on m.pair_id = s.pair_id group by 1",
    "verify_early_stop": f"""with {SQL_KNN}, f as (select query_id, ref_id, rank, (query_id * 7 + ref_id * 13) % 60 as inliers from ranked where rank <= 10),
 g as (select *, max(inliers) over (partition by query_id order by rank rows between unbounded preceding and 1 preceding) as so_far from f),
 h as (select *, row_number() over (partition by query_id order by inliers desc, rank) as r, count(*) over (partition by query_id) as tried from g where so_far is null or so_far < 40)
 select query_id, ref_id, inliers, rank, tried from h where r = 1""",
}
