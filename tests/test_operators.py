"""Operators that SQL cannot express, against direct computation."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from loftline.functions import affine, geo
from loftline.operators import graph, retrieval
from loftline.operators import trajectory as T
from loftline.plans import graph_queries, metric_queries
from loftline.sources import logs


def test_edge_residual_contract(spark):
    i = affine.Pose(*[F.lit(float(v)) for v in (0, 0, 0, 0, 0)])
    j = affine.Pose(*[F.lit(float(v)) for v in (12, 12, 0.05, 0.05, 0.05)])
    edge = affine.Pose(*[F.lit(float(v)) for v in (10, 10, 0, 0, 0)])
    got = spark.range(1).select(*affine.edge_residual(i, j, edge, F.lit(2.0), 960.0, 1.0)).first()
    assert np.allclose(got, [4, 4, 96, 96, 1920 * math.atan2(math.sin(0.05), math.cos(0.05))], atol=1e-9)
    wide = i._replace(log_sx=F.lit(math.log(2.0)))
    assert abs(spark.range(1).select(affine.edge_residual(wide, affine.Pose(*[F.lit(14.0), *j[1:]]), edge, F.lit(2.0), 960.0, 1.0)[0]).first()[0] + 6) < 1e-9


def test_forward_and_inverse_prediction_return(spark):
    p = affine.Pose(*[F.lit(v) for v in (3.0, -2.0, 0.1, 0.1, 0.4)])
    e = affine.Pose(*[F.lit(v) for v in (5.0, 7.0, 0.02, 0.02, -0.3)])
    back = affine.predict_inverse(affine.predict_forward(p, e, 1.0), e, 1.0)
    assert np.allclose(spark.range(1).select(*back).first(), (3.0, -2.0, 0.1, 0.1, 0.4), atol=1e-9)


def test_utm_against_the_meridian_arc_and_conformality(spark):
    """On the central meridian the northing is the scaled arc; elsewhere the map keeps angles."""
    e2, a = geo.FLATTENING * (2 - geo.FLATTENING), geo.MERCATOR_M
    phi = np.linspace(0, math.radians(50), 200_001)
    meridian = a * (1 - e2) / (1 - e2 * np.sin(phi) ** 2) ** 1.5
    arc = np.trapezoid(meridian, phi) * geo.UTM_SCALE
    step = 1e-4

    def at(lat, lon):
        x, y = geo.utm_xy(F.lit(lat), F.lit(lon), F.lit(36))
        return np.array(spark.range(1).select(x, y).first())

    assert np.allclose(at(50.0, 33.0), (500_000.0, arc), atol=2e-3)
    north = (at(50.0 + step, 30.0) - at(50.0 - step, 30.0)) / (2 * math.radians(step)) / meridian[-1]
    radius = a / math.sqrt(1 - e2 * math.sin(math.radians(50)) ** 2) * math.cos(math.radians(50))
    east = (at(50.0, 30.0 + step) - at(50.0, 30.0 - step)) / (2 * math.radians(step)) / radius
    assert np.allclose(north, (-east[1], east[0]), atol=1e-6)


def test_pchip_is_monotone_and_hits_nodes():
    t, v = np.array([0.0, 1, 2, 4, 5]), np.array([0.0, 1, 1, 5, 5])
    at = np.linspace(-1, 6, 200)
    got = T.pchip(t, v, at)
    assert np.allclose(T.pchip(t, v, t), v) and (np.diff(got) >= -1e-12).all() and got[0] == 0 and abs(got[-1] - 5) < 1e-12


def test_gate_accepts_after_a_series_of_misses():
    rows = pd.DataFrame({"x": [0.0, 10, 20, 30, 5000, 5010, 5020, 5030], "y": 0.0, "t": np.arange(8.0)})
    assert T.gate_fold(rows, most=50.0, in_a_row=3)["rejected"].tolist() == [False] * 4 + [True, True, False, False]


def test_kalman_follows_a_line():
    rows = pd.DataFrame({"x": np.arange(30) * 10.0, "y": np.arange(30) * -3.0, "t": np.arange(30.0)})
    got = T.kalman_fold(rows)
    assert abs(got["fx"].iloc[-1] - 290) < 1e-3 and pd.isna(got["d2"].iloc[0]) and got["d2"].iloc[5] < 1e-3


def test_smoother_ignores_a_spike():
    rows = pd.DataFrame({"x": np.r_[np.arange(20.0), 500, np.arange(21.0, 30)], "y": 0.0, "t": np.arange(30.0)})
    assert abs(T.smooth_fold(rows)["sx"].iloc[-1] - 29) < 2


def test_propagation_and_solve_recover_a_chain(spark):
    n = 8
    rows = [(i, i, i + 1, 10.0, 2.0, 0.0, 0.0, 0.1, 1.0, "temporal", 50, 0.1, 1) for i in range(n - 1)]
    names = ["edge_id", "from_id", "to_id", *graph.STEP, "weight", "edge_type", "inliers", "rmse", "component"]
    edges = spark.createDataFrame(rows, names)
    anchors = spark.createDataFrame([(0, 0.0, 0.0, 0.0, 0.0, 0.0)], ["node", *graph.POSE])
    found = graph.propagate(edges, anchors)
    assert {(r.node, r.hop) for r in found.collect()} == {(i, i) for i in range(n)}
    noisy = found.withColumn("x", F.col("x") + F.when(F.col("node") > 0, F.col("node") % 3).otherwise(0))
    nodes = noisy.select(F.lit(1).cast("long").alias("component"), "node", *graph.POSE, (F.col("node") == 0).alias("is_anchor"))
    got = graph.solve(nodes, edges, 960.0).toPandas().sort_values("node")
    want = found.toPandas().sort_values("node")
    assert np.allclose(got[graph.POSE], want[graph.POSE], atol=1e-3) and got["cost"].iloc[0] < 1e-3


def test_blocks_solve_what_one_task_solves(spark):
    """A noisy chain with loop closures and anchors, whole and in blocks."""
    rng, n = np.random.default_rng(4), 24
    p = np.cumsum(rng.normal(size=(n, 5)) * [5, 5, 0.02, 0.02, 0.1], 0)
    rows = []
    for k, (i, j) in enumerate([(i, i + 1) for i in range(n - 1)] + [(i, i + 7) for i in range(n - 7)]):
        c, s, d = math.cos(p[i, 4]), math.sin(p[i, 4]), p[j, :2] - p[i, :2]
        step = [(c * d[0] + s * d[1]) / math.exp(p[i, 2]), (c * d[1] - s * d[0]) / math.exp(p[i, 3]), *(p[j, 2:] - p[i, 2:])]
        rows.append((k, i, j, *(np.array(step) + rng.normal(size=5) * [0.3, 0.3, 1e-3, 1e-3, 1e-3]).tolist(), 1.0 + k % 3, 1))
    edges = spark.createDataFrame(rows, ["edge_id", "from_id", "to_id", *graph.STEP, "weight", "component"])
    at = p + rng.normal(size=p.shape) * [1, 1, 0.01, 0.01, 0.02] * (np.arange(n) % 6 > 0)[:, None]
    nodes = spark.createDataFrame([(1, i, *at[i].tolist(), i % 6 == 0) for i in range(n)], ["component", "node", *graph.POSE, "is_anchor"])
    links, wide = edges.toPandas(), np.array([1, 1, 960.0, 960.0, 960.0])

    def loss(flat):
        q = flat.reshape(-1, 5)
        a, b, e = q[links.from_id], q[links.to_id], links[graph.STEP].to_numpy()
        sx, sy, c, s = np.exp(a[:, 2]), np.exp(a[:, 3]), np.cos(a[:, 4]), np.sin(a[:, 4])
        x, y = a[:, 0] + c * sx * e[:, 0] - s * sy * e[:, 1], a[:, 1] + s * sx * e[:, 0] + c * sy * e[:, 1]
        r = np.stack([(b[:, 0] - x) / sx, (b[:, 1] - y) / sy, *(b[:, 2:] - a[:, 2:] - e[:, 2:]).T], 1) * wide * links.weight.to_numpy()[:, None]
        return (r**2).sum() + (((q - at)[::6] * wide * 100) ** 2).sum()

    whole = graph.solve(nodes, edges, 960.0).toPandas().sort_values("node")
    parts = graph.solve(nodes, edges, 960.0, block=12, rounds=5).toPandas().sort_values("node")
    assert whole["cost"].iloc[0] == pytest.approx(loss(whole[graph.POSE].to_numpy().ravel()))
    assert parts["cost"].iloc[0] == pytest.approx(whole["cost"].iloc[0], rel=0.02) and len(parts) == n
    best, flat = whole["cost"].iloc[0], whole[graph.POSE].to_numpy().ravel()
    for k in range(len(flat)):  # no pose number can be moved to gain
        for d in (1e-4, -1e-4):
            moved = flat.copy()
            moved[k] += d
            assert loss(moved) > best - 1e-6 * best


def test_solve_query_has_every_pose(spark):
    folder = "/root/testdata/sf0.001"
    got = graph_queries.pose_graph_solve(spark, folder).toPandas()
    assert sorted(got["node"]) == sorted(r.event_id for r in spark.read.parquet(f"{folder}/events.parquet").collect())
    assert not got.isna().any().any()


def test_cells_reach_recall(spark):
    rng = np.random.default_rng(3)
    centers = rng.normal(size=(8, 16))
    v = centers[rng.integers(0, 8, 400)] + rng.normal(size=(400, 16)) * 0.3
    refs = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "ref_id long, vector array<double>")
    asked = refs.where("ref_id % 20 = 0").select(F.col("ref_id").alias("query_id"), "vector")
    exact = {(r.query_id, r.ref_id) for r in retrieval.topk(asked, refs, 5).collect()}
    centroids = retrieval.fit_centroids(refs, 8)
    near = {(r.query_id, r.ref_id) for r in retrieval.topk_cells(asked, retrieval.cells(refs, centroids), centroids, 5, 4).collect()}
    assert len(exact & near) / len(exact) >= 0.9


@pytest.mark.parametrize("value,want", [(-180.0, -180.0), (180.0, -180.0), (190.0, -170.0), (-0.5, -0.5)])
def test_wrap(spark, value, want):
    assert spark.range(1).select(geo.wrap_deg(F.lit(value))).first()[0] == want


def test_export_has_every_fix(spark):
    folder = "/root/testdata/sf0.001"
    got = metric_queries.export_geojson(spark, folder).collect()
    assert sorted(r.event_id for r in got) == sorted(r.event_id for r in spark.read.parquet(f"{folder}/events.parquet").collect())


def test_truth_ranks_have_no_cap(spark):
    """The own row of the only query scores lowest of 100,003."""
    v = F.when(F.col("id") == 0, F.array(F.lit(-1.0), F.lit(0.1))).otherwise(F.array(F.lit(1.0), F.col("id") / 1e6))
    refs = spark.range(100_003).select(F.col("id").alias("ref_id"), v.alias("vector"))
    asked = spark.range(1).select(F.col("id").alias("query_id"), F.array(F.lit(1.0), F.lit(0.0)).alias("vector"))
    assert [tuple(r) for r in retrieval.truth_ranks(asked, refs).collect()] == [(0, 100_003)]


def test_prune_keeps_the_way_to_an_anchor(spark):
    """Bad edges go worst first, but not the last way of a node to its anchors; nodes that no anchor reaches do not count."""
    rows = [(i, 1, 2, "spatial", 0.1 + i / 1000) for i in range(20)]
    # 3 hangs on two bad edges, of which the less bad one stays; 4 on one; 8 and 9 have no anchor; 5 is an anchor itself.
    rows += [(30, 1, 3, "spatial", 9.0), (31, 2, 3, "spatial", 8.0), (32, 3, 4, "spatial", 7.0), (33, 8, 9, "spatial", 6.0), (34, 2, 5, "spatial", 5.0)]
    rows += [(40, 1, 2, "temporal", None), (41, 8, 9, "temporal", 99.0)]
    edges = spark.createDataFrame(rows, "edge_id long, from_id long, to_id long, edge_type string, residual double")
    anchors = spark.createDataFrame([(1,), (5,)], "node long")
    got = {r.edge_id for r in graph.prune(edges, anchors, most=0.5).collect() if r.pruned}
    assert got == {30, 33, 34}

    def greedy(limit):
        def reach(ids):
            seen = {1, 5}
            while True:
                more = {x for e, a, b, *_ in rows if e in ids and (a in seen) != (b in seen) for x in (a, b)} - seen
                if not more:
                    return seen
                seen |= more
        left = {r[0] for r in rows}
        for e, *_ in sorted((r for r in rows if r[3] == "spatial" and r[4] > limit), key=lambda r: -r[4]):
            if reach(left - {e}) == reach({r[0] for r in rows}):
                left.discard(e)
        return {r[0] for r in rows} - left

    assert got == greedy(1.0)
    few = edges.where("edge_id in (30, 31)")
    assert not any(r.pruned for r in graph.prune(few, anchors).collect())


def test_failure_lines_match_the_first_key_as_written(spark):
    lines = ["Localization failed: Not enough valid inliers", "Outlier filtered", "outlier filtered", "No candidates found | out_of_coverage",
             "Localized (50.1, -3.25) | frame=7 | source=b | angle=90 | inliers=12 | conf=0.50", "Outlier filtered"]
    df = spark.createDataFrame([(x,) for x in lines], "line string")
    got = [tuple(r) for r in logs.failure_counts(df).orderBy("place").collect()]
    assert got == [("Outlier filtered", 2, 1), ("Not enough valid inliers", 1, 2), ("out_of_coverage", 1, 3)]
    assert [(r.lat, r.lon, r.frame, r.inliers, r.confidence) for r in logs.parse(df).collect()] == [(50.1, -3.25, 7, 12, 0.5)]
    assert logs.temporal_prior(df.withColumn("n", F.lit(1)), "n").collect() == []


def test_kalman_steps_many_tracks_as_one_by_one(spark):
    """Batches cut tracks anywhere; each row is that of the filter run over its track alone."""
    rng = np.random.default_rng(3)
    rows = [(i, s, float(s + rng.random()), *map(float, rng.normal(s, 2, 2))) for i in range(9) for s in range(1, 4 + i * 5)]
    frame = pd.DataFrame(rows, columns=["track_id", "seq", "t", "x", "y"])
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = T.kalman(spark.createDataFrame(frame).repartition(3)).toPandas().sort_values(["track_id", "seq"]).reset_index(drop=True)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    want = pd.concat([T.kalman_fold(g.reset_index(drop=True)) for _, g in frame.groupby("track_id")], ignore_index=True)
    for c in ("fx", "fy", "d2"):
        np.testing.assert_allclose(got[c].to_numpy(float), want[c].to_numpy(float), rtol=1e-9, atol=1e-9)
    assert T.kalman(spark.createDataFrame(frame).limit(0)).collect() == []


def test_grid_of_blocks_finds_what_one_block_finds(spark, monkeypatch):
    rng = np.random.default_rng(1)
    refs = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(120, 8)))], "ref_id long, vector array<double>")
    asked = refs.select(F.col("ref_id").alias("query_id"), "vector")
    want = {(r.query_id, r.rank): (r.ref_id, r.score) for r in retrieval.topk(asked, refs, 4).collect()}
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 25)
    assert {(r.query_id, r.rank): (r.ref_id, r.score) for r in retrieval.topk(asked, refs, 4).collect()} == want and len(want) == 480
