"""Queries on tables that the smallest ones do not resemble: ties by the last bit, copies of rows, long and many tracks."""

import tracemalloc

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq

from loftline.operators import calibrated, graph, retrieval, scans, spatial, trajectory
from loftline.plans import registry

from .test_queries import normal


def events(folder, users, values, ks=None, kinds=None):
    """A table of events in `folder`; k and type as given, or in turn."""
    n = len(users)
    frame = pd.DataFrame(
        {
            "event_id": range(n), "ts": pd.Timestamp("2024-01-01") + pd.to_timedelta([i * 10 for i in range(n)], "s"), "user_id": users,
            "event_type": kinds or [("view", "click", "purchase", "error")[i % 4] for i in range(n)], "value": [float(v) for v in values],
            "props": [f'{{"k": {k}}}' for k in (ks or [i % 100 for i in range(n)])],
        }
    )
    frame["ts"] = frame["ts"].astype("datetime64[us]")
    pq.write_table(pa.Table.from_pandas(frame, preserve_index=False), f"{folder}/events.parquet")
    return str(folder)


def assert_equals_sql(spark, folder, name):
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{folder}/events.parquet'")
    got, want = registry.QUERIES[name](spark, folder).toPandas(), con.execute(registry.SQL[name]).df()
    pd.testing.assert_frame_equal(normal(got), normal(want))
    return got


def test_depth_hints_that_are_ties_only_when_rounded(spark, tmp_path):
    folder = events(tmp_path, [1] * 8, [35.1, 35.1, 35.1, 21.06, 35.1, 21.06, 35.1, 42.12], kinds=["error"] * 8)
    got = assert_equals_sql(spark, folder, "depth_hints").set_index("event_id")
    assert got.loc[3, "first"] == 0.5


def test_tiles_that_hold_most_rows_are_counted_without_pairs(spark):
    """200,000 rows in two tiles: 10,000 of them ask, which would be 2 * 10^9 pairs."""
    rows = spark.range(200_000).selectExpr("id as event_id", "48.0011 + id % 2 * 0.006 as lat", "25.0011 + id % 50 * 0.00001 as lon")
    found = spatial.tile_counts(rows.where("event_id % 20 = 0"), rows, 1)
    assert [tuple(r) for r in found.groupBy("n").count().collect()] == [(200_000, 10_000)]
    near = spatial.nearest_points(rows.where("event_id % 20 = 0"), rows, 1, 3)
    assert near.count() == 30_000
    assert [tuple(r) for r in near.where("event_id = 199900").orderBy("rank").collect()] == [(199_900, 0, 0.0, 1), (199_900, 50, 0.0, 2), (199_900, 100, 0.0, 3)]


def test_nearest_points_equal_sql_in_dense_and_sparse_places(spark, tmp_path):
    """A cluster of points some centimetres apart, copies, and points alone in their tiles or with one other in the tile beside."""
    values = [10 + i * 37 % 101 * 1e-4 for i in range(400)] + [20.0] * 50 + [31.3, 35.2, 900.0, 77.7, 79.9, 84.99] * 20
    folder = events(tmp_path, [1] * len(values), values, ks=[50 if i < 450 else i * 7 % 100 for i in range(len(values))])
    assert_equals_sql(spark, folder, "knn_geo_scoped")
    assert_equals_sql(spark, folder, "geo_tile_neighbours")


def test_parts_solved_together_equal_those_solved_one_by_one():
    """Parts of several sizes, with ends that stand still, a loop, a far link, and with robust weights."""
    r = np.random.default_rng(5)
    nodes, edges = [], []
    for part, n in enumerate((30, 7, 1, 40, 30)):
        ids = np.arange(n) * 3 + part * 1000
        nodes.append(pd.DataFrame({"part": part, "component": part, "node": ids, "is_anchor": np.arange(n) % 9 == 0, "is_free": np.arange(n) % 11 != 5}))
        pairs = [(k, k + b) for b in (1, 3) for k in range(n - b)] + ([(3, 3)] if n > 3 else []) + ([(0, 39)] if n == 40 else [])
        a, b = np.array(pairs or np.zeros((0, 2)), int).T
        edges.append(pd.DataFrame({"part": part, "edge_id": np.arange(len(a)), "from_id": ids[a], "to_id": ids[b], "weight": r.uniform(1, 4, len(a)), **{c: r.normal(0, 0.3, len(a)) for c in graph.STEP}}))
    nodes, edges = pd.concat(nodes), pd.concat(edges)
    nodes = nodes.assign(**{c: r.normal(0, 0.3, len(nodes)) for c in graph.POSE})
    nodes = nodes.assign(**{s: nodes[c] for s, c in zip(graph.START, graph.POSE, strict=True)})
    for robust in (None, 5.0):
        got = graph.solve_parts(nodes, edges, 10.0, robust=robust).set_index("node").sort_index()
        want = [graph.solve_component(nodes[nodes["part"] == p].reset_index(drop=True), edges[edges["part"] == p].reset_index(drop=True), 10.0, robust=robust) for p in range(5)]
        np.testing.assert_allclose(got, pd.concat(want).set_index("node").sort_index()[got.columns], rtol=1e-6, atol=1e-7)
    assert len(got) == nodes["is_free"].sum()


def test_smoother_fits_all_windows_of_a_batch_together(spark):
    """Against a plain fit of each window; tracks shorter and longer than a batch of 40 rows, one of a single row."""
    r = np.random.default_rng(1)
    rows = pd.concat([pd.DataFrame({"track_id": k, "seq": np.arange(n) + 1, "x": r.normal(0, 20, n), "y": r.normal(0, 20, n)}) for k, n in enumerate((130, 1, 7, 2, 25))])
    held = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "40")
    try:
        got = trajectory.smoother(spark.createDataFrame(rows), size=12).toPandas().sort_values(["track_id", "seq"])
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", held)
    want = []
    for _, own in rows.groupby("track_id"):
        z = own[["x", "y"]].to_numpy()
        for end in range(1, len(z) + 1):
            w = z[max(0, end - 12) : end]
            n, weight = len(w), np.ones(len(w))
            bend = np.diff(np.eye(n), n=2, axis=0) if n > 2 else np.zeros((0, n))
            for _ in range(5):
                fit = np.linalg.solve(np.diag(weight) + bend.T @ bend, weight[:, None] * w)
                weight = np.minimum(1.0, 3.0 / np.maximum(np.linalg.norm(w - fit, axis=1), 1e-9))
            want.append(fit[-1])
    np.testing.assert_allclose(got[["sx", "sy"]], want, rtol=1e-9, atol=1e-9)


def test_anchor_stress_makes_its_residuals_once(spark):
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for rows in batches:
            made.add(len(rows))
            yield rows

    rows = spark.range(100).selectExpr("id as from_id", "id + 1 as to_id", "cast(id % 7 as double) as residual")
    found = graph.anchor_stress(rows.mapInPandas(count, rows.schema), spark.range(5).toDF("node")).orderBy("node").collect()
    assert made.value == 100 and [r["stress"] for r in found] == [0.0, 0.5 / 3, 0.5, 2.5 / 3, 3.5 / 3]


def counted(spark, rows):
    """rows, and how many of them were made in all."""
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for part in batches:
            made.add(len(part))
            yield part

    return rows.mapInPandas(count, rows.schema), made


def test_prune_makes_its_residuals_once(spark):
    rows = spark.range(60).selectExpr("id as edge_id", "id % 20 as from_id", "id % 20 + 1 as to_id", "'spatial' as edge_type", "cast(id % 20 + if(id >= 57, 99, 0) as double) as residual")
    rows, made = counted(spark, rows)
    got = graph.prune(rows, spark.range(1).toDF("node")).where("pruned").collect()
    assert made.value == 60 and {r.edge_id for r in got} == {57, 58, 59}


def test_scans_make_their_rows_once(spark):
    rows, made = counted(spark, spark.range(100).selectExpr("id % 3 as g", "id as at", "if(id % 7 = 0, id, null) as v"))
    got = scans.running(rows, ["g"], "at", lasts={"before": "v"}, nexts={"after": "v"}, block=10).collect()
    assert made.value == 100 and len(got) == 100
    for r in got:
        own = [v for v in range(0, 100, 7) if v % 3 == r.g]
        assert r.before == max((v for v in own if v < r["at"]), default=None) and r.after == min((v for v in own if v > r["at"]), default=None)


def test_solution_makes_results_and_edges_once(spark):
    results, made = counted(spark, spark.range(0, 40, 2).selectExpr("id as node", *[f"1.5D as {n}" for n in calibrated.MATRIX]))
    edges, drawn = counted(spark, spark.range(39).selectExpr("id as edge_id", "id as from_id", "id + 1 as to_id", "7 as inliers", "0.5D as rmse"))
    slots = spark.range(40).selectExpr("id % 2 as g", "id as at", "id as node")
    got = calibrated.solution_table(slots, results, edges, ["g"], "at", 10.0, 10.0).collect()
    assert (made.value, drawn.value, len(got), sum(r.valid for r in got)) == (20, 39, 40, 20)


def test_search_holds_small_tiles():
    """A batch of 10,000 references against 1,024 queries: the largest matrix has 128 rows, where 512 took above 80 MB."""
    r = np.random.default_rng(4)
    block = pd.DataFrame({"query_id": np.arange(1024), "vector": list(r.normal(size=(1024, 64)).astype(np.float32))})
    refs = pd.DataFrame({"ref_id": np.arange(10_000), "vector": list(r.normal(size=(10_000, 64)).astype(np.float32))})
    tracemalloc.start()
    held = [len(found) for found in retrieval._scores(block, 6, True)([refs])]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(held) == 6 * 1024 and peak < 60e6
