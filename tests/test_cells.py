"""Searches inside buckets: cells, tiles, hot buckets, odd vectors; ranks of the truth on the grid."""

import numpy as np
import pandas as pd

from loftline.operators import retrieval, spatial
from loftline.plans import retrieval_queries as queries
from loftline.session import table


def unit(rows):
    m = np.stack([np.asarray(v, float) for v in rows])
    return m / (np.linalg.norm(m, axis=1, keepdims=True) + 1e-8)


def test_recall_of_the_whole_table(spark):
    for folder in ("/root/testdata/sf0.01", "/root/testdata/sf0.1"):
        e = table(spark, folder, "embeddings").toPandas()
        v = unit(e.embedding)
        found = queries.knn_cells_approximate(spark, folder).toPandas()
        hits = wanted = 0
        for i in np.flatnonzero(e.vec_id % 20 == 0):
            best = e.vec_id.to_numpy()[np.argsort(-(v @ v[i]), kind="stable")[:10]]
            hits += len(set(best) & set(found[found.query_id == e.vec_id[i]].ref_id))
            wanted += 10
        assert hits >= 0.9 * wanted, (folder, hits / wanted)


def test_hot_buckets_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 7)
    rng = np.random.default_rng(1)
    v = rng.normal(size=(60, 4))
    refs = [(i, v[i].tolist(), b) for i in range(60) for b in ({0, i % 3} if i < 40 else {i % 3})]
    asked = [(i, v[i].tolist(), b) for i in range(25) for b in (0, 1)] + [(99, None, 0), (98, [0.0] * 4, 0), (97, [], 0)]
    refs += [(97, None, 0), (98, [0.0] * 4, 0), (99, [1.0] * 4, None)]
    made = lambda rows, key: spark.createDataFrame(rows, f"{key} bigint, vector array<double>, b int")
    got = retrieval.bucket_topk(made(asked, "query_id"), made(refs, "ref_id"), ["b"], 5).toPandas()
    u = unit(v)
    for q in range(25):
        near = {r for r, x, b in refs if x and any(x) and b in (0, 1)}
        want = sorted(near, key=lambda r: (-round(float(u[q] @ u[r]), 9), r))[:5]
        assert got[got.query_id == q].sort_values("rank").ref_id.tolist() == want
    assert set(got.query_id) == set(range(25))


def test_empty_index(spark):
    none = spark.createDataFrame([], "ref_id bigint, vector array<double>")
    centroids = retrieval.fit_centroids(none, retrieval.cell_count(0))
    asked = spark.createDataFrame([(1, [1.0, 0.0])], "query_id bigint, vector array<double>")
    assert retrieval.topk_cells(asked, retrieval.cells(none, centroids), centroids, 3, 1).count() == 0


def test_places(spark):
    rows = [(1, [1.0, 0.0], 48.0, 25.0), (2, [0.9, 0.1], 48.006, 25.0), (3, [1.0, 0.0], 49.0, 25.0), (4, [1.0, 0.0], None, 25.0), (5, [0.0, 1.0], 48.0, 25.0), (6, [1.0, 0.0], float("nan"), 25.0)]
    frames = spark.createDataFrame(rows, "ref_id bigint, vector array<double>, lat double, lon double")
    got = spatial.scoped_topk(frames.withColumnRenamed("ref_id", "query_id"), frames, 2, 2).toPandas()
    of = lambda q: got[got.query_id == q].sort_values("rank").ref_id.tolist()
    assert of(1) == [1, 2] and of(3) == [3] and of(4) == [] and of(6) == [] and of(5) == [5, 2]


def test_truth_ranks_in_a_grid(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 9)
    monkeypatch.setattr(retrieval, "TILE", 4)
    rng = np.random.default_rng(2)
    v = rng.normal(size=(50, 3))
    asked = v + rng.normal(size=v.shape) * 0.5
    frame = lambda m, key: spark.createDataFrame(pd.DataFrame({key: range(len(m)), "vector": m.tolist()}))
    got = dict(retrieval.truth_ranks(frame(asked, "query_id"), frame(v, "ref_id")).collect())
    s = np.round(unit(asked) @ unit(v).T, 9)
    assert got == {i: int((s[i] > s[i, i]).sum()) + 1 for i in range(50)}
