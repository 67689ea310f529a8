"""Stored frames, features and calibrations."""

import json
import math

import numpy as np
import pytest

from loftline.operators import calibrated, scenes
from loftline.sources import calibrations, exports, frames, schema

M = "a double, b double, tx double, c double, d double, ty double"


def matrix(x, y, sx, sy, angle, sign=1.0):
    c, s = math.cos(angle), math.sin(angle)
    return [float(v) for v in (c * sx, -s * sign * sy, x, s * sx, c * sign * sy, y)]


def filled(known, n, log_scale):
    """known: slot -> matrix; a plain loop over the gaps."""
    out, ids = dict(known), sorted(known)
    for i in range(n) if ids else []:
        if i in known:
            continue
        if i < ids[0] or i > ids[-1]:
            out[i] = known[ids[0] if i < ids[0] else ids[-1]]
            continue
        left, right = max(j for j in ids if j < i), min(j for j in ids if j > i)
        l, r = known[left], known[right]
        five = lambda m: [m[2], m[5], math.hypot(m[0], m[3]), math.hypot(m[1], m[4]), math.atan2(m[3], m[0])]
        p, q = np.array(five(l)), np.array(five(r))
        p[4], q[4] = np.unwrap([p[4], q[4]])
        if log_scale:
            p[2:4], q[2:4] = np.log(np.maximum(p[2:4], 1e-12)), np.log(np.maximum(q[2:4], 1e-12))
        t = (i - left) / (right - left)
        x, y, sx, sy, g = p * (1 - t) + q * t
        if log_scale:
            sx, sy = math.exp(sx), math.exp(sy)
        out[i] = matrix(x, y, sx, sy, g, -1.0 if l[0] * l[4] - l[1] * l[3] < 0 else 1.0)
    return out


@pytest.mark.parametrize("log_scale", [False, True])
def test_fill_equals_a_loop(spark, log_scale):
    rng = np.random.default_rng(3)
    rows, want = [], {}
    for g, (n, share) in enumerate([(40, 0.3), (9000, 0.01), (5, 0.0), (1, 1.0), (12, 0.5)]):
        known = {i: matrix(*rng.normal(size=2) * 50, *rng.uniform(0.1, 4, 2), rng.uniform(-3.1, 3.1), rng.choice([-1.0, 1.0])) for i in range(n) if rng.random() < share}
        rows += [(g, i, *known.get(i, [None] * 6)) for i in range(n)]
        if n < 100:
            want |= {(g, i): m for i, m in filled(known, n, log_scale).items()}
        else:
            some = sorted(known)
            assert len(some) > 10 and some[-1] - some[0] > 4096  # gaps over borders of blocks
            near = {i: known[i] for i in some}
            want |= {(g, i): m for i, m in filled(near, n, log_scale).items()}
    got = calibrated.fill_poses(spark.createDataFrame(rows, f"g int, at bigint, {M}"), ["g"], "at", log_scale).collect()
    assert len(got) == len(rows)
    had = {(r[0], r[1]) for r in rows if r[2] is not None}
    for r in got:
        key = (r.g, r.at)
        assert r.valid == (key in want) and r.filled == (key in want and key not in had)
        if key in want:
            assert np.allclose([r[n] for n in calibrated.MATRIX], want[key], atol=1e-9)


def test_quality_of_edges(spark):
    edges = [(i, 1, i + 2, 10 + i, 0.0 if i % 2 else 0.5) for i in range(8)] + [(20, 9, 9, 7, 0.0), (21, 1, 77, None, None)]
    results = [(i, float(i * i)) for i in range(2, 12) if i != 4]
    got = {
        r.node: r
        for r in calibrated.edge_quality(
            spark.createDataFrame(edges, "edge_id bigint, from_id bigint, to_id bigint, inliers int, rmse double"), spark.createDataFrame(results, "node bigint, tx double")
        ).collect()
    }
    assert got[1].matches == 13 and got[1].rmse == 0.5
    assert math.isclose(got[1].disagreement, np.std([4.0, 9.0, 25.0, 36.0]))  # of the first five 2..6, of which 4 has no result
    assert got[9].disagreement == 0.0 and got[9].matches == 10  # edge 7 ends at 9 with 17: (17 + 7 + 7) / 3 is 10.3
    assert got[2].disagreement == 0.0 and got[77].matches is None


def test_empty_solution(spark):
    slots = spark.createDataFrame([], "track_id bigint, seq bigint, node bigint")
    edges = spark.createDataFrame([], "edge_id bigint, from_id bigint, to_id bigint, inliers int, rmse double")
    results = spark.createDataFrame([], f"node bigint, {M}")
    assert calibrated.solution_table(slots, results, edges, ["track_id"], "seq", 10.0, 10.0).count() == 0
    one = spark.createDataFrame([(None, 0, 5)], slots.schema)
    (row,) = calibrated.solution_table(one, results, edges, ["track_id"], "seq", 10.0, 10.0).collect()
    assert (row.valid, row.filled, row.a, row.lat, row.matches, row.rmse) == (False, False, None, None, 0, 0.0)


def test_complete_frames(spark):
    rows = spark.createDataFrame([(1, [1.0], 5.0, float("nan")), (2, None, 3.0, 4.0)], "frame_id bigint, vector array<double>, lat double, lon double")
    a, b = frames.complete(rows).orderBy("frame_id").collect()
    assert (a.frame_index, a.lat, a.lon, a.patches, a.frame_width) == (1, None, None, None, None) and (b.lat, b.lon) == (3.0, 4.0)
    with pytest.raises(ValueError, match="vector"):
        frames.complete(rows.drop("vector"))


def test_features_in_both_layouts(spark):
    rows = [(1, [1.0, 2.0, 3.0, 4.0]), (2, []), (3, None), (4, [5.0])]
    plain = spark.createDataFrame(rows, "frame_id bigint, keypoints array<double>")
    stored = frames.padded(plain, 3, {"keypoints": frames.F.lit(0.0)})
    assert {r.frame_id: (r.kp_count, r.keypoints) for r in stored.collect()} == {1: (3, [1.0, 2.0, 3.0]), 2: (0, [0.0] * 3), 3: (0, [0.0] * 3), 4: (1, [5.0, 0.0, 0.0])}
    sized = spark.createDataFrame([(1, [1.0], 7, 8), (4, [1.0], 7, None)], "frame_id bigint, vector array<double>, frame_height int, frame_width int")
    asked = spark.createDataFrame([(i,) for i in (1, 2, 3, 4, 9)], "frame_id bigint")
    null = frames.F.lit(None).cast("int")
    for table, first in ((stored, [1.0, 2.0, 3.0]), (plain, [1.0, 2.0, 3.0, 4.0])):
        got = {r.frame_id: r for r in frames.frame_features(asked, sized, table, ["keypoints"], (null, null)).collect()}
        assert got[1].keypoints == first and got[4].keypoints == [5.0] and got[2].keypoints is None
        assert [got[i].status for i in (1, 2, 3, 4, 9)] == ["ok", "no keypoints", "no keypoints", "ok", "unknown frame"]
        assert (got[1].height, got[1].width) == (7, 8) and (got[4].height, got[4].width) == (1080, 1920) == (got[9].height, got[9].width)


def test_previous_solution(spark):
    rows = spark.createDataFrame([(1, True, *[1.0] * 6), (2, False, *[0.0] * 6), (3, None, *[0.0] * 6)], f"frame_id bigint, valid boolean, {M}")
    assert [r.frame_id for r in frames.previous_solution(rows).collect()] == [1]
    assert frames.previous_solution(rows.drop("valid")).count() == 0


def test_lines_and_sources(spark, tmp_path):
    rows = [("WEB_MERCATOR", None, None, None, None, 4, *[1.5] * 6, 0.5, 7), ("UTM", 48.0, 25.0, 640, 480, 9, *[2.5] * 6, None, None)]
    given = spark.createDataFrame(rows, f"mode string, ref_lat double, ref_lon double, width int, height int, frame_id bigint, {M}, rmse_m double, inliers_count int")
    calibrations.write(given, str(tmp_path / "lines"))
    back = calibrations.read_lines(spark, str(tmp_path / "lines")).select(*given.columns)
    assert sorted(map(tuple, back.collect()), key=lambda r: r[5]) == rows

    folder = tmp_path / "project"
    (folder / "deep").mkdir(parents=True)
    m = [[1, 0, 2], [0, 1, 3]]
    (folder / "old.json").write_text(json.dumps({"calib_frame_id": 3, "affine_matrix": m, "reference_gps": [48.0, 25.0]}, indent=2))
    (folder / "deep" / "new.json").write_text(json.dumps({"version": "3.0", "anchors": [{"frame_id": 1, "affine_matrix": m}, {"frame_id": 2, "affine_matrix": m[:1]}, {"frame_id": 5, "affine_matrix": m}]}))
    (folder / "bad.json").write_text('{"version": "3.0", "anch')
    table = [("s1", True, "old.json"), ("s2", None, "deep/new.json"), ("s3", True, "bad.json"), ("s4", True, "gone.json"), ("s5", False, "old.json")]
    got = calibrations.read_sources(spark.createDataFrame(table, "source_id string, enabled boolean, calibration_file string"), str(folder))
    assert sorted((r.source_id, r.frame_id, r.mode, r.ref_lat, r.tx) for r in got.collect()) == [("s1", 3, "UTM", 48.0, 2.0), ("s2", 1, "WEB_MERCATOR", None, 2.0), ("s2", 5, "WEB_MERCATOR", None, 2.0)]


def test_graph_features(spark):
    nodes = spark.createDataFrame([(1, 48.0, 25.0, True), (2, 48.5, 25.5, None), (3, None, 25.0, False)], "node bigint, lat double, lon double, anchor boolean")
    edges = spark.createDataFrame([(7, 1, 2, "temporal", 1.5, None), (8, 2, 3, "spatial", 1.0, 2.0), (9, 1, 99, "spatial", 1.0, 2.0)], "edge_id bigint, from_id bigint, to_id bigint, edge_type string, weight double, residual double")
    got = {(r.kind, r.id): json.loads(r.feature) for r in exports.graph_features(nodes, edges).collect()}
    assert set(got) == {("anchor", 1), ("frame", 2), ("edge", 7)}
    assert got["anchor", 1] == {"type": "Feature", "geometry": {"type": "Point", "coordinates": [25.0, 48.0]}, "properties": {"frame_id": 1, "type": "anchor"}}
    assert got["edge", 7]["geometry"] == {"type": "LineString", "coordinates": [[25.0, 48.0], [25.5, 48.5]]}
    assert got["edge", 7]["properties"] == {"from_id": 1, "to_id": 2, "edge_type": "temporal", "residual": None, "weight": 1.5}


def test_slot_errors(spark):
    rows = spark.createDataFrame([(1, 2.34567, 0.5, 0.01), (2, 0.0, None, None)], "slot bigint, error double, angle_error double, scale_error double")
    got = exports.slot_errors(rows, "slot", exports.F.col("slot") == 1).orderBy("slot").collect()
    assert list(map(tuple, got)) == [(1, 1, "2.346", "0.5000", "1.0000"), (2, 0, "0.000", None, None)]


def test_runs_of_unequal_length_are_not_paired(spark):
    rows = [("k", "a", 5, 1), ("k", "a", 2, 2), ("k", "b", 9, 3), ("k", "b", 1, 4), ("u", "a", 1, 5), (None, "a", 1, 6), (None, "b", 1, 7), ("v", "b", 1, 8), ("w", "a", 1, 9), ("w", "b", 1, 10), ("w", "b", 2, 11)]
    runs = spark.createDataFrame(rows, "scene string, side string, at bigint, frame bigint")
    got = scenes.pair_runs(runs, ["scene"], "side", ["at"], ["frame"]).collect()
    assert sorted(map(tuple, got), key=str) == sorted([("k", 0, 2, 4), ("k", 1, 1, 3), (None, 0, 6, 7)], key=str)
    assert scenes.pair_runs(runs.limit(0), ["scene"], "side", ["at"], ["frame"]).count() == 0


def test_schema_gate(spark):
    rows = spark.createDataFrame([(1, "x", "p", None), (2, "y", "p", None), (3, "y", "q", None), (4, None, None, None), (5, "x", "p", "r")], "source_id bigint, kind string, step string, dim string")
    got = lambda base: {r.source_id: (r.differing, r.confounders, r.verdict) for r in schema.gate(rows, rows.where(f"source_id = {base}"), {"kind"}).collect()}
    assert got(1) == {1: (0, 0, "identical"), 2: (1, 0, "valid"), 3: (2, 1, "confounded"), 4: (2, 1, "incomparable"), 5: (1, 1, "confounded")}
    assert {v[2] for v in got(4).values()} == {"incomparable"}
