"""Scans, overlaps, keyframes, bridges, checks of anchors and annealing against direct computation."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loftline.functions import affine
from loftline.operators import graph as G
from loftline.operators import keyframes as K
from loftline.operators import scans, scenes


def step_matrix(rng):
    a, s = rng.uniform(-0.1, 0.1), math.exp(rng.uniform(-0.02, 0.02))
    return [s * math.cos(a), -s * math.sin(a), rng.uniform(-9, 9), s * math.sin(a), s * math.cos(a), rng.uniform(-9, 9), rng.uniform(-1e-5, 1e-5), 1e-6, 1.0]


def track_rows(track, n, seed, lost=0.1):
    rng = random.Random(seed)
    return [(track, k, None if k == 0 or rng.random() < lost else step_matrix(rng), k * 2) for k in range(n)]


SCHEMA = "track_id long, seq long, step array<double>, place long"


def products(rows):
    out, at = {}, {}
    for t, k, h, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        at[t] = at.get(t, np.eye(3)) @ (np.eye(3) if h is None else np.array(h).reshape(3, 3))
        out[t, k] = at[t].ravel()
    return out


@pytest.mark.parametrize("block", [4, 256])
def test_products_of_many_blocks_and_one_hot_track(spark, block):
    rows = track_rows(1, 700, 1) + track_rows(2, 5, 2) + track_rows(None, 70, 3) + track_rows(4, 1, 4)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = scans.cumulative_products(df, ["track_id"], "seq", block=block)
    assert got.columns == ["track_id", "seq", "step", "place", "pose"]
    found, want = {(r.track_id, r.seq): r.pose for r in got.collect()}, products(rows)
    assert found.keys() == want.keys() and all(np.allclose(found[k], want[k], rtol=1e-9, atol=1e-9) for k in want)
    assert {r.seq * 2 == r.place for r in got.collect()} == {True}
    # Blocks of the hot track lie in several tasks before the last walk.
    assert scans.cumulative_products(spark.createDataFrame([], SCHEMA), ["track_id"], "seq").collect() == []


def test_running_sums_and_last_values(spark):
    rng = random.Random(5)
    rows = [(t, k, rng.choice([None, 1.0, 2.5]), rng.choice([None, None, k * 1.0])) for t, n in ((1, 300), (None, 20)) for k in range(n)]
    df = spark.createDataFrame(rows, "t long, k long, v double, w double")
    for ahead in (False, True):
        for own in (False, True):
            got = scans.running(df, ["t"], "k", {"s": "v"}, {"l": "w"}, ahead=ahead, own=own, block=16).collect()
            assert len(got) == len(rows)
            for r in got:
                past = [x for x in rows if x[0] == r.t and (x[1] == r.k and own or (x[1] > r.k if ahead else x[1] < r.k))]
                known = [x for x in past if x[3] is not None]
                last = (min if ahead else max)(known, key=lambda x: x[1])[3] if known else None
                assert abs(r.s - sum(x[2] or 0 for x in past)) < 1e-9 and r.l == last


def test_quantiles_by_ranges(spark):
    rng = np.random.default_rng(3)
    values = {"a": rng.normal(size=501), "b": np.array([3.0]), "c": np.repeat([1.0, 2.0], 40)}
    rows = [(g, float(v)) for g, vs in values.items() for v in vs] + [("a", None), ("d", None), ("a", float("nan"))]
    got = {r.g: r for r in scans.quantiles(spark.createDataFrame(rows, "g string, v double").repartition(4), ["g"], "v", {"m": 0.5, "p": 0.95}).collect()}
    assert got.keys() == values.keys()
    for g, vs in values.items():
        assert np.allclose([got[g].n, got[g].m, got[g].p], [len(vs), np.quantile(vs, 0.5), np.quantile(vs, 0.95)])
    assert scans.quantiles(spark.createDataFrame([], "v double"), [], "v", {"m": 0.5}).collect() == []


def clip_area(h, width, height, n=700):
    """Part of a fine grid of the frame that lies inside the image of the frame."""
    back = np.linalg.inv(h)
    x, y = np.meshgrid((np.arange(n) + 0.5) / n * width, (np.arange(n) + 0.5) / n * height)
    p = back @ np.stack([x.ravel(), y.ravel(), np.ones(n * n)])
    u, v = p[0] / p[2], p[1] / p[2]
    return np.mean((u >= 0) & (u <= width) & (v >= 0) & (v <= height) & (p[2] * np.linalg.det(h) ** 0 != 0))


def test_overlap_of_quadrilaterals(spark):
    w, h = 640.0, 480.0
    known = {
        (1, 0, 0, 0, 1, 0, 0, 0, 1): 1.0, (1, 0, 320, 0, 1, 0, 0, 0, 1): 0.5, (1, 0, -160, 0, 1, 0, 0, 0, 1): 0.75, (1, 0, 640, 0, 1, 0, 0, 0, 1): 0.0,
        (-1, 0, 640, 0, 1, 0, 0, 0, 1): 1.0, (0.5, 0, 160, 0, 0.5, 120, 0, 0, 1): 0.25, (2, 0, -320, 0, 2, -240, 0, 0, 1): 1.0,
        (0, 0, 0, 0, 0, 0, 0, 0, 0): 0.0, (1, 0, 0, 1, 0, 0, 0, 0, 1): 0.0, (1, 0, 0, 0, 1, 0, -0.01, 0, 1): 0.0, (float("nan"),) + (1.0,) * 8: 0.0,
        (float("inf"), 0, 0, 0, 1, 0, 0, 0, 1): 0.0,
    }
    rng = random.Random(8)
    turned = []
    for _ in range(40):
        a, s = rng.uniform(-3, 3), rng.choice([1, -1])
        turned.append((math.cos(a), -math.sin(a) * s, rng.uniform(-300, 600), math.sin(a), math.cos(a) * s, rng.uniform(-300, 500), rng.uniform(-5e-4, 5e-4), rng.uniform(-4e-4, 4e-4), 1.0))
    rows = [(list(map(float, m)),) for m in [*known, *turned]] + [(None,)]
    got = [r.o for r in spark.createDataFrame(rows, "h array<double>").select(K.overlap_fraction(F.col("h"), w, h).alias("o")).collect()]
    assert np.allclose(got[: len(known)], list(known.values()), atol=1e-9) and got[-1] == 0.0
    stacked = np.array([r[0] for r in rows[:-1]]).reshape(-1, 3, 3)
    assert np.allclose(K.overlaps(stacked, w, h), got[:-1], atol=1e-9)
    for m, o in zip(turned, got[len(known) :], strict=False):
        m = np.array(m).reshape(3, 3)
        if (m[2] @ np.array([[0, w, w, 0], [0, 0, h, h], [1, 1, 1, 1]]) > 1e-12).all():
            assert abs(clip_area(m, w, h) - o) < 4e-3
        else:
            assert o == 0
    assert K.overlaps(np.zeros((0, 3, 3)), w, h).shape == (0,)


def row_wise(rows, w, h, most, gap, first):
    pose, out = products(rows), {}
    for t in {r[0] for r in rows}:
        key, since, start = None, 0, True
        for _, k, step, _ in sorted(r for r in rows if r[0] == t):
            p = pose[t, k].reshape(3, 3)
            if start:
                hit, start = first, False
            elif step is None or key is None or gap and since >= gap or np.linalg.det(key) == 0:
                hit = True
            else:
                hit = K.overlaps((np.linalg.inv(key) @ p)[None], w, h)[0] <= most
            if hit:
                key, since = p, 0
            else:
                since += 1
            out[t, k] = bool(hit)
    return out


@pytest.mark.parametrize("gap,first,most", [(0, True, 0.5), (7, True, 0.5), (40, False, 0.8), (3, True, 0.0)])
def test_keyframes_equal_a_row_wise_choice(spark, gap, first, most):
    rows = [r for t in range(9) for r in track_rows(t, 30 + 60 * (t % 3), t, lost=0.03)] + track_rows(20, 1500, 11, lost=0.01) + track_rows(21, 1, 1)
    df = scans.cumulative_products(spark.createDataFrame(rows, SCHEMA), ["track_id"], "seq")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "97")  # tracks go on from batch to batch
    try:
        got = {(r.track_id, r.seq): r.is_keyframe for r in K.select_keyframes(df, 40.0, 30.0, most, gap, first, look=5).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    want = row_wise(rows, 40.0, 30.0, most, gap, first)
    assert got == want and 0 < sum(want.values()) < len(want)


def test_keyframes_of_singular_and_null_poses(spark):
    zero, one = [0.0] * 9, [float(v) for v in scans.IDENTITY]
    rows = [(1, 0, one, None), (1, 1, one, zero), (1, 2, one, one), (1, 3, one, one)]
    df = spark.createDataFrame(rows, "track_id long, seq long, step array<double>, pose array<double>")
    got = [r.is_keyframe for r in K.select_keyframes(df, 40.0, 30.0).orderBy("seq").collect()]
    assert got == [True, True, True, False]
    assert K.select_keyframes(df.limit(0), 40.0, 30.0).collect() == []


def test_bridges_take_the_nearest_predecessor_that_passes(spark):
    turn = {(0, 1): 0.0, (1, 2): 90.0, (0, 2): 1.0, (2, 3): None, (1, 3): None, (0, 3): 60.0, (3, 4): None, (2, 4): None, (1, 4): 2.0}
    pairs = F.create_map(*[F.lit(v) for (a, b), d in turn.items() if d is not None for v in (a * 10 + b, d)])
    frames = spark.createDataFrame([(1, k, k) for k in range(6)], "track_id long, seq long, node long")

    def match(before):
        angle = F.radians(pairs[(before("node") * 10 + F.col("node")).cast("int")])
        return K.Match(affine.compose(F.when(angle.isNotNull(), 3.0), F.lit(4.0), F.when(angle.isNotNull(), 1.0), F.lit(1.0), angle), F.lit(49), F.lit(1.0), F.lit(None).cast("double"))

    got = {r.node: r for r in K.bridge_edges(frames, match, 3, 100.0, 100.0).collect()}
    assert {n: (r.from_id, r.depth, r.gated) for n, r in got.items()} == {
        0: (None, None, 0), 1: (0, 1, 0), 2: (0, 2, 1), 3: (None, None, 1), 4: (1, 3, 0), 5: (None, None, 0)}
    assert abs(got[1].dx - 3) < 1e-9 and abs(got[1].dy - 4) < 1e-9 and got[1].weight == pytest.approx(3.5)
    assert got[4].dtheta == pytest.approx(math.radians(2.0))


def predict(p, e, sign, forward):
    x, y, sx, sy, t = p
    dx, dy, lx, ly, dt = e
    if not forward:
        ix, iy = -math.exp(-lx) * (math.cos(dt) * dx + math.sin(dt) * dy), math.exp(-ly) * (math.sin(dt) * dx - math.cos(dt) * dy)
        dx, dy, lx, ly, dt = ix, iy, -lx, -ly, -dt
    c, s, u, v = math.cos(t), math.sin(t), math.exp(sx), math.exp(sy)
    return x + c * u * dx - s * v * dy * sign, y + s * u * dx + c * v * dy * sign, sx + lx, sy + ly, t + dt * sign


@pytest.mark.parametrize("sign", [1.0, -1.0])
def test_anchor_checks_walk_both_sides(spark, sign):
    rng = random.Random(3)
    nodes, steps, want = [], [], {}
    for t, n in ((1, 90), (2, 12), (3, 4)):
        pose = {k: [rng.uniform(-9, 9), rng.uniform(-9, 9), rng.uniform(-0.2, 0.2), rng.uniform(-0.2, 0.2), rng.uniform(-3, 3)] for k in range(n)}
        anchors = [k for k in range(n) if k % 11 == 2 and k != 24] if t < 3 else [1]
        link = {k: [rng.uniform(-2, 2), rng.uniform(-2, 2), rng.uniform(-0.1, 0.1), rng.uniform(-0.1, 0.1), rng.uniform(-0.3, 0.3)] for k in range(1, n) if (t, k) != (1, 40)}
        nodes += [(t, k, t * 1000 + k, *pose[k], k in anchors) for k in pose]
        steps += [(t, k, *e) for k, e in link.items()]
        for a in anchors:
            off = []
            before, behind = [x for x in anchors if x < a], [x for x in anchors if x > a]
            if before and all(k in link for k in range(before[-1] + 1, a + 1)):
                p = pose[before[-1]]
                for k in range(before[-1] + 1, a + 1):
                    p = predict(p, link[k], sign, True)
                off.append(math.dist(p[:2], pose[a][:2]))
            if behind and all(k in link for k in range(a + 1, behind[0] + 1)):
                p = pose[behind[0]]
                for k in range(behind[0], a, -1):
                    p = predict(p, link[k], sign, False)
                off.append(math.dist(p[:2], pose[a][:2]))
            want[t * 1000 + a] = min(off) if off else None
    pose_columns = ", ".join(f"{n} double" for n in G.POSE)
    df = spark.createDataFrame(nodes, f"track_id long, seq long, node long, {pose_columns}, is_anchor boolean").repartition(3)
    links = spark.createDataFrame(steps, "track_id long, seq long, " + ", ".join(f"{n} double" for n in G.STEP))
    got = {r.node: r for r in G.anchor_checks(df, links, 8.0, sign).collect()}
    assert got.keys() == want.keys() and None in want.values()
    for n, d in want.items():
        assert got[n].reachable == (d is not None) and (d is None or abs(got[n].disagreement - d) < 1e-9)
        assert got[n].flag == (None if d is None else "warning" if d > 8 else "normal")


def chain(n, off):
    """A chain with spatial edges over three steps, some of which are off by as much as `off` says."""
    rng = random.Random(n)
    nodes = [(1, k, 10.0 * k, 3.0 * (k % 2), 0.0, 0.0, 0.0, k % 15 == 0) for k in range(n)]
    edges = []
    for k in range(1, n):
        for back, kind in ((1, "temporal"), (3, "spatial")):
            if k >= back:
                a, b = nodes[k - back], nodes[k]
                shift = off.get(k, 0.0) if kind == "spatial" else 0.0
                edges.append((1, 2 * k + (back > 1), k - back, k, b[2] - a[2] + rng.gauss(0, 0.05) + shift, b[3] - a[3] + rng.gauss(0, 0.05), 0.0, 0.0, 0.0, 1.0 + k % 2 if back > 1 else 5.0, kind))
    return nodes, edges


NODES = "component long, node long, " + ", ".join(f"{n} double" for n in G.POSE) + ", is_anchor boolean"
EDGES = "component long, edge_id long, from_id long, to_id long, " + ", ".join(f"{n} double" for n in G.STEP) + ", weight double, edge_type string"


def test_annealing_takes_weight_from_planted_outliers(spark):
    off = {7: 40.0, 22: -30.0, 38: 55.0}
    nodes, edges = chain(46, off)
    a, b = spark.createDataFrame(nodes, NODES), spark.createDataFrame(edges, EDGES)
    solved, found = G.anneal(a, b, 10.0)
    factor = {r.to_id: r.factor for r in found.collect() if r.edge_type == "spatial"}
    assert all(factor[k] < 0.1 for k in off), {k: factor[k] for k in off}
    assert all(f > 0.5 for k, f in factor.items() if k not in off), sorted((f, k) for k, f in factor.items())[:9]
    assert {r.factor for r in found.collect() if r.edge_type == "temporal"} == {1.0}
    truth = {r[1]: r[2:4] for r in nodes}
    worst = lambda rows: max(math.dist((r.x, r.y), truth[r.node]) for r in rows.collect())
    assert 3 * worst(solved) < worst(G.solve(a, b, 10.0)), worst(solved)
    assert factor == pytest.approx(annealed_by_hand(nodes, edges), abs=1e-4)


def annealed_by_hand(nodes, edges, k=5.0, fall=1.4, rounds=12):
    """The same rounds on whole tables in memory; the solution of a round comes from the solver of one component."""
    import pandas as pd

    columns = [c.split()[0] for c in NODES.split(", ")]
    start, table = pd.DataFrame(nodes, columns=columns), pd.DataFrame(edges, columns=[c.split()[0] for c in EDGES.split(", ")])
    first = start[G.POSE].to_numpy()

    def solved(p, weight):
        at = start.assign(**dict(zip(G.POSE, p.T, strict=True)), **dict(zip(G.START, first.T, strict=True)))
        return G.solve_component(at, table.assign(weight=weight), 10.0)[G.POSE].to_numpy()

    def off(p):
        out = {}
        for r in table[table.edge_type == "spatial"].itertuples():
            i, j = p[r.from_id], p[r.to_id]
            x, y = predict(i, (r.dx, r.dy, 0, 0, 0), 1.0, True)[:2]
            parts = [(j[0] - x) / math.exp(i[2]), (j[1] - y) / math.exp(i[3]), 10 * (j[2] - i[2]), 10 * (j[3] - i[3]), 10 * (j[4] - i[4])]
            out[r.to_id] = math.sqrt(sum(v * v for v in parts))
        return out

    p = solved(first, table.weight)
    r = off(p)
    values = np.array(list(r.values()))
    bound = np.median(values) + k * 1.4826 * np.median(np.abs(values - np.median(values)))
    mu = max(1.0, values.max() / bound)
    for _ in range(rounds):
        factor = {n: (mu * bound) ** 2 / ((mu * bound) ** 2 + v * v) for n, v in r.items()}
        weight = [w * (factor[t] if kind == "spatial" else 1.0) for w, t, kind in zip(table.weight, table.to_id, table.edge_type, strict=True)]
        p = solved(p, weight)
        if mu <= 1:
            break
        mu, r = max(1.0, mu / fall), off(p)
    return factor


def test_annealing_leaves_a_clean_graph_alone(spark):
    nodes, edges = chain(20, {})
    edges = [(*e[:4], round(e[4], 0), round(e[5], 0), *e[6:]) for e in edges]  # all edges fit
    a, b = spark.createDataFrame(nodes, NODES), spark.createDataFrame(edges, EDGES)
    solved, found = G.anneal(a, b, 10.0)
    assert {r.factor for r in found.collect()} == {1.0} and found.count() == len(edges)
    assert {r.node for r in solved.collect()} == set(range(20))
    few = b.where("edge_type = 'temporal' or edge_id < 8")
    assert {r.factor for r in G.anneal(a, few, 10.0)[1].collect()} == {1.0}


def test_kinematic_triples_over_gaps(spark):
    rows = [(1, 0, True), (1, 1, True), (1, 5, True), (1, 6, False), (1, 9, True), (2, 3, False), (2, 4, False)]
    df = spark.createDataFrame(rows, "track_id long, slot long, fixed boolean")
    got = sorted((r.a, r.b, r.c, r.alpha, r.weight) for r in scenes.kinematic_triples(df, "track_id", "slot", "fixed", 2.0).collect())
    assert got == [(1, 5, 6, 0.2, 0.8), (5, 6, 9, 0.75, 1.0)]
    assert scenes.kinematic_triples(df, "track_id", "slot", "fixed", 0.0).collect() == []
