"""Annealing of many components at once against the solver of one component, and what it costs in jobs."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from loftline.operators import bands
from loftline.operators import graph as G
from loftline.plans import keyframe_queries

from .test_keyframes import EDGES, NODES, chain


def jobs(spark, group, run):
    spark.sparkContext.setJobGroup(group, group)
    try:
        run()
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_more_rounds_take_no_more_jobs(spark):
    nodes, edges = chain(30, {7: 40.0, 22: -30.0})
    a, b = spark.createDataFrame(nodes, NODES), spark.createDataFrame(edges, EDGES)
    few, many = (jobs(spark, f"anneal-{n}", lambda n=n: G.anneal(a, b, 10.0, rounds=n)[1].collect()) for n in (1, 4))
    assert few == many, (few, many)


def graph(rng, n, ids, pairs, outliers):
    """Nodes and edges of a part: poses on a line, steps between them with noise, some of them far off."""
    p = np.stack([np.arange(n) * 4.0, rng.normal(0, 3, n), *rng.normal(0, 0.1, (2, n)), rng.normal(0, 0.5, n)], 1)
    i, j = np.array(pairs, int).reshape(-1, 2).T
    step = np.stack([p[j, k] - p[i, k] for k in range(5)], 1) + rng.normal(0, 0.05, (len(i), 5))
    step[outliers, 0] += 20.0
    return p[ids], np.argsort(ids)[i], np.argsort(ids)[j], step


def by_hand(p, anchored, i, j, step, weight, spatial, bounds, sign, robust):
    start, factor = p, np.ones(len(i))
    for bound in bounds:
        if bound is not None:
            r2 = bands._squares(p, i, j, step, 10.0, sign)
            factor = np.where(spatial, bound**2 / (bound**2 + r2), factor)
        nodes = pd.DataFrame(p, columns=G.POSE).assign(component=0, node=np.arange(len(p)), is_anchor=anchored, **dict(zip(G.START, start.T, strict=True)))
        edges = pd.DataFrame(step, columns=G.STEP).assign(from_id=i, to_id=j, weight=weight * factor)
        got = G.solve_component(nodes, edges, 10.0, sign, robust=robust)
        p = got[G.POSE].to_numpy()
    return p, got["cost"].iloc[0], factor


@pytest.mark.parametrize(("sign", "robust", "grid"), [(1.0, None, 16384), (-1.0, None, 64), (1.0, 8.0, 64)])
def test_parts_on_a_grid_equal_those_solved_alone(monkeypatch, sign, robust, grid):
    """Chains of several sizes, ids in any order, parallel edges both ways, a loop, a star, one node, no anchor, an unknown number."""
    monkeypatch.setattr(bands, "GRID", grid)
    rng = np.random.default_rng(7)
    near = lambda n: [(k, k + b) for b in (1, 3) for k in range(n - b)]
    made = [
        (30, np.arange(30), near(30), [40]), (7, np.arange(7), near(7), []), (1, np.arange(1), [], []), (41, rng.permutation(41), near(41), [50, 55]),
        (12, np.arange(12), near(12) + [(2, 3), (3, 2), (5, 2)], [12]), (9, np.arange(9), [*near(9), (4, 4)], [9]), (40, np.arange(40), [(0, k) for k in range(1, 40)], [5]),
        (20, np.arange(20), near(20), [20]), (15, np.arange(15), near(15), []),
    ]
    parts = [graph(rng, *m) for m in made]
    size = [m[0] for m in made]
    first = np.cumsum([0, *size[:-1]])
    part, of = np.repeat(np.arange(len(made)), size), np.repeat(np.arange(len(made)), [len(p[1]) for p in parts])
    pose, step = np.concatenate([p[0] for p in parts]) + rng.normal(0, 0.2, (sum(size), 5)), np.concatenate([p[3] for p in parts])
    i, j = (np.concatenate([p[k] + f for p, f in zip(parts, first, strict=True)]) for k in (1, 2))
    anchored = (np.arange(len(part)) - first[part]) % 9 == 0
    anchored[part == 7] = False
    anchored[part == 7] |= np.arange(20) == 3
    pose[first[8] + 4, 0] = np.nan
    weight, spatial = rng.uniform(1, 4, len(of)), rng.random(len(of)) < 0.6
    alone = []

    def solve(p, start, fixed, a, b, e, w):
        alone.append(len(p))
        nodes = pd.DataFrame(p, columns=G.POSE).assign(component=0, node=np.arange(len(p)), is_anchor=fixed, **dict(zip(G.START, start.T, strict=True)))
        got = G.solve_component(nodes, pd.DataFrame(e, columns=G.STEP).assign(from_id=a, to_id=b, weight=w), 10.0, sign, robust=robust)
        return got[G.POSE].to_numpy(), got["cost"].iloc[0]

    for bounds in ([None], [40.0, 12.0, 4.0]):
        alone.clear()
        found, cost, factor, off, left = bands.anneal_parts(part, pose, pose, anchored, of, i, j, step, weight, spatial, bounds, 10.0, sign, robust, solve, 100, len(made))
        assert not left.any() and set(alone) == {9, 40}  # the loop and the star; ids in any order fit the grid
        for p in range(8):
            n, e = part == p, of == p
            want = by_hand(pose[n], anchored[n], i[e] - first[p], j[e] - first[p], step[e], weight[e], spatial[e], bounds, sign, robust)
            np.testing.assert_allclose(found[n], want[0], atol=1e-2)  # both stop at gains of a part in 1e9 of the cost
            np.testing.assert_allclose(cost[p], want[1], rtol=1e-3 if robust else 1e-5, atol=1e-7)
            np.testing.assert_allclose(factor[e], want[2], atol=2e-4)
            np.testing.assert_allclose(off[e] ** 2, bands._squares(found, i[e], j[e], step[e], 10.0, sign), rtol=1e-6, atol=1e-9)
        # A part with an unknown number stays where it is and leaves the others alone.
        np.testing.assert_array_equal(found[part == 8], pose[part == 8])
    left = bands.anneal_parts(part, pose, pose, anchored, of, i, j, step, weight, spatial, [None], 10.0, sign, robust, solve, 20, len(made))[4]
    assert np.flatnonzero(left).tolist() == [6]


def test_large_and_small_components_anneal_alike(spark, monkeypatch):
    """One of more nodes than a task takes, and edges without a component, an end or any node."""
    solve = G.solve
    monkeypatch.setattr(G, "solve", lambda *a, block=None: solve(*a))  # without blocks, which take many jobs
    nodes, edges = [], []
    for c, (n, off) in enumerate(((46, {7: 40.0, 22: -30.0, 38: 55.0}), (9, {4: 35.0}), (20, {}))):
        a, b = chain(n, off)
        shift = 1000 * c
        nodes += [(c, r[1] + shift, *r[2:]) for r in a]
        edges += [(c, r[1] + 10 * shift, r[2] + shift, r[3] + shift, *r[4:]) for r in b]
    edges += [(None, 90001, 0, 1, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0, "spatial"), (1, 90002, 1000, 77, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0, "spatial"), (5, 90003, 0, 1, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0, "spatial")]
    a, b = spark.createDataFrame(nodes, NODES), spark.createDataFrame(edges, EDGES).withColumn("note", F.col("edge_id") * 2)
    small, large = G.anneal(a, b.drop("note"), 10.0, rounds=2), G.anneal(a, b, 10.0, rounds=2, block=30)
    one, two = (x[1].toPandas().sort_values("edge_id") for x in (small, large))
    assert one.edge_id.tolist() == two.edge_id.tolist() == sorted(e[1] for e in edges)
    assert two.columns.tolist() == [*b.columns, "factor"] and (two.note == two.edge_id * 2).all()
    np.testing.assert_allclose(one.factor, two.factor, atol=2e-4)
    assert one.set_index("edge_id").factor[[90001, 90002, 90003]].tolist() == [1.0, 1.0, 1.0]
    p, q = (x[0].toPandas().sort_values("node") for x in (small, large))
    assert p.node.tolist() == q.node.tolist() == sorted(r[1] for r in nodes)
    np.testing.assert_allclose(p[[*G.POSE, "cost"]], q[[*G.POSE, "cost"]], rtol=1e-5, atol=1e-3)


def test_rounds_go_on_until_the_bound_is_reached(spark):
    """Also where the largest residual is far more than twelve rounds above it."""
    r = [1.0, 1.1, 1.2, 0.9, 1.0, 1e6]
    got = G._bounds(spark.createDataFrame([(x,) for x in r], "r double"), None, 5.0, 1.4)
    bound = 1.05 + 5.0 * 1.4826 * np.median(np.abs(np.array(r) - 1.05))
    assert got[0] == pytest.approx(1e6) and got[-1] == pytest.approx(bound) and len(got) > 12
    np.testing.assert_allclose(np.array(got[:-2]) / got[1:-1], 1.4)
    assert 1.0 < got[-2] / got[-1] <= 1.4 + 1e-9
    assert G._bounds(spark.createDataFrame([(x,) for x in r[:5]], "r double"), None, 5.0, 1.4) == []


def test_the_query_takes_all_rounds(spark, monkeypatch):
    """Its factors are those of a plain loop over its tracks that ends where mu is 1."""
    given, anneal = [], G.anneal
    monkeypatch.setattr(G, "anneal", lambda nodes, edges, *a, **how: given.append((nodes.toPandas(), edges.toPandas())) or anneal(nodes, edges, *a, **how))
    found = keyframe_queries.annealed_weights(spark, "/root/testdata/sf0.001").toPandas().set_index("edge_id").sort_index()
    nodes, edges = given[0]
    nodes, edges = nodes.sort_values("node").reset_index(drop=True), edges.sort_values("edge_id").reset_index(drop=True)
    at = pd.Series(nodes.index, nodes.node)
    i, j, step, spatial = at[edges.from_id].to_numpy(), at[edges.to_id].to_numpy(), edges[G.STEP].to_numpy(), (edges.edge_type == "spatial").to_numpy()
    nodes = nodes.assign(**{s: nodes[n] for s, n in zip(G.START, G.POSE, strict=True)})

    def solved(p, factor):
        here, links = nodes.assign(**dict(zip(G.POSE, p.T, strict=True))), edges.assign(weight=edges.weight * factor)
        rows = [G.solve_component(here[here.component == c].reset_index(drop=True), links[links.component == c], 960.0) for c in here.component.unique()]
        p = pd.concat(rows).sort_values("node")[G.POSE].to_numpy()
        return p, np.sqrt(bands._squares(p, i, j, step, 960.0, 1.0))

    factor = np.ones(len(edges))
    p, r = solved(nodes[G.POSE].to_numpy(), factor)
    middle = np.median(r[spatial])
    bound = middle + 5.0 * 1.4826 * np.median(np.abs(r[spatial] - middle))
    mu, rounds = r[spatial].max() / bound, 0
    while True:
        factor[spatial] = ((mu * bound) ** 2 / ((mu * bound) ** 2 + r**2))[spatial]
        p, r = solved(p, factor)
        rounds += 1
        if mu <= 1:
            break
        mu = max(1.0, mu / 1.4)
    assert rounds > 4
    np.testing.assert_allclose(found.factor, factor, atol=2e-4)
