"""Relative-pose graphs: propagation from anchors, reachability, quality of frames, support, pruning, least squares.

Edges: (edge_id, from_id, to_id, dx, dy, log_dsx, log_dsy, dtheta, weight, edge_type, inliers, rmse).
Poses: (node, x, y, log_sx, log_sy, theta).
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.affine import Pose, edge_residual, predict_forward, predict_inverse
from ..session import cut, stored
from .components import components
from .packs import WHOLE, pack, unpack
from .scans import quantiles, ranked, running

POSE = ["x", "y", "log_sx", "log_sy", "theta"]
STEP = ["dx", "dy", "log_dsx", "log_dsy", "dtheta"]
START, TRIAL = ([f"{prefix}_{n}" for n in POSE] for prefix in ("start", "to"))
#: Nodes that are solved at once, about how many of such parts a call of a task gets together, and how far apart linked nodes may stand for the banded solver.
BLOCK, BUNDLE, BAND = 256, 8192, 12
#: Parts of a step that are tried.
STEPS = (1.0, 0.5, 0.25, 0.1, 0.03, 0.01)


def pose(prefix: str = "", names: list[str] = POSE) -> Pose:
    return Pose(*[F.col(f"{prefix}{n}") for n in names])


def neighbours(edges: DataFrame) -> DataFrame:
    """Both directions of each edge: node, other, forward."""
    there = edges.select("*", F.col("from_id").alias("node"), F.col("to_id").alias("other"), F.lit(True).alias("forward"))
    back = edges.select("*", F.col("to_id").alias("node"), F.col("from_id").alias("other"), F.lit(False).alias("forward"))
    return there.unionByName(back)


def propagate(edges: DataFrame, anchors: DataFrame, sign: float = 1.0) -> DataFrame:
    """Poses (node, POSE, hop) of all nodes that anchors reach; the first to reach a node decides.

    Of several in one hop the smallest parent wins, then the smallest edge. Each hop joins the frontier with the
    edges; its result is checkpointed. Nodes that no anchor reaches have no row.
    """
    links = cut(neighbours(edges).select("node", "other", "forward", "edge_id", *STEP))
    known = cut(anchors.select("node", *POSE, F.lit(0).alias("hop")))
    frontier, hop = known, 0
    step = pose(names=STEP)
    while True:
        hop += 1
        ahead, back = predict_forward(pose(), step, sign), predict_inverse(pose(), step, sign)
        guess = [F.when(F.col("forward"), a).otherwise(b).alias(n) for n, a, b in zip(POSE, ahead, back, strict=True)]
        found = frontier.join(links, "node").select("other", F.struct("node", "edge_id").alias("by"), F.struct(*guess).alias("p"))
        found = found.groupBy("other").agg(F.min_by("p", "by").alias("p"))
        found = found.select(F.col("other").alias("node"), "p.*").join(known.select("node"), "node", "left_anti")
        frontier = cut(found.select("node", *POSE, F.lit(hop).alias("hop")))
        if frontier.isEmpty():
            break
        known = cut(known.unionByName(frontier)) if hop % 10 == 0 else known.unionByName(frontier)
    return known


def reachable(edges: DataFrame, anchors: DataFrame) -> DataFrame:
    """(node, hop): hops from the nearest anchor, for all nodes that have one."""
    poses = anchors.select("node", *[F.lit(0.0).alias(n) for n in POSE])
    zero = edges.select("edge_id", "from_id", "to_id", *[F.lit(0.0).alias(n) for n in STEP])
    return propagate(zero, poses).select("node", "hop")


def residuals(edges: DataFrame, poses: DataFrame, cx: float, sign: float = 1.0) -> DataFrame:
    """edges with r0..r4 and their norm; null where a node has no pose."""
    i = poses.select(F.col("node").alias("from_id"), *[F.col(n).alias(f"i_{n}") for n in POSE])
    j = poses.select(F.col("node").alias("to_id"), *[F.col(n).alias(f"j_{n}") for n in POSE])
    rows = edges.join(i, "from_id", "left").join(j, "to_id", "left")
    r = edge_residual(pose("i_"), pose("j_"), pose(names=STEP), F.col("weight"), cx, sign)
    rows = rows.withColumns({f"r{k}": v for k, v in enumerate(r)})
    total = sum((F.col(f"r{k}") ** 2 for k in range(1, 5)), F.col("r0") ** 2)
    return rows.withColumn("residual", F.sqrt(total)).select(*edges.columns, *[f"r{k}" for k in range(5)], "residual")


def residual_stats(rows: DataFrame) -> DataFrame:
    """Count, median, 95th percentile and maximum of residuals by edge type."""
    return quantiles(rows, ["edge_type"], "residual", {"median": 0.5, "p95": 0.95}, {"max": F.max})


def anchor_stress(rows: DataFrame, anchors: DataFrame) -> DataFrame:
    """Mean residual of an anchor's edges over the median of all. What it reads twice is stored in three columns."""
    rows = stored(rows.select("from_id", "to_id", "residual").where("residual is not null"))
    middle = quantiles(rows, [], "residual", {"middle": 0.5}).select("middle")
    ends = neighbours(rows).select("node", "residual")
    mean = ends.join(anchors.select("node"), "node", "left_semi").groupBy("node").agg(F.avg("residual").alias("mean"))
    return mean.crossJoin(F.broadcast(middle)).select("node", F.try_divide("mean", "middle").alias("stress"))  # one row


def frame_quality(edges: DataFrame) -> DataFrame:
    """Per node: whole mean of inliers and mean of the positive rmse of its edges."""
    ends = neighbours(edges.select("from_id", "to_id", "inliers", "rmse"))
    return ends.groupBy("node").agg(
        F.avg("inliers").cast("int").alias("matches"), F.avg(F.when(F.col("rmse") > 0, F.col("rmse"))).alias("rmse")
    )


def disagreement(edges: DataFrame, poses: DataFrame, sign: float = 1.0) -> DataFrame:
    """Per node with at least two predictions by its neighbours: their mean distance from their mean."""
    links = neighbours(edges).select("node", "other", "forward", "edge_id", *STEP)
    rows = links.join(poses, "node")
    step = pose(names=STEP)
    ahead, back = predict_forward(pose(), step, sign), predict_inverse(pose(), step, sign)
    px, py = (F.when(F.col("forward"), a).otherwise(b) for a, b in ((ahead.x, back.x), (ahead.y, back.y)))
    rows = rows.select("other", px.alias("px"), py.alias("py"))
    mean = rows.groupBy("other").agg(F.avg("px").alias("mx"), F.avg("py").alias("my"), F.count(F.lit(1)).alias("n")).where("n >= 2")
    far = F.hypot(F.col("px") - F.col("mx"), F.col("py") - F.col("my"))
    return rows.join(mean, "other").groupBy(F.col("other").alias("node")).agg(F.avg(far).alias("disagreement"), F.max("n").alias("n"))


def cluster_support(pairs: DataFrame, window: int = 3) -> DataFrame:
    """pairs (i, j) with factor: 1 if another pair is near (either way round) within twice the window, else 0.5.

    Pairs meet in cells of that width, never all with all; the near ones are only looked for, not listed.
    """
    reach = 2 * window
    base = pairs.withColumn("__id", F.monotonically_increasing_id())
    both = base.select("__id", "i", "j").unionByName(base.select("__id", F.col("j").alias("i"), F.col("i").alias("j")))
    cell = lambda c: F.floor(F.col(c) / reach).cast("long")
    there = both.select(F.col("__id").alias("o"), F.col("i").alias("oi"), F.col("j").alias("oj"), cell("i").alias("ci"), cell("j").alias("cj"))
    around = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)])
    asked = base.select("__id", "i", "j", F.explode(around).alias("d"))
    asked = asked.select("__id", "i", "j", (cell("i") + F.col("d.a")).alias("ci"), (cell("j") + F.col("d.b")).alias("cj"))
    near = F.abs(F.col("i") - F.col("oi")) + F.abs(F.col("j") - F.col("oj")) <= reach
    same = (asked["ci"] == there["ci"]) & (asked["cj"] == there["cj"]) & (F.col("__id") != F.col("o")) & near
    supported = asked.join(there, same, "left_semi").select("__id").distinct().withColumn("factor", F.lit(1.0))
    return base.join(supported, "__id", "left").withColumn("factor", F.coalesce("factor", F.lit(0.5))).drop("__id")


def gap_downweight(edges: DataFrame, gaps: DataFrame, factor: float = 0.05) -> DataFrame:
    """Temporal edges that lie inside a flagged gap (lo, hi) lose weight. Gaps do not overlap, but may touch."""
    rows = edges.select(F.lit(None).cast("long").alias("lo"), F.lit(None).cast("long").alias("hi"), F.least("from_id", "to_id").alias("at"), F.lit(1).alias("k"), F.struct("*").alias("e"))
    marks = gaps.select("lo", "hi", F.col("lo").alias("at"), F.lit(0).alias("k"), F.lit(None).alias("e"))
    # The last gap that starts at or before an edge is found inside buckets; a gap stands in each that it meets.
    width = 4096
    rows = rows.withColumn("b", F.floor(F.col("at") / width))
    marks = marks.withColumn("b", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor(F.col("hi") / width))))
    marks = marks.withColumn("at", F.greatest("at", F.col("b") * width))
    w = W.partitionBy("b").orderBy("at", "k").rowsBetween(W.unboundedPreceding, 0)
    found = rows.unionByName(marks).withColumn("hi", F.last("hi", True).over(w)).where("k = 1")
    inside = (F.col("e.edge_type") == "temporal") & F.coalesce(F.greatest("e.from_id", "e.to_id") <= F.col("hi"), F.lit(False))
    return found.select("e.*", inside.alias("__in")).withColumn("weight", F.col("weight") * F.when(F.col("__in"), factor).otherwise(1.0)).drop("__in")


def _forest(candidates: DataFrame) -> DataFrame:
    """edge_id of a spanning forest of candidates (edge_id, a, b, keep) with the smallest sum of ranks by keep.

    Each component takes its first edge, those that are joined so are contracted, and so on: log(n) rounds.
    """
    kept = candidates.select("edge_id").limit(0)
    while True:
        edge = F.struct("keep", "edge_id", "a", "b")
        ends = candidates.select(F.col("a").alias("node"), edge.alias("e")).unionByName(candidates.select(F.col("b").alias("node"), edge.alias("e")))
        best = cut(ends.groupBy("node").agg(F.min("e").alias("e")).select("e.*").distinct())
        if best.isEmpty():
            return kept
        kept = kept.unionByName(best.select("edge_id"))
        candidates = cut(_contracted(candidates, components(best.select(F.col("a").alias("u"), F.col("b").alias("v")))))


def _contracted(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """rows with a and b replaced by their roots (node, root), without those that are loops then."""
    for side in ("a", "b"):
        rows = rows.join(roots.select(F.col("node").alias(side), "root"), side, "left")
        rows = rows.withColumn(side, F.coalesce("root", side)).drop("root")
    return rows.where("a <> b")


def prune(rows: DataFrame, anchors: DataFrame, k: float = 5.0, most: float = 0.2, least: int = 3) -> DataFrame:
    """Edges with pruned: bad spatial ones whose removal cuts no node off the anchors.

    Bad are residuals above median + k * 1.4826 * MAD, the worst first, at most the share `most` of all spatial edges
    with a residual; with fewer than `least` of these none is. Taken worst first, an edge stays if without it a node that anchors
    reach would lose them. That is what a spanning forest leaves out: the parts that good edges and anchors hold
    together are contracted, and of the bad edges between parts the least bad that join them stay.
    What is read several times is stored once.
    """
    rows, anchors = stored(rows), stored(anchors.select("node"))
    known = cut(rows.where("edge_type = 'spatial' and residual is not null").select("edge_id", "residual"))
    middle = quantiles(known, [], "residual", {"m": 0.5}).first()
    bad = rows.select("edge_id").limit(0)
    if middle and middle["n"] >= least:
        spread = quantiles(known.select(F.abs(F.col("residual") - middle["m"]).alias("d")), [], "d", {"d": 0.5}).first()["d"]
        bad = known.where(F.col("residual") > middle["m"] + k * 1.4826 * spread).withColumn("worst", -F.col("residual"))
        bad = ranked(bad, [], ["worst", "edge_id"]).where(F.col("place") < int(middle["n"] * most)).select("edge_id")
    bad = cut(bad.withColumn("bad", F.lit(True)))
    marked = rows.join(bad, "edge_id", "left").withColumn("bad", F.coalesce("bad", F.lit(False)))
    first = anchors.agg(F.min("node").cast("long")).first()[0]
    # All anchors are one part.
    held = anchors.select(F.lit(first).cast("long").alias("u"), F.col("node").cast("long").alias("v"))
    ends = marked.select("edge_id", F.col("from_id").cast("long").alias("a"), F.col("to_id").cast("long").alias("b"), "residual", "bad")
    parts = components(held.unionByName(ends.where("not bad").select(F.col("a").alias("u"), F.col("b").alias("v"))))
    loose = cut(_contracted(ends.where("bad"), parts))
    kept = _forest(loose.select("edge_id", "a", "b", F.struct(F.col("residual"), -F.col("edge_id")).alias("keep")))
    # What no anchor reaches at all need not be kept. Bad edges join parts, so the parts that anchors reach follow from these edges alone.
    joined = components(loose.select(F.col("a").alias("u"), F.col("b").alias("v")))
    home = _root(joined, _root(parts, first))
    reached = loose.select("edge_id", F.col("a").alias("node")).join(joined.where(F.col("root") == F.lit(home).cast("long")), "node").select("edge_id")
    held_back = kept.join(reached, "edge_id", "left_semi").withColumn("kept", F.lit(True))
    out = marked.join(held_back, "edge_id", "left")
    return out.select(*rows.columns, (F.col("bad") & F.col("kept").isNull()).alias("pruned"))


def _root(roots: DataFrame, node: int | None) -> int | None:
    """The root of a node, which is the node itself where no edge has it; null for none."""
    found = None if node is None else roots.where(F.col("node") == node).select("root").first()
    return found[0] if found else node


def odometry_factors(
    rows: DataFrame, poses: DataFrame, steps: Column, per_step: float, width: float, height: float,
    margin: float = 1.5, drift: float = 0.25, factor: float = 0.3, sign: float = 1.0,
) -> DataFrame:
    """edges with factor: low where the edge leads further from the pose that the chain gives its end than is allowed.

    Allowed is `margin` times the frame's diagonal at the start's scale, and `drift` of the usual way for each step of the chain.
    An edge without both poses keeps its weight.
    """
    i = poses.select(F.col("node").alias("from_id"), *[F.col(n).alias(f"i_{n}") for n in POSE])
    j = poses.select(F.col("node").alias("to_id"), F.col("x").alias("j_x"), F.col("y").alias("j_y"))
    both = rows.join(i, "from_id", "left").join(j, "to_id", "left")
    ahead = predict_forward(pose("i_"), pose(names=STEP), sign)
    off = F.sqrt((ahead.x - F.col("j_x")) ** 2 + (ahead.y - F.col("j_y")) ** 2)
    allowed = F.exp("i_log_sx") * math.hypot(width, height) * margin + F.abs(steps) * (per_step * drift)
    return both.select(*rows.columns, F.when(off > allowed, factor).otherwise(1.0).alias("factor"))


def usual_step(poses: DataFrame, group: str, at: str, most: int = 3) -> float:
    """Median way per slot between neighbouring poses that are no more than `most` slots apart; 0 without any."""
    w = W.partitionBy(group).orderBy(at)
    slots = F.col(at) - F.lag(at).over(w)
    way = F.sqrt((F.col("x") - F.lag("x").over(w)) ** 2 + (F.col("y") - F.lag("y").over(w)) ** 2) / F.greatest(slots, F.lit(1))
    ways = poses.select(way.alias("way"), slots.alias("slots")).where(F.col("slots") <= most)
    middle = quantiles(ways, [], "way", {"m": 0.5}).first()
    return middle["m"] if middle else 0.0


def chain_gaps(edges: DataFrame, anchors: DataFrame, tolerance: float) -> DataFrame:
    """Per pair of neighbouring anchors of a track: ok, inconsistent or broken.

    Steps (track_id, seq, dx, dy; null if the edge is missing) between the anchors are summed; the sum must agree
    with the anchors' distance to the tolerance.
    """
    w = W.partitionBy("track_id").orderBy("seq")
    marks = anchors.select("track_id", "seq", "x", "y")
    ends = marks.withColumns({"to": F.lead("seq").over(w), "tx": F.lead("x").over(w), "ty": F.lead("y").over(w)}).where("to is not null")
    rows = edges.select("track_id", "seq", "dx", "dy", F.lit(None).cast("long").alias("a")).unionByName(
        marks.select("track_id", "seq", F.lit(None).cast("double").alias("dx"), F.lit(None).cast("double").alias("dy"), F.col("seq").cast("long").alias("a"))
    )
    # A step belongs to the anchor before it; the step that leads to an anchor comes before that anchor.
    order = W.partitionBy("track_id").orderBy("seq", F.col("a").isNotNull()).rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("gap", F.last("a", True).over(order)).where("a is null and gap is not null")
    sums = rows.groupBy("track_id", F.col("gap").alias("seq")).agg(
        F.count("dx").alias("steps"), F.sum("dx").alias("sx"), F.sum("dy").alias("sy")
    )
    found = ends.join(sums, ["track_id", "seq"], "left")
    off = F.hypot(F.col("tx") - F.col("x") - F.col("sx"), F.col("ty") - F.col("y") - F.col("sy"))
    state = F.when(F.coalesce("steps", F.lit(0)) < F.col("to") - F.col("seq"), "broken").when(off > tolerance, "inconsistent").otherwise("ok")
    return found.select("track_id", "seq", "to", F.coalesce("steps", F.lit(0)).alias("steps"), state.alias("state"))


def _turned(a: np.ndarray, sign: float) -> tuple[np.ndarray, ...]:
    return np.exp(-a[:, 2]), np.exp(-a[:, 3]), np.exp(a[:, 3] - a[:, 2]), np.cos(a[:, 4]), sign * np.sin(a[:, 4])


def _edge_rows(a: np.ndarray, b: np.ndarray, e: np.ndarray, sign: float) -> np.ndarray:
    """Rows (edges, 5) of steps e from poses a to poses b, not scaled yet."""
    ux, uy, ratio, c, s = _turned(a, sign)
    turn = b[:, 4] - a[:, 4] - sign * e[:, 4]
    return np.stack(
        [
            (b[:, 0] - a[:, 0]) * ux - c * e[:, 0] + s * ratio * e[:, 1],
            (b[:, 1] - a[:, 1]) * uy - sign * s / ratio * e[:, 0] - sign * c * e[:, 1],
            b[:, 2] - a[:, 2] - e[:, 2],
            b[:, 3] - a[:, 3] - e[:, 3],
            np.arctan2(np.sin(turn), np.cos(turn)),
        ],
        1,
    )


def _edge_slopes(a: np.ndarray, b: np.ndarray, e: np.ndarray, sign: float) -> tuple[np.ndarray, np.ndarray]:
    """Derivatives of the rows of each edge by the pose of its start and of its end."""
    ux, uy, ratio, c, s = _turned(a, sign)
    by_a, by_b = np.zeros((2, len(e), 5, 5))
    by_a[:, 0, 0], by_b[:, 0, 0], by_a[:, 1, 1], by_b[:, 1, 1] = -ux, ux, -uy, uy
    by_a[:, 0, 3] = s * ratio * e[:, 1]
    by_a[:, 0, 2] = -(b[:, 0] - a[:, 0]) * ux - by_a[:, 0, 3]
    by_a[:, 0, 4] = sign * s * e[:, 0] + sign * c * ratio * e[:, 1]
    by_a[:, 1, 2] = -sign * s / ratio * e[:, 0]
    by_a[:, 1, 3] = -(b[:, 1] - a[:, 1]) * uy - by_a[:, 1, 2]
    by_a[:, 1, 4] = -c / ratio * e[:, 0] + s * e[:, 1]
    for k in (2, 3, 4):
        by_a[:, k, k], by_b[:, k, k] = -1.0, 1.0
    return by_a, by_b


def solve_component(nodes: pd.DataFrame, edges: pd.DataFrame, cx: float, sign: float = 1.0, anchor_weight: float = 100.0, rounds: int = 20, robust: float | None = None) -> pd.DataFrame:
    """Damped least squares of one component; robust: scale of Geman-McClure weights. Returns poses and cost.

    Where nodes say so (is_free) the others keep their poses; anchors are drawn to where nodes have them (START).
    """
    at = {n: i for i, n in enumerate(nodes["node"])}
    p = nodes[POSE].to_numpy(float)
    fixed = nodes["is_anchor"].to_numpy(bool)
    free = nodes["is_free"].to_numpy(bool) if "is_free" in nodes else np.ones(len(nodes), bool)
    start = nodes[START].to_numpy(float) if START[0] in nodes else p.copy()
    i, j = (edges[c].map(at).to_numpy(int) for c in ("from_id", "to_id"))
    e, base = edges[STEP].to_numpy(float), edges["weight"].to_numpy(float)
    scale = np.array([1.0, 1.0, cx, cx, cx])
    pull = np.where(fixed[:, None], (scale * anchor_weight) ** 2, 0.0)

    def edge_rows(p):
        return _edge_rows(p[i], p[j], e, sign) * scale

    def slopes(p):
        return [x * scale[:, None] for x in _edge_slopes(p[i], p[j], e, sign)]

    def cost(p, weight):
        return ((edge_rows(p) * weight[:, None]) ** 2).sum() + (pull * (p - start) ** 2).sum()

    n, weight, damp = len(p), base.copy(), 1e-3
    for _ in range(rounds if free.any() else 0):
        r = edge_rows(p)
        if robust:
            weight = base * (robust**2 / (robust**2 + (r**2).sum(1)))
        w2, sides = (weight**2)[:, None, None], list(zip((i, j), slopes(p), strict=True))
        normal, right = np.zeros((n, n, 5, 5)), pull * (p - start)
        normal[np.arange(n), np.arange(n)] += pull[:, :, None] * np.eye(5)
        for u, x in sides:
            np.add.at(right, u, (w2 * x * r[:, :, None]).sum(1))
            for v, y in sides:
                np.add.at(normal, (u, v), w2 * np.einsum("eki,ekj->eij", x, y))
        k = np.flatnonzero(np.repeat(free, 5))
        normal, right = normal.transpose(0, 2, 1, 3).reshape(5 * n, 5 * n)[np.ix_(k, k)], right.ravel()[k]
        before = cost(p, weight)
        for _ in range(8):
            trial = p.copy().ravel()
            trial[k] -= np.linalg.solve(normal + damp * np.diag(np.diag(normal) + 1e-9), right)
            after = cost(trial.reshape(-1, 5), weight)
            if after <= before:
                gain, p, damp = before - after, trial.reshape(-1, 5), damp / 3
                break
            damp *= 4
        else:
            break
        if gain < 1e-9 * (1 + before):
            break
    out = nodes[["component", "node"]].copy()
    out[POSE] = p
    return out.assign(cost=float(cost(p, weight)))[free]


def _banded(blocks: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Solutions (parts, nodes, 5) of symmetric systems of 5 x 5 blocks, all parts together, a node at a time.

    blocks (parts, nodes, band + 1, 5, 5): at [:, c, k] the block of row c + k and column c. right: (parts, nodes, 5).
    """
    parts, n, wide = blocks.shape[:3]
    q, front = 5 * wide, np.zeros((parts, 5 * wide, 5 * wide))
    held = np.zeros((parts, n + wide, 5))
    held[:, :n] = right
    ways = np.zeros((n, parts, 5, q - 5))
    for c in range(n):
        for k in range(wide):
            rows = slice(5 * k, 5 * k + 5)
            front[:, rows, :5] += blocks[:, c, k]
            if k:
                front[:, :5, rows] += blocks[:, c, k].transpose(0, 2, 1)
        below = front[:, 5:, :5]
        got = np.linalg.solve(front[:, :5, :5], np.concatenate([front[:, :5, 5:], held[:, c, :, None]], 2))
        ways[c], held[:, c] = got[:, :, :-1], got[:, :, -1]
        if q > 5:
            held[:, c + 1 : c + wide] -= (below @ held[:, c, :, None]).reshape(parts, wide - 1, 5)
            rest = front[:, 5:, 5:] - below @ ways[c]
            front = np.zeros_like(front)
            front[:, : q - 5, : q - 5] = rest
        else:
            front = np.zeros_like(front)
    for c in range(n - 1, -1, -1) if q > 5 else ():
        held[:, c] -= (ways[c] @ held[:, c + 1 : c + wide].reshape(parts, q - 5, 1))[:, :, 0]
    return held[:, :n]


def solve_parts(nodes: pd.DataFrame, edges: pd.DataFrame, cx: float, sign: float = 1.0, anchor_weight: float = 100.0, rounds: int = 20, robust: float | None = None) -> pd.DataFrame:
    """solve_component for many parts (column `part`) together, each with its own damping and its own end.

    Parts whose linked nodes stand near each other in the order of the ids take their steps together by a banded solver; others are solved
    one by one. nodes: part, component, node, POSE, START, is_anchor, is_free; edges: part, edge_id, from_id, to_id, STEP, weight.
    """
    nodes = nodes.sort_values(["part", "node"]).reset_index(drop=True)
    edges = edges.sort_values(["part", "edge_id"]).reset_index(drop=True)
    part, free = nodes["part"].to_numpy(), nodes["is_free"].to_numpy(bool)
    ids = np.unique(nodes["node"].to_numpy())
    key = part.astype(np.int64) * len(ids) + np.searchsorted(ids, nodes["node"].to_numpy())
    of = edges["part"].to_numpy()
    i, j = (np.searchsorted(key, of.astype(np.int64) * len(ids) + np.searchsorted(ids, edges[c].to_numpy())) for c in ("from_id", "to_id"))
    count = int(part.max()) + 1
    size = np.bincount(part[free], minlength=count)
    place = np.where(free, np.cumsum(free) - 1 - np.repeat(np.r_[0, np.cumsum(size)[:-1]], np.bincount(part, minlength=count)), -1)
    apart = np.zeros(count, int)
    both = free[i] & free[j]
    np.maximum.at(apart, of[both], np.abs(place[i] - place[j])[both])
    out = []
    for wide in np.flatnonzero(apart > BAND):
        out.append(solve_component(nodes[part == wide].reset_index(drop=True), edges[of == wide].reset_index(drop=True), cx, sign, anchor_weight, rounds, robust))
    # Parts of about one size go together, so that little is padded.
    order = np.flatnonzero(apart <= BAND)
    order = order[np.argsort(size[order], kind="stable")]
    step = max(1, BUNDLE // max(1, int(size.max())))
    for a in range(0, len(order), step):
        some = np.zeros(count, int) - 1
        some[order[a : a + step]] = np.arange(len(order[a : a + step]))
        at, link = np.flatnonzero(some[part] >= 0), np.flatnonzero(some[of] >= 0)
        local = np.zeros(len(part), int)
        local[at] = np.arange(len(at))
        got, cost = _solve_together(
            nodes.iloc[at], edges.iloc[link], some[part[at]], place[at], some[of[link]], local[i[link]], local[j[link]], cx, sign, anchor_weight, rounds, robust
        )
        found = nodes.iloc[at][["component", "node"]].copy()
        found[POSE] = got
        out.append(found.assign(cost=cost[some[part[at]]])[free[at]])
    return pd.concat(out)


def _solve_together(nodes, edges, part, place, of, i, j, cx, sign, anchor_weight, rounds, robust) -> tuple[np.ndarray, np.ndarray]:
    """Poses of all nodes and cost of each part; the steps of solve_component, in all parts that go on."""
    p, start, e = nodes[POSE].to_numpy(float), nodes[START].to_numpy(float), edges[STEP].to_numpy(float)
    base, free = edges["weight"].to_numpy(float), place >= 0
    parts, n = int(part.max()) + 1, int(place.max(initial=-1)) + 1
    scale = np.array([1.0, 1.0, cx, cx, cx])
    pull = np.where(nodes["is_anchor"].to_numpy(bool)[:, None], (scale * anchor_weight) ** 2, 0.0)
    wide = int(np.abs(place[i] - place[j])[free[i] & free[j]].max(initial=0)) + 1

    def rows(p):
        return _edge_rows(p[i], p[j], e, sign) * scale

    def cost(p, r, weight):
        return np.bincount(of, (r**2).sum(1) * weight**2, parts) + np.bincount(part, (pull * (p - start) ** 2).sum(1), parts)

    def system(p, r, weight, on):
        """Blocks and right sides of the parts `on` (their numbers in turn)."""
        number = np.full(parts, -1)
        number[on] = np.arange(len(on))
        take = np.flatnonzero(number[of] >= 0)
        w, home, u, v = weight[take, None], number[of[take]], i[take], j[take]
        slopes = np.concatenate(_edge_slopes(p[u], p[v], e[take], sign), 2) * (scale * w)[:, :, None]
        across = slopes.transpose(0, 2, 1)
        square, drawn = across @ slopes, (across @ (r[take] * w)[:, :, None])[:, :, 0]
        own = np.flatnonzero(free & (number[part] >= 0))
        spot = number[part] * n + place
        right = np.zeros((len(on) * n, 5))
        right[spot[own]] = pull[own] * (p - start)[own]
        off = square[:, :5, 5:]
        turned, loop = place[u] < place[v], u == v
        off = np.where(turned[:, None, None], off.transpose(0, 2, 1), off)
        off[loop] += off[loop].transpose(0, 2, 1)
        at, value = [], []
        for x, mine, part_of in ((u, square[:, :5, :5], drawn[:, :5]), (v, square[:, 5:, 5:], drawn[:, 5:])):
            m = free[x]
            at.append((home * n + place[x])[m] * wide)
            value.append(mine[m].reshape(-1, 25))
            for k in range(5):
                right[:, k] += np.bincount((home * n + place[x])[m], part_of[m, k], len(right))
        m = free[u] & free[v]
        at.append(((home * n + np.minimum(place[u], place[v])) * wide + np.abs(place[u] - place[v]))[m])
        value.append(off[m].reshape(-1, 25))
        at, value = np.concatenate(at), np.concatenate(value)
        turn = np.argsort(at, kind="stable")
        spots, first = np.unique(at[turn], return_index=True)
        blocks = np.zeros((len(on) * n * wide, 25))
        if len(spots):
            blocks[spots] = np.add.reduceat(value[turn], first, axis=0)
        blocks, right = blocks.reshape(len(on), n, wide, 5, 5), right.reshape(len(on), n, 5)
        blocks[number[part[own]], place[own], 0] += pull[own][:, :, None] * np.eye(5)
        return blocks, right, own

    damp, weight, on = np.full(parts, 1e-3), base.copy(), np.arange(parts)
    for _ in range(rounds if free.any() else 0):
        r = rows(p)
        if robust:
            live = np.zeros(parts, bool)
            live[on] = True
            weight = np.where(live[of], base * (robust**2 / (robust**2 + (r**2).sum(1))), weight)
        blocks, right, own = system(p, r, weight, on)
        before = cost(p, r, weight)
        number = np.full(parts, -1)
        number[on] = np.arange(len(on))
        gain, waits = np.full(parts, -1.0), np.arange(len(on))
        for _ in range(8):
            damped = blocks[waits]
            for k in range(5):
                damped[:, :, 0, k, k] += damp[on[waits], None] * (damped[:, :, 0, k, k] + 1e-9)
            # Behind the last node of a shorter part the system is that of nothing.
            empty = np.ones((len(waits), n), bool)
            slot = np.full(len(on), -1)
            slot[waits] = np.arange(len(waits))
            mine = own[slot[number[part[own]]] >= 0]
            home = slot[number[part[mine]]]
            empty[home, place[mine]] = False
            damped[:, :, 0][empty] = np.eye(5)
            trial = p.copy()
            trial[mine] -= _banded(damped, right[waits])[home, place[mine]]
            after = cost(trial, rows(trial), weight)
            good = on[waits][after[on[waits]] <= before[on[waits]]]
            took = np.isin(part[mine], good)
            p = p.copy()
            p[mine[took]] = trial[mine[took]]
            gain[good], damp[good] = (before - after)[good], damp[good] / 3
            waits = waits[~np.isin(on[waits], good)]
            damp[on[waits]] *= 4
            if not len(waits):
                break
        on = on[gain[on] >= 1e-9 * (1 + before[on])]
        if not len(on):
            break
    return p, cost(p, rows(p), weight)


def _costs(nodes: DataFrame, links: DataFrame, cx: float, sign: float, robust: float | None, anchor_weight: float = 100.0) -> DataFrame:
    """Cost of each component at each part (STEPS) of the way from its poses to the trial ones."""
    way = lambda side, t: Pose(*[F.col(f"{side}{n}") + (F.col(f"{side}to_{n}") - F.col(f"{side}{n}")) * t for n in POSE])
    ends = [nodes.select(F.col("node").alias(f"{x}_id"), *[F.col(c).alias(f"{x}_{c}") for c in (*POSE, *TRIAL)]) for x in ("from", "to")]
    rows = links.join(ends[0], "from_id").join(ends[1], "to_id")

    def of_edge(t):
        r2 = sum((r**2 for r in edge_residual(way("from_", t), way("to_", t), pose(names=STEP), F.lit(1.0), cx, sign)), F.lit(0.0))
        return F.col("weight") ** 2 * (r2 * robust**2 / (r2 + robust**2) if robust else r2)

    def of_anchor(t):
        p, wide = way("", t), (1.0, 1.0, cx, cx, cx)
        return sum(((x - F.col(n)) ** 2 * (w * anchor_weight) ** 2 for x, n, w in zip(p, START, wide, strict=True)), F.lit(0.0))

    parts = [[f(t).alias(f"c{k}") for k, t in enumerate((0.0, *STEPS))] for f in (of_edge, of_anchor)]
    both = rows.select("component", *parts[0]).unionByName(nodes.where("is_anchor").select("component", *parts[1]))
    return both.groupBy("component").agg(*[F.sum(f"c{k}").alias(f"c{k}") for k in range(len(STEPS) + 1)])


def solve(nodes: DataFrame, edges: DataFrame, cx: float, sign: float = 1.0, robust: float | None = None, block: int = BLOCK, rounds: int = 200) -> DataFrame:
    """Poses of all nodes and cost of their component (column `component`) by least squares over edges and anchors.

    Anchors are drawn to their poses, or to those of the columns START where nodes have them and the poses are a first guess.

    A component of at most `block` nodes is solved at once. Larger ones are solved in blocks of so many nodes in the order of
    their ids: each block moves its own nodes while those at the other ends of its edges stand still, then all move by
    the part of the way that costs least. Blocks begin half a block further on in every other round. A component is
    done when neither of two rounds gains, or after `rounds` rounds. Components and blocks go in bundles of about BUNDLE nodes, those of a
    bundle take their steps together.
    """
    place = F.row_number().over(W.partitionBy("component").orderBy("node")) - 1
    starts = [F.col(s if s in nodes.columns else n).alias(s) for n, s in zip(POSE, START, strict=True)]
    here = nodes.select("component", "node", *POSE, *starts, "is_anchor", place.alias("place"))
    many = nodes.groupBy("component").agg((F.count(F.lit(1)) > block).alias("many"))
    here, links = cut(here.join(many, "component")), cut(edges.select("component", "edge_id", "from_id", "to_id", *STEP, "weight"))
    result = ["component", "node", *POSE, "cost"]
    schema = "component bigint, node bigint, " + ", ".join(f"{n} double" for n in POSE) + ", cost double"

    def step(own: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
        """All parts (component, block) of a bundle; the other ends of a part's edges stand still."""
        keys = ["component", "block"]
        parts = pd.MultiIndex.from_frame(own[keys]).unique()
        own, links = (rows.assign(part=parts.get_indexer(pd.MultiIndex.from_frame(rows[keys]))) for rows in (own, links))
        far = [
            links[["part", "component", f"{x}_id", *[f"{x}_{n}" for n in POSE]]].set_axis(["part", "component", "node", *POSE], axis=1) for x in ("from", "to")
        ]
        every = pd.concat([own.assign(is_free=True), pd.concat(far).assign(is_free=False, is_anchor=False, **dict.fromkeys(START, 0.0))])
        every = every[["part", "component", "node", *POSE, *START, "is_anchor", "is_free"]].drop_duplicates(["part", "node"])
        return solve_parts(every.astype({"is_anchor": bool, "is_free": bool}), links, cx, sign, robust=robust)

    def moved(here: DataFrame, links: DataFrame, shift: int) -> DataFrame:
        """Nodes with where a round of blocks would take them."""
        here = here.withColumn("block", F.floor((F.col("place") + shift) / block).cast("long"))
        ends = [here.select(F.col("node").alias(f"{x}_id"), F.col("block").alias(f"{x}_block"), *[F.col(n).alias(f"{x}_{n}") for n in POSE]) for x in ("from", "to")]
        links = links.join(ends[0], "from_id").join(ends[1], "to_id")
        links = links.withColumn("block", F.explode(F.array_distinct(F.array("from_block", "to_block"))))
        bundle = F.pmod(F.xxhash64("component", "block"), F.lit(here.count() // BUNDLE + 1)).alias("bundle")
        here, links = here.select("*", bundle), links.select("*", bundle)
        return here.groupBy("bundle").cogroup(links.groupBy("bundle")).applyInPandas(lambda key, a, b: step(a, b) if len(a) else pd.DataFrame(columns=result), schema)

    done = moved(here.where("not many"), links.join(many.where("not many").select("component"), "component"), 0)
    links = cut(links.join(many.where("many").select("component"), "component"))
    here = cut(here.where("many").drop("many").withColumns({"idle": F.lit(0), "cost": F.lit(None).cast("double")}))
    for k in range(rounds):
        open_ = here.where("idle < 2")
        if open_.isEmpty():
            break
        ids = open_.select("component").distinct()
        some = links.join(ids, "component", "left_semi")
        to = moved(open_, some, k % 2 * (block // 2)).select("node", *[F.col(n).alias(t) for n, t in zip(POSE, TRIAL, strict=True)])
        to = cut(open_.drop("cost", "idle").join(to, "node").join(open_.select("node", "idle"), "node"))
        costs = _costs(to, some, cx, sign, robust)
        best = F.array_min(F.array(*[F.struct(F.col(f"c{n}").alias("cost"), F.lit(t).alias("t")) for n, t in enumerate((0.0, *STEPS))]))
        costs = costs.select("component", best.alias("best"), F.col("c0").alias("was"))
        rows = to.join(costs, "component")
        gains = F.col("was") - F.col("best.cost") >= (F.col("was") + 1) * 1e-9
        go = {n: F.col(n) + (F.col(t) - F.col(n)) * F.col("best.t") for n, t in zip(POSE, TRIAL, strict=True)}
        rows = rows.withColumns(go | {"idle": F.when(gains, 0).otherwise(F.col("idle") + 1), "cost": F.col("best.cost")}).select(*here.columns)
        here = cut(here.where("idle >= 2").unionByName(rows))
    return done.select(*result).unionByName(here.select(*result))


def least_gap(width: float, height: float, k: float, displacement: Column) -> Column:
    """How many frames apart loop closures must be: k diagonals in median steps; null for a standing track."""
    return F.when(displacement >= 1e-6, F.ceil(F.lit(k * math.hypot(width, height)) / displacement))


def anchor_checks(nodes: DataFrame, steps: DataFrame, most: float, sign: float = 1.0) -> DataFrame:
    """Anchors (track_id, seq, node) held against the chain from the anchor before and from the one behind.

    nodes: track_id, seq, node, POSE, is_anchor; steps: track_id, seq and the relative pose (STEP) that leads to seq from seq - 1. The
    chain of steps between two anchors is followed from both ends; disagreement is the smaller distance of an
    anchor from where a side puts it, so an anchor that conflicts with both sides stands out and the good neighbour of a bad one does not.
    Adds reachable (a side without a missing step), disagreement and flag (warning above `most`, else normal; null if unreachable).

    Angles and log scales along a leg are running sums, and what the steps add to the position is linear in four sums for each
    leg, so a leg of any length takes the same few jobs. A lone anchor of a track is not reachable.
    """
    rows = nodes.join(steps.select("track_id", "seq", *STEP), ["track_id", "seq"], "left")
    rows = rows.withColumn("anchor", F.when(F.col("is_anchor"), F.col("seq")))
    rows = running(rows, ["track_id"], "seq", lasts={"leg": "anchor"})
    rows = running(rows, ["track_id"], "seq", lasts={"to": "anchor"}, ahead=True, own=True)
    legs = rows.where("leg is not null and to is not null").select("track_id", "seq", "leg", "to", *STEP)
    turn = {"x": "log_dsx", "y": "log_dsy", "t": "dtheta"}
    legs = running(legs, ["track_id", "leg"], "seq", sums={f"f{n}": c for n, c in turn.items()})
    legs = running(legs, ["track_id", "leg"], "seq", sums={f"b{n}": c for n, c in turn.items()}, ahead=True)
    back = predict_inverse(Pose(*[F.lit(0.0)] * 5), pose(names=STEP), 1.0)  # the step the other way
    sides = {"f": (F.col("ft") * sign, F.col("fx"), F.col("fy"), F.col("dx"), F.col("dy")), "b": (-F.col("bt") * sign, -F.col("bx"), -F.col("by"), back.x, back.y)}
    sums = []
    for side, (t, sx, sy, dx, dy) in sides.items():
        terms = {"a": F.cos(t) * F.exp(sx) * dx, "b": F.sin(t) * F.exp(sx) * dx, "c": F.cos(t) * F.exp(sy) * dy, "d": F.sin(t) * F.exp(sy) * dy}
        sums += [F.sum(v).alias(f"{side}_{n}") for n, v in terms.items()]
    legs = legs.groupBy("track_id", "leg", "to").agg(F.count("dx").alias("steps"), *sums).where(F.col("steps") == F.col("to") - F.col("leg"))
    anchors = nodes.where("is_anchor")
    for side, end in (("i", "leg"), ("j", "to")):
        legs = legs.join(anchors.select("track_id", F.col("seq").alias(end), *[F.col(n).alias(f"{side}_{n}") for n in POSE]), ["track_id", end])

    def off(side: str, start: str, end: str) -> Column:
        p, (a, b, c, d) = pose(f"{start}_"), (F.col(f"{side}_{n}") for n in "abcd")
        u, v = F.exp(p.log_sx), F.exp(p.log_sy) * sign
        x = p.x + u * (F.cos(p.theta) * a - F.sin(p.theta) * b) - v * (F.sin(p.theta) * c + F.cos(p.theta) * d)
        y = p.y + u * (F.sin(p.theta) * a + F.cos(p.theta) * b) + v * (F.cos(p.theta) * c - F.sin(p.theta) * d)
        return F.sqrt((x - F.col(f"{end}_x")) ** 2 + (y - F.col(f"{end}_y")) ** 2)

    found = legs.select("track_id", F.col("to").alias("seq"), off("f", "i", "j").alias("off"))
    found = found.unionByName(legs.select("track_id", F.col("leg").alias("seq"), off("b", "j", "i").alias("off")))
    found = found.groupBy("track_id", "seq").agg(F.min("off").alias("disagreement"))
    out = anchors.select("track_id", "seq", "node").join(found, ["track_id", "seq"], "left")
    flag = F.when(F.col("disagreement") > most, "warning").when(F.col("disagreement").isNotNull(), "normal")
    return out.select("track_id", "seq", "node", F.col("disagreement").isNotNull().alias("reachable"), "disagreement", flag.alias("flag"))


def anneal(
    nodes: DataFrame, edges: DataFrame, cx: float, rounds: int | None = None, k: float = 5.0, fall: float = 1.4, sign: float = 1.0, **how
) -> tuple[DataFrame, DataFrame]:
    """Poses (as solve) and edges with factor, after spatial edges were weighed anew in rounds by how far they are off.

    The first solution gives a bound, median + k * 1.4826 * MAD of the residuals of spatial edges by unit of weight. If none lies above, or there are
    fewer than three, all stays as it is (factor 1). Else each round weighs spatial edges by s^2 / (s^2 + r^2), where s is mu
    times the bound, and solves again from the poses it has; mu begins with the largest residual over the bound, falls by `fall` and the round with mu = 1 is
    the last one, or the one of number `rounds` if that is given. Median and MAD come from ranks by ranges. nodes: component, node, POSE, is_anchor; edges: component too.

    As the bound and the largest residual of the first solution settle all rounds, components know nothing of each other after it: those that fit a task (at most
    `block` nodes, or BLOCK if linked nodes stand far apart) are solved once, packed in a row each, and take all rounds in one pass over these rows. Larger ones
    are solved in rounds of jobs.
    """
    robust, here = how.get("robust"), [s if s in nodes.columns else n for n, s in zip(POSE, START, strict=True)]
    most = how.get("block", WHOLE)

    def alone(p, start, anchored, i, j, step, weight):
        part = pd.DataFrame(p, columns=POSE).assign(component=0, node=np.arange(len(p)), is_anchor=anchored, **dict(zip(START, start.T, strict=True)))
        links = pd.DataFrame(step, columns=STEP).assign(from_id=i, to_id=j, weight=weight)
        got = solve_component(part, links, cx, sign, robust=robust)
        return got[POSE].to_numpy(), got["cost"].iloc[0]

    def off(poses: DataFrame, edges: DataFrame) -> DataFrame:
        rows = residuals(edges, poses, cx, sign).where("edge_type = 'spatial' and residual is not null and weight > 1e-12")
        return stored(rows.select("edge_id", (F.col("residual") / F.col("weight")).alias("r")))

    sizes = nodes.where("component is not null").groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    total, largest = sizes.agg(F.sum("n"), F.max("n")).first()
    many = stored(sizes.where(F.col("n") > most).select("component")) if largest and largest > most else None
    few = (lambda rows: rows.join(many, "component", "left_anti")) if many else (lambda rows: rows)
    packed = stored(pack(few(nodes), few(edges), total or 0, POSE, here, STEP, min(most, BLOCK), alone, cx, sign, robust))
    open_ = packed.where("open").select("component")
    if not open_.isEmpty():
        many = many.unionByName(open_) if many else open_
    known = packed.where("not open").select(F.explode("off").alias("r"))
    if many:
        large, links = (rows.join(many, "component", "left_semi") for rows in (nodes, edges))
        large, links = stored(large), stored(links)
        solved = stored(solve(large, links, cx, sign, **how))
        rows = off(solved, links)
        known = known.unionByName(rows.select("r"))
    bounds = _bounds(known, rounds, k, fall)
    flat = stored(unpack(packed.where("not open"), total or 0, POSE, STEP, bounds, alone, cx, sign, robust))
    poses, found = flat.where("not is_edge").select("component", "node", *POSE, "cost"), flat.where("is_edge")
    if set(edges.columns) <= set(found.columns):
        found = found.select(*[F.col(f.name).cast(f.dataType) for f in edges.schema], "factor")
    else:
        found = edges.join(found.select("edge_id", "factor"), "edge_id").select(*edges.columns, "factor")
    if not many:
        return poses, found
    factors, weighed = links.select("edge_id", F.lit(1.0).alias("factor")), links
    for n, s in enumerate(bounds):
        rows = off(solved, weighed) if n else rows
        new = F.when(F.col("r") > 0, F.lit(s * s) / (F.col("r") * F.col("r") + s * s)).otherwise(1.0)
        factors = stored(factors.join(rows.select("edge_id", new.alias("new")), "edge_id", "left").select("edge_id", F.coalesce("new", "factor").alias("factor")))
        weighed = stored(links.join(factors, "edge_id").withColumn("weight", F.col("weight") * F.col("factor")).select(*links.columns))
        starts = large.drop(*POSE, *START).join(solved.select("node", *POSE), "node")
        starts = starts.join(large.select("node", *[F.col(c).alias(s) for c, s in zip(here, START, strict=True)]), "node")
        solved = stored(solve(starts, weighed, cx, sign, **how))
    return poses.unionByName(solved), found.unionByName(links.join(factors, "edge_id").select(*edges.columns, "factor"))


def _bounds(known: DataFrame, rounds: int | None, k: float, fall: float) -> list[float]:
    """mu times the bound, for each round, from residuals r; none if there are fewer than three or no one lies above the bound."""
    middle = quantiles(known, [], "r", {"m": 0.5}, {"most": F.max}).first()
    if not middle or middle["n"] < 3:
        return []
    spread = quantiles(known.select(F.abs(F.col("r") - middle["m"]).alias("d")), [], "d", {"d": 0.5}).first()["d"]
    bound = middle["m"] + k * 1.4826 * spread
    if middle["most"] <= bound * (1 + 1e-9):
        return []
    mu, out = max(1.0, middle["most"] / max(bound, 1e-9)), []
    while not out or mu < last and (rounds is None or len(out) < rounds):
        out.append(mu * bound)
        last, mu = mu, max(1.0, mu / fall)
    return out
