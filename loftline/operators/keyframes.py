"""Keyframes along tracks: overlap of convex quadrilaterals, choice against the last keyframe, edges past bad frames."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.affine import Affine, temporal_edge_reason, to_pose
from ..functions.scores import edge_weight, spread_weight
from .scans import determinant, let

#: Frames that are held against the present keyframe at once.
LOOK = 16
_POINT = "array<struct<x: double, y: double>>"


def _clipped(polygon: Column, side: Column) -> Column:
    """What of a convex polygon lies where a x + b y + c >= 0 (side: a, b, c)."""
    depth = lambda p: side["a"] * p["x"] + side["b"] * p["y"] + side["c"]

    def edge(p: Column, i: Column) -> Column:
        def cut_at(q: Column) -> Column:
            def kept(d: Column) -> Column:
                share = d["p"] / (d["p"] - d["q"])
                point = F.struct((p["x"] + (q["x"] - p["x"]) * share).alias("x"), (p["y"] + (q["y"] - p["y"]) * share).alias("y"))
                own, none = F.array(F.struct(p["x"].alias("x"), p["y"].alias("y"))), F.array().cast(_POINT)
                crossing = F.when(d["p"] * d["q"] < 0, F.array(point)).otherwise(none)
                return F.concat(F.when(d["p"] >= 0, own).otherwise(none), crossing)

            return let(F.struct(depth(p).alias("p"), depth(q).alias("q")), kept)

        return let(F.get(polygon, (i + 1) % F.size(polygon)), cut_at)

    return F.flatten(F.transform(polygon, edge))


def _area(polygon: Column) -> Column:
    def term(p: Column, i: Column) -> Column:
        return let(F.get(polygon, (i + 1) % F.size(polygon)), lambda q: p["x"] * q["y"] - q["x"] * p["y"])

    return F.abs(F.aggregate(F.transform(polygon, term), F.lit(0.0), lambda a, b: a + b)) / 2


def overlap_fraction(h: Column, width: float, height: float) -> Column:
    """Part of a frame that the frame, mapped by the 3 x 3 matrix h (an array of nine), covers; between 0 and 1.

    The image of the frame is clipped at the frame's four sides, one after the other. It is 0 for a null, singular or
    infinite matrix and where a corner lies on or behind the horizon. A mirrored image counts like any other.
    """
    corners = ((0.0, 0.0), (width, 0.0), (width, height), (0.0, height))
    sides = [(1.0, 0.0, 0.0), (-1.0, 0.0, width), (0.0, 1.0, 0.0), (0.0, -1.0, height)]
    rows = F.array(*[F.struct(*[F.lit(float(v)).alias(n) for n, v in zip("abc", s, strict=True)]) for s in sides])

    def of(m: Column) -> Column:
        ahead = [m[6] * x + m[7] * y + m[8] for x, y in corners]
        points = [F.struct(((m[0] * x + m[1] * y + m[2]) / w).alias("x"), ((m[3] * x + m[4] * y + m[5]) / w).alias("y")) for (x, y), w in zip(corners, ahead, strict=True)]
        finite = F.forall(m, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
        sound = finite & (F.abs(determinant(m)) >= 1e-9)
        for w in ahead:
            sound = sound & (w > 1e-12)
        held = lambda: let(F.aggregate(rows, F.array(*points).cast(_POINT), _clipped), _area)
        return F.when(sound, F.least(F.greatest(held() / (width * height), F.lit(0.0)), F.lit(1.0))).otherwise(0.0)

    return F.coalesce(let(h, of), F.lit(0.0))


def overlaps(h: np.ndarray, width: float, height: float) -> np.ndarray:
    """overlap_fraction of n matrices (n, 3, 3) at once."""
    corners = np.array([[0, 0, 1], [width, 0, 1], [width, height, 1], [0, height, 1]], float)
    with np.errstate(all="ignore"):
        image = np.einsum("nij,cj->nci", h, corners)
        sound = np.isfinite(h).all((1, 2)) & (np.abs(np.linalg.det(np.where(np.isfinite(h), h, 0.0))) >= 1e-9) & (image[:, :, 2] > 1e-12).all(1)
        p = np.where(sound[:, None, None], image[:, :, :2] / image[:, :, 2:], 0.0)
    count = np.full(len(h), 4)
    for a, b, c in ((1, 0, 0), (-1, 0, width), (0, 1, 0), (0, -1, height)):
        m = p.shape[1]
        at = np.arange(m)
        live = at < count[:, None]
        after = np.where(at + 1 < count[:, None], at + 1, 0)
        q = np.take_along_axis(p, after[:, :, None], 1)
        dp, dq = p @ (a, b) + c, q @ (a, b) + c
        crossing = live & (dp * dq < 0)
        with np.errstate(all="ignore"):
            point = p + (q - p) * np.where(crossing, dp / (dp - dq), 0.0)[:, :, None]
        both = np.stack([p, point], 2).reshape(len(h), 2 * m, 2)
        keep = np.stack([live & (dp >= 0), crossing], 2).reshape(len(h), 2 * m)
        count = keep.sum(1)
        order = np.argsort(~keep, axis=1, kind="stable")[:, : max(count.max(initial=0), 1)]
        p = np.take_along_axis(both, order[:, :, None], 1)
    at = np.arange(p.shape[1])
    after = np.where(at + 1 < count[:, None], at + 1, 0)
    q = np.take_along_axis(p, after[:, :, None], 1)
    area = np.abs(np.where(at < count[:, None], p[:, :, 0] * q[:, :, 1] - q[:, :, 0] * p[:, :, 1], 0.0).sum(1)) / 2
    return np.where(sound, np.clip(area / (width * height), 0.0, 1.0), 0.0)


def select_keyframes(
    frames: DataFrame, width: float, height: float, most: float = 0.5, gap: int = 0, first: bool = True, look: int = LOOK
) -> DataFrame:
    """frames (track_id, seq, step, pose and others) with is_keyframe, held against the last keyframe of the track.

    A frame becomes a keyframe where its overlap with the last one is at most `most`, where its step is null (it could not
    be matched), where there is none yet or the last one's pose is singular, and after `gap` frames without one (0: never
    for that). The first frame of a track is one if `first` says so. Frames of a track come one after the other in a partition;
    all tracks of a batch go on in step, each by up to `look` frames at once, and the last track's state goes to the next
    batch, so a track may have any length. Null poses count as no overlap.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: tuple | None = None  # track, pose of the last keyframe or None, frames since
        for rows in batches:
            if not len(rows):
                continue
            ids = rows["track_id"].to_numpy()
            starts = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
            ends = np.r_[starts[1:], len(ids)]
            lost = rows["step"].isna().to_numpy()
            nothing = np.full(9, np.nan)
            pose = np.stack([nothing if p is None else np.asarray(p, float) for p in rows["pose"]]).reshape(-1, 3, 3)
            key = np.zeros(len(ids), bool)
            at, since = starts.copy(), np.zeros(len(starts), int)
            has, last = np.zeros(len(starts), bool), np.zeros((len(starts), 3, 3))
            fresh = np.ones(len(starts), bool)
            if held is not None and held[0] == ids[0]:
                fresh[0], has[0], since[0] = False, held[1] is not None, held[2]
                last[0] = held[1] if held[1] is not None else 0.0
            new = starts[fresh]
            key[new], has[fresh], last[fresh] = first, first, pose[new]
            since[fresh] += not first
            at[fresh] += 1
            while len(on := np.flatnonzero(at < ends)):
                i = at[on][:, None] + np.arange(look)
                there = i < ends[on][:, None]
                i = np.minimum(i, len(ids) - 1)
                singular = ~has[on] | ~(np.abs(np.linalg.det(np.nan_to_num(last[on]))) > 0)
                back = np.linalg.inv(np.where(singular[:, None, None], np.eye(3), np.nan_to_num(last[on])))
                rel = (back[:, None] @ pose[i]).reshape(-1, 3, 3)
                hit = overlaps(rel, width, height).reshape(i.shape) <= most
                hit |= lost[i] | singular[:, None]
                if gap > 0:
                    hit |= since[on][:, None] + np.arange(look) >= gap
                hit &= there
                found, place = hit.any(1), hit.argmax(1)
                chosen = i[np.arange(len(on)), place]
                key[chosen[found]] = True
                last[on[found]], has[on[found]] = pose[chosen[found]], True
                since[on] = np.where(found, 0, since[on] + there.sum(1))
                at[on] = np.where(found, chosen + 1, at[on] + there.sum(1))
            held = (ids[-1], last[-1].copy() if has[-1] else None, int(since[-1]))
            yield rows.assign(is_keyframe=key)

    schema = frames.withColumn("is_keyframe", F.lit(True)).schema
    return frames.repartition("track_id").sortWithinPartitions("track_id", "seq").mapInPandas(run, schema)


class Match(NamedTuple):
    """What matching a frame with an earlier one gave: Columns; m is null where they could not be matched."""

    m: Affine
    inliers: Column
    rmse: Column
    spread: Column


def edge_of(m: Affine, width: float, height: float) -> dict[str, Column]:
    """The relative pose of an edge from the matrix between its frames: how far the centre moves, log scales, angle."""
    cx, cy = width / 2, height / 2
    p = to_pose(m, cx, cy)
    return {"dx": p.x - cx, "dy": p.y - cy, "log_dsx": p.log_sx, "log_dsy": p.log_sy, "dtheta": p.theta}


def bridge_edges(frames: DataFrame, match, most: int, width: float, height: float, base: float = 1.0, shift: float = 1.2) -> DataFrame:
    """frames (track_id, seq, node, ...) with the temporal edge that leads to each, from the nearest of `most` predecessors that passes.

    match(before) gives the Match of a row with an earlier one, whose columns before(name) has. A predecessor passes where the two
    could be matched and the edge is sane (turn, scales and shift for their distance). Adds from_id, depth (1: the frame before), gated (how many
    nearer ones were matched but not sane), the relative pose, inliers, rmse and weight; all null, gated but for, where none passes. A
    track's first frame has no predecessor. One window by track serves all predecessors.
    """
    w = W.partitionBy("track_id").orderBy("seq")
    tries, gated = [], []
    for k in range(1, most + 1):
        before = lambda c, k=k: F.lag(c, k).over(w)
        got = match(before)
        there = before("node").isNotNull() & got.m.a.isNotNull()
        sane = temporal_edge_reason(got.m, F.col("seq") - before("seq"), width, height, shift=shift).isNull()
        weight = edge_weight(F.lit(base), got.inliers, got.rmse) * spread_weight(got.spread)
        edge = F.struct(
            before("node").alias("from_id"), F.lit(k).alias("depth"), *[v.alias(n) for n, v in edge_of(got.m, width, height).items()],
            got.inliers.cast("int").alias("inliers"), got.rmse.cast("double").alias("rmse"), weight.alias("weight"),
        )
        tries.append(F.when(there & sane, edge))
        gated.append((there & ~sane).cast("int"))
    rows = frames.withColumns({f"__t{k}": t for k, t in enumerate(tries)} | {f"__g{k}": g for k, g in enumerate(gated)})
    nearer, total = F.lit(True), F.lit(0)
    for k in range(most):
        total = total + F.when(nearer, F.coalesce(F.col(f"__g{k}"), F.lit(0))).otherwise(0)
        nearer = nearer & F.col(f"__t{k}").isNull()
    return rows.select(*frames.columns, total.alias("gated"), F.coalesce(*[F.col(f"__t{k}") for k in range(most)]).alias("e")).select(*frames.columns, "gated", "e.*")
