"""Affine matrices as six Columns a, b, tx, c, d, ty (row-major 2x3), homographies as nine, poses of five numbers."""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class Affine(NamedTuple):
    a: Column
    b: Column
    tx: Column
    c: Column
    d: Column
    ty: Column


class Pose(NamedTuple):
    x: Column
    y: Column
    log_sx: Column
    log_sy: Column
    theta: Column


def det(m: Affine) -> Column:
    return m.a * m.d - m.b * m.c


def isotropic_scale(m: Affine) -> Column:
    return F.sqrt(F.abs(det(m)))


def scales(m: Affine) -> tuple[Column, Column]:
    """Norms of the two basis vectors."""
    return F.sqrt(m.a * m.a + m.c * m.c), F.sqrt(m.b * m.b + m.d * m.d)


def angle(m: Affine) -> Column:
    return F.atan2(m.c, m.a)


def mean_scale(m: Affine) -> Column:
    sx, sy = scales(m)
    return F.greatest((sx + sy) * 0.5, F.lit(1e-9))


def compose(tx: Column, ty: Column, sx: Column, sy: Column, theta: Column, sign: Column | float = 1.0) -> Affine:
    """sign -1 mirrors the y axis."""
    s = F.lit(sign) if isinstance(sign, (int, float)) else sign
    return Affine(F.cos(theta) * sx, -F.sin(theta) * s * sy, tx, F.sin(theta) * sx, F.cos(theta) * s * sy, ty)


def apply(m: Affine, x: Column, y: Column) -> tuple[Column, Column]:
    return m.a * x + m.b * y + m.tx, m.c * x + m.d * y + m.ty


def apply_homography(h: list[Column], x: Column, y: Column) -> tuple[Column, Column]:
    w = h[6] * x + h[7] * y + h[8]
    return F.try_divide(h[0] * x + h[1] * y + h[2], w), F.try_divide(h[3] * x + h[4] * y + h[5], w)


def to_pose(m: Affine, cx: float, cy: float) -> Pose:
    """Image of the frame's centre, log scales (not below 1e-9) and angle."""
    x, y = apply(m, F.lit(cx), F.lit(cy))
    sx, sy = scales(m)
    floor = F.lit(1e-9)
    return Pose(x, y, F.log(F.greatest(sx, floor)), F.log(F.greatest(sy, floor)), angle(m))


def from_pose(p: Pose, cx: float, cy: float, sign: float = 1.0) -> Affine:
    def clip(log_scale: Column) -> Column:
        return F.greatest(F.lit(1e-6), F.least(F.lit(1e6), F.exp(log_scale)))

    m = compose(F.lit(0.0), F.lit(0.0), clip(p.log_sx), clip(p.log_sy), p.theta, sign)
    x, y = apply(m, F.lit(cx), F.lit(cy))
    return m._replace(tx=p.x - x, ty=p.y - y)


def moved(p: Pose, dx: Column, dy: Column, sign: float) -> tuple[Column, Column]:
    """Where a step (dx, dy) in the frame of p leads."""
    sx, sy, c, s = F.exp(p.log_sx), F.exp(p.log_sy), F.cos(p.theta), F.sin(p.theta)
    return p.x + c * sx * dx - s * sy * dy * sign, p.y + s * sx * dx + c * sy * dy * sign


def predict_forward(p: Pose, edge: Pose, sign: float) -> Pose:
    """Pose of an edge's end from that of its start; the edge is a relative pose."""
    x, y = moved(p, edge.x, edge.y, sign)
    return Pose(x, y, p.log_sx + edge.log_sx, p.log_sy + edge.log_sy, p.theta + edge.theta * sign)


def predict_inverse(p: Pose, edge: Pose, sign: float) -> Pose:
    """Pose of an edge's start from that of its end."""
    ix, iy, c, s = F.exp(-edge.log_sx), F.exp(-edge.log_sy), F.cos(edge.theta), F.sin(edge.theta)
    x, y = moved(p, -ix * (c * edge.x + s * edge.y), iy * (s * edge.x - c * edge.y), sign)
    return Pose(x, y, p.log_sx - edge.log_sx, p.log_sy - edge.log_sy, p.theta - edge.theta * sign)


def edge_residual(i: Pose, j: Pose, edge: Pose, weight: Column, cx: float, sign: float) -> list[Column]:
    """The five weighted residuals of an edge between two poses."""
    x, y = moved(i, edge.x, edge.y, sign)
    turn = j.theta - i.theta - edge.theta * sign
    return [
        weight / F.exp(i.log_sx) * (j.x - x),
        weight / F.exp(i.log_sy) * (j.y - y),
        weight * cx * (j.log_sx - i.log_sx - edge.log_sx),
        weight * cx * (j.log_sy - i.log_sy - edge.log_sy),
        weight * cx * F.atan2(F.sin(turn), F.cos(turn)),
    ]


def is_valid(m: Affine, least: float = 0.001, most: float = 100.0, shear: float = 0.8) -> Column:
    """Not degenerate, scales and their ratio in bounds, axes about orthogonal. Mirrored matrices are valid."""
    u, v = scales(m)
    ratio = u / (v + 1e-9)
    skew = F.abs((m.a * m.b + m.c * m.d) / (u * v + 1e-9))
    return (
        (F.abs(det(m)) >= 1e-9)
        & (u > least) & (u < most) & (v > least) & (v < most)
        & (ratio > 0.5) & (ratio < 2.0) & (skew <= shear)
    )


def is_valid_homography(h: list[Column], tilt: float = 0.02) -> Column:
    n = [F.try_divide(x, h[8]) for x in h]
    flat = (F.abs(n[6]) <= tilt) & (F.abs(n[7]) <= tilt)
    return F.coalesce((F.abs(h[8]) >= 1e-9) & flat & is_valid(Affine(n[0], n[1], n[2], n[3], n[4], n[5])), F.lit(False))


def rotate_quarter(x: Column, y: Column, turn_deg: Column, width: Column, height: Column) -> tuple[Column, Column]:
    """A pixel of a frame in the frame turned by 0, 90, 180 or 270 degrees clockwise."""
    nx = F.when(turn_deg == 90, height - 1 - y).when(turn_deg == 180, width - 1 - x).when(turn_deg == 270, y).otherwise(x)
    ny = F.when(turn_deg == 90, x).when(turn_deg == 180, height - 1 - y).when(turn_deg == 270, width - 1 - x).otherwise(y)
    return nx, ny


def significant_motion(m: Affine, cx: float, cy: float, pixels: float = 15.0, degrees: float = 1.5) -> Column:
    """Whether the centre moves or the frame turns enough for a new keyframe; degenerate matrices count as such."""
    x, y = apply(m, F.lit(cx), F.lit(cy))
    far = F.hypot(x - cx, y - cy) >= pixels
    return F.coalesce(far | (F.abs(F.degrees(angle(m))) >= degrees) | (F.abs(det(m)) < 1e-9), F.lit(True))


def temporal_edge_reason(
    m: Affine, gap: Column, width: float, height: float, rotation: float = 30.0, ratio: float = 1.4, shift: float = 1.2
) -> Column:
    """Why a temporal edge is not sane: rotation, scale or shift; null if it is."""
    sx, sy = scales(m)
    most = math.log(max(ratio, 1 + 1e-9))
    x, y = apply(m, F.lit(width / 2), F.lit(height / 2))
    far = F.hypot(x - width / 2, y - height / 2) > F.greatest(gap.cast("double"), F.lit(1.0)) * (shift * math.hypot(width, height))
    off = [F.abs(F.log(F.greatest(s, F.lit(1e-9)))) > most for s in (sx, sy)]
    return (
        F.when(F.abs(F.degrees(angle(m))) > rotation, "rotation").when(off[0] | off[1], "scale").when(far, "shift")
    )


def passes_gate(
    m: Affine, inliers: Column, matches: Column, spread: Column,
    rotation: float = 40.0, ratio: float = 1.6, least_share: float = 0.25, least_spread: float = 0.0,
) -> Column:
    """Physical bounds of a loop closure; the spread only counts where a least one is set and it is known."""
    sx, sy = scales(m)
    most = math.log(max(ratio, 1 + 1e-9))
    share = F.when(matches > 0, inliers / matches).otherwise(F.lit(1.0))
    ok = (F.abs(F.degrees(angle(m))) <= rotation) & (share >= least_share)
    for s in (sx, sy):
        ok = ok & (F.abs(F.log(F.greatest(s, F.lit(1e-9)))) <= most)
    return ok & (spread.isNull() | (spread >= least_spread)) if least_spread > 0 else ok
