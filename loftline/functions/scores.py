"""Weights, confidences and decay scores as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the positional decay score.
PDM_ALPHA, PDM_LAMBDA, PDM_LIMIT = 0.85, 6.0, 1.67


def distance_ratio(d_m: Column, width_m: Column) -> Column:
    """Distance in footprint widths; a width that is not positive is an error."""
    return F.when(width_m > 0, d_m / width_m).otherwise(F.raise_error(F.lit("footprint width must be positive")))


def pdm_score(ratio: Column, alpha: float = PDM_ALPHA, steep: float = PDM_LAMBDA, limit: float = PDM_LIMIT) -> Column:
    """Logistic decay, a half at alpha, 0 from the limit on."""
    power = F.greatest(F.lit(-500.0), F.least(F.lit(500.0), (ratio - alpha) * steep))
    return F.when(ratio >= limit, F.lit(0.0)).otherwise(1.0 / (F.exp(power) + 1.0))


def edge_weight(base: Column, inliers: Column, rmse: Column) -> Column:
    return base * F.sqrt(F.greatest(inliers.cast("double"), F.lit(1.0))) / (rmse + 1.0)


def spread_confidence(spread: Column, reference: float = 0.15, floor: float = 0.35) -> Column:
    """Unknown spread is no penalty; 0 is the worst value."""
    return F.when(spread.isNull(), F.lit(1.0)).otherwise(F.greatest(F.lit(floor), F.least(F.lit(1.0), spread / reference)))


def spread_weight(spread: Column, reference: float = 0.15, k: float = 10.0) -> Column:
    return F.when(spread.isNull(), F.lit(1.0)).otherwise(1.0 / (1.0 + k * F.greatest(F.lit(0.0), F.lit(reference) - spread)))


def confidence(
    inliers: Column, matches: Column, match_rmse: Column, frame_rmse: Column, disagreement: Column,
    most_inliers: float = 80.0, rmse_norm: float = 10.0, disagreement_norm: float = 5.0, ransac: float = 3.0,
    spread: Column | None = None,
) -> Column:
    """Stability of the frame, number of inliers and quality of the match, to [0.05, 1]; with a spread, times its factor."""
    one, zero = F.lit(1.0), F.lit(0.0)
    stability = 1.0 - (
        F.least(frame_rmse, F.lit(rmse_norm)) / rmse_norm * 0.5
        + F.least(disagreement, F.lit(disagreement_norm)) / disagreement_norm * 0.5
    )
    match = inliers / (matches + 1e-6) * 0.5 + 0.5 / (match_rmse / (ransac + 1e-6) + 1.0)
    total = F.greatest(zero, F.least(one, stability)) * 0.3 + F.least(one, inliers / most_inliers) * 0.4 + match * 0.3
    if spread is not None:
        total = total * spread_confidence(spread)
    return F.greatest(F.lit(0.05), F.least(one, total))


def flow_confidence(quality: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), quality)) * 0.35 + 0.5


def flow_noise_scale(conf: Column) -> Column:
    return F.lit(1.5) / F.greatest(conf, F.lit(0.25))


def operating_state(
    active: Column, fix_age: Column, inliers: Column, conf: Column, anchor_age: Column,
    stale: float = 3.0, least_inliers: int = 0, least_confidence: float = 0.0, anchor_stale: float = 0.0,
) -> Column:
    """IDLE, ACQUIRING, LOST, DEGRADED or TRACKING; a limit of 0 is off."""
    weak = F.lit(False)
    if least_inliers:
        weak = weak | (F.coalesce(inliers, F.lit(0)) < least_inliers)
    if least_confidence:
        weak = weak | (F.coalesce(conf, F.lit(1.0)) < least_confidence)
    if anchor_stale:
        weak = weak | anchor_age.isNull() | (anchor_age > anchor_stale)
    return (
        F.when(~active, "IDLE").when(fix_age.isNull(), "ACQUIRING").when(fix_age > stale, "LOST").when(weak, "DEGRADED")
        .otherwise("TRACKING")
    )
