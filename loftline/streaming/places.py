"""Streams of positions: flow between fixes with state per track, and sources that a position activates."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from ..operators.flow import STALE
from ..operators.spatial import active_sources

MEASURED = "track_id bigint, seq bigint, t double, kind string, x double, y double, quality double, accepted boolean, source_id string"
FLOW = MEASURED + ", flow_x double, flow_y double, flow_n bigint, flow_quality double"
_FLOW_STATE = "begun boolean, source string, last array<double>, prev array<double>, n bigint, quality double"


def flow_stream(rows: DataFrame, stale: float = STALE) -> DataFrame:
    """operators.flow.extrapolate over a stream of MEASURED rows that come in order of seq from batch to batch.

    The state of a track is its source, its newest two samples, their number and lowest quality.
    """
    columns = [c.split()[0] for c in FLOW.split(", ")]

    def run(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        begun, source, last, prev, n, low = state.get if state.exists else (False, None, [], [], 0, 1.0)
        last, prev, out = list(last), list(prev), []
        for r in pd.concat(list(frames)).sort_values("seq").astype(object).itertuples(index=False):
            value = lambda v: None if pd.isna(v) else v
            own, quality = value(r.source_id), value(r.quality)
            if begun and own != source:
                last, prev, n, low = [], [], 0, 1.0
            begun, source = True, own
            x = y = None
            if last and r.t - last[0] <= stale:
                x, y = last[1:]
                if prev and last[0] - prev[0] > 1e-6:
                    x, y = (b + (b - a) / (last[0] - prev[0]) * (r.t - last[0]) for a, b in zip(prev[1:], last[1:], strict=True))
            out.append((key[0], r.seq, r.t, r.kind, r.x, r.y, quality, value(r.accepted), own, x, y, n, low))
            if r.kind == "flow":
                last, prev, n, low = [r.t, r.x, r.y], last, n + 1, min(low, 1.0 if quality is None else quality)
            elif r.kind == "fix" and value(r.accepted):
                last, prev, n, low = [], [], 0, 1.0
        state.update((begun, source, [float(v) for v in last], [float(v) for v in prev], int(n), float(low)))
        yield pd.DataFrame(out, columns=columns)

    return rows.groupBy("track_id").applyInPandasWithState(run, FLOW, _FLOW_STATE, "append", GroupStateTimeout.NoTimeout)


CHANGES = "track_id bigint, seq bigint, active array<string>"


def activation_stream(rows: DataFrame, boxes: DataFrame) -> DataFrame:
    """Rows (track_id, seq, active) of a stream of positions (track_id, seq, lat, lon) at which the active sources of a track change.

    boxes (source_id and bounds) is a static table; a position meets the boxes that hold it in a stream-static join, and the state of a
    track is the set it had last. The first position of a track counts as a change. Positions in no box have an empty set. Rows of a
    track come in order of seq from batch to batch.
    """
    whole = rows.select("track_id", "seq", F.lit(None).cast("string").alias("source_id"))
    held = active_sources(rows, boxes).select("track_id", "seq", F.col("source_id").cast("string").alias("source_id"))

    def run(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        known, last = (True, list(state.get[0])) if state.exists else (False, [])
        out = []
        for seq, part in pd.concat(list(frames)).groupby("seq", sort=True):
            active = sorted(s for s in part["source_id"] if s is not None and not pd.isna(s))
            if not known or active != last:
                out.append((key[0], seq, active))
            known, last = True, active
        state.update((last,))
        yield pd.DataFrame(out, columns=["track_id", "seq", "active"])

    both = whole.unionByName(held)
    return both.groupBy("track_id").applyInPandasWithState(run, CHANGES, "active array<string>", "append", GroupStateTimeout.NoTimeout)
