"""Streams of track rows: operating states with timeouts, and the gate and filter with state per track."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from ..operators.trajectory import Gate, Kalman

POSITION = "track_id bigint, seq bigint, t double, x double, y double"


def read_events(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    """The rows of an events table as a stream, in the form of POSITION and with event time ts."""
    schema = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    seconds = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts) / 1e6")
    return rows.select(
        F.col("user_id").alias("track_id"), F.col("event_id").alias("seq"), seconds.alias("t"), F.col("value").alias("x"),
        F.regexp_extract("props", r"\"k\": *(-?[0-9.]+)", 1).cast("double").alias("y"), "event_type", F.col("ts").cast("timestamp").alias("ts"),
    )


def state_counts(rows: DataFrame, window: str = "1 day", delay: str = "1 day") -> DataFrame:
    """Rows by event-time window and event type, with a watermark for late ones."""
    return (
        rows.withWatermark("ts", delay).groupBy(F.window("ts", window).alias("w"), "event_type").count()
        .select(F.col("w.start").alias("starts"), "event_type", "count")
    )


FILTERED = "track_id bigint, seq bigint, t double, fx double, fy double, rejected boolean"
STATE = "last double, x array<double>, p array<double>, first array<double>, window array<array<double>>, misses int"


def _restore(old) -> tuple[float | None, Kalman, Gate]:
    import numpy as np

    filter_, gate = Kalman(), Gate()
    if old is None:
        return None, filter_, gate
    last, x, p, first, window, misses = old
    filter_.x = np.array(x, float) if len(x) else None
    filter_.p = np.array(p, float).reshape(4, 4)
    filter_.first = np.array(first, float) if len(first) else None
    gate.window = [(np.array(w[:2], float), float(w[2])) for w in window]
    gate.misses = int(misses)
    return last, filter_, gate


def _keep(last: float, filter_: Kalman, gate: Gate) -> tuple:
    return (
        last, [] if filter_.x is None else filter_.x.tolist(), filter_.p.ravel().tolist(),
        [] if filter_.first is None else list(map(float, filter_.first)), [[*map(float, p), t] for p, t in gate.window], gate.misses,
    )


def _fold(key, rows: pd.DataFrame, old) -> tuple[pd.DataFrame, tuple]:
    """The gate decides before the filter's state changes; a rejected fix leaves the filter where it was."""
    last, filter_, gate = _restore(old)
    out = []
    for seq, t, x, y in rows.sort_values(["t", "seq"])[["seq", "t", "x", "y"]].itertuples(index=False):
        dt = 1.0 if last is None or t <= last else t - last
        last = t
        rejected = gate.rejects((x, y), dt, filter_.distance((x, y), dt))
        fx = fy = None
        if not rejected:
            gate.accept((x, y), dt)
            fx, fy = filter_.update((x, y), dt)
        out.append((key[0], seq, t, fx, fy, rejected))
    return pd.DataFrame(out, columns=["track_id", "seq", "t", "fx", "fy", "rejected"]), _keep(last, filter_, gate)


def filter_stream(rows: DataFrame) -> DataFrame:
    """Gate and filter of each track over a stream of POSITION rows; the state of a track goes from batch to batch."""

    def run(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        out, new = _fold(key, pd.concat(list(frames)), state.get if state.exists else None)
        state.update(new)
        yield out

    return rows.select("track_id", "seq", "t", "x", "y").groupBy("track_id").applyInPandasWithState(
        run, FILTERED, STATE, "append", GroupStateTimeout.NoTimeout
    )


def filter_batch(rows: DataFrame) -> DataFrame:
    """The same over a table."""
    return rows.select("track_id", "seq", "t", "x", "y").groupBy("track_id").applyInPandas(
        lambda key, frame: _fold(key, frame, None)[0], FILTERED
    )


def newest(rows: DataFrame) -> DataFrame:
    """For foreachBatch: the newest row of each track of a micro-batch, older ones of it are dropped as late."""
    return rows.groupBy("track_id").agg(F.max_by(F.struct("seq", "t", "x", "y"), F.struct("t", "seq")).alias("r")).select("track_id", "r.*")
