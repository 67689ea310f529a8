"""Positions between fixes from optical-flow samples, in a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scans import running

#: Seconds after which the newest sample is too old.
STALE = 0.5


def extrapolate(rows: DataFrame, stale: float = STALE) -> DataFrame:
    """rows (track_id, seq, t, kind, x, y, quality, accepted, source_id) with where the flow puts each: flow_x, flow_y, flow_n, flow_quality.

    Samples (kind 'flow') since the last accepted fix (kind 'fix') of the same source are used: the newest two before a row give
    a line to its time, one alone its place; older than `stale` seconds, or without any, the place is null. flow_n counts the samples and
    flow_quality is their lowest quality (1 without any; a null quality does not count). An accepted fix and a change of source clear
    the track after, respectively before, the row they come with. Rows of a track are ordered by seq, a whole number that is unique in it.
    """
    w = W.partitionBy("track_id").orderBy("seq")
    changed = ~F.lag("source_id").over(w).eqNullSafe(F.col("source_id")) & (F.row_number().over(w) > 1)
    taken = (F.col("kind") == "fix") & F.coalesce(F.col("accepted"), F.lit(False))
    marked = rows.withColumns({"__changed": changed.cast("int"), "__taken": taken.cast("int")})
    marked = running(marked, ["track_id"], "seq", sums={"__fixes": "__taken"})
    marked = running(marked, ["track_id"], "seq", sums={"__runs": "__changed"}, own=True)
    part = W.partitionBy("track_id", "__fixes", "__runs").orderBy("seq")
    before = part.rowsBetween(W.unboundedPreceding, -1)
    sample = F.when(F.col("kind") == "flow", F.struct("t", "x", "y"))
    marked = marked.withColumns(
        {
            "__last": F.last(sample, True).over(before),
            "flow_n": F.coalesce(F.sum((F.col("kind") == "flow").cast("int")).over(before), F.lit(0)).cast("bigint"),
            "flow_quality": F.least(F.lit(1.0), F.coalesce(F.min(F.when(F.col("kind") == "flow", F.col("quality"))).over(before), F.lit(1.0))),
        }
    )
    # The sample before the newest one is what a flow row itself saw as the newest.
    marked = marked.withColumn("__pair", F.last(F.when(F.col("kind") == "flow", F.struct(F.col("__last").alias("p"))), True).over(before))
    last, prev, ahead = F.col("__last"), F.col("__pair.p"), F.col("t") - F.col("__last.t")
    apart = last["t"] - prev["t"]
    out = {}
    for c in ("x", "y"):
        line = last[c] + (last[c] - prev[c]) / F.when(apart > 1e-6, apart) * ahead
        out[f"flow_{c}"] = F.when(ahead <= stale, F.coalesce(line, last[c]))
    return marked.withColumns(out).select(*rows.columns, "flow_x", "flow_y", "flow_n", "flow_quality")
