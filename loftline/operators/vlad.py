"""Frame descriptors from local tokens: low-norm tokens go, residuals to the nearest centroid are summed up."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))


def drop_low_norms(tokens: DataFrame, share: float, least: int = 8, keep: int = 4) -> DataFrame:
    """tokens (frame_id, v) without those of a frame whose norm is not above its quantile `share` (on the line between ranks).

    All tokens stay in a frame of fewer than `least`, where fewer than `keep` would stay, and with a share of 0.
    """
    if share <= 0:
        return tokens
    w = W.partitionBy("frame_id")
    rows = tokens.withColumn("__norm", norm(F.col("v").cast("array<double>")))
    rows = rows.withColumns({"__limit": F.percentile("__norm", share).over(w), "__n": F.count(F.lit(1)).over(w)})
    rows = rows.withColumn("__above", (F.col("__norm") > F.col("__limit")).cast("int"))
    rows = rows.withColumn("__left", F.sum("__above").over(w))
    return rows.where((F.col("__n") < least) | (F.col("__left") < keep) | (F.col("__above") == 1)).select(*tokens.columns)


def centroids_of(rows: DataFrame, key: str, vector: str) -> np.ndarray:
    """Mean vectors (k, d) in the order of a key that has a stated small number of values (the vocabulary)."""
    parts = rows.select(key, F.posexplode(F.col(vector).cast("array<double>")).alias("i", "x")).groupBy(key, "i").agg(F.avg("x").alias("x"))
    table = parts.toPandas().pivot(index=key, columns="i", values="x").sort_index()
    return table.to_numpy(float)


def aggregate_tokens(tokens: DataFrame, centroids: np.ndarray, low_norm_share: float = 0.0) -> DataFrame:
    """(frame_id, n_tokens, vlad): for each frame the residuals of its tokens to their nearest centroids, summed by centroid.

    vlad has k * d numbers: the sums of each centroid at unit length (0 where it has no token or no residual), then the whole at unit
    length. The nearest centroid has the largest v c - c c / 2, the first of equals. Frames come one after the other in a
    partition and one that goes on is carried over, so a frame may have any number of tokens, and none is collected. Tokens
    that are null or of another length than the centroids are left out; a frame without any other has no row.
    """
    k, d = centroids.shape
    half = (centroids**2).sum(1) / 2

    def finished(frame, sums: np.ndarray, n: int) -> tuple:
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        flat = np.divide(sums, length, out=sums.copy(), where=length > 1e-12).ravel()
        whole = np.linalg.norm(flat)
        return frame, n, (flat / whole if whole > 1e-12 else flat).tolist()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: tuple | None = None
        for rows in batches:
            if not len(rows):
                continue
            v = np.stack([np.asarray(x, float) for x in rows["v"]])
            near = np.argmax(v @ centroids.T - half, axis=1)
            frames, at, counts = np.unique(rows["frame_id"].to_numpy(), return_inverse=True, return_counts=True)
            sums = np.zeros((len(frames), k, d))
            np.add.at(sums, (at, near), v - centroids[near])
            done = []
            if held is not None:
                if held[0] == frames[0]:
                    sums[0] += held[1]
                    counts[0] += held[2]
                else:
                    done.append(finished(*held))
            done += [finished(*x) for x in zip(frames[:-1].tolist(), sums[:-1], counts[:-1].tolist(), strict=True)]
            held = (frames[-1].item(), sums[-1], int(counts[-1]))
            if done:
                yield pd.DataFrame(done, columns=["frame_id", "n_tokens", "vlad"])
        if held is not None:
            yield pd.DataFrame([finished(*held)], columns=["frame_id", "n_tokens", "vlad"])

    sound = tokens.where(F.col("v").isNotNull() & (F.size("v") == d) & F.col("frame_id").isNotNull()).select("frame_id", "v")
    rows = drop_low_norms(sound, low_norm_share).repartition("frame_id").sortWithinPartitions("frame_id")
    return rows.mapInPandas(run, "frame_id bigint, n_tokens bigint, vlad array<double>")
