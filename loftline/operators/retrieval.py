"""Vector retrieval: exact and cell-pruned top-k, multi-source choice, patch votes, rank fusion, mutual matches."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import vectors
from ..session import cut, small

#: Queries that are held against the references at once; more are split into as many passes.
QUERY_BLOCK = 8192
DIGITS = 9


#: Queries of a tile: with a batch of references it makes a matrix of at most some 10 MB, of which a task holds a few copies.
TILE = 128


def _best(sim: np.ndarray, of: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, reference and rounded score of the k best of each row; of equal rounded scores the smallest references.

    The k-th score is found by partition; only what is not below it by rounding is sorted.
    """
    kth = sim.max(1) if k == 1 else np.partition(sim, sim.shape[1] - k, axis=1)[:, sim.shape[1] - k] if sim.shape[1] > k else sim.min(1)
    row, at = np.nonzero(sim >= kth[:, None] - 2 * 10.0**-DIGITS)
    score = np.round(sim[row, at], DIGITS)
    order = np.lexsort((of[at], -score, row))
    row, at, score = row[order], at[order], score[order]
    first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    kept = np.arange(len(row)) - np.repeat(first, np.diff(np.r_[first, len(row)])) < k
    return row[kept], of[at[kept]], score[kept]


def _scores(block: pd.DataFrame, k: int, negatives: bool):
    """Best k references of each batch for each query of a block, tile by tile."""
    ids = block["query_id"].to_numpy()
    matrix = np.stack([np.asarray(v, np.float64) for v in block["vector"]]) if len(block) else np.zeros((0, 1))
    matrix = matrix / (np.linalg.norm(matrix, axis=1, keepdims=True) + vectors.EPSILON)

    def run(batches):
        for refs in batches:
            if not len(refs) or not len(ids):
                continue
            other = np.stack([np.asarray(v, np.float64) for v in refs["vector"]])
            other = (other / (np.linalg.norm(other, axis=1, keepdims=True) + vectors.EPSILON)).T
            of = refs["ref_id"].to_numpy()
            for a in range(0, len(ids), TILE):
                sim = matrix[a : a + TILE] @ other
                row, ref, score = _best(sim if negatives else np.maximum(sim, 0.0), of, k)
                yield pd.DataFrame({"query_id": ids[a + row], "ref_id": ref, "score": score})

    return run


def ranked(scored: DataFrame, k: int | None = None, by: str = "query_id") -> DataFrame:
    """With rank: score descending, then ref_id."""
    order = W.partitionBy(by).orderBy(F.col("score").desc(), "ref_id")
    out = scored.withColumn("rank", F.row_number().over(order))
    return out.where(F.col("rank") <= k) if k else out


def topk(queries: DataFrame, refs: DataFrame, k: int, negatives: bool = True) -> DataFrame:
    """(query_id, ref_id, score, rank): the k references of highest cosine for each stated query.

    queries has (query_id, vector), refs (ref_id, vector). Queries of one block are sent to all partitions of the
    references; a partition answers with k rows per query and batch. More queries meet the references in a grid: blocks
    of either side, each pair of blocks in one task, with k rows per query and pair. What is shuffled last does
    not depend on the number of references but on that of blocks. Null, empty and zero vectors are not compared.
    """
    valid = F.col("vector").isNotNull() & (vectors.norm(F.col("vector")) > 0)
    queries, refs = queries.where(valid).select("query_id", "vector"), refs.where(valid).select("ref_id", "vector")
    block = queries.limit(QUERY_BLOCK + 1).toPandas()
    if len(block) <= QUERY_BLOCK:
        return ranked(refs.mapInPandas(_scores(block, k, negatives), _SCORED), k)
    return ranked(_grid(queries, refs, k, negatives), k)


_SCORED = "query_id bigint, ref_id bigint, score double"


def _grid(queries: DataFrame, refs: DataFrame, k: int, negatives: bool) -> DataFrame:
    """Scores of the best k references of each block for each query: all pairs of blocks of about QUERY_BLOCK rows."""
    n, m = (-(-rows.count() // QUERY_BLOCK) for rows in (queries, refs))
    block = lambda rows, key, count: rows.withColumn(key[0], F.pmod(F.xxhash64(key), F.lit(count)).cast("int"))
    meet = lambda name, count: F.explode(F.sequence(F.lit(0), F.lit(max(count, 1) - 1))).alias(name)
    left = block(queries, "query_id", max(n, 1)).select("*", meet("r", m))
    right = block(refs, "ref_id", max(m, 1)).select("*", meet("q", n))

    def both(asked: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        parts = list(_scores(asked, k, negatives)([found])) if len(asked) and len(found) else []
        return pd.concat(parts) if parts else pd.DataFrame({"query_id": pd.Series(dtype="int64"), "ref_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})

    return left.groupBy("q", "r").cogroup(right.groupBy("q", "r")).applyInPandas(both, _SCORED)


def _usable(rows: DataFrame) -> DataFrame:
    """Rows with a vector that has a direction; null, empty and zero vectors are compared with nothing."""
    return rows.where(F.col("vector").isNotNull() & (vectors.norm(F.col("vector")) > 0))


def _units(rows: pd.Series) -> np.ndarray:
    m = np.stack([np.asarray(v, np.float64) for v in rows])
    return m / (np.linalg.norm(m, axis=1, keepdims=True) + vectors.EPSILON)


def truth_ranks(queries: DataFrame, refs: DataFrame) -> DataFrame:
    """(query_id, truth_rank): one more than the references that score above the one of the query's own id.

    Queries and references meet in a grid of blocks; a pair of blocks answers with one count per query, so there is no cap and
    nothing passes through the driver. A query without its own reference has no row. Ids are unique; null, empty and zero
    vectors are not compared.
    """
    queries, refs = _usable(queries).select("query_id", "vector"), _usable(refs).select("ref_id", "vector")
    asked = queries.join(refs.select(F.col("ref_id").alias("query_id"), F.col("vector").alias("own")), "query_id")
    n, m = (max(1, -(-rows.count() // QUERY_BLOCK)) for rows in (asked, refs))
    deal = lambda key, count: F.pmod(F.xxhash64(key), F.lit(count)).cast("int")
    meet = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    left = asked.select(*[F.col(c).alias(c) for c in asked.columns], deal("query_id", n).alias("q"), meet(m).alias("r"))
    right = refs.withColumns({"r": deal("ref_id", m), "q": meet(n)})

    def both(block: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        ids = block["query_id"].to_numpy()
        beaten = np.zeros(len(ids), np.int64)
        if len(ids) and len(found):
            other, of = _units(found["vector"]).T, found["ref_id"].to_numpy()
            for a in range(0, len(ids), TILE):
                part = block.iloc[a : a + TILE]
                matrix = _units(part["vector"])
                truth = np.round((matrix * _units(part["own"])).sum(1), DIGITS)
                above = np.round(matrix @ other, DIGITS) > truth[:, None]
                beaten[a : a + TILE] = (above & (of != ids[a : a + TILE, None])).sum(1)
        return pd.DataFrame({"query_id": ids, "beaten": beaten})

    found = left.groupBy("q", "r").cogroup(right.groupBy("q", "r")).applyInPandas(both, "query_id bigint, beaten bigint")
    return found.groupBy("query_id").agg((F.sum("beaten") + 1).alias("truth_rank"))


def bucket_topk(asked: DataFrame, refs: DataFrame, buckets: list[str], k: int, negatives: bool = True) -> DataFrame:
    """(query_id, ref_id, score, rank): the k references of highest cosine among those that share a bucket with the query.

    asked (query_id, vector, buckets) has a row for each bucket of a query, refs (ref_id, vector, buckets) for each of a
    reference; several common buckets count once. A bucket is dealt out in blocks of about QUERY_BLOCK rows of either side, so a
    hot one is no single task; a pair of blocks answers with k rows per query. A null bucket is none. Null, empty and zero vectors are not compared.
    """
    asked, refs = _usable(asked).select("query_id", "vector", *buckets), _usable(refs).select("ref_id", "vector", *buckets)
    count = lambda rows, name: rows.groupBy(*buckets).agg(F.ceil(F.count(F.lit(1)) / QUERY_BLOCK).cast("int").alias(name))
    sizes = small(cut(count(asked, "__n").join(count(refs, "__m"), buckets)))
    deal = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
    meet = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = asked.join(sizes, buckets).withColumns({"__q": deal("query_id", "__n"), "__r": meet("__m")}).drop("__n", "__m")
    right = refs.join(sizes, buckets).withColumns({"__r": deal("ref_id", "__m"), "__q": meet("__n")}).drop("__n", "__m")

    def both(block: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        parts = list(_scores(block, k, negatives)([found])) if len(block) and len(found) else []
        return pd.concat(parts) if parts else pd.DataFrame({"query_id": pd.Series(dtype="int64"), "ref_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})

    keys = [*buckets, "__q", "__r"]
    left = left.select(*[F.col(c).alias(c) for c in left.columns])  # sides of one table would share their columns' ids
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(both, _SCORED)
    return ranked(found.groupBy("query_id", "ref_id").agg(F.max("score").alias("score")), k)


#: Rows that centroids are fitted on at most, and the fewest of them per cell.
SAMPLE, SAMPLE_PER_CELL = 20_000, 16


def cell_count(rows: int) -> int:
    """Cells of an index over so many rows: the square root, as far as the sample can fit that many."""
    return max(1, min(int(rows**0.5), SAMPLE // SAMPLE_PER_CELL))


def fit_centroids(refs: DataFrame, n: int, sample: int = SAMPLE, rounds: int = 10) -> np.ndarray:
    """Spherical k-means on a sample of at most so many usable rows (the smallest hashes of their ids); without rows none."""
    rows = _usable(refs).orderBy(F.xxhash64("ref_id"), "ref_id").limit(sample).toPandas()
    if not len(rows):
        return np.zeros((0, 1))
    v = _units(rows["vector"])
    centers = v[:: max(1, len(v) // n)][:n].copy()
    for _ in range(rounds):
        nearest = np.argmax(v @ centers.T, axis=1)
        for c in np.unique(nearest):
            centers[c] = v[nearest == c].mean(0)
        centers /= np.linalg.norm(centers, axis=1, keepdims=True) + vectors.EPSILON
    return centers


def cells(rows: DataFrame, centroids: np.ndarray, nearest: int = 1) -> DataFrame:
    """rows once for each cell of their `nearest` centroids (by cosine). Null, empty and zero vectors are in no cell."""

    def run(batches):
        for batch in batches:
            if len(batch) and len(centroids):
                v = np.stack([np.asarray(x, np.float64) for x in batch["vector"]])
                yield batch.assign(cell=list(np.argsort(-(v @ centroids.T), axis=1, kind="stable")[:, :nearest].astype(np.int32)))

    found = _usable(rows).mapInPandas(run, rows.withColumn("cell", F.array(F.lit(0))).schema)
    return found.withColumn("cell", F.explode("cell"))


def topk_cells(queries: DataFrame, indexed: DataFrame, centroids: np.ndarray, k: int, probes: int) -> DataFrame:
    """Approximate top-k: queries meet the references of their nearest cells; negative scores become 0."""
    return bucket_topk(cells(queries, centroids, probes), indexed, ["cell"], k, negatives=False)


def best_source(found: DataFrame, sources: DataFrame) -> DataFrame:
    """Rows of the source with the highest best score; ties go to the lower priority number, then the lower id."""
    best = found.groupBy("query_id", "source_id").agg(F.max("score").alias("best")).join(small(sources), "source_id")
    order = W.partitionBy("query_id").orderBy(F.col("best").desc(), "priority", "source_id")
    chosen = best.withColumn("r", F.row_number().over(order)).where("r = 1").select("query_id", "source_id")
    return found.join(chosen, ["query_id", "source_id"])


def patch_votes(hits: DataFrame, patches: Column | int) -> DataFrame:
    """(query_id, ref_id, hits, score) from patch hits: share of pairs that hit times their mean score.

    Pairs of patches count, so the share may exceed 1.
    """
    n = patches if isinstance(patches, Column) else F.lit(patches)
    return hits.groupBy("query_id", "ref_id").agg(F.count(F.lit(1)).alias("hits"), F.sum("score").alias("total")).select(
        "query_id", "ref_id", "hits", ((F.col("hits") / n) * (F.col("total") / F.col("hits"))).alias("score")
    )


def fuse(a: DataFrame, b: DataFrame, share_a: float = 0.6) -> DataFrame:
    """Full outer fusion of two score lists: weighted where both have an id, else the score as it is."""
    x = a.select("query_id", "ref_id", F.col("score").alias("a"))
    y = b.select("query_id", "ref_id", F.col("score").alias("b"))
    both = F.col("a") * share_a + F.col("b") * (1 - share_a)
    score = F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), both).otherwise(F.coalesce("a", "b"))
    return x.join(y, ["query_id", "ref_id"], "full_outer").select("query_id", "ref_id", score.alias("score"))


def loop_closures(found: DataFrame, least_gap: int, least_score: float) -> DataFrame:
    """Undirected candidate pairs (i, j, score, rank, mutual) of a self search.

    Gap and score filters come first; of both directions of a pair the one of the lower i, then rank, stays;
    whether j has i among its own is told afterwards, so a pair is not tried again from the other side.
    """
    rows = found.select(F.col("query_id").alias("i"), F.col("ref_id").alias("j"), "score", "rank")
    apart = rows.where((F.abs(F.col("i") - F.col("j")) > least_gap) & (F.col("score") >= least_score))
    order = W.partitionBy(F.least("i", "j"), F.greatest("i", "j")).orderBy("i", "rank")
    first = apart.withColumn("r", F.row_number().over(order)).where("r = 1").drop("r")
    back = rows.select(F.col("j").alias("i"), F.col("i").alias("j"), F.lit(True).alias("mutual"))
    return first.join(back, ["i", "j"], "left").withColumn("mutual", F.coalesce("mutual", F.lit(False)))


def mutual_matches(pairs: DataFrame, ratio: float = 0.75) -> DataFrame:
    """Mutual nearest neighbours of each frame pair, by Lowe's ratio of L2 distances.

    pairs: (pair_id, q, r, score) of all descriptor pairs of frame pairs. Fewer than two descriptors on a side
    match nothing; ties go to the lower index.
    """
    forward = W.partitionBy("pair_id", "q").orderBy(F.col("score").desc(), "r")
    back = W.partitionBy("pair_id", "r").orderBy(F.col("score").desc(), "q")
    rows = pairs.withColumn("l2", vectors.similarity_to_l2(F.col("score")))
    rows = rows.withColumns({"rq": F.row_number().over(forward), "second": F.lead("l2").over(forward)})
    rows = rows.withColumn("rr", F.row_number().over(back)).where("rq = 1 and rr = 1")
    return rows.where((F.col("second").isNotNull()) & (F.col("l2") < F.col("second") * ratio)).select("pair_id", "q", "r", "score")


def first_good(candidates: DataFrame, enough: int = 40) -> DataFrame:
    """Verification in rank order: the best of the candidates up to the first with enough inliers, strict >."""
    before = W.partitionBy("query_id").orderBy("rank").rowsBetween(W.unboundedPreceding, -1)
    tried = candidates.withColumn("so_far", F.max("inliers").over(before)).where(
        F.col("so_far").isNull() | (F.col("so_far") < enough)
    )
    best = tried.groupBy("query_id").agg(
        F.max_by(F.struct("ref_id", "inliers", "rank"), F.struct("inliers", -F.col("rank"))).alias("b"),
        F.count(F.lit(1)).alias("tried"),
    )
    return best.select("query_id", "b.ref_id", "b.inliers", "b.rank", "tried")
