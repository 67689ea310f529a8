"""Matching of ordered queries beside the last match, with every so-manyth query checked by the full search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..session import small, stored
from .retrieval import DIGITS, topk
from .scans import ranked

MATCH = ["track_id", "at", "query_id", "n", "route", "ref_id", "score", "last_id"]


def neighbourhood(last: Column, window: int) -> Column:
    """Ids at most `window` away, not below 0, as an array of structs (id, place): the last one first, then one below, one above and so on."""
    steps = F.sequence(F.lit(-window), F.lit(window))
    place = lambda d: F.when(d < 0, -2 * d - 1).otherwise(2 * d)
    return F.filter(F.transform(steps, lambda d: F.struct((last + d).alias("id"), place(d).alias("place"))), lambda c: c["id"] >= 0)


def _vector() -> Column:
    return F.col("vector").isNotNull() & (V.norm(F.col("vector")) > 0)


def _beside(asked: DataFrame, refs: DataFrame, window: int, least: float) -> DataFrame:
    """(row_id, ref_id, score) of asked rows (row_id, last_id, vector) whose best valid neighbour scores `least` or more."""
    near = asked.where("last_id is not null").select("row_id", F.col("vector").alias("__q"), F.explode(neighbourhood(F.col("last_id"), window)).alias("__c"))
    near = near.select("row_id", "__q", F.col("__c.id").alias("ref_id"), F.col("__c.place").alias("__place"))
    scored = refs.where("valid").join(small(near), "ref_id").withColumn("score", F.round(V.cosine(F.col("__q"), F.col("vector")), DIGITS))
    best = scored.groupBy("row_id").agg(F.min(F.struct((-F.col("score")).alias("s"), "__place", "ref_id", "score")).alias("b"))
    return best.where(F.col("b.score") >= least).select("row_id", "b.ref_id", "b.score")


def _after(asked: DataFrame, last: DataFrame) -> DataFrame:
    """asked with the matches of the rows right before theirs as last_id, where these are in last."""
    before = last.select(F.col("track_id").alias("__t"), (F.col("n") + 1).alias("__n"), F.col("ref_id").alias("__last"))
    joined = asked.join(before, F.col("track_id").eqNullSafe(F.col("__t")) & (F.col("n") == F.col("__n")), "left")
    return joined.withColumn("last_id", F.coalesce("__last", "last_id")).drop("__t", "__n", "__last")


def matches(queries: DataFrame, refs: DataFrame, window: int, least: float, every: int, start: DataFrame | None = None) -> DataFrame:
    """MATCH rows: for each query the reference that it matches, and the route by which it was found.

    queries: track_id, at, query_id, vector; those of a track are numbered from 1 (n) in the order of at, then query_id. refs:
    ref_id, vector, and valid where some may not stand in for the last match (null: may not). Each `every`-th query of a track
    is an `audit` and takes the best of all references. Any other is compared with the valid references whose ids are at most
    `window` from the last match of its track; the best of them is taken if its score (cosine) is `least` or more (`prior`), else
    the best of all references (`full`). Of equal scores the nearer id wins beside the last match, then the lower one; in the full
    search the lower one. last_id is the match before. start: track_id, n, ref_id, the last of an earlier part of some tracks.

    An audit does not depend on what was before, so all stretches between audits go in step: there are `every` rounds,
    however long a track is, each with a join for what stands beside and one search for what is still open. This pays where the
    queries are many blocks of a search; else one search for all of them reads the references once.

    Queries without a vector (null, empty, zeros) do not count and have no row; repeated rows are queries of their own. Without
    references that have a vector there is no row. A null track_id is a track. Other columns are left out.
    """
    if every < 2:
        raise ValueError("every has to be 2 or more")
    valid = F.coalesce(F.col("valid"), F.lit(False)) if "valid" in refs.columns else F.lit(True)
    refs = refs.where(_vector()).select("ref_id", "vector", valid.alias("valid"))
    rows = ranked(queries.where(_vector()).select("track_id", "at", "query_id", "vector"), ["track_id"], ["at", "query_id"])
    rows = rows.select("track_id", "at", "query_id", "vector", (F.col("place") + 1).alias("n"))
    if start is None:
        first = rows.withColumns({"row_id": F.monotonically_increasing_id(), "seen": F.lit(0).cast("bigint"), "start_id": F.lit(None).cast("bigint")})
    else:
        known = start.select(F.col("track_id").alias("__t"), F.col("n").alias("seen"), F.col("ref_id").alias("start_id"))
        first = rows.join(known, F.col("track_id").eqNullSafe(F.col("__t")), "left").withColumn("seen", F.coalesce("seen", F.lit(0).cast("bigint")))
        first = first.withColumns({"n": F.col("n") + F.col("seen"), "row_id": F.monotonically_increasing_id()})
    first = stored(first.withColumn("start_id", F.when(F.col("n") == F.col("seen") + 1, F.col("start_id"))).drop("seen", "__t"))

    parts, last = [], None
    for turn in range(every):
        asked = first.where(F.pmod("n", F.lit(every)) == turn).withColumn("last_id", F.col("start_id"))
        if last is not None:
            asked = _after(asked, last)
        own = stored(asked.select("row_id", "track_id", "at", "query_id", "n", "vector", "last_id"))
        prior = None
        rest = own
        if turn:
            prior = stored(_beside(own, refs, window, least))
            rest = own.join(prior.select("row_id"), "row_id", "left_anti")
        found = topk(rest.select(F.col("row_id").alias("query_id"), "vector"), refs, 1)
        route = F.lit("full" if turn else "audit").alias("route")
        new = found.select(F.col("query_id").alias("row_id"), route, "ref_id", "score")
        if prior is not None:
            new = new.unionByName(prior.withColumn("route", F.lit("prior")))
        last = stored(own.drop("vector").join(new, "row_id").select(*MATCH))
        parts.append(last)
    out = _after(parts[0], last).select(*MATCH)  # only now it is known what was before an audit
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def hit_rates(found: DataFrame, window: int, keys: list[str]) -> DataFrame:
    """keys, tries, hits, hit_rate in percent, audits and misses: audits whose match is not beside the match before.

    All queries but audits are tries; those that the prior answered are hits. Without tries the rate is 0. An audit without a match
    before is no miss.
    """
    audit, far = F.col("route") == "audit", F.abs(F.col("ref_id") - F.col("last_id")) > window
    counted = {"tries": ~audit, "hits": F.col("route") == "prior", "audits": audit, "misses": audit & far}
    out = found.groupBy(*keys).agg(*[F.count_if(c).alias(n) for n, c in counted.items()])
    rate = F.when(F.col("tries") > 0, 100.0 * F.col("hits") / F.col("tries")).otherwise(0.0)
    return out.select(*keys, "tries", "hits", rate.alias("hit_rate"), "audits", "misses")


def ends(found: DataFrame, start: DataFrame | None = None) -> DataFrame:
    """track_id, n, ref_id of the last match of each track: what the next part of the tracks takes as start."""
    rows = found.select("track_id", "n", "ref_id")
    rows = rows if start is None else rows.unionByName(start.select("track_id", "n", "ref_id"))
    return rows.groupBy("track_id").agg(F.max("n").alias("n"), F.max_by("ref_id", "n").alias("ref_id"))
