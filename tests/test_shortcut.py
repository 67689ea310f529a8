"""Matching beside the last match against a walk in plain Python, whole, in parts and as a stream."""

import random

import numpy as np
import pytest

from loftline.operators import shortcut
from loftline.streaming.shortcut import match_stream

QUERIES = "track_id long, at long, query_id long, vector array<double>, n string"
REFS = "ref_id long, vector array<double>, valid boolean, score string"


def unit(v):
    return np.asarray(v, float) / (np.linalg.norm(v) + 1e-8)


def walk(queries, refs, window, least, every):
    """(track_id, at, query_id, n, route, ref_id, last_id) of all queries."""
    has = lambda v: v is not None and len(v) and np.linalg.norm(v) > 0
    known = {r: (unit(v), ok) for r, v, ok, _ in refs if has(v)}
    out, tracks = [], {}
    for q in sorted((q for q in queries if has(q[3])), key=lambda q: (q[1], q[2])):
        tracks.setdefault(q[0], []).append(q)
    for rows in tracks.values():
        last = None
        for n, (track, at, query, v, _) in enumerate(rows, 1):
            score = lambda r: round(float(unit(v) @ known[r][0]), 9)  # noqa: B023, E731
            place = lambda r: 2 * (last - r) - 1 if r < last else 2 * (r - last)  # noqa: B023, E731
            near = [r for r in known if known[r][1] and abs(r - last) <= window] if last is not None and n % every else []
            best = min(near, key=lambda r: (-score(r), place(r)), default=None)
            route = "prior" if best is not None and score(best) >= least else "full" if n % every else "audit"
            found = best if route == "prior" else min(known, key=lambda r: (-score(r), r))
            out.append((track, at, query, n, route, found, last))
            last = found
    return sorted(out, key=str)


def tables(seed=3):
    rng, pick = np.random.default_rng(seed), random.Random(seed)
    base = rng.normal(size=(60, 4))
    refs = [(i, v.tolist(), pick.choice([True, True, True, False, None]), "x") for i, v in enumerate(base)]
    refs[7] = (7, refs[6][1], True, "x")  # a tie
    refs += [(60, None, True, "x"), (61, [], True, "x"), (62, [0.0] * 4, True, "x")]
    queries = []
    for track, n in ((1, 23), (2, 1), (None, 9), (4, 5)):
        place = 6
        for i in range(n):
            place = (place + pick.choice([0, 1, 1, 2, -1, 20])) % 60
            queries.append((track, i // 2, 100 * (track or 0) + i, (base[place] + rng.normal(size=4) * 0.2).tolist(), "x"))
    queries += [(1, 3, 900, None, "x"), (1, 4, 901, [0.0] * 4, "x"), queries[3]]  # no vector; a repeated row
    return queries, refs


def rows_of(df):
    return sorted((tuple(r) for r in df.select("track_id", "at", "query_id", "n", "route", "ref_id", "last_id").collect()), key=str)


@pytest.mark.parametrize("window,every", [(2, 4), (0, 2)])
def test_matches_equal_a_walk(spark, window, every):
    queries, refs = tables()
    q, r = spark.createDataFrame(queries, QUERIES).repartition(3), spark.createDataFrame(refs, REFS)
    got = rows_of(shortcut.matches(q, r, window, 0.8, every))
    want = walk(queries, refs, window, 0.8, every)
    assert got == want
    assert {"prior", "full", "audit"} == {w[4] for w in want}


def test_rates_and_empty_tables(spark):
    queries, refs = tables()
    q, r = spark.createDataFrame(queries, QUERIES), spark.createDataFrame(refs, REFS)
    found = shortcut.matches(q, r, 2, 0.8, 4)
    want = walk(queries, refs, 2, 0.8, 4)
    rate = shortcut.hit_rates(found, 2, []).first()
    tries, hits = sum(w[4] != "audit" for w in want), sum(w[4] == "prior" for w in want)
    misses = sum(w[4] == "audit" and w[6] is not None and abs(w[5] - w[6]) > 2 for w in want)
    assert tuple(rate) == (tries, hits, 100.0 * hits / tries, len(want) - tries, misses)
    assert shortcut.matches(q.limit(0), r, 2, 0.8, 2).collect() == []
    assert shortcut.matches(q, r.limit(0), 2, 0.8, 2).collect() == []
    with pytest.raises(ValueError):
        shortcut.matches(q, r, 2, 0.8, 1)


def test_a_stream_equals_the_batch(spark, tmp_path):
    queries, refs = tables(5)
    r = spark.createDataFrame(refs, REFS)
    parts = [[q for q in queries if q[1] < 4], [q for q in queries if 4 <= q[1] < 9], [q for q in queries if q[1] >= 9]]
    for i, part in enumerate(parts):
        spark.createDataFrame(part, QUERIES).coalesce(1).write.mode("append").parquet(str(tmp_path / f"in/part={i}"))
    rows = spark.readStream.schema(QUERIES).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/part=*"))
    writer = match_stream(rows, r, str(tmp_path / "out"), 2, 0.8, 4)
    writer.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination(240)
    got = rows_of(spark.read.parquet(str(tmp_path / "out/matches")))
    assert got == walk(queries, refs, 2, 0.8, 4)
