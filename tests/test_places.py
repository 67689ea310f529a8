"""Token descriptors, searches in stages, flow and activation, in tables and streams, against direct computation."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loftline.operators import flow, search, spatial, vlad
from loftline.streaming import places


def brute_vlad(tokens, centers, share):
    norms = np.linalg.norm(tokens, axis=1)
    if share > 0 and len(tokens) >= 8:
        kept = tokens[norms > np.quantile(norms, share)]
        tokens = kept if len(kept) >= 4 else tokens
    out = np.zeros(centers.shape)
    for v in tokens:
        c = int(np.argmin(((centers - v) ** 2).sum(1)))
        out[c] += v - centers[c]
    length = np.linalg.norm(out, axis=1, keepdims=True)
    flat = np.where(length > 1e-12, out / np.where(length > 0, length, 1), out).ravel()
    return len(tokens), flat / np.linalg.norm(flat) if np.linalg.norm(flat) > 1e-12 else flat


@pytest.mark.parametrize("share", [0.0, 0.3, 0.9])
def test_vlad_equals_brute_force_over_batches(spark, share):
    rng = np.random.default_rng(4)
    centers = rng.normal(size=(5, 6))
    frames = {f: rng.normal(size=(n, 6)) for f, n in enumerate([1, 7, 8, 9, 300, 40, 3])}
    frames[9] = centers[:1].copy()  # a token that is a centroid leaves no residual
    rows = [(f, v.tolist(), i) for f, vs in frames.items() for i, v in enumerate(vs)] + [(1, None, 0), (1, [1.0], 0), (None, [0.0] * 6, 0), (77, None, 1)]
    random.Random(1).shuffle(rows)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "11")
    try:
        got = {r.frame_id: r for r in vlad.aggregate_tokens(spark.createDataFrame(rows, "frame_id long, v array<double>, token int").repartition(3), centers, share).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got.keys() == frames.keys()
    for f, tokens in frames.items():
        n, want = brute_vlad(tokens, centers, share)
        assert got[f].n_tokens == n and np.allclose(got[f].vlad, want, atol=1e-9)
    assert vlad.aggregate_tokens(spark.createDataFrame([], "frame_id long, v array<double>"), centers).collect() == []


def brute_stages(variants, refs, least, prior_least):
    unit = lambda v: np.asarray(v) / (np.linalg.norm(v) + 1e-8)
    out = {}
    for q in {v[0] for v in variants}:
        best, tried = None, 0
        for stage in sorted({v[1] for v in variants}):
            own = sorted(v for v in variants if v[0] == q and v[1] == stage)
            for _, s, p, vector in own:
                if vector is None:
                    continue
                tried += 1
                score, ref = max((round(float(unit(vector) @ unit(v)), 9), -r) for r, v in refs)
                if best is None or score > best[3]:
                    best = (s, p, -ref, score)
            if stage == 0 and best is not None:
                if best[3] >= prior_least:
                    break
                best = None
            elif best is not None and best[3] >= least:
                break
        if best is not None:
            out[q] = (*best, tried)
    return out


def test_staged_search_stops_and_forgets_like_the_loop(spark):
    rng = np.random.default_rng(2)
    refs = [(i, rng.normal(size=4).tolist()) for i in range(6)]
    variants = [(q, s, p, rng.normal(size=4).tolist()) for q in range(40) for s, n in ((0, 1), (1, 2), (2, 3)) for p in range(n) if s or q % 3]
    variants += [(50, 1, 0, None), (51, 1, 0, refs[2][1]), (51, 1, 1, refs[3][1]), (52, 0, 0, None), (52, 2, 0, refs[1][1])]
    df = spark.createDataFrame(variants, "query_id long, stage int, place int, vector array<double>")
    table = spark.createDataFrame(refs, "ref_id long, vector array<double>")
    got = {r.query_id: (r.stage, r.place, r.ref_id, r.score, r.tried) for r in search.staged_search(df, table, 0.9, 0.8).collect()}
    want = brute_stages(variants, refs, 0.9, 0.8)
    assert got == want and 50 not in got and {v[0] for v in want.values()} == {0, 1, 2}
    everything = sum(len([v for v in variants if v[0] == q and v[3] is not None]) for q in want)
    assert sum(v[4] for v in want.values()) < everything
    assert search.staged_search(df.limit(0), table).collect() == []


def measured(seed=6):
    rng, rows = random.Random(seed), []
    for track in range(4):
        t, source = 0.0, "a"
        for seq in range(120):
            t += rng.choice([0.0, 0.05, 0.1, 0.4, 0.7])
            source = rng.choice(["a", "b", None]) if rng.random() < 0.08 else source
            kind = rng.choice(["flow", "flow", "flow", "fix", "frame"])
            rows.append((track, seq, round(t, 3), kind, rng.uniform(0, 9), rng.uniform(0, 9), rng.choice([None, rng.random()]), rng.choice([True, False, None]), source))
    return rows


def walked(rows, stale=0.5):
    out, state = {}, {}
    for track, seq, t, kind, x, y, q, accepted, source in sorted(rows, key=lambda r: r[:2]):
        s = state.setdefault(track, {"source": source, "samples": [], "low": 1.0, "n": 0})
        if s["source"] != source:
            s.update(source=source, samples=[], low=1.0, n=0)
        at = (None, None)
        if s["samples"] and t - s["samples"][-1][0] <= stale:
            at = s["samples"][-1][1:]
            if len(s["samples"]) > 1 and s["samples"][-1][0] - s["samples"][-2][0] > 1e-6:
                (a, *p), (b, *r) = s["samples"][-2:]
                at = tuple(v + (v - u) / (b - a) * (t - b) for u, v in zip(p, r, strict=True))
        out[track, seq] = (*at, s["n"], s["low"])
        if kind == "flow":
            s.update(samples=[*s["samples"], (t, x, y)], n=s["n"] + 1, low=min(s["low"], 1.0 if q is None else q))
        elif kind == "fix" and accepted:
            s.update(samples=[], low=1.0, n=0)
    return out


def same_flow(rows, want):
    got = {(r.track_id, r.seq): (r.flow_x, r.flow_y, r.flow_n, r.flow_quality) for r in rows}
    assert got.keys() == want.keys()
    for k, w in want.items():
        assert got[k][2:] == w[2:] and [v is None for v in got[k]] == [v is None for v in w]
        assert all(a is None or abs(a - b) < 1e-9 for a, b in zip(got[k][:2], w[:2], strict=True))


def drain(spark, df, name):
    query = df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    return spark.table(name).collect()


def parts(spark, df, folder, cuts):
    """df as files by ranges of seq, so that a stream of one file a batch gets them in order."""
    for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
        df.where(F.col("seq").between(a, b - 1)).coalesce(1).write.mode("append").parquet(f"{folder}/p{i}")
    schema = df.schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(folder))


def test_flow_in_a_table_and_in_a_stream(spark, tmp_path):
    rows = measured()
    df = spark.createDataFrame(rows, places.MEASURED)
    want = walked(rows)
    assert {w[0] is None for w in want.values()} == {True, False}
    same_flow(flow.extrapolate(df.repartition(3)).collect(), want)
    assert flow.extrapolate(df.limit(0)).collect() == []
    same_flow(drain(spark, places.flow_stream(parts(spark, df, tmp_path / "flow", [0, 30, 31, 90, 120])), "flows"), want)


def test_activation_in_a_stream_equals_the_join(spark, tmp_path):
    rng = random.Random(3)
    boxes = spark.createDataFrame([("n0", 0.0, 0.0, 5.0, 5.0), ("n1", 3.0, 3.0, 9.0, 9.0), ("n2", 20.0, 20.0, 21.0, 21.0)],
                                  "source_id string, lat_min double, lon_min double, lat_max double, lon_max double")
    rows = [(t, k, rng.uniform(0, 12), rng.uniform(0, 12)) for t in range(3) for k in range(50)] + [(1, 60, None, None)]
    df = spark.createDataFrame(rows, "track_id long, seq long, lat double, lon double")
    held = spatial.active_sources(df, boxes).groupBy("track_id", "seq").agg(F.sort_array(F.collect_list("source_id")).alias("s")).collect()
    active = {(r.track_id, r.seq): r.s for r in held}
    want, last = {}, {}
    for t, k, *_ in sorted(rows, key=lambda r: r[:2]):
        now = active.get((t, k), [])
        if t not in last or now != last[t]:
            want[t, k] = now
        last[t] = now
    got = drain(spark, places.activation_stream(parts(spark, df, tmp_path / "places", [0, 7, 20, 61]), boxes), "activations")
    assert {(r.track_id, r.seq): r.active for r in got} == want and 3 < len(want) < len(rows) and [] in want.values()
