import random

from pyspark.sql import functions as F

from loftline.llm import url_filter as U


def test_hosts(spark):
    urls = ["HTTP://User:pw@Ex.Com.:80/a?b#c", "https://[::1]:8/x", "ftp://a", "nonsense", "", None, "http:///x", "https://1.2.3.4/"]
    got = [r.h for r in spark.createDataFrame([(u,) for u in urls], "u string").select(U.host(F.col("u")).alias("h")).collect()]
    assert got == ["ex.com", "[::1]", "a", None, None, None, None, "1.2.3.4"]
    s = spark.createDataFrame([("a.b.c",), ("1.2.3.4",)], "h string").select(U.suffixes(F.col("h")).alias("s")).collect()
    assert [r.s for r in s] == [["a.b.c", "b.c", "c"], ["1.2.3.4"]]


def brute(captures, entries):
    out = []
    for i, h, t in captures:
        best = None
        for d, c in {(d, c) for d, c, _, _ in entries if d and c}:
            if h is None or t is None or not (h == d or h.endswith("." + d)):
                continue
            known = sorted({(at, a == "remove") for dd, cc, a, at in entries if (dd, cc) == (d, c) and a and at is not None and at <= t})
            if known and not known[-1][1]:
                best = max(best or (), (len(d), c == "allow", known[-1][0], c, d))
        out.append((i, best and best[4], best and best[3], best and best[2]))
    return sorted(out, key=str)


def test_as_of_join_matches_brute_force(spark):
    rng = random.Random(7)
    domains = ["com", "x.com", "a.x.com", "b.x.com", "y.org"]
    month = U.BUCKET
    entries = [(rng.choice(domains), rng.choice(["block", "allow"]), rng.choice(["add", "add", "remove"]), rng.randrange(0, 6 * month, month // 7)) for _ in range(60)]
    entries += [(None, "block", "add", 1), ("com", None, "add", 1), ("com", "block", None, 1), ("com", "block", "add", None)]
    hosts = ["a.x.com", "b.x.com", "q.b.x.com", "y.org", "z.net", None]
    captures = [(i, rng.choice(hosts), rng.randrange(0, 8 * month, month // 7)) for i in range(200)] + [(500, "x.com", None), (None, "y.org", month), (None, "y.org", month)]
    c = spark.createDataFrame([(*r, "old") for r in captures], "page_id long, host string, fetched_at long, category string")
    e = spark.createDataFrame(entries, "domain string, category string, action string, listed_at long")
    got = U.active_entries(c, U.validity(e))
    assert sorted([(r.page_id, r.matched_domain, r.category, r.listed_at) for r in got.collect()], key=str) == brute(captures, entries)
    assert U.active_entries(c.limit(0), U.validity(e)).collect() == []
    assert {r.matched_domain for r in U.active_entries(c, U.validity(e.limit(0))).collect()} == {None}
