import random

from loftline.llm import components as C


def brute(edges):
    root = {x: x for e in edges for x in e}
    while moved := [(u, v) for u, v in edges if root[u] != root[v]]:
        for u, v in moved:
            root[u] = root[v] = min(root[u], root[v])
    return {x: r for x, r in root.items() if any(x in e and e[0] != e[1] for e in edges)}


def test_random_graphs(spark):
    draw = random.Random(3)
    chain = [(i, i + 1) for i in range(40)]
    for edges in (chain, [(0, i) for i in range(1, 30)], [(draw.randrange(90), draw.randrange(90)) for _ in range(70)], [(1, 1), (2, 3), (3, 2), (2, 3)]):
        rows = C.components(spark.createDataFrame(edges, "u long, v long").repartition(5)).collect()
        assert len(rows) == len({r.node for r in rows})
        assert {r.node: r.root for r in rows} == brute(edges)
    assert C.components(spark.createDataFrame([], "u long, v long")).collect() == []


def test_several_partitions_agree(spark, monkeypatch):
    monkeypatch.setattr(C, "BROADCAST_ROWS", 7)
    edges = [(i, i + 1 + i % 3) for i in range(60)]
    assert {r.node: r.root for r in C.components(spark.createDataFrame(edges, "u long, v long")).collect()} == brute(edges)


def test_rounds_of_a_small_table_are_not_shuffled(spark, monkeypatch):
    """Unions hid that their sides are one partition, and a round's result was no longer taken as one, so each dealt a small table out to all partitions."""
    seen, cut = [], C.cut
    monkeypatch.setattr(C, "cut", lambda df: (made := cut(df), seen.append(made.rdd.getNumPartitions()))[0])
    held = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "3"}
    was = {key: spark.conf.get(key) for key in held}
    try:
        for key, value in held.items():
            spark.conf.set(key, value)
        edges = [(i, i + 1) for i in range(40)]
        rows = C.components(spark.createDataFrame(edges, "u long, v long")).collect()
    finally:
        for key, value in was.items():
            spark.conf.set(key, value)
    assert {r.node: r.root for r in rows} == brute(edges)
    assert seen[0] == 3 and len(seen) > 1 and set(seen[1:]) == {1}
