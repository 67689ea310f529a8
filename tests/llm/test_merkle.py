"""Manifest against a plain build of the trees."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from loftline.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars int, text string, root string, tree int"


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row[:5]))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][i : i + 16])) for i in range(0, len(out[-1]), 16)])
    return out


def climb(tree, i):
    path = []
    for nodes in tree[:-1]:
        run = i // 16 * 16
        path.append((i - run, nodes[run : i] + nodes[i + 1 : run + 16]))
        i //= 16
    return path


def fold(node, path):
    for place, others in path:
        node = sha("".join(others[:place] + [node] + others[place:]))
    return node


def brute(rows):
    by = defaultdict(list)
    for r in rows:
        by[r[1]].append(r)
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: levels(sorted_leaves(by[s])) for s in order}
    top = levels([trees[s][-1][0] for s in order])
    out = []
    for k, s in enumerate(order):
        places = {}
        for i, r in enumerate(sorted(by[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))):
            places[i] = r
            path = climb(trees[s], i) + climb(top, k)
            claim = leaf(r)
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None:
                claim = leaf((*r[:4], "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r[4])))
            root = top[-1][0]
            proof = sha("".join(o for _, others in path for o in others))
            folded = fold(claim, path)
            out.append((r[0], leaf(r), trees[s][-1][0], root, proof, folded, folded == root))
    return sorted(out, key=str)


def sorted_leaves(rows):
    return [leaf(r) for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))]


def result(df):
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted([tuple(r[n] for n in names) for r in df.collect()], key=str)


def corpus(sizes, seed=1):
    rng, rows, n = random.Random(seed), [], 0
    for source, size in sizes.items():
        for _ in range(size):
            rows.append((n * 7 % 10007, source, rng.choice(["en", None, "de"]), rng.choice([None, 5]), rng.choice(["Ab c", "x y", None, "", "ÄB"]), "r", 1))
            n += 1
    rng.shuffle(rows)
    return rows


def run(spark, rows, **how):
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    return merkle.manifest(df, claimed=merkle.tampered(df), **how)


@pytest.mark.parametrize("sizes", [{"a": 1}, {"a": 16, None: 17}, {"b": 300, "": 1, "Z": 2, None: 40}, {"big": 4097, "x": 4096, None: 5}, {f"s{i}": 1 + i % 3 for i in range(40)}])
def test_manifest_matches_brute_force(spark, sizes):
    rows = corpus(sizes)
    assert result(run(spark, rows, whole_paths=False)) == brute(rows)


def test_stacked_block_levels(spark):
    """Smaller blocks make trees of blocks over trees of blocks."""
    rows = corpus({"a": 300, None: 4100, **{f"s{i:03d}": 1 for i in range(290)}})
    assert result(run(spark, rows, whole_paths=False, height=1)) == brute(rows)


def test_paths_lead_to_the_root(spark):
    rows = corpus({"a": 50, None: 3})
    for r in run(spark, rows).collect():
        path = [(p.place, p.others) for p in r.path]
        assert merkle.fold(r.leaf, path) == r.root
        assert sha("".join(o for _, o in path)) == r.proof_sha256


def test_repeated_rows_null_ids_and_no_rows(spark):
    rows = [(None, None, None, None, None, "r", 1)] * 3 + [(4, "s", "en", 2, "Q" * 300_000, "r", 1)] * 2 + [(None, "s", "en", 2, "a", "r", 1)]
    assert result(run(spark, rows, whole_paths=False)) == brute(rows)
    assert run(spark, [], whole_paths=True).collect() == []


def test_successive_paths_are_those_of_the_whole_tree():
    for n in (1, 2, 15, 16, 17, 255, 256, 257, 700, 4095, 4096):
        leaves = [sha(str(i)) for i in range(n)]
        tree = levels(leaves)
        height = merkle.height_of(n)
        assert merkle.block_root(leaves, height) == tree[-1][0]
        for i, path in enumerate(merkle.block_paths(leaves, height)):
            assert path == [(p, "".join(o)) for p, o in climb(tree, i)]


def test_other_fields(spark):
    df = spark.createDataFrame([(1, "k", "v"), (2, "k", None)], "key int, part string, value string")
    got = merkle.manifest(df, fields=("key", "part", "value"), claimed=F.lit(None).cast("string")).collect()
    assert all(r.verified for r in got) and {r.leaf for r in got} == {sha("1:11:k1:v"), sha("1:21:k-")}
