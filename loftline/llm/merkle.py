"""Merkle manifest of a dataset: a tree for each source, one over the sources, and an authentication path for every row.

The leaves of a source are cut into aligned blocks of ARITY ** HEIGHT. A block is traversed as in fractal tree
traversal: for each level there is one existing subtree, whose nodes lie beside the present path, and one desired subtree
to its right that takes one leaf a step and is whole when the path enters it. So successive paths need the leaves'
digests of one block and about 2 * HEIGHT * ARITY nodes. What lies above a block is a tree of block roots, made and
traversed in the same way; its paths are made first and are appended to those of the leaves.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import ascii_lower, cut, small, table

ARITY, HEIGHT = 16, 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: A path has one of these for each level: the node's place in its run and the digests of the run's others.
PATH = "array<struct<place: int, others: string>>"
_PATH_ARROW = pa.list_(pa.struct([("place", pa.int32()), ("others", pa.string())]))


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def height_of(n: int) -> int:
    """Levels between n nodes and the one that is left."""
    h = 0
    while n > 1:
        n, h = -(-n // ARITY), h + 1
    return h


class _Desired:
    """The nodes of one level over leaves that come one at a time; open runs lie in a stack."""

    def __init__(self, level: int):
        self.nodes: list[str] = []
        self.stack: list[list[str]] = [[] for _ in range(level)]

    def push(self, node: str) -> None:
        for run in self.stack:
            run.append(node)
            if len(run) < ARITY:
                return
            node = digest("".join(run))
            run.clear()
        self.nodes.append(node)

    def whole(self) -> list[str]:
        """All nodes, the last of which may stand over fewer leaves."""
        for k, run in enumerate(self.stack):
            if run:
                node = digest("".join(run))
                run.clear()
                (self.stack[k + 1] if k + 1 < len(self.stack) else self.nodes).append(node)
                # A run that this fills is closed in its own turn.
        return self.nodes


def block_root(leaves: list[str], height: int) -> str:
    top = _Desired(height)
    for leaf in leaves:
        top.push(leaf)
    return top.whole()[0]


def block_paths(leaves: list[str], height: int) -> Iterator[list[tuple[int, str]]]:
    """For each leaf, in order, its place and the digests of the others of its run at each level, from below."""
    n, spans = len(leaves), [ARITY ** (k + 1) for k in range(height)]
    exist, desired = [], [_Desired(k) for k in range(height)]
    for k, span in enumerate(spans):
        first = _Desired(k)
        for leaf in leaves[:span]:
            first.push(leaf)
        exist.append("".join(first.whole()))
    path: list[tuple[int, str]] = [(0, "")] * height
    for j in range(n):
        for k, span in enumerate(spans):
            if j % (span // ARITY):
                break  # this level's node and all above it stay
            if j and j % span == 0:
                exist[k] = "".join(desired[k].whole())
                desired[k] = _Desired(k)
            place = j // (span // ARITY) % ARITY
            path[k] = (place, exist[k][: 64 * place] + exist[k][64 * place + 64 :])
        for k, span in enumerate(spans):
            if j + span < n:
                desired[k].push(leaves[j + span])
        yield list(path)


def fold(node: str, path: list[tuple[int, str]]) -> str:
    """The root that a node and its path lead to."""
    for place, others in path:
        node = digest(others[: 64 * place] + node + others[64 * place :])
    return node


def leaf_digest(columns: list[Column]) -> Column:
    """sha256 of the values, each with its length in bytes before it, or - if it is null."""
    parts = [F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in (c.cast("string") for c in columns)]
    return F.sha2(F.concat(*parts), 256)


def placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows (checkpointed) with place, their number from 0 in their tree by `order`, and n, the number of the tree's rows.

    Rows are range-partitioned by tree and order. Those of a tree lie one after the other in a partition, so
    their places follow from row numbers and the counts of a tree in earlier partitions: one row for each
    tree and each border between partitions.
    """
    rows = cut(rows.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order))
    rows = rows.withColumn("__at", F.monotonically_increasing_id()).withColumn("__part", F.shiftright("__at", 33))
    runs = cut(rows.groupBy("__part", "tree").agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__count")))
    tree = W.partitionBy("tree")
    before = tree.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    runs = runs.select(
        "__part", "tree", (F.coalesce(F.sum("__count").over(before), F.lit(0)) - F.col("__first")).alias("__shift"),
        F.sum("__count").over(tree).alias("n"),
    )
    found = rows.join(small(cut(runs)), ["__part", "tree"])
    return found.withColumn("place", F.col("__at") + F.col("__shift")).drop("__at", "__part", "__shift")


def _block(height: int) -> Column:
    return F.floor(F.col("place") / ARITY**height).cast("long").alias("block")


def _blocks(n: str, height: int) -> Column:
    """How many blocks n rows have."""
    return F.ceil(F.col(n) / ARITY**height).cast("long").alias(n)


def _leaves(group: pa.Table, height: int) -> tuple[pa.Table, list[str], int]:
    """A block's rows in order, their digests and the levels inside the block."""
    group = group.sort_by("place")
    n = group.column("n")[0].as_py()
    return group, group.column("node").to_pylist(), height if n > ARITY**height else height_of(n)


def block_roots(nodes: DataFrame, height: int = HEIGHT) -> DataFrame:
    """(tree, block, root, n) of nodes (tree, place, n, node): all of a block of leaves or of block roots."""

    def run(group: pa.Table) -> pa.Table:
        group, leaves, levels = _leaves(group, height)
        one = group.select(["tree", "block", "n"]).slice(0, 1)
        return one.append_column("root", pa.array([block_root(leaves, levels)]))

    rows = nodes.select("tree", _block(height), "place", "n", "node")
    return rows.groupBy("tree", "block").applyInArrow(run, "tree string, block bigint, n bigint, root string")


def paths(nodes: DataFrame, height: int = HEIGHT) -> tuple[DataFrame, DataFrame]:
    """The paths (tree, place, path) of nodes (tree, place, n, node; checkpointed) and the roots (tree, root) of their trees.

    A tree of more than one block is traversed above first. The table of block roots is smaller by 4,096 at each
    step, so 10 ** 10 nodes take three.
    """
    upper, tops = _above(cut(block_roots(nodes, height)), height)

    def run(group: pa.Table, over: pa.Table) -> pa.Table:
        group, leaves, levels = _leaves(group, height)
        above = [(p["place"], p["others"]) for p in over.column("above")[0].as_py()]
        found = [[{"place": p, "others": o} for p, o in path + above] for path in block_paths(leaves, levels)]
        return pa.table([group.column("tree"), group.column("place"), pa.array(found, _PATH_ARROW)], names=["tree", "place", "path"])

    rows = nodes.select("tree", _block(height), "place", "n", "node")
    found = rows.groupBy("tree", "block").cogroup(upper.groupBy("tree", "block"))
    return found.applyInArrow(run, f"tree string, place bigint, path {PATH}"), tops


def _above(roots: DataFrame, height: int) -> tuple[DataFrame, DataFrame]:
    """The paths (tree, block, above) of block roots and the roots (tree, root) of their trees."""
    alone = F.col("n") <= ARITY**height
    upper = roots.where(alone).select("tree", "block", F.array().cast(PATH).alias("above"))
    tops = roots.where(alone).select("tree", "root")
    more = roots.where(~alone)
    if more.isEmpty():
        return upper, tops
    nodes = more.select("tree", F.col("block").alias("place"), _blocks("n", height), F.col("root").alias("node"))
    above, higher = paths(cut(nodes), height)
    return upper.unionByName(above.select("tree", F.col("place").alias("block"), F.col("path").alias("above"))), tops.unionByName(higher)


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, whole_paths: bool = True, claimed: Column | None = None, height: int = HEIGHT) -> DataFrame:
    """One row per row of docs: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified and, if asked for, path.

    The leaf is the digest of the fields, of which the first is the id and the second the source. `claimed` is the digest
    that is checked against the manifest (the leaf, where it is null); folded_root is what it and the path lead to.
    path has the place and the digests of the others of each run from the leaf to the root. Sources are ordered with
    null first, leaves of a source by id with null first, then by digest, so rows that are repeated have places side by side.
    A null in any field is a value of its own. A source of one row has its leaf as subroot, and a single source its subroot
    as root. Texts of any length are hashed whole. Other columns are not looked at; no rows give no rows.
    """
    key, source = fields[0], fields[1]
    leaf = leaf_digest([F.col(f) for f in fields])
    # Null comes before all strings, the empty one included.
    tree = F.coalesce(F.concat(F.lit("s"), F.col(source).cast("string")), F.lit("-"))
    rows = docs.select(F.col(key).alias("doc_id"), tree.alias("tree"), leaf.alias("node"), (leaf if claimed is None else F.coalesce(claimed, leaf)).alias("claimed"))
    rows = cut(placed(rows, ["doc_id", "node"]))
    # The trees above the blocks of each source, then the tree of the sources.
    inside, subroots = _above(cut(block_roots(rows, height)), height)
    sources = subroots.select(F.lit("").alias("tree"), F.col("tree").alias("source"), F.col("root").alias("node"))
    sources = cut(placed(sources, ["source"]))
    over, top = paths(sources, height)
    root = top.select("root").limit(1)
    named = sources.select("place", "source", "node").join(over.select("place", "path"), "place")
    named = named.select(F.col("source").alias("tree"), F.col("node").alias("subroot"), "path").crossJoin(F.broadcast(root))  # one row
    upper = inside.join(small(cut(named)), "tree").select("tree", "block", F.concat("above", "path").alias("above"), "subroot", "root")

    kind = rows.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", *["path"] * whole_paths]
    schema = f"doc_id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string" + f", path {PATH}" * whole_paths

    def run(group: pa.Table, over: pa.Table) -> pa.Table:
        group, leaves, levels = _leaves(group, height)
        above = [(p["place"], p["others"]) for p in over.column("above")[0].as_py()]
        beyond = "".join(others for _, others in above)
        proofs, roots, found = [], [], []
        for claim, path in zip(group.column("claimed").to_pylist(), block_paths(leaves, levels), strict=True):
            proofs.append(digest("".join([others for _, others in path]) + beyond))
            roots.append(fold(claim, path + above))
            if whole_paths:
                found.append([{"place": p, "others": o} for p, o in path + above])
        once = [pa.repeat(over.column(c)[0].as_py(), len(leaves)) for c in ("subroot", "root")]
        columns = [group.column("doc_id"), group.column("node"), *once, pa.array(proofs), pa.array(roots)]
        return pa.table(columns + [pa.array(found, _PATH_ARROW)] * whole_paths, names=names)

    blocked = rows.select("tree", _block(height), "place", "n", "node", "claimed", "doc_id")
    out = blocked.groupBy("tree", "block").cogroup(upper.groupBy("tree", "block")).applyInArrow(run, schema)
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def tampered(docs: DataFrame, fields: tuple[str, ...] = FIELDS) -> Column:
    """The digest of a row whose text was lower-cased, where 5 divides the id's crc32; null elsewhere and for a null id."""
    changed = [ascii_lower(F.col(f)) if f == "text" else F.col(f) for f in fields]
    return F.when(F.crc32(F.col(fields[0]).cast("string").cast("binary")) % 5 == 0, leaf_digest(changed))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves, roots and digests of the paths of all documents, a fifth of which are checked with a changed text."""
    docs = table(spark, sf_dir, "documents")
    return manifest(docs, whole_paths=False, claimed=tampered(docs))


_CRC32 = """xor(4294967295, list_reduce(list_prepend(4294967295::bigint, list_transform(string_split({0}, ''), lambda c: ascii(c)::bigint)),
  lambda a, b: list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]::bigint[]), lambda r, z: xor(r >> 1, 3988292384 * (r & 1)))))"""
_FIELD = "coalesce(octet_length(encode({0}::varchar))::varchar || ':' || {0}::varchar, '-')"
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _climb_sql(name: str, leaves: str, levels: int = 6) -> str:
    """CTEs of the levels {name}0.. of leaves (s, p, d) and of the runs {name}_run0.. between them."""
    parts = [f"{name}0 as (select s, p, d, count(*) over (partition by s) as n from {leaves})"]
    for k in range(levels):
        parts.append(f"{name}_run{k} as (select s, p // {ARITY} as p, string_agg(d, '' order by p) as run from {name}{k} where n > 1 group by s, p // {ARITY})")
        parts.append(
            f"{name}{k + 1} as (select s, p, sha256(run) as d, count(*) over (partition by s) as n from {name}_run{k} union all select s, p, d, n from {name}{k} where n = 1)"
        )
    return ",\n ".join(parts)


def _fold_sql(name: str, tree: str, rows: str, levels: int = 6) -> str:
    """CTEs {name}0.. that lead rows (s, p, f, proof and others in q) up the levels of a tree."""
    parts = [f"{name}0 as (select * from {rows})"]
    for k in range(levels):
        left, right = f"left(r.run, (64 * (c.p % {ARITY}))::int)", f"substr(r.run, (64 * (c.p % {ARITY}) + 65)::int)"
        parts.append(
            f"{name}{k + 1} as (select c.s, c.p // {ARITY} as p, case when r.run is null then c.f else sha256({left} || c.f || {right}) end as f, "
            f"c.proof || coalesce({left} || {right}, '') as proof, c.q from {name}{k} c left join {tree}_run{k} r on r.s = c.s and r.p = c.p // {ARITY})"
        )
    return ",\n ".join(parts)


SQL = {
    "op11_merkle_manifest": f"""
with hashed as (select doc_id, coalesce('s' || source, '-') as s, sha256({" || ".join(_FIELD.format(f) for f in FIELDS)}) as d,
   case when {_CRC32.format("doc_id::varchar")} % 5 = 0 then sha256({" || ".join(_FIELD.format(_LOWER if f == "text" else f) for f in FIELDS)}) end as changed from documents),
 leaves as (select *, row_number() over (partition by s order by doc_id nulls first, d) - 1 as p from hashed),
 {_climb_sql("t", "leaves")},
 subroots as (select '' as s, row_number() over (order by s) - 1 as p, d, s as tree from t6),
 {_climb_sql("u", "subroots")},
 start as (select s, p, coalesce(changed, d) as f, '' as proof, struct_pack(doc_id := doc_id, leaf := d) as q from leaves),
 {_fold_sql("c", "t", "start")},
 middle as (select '' as s, r.p, c.f, c.proof, struct_pack(doc_id := c.q.doc_id, leaf := c.q.leaf, subroot := r.d) as q from c6 c join subroots r on r.tree = c.s),
 {_fold_sql("e", "u", "middle")}
select e.q.doc_id as doc_id, e.q.leaf as leaf, e.q.subroot as subroot, u6.d as root, sha256(e.proof) as proof_sha256, e.f as folded_root, e.f = u6.d as verified
from e6 e cross join u6
"""
}
