"""Pose graphs packed in a row for each component, so that what is done in rounds needs no further shuffle: annealing of whole components in tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bands import anneal_parts

#: What a packed row has by node and by edge, numbers of a pose or a step one after the other; off: residuals of its spatial edges by unit of weight.
NODE = {"node": "bigint", "pose": "double", "start": "double", "is_anchor": "boolean"}
EDGE = {"edge_id": "bigint", "from_id": "bigint", "to_id": "bigint", "step": "double", "weight": "double", "edge_type": "string"}
PACKED = "component bigint, open boolean, cost double, " + ", ".join(f"{n} array<{t}>" for n, t in (NODE | EDGE | {"off": "double"}).items())
NOBODY = np.iinfo(np.int64).min
#: About how many nodes a call of a task packs, and the most of a component that is packed.
WHOLE = 16384


def _whole(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Ids as numbers, with NOBODY for null."""
    return pc.fill_null(column, NOBODY).to_numpy(zero_copy_only=False) if isinstance(column, pa.Array) else pc.fill_null(column, NOBODY).to_numpy()


def _numbers(part: np.ndarray, node: np.ndarray, of: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Numbers of the nodes that edges of parts name; -1 for none. Nodes come by part and id."""
    if not len(node):
        return np.full(len(ids), -1)
    known = np.unique(node)
    rank = np.minimum(np.searchsorted(known, ids), len(known) - 1)
    key, asked = part * len(known) + np.searchsorted(known, node), of * len(known) + rank
    at = np.minimum(np.searchsorted(key, asked), len(key) - 1)
    return np.where((known[rank] == ids) & (key[at] == asked), at, -1)


def _lists(values: pa.Array | np.ndarray, counts: np.ndarray) -> pa.ListArray:
    values = values.combine_chunks() if isinstance(values, pa.ChunkedArray) else values
    values = pa.concat_arrays(values.chunks) if isinstance(values, pa.ChunkedArray) else pa.array(values) if isinstance(values, np.ndarray) else values
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), values)


def _packer(pose: list[str], start: list[str], step: list[str], most: int, alone: Callable, cx: float, sign: float, robust: float | None) -> Callable:
    def pack(nodes: pa.Table, edges: pa.Table) -> pa.Table:
        """The first solution of all components of a bundle, packed. Those that are left open have no nodes and edges."""
        own, of = _whole(nodes["component"]), _whole(edges["component"])
        parts = np.unique(np.concatenate([own, of]))
        part, node = np.searchsorted(parts, own), _whole(nodes["node"])
        turn = np.lexsort((node, part))
        first = np.ones(len(turn), bool)
        first[1:] = (part[turn][1:] != part[turn][:-1]) | (node[turn][1:] != node[turn][:-1])
        turn = turn[first]
        part, node, nodes = part[turn], node[turn], nodes.take(pa.array(turn))
        turn = np.lexsort((_whole(edges["edge_id"]), of))
        edges, of = edges.take(pa.array(turn)), np.searchsorted(parts, of[turn])
        poses, starts, steps = (np.stack([t[n].to_numpy() for n in names], 1).astype(float) for t, names in ((nodes, pose), (nodes, start), (edges, step)))
        anchored = pc.fill_null(nodes["is_anchor"], False).to_numpy()
        found, cost, _, off, left = _solved(part, node, poses, starts, anchored, of, edges, steps, [None], len(parts), most, alone, cx, sign, robust)
        keep_n, keep_e = np.flatnonzero(~left[part]), np.flatnonzero(~left[of])
        sizes, links = np.bincount(part[keep_n], minlength=len(parts)), np.bincount(of[keep_e], minlength=len(parts))
        weight = edges["weight"].to_numpy()
        counts = _spatial(edges["edge_type"]) & (weight > 1e-12) & ~np.isnan(off) & ~left[of]
        columns = {
            "component": pa.array(parts, mask=parts == NOBODY), "open": pa.array(left), "cost": pa.array(cost),
            "node": _lists(node[keep_n], sizes), "pose": _lists(found[keep_n].ravel(), sizes * 5), "start": _lists(starts[keep_n].ravel(), sizes * 5),
            "is_anchor": _lists(anchored[keep_n], sizes),
            "step": _lists(steps[keep_e].ravel(), links * 5), "off": _lists(off[counts], np.bincount(of[counts], minlength=len(parts))),
        }
        columns |= {n: _lists(edges[n].take(pa.array(keep_e)), links) for n in EDGE if n != "step"}
        return pa.table({n: columns[n] for n in ("component", "open", "cost", *NODE, *EDGE, "off")})

    return pack


def _spatial(kinds: pa.Array | pa.ChunkedArray) -> np.ndarray:
    same = pc.fill_null(pc.equal(kinds, "spatial"), False)
    return same.to_numpy(zero_copy_only=False) if isinstance(same, pa.Array) else same.to_numpy()


def _solved(part, node, poses, starts, anchored, of, edges, steps, bounds, count, most, alone, cx, sign, robust) -> tuple:
    """anneal_parts over the edges whose nodes are there; the others have factor 1 and no residual."""
    weight = edges["weight"].to_numpy(zero_copy_only=False) if isinstance(edges["weight"], pa.Array) else edges["weight"].to_numpy()
    i, j = (_numbers(part, node, of, _whole(edges[c])) for c in ("from_id", "to_id"))
    has = np.flatnonzero((i >= 0) & (j >= 0))
    factor, off = np.ones(len(of)), np.full(len(of), np.nan)
    spatial = _spatial(edges["edge_type"])
    found, cost, factor[has], off[has], left = anneal_parts(
        part, poses, starts, anchored, of[has], i[has], j[has], steps[has], weight[has], spatial[has], bounds, cx, sign, robust, alone, most, count
    )
    return found, cost, factor, off, left


def _tasks(rows: DataFrame, total: int) -> int:
    """By nodes, as a task's work is that much more than its bytes tell."""
    return min(total // WHOLE + 1, total // (4 * WHOLE) + rows.sparkSession.sparkContext.defaultParallelism)


def pack(
    nodes: DataFrame, edges: DataFrame, total: int, pose: list[str], start: list[str], step: list[str], most: int, alone: Callable, cx: float, sign: float, robust: float | None
) -> DataFrame:
    """Rows (PACKED) of all components with their first solution; `open` are those of more than `most` nodes that fit no grid. total: about how many nodes there are."""
    bundle = F.pmod(F.xxhash64("component"), F.lit(total // WHOLE + 1)).alias("bundle")
    own = nodes.where("component is not null and node is not null").select("component", "node", *dict.fromkeys([*pose, *start]), "is_anchor", bundle)
    links = edges.select("component", *[c for n in EDGE for c in (step if n == "step" else [n])], bundle)
    own, links = (rows.repartition(_tasks(rows, total), "bundle") for rows in (own, links))
    return own.groupBy("bundle").cogroup(links.groupBy("bundle")).applyInArrow(_packer(pose, start, step, most, alone, cx, sign, robust), PACKED)


def unpack(packed: DataFrame, total: int, pose: list[str], step: list[str], bounds: list[float], alone: Callable, cx: float, sign: float, robust: float | None) -> DataFrame:
    """A row for each node (component, node, pose, cost) and each edge (is_edge; component, what it has, factor) after a solution for each of `bounds`."""
    names = {"is_edge": "boolean", "component": "bigint", "node": "bigint", **dict.fromkeys(pose, "double"), "cost": "double"}
    names |= {c: t for n, t in EDGE.items() for c in (step if n == "step" else [n])} | {"factor": "double"}

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            table = {n: batch[n].flatten() for n in (*NODE, *EDGE)}
            sizes, links = (pc.list_value_length(batch[n]).to_numpy(zero_copy_only=False) for n in ("node", "edge_id"))
            part, of = np.repeat(np.arange(batch.num_rows), sizes), np.repeat(np.arange(batch.num_rows), links)
            poses, starts, steps = (table[n].to_numpy(zero_copy_only=False).reshape(-1, 5) for n in ("pose", "start", "step"))
            node, cost, factor = _whole(table["node"]), batch["cost"].to_numpy(zero_copy_only=False), np.ones(len(of))
            if bounds:
                anchored = table["is_anchor"].to_numpy(zero_copy_only=False)
                poses, cost, factor, _, _ = _solved(part, node, poses, starts, anchored, of, table, steps, bounds, batch.num_rows, WHOLE, alone, cx, sign, robust)
            component = batch["component"]
            here = {"is_edge": pa.array(np.zeros(len(part), bool)), "component": component.take(pa.array(part)), "node": table["node"], "cost": pa.array(cost[part], from_pandas=True)}
            here |= {n: pa.array(poses[:, k], from_pandas=True) for k, n in enumerate(pose)}
            yield _filled(here, names, len(part))
            there = {"is_edge": pa.array(np.ones(len(of), bool)), "component": component.take(pa.array(of)), "factor": pa.array(factor)}
            there |= {n: table[n] for n in EDGE if n != "step"} | {n: pa.array(steps[:, k], from_pandas=True) for k, n in enumerate(step)}
            yield _filled(there, names, len(of))

    return packed.repartition(_tasks(packed, total), "component").mapInArrow(rows, ", ".join(f"{n} {t}" for n, t in names.items()))


def _filled(columns: dict, names: dict[str, str], n: int) -> pa.RecordBatch:
    kinds = {"boolean": pa.bool_(), "bigint": pa.int64(), "double": pa.float64(), "string": pa.string()}
    return pa.RecordBatch.from_pydict({c: columns[c] if c in columns else pa.nulls(n, kinds[t]) for c, t in names.items()})
