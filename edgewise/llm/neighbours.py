"""Approximate nearest neighbours by inner product on robust-pruned directed graphs.

Rows are dealt to shards by a hash of their id, so that shards are even
whatever the vectors are. A task builds the graph of one shard: points are
inserted in growing batches; a greedy beam search on the graph so far proposes
neighbours, and pruning with a relaxed distance keeps those of diverse
directions. The index is a written table with one row a node. Beam search then
queries every shard, block of queries by block, and scores what it finds in
double precision on the original vectors.

Inner products become distances on a sphere: each vector gets one more
coordinate that fills its length up to the shard's greatest, a query gets 0.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

#: Edges of a node, width of the search that proposes them, factor by which a kept neighbour must be nearer to a candidate than the node is to drop it.
DEGREE, BUILD_BEAM, ALPHA = 32, 64, 1.2
#: Width of the beam that queries a shard, nodes expanded at a step.
BEAM, EXPAND = 64, 4
#: A shard has this many times the root of all rows, and SHARD_LEAST at least: shards and their size grow alike.
SHARD_FACTOR, SHARD_LEAST = 16, 1024
#: Queries of one search task; points inserted together; cells of a batch's table of seen nodes.
QUERY_BLOCK, BATCH, SEEN_CELLS = 20_000, 512, 8_000_000
#: Extra random starting nodes beside the most central one.
STARTS = 15


def usable(vector: Column) -> Column:
    """True for vectors that are not null, zero or empty and have no null or non-finite component."""
    odd = F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(math.inf)))
    return F.coalesce(~odd & F.exists(vector, lambda c: c != 0), F.lit(False))


def on_sphere(vectors: np.ndarray) -> np.ndarray:
    """Vectors over the greatest length, with one more coordinate that makes all lengths 1."""
    scaled = vectors / np.abs(vectors).max()
    norms = np.einsum("ij,ij->i", scaled, scaled)
    most = norms.max()
    return np.column_stack([scaled / math.sqrt(most), np.sqrt(np.maximum(0.0, 1.0 - norms / most))]).astype(np.float32)


def beam_search(points: np.ndarray, graph: np.ndarray, starts: np.ndarray, queries: np.ndarray, width: int, expand: int = EXPAND) -> tuple[np.ndarray, np.ndarray]:
    """Per query the ``width`` best nodes found (-1: none) and their inner products, best first.

    All queries step together; at a step each expands its best ``expand`` nodes
    that are not expanded yet, and ends when its beam has none.
    """
    rows, nodes = len(queries), len(points)
    seen = np.full(rows * nodes, -1, dtype=np.int32)
    first = np.argsort(-(near := queries @ points[starts].T), axis=1, kind="stable")[:, :width]
    ids = np.full((rows, width), -1, dtype=np.int32)
    scores = np.full((rows, width), -np.inf, dtype=np.float32)
    ids[:, : first.shape[1]], scores[:, : first.shape[1]] = starts[first], np.take_along_axis(near, first, axis=1)
    seen.reshape(rows, nodes)[:, starts] = 0
    done = np.zeros((rows, width), dtype=bool)
    active = np.arange(rows)
    while len(active):
        fresh = (ids[active] >= 0) & ~done[active]
        chosen = fresh & (np.cumsum(fresh, axis=1) <= expand)
        live = chosen.any(axis=1)
        active, chosen = active[live], chosen[live]
        if not len(active):
            break
        at, slot = chosen.nonzero()
        done[active[at], slot] = True
        out = graph[ids[active[at], slot]]
        place = np.repeat(at, out.shape[1])
        out = out.ravel()
        real = out >= 0
        place, out = place[real], out[real]
        key = active[place].astype(np.int64) * nodes + out
        new = seen[key] < 0
        key, place, out = key[new], place[new], out[new]
        order = np.arange(len(key), dtype=np.int32)
        seen[key] = order  # of equal keys one stays
        new = seen[key] == order
        place, out = place[new], out[new]
        if not len(out):
            continue
        got = np.einsum("ij,ij->i", queries[active[place]], points[out])
        count = np.bincount(place, minlength=len(active))
        column = np.arange(len(place)) - np.repeat(np.cumsum(count) - count, count)
        wide = width + int(count.max())
        all_ids, all_scores, all_done = np.full((len(active), wide), -1, dtype=np.int32), np.full((len(active), wide), -np.inf, dtype=np.float32), np.zeros((len(active), wide), dtype=bool)
        all_ids[:, :width], all_scores[:, :width], all_done[:, :width] = ids[active], scores[active], done[active]
        all_ids[place, width + column], all_scores[place, width + column] = out, got
        best = np.argsort(-all_scores, axis=1, kind="stable")[:, :width]
        ids[active], scores[active], done[active] = (np.take_along_axis(x, best, axis=1) for x in (all_ids, all_scores, all_done))
    return ids, scores


def robust_prune(points: np.ndarray, nodes: np.ndarray, candidates: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Of each node's ``candidates`` (-1: none) up to ``degree``, nearest first; a kept one drops those it is ``alpha`` times nearer to than the node is."""
    near = np.einsum("ij,ikj->ik", points[nodes], points[candidates])
    odd = (candidates < 0) | (candidates == nodes[:, None])
    order = np.argsort(np.where(odd, np.inf, -near), axis=1, kind="stable")
    candidates, near, alive = (np.take_along_axis(x, order, axis=1) for x in (candidates, near, ~odd))
    alive[:, 1:] &= candidates[:, 1:] != candidates[:, :-1]  # equal nodes lie side by side unless others tie with them
    vectors = points[candidates]
    between = 1.0 - np.matmul(vectors, vectors.transpose(0, 2, 1))  # half the squared distances
    own, factor = 1.0 - near, alpha * alpha
    out, row = np.full((len(nodes), degree), -1, dtype=np.int32), np.arange(len(nodes))
    for k in range(degree):
        first = alive.argmax(axis=1)
        some = alive[row, first]
        if not some.any():
            break
        out[some, k] = candidates[row, first][some]
        alive &= (factor * between[row, first] > own) & (candidates != candidates[row, first][:, None])
    return out


def build_graph(points: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, alpha: float = ALPHA, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Neighbours of each node (-1: none) and the nodes that searches start from.

    ``points`` are distinct rows on the unit sphere. Up to ``beam`` nodes all are starts.
    """
    n, rng = len(points), np.random.default_rng(seed)
    order = rng.permutation(n).astype(np.int32)
    central = int((points @ points.mean(axis=0)).argmax())
    order = np.concatenate([[central], order[order != central]]).astype(np.int32)
    graph = np.full((n, degree), -1, dtype=np.int32)
    starts = np.arange(n, dtype=np.int32) if n <= beam else order[: STARTS + 1].copy()
    for again in (False, True):  # the second pass sees all points
        at = 0 if again else 1
        while at < n:
            batch = order[at : at + min(BATCH if again else at, BATCH, max(1, SEEN_CELLS // n))]
            here = starts if again or at >= len(starts) else order[:at]
            found, _ = beam_search(points, graph, here, points[batch], beam)
            graph[batch] = robust_prune(points, batch, np.concatenate([found, graph[batch]], axis=1), degree, alpha)
            _link_back(points, graph, batch, degree, alpha)
            at += len(batch)
    return graph, starts


def _link_back(points: np.ndarray, graph: np.ndarray, batch: np.ndarray, degree: int, alpha: float) -> None:
    """Add the reverse of the batch's edges; a node with too many is pruned, its nearest candidates first."""
    target, source = graph[batch].ravel(), np.repeat(batch, degree)
    target, source = target[target >= 0], source[target >= 0]
    new = ~(graph[target] == source[:, None]).any(axis=1)
    target, source = target[new], source[new]
    if not len(target):
        return
    near = np.einsum("ij,ij->i", points[target], points[source])
    order = np.lexsort((-near, target))
    target, source = target[order], source[order]
    nodes, begin, count = np.unique(target, return_index=True, return_counts=True)
    column = np.arange(len(target)) - np.repeat(begin, count)
    keep = column < 2 * degree
    wide = np.full((len(nodes), min(2 * degree, int(count.max()))), -1, dtype=np.int32)
    wide[np.repeat(np.arange(len(nodes)), count)[keep], column[keep]] = source[keep]
    have = (graph[nodes] >= 0).sum(axis=1)
    fits = have + count <= degree
    for k in np.flatnonzero(fits).tolist():
        graph[nodes[k], have[k] : have[k] + count[k]] = wide[k, : count[k]]
    if (~fits).any():
        full = nodes[~fits]
        for k in range(0, len(full), BATCH):
            part = full[k : k + BATCH]
            graph[part] = robust_prune(points, part, np.concatenate([graph[part], wide[~fits][k : k + BATCH]], axis=1), degree, alpha)


def _matrix(column: pa.ChunkedArray, rows: int) -> np.ndarray:
    """Rows of equal length as one array."""
    flat = column.combine_chunks()
    flat = flat.chunk(0) if isinstance(flat, pa.ChunkedArray) else flat
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)


def _lists(matrix: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    rows, width = matrix.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, rows * width + 1, width, dtype=np.int32)), pa.array(matrix.ravel(), type=kind))


def shard_size(rows: int) -> int:
    return max(SHARD_LEAST, math.ceil(SHARD_FACTOR * math.sqrt(rows)))


def index_rows(vectors: DataFrame, neighbours: int) -> DataFrame:
    """Index of a table (vec_id, vector, dim, shard): dim, shard, node, start, vec_ids, vector, edges.

    Equal vectors of a shard are one node. A node keeps the ``neighbours`` + 1
    smallest of its ids, more of which no list of ``neighbours`` can hold.
    """

    def build(table: pa.Table) -> pa.Table:
        table = table.sort_by("vec_id")
        x, ids = _matrix(table["vector"], table.num_rows), table["vec_id"].to_numpy()
        x = x + 0.0  # one zero
        _, first, group = np.unique(np.ascontiguousarray(x).view(np.dtype((np.void, x.dtype.itemsize * x.shape[1]))).ravel(), return_index=True, return_inverse=True)
        order = np.argsort(group, kind="stable")
        bounds = np.searchsorted(group[order], np.arange(len(first) + 1))
        own = [ids[order[a : min(b, a + neighbours + 1)]].tolist() for a, b in zip(bounds, bounds[1:], strict=False)]
        nodes = x[first]
        graph, starts = build_graph(on_sphere(nodes))
        start = np.zeros(len(nodes), dtype=bool)
        start[starts] = True
        n = len(nodes)
        return pa.table({
            "dim": pa.array([table["dim"][0].as_py()] * n, pa.int32()), "shard": pa.array([table["shard"][0].as_py()] * n, pa.int32()), "node": pa.array(np.arange(n, dtype=np.int32)),
            "start": pa.array(start), "vec_ids": pa.array(own, pa.list_(pa.int64())), "vector": _lists(nodes, pa.float64()), "edges": _lists(graph, pa.int32()),
        })

    return vectors.groupBy("dim", "shard").applyInArrow(build, "dim int, shard int, node int, start boolean, vec_ids array<long>, vector array<double>, edges array<int>")


def search_index(index: DataFrame, queries: DataFrame, neighbours: int, beam: int = BEAM) -> DataFrame:
    """Each shard's ``neighbours`` nearest of every query of its length: query_id, vec_id, score.

    ``queries``: query_id, query, dim. Shards meet queries block by block of
    QUERY_BLOCK; a query's own id is left out.
    """
    shards = index.groupBy("dim", "shard").agg(F.count("*").alias("nodes"))
    asked = queries.groupBy("dim").agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("int").alias("blocks"))
    plan = shards.join(asked, "dim")  # a row a shard
    left = index.join(plan.select("dim", "shard", "blocks"), ["dim", "shard"]).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    lists = plan.groupBy("dim", "blocks").agg(F.collect_list("shard").alias("shards"))
    right = queries.join(F.broadcast(lists), "dim")  # a row a vector length
    right = right.withColumn("block", F.pmod(F.xxhash64(F.lit("block"), "query_id"), F.col("blocks")).cast("int")).withColumn("shard", F.explode("shards")).select("dim", "shard", "block", "query_id", "query")
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def search(nodes: pa.Table, asked: pa.Table) -> pa.Table:
        if not nodes.num_rows or not asked.num_rows:
            return schema.empty_table()
        nodes = nodes.sort_by("node")
        x, graph = _matrix(nodes["vector"], nodes.num_rows), _matrix(nodes["edges"], nodes.num_rows)
        points, starts = on_sphere(x), np.flatnonzero(nodes["start"].to_numpy()).astype(np.int32)
        own = nodes["vec_ids"].to_pylist()
        q, q_ids = _matrix(asked["query"], asked.num_rows), asked["query_id"].to_numpy()
        unit = q / np.abs(q).max(axis=1, keepdims=True)
        unit = np.column_stack([unit / np.sqrt(np.einsum("ij,ij->i", unit, unit))[:, None], np.zeros(len(q))]).astype(np.float32)
        out: list[tuple[int, int, float]] = []
        step = max(1, min(BATCH, SEEN_CELLS // len(points)))
        for at in range(0, len(q), step):
            found, _ = beam_search(points, graph, starts, unit[at : at + step], max(beam, neighbours + 1))
            row, slot = (found >= 0).nonzero()
            node = found[row, slot]
            score = np.einsum("ij,ij->i", q[at + row], x[node])
            order = np.lexsort((-score, row))
            row, node, score = row[order], node[order], score[order]
            bounds = np.searchsorted(row, np.arange(min(step, len(q) - at) + 1))
            for k, (a, b) in enumerate(zip(bounds.tolist(), bounds[1:].tolist(), strict=False)):
                me, ranked = int(q_ids[at + k]), []
                for j in range(a, b):
                    if len(ranked) >= neighbours and score[j] < ranked[-1][0]:
                        break
                    ranked += [(float(score[j]), i) for i in own[node[j]] if i != me]
                ranked.sort(key=lambda r: (-r[0], r[1]))
                out += [(me, i, s) for s, i in ranked[:neighbours]]
        return pa.table([pa.array(c, kind) for c, kind in zip(zip(*out, strict=True) if out else ((), (), ()), schema.types, strict=True)], schema=schema)

    keys = ["dim", "shard", "block"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(search, "query_id long, vec_id long, score double")


def nearest_neighbours(df: DataFrame, is_query: Column, neighbours: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", beam: int = BEAM) -> DataFrame:
    """Each query's nearest rows by inner product: query_id, rank, vec_id, score.

    Queries are the rows for which ``is_query`` (of ``vec_id``) holds;
    candidates all rows but the query's own; with fewer than ``neighbours`` all
    of them. Scores are exact, in double precision; ties go to the smaller id.
    Which rows are found is approximate. Rows with a null id, and vectors that
    are null, empty, zero or hold null or non-finite components take no part.
    Rows with one id count once, with the least vector. Vectors meet vectors of
    their own length. Other columns are ignored; an empty table gives an empty
    result.
    """
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector")).filter(F.col("vec_id").isNotNull() & usable(F.col("vector")))
    rows = materialise(rows.groupBy("vec_id").agg(F.min("vector").alias("vector")).withColumn("dim", F.size("vector")), "vectors")
    n = rows.count()
    shards = max(1, round(n / shard_size(n)))
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64(F.lit("shard"), "vec_id"), F.lit(shards)).cast("int"))
    index = materialise(index_rows(dealt, neighbours), "graph")
    queries = rows.filter(is_query).select(F.col("vec_id").alias("query_id"), F.col("vector").alias("query"), "dim")
    found = search_index(index, queries, neighbours, beam)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= neighbours).select("query_id", "rank", "vec_id", "score")
