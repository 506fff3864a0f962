"""Exact top-k by inner product: dual-tree search over cover trees.

Vectors are integers (scaled and floored). A bounded sample of rows, picked by hash,
gives the top of the index: cover-tree centres far from each other. Every row, query
or not, goes to its nearest centre; large groups are split. Data groups meet blocks
of queries in a grid of bounded cells. In a cell one cover tree is built over queries
and data together, and pairs of nodes are visited best bound first. A pair is left
out when the inner product that its centres and covering radii allow is below the
worst kth score of the node's queries; these start from the kth score among the
sample, which is a lower bound since the sample's rows are rows. Cells send the best
k of each query, and a ranked window keeps the best of all.

The stated queries meet all rows, in blocks; nothing else grows. No cell holds more
than about ``cell_rows`` data rows and ``cell_queries`` queries; the driver sees the
sample and the sizes of groups.

Nulls: rows without an id, null vectors and vectors with null or non-finite
components take no part. Empty vectors have score 0 with all. Vectors of different
length are compared as if filled up with zeros. Rows with the query's own id are no
candidates; other repeated ids are candidates each, and a repeated query id is
answered once, for its smallest vector. Ties go to the smaller id. An empty table
gives no rows. Sums beyond 64 bits wrap around.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thoughtloom.session import materialise

LOWEST = np.iinfo(np.int64).min


def scaled(vector: Column, scale: int) -> Column:
    """floor(scale * x) of each component; null if any is null or not finite."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(fine, F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long")))


def matrix(rows: list, width: int) -> np.ndarray:
    """Vectors as rows of integers, filled up with zeros."""
    out = np.zeros((len(rows), width), np.int64)
    for i, x in enumerate(rows):
        out[i, : len(x)] = x
    return out


def column_matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(column.offsets.to_numpy())
    if len(sizes) and (sizes == width).all():
        return column.flatten().to_numpy().reshape(-1, width).astype(np.int64)
    return matrix(column.to_pylist(), width)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of rows (modulo 2 ** 64)."""
    most = float(np.abs(a.astype(float)).max(initial=0)) * float(np.abs(b.astype(float)).max(initial=0)) * max(1, a.shape[1])
    if most < 2**53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a @ b.T


def far_apart(points: np.ndarray, most: int, least_distance: float = 0.0) -> list[int]:
    """Points by farthest-first traversal, until all are within the distance of one."""
    chosen, away = [0], np.linalg.norm(points - points[0], axis=1)
    while len(chosen) < most and away.max() > least_distance:
        chosen.append(int(away.argmax()))
        away = np.minimum(away, np.linalg.norm(points - points[chosen[-1]], axis=1))
    return chosen


class Node:
    """Part of a cover tree: the queries and data under a centre, and their covering radii."""

    __slots__ = ("center", "norm", "queries", "data", "query_radius", "data_radius", "children")

    def __init__(self, center, queries, data, query_radius, data_radius):
        self.center, self.norm = center, float(np.linalg.norm(center))
        self.queries, self.data = queries, data
        self.query_radius, self.data_radius = query_radius, data_radius
        self.children: list[Node] = []


def grow(queries: np.ndarray, data: np.ndarray, leaf: int = 128, fan: int = 16) -> Node:
    """Cover tree over both sets of points; children cover about half their parent's radius."""

    def node(center: np.ndarray, q: np.ndarray, d: np.ndarray) -> Node:
        reach = [float(np.linalg.norm(x[i] - center, axis=1).max(initial=0.0)) for x, i in ((queries, q), (data, d))]
        return Node(center, q, d, *reach)

    whole = np.concatenate([data, queries])
    root = node(whole[0], np.arange(len(queries)), np.arange(len(data)))
    waiting = [root]
    while waiting:
        here = waiting.pop()
        radius = max(here.query_radius, here.data_radius)
        if len(here.queries) + len(here.data) <= leaf or radius == 0:
            continue
        own = np.concatenate([data[here.data], queries[here.queries]])
        centers = own[far_apart(own, fan, radius / 2)]
        nearest = ((centers**2).sum(axis=1) - 2 * own @ centers.T).argmin(axis=1)
        for k, center in enumerate(centers):
            mine = nearest == k
            if mine.any():
                here.children.append(node(center, here.queries[mine[len(here.data) :]], here.data[mine[: len(here.data)]]))
        if len(here.children) < 2:
            here.children = []
        waiting += here.children
    return root


def search(q_ids, queries, floors, d_ids, data, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query index, data index, score) of the k best of each query, and maybe some more."""
    tree = grow(queries.astype(np.float64), data.astype(np.float64))
    kth = floors.copy()
    best = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in q_ids]

    def bound(a: Node, b: Node) -> float:
        top = float(a.center @ b.center) + a.query_radius * b.norm + b.data_radius * a.norm + a.query_radius * b.data_radius
        return top + 1e-9 * (abs(top) + a.norm * b.norm) + 1

    def compare(a: Node, b: Node) -> None:
        scores = products(queries[a.queries], data[b.data])
        near = scores >= kth[a.queries][:, None]
        near &= q_ids[a.queries][:, None] != d_ids[b.data][None, :]
        for i in np.flatnonzero(near.any(axis=1)):
            at = int(a.queries[i])
            own = np.concatenate([best[at][0], scores[i, near[i]]])
            ids = np.concatenate([best[at][1], b.data[near[i]]])
            if len(own) > k:
                order = np.lexsort((d_ids[ids], -own))[:k]
                own, ids = own[order], ids[order]
            best[at] = own, ids
            if len(own) == k:
                kth[at] = max(kth[at], own.min())

    def visit(a: Node, b: Node, top: float) -> None:
        if not len(a.queries) or not len(b.data) or top < kth[a.queries].min():
            return
        if not a.children and not b.children:
            compare(a, b)
        elif b.children and (not a.children or b.data_radius >= a.query_radius):
            for top, c in sorted(((bound(a, c), c) for c in b.children), key=lambda x: -x[0]):
                visit(a, c, top)
        else:
            for c in a.children:
                visit(c, b, bound(c, b))

    visit(tree, tree, bound(tree, tree))
    counts = [len(x[0]) for x in best]
    scores, ids = (np.concatenate([np.zeros(0, np.int64), *[x[i] for x in best]]) for i in (0, 1))
    return np.repeat(np.arange(len(best)), counts), ids, scores


def top_k(
    rows: DataFrame, is_query: Column, k: int = 10, scale: int = 1024, sample_rows: int = 2048,
    cell_rows: int = 16_384, cell_queries: int = 4096, id_column: str = "vec_id", vector_column: str = "embedding",
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows of each query row, all if fewer."""
    held = rows.select(
        F.col(id_column).cast("long").alias("id"), scaled(F.col(vector_column), scale).alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks")
    )
    held = materialise(held.where(F.col("id").isNotNull() & F.col("v").isNotNull()))
    width, n, asking = held.agg(F.max(F.size("v")), F.count(F.lit(1)), F.coalesce(F.sum(F.col("asks").cast("long")), F.lit(0))).first()
    width = max(width or 0, 1)
    sample = held.select("id", "v").orderBy(F.xxhash64("id"), "id", "v").limit(sample_rows).collect()
    ids, points = np.array([r["id"] for r in sample], np.int64), matrix([r["v"] for r in sample], width)
    groups = int(min(len(sample), max(1, n // cell_rows), 256))
    real = points.astype(np.float64)
    centers = real[far_apart(real, groups)] if len(sample) else np.zeros((1, width))

    def settle(batches):
        """Nearest centre of each row, and for queries the kth best score among the sample."""
        for batch in batches:
            own = column_matrix(batch.column("v"), width)
            nearest = ((centers**2).sum(axis=1) - 2 * own.astype(np.float64) @ centers.T).argmin(axis=1)
            floors = np.full(len(own), LOWEST, np.int64)
            asks = np.flatnonzero(batch.column("asks").to_numpy(zero_copy_only=False))
            if len(asks):
                scores = products(own[asks], points)
                mine = batch.column("id").to_numpy()[asks]
                for row, i, me in zip(scores, asks, mine, strict=True):
                    others = row[ids != me]
                    if len(others) >= k:
                        floors[i] = np.partition(others, len(others) - k)[len(others) - k]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(nearest, pa.int32()), pa.array(floors)], ["id", "v", "asks", "node", "floor"]
            )

    settled = materialise(held.mapInArrow(settle, "id long, v array<long>, asks boolean, node int, floor long"))
    sizes = {r["node"]: r["count"] for r in settled.groupBy("node").count().collect()}
    lanes, first = [], 0
    for node in range(groups):
        lanes.append((first, -(-sizes.get(node, 0) // cell_rows)))
        first += lanes[-1][1]
    parts = max(1, -(-asking // cell_queries))
    base = F.element_at(F.array(*[F.lit(a) for a, _ in lanes or [(0, 0)]]), F.col("node") + 1)
    splits = F.element_at(F.array(*[F.lit(max(1, b)) for _, b in lanes or [(0, 0)]]), F.col("node") + 1)
    data = settled.select(
        "id", "v", (base + F.pmod(F.xxhash64("id"), splits)).cast("int").alias("lane"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part")
    )
    asked = settled.where("asks").groupBy("id").agg(F.min(F.struct("v", "floor")).alias("q")).select("id", "q.v", "q.floor")
    # Queries are dealt by their vectors' first centre's order, so that a block holds near ones.
    asked = asked.select(
        "id", "v", "floor", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias("part"),
        F.explode(F.sequence(F.lit(0), F.lit(max(0, first - 1)))).alias("lane"),
    )

    def cell(_, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            q, d, s = (np.zeros(0, np.int64),) * 3
            q_ids = d_ids = np.zeros(0, np.int64)
        else:
            q_ids, d_ids = right.column("id").to_numpy(), left.column("id").to_numpy()
            floors = right.column("floor").to_numpy().copy()
            q, d, s = search(q_ids, column_matrix(right.column("v"), width), floors, d_ids, column_matrix(left.column("v"), width), k)
        return pa.table({"query_id": q_ids[q], "vec_id": d_ids[d], "score": s})

    # Keys are the same on both sides; only rows of one cell meet.
    met = data.groupBy("lane", "part").cogroup(asked.groupBy("lane", "part")).applyInArrow(cell, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
