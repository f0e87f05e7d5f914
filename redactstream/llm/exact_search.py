"""Exact top-k inner products by dual-tree search over cover trees.

Data and queries are indexed in cover trees: a node holds all points within its radius, and
its children, more than half that radius apart, cover them within half of it. For a query node
(center q, radius r) and a data node (center c, radius s) no product exceeds
q.c + |q| s + r |c| + r s; a pair of nodes whose bound is below the worst kth score of the query
node's queries is left out, others are split, best bound first. Leaves are multiplied as
matrices. Nothing is approximate: bounds are strict, and ties are kept for the smaller id.

For the cluster, vectors near one of a few pivots (the trees' common top level, from a bounded
sample) share blocks of bounded size, and queries form blocks. A task searches one query block in
one data block. Every query starts from its kth score in the pivot sample, which is a lower
bound of its answer; the best k per query and block are merged by rank.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from redactstream.llm.store import keep

SCALE = 256
EVERY = 50
K = 5
SAMPLE = 2_048
PIVOTS = 16
DATA_BLOCK, QUERY_BLOCK = 4_096, 1_024
LEAF = 64
EPS = 1e-6


class Node:
    __slots__ = ("center", "radius", "points", "children", "centers", "radii", "norms")

    def __init__(self, center, radius, points):
        self.center, self.radius, self.points, self.children = center, radius, points, None


def near_groups(x, points, radius: float, batch: int = LEAF) -> list:
    """Cover the points by balls of that radius around some of them, centers further apart than it.

    Candidates are tried by the batch, with one matrix product for all distances to it: a batch
    removes at least its own points, so the cost is at most that of one product of all with all.
    """
    groups, rest = [], points
    square = (x[points] ** 2).sum(axis=1)
    while len(rest):
        tried = rest[:batch]
        apart = square[:, None] + square[None, : len(tried)] - 2 * (x[rest] @ x[tried].T)
        near = apart <= radius * radius
        free = np.ones(len(rest), bool)
        for j in range(len(tried)):
            if free[j]:
                mine = near[:, j] & free
                mine[j] = True
                free &= ~mine
                groups.append((x[tried[j]], rest[mine]))
        rest, square = rest[free], square[free]
    return groups


def cover_tree(x, points=None, center=None, leaf: int = LEAF) -> Node:
    """Cover tree of rows of x. Equal points form one leaf of radius 0, however many.

    Points that are alone at a level share nodes, sorted along the line on which they spread, so
    such a node has the radius its points ask for.
    """
    points = np.arange(len(x)) if points is None else points
    c = x[points[0]] if center is None else center
    dist = np.sqrt(((x[points] - c) ** 2).sum(axis=1))
    node = Node(c, float(dist.max()) if len(points) else 0.0, points)
    if len(points) <= leaf or node.radius == 0:
        return node
    groups = near_groups(x, points[np.argsort(dist, kind="stable")], node.radius / 2)
    node.children = [cover_tree(x, g, p, leaf) for p, g in groups if len(g) > 1]
    alone = [g for _, g in groups if len(g) == 1]
    if alone:
        alone = np.concatenate(alone)
        off = x[alone] - x[alone].mean(axis=0)
        line = off[(off**2).sum(axis=1).argmax()]
        alone = alone[np.argsort(off @ line, kind="stable")]
        for k in range(0, len(alone), leaf):
            part = alone[k : k + leaf]
            mean = x[part].mean(axis=0)
            node.children.append(Node(mean, float(np.sqrt(((x[part] - mean) ** 2).sum(axis=1)).max()), part))
    node.centers = np.stack([n.center for n in node.children])
    node.radii = np.array([n.radius for n in node.children])
    node.norms = np.sqrt((node.centers**2).sum(axis=1))
    return node


class Best:
    """The k best (score, id) of each query so far, ties to the smaller id."""

    def __init__(self, query_ids, floor, k: int):
        n = len(query_ids)
        self.query_ids, self.floor, self.k = query_ids, floor, k
        self.score = np.full((n, k), -np.inf)
        self.id = np.full((n, k), np.iinfo(np.int64).max)

    def worst(self, q):
        """No score below this can still matter to any of the queries."""
        return float(np.maximum(self.score[q, -1], self.floor[q]).min())

    def add(self, q, scores, ids):
        scores = np.where(ids[None, :] == self.query_ids[q, None], -np.inf, scores)
        s = np.concatenate([self.score[q], scores], axis=1)
        i = np.concatenate([self.id[q], np.broadcast_to(ids, scores.shape)], axis=1)
        order = np.lexsort((i, -s), axis=1)[:, : self.k]
        self.score[q], self.id[q] = np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)


def dual_search(queries, query_ids, floor, data, data_ids, k: int = K) -> Best:
    """The k best rows of `data` for each query, but for rows of the query's own id."""
    best = Best(query_ids, floor, k)
    if not len(queries) or not len(data):
        return best
    start_q, start_d = cover_tree(queries), cover_tree(data)

    def bound(q: Node, centers, radii, norms):
        n = np.sqrt((q.center**2).sum())
        return centers @ q.center + n * radii + q.radius * norms + q.radius * radii + EPS

    def one(q: Node, d: Node):
        return float(bound(q, d.center[None], np.array([d.radius]), np.sqrt((d.center**2).sum())[None])[0])

    heap, tick = [(-one(start_q, start_d), 0, start_q, start_d)], 1
    while heap:
        negative, _, q, d = heapq.heappop(heap)
        if -negative < best.worst(q.points):
            continue
        if d.children is None and q.children is None:
            best.add(q.points, queries[q.points] @ data[d.points].T, data_ids[d.points])
            continue
        if d.children is not None and (q.children is None or d.radius >= q.radius):
            bounds = bound(q, d.centers, d.radii, d.norms)
            for j in np.flatnonzero(bounds >= best.worst(q.points)).tolist():
                heapq.heappush(heap, (-float(bounds[j]), tick, q, d.children[j]))
                tick += 1
        else:
            for child in q.children:
                b = one(child, d)
                if b >= best.worst(child.points):
                    heapq.heappush(heap, (-b, tick, child, d))
                    tick += 1
    return best


def _matrix(column, dim: int):
    return np.stack([np.asarray(v, np.float64) for v in column]) if len(column) else np.zeros((0, dim))


def usable_vectors(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id and v = floor(scale * component), for vectors without null or non-finite components."""
    x = F.col("embedding").cast("array<double>")
    whole = ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & whole)
    return rows.select(
        F.col("vec_id").cast("long"),
        F.transform(x, lambda c: F.floor(c * scale).cast("double")).alias("v"),
    )


def top_k(vectors: DataFrame, every: int = EVERY, k: int = K, scale: int = SCALE) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows for every row whose vec_id is divisible by `every`.

    Scores are inner products of the quantised vectors, ties go to the smaller vec_id; a query
    with fewer candidates has fewer rows. Vectors are compared with those of their own length.
    Vectors without components score 0 among themselves. Rows without a vec_id take no part; rows that repeat a vec_id each are candidates, but never
    for that id, and as queries they count once. Without queries there are no rows.
    """
    rows = keep(usable_vectors(vectors, scale).withColumn("dim", F.size("v")), "vectors")
    spark = rows.sparkSession
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).collect()
    by_dim: dict[int, tuple] = {}
    for dim in {r.dim for r in sample}:
        x = _matrix([r.v for r in sample if r.dim == dim], dim)
        ids = np.array([r.vec_id for r in sample if r.dim == dim])
        picked, far = [0], ((x - x[0]) ** 2).sum(axis=1)
        while len(picked) < min(PIVOTS, len(x)) and far.max() > 0:
            picked.append(int(far.argmax()))
            far = np.minimum(far, ((x - x[picked[-1]]) ** 2).sum(axis=1))
        by_dim[dim] = (x, ids, x[picked])

    def nearest(frames) -> Iterator:
        for f in frames:
            f["pivot"] = 0
            for dim, part in f.groupby("dim"):
                if dim in by_dim:
                    p = by_dim[dim][2]
                    x = _matrix(part["v"], dim)
                    f.loc[part.index, "pivot"] = ((p**2).sum(axis=1) - 2 * x @ p.T).argmin(axis=1)
            yield f

    def floors(frames) -> Iterator:
        """Each query's kth score in the sample, a lower bound of its kth score."""
        for f in frames:
            f["least"] = -np.inf
            for dim, part in f.groupby("dim"):
                if dim in by_dim:
                    x, ids, _ = by_dim[dim]
                    s = _matrix(part["v"], dim) @ x.T
                    s[part["vec_id"].to_numpy()[:, None] == ids[None, :]] = -np.inf
                    if s.shape[1] >= k:
                        f.loc[part.index, "least"] = -np.partition(-s, k - 1, axis=1)[:, k - 1]
            yield f

    schema = "vec_id long, v array<double>, dim int"
    placed = keep(rows.mapInPandas(nearest, f"{schema}, pivot int"), "placed")
    salted = F.xxhash64("vec_id")
    sizes = placed.groupBy("dim", "pivot").agg(F.ceil(F.count("*") / DATA_BLOCK).cast("int").alias("n"))
    asked = placed.where(F.col("vec_id") % every == 0).select("vec_id", "v", "dim").dropDuplicates(["vec_id", "dim"])
    q_sizes = asked.groupBy("dim").agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("int").alias("q"))
    blocks = sizes.select("dim", "pivot", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("salt"))
    # Every query block meets every data block of its dimension.
    queries = (
        asked.mapInPandas(floors, f"{schema}, least double")
        .join(q_sizes, "dim")
        .withColumn("qb", F.pmod(F.xxhash64(F.lit(1), "vec_id"), "q").cast("int"))
        .join(blocks, "dim")
        .select("dim", "qb", "pivot", "salt", "vec_id", "v", "least")
    )
    data = (
        placed.join(sizes, ["dim", "pivot"])
        .join(q_sizes, "dim")
        .withColumn("salt", F.pmod(salted, "n").cast("int"))
        .withColumn("qb", F.explode(F.sequence(F.lit(0), F.col("q") - 1)))
        .select("dim", "qb", "pivot", "salt", "vec_id", "v")
    )

    def search(a, b):
        import pandas as pd

        if not len(a) or not len(b):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        dim = int(a["dim"].iloc[0])
        best = dual_search(
            _matrix(a["v"], dim), a["vec_id"].to_numpy(), a["least"].to_numpy(), _matrix(b["v"], dim), b["vec_id"].to_numpy(), k
        )
        i, j = np.nonzero(np.isfinite(best.score))
        return pd.DataFrame(
            {"query_id": a["vec_id"].to_numpy()[i], "vec_id": best.id[i, j], "score": best.score[i, j].astype("int64")}
        )

    task = ["dim", "qb", "pivot", "salt"]
    found = (
        queries.groupBy(*task)
        .cogroup(data.groupBy(*task))
        .applyInPandas(search, "query_id long, vec_id long, score long")
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
