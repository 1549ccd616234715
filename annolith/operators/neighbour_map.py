"""A neighbour-embedding map (Q13): fuzzy graph of nearest neighbours, layout of the plane, and a projector fitted to it.

The graph: each vector's distances to its nearest neighbours become memberships, 1 at the nearest and falling at the
vector's own rate, so that they sum up to the same everywhere; the two directions of an edge are joined as a fuzzy union.

The layout: connected points attract each other along the curve 1 / (1 + a d^(2b)), and sampled other points repel. The edges
lie on the executors, dealt into shards by the hash of their first point, as many as their number asks for; the points' positions, two numbers each, are
broadcast. In a round every shard moves its own copy of the positions through some epochs of sampled edges, and a point goes on from the mean of its
moves, weighted by how many edges of it each shard has. All draws are hashes of edge, epoch and seed, so a map does not depend on the cluster.

The projector places any vector: normalised radial functions of landmarks and a linear part, fitted by ridge regression to the
layout. It is an object with a `project` method like the others of `mapping`.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import number_rows, stored
from . import clustering, knn
from .kernels import matrix, squared_distances
from .mapping import Projector

#: Nearest neighbours of a point, and how close the layout packs points (fixed values of the maps that are followed).
NEIGHBOURS, MIN_DIST = 10, 0.5
#: Points of a layout: what is broadcast is 16 bytes for each.
MOST_POINTS = 4_000_000
#: Edges of a shard, rounds, and epochs of a round.
SHARD_EDGES, ROUNDS, EPOCHS = 250_000, 10, 20
#: Points that repel an end of a sampled edge.
REPEL = 5
#: Landmarks of the projector.
LANDMARKS = 256


def curve(min_dist: float = MIN_DIST, spread: float = 1.0) -> tuple[float, float]:
    """a, b with which 1 / (1 + a d^(2b)) is next to 1 up to min_dist and falls like exp(-(d - min_dist) / spread) beyond."""
    d = np.linspace(0, 3 * spread, 301)[1:]
    want = np.where(d < min_dist, 1.0, np.exp(-(d - min_dist) / spread))
    p = np.array([0.0, 0.0])  # logarithms of a and b
    for _ in range(100):  # Gauss-Newton steps
        a, b = np.exp(p)
        t = a * d ** (2 * b)
        got = 1 / (1 + t)
        slope = -(got**2) * t
        j = np.stack([slope, slope * 2 * b * np.log(d)], axis=1)
        p = p + np.linalg.solve(j.T @ j + 1e-9 * np.eye(2), j.T @ (want - got))
    return float(np.exp(p[0])), float(np.exp(p[1]))


def memberships(dist: np.ndarray) -> np.ndarray:
    """Rows of ascending distances to strengths of 0 to 1: exp(-(d - nearest) / rate), the rate such that a row sums up to the
    logarithm of their number to base 2. Distances that are missing are infinite and have none."""
    have = np.isfinite(dist)
    goal = np.log2(np.maximum(have.sum(axis=1), 2))
    low = np.where(have & (dist > 0), dist, np.inf).min(axis=1)
    low = np.where(np.isfinite(low), low, 0.0)
    over = np.where(have, np.maximum(np.where(have, dist, 0) - low[:, None], 0), np.inf)
    lo, hi = np.zeros(len(dist)), np.full(len(dist), np.inf)
    rate = np.ones(len(dist))
    for _ in range(64):
        total = np.exp(-over / rate[:, None]).sum(axis=1)
        lo, hi = np.where(total < goal, rate, lo), np.where(total < goal, hi, rate)
        rate = np.where(np.isfinite(hi), (lo + hi) / 2, rate * 2)
        rate = np.clip(rate, 1e-12, 1e12)
    floor = 1e-3 * np.where(have, dist, 0).sum(axis=1) / np.maximum(1, have.sum(axis=1))
    return np.where(have, np.exp(-over / np.maximum(rate, np.maximum(floor, 1e-12))[:, None]), 0.0)


def neighbour_graph(vectors: DataFrame, k: int = NEIGHBOURS, near: DataFrame | None = None) -> DataFrame:
    """a, b (ids, a < b), weight: the fuzzy graph of k neighbours. `near` (query_id, vec_id, dist) can be that of any search; the default is exact."""
    near = knn.exact_knn(vectors, vectors, k + 1, "l2") if near is None else near
    order = Window.partitionBy("query_id").orderBy("dist", "vec_id")
    near = near.where("query_id <> vec_id").withColumn("r", F.row_number().over(order)).where(F.col("r") <= k)
    rows = near.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("dist", "vec_id"))).alias("n"))

    def weigh(batches):
        for batch in batches:
            n = batch.column(1)
            sizes = np.diff(n.offsets.to_numpy())
            flat = n.flatten()
            dist = np.full((len(n), k), np.inf)
            row = np.repeat(np.arange(len(n)), sizes)
            place = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            dist[row, place] = flat.field(0).to_numpy()
            q, v = batch.column(0).to_numpy()[row], flat.field(1).to_numpy()
            w = memberships(dist)[row, place]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(q, v)), pa.array(np.maximum(q, v)), pa.array(w)], ["a", "b", "w"])

    each = rows.mapInArrow(weigh, "a long, b long, w double")
    s = F.sum("w")
    both = F.when(F.count("*") > 1, F.max("w") * F.min("w")).otherwise(0.0)
    return each.groupBy("a", "b").agg((s - both).alias("weight")).where("weight > 0")


def _mixed(*parts: np.ndarray | int) -> np.ndarray:
    """A hash of whole numbers, element by element."""
    h = np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        for p in parts:
            h = (h ^ np.asarray(p).astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
            h = h ^ (h >> np.uint64(32))
    return h


def move(y: np.ndarray, a: np.ndarray, b: np.ndarray, share: np.ndarray, epochs: range, all_epochs: int, ab: tuple[float, float], seed: int) -> np.ndarray:
    """Positions after some epochs over edges a-b, each of which is drawn with its share. An epoch goes in several steps, so
    that a point sees where its neighbours went."""
    y, (ca, cb) = y.astype(np.float64), ab
    for epoch in epochs:
        rate = 1.0 - epoch / all_epochs
        h = _mixed(a, b, epoch, seed)
        drawn = np.flatnonzero((h >> np.uint64(11)) / float(1 << 53) < share)
        step = (h[drawn] & np.uint64(7)).astype(np.int64)
        for s in range(8):
            e = drawn[step == s]
            if not len(e):
                continue
            i, j = np.concatenate([a[e], b[e]]), np.concatenate([b[e], a[e]])
            diff = y[i] - y[j]
            d2 = (diff * diff).sum(axis=1)
            pull = -2 * ca * cb * np.maximum(d2, 1e-12) ** (cb - 1) / (1 + ca * d2**cb)
            total = np.clip(pull[:, None] * diff, -4, 4)
            for m in range(REPEL):
                o = (_mixed(i, j, epoch * REPEL + m, seed + 1) % np.uint64(len(y))).astype(np.int64)
                diff = y[i] - y[o]
                d2 = (diff * diff).sum(axis=1)
                push = np.where(o == i, 0.0, 2 * cb / ((0.001 + d2) * (1 + ca * d2**cb)))
                total += np.clip(push[:, None] * diff, -4, 4)
            np.add.at(y, i, rate * total)
    return y


def _shard_mover(shared, epochs: range, all_epochs: int, ab: tuple[float, float], seed: int):
    def run(table: pa.Table) -> pa.Table:
        old = shared.value
        order = table.sort_by([("a", "ascending"), ("b", "ascending")])
        a, b, share = order.column("a").to_numpy(), order.column("b").to_numpy(), order.column("share").to_numpy()
        new = move(old, a, b, share, epochs, all_epochs, ab, seed)
        here = np.bincount(a, minlength=len(old)) + np.bincount(b, minlength=len(old))
        p = np.flatnonzero(here)
        moved = (new[p] - old[p]) * here[p, None]
        return pa.table({"p": pa.array(p), "x": pa.array(moved[:, 0]), "y": pa.array(moved[:, 1]), "n": pa.array(here[p])})

    return run


def layout(graph: DataFrame, start: np.ndarray, rounds: int = ROUNDS, epochs: int = EPOCHS, min_dist: float = MIN_DIST, seed: int = 42) -> np.ndarray:
    """Positions of the points 0..n-1 of a graph, n x 2, from the given ones on."""
    if len(start) > MOST_POINTS:
        raise ValueError(f"{len(start)} points are more than the {MOST_POINTS} whose positions are broadcast")
    spark, ab, n = graph.sparkSession, curve(min_dist), len(start)
    graph = stored(graph.select("a", "b", "weight"), "graph")
    facts = graph.agg(F.count("*").alias("n"), F.max("weight").alias("most")).first()
    if not facts.n:
        return start
    shards = -(-facts.n // SHARD_EDGES)
    edges = graph.select("a", "b", (F.col("weight") / facts.most).alias("share"), F.pmod(F.xxhash64("a", F.lit(seed)), F.lit(shards)).alias("shard"))
    edges = stored(edges.where(F.col("share") * rounds * epochs >= 1), "edges")  # the others would hardly be drawn once
    y = start.astype(np.float32)
    for r in range(rounds):
        shared = spark.sparkContext.broadcast(y)

        run = _shard_mover(shared, range(r * epochs, (r + 1) * epochs), rounds * epochs, ab, seed)
        moved = edges.groupBy("shard").applyInArrow(run, "p long, x double, y double, n long")
        moved = moved.groupBy("p").agg((F.sum("x") / F.sum("n")).alias("x"), (F.sum("y") / F.sum("n")).alias("y")).toArrow()
        y = y.copy()
        y[moved.column("p").to_numpy()] += np.stack([moved.column("x").to_numpy(), moved.column("y").to_numpy()], axis=1).astype(np.float32)
        shared.destroy()
    return y


@dataclass(frozen=True)
class NeighbourProjector:
    """Places vectors by radial functions of landmarks, which sum up to 1, and a linear part."""

    landmarks: np.ndarray
    width: float
    weights: np.ndarray  # of landmarks, components and 1

    def features(self, x: np.ndarray) -> np.ndarray:
        x = np.asarray(x, np.float64)
        d = squared_distances(x, self.landmarks)
        r = np.exp(-(d - d.min(axis=1, keepdims=True)) / (2 * self.width**2))
        return np.concatenate([r / r.sum(axis=1, keepdims=True), x, np.ones((len(x), 1))], axis=1)

    def project(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights


def fit_projector(vectors: DataFrame, points: np.ndarray, landmarks: int = LANDMARKS, ridge: float = 1e-3, seed: int = 42) -> NeighbourProjector:
    """vectors: number (the place in points) and embedding. The normal equations are summed over the cluster: a task sends a matrix of the size of the features."""
    few = clustering.bounded_sample(vectors, min(clustering.SAMPLE_ROWS, 40 * landmarks), "number", "embedding", seed)
    centers = clustering.train_kmeans(few, landmarks, 20, seed)
    gaps = squared_distances(centers, centers)
    np.fill_diagonal(gaps, np.inf)
    width = float(np.sqrt(np.median(gaps.min(axis=1)))) / 2 if len(centers) > 1 else 1.0
    blank = NeighbourProjector(centers, max(width, 1e-12), np.zeros((0, 2)))
    shared = vectors.sparkSession.sparkContext.broadcast((blank, points.astype(np.float32)))
    size = len(centers) + centers.shape[1] + 1

    def run(batches):
        p, y = shared.value
        total = np.zeros((size, size + 2))
        for batch in batches:
            f = p.features(matrix(batch.column(1), centers.shape[1]))
            total += f.T @ np.concatenate([f, y[batch.column(0).to_numpy()]], axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), pa.array(list(total), pa.list_(pa.float64()))], ["r", "s"])

    rows = vectors.select("number", "embedding").mapInArrow(run, "r int, s array<double>")
    rows = rows.select("r", F.posexplode("s").alias("c", "v")).groupBy("r", "c").agg(F.sum("v").alias("v")).toArrow()
    total = np.zeros((size, size + 2))
    total[rows.column("r").to_numpy(), rows.column("c").to_numpy()] = rows.column("v").to_numpy()
    weights = np.linalg.solve(total[:, :size] + ridge * np.eye(size), total[:, size:])
    return NeighbourProjector(centers, blank.width, weights)


def train(
    vectors: DataFrame, k: int = NEIGHBOURS, min_dist: float = MIN_DIST, rounds: int = ROUNDS, epochs: int = EPOCHS, seed: int = 42,
    id_col: str = "vec_id", vector_col: str = "embedding", near: DataFrame | None = None,
) -> tuple[NeighbourProjector, DataFrame]:
    """The projector, and vec_id, x, y of the layout of the given vectors (a bounded training sample; ids are unique). Null ids and vectors play no part."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("embedding")).where("vec_id IS NOT NULL AND embedding IS NOT NULL")
    rows = stored(number_rows(rows, "vec_id", "number"), "map-rows")
    n = rows.count()
    if not n:
        raise ValueError("no vectors to place")
    numbered = rows.select(F.col("number").alias("vec_id"), "embedding")
    if near is not None:
        names = rows.select("vec_id", "number")
        near = near.join(names, "vec_id").select("query_id", F.col("number").alias("vec_id"), "dist").join(names.select(F.col("vec_id").alias("query_id"), F.col("number").alias("q")), "query_id")
        near = near.select(F.col("q").alias("query_id"), "vec_id", "dist")
    graph = neighbour_graph(numbered, k, near)
    few = clustering.bounded_sample(numbered, min(n, clustering.SAMPLE_ROWS), seed=seed)
    flat = Projector.fit(few)
    scale = 10 / max(1e-12, float(np.abs(flat.project(few)).max()))
    placed = numbered.mapInArrow(_project(flat), "p long, x double, y double").toArrow()
    start = np.zeros((n, 2))
    start[placed.column("p").to_numpy()] = np.stack([placed.column("x").to_numpy(), placed.column("y").to_numpy()], axis=1) * scale
    start += ((_mixed(np.arange(2 * n), seed) >> np.uint64(11)) / float(1 << 53)).reshape(n, 2) * 1e-3  # equal vectors part
    y = layout(graph, start, rounds, epochs, min_dist, seed)
    projector = fit_projector(rows, y, min(LANDMARKS, max(1, n // 10)), seed=seed)
    shared = rows.sparkSession.sparkContext.broadcast(y)

    def place(batches):
        for batch in batches:
            at = shared.value[batch.column(1).to_numpy()].astype(np.float64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(at[:, 0]), pa.array(at[:, 1])], ["vec_id", "x", "y"])

    return projector, rows.select("vec_id", "number").mapInArrow(place, "vec_id long, x double, y double")


def _project(projector):
    def run(batches):
        for batch in batches:
            p = projector.project(matrix(batch.column(1), len(projector.mean)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p[:, 0]), pa.array(p[:, 1])], ["p", "x", "y"])

    return run


def trustworthiness(vectors: DataFrame, points: DataFrame, k: int = NEIGHBOURS, queries: DataFrame | None = None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """trustworthiness: how little the map's neighbours are strangers: 1 - 2 / (n k (2 N - 3 k - 1)) times the sum, over n
    queries (all, if none are given) and their k nearest of N points in the map, of the rank in the space beyond k. Ranks are by (distance, id); a query is no neighbour of its own."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v"))
    where = points.select(F.col(id_col).cast("long").alias("vec_id"), F.array("x", "y").alias("v"))
    asked = rows if queries is None else queries.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v"))
    near = knn.exact_knn(where.join(asked.select("vec_id"), "vec_id", "left_semi"), where, k + 1, vector_col="v").where("query_id <> vec_id")
    order = Window.partitionBy("query_id").orderBy("rank")
    near = stored(near.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).select("query_id", "vec_id"), "map-neighbours")
    pairs = near.join(rows.withColumnRenamed("v", "w"), "vec_id").join(asked.withColumnRenamed("vec_id", "query_id"), "query_id")
    pairs = pairs.groupBy("query_id").agg(F.first("v").alias("v"), F.collect_list("vec_id").alias("n"), F.collect_list("w").alias("w"))
    n, total, d = near.select("query_id").distinct().count(), rows.count(), (rows.select(F.size("v")).first() or [0])[0]
    if not n or 2 * total - 3 * k - 1 <= 0:
        return spark.createDataFrame([(None,)], "trustworthiness double")
    found = stored(pairs, "map-pairs")
    blocks = max(1, math.ceil(n * (k + 1) * d * 8 / (64 << 20)))
    beyond = None
    for block in range(blocks):  # of bounded size, each of which meets all vectors
        part = found.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block).toArrow()
        if not part.num_rows:
            continue
        q, own = matrix(part.column("v"), d), part.column("query_id").to_numpy()
        ids, w = part.column("n").combine_chunks(), part.column("w").combine_chunks().flatten()
        row = np.repeat(np.arange(len(own)), np.diff(ids.offsets.to_numpy()))
        name, far = ids.flatten().to_numpy(), ((matrix(w, d) - q[row]) ** 2).sum(axis=1)
        shared = spark.sparkContext.broadcast((q, own, row, name, far))

        def count(batches, shared=shared):
            q, own, row, name, far = shared.value
            closer = np.zeros(len(row), np.int64)
            for batch in batches:
                ids, x = batch.column(0).to_numpy(), matrix(batch.column(1), q.shape[1])
                for lo in range(0, len(q), 256):
                    mine = np.flatnonzero((row >= lo) & (row < lo + 256))
                    for at in range(0, len(x), 4096):
                        part = x[at : at + 4096]
                        dist = np.stack([((part - a) ** 2).sum(axis=1) for a in q[lo : lo + 256]])
                        dist[own[lo : lo + 256, None] == ids[None, at : at + 4096]] = np.inf
                        mine_dist = dist[row[mine] - lo]
                        closer[mine] += ((mine_dist < far[mine, None]) | (mine_dist == far[mine, None]) & (ids[None, at : at + 4096] < name[mine, None])).sum(axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(row))), pa.array(closer)], ["pair", "closer"])

        counted = rows.mapInArrow(count, "pair long, closer long").groupBy("pair").agg(F.sum("closer").alias("closer"))
        some = counted.select(F.greatest(F.col("closer") + 1 - k, F.lit(0)).alias("beyond"))
        beyond = some if beyond is None else beyond.unionByName(some)
    return beyond.agg((1 - F.sum("beyond") * (2.0 / (n * k * (2 * total - 3 * k - 1)))).alias("trustworthiness"))
