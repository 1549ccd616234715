"""k-means: training on a bounded sample, on the driver or by passes over the cluster, and one Lloyd step over all rows (A1, A2)."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored
from .kernels import matrix, nearest

#: Rows that the driver trains on at most; the lists of an index are trained on about 40 rows each.
SAMPLE_ROWS = 262_144


def bounded_sample(vectors: DataFrame, rows: int, id_col: str = "vec_id", vector_col: str = "embedding", seed: int = 42) -> np.ndarray:
    """`rows` vectors (all, if there are fewer) on the driver: those of the smallest hashes of their ids, so the draw does
    not depend on partitioning. More than SAMPLE_ROWS stay on the executors: `training_table`."""
    if rows > SAMPLE_ROWS:
        raise ValueError(f"{rows} vectors are more than the {SAMPLE_ROWS} that the driver trains on")
    usable = vectors.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull())
    n = usable.count()
    drawn = usable.select(F.xxhash64(F.col(id_col).cast("long"), F.lit(seed)).alias("h"), F.col(vector_col).alias("v"))
    if n > rows:
        share = (rows + 6 * rows**0.5 + 20) / n  # sure to hold `rows` but once in a billion times
        drawn = drawn.where(F.pmod("h", F.lit(1 << 30)) < F.lit(int(share * (1 << 30)) + 1))
    found = drawn.toArrow()
    h = found.column("h").to_numpy()
    first = np.lexsort((h, h % (1 << 30)))[:rows]
    return matrix(found.column("v"))[first[np.argsort(h[first], kind="stable")]]


#: Parts of the hash range that are counted to cut a sample of a given size.
_PARTS = 1 << 16


def training_table(vectors: DataFrame, rows: int, id_col: str = "vec_id", vector_col: str = "embedding", seed: int = 42) -> DataFrame:
    """i, v of exactly `rows` vectors (all, if there are fewer), those of the smallest hashes of their ids, stored. Only the part
    of the hash range in which the sample ends is sorted, a 65,536th of it."""
    usable = vectors.select(F.col(id_col).cast("long").alias("i"), F.col(vector_col).alias("v")).where("i IS NOT NULL AND v IS NOT NULL")
    usable = usable.withColumn("h", F.pmod(F.xxhash64("i", F.lit(seed)), F.lit(1 << 40)))
    part = F.shiftright("h", 24)
    counts = sorted((r.p, r.n) for r in usable.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())
    at = 0
    for p, n in counts:
        if at + n > rows:
            last = usable.where(part == p).orderBy("h", "i").limit(rows - at)
            usable = usable.where(part < p).unionByName(last)
            break
        at += n
    return stored(usable.select("i", "v"), "training")


def train_kmeans(x: np.ndarray, k: int, max_iter: int = 100, seed: int = 42, tolerance: float = 1e-6) -> np.ndarray:
    """Lloyd iterations from a distance-weighted start. At most k centers: never more than there are different rows."""
    x = np.asarray(x, np.float64)
    k = min(k, len(np.unique(x, axis=0)))
    if not k:
        return np.zeros((0, x.shape[1] if x.ndim == 2 else 0))
    rng = np.random.default_rng(seed)
    centers = [x[rng.integers(len(x))]]
    d = ((x - centers[0]) ** 2).sum(axis=1)
    while len(centers) < k:
        centers.append(x[rng.choice(len(x), p=d / d.sum())])
        d = np.minimum(d, ((x - centers[-1]) ** 2).sum(axis=1))
    c = np.array(centers)
    for _ in range(max_iter):
        own, dist = nearest(x, c)
        count = np.bincount(own, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        new = np.where(count[:, None] > 0, total / np.maximum(1, count)[:, None], c)
        for e in np.flatnonzero(count == 0):  # an empty center moves to the row that is worst off
            far = int(dist.argmax())
            new[e], dist[far] = x[far], 0
        moved = float(((new - c) ** 2).sum())
        c = new
        if moved <= tolerance:
            break
    return c


#: Nearest coarse cells whose centers a row of a hierarchical assignment is compared with.
BEAM = 8
#: Rows for each center in the tasks that place a cell's first centers.
_START_ROWS = 10
#: Of the largest distances a task has, how many it offers to centers without rows.
_FAR_ROWS = 4


class Hierarchy:
    """Centers under coarse cells: a row is compared with those of the BEAM cells nearest to its own one."""

    def __init__(self, coarse: np.ndarray, centers: np.ndarray, cell: np.ndarray):
        self.coarse, self.centers, self.cell = coarse, centers, cell
        gaps = ((coarse[:, None, :] - coarse[None, :, :]) ** 2).sum(axis=2)
        near = np.argsort(gaps, axis=1, kind="stable")[:, :BEAM]
        self.candidates = [np.flatnonzero(np.isin(cell, near[p])) for p in range(len(coarse))]

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own, dist = np.empty(len(x), np.int64), np.empty(len(x))
        cells, _ = nearest(x, self.coarse)
        for p in np.unique(cells):
            rows, some = np.flatnonzero(cells == p), self.candidates[p]
            best, dist[rows] = nearest(x[rows], self.centers[some])
            own[rows] = some[best]
        return own, dist


def train_kmeans_two_level(sample: DataFrame, k: int, max_iter: int = 100, seed: int = 42, tolerance: float = 1e-4) -> np.ndarray:
    """k-means for more centers, or more rows (`training_table`), than the driver trains: at most k centers.

    Coarse cells, about the root of k, are trained on a part of the sample; each cell gets centers in proportion to its
    rows, placed by k-means on some rows of the cell (ten for each center); then Lloyd steps go over the whole sample, each a pass in which rows
    are assigned hierarchically and a task sends a row of sums for each center. A center without rows moves to a row that is worst off.
    Ends when a step improves the inertia by less than `tolerance` of it. The driver holds centers only."""
    n = sample.count()
    if not n:
        return np.zeros((0, 0))
    few = bounded_sample(sample, min(SAMPLE_ROWS, max(10_000, 50 * math.isqrt(k))), "i", "v", seed)
    coarse = train_kmeans(few, max(1, math.isqrt(k)), 30, seed)
    d = coarse.shape[1]
    counts = np.zeros(len(coarse), np.int64)
    for r in lloyd_step(sample, coarse, "i", "v").select("partition_id", "n").collect():
        counts[r.partition_id] = r.n
    quota = _shares(counts, min(k, n))
    alloc = sample.sparkSession.createDataFrame([(i, int(q)) for i, q in enumerate(quota) if q], "cell int, quota int")
    shared = sample.sparkSession.sparkContext.broadcast(coarse)

    def cells(batches):
        for batch in batches:
            own, _ = nearest(matrix(batch.column(1), d), shared.value)
            yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), *batch.columns], ["cell", "i", "v"])

    rows = sample.mapInArrow(cells, f"cell int, i long, v {sample.schema['v'].dataType.simpleString()}").join(F.broadcast(alloc), "cell")
    rows = rows.withColumn("r", F.row_number().over(Window.partitionBy("cell").orderBy(F.xxhash64("i", F.lit(seed)), "i")))
    rows = rows.where(F.col("r") <= int(_START_ROWS * quota.max())).where(F.col("r") <= _START_ROWS * F.col("quota"))

    def place(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        c = train_kmeans(matrix(table.column("v"), d), table.column("quota")[0].as_py(), 10, seed + key[0].as_py())
        return pa.table({"cell": pa.array([key[0].as_py()] * len(c), pa.int32()), "center": pa.array(list(c), pa.list_(pa.float64()))})

    placed = sorted((r.cell, r.center) for r in rows.groupBy("cell").applyInArrow(place, "cell int, center array<double>").collect())
    tree = Hierarchy(coarse, np.array([c for _, c in placed]), np.array([p for p, _ in placed]))
    before = np.inf
    for _ in range(max_iter):
        total, inertia, far = _sums(sample, tree)
        centers = tree.centers.copy()
        some = total[:, 0] > 0
        centers[some] = total[some, 1:] / total[some, :1]
        empty = np.flatnonzero(~some)
        for e, x in zip(empty, far):
            centers[e] = x
        cell, _ = nearest(centers, coarse)
        tree = Hierarchy(coarse, centers, np.where(some, tree.cell, cell))
        if not len(empty) and before - inertia <= tolerance * inertia:
            break
        before = inertia
    return np.unique(tree.centers, axis=0)


def _shares(counts: np.ndarray, k: int) -> np.ndarray:
    """k in proportion to the counts: at least one where there are rows (if k allows it), never more than there are."""
    exact = counts * k / max(1, counts.sum())
    quota = np.minimum(np.maximum(np.floor(exact).astype(np.int64), counts > 0), counts)
    for p in np.argsort(-(exact - quota), kind="stable"):
        if quota.sum() >= k:
            break
        quota[p] += min(1, counts[p] - quota[p])
    while quota.sum() > k:  # cells that have one for being there
        quota[quota.argmax()] -= 1
    return quota


def _sums(sample: DataFrame, tree: Hierarchy) -> tuple[np.ndarray, float, np.ndarray]:
    """Per center the number of its rows and their sums; the inertia; rows that are far from their centers, farthest first."""
    shared = sample.sparkSession.sparkContext.broadcast(tree)
    d = tree.centers.shape[1]

    def run(batches):
        t = shared.value
        total, inertia, far = np.zeros((len(t.centers), d + 1)), 0.0, (np.zeros(0), np.zeros((0, d)))
        for batch in batches:
            x = matrix(batch.column(0), d)
            own, dist = t.nearest(x)
            inertia += float(dist.sum())
            np.add.at(total, own, np.concatenate([np.ones((len(x), 1)), x], axis=1))
            dist, x = np.concatenate([far[0], dist]), np.concatenate([far[1], x])
            top = np.argsort(-dist, kind="stable")[:_FAR_ROWS]
            far = dist[top], x[top]
        some = np.flatnonzero(total[:, 0])
        numbers = np.concatenate([some, np.full(len(far[0]), -1)]).astype(np.int32)
        values = np.concatenate([total[some], np.concatenate([far[0][:, None], far[1]], axis=1)])
        share = np.zeros(len(numbers))
        share[:1] = inertia
        yield pa.RecordBatch.from_arrays([pa.array(numbers), pa.array(share), pa.array(list(values), pa.list_(pa.float64()))], ["p", "inertia", "s"])

    found = stored(sample.select("v").mapInArrow(run, "p int, inertia double, s array<double>"), "lloyd")
    sums = found.where("p >= 0").groupBy("p").agg(F.array(*[F.sum(F.col("s")[i]) for i in range(d + 1)]).alias("s")).toArrow()
    total = np.zeros((len(tree.centers), d + 1))
    total[sums.column("p").to_numpy()] = matrix(sums.column("s"), d + 1)
    inertia = float(found.agg(F.sum("inertia")).first()[0] or 0.0)
    empty = int((total[:, 0] == 0).sum())
    far = found.where("p < 0").select("s").distinct().orderBy(F.desc(F.col("s")[0]), "s").limit(empty).collect() if empty else []
    shared.destroy()
    return total, inertia, np.array([r.s[1:] for r in far]).reshape(-1, d)


def assign(vectors: DataFrame, centers: np.ndarray, ids: np.ndarray | None = None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, partition_id (the lowest among equals), dist (L2)."""
    shared = vectors.sparkSession.sparkContext.broadcast((centers, np.arange(len(centers)) if ids is None else ids))

    def run(batches):
        c, names = shared.value
        for batch in batches:
            best, dist = nearest(matrix(batch.column(1), c.shape[1]), c)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(names[best].astype(np.int32)), pa.array(np.sqrt(dist))], ["vec_id", "partition_id", "dist"]
            )

    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v")).where("vec_id IS NOT NULL AND v IS NOT NULL")
    return rows.mapInArrow(run, "vec_id long, partition_id int, dist double")


def lloyd_step(vectors: DataFrame, centers: np.ndarray, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One step over all rows: partition_id, n, inertia, centroid (mean of its rows). A task sends one row of sums per
    center, so what is shuffled does not depend on the number of vectors."""
    shared = vectors.sparkSession.sparkContext.broadcast(centers)

    def run(batches):
        c = shared.value
        n, inertia, total = np.zeros(len(c), np.int64), np.zeros(len(c)), np.zeros_like(c)
        for batch in batches:
            x = matrix(batch.column(0), c.shape[1])
            own, dist = nearest(x, c)
            n += np.bincount(own, minlength=len(c))
            inertia += np.bincount(own, dist, len(c))
            np.add.at(total, own, x)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays(
            [pa.array(some.astype(np.int32)), pa.array(n[some]), pa.array(inertia[some]), pa.array(list(total[some]), pa.list_(pa.float64()))],
            ["partition_id", "n", "inertia", "total"],
        )

    rows = vectors.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).select(F.col(vector_col).alias("v"))
    sums = rows.mapInArrow(run, "partition_id int, n long, inertia double, total array<double>")
    d = centers.shape[1]
    parts = sums.groupBy("partition_id").agg(
        F.sum("n").alias("n"), F.sum("inertia").alias("inertia"), F.array(*[F.sum(F.col("total")[i]) for i in range(d)]).alias("total")
    )
    return parts.select("partition_id", "n", "inertia", F.transform("total", lambda x: x / F.col("n")).alias("centroid"))
