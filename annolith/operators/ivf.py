"""Inverted lists of product codes: build, save, load, search.

Lists are rows (partition_id, vec_id, codes); saved, they are clustered by partition_id, so a search reads the row
groups of the lists it probes. Centroids (about the root of the number of vectors) and codebook are arrays: they are
what a search broadcasts.
"""

from __future__ import annotations

import json
import math
from collections import defaultdict
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ranked_by_range, stored
from . import clustering
from .kernels import QUERY_BYTES, Best, matrix, merged, nearest, offer_matrix, paired, query_block, squared_distances, usable_rows
from .pq import ProductQuantizer, code_matrix, refine_words, train_quantizer, usable

VERSION = "residual-1.1"
#: Defaults of an online search.
K, N_PROBE = 50, 4
#: Rows of a list in one task of a search with more queries than a broadcast holds.
LIST_ROWS = 200_000
#: Lists up to which the driver trains.
DRIVER_LISTS = 4096


@dataclass
class IvfPqIndex:
    centroids: np.ndarray
    pq: ProductQuantizer
    lists: DataFrame
    partition_ids: np.ndarray = None  # number of each centroid; a user index keeps the numbers of its base
    metadata: dict = field(default_factory=dict)

    def __post_init__(self):
        if self.partition_ids is None:
            self.partition_ids = np.arange(len(self.centroids))
        if self.centroids.shape[1] != self.pq.d:
            raise ValueError(f"centroids have {self.centroids.shape[1]} dimensions, the quantizer {self.pq.d}")
        known = {"d": self.pq.d, "n_partitions": len(self.centroids), "pq_m": self.pq.m, "pq_k": self.pq.k, "centroids_shape": list(self.centroids.shape), "version": VERSION}
        self.metadata = {**known, **self.metadata}

    @property
    def dimensions(self) -> int:
        return self.pq.d

    @property
    def n_partitions(self) -> int:
        return len(self.centroids)

    def describe(self) -> dict:
        """Q20: the metadata of lists and codes."""
        return {"ivf": dict(self.metadata), "pq": self.pq.metadata()}


def populate(
    vectors: DataFrame, centroids: np.ndarray, pq: ProductQuantizer, id_col: str = "vec_id", vector_col: str = "embedding", partition_ids: np.ndarray | None = None
) -> DataFrame:
    """partition_id, vec_id, codes of the residual, for every vector; one pass."""
    names = np.arange(len(centroids)) if partition_ids is None else partition_ids
    shared = vectors.sparkSession.sparkContext.broadcast((centroids, pq, names.astype(np.int32)))

    def run(batches):
        c, q, names = shared.value
        for batch in batches:
            x = matrix(batch.column(1), q.d)
            own, _ = nearest(x, c)
            codes = q.encode(x - c[own])
            yield pa.RecordBatch.from_arrays(
                [pa.array(names[own]), batch.column(0), pa.array([r.tobytes() for r in codes], pa.binary())], ["partition_id", "vec_id", "codes"]
            )

    return usable(vectors, id_col, vector_col).mapInArrow(run, "partition_id int, vec_id long, codes binary")


def build(
    vectors: DataFrame,
    m: int = 16,
    k: int = 256,
    n_partitions: int | None = None,
    max_iter: int = 100,
    training_rows: int | None = None,
    seed: int = 42,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> IvfPqIndex:
    """Train on a sample of `training_rows` (40 for each list, if not given), index every row. n_partitions defaults to the root of the
    number of vectors. Up to DRIVER_LISTS lists and clustering.SAMPLE_ROWS rows are trained on the driver; more lists by the
    two-level k-means over the whole sample, and code words of a larger sample are refined over all of it."""
    rows = vectors.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull())
    n = rows.count()
    if not n:
        raise ValueError("no vectors to index")
    lists = n_partitions or max(1, math.isqrt(n))
    if lists > n:
        raise ValueError(f"{lists} lists need as many vectors, there are {n}")
    wanted = min(n, training_rows or max(10_000, 40 * lists))
    sample = clustering.bounded_sample(vectors, min(wanted, clustering.SAMPLE_ROWS), id_col, vector_col, seed)
    if lists <= DRIVER_LISTS and wanted <= clustering.SAMPLE_ROWS:
        centroids = clustering.train_kmeans(sample, lists, max_iter, seed)
        whole = None
    else:
        whole = clustering.training_table(vectors, wanted, id_col, vector_col, seed)
        centroids = clustering.train_kmeans_two_level(whole, lists, max_iter, seed)
    own, dist = nearest(sample, centroids)
    pq = train_quantizer(sample - centroids[own], m, k, min(max_iter, 50), seed, vectors.sparkSession)
    if wanted > len(sample):
        pq = refine_words(whole, pq, centroids)
    metadata = {
        "d": pq.d, "n_partitions": len(centroids), "pq_m": pq.m, "pq_k": pq.k, "max_iterations": max_iter, "training_rows": wanted,
        "inertia": float(dist.sum()), "centroids_shape": list(centroids.shape), "version": VERSION,
    }
    return IvfPqIndex(centroids, pq, populate(vectors, centroids, pq, id_col, vector_col), None, metadata)


def save(index: IvfPqIndex, path: str) -> None:
    """Parquet tables lists, centroids, codebook and a row of metadata; only lists that have vectors exist."""
    spark = index.lists.sparkSession
    index.lists.repartitionByRange("partition_id", "vec_id").sortWithinPartitions("partition_id", "vec_id").write.mode("overwrite").parquet(f"{path}/lists")
    rows = [(int(p), c.tolist()) for p, c in zip(index.partition_ids, index.centroids)]
    spark.createDataFrame(rows, "partition_id int, centroid array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/centroids")
    words = [(j, c, index.pq.codebook[j, c].tolist()) for j in range(index.pq.m) for c in range(index.pq.k) if np.isfinite(index.pq.codebook[j, c]).all()]
    spark.createDataFrame(words, "j int, code int, centroid array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/codebook")
    meta = json.dumps({"index": index.metadata, "pq": index.pq.metadata()})
    spark.createDataFrame([(meta,)], "metadata string").coalesce(1).write.mode("overwrite").parquet(f"{path}/metadata")


def load(spark: SparkSession, path: str) -> IvfPqIndex:
    meta = json.loads(spark.read.parquet(f"{path}/metadata").first()[0])
    cent = sorted(spark.read.parquet(f"{path}/centroids").collect())
    words = spark.read.parquet(f"{path}/codebook").collect()
    book = np.full(meta["pq"]["codebooks_shape"], np.inf)
    for w in words:
        book[w.j, w.code] = w.centroid
    return IvfPqIndex(np.array([r.centroid for r in cent]), ProductQuantizer(book), spark.read.parquet(f"{path}/lists"), np.array([r.partition_id for r in cent]), meta["index"])


def probes_of(q: np.ndarray, centroids: np.ndarray, n_probe: int) -> tuple[np.ndarray, np.ndarray]:
    """T4: per query its n_probe nearest centroids by (distance, number), and the L2 distances."""
    n_probe = min(n_probe, len(centroids))
    out, dist = np.empty((len(q), n_probe), np.int64), np.empty((len(q), n_probe))
    step = max(1, (1 << 22) // max(1, len(centroids)))
    for lo in range(0, len(q), step):
        d = squared_distances(q[lo : lo + step], centroids)
        for i, row in enumerate(d):
            close = np.flatnonzero(row <= np.partition(row, n_probe - 1)[n_probe - 1] + 1e-9)
            exact = ((q[lo + i] - centroids[close]) ** 2).sum(axis=1)
            first = np.lexsort((close, exact))[:n_probe]
            out[lo + i], dist[lo + i] = close[first], np.sqrt(exact[first])
    return out, dist


def probe(queries: DataFrame, index: IvfPqIndex, n_probe: int = N_PROBE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, partition_id, dist (L2)."""
    shared = queries.sparkSession.sparkContext.broadcast((index.centroids, index.partition_ids))

    def run(batches):
        c, names = shared.value
        for batch in batches:
            best, dist = probes_of(matrix(batch.column(1), c.shape[1]), c, n_probe)
            n = best.shape[1]
            ids = np.repeat(batch.column(0).to_numpy(), n)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids), pa.array(np.tile(np.arange(1, n + 1, dtype=np.int32), len(best))), pa.array(names[best].ravel().astype(np.int32)), pa.array(dist.ravel())],
                ["query_id", "rank", "partition_id", "dist"],
            )

    return usable(queries, id_col, vector_col).mapInArrow(run, "query_id long, rank int, partition_id int, dist double")


def search(
    queries: DataFrame, index: IvfPqIndex, n_probe: int = N_PROBE, k: int = K, metric: str = "l2sq", payload: str | None = None,
    id_col: str = "vec_id", vector_col: str = "embedding", broadcast_bytes: int | None = None,
) -> DataFrame:
    """query_id, rank, vec_id, dist by asymmetric distance over the probed lists, ties by vec_id; lists without vectors
    contribute nothing. `payload` adds an integer column of the lists. metric "l2" takes the root (A4).
    Queries of up to `broadcast_bytes` (BLOCK_BYTES) are broadcast; beyond that each goes to the lists it probes."""
    if metric not in ("l2sq", "l2"):
        raise ValueError("metric is l2sq or l2")
    columns = ["query_id", "rank", "vec_id", "dist", *([payload] if payload else [])]
    block = query_block(queries, id_col, vector_col, broadcast_bytes)
    if block is None:
        parts = _search_lists(usable_rows(queries, id_col, vector_col), index, n_probe, k, payload)
    elif not len(block[0]):
        return queries.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, dist double" + (f", {payload} long" if payload else ""))
    else:
        parts = _search_block(index, *block, n_probe, k, payload)
    found = merged(parts, k).select(*columns)
    return found.withColumn("dist", F.sqrt("dist")) if metric == "l2" else found


def _visits(queries: DataFrame, index: IvfPqIndex, n_probe: int) -> DataFrame:
    """partition_id, i, v: each query in the lists it probes. Stored."""
    shared = queries.sparkSession.sparkContext.broadcast((index.centroids, index.partition_ids.astype(np.int32)))

    def probes(batches):
        c, names = shared.value
        for batch in batches:
            near, _ = probes_of(matrix(batch.column(1), c.shape[1]), c, n_probe)
            rows = pa.array(np.repeat(np.arange(len(near)), near.shape[1]))
            yield pa.RecordBatch.from_arrays([pa.array(names[near.ravel()]), batch.column(0).take(rows), batch.column(1).take(rows)], ["partition_id", "i", "v"])

    return stored(queries.mapInArrow(probes, queries.select(F.lit(0).alias("partition_id"), "i", "v").schema), "probes")


def _meet(visits: DataFrame, index: IvfPqIndex, payload: str | None, kernel, schema: str) -> DataFrame:
    """kernel(queries less their list's centroid, query ids, codes, vector ids, payloads) gives the columns of a table, for
    blocks of the queries that visit a list and blocks of its rows."""
    spark = visits.sparkSession
    lists = index.lists.select("partition_id", F.col("vec_id").alias("i"), "codes", *([F.col(payload).cast("long").alias(payload)] if payload else []))
    t = visits.groupBy("partition_id").agg(F.ceil(F.count("*") / max(1, QUERY_BYTES // (8 * index.dimensions))).alias("t"))
    s = lists.groupBy("partition_id").agg(F.ceil(F.count("*") / LIST_ROWS).alias("s"))
    where = spark.sparkContext.broadcast(({int(p): i for i, p in enumerate(index.partition_ids)}, index.centroids, index.pq))

    def run(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        number, centroids, pq = where.value
        q = matrix(left.column("v"), pq.d) - centroids[number[key[0].as_py()]]
        codes = code_matrix(right.column("codes").combine_chunks(), pq.m) if right.num_rows else np.zeros((0, pq.m), np.uint8)
        return kernel(pq, q, left.column("i").to_numpy(), codes, right.column("i").to_numpy(), right.column(payload).to_numpy() if payload else None)

    return paired(visits, lists, t.join(s, "partition_id"), ["partition_id"], run, schema)


def _search_lists(queries: DataFrame, index: IvfPqIndex, n_probe: int, k: int, payload: str | None) -> DataFrame:
    """Queries beyond a broadcast: each goes to the lists it probes, and meets them where they are, list by list."""
    names = ["query_id", "vec_id", "dist", *([payload] if payload else [])]

    def kernel(pq: ProductQuantizer, q: np.ndarray, ids: np.ndarray, codes: np.ndarray, vec: np.ndarray, extra: np.ndarray | None) -> pa.Table:
        best = Best(len(q), k)
        for lo in range(0, len(q), 512):
            part = np.arange(lo, min(lo + 512, len(q)))
            tables = pq.table(q[part])
            for at in range(0, len(vec), 2048):
                offer_matrix(best, part, pq.distances(tables, codes[at : at + 2048]), vec[at : at + 2048], None if extra is None else extra[at : at + 2048])
        n, found, dist, payloads = best.rows()
        arrays = [pa.array(ids[n]), pa.array(found), pa.array(dist)] + ([pa.array(payloads)] if payload else [])
        return pa.table(dict(zip(names, arrays)))

    return _meet(_visits(queries, index, n_probe), index, payload, kernel, "query_id long, vec_id long, dist double" + (f", {payload} long" if payload else ""))


#: Distances of a full order that one task hands on as one row.
_ORDER_ROWS = 4096


def order_lists(queries: DataFrame, index: IvfPqIndex, n_probe: int = 1, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """T5: query_id, rank, vec_id, dist of every vector in the probed lists, in order of (dist, vec_id) for each query: a full sort
    without a limit. The distances leave the kernels in arrays and are sorted by ranges over the cluster, so neither a query's lists
    nor a query need fit a task; a rank is a row's place in the sorted whole less that of its query's first row."""

    def kernel(pq: ProductQuantizer, q: np.ndarray, ids: np.ndarray, codes: np.ndarray, vec: np.ndarray, extra: None) -> pa.Table:
        owners, names, dists = [], [], []
        for lo in range(0, len(q), 512):
            tables = pq.table(q[lo : lo + 512])
            for at in range(0, len(vec), _ORDER_ROWS):
                d = pq.distances(tables, codes[at : at + _ORDER_ROWS])
                owners.append(ids[lo : lo + 512])
                names += [vec[at : at + _ORDER_ROWS]] * len(d)
                dists += list(d)
        arrays = [np.concatenate(owners) if owners else np.zeros(0, np.int64), pa.array(names, pa.list_(pa.int64())), pa.array(dists, pa.list_(pa.float64()))]
        return pa.table(arrays, ["query_id", "vec_ids", "dists"])

    visits = _visits(usable_rows(queries, id_col, vector_col), index, n_probe)
    blocks = _meet(visits, index, None, kernel, "query_id long, vec_ids array<long>, dists array<double>")
    every = blocks.select("query_id", F.explode(F.arrays_zip("vec_ids", "dists")).alias("r")).select("query_id", F.col("r.vec_ids").alias("vec_id"), F.col("r.dists").alias("dist"))
    return ranked_by_range(every, ["query_id"], ["dist", "vec_id"]).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "dist")


#: Rows of candidates, in the results of all tasks, from which a search learns each query's limit in its nearest lists first.
LIMIT_ROWS = 4_000_000
#: Queries whose results a task hands on at once.
_EMIT = 4096


def _search_block(index: IvfPqIndex, ids: np.ndarray, q: np.ndarray, n_probe: int, k: int, payload: str | None) -> DataFrame:
    """Queries that fit a broadcast. The rows of the probed lists are dealt by list, so that the tables of a list's visitors
    are made once; where tasks would find very many rows, a query's
    nearest lists give a limit for the others."""
    near, _ = probes_of(q, index.centroids, n_probe)
    sc = index.lists.sparkSession.sparkContext
    tasks = max(int(index.lists.sparkSession.conf.get("spark.sql.shuffle.partitions")), sc.defaultParallelism)
    limit = np.full(len(ids), np.inf)
    some = min(near.shape[1], -(-4 * k // index.n_partitions))  # lists have about as many rows as there are lists
    if len(ids) * min(near.shape[1], tasks) * k > LIMIT_ROWS and some < near.shape[1]:
        kth = merged(_scan(index, ids, q, near[:, :some], k, None, limit, tasks), k).where(F.col("rank") == k).select("query_id", "dist").toArrow()
        found = dict(zip(kth.column("query_id").to_pylist(), kth.column("dist").to_pylist()))  # a row for each query, as many as were broadcast
        limit = np.array([found.get(int(i), np.inf) for i in ids])
    return _scan(index, ids, q, near, k, payload, limit, tasks)


def _scan(index: IvfPqIndex, ids: np.ndarray, q: np.ndarray, near: np.ndarray, k: int, payload: str | None, limit: np.ndarray, tasks: int) -> DataFrame:
    """The k best of each task's rows for every query, of those up to its limit."""
    spark = index.lists.sparkSession
    visitors: dict[int, list[int]] = defaultdict(list)
    for row, own in enumerate(near):
        for c in own:
            visitors[int(c)].append(row)
    probed = sorted(visitors)
    by_name = {int(index.partition_ids[c]): (i, np.array(visitors[c])) for i, c in enumerate(probed)}
    shared = spark.sparkContext.broadcast((ids, q, index.centroids[probed], by_name, index.pq, limit))
    names = ["query_id", "vec_id", "dist", *([payload] if payload else [])]
    step = min(512, max(16, (1 << 20) // (index.pq.k * index.pq.d)))

    def run(batches):
        ids, q, centroids, visitors, pq, limit = shared.value
        best = Best(len(ids), k, limit)
        for batch in batches:
            if not batch.num_rows:
                continue
            partition, vec, codes = batch.column(0).to_numpy(), batch.column(1).to_numpy(), code_matrix(batch.column(2), pq.m)
            extra = batch.column(3).to_numpy() if payload else None
            # of rows with equal codes, which are as far from any query, those with the k smallest ids matter
            new = np.ones(len(vec), bool)
            new[1:] = (partition[1:] != partition[:-1]) | (codes[1:] != codes[:-1]).any(axis=1)
            place = np.arange(len(vec))
            kept = np.flatnonzero(place - np.maximum.accumulate(np.where(new, place, 0)) < k)
            partition = partition[kept]
            starts = np.append(np.flatnonzero(np.append(True, partition[1:] != partition[:-1])), len(kept))
            for a, b in zip(starts[:-1], starts[1:]):
                c, rows = visitors[int(partition[a])]
                for lo in range(0, len(rows), step):
                    part = rows[lo : lo + step]
                    tables = pq.table(q[part] - centroids[c])
                    for at in range(a, b, 2048):
                        some = kept[at : min(b, at + 2048)]
                        offer_matrix(best, part, pq.distances(tables, codes[some]), vec[some], None if extra is None else extra[some])
        for n, found, dist, extra in best.parts(_EMIT):
            arrays = [pa.array(ids[n]), pa.array(found), pa.array(dist)] + ([pa.array(extra)] if payload else [])
            yield pa.RecordBatch.from_arrays(arrays, names)

    lists = index.lists.select("partition_id", "vec_id", "codes", *([F.col(payload).cast("long").alias(payload)] if payload else []))
    lists = lists.where(F.col("partition_id").isin(sorted(by_name)))  # their numbers prune the scan
    pieces = -(-4 * tasks // len(by_name)) if len(by_name) < tasks else 1  # few lists are dealt in pieces; equal codes stay together
    lists = lists.repartition(tasks, "partition_id", F.pmod(F.xxhash64("codes"), F.lit(pieces))).sortWithinPartitions("partition_id", "codes", "vec_id")
    return lists.mapInArrow(run, "query_id long, vec_id long, dist double" + (f", {payload} long" if payload else ""))


def refine(found: DataFrame, queries: DataFrame, vectors: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The candidates of a search ranked anew by their exact squared distances."""
    from ..functions.vectors import l2_squared

    q = queries.select(F.col(id_col).alias("query_id"), F.col(vector_col).alias("__q"))
    v = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("__v"))
    exact = found.select("query_id", "vec_id").join(v, "vec_id").join(q, "query_id").select("query_id", "vec_id", l2_squared(F.col("__q"), F.col("__v")).alias("dist"))
    return merged(exact, k).select("query_id", "rank", "vec_id", "dist")


def artifacts(vectors: DataFrame, index: IvfPqIndex, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, partition_id of the nearest list, codes of the residual - what a user index is built from."""
    rows = populate(vectors, index.centroids, index.pq, id_col, vector_col, index.partition_ids)
    return rows.select(F.col("vec_id").alias("query_id"), "partition_id", "codes")


def partition_stats(lists: DataFrame) -> DataFrame:
    """partition_id, n of the lists that have vectors."""
    return lists.groupBy("partition_id").agg(F.count("*").alias("n"))
