"""Exact nearest neighbours."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import QUERY_BYTES, ROW_BYTES, Best, matrix, merged, offer_exact, offer_tiled, query_block, usable_rows

METRICS = ("l2sq", "l2", "cosine")
#: Bytes of query vectors in a task's block, where there are more than enough blocks for the cores.
MOST_QUERY_BYTES = 64 << 20
#: Pairs that are worth a task.
_TASK_PAIRS = 1 << 28


def exact_knn(
    queries: DataFrame, vectors: DataFrame, k: int, metric: str = "l2sq", id_col: str = "vec_id", vector_col: str = "embedding",
    broadcast_bytes: int | None = None, digits: int | None = None,
) -> DataFrame:
    """query_id, rank, vec_id, dist for the k nearest of every query, ties by vec_id. Null ids and vectors are left out;
    a zero vector has no cosine and finds, and is found by, nothing. Queries of up to `broadcast_bytes` (BLOCK_BYTES) are
    broadcast; beyond that both sides are dealt into blocks. Squared distances are compared as rounded to `digits`, if given."""
    if metric not in METRICS:
        raise ValueError(f"metric is one of {METRICS}")
    usable = usable_rows(vectors, id_col, vector_col)
    block = query_block(queries, id_col, vector_col, broadcast_bytes)
    if block is None:
        parts = _blocks(usable_rows(queries, id_col, vector_col), usable, k, metric, digits)
    elif not len(block[0]):
        return queries.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, dist double")
    else:
        parts = _broadcast(usable, *block, k, metric, digits)
    return merged(parts, k).select("query_id", "rank", "vec_id", "dist")


def _unit(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    size = np.sqrt((x * x).sum(axis=1))
    good = size > 0
    return x[good] / size[good, None], good


def _offer(best: Best, q: np.ndarray, x: np.ndarray, ids: np.ndarray, metric: str, digits: int | None, offer: Callable = offer_exact) -> None:
    if metric == "cosine":
        x, good = _unit(x)
        ids = ids[good]
    if len(x) and len(q):
        offer(best, q, x, ids, digits)


def _found(best: Best, names: np.ndarray, metric: str, queries: np.ndarray | None = None):
    """Batches of what was found; names[i] is the name of query number i, or of queries[i]."""
    for low in range(0, len(names), 4096):
        own = np.arange(low, min(low + 4096, len(names))) if queries is None else queries[low : low + 4096]
        n, c = np.nonzero(np.isfinite(best.dist[own]))
        dist = best.dist[own[n], c]
        dist = dist / 2 if metric == "cosine" else np.sqrt(dist) if metric == "l2" else dist
        yield pa.RecordBatch.from_arrays([pa.array(names[low + n]), pa.array(best.ids[own[n], c]), pa.array(dist)], ["query_id", "vec_id", "dist"])


_SCHEMA = "query_id long, vec_id long, dist double"


def _broadcast(vectors: DataFrame, ids: np.ndarray, q: np.ndarray, k: int, metric: str, digits: int | None) -> DataFrame:
    if metric == "cosine":
        q, good = _unit(q)
        ids = ids[good]
    shared = vectors.sparkSession.sparkContext.broadcast((ids, q))

    def run(batches):
        names, q = shared.value
        best = Best(len(names), k)
        for batch in batches:
            if batch.num_rows and len(names):
                _offer(best, q, matrix(batch.column(1), q.shape[1]), batch.column(0).to_numpy(), metric, digits)
        yield from _found(best, names, metric)

    return vectors.mapInArrow(run, _SCHEMA)


def _blocks(queries: DataFrame, vectors: DataFrame, k: int, metric: str, digits: int | None) -> DataFrame:
    """Both sides are dealt by the hash of the vector, so that equal ones meet: queries into t blocks, vectors into s parts. A task holds a
    block of queries, once each, and the vectors of a part pass it, some at a time; so parts may be as large as they like, and with one
    part no query is found twice."""
    shapes = [x.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("d")).first() for x in (queries, vectors)]
    (n, d), rows = shapes[0], shapes[1].n
    t, s = _deal(n, rows, max(1, d or 0) * 8, k, queries.sparkSession.sparkContext.defaultParallelism)

    def rows_of(side: DataFrame, kind: str, places):
        hashed = side.select("i", F.col("v").cast("array<double>").alias("v"), F.lit(kind).alias("kind"), F.xxhash64("v").alias("h"))
        return hashed.select("*", F.explode(places.cast("array<int>")).alias("place"))

    block, part = F.pmod("h", F.lit(t)) * s, F.pmod("h", F.lit(s))
    ours = rows_of(queries, "q", F.sequence(block, block + (s - 1)))
    dealt = ours.unionByName(rows_of(vectors, "v", F.sequence(part, part + (t - 1) * s, F.lit(s).cast("long"))))
    dealt = dealt.repartitionById(t * s, "place").sortWithinPartitions("kind", "h")  # queries come first

    def run(batches):
        names, owns, blocks, held = [], [], [], []
        count, best, q, bytes_held = 0, None, None, 0

        def pass_by():
            x, ids = np.concatenate([matrix(b.column(1), d) for b in held]), np.concatenate([b.column(0).to_numpy() for b in held])
            held.clear()
            _offer(best, q, x, ids, metric, digits, offer_tiled)

        for batch in batches:
            ours = int(pc.sum(pc.equal(batch.column(2), "q")).as_py() or 0)
            if ours:
                x, ids = matrix(batch.column(1)[:ours], d), batch.column(0)[:ours].to_numpy()
                if metric == "cosine":
                    x, good = _unit(x)
                    ids = ids[good]
                if len(x):
                    new = np.append(not blocks or (blocks[-1][-1] != x[0]).any(), (x[1:] != x[:-1]).any(axis=1))
                    names.append(ids)
                    owns.append(count + np.cumsum(new) - 1)
                    count += int(new.sum())
                    if new.any():
                        blocks.append(x[new])
            if ours < batch.num_rows and count:
                if best is None:
                    q, best = np.concatenate(blocks), Best(count, k)
                    blocks.clear()
                held.append(batch.slice(ours))
                bytes_held += (batch.num_rows - ours) * d * 8
                if bytes_held >= ROW_BYTES // 2:  # with copies of them in other orders
                    pass_by()
                    bytes_held = 0
        if held:
            pass_by()
        if best is not None:
            yield from _found(best, np.concatenate(names), metric, np.concatenate(owns))

    return dealt.select("i", "v", "kind").mapInArrow(run, _SCHEMA)


def _deal(n: int, rows: int, width: int, k: int, cores: int) -> tuple[int, int]:
    """How many blocks of queries and parts of vectors: enough tasks for the cores, by blocks of queries as far as these do not get small. A
    vector is moved to every block; a query to every part, where it starts anew and has k results, which costs as much as moving k vectors."""
    tasks = max(1, min(2 * cores, -(-n * rows // _TASK_PAIRS)))
    least, most = max(1, -(-n * width // MOST_QUERY_BYTES)), max(1, -(-n * width // QUERY_BYTES))
    t = max(least, min(most, tasks, math.ceil(math.sqrt(tasks * n * k / max(1, rows)))))
    s = max(1, -(-tasks // t))
    return max(least, -(-tasks // s)), s
