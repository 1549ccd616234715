"""Numpy kernels and the plumbing that feeds them with Arrow batches.

The searches have two shapes. Queries that fit a broadcast (BLOCK_BYTES, checked by counting) go to all tasks; every task
walks its own rows of the large side once and keeps the k best per query; the large side is not shuffled. More queries
than that stay on the executors: both sides are dealt into blocks, a task gets one block of each, and nothing passes the
driver; of an exact search a task gets a block of queries, which all vectors of a part pass, some at a time. In both the tasks' bests are merged
in the JVM, and no pair is ever a row.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Bytes of query vectors (as doubles) that are broadcast.
BLOCK_BYTES = 64 << 20
#: Bytes of query vectors and of searched vectors (as doubles) in the blocks of a task.
QUERY_BYTES, ROW_BYTES = 8 << 20, 64 << 20
#: Cells of one distance matrix.
_CELLS = 1 << 22


def matrix(column: pa.Array | pa.ChunkedArray, d: int | None = None) -> np.ndarray:
    """A list column without nulls as a matrix of doubles; rows of another length are an error."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    n = len(column)
    if d is None:
        d = len(flat) // n if n else 0
    if n and (len(flat) != n * d or (np.diff(column.offsets.to_numpy()) != d).any()):
        raise ValueError(f"a vector does not have {d} dimensions")
    return flat.reshape(n, d)


def squared_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All pairs by one product; small differences cancel, so what must be exact is computed again from differences."""
    d = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T)
    return np.maximum(d, 0, out=d)


def exact_squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of paired rows."""
    return ((a - b) ** 2).sum(axis=1)


def nearest(x: np.ndarray, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per row the nearest center, the lowest number among equals, and the squared distance."""
    best, dist = np.empty(len(x), np.int64), np.empty(len(x))
    step = max(1, _CELLS // max(1, len(centers)))
    for lo in range(0, len(x), step):
        part = x[lo : lo + step]
        d = squared_distances(part, centers)
        low = d.min(axis=1)
        best[lo : lo + step] = d.argmin(axis=1)
        for i in np.flatnonzero((d <= (low + 1e-9)[:, None]).sum(axis=1) > 1):  # near ties are decided exactly
            close = np.flatnonzero(d[i] <= low[i] + 1e-9)
            best[lo + i] = close[((part[i] - centers[close]) ** 2).sum(axis=1).argmin()]
        dist[lo : lo + step] = exact_squared(part, centers[best[lo : lo + step]])
    return best, dist


class Best:
    """The k smallest (distance, id) per query, gathered from batches; payload numbers follow the ids. As wide as what the
    fullest query has found, so k may be any number."""

    def __init__(self, n: int, k: int, limit: np.ndarray | None = None):
        """limit: distances beyond which a query has no use for a candidate."""
        self.k, self.limit = k, np.full(n, np.inf) if limit is None else limit
        self.dist, self.ids, self.extra = _blank((n, 0))

    def worst(self, rows: np.ndarray) -> np.ndarray:
        """What a candidate must not exceed to matter."""
        return np.minimum(self.dist[rows, -1], self.limit[rows]) if self.dist.shape[1] == self.k else self.limit[rows]

    def offer(self, rows: np.ndarray, dist: np.ndarray, ids: np.ndarray, extra: np.ndarray | None = None) -> None:
        """dist: len(rows) x candidates; ids: candidates, or a row of them for each query."""
        ids = np.broadcast_to(ids, dist.shape)
        extra = np.broadcast_to(-1 if extra is None else extra, dist.shape)
        d = np.concatenate([self.dist[rows], dist], axis=1)
        i = np.concatenate([self.ids[rows], ids], axis=1)
        e = np.concatenate([self.extra[rows], extra], axis=1)
        order = np.lexsort((i, d), axis=1)[:, : self.k]
        d, i, e = (np.take_along_axis(x, order, 1) for x in (d, i, e))
        used = max(self.dist.shape[1], int(np.isfinite(d).sum(axis=1).max(initial=0)))
        if used > self.dist.shape[1]:
            more = _blank((len(self.dist), used - self.dist.shape[1]))
            self.dist, self.ids, self.extra = (np.concatenate([a, b], axis=1) for a, b in zip((self.dist, self.ids, self.extra), more))
        self.dist[rows], self.ids[rows], self.extra[rows] = d[:, :used], i[:, :used], e[:, :used]

    def rows(self, low: int = 0, high: int | None = None) -> tuple[np.ndarray, ...]:
        """Query numbers, ids, distances and payloads of what was found for the queries from low to high."""
        q, c = np.nonzero(np.isfinite(self.dist[low:high]))
        q = q + low
        return q, self.ids[q, c], self.dist[q, c], self.extra[q, c]

    def parts(self, queries: int):
        """`rows` by so many queries at a time."""
        for low in range(0, len(self.dist), queries):
            yield self.rows(low, low + queries)


def _blank(shape: tuple[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.full(shape, np.inf), np.full(shape, np.iinfo(np.int64).max), np.full(shape, -1, np.int64)


def side_by_side(x: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order of the rows in which equal ones lie side by side, by id, and which rows in it are equal to the one before."""
    key = x @ np.random.default_rng(0).standard_normal(x.shape[1])
    order = np.lexsort((ids, key))
    same = np.zeros(len(x), bool)
    same[1:] = key[order[1:]] == key[order[:-1]]
    near = np.flatnonzero(same)
    for lo in range(0, len(near), 8192):
        part = near[lo : lo + 8192]
        same[part] = (x[order[part]] == x[order[part - 1]]).all(axis=1)
    return order, same


def _first_k(same: np.ndarray, k: int) -> np.ndarray:
    """Which rows are among the first k of their equals."""
    place = np.arange(len(same))
    return place - np.maximum.accumulate(np.where(same, 0, place)) < k


def few_copies(x: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the rows without those that are copies of k rows with smaller ids: no query has use for them."""
    order, same = side_by_side(x, ids)
    return np.sort(order[_first_k(same, k)])


#: Queries and rows of one product of an exact search; it stays in a core's cache.
_QUERY_STEP, _ROW_STEP = 512, 2048


def _distances(q: np.ndarray, x: np.ndarray, i: np.ndarray, j: np.ndarray, digits: int | None) -> np.ndarray:
    """Squared distances of q[i] and x[j] from differences in doubles, rounded to so many digits."""
    exact = np.concatenate([exact_squared(q[i[a : a + 16384]], x[j[a : a + 16384]]) for a in range(0, len(i), 16384)])
    return exact if digits is None else np.round(exact, digits)


def _slack(d: int, size: np.ndarray, far: float, digits: int | None) -> np.ndarray:
    """By how much a distance from a product in single precision, of vectors up to `far` and queries of squared norm `size`, may be wrong."""
    return (2 * (d + 24) * 2.0**-24) * (2 * np.sqrt(size) * far + far * far + size) + 1e-9 + (0 if digits is None else 10.0**-digits)


def offer_exact(best: Best, queries: np.ndarray, x: np.ndarray, ids: np.ndarray, digits: int | None = None) -> None:
    """Offer a batch of vectors to all queries: candidates by a product in single precision, less its largest possible error,
    their distances from differences in doubles. A pair that is no candidate costs the product and one comparison."""
    kept = few_copies(x, ids, best.k)
    x, ids = x[kept], ids[kept]
    center = x.mean(axis=0)
    moved = x - center
    norms = (moved * moved).sum(axis=1)
    # what is compared is |x|^2 - 2 qx, to the limit less |q|^2; the norm of x is one more place of the vectors
    right = np.concatenate([-2 * moved, norms[:, None]], axis=1).astype(np.float32).T
    far = float(np.sqrt(norms.max(initial=0)))
    for lo in range(0, len(queries), _QUERY_STEP):
        q = queries[lo : lo + _QUERY_STEP]
        own = q - center
        size = (own * own).sum(axis=1)
        slack = _slack(q.shape[1], size, far, digits)
        left = np.concatenate([own, np.ones((len(q), 1))], axis=1).astype(np.float32)
        rows = np.arange(lo, lo + len(q))
        for at in range(0, len(x), _ROW_STEP):
            score = left @ right[:, at : at + _ROW_STEP]
            limit = best.worst(rows) - size + slack
            if score.shape[1] > best.k and not np.isfinite(limit).all():
                limit = np.minimum(limit, np.partition(score, best.k - 1, axis=1)[:, best.k - 1] + 2 * slack)
            hit = np.flatnonzero(score <= np.nextafter(limit.astype(np.float32), np.float32(np.inf))[:, None])
            if not len(hit):
                continue
            i, j = hit // score.shape[1], hit % score.shape[1] + at
            exact = _distances(q, x, i, j, digits)
            near = exact <= best.worst(rows)[i]
            if near.any():
                offer_pairs(best, rows, i[near], exact[near], ids[j[near]])


#: Vectors of a tile and queries of a cell of a search by tiles, and the directions along which tiles have bounds.
_TILE, _CELL, _DIRECTIONS = 1024, 512, 4


def offer_tiled(best: Best, queries: np.ndarray, x: np.ndarray, ids: np.ndarray, digits: int | None = None) -> None:
    """What `offer_exact` does, for many queries and vectors at once. Equal vectors are compared once. Vectors that lie near each
    other along the main directions, and in their distance from these, are a tile, and queries a cell; a cell goes through the
    tiles, nearest first, and a query is compared with a tile if the bounds of that leave room for a neighbour."""
    center = x.mean(axis=0)
    if not (np.isfinite(x).all() and np.isfinite(queries).all()):
        return offer_exact(best, queries, x, ids, digits)
    spread = sum((part := x[lo : lo + 8192] - center).T @ part for lo in range(0, len(x), 8192))
    turn = np.linalg.eigh(spread)[1][:, ::-1]
    main = _main(x, center, turn)
    order, same = side_by_side(x, ids)
    kept = _first_k(same, best.k)
    order, same = order[kept], same[kept]
    first = np.flatnonzero(~same)
    copies, ids = np.diff(np.append(first, len(order))), ids[order]
    tiles = _near_parts(main[order[first]], _TILE)
    at = np.concatenate(tiles)
    first, copies = first[at], copies[at]
    x, main = x[order[first]], main[order[first]]
    ends = np.cumsum([len(t) for t in tiles])
    starts = ends - [len(t) for t in tiles]
    low, high = np.minimum.reduceat(main, starts), np.maximum.reduceat(main, starts)
    right = np.empty((len(x), x.shape[1] + 1), np.float32)
    for a, b in zip(starts, ends):
        moved = x[a:b] - center
        right[a:b, :-1], right[a:b, -1] = -2 * moved, (moved * moved).sum(axis=1)
    far = float(np.sqrt(right[:, -1].max(initial=0))) * (1 + 1e-6)
    own, space = _main(queries, center, turn), np.empty(_CELL * _TILE, np.float32)
    for rows in _near_parts(own, _CELL):
        q, y = queries[rows], own[rows]
        left = q - center
        size = (left * left).sum(axis=1)
        left = np.concatenate([left, np.ones((len(q), 1))], axis=1).astype(np.float32)
        slack = _slack(q.shape[1], size, far, digits)
        bound, middle = np.zeros((len(q), len(low)), np.float32), np.zeros(len(low), np.float32)
        for c in range(y.shape[1]):
            gap = np.maximum(low[:, c] - y[:, c, None], y[:, c, None] - high[:, c])
            bound += np.maximum(gap, 0, out=gap) ** 2
            middle += ((low[:, c] + high[:, c]) / 2 - y[:, c].mean()) ** 2
        limit, held, waiting = best.worst(rows), [], 0
        for t in np.lexsort((middle, bound.mean(axis=0))):
            need = np.flatnonzero(bound[:, t] <= limit + slack)
            if not len(need):
                continue
            score = space[: len(need) * (ends[t] - starts[t])].reshape(len(need), -1)
            np.matmul(left if len(need) == len(q) else left[need], right[starts[t] : ends[t]].T, out=score)
            most = (limit - size + slack)[need]
            if score.shape[1] > best.k and not np.isfinite(most).all():
                most = np.minimum(most, np.partition(score, best.k - 1, axis=1)[:, best.k - 1] + 2 * slack[need])
            most = np.nextafter(most.astype(np.float32), np.float32(np.inf))
            some = np.flatnonzero(score.min(axis=1) <= most)  # few, soon
            if not len(some):
                continue
            hit = np.flatnonzero(score[some] <= most[some, None])
            i, j = need[some[hit // score.shape[1]]], hit % score.shape[1] + starts[t]
            exact = _distances(q, x, i, j, digits)
            near = exact <= limit[i]
            i, j, exact = i[near], j[near], exact[near]
            n = copies[j]
            place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            held.append((np.repeat(i, n), np.repeat(exact, n), ids[np.repeat(first[j], n) + place]))
            waiting += len(place)
            if waiting > 2 * len(rows) or not np.isfinite(limit).all():
                _hand_on(best, rows, held)
                limit, held, waiting = best.worst(rows), [], 0
        _hand_on(best, rows, held)


def _hand_on(best: Best, rows: np.ndarray, held: list[tuple[np.ndarray, ...]]) -> None:
    if held:
        i, dist, ids = (np.concatenate(x) for x in zip(*held))
        if len(i):
            offer_pairs(best, rows, i, dist, ids)


def _main(x: np.ndarray, center: np.ndarray, turn: np.ndarray) -> np.ndarray:
    """Places along the main directions and the distance from these; no two vectors are nearer than they are in these places."""
    main = np.empty((len(x), min(_DIRECTIONS, x.shape[1]) + 1), np.float32)
    for lo in range(0, len(x), 8192):
        turned = (x[lo : lo + 8192] - center) @ turn
        main[lo : lo + 8192, :-1], main[lo : lo + 8192, -1] = turned[:, :_DIRECTIONS], np.sqrt((turned[:, _DIRECTIONS:] ** 2).sum(axis=1))
    return main


def _near_parts(places: np.ndarray, size: int) -> list[np.ndarray]:
    """The rows in parts of up to `size`, each cut at the middle of where it is widest; neighbours follow each other."""
    parts, left = [], [np.arange(len(places))]
    while left:
        rows = left.pop()
        if len(rows) <= size:
            parts.append(rows)
            continue
        half = len(rows) // 2
        cut = rows[np.argpartition(places[rows, places[rows].var(axis=0).argmax()], half)]
        left += [cut[half:], cut[:half]]
    return parts


def offer_pairs(best: Best, rows: np.ndarray, i: np.ndarray, dist: np.ndarray, ids: np.ndarray, extra: np.ndarray | None = None) -> None:
    """Offer candidates as pairs: query rows[i], distance, id. Of a query's candidates (equal ones may be many) only the
    k best by distance, then id, are handed on."""
    some, i = np.unique(i, return_inverse=True)  # queries without a candidate are left alone
    rows = rows[some]
    order = np.lexsort((ids, dist, i))
    i, dist, ids = i[order], dist[order], ids[order]
    place = np.arange(len(i)) - np.searchsorted(i, np.arange(len(rows)))[i]
    keep = place < best.k
    shape = len(rows), int(place[keep].max()) + 1 if keep.any() else 0
    d, n, e = np.full(shape, np.inf), np.full(shape, np.iinfo(np.int64).max), np.full(shape, -1, np.int64)
    d[i[keep], place[keep]], n[i[keep], place[keep]] = dist[keep], ids[keep]
    if extra is not None:
        e[i[keep], place[keep]] = extra[order][keep]
    best.offer(rows, d, n, e)


def offer_matrix(best: Best, rows: np.ndarray, dist: np.ndarray, ids: np.ndarray, extra: np.ndarray | None = None) -> None:
    """Offer exact distances of queries x candidates."""
    limit = best.worst(rows)
    if dist.shape[1] > best.k and not np.isfinite(limit).all():
        limit = np.minimum(np.partition(dist, best.k - 1, axis=1)[:, best.k - 1], limit)
    i, j = np.nonzero((dist <= limit[:, None]) & np.isfinite(dist))
    if len(i):
        offer_pairs(best, rows, i, dist[i, j], ids[j], None if extra is None else extra[j])


def query_block(queries: DataFrame, id_col: str, vector_col: str, block_bytes: int | None = None) -> tuple[np.ndarray, np.ndarray] | None:
    """(ids, vectors) of the queries if they fit a broadcast, None if they do not; then nothing is collected."""
    rows = usable_rows(queries, id_col, vector_col)
    shape = rows.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("d")).first()
    if shape.n * max(1, shape.d or 0) * 8 > (BLOCK_BYTES if block_bytes is None else block_bytes):
        return None
    found = rows.toArrow()
    ids = found.column("i").to_numpy()
    order = np.argsort(ids, kind="stable")
    return ids[order], matrix(found.column("v"), shape.d or 0)[order]


def usable_rows(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """i, v of the rows that have both."""
    return rows.select(F.col(id_col).cast("long").alias("i"), F.col(vector_col).alias("v")).where("i IS NOT NULL AND v IS NOT NULL")


def paired(left: DataFrame, right: DataFrame, sizes: DataFrame, on: list[str], kernel: Callable, schema: str) -> DataFrame:
    """Every row of `left` meets every row of `right` with equal `on`, block by block: left is dealt by the hash of its id
    `i` into t blocks, right into s blocks (columns of `sizes`, one row per key), and a task gets one block of each. A
    block is copied to each block of the other side, so a large key costs s copies of its queries and t of its rows, and
    no task has more than two blocks. kernel(key, left table, right table) gives a table of `schema`."""
    a = left.join(sizes, on).withColumns({"__t": F.pmod(F.xxhash64("i"), F.col("t")), "__s": F.explode(F.sequence(F.lit(0).cast("long"), F.col("s") - 1))})
    b = right.join(sizes, on).withColumns({"__s": F.pmod(F.xxhash64("i"), F.col("s")), "__t": F.explode(F.sequence(F.lit(0).cast("long"), F.col("t") - 1))})
    keys = [*on, "__s", "__t"]
    return a.drop("s", "t").groupBy(*keys).cogroup(b.drop("s", "t").groupBy(*keys)).applyInArrow(kernel, schema)


def merged(parts: DataFrame, k: int, by: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """The k best of the tasks' bests, ranked by (dist, vec_id)."""
    order = Window.partitionBy(*by).orderBy("dist", "vec_id")
    return parts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
