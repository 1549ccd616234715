"""Operator 11, vector code compression: product codes by Lloyd's rounds with Hamerly's bounds, in whole numbers.

A round is one pass over the rows, from a stored table of their parts' entries and bounds to the next one. For every part
of a vector two numbers are kept: an upper bound of the distance to its own entry, and a lower bound of the distance to
any other one. When the entries move, the upper bound grows by what the own entry moved and the lower one shrinks by the
most that another moved. Only a part whose upper bound is not strictly below its lower bound, nor strictly below half the way
from its entry to the next, is compared with all entries; strictly, because an equal distance may belong to a lower index, which
would win. Bounds are stored as floats rounded outwards, distances are exact whole numbers.

What is new of an entry after a round is the sum and the count of its parts: a task sends one row for each, and the driver
gets as many as there are entries in all (16 x 64).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import binary_column, lookup, stored, table

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Rows compared with all entries at a time.
_BLOCK = 8192
#: More than the rounding of a few operations on doubles.
_UP, _DOWN = 1 + 1e-12, 1 - 1e-12


def whole(x: np.ndarray, scale: int = SCALE) -> np.ndarray:
    return np.floor(scale * np.asarray(x, np.float64)).astype(np.int64)


def compare_all(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per row the nearest entry (lowest index among equals), its squared distance and that of the nearest other one."""
    own, first = np.empty(len(x), np.int64), np.empty(len(x), x.dtype)
    second = np.full(len(x), np.inf)
    for lo in range(0, len(x), _BLOCK):
        part = x[lo : lo + _BLOCK]
        d = (part * part).sum(axis=1)[:, None] + (book * book).sum(axis=1)[None, :] - 2 * (part @ book.T)
        rows = np.arange(len(part))
        best = d.argmin(axis=1)
        own[lo : lo + _BLOCK], first[lo : lo + _BLOCK] = best, d[rows, best]
        if len(book) > 1:
            second[lo : lo + _BLOCK] = np.where(np.arange(len(book)) == best[:, None], d.max(), d).min(axis=1)
    return own, first, second


def _outward(u: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds as floats, rounded away from each other."""
    with np.errstate(over="ignore"):
        return np.nextafter(u.astype(np.float32), np.float32(np.inf)), np.nextafter(low.astype(np.float32), np.float32(-np.inf))


class Drift:
    """How the entries of one part position moved: what the bounds need to know."""

    def __init__(self, old: np.ndarray, new: np.ndarray):
        self.moved = np.sqrt(((new - old).astype(np.float64) ** 2).sum(axis=1)) * _UP
        self.most = int(self.moved.argmax())
        others = np.delete(self.moved, self.most)
        self.second = float(others.max()) if len(others) else 0.0
        gaps = ((new[:, None, :] - new[None, :, :]).astype(np.float64) ** 2).sum(axis=2)
        np.fill_diagonal(gaps, np.inf)
        self.half = np.sqrt(gaps.min(axis=1)) / 2 * _DOWN


def reassign(x: np.ndarray, book: np.ndarray, drift: Drift, own: np.ndarray, upper: np.ndarray, lower: np.ndarray):
    """The parts' entries after the entries moved: own, exact squared distance, upper, lower, and how many parts were
    compared with all entries."""
    own, upper = own.copy(), (upper.astype(np.float64) + drift.moved[own]) * _UP
    lower = lower.astype(np.float64) - np.where(own == drift.most, drift.second, drift.moved[drift.most])
    lower = np.where(lower > 0, lower * _DOWN, lower * _UP)
    bound = np.maximum(lower, drift.half[own])
    exact = ((x - book[own]) ** 2).sum(axis=1)
    loose = np.flatnonzero(~(upper < bound))  # strictly, else an equal entry of a lower index would be lost
    upper[loose] = np.sqrt(exact[loose].astype(np.float64)) * _UP
    open_ = loose[~(upper[loose] < bound[loose])]
    if len(open_):
        own[open_], exact[open_], second = compare_all(x[open_], book)
        upper[open_], lower[open_] = np.sqrt(exact[open_].astype(np.float64)) * _UP, np.sqrt(second) * _DOWN
    return own, exact, upper, lower, len(open_)


def _usable(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    v = F.col("v")
    rows = vectors.select(vectors[f"`{id_col}`"].alias("id"), vectors[f"`{label_col}`"].alias("label"), vectors[f"`{vector_col}`"].cast("array<double>").alias("v"))
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return rows.where(v.isNotNull() & good)


def codebooks_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE,
) -> tuple[DataFrame, np.ndarray]:
    """(rows, codebooks): the rows have the columns id, label, own (binary, an entry's index for each part) and error (long); the codebooks are parts x entries x
    components.

    Rows with a null vector, or with null or non-finite components, are dropped. The vectors' length is that of the
    longest; rows of another length (empty ones too) have no such parts and are dropped as well, and a length that is no multiple of
    `parts` is an error. Repeated ids and repeated rows are rows like others; the entries start from the first rows by
    (id, whole components), null ids last, and are fewer than `entries` if there are fewer rows. A table without usable
    rows gives none, and codebooks without entries. Components whose squared distances no long could hold are an error.
    Ids and labels may be of any type and null."""
    if not 0 < entries <= 256:
        raise ValueError("a part's index takes one byte")
    spark, rows = vectors.sparkSession, _usable(vectors, id_col, vector_col, label_col)
    shape = rows.agg(F.max(F.size("v")).alias("d"), F.max(F.array_max(F.transform("v", F.abs))).alias("most")).first()
    d, most = shape.d or 0, scale * (shape.most or 0.0) + 1
    schema = f"id {vectors.schema[id_col].dataType.simpleString()}, label {vectors.schema[label_col].dataType.simpleString()}, "
    if not d:
        return spark.createDataFrame([], schema + "own binary, error long"), np.zeros((parts, 0, 0), np.int64)
    if d % parts:
        raise ValueError(f"vectors of {d} components cannot be cut into {parts} equal parts")
    if d * (2 * most) ** 2 >= 2**63:
        raise ValueError(f"components of up to {shape.most} have squared distances that no long holds")
    kind = np.int16 if most < 2**15 else np.int32 if most < 2**31 else np.int64
    number = np.float64 if d * (2 * most) ** 2 < 2**52 else np.int64  # products of doubles are exact below
    rows = rows.where(F.size("v") == d)
    width = d // parts
    first = rows.select("id", F.transform("v", lambda x: F.floor(x * scale)).alias("q")).orderBy(F.asc_nulls_last("id"), "q").limit(entries).collect()
    books = np.array([r.q for r in first], np.int64).reshape(len(first), parts, width).transpose(1, 0, 2)

    state_schema = schema + "q binary, own binary, upper binary, lower binary"
    share = spark.sparkContext.broadcast

    def begin(batches, shared):
        c = shared.value.astype(number)
        for batch in batches:
            q = whole(batch.column(2).flatten().to_numpy(), scale).reshape(-1, d)
            own, upper, lower = np.empty((len(q), parts), np.uint8), *np.empty((2, len(q), parts), np.float32)
            for j in range(parts):
                o, near, next_ = compare_all(q[:, j * width : (j + 1) * width].astype(number), c[j])
                own[:, j] = o
                upper[:, j], lower[:, j] = _outward(np.sqrt(near.astype(np.float64)) * _UP, np.sqrt(next_) * _DOWN)
            yield _state(batch, q.astype(kind), own, upper, lower)

    def _state(batch, q, own, upper, lower):
        columns = [pc.cast(binary_column(x), pa.binary()) for x in (q, own, upper, lower)]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["id", "label", "q", "own", "upper", "lower"])

    def read(column, dtype, n):
        a = column.cast(pa.large_binary())
        data = np.frombuffer(a.buffers()[2], dtype) if len(a) else np.zeros(0, dtype)
        at = a.buffers()[1] and np.frombuffer(a.buffers()[1], np.int64)[a.offset] // np.dtype(dtype).itemsize or 0
        return data[at : at + len(a) * n].reshape(len(a), n)

    def again(batches, shared, last):
        old, new = shared.value
        drifts, c = [Drift(a, b) for a, b in zip(old, new)], new.astype(number)
        for batch in batches:
            q, own = read(batch.column(2), kind, d), read(batch.column(3), np.uint8, parts).copy()
            upper, lower = read(batch.column(4), np.float32, parts).copy(), read(batch.column(5), np.float32, parts).copy()
            error = np.zeros(len(q), np.int64)
            for j in range(parts):
                x = q[:, j * width : (j + 1) * width].astype(number)
                o, exact, u, low, _ = reassign(x, c[j], drifts[j], own[:, j].astype(np.int64), upper[:, j], lower[:, j])
                own[:, j], error = o, error + exact.astype(np.int64)
                upper[:, j], lower[:, j] = _outward(u, low)
            if last:
                arrays = [batch.column(0), batch.column(1), pc.cast(binary_column(own), pa.binary()), pa.array(error)]
                yield pa.RecordBatch.from_arrays(arrays, ["id", "label", "own", "error"])
            else:
                yield _state(batch, q, own, upper, lower)

    def sums(batches):
        n, total = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64)
        for batch in batches:
            q, own = read(batch.column(0), kind, d).astype(np.int64), read(batch.column(1), np.uint8, parts)
            for j in range(parts):
                n[j] += np.bincount(own[:, j], minlength=entries)
                np.add.at(total[j], own[:, j], q[:, j * width : (j + 1) * width])
        p, e = np.nonzero(n)
        values = pa.array(total[p, e].tolist(), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(p.astype(np.int32)), pa.array(e.astype(np.int32)), pa.array(n[p, e]), values], ["part", "entry", "n", "total"])

    shared = share(books)
    state = stored(rows.select("id", "label", "v").mapInArrow(lambda b: begin(b, shared), state_schema), "codes")
    for r in range(rounds):
        by_task = state.select("q", "own").mapInArrow(sums, "part int, entry int, n long, total array<long>")
        total = F.array(*[F.sum(F.col("total")[i]) for i in range(width)]).alias("total")
        old, books = books, books.copy()
        for e in by_task.groupBy("part", "entry").agg(F.sum("n").alias("n"), total).collect():
            books[e.part, e.entry] = np.array(e.total) // e.n
        both, last = share((old, books)), r == rounds - 1
        made = state.mapInArrow(lambda b, both=both, last=last: again(b, both, last), schema + "own binary, error long" if last else state_schema)
        state = stored(made, "codes")
    return state, books


def with_label_errors(rows: DataFrame) -> DataFrame:
    """rows with label_error: the sum of error over the rows of its label, nulls together."""
    sums = stored(rows.groupBy("label").agg(F.sum("error").alias("label_error"), F.count("*").alias("n")), "label-errors")
    return lookup(rows, sums, "label", "n", ["id", "own"])


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of all usable rows of `embeddings`."""
    rows, books = compress(table(spark, sf_dir, "embeddings"))
    return with_label_errors(rows).select(
        F.col("id").alias("vec_id"), F.lower(F.hex("own")).alias("code"), "error", "label_error", F.lit(codebooks_digest(books)).alias("codebooks_sha256")
    )


_LISTS = "list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))"
_DIST = f"list_sum({_LISTS})"


def _round_sql(r: int) -> str:
    return f"""
a{r} AS (SELECT id, part, x, arg_min(entry, (d, entry)) AS entry, min(d) AS d FROM (SELECT p.id, p.part, p.x, b.entry, {_DIST} AS d FROM parts p JOIN b{r - 1} b USING (part)) GROUP BY ALL),
m{r} AS (SELECT part, entry, list(CAST(floor(s / n) AS BIGINT) ORDER BY i) AS c FROM (
  SELECT part, entry, i, sum(x[i]) AS s, count(*) AS n FROM a{r}, range(1, {{width}} + 1) t(i) GROUP BY ALL) GROUP BY ALL),
b{r} AS (SELECT part, entry, coalesce(m.c, o.c) AS c FROM b{r - 1} o LEFT JOIN m{r} m USING (part, entry)),"""


#: For vectors of 64 components, as the table has them.
OP11_SQL = f"""WITH v AS (
  SELECT vec_id, label, row_number() OVER (ORDER BY vec_id NULLS LAST, q) AS id, q FROM (
    SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)),
parts AS (SELECT id, part, list_slice(q, part * 4 + 1, part * 4 + 4) AS x FROM v, range(16) t(part)),
b0 AS (SELECT part, id - 1 AS entry, x AS c FROM parts WHERE id <= 64),{_round_sql(1)}{_round_sql(2)}
fin AS (SELECT id, part, arg_min(entry, (d, entry)) AS entry, min(d) AS d FROM (SELECT p.id, p.part, b.entry, {_DIST} AS d FROM parts p JOIN b2 b USING (part)) GROUP BY ALL),
codes AS (SELECT id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM fin GROUP BY 1),
book AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) AS h FROM b2)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256 FROM v JOIN codes USING (id), book""".format(width=4)
