"""Product quantisation."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .clustering import bounded_sample, train_kmeans
from .kernels import matrix, nearest

_CELLS = 1 << 22


@dataclass(frozen=True)
class ProductQuantizer:
    """codebook: m x k x d_sub; words that a subspace does not have are infinite, so they are never chosen."""

    codebook: np.ndarray

    @property
    def m(self) -> int:
        return self.codebook.shape[0]

    @property
    def k(self) -> int:
        return self.codebook.shape[1]

    @property
    def d(self) -> int:
        return self.codebook.shape[0] * self.codebook.shape[2]

    @property
    def d_sub(self) -> int:
        return self.codebook.shape[2]

    @property
    def compression_ratio(self) -> float:
        return self.d * 32 / (self.m * 8)

    def metadata(self) -> dict:
        """D11."""
        return {
            "d": self.d, "m": self.m, "k": self.k, "d_sub": self.d_sub, "compression_ratio": self.compression_ratio,
            "codebooks_shape": list(self.codebook.shape), "codebooks_size": int(self.codebook.size), "version": "1.0",
        }

    def table(self, x: np.ndarray) -> np.ndarray:
        """squared distances of each subvector to each word, n x m x k."""
        parts = x.reshape(len(x), self.m, 1, self.d_sub)
        return ((parts - self.codebook[None]) ** 2).sum(axis=3)

    def encode(self, x: np.ndarray) -> np.ndarray:
        """nearest word of each subspace, the lowest code among equals."""
        if x.shape[1] != self.d:
            raise ValueError(f"vectors have {x.shape[1]} dimensions, the quantizer {self.d}")
        step = max(1, _CELLS // (self.k * self.d))
        parts = [self.table(x[lo : lo + step]).argmin(axis=2) for lo in range(0, len(x), step)]
        return np.concatenate(parts).astype(np.uint8) if parts else np.zeros((0, self.m), np.uint8)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        """F4."""
        return self.codebook[np.arange(self.m), codes].reshape(len(codes), self.d)

    def distances(self, table: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """A3: squared distances of queries (their tables) x codes, summed over subspaces in order."""
        total = np.zeros((len(table), len(codes)))
        for j in range(self.m):
            total += table[:, j, codes[:, j]]
        return total


def check_shape(d: int, m: int, k: int) -> None:
    if m < 1 or d % m:
        raise ValueError(f"{d} dimensions do not divide into {m} subspaces")
    if not 1 <= k <= 256:
        raise ValueError("a code is a byte: k is 1 to 256")


def from_words(words: list[np.ndarray]) -> ProductQuantizer:
    """Words per subspace; shorter lists are filled up with words that are never chosen."""
    k = max(len(w) for w in words)
    return ProductQuantizer(np.stack([np.pad(w, ((0, k - len(w)), (0, 0)), constant_values=np.inf) for w in words]))


def train_quantizer(x: np.ndarray, m: int, k: int = 256, max_iter: int = 50, seed: int = 42, spark=None) -> ProductQuantizer:
    """A2: k-means in every subspace, seed + j. With a session the subspaces are trained by one task each."""
    check_shape(x.shape[1], m, k)
    parts = x.reshape(len(x), m, -1)
    if spark is None:
        return from_words([train_kmeans(parts[:, j], k, max_iter, seed + j) for j in range(m)])
    data = pa.table({"j": pa.array(range(m), pa.int32()), "x": pa.array([np.ascontiguousarray(parts[:, j]).tobytes() for j in range(m)], pa.binary())})
    d_sub = x.shape[1] // m

    def train(batches):
        for batch in batches:
            for j, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                c = train_kmeans(np.frombuffer(raw).reshape(-1, d_sub), k, max_iter, seed + j)
                yield pa.RecordBatch.from_arrays([pa.array([j], pa.int32()), pa.array([c.tobytes()], pa.binary())], ["j", "c"])

    found = spark.createDataFrame(data).repartition(m, "j").mapInArrow(train, "j int, c binary").collect()
    return from_words([np.frombuffer(bytes(r.c)).reshape(-1, d_sub) for r in sorted(found)])


def train_quantizer_on(vectors: DataFrame, m: int, k: int = 256, max_iter: int = 50, sample: int = 65_536, seed: int = 42, **cols) -> ProductQuantizer:
    """Q2: on a bounded sample of a table."""
    return train_quantizer(bounded_sample(vectors, sample, seed=seed, **cols), m, k, max_iter, seed, vectors.sparkSession)


def refine_words(sample: DataFrame, pq: ProductQuantizer, centroids: np.ndarray, rounds: int = 5) -> ProductQuantizer:
    """The words after Lloyd steps over the residuals of a whole table (i, v), each a pass in which a task sends a row of
    sums for each word."""
    shared, m, w = sample.sparkSession.sparkContext.broadcast(centroids), pq.m, pq.d_sub
    for _ in range(rounds):
        words = sample.sparkSession.sparkContext.broadcast(pq)

        def run(batches, words=words):
            q, c = words.value, shared.value
            total = np.zeros((m, q.k, w + 1))
            for batch in batches:
                x = matrix(batch.column(0), q.d)
                own, _ = nearest(x, c)
                res = x - c[own]
                codes = q.encode(res)
                for j in range(m):
                    np.add.at(total[j], codes[:, j], np.concatenate([np.ones((len(x), 1)), res[:, j * w : (j + 1) * w]], axis=1))
            j, code = np.nonzero(total[:, :, 0])
            yield pa.RecordBatch.from_arrays([pa.array((j * q.k + code).astype(np.int32)), pa.array(list(total[j, code]), pa.list_(pa.float64()))], ["p", "s"])

        sums = sample.select("v").mapInArrow(run, "p int, s array<double>").groupBy("p").agg(F.array(*[F.sum(F.col("s")[i]) for i in range(w + 1)]).alias("s"))
        book = pq.codebook.copy()
        for r in sums.collect():
            book[r.p // pq.k, r.p % pq.k] = np.array(r.s[1:]) / r.s[0]
        pq = ProductQuantizer(book)
    return pq


def encode_vectors(vectors: DataFrame, pq: ProductQuantizer, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, codes (a byte each)."""
    shared = vectors.sparkSession.sparkContext.broadcast(pq)

    def run(batches):
        for batch in batches:
            codes = shared.value.encode(matrix(batch.column(1), shared.value.d))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([c.tobytes() for c in codes], pa.binary())], ["vec_id", "codes"])

    return usable(vectors, id_col, vector_col).mapInArrow(run, "vec_id long, codes binary")


def decode_vectors(codes: DataFrame, pq: ProductQuantizer) -> DataFrame:
    """vec_id, embedding as the words say."""
    shared = codes.sparkSession.sparkContext.broadcast(pq)

    def run(batches):
        for batch in batches:
            x = shared.value.decode(code_matrix(batch.column(1), shared.value.m))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(x), pa.list_(pa.float64()))], ["vec_id", "embedding"])

    return codes.select("vec_id", "codes").mapInArrow(run, "vec_id long, embedding array<double>")


def reconstruction(vectors: DataFrame, pq: ProductQuantizer, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, mse, relative_error (norm of the difference over the norm; null for a zero vector)."""
    shared = vectors.sparkSession.sparkContext.broadcast(pq)

    def run(batches):
        for batch in batches:
            x = matrix(batch.column(1), shared.value.d)
            wrong = ((x - shared.value.decode(shared.value.encode(x))) ** 2).sum(axis=1)
            size = np.sqrt((x * x).sum(axis=1))
            relative = np.sqrt(wrong) / np.where(size > 0, size, np.nan)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(wrong / x.shape[1]), pa.array(relative, from_pandas=True)], ["vec_id", "mse", "relative_error"])

    return usable(vectors, id_col, vector_col).mapInArrow(run, "vec_id long, mse double, relative_error double")


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    return vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v")).where("vec_id IS NOT NULL AND v IS NOT NULL")


def code_matrix(column: pa.Array, m: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, m)
