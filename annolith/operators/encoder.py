"""The pluggable encoder, its built-in forms, and occlusion importance (2.10, Q8, Q10, F11, T7, P9).

An encoder turns a batch of raw-count rows over the vocabulary into vectors. It runs in Arrow batches, one instance per
Python worker.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .kernels import matrix


class Encoder(Protocol):
    n_genes: int

    def encode(self, x: np.ndarray) -> np.ndarray:
        """n x n_genes raw counts to n x d."""


def preprocess(x: np.ndarray, total: float = 1e4) -> np.ndarray:
    """F7-F9 on dense rows."""
    x = np.nan_to_num(x.astype(np.float64), posinf=np.finfo(np.float32).max, neginf=np.finfo(np.float32).min)
    s = x.sum(axis=1, keepdims=True)
    return np.log1p(x * (total / np.where(s == 0, 1, s)))


@dataclass(frozen=True)
class LinearEncoder:
    """Weights n_genes x d; normalised rows, optionally to unit length."""

    weights: np.ndarray
    normalise: bool = True
    unit: bool = False

    @property
    def n_genes(self) -> int:
        return len(self.weights)

    def encode(self, x: np.ndarray) -> np.ndarray:
        y = (preprocess(x) if self.normalise else x) @ self.weights
        if self.unit:
            y = y / np.maximum(np.sqrt((y * y).sum(axis=1, keepdims=True)), 1e-12)
        return y


@dataclass(frozen=True)
class MlpEncoder:
    """Dense layers with rectifiers between them."""

    layers: tuple[tuple[np.ndarray, np.ndarray], ...]
    unit: bool = True

    @property
    def n_genes(self) -> int:
        return len(self.layers[0][0])

    def encode(self, x: np.ndarray) -> np.ndarray:
        y = preprocess(x)
        for i, (w, b) in enumerate(self.layers):
            y = y @ w + b
            if i < len(self.layers) - 1:
                y = np.maximum(y, 0)
        return y / np.maximum(np.sqrt((y * y).sum(axis=1, keepdims=True)), 1e-12) if self.unit else y


@dataclass
class OnnxEncoder:
    """A supplied model graph; needs onnxruntime. `model` is its bytes, so that workers need no common path."""

    model: bytes
    n_genes: int

    def encode(self, x: np.ndarray) -> np.ndarray:
        session = self.__dict__.get("_session")
        if session is None:
            import onnxruntime

            session = self.__dict__["_session"] = onnxruntime.InferenceSession(self.model, providers=["CPUExecutionProvider"])
        return session.run(None, {session.get_inputs()[0].name: x.astype(np.float32)})[0].astype(np.float64)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_session"}


def _gather(aligned: DataFrame) -> DataFrame:
    entry = F.struct(F.col("model_idx").cast("int").alias("i"), F.col("value").cast("double").alias("v"))
    rows = aligned.groupBy("cell_id").agg(F.array_sort(F.collect_list(entry)).alias("e"))
    return rows.select("cell_id", F.col("e.i").alias("i"), F.col("e.v").alias("v"))


class _Rows:
    """Gathered rows of an Arrow batch: the entries of all rows side by side, and where each row's begin."""

    def __init__(self, batch: pa.RecordBatch):
        self.i = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        self.v = batch.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # null values are NaN
        self.starts = np.append(0, np.cumsum(pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False)))

    def dense(self, low: int, high: int, n: int) -> np.ndarray:
        x = np.zeros((high - low, n))
        a, b = self.starts[low], self.starts[high]
        x[np.repeat(np.arange(high - low), np.diff(self.starts[low : high + 1])), self.i[a:b]] = self.v[a:b]
        return x


def embed(aligned: DataFrame, encoder: Encoder) -> DataFrame:
    """cell_id, embedding from aligned raw counts (cell_id, model_idx, value). A row has at most n_genes entries."""
    shared = aligned.sparkSession.sparkContext.broadcast(encoder)
    kind = aligned.schema["cell_id"].dataType

    def run(batches):
        e = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            rows, n = _Rows(batch), batch.num_rows
            y = np.concatenate([e.encode(rows.dense(lo, min(n, lo + 256), e.n_genes)) for lo in range(0, n, 256)])
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, y.size + 1, y.shape[1]), pa.int32()), pa.array(y.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["cell_id", "embedding"])

    from pyspark.sql import types as T

    return _gather(aligned).mapInArrow(run, T.StructType().add("cell_id", kind).add("embedding", T.ArrayType(T.DoubleType())))


def embed_dense(rows: DataFrame, encoder: Encoder) -> DataFrame:
    """cell_id, embedding from raw counts as rows of a matrix (cell_id, value: an array of n_genes). A cell without a count has no embedding."""
    from pyspark.sql import types as T

    shared = rows.sparkSession.sparkContext.broadcast(encoder)
    schema = T.StructType().add("cell_id", rows.schema["cell_id"].dataType).add("embedding", T.ArrayType(T.DoubleType()))

    def run(batches):
        e = shared.value
        for batch in batches:
            x = matrix(batch.column(1), e.n_genes)
            has = x.any(axis=1)
            full = x[has]
            y = np.concatenate([e.encode(full[lo : lo + 256]) for lo in range(0, len(full), 256)] or [np.zeros((0, 1))])
            ends = np.append(0, np.cumsum(has * y.shape[1]))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(y.ravel()), mask=pa.array(~has))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["cell_id", "embedding"])

    return rows.select("cell_id", "value").mapInArrow(run, schema)


def importance(aligned: DataFrame, encoder: Encoder, above: float = 0.1, batch: int = 128) -> DataFrame:
    """Q10: cell_id, model_idx, expression, importance: how far the cell's vector moves (L2) when an expressed gene's
    raw count is set to 0. A cell's genes are occluded together in batches; only moves above 0 are returned."""
    shared = aligned.sparkSession.sparkContext.broadcast(encoder)

    def run(batches):
        e = shared.value
        for b in batches:
            rows = _Rows(b)
            for k, cell in enumerate(b.column(0)):
                x = rows.dense(k, k + 1, e.n_genes)
                base = e.encode(x)
                entries = slice(rows.starts[k], rows.starts[k + 1])
                own = rows.i[entries][rows.v[entries] > above]
                moved = np.zeros(len(own))
                for lo in range(0, len(own), batch):
                    part = own[lo : lo + batch]
                    y = np.repeat(x, len(part), axis=0)
                    y[np.arange(len(part)), part] = 0
                    moved[lo : lo + batch] = np.sqrt(((e.encode(y) - base) ** 2).sum(axis=1))
                keep = moved > 0
                n = int(keep.sum())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([cell.as_py()] * n, cell.type), pa.array(own[keep].astype(np.int32)), pa.array(x[0, own[keep]]), pa.array(moved[keep])],
                    ["cell_id", "model_idx", "expression", "importance"],
                )

    from pyspark.sql import types as T

    kind = aligned.schema["cell_id"].dataType
    schema = T.StructType().add("cell_id", kind).add("model_idx", "integer").add("expression", "double").add("importance", "double")
    return _gather(aligned).mapInArrow(run, schema)


def top_genes(found: DataFrame, vocabulary: DataFrame, top: int | None = 10) -> DataFrame:
    """The `top` genes of every cell, importance first, then the lower index; 0 and None mean 10."""
    order = Window.partitionBy("cell_id").orderBy(F.desc("importance"), "model_idx")
    first = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= (top or 10))
    return first.join(vocabulary.select("model_idx", F.col("symbol").alias("gene")), "model_idx")
