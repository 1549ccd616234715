"""Sinks: result files, vectors and labels, binary index and map files."""

from __future__ import annotations

import json
import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.labels import quoted
from ..operators.ivf import IvfPqIndex
from ..operators.kernels import matrix
from ..operators.pq import code_matrix
from ..session import number_rows
from .readers import LIST_ENTRY, local_path


def result_rows(cells: DataFrame) -> DataFrame:
    """K8: line: quoted id and label (Unknown if missing), the confidence with three decimals (1.000 if missing)."""
    label = F.coalesce("label", F.lit("Unknown"))
    confidence = F.format_string("%.3f", F.coalesce(F.col("confidence").cast("double"), F.lit(1.0)))
    return cells.select("cell_id", F.concat_ws(",", quoted(F.col("cell_id").cast("string")), quoted(label), confidence).alias("line"))


def write_results(cells: DataFrame, path: str) -> None:
    """K8: text files with the header in each, as Spark writes them; cells keep their partitions."""
    cells.select("cell_id", F.coalesce("label", F.lit("Unknown")).alias("category_label"), F.coalesce(F.col("confidence").cast("double"), F.lit(1.0)).alias("c")).select(
        "cell_id", "category_label", F.format_string("%.3f", "c").alias("confidence")
    ).write.mode("overwrite").option("header", True).option("quoteAll", True).csv(path)


def write_labels_csv(cells: DataFrame, path: str) -> None:
    """K9: cell_id, category_label, all quoted."""
    cells.select("cell_id", F.col("label").alias("category_label")).write.mode("overwrite").option("header", True).option("quoteAll", True).csv(path)


def write_vectors(vectors: DataFrame, path: str) -> None:
    """K1, K3, K7: a table clustered by id, which range scans prune by. `write_npy` writes the file of the same rows."""
    vectors.repartitionByRange("vec_id").sortWithinPartitions("vec_id").write.mode("overwrite").parquet(path)


def write_training_ids(sample: DataFrame, path: str) -> None:
    """K7: the ids of a training sample."""
    sample.select("vec_id").repartitionByRange("vec_id").sortWithinPartitions("vec_id").write.mode("overwrite").parquet(path)


def write_label_columns(labels: DataFrame, path: str) -> None:
    """K2."""
    labels.write.mode("overwrite").option("compression", "snappy").parquet(path)


def write_npy(vectors: DataFrame, path: str) -> None:
    """K1, K3: an .npy file of floats whose row number is the vector's id, on a mounted path that all machines share: it
    is made in full size first, then every task writes its rows where they belong. Ids go from 0 without a gap."""
    place = local_path(path)
    shape = vectors.agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("d"), F.min("vec_id").alias("low"), F.max("vec_id").alias("high")).first()
    if shape.n and (shape.low, shape.high) != (0, shape.n - 1):
        raise ValueError("ids of an npy file go from 0 without a gap")
    os.makedirs(os.path.dirname(place) or ".", exist_ok=True)
    np.lib.format.open_memmap(place, "w+", np.float32, (shape.n, shape.d or 0)).flush()
    d = shape.d or 0

    def put(batches):
        for batch in batches:
            rows = np.load(place, mmap_mode="r+")
            rows[batch.column(0).to_numpy()] = matrix(batch.column(1), d)
            rows.flush()
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    if shape.n:
        vectors.select("vec_id", "embedding").mapInArrow(put, "n long").agg(F.sum("n")).collect()


def list_file(number: int) -> str:
    return f"partition_{number:04d}.bin"


def _put(spark: SparkSession, path: str, data: bytes) -> None:
    """A file of bounded size, through the Hadoop file system of its path."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()


def write_binary_index(index: IvfPqIndex, folder: str) -> int:
    """K4, K5: the interoperable files: ivf_centroids.bin, ivf_metadata.json, pq_codebooks.bin, pq_metadata.json, and of
    every list that has vectors partitions/partition_NNNN.bin (more digits from 10,000 on), written by the task that has the list. How many lists were
    written. The folder is one that `pyarrow.fs` knows on all machines."""
    spark = index.lists.sparkSession
    c, book, m = index.centroids.astype("<f4"), index.pq.codebook, index.pq.m
    _put(spark, f"{folder}/ivf_centroids.bin", np.array(c.shape, "<u4").tobytes() + c.tobytes())
    _put(spark, f"{folder}/pq_codebooks.bin", np.where(np.isfinite(book), book, 3.4e38).astype("<f4").tobytes())
    _put(spark, f"{folder}/ivf_metadata.json", json.dumps(index.metadata).encode())
    _put(spark, f"{folder}/pq_metadata.json", json.dumps(index.pq.metadata()).encode())

    def put(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        from pyarrow import fs

        ids = rows.column("vec_id").to_numpy()
        if len(ids) and not -(1 << 31) <= ids.min() <= ids.max() < 1 << 31:
            raise ValueError("list files have ids of 32 bits")
        order = np.argsort(ids, kind="stable")
        entries = np.empty(len(ids), LIST_ENTRY(m))
        entries["id"], entries["codes"] = ids[order], code_matrix(rows.column("codes"), m)[order]
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(f"{root}/partitions", recursive=True)
        with store.open_output_stream(f"{root}/partitions/{list_file(key[0].as_py())}", compression=None) as out:
            out.write(np.array([len(ids), m], "<u4").tobytes() + entries.tobytes())
        return pa.table({"n": pa.array([len(ids)], pa.int64())})

    return index.lists.select("partition_id", "vec_id", "codes").groupBy("partition_id").applyInArrow(put, "n long").count()


def write_map(points: DataFrame, dictionary: DataFrame, metadata: dict, folder: str) -> None:
    """K6: x, y and label code files and the metadata, points in id order. On a mounted folder the files are made in full
    size and every task writes its stretch of them; elsewhere they pass through the driver, their size being bounded by what
    a browser loads."""
    spark = points.sparkSession
    categories: dict[str, list[str]] = {}
    for r in dictionary.orderBy("column", "code").collect():
        categories.setdefault(r.column, []).append(r.category)
    kinds = {"x": "<f4", "y": "<f4", **dict.fromkeys(categories, "<i2")}
    try:
        place = local_path(folder)
    except ValueError:
        rows = points.orderBy("vec_id").toPandas()
        n = len(rows)
        for c, kind in kinds.items():
            _put(spark, f"{folder}/{c}.bin", rows[c].to_numpy().astype(kind).tobytes())
    else:
        numbered = number_rows(points.select("vec_id", *kinds), "vec_id", "__at").select("__at", *kinds)
        n = numbered.count()
        os.makedirs(place, exist_ok=True)
        for c, kind in kinds.items():
            with open(f"{place}/{c}.bin", "wb") as f:
                f.truncate(n * np.dtype(kind).itemsize)

        def put(batches):
            for batch in batches:
                at = batch.column(0).to_numpy()
                for k, (c, kind) in enumerate(kinds.items() if len(at) else ()):
                    values = np.memmap(f"{place}/{c}.bin", kind, "r+")
                    values[at] = batch.column(k + 1).to_numpy(zero_copy_only=False)
                    values.flush()
                yield pa.RecordBatch.from_arrays([pa.array([len(at)], pa.int64())], ["n"])

        numbered.mapInArrow(put, "n long").agg(F.sum("n")).collect()
    _put(spark, f"{folder}/metadata.json", json.dumps({**metadata, "categories": categories, "numPoints": n}).encode())
