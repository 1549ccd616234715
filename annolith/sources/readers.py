"""Sources: MatrixMarket triples, vocabularies, tables of vectors and labels, binary index files, maps, registries.

S9-S11, S13-S21 (S1: cells). Everything goes through Spark's readers, so any store that Spark reads will do.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import shutil
import time
import urllib.request
import uuid
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ivf, pq

MTX_FILES = ("matrix.mtx.gz", "barcodes.tsv.gz", "features.tsv.gz")


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """line, n (from 1) of a text file. A file of names is one read; gzip files cannot be split anyway."""
    return spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("p", "line")).select("line", (F.col("p") + 1).alias("n")).where("line <> ''")


def matrix_market(spark: SparkSession, folder: str, sample: str | None = None) -> DataFrame:
    """Barcode, symbol, value (and sample_id, cell_id) of one 10x folder. Column 1 of the entries is the feature, 2
    the cell; lines of % and the line of sizes are no entries."""
    lines = spark.read.text(f"{folder}/{MTX_FILES[0]}").where(~F.col("value").startswith("%"))
    parts = lines.select(F.split(F.trim("value"), r"\s+").alias("p"))
    entries = parts.select(F.col("p")[0].cast("long").alias("g"), F.col("p")[1].cast("long").alias("c"), F.col("p")[2].cast("double").alias("value"))
    # the first line left is that of the sizes: it opens the first split of the file
    entries = entries.withColumn("__n", F.monotonically_increasing_id()).where("__n > 0").drop("__n")
    cells = numbered_lines(spark, f"{folder}/{MTX_FILES[1]}").select(F.col("n").alias("c"), F.col("line").alias("barcode"))
    genes = numbered_lines(spark, f"{folder}/{MTX_FILES[2]}").select(F.col("n").alias("g"), F.coalesce(F.get(F.split("line", "\t"), F.lit(1)), F.split("line", "\t")[0]).alias("symbol"))
    rows = entries.join(genes, "g").join(cells, "c").select("barcode", "symbol", "value")
    return rows if sample is None else rows.select(F.lit(sample).alias("sample_id"), F.concat_ws("_", F.lit(sample), "barcode").alias("cell_id"), "symbol", "value")


def matrix_market_samples(spark: SparkSession, folders: dict[str, str]) -> DataFrame:
    """All samples that have their three files; the others are left out."""
    whole = {s: f for s, f in folders.items() if all(exists(spark, f"{f}/{x}") for x in MTX_FILES)}
    if not whole:
        return spark.createDataFrame([], "sample_id string, cell_id string, symbol string, value double")
    return reduce(DataFrame.unionByName, [matrix_market(spark, f, s) for s, f in sorted(whole.items())])


def vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """model_idx, symbol by line. Lines are not trimmed; a last empty line is no symbol."""
    lines = spark.read.text(path, wholetext=True).select(F.split(F.regexp_replace("value", "\n$", ""), "\n").alias("s"))
    return lines.select(F.posexplode("s").alias("model_idx", "symbol"))


def tsv_labels(spark: SparkSession, path: str) -> DataFrame:
    """Pos, label: the first field of every line."""
    return numbered_lines(spark, path).select((F.col("n") - 1).alias("pos"), F.split("line", "\t")[0].alias("label"))


def embeddings(spark: SparkSession, path: str, low: int = 0, high: int | None = None, columns: tuple[str, ...] = ("vec_id", "embedding")) -> DataFrame:
    """Columns of a table for ids from low to below high; both reach the scan."""
    rows = spark.read.parquet(path).where(F.col("vec_id") >= low)
    return (rows if high is None else rows.where(F.col("vec_id") < high)).select(*columns)


def local_path(path: str) -> str:
    """The place of a file on a mounted path; other stores have none."""
    if "://" in path and not path.startswith("file://") or ":" in path.split("/")[0] and not path.startswith("file:"):
        raise ValueError(f"{path} is on no mounted path")
    return re.sub("^file:(//)?", "", path)


def npy_vectors(spark: SparkSession, path: str, max_vectors: int | None = None, rows_per_batch: int = 10_000, rows_per_task: int = 1_000_000) -> DataFrame:
    """vec_id, embedding of an .npy file of floats in C order, the first rows if asked for. A file on a mounted path is
    read by ranges of rows, each task its own; one in another store is read whole by one task, as Spark's reader for it
    has no splits."""

    def rows_of(x: np.ndarray, low: int, high: int):
        for lo in range(low, high, rows_per_batch):
            part = np.ascontiguousarray(x[lo : min(high, lo + rows_per_batch)], np.float32)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, part.size + 1, x.shape[1]), pa.int32()), pa.array(part.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(lo, lo + len(part))), flat], ["vec_id", "embedding"])

    def checked(x: np.ndarray) -> int:
        if x.ndim != 2:
            raise ValueError("an npy file of vectors is two-dimensional")
        return len(x) if max_vectors is None else min(max_vectors, len(x))

    schema = "vec_id long, embedding array<float>"
    try:
        place = local_path(path)
    except ValueError:
        place = None
    if place is not None:
        n = checked(np.load(place, mmap_mode="r", allow_pickle=False))

        def ranges(batches):
            for batch in batches:
                x = np.load(place, mmap_mode="r", allow_pickle=False)
                for low in batch.column(0).to_pylist():
                    yield from rows_of(x, low, min(n, low + rows_per_task))

        tasks = max(1, -(-n // rows_per_task))
        return spark.range(0, n, rows_per_task, tasks).mapInArrow(ranges, schema)

    def parse(batches):
        import io

        for batch in batches:
            for content in batch.column(0):
                x = np.load(io.BytesIO(content.as_buffer()), allow_pickle=False)
                yield from rows_of(x, 0, checked(x))

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(parse, schema)


def LIST_ENTRY(m: int) -> np.dtype:
    """An entry of a list file: a signed 32-bit id and m bytes."""
    return np.dtype([("id", "<i4"), ("codes", "u1", (m,))])


_LIST_FILE = re.compile(r"partition_(\d{4,})\.bin$")


def read_inverted_lists(spark: SparkSession, folder: str, m: int) -> DataFrame:
    """partition_id, vec_id, codes of the list files `partition_NNNN.bin`: a header of two unsigned 32-bit integers
    (how many, m), then the entries. The list is the file's number; m and the size must agree, and a file of another name
    is an error."""
    files = spark.read.format("binaryFile").load(folder).select("path", "content")

    def parse(batches):
        for batch in batches:
            for path, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                name = _LIST_FILE.search(path)
                if not name:
                    raise ValueError(f"{path} is no list file")
                n, own = (int(x) for x in np.frombuffer(raw, "<u4", 2))
                if own != m:
                    raise ValueError(f"{path} has codes of {own} bytes, not {m}")
                if len(raw) != 8 + n * (4 + m):
                    raise ValueError(f"{path} does not have {n} entries")
                rows = np.frombuffer(raw, LIST_ENTRY(m), n, 8)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, int(name[1]), np.int32)), pa.array(rows["id"].astype(np.int64)), pa.array([c.tobytes() for c in rows["codes"]], pa.binary())],
                    ["partition_id", "vec_id", "codes"],
                )

    return files.mapInArrow(parse, "partition_id int, vec_id long, codes binary")


def read_binary_index(spark: SparkSession, folder: str) -> ivf.IvfPqIndex:
    """The index whose files `write_binary_index` and others write."""
    meta, own = read_json(spark, f"{folder}/ivf_metadata.json"), read_json(spark, f"{folder}/pq_metadata.json")
    centroids = read_centroids(spark, f"{folder}/ivf_centroids.bin")
    if centroids.shape != (meta["n_partitions"], meta["d"]):
        raise ValueError(f"centroids have the shape {centroids.shape}, the metadata say {meta['n_partitions']} x {meta['d']}")
    book = read_codebook(spark, f"{folder}/pq_codebooks.bin", own)
    return ivf.IvfPqIndex(centroids, pq.ProductQuantizer(np.where(book > 3e38, np.inf, book)), read_inverted_lists(spark, f"{folder}/partitions", own["m"]), None, meta)


def _content(spark: SparkSession, path: str) -> bytes:
    """A small file: centroids, codebook, metadata."""
    return bytes(spark.read.format("binaryFile").load(path).first().content)


def read_centroids(spark: SparkSession, path: str) -> np.ndarray:
    """A header of two unsigned 32-bit integers (lists, d), then floats."""
    raw = _content(spark, path)
    n, d = (int(x) for x in np.frombuffer(raw, "<u4", 2))
    if len(raw) != 8 + 4 * n * d:
        raise ValueError(f"{path} does not have {n} x {d} floats")
    return np.frombuffer(raw, "<f4", offset=8).reshape(n, d).astype(np.float64)


def read_codebook(spark: SparkSession, path: str, metadata: dict) -> np.ndarray:
    """Floats without a header, the shape from the metadata."""
    x = np.frombuffer(_content(spark, path), "<f4")
    shape = metadata["m"], metadata["k"], metadata["d_sub"]
    if x.size != np.prod(shape):
        raise ValueError(f"{path} has {x.size} floats, the metadata say {shape}")
    return x.reshape(shape).astype(np.float64)


def read_json(spark: SparkSession, path: str) -> dict:
    return json.loads(_content(spark, path))


def read_map(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, dict]:
    """Points (vec_id, x, y, a code column per label), dictionary (column, code, category), metadata. Coordinate
    files must have as many values as the metadata say; label files cover all vectors, of which the points are the
    first."""
    meta = read_json(spark, f"{folder}/metadata.json")
    n = meta["numPoints"]
    columns = {"x": "<f4", "y": "<f4", **{c: "<i2" for c in meta["categories"]}}
    rows = [(c, k, name) for c, names in meta["categories"].items() for k, name in enumerate(names)]
    dictionary = spark.createDataFrame(rows or [], "column string, code int, category string")
    try:
        place = local_path(folder)
    except ValueError:  # small files of another store come through the driver
        place, data = None, {c: np.frombuffer(_content(spark, f"{folder}/{c}.bin"), kind) for c, kind in columns.items()}
        sizes = {c: len(v) for c, v in data.items()}
    else:
        sizes = {c: os.path.getsize(f"{place}/{c}.bin") // np.dtype(kind).itemsize for c, kind in columns.items()}
    for c, size in sizes.items():
        if size != n if c in "xy" else size < n:
            raise ValueError(f"{c}.bin has {size} values for {n} points")

    def arrays(values: dict, low: int, high: int) -> list[pa.Array]:
        out = [np.arange(low, high)] + [values[c][low:high].astype(np.float64 if kind == "<f4" else np.int32) for c, kind in columns.items()]
        return [pa.array(v) for v in out]

    if place is None:
        return spark.createDataFrame(pa.table(dict(zip(["vec_id", *columns], arrays(data, 0, n))))), dictionary, meta

    def ranges(batches):
        for batch in batches:
            values = {c: np.memmap(f"{place}/{c}.bin", kind, "r") for c, kind in columns.items()} if n else {}
            for low in batch.column(0).to_pylist():
                for at in range(low, min(n, low + _MAP_ROWS), 10_000):
                    yield pa.RecordBatch.from_arrays(arrays(values, at, min(n, low + _MAP_ROWS, at + 10_000)), ["vec_id", *columns])

    schema = "vec_id long, " + ", ".join(f"`{c}` {'double' if kind == '<f4' else 'int'}" for c, kind in columns.items())
    return spark.range(0, n, _MAP_ROWS, max(1, -(-n // _MAP_ROWS))).mapInArrow(ranges, schema), dictionary, meta


#: Points of a map that a task reads.
_MAP_ROWS = 1_000_000


def fetch(url: str, cache: str) -> str:
    """A file by its URL, kept in a folder under a name made of the URL: fetched once, under another name until it is
    whole. The place of the file; the folder is one that all machines share."""
    place = os.path.join(local_path(cache), _cached_name(url))
    if not os.path.exists(place):
        os.makedirs(os.path.dirname(place), exist_ok=True)
        part = f"{place}.{uuid.uuid4().hex}"
        with urllib.request.urlopen(url) as source, open(part, "wb") as f:
            shutil.copyfileobj(source, f)
        os.replace(part, place)
    return place


def _cached_name(url: str) -> str:
    return hashlib.sha256(url.encode()).hexdigest()[:32] + "-" + re.sub(r"[^A-Za-z0-9._-]", "_", url.rsplit("/", 1)[-1])[-80:]


def fetch_all(urls: DataFrame, cache: str, attempts: int = 3, timeout: float = 60.0) -> DataFrame:
    """S17 for many files: url, place, length, sha256 of each row's url, fetched by the executors, a row at a time, into a folder that all machines
    share (one that `pyarrow.fs` knows). urls: url and, if it has them, the length and sha256 that the file must have.

    A file is written under another name and moved to its own when it is whole and right, so neither a task that is stopped nor one
    that runs twice leaves a part. What is there already is not fetched again. An answer other than OK, or a
    file of another length or digest, is tried again, so many times, and then is an error. Null urls are left out."""
    given = {c: F.col(c) if c in urls.columns else F.lit(None) for c in ("length", "sha256")}
    rows = urls.select("url", given["length"].cast("long").alias("length"), F.lower(given["sha256"].cast("string")).alias("sha256")).where("url IS NOT NULL").distinct()

    def run(batches):
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(cache)
        store.create_dir(root, recursive=True)

        def copied(source, out) -> tuple[int, str]:
            n, digest = 0, hashlib.sha256()
            while chunk := source.read(1 << 20):
                n += len(chunk)
                digest.update(chunk)
                if out is not None:
                    out.write(chunk)
            return n, digest.hexdigest()

        def one(url: str, length: int | None, sha256: str | None) -> tuple[int, str]:
            place = f"{root}/{_cached_name(url)}"
            if store.get_file_info(place).type == fs.FileType.File:
                with store.open_input_stream(place, compression=None) as kept:
                    found = copied(kept, None)
                if length in (None, found[0]) and sha256 in (None, found[1]):
                    return found
            for attempt in range(attempts):
                part = f"{place}.{uuid.uuid4().hex}"
                try:
                    with urllib.request.urlopen(url, timeout=timeout) as source, store.open_output_stream(part, compression=None) as out:
                        said = source.headers.get("Content-Length")
                        found = copied(source, out)
                    if said is not None and int(said) != found[0] or length not in (None, found[0]) or sha256 not in (None, found[1]):
                        raise OSError(f"{url} has {found[0]} bytes with digest {found[1]}, which is not what it should have")
                    store.move(part, place)
                    return found
                except OSError:  # those of urllib among them
                    if store.get_file_info(part).type == fs.FileType.File:
                        store.delete_file(part)
                    if attempt + 1 == attempts:
                        raise
                    time.sleep(0.2 * 2**attempt)

        for batch in batches:
            names = batch.column(0).to_pylist()
            found = [one(*x) for x in zip(names, batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            places = [f"{cache.rstrip('/')}/{_cached_name(u)}" for u in names]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(places, pa.string()), pa.array([n for n, _ in found], pa.int64()), pa.array([d for _, d in found], pa.string())], ["url", "place", "length", "sha256"])

    return rows.repartition(rows.sparkSession.sparkContext.defaultParallelism, "url").mapInArrow(run, "url string, place string, length long, sha256 string")


def models(spark: SparkSession, path: str, user_indexes: DataFrame | None = None) -> DataFrame:
    """Name, kind, id: models by line, empty lines left out, then user indexes."""
    base = spark.read.text(path).where("trim(value) <> ''").select(F.trim("value").alias("name"), F.lit("model").alias("kind"), F.trim("value").alias("id"))
    return base if user_indexes is None else base.unionByName(user_indexes.select("name", F.lit("user").alias("kind"), "id"))
