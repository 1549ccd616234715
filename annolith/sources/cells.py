"""HDF5 cell files as a Spark data source, read by ranges of rows.

`spark.read.format("cells").option("path", ...).load()` gives the long matrix (cell_id, gene_idx, symbol, value) of the
raw counts; `.option("table", "obs")` or "var" the annotations. A partition reads its rows through the row pointers of a
sparse matrix or by slices of a dense one, so no task sees the whole file. The format needs a library (h5py) that is
loaded where it is used: without it only these reads fail, and say so.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .discovery import CELL_NAMES, GENE_NAMES, NotFound, raw_counts_key

ROWS_PER_PARTITION = 10_000


def _open(path: str):
    try:
        import h5py
    except ImportError as e:
        raise RuntimeError("HDF5 cell files need h5py, which is not installed; convert the file to Parquet or MatrixMarket") from e
    place = path.removeprefix("file://")
    if not os.path.exists(place):
        raise ValueError(f"{path} is not on this machine: cell files must be in a folder that all machines mount")
    try:
        return h5py.File(place, "r")
    except OSError as e:
        raise ValueError(f"Failed to extract data: {path} is no HDF5 file") from e


def _is_group(node) -> bool:
    return hasattr(node, "keys")


def _text(values) -> list[str]:
    return [x.decode() if isinstance(x, bytes) else str(x) for x in values]


def read_strings(group, key: str, low: int = 0, high: int | None = None) -> list[str] | None:
    """Rows of a flat column or a categorical one {categories, codes}; a code below 0 gives an empty string."""
    node = group[key]
    if not _is_group(node):
        return _text(node[low:high])
    if "categories" in node.keys() and "codes" in node.keys():
        names = _text(node["categories"][:])
        return [names[c] if c >= 0 else "" for c in np.asarray(node["codes"][low:high], np.int64)]
    return None


def _cell_column(file):
    """The obs dataset, of which a record's first field is the name, or the first readable candidate of the group."""
    if "obs" not in file.keys():
        raise NotFound("no obs in the file")
    obs = file["obs"]
    if not _is_group(obs):
        return None
    for key in CELL_NAMES:
        if key in obs.keys() and (not _is_group(obs[key]) or {"categories", "codes"} <= set(obs[key].keys())):
            return key
    raise NotFound(f"no cell names among: {', '.join(obs.keys())}")


def cell_names(file, low: int = 0, high: int | None = None) -> list[str]:
    """The names of the cells from `low` to below `high`; no others are read."""
    key = _cell_column(file)
    return _text(r[0] for r in file["obs"][low:high]) if key is None else read_strings(file["obs"], key, low, high)


def n_cells(file) -> int:
    key = _cell_column(file)
    node = file["obs"] if key is None else file["obs"][key]
    return int((node["codes"] if _is_group(node) else node).shape[0])


def gene_symbols(file) -> list[str]:
    """The first candidate with two markers or more, then the first column; in upper case."""
    from ..operators.features import MARKERS

    if "var" not in file.keys():
        raise NotFound("no var in the file")
    var = file["var"]
    if not _is_group(var):
        return [x.upper() for x in _text(r[0] for r in var[:])]
    keys = list(var.keys())
    for key in [k for k in GENE_NAMES if k in keys] + keys[:1]:
        names = read_strings(var, key)
        if names is not None and len({x.upper() for x in names} & set(MARKERS)) >= 2:
            return [x.upper() for x in names]
    raise NotFound(f"no gene names among: {', '.join(keys)}")


def raw_counts(file):
    """The node of the raw counts: a dataset, or a group with data, indices and indptr."""
    layers = list(file["layers"].keys()) if "layers" in file.keys() else []
    usable = [k for k in layers if not _is_group(file["layers"][k]) or {"data", "indices", "indptr"} <= set(file["layers"][k].keys())]
    has_raw = "raw" in file.keys() and _is_group(file["raw"]) and "X" in file["raw"].keys()
    key, _ = raw_counts_key(usable, has_raw, "X" in file.keys())
    node = file
    for part in key.split("/"):
        node = node[part]
    return node


def rows_between(node, low: int, high: int, n_genes: int, zeros: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row numbers, gene numbers and values of the stored entries (sparse), or of a dense matrix the nonzero ones and all
    of the genes that `zeros` marks: where two columns have one symbol, the last one counts, with its zeros as well."""
    if _is_group(node):
        ptr = np.asarray(node["indptr"][low : high + 1], np.int64)
        a, b = int(ptr[0]), int(ptr[-1])
        return np.repeat(np.arange(low, high), np.diff(ptr)), np.asarray(node["indices"][a:b], np.int64), np.asarray(node["data"][a:b], np.float64)
    if len(node.shape) == 1:
        x = np.asarray(node[low * n_genes : high * n_genes], np.float64).reshape(high - low, n_genes)
    elif len(node.shape) == 2:
        x = np.asarray(node[low:high, :n_genes], np.float64)
    else:
        raise ValueError(f"a matrix of {len(node.shape)} dimensions")
    i, j = np.nonzero(x if zeros is None else (x != 0) | zeros)
    return i + low, j, x[i, j]


class _Rows(InputPartition):
    def __init__(self, low: int, high: int):
        self.low, self.high = low, high


class CellReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.table = options["path"], options.get("table", "matrix")
        self.rows = int(options.get("rows", ROWS_PER_PARTITION))
        self.limit = int(options["limit"]) if "limit" in options else None

    def partitions(self) -> list[InputPartition]:
        if self.table != "matrix":
            return [_Rows(0, 0)]
        with _open(self.path) as f:
            n = n_cells(f)
        n = n if self.limit is None else min(n, self.limit)
        return [_Rows(lo, min(n, lo + self.rows)) for lo in range(0, n, self.rows)] or [_Rows(0, 0)]

    def read(self, partition: _Rows) -> Iterator[pa.RecordBatch]:
        with _open(self.path) as f:
            if self.table == "obs":
                names = cell_names(f)
                yield pa.RecordBatch.from_arrays([pa.array(range(len(names)), pa.int64()), pa.array(names)], ["pos", "cell_id"])
            elif self.table == "var":
                names = gene_symbols(f)
                yield pa.RecordBatch.from_arrays([pa.array(range(len(names)), pa.int32()), pa.array(names)], ["gene_idx", "symbol"])
            elif partition.high > partition.low:
                cells = np.array(cell_names(f, partition.low, partition.high), object)
                genes = np.array(gene_symbols(f), object)
                _, which, times = np.unique(genes.astype(str), return_inverse=True, return_counts=True)
                row, gene, value = rows_between(raw_counts(f), partition.low, partition.high, len(genes), times[which] > 1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cells[row - partition.low], pa.string()), pa.array(gene.astype(np.int32)), pa.array(genes[gene], pa.string()), pa.array(value)],
                    ["cell_id", "gene_idx", "symbol", "value"],
                )


class CellSource(DataSource):
    """The data source "cells": options path, table (matrix, obs, var), rows (a partition's), limit (first cells)."""

    @classmethod
    def name(cls) -> str:
        return "cells"

    def schema(self) -> str:
        return {"obs": "pos long, cell_id string", "var": "gene_idx int, symbol string"}.get(
            self.options.get("table", "matrix"), "cell_id string, gene_idx int, symbol string, value double"
        )

    def reader(self, schema) -> CellReader:
        return CellReader(self.options)


def register(spark) -> None:
    spark.dataSource.register(CellSource)
