"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import clean_up, scratch, shared_dir, stored, table

__all__ = ["BYTE_BPE", "as_row", "batch_rows", "binary_column", "clean_up", "lookup", "scratch", "shared_dir", "stored", "table", "tokenizer_path"]

#: The tokenizer file that the token contracts name.
BYTE_BPE = "byte_bpe_50k.json"


def tokenizer_path(name: str = BYTE_BPE) -> str:
    """Place of a tokenizer file: a path as it is, or the name of an installed public one, which each machine resolves
    for itself, as installs may differ."""
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def batch_rows(spark: SparkSession, n: int) -> None:
    """Rows and bytes per Arrow batch, lower than the defaults so that batches of long texts stay small."""
    for key, most, default in (("maxRecordsPerBatch", n, 10_000), ("maxBytesPerBatch", 32 << 20, 2**31 - 1)):
        name = f"spark.sql.execution.arrow.{key}"
        if _bytes(spark.conf.get(name, str(default))) > most:
            spark.conf.set(name, str(most))


def _bytes(value: str) -> int:
    scale = {"b": 1, "k": 1 << 10, "m": 1 << 20, "g": 1 << 30}
    value = value.lower().removesuffix("b") or "0"
    return int(value) if value.lstrip("-").isdigit() else int(value[:-1]) * scale[value[-1]]


def as_row(docs: DataFrame, text: str) -> DataFrame:
    """All columns as one struct `__row`, the text again as `__in`: whatever the columns of a table are called, they
    cannot clash with those an operator adds. `select("__row.*")` gives them back."""
    return docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("__row"), docs[f"`{text}`"].alias("__in"))


def binary_column(rows: np.ndarray) -> pa.Array:
    """The bytes of each row of a matrix."""
    rows = np.ascontiguousarray(rows)
    width = rows.itemsize * (rows.shape[1] if rows.ndim > 1 else 1)
    offsets = np.arange(len(rows) + 1, dtype=np.int64) * width
    return pa.Array.from_buffers(pa.large_binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(rows)])


#: Of how many parts of all rows a key must hold one to be looked up in a broadcast; so many keys at most can.
HOT_SHARE = 1000


def lookup(left: DataFrame, right: DataFrame, key: str, rows: str, spread: list[str]) -> DataFrame:
    """left with the further columns of right, null where right has none. `key` (null is a key) is unique in right,
    whose column `rows` counts the rows of left that have it and is not returned; right is read three times, so it is a
    stored table, and the values are of bounded size. Keys that hold a thousandth of all rows, of which there are a thousand at
    most, are looked up in a broadcast and their rows are dealt on by the hash of `spread`; the others are joined by key."""
    names = [c for c in right.columns if c not in (key, rows)]
    total = right.agg(F.sum(rows).alias("n")).first().n or 0
    hot = F.col(rows) * HOT_SHARE >= F.lit(total)
    found = right.select(F.col(key).alias("__key"), F.struct(*names).alias("__value"), hot.alias("__hot"))
    frequent = found.where("__hot").select(F.col("__key").alias("__hot_key"), F.col("__value").alias("__hot_value"))
    rest = found.where("NOT __hot").select("__key", "__value", F.lit(0).cast("long").alias("__deal_key"))
    a = left.join(F.broadcast(frequent), F.col(key).eqNullSafe(F.col("__hot_key")), "left")
    deal = F.when(F.col("__hot_value").isNull(), F.lit(0).cast("long")).otherwise(F.pmod(F.xxhash64(*spread), F.lit(1 << 20)) + 1)
    a = a.withColumn("__deal", deal)
    a = a.join(rest, F.col(key).eqNullSafe(F.col("__key")) & (F.col("__deal") == F.col("__deal_key")), "left")
    value = F.coalesce("__hot_value", "__value")
    return a.select(*left.columns, *[value.getField(n).alias(n) for n in names])
