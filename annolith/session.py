"""Session defaults, table access and the shared folder, used by every module."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType


def build_session(master: str = "local[*]", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session with adaptive execution, used by tests and the bench. On a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(master)
        .appName("annolith")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.host", "127.0.0.1")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all machines share: spark.checkpoint.dir. Only a local session may be without; it gets a folder of its
    own, which would be another one on every machine of a cluster."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        named = "file://" + tempfile.mkdtemp(prefix="annolith-shared-")
        spark.conf.set("spark.checkpoint.dir", named)
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(named)
    return named.rstrip("/")


def scratch(spark: SparkSession) -> str:
    """This application's part of the shared folder."""
    return f"{shared_dir(spark)}/annolith-{spark.sparkContext.applicationId}"


#: Where the shared folder is a mounted one: files without a checksum file beside each. Without the native library Hadoop
#: starts a shell command for every file's permissions, four for a file and its checksums, and each of them shares the
#: executor's memory for a moment, which counts it twice.
RAW_FILES = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}


def stored(df: DataFrame, what: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back: it cuts the lineage, survives the loss of
    any executor, and unlike a checkpoint of rows is columnar and compressed."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/{what}-{uuid.uuid4().hex}"
    df.write.options(**(RAW_FILES if path.startswith("file:") else {})).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clean_up(spark: SparkSession) -> None:
    """Delete the tables and archives this application has stored; results that read them are gone with them."""
    remove(spark, scratch(spark))


def remove(spark: SparkSession, place: str) -> None:
    """Delete a file or folder, if there is one, wherever Spark can write."""
    path = spark._jvm.org.apache.hadoop.fs.Path(place)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def number_rows(rows: DataFrame, key: str, name: str = "vec_id") -> DataFrame:
    """rows with their place in the order of a key that is unique. They are sorted by range and stored once; what goes
    through the driver is a count per partition."""
    ordered = stored(rows.repartitionByRange(key).sortWithinPartitions(key).withColumn("__place", F.monotonically_increasing_id()), "numbered")
    part, place = F.shiftright("__place", 33), F.col("__place").bitwiseAND(F.lit((1 << 33) - 1))
    counts = {r.p: r.n for r in ordered.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()}
    starts, at = [], 0
    for p in sorted(counts):
        starts.append((p, at))
        at += counts[p]
    first = rows.sparkSession.createDataFrame(starts, "__p long, __first long")
    numbered = ordered.join(F.broadcast(first), part == F.col("__p"))
    return numbered.withColumn(name, F.col("__first") + place).drop("__place", "__p", "__first")


def ranked_by_range(rows: DataFrame, by: list[str], order: list[str], name: str = "rank") -> DataFrame:
    """rows with their rank (long, from 1) within `by` (not null), in an order that has no ties. Sorted by ranges of both,
    so that a large group lies in many tasks; each task counts along its rows, and what goes through the driver are the first
    and the last group of each task and the size of the latter there."""
    from pyspark import TaskContext

    names = rows.columns
    at = [names.index(c) for c in by]

    def count_along(batches):
        task, last, n = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = [batch.column(i).to_numpy(zero_copy_only=False) for i in at]
            new = np.ones(batch.num_rows, bool)
            new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
            new[0] = last != tuple(k[0] for k in keys)
            place = np.arange(batch.num_rows)
            start = np.maximum.accumulate(np.where(new, place, -1))
            rank = np.where(start < 0, n + place, place - start) + 1
            last, n = tuple(k[-1] for k in keys), int(rank[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rank.astype(np.int64)), pa.array(np.full(len(place), task, np.int32))], [*names, "__rank", "__task"])

    schema = StructType([*rows.schema.fields, StructField("__rank", LongType()), StructField("__task", IntegerType())])
    ordered = stored(rows.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order).mapInArrow(count_along, schema), "ranked")
    group = F.struct(*by)
    ends = ordered.groupBy("__task").agg(F.min(group).alias("a"), F.max(F.struct(group.alias("g"), F.col("__rank").alias("n"))).alias("z"))
    before, group_before, n = [], None, 0
    for r in sorted(ends.collect(), key=lambda r: r["__task"]):
        same = group_before is not None and r.z.g == group_before
        if group_before is not None and r.a == group_before:
            before.append((r["__task"], r.a, n))
        group_before, n = r.z.g, r.z.n + (n if same else 0)
    rank = F.col("__rank")
    if before:
        known = rows.sparkSession.createDataFrame(before, ends.select(F.col("__task").alias("t"), F.col("a").alias("__g"), F.lit(0).cast("long").alias("before")).schema)
        ordered = ordered.join(F.broadcast(known), (F.col("__task") == F.col("t")) & (group == F.col("__g")), "left")
        rank = rank + F.coalesce("before", F.lit(0))
    return ordered.select(*names, rank.alias(name))
