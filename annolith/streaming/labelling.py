"""Labelling as a stream (R1-R7): bounded micro-batches, running counts, the last state of every cell."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable
from concurrent.futures import CancelledError, Future

from pyspark import InheritableThread
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from ..operators.mapping import latest_state
from ..session import remove, stored
from ..sources.readers import exists


def cell_stream(spark: SparkSession, folder: str, schema, files_per_trigger: int = 1) -> DataFrame:
    """Parquet files of cells as they arrive, so many at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def label_stream(cells: DataFrame, label: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """`label` (any batch plan, such as a search and a vote) is applied to every micro-batch and its rows are
    added to a table with their batch number. A repeated batch replaces its own rows, so results are written once."""

    def write(batch: DataFrame, n: int) -> None:
        rows = label(batch).withColumn("batch_seq", F.lit(n).cast("long"))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_seq").parquet(out)

    writer = cells.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 second")).start()


def running_counts(cells: DataFrame, label: str = "label") -> DataFrame:
    """Rows per label so far; a cell that is sent again counts again. State: one row per label."""
    return cells.where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n"))


def count_stream(cells: DataFrame, name: str, checkpoint: str, label: str = "label") -> StreamingQuery:
    """The running counts as an in-memory table of bounded size (one row per label)."""
    counts = running_counts(cells, label)
    return counts.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_cells(spark: SparkSession, out: str, key: str = "cell_id") -> DataFrame:
    """The last state of every cell of a labelled table, by batch."""
    return latest_state(spark.read.parquet(out), key)


def upsert_stream(
    cells: DataFrame, label: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, key: str = "cell_id", order: tuple[str, ...] = ("batch_seq",),
    buckets: int = 64, available_now: bool = True,
) -> StreamingQuery:
    """A table of the last state of every cell, kept by key. A micro-batch reads and replaces only the buckets (of the
    key's hash) that its cells fall into, so reading the table needs no grouping and a batch does not touch the history.

    Replacing a bucket removes it first. A batch therefore writes its buckets, merged and whole, beside the checkpoint before it touches the
    table. If it is stopped then, wherever, it comes again with the same number, finds them there, and only replaces the
    buckets once more; it does not merge with a table that may lack some. The merge takes the last row by `order`."""

    def write(batch: DataFrame, n: int) -> None:
        spark, pending = batch.sparkSession, f"{checkpoint.rstrip('/')}-pending"
        if not exists(spark, f"{pending}/{n}/_SUCCESS"):
            rows = label(batch)
            rows = rows if "batch_seq" in rows.columns else rows.withColumn("batch_seq", F.lit(n).cast("long"))
            new = stored(latest_state(rows, key, order).withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")), "upsert")
            touched = [r.bucket for r in new.select("bucket").distinct().collect()]  # of `buckets` at most
            if exists(spark, out):
                old = spark.read.parquet(out).where(F.col("bucket").isin(touched))
                new = latest_state(old.unionByName(new), key, order)
            new.write.mode("overwrite").parquet(f"{pending}/{n}")
        _replace_buckets(spark, f"{pending}/{n}", out)
        remove(spark, f"{pending}/{n - 1}")

    writer = cells.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 second")).start()


def _replace_buckets(spark: SparkSession, pending: str, out: str) -> None:
    spark.read.parquet(pending).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(out)


class Progress(StreamingQueryListener):
    """R2: rows and batches so far, for a progress display."""

    def __init__(self):
        self.rows = self.batches = 0
        self.ended = False

    def onQueryStarted(self, event) -> None:
        self.ended = False

    def onQueryProgress(self, event) -> None:
        self.rows += event.progress.numInputRows
        self.batches += 1

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ended = True


class Replaceable:
    """A request whose jobs are cancelled when the next one replaces it. It runs in a thread of its own with a tag on
    its jobs, so asking again returns at once; what it has written until then stays."""

    def __init__(self, spark: SparkSession, group: str = "importance"):
        self.spark, self.tag, self.stopped = spark, f"{group}-{uuid.uuid4().hex}", None

    def submit(self, action: Callable[[], object]) -> Future:
        """Ends the request before and starts this one; its result, or its error, comes with the future."""
        self.cancel()
        done, stopped, tag = Future(), threading.Event(), f"{self.tag}-{uuid.uuid4().hex}"
        self.stopped, self.current = stopped, tag
        sc = self.spark.sparkContext

        def work() -> None:
            sc.addJobTag(tag)
            try:
                result = action()
            except BaseException as e:
                done.set_exception(e)
            else:
                if stopped.is_set():
                    done.set_exception(CancelledError("the request was cancelled"))
                else:
                    done.set_result(result)
            finally:
                sc.removeJobTag(tag)

        InheritableThread(target=work, daemon=True).start()
        return done

    def run(self, action: Callable[[], object]) -> object:
        return self.submit(action).result()

    def cancel(self) -> None:
        """Ends the jobs of the current request, and gives it no result if it goes on."""
        if self.stopped is not None and not self.stopped.is_set():
            self.stopped.set()
            self.spark.sparkContext.cancelJobsWithTag(self.current)
