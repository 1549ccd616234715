"""Job 1, incremental: documents that have arrived are annotated by their nearest labelled neighbours.

    python -m jobs.annotate_documents DOCUMENTS REFERENCE LABELS OUT CHECKPOINT [--config FILE] [--master URL]

DOCUMENTS, a Parquet table or a folder into which files of it arrive (doc_id, text), is read as a stream: a run takes the files that
came since the last one, and ends. REFERENCE (doc_id, text) and LABELS (doc_id, a label column) are the annotated collection.
A document is a cell and its words are the genes: their counts, hashed to so many places, are log-normalised and are its vector;
the vote of its nearest reference documents, itself apart, is its label, with the share of the votes as confidence.

OUT/annotated has a row per document and batch (doc_id, label_id, label, votes, confidence), by batch; OUT/counts how many documents of a
batch got a label. A document without words, or without a neighbour, is Unknown. CHECKPOINT is the mark: which files are done. A run that
was stopped is continued by the next: an unfinished batch is done again and replaces its own rows, so every document is annotated once for each time it arrived.
A run that finds nothing new writes nothing.
"""

from __future__ import annotations

import argparse
import functools
import logging

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from annolith.operators import encoder, knn, vote
from annolith.session import build_session, stored
from annolith.sources.readers import exists
from annolith.streaming.labelling import cell_stream, label_stream

from .common import configuration, logger, place_counts

NAME = "annotate_documents"
#: Distances that are equal in so many digits are: texts of few words are often equally far away, but for the order of a sum.
DIGITS = 9
#: Bytes of the vectors of a batch that are sent to all tasks; of more, no task gets them all.
BROADCAST_BYTES = 1 << 20
log = logger(NAME)


def profiles(documents: DataFrame, dimensions: int) -> DataFrame:
    """vec_id, embedding of the documents; without a word there is no embedding."""
    counts = place_counts(documents, dimensions).withColumnsRenamed({"doc_id": "cell_id", "counts": "value"})
    return encoder.embed_dense(counts, encoder.LinearEncoder(np.eye(dimensions))).withColumnRenamed("cell_id", "vec_id")


def annotate(documents: DataFrame, reference: DataFrame, labels: DataFrame, names: DataFrame, k: int, dimensions: int) -> DataFrame:
    """doc_id, label_id, label, votes, confidence of each document of a batch. reference: vec_id, embedding."""
    batch = stored(profiles(documents, dimensions), "batch")  # the texts are read once
    near = knn.exact_knn(batch, reference, k + 1, broadcast_bytes=BROADCAST_BYTES, digits=DIGITS).where("query_id <> vec_id")
    order = Window.partitionBy("query_id").orderBy("rank")
    near = near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    votes = vote.all_queries(batch.select("vec_id"), vote.majority_vote(vote.with_labels(near, labels), k))
    return vote.decode_labels(votes, names).select(F.col("query_id").alias("doc_id"), "label_id", "label", "votes", "confidence")


def run(spark: SparkSession, documents: str, reference: str, labels: str, out: str, checkpoint: str, config: dict | None = None) -> dict:
    """Annotates what is new and returns what was read and written."""
    config = config or configuration(NAME)
    k, dimensions, label = int(config["neighbours"]), int(config["dimensions"]), config["label"]

    @functools.cache
    def known() -> tuple[DataFrame, DataFrame, DataFrame]:
        """Made when the first batch comes: a run without one reads nothing."""
        marks = spark.read.parquet(labels).where(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
        marks = marks.groupBy(F.col("doc_id").alias("vec_id")).agg(F.max(F.col(label).cast("int")).alias("label_id"))
        marked = spark.read.parquet(reference).select("doc_id", "text").join(marks.select(F.col("vec_id").alias("doc_id")), "doc_id", "left_semi")
        vectors = stored(profiles(marked, dimensions).where("embedding IS NOT NULL"), "reference")
        log.info("reference: %d documents with label %r from %s and %s", vectors.count(), label, reference, labels)
        return vectors, marks, spark.createDataFrame([(int(c), n) for c, n in config["names"].items()], "label_id int, label string")

    def batch(rows: DataFrame) -> DataFrame:
        vectors, marks, names = known()
        return annotate(rows, vectors, marks, names, k, dimensions)

    head, _, tail = documents.rstrip("/").rpartition("/")
    pattern = f"{head}/[{tail[0]}]{tail[1:]}"  # a pattern matches a file as well as a folder
    schema = spark.read.parquet(documents).select("doc_id", "text").schema
    query = label_stream(cell_stream(spark, pattern, schema, int(config["files_per_trigger"])), batch, f"{out}/annotated", checkpoint)
    query.awaitTermination()
    read = sum(p["numInputRows"] for p in query.recentProgress)
    done = _count_new_batches(spark, out)
    log.info("read %d new documents from %s; wrote %d rows of %d batches to %s/annotated", read, documents, done["rows"], done["batches"], out)
    return {"read": read, **done}


def _count_new_batches(spark: SparkSession, out: str) -> dict:
    """The label counts of the batches that have none yet, which also mends a run that was stopped before it counted."""
    if not exists(spark, f"{out}/annotated"):
        return {"rows": 0, "batches": 0}
    rows = spark.read.parquet(f"{out}/annotated")
    if exists(spark, f"{out}/counts"):
        rows = rows.join(F.broadcast(spark.read.parquet(f"{out}/counts").select("batch_seq").distinct()), "batch_seq", "left_anti")  # a row per batch
    counts = stored(rows.groupBy("batch_seq", "label").agg(F.count("*").alias("n")), "counts")
    counts.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_seq").parquet(f"{out}/counts")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count_distinct("batch_seq").alias("batches")).first()
    return total.asDict()


def main() -> None:
    p = argparse.ArgumentParser(description=__doc__.split("\n")[0])
    for name in ("documents", "reference", "labels", "out", "checkpoint"):
        p.add_argument(name)
    p.add_argument("--config")
    p.add_argument("--master", default="local[*]")
    a = p.parse_args()
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = build_session(a.master)
    try:
        run(spark, a.documents, a.reference, a.labels, a.out, a.checkpoint, configuration(NAME, a.config))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
