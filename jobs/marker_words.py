"""Job 2, batch: the markers of every category, a panel of what tells its documents from the others.

    python -m jobs.marker_words DOCUMENTS OUT [--config FILE] [--master URL]

DOCUMENTS is a Parquet table (doc_id, text, a category column). A document is a cell and its words are the genes. Of each category
those words are kept that at least so many of all documents have, and ranked by how much larger the share of the category's documents that have the word is than
the share of the others'. OUT, partitioned by category, has rank, word, n_in and n_out (documents that have it, in the category and outside), share_in, share_out
and mean_value: the mean over the category's documents of the log-normalised counts. A null category is Unknown; a document is one id, its category the smallest it is given; those
without words count in the shares. The output is replaced as a whole, so a rerun gives the same files' rows.
"""

from __future__ import annotations

import argparse
import logging

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from annolith.operators import features, mapping, vote
from annolith.session import build_session, stored

from .common import configuration, logger, words_of

NAME = "marker_words"
log = logger(NAME)
SCHEMA = "rank int, word string, n_in long, n_out long, share_in double, share_out double, mean_value double, category string"


def markers(documents: DataFrame, category: str, least: int, top: int, most: int = mapping.MOST_INGEST) -> DataFrame:
    """category, rank, word, n_in, n_out, share_in, share_out, mean_value."""
    named = documents.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.coalesce(F.min(F.col(category).cast("string")), F.lit(vote.UNKNOWN)).alias("category"))
    named = stored(named, "categories")
    kept = mapping.label_cardinality(named, ["category"], most).first()
    if not kept.kept:
        raise ValueError(f"{category} has {kept.n_distinct} values, more than {most}: it is no category")
    sizes = vote.label_counts(named, "category").withColumnRenamed("n", "size")
    total = named.count()
    counts = words_of(documents).select(F.col("doc_id").alias("cell_id"), F.col("word").alias("model_idx"), F.col("n").cast("double").alias("value"))
    values = features.log_normalise(counts).join(named.withColumnRenamed("doc_id", "cell_id"), "cell_id")
    inside = values.groupBy("category", F.col("model_idx").alias("word")).agg(F.count("*").alias("n_in"), F.sum("value").alias("value"))
    inside = stored(inside, "words-by-category")  # small against the texts, and read twice
    frequent = inside.groupBy("word").agg(F.sum("n_in").alias("n_all")).where(F.col("n_all") >= least)
    both = inside.join(frequent, "word").join(F.broadcast(sizes), "category")  # at most `most` rows, checked
    others = F.lit(total) - F.col("size")
    both = both.select(
        "category", "word", "n_in", (F.col("n_all") - F.col("n_in")).alias("n_out"), (F.col("n_in") / F.col("size")).alias("share_in"),
        F.when(others > 0, (F.col("n_all") - F.col("n_in")) / others).otherwise(0.0).alias("share_out"), (F.col("value") / F.col("size")).alias("mean_value"),
    )
    order = Window.partitionBy("category").orderBy(F.desc(F.col("share_in") - F.col("share_out")), "word")
    return both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("rank", "word", "n_in", "n_out", "share_in", "share_out", "mean_value", "category")


def run(spark: SparkSession, documents: str, out: str, config: dict | None = None) -> dict:
    """Writes the markers and returns what was read and written."""
    config = config or configuration(NAME)
    rows = spark.read.parquet(documents).select("doc_id", "text", config["category"])
    found = stored(markers(rows, config["category"], int(config["least_documents"]), int(config["markers"]), int(config["most_categories"])), "markers")
    found.repartition("category").sortWithinPartitions("category", "rank").write.mode("overwrite").partitionBy("category").parquet(out)
    done = {"read": rows.count(), "rows": found.count(), "categories": found.select("category").distinct().count()}
    log.info("read %d documents from %s; wrote %d markers of %d categories to %s", done["read"], documents, done["rows"], done["categories"], out)
    return done


def main() -> None:
    p = argparse.ArgumentParser(description=__doc__.split("\n")[0])
    p.add_argument("documents")
    p.add_argument("out")
    p.add_argument("--config")
    p.add_argument("--master", default="local[*]")
    a = p.parse_args()
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = build_session(a.master)
    try:
        run(spark, a.documents, a.out, configuration(NAME, a.config))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
