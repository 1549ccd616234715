"""Neighbour votes, confidences and label tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

UNKNOWN = "Unknown"
TIES = ("smallest", "first_seen")


def with_labels(neighbours: DataFrame, labels: DataFrame, id_col: str = "vec_id", label_col: str = "label_id") -> DataFrame:
    """Neighbours whose vector has a label of 0 or more."""
    named = labels.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label_id")).where("label_id >= 0")
    return neighbours.join(named, "vec_id")


def majority_vote(labelled: DataFrame, k: int, tie: str = "smallest", weight: str | None = None) -> DataFrame:
    """query_id, label_id, votes, confidence over neighbours with label_id.

    tie "smallest" (A5): the smallest label wins; "first_seen" (A6): that of the nearest neighbour among the equal.
    The confidence divides by the constant k, even if fewer neighbours were found (A7). With `weight` (A30) a vote counts
    1 / (dist + 1e-9) and the confidence is the label's share of all weights."""
    if tie not in TIES:
        raise ValueError(f"tie is one of {TIES}")
    one = F.count("*") if weight is None else F.sum(1 / (F.col(weight) + 1e-9))
    counted = labelled.groupBy("query_id", "label_id").agg(one.alias("votes"), F.min("rank").alias("seen"))
    ties = "label_id" if tie == "smallest" else "seen"
    order = Window.partitionBy("query_id").orderBy(F.desc("votes"), ties)
    if weight is not None:
        counted = counted.withColumn("all", F.sum("votes").over(Window.partitionBy("query_id")))
    first = counted.withColumn("n", F.row_number().over(order)).where("n = 1")
    share = F.col("votes") / (F.lit(k) if weight is None else F.col("all"))
    return first.select("query_id", "label_id", "votes", share.alias("confidence"))


def vote_ranks(labelled: DataFrame) -> DataFrame:
    """Every label of a query, by votes, then first seen."""
    counted = labelled.groupBy("query_id", "label_id").agg(F.count("*").alias("votes"), F.min("rank").alias("seen"))
    return counted.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("votes"), "seen"))).drop("seen")


def all_queries(queries: DataFrame, votes: DataFrame, id_col: str = "vec_id") -> DataFrame:
    """A row for every query; without a vote the label is null (the file and the views show it as Unknown)."""
    return queries.select(F.col(id_col).alias("query_id")).join(votes, "query_id", "left")


def labelled_only(cells: DataFrame) -> DataFrame:
    """The update view shows labelled cells only."""
    return cells.where(F.col("label_id").isNotNull())


def decode_labels(cells: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Label names, Unknown where the code is not in the dictionary (label_id, label)."""
    return cells.join(F.broadcast(dictionary) if dictionary.count() <= 100_000 else dictionary, "label_id", "left").withColumn(
        "label", F.coalesce("label", F.lit(UNKNOWN))
    )


def label_counts(cells: DataFrame, label: str = "label") -> DataFrame:
    """Rows per label, most first."""
    return cells.groupBy(label).agg(F.count("*").alias("n")).orderBy(F.desc("n"), label)


def top_counts(cells: DataFrame, label: str = "label", top: int = 10) -> DataFrame:
    """The `top` labels, and one row for how many more there are. Only `top` rows are ever ranked."""
    counts = cells.groupBy(label).agg(F.count("*").alias("n"))
    order = [F.desc("n"), F.col(label)]
    first = counts.orderBy(*order).limit(top)
    shown = first.agg(F.count("*").alias("labels"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows"))
    every = counts.agg(F.count("*").alias("all_labels"), F.sum("n").alias("all_rows"))
    more = every.join(F.broadcast(shown)).where("all_labels > labels").select(
        F.concat(F.lit("("), (F.col("all_labels") - F.col("labels")).cast("string"), F.lit(" more)")).alias(label),
        (F.col("all_rows") - F.col("rows")).alias("n"),
        F.lit(top + 1).alias("place"),
    )
    return first.withColumn("place", F.row_number().over(Window.orderBy(*order))).unionByName(more)
