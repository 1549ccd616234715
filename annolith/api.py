"""The composite entry points: ingest, label, label exactly, validate (Q8, Q9, Q12, Q14-Q17)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import analytics, encoder, features, ivf, knn, mapping, vote
from .session import number_rows, stored


@dataclass(frozen=True)
class Reference:
    """What cells are labelled against: an index, the labels of its vectors, and the label names."""

    index: ivf.IvfPqIndex
    labels: DataFrame  # vec_id, label_id
    names: DataFrame  # label_id, label


def embed_cells(expression: DataFrame, genes: DataFrame, vocabulary: DataFrame, model: encoder.Encoder) -> DataFrame:
    """Q14: cell_id, embedding. Cells without any vocabulary gene have no row."""
    return encoder.embed(features.align(expression, genes, vocabulary), model)


def number_cells(cells: DataFrame, key: str = "cell_id") -> DataFrame:
    """A long id per cell: the hash of its name, or, should two names share one (which is to be expected from some 10^9 cells on), its place in their order."""
    numbered = cells.withColumn("vec_id", F.xxhash64(key))
    twice = numbered.groupBy("vec_id").agg(F.min(key).alias("a"), F.max(key).alias("z")).where("a <> z")
    if twice.isEmpty():
        return numbered
    places = number_rows(cells.select(key).where(F.col(key).isNotNull()).distinct(), key)
    return cells.join(places, key, "left")


def label_embeddings(cells: DataFrame, reference: Reference, n_probe: int = ivf.N_PROBE, k: int = ivf.K, tie: str = "smallest", key: str = "cell_id") -> DataFrame:
    """Q9: `key`, label_id, label (Unknown without a vote), confidence (null without), partition_id and codes: what a user
    index is made of. Every cell has its row, whatever its search found."""
    numbered = number_cells(cells, key)
    near = vote.with_labels(ivf.search(numbered, reference.index, n_probe, k), reference.labels)
    votes = vote.all_queries(numbered, vote.majority_vote(near, k, tie))
    own = ivf.artifacts(numbered, reference.index)
    named = vote.decode_labels(votes, reference.names).join(own, "query_id", "left")
    return numbered.select(key, F.col("vec_id").alias("query_id")).join(named, "query_id").select(key, "label_id", "label", "confidence", "partition_id", "codes")


def label_cells(
    expression: DataFrame, genes: DataFrame, vocabulary: DataFrame, model: encoder.Encoder, reference: Reference, projector=None, **how
) -> DataFrame:
    """Q8: align, normalise, embed, search, vote, and place on the map if a projector is given. The embeddings, which all
    further steps read, are computed once and stored."""
    cells = stored(embed_cells(expression, genes, vocabulary, model), "cells")
    labelled = label_embeddings(cells, reference, **how)
    if projector is None:
        return labelled
    return labelled.join(mapping.project(cells, projector, "cell_id"), "cell_id", "left")


def label_exactly(cells: DataFrame, vectors: DataFrame, labels: DataFrame, names: DataFrame, k: int = ivf.K, weighted: bool = False, key: str = "cell_id") -> DataFrame:
    """Q17: `key`, label by exact neighbours; the nearest neighbour's label wins a tie."""
    numbered = number_cells(cells, key)
    near = vote.with_labels(knn.exact_knn(numbered, vectors, k), labels)
    votes = vote.all_queries(numbered, vote.majority_vote(near, k, "first_seen", "dist" if weighted else None))
    named = vote.decode_labels(votes, names)
    return numbered.select(key, F.col("vec_id").alias("query_id")).join(named, "query_id").select(key, "label", "confidence")


def validate_export(source: DataFrame, written: DataFrame, labels: list[str], tolerance: float = 1e-5, id_col: str = "vec_id") -> DataFrame:
    """Q16: of two tables with ids, vectors and labels: missing rows, differing vectors, and per label column the rows
    whose values differ as strings."""
    vectors = analytics.compare_embeddings(source, written, tolerance, id_col)
    a = source.select(id_col, *[F.col(c).cast("string").alias(f"a_{i}") for i, c in enumerate(labels)])
    b = written.select(id_col, *[F.col(c).cast("string").alias(f"b_{i}") for i, c in enumerate(labels)])
    differ = a.join(b, id_col).agg(*[F.count(F.when(~F.col(f"a_{i}").eqNullSafe(F.col(f"b_{i}")), 1)).alias(f"n_different_{c}") for i, c in enumerate(labels)])
    return vectors.join(F.broadcast(differ)) if labels else vectors
