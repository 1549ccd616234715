"""From tables to the artefacts of a reference, step by step: ingest, export, and the 2-D map (Q13-Q15).

Vectors are numbered from 0 without a gap, in order of their names, as the files of vectors, labels and maps are aligned
by that number.
"""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import api
from .operators import clustering, encoder, mapping, neighbour_map, sampling
from .session import number_rows, stored
from .sources import readers, writers

#: Training rows of a map, and vectors placed on it.
TRAINING_ROWS, MAP_ROWS = 250_000, 1_000_000


def ingest(
    expression: DataFrame, genes: DataFrame, vocabulary: DataFrame, model: encoder.Encoder, obs: DataFrame | None = None,
    label_columns: tuple[str, ...] = (), max_cells: int | None = None, key: str = "cell_id",
) -> DataFrame:
    """Q14: vec_id, `key`, embedding and the label columns (null for cells that `obs` lacks; columns of more than 1000
    values are left out) of the cells, the first ones by number if `max_cells` is given."""
    cells = api.embed_cells(expression, genes, vocabulary, model)
    cells = number_rows(cells, key)
    if max_cells is not None:
        cells = sampling.first_n(cells, max_cells)
    if obs is None or not label_columns:
        return cells.select("vec_id", key, "embedding")
    kept = [r["column"] for r in mapping.label_cardinality(obs, list(label_columns)).where("kept").collect()]
    labels = obs.select(key, *kept).dropDuplicates([key])
    return cells.join(labels, key, "left").select("vec_id", key, "embedding", *kept)


def export(vectors: DataFrame, out: str, label_columns: tuple[str, ...] = (), max_vectors: int | None = None, npy: bool = True) -> DataFrame:
    """Q15: writes the first vectors as `embeddings.npy` (on a mounted path) or as a table, and their labels as a table in
    the same order; returns the validation of what was written (rows in both, missing, different; per label the same)."""
    spark = vectors.sparkSession
    rows = vectors if max_vectors is None else sampling.first_n(vectors, max_vectors)
    if npy:
        writers.write_npy(rows.select("vec_id", "embedding"), f"{out}/embeddings.npy")
        back = readers.npy_vectors(spark, f"{out}/embeddings.npy")
    else:
        writers.write_vectors(rows.select("vec_id", "embedding"), f"{out}/embeddings")
        back = readers.embeddings(spark, f"{out}/embeddings")
    if label_columns:
        writers.write_label_columns(rows.select("vec_id", *label_columns), f"{out}/labels.parquet")
        back = back.join(spark.read.parquet(f"{out}/labels.parquet"), "vec_id", "left")
    return api.validate_export(rows, back, list(label_columns))


def train_map(vectors: DataFrame, label: str | None, out: str, n: int = TRAINING_ROWS, seed: int = 42, method: str = "neighbours", **how):
    """Fits the projection on a sample, by shares of a label if one is named, and writes the ids of the sample
    and the projection: of a neighbour map (`neighbour_map.train`, which takes `how`), or the plane of the principal components ("components")."""
    if method not in ("neighbours", "components"):
        raise ValueError("method is neighbours or components")
    spark = vectors.sparkSession
    if label:
        sample = sampling.stratified_sample(sampling.labelled_strata(vectors, label), label, n, seed=seed)
    else:
        sample = sampling.random_subset(vectors, n, seed=seed)
    sample = stored(sample.select("vec_id", "embedding"), "map-sample")
    writers.write_training_ids(sample, f"{out}/training_ids")
    if method == "neighbours":
        p, _ = neighbour_map.train(sample, seed=seed, **how)
    else:
        p = mapping.Projector.fit(clustering.bounded_sample(sample, min(n, clustering.SAMPLE_ROWS)))
    save_projector(spark, p, out)
    return p


def save_projector(spark: SparkSession, p, folder: str) -> None:
    if isinstance(p, mapping.Projector):
        model = {"mean": p.mean.tolist(), "axes": p.axes.tolist()}
    else:
        model = {"landmarks": p.landmarks.tolist(), "width": p.width, "weights": p.weights.tolist()}
    spark.createDataFrame([(json.dumps(model),)], "projector string").coalesce(1).write.mode("overwrite").parquet(f"{folder}/projector")


def load_projector(spark: SparkSession, folder: str):
    model = json.loads(spark.read.parquet(f"{folder}/projector").first()[0])
    if "axes" in model:
        return mapping.Projector(np.array(model["mean"]), np.array(model["axes"]))
    return neighbour_map.NeighbourProjector(np.array(model["landmarks"]), model["width"], np.array(model["weights"]))


def place_on_map(vectors: DataFrame, projector, max_vectors: int | None = MAP_ROWS) -> DataFrame:
    """Q13: vec_id, x, y of the first vectors, in the square from -1 to 1."""
    rows = vectors if max_vectors is None else sampling.first_n(vectors, max_vectors)
    return mapping.normalise(stored(mapping.project(rows, projector), "map-points"))


def export_map(points: DataFrame, labels: DataFrame, label_columns: tuple[str, ...], folder: str, metadata: dict | None = None) -> None:
    """Q13, K6: the files of a map: coordinates and label codes of its points, and their dictionary."""
    coded, names = points.join(labels.select("vec_id", *label_columns), "vec_id", "left"), None
    for c in label_columns:
        d = mapping.category_dictionary(labels, c)
        coded = mapping.encode_category(coded, c, d).drop(c).withColumnRenamed(f"{c}_code", c)
        d = d.select(F.lit(c).alias("column"), "code", "category")
        names = d if names is None else names.unionByName(d)
    if names is None:
        names = points.sparkSession.createDataFrame([], "column string, code int, category string")
    writers.write_map(coded, names, metadata or {}, folder)
