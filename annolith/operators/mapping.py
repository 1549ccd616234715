"""The 2-D map: projection, coordinates, category codes, layers, cell state."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Categories a column may have at export, and at ingest.
MOST_CATEGORIES, MOST_INGEST = 500, 1000
LAYERS = (("base", 1), ("user", 3), ("query", 6))


@dataclass(frozen=True)
class Projector:
    """A linear projection to the plane: principal components, not a neighbour embedding. Any object with a project
    method (vectors to n x 2) takes its place, such as one that runs a supplied graph."""

    mean: np.ndarray
    axes: np.ndarray

    @classmethod
    def fit(cls, x: np.ndarray) -> Projector:
        mean = x.mean(axis=0)
        _, _, v = np.linalg.svd(x - mean, full_matrices=False)
        axes = v[:2] * np.where(v[:2][np.arange(2), np.abs(v[:2]).argmax(axis=1)] < 0, -1, 1)[:, None]
        return cls(mean, axes.T)

    def project(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) @ self.axes


def project(vectors: DataFrame, projector, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, x, y."""
    shared = vectors.sparkSession.sparkContext.broadcast(projector)

    @F.pandas_udf("x double, y double")
    def plane(v: pd.Series) -> pd.DataFrame:
        if not len(v):
            return pd.DataFrame({"x": np.zeros(0), "y": np.zeros(0)})
        p = shared.value.project(np.stack(v.to_numpy()).astype(np.float64))
        return pd.DataFrame({"x": p[:, 0], "y": p[:, 1]})

    rows = vectors.where(F.col(vector_col).isNotNull())
    return rows.select(F.col(id_col), plane(vector_col).alias("p")).select(id_col, "p.x", "p.y")


def bounds(points: DataFrame) -> DataFrame:
    """x_center, y_center, max_range, num_points."""
    mm = points.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"), F.count("*").alias("num_points"))
    return mm.select(
        ((F.col("x0") + F.col("x1")) / 2).alias("x_center"),
        ((F.col("y0") + F.col("y1")) / 2).alias("y_center"),
        F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")).alias("max_range"),
        "num_points",
    )


def normalise(points: DataFrame, box: DataFrame | None = None) -> DataFrame:
    """one range for both axes keeps the aspect; a range of 0 gives 0. `box` is one row, so its broadcast is bounded."""
    b = F.broadcast((bounds(points) if box is None else box).select("x_center", "y_center", "max_range"))
    half = F.col("max_range") / 2

    def scaled(c: str):
        return F.when(F.col("max_range") == 0, 0.0).otherwise((F.col(c) - F.col(f"{c}_center")) / half)

    return points.join(b).withColumns({"x": scaled("x"), "y": scaled("y")}).drop("x_center", "y_center", "max_range")


class TooManyCategories(ValueError):
    pass


def category_dictionary(df: DataFrame, column: str, most: int | None = MOST_CATEGORIES) -> DataFrame:
    """code, category over the non-null values as strings in ascending order. The values are made distinct before
    they are ranked; more than `most` of them is an error."""
    values = df.where(F.col(column).isNotNull()).select(F.col(column).cast("string").alias("category")).distinct()
    if most is not None and values.limit(most + 1).count() > most:
        raise TooManyCategories(f"{column} has more than {most} categories")
    return values.select((F.row_number().over(Window.orderBy("category")) - 1).alias("code"), "category")


def encode_category(df: DataFrame, column: str, dictionary: DataFrame | None = None) -> DataFrame:
    """df with `<column>_code`, -1 where the value is missing or not in the dictionary."""
    d = category_dictionary(df, column) if dictionary is None else dictionary
    d = d.select(F.col("code").alias("__code"), F.col("category").alias("__cat"))
    joined = df.join(d, df[column].cast("string") == F.col("__cat"), "left")  # Spark broadcasts it if it is small enough
    return joined.withColumn(f"{column}_code", F.coalesce("__code", F.lit(-1))).drop("__code", "__cat")


def label_cardinality(df: DataFrame, columns: list[str], most: int = MOST_INGEST) -> DataFrame:
    """Column, n_distinct, kept. Columns the table lacks are left out; all are counted in one pass."""
    present = [c for c in columns if c in df.columns]
    if not present:
        return df.sparkSession.createDataFrame([], "column string, n_distinct long, kept boolean")
    counts = df.agg(*[F.count_distinct(c).alias(c) for c in present])
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("n_distinct")) for c in present]))
    return counts.select(pairs.alias("p")).select("p.*").withColumn("kept", F.col("n_distinct") <= most)


def union_layers(base: DataFrame, user: DataFrame | None = None, query: DataFrame | None = None) -> DataFrame:
    """X, y, label_id of up to three layers with layer (0, 1, 2), size and local_idx. U1b is a filter on these."""
    parts = []
    for k, (frame, (name, size)) in enumerate(zip((base, user, query), LAYERS)):
        if frame is not None:
            parts.append(frame.select("local_idx", "x", "y", "label_id").withColumns({"layer": F.lit(k), "layer_name": F.lit(name), "size": F.lit(size)}))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def latest_state(updates: DataFrame, key: str = "cell_id", order: tuple[str, ...] = ("batch_seq",)) -> DataFrame:
    """One row per key, the last by `order`."""
    rest = [c for c in updates.columns if c != key]
    last = updates.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("s"))
    return last.select(key, *[F.col(f"s.{c}").alias(c) for c in rest])


def category_columns(dictionary: DataFrame, user_index: DataFrame | None = None, default: str | None = None) -> DataFrame:
    """Column, is_default: the names of the columns that have categories; of a user index (its metadata) the one
    category it was made for. Without a default the first name is it."""
    if user_index is not None:
        return user_index.select(F.col("category").alias("column"), F.lit(True).alias("is_default"))
    names = dictionary.select("column").distinct()
    first = F.lit(default) if default is not None else F.min("column").over(Window.partitionBy())
    return names.select("column", (F.col("column") == first).alias("is_default"))
