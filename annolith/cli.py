"""Command line: train an index, measure its recall, label vectors (Q11, Q12, Q17).

    python -m annolith.cli train VECTORS OUT [--pq-m 16] [--max-vectors N] [--training-rows N] [--test]
    python -m annolith.cli measure-recall VECTORS INDEX [--queries 100]
    python -m annolith.cli label VECTORS REFERENCE OUT [--neighbours 50]
    python -m annolith.cli export VECTORS OUT [--labels NAME ...] [--max-vectors N] [--table]
    python -m annolith.cli map-train VECTORS OUT [--label NAME] [--training-rows N] [--method neighbours|components]
    python -m annolith.cli map VECTORS MODEL OUT [--max-vectors N]
    python -m annolith.cli map-export POINTS VECTORS OUT [--labels NAME ...]

VECTORS and REFERENCE are Parquet tables (vec_id, embedding; label columns where they are needed), or .npy files.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ingest
from .operators import analytics, ivf, knn, sampling, vote
from .session import build_session
from .sources import readers, writers


def _vectors(spark: SparkSession, path: str, most: int | None = None) -> DataFrame:
    if path.endswith(".npy"):
        return readers.npy_vectors(spark, path, most)
    rows = spark.read.parquet(path)
    return rows if most is None else sampling.first_n(rows, most)


def train(spark: SparkSession, a: argparse.Namespace) -> None:
    vectors = _vectors(spark, a.vectors, a.max_vectors)
    index = ivf.build(vectors, a.pq_m, a.pq_k, training_rows=a.training_rows, max_iter=a.max_iter)
    ivf.save(index, a.out)
    print(index.metadata)
    if a.test:
        _recall(vectors, ivf.load(spark, a.out), 100)


def _recall(vectors: DataFrame, index: ivf.IvfPqIndex, n: int) -> None:
    queries = sampling.random_subset(vectors.select("vec_id", "embedding"), n).persist()
    for name, rows in (("exact", queries), ("perturbed", analytics.perturbed(queries))):
        print(f"{name}: {analytics.self_accuracy(rows, index).first()[0]:.3f} find themselves first")


def measure_recall(spark: SparkSession, a: argparse.Namespace) -> None:
    _recall(_vectors(spark, a.vectors, a.max_vectors), ivf.load(spark, a.index), a.queries)


def label(spark: SparkSession, a: argparse.Namespace) -> None:
    reference = spark.read.parquet(a.reference)
    near = vote.with_labels(knn.exact_knn(_vectors(spark, a.vectors), reference, a.neighbours), reference.withColumn("label_id", F.col("label")))
    votes = vote.majority_vote(near, a.neighbours, "first_seen")
    writers.write_results(votes.select(F.col("query_id").alias("cell_id"), F.col("label_id").cast("string").alias("label"), "confidence"), a.out)


def export(spark: SparkSession, a: argparse.Namespace) -> None:
    print(ingest.export(_vectors(spark, a.vectors), a.out, tuple(a.labels), a.max_vectors, not a.table).first().asDict())


def map_train(spark: SparkSession, a: argparse.Namespace) -> None:
    ingest.train_map(_vectors(spark, a.vectors), a.label, a.out, a.training_rows, method=a.method)


def map_place(spark: SparkSession, a: argparse.Namespace) -> None:
    points = ingest.place_on_map(_vectors(spark, a.vectors), ingest.load_projector(spark, a.model), a.max_vectors)
    writers.write_vectors(points, a.out)


def map_export(spark: SparkSession, a: argparse.Namespace) -> None:
    ingest.export_map(spark.read.parquet(a.points), _vectors(spark, a.vectors), tuple(a.labels), a.out)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    p = argparse.ArgumentParser(prog="annolith", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    commands = p.add_subparsers(required=True)
    c = commands.add_parser("train")
    c.set_defaults(run=train)
    c.add_argument("vectors")
    c.add_argument("out")
    c.add_argument("--pq-m", type=int, default=16)
    c.add_argument("--pq-k", type=int, default=256)
    c.add_argument("--max-iter", type=int, default=100)
    c.add_argument("--max-vectors", type=int)
    c.add_argument("--training-rows", type=int, default=50_000)
    c.add_argument("--test", action="store_true")
    c = commands.add_parser("measure-recall")
    c.set_defaults(run=measure_recall)
    c.add_argument("vectors")
    c.add_argument("index")
    c.add_argument("--max-vectors", type=int)
    c.add_argument("--queries", type=int, default=100)
    c = commands.add_parser("label")
    c.set_defaults(run=label)
    c.add_argument("vectors")
    c.add_argument("reference")
    c.add_argument("out")
    c.add_argument("--neighbours", type=int, default=50)
    c = commands.add_parser("export")
    c.set_defaults(run=export)
    c.add_argument("vectors")
    c.add_argument("out")
    c.add_argument("--labels", nargs="*", default=[])
    c.add_argument("--max-vectors", type=int)
    c.add_argument("--table", action="store_true")
    c = commands.add_parser("map-train")
    c.set_defaults(run=map_train)
    c.add_argument("vectors")
    c.add_argument("out")
    c.add_argument("--label")
    c.add_argument("--training-rows", type=int, default=ingest.TRAINING_ROWS)
    c.add_argument("--method", choices=("neighbours", "components"), default="neighbours")
    c = commands.add_parser("map")
    c.set_defaults(run=map_place)
    c.add_argument("vectors")
    c.add_argument("model")
    c.add_argument("out")
    c.add_argument("--max-vectors", type=int, default=ingest.MAP_ROWS)
    c = commands.add_parser("map-export")
    c.set_defaults(run=map_export)
    c.add_argument("points")
    c.add_argument("vectors")
    c.add_argument("out")
    c.add_argument("--labels", nargs="*", default=[])
    a = p.parse_args(argv)
    a.run(spark or build_session(), a)


if __name__ == "__main__":
    main()
