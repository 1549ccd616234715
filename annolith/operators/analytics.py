"""Comparing approximate with exact searches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import ivf


def recall_per_query(exact: DataFrame, approx: DataFrame, k: int) -> DataFrame:
    """query_id, recall: common ids over k."""
    both = exact.select("query_id", "vec_id").join(approx.select("query_id", "vec_id"), ["query_id", "vec_id"]).groupBy("query_id").agg(F.count("*").alias("n"))
    queries = exact.select("query_id").distinct()
    return queries.join(both, "query_id", "left").select("query_id", (F.coalesce("n", F.lit(0)) / F.lit(k)).alias("recall"))


def hit_recall(queries: DataFrame, found: DataFrame, k: int, id_col: str = "vec_id") -> DataFrame:
    """Recall: share of queries whose own id is among the first k."""
    own = found.where((F.col("rank") <= k) & (F.col("query_id") == F.col("vec_id"))).select(F.col("query_id").alias("hit")).distinct()
    joined = queries.select(F.col(id_col).alias("q")).join(own, F.col("q") == F.col("hit"), "left")
    return joined.agg(F.avg(F.col("hit").isNotNull().cast("double")).alias("recall"))


def distortion(exact: DataFrame, approx: DataFrame) -> DataFrame:
    """query_id, distortion: mean |difference| over the neighbours both have; null if none."""
    a = exact.select("query_id", "vec_id", F.col("dist").alias("de"))
    b = approx.select("query_id", "vec_id", F.col("dist").alias("da"))
    both = a.join(b, ["query_id", "vec_id"]).groupBy("query_id").agg(F.avg(F.abs(F.col("de") - F.col("da"))).alias("distortion"))
    return exact.select("query_id").distinct().join(both, "query_id", "left")


def mean_distance(found: DataFrame) -> DataFrame:
    """A26."""
    return found.groupBy("query_id").agg(F.avg("dist").alias("mean_dist"))


def mismatches(exact: DataFrame, approx: DataFrame, k: int) -> DataFrame:
    """Queries whose votes differ: both labels and confidences, the place of the approximate label among the exact
    votes (null if it has none), and the first three labels of both. Inputs carry label_id. Both searches are counted in one
    grouping by query and label and gathered in one by query (at most k labels each), so no task sorts them side by side."""
    both = exact.select(F.lit(True).alias("true"), "query_id", "label_id", "rank").unionByName(approx.select(F.lit(False).alias("true"), "query_id", "label_id", "rank"))
    counted = both.groupBy("query_id", "label_id").agg(*[f.alias(c + n) for n, own in (("e", F.col("true")), ("a", ~F.col("true"))) for c, f in (
        ("votes_", F.count(F.when(own, 1))), ("seen_", F.min(F.when(own, F.col("rank")))))])
    # the order of votes: most first, then first seen; ranks of a query are different
    found = counted.groupBy("query_id").agg(*[F.sort_array(F.collect_list(F.when(F.col(f"votes_{n}") > 0, F.struct((-F.col(f"votes_{n}")).alias("v"), F.col(f"seen_{n}").alias("s"), "label_id")))).alias(n) for n in ("e", "a")])
    first = found.where("size(e) > 0 AND size(a) > 0").select(
        "query_id", F.col("e")[0]["label_id"].alias("exact_label"), (-F.col("e")[0]["v"] / F.lit(k)).alias("exact_confidence"), F.col("a")[0]["label_id"].alias("approx_label"),
        (-F.col("a")[0]["v"] / F.lit(k)).alias("approx_confidence"), F.col("e.label_id").alias("le"), F.slice("a.label_id", 1, 3).alias("approx_top3"),
    )
    return first.where("exact_label <> approx_label").select(
        "query_id", "approx_label", "exact_label", "exact_confidence", "approx_confidence",
        F.nullif(F.array_position("le", F.col("approx_label")), F.lit(0)).cast("int").alias("approx_place"), F.slice("le", 1, 3).alias("exact_top3"), "approx_top3",
    )


def confusion_pairs(table: DataFrame) -> DataFrame:
    """Unordered pairs of labels of a mismatch table: frequency, mean confidence difference, first three queries."""
    pairs = table.select(F.least("exact_label", "approx_label").alias("label_a"), F.greatest("exact_label", "approx_label").alias("label_b"),
                         (F.col("exact_confidence") - F.col("approx_confidence")).alias("diff"), "query_id")
    first = Window.partitionBy("label_a", "label_b").orderBy("query_id")
    ranked = pairs.withColumn("n", F.row_number().over(first))
    return ranked.groupBy("label_a", "label_b").agg(
        F.count("*").alias("frequency"), F.avg("diff").alias("mean_confidence_diff"),
        F.array_sort(F.collect_list(F.when(F.col("n") <= 3, F.col("query_id")))).alias("examples"),
    )


def compare_settings(low: DataFrame, high: DataFrame) -> DataFrame:
    """Mismatching queries of two settings: fixed by the second, new in it, persistent in both."""
    both = low.select("query_id", F.lit(True).alias("low")).unionByName(high.select("query_id", F.lit(False).alias("low")))
    each = both.groupBy("query_id").agg(F.bool_or("low").alias("a"), F.bool_or(~F.col("low")).alias("b"))
    kind = F.when(F.col("a") & F.col("b"), "persistent").when(F.col("a"), "fixed").otherwise("new")
    return each.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


def bandwidth(probes: DataFrame, lists: DataFrame, m: int) -> DataFrame:
    """Lists touched by a run and their bytes as files: a header of 8 bytes, 4 + m per vector."""
    sizes = ivf.partition_stats(lists).select("partition_id", (F.col("n") * (4 + m) + 8).alias("bytes"))
    touched = probes.select("partition_id").distinct().join(sizes, "partition_id")
    return touched.agg(F.count("*").alias("lists"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))


def recall_quartiles(recalls: DataFrame, by: list[str]) -> DataFrame:
    """Min, quartiles and max of recall per setting."""
    q = F.percentile("recall", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return recalls.groupBy(*by).agg(F.min("recall").alias("low"), q.alias("q"), F.max("recall").alias("high")).select(
        *by, "low", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"), "high"
    )


def codes_used(lists: DataFrame, m: int) -> DataFrame:
    """Subspace j and how many different codes occur in it."""
    each = lists.select(F.posexplode(F.split(F.regexp_replace(F.hex("codes"), "(..)", "$1,"), ",")).alias("j", "code")).where(F.col("j") < m)
    return each.groupBy("j").agg(F.count_distinct("code").alias("n_codes"))


def accuracy_at(results: DataFrame, truth: DataFrame, thresholds: tuple[float, ...] = (0.0, 0.9, 1.0)) -> DataFrame:
    """Share of matching labels among results of at least each confidence, 0 where there are none. Every result
    must have a truth and every truth a result; what has not counts in n_unmatched."""
    j = results.alias("r").join(truth.select("cell_id", F.col("label").alias("truth")).alias("t"), "cell_id", "full")
    one = F.col("r.label") == F.col("truth")
    aggs = []
    for i, t in enumerate(thresholds):
        at = (F.col("confidence") >= t) & F.col("truth").isNotNull()
        aggs.append(F.coalesce(F.avg(F.when(at, one.cast("double"))), F.lit(0.0)).alias(f"accuracy_{i}"))
    return j.agg(*aggs, F.count(F.when(F.col("r.label").isNull() | F.col("truth").isNull(), 1)).alias("n_unmatched"))


def compare_embeddings(a: DataFrame, b: DataFrame, tolerance: float = 1e-5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Q16: rows in both, missing on a side, and how many differ by more than the tolerance in a component."""
    x = a.select(F.col(id_col).alias("i"), F.col(vector_col).cast("array<double>").alias("va"), F.lit(1).alias("ina"))
    y = b.select(F.col(id_col).alias("i"), F.col(vector_col).cast("array<double>").alias("vb"), F.lit(1).alias("inb"))
    far = F.exists(F.zip_with("va", "vb", lambda p, q: F.abs(p - q) > tolerance), lambda z: F.coalesce(z, F.lit(True)))
    return x.join(y, "i", "full").agg(
        F.count(F.when(F.col("ina").isNotNull() & F.col("inb").isNotNull(), 1)).alias("n_both"),
        F.count(F.when(F.col("ina").isNull() | F.col("inb").isNull(), 1)).alias("n_missing"),
        F.count(F.when(far, 1)).alias("n_different"),
    )


def perturbed(vectors: DataFrame, scale: float = 0.01, seed: int = 42, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """v + scale * |v| * noise, the noise drawn by the id, so it depends on nothing else."""
    import numpy as np
    import pandas as pd

    @F.pandas_udf("array<double>")
    def noisy(ids, v):
        out = []
        for i, x in zip(ids, v):
            x = np.asarray(x, np.float64)
            out.append(x + scale * np.sqrt((x * x).sum()) * np.random.default_rng([seed, int(i)]).standard_normal(len(x)))
        return pd.Series(out)

    rows = vectors.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull())
    return rows.select(F.col(id_col), noisy(F.col(id_col).cast("long"), vector_col).alias(vector_col))


def self_accuracy(queries: DataFrame, index: ivf.IvfPqIndex, n_probe: int = 8, id_col: str = "vec_id") -> DataFrame:
    """Share of queries whose nearest is themselves; a query that finds nothing is a miss."""
    return hit_recall(queries, ivf.search(queries, index, n_probe, 1, id_col=id_col), 1, id_col)


def n_probe_for(queries: DataFrame, vectors: DataFrame, index: ivf.IvfPqIndex, k: int, recall: float, refine: int = 4) -> tuple[int, float]:
    """The smallest doubling of n_probe at which a refined search of the sample queries reaches a recall, and that."""
    from .knn import exact_knn

    exact = exact_knn(queries, vectors, k).persist()
    n_probe = 1
    while True:
        found = ivf.refine(ivf.search(queries, index, n_probe, refine * k), queries, vectors, k)
        got = recall_per_query(exact, found, k).agg(F.avg("recall")).first()[0] or 0.0
        if got >= recall or n_probe >= index.n_partitions:
            exact.unpersist()
            return n_probe, got
        n_probe = min(2 * n_probe, index.n_partitions)


def folder_size(spark: SparkSession, path: str) -> int:
    """Bytes of all files below a path, from their listing alone."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("length")
    return files.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]


def sweep(queries: DataFrame, vectors: DataFrame, indexes: dict[int, ivf.IvfPqIndex], n_probes: tuple[int, ...], k: int) -> DataFrame:
    """A row per (m, n_probe): mean recall, seconds, speedup over the exact search, storage and its reduction, bytes
    of the lists that the run touched; and one row (m 0) for the exact search itself."""
    import time

    from .knn import exact_knn

    spark = queries.sparkSession
    began = time.perf_counter()
    exact = exact_knn(queries, vectors, k).persist()
    exact.count()
    base = time.perf_counter() - began
    n = vectors.count()
    d = next(iter(indexes.values())).dimensions
    rows = [(0, 0, 1.0, base, 1.0, n * d * 4, 1.0, n * d * 4)]
    for m, index in sorted(indexes.items()):
        storage = ivf.partition_stats(index.lists).agg(F.sum(F.col("n") * (4 + m) + 8)).first()[0] or 0
        for p in n_probes:
            began = time.perf_counter()
            found = ivf.search(queries, index, p, k).persist()
            found.count()
            took = time.perf_counter() - began
            recall = recall_per_query(exact, found, k).agg(F.avg("recall")).first()[0]
            touched = bandwidth(ivf.probe(queries, index, p), index.lists, m).first().bytes
            rows.append((m, p, recall, took, base / took, storage, n * d * 4 / max(1, storage), touched))
            found.unpersist()
    exact.unpersist()
    return spark.createDataFrame(rows, "m int, n_probe int, recall double, seconds double, speedup double, storage long, reduction double, bandwidth long")
