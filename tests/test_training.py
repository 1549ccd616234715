"""Training at size: samples of a given size, two-level k-means, indexes of more lists than the driver trains."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from annolith.operators import clustering, ivf, kernels, knn, pq

from .test_vectors import clustered, frame  # noqa: F401


def test_a_sample_has_the_size_asked_for(spark):
    rows = spark.range(200_000).select(F.col("id").alias("vec_id"), F.array(F.col("id").cast("float")).alias("embedding"))
    rows = rows.unionByName(spark.createDataFrame([(None, [1.0]), (5, None)], "vec_id long, embedding array<float>"))
    for n in (1, 777, 150_000, 200_000, 300_000):
        ids = [r.i for r in clustering.training_table(rows.repartition(7), n).select("i").collect()]
        assert len(ids) == len(set(ids)) == min(n, 200_000)
    a, b = (set(r.i for r in clustering.training_table(rows.repartition(p), 5000).collect()) for p in (3, 11))
    assert a == b
    assert len(clustering.bounded_sample(rows, 3000)) == 3000 and len(clustering.bounded_sample(rows, 250_000)) == 200_000
    with pytest.raises(ValueError, match="more than"):
        clustering.bounded_sample(rows, clustering.SAMPLE_ROWS + 1)


def test_two_levels_are_as_good_as_one(spark, clustered):  # noqa: F811
    x = clustered.astype(float)
    sample = clustering.training_table(frame(spark, clustered), 4000)
    flat, two = clustering.train_kmeans(x, 63, 100), clustering.train_kmeans_two_level(sample, 63)
    inertia = [kernels.nearest(x, c)[1].sum() for c in (flat, two)]
    assert len(two) == 63 and inertia[1] < 1.05 * inertia[0]
    again = clustering.train_kmeans_two_level(sample.repartition(5), 63)
    assert np.allclose(np.sort(two, axis=0), np.sort(again, axis=0), atol=1e-6)


def test_equal_rows_and_few_rows(spark):
    same = clustering.training_table(frame(spark, np.ones((300, 4))), 300)
    assert clustering.train_kmeans_two_level(same, 20).tolist() == [[1, 1, 1, 1]]
    x = np.repeat(np.arange(5.0), 40)[:, None] * np.ones(4)
    few = clustering.train_kmeans_two_level(clustering.training_table(frame(spark, x), 200), 50)
    assert {tuple(c) for c in few.tolist()} == {(float(i),) * 4 for i in range(5)}
    assert len(clustering.train_kmeans_two_level(clustering.training_table(frame(spark, x[:3]), 9), 9)) == 1


def test_quotas():
    assert clustering._shares(np.array([90, 9, 1, 0]), 10).tolist() == [8, 1, 1, 0]
    for counts, k in (([5, 5, 5], 15), ([1000, 1, 1], 50), ([3, 0, 2], 4)):
        q = clustering._shares(np.array(counts), k)
        assert q.sum() == min(k, sum(counts)) and (q <= counts).all() and ((q > 0) == (np.array(counts) > 0)).all()


def _recall(vectors, index, n_probe, one_in=40):
    q = vectors.where(f"vec_id % {one_in} = 0")
    near = knn.exact_knn(q, vectors, 10)
    found = ivf.refine(ivf.search(q, index, n_probe, 60), q, vectors, 10)
    same = near.join(found, ["query_id", "vec_id"], "left_semi").count()
    return same / near.count()


def test_an_index_trained_over_the_cluster_recalls_as_much(spark, clustered, monkeypatch):  # noqa: F811
    vectors = frame(spark, clustered)
    flat = ivf.build(vectors, m=8, k=64, max_iter=25)
    monkeypatch.setattr(ivf, "DRIVER_LISTS", 10)
    two = ivf.build(vectors, m=8, k=64, max_iter=25)
    assert two.n_partitions == flat.n_partitions == 63
    recall = [_recall(vectors, i, 8, 5) for i in (flat, two)]  # of 8,000 pairs: one seed differs from another by 0.003
    assert recall[1] > recall[0] - 0.01 and recall[1] > 0.9


def test_training_reads_the_sample_asked_for_and_nothing_else(spark, clustered, monkeypatch):  # noqa: F811
    """Also beyond what the driver trains on."""
    vectors, seen = frame(spark, clustered), []
    inside = clustering.training_table
    monkeypatch.setattr(clustering, "SAMPLE_ROWS", 1000)
    monkeypatch.setattr(clustering, "training_table", lambda *a: seen.append(inside(*a)) or seen[-1])
    index = ivf.build(vectors, m=8, k=32, training_rows=2400)
    assert [s.count() for s in seen] == [2400] and index.metadata["training_rows"] == 2400
    assert index.lists.count() == 4000 and index.n_partitions == 63
    driver = pq.train_quantizer(clustered[:1000].astype(float), 8, 32)
    refined = pq.refine_words(inside(vectors, 4000), driver, np.zeros((1, 32)))
    wrong = [((clustered - q.decode(q.encode(clustered.astype(float)))) ** 2).mean() for q in (driver, refined)]
    assert wrong[1] < wrong[0]


def test_more_lists_than_the_driver_trains(spark):
    rng = np.random.default_rng(3)
    centers = rng.standard_normal((300, 8)) * 4
    x = (centers[rng.integers(0, 300, 30_000)] + rng.standard_normal((30_000, 8)) * 0.3).astype(np.float32)
    vectors = frame(spark, x)
    index = ivf.build(vectors, m=4, k=16, n_partitions=4_500, training_rows=30_000, max_iter=3)
    assert ivf.DRIVER_LISTS < index.n_partitions <= 4_500 and index.n_partitions > 4_400
    assert index.lists.count() == 30_000
    assert _recall(vectors, index, 60) > 0.9
