
from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from annolith.operators import analytics, ivf, knn, pq, vote

from .test_vectors import frame


@pytest.fixture(scope="module")
def world():
    """10,000 vectors of 128 dimensions around 16 centres of growing radius, every other one shifted in the first or the
    second half; every 20th vector lies between two clusters."""
    rng = np.random.default_rng(42)
    centers = rng.standard_normal((16, 128))
    centers *= ((10 + 2 * np.arange(16)) / np.linalg.norm(centers, axis=1))[:, None]
    centers[::2, :64] += 3
    centers[1::2, 64:] += 3
    own = np.arange(10_000) % 16
    x = centers[own] + rng.standard_normal((10_000, 128)) * rng.uniform(0.3, 1.0, 16)[own][:, None]
    between = np.arange(0, 10_000, 20)
    t = rng.uniform(0.3, 0.7, len(between))[:, None]
    x[between] = t * x[between] + (1 - t) * centers[rng.integers(0, 16, len(between))]
    queries = x[::50][:100] + 1.5 * rng.standard_normal((100, 128))
    return x.astype(np.float32), own, queries.astype(np.float32)


@pytest.fixture(scope="module")
def index(spark, world):
    built = ivf.build(frame(spark, world[0]), m=16, k=256, max_iter=25)
    built.lists = built.lists.persist()
    return built


def test_recall_bounds(spark, world, index):
    x, _, queries = world
    q, v = frame(spark, queries), frame(spark, x)
    exact = knn.exact_knn(q, v, 5).persist()
    recalls = [analytics.recall_per_query(exact, ivf.search(q, index, p, 5), 5).agg(F.avg("recall")).first()[0] for p in (1, 2, 4, 8, 16, 32)]
    assert recalls[0] > 0.2 and recalls[-1] >= 0.65, recalls
    assert all(b >= a - 0.01 for a, b in zip(recalls, recalls[1:])) and recalls[-1] - recalls[0] > 0.05, recalls


def _labelled(spark, world, found):
    own = spark.createDataFrame([(i, int(k)) for i, k in enumerate(world[1])], "vec_id long, label_id int")
    return vote.majority_vote(vote.with_labels(found, own), 50)


def test_label_bounds(spark, world, index):
    x, own, _ = world
    ids = np.arange(7, 10_000, 100)  # 100 cells
    q, v = frame(spark, x[ids], ids), frame(spark, x)
    truth = {int(i): int(own[i]) for i in ids}
    mine = {r.query_id: (r.label_id, r.confidence) for r in _labelled(spark, world, ivf.search(q, index, 8, 50)).collect()}
    assert np.mean([mine[i][0] == truth[i] for i in truth]) >= 0.70
    exact = {r.query_id: r.label_id for r in _labelled(spark, world, knn.exact_knn(q, v, 50)).collect()}
    near = {r.query_id: r.label_id for r in _labelled(spark, world, ivf.search(q, index, 20, 50)).collect()}
    assert np.mean([near[i] == exact[i] for i in truth]) >= 0.60
    four = {r.query_id: (r.label_id, r.confidence) for r in _labelled(spark, world, ivf.search(q, index, 4, 50)).collect()}
    for least, bound in ((0.0, 0.70), (0.9, 0.80), (1.0, 0.90)):
        kept = [i for i in truth if four[i][1] >= least]
        assert kept and np.mean([four[i][0] == exact[i] for i in kept]) > bound


def test_reconstruction_bounds_of_both_kinds():
    rng = np.random.default_rng(42)
    pattern = np.repeat(0.5 * rng.standard_normal(16), 8)
    x = rng.standard_normal((1000, 128)) + pattern
    q = pq.train_quantizer(x, 16, 256, 25)
    for rows, most in ((x, 10), (rng.standard_normal((500, 128)) + pattern, 5)):
        back = q.decode(q.encode(rows))
        assert ((rows - back) ** 2).mean() < most and np.linalg.norm(rows - back) / np.linalg.norm(rows) < 0.8
    assert q.compression_ratio >= 4


def test_exact_queries_find_themselves(spark):
    """Search accuracy: 500 vectors of 64 dimensions, five of them asked exactly and a little moved."""
    rng = np.random.default_rng(42)
    x = rng.standard_normal((500, 64)).astype(np.float32)
    ids = np.array([10, 50, 100, 200, 300])
    index = ivf.build(frame(spark, x), m=8, k=64, max_iter=25)
    for rows in (x[ids], x[ids] + 0.05 * rng.standard_normal((5, 64)).astype(np.float32)):
        found = ivf.search(frame(spark, rows, ids), index, index.n_partitions, 10)
        assert analytics.hit_recall(frame(spark, rows, ids), found, 10).first()[0] == 1.0


@pytest.mark.parametrize("d", [64, 128, 256])
def test_dimensions(spark, d):
    x = np.random.default_rng(d).standard_normal((200, d)).astype(np.float32)
    index = ivf.build(frame(spark, x), m=8, k=32, max_iter=5)
    assert ivf.search(frame(spark, x[:3]), index, 4, 5).count() == 15 and index.dimensions == d
