"""The neighbour map: curve, memberships, graph, layout, projector, and how far its neighbours can be trusted."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from annolith import ingest
from annolith.operators import clustering, mapping, neighbour_map

from .test_vectors import clustered, frame  # noqa: F401


def test_the_curve_follows_its_target():
    a, b = neighbour_map.curve(0.5)
    assert abs(a - 0.583) < 0.01 and abs(b - 1.334) < 0.01  # what is published for this distance
    a, b = neighbour_map.curve(0.1)
    assert abs(a - 1.577) < 0.02 and abs(b - 0.895) < 0.02


def test_memberships_sum_up_alike():
    rng = np.random.default_rng(1)
    d = np.sort(rng.uniform(0.5, 3, (50, 10)) * rng.uniform(0.1, 100, (50, 1)), axis=1)
    w = neighbour_map.memberships(d)
    assert np.allclose(w[:, 0], 1) and np.allclose(w.sum(axis=1), np.log2(10), atol=1e-3) and (np.diff(w, axis=1) <= 0).all()
    d[0, 5:] = np.inf
    assert (neighbour_map.memberships(d)[0, 5:] == 0).all()
    assert np.isfinite(neighbour_map.memberships(np.zeros((2, 10)))).all()


def test_graph_by_hand(spark):
    x = np.array([[0.0], [1.0], [3.0], [10.0]])
    edges = {(r.a, r.b): r.weight for r in neighbour_map.neighbour_graph(frame(spark, x), 2).collect()}
    directed = {(0, 1): 1.0, (0, 2): None, (1, 0): 1.0, (1, 2): None, (2, 1): 1.0, (2, 0): None, (3, 2): 1.0, (3, 1): None}
    assert set(edges) == {(min(e), max(e)) for e in directed} and all(0 < w <= 1 for w in edges.values())
    assert edges[0, 1] == pytest.approx(1) and edges[1, 2] == pytest.approx(1) and edges[2, 3] == pytest.approx(1)


def _brute_trust(x, y, k):
    n = len(x)
    dx, dy = (np.sqrt(((a[:, None] - a[None]) ** 2).sum(axis=2)) for a in (x, y))
    total = 0
    for i in range(n):
        others = [j for j in range(n) if j != i]
        rank = {j: r + 1 for r, j in enumerate(sorted(others, key=lambda j: (dx[i, j], j)))}
        total += sum(max(0, rank[j] - k) for j in sorted(others, key=lambda j: (dy[i, j], j))[:k])
    return 1 - 2 / (n * k * (2 * n - 3 * k - 1)) * total


def test_trustworthiness_against_brute_force(spark):
    rng = np.random.default_rng(2)
    x, y = rng.standard_normal((150, 5)), rng.standard_normal((150, 2))
    for plane in (y, x[:, :2]):
        points = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(plane)], "vec_id long, x double, y double")
        got = neighbour_map.trustworthiness(frame(spark, x), points, 7).first()[0]
        assert got == pytest.approx(_brute_trust(np.float32(x).astype(float), plane, 7), abs=1e-12)
    assert neighbour_map.trustworthiness(frame(spark, x[:3]), points, 7).first()[0] is None


@pytest.fixture(scope="module")
def trained(spark, clustered):  # noqa: F811
    projector, points = neighbour_map.train(frame(spark, clustered[:2000]), rounds=6, epochs=15)
    return projector, points.persist()


def test_map_is_more_trustworthy_than_principal_components(spark, clustered, trained):  # noqa: F811
    vectors = frame(spark, clustered[:2000])
    queries = vectors.where("vec_id % 10 = 3")
    flat = mapping.project(vectors, mapping.Projector.fit(clustered[:2000].astype(float)))
    projected = mapping.project(vectors, trained[0])
    trust = [neighbour_map.trustworthiness(vectors, p, 10, queries).first()[0] for p in (flat, trained[1], projected)]
    assert trust[1] > trust[0] and trust[1] > 0.97, trust
    assert trust[2] > trust[0], trust


def test_projector_places_new_vectors_and_survives_its_file(spark, clustered, trained, tmp_path):  # noqa: F811
    new = frame(spark, clustered[2000:2600])
    flat = mapping.project(new, mapping.Projector.fit(clustered[:2000].astype(float)))
    placed = mapping.project(new, trained[0])
    trust = [neighbour_map.trustworthiness(new, p, 10).first()[0] for p in (flat, placed)]
    assert trust[1] > trust[0], trust
    ingest.save_projector(spark, trained[0], f"{tmp_path}/map")
    again = ingest.load_projector(spark, f"{tmp_path}/map")
    x = clustered[2000:2100].astype(float)
    assert np.allclose(again.project(x), trained[0].project(x))
    square = ingest.place_on_map(new, again).agg(F.max(F.abs("x")), F.max(F.abs("y")), F.count("*")).first()
    assert max(square[0], square[1]) <= 1 + 1e-9 and square[2] == 600


def test_map_is_the_same_by_its_seed_whatever_the_partitions(spark, clustered, monkeypatch):  # noqa: F811
    monkeypatch.setattr(neighbour_map, "SHARD_EDGES", 500)
    rows = frame(spark, clustered[:300])
    maps = [{r.vec_id: (r.x, r.y) for r in neighbour_map.train(v, rounds=2, epochs=5)[1].collect()} for v in (rows, rows.repartition(5))]
    assert len(maps[0]) == 300 and all(np.allclose(maps[0][i], maps[1][i], atol=1e-3) for i in maps[0])


def test_odd_vectors(spark):
    rows = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0]), (9, [1.0, 2.0]), (None, [0.0, 0.0]), (5, None), (7, [4.0, 4.0])], "vec_id long, embedding array<float>")
    projector, points = neighbour_map.train(rows, rounds=1, epochs=2)
    assert sorted(r.vec_id for r in points.collect()) == [1, 2, 7, 9]
    assert np.isfinite(projector.project(np.array([[1.0, 2.0]]))).all()
    with pytest.raises(ValueError, match="no vectors"):
        neighbour_map.train(rows.where("false"))
