"""Quantisation, inverted lists and search: hand-made cases, invariants on clustered vectors, edges."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from annolith.functions import labels, vectors
from annolith.operators import analytics, clustering, ivf, kernels, knn, pq, user_index, vote


def frame(spark, x, ids=None):
    ids = np.arange(len(x)) if ids is None else ids
    return spark.createDataFrame(pa.table({"vec_id": pa.array(ids), "embedding": pa.array(list(np.asarray(x, np.float32)), pa.list_(pa.float32()))})).repartition(3)


@pytest.fixture(scope="module")
def clustered():
    """16 groups with bridges between them, as an index is meant for."""
    rng = np.random.default_rng(42)
    centers = rng.standard_normal((16, 32)) * (3 + np.arange(16) / 4)[:, None]
    x = np.concatenate([centers[i % 16] + rng.standard_normal(32) * rng.uniform(0.3, 1.0) for i in range(4000)]).reshape(-1, 32)
    x[::20] = (centers[rng.integers(0, 16, 200)] + centers[rng.integers(0, 16, 200)]) / 2
    return x.astype(np.float32)


@pytest.fixture(scope="module")
def index(spark, clustered):
    built = ivf.build(frame(spark, clustered), m=8, k=64, max_iter=25)
    built.lists = built.lists.persist()
    return built


def test_distances_by_hand():
    """Codebooks, residual and codes worked out on paper: squared distances 0, 4, 2."""
    q = pq.ProductQuantizer(np.array([[[1, 0], [0, 1], [-1, 0], [0, -1]], [[0, 1], [1, 0], [0, -1], [-1, 0]]], float))
    d = q.distances(q.table(np.array([[1.0, 0, 0, 1]])), np.array([[0, 0], [1, 1], [0, 1]]))
    assert d.tolist() == [[0, 4, 2]]


def test_search_by_hand(spark):
    book = np.array([[[0, 0], [0.5, 0.5], [1, 1]], [[0, 0], [0.5, 0.5], [1, 1]]], float)
    rows = [(0, 0, bytes([0, 1])), (0, 1, bytes([1, 0])), (0, 2, bytes([2, 2]))]
    lists = spark.createDataFrame([(p, v, bytearray(c)) for p, v, c in rows], "partition_id int, vec_id long, codes binary")
    two = ivf.IvfPqIndex(np.array([[0.0] * 4, [1.0] * 4]), pq.ProductQuantizer(book), lists)
    got = ivf.search(frame(spark, [[0, 0, 0.5, 0.5], [1, 1, 1, 1]]), two, 1, 2).collect()
    assert [(r.query_id, r.rank, r.vec_id, r.dist) for r in got] == [(0, 1, 0, 0.0), (0, 2, 1, 1.0)]  # the second list is empty
    with pytest.raises(ValueError):
        ivf.IvfPqIndex(np.zeros((2, 3)), two.pq, lists)
    with pytest.raises(Exception, match="dimensions"):
        ivf.probe(frame(spark, [[0, 0]]), two).collect()


def test_ties_take_the_lowest(spark):
    assert kernels.nearest(np.array([[0.0, 0.0]]), np.array([[1.0, 0], [0, 1], [-1, 0]]))[0].tolist() == [0]
    q = pq.from_words([np.array([[1.0], [1.0], [2.0]]), np.array([[5.0]])])
    assert q.encode(np.array([[1.0, 0.0]])).tolist() == [[0, 0]]
    same = frame(spark, [[1, 1]] * 50 + [[2, 2]], np.arange(51)[::-1].copy())
    got = knn.exact_knn(same.where("vec_id = 7"), same, 4).collect()
    assert [r.vec_id for r in got] == [1, 2, 3, 4] and {r.dist for r in got} == {0.0}


def test_exact_search_against_brute_force(spark, clustered):
    x = clustered[:700].astype(np.float64)
    d = ((x[:40, None] - x[None]) ** 2).sum(-1)
    want = np.lexsort((np.broadcast_to(np.arange(700), d.shape), d))[:, :7]
    got = knn.exact_knn(frame(spark, clustered[:40]), frame(spark, clustered[:700]), 7).toPandas().sort_values(["query_id", "rank"])
    assert (got.vec_id.to_numpy().reshape(40, 7) == want).all()


@pytest.fixture
def few_bytes(monkeypatch):
    """A broadcast has room for 7 queries, a task for 3 queries and 40 rows; collecting vectors is an error."""
    monkeypatch.setattr(kernels, "BLOCK_BYTES", 8 * 32 * 7)
    for module in (knn, ivf):
        monkeypatch.setattr(module, "QUERY_BYTES", 8 * 32 * 3)
    monkeypatch.setattr(knn, "ROW_BYTES", 8 * 32 * 40)
    monkeypatch.setattr(ivf, "LIST_ROWS", 10)

    def refuse(self):
        raise AssertionError("vectors came to the driver")

    monkeypatch.setattr(type_of_frame(), "toArrow", refuse)


def type_of_frame():
    from pyspark.sql.classic.dataframe import DataFrame

    return DataFrame


@pytest.mark.parametrize("metric", ["l2sq", "l2", "cosine"])
def test_many_queries_search_as_few_do(spark, clustered, request, metric):
    q, v = frame(spark, clustered[:30]), frame(spark, clustered[:300])
    few = {(r.query_id, r.rank): (r.vec_id, round(r.dist, 9)) for r in knn.exact_knn(q, v, 5, metric).collect()}
    request.getfixturevalue("few_bytes")
    many = {(r.query_id, r.rank): (r.vec_id, round(r.dist, 9)) for r in knn.exact_knn(q, v, 5, metric).collect()}
    assert many == few and len(few) == 150


@pytest.mark.parametrize("payload", [None, "label_id"])
def test_many_queries_search_lists_as_few_do(spark, clustered, index, request, payload):
    own = ivf.IvfPqIndex(index.centroids, index.pq, index.lists.withColumn("label_id", (F.col("vec_id") % 7).cast("int")), index.partition_ids, index.metadata)
    q = frame(spark, clustered[:60])
    few = sorted((*r[:3], round(r[3], 9), *r[4:]) for r in ivf.search(q, own, 4, 10, payload=payload).collect())
    request.getfixturevalue("few_bytes")
    found = ivf.search(q, own, 4, 10, payload=payload)
    assert sorted((*r[:3], round(r[3], 9), *r[4:]) for r in found.collect()) == few and len(few) == 600
    assert "FlatMapCoGroupsInArrow" in found._jdf.queryExecution().optimizedPlan().toString()


def test_search_edges(spark, index):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert knn.exact_knn(none, frame(spark, [[1, 2]]), 3).count() == 0
    assert knn.exact_knn(frame(spark, [[1, 2]]), none, 3).count() == 0
    assert ivf.search(none, index).count() == 0
    nulls = spark.createDataFrame([(1, [1.0, 2.0]), (None, [1.0, 1.0]), (2, None)], "vec_id long, embedding array<float>")
    assert [(r.query_id, r.vec_id) for r in knn.exact_knn(nulls, nulls, 3).collect()] == [(1, 1)]
    zero = frame(spark, [[0, 0], [1, 0]])
    assert [(r.query_id, r.vec_id) for r in knn.exact_knn(zero, zero, 3, "cosine").collect()] == [(1, 1)]
    with pytest.raises(ValueError):
        ivf.build(none)
    with pytest.raises(ValueError):
        pq.check_shape(10, 3, 256)
    with pytest.raises(ValueError):
        pq.check_shape(8, 2, 300)


def test_every_vector_is_in_one_list(index, clustered):
    rows = index.lists.select("vec_id").collect()
    assert sorted(r.vec_id for r in rows) == list(range(len(clustered)))
    assert index.n_partitions == 63 and index.metadata["version"] == "residual-1.1" and index.pq.metadata()["compression_ratio"] == 32 * 32 / 64


def test_recall_grows_with_lists(spark, index, clustered):
    rng = np.random.default_rng(1)
    q = frame(spark, clustered[::50] + 0.3 * rng.standard_normal((80, 32)))
    exact = knn.exact_knn(q, frame(spark, clustered), 5)
    recalls = [analytics.recall_per_query(exact, ivf.search(q, index, p, 5), 5).agg(F.avg("recall")).first()[0] for p in (1, 4, 16, 63)]
    assert all(b >= a - 0.01 for a, b in zip(recalls, recalls[1:])) and recalls[0] > 0.2 and recalls[-1] >= 0.5
    refined = ivf.refine(ivf.search(q, index, 16, 50), q, frame(spark, clustered), 5)
    assert analytics.recall_per_query(exact, refined, 5).agg(F.avg("recall")).first()[0] >= 0.9


def test_own_position_and_order(spark, index, clustered):
    q = frame(spark, clustered[:50])
    found = ivf.search(q, index, 4, 50)
    assert analytics.hit_recall(q, found, 50).first()[0] > 0.9
    rows = found.orderBy("query_id", "rank").toPandas()
    assert all(g.dist.is_monotonic_increasing for _, g in rows.groupby("query_id"))
    first = ivf.search(q, index, 4, 10).toPandas()
    assert set(map(tuple, first[["query_id", "rank", "vec_id"]].to_numpy())) <= set(map(tuple, rows[["query_id", "rank", "vec_id"]].to_numpy()))
    assert analytics.self_accuracy(q, index).first()[0] > 0.3


def test_reconstruction_bounds(clustered):
    x = clustered[:1000].astype(np.float64)
    q = pq.train_quantizer(x, 8, 256, 20)
    back = q.decode(q.encode(x))
    assert ((x - back) ** 2).mean() < 10 and np.linalg.norm(x - back) / np.linalg.norm(x) < 0.8 and q.compression_ratio >= 4
    small = pq.train_quantizer(x[:5], 4, 8, 10)  # fewer rows than words: the rest is never chosen
    assert np.isfinite(small.decode(small.encode(x))).all()


def test_kmeans_trainers(spark, clustered):
    one = clustering.train_kmeans(clustered[:500], 12, 30)
    two = clustering.train_kmeans_two_level(clustering.training_table(frame(spark, clustered[:500]), 500), 12)
    inertia = [kernels.nearest(clustered[:500].astype(float), c)[1].sum() for c in (one, two)]
    assert inertia[1] < 1.3 * inertia[0] and len(clustering.train_kmeans(np.ones((9, 2)), 4)) == 1
    step = clustering.lloyd_step(frame(spark, clustered[:500]), one).agg(F.sum("n"), F.sum("inertia")).first()
    assert step[0] == 500 and abs(step[1] - inertia[0]) < 1e-6 * inertia[0]


def test_save_load_round_trip(spark, index, clustered, tmp_path):
    ivf.save(index, f"file://{tmp_path}/i")
    again = ivf.load(spark, f"file://{tmp_path}/i")
    q = frame(spark, clustered[:20])
    assert sorted(map(tuple, ivf.search(q, again, 4, 10).collect())) == sorted(map(tuple, ivf.search(q, index, 4, 10).collect()))
    plan = again.lists.where(F.col("partition_id") == 3)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(partition_id), EqualTo(partition_id,3)]" in plan


def test_votes(spark):
    rows = [(1, r, 100 + r, lab, float(r)) for r, lab in enumerate([5, 2, 2, 5, 9], 1)] + [(2, 1, 7, -1, 1.0)]
    near = spark.createDataFrame([(q, r, v, d) for q, r, v, _, d in rows], "query_id long, rank int, vec_id long, dist double")
    known = spark.createDataFrame([(v, lab) for _, _, v, lab, _ in rows], "vec_id long, label_id int")
    labelled = vote.with_labels(near, known)
    assert [tuple(r) for r in vote.majority_vote(labelled, 50).collect()] == [(1, 2, 2, 0.04)]
    assert [tuple(r) for r in vote.majority_vote(labelled, 50, "first_seen").collect()] == [(1, 5, 2, 0.04)]
    assert vote.majority_vote(labelled, 50, weight="dist").first().label_id == 5
    every = vote.all_queries(spark.createDataFrame([(1,), (2,)], "vec_id long"), vote.majority_vote(labelled, 50))
    names = spark.createDataFrame([(2, "two")], "label_id int, label string")
    assert {r.query_id: r.label for r in vote.decode_labels(every, names).collect()} == {1: "two", 2: "Unknown"}
    assert vote.labelled_only(every).count() == 1


def test_user_index_store(spark, index, clustered, tmp_path):
    cells = ivf.artifacts(frame(spark, clustered[:60]), index).select(F.col("query_id").alias("pos"), "partition_id", "codes")
    cells = cells.withColumns({"label_id": (F.col("pos") % 300).cast("int"), "x": F.col("pos") / 2, "y": -F.col("pos") / 4})
    store = user_index.UserIndexStore(spark, f"file://{tmp_path}/store")
    assert store.list().count() == 0
    meta = spark.sql("SELECT 'a' AS id, 'A' AS name, 'base' AS base_model_id, timestamp'2026-01-02 03:04:05.678' AS created, 60L AS cell_count, 'kind' AS category, array('x', null) AS labels")
    for name in ("a", "b"):
        store.save(meta.withColumn("id", F.lit(name)), user_index.entries(cells, name))
    store.save(meta, user_index.entries(cells.where("pos < 30"), "a"))  # saving again replaces
    assert sorted(r.id for r in store.list().collect()) == ["a", "b"]
    assert store.get("a")[1].count() == 30 and store.get("b")[1].count() == 60
    text = store.export("b").first().json
    (tmp_path / "b.json").write_text(text)
    store.delete("b")
    assert store.load(f"file://{tmp_path}/b.json") == "b"
    key = ["partition_id", "pos", "codes", "label_id", "x", "y"]
    assert sorted(map(tuple, store.get("b")[1].select(key).collect())) == sorted(map(tuple, user_index.entries(cells, "b").select(key).collect()))
    assert store.get("b")[0].first().created == meta.first().created
    found = user_index.search(frame(spark, clustered[:5]), index, store.get("b")[1], 4, 3)
    assert found.count() == 15 and set(found.columns) == {"query_id", "rank", "label_id", "dist"}
    assert user_index.search(frame(spark, clustered[:5]), index, store.get("none")[1]).count() == 0


def test_a_cell_of_an_imported_index_carries_no_list_and_no_map(spark, tmp_path):
    """What is exploded and sorted are cells: their rows do not grow with the index."""
    cells = spark.range(20_000).selectExpr("id AS pos", "cast(id % 3 AS int) AS partition_id", "unhex('0102') AS codes", "cast(id % 500 AS int) AS label_id", "id / 2 AS x", "-id / 4 AS y")
    meta = spark.sql("SELECT 'a' AS id, 'A' AS name, 'base' AS base_model_id, timestamp'2026-01-02 03:04:05.678' AS created, 1L AS cell_count, 'kind' AS category, array('x') AS labels")
    user_index.to_json(meta, user_index.entries(cells, "a")).select(F.col("json").alias("value")).coalesce(1).write.text(f"{tmp_path}/a")
    documents = spark.read.text(f"{tmp_path}/a", wholetext=True).withColumnRenamed("value", "json")
    back = user_index.from_json(documents)[1]
    plan = back._jdf.queryExecution().optimizedPlan()
    text = plan.toString()
    for line in text.splitlines():
        if "Window [" in line:  # what the window sorts
            assert "xs" not in line and "ys" not in line
    generated = [line for line in text.splitlines() if "Generate inline" in line]
    assert generated, "the lists are cut into cells before they are rows"
    assert back.agg(F.count("*"), F.sum("pos"), F.sum("x"), F.sum("y"), F.sum("label_id")).first() == cells.agg(F.count("*"), F.sum("pos"), F.sum("x"), F.sum("y"), F.sum("label_id")).first()
    assert user_index.map_points(documents).agg(F.count("*"), F.sum("x"), F.sum("label_id")).first() == cells.agg(F.count("*"), F.sum("x"), F.sum("label_id")).first()


def test_mismatches_sort_no_searches_side_by_side(spark):
    """Votes of two searches are compared by groupings alone, and as by hand."""
    rng = np.random.default_rng(3)
    draws = [{q: rng.integers(0, 4, rng.integers(0, 6)).tolist() for q in range(40)} for _ in range(3)]
    one, two, three = (spark.createDataFrame([(q, n + 1, int(c)) for q, cs in d.items() for n, c in enumerate(cs)], "query_id long, rank int, label_id long") for d in draws)

    def places(labels):
        return sorted(set(labels), key=lambda c: (-labels.count(c), labels.index(c)))

    want = set()
    for q in range(40):
        e, a = draws[0][q], draws[1][q]
        pe, pa = places(e), places(a)
        if pe and pa and pe[0] != pa[0]:
            want.add((q, pe[0], pa[0], e.count(pe[0]) / 5, a.count(pa[0]) / 5, pe.index(pa[0]) + 1 if pa[0] in pe else None, tuple(pe[:3]), tuple(pa[:3])))
    found = analytics.mismatches(one, two, 5)
    got = {(r.query_id, r.exact_label, r.approx_label, r.exact_confidence, r.approx_confidence, r.approx_place, tuple(r.exact_top3), tuple(r.approx_top3)) for r in found.collect()}
    assert got == want and len(want) > 5 and any(w[5] is None for w in want)
    other = analytics.mismatches(one, three, 5)
    compared = analytics.compare_settings(found, other)
    for table in (found, compared):
        plan = table._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in plan and "Window" not in plan
    a, b = ({r.query_id for r in x.select("query_id").collect()} for x in (found, other))
    assert {r.kind: r.n for r in compared.collect()} == {k: len(v) for k, v in (("fixed", a - b), ("new", b - a), ("persistent", a & b)) if v}


def test_rows_of_equal_codes_give_a_search_k_of_them(spark):
    """Of many rows with equal codes those with the smallest ids are found; tasks hand on no more than they need."""
    quantizer = pq.from_words([np.array([[0.0], [1.0]])] * 2)
    x = np.array([[0, 0], [0, 1], [1, 0], [1, 1]], float)[np.arange(4000) % 4]
    index = ivf.IvfPqIndex(np.zeros((1, 2)), quantizer, ivf.populate(frame(spark, x), np.zeros((1, 2)), quantizer))
    q = frame(spark, x[:4], np.arange(4))
    want = {(i, r + 1): i + 4 * r for i in range(4) for r in range(5)}
    assert {(r.query_id, r.rank): r.vec_id for r in ivf.search(q, index, 1, 5).collect()} == want
    kept = kernels.few_copies(x, np.arange(4000), 5)
    assert sorted(kept.tolist()) == list(range(20))


@pytest.mark.parametrize("shift", [0.0, 1e4])
def test_exact_search_in_single_precision_loses_nothing(shift):
    """Candidates are found by products in single precision: near ties, copies and vectors far from the origin."""
    rng = np.random.default_rng(5)
    x = rng.standard_normal((3000, 16)) + shift
    x[1000:2000] = x[:1000] + 1e-6 * rng.standard_normal((1000, 16))
    x[2500:] = x[2499]
    ids, q = rng.permutation(3000), np.concatenate([x[:40], x[2490:2510]])
    best = kernels.Best(len(q), 7)
    for lo in range(0, 3000, 1100):
        kernels.offer_exact(best, q, x[lo : lo + 1100], ids[lo : lo + 1100])
    for i, one in enumerate(q):
        dist = ((one - x) ** 2).sum(axis=1)
        order = np.lexsort((ids, dist))[:7]
        assert (best.ids[i] == ids[order]).all() and (best.dist[i] == dist[order]).all()


@pytest.mark.parametrize("shift", [0.0, 1e4])
@pytest.mark.parametrize("digits", [None, 3])
def test_a_search_by_tiles_loses_nothing_and_leaves_out_far_tiles(shift, digits, monkeypatch):
    """Near ties, copies, vectors far from the origin, few and many directions; what cannot be near is not compared."""
    monkeypatch.setattr(kernels, "_TILE", 64)
    monkeypatch.setattr(kernels, "_CELL", 32)
    rng = np.random.default_rng(5)
    for d in (1, 3, 16):
        x = rng.standard_normal((3000, d)) + 40 * rng.integers(0, 4, (3000, 1)) + shift
        x[1000:2000] = x[:1000] + 1e-6 * rng.standard_normal((1000, d))
        x[2500:] = x[2499]
        ids, q = rng.permutation(3000), np.concatenate([x[:90], x[2490:2510]])
        best, compared, matmul = kernels.Best(len(q), 7), [], np.matmul
        monkeypatch.setattr(np, "matmul", lambda *a, **b: (compared.append(len(a[0]) * a[1].shape[1]), matmul(*a, **b))[1])
        for lo in range(0, 3000, 1100):
            kernels.offer_tiled(best, q, x[lo : lo + 1100], ids[lo : lo + 1100], digits)
        monkeypatch.setattr(np, "matmul", matmul)
        for i, one in enumerate(q):
            dist = ((one - x) ** 2).sum(axis=1)
            dist = dist if digits is None else np.round(dist, digits)
            order = np.lexsort((ids, dist))[:7]
            assert (best.ids[i] == ids[order]).all() and (best.dist[i] == dist[order]).all()
        assert 0 < sum(compared) < 0.5 * len(q) * len(x)


def test_a_search_by_blocks_finds_a_query_once(spark, clustered, request):
    """Vectors pass a block of queries, so there is no best of every piece of them to be merged; parts are for the cores only."""
    request.getfixturevalue("few_bytes")
    q, v = (kernels.usable_rows(frame(spark, clustered[:n]), "vec_id", "embedding") for n in (30, 300))
    assert knn._blocks(q, v, 5, "l2sq", None).count() == 150
    assert knn._deal(3_000_000, 1_200_000, 512, 16, 12) == (24, 1)
    assert all(t * s >= 24 for t, s in (knn._deal(n, 10**7, 512, 16, 12) for n in (20_000, 200_000, 2_000_000)))


def test_copies_are_found_by_blocks_as_elsewhere(spark, clustered):
    x = clustered[np.arange(600) % 7]
    few = knn.exact_knn(frame(spark, x[:50]), frame(spark, x), 9).collect()
    assert sorted(map(tuple, few)) == sorted(map(tuple, knn.exact_knn(frame(spark, x[:50]), frame(spark, x), 9, broadcast_bytes=0).collect()))
    assert len(few) == 450


def test_a_search_with_limits_finds_the_same(spark, index, clustered, monkeypatch):
    q = frame(spark, clustered[:50])
    whole = [tuple(r) for r in ivf.search(q, index, index.n_partitions, 2).orderBy("query_id", "rank").collect()]
    calls, scan = [], ivf._scan
    monkeypatch.setattr(ivf, "_scan", lambda *a: (calls.append(a[6]), scan(*a))[1])
    monkeypatch.setattr(ivf, "LIMIT_ROWS", 1)
    assert [tuple(r) for r in ivf.search(q, index, index.n_partitions, 2).orderBy("query_id", "rank").collect()] == whole
    assert len(calls) == 2 and np.isinf(calls[0]).all() and np.isfinite(calls[1]).all()


def test_scalar_functions(spark):
    r = spark.sql("SELECT array(1f, 2f) AS a, array(4f, 6f) AS b, double('NaN') AS n, double('Infinity') AS i, array(0f, 0f) AS z").select(
        vectors.l2(F.col("a"), F.col("b")).alias("l2"),
        vectors.nan_to_num(F.col("n")).alias("n"),
        vectors.nan_to_num(F.col("i")).alias("i"),
        vectors.cosine_distance(F.col("a"), F.col("z")).alias("cz"),
        vectors.subvectors(F.col("a"), 2, 2).alias("s"),
        vectors.ratio(F.lit(1), F.lit(0)).alias("ratio"),
        vectors.compression_ratio(128, 32).alias("c"),
        labels.list_file_name(F.lit(7)).alias("f"),
        labels.user_index_id(F.lit(12), F.lit("x")).alias("u"),
        labels.decode_floats(labels.encode_floats(F.col("a"))).alias("back"),
        labels.encode_bytes(F.array(F.lit(0), F.lit(255))).alias("e"),
        labels.decode_bytes(labels.encode_bytes(F.array(F.lit(0), F.lit(255)))).alias("d"),
    ).first()
    assert (r.l2, r.n, r.cz, r.s, r.c, r.f, r.u, r.back, r.e, r.d) == (5.0, 0.0, None, [[1.0], [2.0]], 16.0, "0007", "user-12-x", [1.0, 2.0], "AP8=", [0, 255])
    assert r.i > 3e38 and r.ratio != r.ratio


def test_n_probe_is_chosen_for_recall(spark, index, clustered):
    n, got = analytics.n_probe_for(frame(spark, clustered[:20]), frame(spark, clustered), index, 5, 0.9)
    assert got >= 0.9 and 1 <= n <= index.n_partitions


def test_perturbation_depends_on_the_id_alone(spark, clustered):
    a = {r.vec_id: r.embedding for r in analytics.perturbed(frame(spark, clustered[:10])).collect()}
    b = {r.vec_id: r.embedding for r in analytics.perturbed(frame(spark, clustered[:10]).coalesce(1)).collect()}
    assert a == b and all(np.linalg.norm(np.array(a[i]) - clustered[i]) < 0.2 * np.linalg.norm(clustered[i]) for i in a)
