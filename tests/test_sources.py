"""Readers and writers, discovery, feature matrices, samples, maps and streams."""

from __future__ import annotations

import csv
import glob
import gzip
import os
import struct
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from annolith.operators import encoder, features, ivf, mapping, pq, sampling, user_index
from annolith.sources import discovery, readers, writers
from annolith.streaming import labelling

from .test_vectors import frame


def _mtx(folder, cells, genes, entries):
    folder.mkdir(parents=True)
    lines = ["%%MatrixMarket matrix coordinate integer general", "%", f"{len(genes)} {len(cells)} {len(entries)}", *[f"{g} {c} {v}" for g, c, v in entries]]
    for name, rows in (("matrix.mtx.gz", lines), ("barcodes.tsv.gz", cells), ("features.tsv.gz", [f"id{i}\t{g}\tGene Expression" for i, g in enumerate(genes)])):
        with gzip.open(folder / name, "wt") as f:
            f.write("\n".join(rows) + "\n")


def test_matrix_market(spark, tmp_path):
    _mtx(tmp_path / "a", ["AA", "BB"], ["g1", "g2"], [(1, 1, 5), (2, 2, 7)])
    _mtx(tmp_path / "b", ["AA"], ["g2", "g3"], [(2, 1, 1)])
    (tmp_path / "c").mkdir()
    got = readers.matrix_market_samples(spark, {s: f"file://{tmp_path}/{s}" for s in "abc"}).collect()
    assert sorted((r.sample_id, r.cell_id, r.symbol, r.value) for r in got) == [("a", "a_AA", "g1", 5.0), ("a", "a_BB", "g2", 7.0), ("b", "b_AA", "g3", 1.0)]


def test_text_sources(spark, tmp_path):
    (tmp_path / "genes.txt").write_text("B\nA \nB\n")
    assert [tuple(r) for r in readers.vocabulary(spark, f"file://{tmp_path}/genes.txt").collect()] == [(0, "B"), (1, "A "), (2, "B")]
    (tmp_path / "labels.tsv").write_text("t cell\tx\nb cell\ty\n")
    assert [tuple(r) for r in readers.tsv_labels(spark, f"file://{tmp_path}/labels.tsv").collect()] == [(0, "t cell"), (1, "b cell")]
    (tmp_path / "models.txt").write_text("one\n\ntwo\n")
    own = spark.createDataFrame([("u1", "mine")], "id string, name string")
    assert [r.name for r in readers.models(spark, f"file://{tmp_path}/models.txt", own).collect()] == ["one", "two", "mine"]


def test_npy_and_range_scan(spark, tmp_path):
    x = np.arange(12, dtype=np.float32).reshape(4, 3)
    np.save(tmp_path / "e.npy", x)
    got = readers.npy_vectors(spark, f"file://{tmp_path}/e.npy", 3).orderBy("vec_id").collect()
    assert [r.vec_id for r in got] == [0, 1, 2] and np.array_equal([r.embedding for r in got], x[:3])
    writers.write_vectors(frame(spark, x), f"file://{tmp_path}/v")
    scan = readers.embeddings(spark, f"file://{tmp_path}/v", 1, 3, ("vec_id",))
    assert sorted(r.vec_id for r in scan.collect()) == [1, 2]
    plan = scan._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(vec_id,1)" in plan and "ReadSchema: struct<vec_id:bigint>" in plan


def test_binary_index_round_trip(spark, tmp_path):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((200, 8)).astype(np.float32)
    index = ivf.build(frame(spark, x), m=2, k=8, max_iter=5)
    folder = f"file://{tmp_path}/bin"
    writers.write_binary_index(index, folder)
    again = readers.read_binary_index(spark, folder)
    assert sorted(map(tuple, again.lists.collect())) == sorted(map(tuple, index.lists.collect()))
    assert np.allclose(again.centroids, index.centroids, atol=1e-6) and np.allclose(again.pq.codebook, index.pq.codebook, atol=1e-6)
    assert again.describe() == index.describe()
    q = frame(spark, x[:5])
    key = lambda found: [(r.query_id, r.rank, r.vec_id) for r in sorted(found.collect())]
    assert key(ivf.search(q, again, 3, 5)) == key(ivf.search(q, index, 3, 5))
    with pytest.raises(Exception, match="codes of 2 bytes"):
        readers.read_inverted_lists(spark, f"{folder}/partitions", 4).collect()
    with pytest.raises(Exception, match="32 bits"):
        writers.write_binary_index(replace(index, lists=index.lists.withColumn("vec_id", F.lit(1 << 40))), f"file://{tmp_path}/large")


def test_binary_index_by_the_byte(spark, tmp_path):
    """Files written by hand from the format: two lists of four dimensions, two subspaces of four words."""
    folder = tmp_path / "hand"
    (folder / "partitions").mkdir(parents=True)
    (folder / "ivf_metadata.json").write_text('{"d": 4, "n_partitions": 2, "pq_m": 2, "pq_k": 4, "max_iterations": 1, "inertia": 0.5, "centroids_shape": [2, 4], "version": "residual-1.1"}')
    (folder / "pq_metadata.json").write_text('{"m": 2, "k": 4, "d_sub": 2, "version": "1.0"}')
    (folder / "ivf_centroids.bin").write_bytes(struct.pack("<II8f", 2, 4, 0, 0, 0, 0, 1, 1, 1, 1))
    (folder / "pq_codebooks.bin").write_bytes(struct.pack("<16f", 1, 0, 0, 1, -1, 0, 0, -1, 0, 1, 1, 0, 0, -1, -1, 0))
    (folder / "partitions" / "partition_0001.bin").write_bytes(struct.pack("<II", 3, 2) + struct.pack("<iBB", 7, 0, 0) + struct.pack("<iBB", -2, 1, 1) + struct.pack("<iBB", 9, 0, 1))
    index = readers.read_binary_index(spark, f"file://{folder}")
    assert sorted((r.partition_id, r.vec_id, bytes(r.codes)) for r in index.lists.collect()) == [(1, -2, b"\1\1"), (1, 7, b"\0\0"), (1, 9, b"\0\1")]
    found = ivf.search(frame(spark, [[2, 1, 1, 2]]), index, 1, 3).collect()  # residual (1, 0, 0, 1)
    assert [(r.vec_id, r.dist) for r in found] == [(7, 0.0), (9, 2.0), (-2, 4.0)]
    writers.write_binary_index(index, f"file://{tmp_path}/again")
    body = (tmp_path / "again" / "partitions" / "partition_0001.bin").read_bytes()
    assert body == struct.pack("<II", 3, 2) + struct.pack("<iBB", -2, 1, 1) + struct.pack("<iBB", 7, 0, 0) + struct.pack("<iBB", 9, 0, 1)
    for name in ("ivf_centroids.bin", "pq_codebooks.bin"):
        assert (tmp_path / "again" / name).read_bytes() == (folder / name).read_bytes()
    (folder / "partitions" / "0000.bin").write_bytes(b"x")
    with pytest.raises(Exception, match="no list file"):
        readers.read_inverted_lists(spark, f"file://{folder}/partitions", 2).collect()
    (folder / "partitions" / "0000.bin").unlink()
    (folder / "partitions" / "partition_0000.bin").write_bytes(struct.pack("<II", 3, 2))
    with pytest.raises(Exception, match="3 entries"):
        readers.read_inverted_lists(spark, f"file://{folder}/partitions", 2).collect()


def test_user_index_document_by_the_byte(spark, tmp_path):
    """A document as others write it: lists by number, labels of 16 bits, coordinates of all cells beside."""
    import base64
    import json

    def b64(data):
        return base64.b64encode(data).decode()

    document = {
        "id": "user-1", "name": "mine", "baseModelId": "base", "created": "2026-01-02T03:04:05.678Z", "cellCount": 3, "category": "kind", "labels": ["a", "b"],
        "x": b64(struct.pack("<3f", 0.5, 1.5, 2.5)), "y": b64(struct.pack("<3f", -0.5, -1.5, -2.5)), "labelIndices": b64(struct.pack("<3h", 0, 300, -1)),
        "partitions": {
            "12": {"pqCodes": b64(bytes([1, 2, 3, 4])), "pqCodeCount": 2, "labelIndices": b64(struct.pack("<2h", 0, -1))},
            "3": {"pqCodes": b64(bytes([255, 0])), "pqCodeCount": 1, "labelIndices": b64(struct.pack("<h", 300))},
        },
    }
    (tmp_path / "index.json").write_text(json.dumps(document, indent=2))
    store = user_index.UserIndexStore(spark, f"file://{tmp_path}/store")
    assert store.load(f"file://{tmp_path}/index.json") == "user-1"
    rows = store.get("user-1")[1].orderBy("pos").collect()
    assert [(r.partition_id, r.pos, bytes(r.codes), r.label_id, r.x) for r in rows] == [(3, 0, b"\xff\0", 300, None), (12, 1, b"\1\2", 0, None), (12, 2, b"\3\4", -1, None)]
    assert tuple(store.describe("user-1").first()) == ("user-1", "mine", "base", 3, 2) and store.describe("none").count() == 0
    assert [tuple(r) for r in store.labels("user-1").collect()] == [(0, "a"), (1, "b")]
    text = spark.read.text(f"file://{tmp_path}/index.json", wholetext=True).withColumnRenamed("value", "json")
    points = [tuple(r)[1:] for r in user_index.map_points(text).orderBy("pos").collect()]
    assert points == [(0, 0.5, -0.5, 0), (1, 1.5, -1.5, 300), (2, 2.5, -2.5, -1)]
    written = json.loads(store.export("user-1").first().json)
    for number, part in document["partitions"].items():
        assert {k: written["partitions"][number][k] for k in part} == part
    assert {k: written[k] for k in ("id", "name", "baseModelId", "created", "cellCount", "category", "labels")} == {k: document[k] for k in ("id", "name", "baseModelId", "created", "cellCount", "category", "labels")}
    for broken in ({**document, "partitions": [{"partition": 1}]}, {k: v for k, v in document.items() if k != "labelIndices"}, {**document, "partitions": {"1": {"codes": ""}}}):
        (tmp_path / "broken.json").write_text(json.dumps(broken))
        with pytest.raises(Exception, match="no user index"):
            store.load(f"file://{tmp_path}/broken.json")


def test_npy_file_is_written_and_read_by_ranges(spark, tmp_path):
    x = np.random.default_rng(4).standard_normal((1000, 6)).astype(np.float32)
    writers.write_npy(frame(spark, x), f"file://{tmp_path}/v.npy")
    assert (np.load(tmp_path / "v.npy") == x).all()
    found = readers.npy_vectors(spark, f"file://{tmp_path}/v.npy", rows_per_batch=30, rows_per_task=90)
    assert found.rdd.getNumPartitions() == 12
    rows = found.orderBy("vec_id").collect()
    assert [r.vec_id for r in rows] == list(range(1000)) and (np.array([r.embedding for r in rows], np.float32) == x).all()
    with pytest.raises(ValueError, match="without a gap"):
        writers.write_npy(frame(spark, x[:2], np.array([0, 5])), f"file://{tmp_path}/w.npy")
    with pytest.raises(ValueError, match="mounted"):
        writers.write_npy(frame(spark, x[:2]), "hdfs://x/w.npy")


def test_fetch_keeps_what_it_has(tmp_path):
    (tmp_path / "a b.bin").write_bytes(b"one")
    url = f"file://{tmp_path}/a%20b.bin"
    place = readers.fetch(url, f"file://{tmp_path}/cache")
    (tmp_path / "a b.bin").write_bytes(b"two")
    assert readers.fetch(url, f"file://{tmp_path}/cache") == place and open(place, "rb").read() == b"one"
    with pytest.raises(OSError):
        readers.fetch(f"file://{tmp_path}/none", f"{tmp_path}/cache")
    assert len(list((tmp_path / "cache").iterdir())) == 1


def test_map_files_are_written_and_read_by_stretches(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(readers, "_MAP_ROWS", 70)
    rows = spark.range(500).selectExpr("id * 2 AS vec_id", "id / 500 AS x", "-id / 500 AS y", "cast(id % 3 - 1 AS int) AS kind").repartition(5)
    names = spark.createDataFrame([("kind", 0, "a"), ("kind", 1, "b")], "column string, code int, category string")
    writers.write_map(rows, names, {}, f"file://{tmp_path}/map")
    back, _, meta = readers.read_map(spark, f"file://{tmp_path}/map")
    got = back.orderBy("vec_id").collect()
    assert meta["numPoints"] == 500 and [r.kind for r in got] == [i % 3 - 1 for i in range(500)] and all(abs(r.x - i / 500) < 1e-6 for i, r in enumerate(got))
    (tmp_path / "map" / "y.bin").write_bytes(b"1234")
    with pytest.raises(ValueError, match="1 values for 500 points"):
        readers.read_map(spark, f"file://{tmp_path}/map")


def test_map_round_trip(spark, tmp_path):
    rows = [(i, float(i), -float(i), "ab"[i % 2] if i else None) for i in range(5)]
    pts = spark.createDataFrame(rows, "vec_id long, x double, y double, kind string")
    d = mapping.category_dictionary(pts, "kind")
    coded = mapping.encode_category(mapping.normalise(pts), "kind", d).select("vec_id", "x", "y", F.col("kind_code").alias("kind"))
    writers.write_map(coded, d.withColumn("column", F.lit("kind")), {"xCenter": 2.0}, f"file://{tmp_path}/map")
    back, names, meta = readers.read_map(spark, f"file://{tmp_path}/map")
    assert [(r.x, r.y, r.kind) for r in back.orderBy("vec_id").collect()] == [(-1, 1, -1), (-0.5, 0.5, 1), (0, 0, 0), (0.5, -0.5, 1), (1, -1, 0)]
    assert [r.category for r in names.orderBy("code").collect()] == ["a", "b"] and meta["numPoints"] == 5
    flat = spark.createDataFrame([(1, 3.0, 4.0)], "vec_id long, x double, y double")
    assert tuple(mapping.normalise(flat).first()) == (1, 0.0, 0.0)
    with pytest.raises(mapping.TooManyCategories):
        mapping.category_dictionary(pts, "vec_id", 4)


def test_result_files(spark, tmp_path):
    cells = spark.createDataFrame([("a", "t cell", 0.5), ("b", None, None)], "cell_id string, label string, confidence double")
    assert [r.line for r in writers.result_rows(cells).collect()] == ['"a","t cell",0.500', '"b","Unknown",1.000']
    writers.write_results(cells.coalesce(1), f"file://{tmp_path}/r")
    with open(glob.glob(f"{tmp_path}/r/*.csv")[0]) as f:
        assert list(csv.reader(f)) == [["cell_id", "category_label", "confidence"], ["a", "t cell", "0.500"], ["b", "Unknown", "1.000"]]
    writers.write_labels_csv(cells.coalesce(1), f"file://{tmp_path}/l")
    assert open(glob.glob(f"{tmp_path}/l/*.csv")[0]).readline() == '"cell_id","category_label"\n'


def test_discovery(spark):
    obs = spark.createDataFrame([("c",)], "barcode string").withColumn("cell_id", F.lit("d"))
    assert discovery.cell_name_column(obs) == "barcode"
    var = spark.createDataFrame([("ENSG1", "actb"), ("ENSG2", "Gapdh"), ("ENSG3", "x")], "gene_name string, symbol string")
    assert discovery.gene_name_column(var) == "symbol"
    assert [r.symbol for r in discovery.gene_names(var).collect()] == ["ACTB", "GAPDH", "X"]
    with pytest.raises(discovery.NotFound):
        discovery.gene_name_column(var.select("gene_name"))
    with pytest.raises(discovery.NotFound):
        discovery.cell_name_column(var)
    assert discovery.raw_counts_key(["spliced", "raw"], True, True) == ("layers/raw", False)
    assert discovery.raw_counts_key(["spliced"], True, True, offline=True) == ("raw/X", False)
    assert discovery.raw_counts_key([], False, True) == ("X", True)


def test_collisions_and_duplicates(spark):
    genes = spark.createDataFrame([(0, "A"), (1, "A"), (2, "B"), (3, "Z"), (4, None)], "gene_idx int, symbol string")
    voc = spark.createDataFrame([(0, "B"), (1, "A"), (2, "B")], "model_idx int, symbol string")
    rows = spark.createDataFrame([("c", 0, 5.0), ("c", 1, 7.0), ("c", 2, 1.0), ("c", 3, 9.0), ("d", 0, 5.0), ("d", 4, 1.0)], "cell_id string, gene_idx int, value double")
    assert sorted(map(tuple, features.align(rows, genes, voc).collect())) == [("c", 0, 1.0), ("c", 1, 7.0), ("d", 1, 5.0)]
    assert sorted(map(tuple, features.align(rows, genes, voc, "last").collect()))[-2:] == [("c", 2, 1.0), ("d", 1, 5.0)]
    dense = features.from_dense(features.to_dense(rows.where("gene_idx < 2"), 2), keep_zeros=True)
    assert ("d", 1, 0.0) in {tuple(r) for r in features.align(dense, genes, voc).collect()}  # a dense zero overwrites


def test_normalisation_edges(spark):
    rows = spark.createDataFrame([("a", 0, 0.0), ("b", 0, float("nan")), ("b", 1, 2.0), ("c", 0, None)], "cell_id string, model_idx int, value double")
    got = {(r.cell_id, r.model_idx): r.value for r in features.log_normalise(rows).collect()}
    assert got == {("a", 0): 0.0, ("b", 0): 0.0, ("b", 1): np.log1p(1e4), ("c", 0): 0.0}
    assert features.expressed(spark.createDataFrame([(np.float32(0.1).item(),), (0.1,)], "value double")).count() == 1


def test_csr_round_trip(spark, monkeypatch):
    rows = spark.createDataFrame([(1, 4, 2.0), (1, 0, 1.0), (2, 3, 5.0)], "cell_id long, gene_idx int, value double")
    assert sorted(map(tuple, features.from_csr(features.to_csr(rows)).collect())) == sorted(map(tuple, rows.collect()))
    flat = spark.createDataFrame([(i, float(i)) for i in range(6)], "pos long, value double")
    assert [(r.cell_id, r.gene_idx) for r in features.from_flat(flat, 3).orderBy("value").collect()] == [(0, 0), (0, 1), (0, 2), (1, 0), (1, 1), (1, 2)]
    monkeypatch.setattr(features, "_BLOCK", 1000)
    indptr = spark.createDataFrame([(0, 0), (1, 2), (2, 2), (3, 70_000)], "pos long, start long")
    entries = spark.range(70_003).select(F.col("id").alias("pos"), F.lit(1).alias("gene_idx"), F.lit(1.0).alias("value"))
    got = {r.cell_id: r["count"] for r in features.csr_slices(indptr, entries).groupBy("cell_id").count().collect()}
    assert got == {0: 2, 2: 69_998, 3: 3}


def test_same_metadata(spark):
    one = spark.createDataFrame([("g", "x"), ("h", "x")], "symbol string, value string")
    two = spark.createDataFrame([("g", "x"), ("h", "y"), ("i", None)], "symbol string, value string")
    assert {r.symbol: r.value for r in features.same_metadata([("1", one), ("2", two)]).collect()} == {"g": "x", "h": None, "i": None}


def test_importance_against_the_definition(spark):
    rng = np.random.default_rng(0)
    w = rng.standard_normal((5, 3))
    e = encoder.LinearEncoder(w)
    x = np.array([[3.0, 0.05, 0, 2, 1]])
    rows = spark.createDataFrame([("c", i, float(v)) for i, v in enumerate(x[0]) if v], "cell_id string, model_idx int, value double")
    want = {}
    for i in (0, 3, 4):
        y = x.copy()
        y[0, i] = 0
        want[i] = float(np.linalg.norm(e.encode(y) - e.encode(x)))
    got = {r.model_idx: r.importance for r in encoder.importance(rows, e, batch=2).collect()}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-12 for i in want)
    voc = spark.createDataFrame([(i, f"g{i}") for i in range(5)], "model_idx int, symbol string")
    top = encoder.top_genes(encoder.importance(rows, e), voc, 0)
    assert top.count() == 3 and top.where("rank = 1").first().gene == f"g{max(want, key=want.get)}"


def test_samples(spark):
    df = spark.createDataFrame([(i, "abc"[min(i % 10, 2)]) for i in range(100)], "vec_id long, label string")
    for n in (1, 7, 33, 100, 500):
        s = sampling.stratified_sample(df, "label", n)
        assert s.count() == min(n, 100)
    counts = {r.label: r["count"] for r in sampling.stratified_sample(df, "label", 50).groupBy("label").count().collect()}
    assert counts == {"a": 5, "b": 5, "c": 40}
    one, two = (sorted(r.vec_id for r in sampling.random_subset(d, 9).collect()) for d in (df, df.repartition(5)))
    assert one == two and len(one) == 9
    missing = df.withColumn("label", F.when(F.col("vec_id") >= 5, F.col("label")))
    assert sampling.labelled_strata(missing, "label").count() == 95
    with pytest.raises(sampling.StrataError):
        sampling.labelled_strata(df.withColumn("label", F.when(F.col("vec_id") >= 10, F.col("label"))), "label")


def test_label_stream_writes_once(spark, tmp_path):
    rows = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(10)], "cell_id long, label string")
    for k in range(3):
        rows.withColumn("label", F.concat("label", F.lit(str(k)))).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = labelling.cell_stream(spark, f"{tmp_path}/in", rows.schema)
    for _ in range(2):  # a second run finds nothing new
        labelling.label_stream(stream, lambda b: b, f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 30
    now = labelling.current_cells(spark, f"{tmp_path}/out")
    assert now.count() == 10 and now.select(F.substring("label", 2, 1)).distinct().count() == 1
    labelling.count_stream(stream, "counts_test", f"{tmp_path}/cp2").awaitTermination()
    assert sum(r.n for r in spark.table("counts_test").collect()) == 30


def test_state_is_kept_by_key(spark, tmp_path):
    """Of every cell the row of the latest time, whichever batch it came in; a batch leaves other buckets' files alone."""
    schema = "cell_id long, label string, t long"
    batches = ([(i, "a", 10) for i in range(50)], [(3, "b", 20), (60, "b", 5)], [(3, "late", 15), (3, "c", 30), (7, "c", 10 + 1)])
    state = {}
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = labelling.cell_stream(spark, f"{tmp_path}/in", spark.createDataFrame(rows, schema).schema)
        before = set(glob.glob(f"{tmp_path}/out/*/*.parquet"))
        labelling.upsert_stream(stream, lambda b: b, f"file://{tmp_path}/out", f"{tmp_path}/cp", order=("t",), buckets=16).awaitTermination()
        for cell, label, t in rows:
            state[cell] = max(state.get(cell, (0, "")), (t, label))
        got = {r.cell_id: (r.t, r.label) for r in spark.read.parquet(f"file://{tmp_path}/out").collect()}
        assert got == state
        if n:
            assert len(before & set(glob.glob(f"{tmp_path}/out/*/*.parquet"))) >= len(before) - 2


@pytest.mark.parametrize("stopped", ["before the table is touched", "after buckets are removed", "after buckets are written"])
def test_state_survives_a_batch_that_is_stopped(spark, tmp_path, monkeypatch, stopped):
    """The batch comes again and no cell is lost, also of buckets that were gone."""
    import shutil

    schema = "cell_id long, label string, t long"
    inside = labelling._replace_buckets

    def run(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        go()

    def go():
        stream = labelling.cell_stream(spark, f"{tmp_path}/in", spark.createDataFrame([], schema).schema)
        labelling.upsert_stream(stream, lambda b: b, f"file://{tmp_path}/out", f"{tmp_path}/cp", order=("t",), buckets=4).awaitTermination()

    def dies(spark, pending, out):
        if stopped == "after buckets are removed":
            for r in spark.read.parquet(pending).select("bucket").distinct().collect():
                shutil.rmtree(f"{tmp_path}/out/bucket={r.bucket}")
        elif stopped == "after buckets are written":
            inside(spark, pending, out)
        raise RuntimeError("stopped")

    run([(i, "a", 10) for i in range(40)])
    monkeypatch.setattr(labelling, "_replace_buckets", dies)
    with pytest.raises(Exception, match="stopped"):
        run([(i, "b", 20) for i in range(5)] + [(50, "b", 20)])
    monkeypatch.setattr(labelling, "_replace_buckets", inside)
    go()
    got = {r.cell_id: r.label for r in spark.read.parquet(f"file://{tmp_path}/out").collect()}
    assert got == {**{i: "a" for i in range(40)}, **{i: "b" for i in range(5)}, 50: "b"}
    run([(50, "c", 30)])
    assert {r.cell_id: r.label for r in spark.read.parquet(f"file://{tmp_path}/out").collect()} == {**got, 50: "c"}
    assert len(glob.glob(f"{tmp_path}/cp-pending/*")) == 1


def test_list_files_beyond_four_digits(spark, tmp_path):
    """Of an index of so many lists those with numbers of five digits have vectors."""
    n = 10_003
    lists = spark.createDataFrame([(9_999, 1, bytearray(b"\0\1")), (10_000, 2, bytearray(b"\1\1")), (10_002, 3, bytearray(b"\1\0"))], "partition_id int, vec_id long, codes binary")
    quantizer = pq.from_words([np.array([[0.0], [1.0]])] * 2)
    written = ivf.IvfPqIndex(np.zeros((n, 2)) + np.arange(n)[:, None], quantizer, lists)
    assert writers.write_binary_index(written, f"file://{tmp_path}/index") == 3
    assert sorted(os.path.basename(p) for p in glob.glob(f"{tmp_path}/index/partitions/*")) == ["partition_10000.bin", "partition_10002.bin", "partition_9999.bin"]
    back = readers.read_inverted_lists(spark, f"file://{tmp_path}/index/partitions", 2)
    assert sorted((r.partition_id, r.vec_id, bytes(r.codes)) for r in back.collect()) == [(9_999, 1, b"\0\1"), (10_000, 2, b"\1\1"), (10_002, 3, b"\1\0")]


def test_replaceable_request(spark):
    r = labelling.Replaceable(spark)
    assert r.run(lambda: spark.range(5).count()) == 5 and r.run(lambda: spark.range(6).count()) == 6
    r.cancel()


def test_onnx_is_optional():
    e = encoder.OnnxEncoder(b"", 3)
    assert "_session" not in e.__getstate__()


def _cell_file(tmp_path, name, **datasets):
    with open(tmp_path / name, "wb") as f:
        np.savez(f, **{k.replace("__", "/"): v for k, v in datasets.items()})
    return f"{tmp_path}/{name}"


@pytest.mark.parametrize("form", ["csr", "dense", "flat"])
def test_cell_files(spark, tmp_path, form):
    from annolith.sources import cells

    cells.register(spark)
    x = np.array([[0, 2, 0], [1, 0, 3], [0, 0, 0], [4, 5, 6]], np.float32)
    obs = {"obs__barcode__categories": np.array([b"A", b"B"]), "obs__barcode__codes": np.array([0, 1, -1, 0], np.int8)}
    var = {"var__feature_name": np.array(["ENSG1", "ENSG2", "ENSG3"]), "var__symbol": np.array(["actb", "GAPDH", "zz"])}
    if form == "csr":
        matrix = {"layers__counts__data": x[x > 0], "layers__counts__indices": np.nonzero(x)[1], "layers__counts__indptr": np.array([0, 1, 3, 3, 6]), "X": x * 100}
    else:
        matrix = {"raw__X": x if form == "dense" else x.ravel(), "X": x * 100}
    path = _cell_file(tmp_path, "c.h5ad", **obs, **var, **matrix)
    got = spark.read.format("cells").option("path", path).option("rows", 2).load()
    assert got.rdd.getNumPartitions() == 2
    want = [(["A", "B", "", "A"][i], j, ["ACTB", "GAPDH", "ZZ"][j], float(x[i, j])) for i, j in zip(*np.nonzero(x))]
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert spark.read.format("cells").option("path", path).option("limit", 1).load().count() == 1
    assert [r.cell_id for r in spark.read.format("cells").option("path", path).option("table", "obs").load().collect()] == ["A", "B", "", "A"]
    (tmp_path / "no.h5ad").write_bytes(b"no cells here")
    with pytest.raises(Exception, match="Failed to extract"):
        spark.read.format("cells").option("path", f"{tmp_path}/no.h5ad").load().collect()


def test_dense_zeros_of_colliding_genes_count(spark, tmp_path):
    """Of two columns with one symbol the last one stands, a zero included; other zeros are no rows."""
    from annolith.sources import cells

    cells.register(spark)
    x = np.array([[7, 1, 0], [7, 0, 2]], np.float32)
    path = _cell_file(tmp_path, "z.h5ad", obs__barcode=np.array(["A", "B"]), var__symbol=np.array(["ACTB", "GAPDH", "actb"]), X=x)
    long = spark.read.format("cells").option("path", path).option("rows", 1).load()
    assert sorted(map(tuple, long.select("cell_id", "gene_idx", "value").collect())) == [("A", 0, 7.0), ("A", 1, 1.0), ("A", 2, 0.0), ("B", 0, 7.0), ("B", 2, 2.0)]
    voc = spark.createDataFrame([(0, "ACTB"), (1, "GAPDH")], "model_idx int, symbol string")
    got = features.align(long, long.select("gene_idx", "symbol").distinct(), voc)
    assert sorted(map(tuple, got.collect())) == [("A", 0, 0.0), ("A", 1, 1.0), ("B", 0, 2.0)]
    with pytest.raises(Exception, match="all machines mount"):
        spark.read.format("cells").option("path", "/nowhere/c.h5ad").load().collect()


def test_running_total_over_ranges(spark):
    rows = spark.range(1000).selectExpr("id * 3 AS k", "id % 7 AS n").repartition(6)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    got = sorted(map(tuple, features.running_total(rows, "k", "n", "t").select("k", "t").collect()))
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want, at = [], 0
    for i in range(1000):
        want.append((3 * i, at))
        at += i % 7
    assert got == want


def test_align_normalise_gather_shuffle_once(spark):
    genes = spark.createDataFrame([(i, f"g{i}") for i in range(9)], "gene_idx int, symbol string")
    voc = genes.withColumnRenamed("gene_idx", "model_idx")
    rows = spark.createDataFrame([(c, g, 1.0) for c in range(20) for g in range(9)], "cell_id long, gene_idx int, value double")
    encoded = encoder.embed(features.log_normalise(features.align(rows, genes, voc)), encoder.LinearEncoder(np.eye(9), normalise=False))
    plan = encoded._jdf.queryExecution().executedPlan().toString()
    assert sum("Exchange hashpartitioning(cell_id" in line for line in plan.splitlines()) == 1
