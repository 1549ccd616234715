"""The composite entry points and the command line."""

from __future__ import annotations

import glob

import numpy as np
import pytest
from pyspark.sql import functions as F

from annolith import api, cli, ingest
from annolith.operators import analytics, encoder, ivf, mapping, user_index
from annolith.sources import readers

from .test_vectors import frame


@pytest.fixture(scope="module")
def world(spark):
    """Cells of three kinds, each kind with genes of its own."""
    rng = np.random.default_rng(5)
    kinds = rng.integers(0, 3, 300)
    rows = []
    for i, k in enumerate(kinds):
        for g in range(12):
            v = rng.poisson(20 if g % 3 == k else 0.4)
            if v:
                rows.append((f"c{i}", g, float(v)))
    expression = spark.createDataFrame(rows, "cell_id string, gene_idx int, value double")
    genes = spark.createDataFrame([(g, f"G{g}") for g in range(12)], "gene_idx int, symbol string")
    vocabulary = spark.createDataFrame([(11 - g, f"G{g}") for g in range(12)], "model_idx int, symbol string")
    model = encoder.LinearEncoder(rng.standard_normal((12, 8)), unit=True)
    return kinds, expression, genes, vocabulary, model


def test_label_cells_end_to_end(spark, world):
    kinds, expression, genes, vocabulary, model = world
    known = api.number_cells(api.embed_cells(expression, genes, vocabulary, model).where("int(substr(cell_id, 2)) >= 60")).persist()
    kind = {f"c{i}": int(k) for i, k in enumerate(kinds)}
    pairs = spark.createDataFrame(list(kind.items()), "cell_id string, label_id int")
    labels = known.join(pairs, "cell_id").select("vec_id", "label_id")
    names = spark.createDataFrame([(i, f"kind {i}") for i in range(3)], "label_id int, label string")
    reference = api.Reference(ivf.build(known, m=4, k=32, max_iter=20), labels, names)
    new = expression.where("int(substr(cell_id, 2)) < 60")
    projector = mapping.Projector.fit(np.random.default_rng(0).standard_normal((20, 8)))
    got = api.label_cells(new, genes, vocabulary, model, reference, projector, n_probe=8, k=10).collect()
    assert len(got) == 60 and all(r.label == f"kind {kind[r.cell_id]}" for r in got) and all(0 < r.confidence <= 1 and r.x is not None for r in got)
    exact = api.label_exactly(api.embed_cells(new, genes, vocabulary, model), known, labels, names, 10).collect()
    assert {r.cell_id: r.label for r in exact} == {r.cell_id: r.label for r in got}
    assert api.label_exactly(api.embed_cells(new, genes, vocabulary, model), known, labels, names, 10, weighted=True).count() == 60
    # the labelled cells make an index of their own
    cells = api.label_embeddings(api.embed_cells(new, genes, vocabulary, model), reference, 8, 10)
    rows = user_index.entries(cells.withColumns({"pos": F.xxhash64("cell_id"), "x": F.lit(0.0), "y": F.lit(0.0)}), "mine")
    found = user_index.search(known, reference.index, rows, 8, 5)
    truth = {r.vec_id: r.label_id for r in labels.collect()}
    best = [(r.label_id, truth[r.query_id]) for r in found.where("rank = 1").collect()]
    assert len(best) > 200 and np.mean([a == b for a, b in best]) > 0.95


def test_validation(spark):
    a = frame(spark, np.eye(4)).withColumn("kind", F.col("vec_id").cast("string"))
    b = a.where("vec_id < 3").withColumn("kind", F.when(F.col("vec_id") == 1, None).otherwise(F.col("kind")))
    r = api.validate_export(a, b, ["kind"]).first()
    assert (r.n_both, r.n_missing, r.n_different, r.n_different_kind) == (3, 1, 0, 1)


def test_sweep_and_folder_size(spark, tmp_path):
    x = np.random.default_rng(0).standard_normal((300, 8))
    v = frame(spark, x)
    rows = analytics.sweep(frame(spark, x[:20]), v, {2: ivf.build(v, m=2, k=16, max_iter=5), 4: ivf.build(v, m=4, k=16, max_iter=5)}, (1, 17), 5).collect()
    assert [(r.m, r.n_probe) for r in rows] == [(0, 0), (2, 1), (2, 17), (4, 1), (4, 17)]
    assert rows[2].recall >= rows[1].recall and rows[1].bandwidth <= rows[2].bandwidth == rows[2].storage and rows[3].reduction > 1
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x").write_bytes(b"123")
    (tmp_path / "y").write_bytes(b"12")
    assert analytics.folder_size(spark, f"file://{tmp_path}") == 5


def test_command_line(spark, tmp_path, capsys):
    x = np.random.default_rng(1).standard_normal((200, 16)).astype(np.float32)
    np.save(tmp_path / "v.npy", x)
    frame(spark, x).withColumn("label", (F.col("vec_id") % 3).cast("int")).write.parquet(f"{tmp_path}/ref")
    cli.main(["train", f"file://{tmp_path}/v.npy", f"file://{tmp_path}/index", "--pq-m", "4", "--pq-k", "32", "--max-iter", "5", "--test"], spark)
    cli.main(["measure-recall", f"file://{tmp_path}/v.npy", f"file://{tmp_path}/index", "--queries", "20"], spark)
    assert capsys.readouterr().out.count("find themselves first") == 4
    cli.main(["label", f"file://{tmp_path}/v.npy", f"file://{tmp_path}/ref", f"file://{tmp_path}/out"], spark)
    assert sum(len(open(f).readlines()) - 1 for f in glob.glob(f"{tmp_path}/out/*.csv")) == 200


def test_export_and_map_commands(spark, tmp_path, capsys):
    x = np.random.default_rng(2).standard_normal((120, 6)).astype(np.float32)
    frame(spark, x).withColumn("kind", F.concat(F.lit("k"), (F.col("vec_id") % 3).cast("string"))).write.parquet(f"{tmp_path}/v")
    out = f"file://{tmp_path}"
    cli.main(["export", f"{out}/v", f"{out}/e", "--labels", "kind", "--max-vectors", "100"], spark)
    assert capsys.readouterr().out.strip() == "{'n_both': 100, 'n_missing': 0, 'n_different': 0, 'n_different_kind': 0}"
    assert (np.load(tmp_path / "e" / "embeddings.npy") == x[:100]).all() and spark.read.parquet(f"{out}/e/labels.parquet").count() == 100
    cli.main(["map-train", f"{out}/v", f"{out}/m", "--label", "kind", "--training-rows", "30"], spark)
    ids = spark.read.parquet(f"{out}/m/training_ids").selectExpr("vec_id % 3 AS k").groupBy("k").count().collect()
    assert sorted(r["count"] for r in ids) == [10, 10, 10]
    cli.main(["map", f"{out}/v", f"{out}/m", f"{out}/p", "--max-vectors", "90"], spark)
    cli.main(["map-export", f"{out}/p", f"{out}/v", f"{out}/files", "--labels", "kind"], spark)
    points, names, meta = readers.read_map(spark, f"{out}/files")
    rows = points.orderBy("vec_id").collect()
    assert meta["numPoints"] == 90 and [r.kind for r in rows] == [i % 3 for i in range(90)] and max(abs(v) for r in rows for v in (r.x, r.y)) == 1
    assert [r.category for r in names.orderBy("code").collect()] == ["k0", "k1", "k2"]


def test_ingest_numbers_cells_by_name(spark, world):
    kinds, expression, genes, vocabulary, model = world
    obs = spark.createDataFrame([(f"c{i}", f"k{k}", f"c{i}") for i, k in enumerate(kinds) if i % 10], "cell_id string, kind string, name string")
    got = ingest.ingest(expression, genes, vocabulary, model, obs, ("kind", "missing"), 200).collect()
    names = sorted({f"c{i}" for i in range(300)} & {r.cell_id for r in expression.select("cell_id").distinct().collect()})
    assert sorted((r.vec_id, r.cell_id) for r in got) == list(enumerate(names))[:200]
    assert all(r.kind == (f"k{kinds[int(r.cell_id[1:])]}" if int(r.cell_id[1:]) % 10 else None) for r in got)
