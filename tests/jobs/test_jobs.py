"""The jobs: growing input in two runs, a stopped run, reruns, odd rows, the command lines, and the queries against SQL."""

from __future__ import annotations

import glob
import os
import subprocess
import sys

import duckdb
import pytest
from pyspark.sql import functions as F

from annolith.session import shared_dir
from jobs import annotate_documents, marker_words
from jobs.common import configuration
from jobs.queries import ORACLE_SQL, QUERIES

from ..test_queries import _plain

REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, sf_dir, name):
    c = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    got, want = QUERIES[name](spark, sf_dir), c.execute(ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    order = sorted(names)
    assert sorted(got.columns) == order
    assert _plain([r[n] for n in order] for r in got.collect()) == _plain([r[names.index(n)] for n in order] for r in want.fetchall())


@pytest.fixture
def place(spark, tmp_path):
    shared_dir(spark)
    return str(tmp_path)


def _annotate(spark, sf_dir, place, **how):
    return annotate_documents.run(
        spark, f"{place}/in/documents.parquet", f"{sf_dir}/documents.parquet", f"{sf_dir}/labels.parquet", f"{place}/out", f"{place}/checkpoint",
        configuration(annotate_documents.NAME, **how),
    )


def _rows(spark, path):
    return sorted(map(tuple, spark.read.parquet(f"{path}/annotated").select("doc_id", "label_id", "label", "votes", "confidence").collect()), key=str)


def test_growing_input_gives_what_one_run_gives(spark, sf_dir, place):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs.where("doc_id < 120").repartition(3).write.mode("append").parquet(f"{place}/in/documents.parquet")
    first = _annotate(spark, sf_dir, place, files_per_trigger=2)
    assert (first["read"], first["rows"], first["batches"]) == (120, 120, 2)
    before = _rows(spark, f"{place}/out")
    docs.where("doc_id >= 120").repartition(2).write.mode("append").parquet(f"{place}/in/documents.parquet")
    second = _annotate(spark, sf_dir, place, files_per_trigger=2)
    assert (second["read"], second["rows"], second["batches"]) == (80, 80, 1)
    assert _annotate(spark, sf_dir, place) == {"read": 0, "rows": 0, "batches": 0}
    after = _rows(spark, f"{place}/out")
    assert set(before) <= set(after)
    want = QUERIES["job1_annotate_documents"](spark, sf_dir).withColumn("confidence", F.round("confidence", 6)).collect()
    assert {(r[0], r[1], r[2], r[3]) for r in after} == {(r.doc_id, r.label_id, r.label, r.votes) for r in want}
    counts = {r.label: r.n for r in spark.read.parquet(f"{place}/out/counts").groupBy("label").agg(F.sum("n").alias("n")).collect()}
    assert sum(counts.values()) == 200 and counts.get("high", 0) == sum(r[2] == "high" for r in after)


def test_a_batch_that_was_stopped_is_done_again_and_counted_once(spark, sf_dir, place, monkeypatch):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs.where("doc_id < 50").coalesce(1).write.parquet(f"{place}/in/documents.parquet")
    inside = annotate_documents.label_stream

    def dies_after_writing(cells, label, out, checkpoint):
        def write(batch, n):
            rows = label(batch).withColumn("batch_seq", F.lit(n).cast("long"))
            rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_seq").parquet(out)
            raise RuntimeError("stopped")  # the rows are there, the mark is not

        return cells.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    monkeypatch.setattr(annotate_documents, "label_stream", dies_after_writing)
    with pytest.raises(Exception, match="stopped"):
        _annotate(spark, sf_dir, place)
    monkeypatch.setattr(annotate_documents, "label_stream", inside)
    done = _annotate(spark, sf_dir, place)
    assert (done["rows"], done["batches"]) == (50, 1)
    assert len(_rows(spark, f"{place}/out")) == 50


def test_a_run_that_was_stopped_before_it_counted_is_mended(spark, sf_dir, place, monkeypatch):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs.where("doc_id < 30").coalesce(1).write.parquet(f"{place}/in/documents.parquet")
    monkeypatch.setattr(annotate_documents, "_count_new_batches", lambda *a: {"rows": 0, "batches": 0})
    _annotate(spark, sf_dir, place)
    monkeypatch.undo()
    assert _annotate(spark, sf_dir, place) == {"read": 0, "rows": 30, "batches": 1}


def test_odd_documents_and_an_empty_reference(spark, place):
    rows = [(1, "a b c"), (1, "a b"), (2, None), (3, ""), (None, "a b"), (4, "x " * 30_000), (5, "a b c")]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{place}/in/documents.parquet")
    labels = spark.createDataFrame([(1, 1), (5, 0), (4, None), (None, 1)], "doc_id long, quality int")
    labels.write.parquet(f"{place}/labels.parquet")

    def annotate(at, marks):
        annotate_documents.run(spark, f"{place}/in/documents.parquet", f"{place}/in/documents.parquet", marks, f"{place}/{at}", f"{place}/{at}/checkpoint")
        return {r[0]: (r[1], r[2]) for r in _rows(spark, f"{place}/{at}")}

    assert annotate("one", f"{place}/labels.parquet") == {1: (0, "low"), 2: (None, "Unknown"), 3: (None, "Unknown"), 4: (0, "low"), 5: (1, "high")}
    labels.where("false").write.parquet(f"{place}/none.parquet")
    assert set(annotate("two", f"{place}/none.parquet").values()) == {(None, "Unknown")}


def test_markers_of_odd_documents(spark, place):
    rows = [(1, "a b", "x"), (1, "a", "x"), (2, "a c c", "y"), (3, None, None), (4, "", "y"), (None, "a", "x"), (5, "a c", "12")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{place}/documents.parquet")
    how = configuration(marker_words.NAME, least_documents=1, markers=2)
    for _ in range(2):
        assert marker_words.run(spark, f"{place}/documents.parquet", f"{place}/out", how)["categories"] == 3
        got = {(r.category, r.rank): (r.word, r.n_in, r.n_out, r.share_in, r.share_out) for r in spark.read.schema(marker_words.SCHEMA).parquet(f"{place}/out").collect()}
        assert got == {
            ("x", 1): ("b", 1, 0, 1.0, 0.0), ("x", 2): ("a", 1, 2, 1.0, 0.5), ("y", 1): ("c", 1, 1, 0.5, 1 / 3), ("y", 2): ("a", 1, 2, 0.5, 2 / 3),
            ("12", 1): ("c", 1, 1, 1.0, 0.25), ("12", 2): ("a", 1, 2, 1.0, 0.5),
        }
    spark.createDataFrame([], "doc_id long, text string, lang string").write.parquet(f"{place}/empty.parquet")
    assert marker_words.run(spark, f"{place}/empty.parquet", f"{place}/none", how)["rows"] == 0
    with pytest.raises(ValueError, match="no category"):
        marker_words.run(spark, f"{place}/documents.parquet", f"{place}/out", {**how, "most_categories": 1})


def test_settings_are_known_by_name():
    with pytest.raises(ValueError, match="no such"):
        configuration(marker_words.NAME, neighbors=3)


def test_command_lines(spark, sf_dir, place):
    env = {**os.environ, "PYTHONPATH": REPO}
    a = [sys.executable, "-m", "jobs.marker_words", f"{sf_dir}/documents.parquet", f"{place}/markers", "--master", "local[2]"]
    done = subprocess.run(a, cwd=REPO, env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0 and "wrote 80 markers of 4 categories" in done.stderr
    assert sorted(os.path.basename(x) for x in glob.glob(f"{place}/markers/category=*")) == ["category=de", "category=en", "category=es", "category=fr"]
    b = [sys.executable, "-m", "jobs.annotate_documents", f"{sf_dir}/documents.parquet", f"{sf_dir}/documents.parquet", f"{sf_dir}/labels.parquet", f"{place}/o", f"{place}/c", "--master", "local[2]"]
    done = subprocess.run(b, cwd=REPO, env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0 and "read 200 new documents" in done.stderr


def test_texts_are_dealt_once_and_their_words_are_not(spark):
    """The words of a document, its total and its category meet without a further exchange of words."""
    from annolith.operators import features
    from jobs.common import words_of

    docs = spark.createDataFrame([(1, "a b a"), (1, "b"), (2, None), (None, "a"), (3, "")], "doc_id long, text string")
    counts = words_of(docs)
    assert sorted(map(tuple, counts.collect())) == [(1, "a", 2), (1, "b", 2)]
    values = features.log_normalise(counts.selectExpr("doc_id AS cell_id", "word AS model_idx", "cast(n AS double) AS value"))
    plan = values._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_documents_as_far_away_vote_as_in_sql(spark, place):
    """Sums of the same squares in another order are the same distance."""
    import random

    pick = random.Random(17)
    rows = [(i, " ".join(f"w{pick.randrange(40)}" for _ in range(pick.randrange(2, 6)))) for i in range(60)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{place}/a/documents.parquet")
    spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, quality int").write.parquet(f"{place}/a/labels.parquet")
    c = duckdb.connect()
    for name in ("documents", "labels"):
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM '{place}/a/{name}.parquet/*.parquet'")
    want = c.execute(ORACLE_SQL["job1_annotate_documents"]).fetchall()
    assert _plain(QUERIES["job1_annotate_documents"](spark, f"{place}/a").collect()) == _plain(want)


def test_words_are_counted_where_texts_are_read(spark, monkeypatch):
    """Counts are dealt, not texts; rows of a document are one, wherever batches and texts are cut."""
    import hashlib

    import numpy as np
    import pyarrow as pa

    from jobs import common

    texts = [(i % 40, None if i % 9 == 0 else " \t\u3000é\x1c\u00a0x ".join("ab\ncd" for _ in range(i % 13)) + "\x0b") for i in range(200)] + [(None, "a")]
    want = np.zeros((40, 8), int)
    for key, text in texts[:-1]:
        for word in (text or "").encode().split():
            want[key, int(hashlib.md5(word).hexdigest()[:8], 16) % 8] += 1
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    counts = common.place_counts(docs.repartition(3), 8)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {r.doc_id: r.counts for r in counts.collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got == {i: list(row) for i, row in enumerate(want)}
    plan = common.place_counts(docs, 8)._jdf.queryExecution().executedPlan().toString().splitlines()
    at = [i for i, line in enumerate(plan) if "Exchange" in line]
    assert len(at) == 1 and "MapInArrow" in plan[at[0] + 1]
    monkeypatch.setattr(common, "_PIECE", 5)
    some = pa.array([t for _, t in texts[:40]])
    assert (common._count_words(some, 8) == [[*np.bincount(np.array([int(hashlib.md5(w).hexdigest()[:8], 16) % 8 for w in (t or "").encode().split()], int), minlength=8)] for _, t in texts[:40]]).all()
