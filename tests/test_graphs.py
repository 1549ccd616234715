"""Exported graphs run by the installed runtime, against the operators, and requests that replace each other."""

from __future__ import annotations

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from annolith.operators import encoder, ivf, pq
from annolith.sources import graphs
from annolith.streaming import labelling

from .test_vectors import frame

ort = pytest.importorskip("onnxruntime")


def _run(model: bytes, **inputs):
    return ort.InferenceSession(model, providers=["CPUExecutionProvider"]).run(None, inputs)


@pytest.mark.parametrize("kind", ["linear", "unit", "as it is", "layers"])
def test_encoder_graph_equals_the_encoder(spark, kind):
    rng = np.random.default_rng(1)
    w, b = rng.standard_normal((20, 6)), rng.standard_normal(6)
    model = {
        "linear": encoder.LinearEncoder(w), "unit": encoder.LinearEncoder(w, unit=True), "as it is": encoder.LinearEncoder(w, normalise=False),
        "layers": encoder.MlpEncoder(((w, b), (rng.standard_normal((6, 4)), np.zeros(4)))),
    }[kind]
    graph = graphs.encoder_graph(model)
    x = rng.poisson(1.5, (50, 20)).astype(np.float32)
    x[3] = 0
    assert np.allclose(_run(graph, input=x)[0], model.encode(x.astype(float)), rtol=1e-4, atol=1e-4)
    wrapped = encoder.OnnxEncoder(graph, 20)  # in Spark's workers
    rows = spark.createDataFrame([(i, j, float(x[i, j])) for i in range(50) for j in range(20) if x[i, j]], "cell_id long, model_idx int, value double")
    got = {r.cell_id: r.embedding for r in encoder.embed(rows, wrapped).collect()}
    assert len(got) == 49 and all(np.allclose(got[i], model.encode(x[i : i + 1].astype(float))[0], rtol=1e-4, atol=1e-4) for i in got)


def test_quantizer_and_probe_graphs(spark, tmp_path):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((400, 16)).astype(np.float32)
    q = pq.train_quantizer(x.astype(float), 4, 32, 5)
    assert (_run(graphs.quantizer_graph(q), vectors=x)[0] == q.encode(x.astype(float))).all()
    codes = q.encode(x.astype(float))
    order, far = _run(graphs.distance_graph(q), query_vector=x[0], reference_codes=codes, codebooks=q.codebook.astype(np.float32))
    want = np.sqrt(q.distances(q.table(x[:1].astype(float)), codes))[0]
    assert np.allclose(far, np.sort(want), atol=1e-4) and np.allclose(want[order], far, atol=1e-4) and sorted(order) == list(range(400))
    few = pq.from_words([np.zeros((1, 4)), rng.standard_normal((5, 4)), np.ones((2, 4)), rng.standard_normal((3, 4))])
    assert (_run(graphs.quantizer_graph(few), vectors=x)[0] == few.encode(x.astype(float))).all()
    centroids = rng.standard_normal((30, 16))
    index = ivf.IvfPqIndex(centroids, q, ivf.populate(frame(spark, x), centroids, q))
    graphs.write_graphs(spark, f"file://{tmp_path}/g", index, encoder.LinearEncoder(np.eye(16)))
    want, dist = ivf.probes_of(x[:20].astype(float), centroids, 4)
    for i in range(20):
        places, far = _run((tmp_path / "g" / "ivf_coarse.onnx").read_bytes(), query_vector=x[i], partition_centroids=centroids.astype(np.float32), k=np.array(4, np.int32))
        assert places.tolist() == want[i].tolist() and places.dtype == np.int32 and np.allclose(far, dist[i], atol=1e-5)
    for name in ("pq_encode", "pq_distance", "model"):
        assert (tmp_path / "g" / f"{name}.onnx").stat().st_size > 100


def test_a_request_ends_the_one_it_replaces(spark):
    def slow():
        def wait(batches):
            time.sleep(60)
            yield from batches

        return spark.range(4, numPartitions=4).mapInArrow(wait, "id long").count()

    r = labelling.Replaceable(spark, "slow")
    first = r.submit(slow)
    time.sleep(3)
    assert not first.done()
    began = time.perf_counter()
    second = r.submit(lambda: spark.range(7).count())
    with pytest.raises(Exception, match="cancel"):
        first.result(timeout=20)
    assert second.result(timeout=20) == 7
    assert time.perf_counter() - began < 15
    assert r.run(lambda: spark.range(3).count()) == 3
    assert spark.range(9).count() == 9  # the caller's own jobs have no tag


def test_what_a_stopped_request_has_written_stays(spark, tmp_path):
    def rounds():
        for k in range(50):
            spark.range(3).write.parquet(f"{tmp_path}/part={k}")
            time.sleep(0.2)

    r = labelling.Replaceable(spark)
    running = r.submit(rounds)
    while not (tmp_path / "part=1" / "_SUCCESS").exists():
        time.sleep(0.1)
    r.cancel()
    with pytest.raises(Exception):
        running.result(timeout=20)
    assert spark.read.parquet(f"{tmp_path}/part=0").count() == 3
