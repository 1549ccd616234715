"""Queries over `embeddings`: exact and approximate search, votes, quantisation, analytics."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import norm, residual
from ..operators import analytics, clustering, ivf, knn, mapping, neighbour_map, pq, user_index, vote
from ..operators.kernels import nearest
from ..session import stored, table
from .fixed import INDEX_SQL, L2, PROBE_SQL, QUERIES, VECTORS_SQL, index_sql, rule_index, search_sql, vectors_and_queries

K, K_VOTE, N_PROBE = 10, 50, 4

QUERY: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERY[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def r6(column: str, name: str | None = None):
    return F.round(F.col(column), 6).alias(name or column)


def _labels(v: DataFrame) -> DataFrame:
    return v.select("vec_id", F.col("label").alias("label_id"))


# ---- exact search and votes


@query("exact_knn", f"WITH {VECTORS_SQL} SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, round(dist, 6) AS dist FROM exact WHERE rank <= 10")
def exact_knn(spark: SparkSession, d: str) -> DataFrame:
    v, q = vectors_and_queries(spark, d)
    return knn.exact_knn(q, v, K).select("query_id", "rank", "vec_id", r6("dist"))


@query("exact_knn_many", SQL["exact_knn"])
def exact_knn_many(spark: SparkSession, d: str) -> DataFrame:
    """The same with both sides in blocks, as for more queries than a broadcast holds."""
    v, q = vectors_and_queries(spark, d)
    return knn.exact_knn(q, v, K, broadcast_bytes=0).select("query_id", "rank", "vec_id", r6("dist"))


@query(
    "exact_knn_cosine",
    f"""WITH {VECTORS_SQL}, cs AS (
      SELECT query_id, vec_id, 1 - list_sum(list_transform(list_zip(q.e, v.e), lambda p: p[1] * p[2]))
        / (sqrt(list_sum(list_transform(q.e, lambda x: x * x))) * sqrt(list_sum(list_transform(v.e, lambda x: x * x)))) AS dist FROM q, v)
    SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, round(abs(dist), 6) AS dist FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(dist, 9), vec_id) AS rank FROM cs) WHERE rank <= 10""",
)
def exact_knn_cosine(spark: SparkSession, d: str) -> DataFrame:
    v, q = vectors_and_queries(spark, d)
    return knn.exact_knn(q, v, K, "cosine").select("query_id", "rank", "vec_id", r6("dist"))


_VOTE_SQL = """
SELECT query_id, label_id, votes, confidence FROM (
  SELECT query_id, label AS label_id, votes, round(votes / {k}.0, 6) AS confidence, row_number() OVER (PARTITION BY query_id ORDER BY votes DESC, {tie}) AS n
  FROM (SELECT query_id, label, count(*) AS votes, min(rank) AS seen FROM {rows} GROUP BY ALL)) WHERE n = 1"""


@query("exact_knn_label", f"WITH {VECTORS_SQL}" + _VOTE_SQL.format(k=50, tie="label", rows="exact WHERE rank <= 50"))
def exact_knn_label(spark: SparkSession, d: str) -> DataFrame:
    v, q = vectors_and_queries(spark, d)
    near = vote.with_labels(knn.exact_knn(q, v, K_VOTE), _labels(v))
    return vote.majority_vote(near, K_VOTE).select("query_id", "label_id", "votes", r6("confidence"))


@query("vote_first_seen", f"WITH {VECTORS_SQL}" + _VOTE_SQL.format(k=10, tie="seen", rows="exact WHERE rank <= 10"))
def vote_first_seen(spark: SparkSession, d: str) -> DataFrame:
    v, q = vectors_and_queries(spark, d)
    near = vote.with_labels(knn.exact_knn(q, v, K), _labels(v))
    return vote.majority_vote(near, K, "first_seen").select("query_id", "label_id", "votes", r6("confidence"))


@query(
    "vote_weighted",
    f"""WITH {VECTORS_SQL}, w AS (SELECT query_id, label, sum(1 / (dist + 1e-9)) AS votes FROM exact WHERE rank > 1 AND rank <= 10 GROUP BY ALL)
    SELECT query_id, label_id, round(votes, 4) AS votes, round(confidence, 6) AS confidence FROM (
      SELECT query_id, label AS label_id, votes, votes / sum(votes) OVER (PARTITION BY query_id) AS confidence,
        row_number() OVER (PARTITION BY query_id ORDER BY votes DESC, label) AS n FROM w) WHERE n = 1""",
)
def vote_weighted(spark: SparkSession, d: str) -> DataFrame:
    v, q = vectors_and_queries(spark, d)
    near = vote.with_labels(knn.exact_knn(q, v, K).where("rank > 1"), _labels(v))
    return vote.majority_vote(near, K, weight="dist").select("query_id", "label_id", F.round("votes", 4).alias("votes"), r6("confidence"))


# ---- lists and codes


@query("ivf_assign", f"WITH {INDEX_SQL} SELECT vec_id, CAST(partition_id AS INTEGER) AS partition_id, round(sqrt(d2), 6) AS dist FROM own")
def ivf_assign(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings")
    return clustering.assign(v, rule_index(v).centroids).select("vec_id", "partition_id", r6("dist"))


@query("ivf_probe", f"WITH {PROBE_SQL} SELECT query_id, CAST(rank AS INTEGER) AS rank, CAST(partition_id AS INTEGER) AS partition_id, round(sqrt(d2), 6) AS dist FROM near WHERE rank <= 4")
def ivf_probe(spark: SparkSession, d: str) -> DataFrame:
    v, q = vectors_and_queries(spark, d)
    return ivf.probe(q, rule_index(v), N_PROBE).select("query_id", "rank", "partition_id", r6("dist"))


@query("ivf_partition_stats", f"WITH {INDEX_SQL} SELECT CAST(partition_id AS INTEGER) AS partition_id, count(*) AS n FROM own GROUP BY 1")
def ivf_partition_stats(spark: SparkSession, d: str) -> DataFrame:
    return ivf.partition_stats(rule_index(table(spark, d, "embeddings")).lists)


@query("residuals", f"WITH {INDEX_SQL} SELECT vec_id, round(sqrt(list_sum(list_transform(res, lambda x: x * x))), 6) AS norm, round(list_sum(res), 6) AS total, round(res[1], 6) AS first FROM own")
def residuals(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings")
    index = rule_index(v)
    centroids = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(index.centroids)], "partition_id int, c array<double>")
    rows = v.select("vec_id", "embedding").join(clustering.assign(v, index.centroids), "vec_id").join(centroids, "partition_id")
    rows = rows.withColumn("r", residual(F.col("embedding"), F.col("c")))
    total = F.aggregate("r", F.lit(0.0), lambda a, x: a + x)
    return rows.select("vec_id", F.round(norm(F.col("r")), 6).alias("norm"), F.round(total, 6).alias("total"), F.round(F.col("r")[0], 6).alias("first"))


@query("pq_encode", f"WITH {INDEX_SQL} SELECT vec_id, CAST(partition_id AS INTEGER) AS partition_id, string_agg(lpad(CAST(code AS VARCHAR), 2, '0'), '' ORDER BY j) AS codes FROM codes GROUP BY ALL")
def pq_encode(spark: SparkSession, d: str) -> DataFrame:
    lists = rule_index(table(spark, d, "embeddings")).lists
    text = F.expr("array_join(transform(sequence(0, 7), j -> lpad(conv(hex(substring(codes, j + 1, 1)), 16, 10), 2, '0')), '')")
    return lists.select("vec_id", "partition_id", text.alias("codes"))


@query("pq_encode_graph", SQL["pq_encode"])
def pq_encode_graph(spark: SparkSession, d: str) -> DataFrame:
    """The codes by the exported graph of the quantizer, which a runtime computes in the tasks."""
    from ..operators.encoder import OnnxEncoder
    from ..operators.kernels import matrix
    from ..sources.graphs import quantizer_graph

    v = table(spark, d, "embeddings")
    index = rule_index(v)
    shared = spark.sparkContext.broadcast((OnnxEncoder(quantizer_graph(index.pq), 64), index.centroids))

    def run(batches):
        graph, centroids = shared.value
        for batch in batches:
            x = matrix(batch.column(1))
            own, _ = nearest(x, centroids)
            codes = graph.encode(x - centroids[own]).astype(int)
            text = ["".join(f"{c:02d}" for c in row) for row in codes]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own.astype(np.int32)), pa.array(text, pa.string())], ["vec_id", "partition_id", "codes"])

    return v.select("vec_id", "embedding").mapInArrow(run, "vec_id long, partition_id int, codes string")


@query(
    "pq_decode",
    f"""WITH {INDEX_SQL}, dec AS (SELECT vec_id, flatten(list(w ORDER BY j)) AS x FROM codes JOIN book USING (j, code) GROUP BY vec_id)
    SELECT vec_id, round(list_sum(x), 6) AS total, round(x[1], 6) AS first, round(x[64], 6) AS last FROM dec""",
)
def pq_decode(spark: SparkSession, d: str) -> DataFrame:
    index = rule_index(table(spark, d, "embeddings"))
    x = pq.decode_vectors(index.lists, index.pq)
    total = F.aggregate("embedding", F.lit(0.0), lambda a, b: a + b)
    return x.select("vec_id", F.round(total, 6).alias("total"), F.round(F.col("embedding")[0], 6).alias("first"), F.round(F.col("embedding")[63], 6).alias("last"))


@query("pq_reconstruction_error", f"WITH {INDEX_SQL} SELECT vec_id, round(sum(d) / 64, 8) AS mse FROM codes GROUP BY vec_id")
def pq_reconstruction_error(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings")
    index = rule_index(v)
    centroids = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(index.centroids)], "partition_id int, c array<double>")
    rows = v.select("vec_id", "embedding").join(clustering.assign(v, index.centroids), "vec_id").join(centroids, "partition_id")
    res = rows.select("vec_id", residual(F.col("embedding"), F.col("c")).alias("embedding"))
    return pq.reconstruction(res, index.pq).select("vec_id", F.round("mse", 8).alias("mse"))


@query("pq_codes_used", f"WITH {INDEX_SQL} SELECT CAST(j AS INTEGER) AS j, count(DISTINCT code) AS n_codes FROM codes GROUP BY 1")
def pq_codes_used(spark: SparkSession, d: str) -> DataFrame:
    index = rule_index(table(spark, d, "embeddings"))
    return analytics.codes_used(index.lists, index.pq.m)


# ---- approximate search


_FOUND = f"WITH {PROBE_SQL}{search_sql(4)}"


@query("ivfpq_search", _FOUND + " SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, round(dist, 6) AS dist FROM found")
def ivfpq_search(spark: SparkSession, d: str) -> DataFrame:
    v, q = vectors_and_queries(spark, d)
    return ivf.search(q, rule_index(v), N_PROBE, K).select("query_id", "rank", "vec_id", r6("dist"))


@query("ivfpq_search_many", SQL["ivfpq_search"])
def ivfpq_search_many(spark: SparkSession, d: str) -> DataFrame:
    """The same with the queries going to the lists they probe, as for more queries than a broadcast holds."""
    v, q = vectors_and_queries(spark, d)
    return ivf.search(q, rule_index(v), N_PROBE, K, broadcast_bytes=0).select("query_id", "rank", "vec_id", r6("dist"))


@query("list_order", f"WITH {PROBE_SQL}{search_sql(1, k=1000000)} SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, round(dist, 6) AS dist FROM found")
def list_order(spark: SparkSession, d: str) -> DataFrame:
    """T5: every vector of the nearest list, in order of its distance."""
    v, q = vectors_and_queries(spark, d)
    return ivf.order_lists(q, rule_index(v)).select("query_id", "rank", "vec_id", r6("dist"))


@query("adc_search_all_lists", f"WITH {PROBE_SQL}{search_sql(1000000)} SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, round(sqrt(dist), 6) AS dist FROM found")
def adc_search_all_lists(spark: SparkSession, d: str) -> DataFrame:
    v, q = vectors_and_queries(spark, d)
    index = rule_index(v)
    return ivf.search(q, index, index.n_partitions, K, "l2").select("query_id", "rank", "vec_id", r6("dist"))


@query("ivfpq_label", f"WITH {PROBE_SQL}{search_sql(4, k=50)}, lab AS (SELECT f.*, label FROM found f JOIN v USING (vec_id))" + _VOTE_SQL.format(k=50, tie="label", rows="lab"))
def ivfpq_label(spark: SparkSession, d: str) -> DataFrame:
    v, q = vectors_and_queries(spark, d)
    near = vote.with_labels(ivf.search(q, rule_index(v), N_PROBE, K_VOTE), _labels(v))
    return vote.majority_vote(near, K_VOTE).select("query_id", "label_id", "votes", r6("confidence"))


@query("ivfpq_label_many", SQL["ivfpq_label"])
def ivfpq_label_many(spark: SparkSession, d: str) -> DataFrame:
    v, q = vectors_and_queries(spark, d)
    near = vote.with_labels(ivf.search(q, rule_index(v), N_PROBE, K_VOTE, broadcast_bytes=0), _labels(v))
    return vote.majority_vote(near, K_VOTE).select("query_id", "label_id", "votes", r6("confidence"))


@query("labelled_only", SQL["ivfpq_label"].replace("lab AS (SELECT f.*, label FROM found f JOIN v USING (vec_id))", "lab AS (SELECT f.*, label FROM found f JOIN v USING (vec_id) WHERE label < 2)").replace("k=50", "k=50"))
def labelled_only(spark: SparkSession, d: str) -> DataFrame:
    """Only queries that a vote has labelled, where most vectors have no label."""
    v, q = vectors_and_queries(spark, d)
    near = vote.with_labels(ivf.search(q, rule_index(v), N_PROBE, K_VOTE), _labels(v).where("label_id < 2"))
    return vote.labelled_only(vote.all_queries(q, vote.majority_vote(near, K_VOTE))).select("query_id", "label_id", "votes", r6("confidence"))


@query("ivfpq_refined", f"""{_FOUND.replace("rank <= 10", "rank <= 40")}
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, round(dist, 6) AS dist FROM (
  SELECT query_id, vec_id, e.dist, row_number() OVER (PARTITION BY query_id ORDER BY round(e.dist, 9), vec_id) AS rank
  FROM found f JOIN exact e USING (query_id, vec_id)) WHERE rank <= 10""")  # fmt: skip
def ivfpq_refined(spark: SparkSession, d: str) -> DataFrame:
    v, q = vectors_and_queries(spark, d)
    found = ivf.search(q, rule_index(v), N_PROBE, 4 * K)
    return ivf.refine(found, q, v, K).select("query_id", "rank", "vec_id", r6("dist"))


@query("ivfpq_trained_search")
def ivfpq_trained_search(spark: SparkSession, d: str) -> DataFrame:
    """A trained index over every row; n_probe is chosen so that the refined search reaches a recall of 0.9 or more on a
    bounded sample of the queries (a test measures it on all)."""
    v, q = vectors_and_queries(spark, d)
    index = ivf.build(v, m=16, k=64, max_iter=20)
    index.lists = stored(index.lists, "lists")  # every search reads them
    from ..operators.sampling import random_subset

    n_probe, _ = analytics.n_probe_for(random_subset(q, 64), v, index, K, 0.95, refine=20)
    found = ivf.search(q, index, n_probe, 20 * K)
    return ivf.refine(found, q, v, K).select("query_id", "rank", "vec_id", r6("dist"))


# ---- k-means


@query(
    "lloyd_step",
    f"""WITH {INDEX_SQL}, dims AS (SELECT partition_id, vec_id, d2, unnest(e) AS x, generate_subscripts(e, 1) AS i FROM own JOIN v USING (vec_id)),
    m AS (SELECT partition_id, i, avg(x) AS x FROM dims GROUP BY ALL),
    s AS (SELECT partition_id, count(*) AS n, sum(d2) AS inertia FROM own GROUP BY 1)
    SELECT CAST(s.partition_id AS INTEGER) AS partition_id, n, round(inertia, 6) AS inertia, round(sum(x), 6) AS total, round(max(CASE WHEN i = 1 THEN x END), 6) AS first
    FROM s JOIN m USING (partition_id) GROUP BY s.partition_id, n, inertia""",
)
def lloyd_step(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings")
    step = clustering.lloyd_step(v, rule_index(v).centroids)
    total = F.aggregate("centroid", F.lit(0.0), lambda a, x: a + x)
    return step.select("partition_id", "n", r6("inertia"), F.round(total, 6).alias("total"), F.round(F.col("centroid")[0], 6).alias("first"))


# ---- user index


@query("user_index_build", f"WITH {INDEX_SQL} SELECT CAST(partition_id AS INTEGER) AS partition_id, count(*) AS n, string_agg(CAST(label AS VARCHAR), ',' ORDER BY vec_id) AS labels FROM own JOIN v USING (vec_id) WHERE label < 3 GROUP BY 1")
def user_index_build(spark: SparkSession, d: str) -> DataFrame:
    parts = user_index.partitions(_user_rows(spark, d)[1])
    return parts.select("partition_id", "n", F.array_join(F.transform("labels", lambda x: x.cast("string")), ",").alias("labels"))


def _user_rows(spark: SparkSession, d: str) -> tuple[ivf.IvfPqIndex, DataFrame]:
    """A user's cells: those of three kinds, labelled, with the codes the base index gives them."""
    v = table(spark, d, "embeddings")
    base = rule_index(v)
    own = v.where("label < 3")
    cells = ivf.artifacts(own, base).withColumnRenamed("query_id", "pos").join(own.select(F.col("vec_id").alias("pos"), F.col("label").alias("label_id")), "pos")
    return base, user_index.entries(cells.withColumns({"x": F.lit(0.0), "y": F.lit(0.0)}), "user-1")


@query(
    "user_index_search",
    f"""WITH {PROBE_SQL.replace("FROM q, c)", "FROM q, c WHERE partition_id IN (SELECT partition_id FROM own JOIN v USING (vec_id) WHERE label < 3))")}{search_sql(4).replace("JOIN codes USING (partition_id, j, code)", "JOIN (SELECT codes.* FROM codes JOIN v USING (vec_id) WHERE label < 3) codes USING (partition_id, j, code)")}
    SELECT query_id, CAST(rank AS INTEGER) AS rank, CAST(label AS BIGINT) AS label_id, round(dist, 6) AS dist FROM found JOIN v USING (vec_id)""",
)
def user_index_search(spark: SparkSession, d: str) -> DataFrame:
    base, rows = _user_rows(spark, d)
    q = table(spark, d, "embeddings").where(QUERIES)
    return user_index.search(q, base, rows, N_PROBE, K).select("query_id", "rank", "label_id", r6("dist"))


@query("user_index_round_trip", f"WITH {INDEX_SQL} SELECT CAST(partition_id AS INTEGER) AS partition_id, count(*) AS n, sum(vec_id) AS positions, CAST(sum(label) AS BIGINT) AS labels, CAST(sum(code) AS BIGINT) AS codes FROM (SELECT partition_id, vec_id, label, sum(code) AS code FROM codes JOIN v USING (vec_id) WHERE label < 3 GROUP BY ALL) GROUP BY 1")
def user_index_round_trip(spark: SparkSession, d: str) -> DataFrame:
    _, rows = _user_rows(spark, d)
    meta = spark.sql("SELECT 'user-1' AS id, 'mine' AS name, 'base' AS base_model_id, timestamp'2026-01-01 00:00:00' AS created, 1L AS cell_count, 'label' AS category, array('a') AS labels")
    _, back = user_index.from_json(user_index.to_json(meta, rows))
    code = F.expr("aggregate(transform(sequence(1, length(codes)), j -> cast(conv(hex(substring(codes, j, 1)), 16, 10) as bigint)), 0L, (a, x) -> a + x)")
    return back.groupBy("partition_id").agg(F.count("*").alias("n"), F.sum("pos").alias("positions"), F.sum("label_id").alias("labels"), F.sum(code).alias("codes"))


# ---- analytics


def _both(spark: SparkSession, d: str, n_probe: int = N_PROBE) -> tuple[DataFrame, DataFrame, DataFrame, ivf.IvfPqIndex]:
    v, q = vectors_and_queries(spark, d)
    index = rule_index(v)
    return knn.exact_knn(q, v, K), ivf.search(q, index, n_probe, K), v, index


_COMMON = ", both_ AS (SELECT e.query_id, e.vec_id, e.dist AS de, f.dist AS da FROM exact e JOIN found f USING (query_id, vec_id) WHERE e.rank <= 10)"


@query("recall_at_k", _FOUND + _COMMON + " SELECT query_id, round(count(b.vec_id) / 10.0, 6) AS recall FROM q LEFT JOIN both_ b USING (query_id) GROUP BY 1")
def recall_at_k(spark: SparkSession, d: str) -> DataFrame:
    exact, approx, *_ = _both(spark, d)
    return analytics.recall_per_query(exact, approx, K).select("query_id", r6("recall"))


@query("hit_recall", _FOUND + " SELECT round(avg(CASE WHEN hit THEN 1.0 ELSE 0.0 END), 6) AS recall FROM (SELECT q.query_id, bool_or(coalesce(f.vec_id = q.query_id, false)) AS hit FROM q LEFT JOIN found f USING (query_id) GROUP BY 1)")
def hit_recall(spark: SparkSession, d: str) -> DataFrame:
    _, approx, v, _ = _both(spark, d)
    return analytics.hit_recall(v.where(QUERIES), approx, K).select(r6("recall"))


@query("distortion", _FOUND + _COMMON + " SELECT query_id, round(avg(abs(de - da)), 6) AS distortion FROM q LEFT JOIN both_ b USING (query_id) GROUP BY 1")
def distortion(spark: SparkSession, d: str) -> DataFrame:
    exact, approx, *_ = _both(spark, d)
    return analytics.distortion(exact, approx).select("query_id", r6("distortion"))


@query("neighbour_distance", f"WITH {VECTORS_SQL} SELECT query_id, round(avg(dist), 6) AS mean_dist FROM exact WHERE rank <= 10 GROUP BY 1")
def neighbour_distance(spark: SparkSession, d: str) -> DataFrame:
    v, q = vectors_and_queries(spark, d)
    return analytics.mean_distance(knn.exact_knn(q, v, K)).select("query_id", r6("mean_dist"))


_MISMATCH = """, le AS (SELECT query_id, label, count(*) AS votes, min(rank) AS seen FROM exact WHERE rank <= 10 GROUP BY ALL),
la AS (SELECT query_id, label, count(*) AS votes, min(rank) AS seen FROM found JOIN v USING (vec_id) GROUP BY ALL),
re AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY votes DESC, seen) AS place FROM le),
ra AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY votes DESC, seen) AS place FROM la),
mis AS (
  SELECT query_id, re.label AS exact_label, ra.label AS approx_label, re.votes / 10.0 AS exact_confidence, ra.votes / 10.0 AS approx_confidence,
    coalesce((SELECT CAST(min(x.place) AS INTEGER) FROM re x WHERE x.query_id = re.query_id AND x.label = ra.label), -1) AS approx_place
  FROM re JOIN ra USING (query_id) WHERE re.place = 1 AND ra.place = 1 AND re.label <> ra.label
)"""


def _mismatch(spark: SparkSession, d: str, n_probe: int = N_PROBE) -> DataFrame:
    exact, approx, v, _ = _both(spark, d, n_probe)
    return analytics.mismatches(vote.with_labels(exact, _labels(v)), vote.with_labels(approx, _labels(v)), K)


@query(
    "mismatch_table",
    _FOUND + _MISMATCH + """ SELECT query_id, exact_label, approx_label, round(exact_confidence, 6) AS exact_confidence, round(approx_confidence, 6) AS approx_confidence, approx_place,
    (SELECT string_agg(CAST(label AS VARCHAR), ',' ORDER BY place) FROM re WHERE re.query_id = mis.query_id AND place <= 3) AS exact_top3,
    (SELECT string_agg(CAST(label AS VARCHAR), ',' ORDER BY place) FROM ra WHERE ra.query_id = mis.query_id AND place <= 3) AS approx_top3 FROM mis""",
)
def mismatch_table(spark: SparkSession, d: str) -> DataFrame:
    t = _mismatch(spark, d)
    text = {c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",") for c in ("exact_top3", "approx_top3")}
    return t.withColumns(text).select("query_id", "exact_label", "approx_label", r6("exact_confidence"), r6("approx_confidence"), F.coalesce("approx_place", F.lit(-1)).alias("approx_place"), "exact_top3", "approx_top3")


@query(
    "confusion_pairs",
    _FOUND + _MISMATCH + """, p AS (SELECT least(exact_label, approx_label) AS label_a, greatest(exact_label, approx_label) AS label_b, exact_confidence - approx_confidence AS diff, query_id FROM mis)
    SELECT label_a, label_b, count(*) AS frequency, round(avg(diff), 6) AS mean_confidence_diff, array_to_string(list_slice(list(query_id ORDER BY query_id), 1, 3), ',') AS examples FROM p GROUP BY 1, 2""",
)
def confusion_pairs(spark: SparkSession, d: str) -> DataFrame:
    pairs = analytics.confusion_pairs(_mismatch(spark, d))
    text = F.array_join(F.transform("examples", lambda x: x.cast("string")), ",")
    return pairs.select("label_a", "label_b", "frequency", r6("mean_confidence_diff"), text.alias("examples"))


_EXTREMES = f"""WITH {PROBE_SQL}{search_sql(1, "one")}{search_sql(1000000, "every")},
le AS (SELECT query_id, label, count(*) AS votes, min(rank) AS seen FROM exact WHERE rank <= 10 GROUP BY ALL),
be AS (SELECT query_id, label FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY votes DESC, seen) AS n FROM le) WHERE n = 1),
l1 AS (SELECT query_id, label, count(*) AS votes, min(rank) AS seen FROM one JOIN v USING (vec_id) GROUP BY ALL),
b1 AS (SELECT query_id, label FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY votes DESC, seen) AS n FROM l1) WHERE n = 1),
l2 AS (SELECT query_id, label, count(*) AS votes, min(rank) AS seen FROM every JOIN v USING (vec_id) GROUP BY ALL),
b2 AS (SELECT query_id, label FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY votes DESC, seen) AS n FROM l2) WHERE n = 1),
m1 AS (SELECT query_id FROM be JOIN b1 USING (query_id) WHERE be.label <> b1.label),
m2 AS (SELECT query_id FROM be JOIN b2 USING (query_id) WHERE be.label <> b2.label)
SELECT kind, count(*) AS n FROM (
  SELECT 'fixed' AS kind, query_id FROM m1 WHERE query_id NOT IN (SELECT query_id FROM m2)
  UNION ALL SELECT 'new', query_id FROM m2 WHERE query_id NOT IN (SELECT query_id FROM m1)
  UNION ALL SELECT 'persistent', query_id FROM m1 WHERE query_id IN (SELECT query_id FROM m2)) GROUP BY 1"""


@query("setting_extremes", _EXTREMES)
def setting_extremes(spark: SparkSession, d: str) -> DataFrame:
    return analytics.compare_settings(_mismatch(spark, d, 1), _mismatch(spark, d, 1_000_000))


@query("probe_bandwidth", f"WITH {PROBE_SQL}, s AS (SELECT partition_id, count(*) * 12 + 8 AS bytes FROM own GROUP BY 1) SELECT count(*) AS lists, CAST(sum(bytes) AS BIGINT) AS bytes FROM (SELECT DISTINCT partition_id FROM near WHERE rank <= 4) JOIN s USING (partition_id)")
def probe_bandwidth(spark: SparkSession, d: str) -> DataFrame:
    v, q = vectors_and_queries(spark, d)
    index = rule_index(v)
    return analytics.bandwidth(ivf.probe(q, index, N_PROBE), index.lists, index.pq.m)


_GRID = (1, 2, 4, 8)
_SWEEP_PARTS = " UNION ALL ".join(f"SELECT {p} AS n_probe, query_id, (SELECT count(*) FROM f{p} f JOIN exact e USING (query_id, vec_id) WHERE f.query_id = q.query_id AND e.rank <= 10) / 10.0 AS recall FROM q" for p in _GRID)
_SWEEP_SQL = f"WITH {PROBE_SQL}" + "".join(search_sql(p, f"f{p}") for p in _GRID) + f", rec AS ({_SWEEP_PARTS})"


def _sweep(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, ivf.IvfPqIndex]:
    v, q = vectors_and_queries(spark, d)
    index = rule_index(v)
    exact = knn.exact_knn(q, v, K)
    parts = [analytics.recall_per_query(exact, ivf.search(q, index, p, K), K).select(F.lit(p).alias("n_probe"), "query_id", "recall") for p in _GRID]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out, q, index


@query("recall_distribution", _SWEEP_SQL + " SELECT n_probe, round(min(recall), 6) AS low, round(quantile_cont(recall, 0.25), 6) AS q1, round(quantile_cont(recall, 0.5), 6) AS median, round(quantile_cont(recall, 0.75), 6) AS q3, round(max(recall), 6) AS high FROM rec GROUP BY 1")
def recall_distribution(spark: SparkSession, d: str) -> DataFrame:
    q = analytics.recall_quartiles(_sweep(spark, d)[0], ["n_probe"])
    return q.select("n_probe", *[r6(c) for c in ("low", "q1", "median", "q3", "high")])


@query(
    "sweep_summary",
    _SWEEP_SQL + ", s AS (SELECT partition_id, count(*) * 12 + 8 AS bytes FROM own GROUP BY 1), bw AS ("
    + " UNION ALL ".join(f"SELECT {p} AS n_probe, count(*) AS lists, sum(bytes) AS bytes FROM (SELECT DISTINCT partition_id FROM near WHERE rank <= {p}) JOIN s USING (partition_id)" for p in _GRID)
    + ") SELECT n_probe, round(avg(recall), 6) AS recall, lists, CAST(bytes AS BIGINT) AS bytes, (SELECT CAST(sum(bytes) AS BIGINT) FROM s) AS storage FROM rec JOIN bw USING (n_probe) GROUP BY n_probe, lists, bytes",
)
def sweep_summary(spark: SparkSession, d: str) -> DataFrame:
    """A21 without the times, which are not the same twice."""
    recalls, q, index = _sweep(spark, d)
    probes = ivf.probe(q, index, max(_GRID))
    sizes = ivf.partition_stats(index.lists).select("partition_id", (F.col("n") * 12 + 8).alias("bytes"))
    touched = probes.join(F.broadcast(spark.createDataFrame([(p,) for p in _GRID], "n_probe int")), F.col("rank") <= F.col("n_probe")).select("n_probe", "partition_id").distinct()
    bw = touched.join(sizes, "partition_id").groupBy("n_probe").agg(F.count("*").alias("lists"), F.sum("bytes").alias("bytes"))
    storage = sizes.agg(F.sum("bytes").alias("storage"))
    mean = recalls.groupBy("n_probe").agg(F.round(F.avg("recall"), 6).alias("recall"))
    return mean.join(bw, "n_probe").join(F.broadcast(storage)).select("n_probe", "recall", "lists", "bytes", "storage")


_SUBSPACES = (4, 8, 16)


def _subspace_sql(m: int) -> str:
    found = search_sql(4).replace("j * 8 + 1, j * 8 + 8", f"j * {64 // m} + 1, j * {64 // m} + {64 // m}")
    near = PROBE_SQL[len(INDEX_SQL) :]
    return f"""SELECT {m} AS n_sub, round(avg(recall), 6) AS recall, (SELECT CAST(sum(n * (4 + {m}) + 8) AS BIGINT) FROM (SELECT count(*) AS n FROM own GROUP BY partition_id)) AS storage
    FROM (SELECT q.query_id, count(f.vec_id) / 10.0 AS recall FROM q LEFT JOIN (SELECT f.* FROM found f JOIN exact e USING (query_id, vec_id) WHERE e.rank <= 10) f USING (query_id) GROUP BY 1)""", f"WITH {index_sql(m)}{near}{found}"


@query("sweep_subvectors", " UNION ALL ".join(f"SELECT * FROM ({ctes} {body})" for body, ctes in map(_subspace_sql, _SUBSPACES)))
def sweep_subvectors(spark: SparkSession, d: str) -> DataFrame:
    """A21 along the number of subspaces: recall and bytes of the lists."""
    v, q = vectors_and_queries(spark, d)
    exact, out = knn.exact_knn(q, v, K), None
    for m in _SUBSPACES:
        index = rule_index(v, m)
        recall = analytics.recall_per_query(exact, ivf.search(q, index, N_PROBE, K), K).agg(F.round(F.avg("recall"), 6).alias("recall"))
        storage = ivf.partition_stats(index.lists).agg(F.sum(F.col("n") * (4 + m) + 8).alias("storage"))
        row = recall.join(F.broadcast(storage)).select(F.lit(m).alias("n_sub"), "recall", "storage")
        out = row if out is None else out.unionByName(row)
    return out


@query("self_accuracy_perturbed")
def self_accuracy_perturbed(spark: SparkSession, d: str) -> DataFrame:
    """A17 on exact and on perturbed queries."""
    v, q = vectors_and_queries(spark, d)
    index = rule_index(v)
    parts = [analytics.self_accuracy(rows, index).select(F.lit(name).alias("queries"), "recall") for name, rows in (("exact", q), ("perturbed", analytics.perturbed(q)))]
    return parts[0].unionByName(parts[1])


_MOVED = PROBE_SQL.replace(
    "q AS (SELECT vec_id AS query_id, e FROM v WHERE mod(vec_id, 20) = 0)",
    "q AS (SELECT vec_id AS query_id, list_transform(e, lambda x, i: x + ((vec_id * 7 + (i - 1) * 13) % 11 - 5) / 200.0) AS e FROM v WHERE mod(vec_id, 20) = 0)",
)


@query(
    "self_accuracy",
    f"""SELECT 'exact' AS queries, (WITH {PROBE_SQL}{search_sql(8, k=1)} SELECT round(count(*) FILTER (WHERE query_id = vec_id) / (SELECT count(*) FROM q), 6) FROM found) AS recall
    UNION ALL SELECT 'moved', (WITH {_MOVED}{search_sql(8, k=1)} SELECT round(count(*) FILTER (WHERE query_id = vec_id) / (SELECT count(*) FROM q), 6) FROM found)""",
)
def self_accuracy(spark: SparkSession, d: str) -> DataFrame:
    """How many queries find themselves first, as they are and moved by a rule."""
    v, q = vectors_and_queries(spark, d)
    index = rule_index(v)
    step = (F.pmod(F.col("vec_id") * 7 + F.col("i") * 13, F.lit(11)) - 5) / 200.0
    moved = q.select("vec_id", F.posexplode("embedding").alias("i", "x")).select("vec_id", "i", (F.col("x").cast("double") + step).alias("x"))
    moved = moved.groupBy("vec_id").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("e")).select("vec_id", F.col("e.x").alias("embedding"))
    parts = [analytics.self_accuracy(rows, index).select(F.lit(name).alias("queries"), F.round("recall", 6).alias("recall")) for name, rows in (("exact", q), ("moved", moved))]
    return parts[0].unionByName(parts[1])


@query("lut_distances", f"WITH {PROBE_SQL}{search_sql(4)} SELECT query_id, CAST(partition_id AS INTEGER) AS partition_id, CAST(j AS INTEGER) AS j, code, round(d, 6) AS d FROM lut_found")
def lut_distances(spark: SparkSession, d: str) -> DataFrame:
    """F5 as rows; a search builds the same tables inside its kernel."""
    v, q = vectors_and_queries(spark, d)
    index = rule_index(v)
    centroids = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(index.centroids)], "partition_id int, c array<double>")
    rows = ivf.probe(q, index, N_PROBE).join(q.select(F.col("vec_id").alias("query_id"), "embedding"), "query_id").join(centroids, "partition_id")
    rows = rows.select("query_id", "partition_id", residual(F.col("embedding"), F.col("c")).alias("r"))
    shared = spark.sparkContext.broadcast(index.pq)

    @F.pandas_udf("array<double>")
    def table_of(r):
        import numpy as np
        import pandas as pd

        return pd.Series(list(shared.value.table(np.stack(r.to_numpy())).reshape(len(r), -1))) if len(r) else pd.Series([], dtype=object)

    k = index.pq.k
    out = rows.select("query_id", "partition_id", F.posexplode(table_of("r")).alias("p", "d"))
    return out.select("query_id", "partition_id", F.floor(F.col("p") / k).cast("int").alias("j"), (F.col("p") % k).cast("int").alias("code"), r6("d"))


# ---- the neighbour map


_NEAR_ALL = f"""v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
near AS (SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY round(dist, 9), b) AS rank FROM (
  SELECT x.vec_id AS a, y.vec_id AS b, {L2.format(a="x.e", b="y.e")} AS dist FROM v x, v y WHERE x.vec_id <> y.vec_id))"""


@query("neighbour_graph", f"WITH {_NEAR_ALL} SELECT least(a, b) AS a, greatest(a, b) AS b, bool_or(rank = 1) AS certain FROM near WHERE rank <= 10 GROUP BY 1, 2")
def neighbour_graph(spark: SparkSession, d: str) -> DataFrame:
    """Q13: the edges of the fuzzy graph; those to a nearest neighbour have weight 1."""
    g = neighbour_map.neighbour_graph(table(spark, d, "embeddings"))
    return g.select("a", "b", (F.col("weight") > 1 - 1e-9).alias("certain"))


@query(
    "map_trustworthiness",
    f"""WITH {_NEAR_ALL},
    plane AS (SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY dist, b) AS place FROM (
      SELECT x.vec_id AS a, y.vec_id AS b, (x.e[1] - y.e[1]) * (x.e[1] - y.e[1]) + (x.e[2] - y.e[2]) * (x.e[2] - y.e[2]) AS dist FROM v x, v y WHERE x.vec_id <> y.vec_id AND x.vec_id % 20 = 0)),
    n AS (SELECT count(*) AS n, count(*) FILTER (WHERE vec_id % 20 = 0) AS q FROM v)
    SELECT round(1 - 2.0 / ((SELECT q FROM n) * 10 * (2 * (SELECT n FROM n) - 31)) * sum(greatest(rank - 10, 0)), 9) AS trustworthiness FROM plane JOIN near USING (a, b) WHERE place <= 10""",
)
def map_trustworthiness(spark: SparkSession, d: str) -> DataFrame:
    """Q13: of the plane of the first two components."""
    v, q = vectors_and_queries(spark, d)
    plane = v.select("vec_id", F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))
    return neighbour_map.trustworthiness(v, plane, 10, q).select(F.round("trustworthiness", 9).alias("trustworthiness"))


@query("neighbour_map")
def placed_by_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """Q13: a neighbour map trained on the vectors, and all of them placed by its projector."""
    v = table(spark, d, "embeddings")
    projector, _ = neighbour_map.train(v, rounds=2, epochs=10)
    return mapping.normalise(mapping.project(v, projector)).select("vec_id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))
