"""Queries over documents, labels, embeddings and events: samples, categories, map coordinates, cell state, results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.labels import label_color
from ..operators import analytics, mapping, sampling, vote
from ..session import scratch, table
from ..sources.discovery import decode_categorical
from ..sources.writers import result_rows
from ..streaming.labelling import cell_stream, count_stream, upsert_stream

QUERY: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERY[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


@query("category_encode", "SELECT doc_id, CAST(CASE WHEN lang IS NULL THEN -1 ELSE code END AS INTEGER) AS lang_code FROM documents LEFT JOIN (SELECT lang AS l, row_number() OVER (ORDER BY lang) - 1 AS code FROM (SELECT DISTINCT lang FROM documents WHERE lang IS NOT NULL)) ON lang = l")
def category_encode(spark: SparkSession, d: str) -> DataFrame:
    return mapping.encode_category(table(spark, d, "documents").select("doc_id", "lang"), "lang").select("doc_id", F.col("lang_code").cast("int").alias("lang_code"))


@query("categorical_decode", "SELECT quality, coalesce(CASE quality WHEN 0 THEN 'low' WHEN 1 THEN 'high' END, '') AS value, count(*) AS n FROM (SELECT CASE WHEN toxic = 1 THEN -1 ELSE quality END AS quality FROM labels) GROUP BY ALL")
def categorical_decode(spark: SparkSession, d: str) -> DataFrame:
    codes = table(spark, d, "labels").select(F.when(F.col("toxic") == 1, -1).otherwise(F.col("quality")).alias("quality"))
    names = spark.createDataFrame([(0, "low"), (1, "high")], "code int, category string")
    return decode_categorical(codes, names, "quality").groupBy("quality", "value").agg(F.count("*").alias("n"))


@query("label_cardinality_filter", "SELECT column_, n_distinct, n_distinct <= 1000 AS kept FROM (SELECT 'lang' AS column_, count(DISTINCT lang) AS n_distinct FROM documents UNION ALL SELECT 'source', count(DISTINCT source) FROM documents UNION ALL SELECT 'n_chars', count(DISTINCT n_chars) FROM documents)")
def label_cardinality_filter(spark: SparkSession, d: str) -> DataFrame:
    return mapping.label_cardinality(table(spark, d, "documents"), ["lang", "source", "n_chars", "missing"]).withColumnRenamed("column", "column_")


@query("distinct_per_label", "SELECT quality, count(DISTINCT toxic) AS n_toxic, count(*) AS n FROM labels GROUP BY 1")
def distinct_per_label(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "labels").groupBy("quality").agg(F.count_distinct("toxic").alias("n_toxic"), F.count("*").alias("n"))


@query("label_counts", "SELECT lang AS label, count(*) AS n FROM documents GROUP BY 1")
def label_counts(spark: SparkSession, d: str) -> DataFrame:
    return vote.label_counts(table(spark, d, "documents").select(F.col("lang").alias("label")))


@query(
    "top_counts",
    """WITH c AS (SELECT source AS label, count(*) AS n FROM documents GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, label) AS place FROM c)
    SELECT label, n, CAST(place AS INTEGER) AS place FROM r WHERE place <= 10 UNION ALL SELECT '(' || count(*) || ' more)', CAST(sum(n) AS BIGINT), 11 FROM r WHERE place > 10 HAVING count(*) > 0""",
)
def top_counts(spark: SparkSession, d: str) -> DataFrame:
    return vote.top_counts(table(spark, d, "documents").select(F.col("source").alias("label")))


@query(
    "stratified_sample",
    """WITH c AS (SELECT lang, count(*) AS c FROM documents GROUP BY 1), s AS (SELECT lang, floor(c * 100 / t) AS base, c * 100.0 / t - floor(c * 100 / t) AS rest, t FROM (SELECT *, (SELECT count(*) FROM documents) AS t FROM c)),
    q AS (SELECT lang, base + CASE WHEN row_number() OVER (ORDER BY round(rest, 9) DESC, lang) <= 100 - (SELECT sum(base) FROM s) THEN 1 ELSE 0 END AS quota FROM s)
    SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS r FROM documents) JOIN q USING (lang) WHERE r <= quota""",
)
def stratified_sample(spark: SparkSession, d: str) -> DataFrame:
    docs = sampling.labelled_strata(table(spark, d, "documents").select("doc_id", "lang"), "lang")
    return sampling.stratified_sample(docs, "lang", 100, "doc_id", order=F.col("doc_id")).select("doc_id", "lang")


@query("first_n_subset", "SELECT vec_id, label FROM embeddings WHERE vec_id < 300")
def first_n_subset(spark: SparkSession, d: str) -> DataFrame:
    return sampling.first_n(table(spark, d, "embeddings"), 300).select("vec_id", "label")


def points(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"), F.col("label").alias("label_id"))


_POINTS = "p AS (SELECT vec_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, label FROM embeddings), b AS (SELECT (min(x) + max(x)) / 2 AS cx, (min(y) + max(y)) / 2 AS cy, greatest(max(x) - min(x), max(y) - min(y)) AS r, count(*) AS n FROM p)"


@query("coord_bounds", f"WITH {_POINTS} SELECT round(cx, 6) AS x_center, round(cy, 6) AS y_center, round(r, 6) AS max_range, n AS num_points FROM b")
def coord_bounds(spark: SparkSession, d: str) -> DataFrame:
    b = mapping.bounds(points(spark, d))
    return b.select(*[F.round(c, 6).alias(c) for c in ("x_center", "y_center", "max_range")], "num_points")


@query("coord_normalize", f"WITH {_POINTS} SELECT vec_id, round((x - cx) / (r / 2), 6) AS x, round((y - cy) / (r / 2), 6) AS y FROM p, b")
def coord_normalize(spark: SparkSession, d: str) -> DataFrame:
    return mapping.normalise(points(spark, d)).select("vec_id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query("layer_union", "SELECT layer, size, count(*) AS n, CAST(sum(local_idx) AS BIGINT) AS idx FROM (SELECT 0 AS layer, 1 AS size, vec_id AS local_idx FROM embeddings WHERE vec_id % 3 = 0 UNION ALL SELECT 1, 3, vec_id FROM embeddings WHERE vec_id % 3 = 1 UNION ALL SELECT 2, 6, vec_id FROM embeddings WHERE vec_id % 3 = 2) GROUP BY ALL")
def layer_union(spark: SparkSession, d: str) -> DataFrame:
    parts = [points(spark, d).where(f"vec_id % 3 = {k}").withColumn("local_idx", F.col("vec_id")) for k in range(3)]
    return mapping.union_layers(*parts).groupBy("layer", "size").agg(F.count("*").alias("n"), F.sum("local_idx").alias("idx"))


@query("layer_lookup", "SELECT vec_id % 3 AS layer, vec_id AS local_idx, CASE WHEN label < 5 THEN 'label ' || label ELSE 'Unknown' END AS label FROM embeddings")
def layer_lookup(spark: SparkSession, d: str) -> DataFrame:
    """The layer, place and label name of every point; codes that the dictionary lacks are Unknown."""
    parts = [points(spark, d).where(f"vec_id % 3 = {k}").withColumn("local_idx", F.col("vec_id")) for k in range(3)]
    names = spark.createDataFrame([(i, f"label {i}") for i in range(5)], "label_id int, label string")
    return vote.decode_labels(mapping.union_layers(*parts), names).select(F.col("layer").cast("long").alias("layer"), "local_idx", "label")


@query("projection_pca")
def projection_pca(spark: SparkSession, d: str) -> DataFrame:
    """Q13: fitted on a bounded sample, applied to every vector, normalised."""
    from ..operators.clustering import bounded_sample

    v = table(spark, d, "embeddings")
    p = mapping.project(v, mapping.Projector.fit(bounded_sample(v, 10_000)))
    return mapping.normalise(p).select("vec_id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query("palette", """
WITH l AS (SELECT label, row_number() OVER (ORDER BY label) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT label FROM embeddings) UNION ALL SELECT -1, count(DISTINCT label), count(DISTINCT label) FROM embeddings),
h AS (SELECT label, i, n, 30 + i * 330.0 / n AS hue FROM l),
x AS (SELECT *, 0.7 * (1 - abs((hue / 60) - 2 * floor(hue / 120) - 1)) AS x, least(CAST(floor(hue / 60) AS INTEGER), 5) AS s FROM h),
rgb AS (SELECT label, i, n, list_value(0.7, x, 0, 0, x, 0.7)[s + 1] AS r, list_value(x, 0.7, 0.7, x, 0, 0)[s + 1] AS g, list_value(0, 0, x, 0.7, 0.7, x)[s + 1] AS b FROM x)
SELECT label, CASE WHEN i >= n THEN '#999999' ELSE '#' || lower(lpad(printf('%x', CAST(floor((r + 0.15) * 255 + 0.5) AS INTEGER)), 2, '0') || lpad(printf('%x', CAST(floor((g + 0.15) * 255 + 0.5) AS INTEGER)), 2, '0') || lpad(printf('%x', CAST(floor((b + 0.15) * 255 + 0.5) AS INTEGER)), 2, '0')) END AS color FROM rgb""")  # fmt: skip
def palette(spark: SparkSession, d: str) -> DataFrame:
    labels = table(spark, d, "embeddings").select("label").distinct()
    ranked = labels.select("label", (F.row_number().over(Window.orderBy("label")) - 1).alias("i"))
    n = labels.agg(F.count("*").alias("n"))
    rows = ranked.join(F.broadcast(n)).unionByName(n.select(F.lit(-1).alias("label"), F.col("n").cast("int").alias("i"), "n"))
    return rows.select("label", label_color(F.col("i"), F.col("n")).alias("color"))


@query("cell_upsert_last_wins", "SELECT user_id AS cell_id, max_by(event_type, (ts, event_id)) AS label, max_by(value, (ts, event_id)) AS x FROM events GROUP BY 1")
def cell_upsert_last_wins(spark: SparkSession, d: str) -> DataFrame:
    u = table(spark, d, "events").select(F.col("user_id").alias("cell_id"), F.col("event_type").alias("label"), F.col("value").alias("x"), "ts", "event_id")
    return mapping.latest_state(u, order=("ts", "event_id")).select("cell_id", "label", "x")


@query("label_lookup", "SELECT doc_id, CASE WHEN quality = 1 THEN 'good' ELSE 'Unknown' END AS label FROM labels")
def label_lookup(spark: SparkSession, d: str) -> DataFrame:
    names = spark.createDataFrame([(1, "good")], "label_id int, label string")
    return vote.decode_labels(table(spark, d, "labels").withColumnRenamed("quality", "label_id"), names).select("doc_id", "label")


def _results(spark: SparkSession, d: str) -> DataFrame:
    """Labels as predicted (by a rule), with a confidence that some rows lack."""
    e = table(spark, d, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, F.lit(None)).otherwise(F.concat(F.lit("label "), (F.col("label") - F.when(F.col("vec_id") % 5 == 0, 1).otherwise(0)).cast("string")))
    conf = F.when(F.col("vec_id") % 11 == 0, F.lit(None)).otherwise((F.col("vec_id") % 9 + 2) / 10)
    return e.select(F.col("vec_id").alias("cell_id"), label.alias("label"), conf.alias("confidence"))


_RESULTS = "res AS (SELECT vec_id AS cell_id, CASE WHEN vec_id % 7 = 0 THEN NULL ELSE 'label ' || (label - CASE WHEN vec_id % 5 = 0 THEN 1 ELSE 0 END) END AS label, CASE WHEN vec_id % 11 = 0 THEN NULL ELSE (vec_id % 9 + 2) / 10.0 END AS confidence FROM embeddings)"


@query("labels_csv", f"""WITH {_RESULTS} SELECT cell_id, '"' || cell_id || '","' || coalesce(label, 'Unknown') || '",' || printf('%.3f', coalesce(confidence, 1.0)::DOUBLE) AS line FROM res""")
def labels_csv(spark: SparkSession, d: str) -> DataFrame:
    return result_rows(_results(spark, d))


@query("accuracy_at_confidence", f"""WITH {_RESULTS}, t AS (SELECT vec_id AS cell_id, 'label ' || label AS truth FROM embeddings WHERE vec_id % 13 <> 0), j AS (SELECT * FROM res FULL JOIN t USING (cell_id))
SELECT round(coalesce(avg(CASE WHEN confidence >= 0 AND truth IS NOT NULL AND label IS NOT NULL THEN (label = truth)::INT END), 0), 6) AS accuracy_0,
  round(coalesce(avg(CASE WHEN confidence >= 0.9 AND truth IS NOT NULL AND label IS NOT NULL THEN (label = truth)::INT END), 0), 6) AS accuracy_1,
  round(coalesce(avg(CASE WHEN confidence >= 1 AND truth IS NOT NULL AND label IS NOT NULL THEN (label = truth)::INT END), 0), 6) AS accuracy_2,
  count(CASE WHEN label IS NULL OR truth IS NULL THEN 1 END) AS n_unmatched FROM j""")  # fmt: skip
def accuracy_at_confidence(spark: SparkSession, d: str) -> DataFrame:
    truth = table(spark, d, "embeddings").where("vec_id % 13 <> 0").select(F.col("vec_id").alias("cell_id"), F.concat(F.lit("label "), F.col("label").cast("string")).alias("label"))
    a = analytics.accuracy_at(_results(spark, d), truth)
    return a.select(*[F.round(c, 6).alias(c) for c in ("accuracy_0", "accuracy_1", "accuracy_2")], "n_unmatched")


@query("result_vs_truth", f"WITH {_RESULTS}, t AS (SELECT vec_id AS cell_id FROM embeddings WHERE vec_id % 13 <> 0) SELECT count(*) AS n, count(*) FILTER (WHERE r.cell_id IS NULL) AS only_truth, count(*) FILTER (WHERE t.cell_id IS NULL) AS only_results FROM res r FULL JOIN t ON r.cell_id = t.cell_id")
def result_vs_truth(spark: SparkSession, d: str) -> DataFrame:
    r = _results(spark, d).select(F.col("cell_id").alias("r"))
    t = table(spark, d, "embeddings").where("vec_id % 13 <> 0").select(F.col("vec_id").alias("t"))
    return r.join(t, F.col("r") == F.col("t"), "full").agg(
        F.count("*").alias("n"), F.count(F.when(F.col("r").isNull(), 1)).alias("only_truth"), F.count(F.when(F.col("t").isNull(), 1)).alias("only_results")
    )


@query("embedding_validation", "SELECT count(*) FILTER (WHERE vec_id % 10 <> 0) AS n_both, count(*) FILTER (WHERE vec_id % 10 = 0) AS n_missing, count(*) FILTER (WHERE vec_id % 10 <> 0 AND vec_id % 17 = 0) AS n_different FROM embeddings")
def embedding_validation(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings")
    moved = F.transform(F.col("embedding").cast("array<double>"), lambda x: x + F.when(F.col("vec_id") % 17 == 0, 1e-3).otherwise(1e-9))
    return analytics.compare_embeddings(v, v.where("vec_id % 10 <> 0").select("vec_id", moved.alias("embedding")))


@query("id_set_operations", "SELECT count(*) FILTER (WHERE quality = 1 AND toxic = 1) AS both_, count(*) FILTER (WHERE quality = 1 AND toxic = 0) AS only_good, count(*) FILTER (WHERE quality = 0 AND toxic = 1) AS only_toxic FROM labels")
def id_set_operations(spark: SparkSession, d: str) -> DataFrame:
    """U2."""
    x = table(spark, d, "labels")
    a, b = x.where("quality = 1").select("doc_id"), x.where("toxic = 1").select("doc_id")
    one = a.intersect(b).agg(F.count("*").alias("both_"))
    two = a.exceptAll(b).agg(F.count("*").alias("only_good"))
    three = b.exceptAll(a).agg(F.count("*").alias("only_toxic"))
    return one.join(F.broadcast(two)).join(F.broadcast(three))


def _checkpoint(spark: SparkSession) -> str:
    """A place for a stream's progress in the shared folder."""
    import uuid

    return f"{scratch(spark)}/stream-{uuid.uuid4().hex}"


def _event_stream(spark: SparkSession, d: str) -> DataFrame:
    """The event table as a stream of its files; a pattern matches a file as well as a folder of files."""
    return cell_stream(spark, f"{d}/[e]vents.parquet", table(spark, d, "events").schema)


@query("streaming_label_counts", "SELECT event_type AS label, count(*) AS n FROM events GROUP BY 1")
def streaming_label_counts(spark: SparkSession, d: str) -> DataFrame:
    """The running counts after the last micro-batch of the event stream."""
    import uuid

    cells = _event_stream(spark, d).withColumnRenamed("event_type", "label")
    name = f"label_counts_{uuid.uuid4().hex}"
    count_stream(cells, name, _checkpoint(spark)).awaitTermination()
    return spark.table(name)


@query("streaming_cell_state", "SELECT user_id AS cell_id, max_by(event_type, (ts, event_id)) AS label FROM events GROUP BY 1")
def streaming_cell_state(spark: SparkSession, d: str) -> DataFrame:
    """Cells labelled batch by batch, and the last state of each, kept by key."""
    cells = _event_stream(spark, d)
    out = _checkpoint(spark)
    rows = lambda b: b.select(F.col("user_id").alias("cell_id"), F.col("event_type").alias("label"), "ts", "event_id")
    upsert_stream(cells, rows, f"{out}/state", f"{out}/progress", order=("ts", "event_id")).awaitTermination()
    return spark.read.parquet(f"{out}/state").select("cell_id", "label")
