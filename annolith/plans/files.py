"""Queries that write an artefact to the shared folder and read it back, and those of scalar functions and samples."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import api, ingest
from ..functions import labels as scalar
from ..functions.vectors import compression_ratio, ratio
from ..operators import analytics, encoder, ivf, mapping, pq, sampling, user_index, vote
from ..session import scratch, table
from ..sources import discovery, readers, writers
from ..streaming.labelling import current_cells, label_stream
from .fixed import INDEX_SQL, L2, rule_index
from .matrix import _BASE, _EMB, _EVENTS, _events, aligned, expression, genes, linear, vocabulary
from .search import SQL as SEARCH_SQL
from .search import _user_rows
from .tables import _POINTS, _RESULTS, _event_stream, _results, points

QUERY: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERY[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def folder(spark: SparkSession) -> str:
    return f"{scratch(spark)}/files-{uuid.uuid4().hex}"


def _digits(c: str):
    """Codes as two digits each."""
    return F.expr(f"array_join(transform(sequence(0, length({c}) - 1), j -> lpad(conv(hex(substring({c}, j + 1, 1)), 16, 10), 2, '0')), '')")


# ---- vectors, labels, indexes, maps


@query("npy_round_trip", "SELECT vec_id, len(embedding) AS d, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 6) AS total, round(embedding[1]::DOUBLE, 6) AS first FROM embeddings")
def npy_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """S10, K1, K3."""
    out = f"{folder(spark)}/embeddings.npy"
    writers.write_npy(table(spark, d, "embeddings"), out)
    x = readers.npy_vectors(spark, out, rows_per_task=300)
    total = F.aggregate("embedding", F.lit(0.0), lambda a, v: a + v)
    return x.select("vec_id", F.size("embedding").cast("long").alias("d"), F.round(total, 6).alias("total"), F.round(F.col("embedding")[0].cast("double"), 6).alias("first"))


@query("npy_first_rows", "SELECT count(*) AS n, max(vec_id) AS high FROM embeddings WHERE vec_id < 100")
def npy_first_rows(spark: SparkSession, d: str) -> DataFrame:
    """With a limit."""
    out = f"{folder(spark)}/embeddings.npy"
    writers.write_npy(table(spark, d, "embeddings"), out)
    return readers.npy_vectors(spark, out, 100).agg(F.count("*").alias("n"), F.max("vec_id").alias("high"))


@query("range_scan", "SELECT vec_id, label FROM embeddings WHERE vec_id >= 100 AND vec_id < 250")
def range_scan(spark: SparkSession, d: str) -> DataFrame:
    """Both ends reach the scan."""
    return readers.embeddings(spark, f"{d}/embeddings.parquet", 100, 250, ("vec_id", "label"))


@query("vectors_round_trip", "SELECT vec_id, label, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 6) AS total FROM embeddings")
def vectors_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Vectors and labels as tables."""
    at = folder(spark)
    v = table(spark, d, "embeddings")
    writers.write_vectors(v.select("vec_id", "embedding"), f"{at}/embeddings")
    writers.write_label_columns(v.select("vec_id", "label"), f"{at}/labels.parquet")
    x = readers.embeddings(spark, f"{at}/embeddings").join(readers.embeddings(spark, f"{at}/labels.parquet", columns=("vec_id", "label")), "vec_id")
    return x.select("vec_id", "label", F.round(F.aggregate("embedding", F.lit(0.0), lambda a, e: a + e), 6).alias("total"))


@query("binary_index_round_trip", SEARCH_SQL["pq_encode"])
def binary_index_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """List files as they are exchanged."""
    at = folder(spark)
    writers.write_binary_index(rule_index(table(spark, d, "embeddings")), at)
    return readers.read_binary_index(spark, at).lists.select("vec_id", "partition_id", _digits("codes").alias("codes"))


@query("index_round_trip", SEARCH_SQL["pq_encode"])
def index_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Q2, Q4, Q20: an index saved and loaded as tables."""
    at = folder(spark)
    ivf.save(rule_index(table(spark, d, "embeddings")), at)
    return ivf.load(spark, at).lists.select("vec_id", "partition_id", _digits("codes").alias("codes"))


@query("index_accessors", "SELECT CAST(floor(sqrt(count(*))) AS BIGINT) AS n_partitions, 64 AS d, 8 AS m, 16 AS k, 32.0 AS compression FROM embeddings")
def index_accessors(spark: SparkSession, d: str) -> DataFrame:
    """Q20, F13."""
    index = rule_index(table(spark, d, "embeddings"))
    own = index.describe()["pq"]
    return spark.createDataFrame([(index.n_partitions, index.dimensions, own["m"], own["k"], float(own["compression_ratio"]))], "n_partitions long, d int, m int, k int, compression double")


@query("map_round_trip", f"WITH {_POINTS}, m AS (SELECT vec_id, (x - cx) / (r / 2) AS x, (y - cy) / (r / 2) AS y, label FROM p, b), c AS (SELECT label, row_number() OVER (ORDER BY CAST(label AS VARCHAR)) - 1 AS code FROM (SELECT DISTINCT label FROM embeddings)) SELECT vec_id, round(x, 4) AS x, round(y, 4) AS y, CAST(code AS INTEGER) AS code, CAST(label AS VARCHAR) AS category FROM m JOIN c USING (label)")
def map_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """The files of a map."""
    at = folder(spark)
    ingest.export_map(mapping.normalise(points(spark, d)), table(spark, d, "embeddings"), ("label",), at)
    found, names, _ = readers.read_map(spark, at)
    names = names.where("column = 'label'").select("code", "category")
    return found.withColumnRenamed("label", "code").join(names, "code").select("vec_id", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"), F.col("code").cast("int").alias("code"), "category")


@query("map_categories", "SELECT * FROM (VALUES ('base', 'lang', false), ('base', 'source', true), ('first', 'lang', true), ('first', 'source', false), ('user', 'mine', true)) t(kind, column_, is_default)")
def map_categories(spark: SparkSession, d: str) -> DataFrame:
    """Of a model with a default, of one without, of a user index."""
    docs = table(spark, d, "documents")
    names = [mapping.category_dictionary(docs, c).select(F.lit(c).alias("column"), "code", "category") for c in ("lang", "source")]
    both = names[0].unionByName(names[1])
    user = spark.createDataFrame([("mine",)], "category string")
    parts = (("base", mapping.category_columns(both, default="source")), ("first", mapping.category_columns(both)), ("user", mapping.category_columns(both, user)))
    frames = [f.select(F.lit(k).alias("kind"), F.col("column").alias("column_"), "is_default") for k, f in parts]
    return frames[0].unionByName(frames[1]).unionByName(frames[2])


@query("artefact_bytes", "SELECT 128 + count(*) * 64 * 4 AS bytes FROM embeddings")
def artefact_bytes(spark: SparkSession, d: str) -> DataFrame:
    """Bytes below a folder."""
    at = folder(spark)
    writers.write_npy(table(spark, d, "embeddings"), f"{at}/embeddings.npy")
    return spark.createDataFrame([(analytics.folder_size(spark, at),)], "bytes long")


@query("export_validation", "SELECT count(*) AS n_both, 0 AS n_missing, 0 AS n_different, 0 AS n_different_label FROM embeddings WHERE vec_id < 200")
def export_validation(spark: SparkSession, d: str) -> DataFrame:
    """Q15, Q16."""
    return ingest.export(table(spark, d, "embeddings"), folder(spark), ("label",), 200)


@query(
    "projection_linear",
    "WITH p AS (SELECT vec_id, list_sum(list_transform(range(64), lambda i: embedding[i + 1]::DOUBLE * ((7 * i) % 11 - 5) / 10.0)) AS x, list_sum(list_transform(range(64), lambda i: embedding[i + 1]::DOUBLE * ((7 * i + 3) % 11 - 5) / 10.0)) AS y FROM embeddings WHERE vec_id < 400), "
    "b AS (SELECT (min(x) + max(x)) / 2 AS cx, (min(y) + max(y)) / 2 AS cy, greatest(max(x) - min(x), max(y) - min(y)) AS r FROM p) SELECT vec_id, round((x - cx) / (r / 2), 6) AS x, round((y - cy) / (r / 2), 6) AS y FROM p, b",
)
def projection_linear(spark: SparkSession, d: str) -> DataFrame:
    """Q13: the first vectors placed on the map by given axes."""
    i = np.arange(64)[:, None]
    axes = ((7 * i + 3 * np.arange(2)) % 11 - 5) / 10
    found = ingest.place_on_map(table(spark, d, "embeddings"), mapping.Projector(np.zeros(64), axes), 400)
    return found.select("vec_id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query("training_ids", "WITH s AS (SELECT vec_id, label FROM (SELECT vec_id, label, row_number() OVER (ORDER BY md5(CAST(vec_id AS VARCHAR)), vec_id) AS r FROM embeddings) WHERE r <= 100) SELECT vec_id FROM s")
def training_ids(spark: SparkSession, d: str) -> DataFrame:
    """The ids of a training sample, written and read."""
    at = folder(spark)
    writers.write_training_ids(sampling.random_subset(table(spark, d, "embeddings"), 100, order=F.md5(F.col("vec_id").cast("string"))), at)
    return spark.read.parquet(at)


@query("user_index_store", SEARCH_SQL["user_index_round_trip"])
def user_index_store(spark: SparkSession, d: str) -> DataFrame:
    """Two indexes saved, one exported, both deleted, the exported one imported again."""
    _, rows = _user_rows(spark, d)
    meta = spark.sql("SELECT 'user-1' AS id, 'mine' AS name, 'base' AS base_model_id, timestamp'2026-01-01 00:00:00' AS created, 1L AS cell_count, 'label' AS category, array('a') AS labels")
    at = folder(spark)
    store = user_index.UserIndexStore(spark, f"{at}/store")
    for name in ("user-1", "user-2"):
        store.save(meta.withColumn("id", F.lit(name)), rows.withColumn("index_id", F.lit(name)))
    store.export("user-1").select(F.col("json").alias("value")).coalesce(1).write.text(f"{at}/exported")
    for name in ("user-1", "user-2"):
        store.delete(name)
    back = store.get(store.load(f"{at}/exported"))[1]
    code = F.expr("aggregate(transform(sequence(1, length(codes)), j -> cast(conv(hex(substring(codes, j, 1)), 16, 10) as bigint)), 0L, (a, x) -> a + x)")
    return back.groupBy("partition_id").agg(F.count("*").alias("n"), F.sum("pos").alias("positions"), F.sum("label_id").alias("labels"), F.sum(code).alias("codes"))


@query("user_index_accessors", f"WITH {INDEX_SQL} SELECT 'user-1' AS id, 'mine' AS name, 7 AS cell_count, count(DISTINCT partition_id) AS partition_count FROM own JOIN v USING (vec_id) WHERE label < 3")
def user_index_accessors(spark: SparkSession, d: str) -> DataFrame:
    """Q18, Q20."""
    _, rows = _user_rows(spark, d)
    store = user_index.UserIndexStore(spark, folder(spark))
    meta = spark.sql("SELECT 'user-1' AS id, 'mine' AS name, 'base' AS base_model_id, timestamp'2026-01-01 00:00:00' AS created, 7L AS cell_count, 'label' AS category, array('a') AS labels")
    store.save(meta, rows)
    return store.describe("user-1").select("id", "name", "cell_count", "partition_count")


# ---- expression matrices and their tables


@query("matrix_market_round_trip", f"WITH {_EVENTS} SELECT 's1' AS sample_id, 's1_' || cell_id AS cell_id, event_type AS symbol, CAST(value AS DOUBLE) AS value FROM ev JOIN t USING (gene_idx)")
def matrix_market_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """A sample's folder of triples, cells and features."""
    at = folder(spark)
    e = _events(spark, d)
    kinds = table(spark, d, "events").select("event_type").distinct().select("event_type", F.row_number().over(Window.orderBy("event_type")).alias("g"))
    cells = e.select("cell_id").distinct().select("cell_id", F.row_number().over(Window.orderBy("cell_id")).alias("c"))
    body = e.join(cells, "cell_id").select(F.concat_ws(" ", F.col("gene_idx") + 1, "c", "value").alias("value"))
    head = spark.createDataFrame([("%%MatrixMarket matrix coordinate integer general",), ("% by rule",), ("0 0 0",)], "value string")
    parts = head.withColumn("n", F.lit(0)).unionByName(body.withColumn("n", F.lit(1)))
    order = F.when(F.col("value").startswith("%"), 0).otherwise(1)
    names = (parts.repartition(1).sortWithinPartitions("n", order).select("value"), cells.repartition(1).sortWithinPartitions("c").select(F.col("cell_id").cast("string").alias("value")),
             kinds.repartition(1).sortWithinPartitions("g").select(F.concat(F.lit("id\t"), "event_type").alias("value")))
    for name, rows in zip(readers.MTX_FILES, names):
        rows.write.option("compression", "gzip").text(f"{at}/{name}")
    return readers.matrix_market_samples(spark, {"s1": at, "s2": f"{at}/none"})


@query("vocabulary_scan", "SELECT CAST(row_number() OVER (ORDER BY p_brand) - 1 AS INTEGER) AS model_idx, p_brand AS symbol FROM (SELECT DISTINCT p_brand FROM part)")
def vocabulary_scan(spark: SparkSession, d: str) -> DataFrame:
    """A symbol a line, the place being the line's."""
    at = folder(spark)
    brands = table(spark, d, "part").select(F.col("p_brand").alias("value")).distinct()
    brands.repartition(1).sortWithinPartitions("value").write.text(at)
    return readers.vocabulary(spark, at)


@query("tsv_labels", "SELECT row_number() OVER (ORDER BY doc_id) - 1 AS pos, CAST(quality AS VARCHAR) AS label FROM labels")
def tsv_labels(spark: SparkSession, d: str) -> DataFrame:
    """The first field of every line."""
    at = folder(spark)
    rows = table(spark, d, "labels").repartition(1).sortWithinPartitions("doc_id")
    rows.select(F.concat_ws("\t", "quality", "toxic").alias("value")).write.text(at)
    return readers.tsv_labels(spark, at).select(F.col("pos").cast("long").alias("pos"), "label")


@query(
    "registry_scan",
    """SELECT DISTINCT p_brand AS name, 'model' AS kind, p_brand AS id FROM part
    UNION ALL SELECT n_name, 'user', 'user-' || n_nationkey FROM nation""",
)
def registry_scan(spark: SparkSession, d: str) -> DataFrame:
    """A registry of models by line, with blanks around names and empty lines, and the user indexes."""
    at = folder(spark)
    brands = table(spark, d, "part").select("p_brand").distinct()
    brands.select(F.concat(F.lit(" "), "p_brand", F.lit(" \n ")).alias("value")).write.text(at)
    mine = table(spark, d, "nation").select(F.col("n_name").alias("name"), F.concat(F.lit("user-"), F.col("n_nationkey").cast("string")).alias("id"))
    return readers.models(spark, at, mine)


_CANDIDATES = "s AS (SELECT n_name AS gene_ids, CASE WHEN n_nationkey = 3 THEN 'actb' WHEN n_nationkey = 7 THEN 'Tp53' ELSE 'x' || n_nationkey END AS symbol, n_nationkey AS barcode FROM nation)"


@query("name_discovery", f"WITH {_CANDIDATES} SELECT upper(symbol) AS symbol, 'barcode' AS cells, 'symbol' AS genes FROM s")
def name_discovery(spark: SparkSession, d: str) -> DataFrame:
    """The column of cell names, and that of gene names, which the markers tell from one before it."""
    k = F.col("n_nationkey")
    rows = table(spark, d, "nation").select(
        F.col("n_name").alias("gene_ids"), F.when(k == 3, "actb").when(k == 7, "Tp53").otherwise(F.concat(F.lit("x"), k.cast("string"))).alias("symbol"), k.alias("barcode")
    )
    cells, found = discovery.cell_name_column(rows), discovery.gene_name_column(rows)
    return discovery.gene_names(rows).select("symbol", F.lit(cells).alias("cells"), F.lit(found).alias("genes"))


@query(
    "raw_count_discovery",
    """WITH f AS (SELECT user_id AS file, list(DISTINCT CASE event_type WHEN 'click' THEN 'spliced' WHEN 'purchase' THEN 'raw_counts' WHEN 'signup' THEN 'unspliced' ELSE event_type END) AS l,
      user_id % 3 = 0 AS has_raw, user_id % 7 <> 0 AS has_x FROM events WHERE event_id % 5 = 0 AND event_type <> 'view' GROUP BY ALL),
    p AS (SELECT *, CASE WHEN list_contains(l, 'counts') THEN 'layers/counts' WHEN list_contains(l, 'raw_counts') THEN 'layers/raw_counts' WHEN list_contains(l, 'raw') THEN 'layers/raw' WHEN list_contains(l, 'count') THEN 'layers/count'
      WHEN list_contains(l, 'spliced') THEN 'layers/spliced' WHEN list_contains(l, 'unspliced') THEN 'layers/unspliced' WHEN has_raw THEN 'raw/X' WHEN has_x THEN 'X' END AS online,
      CASE WHEN list_contains(l, 'counts') THEN 'layers/counts' WHEN list_contains(l, 'raw_counts') THEN 'layers/raw_counts' WHEN list_contains(l, 'raw') THEN 'layers/raw' WHEN has_raw THEN 'raw/X' WHEN has_x THEN 'X' END AS offline FROM f)
    SELECT file, 'online' AS kind, online AS place, coalesce(online = 'X', false) AS doubtful FROM p UNION ALL SELECT file, 'offline', offline, coalesce(offline = 'X', false) FROM p""",
)
def raw_count_discovery(spark: SparkSession, d: str) -> DataFrame:
    """A file for each user, whose kinds of events are its layers."""
    kind = F.when(F.col("event_type") == "click", "spliced").when(F.col("event_type") == "purchase", "raw_counts").when(F.col("event_type") == "signup", "unspliced").otherwise(F.col("event_type"))
    files = table(spark, d, "events").where("event_id % 5 = 0 AND event_type <> 'view'").groupBy(F.col("user_id").alias("file")).agg(F.collect_set(kind).alias("layers"))
    files = files.withColumns({"has_raw": F.col("file") % 3 == 0, "has_x": F.col("file") % 7 != 0})
    parts = [discovery.raw_counts_places(files, k == "offline").select("file", F.lit(k).alias("kind"), "place", "doubtful") for k in ("online", "offline")]
    return parts[0].unionByName(parts[1])


@query(
    "ingest_cells",
    f"WITH {_BASE}{_EMB}, n AS (SELECT cell_id, row_number() OVER (ORDER BY cell_id) - 1 AS vec_id FROM (SELECT DISTINCT cell_id FROM emb)) SELECT vec_id, n.cell_id, round(list_sum(list(x ORDER BY j)), 6) AS total, s_nationkey FROM emb JOIN n USING (cell_id) JOIN supplier ON s_suppkey = cell_id WHERE vec_id < 50 GROUP BY ALL",
)
def ingest_cells(spark: SparkSession, d: str) -> DataFrame:
    """Q14: aligned, normalised, embedded, numbered, with labels, the first fifty cells."""
    obs = table(spark, d, "supplier").select(F.col("s_suppkey").alias("cell_id"), "s_nationkey", "s_name")
    got = ingest.ingest(expression(spark, d), genes(spark, d), vocabulary(spark, d), linear(spark, d), obs, ("s_nationkey",), 50)
    return got.select("vec_id", "cell_id", F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x), 6).alias("total"), "s_nationkey")


_W = "(((7 * {i} + 3 * {j}) % 11) - 5) / 10.0"


@query(
    "mlp_embed",
    f"""WITH {_BASE},
    h AS (SELECT cell_id, j, greatest(sum(value * {_W.format(i="model_idx", j="j")}), 0) AS x FROM ln_, range(6) r(j) GROUP BY 1, 2),
    y AS (SELECT cell_id, k, sum(x * {_W.format(i="(5 * j)", j="k")}) AS x FROM h, range(4) r(k) GROUP BY 1, 2),
    u AS (SELECT cell_id, sqrt(sum(x * x)) AS size FROM y GROUP BY 1)
    SELECT cell_id, CAST(k AS INTEGER) AS j, round(x / greatest(size, 1e-12), 6) AS x FROM y JOIN u USING (cell_id)""",
)
def mlp_embed(spark: SparkSession, d: str) -> DataFrame:
    """A two-layer encoder with weights by a rule, a rectifier between, unit output."""
    n = vocabulary(spark, d).count()
    first = ((7 * np.arange(n)[:, None] + 3 * np.arange(6)) % 11 - 5) / 10
    second = ((7 * 5 * np.arange(6)[:, None] + 3 * np.arange(4)) % 11 - 5) / 10
    y = encoder.embed(aligned(spark, d), encoder.MlpEncoder(((first, np.zeros(6)), (second, np.zeros(4)))))
    return y.select("cell_id", F.posexplode("embedding").alias("j", "x")).withColumn("x", F.round("x", 6))


#: Words of both subspaces of the index below, two lists at (0, 0, 0, 0) and (2, 2, -2, 2).
_WORDS = ((-4.0, -1.0), (-1.0, 2.0), (1.0, -3.0), (3.0, 4.0))
_FAR = (2.0, 2.0, -2.0, 2.0)
_LABEL_SQL = f"""WITH {_BASE}{_EMB},
e AS (SELECT cell_id, list(x ORDER BY j) AS e FROM emb GROUP BY 1),
c AS (SELECT * FROM (VALUES (0, [0.0, 0.0, 0.0, 0.0]::DOUBLE[]), (1, {list(_FAR)}::DOUBLE[])) t(p, c)),
near AS (SELECT cell_id, p, list_transform(list_zip(e, c), lambda z: z[1] - z[2]) AS res, row_number() OVER (PARTITION BY cell_id ORDER BY round({L2.format(a="e", b="c")}, 12), p) AS r FROM e, c),
w AS (SELECT * FROM (VALUES {", ".join(f"({i}, [{a}, {b}]::DOUBLE[])" for i, (a, b) in enumerate(_WORDS))}) t(code, w)),
part AS (SELECT cell_id, p, r, j, list_slice(res, j * 2 + 1, j * 2 + 2) AS s FROM near, range(2) t(j)),
lut AS (SELECT cell_id, p, r, j, code, {L2.format(a="s", b="w")} AS d FROM part, w),
codes AS (SELECT cell_id, p, j, code FROM (SELECT *, row_number() OVER (PARTITION BY cell_id, j ORDER BY round(d, 12), code) AS n FROM lut WHERE r = 1) WHERE n = 1),
adc AS (SELECT lut.cell_id AS query_id, codes.cell_id AS vec_id, sum(d) AS dist FROM lut JOIN codes USING (p, j, code) GROUP BY 1, 2),
found AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(dist, 6), vec_id) AS rank FROM adc),
votes AS (SELECT query_id, vec_id % 4 AS label, count(*) AS votes FROM found WHERE rank <= 10 GROUP BY 1, 2),
best AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY votes DESC, label) AS n FROM votes)
SELECT CAST(query_id AS VARCHAR) AS cell_id, 'group ' || label AS label, votes / 10.0 AS confidence FROM best WHERE n = 1"""


@query("label_cells", _LABEL_SQL)
def label_cells(spark: SparkSession, d: str) -> DataFrame:
    """Q8, the whole online path: align, embed, search an index by a rule over the embedded cells, vote, decode."""
    from ..session import stored

    model = linear(spark, d)
    known = stored(encoder.embed(aligned(spark, d), model).withColumnRenamed("cell_id", "vec_id"), "cells")
    quantizer = pq.from_words([np.array(_WORDS), np.array(_WORDS)])
    centroids = np.array([(0.0,) * 4, _FAR])
    index = ivf.IvfPqIndex(centroids, quantizer, ivf.populate(known, centroids, quantizer))
    names = spark.createDataFrame([(i, f"group {i}") for i in range(4)], "label_id int, label string")
    reference = api.Reference(index, known.select("vec_id", (F.col("vec_id") % 4).cast("int").alias("label_id")), names)
    cells = expression(spark, d).withColumn("cell_id", F.col("cell_id").cast("string"))
    found = api.label_cells(cells, genes(spark, d), vocabulary(spark, d), model, reference, n_probe=2, k=10)
    return found.select("cell_id", "label", "confidence")


@query("training_sample", "SELECT vec_id, label FROM (SELECT vec_id, label, row_number() OVER (ORDER BY md5(CAST(vec_id AS VARCHAR)), vec_id) AS r FROM embeddings) WHERE r <= 100")
def training_sample(spark: SparkSession, d: str) -> DataFrame:
    """By a hash that SQL has as well."""
    return sampling.random_subset(table(spark, d, "embeddings"), 100, order=F.md5(F.col("vec_id").cast("string"))).select("vec_id", "label")


# ---- result files


@query("results_csv", f"WITH {_RESULTS} SELECT CAST(cell_id AS VARCHAR) AS cell_id, coalesce(label, 'Unknown') AS category_label, printf('%.3f', coalesce(confidence, 1.0)::DOUBLE) AS confidence FROM res")
def results_csv(spark: SparkSession, d: str) -> DataFrame:
    """K8, as files."""
    at = folder(spark)
    writers.write_results(_results(spark, d), at)
    return spark.read.option("header", True).csv(at)


@query("oracle_csv", f"WITH {_RESULTS} SELECT CAST(cell_id AS VARCHAR) AS cell_id, label AS category_label FROM res WHERE label IS NOT NULL")
def oracle_csv(spark: SparkSession, d: str) -> DataFrame:
    """K9, as files."""
    at = folder(spark)
    writers.write_labels_csv(_results(spark, d).where("label IS NOT NULL"), at)
    return spark.read.option("header", True).csv(at)


# ---- scalar functions


@query("typed_arrays", "SELECT vec_id, base64(unhex(printf('%02x%02x%02x%02x', label, 0, (vec_id % 300) % 256, (vec_id % 300) // 256))) AS shorts, base64(unhex(printf('%02x%02x', label, vec_id % 256))) AS bytes, CAST(label + vec_id % 300 AS BIGINT) AS short_sum, CAST(label + vec_id % 256 AS BIGINT) AS byte_sum, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 6) AS float_sum FROM embeddings")
def typed_arrays(spark: SparkSession, d: str) -> DataFrame:
    """arrays of each kind to base64 and back."""
    v = table(spark, d, "embeddings")
    low, high = F.col("label").cast("int"), (F.col("vec_id") % 300).cast("int")
    coded = v.select(
        "vec_id", scalar.encode_shorts(F.array(low, high)).alias("shorts"), scalar.encode_bytes(F.array(low, (F.col("vec_id") % 256).cast("int"))).alias("bytes"),
        scalar.encode_floats("embedding").alias("floats"),
    )

    def total(c, zero):
        return F.aggregate(c, zero, lambda a, x: a + x)

    back = coded.select("vec_id", "shorts", "bytes", scalar.decode_shorts("shorts").alias("s"), scalar.decode_bytes("bytes").alias("b"), scalar.decode_floats("floats").alias("f"))
    return back.select("vec_id", "shorts", "bytes", total("s", F.lit(0)).cast("long").alias("short_sum"), total("b", F.lit(0)).cast("long").alias("byte_sum"), F.round(total("f", F.lit(0.0)), 6).alias("float_sum"))


@query(
    "ratios",
    """SELECT label, CAST(m AS INTEGER) AS m, d * 32 / (m * 8.0) AS compression, round(sum_all / (count_all * (4.0 + m)), 6) AS reduction,
      CASE WHEN zero = 0 THEN 'NaN'::DOUBLE ELSE round(count_all / zero, 6) END AS odds
    FROM (SELECT label, len(embedding) AS d, sum(len(embedding) * 4.0) AS sum_all, count(*) AS count_all, count(*) FILTER (WHERE vec_id % 50 = label) AS zero FROM embeddings GROUP BY ALL), (VALUES (8), (16), (32)) t(m)""",
)
def ratios(spark: SparkSession, d: str) -> DataFrame:
    """of each label's vectors, what codes save, and a ratio whose divisor may be 0."""
    v = table(spark, d, "embeddings")
    facts = v.groupBy("label", F.size("embedding").alias("d")).agg(
        F.sum(F.size("embedding") * 4).alias("bytes"), F.count("*").alias("n"), F.count(F.when(F.col("vec_id") % 50 == F.col("label"), 1)).alias("some")
    )
    rows = facts.withColumn("m", F.explode(F.array(*[F.lit(m) for m in (8, 16, 32)])))
    return rows.select(
        "label", "m", compression_ratio(F.col("d"), F.col("m")).cast("double").alias("compression"),
        F.round(ratio(F.col("bytes"), F.col("n") * (F.col("m") + 4)), 6).alias("reduction"), F.round(ratio(F.col("n"), F.col("some")), 6).alias("odds"),
    )


@query("user_index_ids", "SELECT user_id, 'user-' || (user_id * 1000) || '-' || lpad(CAST(user_id AS VARCHAR), 8, '0') AS id FROM (SELECT DISTINCT user_id FROM events)")
def user_index_ids(spark: SparkSession, d: str) -> DataFrame:
    """F19, with a given random part."""
    users = table(spark, d, "events").select("user_id").distinct()
    return users.select("user_id", scalar.user_index_id(F.col("user_id") * 1000, F.lpad(F.col("user_id").cast("string"), 8, "0")).alias("id"))


@query("perturbed_norms", "SELECT vec_id, true AS moved, true AS near FROM embeddings WHERE vec_id % 20 = 0")
def perturbed_norms(spark: SparkSession, d: str) -> DataFrame:
    """Every query is moved, by about a hundredth of its length times the root of its dimensions."""
    v = table(spark, d, "embeddings").where("vec_id % 20 = 0")
    both = analytics.perturbed(v).withColumnRenamed("embedding", "p").join(v.select("vec_id", "embedding"), "vec_id")
    size = F.sqrt(F.aggregate(F.col("embedding").cast("array<double>"), F.lit(0.0), lambda a, x: a + x * x))
    gap = F.sqrt(F.aggregate(F.zip_with("p", F.col("embedding").cast("array<double>"), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, x: a + x))
    return both.select("vec_id", (gap > 0).alias("moved"), gap.between(size * 0.03, size * 0.16).alias("near"))


# ---- streams


@query("streaming_batches", "SELECT 0 AS batch_seq, count(*) AS n, count(DISTINCT user_id) AS cells FROM events")
def streaming_batches(spark: SparkSession, d: str) -> DataFrame:
    """Rows pushed by micro-batch."""
    at = folder(spark)
    label_stream(_event_stream(spark, d), lambda b: b.select(F.col("user_id").alias("cell_id"), F.col("event_type").alias("label"), "ts", "event_id"), f"{at}/rows", f"{at}/progress").awaitTermination()
    return spark.read.parquet(f"{at}/rows").groupBy(F.col("batch_seq").cast("int").alias("batch_seq")).agg(F.count("*").alias("n"), F.count_distinct("cell_id").alias("cells"))


@query("streaming_current_cells", "SELECT count(DISTINCT user_id) AS n FROM events")
def streaming_current_cells(spark: SparkSession, d: str) -> DataFrame:
    """A row for every cell, whatever was sent."""
    at = folder(spark)
    label_stream(_event_stream(spark, d), lambda b: b.select(F.col("user_id").alias("cell_id"), F.col("event_type").alias("label")), f"{at}/rows", f"{at}/progress").awaitTermination()
    return current_cells(spark, f"{at}/rows").agg(F.count("*").alias("n"))
