"""Queries over expression-like matrices derived from the star tables: alignment, normalisation, encoding, importance.

Cells are suppliers, features the brands of the parts they deliver, values the delivered quantities; a second matrix has
users and event types.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.labels import sample_cell_id
from ..operators import encoder, features
from ..session import table

QUERY: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERY[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def genes(spark: SparkSession, d: str) -> DataFrame:
    """gene_idx, symbol: the brands in order."""
    brands = table(spark, d, "part").select(F.col("p_brand").alias("symbol")).distinct()
    return brands.select((F.row_number().over(Window.orderBy("symbol")) - 1).cast("int").alias("gene_idx"), "symbol")


def expression(spark: SparkSession, d: str) -> DataFrame:
    """cell_id, gene_idx, value: quantity by supplier and brand. The facts are summed by part before they meet the parts."""
    facts = table(spark, d, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.sum("l_quantity").alias("q"))
    rows = facts.join(table(spark, d, "part").select("p_partkey", F.col("p_brand").alias("symbol")), F.col("l_partkey") == F.col("p_partkey"))
    cells = rows.groupBy(F.col("l_suppkey").alias("cell_id"), "symbol").agg(F.sum("q").alias("value"))
    return cells.join(features.small(genes(spark, d)), "symbol").select("cell_id", "gene_idx", "value")


def vocabulary(spark: SparkSession, d: str) -> DataFrame:
    """model_idx, symbol: every brand with an even last digit, last first; the first symbol is there twice, and one that
    no sample has."""
    even = table(spark, d, "part").select(F.col("p_brand").alias("symbol")).distinct().where(F.substring("symbol", -1, 1).isin("0", "2", "4", "6", "8"))
    places = even.select((F.row_number().over(Window.orderBy(F.desc("symbol"))) - 1).cast("int").alias("model_idx"), "symbol")
    more = even.agg(F.max("symbol").alias("symbol"), F.count("*").alias("n")).select(F.col("n").cast("int").alias("model_idx"), "symbol")
    return places.unionByName(more).unionByName(more.select((F.col("model_idx") + 1).alias("model_idx"), F.lit("Brand#none").alias("symbol")))


_BASE = """
g AS (SELECT CAST(row_number() OVER (ORDER BY symbol) - 1 AS INTEGER) AS gene_idx, symbol FROM (SELECT DISTINCT p_brand AS symbol FROM part)),
ex AS (SELECT l_suppkey AS cell_id, gene_idx, sum(l_quantity) AS value FROM lineitem JOIN part ON l_partkey = p_partkey JOIN g ON p_brand = symbol GROUP BY 1, 2),
voc AS (SELECT CAST(row_number() OVER (ORDER BY symbol DESC) - 1 AS INTEGER) AS model_idx, symbol FROM g WHERE right(symbol, 1) IN ('0', '2', '4', '6', '8')),
al AS (SELECT cell_id, model_idx, value FROM ex JOIN g USING (gene_idx) JOIN voc USING (symbol)),
tot AS (SELECT cell_id, sum(value) AS total FROM al GROUP BY 1),
ln_ AS (SELECT cell_id, model_idx, ln(1 + value * 10000 / CASE WHEN total = 0 THEN 1 ELSE total END) AS value FROM al JOIN tot USING (cell_id))"""


def aligned(spark: SparkSession, d: str) -> DataFrame:
    return features.align(expression(spark, d), genes(spark, d), vocabulary(spark, d))


@query("align_genes", f"WITH {_BASE} SELECT cell_id, model_idx, round(value, 4) AS value FROM al")
def align_genes(spark: SparkSession, d: str) -> DataFrame:
    return aligned(spark, d).select("cell_id", "model_idx", F.round("value", 4).alias("value"))


@query("lognorm", f"WITH {_BASE} SELECT cell_id, model_idx, round(value, 6) AS value FROM ln_")
def lognorm(spark: SparkSession, d: str) -> DataFrame:
    return features.log_normalise(aligned(spark, d)).select("cell_id", "model_idx", F.round("value", 6).alias("value"))


@query("expressed_genes", f"WITH {_BASE} SELECT cell_id, count(*) AS n FROM al WHERE value > 0.1 GROUP BY 1")
def expressed_genes(spark: SparkSession, d: str) -> DataFrame:
    return features.expressed(aligned(spark, d)).groupBy("cell_id").agg(F.count("*").alias("n"))


@query("matrix_shape", f"WITH {_BASE} SELECT count(DISTINCT cell_id) AS n_cells, max(gene_idx) + 1 AS n_genes FROM ex")
def matrix_shape(spark: SparkSession, d: str) -> DataFrame:
    return features.shape(expression(spark, d))


_EVENTS = """
t AS (SELECT event_type, CAST(row_number() OVER (ORDER BY event_type) - 1 AS INTEGER) AS gene_idx FROM (SELECT DISTINCT event_type FROM events)),
ev AS (SELECT user_id AS cell_id, gene_idx, count(*) AS value FROM events JOIN t USING (event_type) GROUP BY 1, 2)"""


def _events(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("value"))
    kinds = e.select("event_type").distinct().select("event_type", (F.row_number().over(Window.orderBy("event_type")) - 1).cast("int").alias("gene_idx"))
    return e.join(features.small(kinds), "event_type").select(F.col("user_id").alias("cell_id"), "gene_idx", "value")


@query("csr_pivot", f"WITH {_EVENTS} SELECT cell_id, string_agg(CAST(gene_idx AS VARCHAR), ',' ORDER BY gene_idx) AS indices, string_agg(CAST(value AS VARCHAR), ',' ORDER BY gene_idx) AS data FROM ev GROUP BY 1")
def csr_pivot(spark: SparkSession, d: str) -> DataFrame:
    rows = features.to_csr(_events(spark, d))
    return rows.select("cell_id", *[F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c) for c in ("indices", "data")])


@query("dense_unpivot")
def dense_unpivot(spark: SparkSession, d: str) -> DataFrame:
    return features.from_dense(features.to_dense(_events(spark, d), 5), keep_zeros=True).select("cell_id", "gene_idx", "value")


SQL["dense_unpivot"] = (
    f"WITH {_EVENTS} SELECT c.cell_id, CAST(i AS INTEGER) AS gene_idx, CAST(coalesce(value, 0) AS DOUBLE) AS value "
    "FROM (SELECT DISTINCT cell_id FROM ev) c CROSS JOIN range(5) r(i) LEFT JOIN ev ON ev.cell_id = c.cell_id AND ev.gene_idx = i"
)


@query("csr_row_slices", "SELECT o_custkey % 50 AS cell_id, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1")
def csr_row_slices(spark: SparkSession, d: str) -> DataFrame:
    """A matrix stored as entries by position and row starts, cut into its rows again."""
    rows = table(spark, d, "orders").select((F.col("o_custkey") % 50).alias("cell"), F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("v"))
    counts = rows.groupBy("cell").agg(F.count("*").alias("n"))
    starts = features.running_total(counts, "cell", "n", "start")
    placed = rows.join(starts.select("cell", "start"), "cell").withColumn("pos", F.col("start") + F.row_number().over(Window.partitionBy("cell").orderBy("k")) - 1)
    entries = placed.select("pos", F.lit(0).alias("gene_idx"), F.col("v").alias("value"))
    found = features.csr_slices(starts.select(F.col("cell").alias("pos"), "start"), entries)
    return found.groupBy("cell_id").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query("marker_validation", "SELECT count(DISTINCT CASE WHEN upper(p_brand) IN ('BRAND#11', 'BRAND#12', 'BRAND#99', 'ACTB') THEN upper(p_brand) END) AS n_markers, count(DISTINCT CASE WHEN upper(p_brand) IN ('BRAND#11', 'BRAND#12', 'BRAND#99', 'ACTB') THEN upper(p_brand) END) >= 2 AS accepted FROM part")
def marker_validation(spark: SparkSession, d: str) -> DataFrame:
    return features.markers_present(table(spark, d, "part"), "p_brand", ("Brand#11", "brand#12", "Brand#99", "ACTB"))


@query("outer_concat", "SELECT sample_id, symbol, count(*) AS n, CAST(sum(value) AS DOUBLE) AS total FROM (SELECT CASE WHEN user_id % 2 = 0 THEN 'a' ELSE 'b' END AS sample_id, event_type AS symbol, user_id, count(*) AS value FROM events WHERE NOT (user_id % 2 = 0 AND event_type = 'click') GROUP BY ALL) GROUP BY ALL")
def outer_concat(spark: SparkSession, d: str) -> DataFrame:
    """J8, P11 on two samples of which one lacks a gene."""
    e = table(spark, d, "events").groupBy(F.col("user_id").alias("barcode"), F.col("event_type").alias("symbol")).agg(F.count("*").cast("double").alias("value"))
    samples = [("a", e.where("barcode % 2 = 0 AND symbol <> 'click'")), ("b", e.where("barcode % 2 <> 0"))]
    return features.concat_samples(samples).groupBy("sample_id", "symbol").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


@query("prefix_cells", "SELECT 's1_' || CAST(user_id AS VARCHAR) AS cell_id, 's1' AS sample_id, count(*) AS n FROM events GROUP BY user_id")
def prefix_cells(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"))
    return n.select(sample_cell_id(F.lit("s1"), F.col("user_id").cast("string")).alias("cell_id"), F.lit("s1").alias("sample_id"), "n")


# ---- encoder: weights by a rule, ((7 i + 3 j) mod 11 - 5) / 10

D = 4
_W = "(((7 * {i} + 3 * {j}) % 11) - 5) / 10.0"


def linear(spark: SparkSession, d: str) -> encoder.LinearEncoder:
    n = vocabulary(spark, d).count()
    i, j = np.arange(n)[:, None], np.arange(D)[None, :]
    return encoder.LinearEncoder((((7 * i + 3 * j) % 11) - 5) / 10)


_EMB = f", emb AS (SELECT cell_id, j, sum(value * {_W.format(i='model_idx', j='j')}) AS x FROM ln_, range({D}) r(j) GROUP BY 1, 2)"


@query("linear_embed", f"WITH {_BASE}{_EMB} SELECT cell_id, CAST(j AS INTEGER) AS j, round(x, 6) AS x FROM emb")
def linear_embed(spark: SparkSession, d: str) -> DataFrame:
    y = encoder.embed(aligned(spark, d), linear(spark, d))
    return y.select("cell_id", F.posexplode("embedding").alias("j", "x")).withColumn("x", F.round("x", 6))


@query(
    "occlusion_importance",
    f"""WITH {_BASE}{_EMB},
    occ AS (
      SELECT a.cell_id, a.model_idx, a.value AS expression, j,
        sum(ln(1 + b.value * 10000 / CASE WHEN total - a.value = 0 THEN 1 ELSE total - a.value END) * {_W.format(i='b.model_idx', j='j')}) FILTER (WHERE b.model_idx <> a.model_idx) AS y
      FROM al a JOIN al b USING (cell_id) JOIN tot USING (cell_id), range({D}) r(j) WHERE a.value > 0.1 GROUP BY ALL
    ),
    imp AS (SELECT cell_id, model_idx, expression, sqrt(sum((coalesce(y, 0) - x) * (coalesce(y, 0) - x))) AS importance FROM occ JOIN emb USING (cell_id, j) GROUP BY ALL)
    SELECT cell_id, CAST(rank AS INTEGER) AS rank, symbol AS gene, round(importance, 6) AS importance, round(expression, 4) AS expression FROM (
      SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY round(importance, 9) DESC, model_idx) AS rank FROM imp WHERE importance > 0) JOIN voc USING (model_idx) WHERE rank <= 10""",
)
def occlusion_importance(spark: SparkSession, d: str) -> DataFrame:
    found = encoder.importance(aligned(spark, d), linear(spark, d))
    first = encoder.top_genes(found.withColumn("importance", F.round("importance", 9)), vocabulary(spark, d))
    return first.select("cell_id", "rank", "gene", F.round("importance", 6).alias("importance"), F.round("expression", 4).alias("expression"))
