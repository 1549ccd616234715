"""Indexes made of labelled cells: group, store, export, import, search."""

from __future__ import annotations

from dataclasses import replace

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.labels import decode_floats, decode_shorts, encode_floats
from . import ivf

ROWS = "index_id string, partition_id int, pos long, codes binary, label_id int, x double, y double"
META = "id string, name string, base_model_id string, created timestamp, cell_count long, category string, labels array<string>"


def entries(cells: DataFrame, index_id: str) -> DataFrame:
    """Rows of an index from labelled cells (pos, partition_id, codes, label_id, x, y). Everything is keyed by the cell's
    position; cells without a list or a label are left out, not shifted."""
    rows = cells.where("partition_id IS NOT NULL AND codes IS NOT NULL AND label_id IS NOT NULL")
    return rows.select(F.lit(index_id).alias("index_id"), "partition_id", F.col("pos").cast("long").alias("pos"), "codes", "label_id", "x", "y")


def partitions(rows: DataFrame) -> DataFrame:
    """Per list the codes and labels of its cells in cell order, and how many. For export; a search uses the rows."""
    one = F.struct("pos", "codes", "label_id")
    grouped = rows.groupBy("index_id", "partition_id").agg(F.array_sort(F.collect_list(one)).alias("e"))
    return grouped.select("index_id", "partition_id", F.size("e").cast("long").alias("n"), F.col("e.codes").alias("codes"), F.col("e.label_id").alias("labels"))


def restrict(base: ivf.IvfPqIndex, rows: DataFrame) -> ivf.IvfPqIndex:
    """The base index with only the centroids of lists the user index has, under their own numbers; its lists carry
    the cells, with the label as payload."""
    have = {r.partition_id for r in rows.select("partition_id").distinct().collect()}
    keep = np.array([i for i, p in enumerate(base.partition_ids) if int(p) in have], np.int64)
    lists = rows.select("partition_id", F.col("pos").alias("vec_id"), "codes", "label_id")
    return replace(base, centroids=base.centroids[keep], partition_ids=base.partition_ids[keep], lists=lists)


def search(queries: DataFrame, base: ivf.IvfPqIndex, rows: DataFrame, n_probe: int = ivf.N_PROBE, k: int = ivf.K, **cols) -> DataFrame:
    """Q7: query_id, rank, label_id, dist. The list of a user-index hit and its code are of no use to it, so not given."""
    index = restrict(base, rows)
    if not index.n_partitions:
        return queries.sparkSession.createDataFrame([], "query_id long, rank int, label_id long, dist double")
    return ivf.search(queries, index, n_probe, k, payload="label_id", **cols).select("query_id", "rank", "label_id", "dist")


class UserIndexStore:
    """Indexes in a folder: tables meta and rows, a partition each by index id, so saving replaces only its own."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def save(self, meta: DataFrame, rows: DataFrame) -> None:
        mode = {"partitionOverwriteMode": "dynamic"}
        rows.write.mode("overwrite").options(**mode).partitionBy("index_id").parquet(f"{self.path}/rows")
        meta.withColumn("index_id", F.col("id")).write.mode("overwrite").options(**mode).partitionBy("index_id").parquet(f"{self.path}/meta")

    def _read(self, table: str, schema: str) -> DataFrame:
        full = schema if "index_id" in schema else f"{schema}, index_id string"
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{table}")
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], full)
        return self.spark.read.schema(full).parquet(f"{self.path}/{table}")

    def list(self) -> DataFrame:
        """Metadata only; the rows are not read."""
        return self._read("meta", META).drop("index_id")

    def get(self, index_id: str) -> tuple[DataFrame, DataFrame]:
        return self.list().where(F.col("id") == index_id), self._read("rows", ROWS).where(F.col("index_id") == index_id)

    def describe(self, index_id: str) -> DataFrame:
        """Q20: id, name, base_model_id, cell_count, partition_count; no row if there is no such index."""
        meta, rows = self.get(index_id)
        lists = rows.agg(F.count_distinct("partition_id").alias("partition_count"))
        return meta.select("id", "name", "base_model_id", "cell_count").join(F.broadcast(lists))

    def coordinates(self, index_id: str) -> DataFrame:
        """Q20: pos, x, y of its cells."""
        return self.get(index_id)[1].select("pos", "x", "y")

    def labels(self, index_id: str) -> DataFrame:
        """Q20: label_id, label by the dictionary of the index."""
        return self.get(index_id)[0].select(F.posexplode("labels").alias("label_id", "label"))

    def delete(self, index_id: str) -> None:
        jvm = self.spark._jvm
        for table in ("rows", "meta"):
            path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{table}/index_id={index_id}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def export(self, index_id: str) -> DataFrame:
        meta, rows = self.get(index_id)
        return to_json(meta, rows)

    def load(self, path: str) -> str:
        """Import one exported file; an index of the same id is replaced."""
        meta, rows = from_json(self.spark.read.text(path, wholetext=True).select(F.col("value").alias("json")))
        index_id = meta.first().id
        self.save(meta, rows)
        return index_id


def _bytes(items: Column, one) -> Column:
    """Binary of the items' bytes, each given as hexadecimal digits; linear in their number."""
    return F.unhex(F.array_join(F.transform(items, one), ""))


def _int16(x: Column) -> Column:
    """Hexadecimal digits of a 16-bit integer's little-endian bytes."""
    low, high = F.pmod(x, F.lit(256)), F.pmod(F.shiftright(x, 8), F.lit(256))
    return F.concat(F.lpad(F.hex(low.cast("long")), 2, "0"), F.lpad(F.hex(high.cast("long")), 2, "0"))


def to_json(meta: DataFrame, rows: DataFrame) -> DataFrame:
    """Id, json: a document per index in the format that is exchanged: the time as an ISO string; x, y and
    labelIndices of all cells in order of their positions, as base64 of little-endian 32-bit floats and 16-bit integers;
    partitions, an object by list number with the cells' codes, how many they are, and their labels. Beside these a list
    has the positions of its cells, which other readers leave out. The document holds the whole index, as the format does."""
    grouped = rows.groupBy("index_id", "partition_id").agg(F.array_sort(F.collect_list(F.struct("pos", "codes", "label_id"))).alias("e"))
    entry = F.struct(
        F.base64(_bytes(F.col("e"), lambda x: F.hex(x["codes"]))).alias("pqCodes"),
        F.size("e").alias("pqCodeCount"),
        F.base64(_bytes(F.col("e"), lambda x: _int16(x["label_id"]))).alias("labelIndices"),
        F.col("e.pos").alias("positions"),
    )
    named = grouped.select("index_id", F.struct(F.col("partition_id").cast("string").alias("key"), entry.alias("value")).alias("p"))
    lists = named.groupBy("index_id").agg(F.map_from_entries(F.collect_list("p")).alias("partitions"))
    cells = rows.groupBy(F.col("index_id").alias("__id")).agg(F.array_sort(F.collect_list(F.struct("pos", "x", "y", "label_id"))).alias("c"))
    document = F.struct(
        "id", "name", F.col("base_model_id").alias("baseModelId"), F.date_format("created", _ISO).alias("created"),
        F.col("cell_count").alias("cellCount"), "category", "labels",
        encode_floats(F.col("c.x").cast("array<float>")).alias("x"), encode_floats(F.col("c.y").cast("array<float>")).alias("y"),
        F.base64(_bytes(F.col("c"), lambda x: _int16(x["label_id"]))).alias("labelIndices"), "partitions",
    )
    return meta.join(lists, meta.id == lists.index_id).join(cells, meta.id == F.col("__id")).select("id", F.to_json(document).alias("json"))


_ISO = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"
_DOCUMENT = (
    "id string, name string, baseModelId string, created string, cellCount long, category string, labels array<string>, x string, y string, labelIndices string, "
    "partitions map<string, struct<pqCodes:string, pqCodeCount:int, labelIndices:string, positions:array<long>>>"
)


def from_json(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(meta, rows) of exported documents in a column json. A document of another layout is an error. Where a document
    does not say the positions of a list's cells, they are numbered list by list and have no coordinates; those of all
    cells are what `map_points` gives."""
    d = documents.select(F.from_json("json", _DOCUMENT).alias("d")).select("d.*")
    known = F.col("id").isNotNull() & F.col("partitions").isNotNull() & F.col("labelIndices").isNotNull()
    whole = F.coalesce(F.forall(F.map_values("partitions"), lambda p: p["pqCodes"].isNotNull() & p["pqCodeCount"].isNotNull() & p["labelIndices"].isNotNull()), F.lit(False))
    d = d.withColumn("partitions", F.when(known & whole, F.col("partitions")).otherwise(F.raise_error(F.lit("no user index: lists by number with codes and labels are missing"))))
    meta = d.select(
        "id", "name", F.col("baseModelId").alias("base_model_id"), F.to_timestamp("created", _ISO).alias("created"),
        F.col("cellCount").alias("cell_count"), "category", "labels",
    )
    lists = F.array_sort(F.transform(F.map_entries("partitions"), lambda e: F.struct(e["key"].cast("int").alias("partition_id"), e["value"].alias("v"))))
    part = d.select(F.col("id").alias("index_id"), lists.alias("lists"))
    part = part.select("index_id", F.transform("lists", lambda p: p["v"]["pqCodeCount"]).alias("counts"), F.posexplode("lists").alias("nth", "p"))
    before = F.aggregate(F.slice("counts", F.lit(1), F.col("nth")), F.lit(0).cast("long"), lambda n, c: n + c)
    part = part.select("index_id", "p.partition_id", "p.v.positions", "p.v.pqCodeCount", before.alias("before"), F.unbase64("p.v.pqCodes").alias("all"), F.unbase64("p.v.labelIndices").alias("labels"))
    part = part.where("pqCodeCount > 0").withColumn("m", (F.length("all") / F.col("pqCodeCount")).cast("int"))
    # a list is cut into its cells before they are rows: a row carries no list, and no index
    number = F.transform(F.sequence(F.lit(0), F.col("pqCodeCount") - 1), lambda at: F.struct(
        F.coalesce(F.get("positions", at), F.col("before") + at).alias("pos"), F.substring(F.col("all"), at * F.col("m") + 1, F.col("m")).alias("codes"), _label(F.col("labels"), at).alias("label_id")))
    cells = part.select("index_id", "partition_id", F.col("positions").isNotNull().alias("placed"), F.inline(number))
    rank = (F.row_number().over(Window.partitionBy("index_id").orderBy("pos")) - 1).alias("rank")
    known = cells.select("*", rank)
    points = d.select(F.col("id").alias("index_id"), *[F.coalesce(decode_floats(c), F.array().cast("array<float>")).alias(c) for c in ("x", "y")])
    points = points.select("index_id", F.posexplode(F.arrays_zip("x", "y")).alias("rank", "p")).select("index_id", "rank", "p.x", "p.y")
    xy = [F.when(F.col("placed"), F.col(c)).cast("double").alias(c) for c in ("x", "y")]
    return meta, known.join(points, ["index_id", "rank"], "left").select("index_id", "partition_id", "pos", "codes", "label_id", *xy)


def _label(data: Column, at: Column) -> Column:
    """The at-th 16-bit integer of little-endian bytes."""
    one = F.lit(1)
    value = F.conv(F.concat(F.hex(F.substring(data, 2 * at + 2, one)), F.hex(F.substring(data, 2 * at + 1, one))), 16, 10).cast("int")
    return F.when(value >= 32768, value - 65536).otherwise(value)


def map_points(documents: DataFrame) -> DataFrame:
    """index_id, pos, x, y, label_id of all cells of exported documents, in the order in which they were given."""
    d = documents.select(F.from_json("json", _DOCUMENT).alias("d")).select("d.*")
    rows = d.select(F.col("id").alias("index_id"), *[decode_floats(c).alias(c) for c in ("x", "y")], decode_shorts("labelIndices").alias("label_id")).where("x IS NOT NULL")
    rows = rows.select("index_id", F.size("x").alias("n"), F.posexplode(F.arrays_zip("x", *[F.coalesce(c, F.array()).alias(c) for c in ("y", "label_id")])).alias("pos", "p")).where("pos < n")
    return rows.select("index_id", F.col("pos").cast("long").alias("pos"), F.col("p.x").cast("double").alias("x"), F.col("p.y").cast("double").alias("y"), "p.label_id")
