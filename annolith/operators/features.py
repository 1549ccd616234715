"""Sparse cell-by-feature matrices as rows (cell_id, feature, value): alignment to a vocabulary, normalisation, shape.

J1, J8, F7-F9, A12, P8, P11, A29, S4, S7, S8.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import nan_to_num

#: Symbols of which two must occur for a column to count as gene symbols (fixed values).
MARKERS = ("ACTB", "GAPDH", "MALAT1", "B2M", "PTPRC", "RPL13", "TMSB4X", "TP53")
TARGET_TOTAL = 1e4
#: Aligned raw values above it count as expressed.
EXPRESSED = 0.1
#: Entries of a block of positions.
_BLOCK = 1 << 20
#: Rows of a vocabulary up to which it is broadcast.
BROADCAST_ROWS = 1_000_000


def markers_present(symbols: DataFrame, column: str = "symbol", markers: tuple[str, ...] = MARKERS, least: int = 2) -> DataFrame:
    """n_markers and whether the column is accepted, in any case of letters."""
    upper = F.upper(F.col(column))
    n = F.count_distinct(F.when(upper.isin(*[m.upper() for m in markers]), upper))
    return symbols.agg(n.alias("n_markers"), (n >= least).alias("accepted"))


def small(df: DataFrame) -> DataFrame:
    """df with a broadcast hint if it has at most BROADCAST_ROWS rows."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def align(expression: DataFrame, features: DataFrame, vocabulary: DataFrame, model_tie: str = "first") -> DataFrame:
    """cell_id, model_idx, value.

    expression (cell_id, gene_idx, value), features (gene_idx, symbol), vocabulary (model_idx, symbol). A symbol that the
    vocabulary has twice takes the first (or, "last", the last) place. Features of a sample that fall on one place do not
    add up: the value of the last one, by gene_idx, stands. Features the vocabulary lacks are dropped. The rows are dealt
    by cell, which also is what normalising and gathering a cell need: the three together shuffle once."""
    pick = {"first": F.min, "last": F.max}[model_tie]
    places = vocabulary.where("symbol IS NOT NULL").groupBy("symbol").agg(pick("model_idx").alias("model_idx"))
    mapping = features.select("gene_idx", "symbol").join(small(places), "symbol").select("gene_idx", "model_idx")
    rows = expression.select("cell_id", "gene_idx", "value").join(small(mapping), "gene_idx")
    return rows.repartition("cell_id").groupBy("cell_id", "model_idx").agg(F.max_by("value", "gene_idx").alias("value"))


def log_normalise(aligned: DataFrame, total: float = TARGET_TOTAL) -> DataFrame:
    """ln(1 + value * total / row sum) in doubles; a row sum of 0 counts as 1."""
    from pyspark.sql import Window

    clean = aligned.withColumn("value", nan_to_num(F.col("value")))
    row_sum = F.sum("value").over(Window.partitionBy("cell_id"))
    return clean.withColumn("value", F.log1p(F.col("value") * (total / F.when(row_sum == 0, 1.0).otherwise(row_sum))))


def expressed(aligned: DataFrame, above: float = EXPRESSED) -> DataFrame:
    """Compared as doubles, so a stored float 0.1 passes."""
    return aligned.where(F.col("value").cast("double") > above)


def shape(expression: DataFrame) -> DataFrame:
    """Cells that have rows, genes up to the largest index."""
    return expression.agg(F.count_distinct("cell_id").alias("n_cells"), (F.max("gene_idx") + 1).alias("n_genes"))


def to_csr(expression: DataFrame) -> DataFrame:
    """cell_id, indices, data: a cell's stored entries in index order."""
    entry = F.struct(F.col("gene_idx").alias("i"), F.col("value").alias("v"))
    rows = expression.groupBy("cell_id").agg(F.array_sort(F.collect_list(entry)).alias("e"))
    return rows.select("cell_id", F.col("e.i").alias("indices"), F.col("e.v").alias("data"))


def from_csr(cells: DataFrame) -> DataFrame:
    pairs = cells.select("cell_id", F.explode(F.arrays_zip("indices", "data")).alias("e"))
    return pairs.select("cell_id", F.col("e.indices").alias("gene_idx"), F.col("e.data").alias("value"))


def running_total(rows: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """rows with the sum of `value` over all rows of smaller keys, which are unique: within ranges of the key by a window,
    across them by a sum per range, which is all that reaches the driver."""
    from pyspark.sql import Window

    from ..session import stored

    ranged = stored(rows.repartitionByRange(key).withColumn("__range", F.spark_partition_id()), "ranged")
    at, offsets = 0, []
    for r in sorted(ranged.groupBy("__range").agg(F.min(key).alias("low"), F.sum(value).alias("total")).collect(), key=lambda r: r.low):
        offsets.append((r["__range"], at))
        at += r.total or 0
    before = Window.partitionBy("__range").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    inside = ranged.withColumn(name, F.coalesce(F.sum(value).over(before), F.lit(0)))
    ranges = rows.sparkSession.createDataFrame(offsets, "__range int, __offset long")
    return inside.join(F.broadcast(ranges), "__range").withColumn(name, F.col(name) + F.col("__offset")).drop("__range", "__offset")


def csr_slices(indptr: DataFrame, entries: DataFrame) -> DataFrame:
    """S7 on the stored triple: indptr (pos, start), entries (pos, gene_idx, value), both by position. Every stored entry
    finds its row by its place, without a join by ranges: the starts are laid among the entries of their block and carried
    on; only the last start of each block, a row per _BLOCK entries, is ranked across blocks."""
    from pyspark.sql import Window

    starts = indptr.select(F.col("start").alias("at"), F.lit(0).alias("kind"), F.col("pos").alias("cell_id"), F.lit(None).cast("int").alias("gene_idx"), F.lit(None).cast("double").alias("value"))
    rows = entries.select(F.col("pos").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast("long").alias("cell_id"), F.col("gene_idx").cast("int").alias("gene_idx"), F.col("value").cast("double").alias("value"))
    block = F.floor(F.col("at") / _BLOCK)
    every = starts.unionByName(rows).withColumn("block", block)
    # a block's first entries belong to the last start of an earlier block
    last = starts.withColumn("block", block).groupBy("block").agg(F.max("cell_id").alias("last"))
    before = Window.partitionBy("block").orderBy("at", "kind", "cell_id").rowsBetween(Window.unboundedPreceding, 0)
    own = every.withColumn("own", F.max("cell_id").over(before))
    blocks = every.select("block").distinct().join(last, "block", "left")
    earlier = blocks.withColumn("carry", F.max("last").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1))).select("block", "carry")
    found = own.where("kind = 1").join(small(earlier), "block").withColumn("cell_id", F.coalesce("own", "carry"))
    return found.select("cell_id", "gene_idx", "value")


def to_dense(expression: DataFrame, n_genes: int) -> DataFrame:
    """cell_id, values: all places, absent ones 0."""
    m = F.map_from_entries(F.collect_list(F.struct("gene_idx", F.col("value").cast("double").alias("v"))))
    rows = expression.groupBy("cell_id").agg(m.alias("m"))
    return rows.select("cell_id", F.transform(F.sequence(F.lit(0), F.lit(n_genes - 1)), lambda i: F.coalesce(F.try_element_at("m", i.cast("int")), F.lit(0.0))).alias("values"))


def from_dense(cells: DataFrame, keep_zeros: bool = False) -> DataFrame:
    """S8. Zeros of a dense matrix are values: with keep_zeros they stay, and take part in collisions."""
    rows = cells.select("cell_id", F.posexplode("values").alias("gene_idx", "value"))
    return rows if keep_zeros else rows.where("value <> 0")


def from_flat(values: DataFrame, n_genes: int) -> DataFrame:
    """S8 on a flat array: (pos, value) with row pos div n_genes."""
    return values.select(F.floor(F.col("pos") / n_genes).alias("cell_id"), F.pmod("pos", F.lit(n_genes)).alias("gene_idx"), "value")


def concat_samples(samples: list[tuple[str, DataFrame]]) -> DataFrame:
    """Rows of all samples (barcode, symbol, value) with cell_id `sample_barcode` and sample_id. In long form
    the outer union of the genes is the union of the rows."""
    from functools import reduce

    parts = [
        df.select(F.concat_ws("_", F.lit(name), "barcode").alias("cell_id"), F.lit(name).alias("sample_id"), "symbol", "value") for name, df in samples
    ]
    return reduce(DataFrame.unionByName, parts)


def same_metadata(samples: list[tuple[str, DataFrame]], key: str = "symbol") -> DataFrame:
    """Features (key, value) of all samples; a value stays only if every sample that has the key agrees on it."""
    from functools import reduce

    every = reduce(DataFrame.unionByName, [df.select(key, "value") for _, df in samples])
    n = F.count_distinct("value") + F.max(F.col("value").isNull().cast("int"))
    return every.groupBy(key).agg(F.when(n == 1, F.max("value")).alias("value"))


def vocabulary_positions(symbols: Column) -> Column:
    """(model_idx, symbol) entries of an ordered list."""
    return F.transform(symbols, lambda s, i: F.struct(i.alias("model_idx"), s.alias("symbol")))
