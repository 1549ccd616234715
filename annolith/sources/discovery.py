"""Finding the right column or matrix among candidates (S2, S3, S5, S6, S6b, F7 inputs)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.features import markers_present

# Candidate names in their order of preference (fixed values).
CELL_NAMES = ("index", "barcodes", "Cells", "barcode", "cell_id", "_index", "cell_name", "_barcodes")
GENE_NAMES = (
    "feature_name", "gene_symbols", "gene_name", "symbol", "index", "gene_ids", "_index", "gene_symbol", "gene_names", "features", "gene_id", "Genes",
)
RAW_LAYERS = ("counts", "raw_counts", "raw", "count", "spliced", "unspliced")
RAW_LAYERS_OFFLINE = ("counts", "raw_counts", "raw")


class NotFound(ValueError):
    pass


def first_present(names: list[str], candidates: tuple[str, ...], what: str) -> str:
    for c in candidates:
        if c in names:
            return c
    raise NotFound(f"no {what} among: {', '.join(names)}")


def cell_name_column(obs: DataFrame) -> str:
    """S2."""
    return first_present(obs.columns, CELL_NAMES, "cell names")


def gene_name_column(var: DataFrame) -> str:
    """S3: the first candidate whose values pass the marker check, then the first column if it passes. All candidates
    are checked in one pass over the table."""
    tried = [c for c in GENE_NAMES if c in var.columns]
    tried += [c for c in var.columns[:1] if c not in tried]
    if tried:
        long = var.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("symbol")) for c in tried])).alias("s")).select("s.*")
        from ..operators.features import MARKERS

        upper = F.upper("symbol")
        good = long.where(upper.isin(*MARKERS)).groupBy("column").agg(F.count_distinct(upper).alias("n")).where("n >= 2").collect()
        accepted = {r.column for r in good}
        for c in tried:
            if c in accepted:
                return c
    raise NotFound(f"no gene names among: {', '.join(var.columns)}")


def gene_names(var: DataFrame) -> DataFrame:
    """symbol in upper case, from the column that S3 finds."""
    return var.select(F.upper(F.col(gene_name_column(var))).alias("symbol"))


def raw_counts_key(layers: list[str], has_raw: bool, has_x: bool, offline: bool = False) -> tuple[str, bool]:
    """Place of the raw counts, and whether it may hold normalised values instead (the last resort)."""
    for c in RAW_LAYERS_OFFLINE if offline else RAW_LAYERS:
        if c in layers:
            return f"layers/{c}", False
    if has_raw:
        return "raw/X", False
    if has_x:
        return "X", True
    raise NotFound("no raw counts in layers, raw/X or X")


def raw_counts_places(files: DataFrame, offline: bool = False) -> DataFrame:
    """S6, S6b for a table of files (layers, an array of names; has_raw, has_x): their columns with place, null where there are no raw counts, and doubtful."""
    wanted = F.array(*[F.lit(c) for c in (RAW_LAYERS_OFFLINE if offline else RAW_LAYERS)])
    first = F.get(F.filter(wanted, lambda c: F.array_contains("layers", c)), 0)
    layer = F.concat(F.lit("layers/"), first)
    place = F.when(layer.isNotNull(), layer).when(F.col("has_raw"), "raw/X").when(F.col("has_x"), "X")
    return files.withColumns({"place": place, "doubtful": F.coalesce(place == "X", F.lit(False))})


def decode_categorical(codes: DataFrame, categories: DataFrame, code: str = "code") -> DataFrame:
    """Codes with `value` from a dictionary (code, category); negative or unknown codes give an empty string."""
    d = categories.select(F.col("code").alias("__c"), F.col("category").alias("value"))
    return codes.join(d, F.col(code) == F.col("__c"), "left").withColumn("value", F.coalesce("value", F.lit(""))).drop("__c")


def accepted_markers(symbols: DataFrame, column: str = "symbol") -> bool:
    return bool(markers_present(symbols, column).first().accepted)


def clean_string(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))
