"""Deterministic samples and subsets (T1-T3, P1, P2, P4, P5, P14). Nothing depends on partitioning or on row order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_n(df: DataFrame, n: int, id_col: str = "vec_id") -> DataFrame:
    """By id; a limit would take whichever rows come first."""
    return df.where(F.col(id_col) < n)


def _unit(id_col: str, seed: int) -> Column:
    """The id's place in 0..1 by hash."""
    return F.pmod(F.xxhash64(F.col(id_col), F.lit(seed)), F.lit(1 << 52)) / F.lit(float(1 << 52))


def _share(wanted: Column | float, of: Column | float):
    """A share of the hash range that holds the wanted rows but once in a billion times, and seldom many more."""
    return (wanted + 6 * wanted**0.5 + 20) / of


def random_subset(df: DataFrame, n: int, id_col: str = "vec_id", seed: int = 42, order: Column | None = None) -> DataFrame:
    """The n rows of smallest hash (or first by another order), so any partitioning draws the same ones. What
    is sorted is little more than n rows: those of a share of the hash range that is sure to hold them; should it not, all."""
    if order is not None:
        return df.orderBy(order, id_col).limit(n)
    place, total = _unit(id_col, seed), df.count()
    few = df
    if total and (share := _share(float(n), float(total))) < 1:
        few = df.where(place < share)
        if few.count() < n:
            few = df
    return few.orderBy(place, id_col).limit(n)


class StrataError(ValueError):
    pass


def labelled_strata(df: DataFrame, label: str, most_missing: float = 0.10) -> DataFrame:
    """Rows with a label; an error if `most_missing` of all rows or more have none."""
    share = df.agg(F.avg(F.col(label).isNull().cast("int")).alias("m")).first().m
    if share is None:
        raise StrataError("no rows to sample")
    if share >= most_missing:
        raise StrataError(f"{share:.1%} of the rows have no {label}")
    return df.where(F.col(label).isNotNull()) if share > 0 else df


def stratified_sample(df: DataFrame, label: str, n: int, id_col: str = "vec_id", order: Column | None = None, seed: int = 42) -> DataFrame:
    """N rows (all, if there are fewer), proportionally to the labels: each label's share is rounded down and the
    rows still missing go to the largest remainders, then the smallest label. Within a label the order is by hash of the
    id, or as given. Only counts per label are ranked across labels."""
    counts = df.groupBy(label).agg(F.count("*").alias("__c"))
    total = counts.agg(F.sum("__c")).first()[0] or 0
    n = min(n, total)
    exact = F.col("__c") * F.lit(n) / F.lit(max(1, total))
    base = F.floor(F.col("__c") * F.lit(n) / F.lit(max(1, total)))
    shares = counts.withColumn("__base", base).withColumn("__rest", exact - base)
    missing = F.lit(n) - F.sum("__base").over(Window.partitionBy())
    place = F.row_number().over(Window.orderBy(F.desc("__rest"), label))
    quota = shares.withColumn("__quota", F.col("__base") + F.when(place <= missing, 1).otherwise(0)).select(F.col(label).alias("__l"), "__quota", "__c")
    rows = df.join(quota, df[label].eqNullSafe(F.col("__l")))
    if order is None:
        # of a label only the rows of a share of the hash range are ranked; should it lack rows of a label, all are
        order = _unit(id_col, seed)
        few = rows.where(order < _share(F.col("__quota"), F.col("__c")))
        have = few.groupBy("__l", "__quota").agg(F.count("*").alias("__n"))
        short = quota.alias("a").join(have.alias("b"), F.col("a.__l").eqNullSafe(F.col("b.__l")), "left").where("coalesce(__n, 0) < a.__quota")
        rows = few if short.isEmpty() else rows
    first = Window.partitionBy("__l").orderBy(order, id_col)
    # no label has a quota over n: with that constant each task sorts and sends n rows of a label at most
    ranked = rows.withColumn("__r", F.row_number().over(first)).where(F.col("__r") <= n)
    return ranked.where("__r <= __quota").select(*df.columns)
