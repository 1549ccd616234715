"""A corpus pipeline of five stages, each over all documents that the stage before it kept.

quality rules -> one document of each near-duplicate class -> no benchmark contamination -> secrets masked -> packing.

Every stage but the last returns the columns of its input. A stage's result is written as Parquet in the shared folder
and read again as the next one's input. No stage is expressed in SQL, so ORACLE_SQL is None; tests/llm compares the
stages with brute-force versions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annolith.llm.common import as_row, stored, table
from annolith.llm.decontaminate import decontaminate
from annolith.llm.near_dedup import keep_one
from annolith.llm.packing import pack
from annolith.llm.quality_rules import quality_rules
from annolith.llm.secret_scan import scan_secrets

ORACLE_SQL = None


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base statistics and every quality rule."""
    return quality_rules(as_row(docs, "text"), "__in", keep=("__row",)).where("kept").select("__row.*")


def keep_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of every near-duplicate class."""
    return keep_one(docs)


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the secrets in their texts masked and n_chars following the text."""
    found = scan_secrets(as_row(docs, "text"), "__in", keep=("__row",), redacted="__masked")
    row = F.col("__row").withField("text", F.col("__masked"))
    if "n_chars" in docs.columns:
        changed = F.when(F.col("spans") == "", F.col("__row.n_chars")).otherwise(F.length("__masked").cast(docs.schema["n_chars"].dataType))
        row = row.withField("n_chars", changed)
    return found.select(row.alias("__row")).select("__row.*")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of 1024 tokens."""
    return pack(docs)


STAGES = [
    ("quality_rules", keep_good),
    ("near_dedup", keep_distinct),
    ("decontamination", keep_uncontaminated),
    ("secret_scans", mask_secrets),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages from the table `documents`."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
