"""Token counts by the whole-token shortcut (see bpe); tokenizers of another kind count by their library alone.

Defined cases: a null text is empty and has no tokens; texts of any length are counted whole; repeated rows are counted
each; a null doc_id is kept; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import encoder_for, prove_whole_tokens
from .common import BYTE_BPE, batch_rows, table, tokenizer_path


def count_tokens(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), name: str = BYTE_BPE) -> DataFrame:
    """`keep` columns, n_bytes, n_tokens. One pass without a shuffle; what is broadcast is at most the vocabulary."""
    spark = docs.sparkSession
    batch_rows(spark, 1000)
    whole = spark.sparkContext.broadcast(prove_whole_tokens(tokenizer_path(name)))
    narrow = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("__text"))
    schema = docs.select(*keep).schema.add("n_bytes", "long", False).add("n_tokens", "long", False)

    def run(batches):
        encoder = encoder_for(name, whole.value)
        for batch in batches:
            texts = batch.column(len(keep))
            counts = [encoder.count(t) for t in texts.to_pylist()]
            sizes = pc.binary_length(texts).cast(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(keep)], sizes, pa.array(counts, pa.int64())], [*keep, "n_bytes", "n_tokens"]
            )

    return narrow.mapInArrow(run, schema)


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = count_tokens(table(spark, sf_dir, "documents"))
    return counted.withColumn("over_limit", F.col("n_tokens") > 512)
