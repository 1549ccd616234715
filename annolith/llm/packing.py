"""Best-fit packing of token sequences, bulk-synchronously.

1. Cut. Documents longer than a sequence are cut into full pieces, the first piece taking the rest.
2. Range-sort. Pieces are ordered by (length, task, place in the task). The order is never materialised by moving rows:
   each task counts its pieces by length, the counts of all tasks are summed up per length in a window, and a piece's
   rank within its length is the sum of the earlier tasks plus its place. Sorted pieces, and likewise sorted gaps, are
   thus two lists of runs (size, how many), at most one run per possible length whatever the size of the corpus.
3. Sweep, in bulk-synchronous rounds over the runs. In a round every run of open documents finds its successor among
   the gaps (the smallest gap that holds it) by binary search; where several runs claim one gap run, the longer
   documents rank first and take as many of its sequences as they need, the others try again in the next round; gaps
   are updated and the round repeats until no document finds a gap. Then the longest open documents open sequences of
   their own, as many as there are documents, and the rounds go on.
   Each match is an interval of ranks of one length against an interval of sequences. There are at most a few per
   length, so the plan that the driver computes and broadcasts is bounded by the sequence length, not by the corpus.
4. Distribute. Every task looks its pieces up in the intervals by binary search: sequence and offset.

The rows themselves are shuffled at most once, with narrow columns, to meet their task's rank offsets.

Defined cases: a null text is empty and still has its end token; equal documents and repeated rows are packed each; a
document of any length is cut whole; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import bisect
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from .bpe import encoder_for, prove_whole_tokens
from .common import BYTE_BPE, batch_rows, stored, table, tokenizer_path

END_ID = 2
CAPACITY = 1024


@dataclass(frozen=True)
class Match:
    """`count` documents of a length, from rank `rank`, go to sequences from `sequence` on at `offset`."""

    length: int
    rank: int
    count: int
    sequence: int
    offset: int


def plan_packing(histogram: dict[int, int], capacity: int = CAPACITY) -> list[Match]:
    """Best-fit matches of all documents, given how many there are of each length."""
    open_docs = {n: c for n, c in histogram.items() if c > 0}
    if any(n < 1 or n > capacity for n in open_docs):
        raise ValueError("a piece is empty or longer than a sequence")
    placed: dict[int, int] = defaultdict(int)
    gaps: dict[int, list[tuple[int, int]]] = {}  # size of the gap: (first sequence, how many)
    plan: list[Match] = []
    sequences = 0

    def put(length: int, first: int, count: int, offset: int) -> None:
        plan.append(Match(length, placed[length], count, first, offset))
        placed[length] += count
        open_docs[length] -= count
        if not open_docs[length]:
            del open_docs[length]
        if capacity - offset - length:
            gaps.setdefault(capacity - offset - length, []).append((first, count))

    while open_docs:
        while True:  # rounds: all runs look at the same gaps
            sizes = sorted(gaps)
            claims: dict[int, list[int]] = defaultdict(list)
            for length in sorted(open_docs, reverse=True):
                i = bisect.bisect_left(sizes, length)
                if i < len(sizes):
                    claims[sizes[i]].append(length)
            if not claims:
                break
            for size, lengths in claims.items():
                runs = gaps.pop(size)
                for length in lengths:  # by rank: the longest first
                    while runs and length in open_docs:
                        first, many = runs.pop()
                        taken = min(many, open_docs[length])
                        if taken < many:
                            runs.append((first + taken, many - taken))
                        put(length, first, taken, capacity - size)
                if runs:
                    gaps.setdefault(size, []).extend(runs)
        if open_docs:
            length = max(open_docs)
            count = open_docs[length]
            if 2 * length <= capacity:  # what fits twice opens only as many as it fills
                count = -(-count // (capacity // length))
            put(length, sequences, count, 0)
            sequences += count
    return plan


def cut(total: int, capacity: int = CAPACITY) -> Iterator[tuple[int, int]]:
    """(start, length) of the pieces of a document of that many tokens: full ones, the first one taking the rest."""
    first = total % capacity or min(total, capacity)
    start, length = 0, first
    while start < total:
        yield start, length
        start, length = start + length, capacity


_PIECES = "piece integer, start long, length long, ids_crc32 long, task integer, place long"


def tokenize_and_cut(docs: DataFrame, text: str, keep: tuple[str, ...], capacity: int, end_id: int, with_ids: bool, name: str) -> DataFrame:
    """A row per piece, with its task and its place among the pieces of its length in the task."""
    spark = docs.sparkSession
    batch_rows(spark, 1000)
    whole = spark.sparkContext.broadcast(prove_whole_tokens(tokenizer_path(name)))
    schema = docs.select(*keep).schema
    for column, kind in (x.split() for x in _PIECES.split(", ")):
        schema = schema.add(column, kind, False)
    if with_ids:
        schema = schema.add("ids", "binary", False)
    tail = end_id.to_bytes(4, "little")

    def run(batches):
        encoder = encoder_for(name, whole.value)
        task = TaskContext.get().partitionId()
        seen = [0] * (capacity + 1)
        for batch in batches:
            rows, origin = [], []
            for i, t in enumerate(batch.column(len(keep)).to_pylist()):
                ids = encoder.encode(t) + tail
                for k, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                    part = ids[4 * start : 4 * (start + length)]
                    rows.append((k, start, length, zlib.crc32(part), task, seen[length], part))
                    origin.append(i)
                    seen[length] += 1
            columns = list(zip(*rows)) if rows else [()] * 7
            taken = [c.take(pa.array(origin, pa.int64())) for c in batch.columns[: len(keep)]]
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds)][: 7 if with_ids else 6]
            yield pa.RecordBatch.from_arrays([*taken, *arrays], schema.names)

    return docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("__text")).mapInArrow(run, schema)


def place_pieces(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Pieces (length, task, place and any other columns; read twice, so a stored table) with sequence_id and offset."""
    spark = pieces.sparkSession
    counts = pieces.groupBy("length", "task").agg(F.max("place").alias("n")).withColumn("n", F.col("n") + 1)
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = stored(counts.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))), "pack-offsets")
    histogram = {r.length: r.n for r in offsets.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = spark.sparkContext.broadcast(_lookup(plan_packing(histogram, capacity)))

    @F.pandas_udf("sequence_id long, offset long")
    def where(columns: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        keys, firsts, sequences, offset = plan.value
        for length, rank in columns:
            key = (length.to_numpy().astype(np.int64) << 48) + rank.to_numpy()
            i = np.searchsorted(keys, key, "right") - 1
            yield pd.DataFrame({"sequence_id": sequences[i] + (key - firsts[i]), "offset": offset[i]})

    ranked = pieces.join(offsets.select("length", "task", "before"), ["length", "task"]).withColumn("__rank", F.col("before") + F.col("place"))
    placed = ranked.withColumn("__at", where("length", "__rank"))
    return placed.select("*", "__at.sequence_id", "__at.offset").drop("__at", "__rank", "before", "task", "place")


def _lookup(plan: list[Match]) -> tuple[np.ndarray, ...]:
    plan = sorted(plan, key=lambda m: (m.length, m.rank))
    firsts = np.array([(m.length << 48) + m.rank for m in plan], np.int64)
    return firsts, firsts, np.array([m.sequence for m in plan], np.int64), np.array([m.offset for m in plan], np.int64)


def pack(
    docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), capacity: int = CAPACITY, end_id: int = END_ID,
    with_ids: bool = False, name: str = BYTE_BPE,
) -> DataFrame:
    """`keep` columns, piece, start, length, ids_crc32, sequence_id, offset, and the ids if asked for."""
    cut_ = stored(tokenize_and_cut(docs, text, keep, capacity, end_id, with_ids, name), "pack-pieces")
    return place_pieces(cut_, capacity)


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents")).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )

