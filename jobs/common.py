"""What the jobs share: configuration, texts as sparse profiles, and logging."""

from __future__ import annotations

import hashlib
import json
import logging
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from annolith.operators.kernels import matrix

#: A word: a run of characters other than the white space of ASCII.
WORD = r"[^\x20\x09-\x0D]+"
#: Characters of the texts whose words one task counts, groups and sorts.
TASK_CHARACTERS = 4 << 20


def configuration(name: str, path: str | None = None, **given) -> dict:
    """The settings in the file beside the jobs, or another one, with those given instead. Read where the job is started."""
    with open(path or os.path.join(os.path.dirname(os.path.abspath(__file__)), f"{name}.json")) as f:
        known = json.load(f)
    unknown = sorted({*given} - {*known})
    if unknown:
        raise ValueError(f"no such settings: {', '.join(unknown)}")
    return {**known, **given}


def logger(name: str) -> logging.Logger:
    return logging.getLogger(f"jobs.{name}")


def words_of(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, word, n: how often a document has a word. Rows with the same key are one document; those without a key are left out."""
    texts = documents.where(F.col(key).isNotNull()).select(key, text)
    # texts are dealt once, and are smaller than their words; whatever is grouped by key then is where it has to be
    size = texts.agg(F.sum(F.length(text))).first()[0] or 0
    texts = texts.repartition(max(texts.sparkSession.sparkContext.defaultParallelism, -(-size // TASK_CHARACTERS)), key)
    words = texts.select(key, F.explode(F.regexp_extract_all(F.col(text), F.lit(WORD), F.lit(0))).alias("word"))
    return words.groupBy(key, "word").agg(F.count("*").alias("n"))


def place_counts(documents: DataFrame, places: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, counts: of each document (rows with the same key are one) how many of its words have one of so many places, by hash of the word;
    other engines can compute it as well. Words are counted where the texts are read, and only the counts are dealt by key. A row without a key is left out."""

    def count(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), _rows(_count_words(batch.column(1), places))], [key, "counts"])

    def add(batches):
        """Rows of one key follow each other; the last may go on in the next batch."""
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, counts = batch.column(0), matrix(batch.column(1), places).astype(np.int64)
            if last is not None:
                keys, counts = pa.concat_arrays([last[0], keys]), np.concatenate([last[1], counts])
            starts = np.append(0, np.flatnonzero(pc.not_equal(keys[1:], keys[:-1]).to_numpy(zero_copy_only=False)) + 1)
            keys, counts = keys.take(pa.array(starts)), np.add.reduceat(counts, starts, axis=0)
            yield pa.RecordBatch.from_arrays([keys[:-1], _rows(counts[:-1])], [key, "counts"])
            last = keys[-1:], counts[-1:]
        if last is not None:
            yield pa.RecordBatch.from_arrays([last[0], _rows(last[1])], [key, "counts"])

    texts = documents.where(F.col(key).isNotNull()).select(key, text)
    schema = T.StructType([T.StructField(key, documents.schema[key].dataType), T.StructField("counts", T.ArrayType(T.LongType()))])
    return texts.mapInArrow(count, schema).repartition(key).sortWithinPartitions(key).mapInArrow(add, schema)


#: Bytes of text whose words a task has side by side.
_PIECE = 8 << 20
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def _count_words(texts: pa.Array, places: int) -> np.ndarray:
    """Texts x places. Some texts at a time, a very long one in pieces."""
    counts = np.zeros((len(texts), places), np.int64)
    size = pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    group = (np.cumsum(size) - size) // _PIECE
    starts = np.append(np.flatnonzero(np.append(True, group[1:] != group[:-1])), len(texts)) if len(texts) else [0]
    for a, b in zip(starts[:-1], starts[1:]):
        if size[a:b].max() <= _PIECE:
            counts[a:b] = _count_places(texts[a:b], places)
            continue
        for row in range(a, b):
            for piece in _pieces(texts.view(pa.binary())[row].as_py()):
                counts[row] += _count_places(pa.array([piece], pa.binary()).view(pa.string()), places)[0]
    return counts


def _pieces(text: bytes | None):
    at = 0
    while text is not None and at < len(text):
        cut = _SPACE.search(text, at + _PIECE)
        end = cut.start() if cut else len(text)
        yield text[at:end]
        at = end


def _count_places(texts: pa.Array, places: int) -> np.ndarray:
    """Each different word is hashed once."""
    words = pc.ascii_split_whitespace(texts)  # as WORD, but for empty words at the ends
    row = np.repeat(np.arange(len(texts)), pc.list_value_length(words).fill_null(0).to_numpy(zero_copy_only=False))
    coded = words.flatten().dictionary_encode()
    known = coded.dictionary.view(pa.binary()).to_numpy(zero_copy_only=False)
    place = np.frombuffer(b"".join([hashlib.md5(w, usedforsecurity=False).digest() for w in known]), ">u4")[::4].astype(np.int64) % places
    code = coded.indices.to_numpy(zero_copy_only=False)
    real = (known != b"")[code]
    row, code = row[real], code[real]
    return np.bincount(row * places + place[code], minlength=len(texts) * places).reshape(len(texts), places)


def _rows(counts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(counts) + 1) * counts.shape[1], pa.int32()), pa.array(counts.ravel()))
