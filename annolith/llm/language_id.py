"""Language identification by string kernels.

The kernel of two texts is the blended spectrum of character n-grams (n = 1, 2, 3) by presence: the number of n-grams
both have, over the geometric mean of how many each has. n-grams are hashed to SLOTS places. Texts are mapped to the
kernel values with m landmark texts and whitened (Nystroem), and one ridge regression per language (+1 against -1) is
solved in that space. Whitening and regression fold into one m x languages matrix, so a batch of texts is scored by two
matrix products: presence x landmarks and kernel x weights. A text longer than BLOCK characters is scored in blocks, all
of them, and its score is their mean by length: the places of one set of n-grams would fill up, and any text then look
the same.

Fitting sees a bounded sample, TRAIN_PER_LANGUAGE texts of every language at most, those of the smallest hash of their
row (of a text longer than a block, one block, by the same hash); only their presence bits (SLOTS / 8 bytes each) are
ranked and come to the driver, never the texts.

Defined cases: a null text or one without a letter is `und` with score 0; equal scores go to the first language in
alphabetical order; a training set without any labelled text makes everything `und`; texts are read whole, however long;
repeated rows are scored each, and of those with one hash the sample takes any; an empty table gives an empty result;
other columns are ignored, whatever they are called.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import batch_rows, table

SLOTS = 1 << 14
ORDERS = 3
TRAIN_PER_LANGUAGE = 400
LANDMARKS_PER_LANGUAGE = 24
RIDGE = 1e-2
#: Characters scored together.
BLOCK = 1 << 14
#: Rows scored by one matrix product.
_ROWS = 256
_LETTER = regex.compile(r"\p{L}")


def presence(text: str) -> np.ndarray:
    """Places of the n-grams of a text, each once."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    bits = np.zeros(SLOTS, bool)
    key = np.zeros(len(c), np.uint32)
    for n in range(min(ORDERS, len(c))):
        key = key[: len(c) - n] * np.uint32(0x9E3779B1) + c[n:]
        bits[((key ^ (key >> np.uint32(15))) * np.uint32(0x85EBCA6B)) >> np.uint32(18)] = True
    return bits


def blocks(text: str) -> list[str]:
    """A text in parts of about equal length, none longer than BLOCK."""
    n = max(1, -(-len(text) // BLOCK))
    size = -(-len(text) // n) or 1
    return [text[i : i + size] for i in range(0, len(text), size)] or [""]


@dataclass
class LanguageModel:
    languages: list[str]
    landmarks: np.ndarray  # SLOTS x m, columns divided by the root of their size
    weights: np.ndarray  # m x languages

    def scores(self, bits: np.ndarray) -> np.ndarray:
        size = np.sqrt(np.maximum(1, bits.sum(axis=1, dtype=np.float32)))[:, None]
        return (bits.astype(np.float32) @ self.landmarks) / size @ self.weights

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        names, confidence = ["und"] * len(texts), np.zeros(len(texts))
        if not self.languages:
            return names, confidence
        parts = [(i, b) for i, t in enumerate(texts) if t and _LETTER.search(t) for b in blocks(t)]
        total = np.zeros((len(texts), len(self.languages)))
        for lo in range(0, len(parts), _ROWS):
            some = parts[lo : lo + _ROWS]
            s = self.scores(np.stack([presence(b) for _, b in some]))
            np.add.at(total, [i for i, _ in some], s * np.array([[len(b) / len(texts[i])] for i, b in some]))
        for i in {i for i, _ in parts}:
            best = int(total[i].argmax())
            names[i] = self.languages[best]
            confidence[i] = min(1.0, max(0.0, (float(total[i, best]) + 1) / 2))
        return names, confidence


def fit(bits: np.ndarray, labels: list[str]) -> LanguageModel:
    """Kernel ridge regression on Nystroem features."""
    languages = sorted(set(labels))
    if not languages:
        return LanguageModel([], np.zeros((SLOTS, 0), np.float32), np.zeros((0, 0), np.float32))
    y = np.array([languages.index(x) for x in labels])
    chosen = np.concatenate([np.flatnonzero(y == k)[:LANDMARKS_PER_LANGUAGE] for k in range(len(languages))])
    marks = bits[chosen].astype(np.float64)
    marks = (marks / np.sqrt(np.maximum(1, marks.sum(axis=1)))[:, None]).T
    k_nm = bits.astype(np.float64) @ marks / np.sqrt(np.maximum(1, bits.sum(axis=1)))[:, None]
    values, vectors = np.linalg.eigh(marks.T @ marks)
    good = values > 1e-8 * values.max()
    whiten = vectors[:, good] / np.sqrt(values[good])
    phi = k_nm @ whiten
    target = np.where(y[:, None] == np.arange(len(languages)), 1.0, -1.0)
    # languages weigh alike however many texts they have
    balance = (1 / np.bincount(y)[y])[:, None]
    w = np.linalg.solve(phi.T @ (balance * phi) + RIDGE * np.eye(phi.shape[1]), phi.T @ (balance * target))
    return LanguageModel(languages, marks.astype(np.float32), (whiten @ w).astype(np.float32))


def train(labelled: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> LanguageModel:
    """Fit on a bounded sample. `key` only deals rows into the sample, by its hash."""
    spark = labelled.sparkSession
    batch_rows(spark, 1000)
    hashed = F.pmod(F.xxhash64(F.col(key).cast("string"), F.col(text), F.lit("lid")), F.lit(1 << 30))
    rows = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("l"), F.col(text).alias("t"), hashed.alias("h"))
    totals = {r.l: r.n for r in rows.groupBy("l").agg(F.count("*").alias("n")).collect()}
    if not totals:
        return fit(np.zeros((0, SLOTS), bool), [])
    # a share of the hash range that is sure to hold the sample, of which the first rows by hash are taken
    wide = TRAIN_PER_LANGUAGE + 6 * TRAIN_PER_LANGUAGE**0.5
    share = F.create_map(*[F.lit(x) for l, n in totals.items() for x in (l, int(min(1.0, wide / n) * (1 << 30)))])

    def bits(batches):
        for batch in batches:
            kept = []
            for l, t, h in zip(*(c.to_pylist() for c in batch.columns)):
                if _LETTER.search(t):
                    parts = blocks(t)
                    kept.append((l, np.packbits(presence(parts[h % len(parts)])).tobytes(), h))
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[0] for x in kept], pa.string()), pa.array([x[1] for x in kept], pa.binary()), pa.array([x[2] for x in kept], pa.int64())],
                ["l", "b", "h"],
            )

    sample = rows.where(F.col("h") < F.try_element_at(share, F.col("l"))).mapInArrow(bits, "l string, b binary, h long")
    first = F.row_number().over(Window.partitionBy("l").orderBy("h", "b"))
    drawn = sorted(sample.withColumn("n", first).where(F.col("n") <= TRAIN_PER_LANGUAGE).collect(), key=lambda r: (r.h, r.l, bytes(r.b)))
    data = [np.unpackbits(np.frombuffer(bytes(r.b), np.uint8)).astype(bool) for r in drawn]
    return fit(np.stack(data) if data else np.zeros((0, SLOTS), bool), [r.l for r in drawn] if data else [])


def identify(docs: DataFrame, model: LanguageModel, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep` columns, lang_pred, score. One pass without a shuffle; the model's size is bounded."""
    batch_rows(docs.sparkSession, 1000)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.select(*keep).schema.add("lang_pred", "string", False).add("score", "double", False)

    def run(batches):
        for batch in batches:
            names, confidence = shared.value.predict(batch.column(len(keep)).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(names, pa.string()), pa.array(confidence, pa.float64())], schema.names)

    return docs.select(*keep, F.col(text).alias("__text")).mapInArrow(run, schema)


def held_out(doc_id: Column) -> Column:
    """The contract's fold: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs.where(~held_out(F.col("doc_id"))))
    return identify(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
