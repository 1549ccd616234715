"""Operator 12, suffix-array dedup: what occurs twice or more anywhere, of at least 200 bytes, is removed everywhere.

A window is a string of 200 bytes. Equal windows have equal anchors: the place in the window where the hash of the
following 60 bytes is smallest. Consecutive windows of a text with one anchor are a stretch (70 windows, 270 bytes on average), and windows of
different anchors' hashes cannot be equal, so the work is:

1. Equal texts become one row; if there were two or more of them, all their bytes are covered. Texts are stored once,
   bucketed; what follows comes to them, and they are not shuffled again.
2. Anchors whose hash occurs once are done: no other window can equal theirs. Of the others the stretches are cut out.
3. Equal stretches become one row; if there were two or more, all their windows are repeated.
4. The different stretches of an anchor are put, with those of other anchors, into blocks of about a megabyte; the suffix array of a
   block, by two-stage sorting, brings equal windows together, and adjacent common prefixes of 200 bytes tell them.
   An anchor with more than 2,000 different stretches (near copies, or the edges of a passage of countless documents)
   would not be bounded: its windows are counted by their digests instead, aggregated before the shuffle.
5. Repeated windows go back to the texts, which lose the bytes they cover.

The result depends on no hash: anchors only decide who meets, stretches and texts are told by digests of 128 and 256 bits, windows by
their bytes or digests of 256 bits.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import RAW_FILES
from .common import as_row, batch_rows, lookup, scratch, stored, table
from .suffix_array import common_prefixes, suffix_array

LENGTH = 200
#: Bytes whose hash places an anchor, of a window of 200.
GRAM = 60
#: Bytes of text in one group of texts, and groups in which a table is bucketed at most.
GROUP_BYTES, BUCKETS = 4 << 20, 1 << 16
#: Bytes of stretches in a block that is suffix-sorted, and stretches of an anchor up to which it is.
BLOCK_BYTES, STRETCHES = 1 << 20, 2000
#: Bytes of text hashed at a time; positions in them have _BITS bits.
_SEGMENT, _BITS = 1 << 20, 24
#: Digests of texts that a task remembers.
_SEEN = 1 << 17

_RNG = np.random.default_rng(12)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


class _Powers:
    """Powers of the base and of its inverse, as many as were asked for."""

    up = down = np.zeros(0, np.uint64)

    @classmethod
    def get(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            cls.up, cls.down = (np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, b, np.uint64)])) for b in (_BASE, _INVERSE))
        return cls.up[:n], cls.down[:n]


def gram_hashes(b: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """A hash of the `gram` bytes from each position on."""
    up, down = _Powers.get(len(b) + 1)
    sums = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(_BYTE[b] * up[:-1], out=sums[1:])
    h = (sums[gram:] - sums[:-gram]) * down[: len(b) - gram + 1]
    h ^= h >> np.uint64(30)
    h *= _M1
    h ^= h >> np.uint64(27)
    h *= _M2
    return h ^ (h >> np.uint64(31))


def anchors_of(b: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Of texts [start, end) that follow each other in b: text number, first window (place in b), windows, anchor (place
    in b) and its hash for every run of windows with one anchor. What is an anchor depends on the window's bytes alone."""
    found = [x for lo, end in _segments(starts, ends) for x in _anchors(b, lo, end, starts, length, gram)]
    if not found:
        return (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),)
    lo, n, at, h = (np.concatenate(x) for x in zip(*found))
    text = np.searchsorted(starts, lo, side="right") - 1
    n = np.minimum(n, ends[text] - length + 1 - lo)
    inside = n > 0
    return text[inside], lo[inside], n[inside], at[inside], h[inside]


def _segments(starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, int]]:
    """Texts together of about a segment, from the start of the first to the end of the last."""
    k = 0
    while k < len(starts):
        last = max(k + 1, int(np.searchsorted(ends, starts[k] + _SEGMENT, side="right")))
        yield int(starts[k]), int(ends[last - 1])
        k = last


def _anchors(b: np.ndarray, lo: int, end: int, starts: np.ndarray, length: int, gram: int) -> Iterator[tuple[np.ndarray, ...]]:
    w = length - gram + 1
    while lo + length <= end:
        part = b[lo : min(lo + _SEGMENT + length - 1, end)]
        h, n = gram_hashes(part, gram), len(part) - length + 1
        blocks = -(-len(h) // w)
        grid = np.full(blocks * w, np.iinfo(np.uint64).max)
        grid[: len(h)] = (h >> np.uint64(_BITS)) << np.uint64(_BITS) | np.arange(len(h), dtype=np.uint64)
        grid = grid.reshape(blocks, w)
        left = np.minimum.accumulate(grid, axis=1).ravel()
        right = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
        at = (np.minimum(right[:n], left[w - 1 : w - 1 + n]) & np.uint64((1 << _BITS) - 1)).astype(np.int64)
        new = np.concatenate([[True], at[1:] != at[:-1]])
        new[starts[np.searchsorted(starts, lo) : np.searchsorted(starts, lo + n)] - lo] = True
        first = np.flatnonzero(new)
        yield first + lo, np.diff(np.concatenate([first, [n]])), at[first] + lo, h[at[first]]
        lo += n


def _texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of a binary column, and where its values start and end."""
    a = column.cast(pa.large_binary())
    offsets = np.frombuffer(a.buffers()[1], np.int64)[a.offset : a.offset + len(a) + 1] if len(a) else np.zeros(1, np.int64)
    data = np.frombuffer(a.buffers()[2], np.uint8) if a.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data, offsets[:-1], offsets[1:]


# ---- the passes


def _first_of_copies(groups: int):
    """Rows (b, sha, n, text): per task the first text of equal ones, and at the end how many more there were."""

    def run(batches):
        seen: dict[bytes, int] = {}

        def more():
            again = [(k, n) for k, n in seen.items() if n]
            seen.clear()
            shas = [k for k, _ in again]
            yield record(shas, [n for _, n in again], pa.nulls(len(again), pa.binary()))

        def record(shas, counts, texts):
            b = np.array([int.from_bytes(k[:8], "little") % groups for k in shas], np.int64)
            return pa.RecordBatch.from_arrays([pa.array(b), pa.array(shas, pa.binary()), pa.array(counts, pa.int64()), texts], ["b", "sha", "n", "text"])

        for batch in batches:
            keep = []
            for i, k in enumerate(batch.column(1).to_pylist()):
                if k in seen:
                    seen[k] += 1
                else:
                    seen[k] = 0
                    keep.append(i)
            rows = batch.take(pa.array(keep, pa.int64()))
            yield record(rows.column(1).to_pylist(), [1] * len(keep), rows.column(0))
            if len(seen) > _SEEN:
                yield from more()
        yield from more()

    return run


def _bucketed(rows: DataFrame, by: str, buckets: int) -> tuple[DataFrame, str]:
    """rows stored as a table of the session whose files are dealt by the hash of a column, and its name."""
    spark = rows.sparkSession
    name = f"annolith_texts_{uuid.uuid4().hex}"
    path = f"{scratch(spark)}/{name}"
    options = {**(RAW_FILES if path.startswith("file:") else {}), "path": path, "compression": "zstd"}
    rows.repartition(buckets, by).write.format("parquet").options(**options).bucketBy(buckets, by).saveAsTable(name)
    return spark.table(name), name


def _anchor_rows(length: int, gram: int):
    def run(batches):
        for batch in batches:
            data, starts, ends = _texts(batch.column(1))
            text, _, _, _, h = anchors_of(data, starts, ends, length, gram)
            b = batch.column(0).to_numpy()[text]
            order = np.lexsort((h, b))
            b, h = b[order], h[order]
            first = np.flatnonzero(np.concatenate([[True], (b[1:] != b[:-1]) | (h[1:] != h[:-1])])) if len(b) else np.zeros(0, np.int64)
            n = np.diff(np.concatenate([first, [len(b)]]))
            yield pa.RecordBatch.from_arrays([pa.array(b[first]), pa.array(h[first].view(np.int64)), pa.array(n)], ["b", "h", "n"])

    return run


_PIECES = "b long, h long, key binary, at int, windows int, bytes binary, texts array<int>, places array<long>"


def _cut(length: int, gram: int):
    """The stretches of a group of texts whose anchors occur elsewhere too, equal ones as one row with all their places."""

    def run(key: tuple[pa.Scalar, ...], texts: pa.Table, wanted: pa.Table) -> pa.Table:
        found: dict[bytes, list] = {}
        if texts.num_rows and wanted.num_rows:
            texts = texts.sort_by("sha")
            hashes = np.unique(wanted.column("h").to_numpy()).view(np.uint64)
            hashes.sort()
            data, starts, ends = _texts(texts.column("text").combine_chunks())
            text, lo, n, at, h = anchors_of(data, starts, ends, length, gram)
            place = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
            mine = hashes[place] == h
            raw = data.tobytes()
            values = zip(text[mine].tolist(), lo[mine].tolist(), n[mine].tolist(), (at - lo)[mine].tolist(), h[mine].view(np.int64).tolist(), starts[text[mine]].tolist())
            for t, a, w, off, hash_, start in values:
                s = raw[a : a + w + length - 1]
                k = hashlib.blake2b(s, digest_size=16, salt=off.to_bytes(4, "little")).digest()
                row = found.get(k)
                if row is None:
                    row = found[k] = [hash_, k, off, w, s, [], []]
                row[5].append(t)
                row[6].append(a - start)
        columns = list(zip(*found.values())) if found else [[]] * 7
        kinds = [pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int64())]
        names = [x.split()[0] for x in _PIECES.split(", ")]
        return pa.table([pa.array([key[0].as_py()] * len(found), pa.int64()), *[pa.array(c, t) for c, t in zip(columns, kinds)]], names)

    return run


def repeated_windows(pieces: list[bytes], windows: np.ndarray, length: int = LENGTH) -> list[np.ndarray]:
    """Per stretch whether each of its windows occurs in another one too, by the suffix array of them all."""
    t = np.frombuffer(b"".join(pieces), np.uint8)
    starts = np.concatenate([[0], np.cumsum([len(p) for p in pieces])]).astype(np.int64)
    wanted = np.zeros(len(t), bool)
    for lo, n in zip(starts, windows):
        wanted[lo : lo + n] = True
    order = suffix_array(t, length, wanted)
    same = common_prefixes(t, order, length) >= length
    repeated = np.zeros(len(t), bool)
    repeated[order[1:][same]] = True
    repeated[order[:-1][same]] = True
    return [repeated[lo : lo + n] for lo, n in zip(starts, windows)]


def _runs(flags: np.ndarray) -> list[list[int]]:
    """[start, end) of the runs of true."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.view(np.int8), [0]])))
    return edge.reshape(-1, 2).tolist()


_VERDICT = "key binary, runs array<array<int>>"


def _sort_block(length: int):
    def run(key: tuple[pa.Scalar, ...], block: pa.Table) -> pa.Table:
        n, own = block.column("n").to_numpy(), block.column("windows").to_numpy()
        flags = repeated_windows(block.column("bytes").to_pylist(), own, length)
        found = [(k, _runs(f | (c > 1))) for k, f, c in zip(block.column("key").to_pylist(), flags, n)]
        found = [x for x in found if x[1]]
        return pa.table([pa.array([k for k, _ in found], pa.binary()), pa.array([r for _, r in found], pa.list_(pa.list_(pa.int32())))], ["key", "runs"])

    return run


def _many_windows(pieces: DataFrame, length: int) -> DataFrame:
    """The verdict on stretches of anchors that have too many for one block, by counting their windows. `n` counts equal stretches."""
    every = pieces.select("key", "n", "bytes", F.explode(F.sequence(F.lit(0), F.col("windows") - 1)).alias("i"))
    every = stored(every.select("key", "n", "i", F.unhex(F.sha2(F.substring("bytes", F.col("i") + 1, F.lit(length)), 256)).alias("w")), "windows")
    counts = every.groupBy("w").agg(F.sum("n").alias("times"), F.count("*").alias("rows"))
    counts = stored(counts.where("times > 1"), "repeated-windows")
    found = lookup(every, counts, "w", "rows", ["key", "i"]).where("times IS NOT NULL")
    return found.groupBy("key").agg(F.transform(F.collect_list("i"), lambda i: F.array(i, i + 1)).alias("runs"))


def _cover(length: int):
    """Per text with removed bytes: its digest, the spans removed, and the digest of what is left. Of a text with copies all goes."""

    def run(key: tuple[pa.Scalar, ...], texts: pa.Table, runs: pa.Table) -> pa.Table:
        out = [[], [], [], [], []]
        if texts.num_rows:
            texts = texts.sort_by("sha")
            data, starts, ends = _texts(texts.column("text").combine_chunks())
            copies = texts.column("copies").to_numpy()
            cover = np.zeros(len(data) + 1, np.int32)
            if runs.num_rows:
                base = starts[runs.column("t").to_numpy()]
                np.add.at(cover, base + runs.column("lo").to_numpy(), 1)
                np.add.at(cover, base + runs.column("hi").to_numpy() + length - 1, -1)
            gone = np.cumsum(cover[:-1]) > 0
            for t, own in enumerate(copies > 1):
                if own:
                    gone[starts[t] : ends[t]] = True
            shas = texts.column("sha").combine_chunks()
            for t in np.union1d(runs.column("t").to_numpy(), np.flatnonzero(copies > 1)).astype(int).tolist():
                own = gone[starts[t] : ends[t]]
                out[0].append(shas[t].as_py())
                out[1].append(int(copies[t]))
                out[2].append(int(own.sum()))
                out[3].append(_runs(own))
                out[4].append(hashlib.sha256(data[starts[t] : ends[t]][~own].tobytes()).hexdigest())
        kinds = [pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.list_(pa.int64())), pa.string()]
        return pa.table([pa.array(c, k) for c, k in zip(out, kinds)], ["sha", "copies", "n_removed", "spans", "kept_sha256"])

    return run


def find_repeats(texts: DataFrame, length: int = LENGTH, gram: int | None = None, stretches: int = STRETCHES) -> DataFrame:
    """Of a column `text` of bytes, per different text of which something is removed: sha (its SHA-256), copies, n_removed,
    spans (array of [start, end) in bytes), kept_sha256. A stored table."""
    spark = texts.sparkSession
    gram = gram or max(1, min(GRAM, length * 3 // 10))
    batch_rows(spark, 1000)
    rows = texts.where(F.octet_length("text") >= length)
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = max(1, total // GROUP_BYTES)
    buckets = min(groups, BUCKETS)
    firsts = rows.select("text", F.unhex(F.sha2("text", 256)).alias("sha")).mapInArrow(_first_of_copies(groups), "b long, sha binary, n long, text binary")
    dealt = firsts.repartition(buckets, "b").groupBy("b", "sha").agg(F.sum("n").alias("copies"), F.first("text", ignorenulls=True).alias("text"))
    held, name = _bucketed(dealt, "b", buckets)

    anchors = stored(held.select("b", "text").mapInArrow(_anchor_rows(length, gram), "b long, h long, n long"), "anchors")
    counts = anchors.groupBy("h").agg(F.sum("n").alias("times"), F.count("*").alias("rows")).where("times > 1")
    wanted = lookup(anchors, stored(counts, "repeated-anchors"), "h", "rows", ["b"]).where("times IS NOT NULL").select("b", "h")
    pieces = stored(held.select("b", "sha", "text").groupBy("b").cogroup(wanted.groupBy("b")).applyInArrow(_cut(length, gram), _PIECES), "stretches")

    different = pieces.groupBy("key").agg(
        F.sum(F.size("texts")).alias("n"), F.first("h").alias("h"), F.first("windows").alias("windows"), F.first("bytes").alias("bytes"), F.count("*").alias("rows")
    )
    different = stored(different, "different-stretches")
    of_anchor = different.groupBy("h").agg(F.count("*").alias("members"))
    known = lookup(different, stored(of_anchor.withColumn("rows", F.col("members")), "anchors-stretches"), "h", "rows", ["key"])
    known = stored(known, "stretches-to-compare")
    all_windows = F.array(F.array(F.lit(0), F.col("windows")))
    alone = known.where("members = 1 AND n > 1").select("key", all_windows.alias("runs"))
    size = known.where(F.col("members").between(2, stretches)).agg(F.sum(F.octet_length("bytes"))).first()[0] or 0
    block = F.pmod(F.xxhash64("h"), F.lit(max(1, size // BLOCK_BYTES)))
    sorted_ = known.where(F.col("members").between(2, stretches)).select(block.alias("block"), "key", "n", "windows", "bytes")
    verdict = alone.unionByName(sorted_.groupBy("block").applyInArrow(_sort_block(length), _VERDICT))
    verdict = verdict.unionByName(_many_windows(known.where(F.col("members") > stretches), length))
    verdict = stored(verdict.join(known.select("key", "rows"), "key"), "verdicts")

    hit = lookup(pieces.select("b", "key", "texts", "places"), verdict, "key", "rows", ["b", "key"]).where("runs IS NOT NULL")
    hit = hit.select("b", "runs", F.explode(F.arrays_zip("texts", "places")).alias("p")).select("b", F.col("p.texts").alias("t"), F.col("p.places").alias("p"), F.explode("runs").alias("r"))
    hit = hit.select("b", "t", (F.col("p") + F.col("r")[0]).alias("lo"), (F.col("p") + F.col("r")[1]).alias("hi"))
    covered = held.groupBy("b").cogroup(hit.groupBy("b")).applyInArrow(_cover(length), "sha binary, copies long, n_removed long, spans array<array<long>>, kept_sha256 string")
    found = stored(covered, "repeats")
    spark.sql(f"DROP TABLE {name}")
    return found


def repeat_spans(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), length: int = LENGTH, **how) -> DataFrame:
    """`keep` columns, n_bytes, n_removed, n_spans, spans (removed, as [start, end) in bytes of the UTF-8 text),
    kept_sha256, for every row.

    A null text is an empty one; texts shorter than a window lose nothing; of repeated rows and equal texts of a window or
    more nothing is left, as each occurs elsewhere. Ids are not used: they may be null or equal. A table without rows gives none. Columns of other
    names than `keep` and `text` play no part."""
    raw = F.coalesce(docs[f"`{text}`"].cast("binary"), F.lit(b""))
    found = find_repeats(docs.select(raw.alias("text")), length, **how)
    rows = docs.select(*[docs[f"`{c}`"] for c in keep], F.octet_length(raw).cast("long").alias("n_bytes"), F.sha2(raw, 256).alias("__sha256"))
    rows = rows.withColumn("__sha", F.unhex("__sha256"))
    spread = ["__sha", *[c for c in keep if dict(docs.dtypes)[c] in ("bigint", "int", "string")]]
    rows = lookup(rows, found.withColumnRenamed("sha", "__sha"), "__sha", "copies", spread)
    none = F.expr("cast(array() as array<array<bigint>>)")
    return rows.select(
        *keep, "n_bytes", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"), F.coalesce(F.size("spans").cast("long"), F.lit(0).cast("long")).alias("n_spans"),
        F.coalesce("spans", none).alias("spans"), F.coalesce("kept_sha256", "__sha256").alias("kept_sha256"),
    )


def without_repeats(docs: DataFrame, text: str = "text", length: int = LENGTH, **how) -> DataFrame:
    """The documents in their own columns, the text without what occurs elsewhere too; a character that is cut in two goes."""

    @F.udf("string", useArrow=True)
    def left(t, spans):
        if t is None:
            return None
        raw, at, parts = t.encode(), 0, []
        for a, b in spans:
            parts.append(raw[at:a])
            at = b
        return b"".join([*parts, raw[at:]]).decode(errors="ignore")

    found = repeat_spans(as_row(docs, text), "__in", ("__row", "__in"), length, **how)
    new = F.when(F.size("spans") == 0, F.col("__in")).otherwise(left("__in", "spans"))
    return found.select(F.col("__row").withField(text, new).alias("__row")).select("__row.*")


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row of `documents`."""
    return repeat_spans(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
