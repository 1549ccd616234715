"""Near-duplicate classes: improved consistent weighted sampling over TF-IDF shingles, banded, verified exactly.

1. Words are the lower-cased runs of letters, digits and non-ASCII characters. Texts with equal words are one node,
   named by a 128-bit digest. The same pass counts, over all documents, in how many of them each shingle occurs; counts
   are kept by hash in DF_SLOTS places, so the table has a fixed size at any scale.
2. A shingle is 5 consecutive words (all words of a shorter text). Its weight is tf * (1 + IDF_GAIN * idf), idf being
   the logarithm of its document share, scaled to 0..1. The gain is small on purpose: with full idf the shingles of a
   large group of near copies would weigh next to nothing against the few words in which the copies differ, and the
   weighted similarity of copies would fall far below the plain one.
3. Each node is sampled by BANDS * ROWS improved consistent weighted samples (random numbers by hash from a table) and
   falls into BANDS buckets.
4. The leader of a bucket is the node that shares most places in buckets with others: in a group of near copies that is
   their original, in all its buckets, while two copies are often too far from each other. Each node of a bucket is
   compared with its leader: weighted Jaccard of the whole shingle sets, SIMILARITY or more makes a link. A leader of
   very many nodes is copied to as many tasks as they need.
5. A node that is not in its leader's component may still be linked to others of the bucket. Where that leaves many
   comparisons, each bucket's hub is looked for: the node whose samples agree most with a block of the bucket's unlinked
   nodes. All unlinked nodes are verified against it, and this is repeated while it links any. What is still unlinked is
   compared with every node of the bucket that
   is in another component, in blocks dealt out as a grid: all these pairs are verified in place, those whose samples
   agree most first, and only links leave the task. No bucket, partner or candidate is capped, no pair of a group is
   emitted unless it is a link or a node with its hub.
6. Classes are the connected components of the links, with all copies of each node. The class id is the smallest doc_id.

Defined cases: a text without words (null, empty) is a class of its own; repeated rows share a class; a null doc_id
counts for nothing in the smallest id, and a class without any id has a null class id; an id may stand for several
different texts, each of which is classed; texts are compared whole; an empty table gives an empty result; other columns
are ignored. Ids are integers; others are an error.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.taskcontext import TaskContext

from .common import as_row, batch_rows, lookup, stored, table
from .decontaminate import split_words
from .graph import components

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 20, 6
DF_SLOTS = 1 << 18
IDF_GAIN = 0.25
#: Document share at and below which idf is 1.
RARE = 1e-4
#: Rows of the table of random numbers; with more of them it no longer stays in a core's cache.
_TABLE = 1 << 12
#: Share of samples (three standard deviations under the threshold) that agree for a node to count for a hub of step 5.
_AGREE = 0.8 - 3 * (0.8 * 0.2 / (BANDS * ROWS)) ** 0.5
#: Members of a leader verified in one task, and the side of a block of step 5.
_PER_TASK, _BLOCK = 400, 1500
#: Bytes of text on a side of such a block.
_BLOCK_BYTES = 8 << 20
#: Leaders of more than _PER_TASK nodes up to which their list is broadcast.
_BROADCAST = 200_000
#: Comparisons of unlinked nodes with those of their buckets up to which step 5 goes without hubs.
_FEW = 5_000_000
#: Word hashes and digests that a worker remembers.
_WORDS_KEPT = 1 << 16


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= _WORDS_KEPT:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


_hashes = _WordHashes()
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M2
    return x ^ (x >> np.uint64(29))


def shingles(words: list[bytes], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes and how often each occurs."""
    if not words:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    w = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    k = min(size, len(w))
    h = np.full(len(w) - k + 1, k, np.uint64)
    for j in range(k):
        h = h * _M1 + w[j : len(w) - k + 1 + j]
    return np.unique(_mix(h), return_counts=True)


def digest_of(words: list[bytes]) -> bytes:
    return hashlib.blake2b(b" ".join(words), digest_size=16).digest()


def weights_of(hashes: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    return counts * idf[(hashes >> np.uint64(64 - 18)).astype(np.int64)]


def idf_of(df: np.ndarray, documents: int, gain: float = IDF_GAIN) -> np.ndarray:
    """1 for a shingle of every document to 1 + gain for one in at most RARE of them."""
    share = np.clip(df / max(1, documents), RARE, 1.0)
    return (1 + gain * np.log(share) / np.log(RARE)).astype(np.float32)


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Of two (sorted hashes, weights)."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    common = float(np.minimum(a[1][i], b[1][j]).sum())
    union = float(a[1].sum() + b[1].sum()) - common
    return common / union if union > 0 else 0.0


class Sampler:
    """Improved consistent weighted sampling. For element x and hash k: r, c ~ Gamma(2, 1), beta ~ U(0, 1);
    t = floor(ln w / r + beta), ln a = ln c - r * (t - beta + 1); the sample is (x, t) of the smallest a."""

    def __init__(self, bands: int = BANDS, rows: int = ROWS, seed: int = 20):
        self.bands, self.rows = bands, rows
        rng = np.random.default_rng(seed)
        shape = (_TABLE, bands * rows)
        self.r = rng.gamma(2.0, 1.0, shape).astype(np.float32)
        self.ln_c = np.log(rng.gamma(2.0, 1.0, shape)).astype(np.float32)
        self.beta = rng.random(shape, np.float32)

    def samples(self, hashes: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """One 64-bit name of the sample per hash function."""
        ln_w = np.log(weights).astype(np.float32)
        columns = np.arange(self.bands * self.rows)
        best = name = None
        for lo in range(0, len(hashes), 4096):
            h = hashes[lo : lo + 4096]
            at = (h & np.uint64(_TABLE - 1)).astype(np.int64)
            r, beta = self.r[at], self.beta[at]
            t = ln_w[lo : lo + 4096, None] / r
            t += beta
            np.floor(t, out=t)
            ln_a = t - beta
            ln_a += 1
            ln_a *= r
            np.subtract(self.ln_c[at], ln_a, out=ln_a)
            first = ln_a.argmin(axis=0)
            low = ln_a[first, columns]
            here = _mix(h[first] + t[first, columns].astype(np.int64).astype(np.uint64) * _M1)
            best, name = (low, here) if best is None else (np.minimum(low, best), np.where(low < best, here, name))
        return name

    def buckets(self, names: np.ndarray) -> np.ndarray:
        key = np.arange(self.bands, dtype=np.uint64)
        for column in names.reshape(self.bands, self.rows).T:
            key = _mix(key * _M1 + column)
        return key.view(np.int64)


def _read(docs: DataFrame, text: str, key: str) -> DataFrame:
    """Per document (key, digest: null without words), and per task a row with its document counts by slot."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        df, documents = np.zeros(DF_SLOTS, np.uint32), 0
        names = ["key", "digest", "task", "df", "documents"]
        for batch in batches:
            digests = []
            for t in batch.column(1).to_pylist():
                words = split_words(t or "")
                digests.append(digest_of(words) if words else None)
                slots = (shingles(words)[0] >> np.uint64(64 - 18)).astype(np.int64)  # sorted, as the hashes are
                df[slots[np.append(True, slots[1:] != slots[:-1])] if len(slots) else slots] += 1
                documents += 1
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.binary()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.int64())], names)
        _hashes.clear()  # a reused worker goes on to other stages
        task = TaskContext.get().partitionId()
        key_type = pa.int64()
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(1, key_type), pa.nulls(1, pa.binary()), pa.array([task], pa.int32()), pa.array([zlib.compress(df.tobytes(), 1)], pa.binary()), pa.array([documents], pa.int64())],
            names,
        )

    return docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).mapInArrow(run, "key long, digest binary, task int, df binary, documents long")


def _sum_counts(parts: DataFrame) -> tuple[np.ndarray, int]:
    """Tree sum of the tasks' tables, which all have the same fixed size."""

    def add(batches) -> Iterator[pa.RecordBatch]:
        total, documents = np.zeros(DF_SLOTS, np.uint64), 0
        for batch in batches:
            for d, n in zip(batch.column("df").to_pylist(), batch.column("documents").to_pylist()):
                raw = zlib.decompress(d)
                total += np.frombuffer(raw, np.uint32 if len(raw) == 4 * DF_SLOTS else np.uint64)
                documents += n
        if documents:
            yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(total.tobytes(), 1)], pa.binary()), pa.array([documents], pa.int64())], ["df", "documents"])

    parts = parts.select("df", "documents")
    n = parts.count()
    while n > 1:
        n = -(-n // 32)
        parts = parts.repartition(n).mapInArrow(add, "df binary, documents long")
    total, documents = np.zeros(DF_SLOTS, np.uint64), 0
    for r in parts.collect():
        raw = zlib.decompress(bytes(r.df))
        total += np.frombuffer(raw, np.uint32 if len(raw) == 4 * DF_SLOTS else np.uint64)
        documents += r.documents
    return total, documents


def _sign(docs: DataFrame, text: str, idf) -> DataFrame:
    """(digest, signature: a byte per sample, buckets), once per task for equal words."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        sampler, seen = Sampler(), set()
        for batch in batches:
            digests, signatures, buckets = [], [], []
            for t in batch.column(0).to_pylist():
                words = split_words(t)
                if not words:
                    continue
                d = digest_of(words)
                if d in seen:
                    continue
                if len(seen) >= _WORDS_KEPT:
                    seen.clear()
                seen.add(d)
                h, n = shingles(words)
                names = sampler.samples(h, weights_of(h, n, idf.value))
                digests.append(d)
                signatures.append((names >> np.uint64(56)).astype(np.uint8).tobytes())
                buckets.append(sampler.buckets(names))
            flat = np.concatenate(buckets) if buckets else np.zeros(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, BANDS), pa.int32()), pa.array(flat, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(signatures, pa.binary()), lists], ["digest", "signature", "buckets"])
        _hashes.clear()

    return docs.select(F.col(text).alias("text")).where("text IS NOT NULL").mapInArrow(run, "digest binary, signature binary, buckets array<long>")


def _with_digest(docs: DataFrame, text: str) -> DataFrame:
    """(digest, text) of the texts that have words."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [split_words(t) for t in batch.column(0).to_pylist()]
            digests = pa.array([digest_of(w) if w else None for w in words], pa.binary())
            yield pa.RecordBatch.from_arrays([digests, batch.column(0)], ["digest", "text"])

    return docs.select(F.col(text).alias("text")).where("text IS NOT NULL").mapInArrow(run, "digest binary, text string").where("digest IS NOT NULL")


def _texts(docs: DataFrame, text: str, key: str, wanted: DataFrame) -> DataFrame:
    """(digest, text) of the wanted (digest, key): one text for each. Rows meet by their key, as the digests of all texts
    are stored without them; only rows without a key are met by digest."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [i for i, (d, t) in enumerate(zip(batch.column("digest").to_pylist(), batch.column("text").to_pylist())) if digest_of(split_words(t)) == d]
            yield batch.take(pa.array(keep, pa.int64())).select(["digest", "text"])

    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).where("text IS NOT NULL")
    found = rows.join(wanted.select("digest", "key"), "key").select("digest", "text").mapInArrow(run, "digest binary, text string")
    nameless = _with_digest(docs.where(F.col(key).isNull()), text).join(wanted.where("key IS NULL").select("digest"), "digest", "left_semi")
    return found.unionByName(nameless).groupBy("digest").agg(F.first("text").alias("text"))


def _verify(pairs: DataFrame, texts: DataFrame, idf) -> DataFrame:
    """pairs (member, leader) with their similarity, the weighted Jaccard of the whole texts."""
    counts = pairs.groupBy("leader").agg(F.ceil(F.count("*") / _PER_TASK).cast("int").alias("tasks"))
    large = counts.where("tasks > 1")  # a _PER_TASK-th of the pairs at most
    large = F.broadcast(large) if large.count() <= _BROADCAST else large
    named = texts.withColumnRenamed("digest", "leader")
    leaders = counts.join(named, "leader").select("leader", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1)).alias("task"), F.lit(None).cast("binary").alias("member"), "text")
    task = F.pmod(F.xxhash64("member"), F.coalesce("tasks", F.lit(1))).cast("int").alias("task")
    members = pairs.join(large, "leader", "left").select("leader", "member", task)
    members = members.join(texts.withColumnRenamed("digest", "member"), "member").select("leader", "task", "member", "text")

    def run(batches) -> Iterator[pa.RecordBatch]:
        leader, own = None, None
        for batch in batches:
            out = []
            for of, member, t in zip(*(batch.column(c).to_pylist() for c in ("leader", "member", "text"))):
                h, n = shingles(split_words(t))
                features = h, weights_of(h, n, idf.value)
                if member is None:
                    leader, own = of, features
                else:
                    assert of == leader
                    out.append((member, of, weighted_jaccard(own, features)))
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out], pa.binary()), pa.array([x[2] for x in out], pa.float64())],
                ["member", "leader", "similarity"],
            )
        _hashes.clear()

    ordered = leaders.unionByName(members).repartition("leader", "task").sortWithinPartitions("leader", "task", F.col("member").asc_nulls_first())
    return ordered.mapInArrow(run, "member binary, leader binary, similarity double")


def _spread(rows: DataFrame, buckets: DataFrame) -> DataFrame:
    """rows with what `buckets` has on their bucket, for rows whose bucket it has. It was made by grouping, so it is dealt
    out by bucket already, and joined like this the rows of a large bucket would have to come to one task. Under another
    name for the bucket both sides are dealt out anew, and Spark may split a large bucket's rows over tasks."""
    named = buckets.withColumn("__other", F.bitwise_not("bucket")).drop("bucket")
    return rows.join(named, F.bitwise_not(rows["bucket"]) == F.col("__other")).drop("__other")


def _grid(members: DataFrame, unlinked_blocks: int | None = None) -> DataFrame:
    """Buckets with unlinked nodes as a grid of cells (bucket, i, j): block i of the unlinked, block j of all nodes.
    members: bucket, digest, component, unlinked and what the cells need. With `unlinked_blocks` only the first ones. With
    `size`, the bytes of a node's text, a block has about _BLOCK_BYTES of them at most, but for a text that is larger by itself."""
    size = F.col("size") if "size" in members.columns else F.lit(0)
    sizes = members.groupBy("bucket").agg(
        F.count("*").alias("n"), F.count(F.when(F.col("unlinked"), 1)).alias("m"), F.sum(size).alias("nb"), F.sum(F.when(F.col("unlinked"), size)).alias("mb")
    ).where("m > 0")
    across = F.ceil(F.greatest(F.col("m") / _BLOCK, F.col("mb") / _BLOCK_BYTES)).cast("int")
    used = across if unlinked_blocks is None else F.least(across, F.lit(unlinked_blocks))
    down = F.ceil(F.greatest(F.col("n") / _BLOCK, F.col("nb") / _BLOCK_BYTES)).cast("int")
    sizes = sizes.select("bucket", down.alias("down"), across.alias("across"), used.alias("used"))
    dealt = _spread(members, sizes)
    hashed, rest = F.xxhash64("digest"), [c for c in members.columns if c not in ("bucket", "unlinked", "size")]
    every = dealt.select("bucket", F.explode(F.sequence(F.lit(0), F.col("used") - 1)).alias("i"), F.pmod(hashed, F.col("down")).cast("int").alias("j"), F.lit(False).alias("left"), *rest)
    left = dealt.where("unlinked").withColumn("i", F.pmod(hashed, F.col("across")).cast("int")).where("i < used")
    left = left.select("bucket", "i", F.explode(F.sequence(F.lit(0), F.col("down") - 1)).alias("j"), F.lit(True).alias("left"), *rest)
    return every.unionByName(left)


def _cell(cell: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Digests, components and signatures of a cell's rows, and the rows of its unlinked and of all its nodes."""
    flags = cell.column("left").to_numpy()
    digest = np.array(cell.column("digest").to_pylist(), object)
    component = np.unique(np.array(cell.column("component").to_pylist(), "S16"), return_inverse=True)[1]
    signature = np.frombuffer(b"".join(cell.column("signature").to_pylist()), np.uint8).reshape(-1, BANDS * ROWS)
    return digest, component, signature, np.flatnonzero(flags), np.flatnonzero(~flags)


def _hubs(members: DataFrame) -> DataFrame:
    """Pairs (member, leader) of the unlinked nodes with the hub of their bucket."""

    def best(key: tuple[pa.Scalar, ...], cell: pa.Table) -> pa.Table:
        digest, component, signature, a, b = _cell(cell)
        total = np.zeros(len(b))
        for x in a:
            agree = (signature[b] == signature[x]).mean(axis=1)
            total += np.where((agree >= _AGREE) & (component[b] != component[x]), agree, 0)
        k = int(total.argmax()) if len(b) else 0
        found = len(b) > 0 and total[k] > 0
        return pa.table({"bucket": pa.array([key[0].as_py()] if found else [], pa.int64()), "hub": pa.array([digest[b[k]]] if found else [], pa.binary()), "total": pa.array([total[k]] if found else [], pa.float64())})

    cells = _grid(members.select("bucket", "digest", "component", "signature", "unlinked"), 1).groupBy("bucket", "i", "j")
    hubs = cells.applyInArrow(best, "bucket long, hub binary, total double")
    hubs = hubs.groupBy("bucket").agg(F.max(F.struct("total", "hub")).alias("h")).select("bucket", F.col("h.hub").alias("hub"))
    unlinked = _spread(members.where("unlinked").select("bucket", "digest"), hubs).where("digest != hub")
    return unlinked.select(F.col("digest").alias("member"), F.col("hub").alias("leader")).distinct()


def _not_in(pairs: DataFrame, judged: DataFrame) -> DataFrame:
    """Pairs that are not judged yet, in either direction."""
    low, high = F.least("member", "leader").alias("__low"), F.greatest("member", "leader").alias("__high")
    return pairs.select("*", low, high).join(judged.select(low, high), ["__low", "__high"], "left_anti").select("member", "leader")


def _links_in_cells(members: DataFrame, texts: DataFrame, idf) -> DataFrame:
    """Links (a, b, similarity) between unlinked nodes and nodes of other components of their buckets."""
    sized = members.select("bucket", "digest", "component", "signature", "unlinked").join(texts.select("digest", F.octet_length("text").alias("size")), "digest")
    cells = _grid(sized).join(texts, "digest")

    def compare(key: tuple[pa.Scalar, ...], cell: pa.Table) -> pa.Table:
        digest, component, signature, a, b = _cell(cell)
        texts, features, found = cell.column("text"), {}, []
        root = np.arange(int(component.max()) + 1)

        def of(row: int) -> tuple[np.ndarray, np.ndarray]:
            if row not in features:
                h, n = shingles(split_words(texts[row].as_py()))
                features[row] = h, weights_of(h, n, idf.value)
            return features[row]

        for x in a:
            agree = (signature[b] == signature[x]).mean(axis=1)
            for y in b[np.argsort(-agree, kind="stable")]:
                p, q = root[component[x]], root[component[y]]
                if p != q and (s := weighted_jaccard(of(int(x)), of(int(y)))) >= SIMILARITY:
                    found.append((digest[x], digest[y], s))
                    root[root == p] = q
        kinds = {"a": pa.binary(), "b": pa.binary(), "similarity": pa.float64()}
        return pa.table({c: pa.array([p[i] for p in found], k) for i, (c, k) in enumerate(kinds.items())})

    return cells.groupBy("bucket", "i", "j").applyInArrow(compare, "a binary, b binary, similarity double")


def _classes(docs: DataFrame, text: str, key: str, gain: float) -> DataFrame:
    """A row per document: key, digest (null without words), component (its node, or the least one linked to it),
    class_id, the smallest key of the component, n_links and similarity of its text."""
    if not isinstance(docs.schema[key].dataType, T.IntegralType):
        raise TypeError(f"{key} is no integer")
    spark = docs.sparkSession
    batch_rows(spark, 1000)
    read = stored(_read(docs, text, key), "dedup-read")
    rows = read.where("task IS NULL").select("key", "digest")
    df, documents = _sum_counts(read.where("task IS NOT NULL"))
    idf = spark.sparkContext.broadcast(idf_of(df, documents, gain))

    signed = stored(_sign(docs, text, idf).dropDuplicates(["digest"]), "dedup-signed")
    placed = signed.select("digest", F.explode("buckets").alias("bucket"))
    sizes = placed.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    shared = stored(_spread(placed, sizes).select("bucket", "digest", "n"), "dedup-shared")
    places = shared.groupBy("digest").agg(F.sum("n").alias("places"))
    most = shared.join(places, "digest").groupBy("bucket").agg(F.max(F.struct("places", "digest")).alias("l"))
    members = stored(_spread(shared, most).select("bucket", "digest", F.col("l.digest").alias("leader")), "dedup-members")
    pairs = stored(members.where("digest != leader").select(F.col("digest").alias("member"), "leader").distinct(), "dedup-pairs")

    copies = stored(rows.where("digest IS NOT NULL").groupBy("digest").agg(F.min("key").alias("key"), F.count("*").alias("n")), "dedup-copies")
    wanted = copies.join(pairs.select(F.col("member").alias("digest")).union(pairs.select("leader")).distinct(), "digest")
    texts = stored(_texts(docs, text, key, wanted), "dedup-texts")

    judged = stored(_verify(pairs, texts, idf), "dedup-judged")
    links = _links(judged)
    labels = components(links)
    signatures = signed.select("digest", "signature")

    def open_buckets() -> DataFrame:
        """Nodes of the buckets in which a node is not in its leader's component."""
        of = labels.select(F.col("node").alias("digest"), "component")
        known = members.join(of, "digest", "left").withColumn("component", F.coalesce("component", "digest"))
        lead = known.where("digest = leader").select("bucket", F.col("component").alias("lead"))
        known = _spread(known, lead).withColumn("unlinked", F.col("component") != F.col("lead"))
        hit = known.where("unlinked").select("bucket").distinct()
        return stored(_spread(known, hit).join(signatures, "digest"), "dedup-open")

    def comparisons() -> int:
        per = rest.groupBy("bucket").agg(F.count("*").alias("n"), F.count(F.when(F.col("unlinked"), 1)).alias("m"))
        return per.agg(F.sum(F.col("n") * F.col("m"))).first()[0] or 0

    rest = open_buckets()
    while comparisons() > _FEW:
        hubs = stored(_not_in(_hubs(rest), judged), "dedup-hubs")
        if hubs.isEmpty():
            break
        more = stored(_verify(hubs, texts, idf), "dedup-judged")
        judged = judged.unionByName(more)
        new = _links(more)
        if new.isEmpty():
            break
        links = links.unionByName(new)
        labels = components(links)
        rest = open_buckets()
    if not rest.isEmpty():
        new = stored(_links_in_cells(rest, texts, idf), "dedup-links")
        if not new.isEmpty():
            links = links.unionByName(new)
            labels = components(links)

    each = links.select(F.explode(F.array(F.struct(F.col("a").alias("digest"), F.col("b").alias("other")), F.struct(F.col("b").alias("digest"), F.col("a").alias("other")))).alias("l"), "similarity")
    each = each.groupBy("l.digest", "l.other").agg(F.max("similarity").alias("similarity"))
    of_node = each.groupBy("digest").agg(F.count("*").alias("n_links"), F.max("similarity").alias("similarity"))
    linked = copies.join(labels.withColumnRenamed("node", "digest"), "digest").join(of_node, "digest")
    classes = linked.groupBy("component").agg(F.min("key").alias("class_id"))
    other = classes.select(F.col("component").alias("__component"), "class_id")
    of_linked = linked.join(other, F.col("component") == F.col("__component")).select("digest", "n", "component", "class_id", "n_links", "similarity")
    of_copies = copies.where("n > 1").join(labels.select(F.col("node").alias("digest")), "digest", "left_anti")
    of_copies = of_copies.select("digest", "n", F.col("digest").alias("component"), F.col("key").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(None).cast("double").alias("similarity"))
    found = stored(of_linked.unionByName(of_copies).withColumn("found", F.lit(True)), "dedup-classes")

    joined = lookup(rows.where("digest IS NOT NULL"), found, "digest", "n", ["key"])  # a third of all rows may have one digest
    classed = joined.select(
        "key", "digest", F.coalesce("component", "digest").alias("component"),
        F.when(F.col("found"), F.col("class_id")).otherwise(F.col("key")).alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), "similarity",
    )
    nothing = F.lit(None)
    alone = rows.where("digest IS NULL").select("key", "digest", nothing.cast("binary").alias("component"), F.col("key").alias("class_id"), F.lit(0).cast("long").alias("n_links"), nothing.cast("double").alias("similarity"))
    return classed.unionByName(alone)


def _links(judged: DataFrame) -> DataFrame:
    return judged.where(F.col("similarity") >= SIMILARITY).select(F.col("member").alias("a"), F.col("leader").alias("b"), "similarity")


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", idf_gain: float = IDF_GAIN) -> DataFrame:
    """A row per document: `key`; class_id, the smallest key of its class, which stands for it; n_links, with how many
    other texts its text is verified to be similar (copies of a text are one; a text is compared until it is in its
    class, not with everyone in it); similarity, the largest of these (null without a link)."""
    found = _classes(docs, text, key, idf_gain)
    return found.select(F.col("key").cast(docs.schema[key].dataType).alias(key), "class_id", "n_links", "similarity")


def keep_one(docs: DataFrame, text: str = "text", key: str = "doc_id", idf_gain: float = IDF_GAIN) -> DataFrame:
    """One document of each class: that with the smallest id, one row of it if it repeats. Of a class without ids one
    row stays."""

    @F.pandas_udf(T.BinaryType())
    def digest(t):
        words = (split_words(x) if x else [] for x in t)
        return pd.Series([digest_of(w) if w else None for w in words], dtype=object)

    classes = _classes(docs, text, key, idf_gain)
    first = classes.where("key = class_id AND digest IS NOT NULL").groupBy("component").agg(F.min(F.struct("key", "digest")).alias("f")).select("f.key", "f.digest")
    first = first.unionByName(classes.where("key IS NOT NULL AND digest IS NULL").select("key", "digest").distinct())
    rows = as_row(docs, text).withColumn("__key", F.col(f"__row.`{key}`").cast("long"))
    named = rows.join(first.withColumnRenamed("digest", "__digest"), F.col("__key") == F.col("key"))
    named = named.where(digest("__in").eqNullSafe(F.col("__digest"))).dropDuplicates(["__key", "__digest"]).select("__row")
    nameless = rows.where("__key IS NULL").withColumn("__digest", digest("__in"))
    alone = classes.where("key IS NULL AND class_id IS NULL").select("digest", "component").distinct()
    one = nameless.join(alone, F.col("__digest") == F.col("digest")).dropDuplicates(["component"]).select("__row")
    return named.unionByName(one).unionByName(nameless.where("__digest IS NULL").select("__row")).select("__row.*")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
