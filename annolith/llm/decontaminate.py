"""Benchmark decontamination: an FM-index per training shard, searched for the windows of the benchmark items.

Words are lower-cased (A-Z) runs of letters, digits and non-ASCII characters. The windows of an item are its runs of 10
words, or the whole item if it is shorter. A shard is a bounded stretch of documents of one task. Its words become
symbols: the benchmark's words keep their number, any other word, which no window has, becomes a separator, and a run
of the benchmark's words too short for the shortest window is left out. That loses no occurrence. Windows are found by
backward search through wavelet ranks, occurrences are located by sampled suffix positions, and overlapping or touching
ones are merged into removal spans.

The windows are broadcast in blocks of about BLOCK_BYTES of benchmark text, which take some ten times that on the driver
and in a worker; a larger benchmark takes several passes over the documents, so no task ever has the windows of two blocks.
A pass before the last stores only what it found, by the digest of the text (spans and items depend on nothing else), and the
last one meets it.

Defined cases: null texts have no words; repeated documents are searched each; an item given twice counts once; a null
item_id is written as an empty string; an empty benchmark leaves every document clean; empty tables give empty results;
other columns are ignored unless kept.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_row, batch_rows, lookup, stored, table
from .fm_index import SEPARATOR, FMIndex

WINDOW = 10
BLOCK_BYTES = 4 << 20
#: A shard ends once it holds so many indexed symbols or so many bytes of pending texts.
SHARD_SYMBOLS = 1 << 19
SHARD_BYTES = 16 << 20

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: Bytes of words stay (A-Z in lower case), all others become spaces; bytes over 0x7F belong to non-ASCII characters.
_FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if b > 127 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)


def split_words(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split()


@dataclass
class Windows:
    """The distinct windows of a block of items as rows of word numbers (0 beyond a shorter one's end), and of window k
    the items names[i] for i in owners[first[k] : first[k + 1]]. Arrays take about 10 bytes a byte of benchmark text."""

    words: dict[bytes, int]
    rows: np.ndarray
    lengths: np.ndarray
    first: np.ndarray
    owners: np.ndarray
    names: list[str]
    shortest: int

    @classmethod
    def of(cls, items: Iterable[tuple[str, str | None]], window: int = WINDOW) -> Windows:
        words: dict[bytes, int] = {}
        names: dict[str, int] = {}
        ids, starts, lengths, owners, at = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)], [], [], 0
        for item, text in items:
            own = np.fromiter((words.setdefault(w, len(words) + 1) for w in split_words(text or "")), np.int32)
            if not len(own):
                continue
            size = min(window, len(own))
            many = len(own) - size + 1
            ids.append(own)
            starts.append(np.arange(at, at + many))
            lengths.append(np.full(many, size, np.int32))
            owners.append(np.full(many, names.setdefault(item, len(names)), np.int32))
            at += len(own)
        ids.append(np.zeros(window, np.int32))
        every, start = np.concatenate(ids), np.concatenate(starts)
        length = np.concatenate([np.zeros(0, np.int32), *lengths])
        rows = np.empty((len(start), window), np.int32)
        for k in range(window):
            rows[:, k] = np.where(k < length, every[start + k], 0)
        _, one, which = np.unique(rows.view(f"V{4 * window}").ravel(), return_index=True, return_inverse=True)
        pairs = np.unique(which * len(names) + np.concatenate([np.zeros(0, np.int32), *owners])) if names else np.zeros(0, np.int64)
        many = max(1, len(names))
        first = np.searchsorted(pairs, np.arange(len(one) + 1) * many)
        return cls(words, rows[one], length[one], first, (pairs % many).astype(np.int32), list(names), int(length.min(initial=window)))

    def items(self, k: int) -> list[str]:
        return [self.names[i] for i in self.owners[self.first[k] : self.first[k + 1]]]


def candidate_runs(ids: np.ndarray, shortest: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of the benchmark's words (numbers over 0) that can hold the shortest window."""
    known = np.concatenate([[False], ids > 0, [False]])
    change = np.flatnonzero(known[1:] != known[:-1])
    begin, size = change[::2], change[1::2] - change[::2]
    enough = size >= shortest
    return begin[enough], size[enough]


class Shard:
    """Documents gathered for one index."""

    def __init__(self, windows: Windows):
        self.windows = windows
        self.symbols: list[np.ndarray] = []
        self.docs: list[np.ndarray] = []
        self.places: list[np.ndarray] = []
        self.size = self.count = self.bytes = 0
        self.n_words: list[int] = []

    def add(self, texts: list[str]) -> None:
        get, parts, starts, at = self.windows.words.get, [], [], 0
        for t in texts:
            words = split_words(t)
            parts.append(np.fromiter(map(get, words, repeat(0)), np.int64, len(words)))
            parts.append(np.zeros(1, np.int64))  # no run goes on into the next document
            self.n_words.append(len(words))
            self.bytes += len(t)
            starts.append(at)
            at += len(words) + 1
        ids = np.concatenate([*parts, np.zeros(1, np.int64)])
        begin, size = candidate_runs(ids, self.windows.shortest)
        if len(begin):
            doc = np.searchsorted(np.array(starts), begin, "right") - 1
            # every run is followed by one separator
            lengths = size + 1
            ends = np.cumsum(lengths)
            place = np.arange(ends[-1]) - np.repeat(ends - lengths, lengths)
            source = np.repeat(begin, lengths) + place
            symbols = ids[source]
            symbols[ends - 1] = SEPARATOR
            self.symbols.append(symbols)
            self.docs.append(np.repeat(doc + self.count, lengths))
            self.places.append(source - np.repeat(np.array(starts)[doc], lengths))
            self.size += len(symbols)
        self.count += len(texts)

    def full(self) -> bool:
        return self.size >= SHARD_SYMBOLS or self.bytes >= SHARD_BYTES

    def search(self) -> tuple[list[list[tuple[int, int]]], list[set[str]]]:
        """Per document: merged spans of hit words [start, end), and the items."""
        spans: list[list[tuple[int, int]]] = [[] for _ in range(self.count)]
        items: list[set[str]] = [set() for _ in range(self.count)]
        if not self.size or not len(self.windows.lengths):
            return spans, items
        w = self.windows
        text, docs, places = (np.concatenate(x) for x in (self.symbols, self.docs, self.places))
        index = FMIndex(text, len(w.words) + 1)
        low, high = index.ranges(w.rows, w.lengths)
        n = high - low
        which = np.repeat(np.arange(len(n)), n)
        if not len(which):
            return spans, items
        rows = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + low[which]
        at = index.locate(rows)
        change = np.zeros(len(text) + 1, np.int64)
        np.add.at(change, at, 1)
        np.add.at(change, at + w.lengths[which], -1)
        hit = np.flatnonzero(np.cumsum(change[:-1]) > 0)
        cut = np.ones(len(hit), bool)
        cut[1:] = (docs[hit[1:]] != docs[hit[:-1]]) | (places[hit[1:]] != places[hit[:-1]] + 1)
        first = np.flatnonzero(cut)
        last = np.append(first[1:], len(hit)) - 1
        for a, b in zip(hit[first], hit[last]):
            spans[docs[a]].append((int(places[a]), int(places[b]) + 1))
        pairs = np.unique(docs[at] * len(n) + which)
        for p in pairs.tolist():
            items[p // len(n)].update(w.items(p % len(n)))
        return spans, items


def merge_spans(a: list[tuple[int, int]], b: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted([*a, *b]):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((start, end))
    return out


def excise(text: str, spans: list[tuple[int, int]]) -> str:
    """Text without the words in the spans and what stands between them."""
    if not spans:
        return text
    places = [m.span() for m in _WORD.finditer(text.translate(_LOWER))]
    parts, at = [], 0
    for start, end in spans:
        parts.append(text[at : places[start][0]])
        at = places[end - 1][1]
    return "".join([*parts, text[at:]])


_LOWER = {c: c + 32 for c in range(65, 91)}


def _blocks(benchmark: DataFrame, item: str, text: str) -> Iterator[tuple[bool, Iterator[tuple[str, str | None]]]]:
    """The items in blocks of bounded size, dealt by hash, and whether it is the last block."""
    rows = benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("")).alias("i"), F.col(text).alias("t")).where("t IS NOT NULL")
    total = rows.agg(F.sum(F.octet_length("t") + 64)).first()[0] or 0
    n = -(-total // BLOCK_BYTES) or 1
    for k in range(n):
        block = rows if n == 1 else rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k)
        yield k == n - 1, ((r.i, r.t) for r in block.toLocalIterator())


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), item: str = "item_id", item_text: str = "text", window: int = WINDOW
) -> DataFrame:
    """`keep` columns, n_words, spans (array of [start, end) word numbers), items (ids as sorted strings), text as `__text`."""
    spark = docs.sparkSession
    batch_rows(spark, 1000)
    empty = docs.select(*keep, F.lit(0).cast("long").alias("n_words"), F.expr("cast(array() as array<array<long>>)").alias("spans"),
                        F.expr("cast(array() as array<string>)").alias("items"), F.col(text).alias("__text"))
    earlier = []
    for last, block in _blocks(benchmark, item, item_text):
        windows = spark.sparkContext.broadcast(Windows.of(block, window))
        if last:
            found = empty.mapInArrow(_pass(windows, len(keep), empty.columns), empty.schema)
        else:
            rows = empty.select(_digest(F.col("__text")).alias("__sha"), "n_words", "spans", "items", "__text")
            hits = rows.mapInArrow(_pass(windows, 1, rows.columns), rows.schema).where(F.size("spans") > 0)
            earlier.append(stored(hits.groupBy("__sha").agg(F.first("spans").alias("s"), F.first("items").alias("i"), F.count("*").alias("__n")), "contamination"))
            windows.destroy()
    return _with_earlier(found, earlier, keep) if earlier else found


def _digest(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def _with_earlier(found: DataFrame, earlier: list[DataFrame], keep: tuple[str, ...]) -> DataFrame:
    """What the last pass found, and what the passes before it found in the same texts."""
    every = functools.reduce(DataFrame.unionByName, earlier)
    texts = every.groupBy("__sha").agg(F.flatten(F.collect_list("s")).alias("__spans"), F.flatten(F.collect_list("i")).alias("__items"), F.max("__n").alias("__n"))
    both = lookup(found.withColumn("__sha", _digest(F.col("__text"))), stored(texts, "contamination"), "__sha", "__n", ["__sha", *keep])

    @F.udf("array<array<bigint>>", useArrow=True)
    def merged(a, b):
        return [list(x) for x in merge_spans([tuple(x) for x in a], [tuple(x) for x in b])]

    some = F.col("__spans").isNotNull()
    spans = F.when(some, merged("spans", F.coalesce("__spans", "spans"))).otherwise(F.col("spans"))
    items = F.when(some, F.array_sort(F.array_union("items", "__items"))).otherwise(F.col("items"))
    return both.withColumns({"spans": spans, "items": items}).select(*found.columns)


def _pass(windows, kept: int, names: list[str]):
    def flush(shard: Shard, pending: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans, items = shard.search()
        at = 0
        for batch in pending:
            n = batch.num_rows
            arrays = [
                pa.array(shard.n_words[at : at + n], pa.int64()),
                pa.array([[list(x) for x in row] for row in spans[at : at + n]], pa.list_(pa.list_(pa.int64()))),
                pa.array([sorted(x) for x in items[at : at + n]], pa.list_(pa.string())),
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns[:kept], *arrays, batch.columns[kept + 3]], names)
            at += n

    def run(batches):
        shard, pending = Shard(windows.value), []
        for batch in batches:
            shard.add([t or "" for t in batch.column(kept + 3).to_pylist()])
            pending.append(batch)
            if shard.full():
                yield from flush(shard, pending)
                shard, pending = Shard(windows.value), []
        if pending:
            yield from flush(shard, pending)

    return run


def decontaminate(docs: DataFrame, benchmark: DataFrame, action: str = "drop", text: str = "text", **how) -> DataFrame:
    """Documents in their own columns: contaminated ones dropped, or (action "excise") without their spans."""
    if action not in ("drop", "excise"):
        raise ValueError("action is drop or excise")
    found = find_contamination(as_row(docs, text), benchmark, "__in", keep=("__row",), **how)
    if action == "drop":
        return found.where(F.size("spans") == 0).select("__row.*")

    @F.udf("string", useArrow=True)
    def without(t, spans):
        return None if t is None else excise(t, [tuple(x) for x in spans])

    new = F.when(F.size("spans") == 0, F.col("__text")).otherwise(without("__text", "spans"))
    return found.select(F.col("__row").withField(text, new).alias("__row")).select("__row.*")


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s[1] - s[0])
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


_SQL_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP8_SQL = f"""
WITH b AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item_id, {_SQL_WORDS} AS ws FROM benchmark
), win AS (
  SELECT DISTINCT item_id, n, array_to_string(list_slice(ws, i, i + n - 1), ' ') AS win
  FROM (SELECT item_id, ws, least(len(ws), 10) AS n, unnest(range(1, len(ws) - least(len(ws), 10) + 2)) AS i FROM b WHERE len(ws) > 0)
), d AS (
  SELECT row_number() OVER () AS r, doc_id, {_SQL_WORDS} AS ws FROM documents
), dwin AS (
  SELECT r, i, n, array_to_string(list_slice(ws, i, i + n - 1), ' ') AS win
  FROM (SELECT r, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM win) WHERE len(ws) >= n)
), occ AS (
  SELECT r, i, n, item_id FROM dwin JOIN win USING (n, win)
), hit AS (
  SELECT r, count(DISTINCT i + k) AS n_hit FROM (SELECT DISTINCT r, i, n FROM occ), range(10) t(k) WHERE k < n GROUP BY r
), item AS (
  SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT r, item_id FROM occ) GROUP BY r
)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN item USING (r)
"""
