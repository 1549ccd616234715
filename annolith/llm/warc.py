"""WARC archives with a two-level capture index.

Write: a record per page, each a gzip member of its own, into one archive file per task in the shared folder. A page
whose payload (of at least MIN_REVISIT bytes) also belongs to a page with a larger id becomes a revisit record: no
payload, but the digest, the HTTP header with the payload's length, and the page it refers to.
Index: a line per record (reversed-host URL key, page id, place), sorted by range over the cluster and written in
compressed blocks, a file per task. A file ends with its directory: the first line of each block and where it lies. The
directory of files has the first and last line of each, so it grows with the tasks, not with the pages, and goes to all
readers.
Read: a capture is looked up by its key and page id. Bisection in the directory of files, in a file's directory and in a
block, each read by range, leads to its lines, and they to its records, read by range from the archives. Many captures
are looked up in key order, so a task reads a block once, and a batch's records in the order of the archives.

A task names its files freshly at every attempt and returns the names with its rows, which are stored as a table before
anyone reads them. So a file of a lost or repeated attempt is never referred to.

Defined cases: a null html is empty; a null url has the key "-"; a null page_id is written empty and read back as null;
repeated rows get a record each, and if rows of the largest page_id repeat, all of them are responses; payloads of any
length are written and read whole, a record at a time; an empty table gives empty archives and results; other columns are
ignored, whatever they are called.
"""

from __future__ import annotations

import bisect
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch_rows, scratch, stored, table

MIN_REVISIT = 1000
BLOCK_LINES = 1000
#: Records, and bytes of payload, that a task reads at a time.
READ_RECORDS, READ_BYTES = 10_000, 16 << 20
#: Records read by a task, unless more tasks would be needed.
TASK_RECORDS, MOST_TASKS = 5_000, 20_000
#: Payload groups up to which the table of revisited pages is broadcast (about 60 bytes each); beyond it is a join.
BROADCAST_GROUPS = 500_000
_GZIP = 31


def url_key(url: str | None) -> str:
    """Reversed-host key: `https://www.b.example.com:443/x?y#z` gives `com,example,b)/x?y`."""
    if not url:
        return "-"
    try:
        parts = urlsplit(url.strip())
        host, port = (parts.hostname or "").lower(), parts.port
    except ValueError:
        return "-" + re.sub(r"[\n\t]", " ", url)
    host = host.removeprefix("www.")
    key = ",".join(reversed(host.split("."))) + (f":{port}" if port and port not in (80, 443) else "")
    path = (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
    return f"{key}){path}".replace("\n", "%0A").replace("\t", "%09").replace(" ", "%20")


def encode_record(page_id, url: str | None, payload: bytes, digest: str, refers_to) -> bytes:
    """One gzip member. page_id None: no id; refers_to None: a response."""
    name = "" if page_id is None else str(page_id)
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{name}>",
        f"WARC-Target-URI: {re.sub(r'[\r\n]', ' ', url or '')}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if revisit:
        lines[2:2] = [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    z = zlib.compressobj(1, zlib.DEFLATED, _GZIP)
    return z.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + z.flush()


@dataclass
class Record:
    page_id: int | None
    url: str
    kind: str
    payload_bytes: int
    digest: str
    refers_to: int | None
    payload: bytes | None


def decode_record(member: bytes) -> Record:
    """A record as read from an archive; a response's payload must have the digest its header gives."""
    raw = zlib.decompress(member, _GZIP)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    kind = fields["WARC-Type"]
    if kind == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")

    def number(x: str | None) -> int | None:
        x = (x or "")[len("<urn:page:") : -1]
        return int(x) if x else None

    return Record(
        number(fields["WARC-Record-ID"]), fields["WARC-Target-URI"], kind, size, digest,
        number(fields.get("WARC-Refers-To")), payload if kind == "response" else None,
    )


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


class _Ranges:
    """Reads ranges of files in a folder, with a few of them open."""

    def __init__(self, uri: str, most: int = 32):
        self.fs, self.root = _filesystem(uri)
        self.most, self.open = most, {}

    def read(self, name: str, offset: int, length: int) -> bytes:
        f = self.open.pop(name, None) or self.fs.open_input_file(f"{self.root}/{name}")
        self.open[name] = f
        if len(self.open) > self.most:
            self.open.pop(next(iter(self.open))).close()
        f.seek(offset)
        return f.read(length)


@dataclass
class Archive:
    """Where the files are, and the directory of index files: first and last line (key, page id), file, where the file's
    own directory lies and how many blocks and lines it has."""

    folder: str
    files: DataFrame


def revisits(pages: DataFrame) -> DataFrame:
    """pages with payload_digest and refers_to (the page that holds the payload, null for responses)."""
    html = F.coalesce(F.col("html"), F.lit(""))
    named = pages.select("page_id", "url", html.alias("html"), F.sha1(html.cast("binary")).alias("payload_digest"))
    groups = (
        named.where(F.octet_length("html") >= MIN_REVISIT)
        .groupBy(F.col("payload_digest").alias("d"))
        .agg(F.max("page_id").alias("holder"), F.count("*").alias("n"))
        .where("n > 1")
        .select("d", "holder")
    )
    groups = stored(groups, "warc-groups")
    if groups.count() <= BROADCAST_GROUPS:
        groups = F.broadcast(groups)
    large = F.octet_length("html") >= MIN_REVISIT
    other = F.col("page_id").isNull() | (F.col("page_id") != F.col("holder"))
    # small payloads, of which many may be equal, take no part in the join: their key is null, and a null salted by the row
    on = F.when(large, F.col("payload_digest")).otherwise(F.concat(F.lit("-"), F.xxhash64("page_id", "url").cast("string")))
    joined = named.withColumn("__on", on).join(groups, F.col("__on") == groups.d, "left")
    return joined.select("page_id", "url", "html", "payload_digest", F.when(other, F.col("holder")).alias("refers_to"))


def write_archive(pages: DataFrame) -> Archive:
    """Archives and index of all pages (page_id, url, html)."""
    spark = pages.sparkSession
    batch_rows(spark, 1000)
    folder = f"{scratch(spark)}/warc-{uuid.uuid4().hex}"

    def records(batches) -> Iterator[pa.RecordBatch]:
        fs, root = _filesystem(folder)
        fs.create_dir(root, recursive=True)
        name, out, at = f"pages-{uuid.uuid4().hex}.warc.gz", None, 0
        for batch in batches:
            out = out or fs.open_output_stream(f"{root}/{name}", compression=None)
            rows = []
            for page_id, url, html, digest, refers in zip(*(c.to_pylist() for c in batch.columns)):
                member = encode_record(page_id, url, html.encode("utf-8", "surrogatepass"), digest, refers)
                out.write(member)
                rows.append((url_key(url), page_id, name, at, len(member)))
                at += len(member)
            if rows:
                kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["key", "page_id", "file", "offset", "length"])
        if out:
            out.close()

    lines = stored(
        revisits(pages).mapInArrow(records, "key string, page_id long, file string, offset long, length long"), "warc-lines"
    )

    def blocks(batches) -> Iterator[pa.RecordBatch]:
        fs, root = _filesystem(folder)
        name, out, at, pending, directory, last, lines_ = f"index-{uuid.uuid4().hex}.cdxz", None, 0, [], [], None, 0

        def append(rows: list[tuple]) -> tuple[int, int]:
            nonlocal at
            body = zlib.compress("\n".join("\t".join("" if x is None else str(x) for x in row) for row in rows).encode(), 6)
            out.write(body)
            at += len(body)
            return at - len(body), len(body)

        def close_block() -> None:
            directory.append((*pending[0][:2], *append(pending)))
            pending.clear()

        for batch in batches:
            out = out or fs.open_output_stream(f"{root}/{name}", compression=None)
            for last in zip(*(c.to_pylist() for c in batch.columns)):
                pending.append(last)
                lines_ += 1
                if len(pending) == BLOCK_LINES:
                    close_block()
        if pending:
            close_block()
        if directory:
            rows = [(*directory[0][:2], *last[:2], name, *append(directory), len(directory), lines_)]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), _FILE_KINDS.values())], list(_FILE_KINDS))
        if out:
            out.close()

    ordered = lines.repartitionByRange("key", "page_id", "file", "offset").sortWithinPartitions("key", "page_id", "file", "offset")
    schema = "first_key string, first_id long, last_key string, last_id long, file string, offset long, length long, n long, lines long"
    return Archive(folder, stored(ordered.mapInArrow(blocks, schema), "warc-files"))


_FILE_KINDS = {
    "first_key": pa.string(), "first_id": pa.int64(), "last_key": pa.string(), "last_id": pa.int64(),
    "file": pa.string(), "offset": pa.int64(), "length": pa.int64(), "n": pa.int64(), "lines": pa.int64(),
}
#: A missing page id sorts before all others.
_NO_ID = -(1 << 63) - 1


def _line(key: str, page_id: int | str | None) -> tuple[str, int]:
    return key, _NO_ID if page_id in (None, "") else int(page_id)


class IndexReader:
    """Finds captures by bisection in the directory of files, in a file's directory and in a block. Holds the directory
    and the block that it used last, as captures are looked up in key order."""

    def __init__(self, folder: str, files: list[tuple]):
        """files: (first key, first id, last key, last id, file, offset, length, blocks, lines) in order."""
        self.ranges = _Ranges(folder)
        self.files = files
        self.lasts = [_line(f[2], f[3]) for f in files]
        self.held: dict[str, tuple] = {}
        self.reads = 0

    def _lines(self, what: str, file: str, offset: int, length: int) -> tuple[list[tuple[str, int]], list[list[str]]]:
        """(keys, lines) of a directory or block."""
        if self.held.get(what, (None,))[0] != (file, offset):
            rows = [x.split("\t") for x in zlib.decompress(self.ranges.read(file, offset, length)).decode().split("\n")]
            self.held[what] = (file, offset), ([_line(*row[:2]) for row in rows], rows)
            self.reads += 1
        return self.held[what][1]

    def find(self, key: str, page_id: int | None = None, any_id: bool = False) -> Iterator[tuple[str, int, int]]:
        """(archive, offset, length) of the records of a capture, or of all captures of a key."""
        low = (key, _NO_ID) if any_id else _line(key, page_id)
        high = (key, 1 << 64) if any_id else low
        for k in range(bisect.bisect_left(self.lasts, low), len(self.files)):
            first_key, first_id, _, _, file, offset, length, *_ = self.files[k]
            if _line(first_key, first_id) > high:
                return
            firsts, blocks = self._lines("directory", file, offset, length)
            for b in range(max(0, bisect.bisect_left(firsts, low) - 1), len(blocks)):
                if firsts[b] > high:
                    return
                keys, lines = self._lines("block", file, int(blocks[b][2]), int(blocks[b][3]))
                for line in lines[bisect.bisect_left(keys, low) : bisect.bisect_right(keys, high)]:
                    yield line[2], int(line[3]), int(line[4])


def _files_of(archive: Archive) -> list[tuple]:
    """The directory of files, in order; a row per task that wrote an index file."""
    rows = [tuple(r) for r in archive.files.select(*_FILE_KINDS).collect()]
    return sorted(rows, key=lambda r: (_line(r[0], r[1]), _line(r[2], r[3])))


def captures(pages: DataFrame) -> DataFrame:
    """(key, page_id) of the pages, each once."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = pa.array([url_key(u) for u in batch.column("url").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([keys, batch.column("page_id")], ["key", "page_id"])

    return pages.select("page_id", "url").mapInArrow(run, "key string, page_id long").distinct()


def read_captures(archive: Archive, wanted: DataFrame, payload: bool = True) -> DataFrame:
    """The records of the wanted captures (key, page_id), each found through the index: page_id, url, payload_bytes,
    payload_digest, record_type, refers_to and, unless it is not asked for, payload (null for revisits)."""
    folder = archive.folder
    directory = _files_of(archive)
    files = archive.files.sparkSession.sparkContext.broadcast(directory)
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    if payload:
        schema, kinds = schema + ", payload binary", [*kinds, pa.binary()]
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches) -> Iterator[pa.RecordBatch]:
        index, records = IndexReader(folder, files.value), _Ranges(folder)

        def flush(places: list[tuple[str, int, int]]) -> Iterator[pa.RecordBatch]:
            rows, size = [], 0
            for place in sorted(places):
                r = decode_record(records.read(*place))
                rows.append((r.page_id, r.url, r.payload_bytes, r.digest, r.kind, r.refers_to, r.payload)[: len(names)])
                size += len(r.payload or b"") if payload else 0
                if size > READ_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

        for batch in batches:
            places: list[tuple[str, int, int]] = []
            for key, page_id in zip(*(c.to_pylist() for c in batch.columns)):
                for place in index.find(key, page_id):
                    places.append(place)
                    if len(places) == READ_RECORDS:
                        yield from flush(places)
                        places = []
            yield from flush(places)

    # a task's work is the records it reads, not the keys it is given
    tasks = max(1, min(MOST_TASKS, -(-sum(f[-1] for f in directory) // TASK_RECORDS)))
    ordered = wanted.select("key", "page_id").repartitionByRange(tasks, "key", "page_id").sortWithinPartitions("key", "page_id")
    return ordered.mapInArrow(run, schema)


def lookup(archive: Archive, url: str) -> list[Record]:
    """The records of one URL, found through the index, in order of their page ids."""
    index, records = IndexReader(archive.folder, _files_of(archive)), _Ranges(archive.folder)
    return [decode_record(records.read(*place)) for place in index.find(url_key(url), any_id=True)]


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    found = read_captures(write_archive(pages), captures(pages), payload=False)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP6_SQL = """
WITH p AS (
  SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), m AS (
  SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS holder FROM p
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id IS DISTINCT FROM holder THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id IS DISTINCT FROM holder THEN holder END AS refers_to
FROM m
"""
