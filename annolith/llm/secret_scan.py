"""Secret scan with a recursive decoding worklist.

The base patterns run over the text itself. Then a worklist unwraps layers. A layer is a stretch of text with, character
by character, the place in the document that it came from. Two steps lead from a layer to deeper ones:

* unescape: every percent escape and every backslash escape (`\\uXXXX`, `\\u{X}`, `\\UXXXXXXXX`, `\\xXX`) is replaced by
  what it stands for, and so are quotes and ends of lines behind one backslash or more, as in JSON. Where an escape stands for
  `%` or a backslash, it is read on together with what follows, so one that was escaped any number of times
  (`%252525..20`) is peeled in this one step, in time linear in its length;
* base64: every run of base64 (wrapped and indented or not, either alphabet) that encodes text, inflated further through
  all members of gzip, zlib, bzip2 and xz and whole streams of bare deflate, is replaced by that text. Runs that encode other data are a layer each, read byte by byte and, where NULs
  alternate, as UTF-16; matches in them map to the whole run.

Only what changed is entered: the maximal runs of characters that can belong to a pattern, an escape or a base64 run
(`_REACH`) around the replaced places. No pattern reaches beyond such a run, so this finds the same as entering the whole
text would. Layers already seen at the same place are not entered again, so the list ends at a fixpoint even for data
that unpacks to itself. Each layer is scanned with the same patterns; matches with a decoded character are mapped back to
code points of the text and added to the base matches. There is no recursion, so nesting has no limit.

Data that inflates beyond IN_MEMORY bytes is not held: it is inflated and searched as it comes, whatever its size, and
what it has counts for the run as a whole. It is read in pieces that overlap; a run of base64 in it that is longer than the
overlap is decoded as it comes and searched in the same way, and so on (`_Search`).

Base patterns (fixed values): assign, access, hex as in `KINDS`.

Defined cases: a null text is empty and has no spans; repeated rows are scanned each; texts of any length and nesting are
scanned whole; escapes that are not complete stay as they are, bytes that are no UTF-8 become U+FFFD; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import binascii
import bisect
import bz2
import contextlib
import hashlib
import itertools
import lzma
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch_rows, table

IN_MEMORY = 1 << 24
PIECE, OVERLAP = 1 << 20, 1 << 16

#: Kinds in their listed order.
KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
#: The two others with their least length inside: a maximal run is matched whole, so a failing one has no other match.
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
_KEYWORDS = ("passw", "secret", "token", "apikey", "api_key")

#: Runs of all characters that a pattern, an escape or a base64 run can have.
_REACH = re.compile(r"""[A-Za-z0-9+/_.=%\\{}"':\x20\t\r\n-]+""")
_OPENER = re.compile(r"[%\\]")
_PERCENT = re.compile(r"[0-9A-Fa-f]{2}")
_BACKSLASH = re.compile(r"u\{([0-9A-Fa-f]{1,6})\}|u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8})|x([0-9A-Fa-f]{2})")
#: Quotes and ends of lines as strings of programs and JSON have them, escaped once or more often.
_QUOTED = re.compile(r"""\\*(["'nrt])""")
_MEANING = {"n": 10, "r": 13, "t": 9}
#: Lines of 16 characters or more, indented or not, and one last line of any length.
_BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}(?:\r?\n[ \t]*[A-Za-z0-9+/_-]{16,})*(?:\r?\n[ \t]*[A-Za-z0-9+/_-]{1,15})?={0,2}")
#: NULs that alternate with other bytes, as in UTF-16.
_WIDE = re.compile(rb"(?:[^\x00]\x00){4}")
#: Bytes of the shortest secret, `token=` and six characters; no escape or base64 run of one is shorter.
SHORTEST = 12
_UNPRINTABLE = re.compile(r"[\x00-\x08\x0e-\x1f\x7f-\x9f]")


def scan(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base patterns, leftmost and non-overlapping within a kind."""
    found = []
    low = text.lower()
    if any(k in low for k in _KEYWORDS):
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(found)


# ---- packed data

#: How packed data begin (fixed values); zlib data by its check of the first two bytes.
_MAGIC = ((b"\x1f\x8b", lambda: zlib.decompressobj(47)), (b"BZh", bz2.BZ2Decompressor), (b"\xfd7zXZ\x00", lambda: lzma.LZMADecompressor(lzma.FORMAT_XZ)))
_BROKEN = (zlib.error, OSError, lzma.LZMAError, EOFError)


def _packed(data: bytes) -> bool:
    return _unpacker(data) is not None


def _unpacker(data: bytes):
    for magic, make in _MAGIC:
        if data[: len(magic)] == magic:
            return make
    if data[:1] == b"\x78" and len(data) > 1 and (data[0] * 256 + data[1]) % 31 == 0:
        return lambda: zlib.decompressobj(47)
    return None


#: Bytes that tell whether data are packed.
_HEAD = 6


def _pieces(z, data: bytes) -> Iterator[bytes]:
    """What an unpacker makes of more data, in pieces."""
    if hasattr(z, "unconsumed_tail"):
        while data and not z.eof:
            yield z.decompress(data, PIECE)
            data = z.unconsumed_tail
    else:
        yield z.decompress(data, PIECE)
        while not z.eof and not z.needs_input:
            yield z.decompress(b"", PIECE)


def _members(source: Iterator[bytes]) -> Iterator[bytes]:
    """What the packed members of a stream hold, all joined, and then what follows them as it is."""
    z, rest, first = None, b"", True
    for chunk in source:
        rest += chunk
        while rest:
            if z is None:
                if not first:  # members may be padded
                    rest = rest.lstrip(b"\0")
                if len(rest) < _HEAD and (more := next(source, b"")):
                    rest += more
                    continue
                if not rest:
                    break
                if (make := _unpacker(rest)) is None:
                    yield rest
                    yield from source
                    return
                z, first = make(), False
            try:
                yield from filter(None, _pieces(z, rest))
            except _BROKEN:
                yield rest
                yield from source
                return
            rest = b""
            if z.eof:
                rest, z = z.unused_data, None


def _unpack(data: bytes) -> tuple[bytes, Iterator[bytes] | None]:
    """Data without its packed layers, or the rest of the work as a stream if it is larger than IN_MEMORY."""
    seen = set()
    while _packed(data):
        seen.add(hashlib.sha256(data).digest())
        parts, size, pieces = [], 0, _members(iter((data,)))
        for piece in pieces:
            parts.append(piece)
            size += len(piece)
            if size > IN_MEMORY:
                return b"", _whole(_members(iter((data,))))
        out = b"".join(parts)
        if hashlib.sha256(out).digest() in seen:
            break
        data = out
    return data, None


def _raw_deflate(data: bytes) -> Iterator[bytes] | None:
    """What data hold that are one whole stream of deflate without a header, which nothing but trying tells."""
    if len(data) < SHORTEST:
        return None
    z = zlib.decompressobj(-15)
    try:
        for _ in _pieces(z, data):
            pass
    except zlib.error:
        return None
    return _pieces(zlib.decompressobj(-15), data) if z.eof and not z.unused_data else None


def _bounded(stream: Iterator[bytes]) -> tuple[bytes, Iterator[bytes] | None]:
    """All of a stream, or if that is larger than IN_MEMORY the stream from its start on."""
    parts, size = [], 0
    for piece in stream:
        parts.append(piece)
        size += len(piece)
        if size > IN_MEMORY:
            return b"", itertools.chain(parts, stream)
    return b"".join(parts), None


def _whole(stream: Iterator[bytes]) -> Iterator[bytes]:
    """A stream without the packed layers it still has."""
    while True:
        head = next(stream, b"")
        while 0 < len(head) < _HEAD and (more := next(stream, b"")):
            head += more
        rest = itertools.chain((head,), stream)
        if not _packed(head):
            return rest
        stream = _members(rest)


# ---- data of any size, searched as they come


#: 1: characters of base64; 2: ends of lines and NULs between them; 3: indentation, which counts after one of these.
_CLASS = np.zeros(256, np.uint8)
_CLASS[[*b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_"]] = 1
_CLASS[[*b"\r\n\0"]] = 2
_CLASS[[*b" \t"]] = 3


def _in_run(data: bytes, after_line: bool = False) -> np.ndarray:
    """Per byte whether a run of base64 may go on with it, whatever stands before."""
    c = _CLASS[np.frombuffer(data, np.uint8)]
    at = np.maximum.accumulate(np.where(c != 3, np.arange(len(c)), -1))
    before = np.where(at < 0, 2 if after_line else 0, c[np.maximum(at, 0)])
    return (c == 1) | (c == 2) | (c == 3) & (before == 2)


class _Search:
    """Kinds of secrets in data of any size, which come piece by piece. They are read in pieces that overlap by OVERLAP
    bytes. What is shorter than that is wholly in a piece; a run of base64 that is longer goes on, while it lasts, into searches of
    their own of what it encodes: one for each place among four where its groups of four may begin, as what stands before it may
    look like a part of it. What they get is unpacked first."""

    def __init__(self, found: set[int] | None = None):
        self.found = set() if found is None else found
        self.held, self.run = b"", None

    def feed(self, data: bytes) -> None:
        for lo in range(0, len(data), PIECE):
            self._take(data[lo : lo + PIECE])

    def _take(self, data: bytes) -> None:
        if len(self.found) == len(KINDS):
            return
        if self.run is not None:
            self.run.feed(data)
            if self.run.ended:
                self.run = None
        self.held += data
        if len(self.held) < PIECE + OVERLAP:
            return
        self.found |= _kinds_of(self.held)
        if self.run is None:
            bad = np.flatnonzero(~_in_run(self.held))
            start = int(bad[-1]) + 1 if len(bad) else 0
            if len(self.held) - start > OVERLAP // 2:
                self.run = _LongRun(self.found)
                self.run.feed(self.held[start:])
        self.held = self.held[-OVERLAP:]

    def finish(self) -> set[int]:
        if self.run is not None:
            self.run.finish()
            self.run = None
        if len(self.found) < len(KINDS):
            self.found |= _kinds_of(self.held)
        return self.found


class _LongRun:
    """A run of base64 as it comes, decoded from each of four places on."""

    def __init__(self, found: set[int]):
        self.readers = [_Opened(found) for _ in range(4)]
        self.rest = [b""] * 4
        self.skip = [0, 1, 2, 3]
        self.after_line, self.ended = False, False

    def feed(self, data: bytes) -> None:
        if self.ended or not data:
            return
        bad = np.flatnonzero(~_in_run(data, self.after_line))
        part = data[: int(bad[0])] if len(bad) else data
        if part:
            self.after_line = part.rstrip(b" \t")[-1:] in (b"\r", b"\n", b"\0") or self.after_line and not part.strip(b" \t")
        chars = part.translate(bytes.maketrans(b"-_", b"+/"), b"\r\n\0 \t")
        for k, reader in enumerate(self.readers):
            own = self.rest[k] + chars[self.skip[k] :]
            self.skip[k] -= min(self.skip[k], len(chars))
            whole = len(own) // 4 * 4
            self.rest[k] = own[whole:]
            reader.feed(binascii.a2b_base64(own[:whole]))
        if len(bad):
            self.finish()

    def finish(self) -> None:
        if not self.ended:
            self.ended = True
            for reader, rest in zip(self.readers, self.rest):
                if len(rest) > 1:
                    reader.feed(binascii.a2b_base64(rest + b"=" * (4 - len(rest))))
                reader.finish()


class _Opened:
    """Data as they come, less the packed layers they begin with, into a search; if they may be deflate without a header,
    into another one too."""

    def __init__(self, found: set[int]):
        self.found, self.head, self.next = found, b"", []

    def feed(self, data: bytes) -> None:
        if not self.next:
            self.head += data
            if len(self.head) < 1024:
                return
            data = self._begin()
        for x in self.next:
            x.feed(data)

    def _begin(self) -> bytes:
        head, self.head = self.head, b""
        if (make := _unpacker(head)) is not None:
            self.next = [_Inflating(self.found, make)]
        else:
            self.next = [_Search(self.found)]
            with contextlib.suppress(zlib.error):
                zlib.decompressobj(-15).decompress(head, PIECE)
                self.next.append(_Inflating(self.found, lambda: zlib.decompressobj(-15)))
        return head

    def finish(self) -> None:
        if not self.next:
            head = self._begin()
            for x in self.next:
                x.feed(head)
        for x in self.next:
            x.finish()


class _Inflating:
    """Packed data as they come: members one after another, and what follows them as it is."""

    def __init__(self, found: set[int], make):
        self.found, self.z, self.next, self.head = found, make(), _Opened(found), b""

    def feed(self, data: bytes) -> None:
        while data:
            if self.z is None:  # between members
                data = (self.head + data).lstrip(b"\0") if self.head is not None else data
                make = _unpacker(data) if self.head is not None else None
                if make is None:
                    if self.head is not None and len(data) < _HEAD:
                        self.head = data
                        return
                    self.head = None
                    self.next.feed(data)
                    return
                self.z, self.head = make(), b""
            try:
                for piece in _pieces(self.z, data):
                    self.next.feed(piece)
            except _BROKEN:
                self.z, self.head = None, None
                self.next.feed(data)
                return
            data = b""
            if self.z.eof:
                data, self.z = self.z.unused_data, None

    def finish(self) -> None:
        if self.head:
            self.next.feed(self.head)
        self.next.finish()


def _kinds_in(stream: Iterator[bytes]) -> set[int]:
    """Kinds of secrets that data of any size has."""
    search = _Search()
    for piece in stream:
        search.feed(piece)
        if len(search.found) == len(KINDS):
            break
    return search.finish()


def _kinds_of(data: bytes) -> set[int]:
    return {kind for reading in _readings(data) for _, kind, _ in find_secrets(reading)[1]}


def _as_text(data: bytes) -> str | None:
    try:
        text = data.decode()
    except UnicodeDecodeError:
        return None
    return None if not text or _UNPRINTABLE.search(text) else text


def _from_base64(run: str) -> bytes | None:
    body = re.sub(r"[\r\n\t =]", "", run).replace("-", "+").replace("_", "/")
    if len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def _readings(data: bytes) -> list[str]:
    """What data that are no plain text may say: byte by byte, and as UTF-16 at even and odd places where NULs
    alternate; characters of the other byte order come out right if they are ASCII, as all patterns are."""
    if len(data) < SHORTEST:
        return []
    texts = [data.decode("latin-1")]
    if _WIDE.search(data):
        texts += [(data[i:] + b"\0" * (1 + (len(data) - i) % 2)).decode("utf-16-le", "replace") for i in (0, 1)]
    return texts


# ---- steps from a layer to deeper ones: what stands at (start, end) is replaced by a text


def _escaped(text: str, at: int) -> tuple[int, int, bool] | None:
    """(end, code, whether it is a byte) of the escape that opens at a place; openers that it stands for are read on."""
    opener, at, found = text[at], at + 1, None
    while True:
        if opener == "%":
            m = _PERCENT.match(text, at)
            code = int(m[0], 16) if m else -1
        else:
            m = _BACKSLASH.match(text, at)
            code = int(m[m.lastindex], 16) if m else -1
            if m is None and (m := _QUOTED.match(text, at)):
                return m.end(), _MEANING.get(m[1], ord(m[1])), False
        if m is None:
            return found
        at, found = m.end(), (m.end(), code, opener == "%")
        if code not in (0x25, 0x5C):
            return found
        opener = chr(code)


def unescape_hits(text: str) -> Iterator[tuple[int, int, str]]:
    """(start, end, character) of every escape; bytes that follow each other are read as UTF-8."""
    run: list[tuple[int, int, int]] = []  # bytes of 0x80 and more, side by side
    high = None
    at = 0
    while m := _OPENER.search(text, at):
        start = m.start()
        found = _escaped(text, start)
        if run and (found is None or not found[2] or found[1] < 0x80 or run[-1][1] != start):
            yield from _utf8(run)
            run = []
        if found is None:
            at = start + 1
            continue
        at, code, byte = found
        if byte and code >= 0x80:
            run.append((start, at, code))
        elif high and high[1] == start and 0xDC00 <= code < 0xE000:
            yield high[0], at, chr(0x10000 + ((high[2] - 0xD800) << 10) + code - 0xDC00)
        elif code < 0xD800 or 0xE000 <= code < 0x110000:
            yield start, at, chr(code)
        high = (start, at, code) if 0xD800 <= code < 0xDC00 else None
    yield from _utf8(run)


def _utf8(run: list[tuple[int, int, int]]) -> Iterator[tuple[int, int, str]]:
    i = 0
    while i < len(run):
        size = 4 if run[i][2] >= 0xF0 else 3 if run[i][2] >= 0xE0 else 2
        try:
            c = bytes(b for _, _, b in run[i : i + size]).decode()
        except UnicodeDecodeError:
            size, c = 1, "�"
        yield run[i][0], run[min(i + size, len(run)) - 1][1], c
        i += size


def base64_hits(text: str, others: list[tuple[int, int, str | set[int]]]) -> Iterator[tuple[int, int, str]]:
    """Runs that encode text; `others` gets the (start, end, reading) of those that encode other data, or the kinds found
    in them if they are too large to hold."""
    for m in _BASE64.finditer(text):
        pieces = [(m.start(), m[0])]
        if "\n" in m[0]:  # the last line may be other text
            pieces.append((m.start(), m[0][: m[0].rindex("\n")].removesuffix("\r")))
        if re.search(r"[\n/_-]", m[0]):  # a run may touch other text: its parts are tried where the whole is no text
            pieces += [(m.start() + p.start(), p[0]) for p in re.finditer(r"[A-Za-z0-9+/_-]+={0,2}", m[0]) if "\n" in m[0]]
            pieces += [(m.start() + p.start(), p[0]) for p in re.finditer(r"[A-Za-z0-9+/]{16,}={0,2}", m[0])]
            pieces += [(m.start() + p.start(), p[0]) for p in re.finditer(r"[A-Za-z0-9+]{16,}={0,2}", m[0])]
        done = m.start()
        for at, run in pieces:
            if at < done or (data := _from_base64(run)) is None:
                continue
            packed = _packed(data)
            data, stream = _unpack(data)
            plain = _as_text(data)
            if stream is not None:
                others.append((at, at + len(run), _kinds_in(stream)))
            elif plain is None:
                others += [(at, at + len(run), reading) for reading in _readings(data)]
                if not packed and (raw := _raw_deflate(data)) is not None:
                    data, stream = _bounded(_whole(raw))
                    if stream is not None:
                        others.append((at, at + len(run), _kinds_in(stream)))
                    else:
                        said = _as_text(data)
                        others += [(at, at + len(run), reading) for reading in ([said] if said else _readings(data))]
            else:
                yield at, at + len(run), plain
            if plain is not None or packed:
                done = at + len(run)


# ---- layers


class Layer:
    """A text and, stretch by stretch, where its characters come from: (place in the layer, start and end in the
    document, whether the stretch stands there as it is)."""

    def __init__(self, text: str, stretches: list[tuple[int, int, int, bool]]):
        self.text, self.stretches = text, stretches
        self.starts = [s[0] for s in stretches]

    def places(self, start: int, end: int) -> tuple[int, int, bool]:
        """Start and end in the document, and whether any character between was decoded."""
        i, j = bisect.bisect_right(self.starts, start) - 1, bisect.bisect_left(self.starts, end) - 1
        first, last = self.stretches[i], self.stretches[j]
        a = first[1] + (start - first[0] if first[3] else 0)
        b = last[1] + (end - last[0]) if last[3] else last[2]
        return a, b, i != j or not first[3]

    def part(self, start: int, end: int, at: int) -> Iterator[tuple[int, int, int, bool]]:
        """The stretches of [start, end), told from `at` on."""
        i, j = bisect.bisect_right(self.starts, start) - 1, bisect.bisect_left(self.starts, end)
        for place, a, b, plain in self.stretches[i:j]:
            if plain:
                a, b = a + max(0, start - place), min(b, a + end - place)
            yield at + max(0, place - start), a, b, plain

    def replaced(self, hits: list[tuple[int, int, str]]) -> Iterator[Layer]:
        """A layer for every run of characters in reach of each other in which something is replaced."""
        k = 0
        for m in _REACH.finditer(self.text):
            lo, hi = m.span()
            if k == len(hits):
                return
            if hits[k][0] >= hi:
                continue
            parts, stretches, at, size = [], [], lo, 0
            while k < len(hits) and hits[k][0] < hi:
                start, end, plain = hits[k]
                if start > at:
                    stretches += self.part(at, start, size)
                    parts.append(self.text[at:start])
                    size += start - at
                stretches.append((size, *self.places(start, end)[:2], False))
                parts.append(plain)
                size += len(plain)
                at, k = end, k + 1
            if at < hi:
                stretches += self.part(at, hi, size)
                parts.append(self.text[at:hi])
            yield Layer("".join(parts), stretches)


def find_secrets(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and all spans with those that only decoded layers show: (start, kind number, end), sorted."""
    base = scan(text)
    every = set(base)
    work, seen = [Layer(text, [(0, 0, len(text), True)])], set()
    while work:
        layer = work.pop()
        others: list[tuple[int, int, str | set[int]]] = []
        deepers = [*layer.replaced(list(unescape_hits(layer.text))), *layer.replaced(list(base64_hits(layer.text, others)))]
        for start, end, what in others:
            a, b, _ = layer.places(start, end)
            if isinstance(what, set):
                every |= {(a, kind, b) for kind in what}
            else:
                deepers.append(Layer(what, [(0, a, b, False)]))
        for deeper in deepers:
            key = *deeper.places(0, len(deeper.text))[:2], hashlib.sha256(deeper.text.encode("utf-8", "surrogatepass")).digest()
            if key in seen:
                continue
            seen.add(key)
            work.append(deeper)
            for start, kind, end in scan(deeper.text):
                a, b, decoded = deeper.places(start, end)
                if decoded:
                    every.add((a, kind, b))
    return base, sorted(every)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def redact(text: str, spans: list[tuple[int, int, int]], mask: str = "[REDACTED]") -> str:
    """Text with every stretch that spans cover replaced by the mask, overlapping spans by one."""
    parts, at = [], 0
    for start, _, end in spans:
        if start >= at:
            parts += [text[at:start], mask]
        at = max(at, end)
    return "".join([*parts, text[at:]])


def scan_secrets(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), redacted: str | None = None) -> DataFrame:
    """`keep` columns, n_assign, n_access, n_hex, base_spans, spans, and under the name `redacted` (if given) the text
    without its secrets (null where the text is null). One pass without a shuffle."""
    batch_rows(docs.sparkSession, 1000)
    schema = docs.select(*keep).schema
    for c in ("n_assign", "n_access", "n_hex"):
        schema = schema.add(c, "long", False)
    schema = schema.add("base_spans", "string", False).add("spans", "string", False)
    if redacted:
        schema = schema.add(redacted, "string", True)

    def run(batches):
        for batch in batches:
            texts = batch.column(len(keep)).to_pylist()
            found = [find_secrets(t or "") for t in texts]
            arrays = [pa.array([sum(k == n for _, k, _ in base) for base, _ in found], pa.int64()) for n in range(3)]
            arrays += [pa.array([joined(base) for base, _ in found], pa.string()), pa.array([joined(s) for _, s in found], pa.string())]
            if redacted:
                arrays.append(pa.array([t and redact(t, s) for t, (_, s) in zip(texts, found)], pa.string()))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *arrays], schema.names)

    return docs.select(*keep, F.col(text).alias("__text")).mapInArrow(run, schema)


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_assign", "n_access", "n_hex", F.sha2("base_spans", 256).alias("base_sha256"), "spans"
    )
