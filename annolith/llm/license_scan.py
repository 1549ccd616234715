"""License scan by conditional compression.

1. Candidates. A text is cut into sentences, and long ones into overlapping windows of WINDOW words. Each is compressed
   alone and with all templates together as one raw zstandard dictionary; where that saves GATE of its size or SAVED
   bytes, it is a candidate, and so is one that has all the telling words of a template, as a short notice saves little
   in a long window. No other word decides. Candidates that are near each other make a block, with what is around it.
2. Ranking. A block is compressed with each template as raw dictionary; the relative reductions rank the templates.
3. Confirming. Down the ranking, each template is aligned with the block word by word (Myers' bit vectors), with any
   stretch of it. A stretch confirms it if at most TOLERANCE of the template's words are replaced, missing or added and
   all words that tell this license from its relatives are there. The first one that is confirmed wins; among the wordings of
   its license, and of those whose reduction is level with its own (LEVEL), the one with most words in agreement less
   differences stands in that place. What is left before and behind it is ranked again. Templates of which more words are missing from the block than the tolerance allows cannot
   be confirmed and are passed over.
4. A candidate outside the notices counts as unconfirmed if it is much like a template (UNKNOWN), or speaks of a license
   with words of the templates beside; a bare `license` says nothing.

`SPDX-License-Identifier:` tags are read as what they are: an expression of identifiers, each a finding.

Defined cases: a null text is empty and has no license; of equally good stretches the first one stands, of equally ranked
templates that of the smaller name; repeated rows and blocks are judged each; texts of any length are read whole, in time
linear in the length; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import bisect
import functools
import re
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession

from .common import batch_rows, table
from .license_texts import TEMPLATES, Template, from_folder

__all__ = ["TEMPLATES", "Finding", "LicenseScanner", "Template", "from_folder", "op2", "scan_licenses"]

_SENTENCE = re.compile(r"[^\n]+?(?:[.:;!?](?=\s)|(?=\n)|\Z)")
_WORD = re.compile(r"[a-z]+|[0-9]+|[^\x00-\x7f]+")
#: An identifier, any number of others after operators, and parentheses.
_ID = r"\(*[ \t]*[A-Za-z0-9][A-Za-z0-9.+-]*[ \t]*\)*"
_TAG = re.compile(rf"SPDX-License-Identifier:[ \t]*({_ID}(?:[ \t]*\b(?:AND|OR|WITH)\b[ \t]*{_ID})*)")
_IDENTIFIER = re.compile(r"[A-Za-z0-9][A-Za-z0-9.+-]*")
_LICENSE = re.compile(r"licen[cs]e[ds]?|copyleft")
#: Words of a window, and how many of them the next one shares.
WINDOW, SHARED = 40, 20
#: Characters around a candidate that belong to its block.
NEAR = 200
#: Share of the size, or bytes, that the dictionary of all templates must save for a candidate.
GATE, SAVED = 0.2, 8
#: Differing words allowed, as a share of the template's words.
TOLERANCE = 0.25
#: Reductions that differ by no more than this share of them are level: compression does not tell these templates apart.
LEVEL = 0.05
#: Share of the size saved by which a candidate without any notice is a license of some kind.
UNKNOWN = 0.35


def words_of(text: str) -> tuple[str, ...]:
    return tuple(_WORD.findall(text.lower()))


def distances(own: tuple[str, ...], block: tuple[str, ...], anchored: bool = False) -> list[int]:
    """For each place of the block the least number of replaced, missing and added words between `own` and a stretch
    that ends there, from the block's start if `anchored` (Myers' bit vectors, a bit a word)."""
    at: dict[str, int] = {}
    for i, w in enumerate(own):
        at[w] = at.get(w, 0) | 1 << i
    mask, top = (1 << len(own)) - 1, 1 << len(own) - 1
    more, less, n, out = mask, 0, len(own), []
    for w in block:
        same = at.get(w, 0)
        across = (((same & more) + more) ^ more) | same
        down = same | less
        up, off = (less | ~(across | more)) & mask, more & across
        n += bool(up & top) - bool(off & top)
        out.append(n)
        up = up << 1 | anchored
        more, less = (off << 1 | ~(down | up)) & mask, up & down & mask
    return out


@dataclass(frozen=True)
class Finding:
    """start and end in code points; license None: unconfirmed."""

    start: int
    end: int
    license: str | None
    reduction: float
    differences: int


class LicenseScanner:
    def __init__(self, templates: tuple[Template, ...] = TEMPLATES):
        self.templates = templates
        self.words = [words_of(t.text) for t in templates]
        self.sets = [frozenset(ws) for ws in self.words]
        self.telling = [frozenset(words_of(t.telling)) for t in templates]
        self.keys = sorted({keys for keys in self.telling if keys}, key=sorted)
        self.limits = [int(TOLERANCE * len(ws)) for ws in self.words]
        self.vocabulary = frozenset(w for ws in self.words for w in ws)
        plain = {"write_checksum": False, "write_content_size": False, "write_dict_id": False}

        def settings(size: int) -> zstandard.ZstdCompressionParameters:
            """Of the same kind for all, with a hash table that has room for every place of the dictionary."""
            room = max(12, size.bit_length() + 1)
            return zstandard.ZstdCompressionParameters(
                compression_level=3, strategy=zstandard.STRATEGY_DFAST, min_match=5, hash_log=room, chain_log=room, window_log=max(17, room), **plain
            )

        def given(text: str) -> zstandard.ZstdCompressor:
            content = text.lower().encode()
            words = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            words.precompute_compress(compression_params=settings(len(content)))
            return zstandard.ZstdCompressor(dict_data=words, compression_params=settings(len(content)))

        self.alone = zstandard.ZstdCompressor(compression_params=settings(0))
        self.each = [given(t.text) for t in templates]
        self.all = given("\n".join(t.text for t in templates))
        self.judge = functools.lru_cache(maxsize=4096)(self._judge)

    def reduction(self, block: str, compressor: zstandard.ZstdCompressor | None = None) -> tuple[float, int]:
        """The share of the block's compressed size that a dictionary saves, and the bytes; by all templates if none is named."""
        data = block.lower().encode("utf-8", "surrogatepass")
        size = len(self.alone.compress(data))
        saved = size - len((compressor or self.all).compress(data))
        return saved / size, saved

    def candidates(self, text: str) -> list[tuple[int, int, float, int]]:
        """(start, end, share saved, bytes saved) of the sentences and windows that templates help to compress, or that
        have the telling words of one."""
        out, has = [], set(words_of(text))
        telling = [keys for keys in self.keys if keys <= has]
        for m in _SENTENCE.finditer(text):
            for lo, hi in self._windows(text, *m.span()):
                share, saved = self.reduction(text[lo:hi])
                if share >= GATE or saved >= SAVED or telling and any(keys.issubset(words_of(text[lo:hi])) for keys in telling):
                    out.append((lo, hi, share, saved))
        return out

    @staticmethod
    def _windows(text: str, lo: int, hi: int) -> list[tuple[int, int]]:
        if hi - lo <= 4 * WINDOW:  # of words of three letters at least
            return [(lo, hi)]
        starts = [m.start() for m in re.finditer(r"\S+", text[lo:hi])]
        if len(starts) <= WINDOW:
            return [(lo, hi)]
        firsts = range(0, max(1, len(starts) - SHARED), WINDOW - SHARED)
        return [(lo + starts[i], lo + starts[i + WINDOW] if i + WINDOW < len(starts) else hi) for i in firsts]

    def rank(self, block: str, which: list[int]) -> dict[int, tuple[float, int]]:
        """Reduction by each of these templates and its rank, largest first, equal ones by name."""
        found = {i: self.reduction(block, self.each[i])[0] for i in which}
        order = sorted(which, key=lambda i: (-found[i], self.templates[i].license, i))
        return {i: (found[i], k) for k, i in enumerate(order)}

    def stretches(self, block: tuple[str, ...], i: int) -> list[tuple[int, int, int]]:
        """(differing words, start, end) of the stretches of a block that confirm a template."""
        own, limit, found, ends = self.words[i], self.limits[i], [], []
        for n, end in sorted((n, k + 1) for k, n in enumerate(distances(own, block)) if n <= limit):
            k = bisect.bisect_left(ends, end)  # one stretch for all ends of an occurrence
            if any(abs(x - end) <= len(own) // 2 for x in ends[max(0, k - 1) : k + 1]):
                continue
            back = distances(own[::-1], block[max(0, end - len(own) - limit) : end][::-1], anchored=True)
            start = end - min((x, abs(j + 1 - len(own)), j + 1) for j, x in enumerate(back))[2]
            while start < end and block[start] not in self.sets[i]:
                start += 1
            last = end
            while start < last and block[last - 1] not in self.sets[i]:
                last -= 1
            if self.telling[i] <= set(block[start:last]):
                bisect.insort(ends, end)
                found.append((n, start, last))
        return found

    def _judge(self, block: str) -> tuple[tuple[int, int, str, float, int], ...]:
        """(start, end, license, reduction, differences) of the notices in a block, which do not overlap."""
        low = block.replace("İ", "i").lower()  # of the same length
        places = [m.span() for m in _WORD.finditer(low)]
        ws = tuple(low[a:b] for a, b in places)
        taken: list[tuple[int, int, int, int, float]] = []
        rests = [(0, len(ws))]
        while rests:
            lo, hi = rests.pop()
            own = ws[lo:hi]
            has = set(own)
            able = [i for i, words in enumerate(self.sets) if self.telling[i] <= has and len(words - has) <= self.limits[i]]
            if not able:
                continue
            ranked = self.rank(low[places[lo][0] : places[hi - 1][1]], able)
            for i in sorted(able, key=lambda i: ranked[i][1]):
                if found := self.stretches(own, i):
                    n, a, b = min(found)
                    # the ranking has chosen the license, or licenses that it does not tell apart; of their wordings the
                    # one that agrees in most words stands there
                    level = ranked[i][0]
                    same = [k for k in able if self.templates[k].license == self.templates[i].license or abs(ranked[k][0] - level) <= LEVEL * abs(level)]
                    close = [(len(self.words[k]) - 2 * n_, -ranked[k][1], -x, y, k, n_) for k in same for n_, x, y in self.stretches(own, k) if x < b and a < y]
                    _, _, a, b, i, n = max(close)
                    taken.append((lo - a, lo + b, i, n, ranked[i][0]))
                    rests += [(lo, lo - a), (lo + b, hi)]
                    break
        return tuple((places[a][0], places[b - 1][1], self.templates[i].license, share, n) for a, b, i, n, share in sorted(taken))

    def scan(self, text: str) -> list[Finding]:
        tags = [
            Finding(m.start(1) + x.start(), m.start(1) + x.end(), x[0], 1.0, 0)
            for m in _TAG.finditer(text)
            for x in _IDENTIFIER.finditer(m[1])
            if x[0] not in ("AND", "OR", "WITH")
        ]
        candidates = self.candidates(text)
        blocks: list[list[int]] = []
        for lo, hi, *_ in candidates:
            lo, hi = max(0, lo - NEAR), min(len(text), hi + NEAR)
            if blocks and lo <= blocks[-1][1]:
                blocks[-1][1] = max(hi, blocks[-1][1])
            else:
                blocks.append([lo, hi])
        found = [Finding(lo + a, lo + b, *rest) for lo, hi in blocks for a, b, *rest in self.judge(text[lo:hi])]
        known = sorted([*tags, *found], key=lambda f: f.start)
        unsure: list[Finding] = []
        starts, ends = [f.start for f in known], [f.end for f in known]
        for lo, hi, share, _ in candidates:
            if unsure and lo < unsure[-1].end or bisect.bisect_right(ends, lo) < bisect.bisect_left(starts, hi):
                for a, b in self._rests(lo if not unsure else max(lo, unsure[-1].end), hi, known, starts, ends):
                    if self._speaks(text[a:b], True):
                        unsure.append(Finding(a, b, None, self.reduction(text[a:b])[0], 0))
            elif share >= UNKNOWN and len(words_of(text[lo:hi])) > 4 or self._speaks(text[lo:hi]):
                unsure.append(Finding(lo, hi, None, share, 0))
        return sorted([*known, *unsure], key=lambda f: f.start)

    @staticmethod
    def _rests(lo: int, hi: int, known: list[Finding], starts: list[int], ends: list[int]):
        """What of a candidate is in no notice."""
        at = lo
        for f in known[bisect.bisect_right(ends, lo) : bisect.bisect_left(starts, hi)]:
            if f.start > at:
                yield at, f.start
            at = max(at, f.end)
        if at < hi:
            yield at, hi

    def _speaks(self, text: str, rest: bool = False) -> bool:
        """Whether a candidate speaks of a license and has more of the templates' words around than a bare mention has;
        what is left over beside a notice needs as many."""
        ws = words_of(text)
        spoken = [i for i, w in enumerate(ws) if _LICENSE.fullmatch(w)]
        near = {j for i in spoken for j in range(max(0, i - 4), min(len(ws), i + 5)) if j not in spoken}
        return bool(spoken) and sum(ws[j] in self.vocabulary for j in near) > 2


def scan_licenses(
    docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), templates: tuple[Template, ...] = TEMPLATES
) -> DataFrame:
    """`keep` columns, licenses (sorted names), n_confirmed, n_unconfirmed, n_differences, spans (name:start:end of
    code points, `unknown` if unconfirmed). One pass without a shuffle; the templates go to the tasks with the code."""
    batch_rows(docs.sparkSession, 1000)
    schema = docs.select(*keep).schema.add("licenses", "string", False)
    for c in ("n_confirmed", "n_unconfirmed", "n_differences"):
        schema = schema.add(c, "long", False)
    schema = schema.add("spans", "string", False)

    def run(batches):
        scanner = LicenseScanner(templates)
        for batch in batches:
            found = [scanner.scan(t or "") for t in batch.column(len(keep)).to_pylist()]
            arrays = [
                pa.array([",".join(sorted({f.license for f in x if f.license})) for x in found], pa.string()),
                pa.array([sum(f.license is not None for f in x) for x in found], pa.int64()),
                pa.array([sum(f.license is None for f in x) for x in found], pa.int64()),
                pa.array([sum(f.differences for f in x) for x in found], pa.int64()),
                pa.array([",".join(f"{f.license or 'unknown'}:{f.start}:{f.end}" for f in x) for x in found], pa.string()),
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *arrays], schema.names)

    return docs.select(*keep, docs[text].alias("__text")).mapInArrow(run, schema)


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))
