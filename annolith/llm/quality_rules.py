"""Quality rules as a short-circuit cascade.

One pass over a text yields the base statistics, which every row returns. The verdict is a conjunction of rules, so
their order changes the cost and never the result. Some rules compare base statistics, others read the text again, at
costs from a scan of its bytes to a sort of all its 10-word windows; what a rule needs beyond the base is computed when
it is asked and kept for the rules after it. `estimate` runs every rule on a sample where the rows are, times it and notes
what it rejects; `plan_cascade` orders greedily by the share rejected, of what the rules before leave, per second. A row
stops at its first rejecting rule, which is returned as `rejected_by` (so that column, unlike `kept`, may vary with the
order).

Defined cases: a null text is empty, has no words and fails the base; ties and repeated rows are judged each; texts are
read whole, whatever their length; an empty table gives an empty result (the rules then keep their written order); other
columns are ignored.
"""

from __future__ import annotations

import functools
import time
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch_rows, table

#: Rows, about, from which cost and selectivity are estimated; the verdict does not depend on them.
SAMPLE_ROWS = 400
_SPACES = " \t\n\x0b\x0c\r"
_SYMBOLS = "#*$%&|<>"


class Stats:
    """Base statistics of a text, and what further rules ask for."""

    def __init__(self, text: str):
        self.text = text
        self.lines = [x for x in text.split("\n") if x.strip(_SPACES)]
        self.words = text.encode("utf-8", "surrogatepass").split()  # bytes split at exactly the six ASCII spaces
        self.word_chars = len(text) - sum(map(text.count, _SPACES))
        self.n_symbols = sum(map(text.count, _SYMBOLS))
        self.n_dup_lines = len(self.lines) - len(set(self.lines))
        self.codes = word_codes(self.words)
        self.n_repeat_words = repeated_words(self.codes, 3)

    @functools.cached_property
    def kinds(self) -> list[bytes]:
        """The words as letters for what their bytes are: U upper case, l lower case, h of other characters, . the rest."""
        return b" ".join(self.words).translate(_KINDS).split(b" ")


_KINDS = bytes(
    ord("U") if 65 <= b <= 90 else ord("l") if 97 <= b <= 122 else ord("h") if b > 127 else 32 if b == 32 else ord(".") for b in range(256)
)


def word_codes(words: list[bytes]) -> np.ndarray:
    """Equal words have equal numbers, from 0 on."""
    codes: dict[bytes, int] = {}
    return np.fromiter((codes.setdefault(w, len(codes)) for w in words), np.int64, len(words))


def repeated_words(codes: np.ndarray, window: int) -> int:
    """Words inside windows of so many words that occur twice or more, the first occurrence included."""
    n = len(codes)
    most = int(codes.max(initial=-1)) + 1
    if n <= window or most == n:
        return 0
    key, size = codes, 1
    while size < window:  # numbers of windows of twice the size, or of two that overlap
        step = min(size, window - size)
        if most >= 1 << 31:  # two numbers would no longer fit 63 bits
            key = np.unique(key, return_inverse=True)[1].astype(np.int64)
            most = len(key)
        key = key[: len(key) - step] * most + key[step:]
        size += step
        most = most * most if most < 1 << 31 else 1 << 62
        if size < window and most >= 1 << 31:
            key = np.unique(key, return_inverse=True)[1].astype(np.int64)
            most = len(key)
    _, inverse, counts = np.unique(key, return_inverse=True, return_counts=True)
    starts = np.flatnonzero(counts[inverse] > 1)
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + window, -1)
    return int((np.cumsum(change[:-1]) > 0).sum())


def base_failed(s: Stats) -> bool:
    return len(s.words) < 50 or 100 * s.n_repeat_words > 50 * len(s.words)


def _shouting(s: Stats) -> bool:
    """Over 6 of 10 words have an upper-case letter A-Z and no lower-case one."""
    return 10 * sum(b"U" in k and b"l" not in k for k in s.kinds) > 6 * len(s.words)


def _letterless(s: Stats) -> bool:
    """Over half of the words have neither a letter A-Z, a-z nor a character outside ASCII."""
    return 2 * sum(not k.strip(b".") for k in s.kinds) > len(s.words)


def _marked(s: Stats) -> bool:
    """Over 9 of 10 lines begin with a list mark."""
    return 10 * sum(x.lstrip(_SPACES)[0] in "-*\u2022\u25cf" for x in s.lines) > 9 * len(s.lines)


def _broken_off(s: Stats) -> bool:
    """Over half of the lines end with three dots or an ellipsis."""
    return 2 * sum(x.rstrip(_SPACES).endswith(("...", "\u2026")) for x in s.lines) > len(s.lines)


def _recited(s: Stats) -> bool:
    """Over 4 of 10 words are in 10-word windows that occur twice or more."""
    return 10 * repeated_words(s.codes, 10) > 4 * len(s.words)


#: Rules that reject, by name; all are exact integer comparisons over the whole text.
RULES: dict[str, Callable[[Stats], bool]] = {
    "recited": _recited,
    "shouting": _shouting,
    "letterless": _letterless,
    "marked": _marked,
    "broken_off": _broken_off,
    "symbols": lambda s: 10 * s.n_symbols > len(s.words),
    "duplicate_lines": lambda s: 2 * s.n_dup_lines > len(s.lines),
    "long_words": lambda s: s.word_chars > 20 * len(s.words),
    "short_words": lambda s: s.word_chars < 2 * len(s.words),
}

#: Of a sampled text: for each rule in turn whether it rejects, and its seconds.
Outcome = tuple[list[bool], list[float]]


def outcome(text: str, rules: dict[str, Callable[[Stats], bool]]) -> Outcome | None:
    """None for a text that fails the base, which no rule sees. Rules that share work are charged with it each."""
    s = Stats(text)
    if base_failed(s):
        return None
    rejects, seconds = [], []
    for rule in rules.values():
        s.__dict__.pop("kinds", None)
        began = time.perf_counter()
        rejects.append(bool(rule(s)))
        seconds.append(time.perf_counter() - began)
    return rejects, seconds


def plan_cascade(outcomes: list[Outcome], rules: dict[str, Callable[[Stats], bool]] | None = None) -> list[tuple[str, float, float]]:
    """(name, share rejected of what the earlier ones left, seconds a text), best rejection per second first; of equal
    ones the cheaper first."""
    names = list(rules or RULES)
    rejects = np.array([r for r, _ in outcomes], bool).reshape(-1, len(names))
    cost = np.array([s for _, s in outcomes]).reshape(-1, len(names)).sum(axis=0) / max(1, len(outcomes)) + 1e-7
    left, order, rest = np.ones(len(outcomes), bool), [], list(range(len(names)))
    while rest:
        gain = {k: float(rejects[left, k].mean()) if left.any() else 0.0 for k in rest}
        best = max(rest, key=lambda k: (gain[k] / cost[k], -cost[k] if len(outcomes) else 0))
        order.append((names[best], gain[best], float(cost[best])))
        left &= ~rejects[:, best]
        rest.remove(best)
    return order


def estimate(docs: DataFrame, text: str = "text", rules: dict | None = None, rows: int = SAMPLE_ROWS) -> list[Outcome]:
    """Outcomes of about `rows` texts, each drawn by itself so that copies of one do not all come, run where the rows are.
    Only verdicts and times reach the driver."""
    rules = rules or RULES
    few = docs.select(F.col(text).alias("t")).where(F.rand(4) * docs.count() < rows)

    def run(batches):
        for batch in batches:
            found = [x for t in batch.column(0).to_pylist() if (x := outcome(t or "", rules))]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r for r, _ in found], pa.list_(pa.bool_())), pa.array([s for _, s in found], pa.list_(pa.float64()))], ["rejects", "seconds"]
            )

    return [(r.rejects, r.seconds) for r in few.mapInArrow(run, "rejects array<boolean>, seconds array<double>").collect()]


def quality_rules(
    docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), rules: dict | None = None, sample: list[Outcome] | None = None
) -> DataFrame:
    """`keep` columns, the base statistics, base_failed, kept, rejected_by. One pass without a shuffle."""
    batch_rows(docs.sparkSession, 1000)
    rules = rules or RULES
    order = [n for n, _, _ in plan_cascade(estimate(docs, text, rules) if sample is None else sample, rules)]
    cascade = [(n, rules[n]) for n in order]
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    schema = docs.select(*keep).schema
    for c in counts:
        schema = schema.add(c, "long", False)
    schema = schema.add("base_failed", "boolean", False).add("kept", "boolean", False).add("rejected_by", "string", True)

    def judge(t: str):
        s = Stats(t)
        if base_failed(s):
            by = "base"
        else:
            by = next((n for n, rule in cascade if rule(s)), None)
        return len(s.words), s.word_chars, s.n_symbols, s.n_dup_lines, s.n_repeat_words, by == "base", by is None, by

    def run(batches):
        for batch in batches:
            rows = [judge(t) for t in batch.column(len(keep)).to_pylist()]
            columns = list(zip(*rows)) if rows else [()] * 8
            arrays = [pa.array(c, pa.int64()) for c in columns[:5]]
            arrays += [pa.array(columns[5], pa.bool_()), pa.array(columns[6], pa.bool_()), pa.array(columns[7], pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *arrays], schema.names)

    return docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("__text")).mapInArrow(run, schema)


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents")).drop("rejected_by")


OP4_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT r, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d
), pos AS (
  SELECT r, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w
), win AS (
  SELECT r, i, word || ' ' || lead(word, 1) OVER o || ' ' || lead(word, 2) OVER o AS tri FROM pos WINDOW o AS (PARTITION BY r ORDER BY i)
), twice AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, tri) AS n FROM win WHERE tri IS NOT NULL) WHERE n > 1
), rep AS (
  SELECT r, count(DISTINCT i + k) AS n_repeat_words FROM twice, range(3) t(k) GROUP BY r
), win10 AS (
  SELECT r, i, array_to_string(list_slice(ws, i, i + 9), ' ') AS ten
  FROM (SELECT r, ws, unnest(range(1, len(ws) - 8)) AS i FROM w WHERE len(ws) > 10)
), twice10 AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, ten) AS n FROM win10) WHERE n > 1
), rep10 AS (
  SELECT r, count(DISTINCT i + k) AS n_recited FROM twice10, range(10) t(k) GROUP BY r
), line AS (
  SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT x) AS n_dup_lines,
    count(*) FILTER (WHERE regexp_matches(x, '^[\x20\x09-\x0D]*[-*•●]')) AS n_marked,
    count(*) FILTER (WHERE regexp_matches(x, '(\.\.\.|…)[\x20\x09-\x0D]*$')) AS n_broken_off
  FROM (SELECT r, unnest(string_split(text, chr(10))) AS x FROM d) WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY r
), up AS (
  SELECT r, count(*) FILTER (WHERE regexp_matches(word, '[A-Z]') AND NOT regexp_matches(word, '[a-z]')) AS n_upper,
    count(*) FILTER (WHERE NOT regexp_matches(word, '[^\x00-\x40\x5B-\x60\x7B-\x7F]')) AS n_letterless
  FROM pos GROUP BY r
), s AS (
  SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_lines, 0) AS n_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_upper, 0) AS n_upper, coalesce(n_letterless, 0) AS n_letterless,
    coalesce(n_recited, 0) AS n_recited, coalesce(n_marked, 0) AS n_marked, coalesce(n_broken_off, 0) AS n_broken_off
  FROM w LEFT JOIN rep USING (r) LEFT JOIN rep10 USING (r) LEFT JOIN line USING (r) LEFT JOIN up USING (r)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND NOT (10 * n_symbols > n_words)
    AND NOT (2 * n_dup_lines > n_lines) AND NOT (word_chars > 20 * n_words) AND NOT (word_chars < 2 * n_words)
    AND NOT (10 * n_upper > 6 * n_words) AND NOT (2 * n_letterless > n_words) AND NOT (10 * n_recited > 4 * n_words)
    AND NOT (10 * n_marked > 9 * n_lines) AND NOT (2 * n_broken_off > n_lines) AS kept
FROM s
"""
