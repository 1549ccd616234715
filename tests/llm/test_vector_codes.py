"""Operator 11 against a plain Lloyd iteration that compares every part with all entries."""

from __future__ import annotations

import collections

import numpy as np
import pytest

from annolith.llm import vector_codes as vc
from annolith.llm.common import lookup, stored

SCHEMA = "vec_id long, embedding array<float>, label int, code string, own int"


def _plain(rows, parts=vc.PARTS, entries=vc.ENTRIES, rounds=vc.ROUNDS):
    """{(id, label): [(code, error)]} and the final codebooks, part by part with whole numbers only."""
    good = [(i, tuple(int(np.floor(256 * float(np.float32(x)))) for x in v), lab) for i, v, lab, *_ in rows if v and all(x is not None and np.isfinite(x) for x in v)]
    d = max((len(q) for _, q, _ in good), default=0)
    good = [g for g in good if len(g[1]) == d]
    good.sort(key=lambda g: (g[0] is None, g[0] or 0, g[1]))
    w, out, books = d // parts, [["", 0] for _ in good], []
    for j in range(parts):
        x = [g[1][j * w : (j + 1) * w] for g in good]
        book = x[:entries]

        def nearest(p, book):
            dist = [sum((a - b) ** 2 for a, b in zip(p, c)) for c in book]
            return dist.index(min(dist)), min(dist)

        for _ in range(rounds):
            own = [nearest(p, book)[0] for p in x]
            book = [tuple(sum(v) // len(m) for v in zip(*m)) if (m := [p for p, o in zip(x, own) if o == e]) else book[e] for e in range(len(book))]
        for k, p in enumerate(x):
            o, e = nearest(p, book)
            out[k][0] += f"{o:02x}"
            out[k][1] += e
        books.append(book)
    found = collections.Counter((g[0], g[2], code, error) for g, (code, error) in zip(good, out))
    return found, books


def _check(spark, rows, **how):
    got, books = vc.compress(spark.createDataFrame(rows, SCHEMA), **how)
    got = vc.with_label_errors(got).collect()
    want, want_books = _plain(rows, **how)
    assert collections.Counter((r.id, r.label, r.own.hex(), r.error) for r in got) == want
    assert books.tolist() == [[list(c) for c in b] for b in want_books]
    totals = collections.Counter()
    for (_, label, _, error), n in want.items():
        totals[label] += n * error
    assert all(r.label_error == totals[r.label] for r in got)
    return got


def test_equals_plain_rounds_on_clusters_ties_and_hot_labels(spark):
    rng = np.random.default_rng(1)
    centers = rng.normal(size=(20, 32))
    rows = [(int(i), (centers[i % 20] + rng.normal(size=32) * 0.1).astype(np.float32).tolist(), int(i % 3) if i % 2 else None, "x", 1) for i in rng.permutation(700)]
    rows += [(1000 + i, [float(i % 3 - 1) / 256] * 32, 7, None, None) for i in range(60)]  # equal distances everywhere
    _check(spark, rows)
    _check(spark, rows, parts=4, entries=5, rounds=4)


def test_nulls_repeated_rows_and_odd_vectors(spark):
    v = [0.5] * 16
    rows = [
        (1, None, 1, "a", 1), (2, [], 1, "a", 1), (3, [None] + v[1:], 1, "a", 1), (4, [float("nan")] + v[1:], 1, "a", 1), (5, [float("inf")] + v[1:], 1, "a", 1),
        (6, v[:8], 1, "a", 1), (None, v, None, None, None), (None, [-0.25] * 16, None, None, None), (7, v, 1, "a", 1), (7, v, 1, "a", 1), (7, [1.0] * 16, 2, "b", 2),
    ]
    got = _check(spark, rows)
    assert len(got) == 5 and sorted(r.error for r in got) == [0] * 5


def test_large_components_stay_exact_and_larger_ones_are_an_error(spark):
    rng = np.random.default_rng(2)
    for scale in (300.0, 30_000.0, 400_000.0):
        rows = [(i, (rng.normal(size=16) * scale).astype(np.float32).tolist(), i % 2, None, None) for i in range(120)]
        _check(spark, rows, entries=8)
    with pytest.raises(ValueError, match="long"):
        vc.compress(spark.createDataFrame([(1, [1e20] * 16, 1, None, None)], SCHEMA))
    with pytest.raises(ValueError, match="equal parts"):
        vc.compress(spark.createDataFrame([(1, [1.0] * 17, 1, None, None)], SCHEMA))


def test_empty_table(spark):
    got, books = vc.compress(spark.createDataFrame([], SCHEMA))
    assert vc.with_label_errors(got).count() == 0 and books.size == 0


def test_bounds_spare_most_comparisons_and_lose_no_tie():
    rng = np.random.default_rng(3)
    centers = rng.integers(-4000, 4000, (64, 4)).astype(np.float64)
    x = centers[rng.integers(0, 64, 5000)] + rng.integers(-30, 30, (5000, 4))
    own, near, other = vc.compare_all(x, centers)
    moved = centers + rng.integers(-5, 5, centers.shape)
    o, exact, upper, lower, n = vc.reassign(x, moved, vc.Drift(centers, moved), own, *vc._outward(np.sqrt(near), np.sqrt(other)))
    want = vc.compare_all(x, moved)
    assert (o == want[0]).all() and (exact == want[1]).all() and n < 500
    assert (upper >= np.sqrt(want[1])).all() and (lower <= np.sqrt(want[2])).all()
    small = rng.integers(-2, 3, (3000, 4)).astype(np.float64)  # ties between entries
    book = rng.integers(-2, 3, (64, 4)).astype(np.float64)
    own, near, other = vc.compare_all(small, book)
    new = book + rng.integers(-1, 2, book.shape)
    o, exact, *_ = vc.reassign(small, new, vc.Drift(book, new), own, *vc._outward(np.sqrt(near), np.sqrt(other)))
    want = vc.compare_all(small, new)
    assert (o == want[0]).all() and (exact == want[1]).all()


def test_lookup_of_hot_cold_null_and_absent_keys(spark):
    left = spark.createDataFrame([(i, None if i % 3 == 0 else ("hot" if i % 3 == 1 else f"k{i}")) for i in range(3000)], "i int, key string")
    right = left.groupBy("key").count().withColumnRenamed("count", "n").where("key IS NULL OR key != 'k5'")
    right = stored(right.selectExpr("key", "n", "coalesce(key, 'none') AS v"), "lookup-test")
    got = {r.i: r.v for r in lookup(left, right, "key", "n", ["i"]).collect()}
    assert len(got) == 3000 and got[0] == "none" and got[1] == "hot" and got[2] == "k2" and got[5] is None
