"""Operator 12 and its suffix arrays against brute force."""

from __future__ import annotations

import collections
import hashlib
import random

import numpy as np
import pytest

from annolith.llm import repeats
from annolith.llm.suffix_array import common_prefixes, needed_suffixes, smaller_than_successor, suffix_array

SCHEMA = "doc_id long, text string, n_bytes string, spans int"


def _text(rng, n, alphabet=b"abcab \n"):
    return bytes(rng.choice(alphabet) for _ in range(n))


@pytest.mark.parametrize("kind", ["random", "few", "one", "runs", "periodic", "all bytes", "empty"])
def test_suffix_array_orders_all_suffixes(kind):
    rng = random.Random(kind)
    t = {
        "random": _text(rng, 3000, bytes(range(97, 123))), "few": _text(rng, 3000, b"ab"), "one": b"z" * 400, "runs": b"".join(bytes([rng.choice(b"abz")]) * rng.randint(1, 90) for _ in range(60)),
        "periodic": b"abcabd" * 300, "all bytes": _text(rng, 3000, bytes(range(256))), "empty": b"",
    }[kind]
    a = np.frombuffer(t, np.uint8)
    depth = 40
    order = suffix_array(a, depth).tolist()
    assert sorted(order) == list(range(len(t)))
    padded = t + bytes(depth)
    keys = [padded[i : i + depth] for i in order]
    assert keys == sorted(keys)
    types = smaller_than_successor(a)
    assert types.tolist() == [t[i:] < t[i + 1 :] for i in range(len(t))]
    wanted = np.array([rng.random() < 0.3 for _ in t], bool)
    some = suffix_array(a, depth, wanted)
    assert sorted(some.tolist()) == np.flatnonzero(wanted).tolist()
    keys = [padded[i : i + depth] for i in some]
    assert keys == sorted(keys)
    assert needed_suffixes(wanted, types)[wanted].all()
    got = common_prefixes(a, some, depth).tolist()

    def common(i, j):
        n = 0
        while n < depth and max(i, j) + n < len(t) and t[i + n] == t[j + n]:
            n += 1
        return n

    assert got == [common(i, j) for i, j in zip(some[:-1], some[1:])]


def test_equal_windows_have_equal_anchors():
    rng = random.Random(4)
    passage = _text(rng, 900)
    texts = [_text(rng, rng.randint(0, 700)) + passage[rng.randint(0, 300) : rng.randint(500, 900)] + _text(rng, rng.randint(0, 700)) for _ in range(40)] + [b"q" * 500, b"", b"ab" * 400]
    raw = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.cumsum([len(t) for t in texts])
    starts = np.concatenate([[0], ends[:-1]])
    text, lo, n, at, h = repeats.anchors_of(raw, starts, ends)
    seen, windows = {}, 0
    for t, a, w, p, hash_ in zip(text.tolist(), lo.tolist(), n.tolist(), at.tolist(), h.tolist()):
        assert starts[t] <= a and a + w - 1 + 200 <= ends[t]
        windows += w
        for i in range(a, a + w):
            assert i <= p <= i + 140
            assert seen.setdefault(raw[i : i + 200].tobytes(), (p - i, hash_)) == (p - i, hash_)
    assert windows == sum(max(0, len(t) - 199) for t in texts)


def test_anchors_do_not_depend_on_segments(monkeypatch):
    rng = random.Random(5)
    b = np.frombuffer(_text(rng, 20_000), np.uint8)
    one = [x for x in (np.array([0]), np.array([len(b)]))]

    def windows():
        _, lo, n, at, h = repeats.anchors_of(b, *one)
        return [(i, p, k) for a, w, p, k in zip(lo.tolist(), n.tolist(), at.tolist(), h.tolist()) for i in range(a, a + w)]

    whole = windows()
    monkeypatch.setattr(repeats, "_SEGMENT", 777)
    assert windows() == whole


def _plain(texts, length):
    """Per text (bytes, removed, runs, digest of the rest): every window of every text is counted."""
    raws = [(t or "").encode() for t in texts]
    count = collections.Counter(r[i : i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for r in raws:
        gone = np.zeros(len(r), bool)
        for i in range(len(r) - length + 1):
            if count[r[i : i + length]] > 1:
                gone[i : i + length] = True
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((len(r), int(gone.sum()), runs, hashlib.sha256(np.frombuffer(r, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


def _check(spark, texts, length=200, **how):
    docs = spark.createDataFrame([(i if i % 7 else None, t, "x", i) for i, t in enumerate(texts)], SCHEMA)
    got = repeats.repeat_spans(docs, length=length, **how).collect()
    want = _plain(texts, length)
    ids = [i if i % 7 else None for i in range(len(texts))]
    assert collections.Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == collections.Counter((i, *w) for i, w in zip(ids, want))
    assert all(sum(b - a for a, b in r.spans) == r.n_removed and len(r.spans) == r.n_spans for r in got)
    return want


def _corpus(seed):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 9))) + rng.choice(["", "é", "日", ","]) for _ in range(400)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage, base, head = say(80), say(300).split(" "), say(33)
    texts = [say(rng.randint(0, 120)) for _ in range(40)]
    texts += [f"{say(rng.randint(0, 60))} {passage} {say(rng.randint(0, 60))}" for _ in range(30)]  # a passage of many
    for _ in range(25):  # near copies
        near = list(base)
        for _ in range(4):
            near[rng.randrange(len(near))] = rng.choice(words)
        texts.append(" ".join(near))
    texts += [texts[0] + texts[1]] * 5 + [head + say(50), head + say(50)]
    texts += [None, "", "x", "a" * 199, "b" * 200, "c" * 201, "d" * 5000, "xyz" * 200, "é" * 150, "日本" * 60 + "語", " ".join([passage] * 3), say(30_000)]
    own = say(60)
    texts += [f"{own} one {own} two"]  # within one document
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("stretches", [repeats.STRETCHES, 3])
def test_equals_brute_force(spark, monkeypatch, stretches):
    """Also with anchors whose windows are counted instead, and with many groups of texts and blocks."""
    monkeypatch.setattr(repeats, "GROUP_BYTES", 20_000)
    monkeypatch.setattr(repeats, "BLOCK_BYTES", 10_000)
    want = _check(spark, _corpus(1), stretches=stretches)
    assert sum(w[1] > 0 for w in want) > 60 and sum(0 < w[1] < w[0] for w in want) > 40


def test_other_lengths(spark):
    _check(spark, _corpus(2), length=50)


def test_edges(spark):
    _check(spark, [])
    _check(spark, [None, "", None])
    _check(spark, ["a" * 200, "a" * 200])
    _check(spark, ["b" * 199, "b" * 199])


def test_documents_keep_their_columns(spark):
    rng = random.Random(3)
    shared, own = _text(rng, 250, b"abcdefgh").decode(), _text(rng, 60, b"ijkl").decode()
    docs = spark.createDataFrame([(1, own + shared, "n", 5), (2, shared, None, None), (None, None, "x", 1), (4, "short", "y", 2)], SCHEMA)
    got = repeats.without_repeats(docs)
    assert got.columns == docs.columns
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(1, own, "n", 5), (2, "", None, None), (None, None, "x", 1), (4, "short", "y", 2)], key=str)


def test_query_equals_brute_force_on_the_smallest_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    want = _plain([r.text for r in docs], 200)
    got = repeats.op12(spark, sf_dir).collect()
    assert collections.Counter(map(tuple, got)) == collections.Counter((r.doc_id, *w) for r, w in zip(docs, want))
