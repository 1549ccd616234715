"""Packing, decontamination, archives, near duplicates and the pipeline, against brute-force versions."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from annolith.llm import decontaminate, fm_index, graph, near_dedup, packing, quality_rules, secret_scan, warc
from annolith.llm.bpe import load_tokenizer
from annolith.llm.common import table, tokenizer_path

from .test_text_operators import DOCS, EDGES

# ---- packing


def _best_fit_decreasing(lengths, capacity):
    gaps, n = [], 0
    for x in sorted(lengths, reverse=True):
        fits = [i for i, g in enumerate(gaps) if g >= x]
        if fits:
            gaps[min(fits, key=lambda i: gaps[i])] -= x
        else:
            n += 1
            gaps.append(capacity - x)
    return n


def _check_plan(histogram, capacity):
    plan = packing.plan_packing(dict(histogram), capacity)
    used, ranks = collections.defaultdict(list), collections.Counter()
    for m in sorted(plan, key=lambda m: (m.length, m.rank)):
        assert m.rank == ranks[m.length]
        ranks[m.length] += m.count
        for k in range(m.count):
            used[m.sequence + k].append((m.offset, m.length))
    assert ranks == {k: v for k, v in histogram.items() if v}
    for parts in used.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(used)


@pytest.mark.parametrize("low,high", [(1, 64), (10, 40), (1, 10), (30, 64), (33, 33), (21, 22)])
def test_plan_is_valid_and_as_good_as_best_fit(low, high):
    rng = random.Random(low * 100 + high)
    lengths = [rng.randint(low, high) for _ in range(1500)]
    n = _check_plan(collections.Counter(lengths), 64)
    assert n >= math.ceil(sum(lengths) / 64)
    assert n <= 1.02 * _best_fit_decreasing(lengths, 64) + 1


def test_plan_stays_small_at_any_count():
    rng = random.Random(5)
    h = {k: rng.randint(1, 10**9) for k in range(1, 1025)}
    assert len(packing.plan_packing(h)) < 20_000


def test_cut_gives_full_pieces_after_the_first():
    assert list(packing.cut(5, 4)) == [(0, 1), (1, 4)]
    assert list(packing.cut(8, 4)) == [(0, 4), (4, 4)]
    assert list(packing.cut(3, 4)) == [(0, 3)]


def _check_pieces(rows, docs):
    tok = load_tokenizer(tokenizer_path())
    ids = collections.defaultdict(list)
    for doc_id, text in docs:
        ids[doc_id].append(np.array(tok.encode(text or "", add_special_tokens=False).ids + [2], "<u4"))
    sequences = collections.defaultdict(list)
    pieces = collections.Counter()
    for r in rows:
        pieces[r.doc_id, r.piece] += 1
        sequences[r.sequence_id].append((r.offset, r.length))
        assert any(zlib.crc32(x[r.start : r.start + r.length].tobytes()) == r.ids_crc32 and r.start + r.length <= len(x) for x in ids[r.doc_id])
    want = collections.Counter((d, k) for d, xs in ids.items() for x in xs for k in range(-(-len(x) // 1024)))
    assert pieces == want
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    return len(sequences)


def test_packing_of_the_table(spark, sf_dir):
    rows = packing.op3(spark, sf_dir).collect()
    docs = [(r.doc_id, r.text) for r in table(spark, sf_dir, "documents").collect()]
    n = _check_pieces(rows, docs)
    assert n <= 1.02 * math.ceil(sum(r.length for r in rows) / 1024) + 1


def test_packing_edges(spark):
    docs = spark.createDataFrame(EDGES, DOCS).select("*", F.lit(9).alias("length"), F.lit(9).alias("task"), F.lit(1).alias("sequence_id"))
    _check_pieces(packing.pack(docs.repartition(3)).collect(), [(r[0], r[1]) for r in EDGES])
    assert packing.pack(docs.limit(0)).count() == 0
    full = packing.pack(docs, with_ids=True).collect()
    assert all(zlib.crc32(bytes(r.ids)) == r.ids_crc32 for r in full)


# ---- FM-index and decontamination


@pytest.mark.parametrize("seed", range(6))
def test_fm_index_against_scanning(seed):
    rng = np.random.default_rng(seed)
    symbols = int(rng.integers(2, 9))
    text = np.append(rng.integers(0, symbols, int(rng.integers(1, 400))), 0)
    if seed == 5:
        text = np.append(np.tile([1, 2, 1], 100), 0)
        symbols = 3
    index = fm_index.FMIndex(text, symbols, sample_every=4)
    patterns = np.zeros((60, 5), np.int64)
    lengths = rng.integers(1, 6, 60)
    for k, n in enumerate(lengths):
        patterns[k, :n] = rng.integers(1, symbols, n)
    low, high = index.ranges(patterns, lengths)
    for k, n in enumerate(lengths):
        want = [i for i in range(len(text) - n + 1) if (text[i : i + n] == patterns[k, :n]).all()]
        assert sorted(index.locate(np.arange(low[k], max(low[k], high[k]))).tolist()) == want


def _brute_contamination(docs, items, window=10):
    wins = collections.defaultdict(set)
    for item, text in items:
        ws = decontaminate.split_words(text or "")
        n = min(window, len(ws))
        for i in range(len(ws) - n + 1 if ws else 0):
            wins[tuple(ws[i : i + n])].add("" if item is None else str(item))
    out = []
    for doc, text in docs:
        ws, hit, found = decontaminate.split_words(text or ""), set(), set()
        for n in {len(w) for w in wins}:
            for i in range(len(ws) - n + 1):
                if (w := tuple(ws[i : i + n])) in wins:
                    hit |= set(range(i, i + n))
                    found |= wins[w]
        out.append((doc, len(ws), len(hit), tuple(sorted(found))))
    return collections.Counter(out)


@pytest.mark.parametrize("block_bytes", [1 << 25, 200])
def test_contamination_against_brute_force(spark, monkeypatch, block_bytes):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block_bytes)
    rng = random.Random(7)
    vocab = ["a", "B", "c", "Été", "x1", "中"]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(n))) for i, n in enumerate([12, 15, 3, 10, 11, 0, 25, 2, 10])]
    items += [(3, items[3][1]), (None, "c c c c c c c c c c c"), (50, None)]
    docs = [(i, ", ".join(rng.choice(vocab) for _ in range(rng.randint(0, 60)))) for i in range(120)]
    docs += [(200 + i, f"zz yy {t} qq, {t}") for i, (_, t) in enumerate(items) if t]
    docs += [(1, None), (None, items[0][1]), (300, items[0][1]), (300, items[0][1]), (301, items[0][1].upper() + "! " + items[1][1])]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string")
    rows = decontaminate.find_contamination(d, b).collect()
    got = collections.Counter((r.doc_id, r.n_words, sum(e - s for s, e in r.spans), tuple(r["items"])) for r in rows)
    assert got == _brute_contamination(docs, items)


def test_windows_of_a_block_stay_small():
    rng = random.Random(2)
    items = [(str(i), " ".join(f"w{rng.randrange(50_000)}" for _ in range(2_000))) for i in range(100)]
    items += items[:10]
    windows = decontaminate.Windows.of(items)
    size = sum(len(t) for _, t in items)
    arrays = (windows.rows, windows.lengths, windows.first, windows.owners)
    assert sum(x.nbytes for x in arrays) < 10 * size
    wanted = collections.defaultdict(set)
    numbers = windows.words
    for item, t in items:
        ws = t.encode().split()
        for i in range(len(ws) - 9):
            wanted[tuple(numbers[w] for w in ws[i : i + 10])].add(item)
    got = {tuple(row): set(windows.items(k)) for k, row in enumerate(windows.rows.tolist())}
    assert got == wanted and set(windows.lengths) == {10}


def test_a_pass_is_stored_before_the_next_one(spark, monkeypatch):
    """With several blocks no plan has the windows of two of them."""
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 300)
    items = [(i, " ".join(f"{c}{i}" for c in "abcdefghijkl")) for i in range(20)]
    d = spark.createDataFrame([(i, t) for i, t in items], "doc_id long, text string")
    found = decontaminate.find_contamination(d, spark.createDataFrame(items, "item_id long, text string"))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    assert {r.doc_id: list(r["items"]) for r in found.collect()} == {i: [str(i)] for i, _ in items}


def test_contamination_edges(spark, sf_dir):
    docs = spark.createDataFrame(EDGES, DOCS).select("*", F.lit("x").alias("spans"), F.lit("x").alias("items"), F.lit("x").alias("__text"))
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.decontaminate(docs, none).count() == len(EDGES)
    assert decontaminate.decontaminate(docs.limit(0), table(spark, sf_dir, "benchmark")).count() == 0
    one = spark.createDataFrame([(1, "the cat sat on THE mat")], "item_id long, text string")
    cut = decontaminate.decontaminate(docs, one, action="excise")
    assert cut.columns == docs.columns
    assert [r.text for r in cut.where("doc_id IS NULL").collect()] == [""]
    assert decontaminate.decontaminate(docs, one).count() == len(EDGES) - 1


# ---- archives


def _pages(spark):
    big = "<html>" + "x" * 2000
    rows = [
        (1, "https://www.B.example.com:443/p?q=1#f", big),
        (7, "http://b.example.com/p?q=1", big),
        (9, None, big),
        (9, None, big),
        (3, "http://u:p@[bad/ url\r\nX: y", "small é"),
        (4, "http://b.example.com/p?q=1", "small é"),
        (5, "", None),
        (None, "http://z.org", big),
        (6, "http://z.org/\t", "é" * 500),
        (8, "http://z.org/\t", "é" * 500),
        (10, "http://z.org/\t", "é" * 499),
        (11, "http://z.org/\t", "é" * 499),
    ]
    return rows, spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)


def test_archive_round_trip(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_LINES", 2)
    rows, pages = _pages(spark)
    archive = warc.write_archive(pages)
    records = warc.read_captures(archive, warc.captures(pages)).collect()
    got = collections.Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in records)
    assert all(hashlib.sha1(r.payload).hexdigest() == r.payload_digest for r in records if r.record_type == "response")
    holder = {}
    for p, _, h in rows:
        if p is not None:
            holder[h or ""] = max(p, holder.get(h or "", p))
    want = collections.Counter()
    for p, _, h in rows:
        data = (h or "").encode()
        other = len(data) >= 1000 and p != holder[h or ""]
        want[p, len(data), hashlib.sha1(data).hexdigest(), "revisit" if other else "response", holder[h or ""] if other else None] += 1
    assert got == want
    found = warc.lookup(archive, "https://b.example.com/p?q=1")
    assert sorted((r.page_id, r.kind) for r in found) == [(1, "revisit"), (4, "response"), (7, "revisit")]
    assert warc.lookup(archive, "http://nowhere.example/") == []
    assert [r.page_id for r in found] == [1, 4, 7]
    empty = warc.write_archive(pages.limit(0))
    assert warc.read_captures(empty, warc.captures(pages)).count() == 0 and warc.lookup(empty, "http://z.org") == []


def test_captures_are_found_by_bisection(spark, monkeypatch):
    """Of an index of many files and blocks a lookup reads one directory and one block, and lookups in order every block once."""
    monkeypatch.setattr(warc, "BLOCK_LINES", 10)
    pages = spark.range(3000).selectExpr("id AS page_id", "concat('http://h', id % 700, '.org/', id % 3) AS url", "cast(id AS string) AS html").repartition(4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    archive = warc.write_archive(pages)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = warc._files_of(archive)
    blocks = sum(f[-2] for f in files)
    assert sum(f[-1] for f in files) == 3000
    assert blocks >= 300 and len(files) > 1
    rows = [(warc.url_key(r.url), r.page_id) for r in pages.collect()]
    for key, page_id in rows[:40]:
        index = warc.IndexReader(archive.folder, files)
        assert len(list(index.find(key, page_id))) == 1 and index.reads <= 4
        assert len(list(index.find(key, any_id=True))) == sum(k == key for k, _ in rows)
        assert list(index.find(key + "x", page_id)) == [] and list(index.find(key, -1)) == []
    index = warc.IndexReader(archive.folder, files)
    for key, page_id in sorted(rows):
        assert len(list(index.find(key, page_id))) == 1
    assert index.reads <= blocks + 2 * len(files)


def test_archive_of_long_pages_and_clashing_columns(spark):
    long = "<p>é" * 3_000_000
    names = ("key", "file", "offset", "length", "d", "holder", "payload_digest", "refers_to", "__on")
    pages = spark.createDataFrame([(1, "http://a.org", long), (2, "http://a.org", long), (3, "http://a.org", "x")], "page_id long, url string, html string")
    clashing = pages.select("*", *[F.lit("x").alias(c) for c in names])
    got = {r.page_id: (r.record_type, r.payload_bytes, r.refers_to) for r in warc.read_captures(warc.write_archive(clashing), warc.captures(clashing)).collect()}
    assert got == {1: ("revisit", 15_000_000, 2), 2: ("response", 15_000_000, None), 3: ("response", 1, None)}


def test_damage_is_noticed():
    member = warc.encode_record(1, "http://a", b"abc", hashlib.sha1(b"other").hexdigest(), None)
    with pytest.raises(ValueError):
        warc.decode_record(member)


# ---- near duplicates


def test_components_against_union_find(spark):
    rng = random.Random(3)
    edges = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(30)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    df = spark.createDataFrame([e for e in edges if e[0] != e[1]], "a long, b long")
    for one_task in (0, 10**6):
        got = {r.node: r.component for r in graph.components(df, one_task).collect()}
        assert got == {x: find(x) for x in got} and len(got) >= len({x for a, b in edges if a != b for x in (a, b)})


def _classes(docs, idf):
    features = {}
    for i, t in docs:
        h, n = near_dedup.shingles(decontaminate.split_words(t or ""))
        features[i] = h, near_dedup.weights_of(h, n, idf)
    parent = {i: i for i, _ in docs}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = [i for i, _ in docs]
    for k, a in enumerate(ids):
        for b in ids[:k]:
            if len(features[a][0]) and near_dedup.weighted_jaccard(features[a], features[b]) >= near_dedup.SIMILARITY:
                parent[max(find(a), find(b))] = min(find(a), find(b))
    return {i: find(i) for i in ids}


def _corpus(rng):
    def prose(n):
        return [f"w{rng.randint(0, 4000)}" for _ in range(n)]

    docs, shared = [], prose(60)
    for _ in range(25):
        docs.append(prose(rng.randint(1, 200)))
    for _ in range(12):  # near copies at all distances, chains included
        base = prose(200)
        for _ in range(6):
            docs.append(list(base))
            for _ in range(rng.randint(1, 3)):
                base[rng.randrange(len(base))] = f"e{rng.randint(0, 10**6)}"
    for _ in range(20):  # a passage that many documents share
        docs.append(prose(30) + shared + prose(10))
    docs += [docs[3], docs[3], docs[40], [], [], ["one"], ["one"]]
    rng.shuffle(docs)
    return [(i, ("  ".join(d)).upper() if i % 3 else " ".join(d) + ".") for i, d in enumerate(docs)]


@pytest.mark.parametrize("block", [1500, 3])
def test_classes_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(near_dedup, "_BLOCK", block)
    monkeypatch.setattr(near_dedup, "_PER_TASK", block)
    monkeypatch.setattr(near_dedup, "_FEW", 0 if block == 3 else 10**9)
    docs = _corpus(random.Random(11))
    df_counts = np.zeros(near_dedup.DF_SLOTS)
    for _, t in docs:
        h, _ = near_dedup.shingles(decontaminate.split_words(t))
        df_counts[np.unique((h >> np.uint64(64 - 18)).astype(np.int64))] += 1
    want = _classes(docs, near_dedup.idf_of(df_counts, len(docs)))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(df).collect()}
    assert got == want


def _all_links(docs, idf):
    """Every pair of documents whose weighted similarity is 0.8 or more. Weights are between 1 and 1 + gain an occurrence,
    so such a pair has a plain similarity over 0.64 as multisets, and shares one of the rarest 36 % of either's elements."""
    features, elements, seen = [], [], collections.Counter()
    for _, t in docs:
        h, n = near_dedup.shingles(decontaminate.split_words(t or ""))
        features.append((h, near_dedup.weights_of(h, n, idf)))
        elements.append([(x, k) for x, m in zip(h.tolist(), n.tolist()) for k in range(m)])
        seen.update(elements[-1])
    holders, links = collections.defaultdict(list), []
    for i in sorted(range(len(docs)), key=lambda i: len(elements[i])):
        rare = sorted(elements[i], key=lambda e: (seen[e], e))
        rare = rare[: len(rare) - int(np.ceil(0.64 * len(rare))) + 1] if rare else []
        for j in {j for e in rare for j in holders[e]}:
            if len(elements[j]) >= 0.6 * len(elements[i]) and (s := near_dedup.weighted_jaccard(features[i], features[j])) >= near_dedup.SIMILARITY:
                links.append((docs[i][0], docs[j][0], s))
        for e in rare:
            holders[e].append(i)
    return links


@pytest.mark.parametrize("size", ["sf0.01", "sf0.1"])
def test_classes_of_the_tables_against_all_pairs(spark, sf_dir, size):
    d = sf_dir.replace("sf0.001", size)
    docs = [(r.doc_id, r.text) for r in table(spark, d, "documents").collect()]
    counts = np.zeros(near_dedup.DF_SLOTS)
    for _, t in docs:
        h, _ = near_dedup.shingles(decontaminate.split_words(t or ""))
        counts[np.unique((h >> np.uint64(64 - 18)).astype(np.int64))] += 1
    links = _all_links(docs, near_dedup.idf_of(counts, len(docs)))
    parent = {i: i for i, _ in docs}

    def find(x):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for a, b, _ in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    rows = near_dedup.near_duplicates(table(spark, d, "documents")).collect()
    assert {r.doc_id: r.class_id for r in rows} == {i: find(i) for i, _ in docs} and len(links) > 50
    best = collections.defaultdict(float)
    words = {i: near_dedup.digest_of(decontaminate.split_words(t or "")) for i, t in docs}
    for a, b, s in links:
        if words[a] != words[b]:
            best[a], best[b] = max(best[a], s), max(best[b], s)
    linked = [r for r in rows if r.n_links]
    assert linked and all(near_dedup.SIMILARITY <= r.similarity <= best[r.doc_id] + 1e-9 for r in linked)
    assert {r.doc_id for r in linked} == set(best)


def test_pairs_of_a_bucket_are_verified_whatever_their_samples(spark):
    text = " ".join(f"w{i}" for i in range(60))
    unlike = " ".join(f"v{i}" for i in range(60))
    rows = [(1, bytes([65 + i]) * 16, bytes([65 + i]) * 16, bytes([i]) * (near_dedup.BANDS * near_dedup.ROWS), i == 0) for i in range(3)]
    members = spark.createDataFrame(rows, "bucket long, digest binary, component binary, signature binary, unlinked boolean")
    texts = spark.createDataFrame([(b"A" * 16, text), (b"B" * 16, text + " x"), (b"C" * 16, unlike)], "digest binary, text string")
    idf = spark.sparkContext.broadcast(near_dedup.idf_of(np.ones(near_dedup.DF_SLOTS), 3))
    links = near_dedup._links_in_cells(members, texts, idf).collect()
    assert {frozenset((bytes(r.a), bytes(r.b))) for r in links} == {frozenset((b"A" * 16, b"B" * 16))}


def test_samples_estimate_weighted_jaccard():
    rng = np.random.default_rng(1)
    sampler = near_dedup.Sampler()
    h = np.sort(rng.integers(0, 2**63, 600).astype(np.uint64) * np.uint64(2))
    w = rng.uniform(1, 3, 600)
    v = np.where(rng.random(600) < 0.8, w, w * 0.3)
    true = np.minimum(w, v).sum() / np.maximum(w, v).sum()
    assert abs((sampler.samples(h, w) == sampler.samples(h, v)).mean() - true) < 0.12


def test_near_duplicate_edges(spark):
    docs = spark.createDataFrame(EDGES, DOCS).select("*", F.lit("x").alias("key"), F.lit("x").alias("digest"), F.lit("x").alias("class_id"))
    rows = [(r.doc_id, r.class_id) for r in near_dedup.near_duplicates(docs).collect()]
    assert sorted(rows, key=str) == sorted([(r[0], r[0]) for r in EDGES], key=str)
    assert near_dedup.near_duplicates(docs.limit(0)).count() == 0
    assert collections.Counter(r.doc_id for r in near_dedup.keep_one(docs).collect()) == collections.Counter({1: 1, 2: 1, None: 1, 4: 1, 5: 1, 6: 1, 7: 1})
    with pytest.raises(TypeError):
        near_dedup.near_duplicates(docs.withColumn("doc_id", F.lit("a")))


def test_missing_and_shared_ids(spark):
    """Near copies of which some have no id, and ids that stand for several texts."""
    words = [f"w{i}" for i in range(100)]
    a, b, c = (" ".join([*words[:k], "x", *words[k + 1 :]]) for k in (3, 50, 99))
    d, e = " ".join(f"d{i}" for i in range(60)), " ".join(f"e{i}" for i in range(60))
    rows = [(None, a), (9, b), (4, c), (None, d), (None, d), (4, d + " more"), (4, e), (7, e), (None, None), (4, e), (2, "d1 d2")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = collections.Counter((r.doc_id, r.class_id) for r in near_dedup.near_duplicates(docs).collect())
    want = [(None, 4), (9, 4), (4, 4), (None, 4), (None, 4), (4, 4), (4, 4), (7, 4), (None, None), (4, 4), (2, 2)]
    assert got == collections.Counter(want)
    kept = collections.Counter((r.doc_id, r.text) for r in near_dedup.keep_one(docs).collect())
    assert kept == collections.Counter([(4, c), (4, d + " more"), (4, e), (None, None), (2, "d1 d2")])
    alone = spark.createDataFrame([(None, a), (None, b), (None, ""), (None, "")], "doc_id long, text string")
    assert sorted(len(r.text) for r in near_dedup.keep_one(alone).collect()) in ([0, 0, len(a)], [0, 0, len(b)])


# ---- pipeline


def test_pipeline_against_brute_force(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    stats = {i: quality_rules.Stats(t) for i, t in rows}
    good = [(i, t) for i, t in rows if not quality_rules.base_failed(stats[i]) and not any(f(stats[i]) for f in quality_rules.RULES.values())]
    counts = np.zeros(near_dedup.DF_SLOTS)
    for _, t in good:
        h, _ = near_dedup.shingles(decontaminate.split_words(t))
        counts[np.unique((h >> np.uint64(64 - 18)).astype(np.int64))] += 1
    classes = _classes(good, near_dedup.idf_of(counts, len(good)))
    distinct = [(i, t) for i, t in good if classes[i] == i]
    items = [(r.item_id, r.text) for r in table(spark, sf_dir, "benchmark").collect()]
    dirty = {k[0] for k in _brute_contamination(distinct, items) if k[2]}
    clean = [(i, t) for i, t in distinct if i not in dirty]
    masked = [(i, secret_scan.redact(t, secret_scan.find_secrets(t)[1])) for i, t in clean]

    got, kept = docs, []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        got = corpus_pipeline.stored(stage(spark, got, sf_dir), "test-stage")
        assert got.columns == docs.columns
        kept.append({r.doc_id for r in got.collect()})
    assert kept[0] == {i for i, _ in good} and kept[1] == {i for i, _ in distinct} and kept[2] == kept[3] == {i for i, _ in clean}
    final = {r.doc_id: (r.text, r.n_chars) for r in got.collect()}
    assert final == {i: (t, len(t)) for i, t in masked}
    _check_pieces(corpus_pipeline.run(spark, sf_dir).collect(), masked)


def test_pipeline_edges(spark, sf_dir):
    docs = spark.createDataFrame(EDGES, DOCS).select("*", F.lit("x").alias("kept"), F.lit("x").alias("spans"), F.lit("x").alias("__in"))
    for frame in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            frame = corpus_pipeline.stored(stage(spark, frame, sf_dir), "test-stage")
            assert frame.columns == docs.columns
        assert corpus_pipeline.STAGES[-1][1](spark, frame, sf_dir).count() == 0


def test_copies_are_linked_through_their_original(spark):
    """Copies of a short text, an edit each: only the original is similar to them, and it is rarely a bucket's leader."""
    rng = random.Random(4)
    base = [f"w{i}" for i in range(60)]
    docs = [(0, " ".join(base))]
    for i in range(1, 150):
        copy = list(base)
        copy[rng.randrange(4, 56)] = f"edit{i}"
        docs.append((i, " ".join(copy)))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(2)
    counts = np.zeros(near_dedup.DF_SLOTS)
    for _, t in docs:
        h, _ = near_dedup.shingles(decontaminate.split_words(t))
        counts[np.unique((h >> np.uint64(64 - 18)).astype(np.int64))] += 1
    got = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(df).collect()}
    assert got == _classes(docs, near_dedup.idf_of(counts, len(docs)))


def test_passes_store_what_they_found_without_texts(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 300)
    kept, inside = [], decontaminate.stored
    monkeypatch.setattr(decontaminate, "stored", lambda df, what: kept.append(inside(df, what)) or kept[-1])
    items = [(i, " ".join(f"{c}{i}" for c in "abcdefghijkl")) for i in range(20)]
    texts = [f"{items[3][1]} and {items[4][1]}"] * 40 + [f"clean words {i}" for i in range(60)]  # copies that are hit in two passes
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = decontaminate.find_contamination(d, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert len(rows) == 100 and all((list(r["items"]) == ["3", "4"]) == (r.doc_id < 40) for r in rows)
    assert len(kept) > 3 and all("__text" not in k.columns for k in kept) and sum(k.count() for k in kept) <= 3


def test_cells_of_long_texts_are_bounded_by_bytes(spark, monkeypatch):
    """Many long texts in one bucket: no cell has more than a bounded stretch of them, and the classes are the same."""
    rng = random.Random(11)
    base = [f"w{rng.randrange(5000)}" for _ in range(3000)]
    texts = []
    for i in range(40):
        near = list(base)
        for _ in range(12 + 3 * i):
            near[rng.randrange(len(near))] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(near))
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts + texts[:5])], DOCS)
    want = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(docs).collect()}
    kept, inside = [], near_dedup._grid
    monkeypatch.setattr(near_dedup, "_BLOCK_BYTES", 60_000)
    monkeypatch.setattr(near_dedup, "_grid", lambda members, blocks=None: kept.append(inside(members, blocks)) or kept[-1])
    got = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(docs).collect()}
    assert got == want and len(set(want.values())) < 40
    for cells in kept:
        if "left" in cells.columns and cells.count():
            most = cells.groupBy("bucket", "i", "j", "left").count().agg(F.max("count")).first()[0]
            assert most * 18_000 < 5 * 60_000
