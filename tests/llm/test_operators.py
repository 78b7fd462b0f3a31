"""Each operator against a plain brute-force version, on texts with nulls, ties, repeats, copies and clashing columns."""

import hashlib
import math
import random
import textwrap
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.llm import components, decontaminate, ftrl, jaccard_join, license_scan, line_templates, mixing, quality, substring_dedup, suffix_tree_lm, topk, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, mark string, size int, component string, copies int, row string, n_words int"


def made(rows):
    return [(i, t, "en", s, None if t is None else len(t), "x", 1, "c", 2, "r", 3) for i, t, s in rows]


def words(rng, n, vocabulary=400):
    return [f"w{int(rng.paretovariate(0.8)) % vocabulary}" for _ in range(n)]


@pytest.fixture(scope="module")
def rows():
    """(doc_id, text, source): copies, near copies, shared passages and lines, and the odd cases."""
    rng = random.Random(7)
    base = [words(rng, rng.randint(5, 160)) for _ in range(60)]
    out = [(i, " ".join(w), f"src{i % 4}") for i, w in enumerate(base)]
    out += [(100 + i, " ".join(base[i % 8]), "src0") for i in range(24)]
    for i in range(30):  # near copies of one text
        w = list(base[20 + i % 3])
        w[rng.randrange(len(w))] = f"n{i}"
        out.append((200 + i, " ".join(w), "src1"))
    passage = " ".join(words(rng, 30))
    out += [(300 + i, f"{' '.join(words(rng, 12))} {passage} {' '.join(words(rng, 9))}", None) for i in range(12)]
    out += [(400 + i, "\n".join([f"Posted {i} times by user{i}", " ".join(words(rng, 6)), "all the usual boiler plate", "", " ".join(words(rng, 8))]), "src2") for i in range(14)]
    out += [(500, None, "src1"), (501, "", "src1"), (502, " \t\n ", None), (503, "one", "src9"), (504, "One two\x0bthree É", "src9"), (None, " ".join(base[1]), "src1"), (None, None, None)]
    out += [(505, "x " * 3000, "src3"), (505, "x " * 3000, "src3"), (1, " ".join(base[1]), "src1"), (506, "ÄB äb AB ab", "src3")]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(made(rows), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def split(text):
    return text.encode().split() if text else []


def expected_dedup(rows, window):
    """Multiset of (doc_id, n_words, n_removed, kept) by the rule itself; ids that repeat here hold equal texts."""
    key = lambda i: (i is None, i or 0)
    first = {}
    for i, t in sorted(((i, t) for i, t, *_ in rows), key=lambda r: key(r[0])):
        w = split(t)
        for p in range(len(w) - window + 1):
            first.setdefault(tuple(w[p : p + window]), (key(i), p))
    out = []
    for i, t, *_ in rows:
        w = split(t)
        gone = [False] * len(w)
        for p in range(len(w) - window + 1):
            if first[tuple(w[p : p + window])] < (key(i), p):
                gone[p : p + window] = [True] * window
        out.append((i, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode()))
    return sorted(out, key=repr)


def test_substring_dedup(docs, rows, empty):
    for window in (20, 5):
        found = substring_dedup.dedup_substrings(docs, window).collect()
        assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in found), key=repr) == expected_dedup(rows, window)
    assert all(sum(s.end - s.start for s in r.removed) == r.n_removed for r in found)
    assert substring_dedup.dedup_substrings(empty).count() == 0


def test_fingerprint_index_in_batches(spark, rows, tmp_path):
    known = [r for r in rows if r[0] is not None and not (r[0] == 1 and r is not rows[1])]
    known = list({r[0]: r for r in known}.values())
    known.sort(key=lambda r: r[0])
    index = substring_dedup.FingerprintIndex(spark, f"file://{tmp_path}/index", window=8, buckets=5, fanout=2)
    got, parts = [], [known[k::1][: len(known) // 4 + 1] for k in range(0, len(known), len(known) // 4 + 1)]
    for k, part in enumerate(parts):
        batch = spark.createDataFrame(made(part), SCHEMA)
        before = spark.createDataFrame(made([r for p in parts[:k] for r in p]), SCHEMA) if k else None
        got += [(r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in index.add(batch, f"part {k}", before).collect()]
    assert sorted(got, key=repr) == expected_dedup(known, 8)
    assert [r[:2] for r in index.runs()] == [(0, 1), (2, 2), (3, 3)] and len(parts) == 4


def expected_components(rows, n, percent):
    sets = [(i, jaccard_join.exact_shingles(t.encode(), n) if t and t.split() else set()) for i, t, *_ in rows]
    parent = {i: i for i, _ in sets if i is not None}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a in range(len(sets)):
        for b in range(a):
            (i, x), (j, y) = sets[a], sets[b]
            if i is not None and j is not None and x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = root(i), root(j)
                parent[max(p, q)] = min(p, q)
    return sorted(((i, len(s), None if i is None else root(i)) for i, s in sets), key=repr)


@pytest.mark.parametrize(("n", "percent"), [(4, 85), (2, 60)])
def test_jaccard_join(docs, rows, empty, n, percent):
    found = jaccard_join.join_components(docs, n, percent).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in found), key=repr) == expected_components(rows, n, percent)
    assert jaccard_join.join_components(empty).count() == 0


def test_jaccard_prefix_is_enough():
    """Any two sets that link share the needed number of prefix tokens, whatever the order's table says."""
    rng = np.random.default_rng(3)
    known = np.sort(rng.choice(3000, 400, replace=False)).astype(np.uint64)
    counts = rng.integers(2, 500, 400)
    for _ in range(300):
        size = int(rng.integers(6, 120))
        a = np.sort(rng.choice(3000, size, replace=False)).astype(np.uint64)
        drop = int(rng.integers(0, max(1, size // 10)))
        b = np.unique(np.r_[a[drop:], rng.choice(np.arange(3000, 6000), int(rng.integers(0, 5)), replace=False).astype(np.uint64)])
        both = len(np.intersect1d(a, b))
        (p, l), (q, m) = (jaccard_join.prefix(x, known, counts, 85) for x in (a, b))
        if 100 * both >= 85 * (len(a) + len(b) - both):
            assert len(np.intersect1d(p, q)) >= min(l, m)


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 340)] + [(500, i) for i in range(501, 560)]
    parent = {v: v for e in edges for v in e}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in edges:
        p, q = root(a), root(b)
        parent[max(p, q)] = min(p, q)
    found = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {v: root(v) for a, b in edges if a != b for v in (a, b)}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_mixing(docs, rows, empty):
    found = mixing.mix(docs).collect()
    assert sorted(((r.doc_id, r.size) for r in found), key=repr) == sorted(((i, len(split(t))) for i, t, _ in rows), key=repr)
    by = defaultdict(list)
    for r in found:
        by[r.source].append(r)
    sizes = {s: sum(r.size for r in x) for s, x in by.items()}
    order = [*sorted(s for s in sizes if s is not None), *[s for s in sizes if s is None]]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, free, left = {}, set(order), sum(sizes.values())
    while free:  # share again what is above three times a source's size
        unit = left / sum(weight[s] for s in free)
        over = {s for s in free if unit * weight[s] >= 3 * sizes[s]}
        for s in over or free:
            target[s] = 3 * sizes[s] if over else unit * weight[s]
        left -= sum(target[s] for s in over)
        free = free - over if over else set()
    for s, x in by.items():
        assert {r.source_size for r in x} == {sizes[s]}
        assert all(r.target == pytest.approx(target[s]) for r in x)
        assert all(r.taken == r.copies * r.size and 0 <= r.copies <= 3 for r in x)
        assert abs(sum(r.taken for r in x) - target[s]) <= 2 * max(r.size for r in x) + 1
    again = mixing.mix(docs.repartition(5)).collect()
    assert Counter((r.doc_id, r.copies) for r in found) == Counter((r.doc_id, r.copies) for r in again)
    out = mixing.emitted(docs)
    assert out.columns == [*docs.columns, "copy"]
    assert Counter(r.doc_id for r in out.collect()) == Counter({i: n for i, n in Counter(i for r in found for i in [r.doc_id] * r.copies).items()})
    assert mixing.mix(empty).count() == 0 and mixing.emitted(empty).count() == 0


@pytest.fixture(scope="module")
def benchmark_rows(rows):
    texts = [t for _, t, _ in rows if t]
    cut = lambda t, a, n: " ".join(t.split()[a : a + n])
    return [(1, cut(texts[3], 0, 40)), (2, cut(texts[5], 2, 10).upper()), (10, cut(texts[7], 1, 4)), (11, "never seen anywhere at all " * 3), (12, ""), (13, None), (14, "w1"), (2, "w2 w3"), (None, cut(texts[9], 0, 12)), (1, cut(texts[3], 0, 40))]


def expected_hits(rows, items, window):
    wins = defaultdict(set)
    for i, t in items:
        w = decontaminate.words(t.encode() if t else None)
        n = min(window, len(w))
        for p in range(len(w) - n + 1 if w else 0):
            wins[tuple(w[p : p + n])].add(i)
    out = []
    for i, t, *_ in rows:
        w = decontaminate.words(t.encode() if t else None)
        hit, ids = [False] * len(w), set()
        for n in {len(k) for k in wins}:
            for p in range(len(w) - n + 1):
                if (k := tuple(w[p : p + n])) in wins:
                    hit[p : p + n] = [True] * n
                    ids |= {str(x) for x in wins[k] if x is not None}
        out.append((i, len(w), sum(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), any(hit)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block_bytes", [16_000_000, 150])
def test_decontamination(spark, docs, rows, empty, benchmark_rows, monkeypatch, block_bytes):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block_bytes)
    items = spark.createDataFrame(benchmark_rows, "item_id long, text string")
    found = decontaminate.digest(decontaminate.find_contamination(docs, items))
    assert sorted((tuple(r) for r in found.collect()), key=repr) == expected_hits(rows, benchmark_rows, 10)
    none = decontaminate.digest(decontaminate.find_contamination(docs, items.limit(0))).collect()
    assert not any(r.contaminated for r in none) and len(none) == len(rows)
    assert decontaminate.find_contamination(empty, items).count() == 0


def test_suffix_tree(docs, rows, empty):
    found = suffix_tree_lm.score_texts(docs, gain=2.0).collect()
    symbols = lambda t: [*(t.encode().lower().split() if t else []), "end"]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    c = Counter(w for i, t, _ in rows if i is not None and not held(i) for w in symbols(t))
    n, v = sum(c.values()), len(c)
    expected = Counter()
    for i, t, _ in rows:
        w = symbols(t)
        base = sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)
        expected[(i, held(i), len(w), sum(c[x] > 0 for x in w), n, round(base, 6))] += 1
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in found) == expected
    trained = [r for r in found if not r.held_out]
    assert sum(r.score for r in trained) > sum(r.base_score for r in trained)
    assert suffix_tree_lm.score_texts(empty).count() == 0


def test_line_dedup(docs, rows, empty):
    found = line_templates.drop_lines(docs, min_texts=10)
    assert found.columns == [*docs.columns, "n_lines", "n_dropped"]
    got = {(r.doc_id, r.n_lines): (r.text, r.n_dropped) for r in found.filter("doc_id >= 400 and doc_id < 420").collect()}
    for i, t, _ in rows:
        if i is not None and 400 <= i < 414:
            lines = t.split("\n")
            kept = lines if i == 400 else [lines[1], lines[3], lines[4]]  # the first document keeps the wording
            assert got[(i, 5)] == ("\n".join(kept), 0 if i == 400 else 2)
    same = {r.doc_id: r.text for r in found.filter("doc_id < 60 or doc_id >= 500").collect()}
    assert all(same[i] == t for i, t, _ in rows if i is not None and (i < 60 or i >= 500))
    assert found.count() == len(rows) and line_templates.drop_lines(empty).count() == 0


def test_license_scan(spark, empty):
    t = license_scan.TEMPLATES
    texts = {
        1: "prose here\nReleased under the MIT License.\nmore prose",
        2: "x\n" + t["MIT"].replace("Software", "Program", 1),
        3: "Licensed under the Apache License, Version 3.7 as we like it, with nothing else to say about it.",
        4: "This is about a license plate and nothing more.",
        5: "\n".join(["a", t["Apache-2.0 notice"], "b", "c", "d", "All rights reserved."]),
        6: "", 7: None, 8: "All rights reserved. " * 1,
        9: "a\nb\n" + textwrap.fill(t["MIT"].removeprefix("Permission "), 78) + "\npermission\nc",
        10: t["CC-BY-SA-4.0 line"], 11: "\n".join([*t.values(), t["ISC"]]), 12: "word " * 200_000 + t["MIT line"] + " word" * 200_000, 13: t["MIT line"],
        14: t["GPL-3.0 line"].replace("3", "2"),
    }
    docs = spark.createDataFrame(made([(i, x, "s") for i, x in texts.items()]), SCHEMA)
    found = license_scan.scan_licenses(docs).collect()
    assert sorted((r.doc_id, r.license) for r in found) == sorted([
        (1, "MIT line"), (2, "MIT"), (5, "Apache-2.0 notice"), (5, "All rights reserved"), (8, "All rights reserved"),
        (9, "MIT"), (10, "CC-BY-SA-4.0 line"), (12, "MIT line"), (13, "MIT line"), *((11, n) for n in t), (11, "ISC"),
    ])
    changed = next(r for r in found if r.doc_id == 2)
    assert changed.missing == ["software"] and changed.other == ["program"] and changed.n_missing == 1
    wrapped = next(r for r in found if r.doc_id == 9)
    assert (wrapped.first_line, wrapped.last_line, wrapped.n_missing, wrapped.n_other) == (2, texts[9].count("\n") - 2, 1, 0)
    for r in found:  # brute force: word counts of the lines reported account for what is missing
        block = Counter(license_scan.wording("\n".join(texts[r.doc_id].split("\n")[r.first_line : r.last_line + 1])))
        assert sum((Counter(license_scan.wording(t[r.license])) - block).values()) <= r.n_missing == len(r.missing)
    assert {r.doc_id for r in license_scan.scan_licenses(docs, unconfirmed=True).filter("license is null").collect()} == {3, 4, 14}
    assert license_scan.scan_licenses(empty).count() == 0


def test_top_k(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 16)).astype(np.float32)
    x[50] = x[51] = x[52]
    rows = [(int(i), [float(c) for c in v], "x") for i, v in enumerate(x)]
    rows += [(1000, None, "x"), (1001, [], "x"), (1002, [float("nan")] * 16, "x"), (1003, [1.0, None] * 8, "x"), (None, [1.0] * 16, "x"), (1100, [1.0, 2.0], "x"), (7, [float(c) for c in x[8]], "x"), (1200, [0.0] * 16, "x")]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string").repartition(3)
    found = topk.top_k(vectors, vectors.filter("vec_id % 100 = 0")).collect()
    whole = [(i, topk.whole([v], 1024)[0]) for i, v, _ in rows]
    whole = [(i, v) for i, v in whole if i is not None and v is not None]
    expected = Counter()
    for i, q in whole:
        if i % 100 == 0:
            scores = sorted((-int(q @ v), j) for j, v in whole if j != i and len(v) == len(q))[:10]
            expected.update((i, k + 1, j, -s) for k, (s, j) in enumerate(scores))
    assert Counter((r.query_id, r["rank"], r.vec_id, r.score) for r in found) == expected
    assert topk.top_k(vectors.limit(0), vectors.limit(0)).count() == 0


def labelled(rng, n):
    out = []
    for i in range(n):
        good, toxic = rng.random() < 0.6, rng.random() < 0.3
        w = words(rng, rng.randint(20, 80))
        for _ in range(3 * toxic):
            w[rng.randrange(len(w))] = rng.choice(["vile", "Scum", "rotten"])
        out.append((i, " ".join(w if good else [f"{x}$$$" for x in w]), "s", int(good), int(toxic)))
    return out


def test_classifiers(spark, empty):
    rows = labelled(random.Random(2), 600)
    odd = [(10_000, None, "s"), (10_001, "", "s"), (None, "vile", "s"), (3, rows[3][1], "s")]
    docs = spark.createDataFrame(made([r[:3] for r in rows] + odd), SCHEMA)
    labels = spark.createDataFrame([(r[0], r[3], r[4]) for r in rows] + [(5, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    for score, folds, out, k in ((quality.score_quality, 3, 1, 3), (toxicity.score_toxicity, 4, 2, 4)):
        found = score(docs, labels).collect()
        assert len(found) == len(rows) + len(odd) and all(0 <= r.score <= 1 for r in found)
        assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % folds == out) for r in found)
        truth = {r[0]: r[k] for r in rows}
        held = [r for r in found if r.held_out and r.doc_id in truth]
        assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.9
        # labels of the held-out fold are never looked at
        other = labels.withColumn("quality", F.when(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(folds)) == out, 1 - F.col("quality")).otherwise(F.col("quality")))
        other = other.withColumn("toxic", F.when(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(folds)) == out, 1 - F.col("toxic")).otherwise(F.col("toxic")))
        assert {(r.doc_id, r.score) for r in score(docs, other).collect()} == {(r.doc_id, r.score) for r in found}
        assert {r.score for r in score(docs, labels.limit(0)).collect()} == {0.5}
        assert score(empty, labels).count() == 0


def test_ftrl_is_sparse():
    rng = np.random.default_rng(1)
    s = ftrl.Settings(bits=12, l1=2.0, epochs=2)
    rows, y = [], rng.integers(0, 2, 400)
    for label in y:
        at = np.unique(np.r_[rng.integers(10, 4096, 30), [1 if label else 2]])
        rows.append((at, np.ones(len(at), np.float32)))
    m = ftrl.fit(rows, y, s)
    w = m.dense()
    assert w[1] > 0 > w[2] and len(m.coordinates) < 400
    assert ftrl.fit([], np.array([]), s).bias == 0
