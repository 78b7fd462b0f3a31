"""The suffix tree against the same model in plain dictionaries, its distributions, its gain on held-out texts, and growth with the input."""

import math
import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from corpusmill.llm import common, suffix_tree_lm

END = "<end>"


def texts(rng, n, vocabulary):
    out = [(i, " ".join(f"w{int(rng.paretovariate(0.7)) % vocabulary}" for _ in range(rng.randint(1, 120)))) for i in range(n)]
    out += [(n + i, out[i % 9][1]) for i in range(40)] + [(9000, ""), (9001, None), (None, "w1 w2 w3"), (None, None), (9002, "W1 w2\x0bW3 unseen")]
    return [*out, out[5], (9003, "w1 w2 " * 20_000)]


def symbols(text):
    return [*(w.decode() for w in (text or "").lower().encode().split()), END]


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 5 == 1


class Plain:
    """The model by its definition."""

    def __init__(self, rows, depth, gain):
        known = [symbols(t) for i, t in rows if i is not None and not held(i)]
        self.c = Counter(w for t in known for w in t)
        self.scale = sum(self.c.values()) + 0.5 * (len(self.c) + 1)
        self.next = defaultdict(Counter)
        for t in known:
            for at, w in enumerate(t):
                for d in range(1, min(depth, at) + 1):
                    self.next[tuple(t[at - d : at])][w] += 1
        self.states, self.depth = {(): None}, depth
        for d in range(1, depth + 1):
            for s, n in self.next.items():
                if len(s) == d and s[1:] in self.states and sum(n.values()) >= 2 and any(k >= 2 for k in n.values()):
                    whole, often = sum(n.values()), {w: k for w, k in n.items() if k >= 2}
                    left = 1 - sum(k - 0.75 for k in often.values()) / whole
                    won = sum(k * (math.log((k - 0.75) / whole) - round(math.log(self.p(s[1:], w)) * 1024) / 1024) for w, k in often.items())
                    if won + (whole - sum(often.values())) * math.log(left) >= gain:
                        self.states[s] = ({w: (k - 0.75) / whole for w, k in often.items()}, left)

    def p(self, state, w):
        if not state:
            return (self.c[w] + 0.5) / self.scale
        mass, left = self.states[state]
        return mass.get(w, 0) + left * self.p(state[1:], w)

    def score(self, text):
        out, t = 0.0, symbols(text)
        for at, w in enumerate(t):
            state = ()
            for d in range(1, min(self.depth, at) + 1):
                if tuple(t[at - d : at]) not in self.states:
                    break
                state = tuple(t[at - d : at])
            out += math.log10(self.p(state, w))
        return out


@pytest.mark.parametrize(("words", "split", "depth"), [(700_000, 1_000_000, 3), (300, 40, 3), (2000, 7, 4), (500, 1_000_000, 1)])
def test_same_as_the_plain_model(spark, monkeypatch, words, split, depth):
    monkeypatch.setattr(suffix_tree_lm, "CHUNK_WORDS", words)
    monkeypatch.setattr(suffix_tree_lm, "SPLIT", split)
    rows = texts(random.Random(5), 200, 150)
    plain = Plain(rows, depth, 3.0)
    assert {len(s) for s in plain.states} == set(range(depth + 1)), "states of every length"
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    expected = [(str(i), held(i), len(symbols(t)), round(plain.score(t), 5)) for i, t in rows]
    found = suffix_tree_lm.score_texts(docs, gain=3.0, depth=depth).collect()
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, round(r.score, 5)) for r in found) == sorted(expected)


def test_groups_of_chunks_ask_in_one_row_a_bucket(spark, monkeypatch):
    """Rows between chunks and buckets do not grow with the product of their numbers; scores are the plain model's, with contexts dealt into parts."""
    rows = texts(random.Random(7), 200, 150)
    plain = Plain(rows, 3, 3.0)
    for name, value in {"CHUNK_WORDS": 300, "SPLIT": 40, "BUCKET_BYTES": 3_000, "GROUP_BYTES": 10, "TOGETHER": 8}.items():
        monkeypatch.setattr(suffix_tree_lm, name, value, raising=False)
    answered, write = {}, common.Buckets.write

    def written(self, df, part):
        write(self, df, part)
        answered[part] = spark.read.parquet(self.folder(part)).filter("kind >= -1").count()

    monkeypatch.setattr(common.Buckets, "write", written)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = suffix_tree_lm.score_texts(docs, gain=3.0).collect()
    expected = [(str(i), held(i), len(symbols(t)), round(plain.score(t), 5)) for i, t in rows]
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, round(r.score, 5)) for r in found) == sorted(expected)
    chunks, buckets = answered["text"], sum(len((t or "").encode()) for _, t in rows) // 3_000
    assert chunks > 25 and buckets > 40
    assert max(answered["words"], answered["1"], answered["2"]) <= (chunks / 8 + 3) * buckets


def test_distributions_sum_to_one():
    plain = Plain(texts(random.Random(5), 120, 100), 3, 3.0)
    for s in plain.states:
        unseen = 0.5 / plain.scale * math.prod(plain.states[s[k:]][1] for k in range(len(s)))
        assert sum(plain.p(s, w) for w in plain.c) + unseen == pytest.approx(1)


def test_held_out_texts_gain(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = suffix_tree_lm.score_texts(docs).filter("held_out").agg(F.sum("n_tokens"), F.sum("base_score"), F.sum("score")).first()
    assert (found[2] - found[1]) / found[0] > 0.15, "log10 a token over the words alone"


def test_rare_pairs_count_in_a_large_corpus(spark):
    """Twelve repeats of a passage make it likely, however many other tokens there are."""
    passage = " ".join(f"rare{i}" for i in range(20))
    other = spark.range(2000).select("id", F.expr("array_join(transform(sequence(1, 800), i -> concat('x', pmod(xxhash64(id, i), 50000))), ' ')").alias("text"))
    repeated = spark.createDataFrame([(5000 + i, passage) for i in range(12)], "id long, text string")
    docs = other.unionByName(repeated).withColumnRenamed("id", "doc_id")
    found = suffix_tree_lm.score_texts(docs).filter("doc_id >= 5000").first()
    assert found.train_tokens > 1_000_000 and found.score > found.base_score + 80


def test_without_training_texts(spark):
    alone = next(i for i in range(100) if held(i))
    found = suffix_tree_lm.score_texts(spark.createDataFrame([(alone, "a b c"), (None, None)], "doc_id long, text string")).collect()
    assert {(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.score, r.base_score) for r in found} == {(alone, True, 4, 0, 0, 0, 0), (None, False, 1, 0, 0, 0, 0)}
