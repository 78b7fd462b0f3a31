"""Benchmark decontamination as a prefix-filtered set join.

An item's windows (``window`` consecutive words; the whole item if it is shorter) are sets of shingles of up to
``SHINGLE`` words. A document contains a window only if it contains all its shingles, so one necessary prefix token is
enough: the shingle with the least document frequency, counted over all documents. Where a document has that shingle, the
shingle's place in the window fixes where the window would begin (positional bound) and end (length bound); what stays
within the text is compared word for word.

The benchmark is read in blocks of at most ``BLOCK_BYTES`` of text; each block's windows are broadcast, and the documents
pass by once for the counts and once for the join. A larger benchmark makes more blocks, never a larger broadcast.

Edge cases (tested): null and empty texts have no words and are never hit; items without words take no part; items that
repeat, or share an id, each count, and an id is listed once; a null item_id makes hits and is not listed; rows that repeat
are each reported; an empty benchmark hits nothing; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm import common

WINDOW = 10
SHINGLE = 3
BLOCK_BYTES = 4_000_000

#: Words are runs of digits, letters a-z (A-Z lowered) and bytes from 0x80.
_WORDS = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def words(text: bytes | None) -> list[bytes]:
    return text.translate(_WORDS).split() if text else []


class Windows:
    """The windows of one block of items, as arrays: the items' words by number, one after the other, and where windows begin.

    ``items`` may be read once. Of a window that occurs several times the first place stands for all.
    """

    def __init__(self, items: Iterable[tuple[int | None, bytes | None]], window: int):
        self.vocabulary: dict[bytes, int] = {}
        parts, ids = [], []
        for item_id, text in items:
            own = words(text)
            if own:
                parts.append(np.array([self.vocabulary.setdefault(w, len(self.vocabulary)) for w in own], np.int32))
                ids.append(item_id)
        lengths = np.array([len(x) for x in parts], np.int64)
        self.flat = np.concatenate(parts) if parts else np.zeros(0, np.int32)
        ends = np.cumsum(lengths)
        sizes = np.minimum(lengths, window)
        number = lengths - sizes + 1
        item = np.repeat(np.arange(len(lengths)), number)
        begins = np.arange(number.sum()) - np.repeat(np.cumsum(number) - number, number) + (ends - lengths)[item]
        every = np.full((len(begins), window), -1, np.int32)
        for j in range(window):
            inside = j < sizes[item]
            every[inside, j] = self.flat[begins[inside] + j]
        # equal windows as one: sorted by their words
        order = np.lexsort(every.T[::-1])
        every = every[order]
        new = np.r_[True, (every[1:] != every[:-1]).any(axis=1)] if len(every) else np.zeros(0, bool)
        row = np.cumsum(new) - 1
        self.begins, self.sizes = begins[order][new], sizes[item][order][new]
        #: Ids as strings, sorted, and for each window the numbers of those that have it.
        self.names = sorted({str(i) for i in ids if i is not None})
        place = {n: k for k, n in enumerate(self.names)}
        name = np.array([-1 if i is None else place[str(i)] for i in ids], np.int64)[item[order]] if len(ids) else row
        pairs = np.unique(row[name >= 0] * max(1, len(self.names)) + name[name >= 0])
        self.owner = (pairs % max(1, len(self.names))).astype(np.int32)
        self.owned = np.searchsorted(pairs, np.arange(len(self.begins) + 1) * max(1, len(self.names)))
        #: For each shingle length in use: all shingles' keys in order, and the number of the one at each place.
        self.short = np.minimum(self.sizes, SHINGLE)
        self.keys, self.at = {}, {}
        for k in np.unique(self.short).tolist():
            key = self.shingles(self.flat, k)
            inside = np.zeros(len(key), bool)
            for j in range(int(self.sizes.max()) - k + 1):
                own = (self.short == k) & (j + k <= self.sizes)
                inside[self.begins[own] + j] = True
            self.keys[k] = np.unique(key[inside])
            self.at[k] = np.searchsorted(self.keys[k], key).astype(np.int32)

    def items_of(self, windows: np.ndarray) -> list[str]:
        """The ids, sorted, that have any of some windows."""
        found = {int(n) for w in np.unique(windows).tolist() for n in self.owner[self.owned[w] : self.owned[w + 1]]}
        return [self.names[n] for n in sorted(found)]

    @staticmethod
    def shingles(ids: np.ndarray, k: int) -> np.ndarray:
        """One 64-bit key for each k consecutive word numbers (21 bits each); -1 where a word is not the benchmark's."""
        n = len(ids) - k + 1
        if n <= 0:
            return np.zeros(0, np.int64)
        out, bad = np.zeros(n, np.int64), np.zeros(n, bool)
        for j in range(k):
            out = (out << 21) | (ids[j : n + j] & 0x1FFFFF)
            bad |= ids[j : n + j] < 0
        out[bad] = -1
        return out

    def numbered(self, own: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.vocabulary.get, own, repeat(-1)), np.int32, len(own))

    def found(self, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Places in a text whose shingle is the benchmark's, and the shingle's number."""
        key = self.shingles(ids, k)
        at = np.flatnonzero(key >= 0)
        number = np.searchsorted(self.keys[k], key[at])
        same = self.keys[k][np.minimum(number, len(self.keys[k]) - 1)] == key[at]
        return at[same], number[same]

    def rank(self, counts: dict[int, np.ndarray]) -> None:
        """Choose each window's rarest shingle as its prefix, and index the windows by it."""
        self.index = {}
        for k, keys in self.keys.items():
            window = np.flatnonzero(self.short == k)
            best = np.full(len(window), np.iinfo(np.int64).max)
            token, offset = np.zeros(len(window), np.int64), np.zeros(len(window), np.int64)
            for j in range(int(self.sizes[window].max()) - k + 1):
                inside = np.flatnonzero(j + k <= self.sizes[window])
                number = self.at[k][self.begins[window[inside]] + j]
                better = counts[k][number] < best[inside]
                inside, number = inside[better], number[better]
                best[inside], token[inside], offset[inside] = counts[k][number], number, j
            o = np.argsort(token, kind="stable")
            self.index[k] = (np.searchsorted(token[o], np.arange(len(keys) + 1)), window[o], offset[o])

    def hits(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, window) of every occurrence."""
        starts, windows = [], []
        for k, (edges, window, offset) in self.index.items():
            at, number = self.found(ids, k)
            each = edges[number + 1] - edges[number]
            if not each.sum():
                continue
            place = np.repeat(at, each)
            entry = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each) + np.repeat(edges[number], each)
            w, start = window[entry], place - offset[entry]
            ok = np.flatnonzero((start >= 0) & (start + self.sizes[w] <= len(ids)))
            w, start = w[ok], start[ok]
            ok = np.ones(len(w), bool)
            for j in range(int(self.sizes[w].max(initial=0))):
                inside = j < self.sizes[w]
                ok[inside] &= ids[start[inside] + j] == self.flat[self.begins[w[inside]] + j]
            starts.append(start[ok])
            windows.append(w[ok])
        return (np.concatenate(starts), np.concatenate(windows)) if starts else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _counted(shared):
    """Document frequency of the block's shingles, summed in each task."""

    def run(it):
        block = shared.value
        counts = {k: np.zeros(len(v), np.int64) for k, v in block.keys.items()}
        for (texts,) in common.column_batches(it, "text"):
            for text in common.raw(texts):
                ids = block.numbered(words(text))
                if (ids >= 0).any():
                    for k in counts:
                        counts[k][np.unique(block.found(ids, k)[1])] += 1
        for k, c in counts.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k), pa.int32()), pa.array(at, pa.int64()), pa.array(c[at])], names=["k", "shingle", "n"])

    return run


_HITS = "doc_id long, n_words long, spans array<struct<start:int,end:int>>, items array<string>"
_HITS_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), ("items", pa.list_(pa.string()))])
_MARKED = f"{_HITS}, mark long"
_MARKED_SCHEMA = _HITS_SCHEMA.append(pa.field("mark", pa.int64()))


def _united(spans: list[tuple[int, int]]) -> list[dict]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [{"start": a, "end": b} for a, b in out]


def _joined(shared):
    """Hits of every document row with one block."""

    def run(it):
        block = shared.value
        for ids, texts, marks in common.column_batches(it, "doc_id", "text", "mark"):
            rows = []
            for text in common.raw(texts):
                own = words(text)
                start, window = block.hits(block.numbered(own))
                spans = _united(list(zip(start.tolist(), (start + block.sizes[window]).tolist(), strict=True)))
                rows.append((len(own), spans, block.items_of(window)))
            yield pa.RecordBatch.from_arrays([ids, *(pa.array([r[k] for r in rows], _HITS_SCHEMA.types[k + 1]) for k in range(3)), marks], schema=_MARKED_SCHEMA)

    return run


def _blocks(benchmark: DataFrame, window: int) -> tuple[int, Iterator[Windows]]:
    """How many blocks the items make, and their windows, block by block. Items that repeat count once."""
    items = common.plain(benchmark, "item_id", "text").distinct()
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = int(total // BLOCK_BYTES) + 1

    def windows() -> Iterator[Windows]:
        for b in range(n):
            part = items if n == 1 else items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b)
            yield Windows(((r["item_id"], None if r["text"] is None else r["text"].encode()) for r in part.toLocalIterator()), window)

    return n, windows()


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """For each row of ``docs``: doc_id, n_words, spans of hit words, items (ids as strings, sorted) with a window in it.

    Of several blocks each one's hits are written before the next one is sent, so that one block is in memory at a time.
    """
    spark = docs.sparkSession
    known = common.plain(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    marked = known.withColumn("mark", F.xxhash64("text"))  # tells rows of one id apart where blocks are united
    found, (n, blocks) = [], _blocks(benchmark, window)
    for block in blocks:
        shared = spark.sparkContext.broadcast(block)
        counts = {k: np.zeros(len(v), np.int64) for k, v in block.keys.items()}
        # as many rows at most as the block has shingles, which its size bounds
        for r in known.select("text").mapInArrow(_counted(shared), "k int, shingle long, n long").groupBy("k", "shingle").agg(F.sum("n").alias("n")).toLocalIterator() if len(block.begins) else ():
            counts[r["k"]][r["shingle"]] = r["n"]
        shared.destroy()
        block.rank(counts)
        ranked = spark.sparkContext.broadcast(block)
        hits = marked.mapInArrow(_joined(ranked), _MARKED)
        if n == 1:
            return hits.drop("mark")
        found.append(common.durable(hits))
        ranked.destroy()
    rows = found[0]
    for more in found[1:]:
        rows = rows.unionByName(more)
    return _combined(rows, len(found))


def _combined(rows: DataFrame, blocks: int) -> DataFrame:
    """Unite what the blocks found in each document row; rows that repeat come back as often as they went in."""
    merged = rows.groupBy("doc_id", "n_words", "mark").agg(
        F.flatten(F.collect_set("spans")).alias("s"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
        F.count("*").alias("n"),
    )
    merged = merged.withColumn("copy", F.explode(F.sequence(F.lit(1), (F.col("n") / blocks).cast("int"))))

    def united(it):
        for ids, n, items, spans in common.column_batches(it, "doc_id", "n_words", "items", "s"):
            own = [_united([(x["start"], x["end"]) for x in s]) for s in spans.to_pylist()]
            yield pa.RecordBatch.from_arrays([ids, n, pa.array(own, _HITS_SCHEMA.field("spans").type), items], schema=_HITS_SCHEMA)

    return merged.mapInArrow(united, _HITS)


def digest(found: DataFrame) -> DataFrame:
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + (s["end"] - s["start"]))
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(find_contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")))
