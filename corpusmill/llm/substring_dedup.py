"""Substring deduplication with a log-structured fingerprint index.

Every window of ``window`` consecutive words gets a 64-bit fingerprint. Fingerprints are dealt to buckets by the
window's *minimizer* (the least hash of its ``window // 2``-word parts): equal windows meet in one bucket, and
neighbouring windows mostly share a bucket, so that places travel as short runs. The index is a folder of immutable runs,
one a batch; in each bucket a run is the sorted list of its fingerprints and the place of each one's first occurrence.

A batch comes as one sorted list from each chunk of a map task, one entry a fingerprint. In each bucket these lists are
merged, the sorted list is joined with the sorted list of every run of the history, and the fingerprints that none of them has
become the batch's own run. Runs are bucketed tables, so that the history is read where it lies: a batch shuffles and
writes its own fingerprints alone. Every ``fanout`` runs of a level are compacted into one of the next. Matches are
verified against the text of the first occurrence, by 128-bit digests of the words.

Edge cases (all tested): a null or empty text has no words; a null ``doc_id`` counts as larger than any other; rows that
share a ``doc_id`` are versions of one document, and neither is earlier than the other at the same start; an empty table
gives an empty result; further columns of the input are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm import common

WINDOW = 20
#: Words that a map task gathers before it sorts and sends them on.
CHUNK_WORDS = 400_000
#: Bytes of text for a bucket of an index that is made for one table.
BUCKET_BYTES = 4_000_000
#: Files of a run, at most; an index may have more buckets, which then share files.
FILES = 20_000
#: Ranges of doc_id that ``dedup_substrings`` gives to the index one after the other.
BATCHES = 4
NO_ID = np.iinfo(np.int64).max

_RUNS = "bucket int, kind int, fingerprints binary, spots binary, places binary"
_RUNS_SCHEMA = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("fingerprints", pa.binary()), ("spots", pa.binary()), ("places", pa.binary())])
_PIECES = "doc_id long, start int, windows int, ref_doc long, ref_start int"
_PIECES_SCHEMA = pa.schema([("doc_id", pa.int64()), ("start", pa.int32()), ("windows", pa.int32()), ("ref_doc", pa.int64()), ("ref_start", pa.int32())])
#: Kinds of rows: sorted fingerprints with their places, and repeats (place, place of the first occurrence, number of windows).
RUN, FOUND = 0, 1


def _pack(*arrays: np.ndarray) -> bytes:
    """Integer arrays as byte-planes of differences, compressed; ids and places that rise together shrink to a few bits."""
    parts = [np.array([len(a) for a in arrays], np.int64).tobytes()]
    for a in arrays:
        d = np.diff(a.astype(np.int64), prepend=np.int64(0))
        parts.append(d.view(np.uint8).reshape(-1, 8).T.tobytes())
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def _unpack(blob: bytes, n: int) -> list[np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(blob)
    sizes, at, out = np.frombuffer(data, np.int64, n), 8 * n, []
    for size in sizes:
        planes = np.frombuffer(data, np.uint8, 8 * size, at).reshape(8, size)
        out.append(np.cumsum(np.ascontiguousarray(planes.T).view(np.int64).ravel()))
        at += 8 * size
    return out


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum over each ``width`` consecutive entries."""
    out, done = x, 1
    while done < width:
        step = min(done, width - done)
        out = np.minimum(out[: len(out) - step], out[step:])
        done += step
    return out


def _coalesce(doc, start, ref_doc, ref_start, length=None):
    """Join pieces that follow on from each other both here and in the text they repeat; sorted by (doc, start)."""
    o = np.lexsort((start, doc))
    doc, start, ref_doc, ref_start = doc[o], start[o], ref_doc[o], ref_start[o]
    length = np.ones(len(doc), np.int64) if length is None else length[o]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (ref_doc[1:] != ref_doc[:-1]) | (start[1:] != start[:-1] + length[:-1]) | (ref_start[1:] != ref_start[:-1] + length[:-1])
    first = np.flatnonzero(new)
    return doc[first], start[first], ref_doc[first], ref_start[first], np.add.reduceat(length, first) if len(first) else length


class _Chunk:
    """Documents gathered in a map task until their fingerprints are sorted and dealt out."""

    def __init__(self, window: int, buckets: int):
        self.window, self.buckets = window, buckets
        self.ids: list[int] = []
        self.hashes: list[np.ndarray] = []
        self.words = 0

    def add(self, doc_id: int | None, text: bytes | None) -> None:
        words = text.split() if text else []
        if len(words) >= self.window:
            self.ids.append(NO_ID if doc_id is None else doc_id)
            self.hashes.append(common.hashed(words))
            self.words += len(words)

    def runs(self) -> Iterator[dict]:
        """Rows of _RUNS."""
        if not self.ids:
            return
        w, part = self.window, max(1, self.window // 2)
        order = np.argsort(np.array(self.ids, np.int64), kind="stable")
        ids = np.array(self.ids, np.int64)[order]
        sizes = np.array([len(self.hashes[i]) for i in order])
        h = np.concatenate([self.hashes[i] for i in order])
        self.hashes = []
        begins = np.cumsum(sizes) - sizes
        f, least = common.rolling(h, w), _least(common.rolling(h, part), w - part + 1)
        owner = np.repeat(np.arange(len(ids)), sizes)
        at = np.arange(len(h)) - begins[owner]
        inside = np.flatnonzero(at[: len(f)] <= sizes[owner[: len(f)]] - w)
        f, least, owner, at, place = f[inside], least[inside], owner[inside], at[inside], inside
        # one entry a fingerprint: the first in (doc_id, start); the order of places is that order
        o = np.argsort(f)
        sf, sp = f[o], place[o]
        head = np.flatnonzero(np.r_[True, sf[1:] != sf[:-1]])
        firsts = np.minimum.reduceat(sp, head)
        first_of = np.empty(len(h), np.int64)
        first_of[sp] = np.repeat(firsts, np.diff(np.r_[head, len(sf)]))
        first = first_of[place]
        # a repeat inside the chunk: same words, and not the same start of rows with one doc_id
        later = np.flatnonzero(first != place)
        ref = np.searchsorted(begins, first[later], "right") - 1
        other = (ids[owner[later]] != ids[ref]) | (at[later] != first[later] - begins[ref])
        later, ref = later[other], ref[other]
        same = np.ones(len(later), bool)
        for j in range(w):
            same &= h[place[later] + j] == h[first[later] + j]
        again, ref = later[same], ref[same]
        doc, start, ref_doc, ref_start, length = _coalesce(ids[owner[again]], at[again], ids[ref], first[again] - begins[ref])
        if len(doc):
            yield int(doc[0] % self.buckets), FOUND, None, None, _pack(doc, start, ref_doc, ref_start, length)
        sent = first == place
        sent[later[~same]] = True
        keep = np.flatnonzero(sent)
        bucket = (common.mixed(least[keep]) % np.uint64(self.buckets)).astype(np.int32)
        o = np.argsort(bucket, kind="stable")
        edges = np.flatnonzero(np.diff(bucket[o], prepend=-1, append=-1))
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            i = keep[o[a:b]]
            yield int(bucket[o[a]]), RUN, *_run(f[i], ids[owner[i]], at[i])


def _run(f: np.ndarray, doc: np.ndarray, start: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """A run's lists: sorted fingerprints, the spot of each among the places, and the places."""
    o = np.argsort(f, kind="stable")
    return _pack(f[o].view(np.int64)), _planes(o.astype(np.uint32)), _runs_of(doc, start)


def _planes(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(x.view(np.uint8).reshape(-1, 4).T.tobytes())


def _spots(blob: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(4, -1).T).view(np.uint32).ravel()


def _fingerprints(blob: bytes) -> np.ndarray:
    return _unpack(blob, 1)[0].view(np.uint64)


def _runs_of(doc: np.ndarray, start: np.ndarray) -> bytes:
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (start[1:] != start[:-1] + 1)
    first = np.flatnonzero(new)
    return _pack(doc[first], start[first], np.diff(np.r_[first, len(doc)]))


def _places_of(blob: bytes, spots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(doc, start) of some places of a run."""
    doc, start, length = _unpack(blob, 3)
    ends = np.cumsum(length)
    at = np.searchsorted(ends, spots, "right")
    return doc[at], start[at] + spots - (ends - length)[at]


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(_RUNS_SCHEMA)], schema=_RUNS_SCHEMA)


def _fingerprint(window: int, buckets: int):
    def run(it):
        chunk = _Chunk(window, buckets)
        for ids, texts in common.column_batches(it, "doc_id", "text"):
            for doc_id, text in zip(ids.to_pylist(), common.raw(texts), strict=True):
                chunk.add(doc_id, text)
                if chunk.words >= CHUNK_WORDS:
                    yield _rows(list(chunk.runs()))
                    chunk = _Chunk(window, buckets)
        yield _rows(list(chunk.runs()))

    return run


def _merge(key, new, old=None):
    """Merge a bucket's lists of a batch and join them with the runs of the history: the batch's run, and its repeats.

    A fingerprint that the history has is a repeat at all its places, any other at all but the earliest.
    """
    bucket, out = key[0].as_py(), []
    lists = []
    for kind, prints, spots, places in zip(*(new[c].to_pylist() for c in ("kind", "fingerprints", "spots", "places")), strict=True):
        if kind == FOUND:
            out.append((bucket, FOUND, None, None, places))
        else:
            lists.append((_fingerprints(prints), *_places_of(places, _spots(spots))))
    if lists:
        f, doc, start = (np.concatenate(x) for x in zip(*lists, strict=True))
        o = np.argsort(f, kind="stable")  # merges lists that are sorted already
        f, doc, start = f[o], doc[o], start[o]
        new_print = np.r_[True, f[1:] != f[:-1]]
        heads, group = np.flatnonzero(new_print), np.cumsum(new_print) - 1
        # the earliest place of each fingerprint
        first = heads.copy()
        several = np.diff(np.r_[heads, len(f)]) > 1
        i = np.flatnonzero(several[group])
        i = i[np.lexsort((start[i], doc[i], group[i]))]
        first[several] = i[np.diff(group[i], prepend=-1) > 0]
        known = np.zeros(len(heads), bool)
        ref_doc, ref_start = doc[first], start[first]
        for prints, spots, places in zip(*(old[c].to_pylist() for c in ("fingerprints", "spots", "places")), strict=True) if old is not None else ():
            theirs = _fingerprints(prints)
            at = np.minimum(np.searchsorted(theirs, f[heads]), len(theirs) - 1)  # both are sorted
            both = np.flatnonzero((theirs[at] == f[heads]) & ~known)
            known[both] = True
            ref_doc[both], ref_start[both] = _places_of(places, _spots(spots)[at[both]])
        later = known[group] | (doc != ref_doc[group]) | (start != ref_start[group])
        j, g = np.flatnonzero(later), group[later]
        if len(j):
            d, s, rd, rs, n = _coalesce(doc[j], start[j], ref_doc[g], ref_start[g])
            out.append((bucket, FOUND, None, None, _pack(d, s, rd, rs, n)))
        fresh = first[~known]
        if len(fresh):
            fresh = fresh[np.lexsort((start[fresh], doc[fresh]))]
            out.append((bucket, RUN, *_run(f[fresh], doc[fresh], start[fresh])))
    return pa.Table.from_batches([_rows(out)], _RUNS_SCHEMA)


def _compact(key, table):
    """A bucket's lists of several runs as one; of a fingerprint in two of them the older run's place stays."""
    prints, spots, places, base = [], [], [], 0
    for _, f, s, p in sorted(zip(*(table[c].to_pylist() for c in ("part", "fingerprints", "spots", "places")), strict=True)):
        prints.append(_fingerprints(f))
        spots.append(_spots(s) + np.uint32(base))
        places.append(_unpack(p, 3))
        base += int(places[-1][2].sum())
    f, spots = np.concatenate(prints), np.concatenate(spots)
    o = np.argsort(f, kind="stable")  # merges lists that are sorted already
    o = o[np.r_[True, f[o][1:] != f[o][:-1]]]
    return pa.Table.from_batches([_rows([(key[0].as_py(), RUN, _pack(f[o].view(np.int64)), _planes(spots[o]), _pack(*(np.concatenate(x) for x in zip(*places, strict=True))))])], _RUNS_SCHEMA)


def _spread(it):
    """Repeats as rows of their own."""
    for (blobs,) in common.column_batches(it, "places"):
        for blob in blobs.to_pylist():
            doc, start, ref_doc, ref_start, length = _unpack(blob, 5)
            yield pa.RecordBatch.from_arrays([pa.array(x).cast(f.type) for x, f in zip((doc, start, length, ref_doc, ref_start), _PIECES_SCHEMA, strict=True)], schema=_PIECES_SCHEMA)


def _words(packed: bytes | None) -> list[bytes]:
    return common.unsqueezed(packed).split()


def _seal(words: list[bytes]) -> bytes:
    return xxhash.xxh3_128_digest(b" ".join(words))


def _joined(it):
    """Pieces of one document that follow on from each other, as one."""
    for ids, pieces in common.column_batches(it, "doc_id", "pieces"):
        flat = pieces.flatten()
        doc = np.repeat(ids.to_numpy(), np.diff(pieces.offsets.to_numpy()))
        col = lambda n: flat.field(n).to_numpy().astype(np.int64)  # noqa: E731, B023
        d, s, rd, rs, n = _coalesce(doc, col("start"), col("ref_doc"), col("ref_start"), col("windows"))
        yield pa.RecordBatch.from_arrays([pa.array(x).cast(t) for x, t in zip((d, s, n, rd, rs), _PIECES_SCHEMA.types, strict=True)], schema=_PIECES_SCHEMA)


def _sealed(window: int):
    """The seal of each passage that another place is said to repeat, from the text itself."""
    schema = pa.schema([("ref_doc", pa.int64()), ("ref_start", pa.int32()), ("windows", pa.int32()), ("seal", pa.binary())])

    def run(it):
        for ids, packed, pieces in common.column_batches(it, "doc_id", "packed", "pieces"):
            rows = []
            for doc_id, blob, own in zip(ids.to_pylist(), packed.to_pylist(), pieces.to_pylist(), strict=True):
                words = _words(blob)
                rows += [(doc_id, p["ref_start"], p["windows"], _seal(words[p["ref_start"] : p["ref_start"] + p["windows"] + window - 1])) for p in own]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(schema.types)], schema=schema)

    return run


def _cut(window: int):
    """Drop the words of verified repeats."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string()), ("removed", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))])

    def run(it):
        for ids, packed, pieces in common.column_batches(it, "doc_id", "packed", "pieces"):
            rows = []
            for doc_id, blob, own in zip(ids.to_pylist(), packed.to_pylist(), pieces.to_pylist(), strict=True):
                words = _words(blob)
                gone = np.zeros(len(words) + 1, np.int32)
                for p in own or ():
                    a, b = p["start"], p["start"] + p["windows"] + window - 1
                    if b <= len(words) and _seal(words[a:b]) == p["seal"]:
                        gone[a] += 1
                        gone[b] -= 1
                if own:
                    out = np.cumsum(gone)[:-1] > 0
                    edge = np.flatnonzero(np.diff(np.r_[False, out, False].astype(np.int8)))
                    spans = [{"start": int(a), "end": int(b)} for a, b in edge.reshape(-1, 2)]
                    kept = [w for w, x in zip(words, out.tolist(), strict=True) if not x]
                else:
                    spans, kept = [], words
                rows.append((None if doc_id == NO_ID else doc_id, len(words), len(words) - len(kept), b" ".join(kept).decode(), spans))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(schema.types)], schema=schema)

    return run


_OUT = "doc_id long, n_words long, n_removed long, kept_text string, removed array<struct<start:int,end:int>>"


class FingerprintIndex:
    """Runs of window fingerprints in a folder that all executors share.

    ``add`` deduplicates a batch against the history and inside itself, and keeps its fingerprints as a run; ids of one
    document must not come in two batches. Texts of the history are read for verification from ``history`` (doc_id,
    text), without which an index that has runs takes no batch.

    ``key`` names a batch. A batch whose job died, before or after its run was complete, is given again under its key: the newest
    batch replaces its own run and is matched with the batches before it alone. An older key is refused.

    A run is a table of ``common.Buckets``, named after the first and last batch that it covers, that is never written again.
    Of runs that cover the same batch the widest counts, so that a compaction that dies midway changes nothing. Only
    batches before the newest are compacted, as the next one comes in.
    """

    def __init__(self, spark: SparkSession, path: str, window: int = WINDOW, buckets: int = 256, fanout: int = 4):
        self.spark, self.window, self.buckets, self.fanout, self.path = spark, window, buckets, fanout, path.rstrip("/")
        own = f"window={window},buckets={buckets}"
        self.store = common.Buckets(spark, f"{self.path}/{own}", _RUNS, "bucket", min(buckets, FILES))
        others = [n for n in common.listed(spark, self.path) if n.startswith("window=") and n != own]
        if others:
            raise ValueError(f"the index in {path} has {others[0]}")

    def runs(self) -> list[tuple[int, int, str]]:
        """(first, last, name) of the runs that count, oldest first."""
        found = [(*map(int, n.split("-")[:2]), n) for n in self.store.names()]
        out = []
        for run in sorted(found, key=lambda r: (r[0], -r[1])):
            if not out or run[0] > out[-1][1]:
                out.append(run)
        return out

    def match(self, batch: DataFrame, key: str) -> DataFrame:
        """Keep a batch's run; give its repeats (doc_id, start, windows, ref_doc, ref_start), not verified yet."""
        mark = xxhash.xxh3_64_hexdigest(key.encode())
        runs = self.runs()
        if runs and runs[-1][2].endswith(f"-{mark}"):
            runs = runs[:-1]
        elif mark in common.listed(self.spark, f"{self.path}/keys"):
            raise ValueError(f"batch {key!r} is in the index, and later ones are, too")
        else:
            runs = self._compacted(runs)
        no = runs[-1][1] + 1 if runs else 0
        rows = common.plain(batch, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(_fingerprint(self.window, self.buckets), _RUNS)
        name = f"{no:06d}-{no:06d}-{mark}"
        if runs:
            with self.store.read([r[2] for r in runs]) as history:
                history = history.filter(F.col("kind") == RUN).groupBy("bucket")
                self.store.write(rows.groupBy("bucket").cogroup(history).applyInArrow(_merge, _RUNS), name)
        else:
            self.store.write(rows.groupBy("bucket").applyInArrow(lambda k, t: _merge(k, t), _RUNS), name)
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/keys/{mark}")
        where.getFileSystem(self.spark._jsc.hadoopConfiguration()).mkdirs(where)
        found = self.spark.read.schema(_RUNS).parquet(self.store.folder(name)).filter(F.col("kind") == FOUND).select("places").mapInArrow(_spread, _PIECES)
        # a document's repeats that follow on from each other are one
        return common.durable(
            found.groupBy("doc_id")
            .agg(F.collect_list(F.struct("start", "windows", "ref_doc", "ref_start")).alias("pieces"))
            .mapInArrow(_joined, _PIECES)
        )

    def add(self, batch: DataFrame, key: str, history: DataFrame | None = None) -> DataFrame:
        """``batch`` without the words that repeat; see ``dedup_substrings`` for the columns."""
        mark = xxhash.xxh3_64_hexdigest(key.encode())
        if history is None and [r for r in self.runs() if not r[2].endswith(f"-{mark}")]:
            raise ValueError("the index has runs: their texts are needed as history, as repeats are verified against them")
        return _apply(batch, self.match(batch, key), self.window, history)

    def _compacted(self, runs: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
        """Make one run of each ``fanout`` neighbours of equal width."""
        while alike := [i for i in range(len(runs) - self.fanout + 1) if len({b - a for a, b, _ in runs[i : i + self.fanout]}) == 1]:
            old = runs[alike[0] : alike[0] + self.fanout]
            with self.store.read([r[2] for r in old]) as lists:
                self.store.write(lists.filter(F.col("kind") == RUN).groupBy("bucket").applyInArrow(_compact, _RUNS), f"{old[0][0]:06d}-{old[-1][1]:06d}")
            for _, _, name in old:
                common.remove(self.spark, self.store.folder(name))
            runs = self.runs()
        return runs


def _apply(docs: DataFrame, pieces: DataFrame, window: int, history: DataFrame | None) -> DataFrame:
    def packed(df):
        return common.plain(df, "doc_id", "text").withColumn("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(int(NO_ID)))).mapInArrow(common.squeezed, "doc_id long, packed binary")

    own = packed(docs)
    known = own if history is None else own.unionByName(packed(history))
    asked = pieces.select("ref_doc", "ref_start", "windows").distinct().groupBy("ref_doc").agg(F.collect_list(F.struct("ref_start", "windows")).alias("pieces"))
    seals = common.durable(
        known.join(asked, known["doc_id"] == asked["ref_doc"])
        .select("doc_id", "packed", "pieces")
        .mapInArrow(_sealed(window), "ref_doc long, ref_start int, windows int, seal binary")
    )
    checked = (
        common.salted_join(pieces, seals, ["ref_doc", "ref_start", "windows"], "doc_id")
        .groupBy("doc_id")
        .agg(F.collect_set(F.struct("start", "windows", "seal")).alias("pieces"))
    )
    return own.join(checked, "doc_id", "left").select("doc_id", "packed", "pieces").mapInArrow(_cut(window), _OUT)


def dedup_substrings(docs: DataFrame, window: int = WINDOW, buckets: int | None = None, batches: int = BATCHES, fanout: int = 3) -> DataFrame:
    """Remove each word covered by a window whose words also start earlier (smaller doc_id, or earlier in the document).

    The table goes through an index of its own in ``batches`` ranges of doc_id, the smallest first. Returns doc_id,
    n_words, n_removed, kept_text (kept words joined by one space) and removed (spans of word positions). See the
    module's text for nulls, ties and repeated rows.
    """
    spark = docs.sparkSession
    rows = common.plain(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    cuts = F.percentile_approx("doc_id", [(i + 1) / batches for i in range(batches - 1)] or [0.5], 1000)
    size, cuts = rows.agg(F.sum(F.octet_length("text")), cuts).first()
    buckets = buckets or max(common.partitions(spark), (size or 0) // BUCKET_BYTES)
    edges = [None, *sorted(set(cuts or []))[: batches - 1], None]
    path = f"{common.shared_dir(spark)}/scratch/{uuid.uuid4().hex}"
    index, pieces = FingerprintIndex(spark, path, window, buckets, fanout), None
    for no, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        batch = rows if a is None else rows.filter((F.col("doc_id") > a) | F.col("doc_id").isNull()) if b is None else rows.filter(F.col("doc_id") > a)
        batch = batch if b is None else batch.filter(F.col("doc_id") <= b)
        found = index.match(batch, str(no))
        pieces = found if pieces is None else pieces.unionByName(found)
    common.remove(spark, path)
    return _apply(rows, pieces, window, None)


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup_substrings(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))
