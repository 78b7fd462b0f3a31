"""Exact top-k by inner product, by aggregation without random access over sorted lists.

The candidates lie in blocks of ``BLOCK`` vectors. In a block each dimension is a list of its vectors sorted by coordinate. A
query reads all lists to the same depth, each from the end that suits the sign of its own coordinate, and keeps for each
vector a lower and an upper bound of its score: what was read, plus for each list in which the vector was not met yet the
list's last value or the value reached. The k-th best score known to be reached, from lower bounds, from earlier blocks and
from the vectors that looked best so far, whose scores are resolved at once, is what others must reach. Depth grows in ``STEPS`` steps, and
stops for a query when the vectors whose upper bound reaches it are few; those are resolved in whole numbers. A depth at which even a
vector never met could still qualify excludes nobody, as no upper bound is less, and is read past without a look at the
bounds. Bounds of all vectors and many queries are matrix products.

Queries go in blocks of at most ``QUERIES`` rows, one at a time: a block is sent to all tasks, and its result is written
before the next one is read. So memory is bounded whatever the number of queries, which the driver never holds as a whole.

Edge cases (tested): a vector that is null, empty, or has a null or non-finite component takes no part, nor does a row
without id; vectors of another length than the query's are no candidates of it; rows with the query's id are its own; ties
go to the smaller id, and rows that repeat hold a rank each; an empty table gives an empty result; further columns are
ignored. Values whose scores could pass 64 bits are an error, never a wrong score.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusmill.llm import common

K = 10
SCALE = 1024
BLOCK = 16_384
QUERIES = 4096
#: Depths at which bounds are looked at, equal parts of the lists.
STEPS = 8
#: Queries whose bounds are held at once.
_TOGETHER = 128

_OUT = "query_id long, vec_id long, score long"


class Block:
    """Vectors of one length with a sorted list for each dimension."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.x = ids[order], x[order]
        self.wide = self.x.astype(np.float64)
        self.lists = np.sort(self.wide, axis=0)
        #: Entries of the lists that the queries have read so far.
        self.read = 0

    def search(self, owns: np.ndarray, queries: np.ndarray, k: int, reached: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids and scores of the k best for each query; rows with its own id are left out.

        ``reached`` is the k-th best score of each query in the blocks before, or -inf, and is raised to that of this one.
        """
        if max(np.abs(self.wide).max(initial=0), 1) * max(np.abs(queries).max(initial=0), 1) * self.x.shape[1] >= 2.0**62:
            raise OverflowError("inner products of these vectors may pass 64 bits")
        out = []
        for begin in range(0, len(owns), _TOGETHER):
            some = slice(begin, begin + _TOGETHER)
            out += self._together(owns[some], queries[some], k, reached[some])
        return out

    def _together(self, owns, queries, k, reached):
        n, dims = self.x.shape
        q = queries.astype(np.float64)
        plus, minus = np.maximum(q, 0), np.minimum(q, 0)
        low, high = self.lists[0], self.lists[-1]
        slack = 2.0**-40 * dims * np.abs(self.wide).max(initial=0) * np.abs(q).max(axis=1, initial=0)  # of the sums below, in floats
        left, live = np.arange(len(owns)), [None] * len(owns)
        for step in range(1, STEPS):
            depth = n * step // STEPS
            if not depth or not len(left):
                continue
            up, down = self.lists[n - depth], self.lists[depth - 1]
            unmet = plus[left] @ up + minus[left] @ down  # the upper bound of a vector that no list has shown
            look = left[(unmet < reached[left]) | np.isneginf(reached[left])]
            if not len(look):
                continue
            p, m = plus[look], minus[look]
            best = np.maximum(self.wide - up, 0) @ p.T + np.minimum(self.wide - down, 0) @ m.T + (p @ up + m @ down + slack[look])
            least = best - (self.wide < up) @ (p * (up - low)).T - (self.wide > down) @ (m * (down - high)).T - 2 * slack[look]
            own = self.ids[:, None] == owns[look][None, :]
            best[own], least[own] = -np.inf, -np.inf
            if n > k:
                reached[look] = np.maximum(reached[look], np.partition(least, n - k, axis=0)[n - k])
                for c, j in enumerate(look):  # those that look best show what can be reached
                    top = np.argpartition(best[:, c], n - k)[n - k :]
                    if np.isfinite(best[top, c]).all():
                        reached[j] = max(reached[j], (self.x[top] @ queries[j]).min())
            stays = (best >= reached[look]) & ~own
            few = stays.sum(axis=0) <= max(4 * k, n // 64)
            for c in np.flatnonzero(few):
                live[look[c]] = np.flatnonzero(stays[:, c])
            self.read += depth * dims * int(few.sum())
            left = np.setdiff1d(left, look[few])
        self.read += n * dims * len(left)
        out = []
        for j in range(len(owns)):
            rows = np.flatnonzero(self.ids != owns[j]) if live[j] is None else live[j]
            score = self.x[rows] @ queries[j]
            o = np.lexsort((self.ids[rows], -score))[:k]
            out.append((self.ids[rows][o], score[o]))
            if len(o) == k:
                reached[j] = max(reached[j], score[o[-1]])
        return out


def whole(vectors: list, scale: int) -> list[np.ndarray | None]:
    """floor(scale * x) of each component; None for vectors that take no part."""
    out = []
    for v in vectors:
        x = None if v is None or len(v) == 0 or any(c is None for c in v) else np.asarray(v, np.float64)
        x = np.floor(x * scale) if x is not None and np.isfinite(x).all() else None
        if x is not None and np.abs(x).max() >= 2.0**62:
            raise OverflowError("a component of a vector passes 64 bits")
        out.append(None if x is None else x.astype(np.int64))
    return out


def _matrices(ids: list, vectors: list, scale: int):
    """(ids, matrix) for each length of vector."""
    by: dict[int, list] = {}
    for i, x in zip(ids, whole(vectors, scale), strict=True):
        if i is not None and x is not None:
            by.setdefault(len(x), []).append((i, x))
    return {n: (np.array([i for i, _ in rows], np.int64), np.stack([x for _, x in rows])) for n, rows in by.items()}


def _searched(shared, k: int, scale: int):
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def run(it):
        reached = {dims: np.full(len(asked), -np.inf) for dims, (asked, _) in shared.value.items()}

        def out(ids, vectors):
            for dims, (own, x) in _matrices(ids, vectors, scale).items():
                if dims not in shared.value:
                    continue
                asked, wanted = shared.value[dims]
                best = Block(own, x).search(asked, wanted, k, reached[dims])
                found = [(np.full(len(near), q), near, score) for q, (near, score) in zip(asked, best, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in zip(*found, strict=True)], schema=schema)

        ids, vectors = [], []
        for i, v in common.column_batches(it, "vec_id", "embedding"):
            ids += i.to_pylist()
            vectors += v.to_pylist()
            while len(ids) >= BLOCK:
                yield from out(ids[:BLOCK], vectors[:BLOCK])
                ids, vectors = ids[BLOCK:], vectors[BLOCK:]
        if ids:
            yield from out(ids, vectors)

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K, scale: int = SCALE) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows of ``vectors`` for each row of ``queries`` (vec_id, embedding)."""
    spark = vectors.sparkSession
    rows = common.plain(vectors, "vec_id", "embedding").withColumn("vec_id", F.col("vec_id").cast("long"))
    asked = common.plain(queries, "vec_id", "embedding").withColumn("vec_id", F.col("vec_id").cast("long")).filter("vec_id is not null and embedding is not null")
    blocks = max(1, -(-asked.count() // QUERIES))
    best, found = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"), []
    for b in range(blocks):
        part = asked if blocks == 1 else asked.filter(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b)
        got = part.toArrow()
        shared = spark.sparkContext.broadcast(_matrices(got["vec_id"].to_pylist(), got["embedding"].to_pylist(), scale))
        one = rows.mapInArrow(_searched(shared, k, scale), _OUT).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
        found.append(one if blocks == 1 else common.durable(one))
        if blocks > 1:
            shared.destroy()
    every = found[0]
    for one in found[1:]:
        every = every.unionByName(one)
    return every.select("query_id", "rank", "vec_id", "score")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return top_k(vectors, vectors.filter(F.col("vec_id") % 100 == 0))


OP9_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.x, c.x), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.x) = len(c.x)),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 10
"""
