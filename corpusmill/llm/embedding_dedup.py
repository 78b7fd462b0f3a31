"""Near-duplicates among embeddings by iterative quantisation, multi-index Hamming tables and a check of the vectors themselves.

Rotations are learnt from a bounded sample of ``SAMPLE`` vectors: its principal directions are turned, by turns of "nearest
corner of the cube" and "best rotation to those corners", until the signs of the rotated vectors are balanced bits that say
as much as they can. The bits are cut into tables of ``width`` bits, about log2 of the vectors less five, so that a bucket
holds some tens of vectors at any size. Rotations are added until ``RECALL`` of neighbours right at the threshold, made from
the sample in any direction and in the sample's own, share a bucket in some table; closer pairs do so more often. Every
vector is indexed.

Pairs meet in buckets. A pair is looked at in the first table it shares, so that it counts once, and only if their whole
codes are as near as those of neighbours; then the cosine decides. Entries of the tables carry codes, not vectors: vectors
are sent after them to those entries alone that have a partner of near code. A task writes, for each entry, the weight of
its links and the least vector it is connected with; pairs are never written.

Equal vectors are one node with their number as weight. A bucket of more than ``BLOCK`` entries is dealt into parts, and
pairs of parts are cells of their own. Before, its dense middle becomes balls: vectors within half the threshold's angle of
one pivot are linked, by the angles alone, and are not compared with each other. So a large group of near copies costs
what its outsiders cost, not its square.

Edge cases (tested): a vector that is null, empty, zero, or has a null or non-finite component links with nothing; vectors of
different lengths don't link, each length has rotations of its own; rows that share an id are rows of their own; a null id
is never the least of a component that has another; pairs of equal cosine are all found or missed by their codes alone;
vectors of any length are read whole; an empty table gives an empty result; further columns, the labels too, are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm import common, components

THRESHOLD = 0.9
#: Vectors from which rotations are learnt, at most.
SAMPLE = 4096
#: Share of pairs right at the threshold that must share a bucket, as measured on the sample.
RECALL = 0.96
#: Vectors that a bucket holds if all are spread evenly.
OCCUPANCY = 32
#: Entries of a part of a bucket.
BLOCK = 512
#: Pivots tried in a bucket of several parts.
PIVOTS = 8
#: Principal directions used, turns of the quantisation, tables at most with and without the mean taken off, least sample.
_DIRECTIONS, _TURNS, _TABLES, _MOST_TABLES, _LEAST = 256, 25, 128, 1023, 256
_SEED = 20
_MARGIN = 1e-9

_VECTORS = "vec_id long, digest binary, dims int, vector binary"
_ENTRIES = "bucket long, node long, code binary"
_CELLS = "bucket long, cell long, side int, ball long, node long, code binary"
_LINKS = "node long, links long, root long"
_NEAR = "node long, pivot long"


@dataclass
class Index:
    """Rotations and tables for vectors of one length."""

    mean: np.ndarray
    turned: np.ndarray
    width: int
    tables: int
    #: Bits in which codes of neighbours differ at most.
    reach: int

    def codes(self, unit: np.ndarray) -> np.ndarray:
        """The tables' keys of each vector."""
        bits = ((unit - self.mean) @ self.turned > 0)[:, : self.tables * self.width].reshape(len(unit), self.tables, self.width)
        return bits @ (1 << np.arange(self.width, dtype=np.uint32)).astype(np.uint32)


def units(x: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled by their largest component first, so that no square passes the range of doubles."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x**2).sum(axis=1, keepdims=True))


def _rotation(x: np.ndarray, rng: np.random.Generator, turns: int) -> np.ndarray:
    """A rotation that brings the rows of ``x`` near to corners of the cube, from a random one on."""
    turn, _ = np.linalg.qr(rng.standard_normal((x.shape[1], x.shape[1])))
    for _ in range(turns if len(x) else 0):
        corners = np.where(x @ turn > 0, 1.0, -1.0)
        left, _, right = np.linalg.svd(corners.T @ x)
        turn = (left @ right).T
    return turn


def _neighbours(base: np.ndarray, threshold: float, rng: np.random.Generator) -> np.ndarray:
    """For each row two vectors right at the threshold: aside in any direction, and towards another row of the sample."""
    both = []
    for aside in (rng.standard_normal(base.shape), np.roll(base, 1, axis=0)):
        aside = aside - (aside * base).sum(axis=1, keepdims=True) * base
        both.append(threshold * base + math.sqrt(1 - threshold**2) * aside / np.maximum(np.sqrt((aside**2).sum(axis=1, keepdims=True)), 1e-300))
    return np.concatenate(both)


def _tables(sample: np.ndarray, mean: np.ndarray, base: np.ndarray, near: np.ndarray, width: int, recall: float, most: int, rng: np.random.Generator) -> Index | None:
    """Rotations until enough neighbours of either kind share a bucket; None if ``most`` tables are not enough."""
    dims = base.shape[1]
    _, directions = np.linalg.eigh(np.cov((sample - mean).T).reshape(dims, dims)) if len(sample) else (None, np.eye(dims))
    directions = directions[:, ::-1][:, :_DIRECTIONS]
    turned, met, differ, twice = np.zeros((dims, 0)), np.zeros(len(near), bool), np.zeros(len(near), int), np.concatenate([base, base])
    done = 0
    while done < most:
        turned = np.concatenate([turned, directions @ _rotation((sample - mean) @ directions, rng, _TURNS)], axis=1)
        unlike = ((twice - mean) @ turned > 0) != ((near - mean) @ turned > 0)
        for table in range(done, min(turned.shape[1] // width, most)):
            bits = unlike[:, table * width : (table + 1) * width].sum(axis=1)
            met, differ, done = met | (bits == 0), differ + bits, table + 1
            if met.reshape(2, -1).mean(axis=1).min() >= recall:
                return Index(mean, turned[:, : done * width], width, done, int(np.quantile(differ, 0.999)) + 1)
    return None


def learnt(sample: np.ndarray, n: int, dims: int, threshold: float = THRESHOLD, recall: float = RECALL) -> Index:
    """Rotations for ``n`` vectors of ``dims`` components, from a sample of unit vectors.

    The sample's mean is taken off, for balance, unless that parts neighbours, as where all vectors lie in one narrow cone:
    signs of the vectors themselves differ by their angle alone. A sample of less than ``_LEAST`` teaches nothing, and the
    rotations are random. Vectors too few for two buckets share one.
    """
    rng, width = np.random.default_rng(_SEED), int(np.clip(round(math.log2(max(n, 2) / OCCUPANCY)), 0, 30))
    zero = np.zeros(dims)
    if not width:
        return Index(zero, np.zeros((dims, 0)), 0, 1, 0)
    sample = sample if len(sample) >= _LEAST else np.zeros((0, dims))
    base = sample if len(sample) else units(rng.standard_normal((SAMPLE, dims)))
    near = _neighbours(base, threshold, rng)
    found = _tables(sample, sample.mean(axis=0), base, near, width, recall, _TABLES, rng) if len(sample) else None
    found = found or _tables(sample, zero, base, near, width, recall, _MOST_TABLES, rng)
    if found is None:
        raise ValueError(f"no {_MOST_TABLES} tables find {recall} of pairs at a cosine of {threshold}")
    return found


def _prepared(it):
    """Rows with the digest and the bytes of their vector; none where it takes no part."""
    schema = pa.schema([("vec_id", pa.int64()), ("digest", pa.binary()), ("dims", pa.int32()), ("vector", pa.binary())])
    for ids, vectors in common.column_batches(it, "vec_id", "embedding"):
        sizes = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False)
        for dims in np.unique(sizes):
            at = np.flatnonzero(sizes == dims)
            own, n = ids.take(pa.array(at)), len(at)
            digests, packed = [None] * n, [None] * n
            if dims:
                flat = vectors.take(pa.array(at)).flatten()
                kind = np.float32 if pa.types.is_float32(flat.type) else np.float64
                x = pc.fill_null(flat.cast(pa.from_numpy_dtype(kind)), np.nan).to_numpy(zero_copy_only=False).reshape(n, dims) + kind(0)  # no minus zero
                for i in np.flatnonzero(np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)):
                    packed[i] = x[i].tobytes()
                    digests[i] = sha256(packed[i]).digest()
            yield pa.RecordBatch.from_arrays([own, pa.array(digests, pa.binary()), pa.array([dims] * n, pa.int32()), pa.array(packed, pa.binary())], schema=schema)


def unpacked(packed: list[bytes], dims: int) -> np.ndarray:
    """Vectors of one length as unit vectors."""
    size = len(packed[0]) // dims
    return units(np.frombuffer(b"".join(packed), np.float32 if size == 4 else np.float64).reshape(len(packed), dims))


def _encoded(shared, tables: int):
    """An entry for each table: bucket (length, table, key), node, and the whole code, zeros up to the most tables."""

    def run(it):
        for nodes, lengths, vectors in common.column_batches(it, "node", "dims", "vector"):
            nodes, lengths, vectors = nodes.to_numpy(), lengths.to_numpy(), vectors.to_pylist()
            for dims in np.unique(lengths).tolist():
                at, index = np.flatnonzero(lengths == dims), shared.value[dims]
                codes = index.codes(unpacked([vectors[i] for i in at], dims))
                whole = np.zeros((len(at), tables), np.uint32)
                whole[:, : index.tables] = codes
                buckets = (dims << 42) + (np.arange(index.tables, dtype=np.int64) << 32) + codes.astype(np.int64)
                packed = [row.tobytes() for row in whole]
                columns = [buckets.ravel(), np.repeat(nodes[at], index.tables), [p for p in packed for _ in range(index.tables)]]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["bucket", "node", "code"])

    return run


def _whole_cells(it, *more: str) -> Iterator[tuple[int, list]]:
    """(length of the vectors, columns) of whole cells, along rows sorted by bucket and cell. A cell has some hundred rows."""
    held = None
    for columns in common.column_batches(it, "bucket", "cell", "side", "ball", "node", "code", *more):
        new = [c.to_numpy(zero_copy_only=False) for c in columns]
        held = new if held is None else [np.concatenate(c) for c in zip(held, new, strict=True)]
        begin = int(np.argmax((held[0] == held[0][-1]) & (held[1] == held[1][-1])))
        if begin:
            yield from _by_length([c[:begin] for c in held])
            held = [c[begin:] for c in held]
    if held is not None:
        yield from _by_length(held)


def _by_length(columns: list) -> Iterator[tuple[int, list]]:
    dims = columns[0] >> 42
    edges = [0, *(np.flatnonzero(np.diff(dims)) + 1), len(dims)]
    for a, b in zip(edges, edges[1:]):
        yield int(dims[a]), [c[a:b] for c in columns]


def _pairs(columns: list, reach: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of the pairs of near code of each cell, once over all tables."""
    bucket, cell, side, ball, _, code = columns[:6]
    n, table = len(bucket), (bucket >> 32) & 1023
    code = np.frombuffer(b"".join(code), np.uint32).reshape(n, -1)
    same = lambda i, j: (bucket[i] == bucket[j]) & (cell[i] == cell[j])
    i, apart = np.arange(n - 1), 1
    i = i[same(i, i + 1)]
    while len(i):
        a = i[((side[i] < 0) | (side[i] != side[i + apart])) & ((ball[i] < 0) | (ball[i] != ball[i + apart]))]
        b = a + apart
        unlike = code[a] ^ code[b]
        near = ((unlike == 0).argmax(axis=1) == table[a]) & (np.bitwise_count(unlike).sum(axis=1, dtype=np.int64) <= reach)
        yield a[near], b[near]
        apart += 1
        i = i[i + apart < n]
        i = i[same(i, i + apart)]


def _with_partner(reaches: dict[int, int]):
    """The entries that have a partner of near code in their cell."""

    def run(it):
        for dims, columns in _whole_cells(it):
            has = np.zeros(len(columns[0]), bool)
            for a, b in _pairs(columns, reaches[dims]):
                has[a], has[b] = True, True
            if has.any():
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c[has], k) for c, k in zip(columns, kinds, strict=True)], names=["bucket", "cell", "side", "ball", "node", "code"])

    return run


def _linked(reaches: dict[int, int], threshold: float):
    """For each entry with a link: the weight of what it links with in its cell, and the least node it is connected with."""

    def run(it):
        for dims, columns in _whole_cells(it, "weight", "vector"):
            node, weight, vectors = columns[4], columns[6], unpacked(list(columns[7]), dims)
            links, found = np.zeros(len(node), np.int64), []
            for a, b in _pairs(columns, reaches[dims]):
                near = np.einsum("ij,ij->i", vectors[a], vectors[b]) >= threshold
                a, b = a[near], b[near]
                links[a] += weight[b]  # a place stands once among a, and once among b
                links[b] += weight[a]
                found.append((a, b))
            a, b = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, int),) * 2
            root = node.copy()
            while len(a):
                least = np.minimum(root[a], root[b])
                before = root.copy()
                np.minimum.at(root, a, least)
                np.minimum.at(root, b, least)
                if (before == root).all():
                    break
            at = np.flatnonzero(links)
            yield pa.RecordBatch.from_arrays([pa.array(c[at], pa.int64()) for c in (node, links, root)], names=["node", "links", "root"])

    return run


def _within(cosine: float):
    """(node, pivot) where the pivot is near enough that all of its ball are linked; at most ``PIVOTS`` a row."""

    def run(it):
        for nodes, lengths, vectors, pivots in common.column_batches(it, "node", "dims", "vector", "pivots"):
            out = []
            for node, dims, vector, around in zip(nodes.to_pylist(), lengths.to_pylist(), vectors.to_pylist(), pivots.to_pylist(), strict=True):
                near = unpacked([p["vector"] for p in around], dims) @ unpacked([vector], dims)[0] >= cosine
                out += [(node, p["node"]) for p, ok in zip(around, near, strict=True) if ok]
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], pa.int64()) for i in range(2)], names=["node", "pivot"])

    return run


def _balls(hot: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """(node, ball) for the entries ``hot`` (bucket, node) of large buckets: balls are disjoint, and all of a ball are linked.

    A bucket's pivots are its members of least hash, so that the same ones serve the many buckets of one dense group.
    """
    tried = hot.groupBy("bucket").agg(F.array_distinct(F.array(*[F.min_by("node", F.xxhash64("node", F.lit(r))) for r in range(PIVOTS)])).alias("tried"))
    tried = tried.select("bucket", F.explode("tried").alias("node")).join(nodes.select("node", "vector"), "node")
    pivots = tried.groupBy("bucket").agg(F.collect_list(F.struct("node", "vector")).alias("pivots"))  # eight at most
    members = common.durable(common.salted_join(hot, common.durable(pivots), ["bucket"], "node", hot))
    met = members.join(nodes.select("node", "dims", "vector"), "node")
    near = met.select("node", "dims", "vector", "pivots").mapInArrow(_within(math.sqrt((1 + threshold) / 2) + _MARGIN), _NEAR)
    return common.durable(near.groupBy("node").agg(F.min_by("pivot", F.xxhash64("pivot")).alias("ball")))


def _celled(entries: DataFrame, large: DataFrame, nodes: DataFrame, threshold: float, block: int) -> tuple[DataFrame, DataFrame | None]:
    """Entries with cell, side and ball, and the balls. ``large``: the buckets of more than ``block`` entries.

    A small bucket is one cell (side -1: all pairs). A large one is dealt into parts of a ball or of the rest; its cells are
    a part of the rest with itself, or two parts (sides 0 and 1) that are not of one ball.
    """
    whole = [F.lit(0).cast("long").alias("cell"), F.lit(-1).alias("side"), F.lit(-1).cast("long").alias("ball"), "node", "code"]
    if large.isEmpty():
        return entries.select("bucket", *whole), None
    listed = common.maybe_broadcast(large)
    small = entries.join(listed, "bucket", "left_anti").select("bucket", *whole)
    hot = common.durable(entries.join(listed, "bucket", "left_semi"))
    balls = _balls(hot.select("bucket", "node"), nodes, threshold)
    hot = common.durable(hot.join(balls, "node", "left").withColumn("ball", F.coalesce("ball", F.lit(-1).cast("long"))))
    sizes = common.durable(hot.groupBy("bucket", "ball").agg(F.ceil(F.count("*") / block).cast("int").alias("parts")))
    dealt = common.salted_join(hot, sizes, ["bucket", "ball"], "node", hot).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    parts = sizes.select("bucket", "ball", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")).select("bucket", F.struct("ball", "part").alias("a"))
    other = parts.withColumnRenamed("a", "b")
    cells = parts.join(other, "bucket").filter("a <= b and (a.ball < 0 or a.ball != b.ball)")
    cells = common.durable(cells.withColumn("cell", F.monotonically_increasing_id()))
    apart = F.col("a") != F.col("b")
    sides = cells.select("bucket", "cell", "a.ball", "a.part", F.when(apart, 0).otherwise(-1).alias("side")).unionByName(cells.filter(apart).select("bucket", "cell", "b.ball", "b.part", F.lit(1).alias("side")))
    in_cells = dealt.join(sides, ["bucket", "ball", "part"]).select("bucket", "cell", "side", "ball", "node", "code")
    return small.unionByName(in_cells), balls


def _sorted(df: DataFrame) -> DataFrame:
    return df.repartition("bucket", "cell").sortWithinPartitions("bucket", "cell")


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, sample: int = SAMPLE, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links and component_id of each row of ``vectors`` (vec_id, embedding)."""
    spark = vectors.sparkSession
    rows = common.plain(vectors, "vec_id", "embedding").withColumn("vec_id", F.col("vec_id").cast("long"))
    prepared = common.durable(rows.mapInArrow(_prepared, _VECTORS))
    nodes = prepared.filter("digest is not null").groupBy("digest").agg(F.min("vec_id").alias("least"), F.count("*").alias("weight"), F.first("dims").alias("dims"), F.first("vector").alias("vector"))
    nodes = common.durable(nodes.withColumn("node", F.monotonically_increasing_id()))
    counts = {r["dims"]: r["count"] for r in nodes.groupBy("dims").count().toLocalIterator()}  # one row a length
    drawn = nodes.select("dims", "vector", "digest").orderBy(F.xxhash64("digest"), "digest").limit(sample).toArrow()
    seen: dict[int, list] = {dims: [] for dims in counts}
    for dims, vector in zip(drawn["dims"].to_pylist(), drawn["vector"].to_pylist(), strict=True):
        seen[dims].append(vector)
    found = {dims: learnt(unpacked(s, dims) if s else np.zeros((0, dims)), counts[dims], dims, threshold, recall) for dims, s in seen.items()}
    shared, tables, reaches = spark.sparkContext.broadcast(found), max([1, *(i.tables for i in found.values())]), {d: i.reach for d, i in found.items()}
    entries = nodes.select("node", "dims", "vector").mapInArrow(_encoded(shared, tables), _ENTRIES)
    large = common.durable(entries.groupBy("bucket").count().filter(F.col("count") > block).select("bucket"))
    celled, balls = _celled(entries, large, nodes, threshold, block)
    near = common.durable(_sorted(celled).mapInArrow(_with_partner(reaches), _CELLS))
    near = near.join(nodes.select("node", "weight", "vector"), "node").select("bucket", "cell", "side", "ball", "node", "code", "weight", "vector")
    links = common.durable(_sorted(near).mapInArrow(_linked(reaches, threshold), _LINKS))
    if balls is not None:
        weighed = balls.join(nodes.select("node", "weight"), "node")
        of_ball = common.durable(weighed.groupBy("ball").agg(F.sum("weight").alias("all"), F.min("node").alias("root")))
        inside = common.salted_join(common.durable(weighed), of_ball, ["ball"], "node")
        links = common.durable(links.unionByName(inside.select("node", (F.col("all") - F.col("weight")).alias("links"), "root")))
    joined = components.components(links.select(F.col("node").alias("a"), F.col("root").alias("b")))
    joined = common.durable(nodes.select("node", "least").join(joined, "node"))
    least = joined.groupBy("component").agg(F.min("least").alias("component_id"))
    joined = common.salted_join(joined.select("node", "component"), common.durable(least), ["component"], "node").select("node", "component_id")
    result = nodes.select("digest", "node", "least", "weight").join(links.groupBy("node").agg(F.sum("links").alias("links")), "node", "left").join(joined, "node", "left")
    result = result.select("digest", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component_id", "least").alias("component_id"))
    slim = prepared.select("vec_id", "digest")
    linked = common.salted_join(slim.filter("digest is not null"), common.durable(result), ["digest"], "vec_id", slim)
    alone = slim.filter("digest is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.select("vec_id", "n_links", "component_id").unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP13_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS x FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
e AS (SELECT p.vec_id AS a, q.vec_id AS b FROM v p JOIN v q ON p.vec_id <> q.vec_id AND len(p.x) = len(q.x) WHERE list_cosine_similarity(p.x, q.x) >= 0.9),
n AS (SELECT a, count(*) AS n_links FROM e GROUP BY a),
r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
m AS (SELECT a, min(b) AS least FROM r GROUP BY a),
c AS (SELECT vec_id, coalesce(n_links, 0) AS n_links, least(vec_id, coalesce(m.least, vec_id)) AS component_id FROM embeddings LEFT JOIN n ON n.a = vec_id LEFT JOIN m ON m.a = vec_id)
SELECT *, vec_id = component_id AS kept FROM c
"""
