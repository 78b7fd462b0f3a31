"""Merkle manifest of a set of documents: one root, and for each document the siblings that prove it is in.

A document's leaf is the hash of its fields. The leaves of a language, in order of doc_id, are hashed in runs of ``fanout``
level by level until one node is left, the language's subroot; the subroots, in order of language, likewise give the root.

Leaves are numbered from range partitions and their counts, without a window over a language, and cut into aligned blocks of
``block`` leaves, a power of the fanout, so that each block is a whole subtree whatever a language holds. A block is one
matrix of 64-byte hex digests in a task: reshaped by the fanout its rows are the next level's runs, and index arithmetic
gives every sibling. Block roots are the leaves of the next round, which is 4,096 times smaller. Paths come back the same
way, from the root to the blocks and from a block, in one pass, to its documents: a proof is never shuffled.

Edge cases (tested): a null field is ``-``; a null language is a language, the first; null ids stand first; rows that share
an id stand in order of their leaves, and rows that repeat have equal leaves and each a place of its own; texts are hashed
whole in the JVM, whatever their length; an empty table has no root and gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm import common

FANOUT = 2
#: Leaves of a block at most; the largest power of the fanout up to this is taken.
BLOCK = 4096
#: Documents whose number decimally hashed by crc32 is divisible by this are tampered with.
TAMPERED = 7

_PATHS = "tree string, block long, subroot string, lefts array<int>, runs array<string>"
_NODES = "tree string, index long, n long, digest string"
_PROOFS = "doc_id long, lang string, leaf string, subroot string, lefts array<int>, runs array<string>"
_CHECKED = "doc_id long, leaf string, subroot string, proof_sha256 string, folded_root string"


def field(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(docs: DataFrame, n_chars: Column | None = None) -> Column:
    """The hash of a document's fields; ``n_chars`` may be given in place of the column."""
    fields = [docs["doc_id"].cast("long"), docs["source"], docs["lang"], docs["n_chars"].cast("long") if n_chars is None else n_chars, docs["text"]]
    return F.sha2(F.concat(*map(field, fields)), 256)


def matrix(digests: list[str]) -> np.ndarray:
    """Hex digests as the rows of a contiguous matrix of bytes."""
    return np.array(digests, "S64").view(np.uint8).reshape(-1, 64)


def strings(rows: np.ndarray) -> list[str]:
    whole, width = rows.tobytes().decode(), rows.shape[1]
    return [whole[i * width : (i + 1) * width] for i in range(len(rows))]


def hashed(rows: np.ndarray) -> np.ndarray:
    """The hash of each row, as a matrix of hex digests."""
    data, width = memoryview(np.ascontiguousarray(rows)).cast("B"), rows.shape[1]
    return np.frombuffer("".join([sha256(data[i : i + width]).hexdigest() for i in range(0, len(data), width)]).encode(), np.uint8).reshape(-1, 64)


def levels(leaves: np.ndarray, fanout: int, height: int = 0) -> list[np.ndarray]:
    """The matrices of a tree's nodes, leaves first, up to a single one, ``height`` levels above the leaves at least."""
    found = [leaves]
    while len(found[-1]) > 1 or len(found) <= height:
        below = found[-1]
        cut = len(below) // fanout * fanout
        above = [hashed(below[:cut].reshape(-1, 64 * fanout))] if cut else []
        if cut < len(below):
            above.append(hashed(below[cut:].reshape(1, -1)))
        found.append(np.concatenate(above))
    return found


def steps(found: list[np.ndarray], fanout: int) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """Level by level, for the leaves of whole runs and for those of a shorter last one: the leaves as a slice, the place of
    each one's node in its run, and the other nodes of the run, left to right."""
    at = np.arange(len(found[0]))
    for nodes in found[:-1]:
        cut = len(nodes) // fanout * fanout
        split = int(np.searchsorted(at, cut))
        for rows, size in ((slice(0, split), fanout), (slice(split, len(at)), len(nodes) - cut)):
            i = at[rows]
            if len(i):
                begin = i // fanout * fanout
                others = begin[:, None] + np.arange(size - 1)
                others += others >= i[:, None]
                yield rows, i - begin, nodes[others].reshape(len(i), 64 * (size - 1))
        at = at // fanout


def folded(nodes: np.ndarray, left: np.ndarray, others: np.ndarray) -> np.ndarray:
    """The parents of nodes that have ``left`` of ``others`` before them in their run."""
    size = others.shape[1] // 64 + 1
    others, runs = others.reshape(len(nodes), size - 1, 64), np.empty((len(nodes), size, 64), np.uint8)
    for place in range(size):
        here = left == place
        runs[here, :place], runs[here, place], runs[here, place + 1 :] = others[here, :place], nodes[here], others[here, place:]
    return hashed(runs.reshape(len(nodes), -1))


def fold(digest: str, lefts: list[int], runs: list[str]) -> str:
    """The root that a leaf and its proof, as ``proofs`` gives it, amount to."""
    for left, run in zip(lefts, runs, strict=True):
        digest = sha256((run[: 64 * left] + digest + run[64 * left :]).encode()).hexdigest()
    return digest


def _height(n: int, fanout: int, block: int) -> int:
    """Levels of a block: all of a block's in a tree of several blocks, as many as there are nodes for in a single one."""
    return round(np.log(block) / np.log(fanout)) if n > block else 0


def _sorted(group: pa.Table) -> pa.Table:
    return group.sort_by("at")


def _block_root(fanout: int, block: int):
    def run(group: pa.Table) -> pa.Table:
        group = _sorted(group)
        n = group["n"][0].as_py()
        root = levels(matrix(group["digest"].to_pylist()), fanout, _height(n, fanout, block))[-1]
        return pa.table([group["tree"].slice(0, 1), group["block"].slice(0, 1), pa.array([-(-n // block)], pa.int64()), pa.array(strings(root))], names=["tree", "index", "n", "digest"])

    return run


def _node_paths(fanout: int, block: int):
    """Paths from a block's nodes to the root, given the block's own."""

    def run(group: pa.Table, above: pa.Table) -> pa.Table:
        group, above = _sorted(group), above.to_pylist()[0]
        found = levels(matrix(group["digest"].to_pylist()), fanout, _height(group["n"][0].as_py(), fanout, block))
        lefts, runs = [[] for _ in range(len(group))], [[] for _ in range(len(group))]
        for rows, left, others in steps(found, fanout):
            for i, x, y in zip(range(rows.start, rows.stop), left.tolist(), strings(others) if others.shape[1] else [""] * len(left), strict=True):
                lefts[i].append(x)
                runs[i].append(y)
        index = [above["block"] * block + i for i in group["at"].to_pylist()]
        columns = [group["tree"], index, [above["subroot"]] * len(index), [x + above["lefts"] for x in lefts], [x + above["runs"] for x in runs]]
        kinds = [pa.string(), pa.int64(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.string())]
        return pa.table([c if isinstance(c, pa.ChunkedArray) else pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["tree", "block", "subroot", "lefts", "runs"])

    return run


def _checked(fanout: int, block: int):
    """The hash of each leaf's siblings, and the root that the leaf as found now amounts to with them."""

    def run(group: pa.Table, above: pa.Table) -> pa.Table:
        group, above = _sorted(group), above.to_pylist()[0]
        leaves = group["digest"].to_pylist()
        found = levels(matrix(leaves), fanout, _height(group["n"][0].as_py(), fanout, block))
        now = matrix([x or y for x, y in zip(group["altered"].to_pylist(), leaves, strict=True)]).copy()
        proofs = [sha256() for _ in leaves]
        for rows, left, others in steps(found, fanout):
            for proof, run_ in zip(proofs[rows], others, strict=True):
                proof.update(run_)
            now[rows] = folded(now[rows], left, others)
        for left, run_ in zip(above["lefts"], above["runs"], strict=True):
            others = np.broadcast_to(np.frombuffer(run_.encode(), np.uint8), (len(now), len(run_)))
            now = folded(now, np.full(len(now), left), others)
        tail = "".join(above["runs"]).encode()
        for proof in proofs:
            proof.update(tail)
        columns = [group["doc_id"], group["digest"], pa.array([above["subroot"]] * len(leaves), pa.string()), pa.array([p.hexdigest() for p in proofs], pa.string()), pa.array(strings(now), pa.string())]
        return pa.table(columns, names=["doc_id", "leaf", "subroot", "proof_sha256", "folded_root"])

    return run


def _blocked(nodes: DataFrame, block: int) -> DataFrame:
    """Nodes numbered by ``index`` with their block and their number ``at`` in it."""
    return nodes.withColumn("block", F.floor(F.col("index") / block).cast("long")).withColumn("at", (F.col("index") % block).cast("int"))


class Manifest:
    """Trees of a set of documents. ``root`` is None for an empty set.

    ``altered`` is the value of n_chars as it is found at a later look, null where nothing was altered; ``checked`` folds
    the leaf that it gives.
    """

    def __init__(self, docs: DataFrame, fanout: int = FANOUT, block: int = BLOCK, altered: Column | None = None):
        if fanout < 2 or block < fanout:
            raise ValueError("a run has two nodes at least, and a block a run")
        self.fanout, self.block = fanout, fanout
        while self.block * fanout <= block:
            self.block *= fanout
        docs = common.plain(docs, "doc_id", "source", "lang", "n_chars", "text")
        now = F.lit(None).cast("string") if altered is None else F.when(altered.isNotNull(), leaf(docs, altered))
        leaves = docs.select(F.col("lang").alias("tree"), F.col("doc_id").cast("long").alias("doc_id"), leaf(docs).alias("digest"), now.alias("altered"))
        self.leaves = common.durable(_blocked(common.numbered(leaves, "tree", ["doc_id", "digest"]), self.block).drop("index"))
        self.rounds, roots = self._grown(self.leaves)
        self.subroots = roots.select(F.col("tree").alias("lang"), F.col("digest").alias("subroot"))
        self.top = common.durable(_blocked(common.numbered(roots.select(F.lit("").alias("tree"), F.col("tree").alias("lang"), "digest"), "tree", ["lang"]), self.block))
        self.top_rounds, last = self._grown(self.top)
        found = last.select("digest").first()  # one row
        self.root = found["digest"] if found else None

    def _grown(self, nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
        """The tables of nodes by rounds of blocks, and the table of the trees' roots."""
        rounds = [nodes]
        while True:
            roots = common.durable(rounds[-1].select("tree", "n", "block", "at", "digest").groupBy("tree", "block").applyInArrow(_block_root(self.fanout, self.block), _NODES))
            if (roots.agg(F.max("n")).first()[0] or 1) == 1:
                return rounds, roots
            rounds.append(_blocked(roots, self.block))

    def _met(self, nodes: DataFrame, paths: DataFrame, run, schema: str) -> DataFrame:
        return nodes.groupBy("tree", "block").cogroup(paths.groupBy("tree", "block")).applyInArrow(run, schema)

    def _paths(self) -> DataFrame:
        """Paths of the blocks of leaves, from the root downwards; one row a block."""
        spark, run = self.leaves.sparkSession, _node_paths(self.fanout, self.block)
        paths = spark.createDataFrame([("", 0, None, [], [])], _PATHS)
        for nodes in reversed(self.top_rounds):
            paths = self._met(nodes.select("tree", "n", "block", "at", "digest"), paths, run, _PATHS)
        trees = self.top.select("lang", "index", F.col("digest").alias("root"))
        paths = common.durable(paths.join(trees, F.col("block") == F.col("index")).select(F.col("lang").alias("tree"), F.lit(0).cast("long").alias("block"), F.col("root").alias("subroot"), "lefts", "runs"))
        for nodes in reversed(self.rounds[1:]):
            paths = common.durable(self._met(nodes.select("tree", "n", "block", "at", "digest"), paths, run, _PATHS))
        return paths

    def proofs(self) -> DataFrame:
        """doc_id, lang, leaf, subroot, lefts and runs of each document: what ``fold`` needs, some twenty digests a row."""
        inner = _node_paths(self.fanout, self.block)

        def run(group: pa.Table, above: pa.Table) -> pa.Table:
            group = _sorted(group)
            found = inner(group, above)
            return pa.table([group["doc_id"], group["tree"], group["digest"], found["subroot"], found["lefts"], found["runs"]], names=["doc_id", "lang", "leaf", "subroot", "lefts", "runs"])

        return self._met(self.leaves, self._paths(), run, _PROOFS)

    def checked(self) -> DataFrame:
        """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of each document; proofs stay in their task."""
        found = self._met(self.leaves, self._paths(), _checked(self.fanout, self.block), _CHECKED).withColumn("root", F.lit(self.root).cast("string"))
        return found.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def tampering(docs: DataFrame) -> Column:
    """n_chars and one more where the id's crc32 is divisible by ``TAMPERED``; null elsewhere."""
    return F.when(common.crc_remainder("doc_id", TAMPERED) == 0, docs["n_chars"].cast("long") + 1)


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return Manifest(docs, altered=tampering(docs)).checked()


#: crc32 of ASCII text by the rule of its polynomial, as DuckDB has no function for it: {text} stands for the text.
CRC_TABLE = """SELECT list_transform(range(256), lambda b: list_reduce(list_concat([b], [0, 0, 0, 0, 0, 0, 0, 0]),
  lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab"""
CRC = "xor(list_reduce(list_concat([4294967295], list_transform(string_split({text}, ''), lambda s: CAST(ord(s) AS BIGINT))), lambda c, b: xor(tab[(xor(c, b) & 255) + 1], c >> 8)), 4294967295)"

_FIELD = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen(CAST({0} AS VARCHAR)) || ':' || {0} END"
_LEAF = "sha256(" + " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "{n}", "text")) + ")"
_UP = "list_transform(range((len(nodes) + 1) // 2), lambda j: sha256(nodes[2 * j + 1] || coalesce(nodes[2 * j + 2], '')))"
_STEP = "CASE WHEN pos % 2 = 1 THEN 'L' ELSE 'R' END || coalesce(nodes[xor(pos, 1) + 1], '')"

OP12_SQL = f"""
WITH RECURSIVE crc AS ({CRC_TABLE}),
d AS (SELECT doc_id, lang, {_LEAF.format(n='n_chars')} AS leaf,
  CASE WHEN {CRC.format(text='CAST(doc_id AS VARCHAR)')} % 7 = 0 THEN {_LEAF.format(n='(n_chars + 1)')} ELSE {_LEAF.format(n='n_chars')} END AS now FROM documents, crc),
p AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM d),
t(lang, level, nodes) AS (SELECT lang, 0, list(leaf ORDER BY i) FROM p GROUP BY lang UNION ALL SELECT lang, level + 1, {_UP} FROM t WHERE len(nodes) > 1),
s AS (SELECT lang, nodes[1] AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS k FROM t WHERE len(nodes) = 1),
u(level, nodes) AS (SELECT 0, list(subroot ORDER BY k) FROM s UNION ALL SELECT level + 1, {_UP} FROM u WHERE len(nodes) > 1),
inner_steps AS (SELECT p.lang, p.i, level, p.i >> level AS pos, nodes FROM p JOIN t ON p.lang IS NOT DISTINCT FROM t.lang WHERE len(nodes) > 1),
outer_steps AS (SELECT lang, level, k >> level AS pos, nodes FROM s, u WHERE len(nodes) > 1),
a AS (SELECT lang, i, list({_STEP} ORDER BY level) AS steps FROM inner_steps GROUP BY lang, i),
b AS (SELECT lang, list({_STEP} ORDER BY level) AS steps FROM outer_steps GROUP BY lang),
r AS (SELECT nodes[1] AS root FROM u WHERE len(nodes) = 1),
x AS (SELECT p.doc_id, p.leaf, p.now, s.subroot, r.root, list_concat(coalesce(a.steps, []), coalesce(b.steps, [])) AS steps FROM p JOIN s ON p.lang IS NOT DISTINCT FROM s.lang
  CROSS JOIN r LEFT JOIN a ON p.lang IS NOT DISTINCT FROM a.lang AND p.i = a.i LEFT JOIN b ON p.lang IS NOT DISTINCT FROM b.lang),
y AS (SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(steps, lambda q: q[2:]), '')) AS proof_sha256,
  list_reduce(list_concat([now], steps), lambda v, q: sha256(CASE WHEN q[1] = 'L' THEN q[2:] || v ELSE v || q[2:] END)) AS folded_root FROM x)
SELECT *, folded_root = root AS verified FROM y
"""
