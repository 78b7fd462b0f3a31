r"""N-gram Jaccard join with adaptive multi-match prefixes.

A document is its set of distinct ``n``-word shingles, counted by their 64-bit hashes. Shingles are ordered by document
frequency and hash: a table of the most common ones, counted over all documents but for those that a chunk of texts has
once; others count as rare. The table sets the order alone. For a threshold t, two sets that link share at
least l shingles of their first ``size - ceil(t size) + l``. Each document takes the l with the least estimated cost: longer
prefixes read longer lists, but a partner must share l of them, so that at most (sum of the lists) / l partners are left
to verify. A pair needs the smaller l of the two as shared prefix shingles.

Groups of copies never meet pair by pair:

* documents with equal sets form a class at once;
* shingles with the same list of documents are merged into one weighted list;
* in a list every document meets the list's smallest one, its hub; of its hubs first the one it shares most with, then
  those that the links so far have not put into its component. Two members in the hub's component need no test of their
  own. Only members outside it meet the other members of the list, and there only those of another component and of
  fitting size, with enough shared prefix shingles to reach the threshold. No link between components is lost.

Pairs are verified on the shingles themselves, as words.

Edge cases (tested): null and empty texts have an empty set and link with nothing; a text of fewer than n words is one
shingle; rows that share an id are one node, each with its own set; a null id takes no part and has a null component; an
empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm import common
from corpusmill.llm.components import components

SHINGLE = 5
PERCENT = 80
#: Bound of the broadcast table of frequencies; it sets the order alone and never what links.
COMMON = 1_000_000
MAX_SHARED = 8
_CHUNK_WORDS = 4_000_000


def shingles(text: bytes | None, n: int) -> np.ndarray:
    """Hashes of the distinct shingles in increasing order."""
    words = text.lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    return np.unique(common.rolling(common.hashed(words), min(n, len(words))))


def exact_shingles(text: bytes, n: int) -> set:
    words = text.lower().split()
    return {tuple(words)} if len(words) < n else set(zip(*(words[i:] for i in range(n)), strict=False))


def _survey(n: int):
    """Shingles in several documents of a chunk, with their number."""

    def run(it):
        def out(parts):
            key, count = np.unique(np.concatenate(parts), return_counts=True)
            often = count >= 2
            return pa.RecordBatch.from_arrays([pa.array(common.signed(key[often])), pa.array(count[often].astype(np.int64))], names=["shingle", "n"])

        parts, size = [], 0
        for (texts,) in common.column_batches(it, "text"):
            for text in common.raw(texts):
                parts.append(shingles(text, n))
                size += len(parts[-1])
                if size > _CHUNK_WORDS:
                    yield out(parts)
                    parts, size = [], 0
        if parts:
            yield out(parts)

    return run


def needed(size: int, percent: int) -> int:
    return -(-percent * size // 100)


def prefix(own: np.ndarray, known: np.ndarray, counts: np.ndarray, percent: int) -> tuple[np.ndarray, int]:
    """The prefix of one set, and how many of it a partner must share."""
    size = len(own)
    lists = np.ones(size, np.int64)
    if len(known):
        at = np.minimum(np.searchsorted(known, own), len(known) - 1)
        lists = np.where(known[at] == own, counts[at], 1)
    order = np.lexsort((own, lists))
    base = size - needed(size, percent)
    longest = min(MAX_SHARED, size - base)
    read = np.cumsum(lists[order[: base + longest]] - 1)
    cost = [read[base + l - 1] * (1 + size / (50 * l)) + 8 * l for l in range(1, longest + 1)]
    best = int(np.argmin(cost)) + 1
    return own[order[: base + best]], best


def _prefixes(shared, n: int, percent: int):
    schema = pa.schema([("doc_id", pa.int64()), ("size", pa.int32()), ("need", pa.int32()), ("digest", pa.binary()), ("rare", pa.list_(pa.int64())), ("frequent", pa.list_(pa.int64()))])
    least = next(s for s in range(1, 1000) if needed(s + 1, percent) <= s)  # smaller sets link with equal ones alone

    def run(it):
        known, counts = shared.value
        seen: set[bytes] = set()
        for ids, texts in common.column_batches(it, "doc_id", "text"):
            rows = []
            for doc_id, text in zip(ids.to_pylist(), common.raw(texts), strict=True):
                own = shingles(text, n)
                digest = xxhash.xxh3_128_digest(own.tobytes()) if len(own) else None
                rare, frequent, need = None, None, 0
                if len(own) >= least and doc_id is not None and digest not in seen:
                    seen.add(digest)  # a copy in the same task needs no prefix: its class is linked as a whole
                    part, need = prefix(own, known, counts, percent)
                    inside = known[np.minimum(np.searchsorted(known, part), len(known) - 1)] == part if len(known) else np.zeros(len(part), bool)
                    rare, frequent = common.signed(part[~inside]), common.signed(part[inside])
                rows.append((doc_id, len(own), need, digest, rare, frequent))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(schema.types)], schema=schema)

    return run


def _repeated(it):
    """Of rows in order of their token, those whose token another row has, too."""
    held, known = None, False  # the last row so far, and whether the one before has its token
    for batch in it:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch] if held is None else [*held.to_batches(), batch])
        token = rows["token"].to_numpy()
        same = token[1:] == token[:-1]
        before = np.r_[known, same]
        found = before | np.r_[same, False]
        found[-1] = False  # its successor is in the next batch
        yield from rows.filter(pa.array(found)).to_batches()
        held, known = rows.slice(len(token) - 1), bool(before[-1])
    if held is not None and known:
        yield from held.to_batches()


def _verified(n: int, percent: int):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("linked", pa.bool_())])

    def run(it):
        for a, b, left, right in common.column_batches(it, "a", "b", "left", "right"):
            last, held, linked = None, set(), []
            for x, y in zip(left.to_pylist(), right.to_pylist(), strict=True):
                if x != last:
                    last, held = x, exact_shingles(common.unsqueezed(x), n)
                other = exact_shingles(common.unsqueezed(y), n)
                both = len(held & other)
                linked.append(100 * both >= percent * (len(held) + len(other) - both))
            yield pa.RecordBatch.from_arrays([a, b, pa.array(linked, pa.bool_())], schema=schema)

    return run


def _squeezed(it):
    """Texts compressed for a shuffle, with the sides of pairs that they are on."""
    schema = pa.schema([("doc_id", pa.int64()), ("sides", pa.int32()), ("packed", pa.binary())])
    pack = zstandard.ZstdCompressor(level=3).compress
    for ids, sides, texts in common.column_batches(it, "doc_id", "sides", "text"):
        yield pa.RecordBatch.from_arrays([ids, sides, pa.array([pack(t) for t in common.raw(texts)], pa.binary())], schema=schema)


class _Join:
    def __init__(self, docs: DataFrame, n: int, percent: int):
        self.docs, self.n, self.percent, self.spark = docs, n, percent, docs.sparkSession

    def fits(self, x: str, y: str) -> Column:
        return 100 * F.least(x, y) >= self.percent * F.greatest(x, y)

    def needed(self, x: tuple[str, str], y: tuple[str, str]) -> Column:
        """How many shingles the prefixes of two sets (size, need) that link share at least.

        What the sets share is at most what their prefixes share and what is left of the one whose prefix ends first.
        """
        beyond = lambda size, need: F.ceil(F.col(size) * self.percent / 100) - F.col(need)
        overlap = F.ceil((F.col(x[0]) + F.col(y[0])) * self.percent / (100 + self.percent))
        return F.greatest(F.least(x[1], y[1]).cast("long"), overlap - F.greatest(beyond(*x), beyond(*y)))

    def links(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that link, by their texts; rows of one id are tried one by one."""
        pairs = common.durable(pairs.select("a", "b"))
        sides = pairs.select(F.col("a").alias("doc_id"), F.lit(1).alias("side")).unionAll(pairs.select("b", F.lit(2)))
        ids = common.durable(sides.groupBy("doc_id").agg(F.bit_or("side").alias("sides")))
        texts = self.docs.filter(F.col("text").isNotNull()).join(common.maybe_broadcast(ids), "doc_id").mapInArrow(_squeezed, "doc_id long, sides int, packed binary")
        texts = common.durable(texts)
        left, right = (texts.filter(F.col("sides").bitwiseAND(F.lit(k)) > 0).select(F.col("doc_id").alias(n), F.col("packed").alias(v)) for k, n, v in ((1, "a", "left"), (2, "b", "right")))
        # b, mostly in one pair, brings its text to a, the hub, whose text moves once for each part of its pairs
        met = common.salted_join(pairs.join(right, "b"), left, ["a"], "b", pairs)
        found = common.durable(met.select("a", "b", "left", "right").mapInArrow(_verified(self.n, self.percent), "a long, b long, linked boolean").filter("linked").select("a", "b").distinct())
        common.release(ids, texts, pairs)
        return found

    def run(self) -> DataFrame:
        counted = self.docs.select("text").mapInArrow(_survey(self.n), "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
        counted = common.durable(counted)
        rows = counted.filter(F.col("n") >= self.least_count(counted)).toArrow()
        key, count = rows["shingle"].to_numpy().view(np.uint64), rows["n"].to_numpy()
        order = np.argsort(key)
        shared = self.spark.sparkContext.broadcast((key[order], count[order]))
        common.release(counted)
        own = common.durable(self.docs.mapInArrow(_prefixes(shared, self.n, self.percent), "doc_id long, size int, need int, digest binary, rare array<long>, frequent array<long>"))
        copies = own.filter("digest is not null and doc_id is not null")
        classes = copies.groupBy("digest").agg(F.min("doc_id").alias("b"), F.count("*").alias("n")).filter("n > 1").drop("n")
        edges = common.durable(common.salted_join(copies.select("digest", F.col("doc_id").alias("a")), classes, ["digest"], "a").filter("a != b").select("a", "b").distinct())

        both = F.shiftleft(F.col("size").cast("long"), 32).bitwiseOR(F.col("need").cast("long")).alias("both")
        rows = {k: own.filter(f"size({k}) > 0").select(F.explode(k).alias("token"), "doc_id", both) for k in ("rare", "frequent")}
        # shingles of the table are in several documents; of the others, in few documents at most, those that are in one go
        several = rows["rare"].repartition("token").sortWithinPartitions("token").mapInArrow(_repeated, "token long, doc_id long, both long")
        entries = several.unionByName(rows["frequent"]).select("token", "doc_id", F.shiftright("both", 32).cast("int").alias("size"), F.col("both").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int").alias("need"))
        entries = common.durable(entries)
        wide, own = own, common.durable(own.select("doc_id", "size"))
        common.release(wide)
        # lists that are equal become one: equal in number, smallest member and two sums of hashes
        sums = [F.sum(F.pmod(F.xxhash64("doc_id", F.lit(k)), F.lit(1 << 31))).alias(f"s{k}") for k in (1, 2)]
        lists = entries.groupBy("token").agg(F.min(F.struct("doc_id", "size", "need")).alias("hub"), F.count("*").alias("n"), *sums).filter("n > 1")
        lists = lists.groupBy("hub", "n", "s1", "s2").agg(F.min("token").alias("token"), F.count("*").alias("weight"))
        lists = entries.join(lists.select("token", "hub", "weight"), "token")
        lists = common.durable(lists.select("token", "weight", "doc_id", "size", "need", F.col("hub.doc_id").alias("hub"), F.col("hub.size").alias("hub_size"), F.col("hub.need").alias("hub_need")))

        common.release(entries)
        stars = lists.filter("doc_id != hub").groupBy(F.col("hub").alias("a"), F.col("doc_id").alias("b"), "size", "hub_size", "need", "hub_need").agg(F.sum("weight").alias("shared"))
        # counted in the hub's own lists alone; pairs that share more in others come up among the rest
        stars = common.durable(stars.filter(self.fits("size", "hub_size") & (F.col("shared") >= self.needed(("size", "need"), ("hub_size", "hub_need")))).groupBy("a", "b").agg(F.max("shared").alias("shared")))
        nearest = common.durable(stars.groupBy("b").agg(F.max_by("a", F.struct("shared", -F.col("a"))).alias("a")).select("a", "b"))
        group = components(edges.unionByName(self.links(nearest)))
        apart = common.durable(self.apart(stars.select("a", "b"), group).join(nearest, ["a", "b"], "left_anti"))
        group = self.grown(group, apart)
        group = self.grown(group, common.durable(self.rest(lists, group).join(nearest.unionByName(apart), ["a", "b"], "left_anti")))
        return own.select("doc_id", F.col("size").cast("long").alias("n_shingles")).join(group, F.col("doc_id") == F.col("node"), "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))

    def least_count(self, counted: DataFrame) -> int:
        """The least frequency that keeps the table of frequencies within COMMON."""
        many = counted.groupBy("n").agg(F.count("*").alias("shingles")).orderBy(F.desc("n")).toLocalIterator()  # a row a frequency
        total, least = 0, 2
        for row in many:
            total += row["shingles"]
            if total > COMMON:
                return row["n"] + 1
            least = row["n"]
        return least

    def apart(self, pairs: DataFrame, group: DataFrame) -> DataFrame:
        """The pairs that are not yet in one component."""
        for side in ("a", "b"):
            own = group.select(F.col("node").alias(side), F.col("component").alias(f"of_{side}"))
            pairs = pairs.join(own, side, "left").withColumn(f"of_{side}", F.coalesce(f"of_{side}", side))
        return pairs.filter("of_a != of_b").select("a", "b")

    def grown(self, group: DataFrame, pairs: DataFrame) -> DataFrame:
        """Components after the links among ``pairs``."""
        if pairs.isEmpty():
            return group
        return components(group.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(self.links(pairs)))

    def rest(self, lists: DataFrame, group: DataFrame) -> DataFrame:
        """Pairs inside lists that no hub has settled: one of them at least is not in the component of the list's hub."""
        own = group.select(F.col("node").alias("doc_id"), "component")
        hubs = group.select(F.col("node").alias("hub"), F.col("component").alias("hub_component"))
        members = lists.join(own, "doc_id", "left").join(hubs, "hub", "left")
        members = members.select("token", "weight", "doc_id", "size", "need", F.coalesce("component", "doc_id").alias("component"), F.coalesce("hub_component", "hub").alias("hub_component"))
        members = members.withColumn("open", F.col("component") != F.col("hub_component"))
        # a list with an open member and one component in all is settled
        spread = members.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.max("open").alias("any")).filter("any and lo != hi").select("token")
        members = common.durable(members.join(spread, "token"))
        # sets of different components share open lists alone, so these are all that two documents can share
        own = members.groupBy("doc_id").agg(F.sort_array(F.collect_set(F.struct("token", "weight"))).alias("lists"))
        own = own.select("doc_id", F.col("lists.token").alias("tokens"), F.col("lists.weight").cast("array<int>").alias("weights"))
        members = common.durable(members.drop("weight", "hub_component").join(own, "doc_id"))
        x, y = members.alias("x"), members.alias("y")
        need = self.needed(("x.size", "x.need"), ("y.size", "y.need"))
        both = F.array_intersect("x.tokens", "y.tokens")
        weight = F.zip_with("x.weights", F.transform("x.tokens", lambda t: F.array_contains(both, t)), lambda w, there: F.when(there, w).otherwise(0))
        shared = F.aggregate(weight, F.lit(0).cast("long"), lambda a, w: a + w)
        # a pair comes up once, in the first list that both are in, and only with enough in common
        meets = (
            (F.col("x.token") == F.col("y.token")) & F.col("x.open") & (F.col("x.component") != F.col("y.component"))
            & (~F.col("y.open") | (F.col("x.doc_id") < F.col("y.doc_id"))) & self.fits("x.size", "y.size")
            & (F.try_element_at(both, F.lit(1)) == F.col("x.token")) & ((F.size(both) >= need) | (shared >= need))
        )
        return x.join(y, meets).select(F.least("x.doc_id", "y.doc_id").alias("a"), F.greatest("x.doc_id", "y.doc_id").alias("b")).distinct()


def join_components(docs: DataFrame, n: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of ``docs``: the smallest id that links reach, itself included."""
    return _Join(common.plain(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long")), n, percent).run()


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_components(spark.read.parquet(f"{sf_dir}/documents.parquet"), n=4, percent=85)
