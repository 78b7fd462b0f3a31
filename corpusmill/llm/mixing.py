"""Mixing sources to target weights by systematic sampling, with DataFrame functions only.

Sources in code-point order (null last) weigh 5, 2, 1, 5, ...; they share all words by weight, no source above three times
its own, what is above being shared again. Every document of a source expects ``target / source size`` copies. Within a
source, documents stand in order of size and id; expected copies are summed along that order, one random offset is added
(from the seed and the source's name, so that reruns agree), and a document is emitted once for each whole number that its
piece of the sum crosses. Because neighbours have like sizes, the words taken miss the target by about one document.

The running sum is a rank times a constant. Ranks come without a window over a source: rows are range-partitioned by
(source, size, id), which splits a hot source and even a hot size, written with their place in the partition, and each
(source, partition) gets the number of rows before it from a table of that many rows.

Edge cases (tested): a null text has size 0; a null source is a source; null ids stand last among equal sizes; rows that
repeat are each placed, in either order with the same rows as the result; sources without words have target 0; an empty
table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusmill.llm import common

WEIGHTS = (5, 2, 1)
CAP = 3
SEED = "mix-1"
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """source, source_size -> the same with target (double). One row a source."""
    named = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    cycle = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(named) - 1) % len(weights)) + 1)
    df = sizes.withColumn("weight", cycle.cast("long")).withColumn("limit", F.col("source_size") * cap)
    df = df.withColumn("level", F.col("limit") / F.col("weight"))
    rising = Window.orderBy("level", F.col("source").asc_nulls_last())
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("limit").over(before), F.lit(0))
    weight = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    # while the level that the rest would reach is above a source's own limit, that source stops there
    df = df.withColumn("share", left / weight).withColumn("stops", F.col("share") >= F.col("level"))
    shared = F.max(F.when(~F.col("stops"), F.col("share"))).over(everything)
    return df.select("source", "source_size", F.when(F.col("stops"), F.col("limit").cast("double")).otherwise(shared * F.col("weight")).alias("target"))


def offset(source: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) that hangs on the seed and the source alone."""
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(source, F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seed: str = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken, and mark (hash of the text) for each row of ``docs``."""
    spark = docs.sparkSession
    sized = common.durable(
        docs.select(F.col("`doc_id`").cast("long").alias("doc_id"), F.col("`source`").alias("source"), word_count("`text`").alias("size"), F.xxhash64(F.col("`text`")).alias("mark"))
    )
    totals = common.durable(source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size"))))
    keys = [F.col("source"), F.col("size"), F.col("doc_id").asc_nulls_last(), F.col("mark")]
    placed = common.durable(
        sized.repartitionByRange(common.partitions(spark), *keys).sortWithinPartitions(*keys).withColumn("place", F.monotonically_increasing_id()).withColumn("part", F.shiftright("place", 33).cast("int"))
    )
    # one row a partition and source in it: as many as there are partitions and sources together
    begins = placed.groupBy("source", "part").agg(F.min("place").alias("first"), F.count("*").alias("n"))
    ahead = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    begins = begins.withColumn("ahead", F.coalesce(F.sum("n").over(ahead), F.lit(0)))
    begins = begins.join(totals.withColumnRenamed("source", "named"), F.col("source").eqNullSafe(F.col("named"))).drop("named", "n")
    begins = common.durable(begins.withColumnsRenamed({"source": "begin_source", "part": "begin_part"}))
    joined = placed.join(common.maybe_broadcast(begins), (F.col("part") == F.col("begin_part")) & F.col("source").eqNullSafe(F.col("begin_source")))
    rank = (F.col("place") - F.col("first") + F.col("ahead") + 1).cast("double")
    each, start = F.col("target") / F.nullif(F.col("source_size"), F.lit(0)), offset(F.col("source"), seed)
    copies = F.coalesce(F.floor(rank * each + start) - F.floor((rank - 1) * each + start), F.lit(0))
    return joined.select("doc_id", "source", "size", "source_size", "target", F.least(copies, F.lit(cap)).cast("long").alias("copies"), "mark").withColumn("taken", F.col("copies") * F.col("size"))


def emitted(docs: DataFrame, **settings) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, with copy numbers from 1 in ``copy`` (a column so named gives way).

    Rows and decisions meet by id and text; rows that repeat in both are paired in order.
    """
    key = Window.partitionBy("doc_id", "mark").orderBy("copies")
    taken = mix(docs, **settings).select("doc_id", "mark", "copies").withColumn("nth", F.row_number().over(key))
    taken = taken.filter("copies > 0").withColumnsRenamed({"doc_id": "mix_id", "mark": "mix_mark"})
    again = Window.partitionBy("id", "its_mark").orderBy("id")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))  # one column: no name can clash
    rows = rows.withColumn("id", F.col("row.doc_id").cast("long")).withColumn("its_mark", F.xxhash64(F.col("row.text"))).withColumn("row_no", F.row_number().over(again))
    met = F.col("id").eqNullSafe(F.col("mix_id")) & F.col("its_mark").eqNullSafe(F.col("mix_mark")) & (F.col("row_no") == F.col("nth"))
    rows = rows.join(taken, met).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return rows.select(*[F.col("row").getField(c).alias(c) for c in docs.columns if c != "copy"], "copy")


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


OP4_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT source, source_size, CAST(CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS BIGINT) AS weight FROM s),
l AS (SELECT *, 3 * source_size AS cap, CAST(3 * source_size AS DOUBLE) / CAST(weight AS DOUBLE) AS level FROM w),
r AS (SELECT *,
  CAST(sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY level, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
  / CAST(sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY level, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS share FROM l),
t AS (SELECT source, source_size, CASE WHEN share >= level THEN CAST(cap AS DOUBLE) ELSE max(CASE WHEN share < level THEN share END) OVER () * weight END AS target,
  CAST('0x' || substr(md5('mix-1:' || coalesce(source, '')), 1, 8) AS BIGINT)::DOUBLE / 4294967296.0::DOUBLE AS start FROM r),
k AS (SELECT d.doc_id, d.size, d.source, t.source_size, t.target, t.start, t.target / nullif(t.source_size, 0)::DOUBLE AS each,
  CAST(row_number() OVER (PARTITION BY d.source ORDER BY d.size, d.doc_id ASC NULLS LAST) AS DOUBLE) AS rank
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (SELECT *, CAST(least(coalesce(floor(rank * each + start) - floor((rank - 1) * each + start), 0), 3) AS BIGINT) AS copies FROM k)
SELECT doc_id, size, source_size, target, copies * size AS taken, source, copies FROM c
"""
