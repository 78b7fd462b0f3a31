"""Helpers that the training-data operators share.

Texts travel to Python as Arrow batches and are handled there as bytes: ``bytes.split()`` cuts at exactly
``\\x20 \\x09-\\x0D``, and ``bytes.lower()`` lowers exactly A-Z, so word rules stated in those terms hold to the byte.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Odd multiplier of the rolling window hash.
BASE = 0x9E3779B97F4A7C15 | 2
#: Bound, in bytes of compressed Parquet, under which a side of a join may be broadcast.
BROADCAST_BYTES = 4_000_000
#: Rows of one key from which a join deals them into parts.
HOT_ROWS = 1_000
_RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where it is unset, as in local tests, a temporary folder of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="corpusmill-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder on any file system that Spark can write."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def listed(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, on any file system that Spark can read; none if there is no such folder."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in fs.listStatus(where)) if fs.exists(where) else []


@contextmanager
def shuffles_released(spark: SparkSession) -> Iterator[None]:
    """Actions inside give up their shuffle files as they end: what they wrote is all that is read again."""
    before = spark.conf.get(_RELEASE, "false")
    spark.conf.set(_RELEASE, "true")
    try:
        yield
    finally:
        spark.conf.set(_RELEASE, before)


def durable(df: DataFrame) -> DataFrame:
    """Write ``df`` to a table in the shared folder and read it back.

    Cuts the lineage without tying rows to an executor: any lost executor can be replaced. The table goes by ``release``,
    or when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/scratch/{uuid.uuid4().hex}"
    with shuffles_released(spark):
        df.write.parquet(path)
    atexit.register(_forget, spark, path)
    table = spark.read.schema(df.schema).parquet(path)
    table.scratch = path
    return table


def release(*tables: DataFrame) -> None:
    """Delete tables that ``durable`` wrote and nobody reads any more."""
    for table in tables:
        remove(table.sparkSession, table.scratch)


class Buckets:
    """A folder of tables that are bucketed by one column: rows of a key, of whatever tables, meet in a task without a shuffle.

    A table is a folder of its own, ``part=<name>``, that is written once and counts once its _SUCCESS is there.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str, files: int):
        self.spark, self.path, self.schema, self.key, self.files = spark, path.rstrip("/"), schema, key, files

    def names(self) -> list[str]:
        """The tables that are complete."""
        return [n.removeprefix("part=") for n in listed(self.spark, self.path) if n.startswith("part=") and "_SUCCESS" in listed(self.spark, f"{self.path}/{n}")]

    def folder(self, part: str) -> str:
        return f"{self.path}/part={part}"

    def write(self, df: DataFrame, part: str) -> None:
        name = f"bucketed_{uuid.uuid4().hex}"
        remove(self.spark, self.folder(part))
        with shuffles_released(self.spark):
            # their columns are packed already
            df.write.bucketBy(self.files, self.key).options(compression="none", **{"parquet.enable.dictionary": "false"}).option("path", self.folder(part)).saveAsTable(name)
        self.spark.sql(f"DROP TABLE {name}")  # the files stay

    @contextmanager
    def read(self, parts: list[str]) -> Iterator[DataFrame]:
        """The rows of some tables, with the table's name as ``part``; to be read inside the block."""
        name = f"bucketed_{uuid.uuid4().hex}"
        self.spark.sql(f"CREATE TABLE {name} ({self.schema}, part STRING) USING parquet PARTITIONED BY (part) CLUSTERED BY ({self.key}) INTO {self.files} BUCKETS LOCATION '{self.path}'")
        self.spark.catalog.recoverPartitions(name)
        try:
            yield self.spark.table(name).filter(F.col("part").isin(parts))
        finally:
            self.spark.sql(f"DROP TABLE {name}")


def salted_join(many: DataFrame, few: DataFrame, on: list[str], spread: str, counted: DataFrame | None = None) -> DataFrame:
    """Inner join where a key may hold a large share of the rows of ``many``; ``few`` has a key once or so.

    ``counted`` is a written table with the keys of ``many``, which is read for them if it is one itself.
    Keys with more than ``HOT_ROWS`` rows, or one in 100,000 of all if that is more, are dealt by hash of the column
    ``spread`` into parts of about that size, and ``few`` is repeated for each part. There are at most 100,000 such keys,
    so that their list may be broadcast.
    """
    counted = many if counted is None else counted
    least = max(HOT_ROWS, counted.count() // 100_000)
    hot = counted.groupBy(*on).count().filter(F.col("count") > least).select(*on, F.ceil(F.col("count") / least).cast("int").alias("parts_"))
    parts = F.coalesce("parts_", F.lit(1))
    hot = durable(hot)
    many = many.join(F.broadcast(hot), on, "left").withColumn("part_", F.pmod(F.xxhash64(spread), parts).cast("int")).drop("parts_")
    few = few.join(F.broadcast(hot), on, "left").withColumn("part_", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts_")
    return many.join(few, [*on, "part_"]).drop("part_")


def numbered(df: DataFrame, tree: str, order: list[str]) -> DataFrame:
    """``df`` with n, the rows of its ``tree``, and index, the row's number (from 0) in the tree by ``order``.

    A tree's rows are counted by range partition and numbered within them, so that a tree may hold any share of the rows. A
    null is a tree.
    """
    placed = df.repartitionByRange(partitions(df.sparkSession), tree, *order).sortWithinPartitions(tree, *order)
    placed = durable(placed.withColumn("place_", F.monotonically_increasing_id()).withColumn("part_", F.shiftright("place_", 33)))
    # one row a partition and tree in it: as many as there are partitions and trees together
    begins = placed.groupBy(F.col(tree).alias("tree_"), F.col("part_").alias("its_part_")).agg(F.min("place_").alias("first_"), F.count("*").alias("rows_"))
    ahead = Window.partitionBy("tree_").orderBy("its_part_").rowsBetween(Window.unboundedPreceding, -1)
    begins = begins.withColumn("ahead_", F.coalesce(F.sum("rows_").over(ahead), F.lit(0))).withColumn("n", F.sum("rows_").over(Window.partitionBy("tree_"))).drop("rows_")
    found = placed.join(maybe_broadcast(durable(begins)), (F.col("part_") == F.col("its_part_")) & F.col(tree).eqNullSafe(F.col("tree_")))
    return found.withColumn("index", F.col("place_") - F.col("first_") + F.col("ahead_")).drop("place_", "part_", "its_part_", "tree_", "first_", "ahead_")


def _forget(spark: SparkSession, path: str) -> None:
    try:
        remove(spark, path)
    except Exception:  # noqa: BLE001  the session may have ended before; the folder is then the cluster's to clean
        pass


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small(table: DataFrame, most: int = BROADCAST_BYTES) -> bool:
    """Whether a table that ``durable`` wrote may be broadcast, by the bytes of its files."""
    where = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table.scratch)
    return where.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).getContentSummary(where).getLength() <= most


def maybe_broadcast(table: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """A table that ``durable`` wrote, with a broadcast hint only if it is small; a shuffle join is the other way."""
    return F.broadcast(table) if small(table, most) else table


def plain(df: DataFrame, *columns: str) -> DataFrame:
    """Only the columns an operator reads, so that no further column of the input can clash with its own."""
    return df.select(*[F.col(f"`{c}`") for c in columns])


def raw(column: pa.Array | pa.ChunkedArray) -> list[bytes | None]:
    """A string column as bytes objects, without decoding."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


def hashed(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads all bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def rolling(h: np.ndarray, k: int) -> np.ndarray:
    """Polynomial hash of each ``k`` consecutive entries, by doubling; empty if there are fewer."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, done = None, 0  # hash of the first `done` entries from each place
    power, width, bits = h, 1, k
    while bits:
        if bits & 1:
            if out is None:
                out = power
            else:
                scale = np.uint64(pow(BASE, width, 1 << 64))
                m = len(h) - done - width + 1
                out = out[:m] * scale + power[done : done + m]
            done += width
        bits >>= 1
        if bits:
            scale = np.uint64(pow(BASE, width, 1 << 64))
            power = power[: len(power) - width] * scale + power[width:]
            width *= 2
    return mixed(out[:n])


def signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


def column_batches(it: Iterable[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    """Each batch as a tuple of columns."""
    for batch in it:
        if batch.num_rows:
            yield tuple(batch.column(batch.schema.get_field_index(n)) for n in names)


def crc_remainder(doc_id: str, n: int):
    """crc32 of the id written as text, modulo ``n``; null ids give null."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(n))


def squeezed(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) -> (doc_id, packed): texts compressed for a shuffle or a table."""
    schema = pa.schema([("doc_id", pa.int64()), ("packed", pa.binary())])
    pack = zstandard.ZstdCompressor(level=1).compress
    for ids, texts in column_batches(it, "doc_id", "text"):
        yield pa.RecordBatch.from_arrays([ids, pa.array([None if t is None else pack(t) for t in raw(texts)], pa.binary())], schema=schema)


def unsqueezed(packed: bytes | None) -> bytes:
    return zstandard.ZstdDecompressor().decompress(packed) if packed is not None else b""
