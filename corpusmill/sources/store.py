"""A keyed table that is inserted into and updated in place, and tables of models that are published by version.

Rows lie in ``buckets`` parts by hash of their key. An insert or an update reads and writes the parts of its own keys alone;
what it writes goes to new folders, and counts from the moment a version file names them, which appears by one rename. So a
writer that is killed leaves the last version as it was, readers keep the version they began with, and of two writers of one
version the second fails. A batch of a stream is remembered in the version that it made: run again, it adds nothing.

The version file names a few folders a part, so it is bounded by the number of parts; a part of more than ``FOLDERS`` folders
is written anew by the next insert that touches it.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.sources import sinks
from corpusmill.sources.scratch import checkpointed

BUCKETS = 64
#: Folders of a part, from which on it is written as one.
FOLDERS = 16


class Versions:
    """Version files in a folder, each complete from the moment it is there: it appears by one rename, which replaces nothing."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm_path = spark._jvm.org.apache.hadoop.fs.Path
        self._files = self._jvm_path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        folder = self._jvm_path(f"{self.path}/versions")
        if not self._files.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._files.listStatus(folder)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))

    def _told(self, number: int) -> dict:
        """What a version file says: one small file."""
        return json.loads("\n".join(r["value"] for r in self.spark.read.text(f"{self.path}/versions/{number:012d}.json").collect()))

    def _name(self, number: int, told: dict) -> None:
        """Make version ``number``; fails if there is one already."""
        made, final = self._jvm_path(f"{self.path}/versions/.{uuid.uuid4().hex}"), self._jvm_path(f"{self.path}/versions/{number:012d}.json")
        out = self._files.create(made)
        out.write(json.dumps(told).encode())
        out.close()
        context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._files.getUri(), self.spark._jsc.hadoopConfiguration())
        kind = self.spark._jvm.org.apache.hadoop.fs.Options.Rename
        how = self.spark.sparkContext._gateway.new_array(kind, 1)
        how[0] = kind.NONE  # an existing file is not replaced
        context.rename(made, final, how)

    def _folders(self, told: dict) -> set[str]:
        """The folders below ``data`` that a version names."""
        raise NotImplementedError

    def vacuum(self, keep: int = 2) -> None:
        """Delete all but the last ``keep`` versions, and folders that no version names; not while a writer is at work."""
        found = self.versions()
        for number in found[:-keep]:
            self._files.delete(self._jvm_path(f"{self.path}/versions/{number:012d}.json"), False)
        named = set().union(*(self._folders(self._told(n)) for n in found[-keep:]))
        for status in self._files.listStatus(self._jvm_path(f"{self.path}/data")):
            if status.getPath().getName() not in named:
                self._files.delete(status.getPath(), True)


class Store(Versions):
    """``key`` columns tell rows apart, nulls being equal; a store keeps the key, schema and parts that it began with."""

    def __init__(self, spark: SparkSession, path: str, key: list[str], buckets: int = BUCKETS):
        super().__init__(spark, path)
        self.key, self.buckets = key, buckets

    def _version(self, number: int | None = None) -> dict:
        found = self.versions()
        if not found:
            return {"number": 0, "schema": None, "parts": {}, "batches": {}}
        number = found[-1] if number is None else number
        told = self._told(number)
        if told["key"] != self.key or told["buckets"] != self.buckets:
            raise ValueError(f"the store has key {told['key']} and {told['buckets']} parts")
        return told | {"number": number}

    def _commit(self, last: dict, schema: T.StructType, parts: dict, batches: dict) -> None:
        self._name(last["number"] + 1, {"key": self.key, "buckets": self.buckets, "schema": schema.jsonValue(), "parts": parts, "batches": batches})

    def _folders(self, told: dict) -> set[str]:
        return {f for folders in told["parts"].values() for f in folders}

    # rows

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")

    def read(self, version: int | None = None, buckets: list[int] | None = None) -> DataFrame:
        """The rows of a version, the last one by default; of some parts alone, if they are named."""
        told = self._version(version)
        if told["schema"] is None:
            raise ValueError(f"no version of a store in {self.path}")
        return self._rows(told, buckets)

    def _rows(self, told: dict, buckets: list[int] | None = None) -> DataFrame:
        schema = T.StructType.fromJson(told["schema"])
        folders = [f"{self.path}/data/{f}/bucket_={b}" for b, found in told["parts"].items() for f in found if buckets is None or int(b) in buckets]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def _touched(self, rows: DataFrame) -> list[int]:
        return [r["b"] for r in rows.select(self._bucket().alias("b")).distinct().collect()]  # at most as many as there are parts

    def _write(self, rows: DataFrame) -> tuple[str, list[str]]:
        """A new folder with the rows, and the parts in it."""
        name = uuid.uuid4().hex
        rows.withColumn("bucket_", self._bucket()).repartition("bucket_").write.partitionBy("bucket_").parquet(f"{self.path}/data/{name}")
        found = [s.getPath().getName() for s in self._files.listStatus(self._jvm_path(f"{self.path}/data/{name}"))]
        return name, [n.removeprefix("bucket_=") for n in found if n.startswith("bucket_=")]

    def insert(self, new: DataFrame, stream: str | None = None, batch: int = 0) -> None:
        """Rows whose key is not there; of rows with one key among the new, one. A batch that ``stream`` has put in is passed over."""
        last = self._version()
        if stream is not None and last["batches"].get(stream, -1) >= batch:
            return
        new = checkpointed(new)
        schema = new.schema if last["schema"] is None else T.StructType.fromJson(last["schema"])
        if [(f.name, f.dataType) for f in schema] != [(f.name, f.dataType) for f in new.schema]:
            raise ValueError(f"the store has columns {schema.simpleString()}")
        touched = self._touched(new)
        full = [b for b in touched if len(last["parts"].get(str(b), [])) >= FOLDERS]
        told = last | {"schema": schema.jsonValue()}
        fresh = sinks.missing_rows(new, self._rows(told, touched), self.key)
        if full:
            fresh = fresh.unionByName(self._rows(told, full))
        name, parts = self._write(fresh)
        kept = {b: f for b, f in last["parts"].items() if int(b) not in full}
        batches = last["batches"] | ({stream: batch} if stream is not None else {})
        self._commit(last, schema, kept | {b: [*kept.get(b, []), name] for b in parts}, batches)

    def update(self, changes: DataFrame, columns: list[str]) -> None:
        """Rows whose key is in ``changes`` get its values of ``columns``; a null there leaves a value as it is."""
        last = self._version()
        changes = checkpointed(changes.select(*self.key, *columns).dropDuplicates(self.key))
        touched = self._touched(changes)
        rows = self._rows(last, touched).alias("r")
        same = F.lit(True)
        for k in self.key:
            same &= F.col(f"r.`{k}`").eqNullSafe(F.col(f"c.`{k}`"))
        joined = rows.join(changes.alias("c"), same, "left")
        fields = T.StructType.fromJson(last["schema"])
        out = [F.coalesce(F.col(f"c.`{f.name}`").cast(f.dataType), F.col(f"r.`{f.name}`")).alias(f.name) if f.name in columns else F.col(f"r.`{f.name}`") for f in fields]
        name, parts = self._write(joined.select(*out))
        kept = {b: f for b, f in last["parts"].items() if int(b) not in touched}
        self._commit(last, fields, kept | {b: [name] for b in parts}, last["batches"])

    def insert_stream(self, df: DataFrame, name: str, checkpoint: str):
        """A query that inserts each micro-batch of ``df`` once, also if it runs again after a failure."""
        return df.writeStream.foreachBatch(lambda rows, i: self.insert(rows, name, i)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class Models(Versions):
    """What is learnt or computed once and used again, as named tables: a classifier, language models, a map of clusters, scores.

    A version has the tables' schemas, row counts and content hashes, and the parameters that they were made with. Loading
    refuses other parameters or columns than are asked for, and on wish checks the content; a reader that holds a version
    keeps it while another is published.
    """

    def publish(self, tables: dict[str, DataFrame], **parameters) -> int:
        """The number of the new version."""
        folder, told = uuid.uuid4().hex, {}
        for name, table in tables.items():
            table.write.parquet(f"{self.path}/data/{folder}/{name}")
            told[name] = {"schema": table.schema.jsonValue()} | self._content(f"{self.path}/data/{folder}/{name}", table.schema)
        number = (self.versions() or [0])[-1] + 1
        self._name(number, {"folder": folder, "tables": told, "parameters": parameters})
        return number

    def _content(self, path: str, schema: T.StructType) -> dict:
        """Rows and a hash of them in whatever order; repeated rows count."""
        rows = self.spark.read.schema(schema).parquet(path)
        found = rows.select(F.xxhash64(F.to_json(F.struct(*[F.col(f"`{c}`") for c in schema.names]))).alias("h")).agg(F.count("*").alias("n"), F.sum(F.pmod("h", F.lit(1 << 40))).alias("s"), F.bit_xor("h").alias("x")).first()
        return {"rows": found["n"], "hash": f"{found['s'] or 0}:{found['x'] or 0}"}

    def load(self, version: int | None = None, columns: dict[str, list[str]] | None = None, check: bool = False, **parameters) -> dict[str, DataFrame]:
        """The tables of a version, the last one by default."""
        found = self.versions()
        if not found:
            raise ValueError(f"nothing is published in {self.path}")
        told = self._told(found[-1] if version is None else version)
        for name, value in parameters.items():
            if told["parameters"].get(name) != value:
                raise ValueError(f"made with {name} {told['parameters'].get(name)!r}, not {value!r}")
        out = {}
        for name, table in told["tables"].items():
            schema, path = T.StructType.fromJson(table["schema"]), f"{self.path}/data/{told['folder']}/{name}"
            if columns and name in columns and schema.names != columns[name]:
                raise ValueError(f"{name} has columns {schema.names}")
            if check and self._content(path, schema) != {k: table[k] for k in ("rows", "hash")}:
                raise ValueError(f"{name} is not what was published")
            out[name] = self.spark.read.schema(schema).parquet(path)
        if columns and set(columns) - set(out):
            raise ValueError(f"no table {sorted(set(columns) - set(out))}")
        return out

    def _folders(self, told: dict) -> set[str]:
        return {told["folder"]}
