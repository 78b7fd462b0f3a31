"""Filters, joins and set operations with the null rules of the text store."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from corpusmill.sources.scratch import checkpointed

#: A dimension or word list may be broadcast up to this many rows, after they are counted.
BROADCAST_ROWS = 500_000
#: A vocabulary of up to so many words is repeated for each partition.
VOCABULARY_ROWS = 20_000
#: Bytes of parts that are looked for in one pass; an automaton takes about sixty times as much in each worker.
PART_BYTES = 2_000_000


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if a count says that it is small; Spark shuffles it otherwise."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def exclude_below(column: str, least) -> Column:
    """NOT (c < least), where a null is not below: nulls stay."""
    return F.col(column).isNull() | (F.col(column) >= least)


def exclude_equal(column: str, value) -> Column:
    """NOT (c = value); nulls stay."""
    return F.col(column).isNull() | (F.col(column) != value)


def quality_filter(df: DataFrame, low: float, high: float, duration: str, words: str, least_words: int, text: str) -> DataFrame:
    """Rows of a duration in [low, high], not empty in ``text`` and not below ``least_words``; null durations go, null counts stay."""
    return df.filter(F.col(duration).between(low, high) & exclude_equal(text, "") & exclude_below(words, least_words))


def icontains(column: str, part: str) -> Column:
    """Case-insensitive substring; % and _ are plain characters."""
    return F.lower(F.col(column)).contains(part.lower())


def parted(df: DataFrame, ok: Column) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected); a null condition rejects."""
    ok = F.coalesce(ok, F.lit(False))
    return df.filter(ok), df.filter(~ok)


def with_dimension(facts: DataFrame, dimension: DataFrame, key: str, dimension_key: str) -> DataFrame:
    """Left join to a dimension of checked size; facts without one stay."""
    return facts.join(small_side(dimension), F.col(key) == F.col(dimension_key), "left")


def many_to_many(facts: DataFrame, bridge: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """The values that a bridge table gives each fact, as a sorted array; [] without any."""
    lists = bridge.groupBy(F.col(key).alias("_k")).agg(F.array_sort(F.collect_set(value)).alias(name))
    return facts.join(lists, F.col(key) == F.col("_k"), "left").withColumn(name, F.coalesce(name, F.array())).drop("_k")


def absent(new: DataFrame, stored: DataFrame, on: Column | list[str]) -> DataFrame:
    return new.join(stored, on, "left_anti")


def _automaton(parts: list[str]):
    """An automaton that finds all ``parts`` in one pass over a text."""
    import ahocorasick

    found = ahocorasick.Automaton()
    for i, part in enumerate(parts):
        found.add_word(part, i)
    found.make_automaton()
    return found


def _parts_in(shared, column: str, keep: str):
    """Rows of Arrow batches with each part that their text has (``keep`` = "met"), or the rows without any ("rest")."""

    def run(it):
        parts = sorted(shared.value)
        blank = bool(parts) and parts[0] == ""  # an empty part is in every text
        automaton = _automaton(parts[blank:]) if len(parts) > blank else None
        for batch in it:
            rows, found = [], []
            for i, text in enumerate(batch.column(batch.schema.get_field_index(column)).to_pylist()):
                numbers = set() if text is None else {n + blank for _, n in automaton.iter(text)} if automaton else set()
                if blank and text is not None:
                    numbers.add(0)
                if keep == "met":
                    rows += [i] * len(numbers)
                    found += [parts[n] for n in numbers]
                elif not numbers:
                    rows.append(i)
            taken = batch.take(pa.array(rows, pa.int64()))
            if keep == "met":
                yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(found, pa.string())], names=[*taken.schema.names, "_part"])
            else:
                yield taken

    return run


def _part_blocks(parts: DataFrame, part: str, most: int):
    """The different parts in lists of about ``most`` bytes at most, one after the other; each is broadcast while it is used."""
    different = parts.select(F.col(part).alias("_part")).filter("_part is not null").distinct()
    size = different.agg(F.sum(F.octet_length("_part") + 16)).first()[0] or 0
    blocks = max(1, -(-size // most))
    for b in range(blocks):
        block = different.filter(F.pmod(F.xxhash64("_part"), F.lit(blocks)) == b)
        shared = parts.sparkSession.sparkContext.broadcast([r["_part"] for r in block.toLocalIterator()])
        yield shared, blocks


def contains_join(rows: DataFrame, parts: DataFrame, text: str, part: str, most: int = PART_BYTES) -> DataFrame:
    """Rows with each of the ``parts`` that their text contains; null texts and parts meet nothing.

    The parts are made into an automaton, so that a text is read once however many they are. Parts of more than ``most``
    bytes go in blocks, one pass over the rows each; a block's matches are written before the next one is sent.
    """
    schema, out = T.StructType([*rows.schema.fields, T.StructField("_part", T.StringType())]), None
    for shared, blocks in _part_blocks(parts, part, most):
        met = rows.mapInArrow(_parts_in(shared, text, "met"), schema)
        if blocks > 1:
            met = checkpointed(met)
            shared.destroy()
        out = met if out is None else out.unionAll(met)
    return out.join(small_side(parts), F.col("_part") == parts[part]).drop("_part")


def contains_rest(rows: DataFrame, parts: DataFrame, text: str, part: str, most: int = PART_BYTES) -> DataFrame:
    """Rows that contain none of the ``parts``, found in the same way."""
    for shared, blocks in _part_blocks(parts, part, most):
        rows = rows.mapInArrow(_parts_in(shared, text, "rest"), rows.schema)
        if blocks > 1:
            rows = checkpointed(rows)
            shared.destroy()
    return rows


def kept_children(parents: DataFrame, children: DataFrame, key: str, child_key: str, ok: Column, least: int = 2) -> DataFrame:
    """Parents with at least ``least`` accepted children: key, accepted, rejected. A null condition rejects.

    Children are counted before they meet their parents, so that a parent with most of the rows is one row in the join.
    """
    good = F.coalesce(ok, F.lit(False))
    counts = children.groupBy(F.col(child_key).alias("_k")).agg(F.count_if(good).alias("accepted"), F.count_if(~good).alias("rejected")).filter(F.col("accepted") >= least)
    return parents.select(key).join(counts, F.col(key) == F.col("_k")).select(key, "accepted", "rejected")


def with_audio(tables: DataFrame, audio: DataFrame, key: str, audio_key: str) -> tuple[DataFrame, DataFrame]:
    """(tables with the facts of their recording, tables without one): what has no recording is told, not dropped."""
    facts = audio.dropDuplicates([audio_key]).withColumnRenamed(audio_key, "_k")
    met = tables.join(small_side(facts), F.col(key) == F.col("_k"), "left")
    return met.filter("_k is not null").drop("_k"), met.filter("_k is null").select(*[F.col(f"`{c}`") for c in tables.columns])


def occurrence_join(left: DataFrame, right: DataFrame, key: list[str], left_order: list[str], right_order: list[str]) -> DataFrame:
    """The n-th row of a key on the left meets the n-th on the right; each row is used once, and nulls are no key."""
    number = lambda df, order: df.withColumn("occurrence", F.row_number().over(Window.partitionBy(*key).orderBy(*order)))
    return number(left, left_order).join(number(right, right_order), [*key, "occurrence"])


def by_priority(parts: dict[str, DataFrame], name: str) -> DataFrame:
    """Union of tables with their name and priority, in the order given."""
    out = None
    for i, (value, df) in enumerate(parts.items()):
        df = df.withColumn(name, F.lit(value)).withColumn("priority", F.lit(i))
        out = df if out is None else out.unionByName(df)
    return out


def lookup(rows: DataFrame, table: DataFrame, key: str, value: str, default) -> DataFrame:
    """``value`` of a key table, or the default."""
    found = table.select(F.col(key).alias("_k"), F.col(value).alias("_v"))
    return rows.join(found, F.col(key) == F.col("_k"), "left").withColumn(value, F.coalesce("_v", F.lit(default))).drop("_k", "_v")


def counted_children(parents: DataFrame, children: DataFrame, key: str) -> DataFrame:
    """Parents with the number of their children; 0 stays."""
    n = children.groupBy(F.col(key).alias("_k")).agg(F.count("*").alias("n_children"))
    return parents.join(n, F.col(key) == F.col("_k"), "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))).drop("_k")


def membership(words: DataFrame, lists: dict[str, DataFrame], word: str = "word") -> DataFrame:
    """A boolean column for each list: whether the word is in it."""
    for name, known in lists.items():
        flag = known.select(F.col(word).alias("_w")).distinct().withColumn(name, F.lit(True))
        words = words.join(flag, F.col(word) == F.col("_w"), "left").withColumn(name, F.coalesce(name, F.lit(False))).drop("_w")
    return words


def leakage(df: DataFrame, split: str, key: list[str]) -> DataFrame:
    """Keys that occur in more than one split, with the splits."""
    return df.groupBy(*key).agg(F.array_sort(F.collect_set(split)).alias("splits")).filter(F.size("splits") > 1)


def overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)


def unique(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.subtract(b)


def symmetric_unique(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct rows of exactly one of two tables, in one aggregation."""
    both = a.withColumn("_side", F.lit(1)).unionAll(b.withColumn("_side", F.lit(2)))
    return both.groupBy(*a.columns).agg(F.bit_or("_side").alias("_sides")).filter("_sides != 3").drop("_sides")


def held_by_one(df: DataFrame, key: str, group: str) -> DataFrame:
    """Keys that occur in one group alone: of two groups, their symmetric difference in one scan."""
    return df.groupBy(key).agg(F.min(group).alias("_lo"), F.max(group).alias("_hi")).filter("_lo = _hi").select(key)


def either(column: str, *values) -> Column:
    """One of several values: a disjunction, never a union of tables."""
    return F.col(column).isin(*values)


def encoded(df: DataFrame, key: str, words: Column, vocabulary: DataFrame, unknown: int) -> DataFrame:
    """Words as vocabulary numbers in order; those not in it get ``unknown``.

    A vocabulary of up to ``VOCABULARY_ROWS`` goes ahead of the rows of each partition, which take their numbers where they
    lie; with a larger one each word meets its number. Rows of one key are put together by the places of their words.
    """
    known = checkpointed(vocabulary.select("word", "idx"))
    if known.limit(VOCABULARY_ROWS + 1).count() > VOCABULARY_ROWS:
        rows = df.select(key, F.posexplode(words).alias("pos", "word"))
        numbers = rows.join(small_side(known), "word", "left")
        item = F.struct("pos", F.coalesce("idx", F.lit(unknown)).alias("idx"))
        return numbers.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(item)), lambda x: x["idx"]).alias("ids"))
    spark, kind = df.sparkSession, df.schema[key].dataType
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = df.select(F.col(key).alias("key"), words.alias("words"))
    rows = rows.select(F.pmod(F.xxhash64("key"), F.lit(parts)).alias("part"), F.lit(1).alias("kind"), "key", "words", F.lit(None).cast("int").alias("idx")).filter("size(words) > 0")
    ahead = spark.range(parts).crossJoin(known.filter("word is not null"))  # parts and numbers are both bounded
    ahead = ahead.select(F.col("id").alias("part"), F.lit(0).alias("kind"), F.lit(None).cast(kind).alias("key"), F.array("word").alias("words"), F.col("idx").cast("int").alias("idx"))
    dealt = ahead.unionByName(rows).repartition(parts, "part").sortWithinPartitions("part", "kind")
    found = dealt.mapInArrow(_numbering(unknown), T.StructType([T.StructField("key", kind), T.StructField("ids", T.ArrayType(T.IntegerType()))]))
    placed = F.sort_array(F.flatten(F.transform("all", lambda x: F.transform(x, lambda v, i: F.struct(i.alias("pos"), v.alias("idx"))))))
    ids = F.when(F.size("all") == 1, F.col("all")[0]).otherwise(F.transform(placed, lambda x: x["idx"]))
    return found.groupBy("key").agg(F.collect_list("ids").alias("all")).select(F.col("key").alias(key), ids.alias("ids"))


def _numbering(unknown: int):
    """Rows' words by the numbers that came before them in the partition."""

    def run(it):
        words, idx = pa.array([], pa.string()), pa.array([], pa.int32())
        for batch in it:
            own = pc.equal(batch["kind"], 0)
            told, rows = batch.filter(own), batch.filter(pc.invert(own))
            if len(told):
                words, idx = pa.concat_arrays([words, told["words"].flatten()]), pa.concat_arrays([idx, told["idx"]])
                new = pc.equal(pc.index_in(words, words), pa.array(range(len(words)), pa.int32()))
                words, idx = words.filter(new), idx.filter(new)  # several parts may lie in one partition
            if len(rows):
                coded = rows["words"].flatten().dictionary_encode()
                numbers = pc.fill_null(idx.take(pc.index_in(coded.dictionary, words)), unknown)
                ids = pc.fill_null(numbers.take(coded.indices), unknown)
                ends = np.r_[0, np.cumsum(pc.list_value_length(rows["words"]).to_numpy())]
                yield pa.RecordBatch.from_arrays([rows["key"], pa.ListArray.from_arrays(pa.array(ends, pa.int32()), ids)], names=["key", "ids"])

    return run


def display_languages(found: Column, main: Column) -> Column:
    """The list, else the main language, else ''."""
    return F.when(F.size(found) > 0, F.array_join(found, ", ")).otherwise(F.coalesce(main, F.lit("")))
