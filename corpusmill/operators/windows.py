"""Ordered computations: running offsets, gaps, islands, threshold buckets, ranks.

Windows are partitioned by a meeting, a wave file or another natural group; ``global_rank`` numbers a whole table without
putting it in one task.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from corpusmill.sources.scratch import checkpointed


def global_rank(df: DataFrame, order: list[str], name: str = "rank", start: int = 0) -> DataFrame:
    """Rows numbered from ``start`` in the order given; ties are broken by the whole row's hash.

    Rows are bucketed by range, counted by bucket, and numbered within buckets. Only bucket counts (some hundreds of rows)
    pass through one task.
    """
    keys = [F.col(c) for c in order] + [F.xxhash64(*df.columns)]
    placed = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_place", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_place", 33))
    placed = checkpointed(placed)  # partition bounds are drawn by sampling: count and number one and the same layout
    counts = placed.groupBy("_part").agg(F.count("*").alias("_n"), F.min("_place").alias("_first"))
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    return placed.join(F.broadcast(counts), "_part").withColumn(name, F.col("_place") - F.col("_first") + F.col("_before") + start).drop("_place", "_part", "_first", "_before")


def running_offset(df: DataFrame, group: str, order: list[str], duration: str) -> DataFrame:
    """``index`` from 1 and ``offset``: what the group's earlier rows last together."""
    w = Window.partitionBy(group).orderBy(*order)
    return df.withColumn("index", F.row_number().over(w)).withColumn("offset", F.coalesce(F.sum(duration).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))


def contiguous_slice(df: DataFrame, group: str, order: list[str], duration: str, start: Column, limit: Column) -> DataFrame:
    """``selected``: rows that reach beyond ``start`` until those before them last ``limit``; the last may overshoot."""
    rows = running_offset(df, group, order, duration)
    late = rows["offset"] + rows[duration] >= start
    rows = rows.withColumn("_late", late)
    w = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.when(F.col("_late"), F.col(duration))).over(w), F.lit(0))
    return rows.withColumn("selected", F.col("_late") & (before < limit)).drop("_late")


def gaps(df: DataFrame, group: str, order: list[str], start: str, end: str, first: Column, last: Column) -> DataFrame:
    """``gap_before`` and ``gap_after`` each row; the group's edges are ``first`` and ``last``."""
    w = Window.partitionBy(group).orderBy(*order)
    before = F.col(start) - F.coalesce(F.lag(end).over(w), first)
    return df.withColumn("gap_before", before).withColumn("gap_after", F.coalesce(F.lead(start).over(w), last) - F.col(end))


def padded_chunks(df: DataFrame, start: str, end: str, most: float = 1.0) -> DataFrame:
    """``pad_start`` and ``pad_end``: chunks grow by half of each gap, ``most`` at the most."""
    half = lambda gap: F.least(F.col(gap) / 2, F.lit(most))
    return df.withColumn("pad_start", F.round(F.col(start) - half("gap_before"), 2)).withColumn("pad_end", F.round(F.col(end) + half("gap_after"), 2))


def silences(df: DataFrame, group: str, order: list[str], start: str, end: str, last: Column) -> DataFrame:
    """The complement of the spans in each group: start and end of every silence that has a length."""
    w = Window.partitionBy(group).orderBy(*order)
    rows = df.withColumn("_from", F.coalesce(F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("_last", F.lead(start).over(w).isNull())
    between = rows.select(group, F.col("_from").alias("start"), F.col(start).alias("end"))
    tail = df.groupBy(group).agg(F.max(end).alias("start"), F.max(last).alias("end"))
    return between.unionByName(tail).filter("end > start")


def islands(df: DataFrame, group: str, order: list[str], active: Column) -> DataFrame:
    """Runs of equal activity: group, island (from 1), active, n, first and last order value."""
    w = Window.partitionBy(group).orderBy(*order)
    rows = df.withColumn("active", active)
    rows = rows.withColumn("_new", F.coalesce((F.col("active") != F.lag("active").over(w)).cast("int"), F.lit(1)))
    rows = rows.withColumn("island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(group, "island").agg(F.first("active").alias("active"), F.count("*").alias("n"), F.min(order[0]).alias("first"), F.max(order[0]).alias("last"))


def threshold_buckets(df: DataFrame, group: str, order: list[str], duration: str, limit: float) -> DataFrame:
    """``bucket`` from 1: durations add up until their sum is over ``limit``, and the next row begins anew.

    A sum that resets is no window function. Rows are sorted within their group and read once, batch by batch, with the
    running sum alone in memory, however many rows a group has.
    """

    def run(it):
        last, total, bucket = None, 0.0, 1
        for batch in it:
            out = []
            for key, d in zip(batch.column("_group").to_pylist(), batch.column("_d").to_pylist(), strict=True):
                if last is None or key != last[0]:
                    last, total, bucket = (key,), 0.0, 1
                out.append(bucket)
                total += d or 0.0
                if total > limit:
                    total, bucket = 0.0, bucket + 1
            keep = [i for i, f in enumerate(batch.schema) if f.name not in ("_group", "_d")]
            columns = [batch.column(i) for i in keep] + [pa.array(out, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=[batch.schema.names[i] for i in keep] + ["bucket"])

    rows = df.withColumn("_group", F.col(group)).withColumn("_d", F.col(duration).cast("double"))
    sorted_rows = rows.repartition("_group").sortWithinPartitions("_group", *order)
    return sorted_rows.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField("bucket", T.IntegerType())]))


def minimum_spans(df: DataFrame, group: str, order: list[str], start: str, end: str, total: Column, least: int = 8000) -> DataFrame:
    """``span_start`` and ``span_end``: short spans grow to ``least`` samples, the last one backwards, within the recording."""
    w = Window.partitionBy(group).orderBy(*order)
    rows = df.withColumn("_final", F.lead(start).over(w).isNull())
    short = F.col(end) - F.col(start) < least
    begin = F.when(short & F.col("_final"), F.greatest(F.col(end) - least, F.lit(0))).otherwise(F.greatest(F.col(start), F.lit(0)))
    finish = F.when(short & ~F.col("_final"), F.col(start) + least).otherwise(F.col(end))
    return rows.withColumn("span_start", begin).withColumn("span_end", F.least(finish, total)).drop("_final")


def first_seen(df: DataFrame, group: str, order: list[str], value: str) -> DataFrame:
    """Distinct values of each group in order of first appearance; a value's least place is found before values are gathered."""
    firsts = df.groupBy(group, F.col(value).alias("_v")).agg(F.min(F.struct(*order)).alias("_at"))
    items = F.sort_array(F.collect_list(F.struct("_at", "_v")))
    return firsts.groupBy(group).agg(F.transform(items, lambda x: x["_v"]).alias("values"))


def numbered_speakers(df: DataFrame, group: str, bucket: str, speaker: str) -> Column:
    """meeting_bucket_speaker, the last two with two digits."""
    two = lambda c: F.when(F.length(F.col(c).cast("string")) < 2, F.lpad(F.col(c).cast("string"), 2, "0")).otherwise(F.col(c).cast("string"))
    return F.concat_ws("_", F.col(group).cast("string"), two(bucket), two(speaker))


def next_word_pairs(df: DataFrame, key: str, words: Column) -> DataFrame:
    """key, pos, word and the word after it."""
    pairs = F.zip_with(words, F.concat(F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), F.array(F.lit(None).cast("string"))), lambda a, b: F.struct(a.alias("word"), b.alias("next")))
    return df.select(key, F.posexplode(pairs).alias("pos", "p")).select(key, "pos", "p.word", "p.next").filter("next is not null")


#: Words whose pairs are counted at once.
PAIR_WORDS = 2_000_000


def next_word_counts(df: DataFrame, text: Column) -> DataFrame:
    """word, next, n: how often a word of a text stands before another. Single spaces part words; empty ones are left out.

    Pairs are counted in the task, where words are numbers, before they meet.
    """
    counted = df.select(text.alias("text")).mapInArrow(_counted_pairs, "word string, next string, n long")
    return counted.groupBy("word", "next").agg(F.sum("n").alias("n"))


def _counted_pairs(it):
    held, size = [], 0
    for batch in it:
        words = pc.split_pattern(batch.column(0), " ")
        flat, text = words.flatten(), pc.list_parent_indices(words)
        there = pc.not_equal(flat, "")
        held.append((flat.filter(there), text.filter(there).to_numpy()))
        size += len(held[-1][0])
        if size >= PAIR_WORDS:
            yield from _pairs(held)
            held, size = [], 0
    if size:
        yield from _pairs(held)


def _pairs(held: list[tuple[pa.Array, np.ndarray]]):
    """Counts of the pairs in some batches of (words, the text of each)."""
    coded = pa.chunked_array([words for words, _ in held]).combine_chunks().dictionary_encode()
    code, n = coded.indices.to_numpy().astype(np.int64), len(coded.dictionary)
    inside = np.concatenate([np.r_[text[1:] == text[:-1], False] if len(text) else np.zeros(0, bool) for _, text in held])
    at = np.flatnonzero(inside)
    pairs, times = np.unique(code[at] * n + code[at + 1], return_counts=True)
    for i in range(0, len(pairs), 100_000):
        some = slice(i, i + 100_000)
        first, then = (coded.dictionary.take(pa.array(x)) for x in (pairs[some] // n, pairs[some] % n))
        yield pa.RecordBatch.from_arrays([first, then, pa.array(times[some], pa.int64())], names=["word", "next", "n"])


def batches(df: DataFrame, position: str, total: int, parts: int) -> DataFrame:
    """``part`` and ``step`` of a token stream dealt into equal parts; the remainder is dropped."""
    size = total // parts
    return df.filter(F.col(position) < size * parts).withColumn("part", F.floor(F.col(position) / size)).withColumn("step", F.col(position) % size)


def frames(wave: Column, size: int = 40, hop: int = 3) -> Column:
    """Overlapping windows of an array."""
    return F.when(F.size(wave) >= size, F.transform(F.sequence(F.lit(0), F.size(wave) - size, F.lit(hop)), lambda i: F.slice(wave, i + 1, F.lit(size)))).otherwise(F.array())


def _smooth(x: np.ndarray, sigma: float) -> np.ndarray:
    reach = int(4 * sigma + 0.5)
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    return np.convolve(np.pad(x, reach, mode="reflect") if len(x) > reach else np.pad(x, reach, mode="edge"), kernel / kernel.sum(), mode="valid")


def _framed(x: np.ndarray, size: int, hop: int) -> np.ndarray:
    """Means of ``size`` entries, ``hop`` apart; one frame, if short, for fewer entries. Sums along the array, not a frame each."""
    starts = np.arange(0, max(1, len(x) - size + 1), hop)
    total = np.concatenate([[0.0], np.cumsum(x, dtype=np.float64)])
    ends = np.minimum(starts + size, len(x))
    return (total[ends] - total[starts]) / (ends - starts)


def _zero_crossing(size: int, hop: int):
    def one(wave):
        x = np.asarray(wave, np.float64)
        rate = _smooth(_framed(np.abs(np.diff(np.signbit(x).astype(np.int8), prepend=0)), size, hop), 3.0)
        return (rate < rate.mean() - 1e-9).tolist()  # equal rates are all silence, whatever their rounding

    return lambda waves: pd.Series([None if w is None or len(w) == 0 else one(w) for w in waves])


def zero_crossing_activity(wave: Column, size: int = 512, hop: int = 128) -> Column:
    """Whether each frame (of ``size`` samples, ``hop`` apart) is speech: smoothed zero-crossing rate below its mean."""
    return F.pandas_udf(_zero_crossing(size, hop), "array<boolean>")(wave)


def _sound_spans(hop: int, below: float):
    def one(wave, rate):
        x = np.asarray(wave, np.float64)
        power = np.array([np.mean(x[i : i + 2 * hop] ** 2) for i in range(0, len(x), hop)])
        loud = power > power.max() * 10 ** (-below / 10)
        edges = np.flatnonzero(np.diff(np.r_[0, loud.astype(np.int8), 0])).reshape(-1, 2) * hop
        spans: list[list[int]] = []
        for a, b in edges.tolist():
            if spans and a - spans[-1][1] < 0.2 * rate:
                spans[-1][1] = min(b, len(x))
            else:
                spans.append([a, min(b, len(x))])
        return [{"start": a, "end": b} for a, b in spans]

    return lambda waves, rates: pd.Series([None if w is None or len(w) == 0 or not np.any(w) else one(w, r) for w, r in zip(waves, rates, strict=True)])


def sound_spans(wave: Column, rate: Column, hop: int = 512, below: float = 30.0) -> Column:
    """Sample spans louder than ``below`` dB below the peak, apart by 0.2 s of silence or more."""
    return F.pandas_udf(_sound_spans(hop, below), "array<struct<start:long,end:long>>")(wave, rate)


def silence_reference(wave: Column) -> Column:
    """Five standard deviations of the samples."""
    n = F.size(wave)
    mean = F.aggregate(wave, F.lit(0.0), lambda a, x: a + x) / n
    return 5 * F.sqrt(F.aggregate(wave, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / n)


def floor_count(ratio: float, n: int) -> int:
    return math.floor(ratio * n)
