"""Who speaks when: speakers of the segments of a recording, a meeting, a table or a file, from vectors of the segments.

A segment's vector comes from whatever model made it; here segments are grouped, stretched and clustered. Results number the
speakers of each group from 0, in order of first appearance.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.operators import cluster, windows

#: Speakers that are no speakers, and one who isn't known.
NO_SPEAKER, UNKNOWN = ("BACKGROUND", "COMMENT"), "UNKNOWN"


def recordings(segments: DataFrame, wav: str, key: str, vector: str, kmax: int = 10) -> DataFrame:
    """wav, key, speaker. A recording of one segment has one speaker."""
    found = cluster.cluster_groups(segments, wav, key, vector, kmax)
    return found.select(wav, key, F.col("cluster").alias("speaker"))


def divides(segments: DataFrame, meeting: str, wav: str, order: str, seconds: str, subdivide: float) -> DataFrame:
    """meeting, wav and ``divide`` (divide_1, ...): recordings add up in order until they last longer than ``subdivide``."""
    wavs = segments.groupBy(meeting, wav).agg(F.min(order).alias("_order"), F.first(seconds).alias("_seconds"))
    found = windows.threshold_buckets(wavs, meeting, ["_order", wav], "_seconds", subdivide)
    return found.select(meeting, wav, F.concat(F.lit("divide_"), F.col("bucket").cast("string")).alias("divide"))


def meetings(segments: DataFrame, meeting: str, wav: str, order: str, seconds: str, vector: str, kmax: int = 10, subdivide: float | None = None) -> DataFrame:
    """meeting, divide (null without ``subdivide``), ``order`` and speaker: a meeting's recordings are clustered together, or
    by divides of about ``subdivide`` seconds of recordings. ``order`` tells the segments of a meeting apart."""
    if subdivide is None:
        found = cluster.cluster_groups(segments, meeting, order, vector, kmax)
        return found.select(meeting, F.lit(None).cast("string").alias("divide"), order, F.col("cluster").alias("speaker"))
    parts = divides(segments, meeting, wav, order, seconds, subdivide)
    rows = segments.join(parts, [meeting, wav]).select(F.to_json(F.struct(meeting, "divide")).alias("_part"), meeting, "divide", order, vector)
    found = cluster.cluster_groups(rows, "_part", order, vector, kmax)
    return rows.select("_part", meeting, "divide").distinct().join(found, "_part").select(meeting, "divide", order, F.col("cluster").alias("speaker"))


def tables(lines: DataFrame, table: str, speaker: str, key: str, vector: str, kmax: int = 10, unknown: bool = True) -> DataFrame:
    """table, key, the line's own speaker and the predicted one, without lines of no speaker, and on wish of no known one."""
    out = NO_SPEAKER if unknown else (*NO_SPEAKER, UNKNOWN)
    rows = lines.filter(~F.col(speaker).isin(*out))
    found = cluster.cluster_groups(rows, table, key, vector, kmax).select(F.col(table).alias("_t"), F.col(key).alias("_k"), F.col("cluster").alias("predicted"))
    return rows.join(found, (F.col(table) == F.col("_t")) & (F.col(key) == F.col("_k"))).select(table, key, speaker, "predicted")


def speech(waves: DataFrame, key: str, wave: str, size: int = 512, hop: int = 128) -> DataFrame:
    """key, span (from 0), start and end, in samples: runs of frames with speech, for recordings without any labels."""
    frames = waves.select(key, F.posexplode(windows.zero_crossing_activity(F.col(wave), size, hop)).alias("frame", "active"))
    runs = windows.islands(frames, key, ["frame"], F.col("active")).filter("active")
    number = F.row_number().over(windows.Window.partitionBy(key).orderBy("first")) - 1
    return runs.select(key, number.alias("span"), (F.col("first") * hop).alias("start"), ((F.col("last") + 1) * hop).alias("end"))


def files(waves: DataFrame, key: str, wave: str, embed: Column, kmax: int = 10, size: int = 512, hop: int = 128) -> DataFrame:
    """key, span, start, end and speaker of whole files: speech is found, cut out and given to ``embed``, a column over the
    samples in the column ``samples``."""
    spans = speech(waves, key, wave, size, hop)
    cut = spans.join(waves.select(key, wave), key).withColumn("samples", F.slice(F.col(wave), F.col("start").cast("int") + 1, (F.col("end") - F.col("start")).cast("int")))
    rows = cut.select(key, "span", "start", "end", embed.alias("_v"))
    found = cluster.cluster_groups(rows, key, "span", "_v", kmax)
    return rows.drop("_v").join(found.select(key, "span", F.col("cluster").alias("speaker")), [key, "span"])
