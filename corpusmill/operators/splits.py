"""Samples and splits that any engine can repeat: rows are ranked by md5 of their key and a seed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusmill.operators.windows import contiguous_slice, global_rank


def order_key(key: str, seed: str) -> Column:
    return F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")).cast("binary"))


def fraction(key: str, seed: str) -> Column:
    """A number in [0, 1) from the key's hash."""
    return F.conv(F.substring(order_key(key, seed), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def sample(df: DataFrame, key: str, n: int, seed: str = "0") -> DataFrame:
    """n rows without replacement."""
    return df.orderBy(order_key(key, seed), key).limit(n)


def ratio_split(df: DataFrame, key: str, ratios: dict[str, float], seed: str = "0", name: str = "split") -> DataFrame:
    """Exact sizes floor(ratio * n) in hash order; the remainder is dropped."""
    ranked = global_rank(df.withColumn("_k", order_key(key, seed)), ["_k", key], "_rank").drop("_k")
    n = df.count()
    edge, out = 0, F.lit(None).cast("string")
    for split, ratio in ratios.items():
        size = int(ratio * n)
        out = F.when((F.col("_rank") >= edge) & (F.col("_rank") < edge + size), split).otherwise(out)
        edge += size
    return ranked.withColumn(name, out).filter(F.col(name).isNotNull()).drop("_rank")


def hash_split(df: DataFrame, key: str, test: float = 0.33, seed: str = "9") -> DataFrame:
    """train and test by the key's hash: no shuffle, sizes are near the share."""
    return df.withColumn("split", F.when(fraction(key, seed) < test, "test").otherwise("train"))


def meeting_split(df: DataFrame, group: str, order: list[str], duration: str, meetings: int, seed: str = "0", seconds: float = 300.0) -> DataFrame:
    """dev, test or train for each row: of 2 * ``meetings`` meetings drawn by hash, the first half gives ``seconds`` of
    running speech each to dev, the second half to test; all else is train."""
    totals = df.groupBy(group).agg(F.sum(duration).alias("_total"))
    drawn = totals.orderBy(order_key(group, seed), group).limit(2 * meetings)
    drawn = drawn.withColumn("_r", F.row_number().over(Window.orderBy(order_key(group, seed), group)))
    # a start that leaves room for the slice, from the hash
    drawn = drawn.withColumn("_start", fraction(group, f"{seed}:start") * F.greatest(F.col("_total") - seconds, F.lit(0.0)))
    rows = df.join(F.broadcast(drawn.withColumnRenamed(group, "_g")), F.col(group) == F.col("_g"), "left")
    chosen = contiguous_slice(rows, group, order, duration, F.coalesce("_start", F.lit(0.0)), F.lit(seconds))
    part = F.when(F.col("selected") & (F.col("_r") <= meetings), "dev").when(F.col("selected") & F.col("_r").isNotNull(), "test").otherwise("train")
    return chosen.withColumn("split", part).drop("_g", "_total", "_r", "_start", "selected", "index", "offset")


def skip_groups(df: DataFrame, group: str, k: int) -> DataFrame:
    """Without the first k groups by name."""
    first = df.select(F.col(group).alias("_g")).distinct().orderBy("_g").limit(k)
    return df.join(first, F.col(group) == F.col("_g"), "left_anti")


def triplets(df: DataFrame, key: str, speaker: str, n: int, seed: str = "0") -> DataFrame:
    """anchor, positive (same speaker) and negative (another speaker) keys: n triplets drawn by hash.

    The next row of the speaker in hash order is the positive. The negative is the row half a table further on in an order
    over all rows, or of the rows after that the first of another speaker among 16; where one speaker holds all of these, it
    is the first row of all that is another speaker's. So an anchor is lost only if there is no other speaker.
    """
    ranked = global_rank(df.select(key, speaker).withColumn("_k", order_key(key, seed)), ["_k", key], "_i").drop("_k")
    own = Window.partitionBy(speaker).orderBy("_i")
    anchors = ranked.withColumn("positive", F.lead(key).over(own)).filter("positive is not null").orderBy("_i").limit(n)
    total = ranked.count()
    tries = anchors.withColumn("_try", F.explode(F.array(*[F.pmod(F.col("_i") + total // 2 + j, F.lit(max(total, 1))) for j in range(16)]))).withColumn("_no", F.pmod(F.col("_try") - F.col("_i") - total // 2, F.lit(max(total, 1))))
    other = ranked.select(F.col("_i").alias("_try"), F.col(key).alias("_found"), F.col(speaker).alias("_other"))
    near = tries.join(other, "_try").filter(F.col("_other") != F.col(speaker)).groupBy(F.col(key).alias("_anchor")).agg(F.min_by("_found", "_no").alias("_near"))
    # the first row of all, and the first of another speaker than that one's: one of them suits any anchor
    first = ranked.agg(F.min(F.struct("_i", key, speaker)).alias("a"))
    second = ranked.join(F.broadcast(first), F.col(speaker) != F.col(f"a.{speaker}")).agg(F.min(F.struct("_i", key, speaker)).alias("b"))
    rows = anchors.join(near, F.col(key) == F.col("_anchor"), "left").crossJoin(F.broadcast(first)).crossJoin(F.broadcast(second))  # one row each
    far = F.when(F.col(f"a.{speaker}") != F.col(speaker), F.col(f"a.{key}")).otherwise(F.col(f"b.{key}"))
    found = rows.select(F.col(key).alias("anchor"), "positive", F.coalesce("_near", far).alias("negative")).filter("negative is not null")
    return found


def cropped(waves: Column) -> Column:
    """Arrays cut to the length of the shortest."""
    n = F.array_min(F.transform(waves, F.size))
    return F.transform(waves, lambda w: F.slice(w, F.lit(1), n))
