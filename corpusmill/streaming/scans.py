"""Structured Streaming forms of the sequential scans. These are additions: what they extend are batch scans.

With a ``time`` column rows may come in any order within the watermark's delay: a row is held, in a list that the state
store keeps on disk, until the watermark has passed its time, and is then given out in order, with the value that the batch
operator gives it. Rows that come later than that are left out, as in every watermarked aggregation.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from corpusmill.sources.sinks import insert_if_absent


def _stateful(df: DataFrame, group: str, order: str, duration: str, name: str, step) -> DataFrame:
    """A running value for each row of a group; the state is (running sum, count).

    Rows must come in order from trigger to trigger; those of one group and trigger are held at once and sorted.
    """
    kinds = dict(df.dtypes)

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        total, number = state.get if state.exists else (0.0, 1)
        # a group's rows of one trigger may come in several frames, in any order: they are sorted together
        for pdf in [pd.concat(list(frames)).sort_values(order, kind="stable")]:
            out = []
            for d in pdf[duration]:
                value, total, number = step(float(d), total, number)
                out.append(value)
            yield pd.DataFrame({group: pdf[group], order: pdf[order], duration: pdf[duration], name: out})
        state.update((total, number))

    schema = f"{group} {kinds[group]}, {order} {kinds[order]}, {duration} {kinds[duration]}, {name} double"
    return df.select(group, order, duration).groupBy(group).applyInPandasWithState(run, schema, "total double, number long", "append", GroupStateTimeout.NoTimeout)


class _Held(StatefulProcessor):
    """Rows of a group, held until the watermark has passed them, with a running (sum, count) over those given out."""

    def __init__(self, step, order: str, names: list[str], kinds: dict[str, str]):
        self.step, self.order, self.names, self.kinds = step, order, names, kinds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", f"at long, place {self.kinds[self.order]}, duration double")
        self.total = handle.getValueState("total", "total double, number long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        least = None
        for pdf in rows:
            self.rows.appendList(list(zip(pdf["at_"].tolist(), pdf[self.order].tolist(), pdf["duration_"].tolist(), strict=True)))
            least = int(pdf["at_"].min()) if least is None else min(least, int(pdf["at_"].min()))
        if least is not None:
            self.handle.registerTimer(least // 1000)
        return iter(())

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        until = timerValues.getCurrentWatermarkInMs() * 1000
        held = list(self.rows.get())
        due, later = sorted(r for r in held if r[0] <= until), [r for r in held if r[0] > until]
        if later:
            self.rows.put(later)
            self.handle.registerTimer(min(r[0] for r in later) // 1000)
        elif held:
            self.rows.clear()
        if due:
            total, number = self.total.get() if self.total.exists() else (0.0, 1)
            out = []
            for _, _, d in due:
                value, total, number = self.step(d or 0.0, total, number)
                out.append(value)
            self.total.update((total, number))
            group, time, order, duration, name = self.names
            stamps = pd.to_datetime([r[0] for r in due], unit="us", utc=True)
            yield pd.DataFrame({group: [key[0]] * len(due), time: stamps, order: [r[1] for r in due], duration: [r[2] for r in due], name: out})

    def close(self) -> None:
        pass


_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _ordered(df: DataFrame, group: str, time: str, order: str, duration: str, name: str, step, late: str) -> DataFrame:
    """A running value for each row of a group, by time and ``order``, whatever the order in which rows come."""
    if df.sparkSession.conf.get(_STORE) != _ROCKS:
        raise ValueError(f"lists of held rows need a state store on disk: set {_STORE} to {_ROCKS}")
    kinds = dict(df.dtypes)
    rows = df.select(group, F.col(time).cast("timestamp").alias(time), order, F.col(duration).cast("double").alias("duration_"))
    rows = rows.withColumn("at_", F.unix_micros(time)).withWatermark(time, late)
    schema = f"{group} {kinds[group]}, {time} timestamp, {order} {kinds[order]}, {duration} double, {name} double"
    held = _Held(step, order, [group, time, order, duration, name], kinds)
    return rows.groupBy(group).transformWithStateInPandas(held, schema, "Append", "EventTime")


def _offset(d: float, total: float, number: int) -> tuple[float, float, int]:
    return total, total + d, number


def _bucket(limit: float):
    def step(d: float, total: float, number: int) -> tuple[float, float, int]:
        over = total + d > limit
        return float(number), 0.0 if over else total + d, number + over

    return step


def running_offset_stream(df: DataFrame, group: str, order: str, duration: str, time: str | None = None, late: str = "10 minutes") -> DataFrame:
    """``offset``: what the group's earlier rows last together, over all batches so far.

    Without ``time`` rows must come in order from trigger to trigger; with it they are put in order by time and ``order``.
    """
    if time:
        return _ordered(df, group, time, order, duration, "offset", _offset, late)
    return _stateful(df, group, order, duration, "offset", _offset)


def threshold_bucket_stream(df: DataFrame, group: str, order: str, duration: str, limit: float, time: str | None = None, late: str = "10 minutes") -> DataFrame:
    """``bucket`` from 1, begun anew after the sum is over ``limit``; ``time`` as for the running offset."""
    if time:
        return _ordered(df, group, time, order, duration, "bucket", _bucket(limit), late)
    return _stateful(df, group, order, duration, "bucket", _bucket(limit))


def silence_chunks(df: DataFrame, group: str, time: str, gap: str, late: str = "10 minutes") -> DataFrame:
    """Chunks parted by silences of ``gap`` or longer; rows later than ``late`` are left out."""
    return df.withWatermark(time, late).groupBy(group, F.session_window(time, gap).alias("w")).agg(F.count("*").alias("n")).select(group, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def insert_stream(df: DataFrame, path: str, key: list[str], checkpoint: str):
    """A query that appends rows whose key is new to a plain folder, whose keys each batch reads; the same batch run twice adds nothing.

    ``sources.store.Store.insert_stream`` reads the parts of a batch's own keys alone.
    """
    return df.writeStream.foreachBatch(lambda batch, _: insert_if_absent(batch, path, key)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
