"""The ordered operators on streams: sampling, once-only hand-offs, expiry, and positions with keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def sample_first(stream: DataFrame, by: str, at: str, width: str, late: str, value: str) -> DataFrame:
    """The first sample of each tumbling window; later than the watermark counts nothing."""
    w = stream.withWatermark(at, late).groupBy(F.col(by), F.window(at, width))
    return w.agg(F.min_by(value, at).alias(value), F.min(at).alias("at")).select(by, F.col("window.start").alias("slot"), "at", value)


def once(stream: DataFrame, key: str, at: str, late: str) -> DataFrame:
    """Every hand-off once, as long as its repeats come within the watermark."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def sessions(stream: DataFrame, by: str, at: str, gap: str, late: str) -> DataFrame:
    """Stretches without a pause longer than ``gap``: (by, start, end, n)."""
    g = stream.withWatermark(at, late).groupBy(F.col(by), F.session_window(at, gap))
    return g.agg(F.count("*").alias("n")).select(by, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def tracked(stream: DataFrame, by: str, order: str, shift: str) -> DataFrame:
    """(by, order, position): the running sum of the shifts per key, kept as state between batches.

    A null shift is predicted by the one before. Within a batch a key's rows are taken in order; state is two numbers.
    """
    kinds = {c: stream.schema[c].dataType.simpleString() for c in (by, order)}

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        at, last = state.get if state.exists else (0.0, 0.0)
        rows = pd.concat(list(frames)).sort_values(order)
        out = []
        for s in rows[shift]:
            last = last if pd.isna(s) else float(s)
            at += last
            out.append(at)
        state.update((at, last))
        yield pd.DataFrame({by: key[0], order: rows[order].values, "position": out})

    return stream.groupBy(by).applyInPandasWithState(
        run, f"{by} {kinds[by]}, {order} {kinds[order]}, position double", "at double, last double", "append", GroupStateTimeout.NoTimeout
    )


class _Kept(StatefulProcessor):
    """The last write of a slot, until it is older than ``age`` milliseconds; see ``expired``."""

    def __init__(self, slot: str, age: int):
        self.slot, self.age = slot, age

    def init(self, handle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at long, writes long")

    def _gone(self, key: tuple, rows: list[tuple[int, int, str]]) -> pd.DataFrame:
        at, writes, how = zip(*rows)
        return pd.DataFrame({self.slot: [key[0]] * len(rows), "at": pd.to_datetime(list(at), unit="us"), "writes": writes, "how": how})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # Every call of the state is a way to the JVM and back, so a batch's writes of a slot read and set it once.
        held = self.last.get()
        before, writes = held or (None, 0)
        gone = []
        for at in sorted(t for r in rows for t in r["at"].tolist()):
            if before is not None and at - before > 1000 * self.age:
                gone.append((before, writes, "write"))
                writes = 0
            # A row that came late but in time: the newer write stays.
            before, writes = at if before is None else max(at, before), writes + 1
        if gone:
            yield self._gone(key, gone)
        self.last.update((before, writes))
        if held:
            self.handle.deleteTimer(held[0] // 1000 + self.age)
        self.handle.registerTimer(before // 1000 + self.age)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = self.last.get()
        if held:
            yield self._gone(key, [(*held, "age")])
            self.last.clear()

    def close(self) -> None:
        pass


#: The state store that keyed state with timers needs.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def expired(stream: DataFrame, slot: str, at: str, days: int, late: str) -> DataFrame:
    """(slot, at, writes, how): what a store of one image a slot drops: the time of the last write, how many writes there
    were since the slot was empty, and whether the sweep of a later ``write`` or its ``age`` was the cause.

    A slot's state is two numbers and goes ``days`` after its last write: when the watermark passes that, or when a later
    write of a batch finds it so old. Rows later than ``late`` count nothing. The session's state store must be
    ``STATE_STORE``.
    """
    kind = stream.schema[slot].dataType.simpleString()
    rows = stream.select(slot, F.col(at).cast("timestamp").alias("ts")).withWatermark("ts", late)
    keyed = rows.select(slot, "ts", F.unix_micros("ts").alias("at")).groupBy(slot)
    return keyed.transformWithStateInPandas(_Kept(slot, days * 86_400_000), f"{slot} {kind}, at timestamp, writes long, how string", "Append", "EventTime")


def drain(df: DataFrame, path: str, checkpoint: str, mode: str = "append"):
    """Runs a stream over what is there now, into Parquet, and ends; the query, for its progress."""
    q = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return q
