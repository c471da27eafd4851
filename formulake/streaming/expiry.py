"""Metrics of recent operations that expire by age (survey F13, A22, X12)."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators.validation import operation_metrics

#: The store that timers and maps of state need.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
KEYS = ["operation", "shard"]
#: Neighbouring slots of a row of state; an operation's shard has some of them.
BLOCK_SLOTS = 512
RESULT = "operation string, shard int, edition long, n long, total double, least double, most double"


def recent(rows: DataFrame, time: str, hours: float, now: datetime | None = None) -> DataFrame:
    """The rows of the last ``hours`` before ``now``, by default before the newest row; the bound is a literal, so it reaches the scan."""
    now = now or rows.agg(F.max(time).alias("t")).first()["t"]
    return rows.limit(0) if now is None else rows.filter(F.col(time) > F.lit(now - timedelta(hours=hours)))


def recent_metrics(rows: DataFrame, time: str, operation: str, seconds: str, hours: float, now: datetime | None = None) -> DataFrame:
    """Count, mean and extremes of the run times of each operation in the last ``hours``."""
    return operation_metrics(recent(rows, time, hours, now), operation, seconds)


class Expiring(StatefulProcessor):
    """Sums of an operation's run times by slots of time. A slot goes ``age`` after its end, by a timer on the watermark; rows that would fall into a slot that went are ignored.

    Slots lie in blocks of neighbours, a row of state each, and an operation has
    one timer, for the slot that goes next: when it fires, all that the
    watermark has passed go together and the rest is told once.
    """

    def __init__(self, slot: int, age: int) -> None:
        self.slot, self.age = slot, age

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.blocks = handle.getMapState("blocks", "block long", "start array<long>, n array<long>, total array<double>, least array<double>, most array<double>")
        self.edition = handle.getValueState("edition", "edition long")
        self.timer = handle.getValueState("timer", "at long")

    def _end(self, start: int) -> int:
        """When a slot goes, in milliseconds."""
        return (start + self.slot + self.age) * 1000

    def _told(self, key: tuple, blocks: dict[int, list[tuple]]) -> pd.DataFrame:
        """What the operation has now; a later edition replaces an earlier one."""
        edition = (self.edition.get()[0] if self.edition.exists() else 0) + 1
        self.edition.update((edition,))
        own = [v for block in blocks.values() for v in block]
        made = (*key, edition, sum(v[1] for v in own), sum(v[2] for v in own), min((v[3] for v in own), default=None), max((v[4] for v in own), default=None))
        return pd.DataFrame([made], columns=[c.split()[0] for c in RESULT.split(", ")])

    def _read(self) -> dict[int, list[tuple]]:
        """(start, n, total, least, most) of the slots of each block."""
        return {int(k[0]): list(zip(*(list(c) for c in v), strict=True)) for k, v in self.blocks.iterator()}

    def _write(self, block: int, slots: list[tuple]) -> None:
        if slots:
            start, n, *rest = zip(*slots, strict=True)
            self.blocks.updateValue((block,), ([int(x) for x in start], [int(x) for x in n], *([float(x) for x in c] for c in rest)))
        else:
            self.blocks.removeKey((block,))

    def _wake(self, blocks: dict[int, list[tuple]]) -> None:
        """Sets the timer to the slot that goes next."""
        first = min((self._end(int(v[0])) for block in blocks.values() for v in block), default=None)
        now = self.timer.get()[0] if self.timer.exists() else None
        if first == now:
            return
        if now is not None:
            self.handle.deleteTimer(now)
            self.timer.clear()
        if first is not None:
            self.handle.registerTimer(first)
            self.timer.update((first,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        mark, new = timerValues.getCurrentWatermarkInMs(), {}
        for f in rows:
            for start, *v in f.groupby("start")["seconds"].agg(["size", "sum", "min", "max"]).itertuples():
                if self._end(int(start)) > mark:
                    old = new.get(int(start))
                    new[int(start)] = tuple(v) if old is None else (old[0] + v[0], old[1] + v[1], min(old[2], v[2]), max(old[3], v[3]))
        if not new:
            return
        blocks, touched = self._read(), {}
        for start, v in new.items():
            block = start // (self.slot * BLOCK_SLOTS)
            if block not in touched:
                touched[block] = {int(x[0]): x[1:] for x in blocks.get(block, ())}
            old = touched[block].get(start)
            touched[block][start] = v if old is None else (old[0] + v[0], old[1] + v[1], min(old[2], v[2]), max(old[3], v[3]))
        for block, slots in touched.items():
            blocks[block] = [(start, *v) for start, v in sorted(slots.items())]
            self._write(block, blocks[block])
        self._wake(blocks)
        yield self._told(key, blocks)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        mark, blocks = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs()), self._read()
        self.timer.clear()  # a timer that fired is gone
        for block, slots in [*blocks.items()]:
            left = [v for v in slots if self._end(int(v[0])) > mark]
            if len(left) < len(slots):
                self._write(block, left)
                blocks[block] = left
        self._wake(blocks)
        yield self._told(key, blocks)

    def close(self) -> None:
        pass


def expiring_metrics(events: DataFrame, time: str, operation: str, seconds: str, hours: float, late: str = "10 minutes", slot: int = 60, shards: int = 8) -> DataFrame:
    """A stream of (operation, shard, edition, n, total, least, most): for each operation what its last ``hours`` hold, told anew whenever that changes.

    Time is taken in slots of ``slot`` seconds; a slot counts until ``hours``
    after its end lie before the watermark. Slots are dealt to ``shards``, so a
    frequent operation is not one task; ``newest`` joins them. Rows without a
    time, an operation or a duration are left out.
    """
    start = F.floor(F.unix_timestamp(time) / slot) * slot
    rows = events.withWatermark(time, late).filter(F.col(time).isNotNull() & F.col(operation).isNotNull() & F.col(seconds).isNotNull())
    keyed = rows.select(F.col(operation).cast("string").alias("operation"), F.pmod(F.floor(F.unix_timestamp(time) / slot), F.lit(shards)).cast("int").alias("shard"), start.cast("long").alias("start"), F.col(seconds).cast("double").alias("seconds"), time)
    return keyed.groupBy(*KEYS).transformWithStateInPandas(Expiring(slot, int(hours * 3600)), outputStructType=RESULT, outputMode="Update", timeMode="EventTime")


def follow_metrics(metrics: DataFrame, out: str, checkpoint: str, partitions: int = 32) -> StreamingQuery:
    """Adds what ``expiring_metrics`` tells to the table at ``out``; a repeated batch overwrites its own folder, and state is kept with the checkpoint.

    State has ``partitions`` stores at most, as the first run sets; each is opened in every batch, whether it has operations or not.
    """
    conf = metrics.sparkSession.conf
    own = {"spark.sql.streaming.stateStore.providerClass": STORE, "spark.sql.shuffle.partitions": str(min(partitions, int(conf.get("spark.sql.shuffle.partitions"))))}
    before = {name: conf.get(name) for name in own}
    for name, value in own.items():
        conf.set(name, value)
    try:
        return metrics.writeStream.outputMode("update").foreachBatch(lambda batch, n: batch.write.mode("overwrite").parquet(f"{out}/batch={n}")).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        for name, value in before.items():
            conf.set(name, value)


def newest(told: DataFrame) -> DataFrame:
    """(operation, n, mean, least, most) of the newest editions; operations that have expired are left out."""
    last = told.groupBy(*KEYS).agg(F.max_by(F.struct("n", "total", "least", "most"), "edition").alias("r")).select("operation", "r.*").filter("n > 0")
    mean: Column = F.sum("total") / F.sum("n")
    return last.groupBy("operation").agg(F.sum("n").alias("n"), mean.alias("mean"), F.min("least").alias("least"), F.max("most").alias("most"))
