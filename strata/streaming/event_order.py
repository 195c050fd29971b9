"""Stateful stream operators that see every key's rows in event-time order.

Rows wait in list state until the watermark has passed them; an event-time timer then hands the released rows of the key,
in order, to a fold with the key's carried state. Late rows within the watermark's delay thus take their place, rows
later than that are dropped by Spark, and the result does not depend on how rows are split into micro-batches. A key
has one timer at a time, and its state ends when the fold carries nothing on and no row waits, or when
``expire_after_ms`` have passed since its last row.

A stream that ends (a backfill with ``availableNow``) still holds the rows of the last delay. ``run_closed`` runs it
to its end, then writes one marker row far in the future to a second source and resumes the same checkpoint, so that
the watermark passes every row.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

FAR = "9000-01-01 00:00:00"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

TIMER = T.StructType([T.StructField("at", T.LongType()), T.StructField("idle", T.BooleanType()), T.StructField("last", T.LongType())])
Fold = Callable[[tuple, tuple | None, pd.DataFrame], tuple[pd.DataFrame, tuple | None]]
PACKED = T.StructType([T.StructField("packed", T.BinaryType())])
ManyFold = Callable[[np.ndarray, np.ndarray, list[tuple | None]], tuple[pd.DataFrame, list[tuple | None]]]
BUCKETS = 256  # of keys; a checkpoint belongs to their number


class InEventOrder(StatefulProcessor):
    """``fold(key, carried, rows) -> (output, carried)`` on rows that the watermark has passed, in order.

    ``release`` gives the time (int64 microseconds) at which a row may be folded, from the rows' event times: the event
    time itself, or the end of its time bucket where the fold wants whole buckets. A fold that carries None ends the
    key's state; with ``expire_after_ms`` an idle key's state ends so long after its last row."""

    def __init__(self, fold: Fold, rows: T.StructType, order: list[str], carried: T.StructType | None = None,
                 release: Callable[[np.ndarray], np.ndarray] | None = None, expire_after_ms: int | None = None):
        self.fold, self.rows, self.carried, self.order = fold, rows, carried, order
        self.release = release or (lambda us: us)
        self.expire_after_ms = expire_after_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.rows)
        self.carry = handle.getValueState("carry", self.carried) if self.carried else None
        self.timer = handle.getValueState("timer", TIMER)

    def close(self) -> None:
        pass

    def _due(self, rows: pd.DataFrame) -> np.ndarray:
        """Milliseconds at which the rows may be folded, rounded up."""
        us = rows[self.order[0]].to_numpy().astype("datetime64[us]").astype(np.int64)
        return -(-self.release(us) // 1000)

    def _wake(self, at: int, last: int | None, idle: bool = False) -> None:
        self.handle.registerTimer(at)
        self.timer.update((at, idle, last))

    def _fold(self, key, carried: tuple | None, last: int | None, rows: pd.DataFrame, due: np.ndarray):
        """The fold, begun anew where more than ``expire_after_ms`` lie between rows, however they are split into batches."""
        if self.expire_after_ms is None:
            return self.fold(key, carried, rows)
        before = np.concatenate([[due[0] if last is None else last], due[:-1]])
        anew = np.flatnonzero(due - before > self.expire_after_ms).tolist()
        outs = []
        for a, b in zip([0, *anew], [*anew, len(rows)], strict=True):
            if a in anew:
                carried = None
            if b > a:
                out, carried = self.fold(key, carried, rows[a:b].reset_index(drop=True))
                outs.append(out)
        return pd.concat(outs, ignore_index=True), carried

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for pdf in rows:
            if len(pdf):
                least = int(self._due(pdf).min())
                first = least if first is None else min(first, least)
                self.waiting.appendList(_plain(pdf[self.rows.names]))
        if first is not None:
            at, idle, last = self.timer.get() or (None, True, None)
            if idle or first < at:
                if at is not None:
                    self.handle.deleteTimer(at)
                self._wake(first, last)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        _, idle, last = self.timer.get()
        if idle:
            self.timer.clear()
            self.carry.clear()
            return
        rows = pd.DataFrame(list(self.waiting.get()), columns=self.rows.names).sort_values(self.order, ignore_index=True)
        due = self._due(rows)
        ripe = due <= timerValues.getCurrentWatermarkInMs()
        before = self.carry.get() if self.carry else None
        out, carried = self._fold(tuple(key), before, last, rows[ripe].reset_index(drop=True), due[ripe])
        if carried != before:
            if carried is None:
                self.carry.clear()
            else:
                self.carry.update(carried)
        last = int(due[ripe].max())
        if not ripe.all():
            self.waiting.put(_plain(rows[~ripe]))
            self._wake(int(due[~ripe].min()), last)
        else:
            self.waiting.clear()
            if carried is not None and self.expire_after_ms is not None:
                self._wake(last + self.expire_after_ms, last, idle=True)
            else:
                self.timer.clear()
        yield out


class ManyInEventOrder(StatefulProcessor):
    """As ``InEventOrder``, for many keys of few rows: a state holds a bucket of keys, so that one exchange with the state
    store serves them all, where a state per key costs several exchanges per key.

    Rows and carried values are long numbers. ``columns`` begin with the ``n_keys`` key columns and the event time in
    microseconds; rows are folded in the order of all columns. ``fold(rows, starts, before) -> (output, after)`` gets the
    bucket's released rows as a matrix, where each key's rows start and what each carries (None: nothing)."""

    def __init__(self, fold: ManyFold, columns: list[str], n_keys: int, n_carried: int, expire_after_ms: int | None = None):
        self.fold, self.columns, self.n_keys, self.n_carried = fold, columns, n_keys, n_carried
        self.expire_after_ms = expire_after_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", PACKED)
        self.carry = handle.getValueState("carry", PACKED)
        self.timer = handle.getValueState("timer", TIMER)

    def close(self) -> None:
        pass

    def _due(self, rows: np.ndarray) -> np.ndarray:
        return -(-rows[:, self.n_keys] // 1000)

    def _wake(self, at: int) -> None:
        self.handle.registerTimer(at)
        self.timer.update((at, False, None))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        parts = [pdf[self.columns].to_numpy(dtype=np.int64) for pdf in rows if len(pdf)]
        if parts:
            self.waiting.appendList([(p.tobytes(),) for p in parts])
            first, timer = min(int(self._due(p).min()) for p in parts), self.timer.get()
            if timer is None or first < timer[0]:
                if timer is not None:
                    self.handle.deleteTimer(timer[0])
                self._wake(first)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark, k = timerValues.getCurrentWatermarkInMs(), self.n_keys
        rows = np.concatenate([_unpacked(b, len(self.columns)) for b, in self.waiting.get()] or [np.zeros((0, len(self.columns)), np.int64)])
        ripe = self._due(rows) <= mark
        later, rows = rows[~ripe], rows[ripe]
        rows = rows[np.lexsort(rows.T[::-1])]
        due = self._due(rows)
        packed = self.carry.get()
        width = k + self.n_carried + 1  # the last is the time of the key's last row
        carried = {tuple(c[:k]): c[k:] for c in _unpacked(packed[0], width).tolist()} if packed else {}
        if len(rows):
            apart = (rows[1:, :k] != rows[:-1, :k]).any(axis=1)
            anew = apart if self.expire_after_ms is None else apart | (np.diff(due) > self.expire_after_ms)
            starts = np.flatnonzero(np.append(True, anew))
            before, of = [], [tuple(x) for x in rows[starts, :k].tolist()]
            for i, (at, name) in enumerate(zip(due[starts].tolist(), of, strict=True)):
                had = carried.get(name) if i == 0 or of[i - 1] != name else None  # else idle for too long
                if had is not None and self.expire_after_ms is not None and at - had[-1] > self.expire_after_ms:
                    had = None
                before.append(None if had is None else tuple(had[:-1]))
            out, after = self.fold(rows, starts, before)
            for name, value, last in zip(of, after, due[np.append(starts[1:], len(rows)) - 1].tolist(), strict=True):
                if value is None:
                    carried.pop(name, None)
                else:
                    carried[name] = [*value, last]
            yield out
        if self.expire_after_ms is not None:
            carried = {name: c for name, c in carried.items() if c[-1] + self.expire_after_ms >= mark}
        if carried:
            self.carry.update((np.array([[*name, *c] for name, c in carried.items()], dtype=np.int64).tobytes(),))
        elif packed:
            self.carry.clear()
        wakes = [int(self._due(later).min())] if len(later) else []
        if carried and self.expire_after_ms is not None:
            wakes.append(min(c[-1] for c in carried.values()) + self.expire_after_ms + 1)
        if len(later):
            self.waiting.put([(later.tobytes(),)])
        else:
            self.waiting.clear()
        if wakes:
            self._wake(min(wakes))
        else:
            self.timer.clear()


def _unpacked(blob: bytes, width: int) -> np.ndarray:
    return np.frombuffer(blob, dtype=np.int64).reshape(-1, width)


def _plain(rows: pd.DataFrame) -> list[tuple]:
    """Rows as tuples of Python values, missing ones as None."""
    columns = []
    for c in rows.columns:
        v = rows[c]
        values = v.to_numpy().astype("datetime64[us]").tolist() if v.dtype.kind == "M" else v.astype(object).where(v.notna(), None).tolist()
        columns.append(values)
    return list(zip(*columns, strict=True))


def in_event_order(rows: DataFrame, keys: list[str], order: list[str], fold: Fold, output: str, delay: str, carried: str | None = None,
                   release: Callable[[np.ndarray], np.ndarray] | None = None, expire_after_ms: int | None = None) -> DataFrame:
    """``rows`` (a stream) grouped by ``keys`` and folded in the order of ``order``, whose first column is the event time."""
    kinds = {f.name: f for f in rows.schema.fields}
    state = T.StructType([T.StructField(c, kinds[c].dataType) for c in rows.columns if c not in keys])
    fold_state = T.StructType.fromDDL(carried) if carried else None
    # the marker of a closed stream is above the watermark node: a filter on the event time is not pushed below it
    real = rows.withWatermark(order[0], delay).where(F.col(order[0]) < F.lit(FAR).cast("timestamp"))
    return real.groupBy(*keys).transformWithStateInPandas(
        InEventOrder(fold, state, order, fold_state, release, expire_after_ms), output, "append", "EventTime")


def many_in_event_order(rows: DataFrame, time: str, columns: list[str], n_keys: int, fold: ManyFold, output: str, delay: str, n_carried: int,
                        expire_after_ms: int | None = None, buckets: int = BUCKETS) -> DataFrame:
    """``rows`` (a stream of long ``columns`` and the event time) by buckets of their first ``n_keys`` columns, in order of all ``columns``."""
    real = rows.withWatermark(time, delay).where(F.col(time) < F.lit(FAR).cast("timestamp"))
    bucket = F.pmod(F.xxhash64(*columns[:n_keys]), F.lit(buckets)).cast("int").alias("bucket")
    return real.select(bucket, time, *columns).groupBy("bucket").transformWithStateInPandas(
        ManyInEventOrder(fold, columns, n_keys, n_carried, expire_after_ms), output, "append", "EventTime")


def start(writer, spark: SparkSession):
    """Start a query with the state store that ``transformWithState`` needs; the session keeps its own setting."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, ROCKSDB)
    try:
        return writer.start()
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def run_closed(build: Callable[[DataFrame], DataFrame], source: DataFrame, base: str, time_col: str = "ts") -> DataFrame:
    """Run ``build(source)`` to the end of its input, close it by a marker, and read all that it wrote.

    ``base`` is a fresh folder that driver and executors share."""
    spark = source.sparkSession
    marks, out, ck = (os.path.join(base, d) for d in ("marks", "out", "checkpoint"))
    path = spark._jvm.org.apache.hadoop.fs.Path(marks)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)
    built = build(source.unionByName(spark.readStream.schema(source.schema).parquet(marks)))

    def run() -> None:
        writer = built.writeStream.option("checkpointLocation", ck).trigger(availableNow=True)
        start(writer.format("parquet").option("path", out).outputMode("append"), spark).awaitTermination()

    run()
    mark = [(F.lit(FAR) if f.name == time_col else F.lit(None)).cast(f.dataType).alias(f.name) for f in source.schema.fields]
    spark.range(1).select(*mark).coalesce(1).write.mode("append").parquet(marks)
    run()
    return spark.read.schema(built.schema).parquet(out)
