"""Streaming operators that keep state of their own: it is put in order, it ends, and event time drives it.

They need the RocksDB state store (rocksdb())."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def millis(interval: str) -> int:
    return int(pd.Timedelta(interval).total_seconds() * 1000)


def _ms(ts: pd.Timestamp) -> int:
    return int(ts.value // 1_000_000)


class _Debounce(StatefulProcessor):
    """All changes have one key here, but they come as sums of a path over a piece of time no longer than the gap."""

    def __init__(self, gap: int):
        self.gap = gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.burst = handle.getValueState("burst", "first long, last long")
        self.paths = handle.getMapState("paths", "path string", "changes long")

    def _emit(self) -> pd.DataFrame:
        first, last = self.burst.get()
        rows = [(pd.Timestamp(first, unit="ms"), pd.Timestamp(last, unit="ms"), k[0], v[0]) for k, v in self.paths.iterator()]
        self.burst.clear()
        self.paths.clear()
        return pd.DataFrame(rows, columns=["first_ts", "last_ts", "path", "changes"])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows)).sort_values("first", kind="stable")
        for first, last, path, n in zip(pdf["first"], pdf["last"], pdf["path"], pdf["changes"], strict=True):
            if self.burst.exists() and first - self.burst.get()[1] > self.gap:
                yield self._emit()
            if self.burst.exists():
                a, b = self.burst.get()
                self.burst.update((a, max(b, int(last))))
            else:
                self.burst.update((int(first), int(last)))
            had = self.paths.getValue((path,))[0] if self.paths.containsKey((path,)) else 0
            self.paths.updateValue((path,), (had + int(n),))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        # the piece of time that a change at the very end of the gap falls into is over by then
        self.handle.registerTimer(self.burst.get()[1] + 2 * self.gap + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.burst.exists():
            yield self._emit()

    def close(self) -> None:
        pass


def debounce_all(changes: DataFrame, gap: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Bursts of changes (ts, path) of all paths together, once nothing has changed for the gap: (first_ts, last_ts, path, changes), a row
    a path (append mode). Times count in milliseconds.

    Changes are first summed up by path and by pieces of time as long as the gap, side by side, within which nothing can end
    a burst; only these sums meet in the one state."""
    timed = changes.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    ms = F.unix_millis("ts")
    pieces = timed.groupBy(F.window("ts", gap).alias("w"), "path").agg(F.min(ms).alias("first"), F.max(ms).alias("last"), F.count("*").alias("changes"))
    one = pieces.select(F.lit(0).alias("all"), F.col("w.end").alias("ts"), "path", "first", "last", "changes")
    return one.groupBy("all").transformWithStateInPandas(_Debounce(millis(gap)), "first_ts timestamp, last_ts timestamp, path string, changes long", "append", "EventTime")


class _Ordered(StatefulProcessor):
    """Rows of a key wait until the watermark has passed them and are then handed to step() in order; what step() keeps ends
    when nothing has come for `keep`."""

    def __init__(self, keep: int):
        self.keep = keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "ts long, ord long, hash string")
        self.last = handle.getValueState("last", "ts long, ord long, hash string")

    def step(self, last, row) -> bool:
        raise NotImplementedError

    def _ripe(self, key, watermark: int) -> Iterator[pd.DataFrame]:
        rows = sorted(self.waiting.get()) if self.waiting.exists() else []
        out, last = [], self.last.get() if self.last.exists() else None
        if last is not None and last[0] + self.keep <= watermark and not any(r[0] <= watermark for r in rows):
            self.last.clear()
            last = None
        for r in rows:
            if r[0] > watermark:
                break
            if last is not None and r[0] - last[0] >= self.keep:
                last = None  # it had ended by then
            if self.step(last, r):
                out.append((r[1], key[0], r[2]))
            last = r
        rest = [r for r in rows if r[0] > watermark]
        if len(rest) < len(rows):
            self.waiting.put(rest) if rest else self.waiting.clear()
            self.last.update(last)
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if rest:
            self.handle.registerTimer(rest[0][0])
        elif self.last.exists():
            self.handle.registerTimer(self.last.get()[0] + self.keep)
        if out:
            yield pd.DataFrame(out, columns=["ord", "uri", "hash"])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            self.waiting.appendList([(_ms(t), int(o), h) for t, o, h in zip(pdf["ts"], pdf["ord"], pdf["hash"], strict=True)])
        yield from self._ripe(key, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._ripe(key, timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


class _Changed(_Ordered):
    def step(self, last, row) -> bool:
        return last is None or last[2] != row[2]


def _state(versions: DataFrame, processor: StatefulProcessor, late: str) -> DataFrame:
    timed = versions.select("ord", "uri", "hash", F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", late)
    return timed.groupBy("uri").transformWithStateInPandas(processor, "ord long, uri string, hash string", "append", "EventTime")


def changed_in_order(versions: DataFrame, late: str = "1 hour", keep: str = "30 days") -> DataFrame:
    """Versions (ord, uri, hash, ts) whose hash differs from the one before them by ts and ord, however batches bring them: a row waits
    until the watermark has passed it; one that is later than `late` is dropped. A uri that is quiet for `keep` is
    forgotten, so its next version counts as changed."""
    return _state(versions, _Changed(millis(keep)), late)


class _Newest(StatefulProcessor):
    def __init__(self, keep: int):
        self.keep = keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "ts long, ord long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        best = max((_ms(t), int(o), h) for pdf in rows for t, o, h in zip(pdf["ts"], pdf["ord"], pdf["hash"], strict=True))
        if self.last.exists() and tuple(self.last.get()) >= best[:2]:
            return
        self.last.update(best[:2])
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(best[0] + self.keep)
        yield pd.DataFrame([(best[1], key[0], best[2])], columns=["ord", "uri", "hash"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.last.clear()
        return iter(())

    def close(self) -> None:
        pass


def superseding(requests: DataFrame, late: str = "1 hour", keep: str = "30 days") -> DataFrame:
    """Of each batch and uri the newest request by ts and ord, if it is newer than all before; it supersedes them. The last one
    of a uri is what latest_generation() gives. A uri that is quiet for `keep` is forgotten."""
    return _state(requests, _Newest(millis(keep)), late)
