"""Changes gathered from the first one on: it opens a wait, and what comes until its end is one batch.

Unlike fixed windows or bursts (``changes.coalesce_changes``), a batch begins at
an event and ends a fixed time later, whether or not more events come.  Each
value of ``by``, such as the root that is watched, has batches of its own.

On a stream a timer of the event time ends the wait; until the watermark has
passed it, events may come in any order, and one that comes before the first
opens the batch anew.  The state holds the events of a key that are not in a
finished batch yet.  The session needs the RocksDB state store.
"""

import math
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from factgraph.streaming.changes import DELETED

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def cut(events: list[tuple], wait_ms: int, until_ms: float = math.inf) -> tuple[list[list[tuple]], list[tuple]]:
    """Batches of events (ms, kind, path), sorted by time, that end by ``until_ms``, and the events behind them."""
    batches, at = [], 0
    while at < len(events) and events[at][0] + wait_ms <= until_ms:
        end = at
        while end < len(events) and events[end][0] < events[at][0] + wait_ms:
            end += 1
        batches.append(events[at:end])
        at = end
    return batches, events[at:]


def collapsed(batch: list[tuple], policy: str) -> list[tuple]:
    """(start ms, path, kind) of a batch, each path once."""
    kinds: dict[str, str] = {}
    for _, kind, path in sorted(batch):
        kinds[path] = kind if policy == "last" or kinds.get(path) != DELETED else DELETED
    return [(batch[0][0], path, kind) for path, kind in sorted(kinds.items())]


def _frame(key: tuple, by: list[str], rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["batch_start", "path", "kind"])
    out["batch_start"] = pd.to_datetime(out["batch_start"], unit="ms")
    for i, column in enumerate(by):
        out.insert(i, column, key[i])
    return out


def _events(frame: pd.DataFrame) -> list[tuple]:
    return list(zip(frame["ms"].tolist(), frame["kind"].tolist(), frame["path"].tolist()))


def _processor(by: list[str], wait_ms: int, policy: str):
    from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

    class Waiting(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.events = handle.getListState("events", "ms bigint, kind string, path string")
            self.ends = handle.getValueState("ends", "ms bigint")

        def _wait_until(self, ms: int | None) -> None:
            """Keep one timer per key, at the end of its first wait."""
            known = self.ends.get()[0] if self.ends.exists() else None
            if known == ms:
                return
            if known is not None:
                self.handle.deleteTimer(known)
            if ms is None:
                self.ends.clear()
            else:
                self.ends.update((ms,))
                self.handle.registerTimer(ms)

        def handleInputRows(self, key, rows: Iterable[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
            first = None
            for frame in rows:
                found = _events(frame)
                self.events.appendList(found)
                first = min([e[0] for e in found] + ([first] if first is not None else []))
            known = self.ends.get()[0] if self.ends.exists() else None
            if first is not None and (known is None or first + wait_ms < known):
                self._wait_until(first + wait_ms)
            return iter(())

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            events = sorted((int(ms), kind, path) for ms, kind, path in self.events.get())
            batches, rest = cut(events, wait_ms, timerValues.getCurrentWatermarkInMs())
            if rest:
                self.events.put(rest)
            else:
                self.events.clear()
            # the timer that has fired is gone already
            self.ends.clear()
            if rest:
                self._wait_until(rest[0][0] + wait_ms)
            rows = [r for batch in batches for r in collapsed(batch, policy)]
            if rows:
                yield _frame(key, by, rows)

        def close(self) -> None:
            pass

    return Waiting()


def debounce(rows: DataFrame, by: list[str], wait_ms: int = 500, policy: str = "deleted", late: str | None = None) -> DataFrame:
    """(by, batch_start, path, kind): each path once per batch.

    Works on a batch and on a stream, which needs ``late``, the time events may
    come late.  ``policy`` is that of ``changes.collapse``.  Times count in
    milliseconds.  A batch of a stream comes out when the watermark has passed
    its end, so the last batches wait for later events.
    """
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    shape = ", ".join([*[f"`{c}` {kinds[c]}" for c in by], "batch_start timestamp", "path string", "kind string"])
    ms = F.unix_millis("ts")
    if rows.isStreaming:
        timed = rows.withWatermark("ts", late or "0 seconds").select(*by, "ts", ms.alias("ms"), "kind", "path")
        return timed.groupBy(*by).transformWithStateInPandas(
            _processor(by, wait_ms, policy), outputStructType=shape, outputMode="Append", timeMode="EventTime")

    def one(key, frame):
        batches, _ = cut(sorted(_events(frame)), wait_ms)
        return _frame(key, by, [r for batch in batches for r in collapsed(batch, policy)])

    # an event that none came shortly before opens a batch in any case, so a task gets one busy stretch of a key
    along = W.partitionBy(*by).orderBy("ms")
    fresh = F.coalesce(F.col("ms") - F.lag("ms").over(along) >= wait_ms, F.lit(True))
    stretches = rows.select(*by, ms.alias("ms"), "kind", "path").withColumn("fresh", fresh.cast("int"))
    stretches = stretches.withColumn("stretch", F.sum("fresh").over(along.rangeBetween(W.unboundedPreceding, 0)))
    return stretches.groupBy(*by, "stretch").applyInPandas(lambda key, frame: one(key[:-1], frame), shape)
