"""Lifecycles of documents as a keyed stream processor: state with timers that ends, in place of state that stays.

Each event is judged when it arrives, in the order of its time within a micro-batch:
``unknown`` (no state of the lifecycle), ``late`` (older than the document's last accepted event), ``refused`` (the
document has ended), ``back`` (accepted, but more than one stage back) or ``accepted``. A document without an accepted
event for ``idle`` seconds expires, an ended one is kept for ``keep`` seconds to refuse what comes after. An event beyond
that begins a new lifecycle; without one a timer does the same when the watermark passes, and the state is cleared.
Verdicts do not depend on how soon timers run.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

VERDICT = "event_id long, ts timestamp, verdict string, status string, events long"
#: What the state store has to be for processors with timers.
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}

_NOW = T.StructType([T.StructField("status", T.StringType()), T.StructField("events", T.LongType()), T.StructField("last", T.LongType()), T.StructField("ended", T.BooleanType())])
_STEP = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("status", T.StringType())])


def judged(now: tuple | None, at: int, status: str | None, states: list[str], terminal: list[str]) -> str:
    """The verdict on an event at a time (in microseconds), given (status, events, last, ended) or None."""
    if status not in states:
        return "unknown"
    if now is None:
        return "accepted"
    if now[3]:
        return "refused"
    if at < now[2]:
        return "late"
    return "back" if states.index(status) < states.index(now[0]) - 1 else "accepted"


class Lifecycle(StatefulProcessor):
    """One value (where a document is) and one list (its accepted events, until it ends) for each key."""

    def __init__(self, key: str, states: list[str], terminal: list[str], idle: int, keep: int):
        self.key, self.states, self.terminal, self.idle, self.keep = key, states, terminal, idle * 1_000_000, keep * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.now = handle.getValueState("now", _NOW)
        self.steps = handle.getListState("steps", _STEP)

    def _over(self, now: tuple) -> int:
        """When a document's state is at its end."""
        return now[2] + (self.keep if now[3] else self.idle)

    def _expired(self, name: object, now: tuple, at: int) -> tuple:
        return (name, None, pd.Timestamp(at, unit="us"), "forgotten" if now[3] else "expired", now[0], now[1])

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = tuple(self.now.get()) if self.now.exists() else None
        before, out, added, anew = now, [], [], False
        events = pd.concat(list(rows)).sort_values(["ts", "event_id"])
        for event_id, ts, status in zip(events["event_id"].tolist(), events["ts"], events["status"].tolist(), strict=True):
            at = ts.value // 1000
            if now is not None and at > self._over(now):
                out.append(self._expired(key[0], now, self._over(now)))
                now, added, anew = None, [], True
            verdict = judged(now, at, status, self.states, self.terminal)
            if verdict in ("accepted", "back"):
                now = (status, (now[1] if now else 0) + 1, at, status in self.terminal)
                added.append((event_id, status))
            out.append((key[0], event_id, ts, verdict, now[0] if now else None, now[1] if now else 0))
        if now != before:
            if anew or now[3]:
                # The log of an ended document is not needed to refuse what comes after.
                self.steps.clear()
            if added and not now[3]:
                self.steps.appendList(added)
            self.now.update(now)
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(self._over(now) // 1000 + 1)
        yield self._frame(out)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if self.now.exists():
            now = tuple(self.now.get())
            self.now.clear()
            self.steps.clear()
            yield self._frame([self._expired(key[0], now, self._over(now))])

    def _frame(self, rows: list[tuple]) -> pd.DataFrame:
        frame = pd.DataFrame(rows, columns=[self.key, "event_id", "ts", "verdict", "status", "events"])
        return frame.astype({"event_id": "Int64", "ts": "datetime64[us]"})

    def close(self) -> None:
        return None


def lifecycles(events: DataFrame, states: list[str], terminal: list[str], key: str = "document", idle: int = 7 * 86_400, keep: int = 90 * 86_400, delay: str = "10 minutes") -> DataFrame:
    """Verdicts on a stream of events (key, event_id, ts, status), and a row for each document that expires or is forgotten.

    Needs the settings of ``STORE``. Events older than the watermark are dropped before they are judged. Null keys are a
    document of their own; of events of equal time the least id comes first.
    """
    schema = T.StructType([events.schema[key], *T.StructType.fromDDL(VERDICT).fields])
    return events.select(key, "event_id", "ts", "status").withWatermark("ts", delay).groupBy(key).transformWithStateInPandas(Lifecycle(key, states, terminal, idle, keep), schema, "Append", "EventTime")
