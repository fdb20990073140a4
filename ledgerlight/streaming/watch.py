"""State of what reads have seen: works that they stop mentioning, slices whose reads fail, and figures that moved.

The first two keep a few values for each key and one timer, so what doesn't come is noticed too: a timer fires when its time has come, with or
without input, also after a restart. ``event_time`` counts time by the reads' own (the stream needs a watermark on ``at``); else it is
the clock's. State lives in RocksDB (``use_timers``).
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ledgerlight.streaming.ingest import signature

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_timers(spark: SparkSession) -> None:
    """What streams with timers need of a session, before they start."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def _ms(at: dt.datetime) -> int:
    return round(at.timestamp() * 1000)


def _at(ms: int) -> dt.datetime:
    return dt.datetime.fromtimestamp(ms / 1000)


class _Timed(StatefulProcessor):
    """A key with one state and at most one timer."""

    schema: str

    def __init__(self, event_time: bool) -> None:
        self.event_time = event_time

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", self.schema)

    def wake(self, ms: int | None) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if ms is not None:
            self.handle.registerTimer(ms)

    def now(self, timers, last: Row | None) -> int:
        return _ms(last["at"]) if self.event_time and last is not None else timers.getCurrentWatermarkInMs() if self.event_time else timers.getCurrentProcessingTimeInMs()

    def close(self) -> None:
        pass


class Presence(_Timed):
    """listed, missing, retired."""

    schema = "now string, since bigint"

    def __init__(self, silent_ms: int, confirm_ms: int, forget_ms: int, event_time: bool) -> None:
        super().__init__(event_time)
        self.waits = {"listed": silent_ms, "missing": confirm_ms, "retired": forget_ms}
        self.confirm_ms = confirm_ms

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        now, since = (self.state.get() if self.state.exists() else None) or ("listed", 0)
        last = None
        for r in sorted(rows, key=lambda r: (r["at"], r["listed"])):
            last, at, new = r, _ms(r["at"]), now
            if r["listed"]:
                new = "listed"
            elif now == "listed":
                new, since = "missing", at
            elif now == "missing" and r["consistent"] and at - since >= self.confirm_ms:
                new = "retired"
            if new != now:
                yield Row(work_id=key[0], state="restored" if new == "listed" else new, at=r["at"], by="read")
            now = new
        self.state.update((now, since))
        self.wake(self.now(timerValues, last) + self.waits[now])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        now, since = self.state.get()
        at = expiredTimerInfo.getExpiryTimeInMs()
        if now == "retired":
            self.state.clear()
            return
        now, since = ("missing", at) if now == "listed" else ("retired", since)
        self.state.update((now, since))
        self.handle.registerTimer(max(at, self.now(timerValues, None)) + self.waits[now])
        yield Row(work_id=key[0], state=now, at=_at(at), by="silence")


def watched(reads: DataFrame, *, silent_minutes: float = 24 * 60, after_minutes: float = 10, forget_minutes: float = 30 * 24 * 60, event_time: bool = False) -> DataFrame:
    """Reads (work_id, at, listed, consistent) to (work_id, state, at, by), a row each time a work's state changes.

    A work that a read lacks waits; a consistent read ``after_minutes`` later that lacks it too retires it, and one that lists it restores
    it. One that no read mentions for ``silent_minutes`` waits as well, and retires if that goes on for ``after_minutes``. A retired work is forgotten
    after ``forget_minutes``, so state doesn't grow with all works there ever were."""
    ms = lambda minutes: round(60_000 * minutes)
    kind = reads.schema["work_id"].dataType.simpleString()
    processor = Presence(ms(silent_minutes), ms(after_minutes), ms(forget_minutes), event_time)
    return reads.groupBy("work_id").transformWithState(processor, f"work_id {kind}, state string, at timestamp, by string", "append", "EventTime" if event_time else "ProcessingTime")


class Attempts(_Timed):
    """Failures of a slice in a row, and when it is due again."""

    schema = "failures int, due bigint"

    def __init__(self, first_ms: int, escalate: int, event_time: bool) -> None:
        super().__init__(event_time)
        self.first_ms, self.escalate = first_ms, escalate

    def row(self, key, what: str, failures: int, due: int | None) -> Row:
        return Row(slice=key[0], lifecycle=what, failures=failures, due_at=None if due is None else _at(due), escalated=failures >= self.escalate)

    def wait(self, failures: int) -> int:
        return self.first_ms * 2 ** (min(failures, 10) - 1)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        failures, due = (self.state.get() if self.state.exists() else None) or (0, 0)
        before, last = failures, None
        for r in sorted(rows, key=lambda r: (r["at"], r["verdict"] == "ok")):
            last, failures = r, 0 if r["verdict"] == "ok" else failures + 1
        if failures == 0:
            self.state.clear()
            self.wake(None)
            if before:
                yield self.row(key, "live", 0, None)
            return
        due = self.now(timerValues, last) + self.wait(failures)
        self.state.update((failures, due))
        self.wake(due)
        yield self.row(key, "quarantined" if failures >= self.escalate else "retry", failures, due)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        failures, due = self.state.get()
        # asked for again after the same wait, should the answer never come
        again = max(due, self.now(timerValues, None)) + self.wait(failures)
        self.state.update((failures, again))
        self.handle.registerTimer(again)
        yield self.row(key, "due", failures, due)


def attempts(verdicts: DataFrame, *, first_minutes: float = 5, escalate: int = 3, event_time: bool = False) -> DataFrame:
    """Verdicts (slice, at, verdict) to (slice, lifecycle, failures, due_at, escalated): retry or quarantined when a read fails, due when the wait,
    which each failure doubles, is over, and live when a slice that had failed is read. Slices that don't fail keep no state."""
    kind = verdicts.schema["slice"].dataType.simpleString()
    return verdicts.groupBy("slice").transformWithState(Attempts(round(60_000 * first_minutes), escalate, event_time), f"slice {kind}, lifecycle string, failures int, due_at timestamp, escalated boolean", "append", "EventTime" if event_time else "ProcessingTime")


class Signatures(StatefulProcessor):
    """The signature of each slice of a root, by level. A slice is compared only below one that moved in the same read."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", "level int, slice string", "signature string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        reads: dict[dt.datetime, dict[int, list[Row]]] = {}
        for r in rows:
            reads.setdefault(r["at"], {}).setdefault(r["level"], []).append(r)
        for at in sorted(reads):
            moved: set[str] | None = None
            for level in sorted(reads[at]):
                here = set()
                for r in sorted(reads[at][level], key=lambda r: (r["slice"], r["signature"])):
                    place = (level, r["slice"])
                    if moved is not None and r["parent"] not in moved:
                        continue
                    if self.seen.containsKey(place) and self.seen.getValue(place)[0] == r["signature"]:
                        continue
                    self.seen.updateValue(place, (r["signature"],))
                    here.add(r["slice"])
                    yield Row(root=key[0], level=level, slice=r["slice"], at=at)
                moved = here

    def close(self) -> None:
        pass


def moved(probes: DataFrame) -> DataFrame:
    """Probes (root, level, slice, parent, at, n, total) to (root, level, slice, at) of the slices that moved since they were last compared.

    Levels count from the top of a root; a level is compared only below what moved above it in the same read, so where nothing moved nothing
    further is asked. A slice never seen has moved. A root's slices are those of one place, as many as the source has there; roots are
    dealt over the cluster. For payloads, a level of one and their hash in place of n do (T4)."""
    rows = probes.withColumn("signature", signature()).select("root", "level", "slice", "parent", "at", "signature")
    return rows.groupBy("root").transformWithState(Signatures(), f"root {probes.schema['root'].dataType.simpleString()}, level int, slice string, at timestamp", "append", "None")
