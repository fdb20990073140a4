"""Calls to a slow service from a few tasks at a time, and the breaker that spares it while it fails."""

from __future__ import annotations

import time
from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame


class Breaker:
    """Opens when more than half of the last calls failed; waits twice as long each time, up to half an hour, and lets one call try."""

    def __init__(self, window: int = 20, share: float = 0.5, pause: float = 60.0, most: float = 1800.0) -> None:
        self.calls: deque[bool] = deque(maxlen=window)
        self.share, self.first, self.pause, self.most = share, pause, pause, most
        self.open_until: float | None = None

    def allows(self, now: float) -> bool:
        return self.open_until is None or now >= self.open_until

    def record(self, ok: bool, now: float) -> None:
        if self.open_until is not None:  # this was the trial
            if ok:
                self.open_until, self.pause = None, self.first
                self.calls.clear()
            else:
                self.pause = min(self.most, 2 * self.pause)
                self.open_until = now + self.pause
            return
        self.calls.append(ok)
        if len(self.calls) == self.calls.maxlen and self.calls.count(False) > self.share * len(self.calls):
            self.open_until = now + self.pause


def called(df: DataFrame, call: Callable[[dict], str], workers: int = 4, breaker: Callable[[], Breaker] | None = Breaker, clock: Callable[[], float] = time.monotonic, wait: Callable[[float], None] = time.sleep, tries: int = 3) -> DataFrame:
    """Adds body and error: call(row) for each row, by at most ``workers`` tasks; an exception is a value of its row.

    A call is tried ``tries`` times. Each task has a breaker of its own: while it is open, the task waits for it."""
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", body string, error string"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        guard = breaker() if breaker else None

        def one(row: dict) -> tuple[str | None, str | None]:
            error = None
            for _ in range(tries):
                if guard and not guard.allows(clock()):
                    wait(max(0.0, guard.open_until - clock()))
                try:
                    body = call(row)
                except Exception as e:  # noqa: BLE001  given back to the caller in place
                    error = f"{type(e).__name__}: {e}"
                    if guard:
                        guard.record(False, clock())
                    continue
                if guard:
                    guard.record(True, clock())
                return body, None
            return None, error

        for pdf in frames:
            out = [one(row) for row in pdf.to_dict("records")]
            yield pdf.assign(body=[b for b, _ in out], error=[e for _, e in out])

    return df.repartition(workers).mapInPandas(run, ddl)
