"""Claims of evidence that lapse: who may decide a piece of evidence, in a stream.

A worker claims a piece of evidence and holds it for LEASE seconds; others are refused until it is decided or
the lease has lapsed, in the time of the requests. Only the holder may decide, while the lease
lasts, and a piece is decided once. State is one lease per piece: it lapses by a timer on the
watermark, so what is claimed and left alone is kept no longer than the lease; what is
decided is kept for `remember` seconds, in which a repeated request is refused."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Seconds that a claim holds.
LEASE = 600
OUT = "evidence_id long, at timestamp, worker string, action string, granted boolean"


class Lease:
    """One piece of evidence: its holder, until when, and whether it is decided."""

    def __init__(self, worker: str | None = None, until: datetime | None = None, decided: bool = False):
        self.worker, self.until, self.decided = worker, until, decided

    def step(self, at: datetime, worker: str, action: str, seconds: int = LEASE) -> bool:
        """Whether a request is granted; a holder's own claim renews its lease."""
        live = self.until is not None and at < self.until
        if self.decided or (live and worker != self.worker):
            return False
        if action == "claim":
            self.worker, self.until = worker, at + timedelta(seconds=seconds)
            return True
        if action == "decide" and live:
            self.decided = True
            return True
        return False


class Leases(StatefulProcessor):
    def __init__(self, seconds: int = LEASE, remember: int = 86400):
        self.seconds, self.remember = seconds, remember

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("lease", "worker string, until timestamp, decided boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        lease = Lease(*self.state.get()) if self.state.exists() else Lease()
        some = pd.concat(list(rows), ignore_index=True).sort_values(["at", "worker", "action"], kind="stable")
        some["granted"] = [lease.step(at.to_pydatetime(), w, a, self.seconds) for at, w, a in zip(some["at"], some["worker"], some["action"])]
        if lease.until is not None:
            self.state.update((lease.worker, lease.until, lease.decided))
            for old in self.handle.listTimers():
                self.handle.deleteTimer(old)
            last = lease.until + timedelta(seconds=self.remember if lease.decided else 0)
            self.handle.registerTimer(int(last.timestamp() * 1000))
        yield some[["evidence_id", "at", "worker", "action", "granted"]]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        yield pd.DataFrame(columns=["evidence_id", "at", "worker", "action", "granted"])

    def close(self) -> None:
        pass


def granted(requests: DataFrame, seconds: int = LEASE, delay: str = "60 seconds", remember: int = 86400) -> DataFrame:
    """Columns OUT of a stream of requests (evidence_id, at, worker, action: claim or decide)."""
    stream = requests.withWatermark("at", delay)
    return stream.groupBy("evidence_id").transformWithStateInPandas(Leases(seconds, remember), OUT, "append", "eventTime")
