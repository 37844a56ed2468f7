"""Leases as keyed state: claim, complete and expiry of the rows of one worker, one writer a key.

A lease ends by an event of its owner or by a timer, once the watermark has passed its time; state that saw nothing for
``KEEP_S`` is dropped by a timer, too.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: A lease that is older is free again. State without events for so long goes. How late events may come.
LEASE_S, KEEP_S, WATERMARK = 3600, 90 * 86_400, "10 minutes"
OUTPUT = "owner long, claims long, done long, failed long, expired long, refused long"
STATE = "lease double, claims long, done long, failed long, expired long, refused long, last double"
#: The state store that timers need.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
# fixed values: which event does what
ACTIONS = {"view": "claim", "click": "claim", "purchase": "done", "error": "failed", "signup": "done"}


def expire(state: tuple, at: float) -> tuple:
    """The state at a time: a lease that is over is free."""
    lease, claims, done, failed, expired, refused = state
    return (-1.0, claims, done, failed, expired + 1, refused) if lease >= 0 and at - lease > LEASE_S else state


def step(state: tuple, action: str, at: float) -> tuple:
    """The next state: a lease is taken if it is free, and ended only while it is held."""
    lease, claims, done, failed, expired, refused = expire(state, at)
    if action == "claim":
        if lease < 0:
            lease, claims = at, claims + 1
        else:
            refused += 1
    elif lease >= 0:
        lease, done, failed = -1.0, done + (action == "done"), failed + (action == "failed")
    else:
        refused += 1
    return lease, claims, done, failed, expired, refused


START = (-1.0, 0, 0, 0, 0, 0)


def replay(rows: list[tuple[float, int, str]], until: float | None = None) -> tuple:
    """The state after (time, id, kind) rows, and once the clock shows ``until``: what the stream must equal."""
    state = START
    for at, _, kind in sorted(rows):
        state = step(state, ACTIONS[kind], at)
    return state if until is None else expire(state, until)


class Leases(StatefulProcessor):
    """Events of a batch are taken in time order; timers fire as the watermark passes."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("lease", STATE)

    def _kept(self, key: tuple, state: tuple, last: float) -> pd.DataFrame:
        self.state.update((*state, last))
        if state[0] >= 0:
            self.handle.registerTimer(int((state[0] + LEASE_S) * 1000) + 1)
        self.handle.registerTimer(int((last + KEEP_S) * 1000) + 1)
        return pd.DataFrame([(key[0], *state[1:])], columns=["owner", "claims", "done", "failed", "expired", "refused"])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        old = tuple(self.state.get()) if self.state.exists() else (*START, 0.0)
        state, frame = old[:6], pd.concat(list(rows)).sort_values(["at", "event_id"])
        for kind, at in zip(frame["event_type"], frame["at"], strict=True):
            state = step(state, ACTIONS[kind], float(at))
        yield self._kept(key, state, max(old[6], float(frame["at"].max())))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.state.exists():
            old, now = tuple(self.state.get()), expiredTimerInfo.getExpiryTimeInMs() / 1000
            state = expire(old[:6], now)
            if now - old[6] > KEEP_S:
                self.state.clear()
            elif state != old[:6]:
                yield self._kept(key, state, old[6])

    def close(self) -> None:
        pass


def lease_counts(events: DataFrame) -> DataFrame:
    """A stream of event_id, user_id, ts, event_type as running counts by owner. The session needs PROVIDER as its state store."""
    timed = events.selectExpr("event_id", "user_id as owner", "cast(ts as timestamp) as moment", "cast(cast(ts as timestamp) as double) as at", "event_type")
    timed = timed.withWatermark("moment", WATERMARK)
    return timed.groupBy("owner").transformWithStateInPandas(Leases(), OUTPUT, "update", "eventTime")
