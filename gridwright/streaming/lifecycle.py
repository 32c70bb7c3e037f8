"""The lifecycle of jobs as a processor with named states, times to live and timers.

A job that waits is kept in the state ``queued`` for an hour, one that runs or has
ended in ``known`` for a day, each counted from its last message. While a job is
alive and hasn't ended, a timer sends a ping every 15 seconds. A job whose state is
gone says so once, and a later message begins it anew. State is kept by RocksDB, so
it may be larger than the memory of executors.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from ..functions.constants import PING_SECONDS, TTL_SECONDS, UPLOAD_TTL_SECONDS
from .messages import NEW, ORDER, STATE, STATES, advance, state_row

#: kind is ``state`` after messages, ``ping`` while nothing comes, and ``forgotten`` when the state is gone.
EVENTS = f"{STATES}, kind string"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_MESSAGE = ("seq", "type", "total_chunks", "n_det", "error")


class Lifecycle(StatefulProcessor):
    def __init__(self, timed: bool, forget: bool, ping: float, ttl: float, queued_ttl: float) -> None:
        self.timed, self.forget, self.ping = timed, forget, int(ping * 1000)
        self.ttl, self.queued_ttl = int(ttl * 1000), int(queued_ttl * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.queued = handle.getValueState("queued", STATE, self.queued_ttl if self.timed else None)
        self.known = handle.getValueState("known", STATE, self.ttl if self.timed else None)

    def _now(self) -> tuple | None:
        for state in (self.known, self.queued):
            if state.exists():
                return tuple(state.get())
        return None

    def _row(self, key: tuple, state: tuple, kind: str) -> pd.DataFrame:
        return pd.DataFrame([(*state_row(key[0], state), kind)], columns=[c.split()[0] for c in EVENTS.split(", ")])

    def _stop(self) -> None:
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        new = advance(self._now() or NEW, pd.concat(list(rows)))
        ended, waits = ORDER[new[0]] == 2, new[0] == "queued"
        if not waits or ended:
            self.queued.clear()
        if ended and self.forget:
            self.known.clear()
        else:
            (self.queued if waits else self.known).update(new)
        if self.timed:
            if ended:
                self._stop()
            elif not list(self.handle.listTimers()):
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.ping)
        yield self._row(key, new, "state")

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        state = self._now()
        if state is None:
            yield self._row(key, NEW, "forgotten")
        elif ORDER[state[0]] < 2:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.ping)
            yield self._row(key, state, "ping")

    def close(self) -> None:
        pass


@contextmanager
def rocks(spark: SparkSession) -> Iterator[None]:
    """Queries that are started in this block keep their state in RocksDB, as ``lifecycle`` needs."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


def lifecycle(messages: DataFrame, timed: bool = True, forget: bool = False, ping: float = PING_SECONDS, ttl: float = TTL_SECONDS, queued_ttl: float = UPLOAD_TTL_SECONDS) -> DataFrame:
    """EVENTS of the jobs of a stream (job_id, seq, type, total_chunks, n_det, error); start it within ``rocks``.

    ``timed`` sends pings and forgets by time; such a query runs a batch whenever a
    timer is due and never runs out of them, so it suits a stream that stays up.
    Without, it ends when all is read. ``forget`` drops a job's state when it ends,
    for ids that no later message names. Messages without a seq are left out, and all
    without a job_id are of one job.
    """
    slim = messages.where("seq is not null").select("job_id", *_MESSAGE)
    return slim.groupBy("job_id").transformWithStateInPandas(Lifecycle(timed, forget, ping, ttl, queued_ttl), EVENTS, "Update", "ProcessingTime" if timed else "None")
