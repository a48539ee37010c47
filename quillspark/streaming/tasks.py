"""Task states as a stream: last event, checks and leases of each task, kept in
state, with a timer for each lease, so that one runs out without a new row."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.work import CHECK_STATES, TASK_STATES

OUT = "task string, status string, leased boolean, at timestamp"
_KEPT = "ms long, id string, what string"


def status_of(last: str | None, checks: list[str | None], leased: bool) -> str:
    """By an active lease that nothing but a claim followed, by the last event, by the checks, else planned."""
    if leased and last in (None, "claimed"):
        return "claimed"
    if last in TASK_STATES:
        return TASK_STATES[last]
    states = [CHECK_STATES.get(c or "") for c in checks]
    if "failed" in states:
        return "blocked"
    if "running" in states:
        return "running"
    return "ready" if states and all(s == "passed" for s in states) else "planned"


class _Task(StatefulProcessor):
    """Everything is kept by time and id, so rows may come in any order."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", _KEPT)
        self.declared = handle.getValueState("declared", "ms long, checks string")
        self.said = handle.getValueState("said", "status string, leased boolean")
        self.checks = handle.getMapState("checks", "name string", _KEPT)
        self.leases = handle.getMapState("leases", "id string", "ms long, status string, until long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        for pdf in rows:
            for kind, at, name, what, check, until in zip(pdf["kind"], pdf["ms"], pdf["id"], pdf["what"], pdf["check"], pdf["until"]):
                at = int(at)
                if kind == "task":
                    if not self.declared.exists() or self.declared.get()[0] <= at:
                        self.declared.update((at, what or ""))
                elif kind == "lease":
                    if not self.leases.containsKey((name,)) or self.leases.getValue((name,))[0] <= at:
                        self.leases.updateValue((name,), (at, what, int(until)))
                        if what == "active":
                            self.handle.registerTimer(int(until))
                else:
                    one = (at, name, what)
                    if isinstance(check, str):
                        if not self.checks.containsKey((check,)) or self.checks.getValue((check,))[:2] <= one[:2]:
                            self.checks.updateValue((check,), one)
                    if what in TASK_STATES and (not self.last.exists() or self.last.get()[:2] <= one[:2]):
                        self.last.update(one)
        yield from self._told(key, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        yield from self._told(key, max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs()))

    def _told(self, key: tuple, now: int) -> Iterator[pd.DataFrame]:
        leased = any(status == "active" and until > now for _, (_, status, until) in self.leases.iterator())
        names = [c for c in (self.declared.get()[1] if self.declared.exists() else "").split(",") if c]
        checks = [self.checks.getValue((c,))[2] if self.checks.containsKey((c,)) else None for c in names]
        now_is = (status_of(self.last.get()[2] if self.last.exists() else None, checks, leased), leased)
        if not self.said.exists() or tuple(self.said.get()) != now_is:
            self.said.update(now_is)
            yield pd.DataFrame({"task": [key[0]], "status": [now_is[0]], "leased": [leased], "at": [pd.Timestamp(max(now, 0), unit="ms")]})

    def close(self) -> None:
        pass


def task_states(rows: DataFrame, late: str = "1 hour") -> DataFrame:
    """A stream of (task, status, leased, at): each change of a task's state.

    ``rows`` (a stream): task, kind, id, at, what, check, until. Of kind
    ``task``: what holds the names of its checks, joined by commas. ``event``:
    what happened, to a check or, if that is null, to the task. ``lease``: its
    status, and until when it holds; renewals are rows of the same id. Rows may
    come in any order within ``late``; a lease is over when the watermark
    reaches its end. The latest state of a task is that of ``work.task_states``.
    """
    keyed = rows.withColumn("at", F.col("at").cast("timestamp")).withWatermark("at", late)
    keyed = keyed.select("task", "kind", "id", "at", "what", "check", F.unix_millis("at").alias("ms"), F.coalesce(F.unix_millis(F.col("until").cast("timestamp")), F.lit(0)).alias("until"))
    return keyed.groupBy("task").transformWithStateInPandas(_Task(), OUT, "Update", "EventTime")
