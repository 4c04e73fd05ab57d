"""The life of review tasks, folded from their events: what a task's status is after each, and which events came too late."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Statuses after which nothing changes.
TERMINAL = ("done", "failed", "cancelled", "timed_out")
IDLE_SECONDS = 180
STATUS = "task string, at long, event string, status string, applied boolean"


def advanced(status: str, last: int, event: str, at: int, idle: int = IDLE_SECONDS) -> tuple[str, int, bool]:
    """(status, last activity, applied) after an event at a time in seconds.

    Events: start, activity, cancel, done, failed, cancelled, and tick, the watchdog's. The first terminal status stays. A task
    that is being cancelled can only become cancelled. A tick ends what was idle for longer than `idle`.
    """
    if status in TERMINAL:
        return status, last, False
    if event == "tick":
        over = status in ("running", "cancelling") and at - last > idle
        return ("timed_out" if status == "running" else "cancelled", last, True) if over else (status, last, False)
    if event == "start":
        return ("running", at, True) if status == "queued" else (status, last, False)
    if event == "activity":
        return status, at, status in ("running", "cancelling")
    if event == "cancel":
        return ("cancelled" if status == "queued" else "cancelling", at, status != "cancelling")
    if event == "cancelled":
        return "cancelled", at, True
    if event in ("done", "failed") and status == "running":
        return event, at, True
    return status, last, False


def folded(rows: list[tuple[int, str]], status: str = "queued", last: int = 0) -> tuple[list[tuple], str, int]:
    out = []
    for at, event in rows:
        status, last, applied = advanced(status, last, event, at)
        out.append((at, event, status, applied))
    return out, status, last


def watched(rows: list[tuple[int, str]], status: str, last: int, idle: int, now: int | None) -> tuple[list[tuple], str, int]:
    """`folded` under a watchdog that needs no event of its own: where a running or cancelling task stays idle for longer than
    `idle` up to its next event, or up to `now`, it ends right then, at the last second that it might have lived."""
    out = []
    for at, event in [*rows, (now, None)] if now is not None else rows:
        if status in ("running", "cancelling") and at - last > idle:
            status, ends, _ = advanced(status, last, "tick", at, idle)
            out.append((last + idle, "watchdog", status, True))
        if event is not None:
            status, last, applied = advanced(status, last, event, at, idle)
            out.append((at, event, status, applied))
    return out, status, last


def _frame(task: str, out: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame([(task, *o) for o in out], columns=["task", "at", "event", "status", "applied"])


def watched_statuses(events: DataFrame, idle: int = IDLE_SECONDS, late: int = 0) -> DataFrame:
    """`statuses`, with a row `watchdog` where a task is ended for idleness. events: task, at (in seconds), event.

    A stream's watchdog is a timer on event time: it acts when the watermark, `late` seconds behind the latest event, has passed a
    task's last activity by more than `idle`, without any row for the task. Of a table the time is the same: the latest event of
    all, less `late`. A table's rows pass by in order, with one task's state held; a task's events of one micro-batch meet. Of events
    of one second a start comes first, the others by name.
    """
    events = events.selectExpr("cast(task as string) task", "cast(at as long) at", "event")
    if not events.isStreaming:
        now = events.agg(F.max("at") - late).first()[0]

        def in_order(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            task, status, last = None, "queued", 0
            for pdf in batches:
                out = []
                for name, at, event in pdf[["task", "at", "event"]].itertuples(index=False, name=None):
                    if name != task:
                        if task is not None:
                            out += [(task, *x) for x in watched([], status, last, idle, now)[0]]
                        task, status, last = name, "queued", 0
                    found, status, last = watched([(int(at), event)], status, last, idle, None)
                    out += [(task, *x) for x in found]
                yield pd.DataFrame(out, columns=["task", "at", "event", "status", "applied"])
            if task is not None:
                yield _frame(task, watched([], status, last, idle, now)[0])

        return events.where("task is not null and at is not null").repartition("task").sortWithinPartitions("task", "at", F.expr("event is distinct from 'start'"), "event").mapInPandas(in_order, STATUS)

    def stream(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        status, last = state.get if state.exists else ("queued", 0)
        if state.hasTimedOut:
            out, status, last = watched([], status, last, idle, last + idle + 1)
        else:
            pdf = pd.concat(list(batches))
            pdf = pdf.assign(later=pdf["event"] != "start").sort_values(["at", "later", "event"], kind="stable")
            out, status, last = watched([(int(at), event) for at, event in pdf[["at", "event"]].itertuples(index=False, name=None)], status, last, idle, None)
            if status in ("running", "cancelling") and (last + idle) * 1000 <= state.getCurrentWatermarkMs():
                more, status, last = watched([], status, last, idle, last + idle + 1)
                out += more
        state.update((status, last))
        if status in ("running", "cancelling"):
            state.setTimeoutTimestamp((last + idle) * 1000 + 1)
        yield _frame(key[0], out)

    timed = events.where("task is not null and at is not null").withColumn("at_", F.timestamp_seconds("at")).withWatermark("at_", f"{late} seconds")
    return timed.groupBy("task").applyInPandasWithState(stream, STATUS, "status string, last long", "append", "EventTimeTimeout")


REUSED = "key string, at long, request long, task long, reused boolean"


def reused(requests: DataFrame) -> DataFrame:
    """key, at, request, task, reused of each request: a task that is still active for its key is taken again, else the request starts
    one of its own number. requests (key, at, request, event): event is submit, or done, which ends the key's active task.

    Of a table, rows pass by in order; of a stream, the state of a key is its active task, and goes when that is done.
    """
    rows = requests.selectExpr("cast(key as string) key", "cast(at as long) at", "cast(request as long) request", "event").where("key is not null")

    def after(found: list[tuple], task: int | None) -> tuple[list[tuple], int | None]:
        out = []
        for key, at, request, event in found:
            if event == "submit":
                out.append((key, at, request, request if task is None else task, task is not None))
                task = out[-1][3]
            elif event == "done":
                task = None
        return out, task

    names = [x.split()[0] for x in REUSED.split(", ")]
    columns = ["key", "at", "request", "event"]

    def in_order(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, task = None, None
        for pdf in batches:
            out = []
            for row in pdf[columns].itertuples(index=False, name=None):
                if row[0] != last:
                    last, task = row[0], None
                found, task = after([row], task)
                out += found
            yield pd.DataFrame(out, columns=names)

    def stream(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(batches)).sort_values(["at", "request"], kind="stable").assign(key=key[0])
        out, task = after(list(pdf[columns].itertuples(index=False, name=None)), state.get[0] if state.exists else None)
        if task is not None:
            state.update((task,))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=names)

    if not rows.isStreaming:
        return rows.repartition("key").sortWithinPartitions("key", "at", "request").mapInPandas(in_order, REUSED)
    return rows.groupBy("key").applyInPandasWithState(stream, REUSED, "task long", "append", "NoTimeout")


def statuses(events: DataFrame) -> DataFrame:
    """task, at, event, status, applied of each event (task, at in seconds, event) of a table or a stream, in order of time."""
    events = events.selectExpr("cast(task as string) task", "cast(at as long) at", "event")

    def batch(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return _frame(key[0], folded(list(pdf.sort_values("at", kind="stable")[["at", "event"]].itertuples(index=False, name=None)))[0])

    def stream(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        status, last = state.get if state.exists else ("queued", 0)
        pdf = pd.concat(list(batches)).sort_values("at", kind="stable")
        out, status, last = folded(list(pdf[["at", "event"]].itertuples(index=False, name=None)), status, last)
        state.update((status, last))
        yield _frame(key[0], out)

    if not events.isStreaming:
        return events.groupBy("task").applyInPandas(batch, STATUS)
    return events.groupBy("task").applyInPandasWithState(stream, STATUS, "status string, last long", "append", "NoTimeout")
