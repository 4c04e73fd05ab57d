"""Stateful stream operators: the sliding rate limit.

A request is admitted if fewer than `limit` admitted requests of its key lie in the last `seconds`; what is refused doesn't
count. That is no window count, so the times of a key's admitted requests are its state, at most `limit` of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions.columns import strip

LIMITED = "key string, at_us long, id long, admitted boolean"


def admit(times: list[int], at: int, limit: int, span: int) -> tuple[list[int], bool]:
    """The admitted times after a request, and whether it is admitted. A time `span` ago still counts."""
    kept = [t for t in times if t >= at - span]
    return (kept, False) if len(kept) >= limit else ([*kept, at], True)


def user_key(name: Column) -> Column:
    """The key of a login name: without white space around it, in lower case."""
    return F.lower(strip(name))


def rate_limited(stream: DataFrame, key: str, at: str, ident: str, limit: int, seconds: int, late: str | None = None) -> DataFrame:
    """key, at_us, id, admitted of each request of a stream (or of a table, as one batch), by event time within each batch.

    With `late` (as "10 seconds"), a stream's requests that come later than that are left out, and the state of a key is dropped
    once no request can fall within `seconds` of its last admitted one; so state doesn't grow with the number of keys ever seen.
    """
    span = seconds * 1_000_000
    if late and stream.isStreaming:
        stream = stream.withColumn("at_", F.col(at).cast("timestamp")).withWatermark("at_", late)
        rows = stream.select(F.col(key).cast("string").alias("key"), F.unix_micros("at_").alias("at_us"), F.col(ident).cast("long").alias("id"), "at_")
        return rows.groupBy("key").applyInPandasWithState(_pruning(limit, span), LIMITED, "times array<long>", "append", "EventTimeTimeout")
    rows = stream.select(F.col(key).cast("string").alias("key"), F.unix_micros(F.col(at).cast("timestamp")).alias("at_us"), F.col(ident).cast("long").alias("id"))

    def run(found: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        out, times = _admitted(found[0], batches, state, limit, span)
        state.update((times,))
        yield out

    if not rows.isStreaming:  # a key's rows come one after the other, so a batch of them and its few times are all that is held
        return rows.repartition("key").sortWithinPartitions("key", "at_us", "id").mapInPandas(_in_order(limit, span), LIMITED)
    return rows.groupBy("key").applyInPandasWithState(run, LIMITED, "times array<long>", "append", "NoTimeout")


def _admitted(key: str, batches: Iterator[pd.DataFrame], state, limit: int, span: int) -> tuple[pd.DataFrame, list[int]]:
    """A key's requests of one micro-batch, judged, and the admitted times after them."""
    times = list(state.get[0]) if state.exists else []
    pdf = pd.concat(list(batches)).sort_values(["at_us", "id"])
    out = []
    for t in pdf["at_us"]:
        times, ok = admit(times, int(t), limit, span)
        out.append(ok)
    return pdf.assign(key=key, admitted=out)[["key", "at_us", "id", "admitted"]], times


def _pruning(limit: int, span: int):
    def run(found: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        out, times = _admitted(found[0], batches, state, limit, span)
        expires, now = (max(times, default=0) + span) // 1000 + 1, state.getCurrentWatermarkMs()
        if times and expires > now:
            state.update((times,))
            state.setTimeoutTimestamp(expires)
        elif state.exists:
            state.remove()
        yield out

    return run


def _in_order(limit: int, span: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, times = object(), []
        for pdf in batches:
            out = []
            for key, at in zip(pdf["key"], pdf["at_us"], strict=True):
                if key != last:
                    last, times = key, []
                times, ok = admit(times, int(at), limit, span)
                out.append(ok)
            yield pdf.assign(admitted=out)[["key", "at_us", "id", "admitted"]]

    return run
