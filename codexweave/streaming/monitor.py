"""Monitors of running jobs as streams of heartbeats.

State is one small row per job; a job that falls silent is told by a timer, not by a scan.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from codexweave.operators.rates import REPLAY_PAGES, REPLAY_RATE

RATES = "job_key string, pages long, seconds double, seconds_per_page double, resets int"
SILENT_SECONDS, KEPT_SAMPLES, KEPT_SECONDS = 90, 12, 300.0


def _rate(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    pid, done, at, resets, samples = state.get if state.exists else (None, None, None, 0, [])
    samples = [tuple(s) for s in samples]
    for batch in batches:
        for r in batch.sort_values("ts").itertuples():
            now = r.ts.timestamp()
            if done is None or r.pid != pid or r.pages < done or now < at:
                resets, samples = resets + (done is not None), []
            elif r.pages > done:
                pages, seconds = r.pages - done, now - at
                if seconds > 0 and not (pages >= REPLAY_PAGES and pages * 60 / seconds >= REPLAY_RATE):
                    samples.append((now, float(pages), seconds))
            else:
                continue  # no progress: the clock of the next page goes on
            pid, done, at = r.pid, int(r.pages), now
    if at is not None:
        samples = [s for s in samples if s[0] >= at - KEPT_SECONDS][-KEPT_SAMPLES:]
        state.update((pid, done, at, resets, samples))
    pages, seconds = sum(s[1] for s in samples), sum(s[2] for s in samples)
    yield pd.DataFrame([(key[0], int(pages), seconds, round(seconds / pages, 2) if pages else None, resets)], columns=["job_key", "pages", "seconds", "seconds_per_page", "resets"])


def page_rates(heartbeats: DataFrame) -> DataFrame:
    """RATES of each job that got heartbeats in a batch, from its last samples of real progress.

    ``heartbeats`` has job_key, pid, pages and ts. A new process, or pages or time going back,
    starts a new series; deltas too fast to be read pages are left out.
    """
    state = "pid long, done long, at double, resets int, samples array<struct<at:double,pages:double,seconds:double>>"
    columns = heartbeats.select("job_key", F.col("pid").cast("long"), F.col("pages").cast("long"), "ts")
    return columns.groupBy("job_key").applyInPandasWithState(_rate, RATES, state, "update", GroupStateTimeout.NoTimeout)


def _alive(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut:
        (last,) = state.get
        state.remove()
        yield pd.DataFrame([(key[0], last, "silent")], columns=["job_key", "last_ts", "state"])
        return
    last = max(batch.ts.max().timestamp() for batch in batches)
    if state.exists:
        last = max(last, state.get[0])
    state.update((last,))
    state.setTimeoutTimestamp(int(last * 1000) + SILENT_SECONDS * 1000)
    yield pd.DataFrame([(key[0], last, "alive")], columns=["job_key", "last_ts", "state"])


def liveness(heartbeats: DataFrame, late: str = "30 seconds") -> DataFrame:
    """``job_key, last_ts, state``: alive with each batch, silent once the watermark is 90 s past the last."""
    marked = heartbeats.select("job_key", "ts").withWatermark("ts", late)
    return marked.groupBy("job_key").applyInPandasWithState(_alive, "job_key string, last_ts double, state string", "last double", "update", GroupStateTimeout.EventTimeTimeout)


def windowed_progress(events: DataFrame, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Pages and failures by time window, closed when the watermark passes; late rows are dropped then."""
    return (
        events.withWatermark("ts", late)
        .groupBy(F.window("ts", window).alias("w"), "event_type")
        .agg(F.count("*").alias("n"), F.sum("value").alias("total"))
        .select(F.col("w.start").alias("window_start"), "event_type", "n", "total")
    )
