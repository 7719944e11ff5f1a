"""Page rates, throughput windows, stalls and latest states over snapshots and events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A delta of so many pages at so many a minute comes from a cache, not from reading.
REPLAY_PAGES, REPLAY_RATE = 8, 10.0
WINDOW = 12


def page_deltas(job_status: DataFrame) -> DataFrame:
    """``job_key, series, updated_at, pages, seconds, is_replay``: progress between snapshots.

    A new series begins where processed_pages or the clock goes back. The first snapshot of a
    series has no delta; re-delivered snapshots count once.
    """
    rows = job_status.select("job_key", "snapshot_id", "processed_pages", "updated_at").where("updated_at IS NOT NULL AND processed_pages IS NOT NULL").dropDuplicates(["job_key", "snapshot_id"])
    order = Window.partitionBy("job_key").orderBy("snapshot_id")
    before, then = F.lag("processed_pages").over(order), F.lag("updated_at").over(order)
    moved = rows.withColumn("pages", F.col("processed_pages") - before).withColumn("seconds", F.timestamp_diff("SECOND", then, F.col("updated_at")))
    back = F.coalesce((F.col("pages") < 0) | (F.col("seconds") < 0), F.lit(True))
    series = moved.withColumn("series", F.sum(back.cast("int")).over(order)).where(~back)
    fast = (F.col("pages") >= REPLAY_PAGES) & (F.col("seconds") > 0) & (F.col("pages") * 60.0 / F.col("seconds") >= REPLAY_RATE)
    return series.select("job_key", "series", "snapshot_id", "updated_at", "pages", "seconds", fast.alias("is_replay"))


def page_rates(deltas: DataFrame) -> DataFrame:
    """``job_key, series, pages, seconds, seconds_per_page, pages_per_minute`` of real progress."""
    real = deltas.where("pages > 0 AND seconds > 0 AND NOT is_replay")
    sums = real.groupBy("job_key", "series").agg(F.sum("pages").alias("pages"), F.sum("seconds").alias("seconds"))
    each = F.bround(F.col("seconds") / F.col("pages"), 2)
    return sums.select("job_key", "series", "pages", "seconds", each.alias("seconds_per_page"), F.bround(60 / each, 3).alias("pages_per_minute"))


def short_window(durations: DataFrame, key: str, order: str, seconds: str, size: int = WINDOW) -> DataFrame:
    """Median of the last ``size`` durations up to each row, at least 0.001, and pages a minute."""
    frame = Window.partitionBy(key).orderBy(order).rowsBetween(1 - size, 0)
    rows = durations.select(key, order, seconds, F.array_sort(F.collect_list(seconds).over(frame)).alias("_held"))
    n = F.size("_held")
    middle = (F.get("_held", ((n - 1) / 2).cast("int")) + F.get("_held", (n / 2).cast("int"))) / 2
    median = F.when(n > 0, F.greatest(middle, F.lit(0.001)))  # greatest skips nulls
    return rows.select(key, order, seconds, n.cast("long").alias("n"), median.alias("median_seconds"), F.round(60 / median, 3).alias("pages_per_minute"))


def stalls(job_status: DataFrame, now: Column, running: tuple[str, ...], limit_seconds: int = 600) -> DataFrame:
    """``job_key, age_seconds, is_stalled``: running, unfinished jobs silent for too long at ``now``."""
    last = job_status.groupBy("job_key").agg(
        F.max_by("status", F.struct("updated_at", "snapshot_id")).alias("status"),
        F.max("updated_at").alias("updated_at"),
        F.max_by(F.struct("processed_pages", "target_pages"), F.struct("updated_at", "snapshot_id")).alias("p"),
    )
    age = F.timestamp_diff("SECOND", F.col("updated_at"), now)
    open_ = F.coalesce(F.col("p.processed_pages") < F.col("p.target_pages"), F.lit(True))
    return last.where(F.col("status").isin(*running)).select("job_key", age.alias("age_seconds"), (open_ & (age >= limit_seconds)).alias("is_stalled"))


def latest_states(events: DataFrame, key: str, order: list[str], state: Column, absorbing: Column) -> DataFrame:
    """``key, state, n_events``: the last state of each key; an absorbing one, once met, stays."""
    at = F.struct(*order)
    return events.groupBy(key).agg(
        F.coalesce(F.max(F.when(absorbing, state)), F.max_by(state, at)).alias("state"), F.count("*").alias("n_events")
    )


def after_cursor(events: DataFrame, cursor: int, limit: int, column: str = "event_id") -> DataFrame:
    """The next ``limit`` events after a cursor, in order: a page of a feed."""
    return events.where(F.col(column) > cursor).orderBy(column).limit(limit)


def progress(latest: DataFrame) -> DataFrame:
    """Adds progress in percent, seconds per page and seconds left to rows of counters.

    Needs target_pages, processed_pages, elapsed_seconds and avg_seconds_per_page; unknown
    stays null, a missing average is taken from elapsed time.
    """
    done, target = F.coalesce("processed_pages", F.lit(0)), F.coalesce("target_pages", F.lit(0))
    speed = F.bround(F.coalesce(F.col("avg_seconds_per_page"), F.when(done > 0, F.col("elapsed_seconds") / done)), 2)
    return latest.select(
        "*",
        F.when(target > 0, F.bround(done * 100.0 / target, 1)).otherwise(0.0).alias("progress_percent"),
        speed.alias("seconds_per_page"),
        F.bround(speed * F.greatest(target - done, F.lit(0))).cast("long").alias("seconds_left"),
    )
