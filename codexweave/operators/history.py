"""Histories of jobs: events, and jobs that left only a status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codexweave.functions import text as T
from codexweave.operators import library

#: Formats of recorded_at. Fixed values.
TIME_FORMATS = ("yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy/MM/dd'T'HH:mm:ss", "yyyy/MM/dd HH:mm:ss", "yyyy/MM/dd HH:mm", "yyyy-MM-dd HH:mm", "yyyyMMddHHmmss", "dd.MM.yyyy HH:mm:ss", "yyyy年MM月dd日 HH:mm:ss", "yyyy年MM月dd日 HH时mm分ss秒")


def recorded_time(text: Column) -> Column:
    """The time in whichever known format it is written, else null."""
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)).cast("timestamp_ntz") for f in TIME_FORMATS])


def processing_history(history: DataFrame, job_status: DataFrame, redact: bool = True) -> DataFrame:
    """``job_key, event, status, source_pdf, processed_pages, recorded, is_backfill``.

    Distinct events, and for each job without any one row made of its last status. Paths are
    cut to their last part unless ``redact`` is off. Unordered; sort by recorded, job_key.
    """
    events = history.select(
        "job_key", "event", "status", "source_pdf", F.col("processed_pages"), recorded_time(F.col("recorded_at")).alias("recorded"), F.lit(False).alias("is_backfill")
    ).distinct()
    silent = library.latest_status(job_status).join(history.select("job_key"), "job_key", "left_anti")
    made = silent.select("job_key", F.lit("backfill").alias("event"), "status", "source_pdf", "processed_pages", F.col("updated_at").alias("recorded"), F.lit(True).alias("is_backfill"))
    rows = events.unionByName(made)
    return rows.withColumn("source_pdf", T.base_name(F.col("source_pdf"))) if redact else rows


#: Columns that are paths, of which only the last part is shown. Fixed values.
PATHS = ("source_pdf", "job_dir", "quality_path", "audit_path")
COUNTS = {"target_pages": "target_pages", "processed_pages": "output_pages", "text_pages": "text_pages", "blank_pages": "blank_pages", "low_confidence_pages": "low_confidence_pages", "failed_pages": "failed_pages"}


def redacted(rows: DataFrame) -> DataFrame:
    """``rows`` with each path cut to its last part; null and empty ones stay."""
    return rows.withColumns({c: T.base_name(F.col(c)) for c in PATHS if c in rows.columns})


def snapshot_events(job_status: DataFrame, quality: DataFrame) -> DataFrame:
    """An event ``backfill`` of each job's last status; counts it lacks or has 0 of come from its quality file."""
    order = F.struct("updated_at", "snapshot_id")
    engines = job_status.where("job_key IS NOT NULL").groupBy("job_key").agg(F.max_by("engine", order).alias("engine"))
    best = quality.where("job_key IS NOT NULL").groupBy("job_key").agg(F.max(F.struct("written_at", "quality_id", *[F.col(q).alias(f"q_{c}") for c, q in COUNTS.items()], F.col("engine").alias("q_engine"))).alias("q"))
    rows = library.latest_status(job_status).join(engines, "job_key").join(best.select("job_key", "q.*"), "job_key", "left")
    count = lambda c: F.coalesce(F.nullif(F.col(c), F.lit(0)), F.nullif(F.col(f"q_{c}"), F.lit(0)), F.col(c), F.col(f"q_{c}")).alias(c)
    return rows.select(
        F.lit("backfill").alias("event"), F.lit(None).cast("string").alias("run_id"), "job_key", "job_dir", "source_pdf", F.coalesce("status", F.lit("未知")).alias("status"), "mode",
        F.coalesce(F.nullif(F.col("engine"), F.lit("")), "q_engine").alias("engine"), *[count(c) for c in COUNTS], F.col("updated_at").alias("recorded"),
    )


def collected_history(history: DataFrame, job_status: DataFrame, quality: DataFrame, source: str | None = None, status: str | None = None, most: int = 500, redact: bool = True) -> DataFrame:
    """The latest ``most`` records of events and of jobs without any, newest first; ``most`` 0 gives all.

    ``source`` keeps records whose path holds it or ends in the same file name, in either
    case; ``status`` keeps exactly that state. Ties are ordered by job, event and run.
    """
    columns = ["event", "run_id", "job_key", "job_dir", "source_pdf", "status", "mode", "engine", *COUNTS, "recorded"]
    events = history.withColumn("recorded", recorded_time(F.col("recorded_at"))).select(*columns).distinct()
    silent = snapshot_events(job_status, quality).join(history.select("job_key"), "job_key", "left_anti").select(*columns)
    rows = events.unionByName(silent)
    if source:
        name = source.replace("\\", "/").rsplit("/", 1)[-1].lower()
        path = F.lower(F.coalesce("source_pdf", F.lit("")))
        rows = rows.where(path.contains(source.lower()) | (T.base_name(path) == name))
    if status:
        rows = rows.where(F.col("status") == status)
    rows = rows.orderBy(F.desc_nulls_last("recorded"), "job_key", "event", "run_id", "processed_pages", "status")
    rows = rows.limit(most) if most > 0 else rows
    return redacted(rows) if redact else rows


def event_counts(history: DataFrame) -> DataFrame:
    """``event, n, last_job``: distinct events by kind and the job of the latest."""
    rows = history.select("event_no", "event", "job_key").distinct()
    return rows.groupBy("event").agg(F.count("*").alias("n"), F.max_by("job_key", "event_no").alias("last_job"))
