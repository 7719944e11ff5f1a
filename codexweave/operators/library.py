"""Versions of a book, the library's catalogue and the knowledge-base index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codexweave.functions import text as T

#: Spellings of the states of a job, by the state meant. Fixed values.
DONE_SPELLINGS = ("完成", "已完成", "done", "complete", "completed", "finished", "ok")


def is_done(status: Column) -> Column:
    return F.coalesce(F.lower(T.stripped(status)).isin(*DONE_SPELLINGS), F.lit(False))


def latest_status(job_status: DataFrame) -> DataFrame:
    """One row per job: its last snapshot (updated_at, then snapshot_id), with gaps filled.

    source_pdf, mode and total_pages never change within a job, so nulls in the last snapshot
    are taken from the others.
    """
    order = F.struct("updated_at", "snapshot_id")
    steady = ("source_pdf", "mode", "total_pages")
    last = [F.max_by(c, order).alias(c) for c in ("status", "job_dir", "target_pages", "processed_pages", "text_pages", "blank_pages", "failed_pages", "low_confidence_pages", "is_sample", "updated_at")]
    rows = job_status.where(F.col("job_key").isNotNull())
    return rows.groupBy("job_key").agg(*last, *[F.min(c).alias(c) for c in steady])


def candidates(job_status: DataFrame, quality: DataFrame) -> DataFrame:
    """Each job's last status with ``reason``: why it cannot stand for its source, or null."""
    totals = quality.groupBy("job_key").agg(F.max("total_pages").alias("quality_total"), _sampled(quality))
    jobs = latest_status(job_status).join(totals, "job_key", "left")
    total = known_total(F.col("total_pages"), F.col("quality_total"))
    part = F.coalesce(F.nullif(F.col("target_pages"), F.lit(0)) < total, F.lit(False))
    sample = F.coalesce("is_sample", F.lit(False)) | F.coalesce("quality_sample", F.lit(False)) | part
    reason = (
        F.when(~is_done(F.col("status")), "not done")
        .when(sample, "sample")
        .when(F.coalesce(F.col("processed_pages") < total, F.lit(False)), "incomplete")
    )
    return jobs.withColumn("reason", reason)


def _sampled(quality: DataFrame) -> Column:
    return (F.max("is_sample") if "is_sample" in quality.columns else F.lit(None).cast("boolean")).alias("quality_sample")


def known_total(status_total: Column, quality_total: Column) -> Column:
    """The number of pages the status tells, else the quality file; 0 tells nothing."""
    return F.coalesce(F.nullif(status_total, F.lit(0)), F.nullif(quality_total, F.lit(0)))


def covers_request(jobs: DataFrame, page_cap: int | None = None) -> Column:
    """Whether a job of ``candidates`` has done what a request for its source asks.

    With a cap on pages: as many pages as that; else the whole source and no sample.
    """
    done = F.coalesce(F.nullif(F.col("processed_pages"), F.lit(0)), F.col("target_pages"), F.lit(0))
    if page_cap:
        return is_done(F.col("status")) & (done >= page_cap)
    total = known_total(F.col("total_pages"), F.col("quality_total"))
    return is_done(F.col("status")) & ~F.coalesce("is_sample", F.lit(False)) & ~F.coalesce(done < total, F.lit(False))


def selected_versions(job_status: DataFrame, quality: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """``job_key, source_pdf, rank, reason``: rank 1 is the version kept of each source.

    The version with most processed, then target pages, then the largest chunk file (``sizes``
    has job_key and size), then the greatest job_dir wins; jobs without a source stand for
    themselves. Losers have the reason ``other version kept``.
    """
    fit = candidates(job_status, quality).where(F.col("reason").isNull())
    fit = fit.withColumn("size", F.lit(0)) if sizes is None else fit.join(sizes.select("job_key", "size"), "job_key", "left")
    key = F.coalesce("source_pdf", "job_dir")
    count = lambda c: F.desc(F.coalesce(c, F.lit(0)))
    order = Window.partitionBy(key).orderBy(count("processed_pages"), count("target_pages"), count("size"), F.desc("job_dir"), "job_key")
    ranked = fit.withColumn("rank", F.row_number().over(order))
    return ranked.select("job_key", "source_pdf", "job_dir", "rank", F.when(F.col("rank") > 1, "other version kept").alias("reason"))


def skipped_versions(job_status: DataFrame, quality: DataFrame) -> DataFrame:
    """``job_key, reason`` of every job that is not kept."""
    unfit = candidates(job_status, quality).where(F.col("reason").isNotNull()).select("job_key", "reason")
    lost = selected_versions(job_status, quality).where("rank > 1").select("job_key", "reason")
    return unfit.unionByName(lost)


def first_chunks(chunks: DataFrame, versions: DataFrame) -> DataFrame:
    """``chunk_id, job_key, source_path, source_page, text``: first of equal chunks of kept versions.

    Chunks are the same if source path, page and text are; the one of the first job by
    job_dir, then by chunk_id and time, is kept. Null texts are chunks with no text. The
    choice is made on digests; texts meet only the rows that were chosen.
    """
    kept = versions.where("rank = 1").select("job_key", "job_dir")
    text = F.coalesce("text", F.lit(""))
    place = F.struct("job_dir", "chunk_id", "created_at", "page_end", "job_key")
    narrow = chunks.select("chunk_id", "job_key", "source_path", "source_page", "created_at", "page_end", F.sha2(text, 256).alias("digest")).join(kept, "job_key")
    first = narrow.groupBy("source_path", "source_page", "digest").agg(F.min(place).alias("p"))
    chosen = first.select("p.chunk_id", "p.job_key", F.col("source_path").alias("_path"), F.col("source_page").alias("_page"), "digest")
    rows = chunks.select("chunk_id", "job_key", "source_path", "source_page", text.alias("text"), F.sha2(text, 256).alias("digest"))
    same = rows["source_path"].eqNullSafe(F.col("_path")) & rows["source_page"].eqNullSafe(F.col("_page"))
    met = rows.join(chosen, ["chunk_id", "job_key", "digest"]).where(same)
    return met.dropDuplicates(["chunk_id", "job_key", "source_path", "source_page", "digest"]).select("chunk_id", "job_key", "source_path", "source_page", "text")


def index_totals(chunks: DataFrame, job_status: DataFrame, quality: DataFrame) -> DataFrame:
    """One row: jobs kept and skipped, chunks, their characters and pages."""
    versions = selected_versions(job_status, quality)
    kept = first_chunks(chunks, versions).agg(
        F.count("*").alias("n_chunks"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n_chars"), F.count_distinct("source_path", "source_page").alias("n_pages")
    )
    jobs = versions.agg(F.count_if(F.col("rank") == 1).alias("n_jobs"))
    skipped = skipped_versions(job_status, quality).agg(F.count("*").alias("n_skipped"))
    return kept.join(jobs).join(skipped)  # three single rows


def catalogue(job_status: DataFrame, quality: DataFrame) -> DataFrame:
    """Every source with the best status of its jobs, numbered through the library by path.

    The number is the place in the folder and the sources of the folders before it, so no
    window gathers the whole library: the second one is over the folders.
    """
    jobs = latest_status(job_status).where(F.col("source_pdf").isNotNull())
    totals = quality.groupBy("job_key").agg(F.max("total_pages").alias("quality_total"))
    rows = jobs.join(totals, "job_key", "left").groupBy("source_pdf").agg(
        F.count("*").alias("n_jobs"),
        F.max(is_done(F.col("status")).cast("int")).alias("done"),
        F.max("processed_pages").alias("processed_pages"),
        F.max(F.coalesce("total_pages", "quality_total")).alias("total_pages"),
    )
    folder = F.regexp_extract("source_pdf", r"^(.*)[/\\]", 1)
    order = Window.partitionBy("folder").orderBy("source_pdf")
    rows = rows.withColumn("folder", folder).withColumn("place", F.row_number().over(order))
    folders = rows.groupBy("folder").agg(F.count("*").alias("n"))
    before = Window.orderBy("folder").rowsBetween(Window.unboundedPreceding, -1)
    offsets = folders.select("folder", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return rows.join(offsets, "folder").select(
        "source_pdf", "folder", T.base_name(F.col("source_pdf")).alias("file_name"), (F.col("base") + F.col("place")).cast("int").alias("number"), "n_jobs", "done", "processed_pages", "total_pages"
    )


def catalogue_counts(catalogued: DataFrame) -> DataFrame:
    """Sources, done ones and those of unknown length, by folder."""
    return catalogued.groupBy("folder").agg(
        F.count("*").alias("n_sources"), F.sum("done").alias("n_done"), F.count_if(F.col("total_pages").isNull()).alias("n_unknown_length")
    )


def library_scan(catalogued: DataFrame, kinds: DataFrame, job_status: DataFrame) -> DataFrame:
    """The catalogue with ``kind`` and ``text_ratio`` of each source: those of its job with most pages; null without any.

    ``kinds`` as from ``classify.document_kinds``. A source whose jobs have no pages stays.
    """
    sources = latest_status(job_status).where("source_pdf IS NOT NULL").select("job_key", "source_pdf")
    best = kinds.join(sources, "job_key").groupBy("source_pdf").agg(F.max_by(F.struct("kind", "text_ratio"), F.struct("n_pages", "job_key")).alias("k"))
    return catalogued.join(best, "source_pdf", "left").select(*catalogued.columns, "k.kind", "k.text_ratio")
