"""Problem 1: lines that repeat across the pages of one source.

Lines are hashed where they are read; only (source hash, line hash, page_id) triples are
shuffled to count, never texts. The frequent lines of a source are few by the threshold
itself (a share of 15 % leaves at most lines-per-page / 0.15 of them), so they come back
to the pages as one short array per source.

A source, or a single line, may hold any share of the rows: the count of distinct pages is
spread over (source, line, page) first, and only partial counts meet at (source, line).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codexweave.llm.common import job_value, lines_of, squeezed
from codexweave.sources.tables import materialised

MIN_PAGES = 8
MIN_SHARE_PERCENT = 15


def frequent_hashes(pages: DataFrame, job_status: DataFrame, min_pages: int = MIN_PAGES, min_share_percent: int = MIN_SHARE_PERCENT) -> DataFrame:
    """``source_hash, line_hash, n_pages, source_pages, sample_page`` of the frequent lines.

    Distinct page_ids count, so re-delivered rows change nothing. Null and blank texts add
    no lines and do not enter the share's denominator; pages of jobs without a source are
    left out. ``sample_page`` is the least page_id with the line. 64-bit hashes are compared
    within one source only.
    """
    lines = pages.where(F.col("page_id").isNotNull()).select(
        "job_key", "page_id", F.array_distinct(F.transform(lines_of(F.col("text")), lambda line: F.xxhash64(line))).alias("hashes")
    )
    sources = job_value(job_status, "source_pdf").select("job_key", F.xxhash64("source_pdf").alias("source_hash"))
    hashed = lines.where(F.size("hashes") > 0).join(sources, "job_key").select("source_hash", "page_id", "hashes")
    counted = (
        hashed.select("source_hash", "page_id", F.explode("hashes").alias("line_hash"))
        .groupBy("source_hash", "line_hash")
        .agg(F.count_distinct("page_id").alias("n_pages"), F.min("page_id").alias("sample_page"))
        .where(F.col("n_pages") >= min_pages)
    )
    sizes = hashed.groupBy("source_hash").agg(F.count_distinct("page_id").alias("source_pages"))
    enough = F.col("n_pages") * 100 >= F.col("source_pages") * min_share_percent
    return counted.join(sizes, "source_hash").where(enough)


def repeated_lines(pages: DataFrame, job_status: DataFrame, min_pages: int = MIN_PAGES, min_share_percent: int = MIN_SHARE_PERCENT) -> DataFrame:
    """``source_pdf, line``: lines on at least ``min_pages`` pages and that share of a source.

    A line is the text between newlines, trimmed, each run of Unicode white space made one
    space; empty lines do not count. Texts are read a second time for the sample pages only.
    """
    frequent = frequent_hashes(pages, job_status, min_pages, min_share_percent)
    samples = frequent.groupBy("sample_page").agg(F.collect_set("line_hash").alias("wanted"))
    texts = pages.select("job_key", "page_id", "text").join(samples, F.col("page_id") == F.col("sample_page"))
    lines = texts.select("job_key", F.explode(F.array_distinct(F.filter(lines_of(F.col("text")), lambda line: F.array_contains("wanted", F.xxhash64(line))))).alias("line"))
    return lines.join(job_value(job_status, "source_pdf"), "job_key").select("source_pdf", "line").distinct()


def without_repeated_lines(pages: DataFrame, job_status: DataFrame, min_pages: int = MIN_PAGES, min_share_percent: int = MIN_SHARE_PERCENT) -> DataFrame:
    """``page_id, source_pdf, text, n_removed``: each page's text without its source's repeated lines.

    One row per page_id (re-delivered rows hold the same text); the other lines stay as
    stored. A null text stays null; pages of jobs without a source keep their text.
    """
    drops = (
        frequent_hashes(pages, job_status, min_pages, min_share_percent)
        .groupBy("source_hash")
        .agg(F.collect_set("line_hash").alias("drop"))
    )
    jobs = job_value(job_status, "source_pdf").withColumn("source_hash", F.xxhash64("source_pdf"))
    jobs = materialised(jobs.join(drops, "source_hash", "left").select("job_key", "source_pdf", "drop"), "repeated-lines")
    sourced = pages.where(F.col("page_id").isNotNull()).select("page_id", "job_key", "text").join(jobs, "job_key", "left")
    raw = F.split("text", "\n")
    kept = F.filter(raw, lambda line: ~F.coalesce(F.array_contains("drop", F.xxhash64(squeezed(line))), F.lit(False)))
    cleaned = F.when(F.col("drop").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    removed = F.when(F.col("drop").isNull() | F.col("text").isNull(), F.lit(0)).otherwise(F.size(raw) - F.size(kept))
    return sourced.select("page_id", "source_pdf", cleaned.alias("text"), removed.cast("int").alias("n_removed")).dropDuplicates(["page_id"])
