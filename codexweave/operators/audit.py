"""What is missing from or doubtful about a job's pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codexweave.functions import text as T
from codexweave.operators import library, reports
from codexweave.operators import pages as P


def missing_pages(pages: DataFrame, job_status: DataFrame) -> DataFrame:
    """``job_key, page_number``: pages from 1 to the job's target that were never read.

    The range is made next to the job's row and joined by job and page, so a job of any size
    is spread over all partitions.
    """
    targets = library.latest_status(job_status).where("target_pages > 0").select("job_key", "target_pages")
    wanted = targets.select("job_key", F.explode(F.sequence(F.lit(1), F.col("target_pages"))).alias("page_number"))
    return wanted.join(pages.select("job_key", "page_number"), ["job_key", "page_number"], "left_anti")


def page_counters(pages: DataFrame) -> DataFrame:
    """Counters of each job's distinct pages: read, with text, blank, failed, low confidence, characters."""
    empty = T.stripped(F.coalesce("text", F.lit(""))) == ""
    blank = F.coalesce(F.col("source") == "blank_page", F.lit(False))
    failed = F.exists(F.coalesce("warnings", F.array().cast("array<string>")), lambda w: w.startswith("识别过程出错"))
    low = ~blank & (F.coalesce("confidence", F.lit(0.0)) < P.LOW_CONFIDENCE)
    flags = P.known_pages(pages).select("page_id", "job_key", empty.alias("empty"), blank.alias("blank"), failed.alias("failed"), low.alias("low"), F.length("text").alias("chars"))
    return P.one_row_each(flags).groupBy("job_key").agg(
        F.count("*").alias("n_pages"),
        F.count_if(~F.col("empty")).alias("text_pages"),
        F.count_if("blank").alias("blank_pages"),
        F.count_if("failed").alias("failed_pages"),
        F.count_if("low").alias("low_confidence_pages"),
        F.coalesce(F.sum("chars"), F.lit(0)).alias("n_chars"),
    )


def issue_pages(pages: DataFrame) -> DataFrame:
    """``job_key, page_id, page_number, problems``: pages with at least one problem, in fixed order."""
    empty = T.stripped(F.coalesce("text", F.lit(""))) == ""
    blank = F.coalesce(F.col("source") == "blank_page", F.lit(False))
    featured = P.with_features(P.known_pages(pages).select("job_key", "page_id", "page_number", "text", "confidence", "source"))
    low = ~blank & (F.coalesce("confidence", F.lit(0.0)) < P.LOW_CONFIDENCE) & ~F.col("is_dense_index")
    problems = F.array_compact(
        F.array(
            F.when(low, F.lit("low_confidence")),
            F.when(~blank & empty, F.lit("no_text")),
            F.when(F.col("is_diagram") & (F.col("n_noise_lines") >= 2), F.lit("diagram_noise")),
            F.when(F.col("is_illustration"), F.lit("illustration")),
        )
    )
    return P.one_row_each(featured.select("job_key", "page_id", "page_number", problems.alias("problems"))).where(F.size("problems") > 0)


def job_audit(pages: DataFrame, job_status: DataFrame) -> DataFrame:
    """One row per job: counters of its pages, and how many are missing and doubtful, with the first of each."""
    missing = missing_pages(pages, job_status).groupBy("job_key").agg(F.count("*").alias("n_missing"), F.min("page_number").alias("first_missing"))
    issues = issue_pages(pages)
    least = issues.groupBy("job_key").agg(F.count("*").alias("n_issues"), F.min("page_number").alias("first_issue"))
    kinds = issues.select("job_key", F.explode("problems").alias("problem")).groupBy("job_key").pivot("problem", ["low_confidence", "no_text", "diagram_noise", "illustration"]).count()
    rows = page_counters(pages).join(missing, "job_key", "left").join(least, "job_key", "left").join(kinds, "job_key", "left")
    return rows.fillna(0, ["n_missing", "n_issues", "low_confidence", "no_text", "diagram_noise", "illustration"])


def job_evidence(pages: DataFrame, job_status: DataFrame, quality: DataFrame, now) -> DataFrame:
    """The counts that ``reports.iteration_plans`` judges a job by, at ``now``; one row per job with a status.

    Doubtful pages are protected where they are those of a dense index. Of pages only flags
    are shuffled.
    """
    empty = T.stripped(F.coalesce("text", F.lit(""))) == ""
    blank = F.coalesce(F.col("source") == "blank_page", F.lit(False))
    low = ~blank & (F.coalesce("confidence", F.lit(0.0)) < P.LOW_CONFIDENCE)
    featured = P.with_features(P.known_pages(pages).select("job_key", "page_id", "page_number", "text", "confidence", "source"))
    flags = P.one_row_each(featured.select(
        "job_key", "page_id", low.alias("low"), (low & F.col("is_dense_index")).alias("protected"), (~blank & empty).alias("empty"),
        (F.col("is_diagram") & (F.col("n_noise_lines") >= 2)).alias("residual"), F.col("is_illustration").alias("illustration"),
    ))
    counts = flags.groupBy("job_key").agg(
        F.count_if("low").alias("low_confidence_pages"), F.count_if("protected").alias("protected_pages"), F.count_if("empty").alias("blank_pages"),
        F.count_if("residual").alias("residual_pages"), F.count_if("illustration").alias("illustration_pages"),
    )
    missing = missing_pages(pages, job_status).groupBy("job_key").agg(F.count("*").alias("unchecked_pages"))
    audited = quality.where("job_key IS NOT NULL").select("job_key").distinct().withColumn("has_audit", F.lit(True))
    jobs = reports.job_reports(job_status, quality, now).select("job_key", "state", "is_stalled", "target_pages", "processed_pages")
    rows = jobs.join(counts, "job_key", "left").join(missing, "job_key", "left").join(audited, "job_key", "left")
    unknown = F.lit(None).cast("double")
    return rows.select("*", F.lit(0).alias("refreshable_pages"), unknown.alias("cpu_percent"), unknown.alias("memory_percent"))


def refreshed_pages(pages: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """``job_key, page_id, page_number, text_changes, warnings_change, notes`` of pages that today's rules would change."""
    rows = P.distinct_pages(pages)
    new = P.prepared(rows, rules).select("page_id", F.col("text").alias("new_text"), F.col("warnings").alias("new_warnings"), "notes")
    met = rows.select("job_key", "page_id", "page_number", F.coalesce("text", F.lit("")).alias("old_text"), F.coalesce("warnings", F.array().cast("array<string>")).alias("old_warnings")).join(new, "page_id")
    told = met.select("job_key", "page_id", "page_number", (F.col("new_text") != F.col("old_text")).alias("text_changes"), (F.col("new_warnings") != F.col("old_warnings")).alias("warnings_change"), "notes")
    return told.where("text_changes OR warnings_change")


def quality_audit(pages: DataFrame, job_status: DataFrame, rules: DataFrame | None = None, samples: int = 20) -> DataFrame:
    """``job_audit`` with what today's rules would change: pages by what is done to them, with their first sample numbers.

    Adds refreshable and warning_refreshable pages, one count for each of NOTES, and sorted
    samples of missing, doubtful and refreshable pages; ``advice`` tells what to do first.
    """
    changed = refreshed_pages(pages, rules)
    notes = [F.count_if(F.array_contains("notes", n)).alias(n) for n in P.NOTES]
    counts = changed.groupBy("job_key").agg(F.count_if("text_changes").alias("refreshable"), F.count_if(~F.col("text_changes")).alias("warning_refreshable"), *notes)
    rows = job_audit(pages, job_status).join(counts, "job_key", "left")
    taken = {"missing_sample": missing_pages(pages, job_status), "issue_sample": issue_pages(pages), "refreshable_sample": changed.where("text_changes")}
    for name, of in taken.items():
        rows = rows.join(reports.sampled(of, "job_key", "page_number", name, samples), "job_key", "left")
    rows = rows.fillna(0, ["refreshable", "warning_refreshable", *P.NOTES])
    advice = F.array_compact(F.array(
        F.when(F.col("n_missing") > 0, "complete"), F.when(F.col("refreshable") > 0, "refresh"), F.when(F.col("warning_refreshable") > 0, "refresh warnings"),
        F.when(F.col("low_confidence") > 0, "review"), F.when(F.col("diagram_noise") > 0, "add rules"),
    ))
    return rows.withColumn("advice", F.when(F.size(advice) > 0, F.array_join(advice, ",")).otherwise("none"))
