"""Queries on rescued books over the driver's tables, whole tables each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codexweave.functions import text as T
from codexweave.operators import audit, capacity, chunks, classify, history, layout, library, pages, rates, rules
from codexweave.sources import sinks
from codexweave.sources.tables import spread, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
#: The clock of freshness queries. Fixed value.
NOW = "2025-12-31 00:00:00"
RUNNING = ("处理中", "排队", "running", "queued")


def _query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


@_query
def kb_candidates_selected(spark, d):
    return library.selected_versions(table(spark, d, "job_status"), table(spark, d, "quality")).where("rank = 1").select("job_key", "source_pdf")


@_query
def kb_candidates_skipped(spark, d):
    return library.skipped_versions(table(spark, d, "job_status"), table(spark, d, "quality"))


@_query
def kb_chunks_first_wins(spark, d):
    versions = library.selected_versions(table(spark, d, "job_status"), table(spark, d, "quality"))
    return library.first_chunks(table(spark, d, "chunks"), versions)


@_query
def kb_index_totals(spark, d):
    return library.index_totals(table(spark, d, "chunks"), table(spark, d, "job_status"), table(spark, d, "quality"))


@_query
def catalog_status_left_join(spark, d):
    return library.catalogue(table(spark, d, "job_status"), table(spark, d, "quality"))


@_query
def catalog_counts(spark, d):
    return library.catalogue_counts(catalog_status_left_join(spark, d))


@_query
def history_union_antijoin(spark, d):
    rows = history.processing_history(table(spark, d, "history"), table(spark, d, "job_status"))
    return rows.select("job_key", "event", "status", "source_pdf", "processed_pages", "is_backfill")


@_query
def history_event_counts(spark, d):
    return history.event_counts(table(spark, d, "history"))


@_query
def audit_missing_pages(spark, d):
    return audit.missing_pages(table(spark, d, "pages"), table(spark, d, "job_status"))


@_query
def audit_page_counters(spark, d):
    return audit.page_counters(table(spark, d, "pages"))


@_query
def audit_issue_rows(spark, d):
    return audit.issue_pages(table(spark, d, "pages")).select("job_key", "page_id", "page_number", F.array_join("problems", ",").alias("problems"))


@_query
def audit_jobs(spark, d):
    return audit.job_audit(table(spark, d, "pages"), table(spark, d, "job_status"))


@_query
def page_features(spark, d):
    rows = pages.with_features(spread(pages.known_pages(table(spark, d, "pages")).select("page_id", "page_number", "text")))
    return pages.one_row_each(rows.drop("text", "page_number"))


@_query
def page_quality_warnings(spark, d):
    rows = spread(pages.known_pages(table(spark, d, "pages")).select("page_id", "page_number", "text", "confidence", "source"))
    featured = pages.with_features(rows)
    return pages.one_row_each(featured.select("page_id", F.array_join(pages.quality_warnings(featured), ",").alias("warnings")))


@_query
def pages_prepared(spark, d):
    rows = pages.prepared(pages.distinct_pages(table(spark, d, "pages")), table(spark, d, "replacement_rules"))
    return rows.select("page_id", "printed_page", "text", "warnings", "notes")


@_query
def audit_quality(spark, d):
    return audit.quality_audit(table(spark, d, "pages"), table(spark, d, "job_status"), table(spark, d, "replacement_rules"))


@_query
def text_cleanup(spark, d):
    return pages.distinct_pages(table(spark, d, "pages")).select("page_id", T.cleaned_ocr_text(F.col("text")).alias("text"))


@_query
def garble_scores(spark, d):
    rows = spread(pages.known_pages(table(spark, d, "pages")).select("page_id", "text"))
    return pages.one_row_each(rows.select("page_id", T.garble_score(F.col("text")).alias("garble")))


@_query
def document_classification(spark, d):
    scanned = ~F.col("source").isin("pdf_text_layer", "existing_ocr_text_layer")
    rows = spread(pages.known_pages(table(spark, d, "pages")).select("page_id", "job_key", "page_number", "text", "source"))
    told = classify.page_reports(rows, scanned)
    return classify.document_kinds(pages.one_row_each(told))


@_query
def inspection_samples(spark, d):
    jobs = library.latest_status(table(spark, d, "job_status")).where("target_pages IS NOT NULL")
    return jobs.select("job_key", F.explode(classify.sample_positions(F.col("target_pages"), 20)).alias("page_number"))


@_query
def page_sections(spark, d):
    return chunks.sections(pages.distinct_pages(table(spark, d, "pages")), r"^(第\s*\d+\s*章|卷\s*\d+|Chapter \d+\.|Chapitre \d+|\d+\. Kapitel)")


@_query
def page_chunks(spark, d):
    return chunks.chunked(pages.distinct_pages(table(spark, d, "pages")))


@_query
def entry_ranges(spark, d):
    rows = pages.distinct_pages(table(spark, d, "pages")).where("book IS NOT NULL")
    first = F.get(T.filled_lines(F.col("text")), F.lit(0))
    starts = rows.select("book", "page_number", first.alias("title")).where(F.col("title").rlike(r"^(第\s*\d+\s*章|卷\s*\d+|Chapter \d+\.)"))
    starts = starts.groupBy("book", "title").agg(F.min("page_number").alias("first_page"))
    return chunks.entry_ranges(starts, rows.groupBy("book").agg(F.max("page_number").alias("max_page")))


@_query
def glossary_apply(spark, d):
    rows = pages.distinct_pages(table(spark, d, "pages")).select("page_id", "book", "text")
    return rules.apply_rules(rows, table(spark, d, "replacement_rules")).select("page_id", "text", "n_changed")


@_query
def warnings_distinct(spark, d):
    rows = pages.distinct_pages(table(spark, d, "pages")).where("warnings IS NOT NULL")
    return rows.select("page_id", F.array_join(F.array_distinct("warnings"), "|").alias("warnings"))


@_query
def confidence_by_source(spark, d):
    rows = pages.known_pages(table(spark, d, "pages")).select("page_id", "source", "confidence").dropDuplicates(["page_id"])
    return rows.groupBy("source").agg(
        F.count("*").alias("n"), F.round(F.avg("confidence"), 6).alias("mean"), F.round(F.percentile("confidence", F.lit(0.05)), 6).alias("p05"), F.round(F.median("confidence"), 6).alias("p50")
    )


@_query
def page_text_in_reading_order(spark, d):
    rows = pages.distinct_pages(table(spark, d, "pages")).where("blocks IS NOT NULL AND size(blocks) > 0")
    return layout.ordered_texts(rows)


@_query
def page_rate_deltas(spark, d):
    rows = rates.page_deltas(table(spark, d, "job_status"))
    return rows.select("job_key", "snapshot_id", "pages", "seconds", F.coalesce("is_replay", F.lit(False)).alias("is_replay"))


@_query
def page_rate_series(spark, d):
    return rates.page_rates(rates.page_deltas(table(spark, d, "job_status")))


@_query
def throughput_last12_median(spark, d):
    events = table(spark, d, "events").where("event_type = 'view'")
    return rates.short_window(events, "user_id", "event_id", "value")


@_query
def heartbeat_stalls(spark, d):
    return rates.stalls(table(spark, d, "job_status"), F.lit(NOW).cast("timestamp_ntz"), RUNNING)


@_query
def event_state_latest(spark, d):
    events = table(spark, d, "events")
    return rates.latest_states(events, "user_id", ["ts", "event_id"], F.col("event_type"), F.col("event_type") == "purchase")


@_query
def event_cursor(spark, d):
    return rates.after_cursor(table(spark, d, "events").select("event_id", "user_id", "event_type"), 500, 100)


@_query
def trial_percentiles(spark, d):
    return capacity.trial_summary(table(spark, d, "events"), "event_type", "value")


@_query
def capacity_matrix(spark, d):
    return capacity.candidate_matrix(spark, 16)


@_query
def job_progress(spark, d):
    rows = table(spark, d, "job_status").select("snapshot_id", "job_key", "target_pages", "processed_pages", "elapsed_seconds", "avg_seconds_per_page").distinct()
    return rates.progress(rows).select("snapshot_id", "job_key", "progress_percent", "seconds_per_page", "seconds_left")


@_query
def signed_entries(spark, d):
    return chunks.signed_entries(pages.distinct_pages(table(spark, d, "pages")))


@_query
def audit_html_rows(spark, d):
    return sinks.audit_html(pages.distinct_pages(table(spark, d, "pages")))


@_query
def source_states(spark, d):
    """Sources by how far their best job came."""
    rows = catalog_status_left_join(spark, d)
    state = F.when(F.col("done") == 1, "done").when(F.coalesce(F.col("processed_pages"), F.lit(0)) > 0, "begun").otherwise("not begun")
    return rows.groupBy(state.alias("state")).agg(F.count("*").alias("n_sources"), F.sum(F.coalesce("processed_pages", F.lit(0))).alias("n_pages"))
