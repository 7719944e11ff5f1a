"""Queries on jobs, tasks, readings, names and capacity over the driver's tables, whole tables each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codexweave.functions import front_matter as FM
from codexweave.functions import numbers as N
from codexweave.functions import text as T
from codexweave.operators import audit, capacity, chunks, evidence, history, library, pages, reports, tasks
from codexweave.plans import books
from codexweave.plans.books import NOW
from codexweave.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
#: Roots of the result folders, the clock of the queue, and its leases' seconds. Fixed values.
LIBRARY, OUTPUT, QUEUE_NOW, LEASE_SECONDS = "/data/library", "/data/out", "2024-01-20 00:00:00", 6 * 3600
#: Trials of a benchmark: candidate, workers, threads, pages a minute, failed, low confidence, memory left, CPU, RSS, thread use, foreign CPU. Fixed values.
TRIALS = (
    ("1x1", 1, 1, 60.0, 0, 0.01, 9.0, 40.0, 900.0, 95.0, 3.0), ("1x2", 1, 2, 100.0, 0, 0.01, 8.0, 55.0, 950.0, 90.0, 3.0), ("1x4", 1, 4, 104.0, 0, 0.01, 8.0, 70.0, 980.0, 60.0, 2.0),
    ("2x2", 2, 2, 127.0, 0, 0.02, 6.0, 75.0, 1900.0, 84.0, 2.0), ("2x4", 2, 4, 131.0, 0, 0.02, 6.0, 88.0, 2000.0, 70.0, None), ("3x2", 3, 2, 150.0, 2, 0.02, 4.0, 90.0, 2800.0, 70.0, 4.0),
    ("3x4", 3, 4, 170.0, 0, 0.09, 4.0, 91.0, 2900.0, 70.0, 4.0), ("4x2", 4, 2, 140.0, 0, 0.02, 1.5, 95.0, 3900.0, 70.0, 4.0), ("4x4", 4, 4, None, 0, 0.0, None, None, None, None, None),
)
TRIAL = "candidate string, workers int, threads int, pages_per_minute double, failed_pages int, low_confidence_ratio double, available_memory_gb double, system_cpu_percent double, rss_mb double, thread_use_percent double, foreign_cpu_percent double"


def _query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _jobs(spark, d):
    return reports.job_reports(table(spark, d, "job_status"), table(spark, d, "quality"), F.lit(NOW).cast("timestamp_ntz"))


@_query
def job_reports(spark, d):
    rows = _jobs(spark, d)
    return rows.withColumn("left_text", T.duration_text(F.col("seconds_left")))


@_query
def batch_reports(spark, d):
    return reports.batch_reports(_jobs(spark, d))


@_query
def batch_selection(spark, d):
    return reports.batch_selection(_jobs(spark, d), 20)


@_query
def state_labels(spark, d):
    rows = table(spark, d, "job_status").select(reports.state_label(F.col("status")).alias("state"))
    return rows.groupBy("state").agg(F.count("*").alias("n"))


@_query
def job_coverage(spark, d):
    """Which jobs cover a request for the whole book, and one for its first 30 pages."""
    jobs = library.candidates(table(spark, d, "job_status"), table(spark, d, "quality"))
    return jobs.select("job_key", library.covers_request(jobs).alias("covers_all"), library.covers_request(jobs, 30).alias("covers_30"))


@_query
def iteration_plans(spark, d):
    return reports.iteration_plans(audit.job_evidence(table(spark, d, "pages"), table(spark, d, "job_status"), table(spark, d, "quality"), F.lit(NOW).cast("timestamp_ntz")))


@_query
def audit_samples(spark, d):
    """The first 20 pages of each job with each problem."""
    rows = audit.issue_pages(table(spark, d, "pages")).select("job_key", F.explode("problems").alias("problem"), "page_number")
    rows = rows.withColumn("key", F.concat_ws("|", "job_key", "problem"))
    return reports.sampled(rows, "key", "page_number", "numbers", 20).select("key", F.array_join(F.transform("numbers", lambda n: n.cast("string")), ",").alias("page_numbers"))


@_query
def history_collected(spark, d):
    rows = history.collected_history(table(spark, d, "history"), table(spark, d, "job_status"), table(spark, d, "quality"), status="完成", most=0)
    return rows.select("event", "job_key", "job_dir", "source_pdf", "status", "mode", "engine", *history.COUNTS)


@_query
def backfilled_events(spark, d):
    rows = history.redacted(history.snapshot_events(table(spark, d, "job_status"), table(spark, d, "quality")))
    return rows.select("event", "job_key", "job_dir", "source_pdf", "status", "mode", "engine", *history.COUNTS, "recorded")


@_query
def book_completions(spark, d):
    rows = table(spark, d, "job_status").where("job_key IS NOT NULL")
    return tasks.completed_once(rows, "job_key", ["updated_at", "snapshot_id"], F.coalesce(reports.state_label(F.col("status")) == "done", F.lit(False)))


@_query
def book_states(spark, d):
    """Sources by what their jobs came to: active before completed before failed before pending."""
    rows = table(spark, d, "job_status").where("source_pdf IS NOT NULL").select("source_pdf", reports.state_label(F.col("status")).alias("label"))
    of = lambda *labels: rows.where(F.col("label").isin(*labels)).select("source_pdf")
    return tasks.book_states(rows.select("source_pdf").distinct(), of("queued"), of("done"), of("failed", "cancelled"), "source_pdf")


@_query
def page_evidence(spark, d):
    return evidence.page_evidence(table(spark, d, "pages"), table(spark, d, "job_status"))


@_query
def resume_plan(spark, d):
    return evidence.resume_plan(table(spark, d, "pages"), table(spark, d, "job_status"))


@_query
def direct_pages(spark, d):
    """Records of the pages that have a text layer, of those a job has marked as doubtful."""
    rows = table(spark, d, "pages")
    layer = rows.where(F.col("source").isin(*evidence.TEXT_LAYERS)).select("job_key", "page_number", "text").distinct()
    doubtful = rows.where(F.col("confidence") < pages.LOW_CONFIDENCE).select("job_key", "page_number")
    return evidence.wanted_direct_pages(evidence.direct_pages(layer), doubtful).select("job_key", "page_number", "text", "confidence", "source", F.size("warnings").alias("n_warnings"))


@_query
def review_pages(spark, d):
    return evidence.reviews(table(spark, d, "pages"))


@_query
def upgraded_pages(spark, d):
    return evidence.upgraded_pages(table(spark, d, "pages"), table(spark, d, "job_status"))


@_query
def block_measures(spark, d):
    placed = pages.boxes(F.col("blocks"))
    rows = pages.known_pages(table(spark, d, "pages")).where("blocks IS NOT NULL")
    return rows.select("page_id", F.size("blocks").alias("n_blocks"), pages.mean_confidence(F.col("blocks")).alias("mean_confidence"), pages.area_share(placed).alias("area_share")).dropDuplicates(["page_id"])


@_query
def volume_titles(spark, d):
    rows = table(spark, d, "pages").where("book IS NOT NULL").select("book").distinct()
    return rows.select("book", F.array_join(FM.volume_titles(F.col("book")), "|").alias("titles"))


@_query
def volume_titles_of_headings(spark, d):
    """Titles read off the first pages' first lines, which have more colons and dashes than books do."""
    line = F.get(T.filled_lines(F.col("text")), F.lit(0))
    rows = table(spark, d, "documents").select(line.alias("book")).where("book IS NOT NULL").distinct()
    return rows.select("book", F.array_join(F.coalesce(FM.volume_titles(F.col("book")), F.array().cast("array<string>")), "|").alias("titles"))


@_query
def front_matter_pages(spark, d):
    rows = pages.distinct_pages(table(spark, d, "pages").where("page_number <= 20")).select("page_id", "book", "page_number", "text")
    fixed = FM.with_front_matter(rows)
    return fixed.select("page_id", "text", F.array_join("front_notes", ",").alias("notes"))


@_query
def result_folders(spark, d):
    rows = table(spark, d, "job_status").where("source_pdf IS NOT NULL").select("source_pdf").distinct()
    path = F.col("source_pdf")
    return rows.select("source_pdf", T.result_folder(path, LIBRARY, OUTPUT).alias("folder"), T.title_file_name(T.stem(path)).alias("file_name"), T.plain_component(T.stem(path), "book").alias("component"))


@_query
def resolutions(spark, d):
    rows = table(spark, d, "job_status").select("mode").distinct()
    return rows.select("mode", T.resolution(F.col("mode")).alias("dpi"))


@_query
def entry_bodies(spark, d):
    return table(spark, d, "chunks").select("chunk_id", "created_at", T.trimmed_body(F.col("text")).alias("text"))


@_query
def entry_starts(spark, d):
    return chunks.entry_starts(table(spark, d, "pages"))


@_query
def entry_titles(spark, d):
    return chunks.entry_starts(table(spark, d, "pages"), old=False)


@_query
def job_estimates(spark, d):
    jobs = library.latest_status(table(spark, d, "job_status")).select("job_key", "target_pages", "mode")
    n = F.col("target_pages")
    return jobs.select(
        "job_key",
        capacity.estimated_seconds(n, F.col("mode"), F.lit("paddleocr"), F.lit(False)).alias("recognised"),
        capacity.estimated_seconds(n, F.col("mode"), F.lit("tesseract"), F.lit(False)).alias("fallback"),
        capacity.estimated_seconds(n, F.col("mode"), F.lit("none"), F.lit(True)).alias("direct"),
        capacity.thread_budget(n, F.lit(8)).alias("threads"),
        capacity.thread_budget(n, F.lit(3), high=True).alias("high_threads"),
    )


def _trials(spark):
    return spark.createDataFrame(TRIALS, TRIAL)


@_query
def capacity_trials(spark, d):
    rows = capacity.evaluated_trials(_trials(spark))
    return rows.select("candidate", F.array_join("reasons", "|").alias("reasons"), "valid", "speedup", "efficiency")


@_query
def capacity_winner(spark, d):
    return capacity.best_trial(_trials(spark))


@_query
def capacity_unsettled(spark, d):
    return capacity.unsettled(capacity.candidate_matrix(spark, 16), _trials(spark).where("pages_per_minute IS NOT NULL")).select("candidate")


@_query
def resource_totals_nullaware(spark, d):
    rows = table(spark, d, "job_status").select(
        "engine", F.col("snapshot_id").alias("pid"), F.col("avg_seconds_per_page").alias("cpu_percent"), F.col("eta_seconds").cast("double").alias("memory_mb"), F.col("low_confidence_pages").alias("n_threads")
    )
    return capacity.resource_totals(rows.distinct(), "engine", 16, 64_000_000.0)


@_query
def thread_use(spark, d):
    """Active and saturated threads of users' workers, whose loads are the values of their event kinds."""
    rows = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.max("value").alias("load"))
    maps = rows.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "load"))).alias("thread_cpu_percent")).withColumn("thread_budget", F.lit(2))
    return capacity.thread_metrics(maps).select("user_id", "active_threads", "saturated_threads", F.round("budget_use_percent", 6).alias("budget_use_percent"))


@_query
def benchmark_fixture_pages(spark, d):
    return capacity.fixture_pages(spark, 1000, 4, 50, 3)


def _events(spark, d):
    return table(spark, d, "events").select("event_id", "ts", "user_id", "event_type", F.get_json_object("props", "$.k").cast("int").alias("page"))


@_query
def page_states(spark, d):
    is_ = lambda kind: F.col("event_type") == kind
    return tasks.page_states(_events(spark, d), ["user_id", "page"], ["event_id"], is_("click"), is_("view"), is_("error"))


@_query
def task_attempts(spark, d):
    starts = _events(spark, d).where("event_type = 'signup'").select("user_id", "event_id")
    return tasks.attempt_numbers(starts, "user_id", ["event_id"])


@_query
def task_reports(spark, d):
    events = _events(spark, d)
    people = events.select("user_id").distinct()
    return tasks.task_reports(people, task_attempts(spark, d), events.select("user_id", F.col("event_type").alias("kind")), "user_id")


@_query
def queue_claimable(spark, d):
    events = _events(spark, d)
    queued = events.where("event_type = 'signup'").groupBy("user_id").agg(F.min("ts").alias("created_at"))
    leases = events.where("event_type = 'purchase'").groupBy("user_id").agg((F.max("ts") + F.expr("INTERVAL 10 DAYS")).alias("expires_at"))
    return tasks.claimable(queued, leases, "user_id", ["created_at", "user_id"], F.lit(QUEUE_NOW).cast("timestamp_ntz"))


@_query
def queue_claimed(spark, d):
    events = _events(spark, d)
    queued = events.where("event_type = 'signup'").groupBy("user_id").agg(F.min("ts").alias("created_at"))
    leases = events.where("event_type = 'purchase'").groupBy("user_id").agg((F.max("ts") + F.expr("INTERVAL 10 DAYS")).alias("expires_at"))
    return tasks.claimed(queued, leases, "user_id", ["created_at", "user_id"], F.lit(QUEUE_NOW).cast("timestamp_ntz"))


@_query
def lease_tokens(spark, d):
    log = _events(spark, d).where("event_type = 'purchase'").select("user_id", "event_id", "ts")
    return tasks.lease_tokens(log, "user_id", ["event_id"], "ts", LEASE_SECONDS)


@_query
def chunk_records(spark, d):
    return chunks.chunk_records(pages.distinct_pages(table(spark, d, "pages")))


@_query
def worker_liveness(spark, d):
    """Workers by user: each event is a heartbeat, the number of views so far the pages done."""
    seen = F.count_if(F.col("event_type") == "view").over(Window.partitionBy("user_id").orderBy("event_id"))
    beats = _events(spark, d).select("user_id", "ts", seen.alias("pages"))
    return tasks.liveness_states(beats, "user_id", F.lit("2024-01-30 23:00:00").cast("timestamp_ntz"))


@_query
def new_requests(spark, d):
    """Requests for a source in a mode, each once, but for those that a done job has answered."""
    rows = table(spark, d, "job_status").select("snapshot_id", "source_pdf", "mode", "status")
    asked = ["source_pdf", "mode"]
    known = rows.where(reports.state_label(F.col("status")) == "done").select(tasks.idempotency_key(asked).alias("request_key")).distinct()
    return tasks.new_requests(rows.select("snapshot_id", *asked), known, asked, ["snapshot_id"])


@_query
def thread_usage(spark, d):
    loads = table(spark, d, "events").select(F.col("user_id").alias("pid"), F.col("event_type").alias("thread"), "value")
    of = lambda f: loads.groupBy("pid", "thread").agg(f("value").alias("cpu_seconds"))
    return capacity.thread_usage(of(F.min), of(F.max), 60.0)


@_query
def sanitised_numbers(spark, d):
    """Values of events' properties and of chunk identifiers' ends as numbers, bounded ones among them."""
    text = F.regexp_extract("chunk_id", r"([^-]*)-[^-]*$", 1)
    rows = table(spark, d, "chunks").select("chunk_id", text.alias("part"), F.regexp_extract("chunk_id", r"(\d+)$", 1).alias("digits")).distinct()
    return rows.select("chunk_id", N.finite(F.col("part")).alias("finite"), N.nonnegative_integer(F.col("digits")).alias("whole"), N.bounded(F.col("digits"), 2, 5).alias("bounded"))


@_query
def entry_texts(spark, d):
    """Entries between chapter headings, of the last reading of each page of a book."""
    rows = pages.distinct_pages(table(spark, d, "pages")).where("book IS NOT NULL AND page_number IS NOT NULL")
    last = rows.groupBy("book", "page_number").agg(F.max_by("text", "page_id").alias("text"))
    return chunks.entry_texts(books.entry_ranges(spark, d), last).select("book", "title", "first_page", "last_page", "n_pages", "n_chars")


@_query
def library_scan(spark, d):
    return library.library_scan(books.catalog_status_left_join(spark, d), books.document_classification(spark, d), table(spark, d, "job_status"))
