"""Reports on jobs, batches and the risks of their results: aggregates and rule tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codexweave.functions import text as T
from codexweave.operators import library

#: States of a job that is at work. Fixed values.
AT_WORK = ("处理中", "进行中", "启动中", "running")
#: Labels of states by spelling, lower case and without blanks around. Fixed values.
STATE_LABELS = {
    "完成": "done", "已完成": "done", "done": "done", "complete": "done", "completed": "done", "finished": "done", "ok": "done",
    "处理中": "running", "进行中": "running", "启动中": "running", "running": "running",
    "排队": "queued", "排队中": "queued", "queued": "queued", "pending": "queued",
    "未完成": "incomplete", "incomplete": "incomplete", "partial": "incomplete",
    "失败": "failed", "已失败": "failed", "failed": "failed", "error": "failed", "出错": "failed",
    "已取消": "cancelled", "取消": "cancelled", "cancelled": "cancelled", "canceled": "cancelled",
}


def state_label(status: Column) -> Column:
    """The label of a state in whichever spelling; ``unknown`` for null and others."""
    labels = F.create_map(*[F.lit(x) for pair in STATE_LABELS.items() for x in pair])
    return F.coalesce(F.try_element_at(labels, F.lower(T.stripped(status))), F.lit("unknown"))


def expected_pages(total: Column, target: Column, page_cap: int | None = None) -> Column:
    """Pages a book is done with: its length, at most the cap; the cap or the target where that is unknown."""
    known = F.nullif(F.coalesce(total, F.lit(0)), F.lit(0))
    if page_cap:
        return F.coalesce(F.least(known, F.lit(page_cap)), F.lit(page_cap))
    return F.coalesce(known, target, F.lit(0))


def job_reports(job_status: DataFrame, quality: DataFrame, now: Column, stalled_after: int = 600, page_cap: int | None = None) -> DataFrame:
    """One row per job: state, pages expected and done, completion, progress, speed, time left and freshness at ``now``.

    A job at work with pages left that was silent for ``stalled_after`` seconds is suspected
    to have stalled. Unknown values stay null.
    """
    order = F.struct("updated_at", "snapshot_id")
    pace = job_status.where("job_key IS NOT NULL").groupBy("job_key").agg(F.max_by("elapsed_seconds", order).alias("elapsed"), F.max_by("avg_seconds_per_page", order).alias("average"))
    totals = quality.groupBy("job_key").agg(F.max("total_pages").alias("quality_total"))
    rows = library.latest_status(job_status).join(totals, "job_key", "left").join(pace, "job_key", "left")
    done, target = F.coalesce("processed_pages", F.lit(0)), F.coalesce("target_pages", F.lit(0))
    expected = expected_pages(library.known_total(F.col("total_pages"), F.col("quality_total")), F.col("target_pages"), page_cap)
    label = state_label(F.col("status"))
    complete = (label == "done") & F.when(expected <= 0, (done > 0) & (done >= target) & (target > 0)).otherwise((done >= expected) & (target >= expected))
    speed = F.bround(F.coalesce("average", F.when(done > 0, F.col("elapsed") / done)), 2)
    age = F.greatest(F.lit(0), F.timestamp_diff("SECOND", F.col("updated_at"), now))
    stalled = F.coalesce((label == "running") & (done < target) & (age >= stalled_after), F.lit(False))
    return rows.select(
        "job_key", "source_pdf", label.alias("state"), expected.alias("expected_pages"), done.alias("processed_pages"), target.alias("target_pages"), complete.alias("is_complete"),
        F.when(target > 0, F.bround(done * 100.0 / target, 1)).otherwise(0.0).alias("progress_percent"),
        speed.alias("seconds_per_page"), F.bround(speed * F.greatest(target - done, F.lit(0))).cast("long").alias("seconds_left"),
        age.alias("age_seconds"), stalled.alias("is_stalled"),
        F.when(stalled, "stalled").otherwise(label).alias("runtime_state"),
    )


def batch_reports(jobs: DataFrame) -> DataFrame:
    """One row per folder of sources: jobs by state, pages, mean speed, joint rate and time left.

    ``jobs`` as from ``job_reports``. The rate is the sum of the rates of the jobs at work
    whose rate is known and positive; unknown without any.
    """
    folder = F.coalesce(F.regexp_extract("source_pdf", r"^(.*)[/\\]", 1), F.lit(""))
    rate = F.when((F.col("runtime_state") == "running") & (F.col("seconds_per_page") > 0), 60.0 / F.col("seconds_per_page"))
    left = F.greatest(F.col("target_pages") - F.col("processed_pages"), F.lit(0))
    rows = jobs.withColumn("folder", folder).groupBy("folder").agg(
        F.count("*").alias("n_jobs"),
        F.count_if("is_complete").alias("n_complete"),
        F.count_if(F.col("state") == "failed").alias("n_failed"),
        F.count_if(F.col("runtime_state") == "running").alias("n_running"),
        F.count_if("is_stalled").alias("n_stalled"),
        F.sum("processed_pages").alias("processed_pages"),
        F.sum(F.when(~F.col("is_complete"), left).otherwise(0)).alias("pages_left"),
        F.round(F.sum(rate), 3).alias("pages_per_minute"),
    )
    return rows.withColumn("minutes_left", F.when(F.col("pages_per_minute") > 0, F.round(F.col("pages_left") / F.col("pages_per_minute"), 1)))


def batch_selection(jobs: DataFrame, max_books: int) -> DataFrame:
    """``source_pdf, action``: covered sources are skipped, of the others the first ``max_books`` by path are taken.

    The limit counts what is taken only. A source is covered if any of its jobs is complete.
    """
    sources = jobs.where("source_pdf IS NOT NULL").groupBy("source_pdf").agg(F.max("is_complete").alias("covered"))
    first = sources.where("NOT covered").orderBy("source_pdf").limit(max_books).select("source_pdf", F.lit(True).alias("taken"))
    rows = sources.join(first, "source_pdf", "left")
    return rows.select("source_pdf", F.when(F.col("covered"), "skipped").when(F.col("taken"), "taken").otherwise("later").alias("action"))


#: The rules of the iteration report: risk, action, and the counts it is judged by.
RULES = ("task_recovery_required", "incomplete_coverage", "low_confidence_text", "blank_page_output", "new_cleanup_rules_available", "layout_or_illustration_risk", "resource_pressure", "missing_quality_evidence")
ACTIONS = ("review_and_recover_task", "complete_page_coverage", "sample_low_confidence_pages", "review_blank_pages", "approve_rule_refresh", "manual_layout_review", "review_resource_policy", "generate_quality_audit")
PRESERVE, SCHEMA_VERSION, STRATEGY_VERSION = "preserve_current_version", "1.0", "rules-v1"


def iteration_plans(jobs: DataFrame) -> DataFrame:
    """``job_key, risks, severities, actions, needs_approval, plan_id``: what a job's evidence asks for.

    ``jobs`` has job_key, is_stalled, state, target_pages, processed_pages, unchecked_pages,
    low_confidence_pages, protected_pages, blank_pages, refreshable_pages, residual_pages,
    illustration_pages, cpu_percent, memory_percent and has_audit. The rules are tried in
    order; the id is a digest of the evidence and the rules that held, in one canonical form,
    so that equal evidence gives an equal plan.
    """
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    failed = F.coalesce(F.col("state") == "failed", F.lit(False))
    stalled = F.coalesce("is_stalled", F.lit(False))
    missing = F.greatest(n("unchecked_pages"), n("target_pages") - n("processed_pages"), F.lit(0))
    low = F.greatest(n("low_confidence_pages") - n("protected_pages"), F.lit(0))
    pressed = F.coalesce(F.col("cpu_percent") >= 90, F.lit(False)) | F.coalesce(F.col("memory_percent") >= 90, F.lit(False))
    tests = (stalled | failed, missing > 0, low > 0, n("blank_pages") > 0, n("refreshable_pages") > 0, (n("residual_pages") > 0) | (n("illustration_pages") > 0), pressed, ~F.coalesce("has_audit", F.lit(False)))
    severity = (F.lit("high"), F.when(failed, "high").otherwise("medium"), F.when(low >= 10, "high").otherwise("medium"), F.lit("high"), *[F.lit("medium")] * 4)
    held = lambda values: F.array_compact(F.array(*[F.when(t, v) for t, v in zip(tests, values, strict=True)]))
    risks, grades, found = held([F.lit(r) for r in RULES]), held(severity), held([F.lit(a) for a in ACTIONS])
    actions = F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(PRESERVE)))
    approval = F.exists(actions, lambda a: ~a.isin(PRESERVE, "generate_quality_audit"))
    evidence = F.concat_ws(",", *[F.concat(F.lit(f'"{c}":'), F.coalesce(F.col(c).cast("string"), F.lit("null"))) for c in EVIDENCE])
    quoted = lambda xs: F.concat(F.lit("["), F.array_join(F.transform(xs, lambda x: F.concat(F.lit('"'), x, F.lit('"'))), ","), F.lit("]"))
    key = F.concat(
        F.lit('{"action_ids":'), quoted(actions), F.lit(',"evidence":{'), evidence, F.lit('},"risk_ids":'), quoted(risks), F.lit(f',"schema_version":"{SCHEMA_VERSION}","strategy_version":"{STRATEGY_VERSION}"}}')
    )
    return jobs.select(
        "job_key", F.array_join(risks, ",").alias("risks"), F.array_join(grades, ",").alias("severities"), F.array_join(actions, ",").alias("actions"), approval.alias("needs_approval"),
        F.concat(F.lit("iteration-"), F.substring(F.sha2(key, 256), 1, 16)).alias("plan_id"),
    )


#: Evidence by name, in the canonical order of names.
EVIDENCE = ("blank_pages", "illustration_pages", "low_confidence_pages", "processed_pages", "protected_pages", "refreshable_pages", "residual_pages", "state", "target_pages", "unchecked_pages")


def sampled(rows: DataFrame, key: str, value: str, name: str, size: int) -> DataFrame:
    """``key, name``: the least ``size`` values of each key, sorted; ranked before they are gathered."""
    order = Window.partitionBy(key).orderBy(value)
    first = rows.select(key, value).distinct().withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= size)
    return first.groupBy(key).agg(F.array_sort(F.collect_list(value)).alias(name))
