"""Jobs, tasks, readings, names, readers and writers on small cases: nulls, ties, repeats, empty tables."""

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from codexweave.functions import numbers as N
from codexweave.functions import text as T
from codexweave.operators import audit, capacity, chunks, evidence, history, layout, library, pages, reports, tasks
from codexweave.sources import records, sinks, tables

T0 = datetime(2025, 1, 1)
STATUS = "snapshot_id long, job_key string, job_dir string, status string, source_pdf string, target_pages int, processed_pages int, text_pages int, blank_pages int, failed_pages int, low_confidence_pages int, engine string, total_pages int, is_sample boolean, elapsed_seconds int, avg_seconds_per_page double, updated_at timestamp_ntz, mode string"
QUALITY = "quality_id long, job_key string, mode string, total_pages int, is_sample boolean, engine string, target_pages int, output_pages int, text_pages int, blank_pages int, low_confidence_pages int, failed_pages int, written_at timestamp_ntz"


def status(spark, rows):
    """Statuses from (job, status, source, target, processed, total, sample, minutes after T0)."""
    return spark.createDataFrame([(i, j, f"/o/{j}", s, p, t, n, n, 0, 0, 1, "e", total, sample, 100, None, T0 + timedelta(minutes=m), "book-fast") for i, (j, s, p, t, n, total, sample, m) in enumerate(rows)], STATUS)


def quality(spark, rows):
    return spark.createDataFrame([(i, j, "m", total, sample, "qe", 9, out, 8, 1, 2, 0, T0) for i, (j, total, sample, out) in enumerate(rows)], QUALITY)


def test_job_reports(spark):
    rows = [("a", "完成 ", "/x/a.pdf", 10, 10, 10, False, 0), ("b", "处理中", "/x/b.pdf", 10, 4, None, None, 0), ("c", None, None, None, None, None, None, 0), ("d", "done", "/y/d.pdf", 5, 5, 10, True, 0), ("b", "排队", "/x/b.pdf", 10, 1, None, None, -5), ("a", "完成 ", "/x/a.pdf", 10, 10, 10, False, 0)]
    made = reports.job_reports(status(spark, rows), quality(spark, [("b", 12, False, 4), (None, 3, None, 1)]), F.lit("2025-01-01 01:00:00").cast("timestamp_ntz"))
    got = {r.job_key: r for r in made.collect()}
    assert (got["a"].state, got["a"].is_complete, got["a"].progress_percent) == ("done", True, 100.0)
    assert (got["b"].state, got["b"].is_stalled, got["b"].expected_pages, got["b"].seconds_left) == ("running", True, 12, 150)
    assert (got["c"].state, got["c"].progress_percent, got["c"].seconds_per_page, got["c"].is_complete) == ("unknown", 0.0, None, False)
    assert not got["d"].is_complete
    batches = {r.folder: r for r in reports.batch_reports(made).collect()}
    assert (batches["/x"].n_jobs, batches["/x"].n_stalled, batches["/x"].pages_per_minute) == (2, 1, None)
    picked = {r.source_pdf: r.action for r in reports.batch_selection(made, 1).collect()}
    assert picked == {"/x/a.pdf": "skipped", "/x/b.pdf": "taken", "/y/d.pdf": "later"}
    assert made.limit(0).count() == 0 and reports.batch_reports(made.limit(0)).count() == 0


def test_samples_and_coverage(spark):
    jobs = library.candidates(status(spark, [("a", "ok", "/a", 5, 5, 10, False, 0), ("b", "ok", "/b", 10, 10, 10, False, 0), ("c", "ok", "/c", 10, 10, 0, None, 0)]), quality(spark, [("c", 20, False, 1), ("b", 10, True, 1)]))
    assert {r.job_key: r.reason for r in jobs.collect()} == {"a": "sample", "b": "sample", "c": "sample"}
    got = {r.job_key: (r.x, r.y) for r in jobs.select("job_key", library.covers_request(jobs).alias("x"), library.covers_request(jobs, 5).alias("y")).collect()}
    assert got == {"a": (False, True), "b": (True, True), "c": (False, True)}


def test_larger_chunk_files_win_ties(spark):
    st = status(spark, [("a", "ok", "/s", 5, 5, 5, False, 0), ("b", "ok", "/s", 5, 5, 5, False, 0)])
    sizes = spark.createDataFrame([("a", 9)], "job_key string, size long")
    first = {r.job_key for r in library.selected_versions(st, quality(spark, []), sizes).where("rank = 1").collect()}
    assert first == {"a"} and {r.job_key for r in library.selected_versions(st, quality(spark, [])).where("rank = 1").collect()} == {"b"}


def test_iteration_plans_are_deterministic(spark):
    schema = "job_key string, state string, is_stalled boolean, target_pages int, processed_pages int, unchecked_pages int, low_confidence_pages int, protected_pages int, blank_pages int, refreshable_pages int, residual_pages int, illustration_pages int, cpu_percent double, memory_percent double, has_audit boolean"
    clean = ("done", False, 5, 5, 0, 0, 0, 0, 0, 0, 0, None, None, True)
    rows = [("a", *clean), ("b", *clean), ("c", "failed", None, 9, 5, None, 12, 1, 1, 1, 1, None, 95.0, None, None), ("d", *[None] * 14)]
    got = {r.job_key: r for r in reports.iteration_plans(spark.createDataFrame(rows, schema)).collect()}
    assert got["a"].plan_id == got["b"].plan_id != got["c"].plan_id and got["a"].actions == "preserve_current_version" and not got["a"].needs_approval
    assert got["c"].risks == ",".join(reports.RULES) and got["c"].severities.split(",")[:4] == ["high"] * 4 and got["c"].needs_approval
    assert got["d"].risks == "missing_quality_evidence" and not got["d"].needs_approval


def test_page_states_and_attempts(spark):
    rows = [("t", 1, 1, "start"), ("t", 1, 2, "fail"), ("t", 1, 3, "start"), ("t", 1, 4, "done"), ("t", 1, 5, "fail"), ("t", 1, 6, "start"), ("t", 2, 7, "start"), ("t", 2, 8, "fail"), ("t", 3, 9, "start"), ("t", None, 10, "x"), ("t", 1, 2, "fail")]
    df = spark.createDataFrame(rows, "task string, page int, n int, kind string").where("page IS NOT NULL").distinct()
    is_ = lambda k: F.col("kind") == k
    got = {r.page: (r.state, r.n_starts, r.n_failures, r.late_starts) for r in tasks.page_states(df, ["task", "page"], ["n"], is_("start"), is_("done"), is_("fail")).collect()}
    assert got == {1: ("completed", 2, 1, 1), 2: ("failed", 1, 1, 0), 3: ("started", 1, 0, 0)}
    numbered = tasks.attempt_numbers(df.where(is_("start")), "task", ["n"])
    assert [r.attempt for r in numbered.orderBy("n").collect()] == [1, 2, 3, 4, 5]
    report = tasks.task_reports(spark.createDataFrame([("t",), ("u",)], "task string"), numbered, df.select("task", "kind"), "task")
    assert {r.task: (r.n_attempts, r.events) for r in report.collect()} == {"t": (5, "done=1,fail=3,start=5"), "u": (None, "")}


def test_queue_and_leases(spark):
    at = lambda s: T0 + timedelta(seconds=s)
    queued = spark.createDataFrame([("a", at(0)), ("b", at(1)), ("c", at(1))], "t string, created timestamp_ntz")
    leases = spark.createDataFrame([("a", at(100)), ("b", at(50)), (None, at(999))], "t string, expires_at timestamp_ntz")
    now = F.lit(str(at(50))).cast("timestamp_ntz")
    assert [r.t for r in tasks.claimable(queued, leases, "t", ["created", "t"], now).collect()] == ["b", "c"]
    assert tasks.claimed(queued, leases, "t", ["created", "t"], now).first().t == "b"
    assert tasks.claimed(queued.limit(0), leases, "t", ["created", "t"], now).count() == 0
    log = spark.createDataFrame([("k", 1, at(0)), ("k", 2, at(10)), ("k", 3, at(60)), ("k", 4, at(61)), ("l", 9, at(5))], "key string, n int, at timestamp_ntz")
    got = [(r.n, r.granted, r.token) for r in tasks.lease_tokens(log, "key", ["n"], "at", 60).orderBy("n").collect()]
    assert got == [(1, True, 1), (2, False, 1), (3, True, 2), (4, False, 2), (9, True, 1)]


def test_liveness_states(spark):
    at = lambda s: T0 + timedelta(seconds=s)
    beats = [("dead", at(0), 1), ("new", at(950), 0), ("none", at(0), 0), ("none", at(995), None), ("stuck", at(0), 0), ("stuck", at(100), 4), ("stuck", at(990), 4), ("ok", at(0), 1), ("ok", at(900), 9), ("ok", at(960), 9)]
    df = spark.createDataFrame(beats, "w string, ts timestamp_ntz, pages int")
    got = {r.w: r.state for r in tasks.liveness_states(df, "w", F.lit(str(at(1000))).cast("timestamp_ntz")).collect()}
    assert got == {"dead": "dead", "new": "starting", "none": "no first page", "stuck": "stuck", "ok": "alive"}
    assert tasks.liveness_states(df.limit(0), "w", F.lit(str(at(0))).cast("timestamp_ntz")).count() == 0


def test_requests_are_taken_once(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "a", None), (3, "a", "null"), (4, "b", 'x"y'), (5, None, "a")], "n int, s string, m string")
    fresh = tasks.new_requests(df, spark.createDataFrame([], "request_key string"), ["s", "m"], ["n"])
    assert sorted(r.n for r in fresh.collect()) == [1, 3, 4, 5]
    assert sorted(r.n for r in tasks.new_requests(df, fresh.where("n = 1"), ["m", "s"], ["n"]).collect()) == [3, 4, 5]


def test_numbers(spark):
    texts = ["3", "3.0", "3.5", "-1", "nan", "inf", "true", "", None, " 7 "]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(N.finite(F.col("t")), N.nonnegative_integer(F.col("t")), N.bounded(F.col("t"), 0, 5)).collect()
    assert [tuple(r) for r in got] == [(3.0, 3, 3.0), (3.0, 3, 3.0), (3.5, None, 3.5), (-1.0, None, 0.0), *[(None, None, None)] * 5, (7.0, 7, 5.0)]


def test_thread_usage(spark):
    schema = "pid int, thread int, cpu_seconds double"
    before, after = spark.createDataFrame([(1, 1, 1.0), (1, 2, 5.0), (1, 3, 0.0)], schema), spark.createDataFrame([(1, 1, 1.5), (1, 2, 4.0), (1, 4, 9.0), (1, 3, 9.0)], schema)
    assert {r.thread: r.cpu_percent for r in capacity.thread_usage(before, after, 1.0).collect()} == {1: 50.0, 2: 0.0, 3: 100.0}


def test_book_states_by_precedence(spark):
    of = lambda *ks: spark.createDataFrame([(k,) for k in ks], "k string")
    got = {r.k: r.state for r in tasks.book_states(of("a", "b", "c", "d"), of("a", "a"), of("a", "b"), of("a", "b", "c"), "k").collect()}
    assert got == {"a": "active", "b": "completed", "c": "failed", "d": "pending"}


PAGE = "page_id long, job_key string, book string, page_number int, printed_page string, text string, confidence double, source string, warnings array<string>, blocks array<struct<text:string,confidence:double,bbox:array<array<double>>>>"


def page(spark, rows):
    """Pages from (id, job, number, text, confidence, source, warnings)."""
    return spark.createDataFrame([(i, j, "书", n, None, t, c, s, w, None) for i, j, n, t, c, s, w in rows], PAGE)


def test_readings_of_a_page(spark):
    long = "正文" * 100
    rows = [(1, "a", 1, long, 0.5, "paddleocr", None), (2, "b", 1, "正文", 0.99, "paddleocr", []), (3, "c", 1, long + "多", 0.6, "pdf_text_layer", None), (4, "a", 2, None, None, "blank_page", None), (5, "b", 2, "", 0.1, None, ["高分辨率重跑失败"]), (1, "a", 1, long, 0.5, "paddleocr", None)]
    jobs = status(spark, [(j, "ok", "/s", 3, 2, 3, False, 0) for j in "abc"])
    df = page(spark, rows)
    best = {r.page_number: (r.n_readings, r.confidence, r.n_chars) for r in evidence.upgraded_pages(df, jobs).collect()}
    assert best == {1: (3, 0.6, 201), 2: (2, 0.0, 0)}
    seen = {r.page_number: (r.chosen, r.n_readings, r.direct_chars) for r in evidence.page_evidence(df, jobs).collect()}
    assert seen == {1: ("direct", 3, 201), 2: ("none", 2, None)}
    plan = {(r.job_key, r.page_number): r.action for r in evidence.resume_plan(df, jobs).collect()}
    assert plan[("a", 1)] == "cached" and plan[("c", 2)] == "recognise" and len(plan) == 9
    assert evidence.resume_plan(df.where("job_key <> 'a'"), jobs).where("job_key = 'a' AND page_number = 1").first().action == "direct"
    review = {r.page_id: (r.needs_review, r.is_upgraded, r.needs_rotation) for r in evidence.reviews(df).collect()}
    assert review == {1: (True, False, False), 2: (False, False, False), 3: (True, False, False), 4: (False, False, False), 5: (True, True, True)}
    assert evidence.page_record(df, "a", 1).first().n_blocks in (0, -1) and evidence.page_record(df, "z", 1).count() == 0


def test_direct_pages(spark):
    layer = spark.createDataFrame([("a", 1, " x \0\n y "), ("a", 2, None), ("a", 3, "z")], "job_key string, page_number int, text string")
    made = evidence.direct_pages(layer)
    assert {r.page_number: (r.text, r.confidence, len(r.warnings)) for r in made.collect()} == {1: ("x\ny", 1.0, 0), 2: ("", 0.0, 1), 3: ("z", 1.0, 0)}
    assert [r.page_number for r in evidence.wanted_direct_pages(made, layer.where("page_number < 3")).collect()] == [1]


def test_trials_and_their_reasons(spark):
    schema = "candidate string, workers int, threads int, pages_per_minute double, failed_pages int, low_confidence_ratio double, quality_passed boolean, available_memory_gb double, system_cpu_percent double, rss_mb double"
    rows = [("1x1", 1, 1, 100.0, 0, 0.0, None, None, None, None), ("1x2", 1, 2, 90.0, 0, 0.0, False, None, None, None), ("2x1", 2, 1, 104.0, 0, 0.0, True, 9.0, 50.0, 5.0), ("2x2", 2, 2, 200.0, 1, 0.0, True, 2.0, 93.0, 5.0), ("3x1", 3, 1, 300.0, None, 0.2, True, 9.0, 9.0, 5.0), ("4x1", 4, 1, None, 0, 0.0, True, 9.0, 9.0, 5.0)]
    df = spark.createDataFrame(rows, schema)
    got = {r.candidate: (len(r.reasons), r.valid, r.speedup) for r in capacity.evaluated_trials(df).collect()}
    assert got == {"1x1": (0, True, 1.0), "1x2": (1, False, None), "2x1": (0, True, 1.04), "2x2": (3, False, None), "3x1": (1, False, None), "4x1": (1, False, None)}
    assert capacity.best_trial(df).first().candidate == "1x1" and capacity.best_trial(df.limit(0)).first().candidate is None
    assert [r.candidate for r in capacity.unsettled(df.select("candidate"), df.where("workers < 4")).collect()] == ["4x1"]


@pytest.mark.parametrize(("pages_", "workers", "sample", "warmup"), [(100, 3, 10, 2), (20, 2, 16, 2), (12, 1, 12, 0)])
def test_fixture_pages_are_common_and_disjoint(spark, pages_, workers, sample, warmup):
    rows = capacity.fixture_pages(spark, pages_, workers, sample, warmup).collect()
    measured = sorted(r.page for r in rows if r.at >= warmup)
    warm = [r.page for r in rows if r.at < warmup]
    assert len(measured) == len(set(measured)) == sample and len(warm) == len(set(warm)) == workers * warmup and not set(warm) & set(measured)
    with pytest.raises(ValueError):
        capacity.fixture_pages(spark, 5, 3, 10, 2)


def test_estimates_and_budgets(spark):
    df = spark.createDataFrame([(100, "book-fast"), (1, "other"), (None, "book-quality"), (450, "book-quality")], "n int, mode string")
    got = df.select(capacity.estimated_seconds(F.col("n"), F.col("mode"), F.lit("paddleocr"), F.lit(False)), capacity.thread_budget(F.col("n"), F.lit(8)), capacity.thread_budget(F.col("n"), F.lit(8), F.lit(3), True)).collect()
    assert [tuple(r) for r in got] == [(3150, 2, 2), (None, 1, 1), (None, 1, 1), (34020, 2, 3)]


def test_history_with_gaps_filled_and_filters(spark):
    events = spark.createDataFrame([(1, "2025-01-02T00:00:00", "结束", "r", "a", "/o/a", "/s/A.pdf", "完成", "m", "e", 1, 1, 1, 0, 0, 0, "/o/a/q.json")] * 2, "event_no long, recorded_at string, event string, run_id string, job_key string, job_dir string, source_pdf string, status string, mode string, engine string, target_pages int, processed_pages int, text_pages int, blank_pages int, low_confidence_pages int, failed_pages int, quality_path string")
    st = status(spark, [("a", "完成", "/s/A.pdf", 5, 5, 5, False, 0), ("b", None, "/s/b.pdf", 0, 0, None, None, 9)])
    got = history.collected_history(events, st, quality(spark, [("b", 5, False, 7)])).collect()
    assert [(r.event, r.source_pdf, r.status, r.processed_pages) for r in got] == [("结束", "A.pdf", "完成", 1), ("backfill", "b.pdf", "未知", 7)]
    assert history.collected_history(events, st, quality(spark, []), source="/else/a.PDF").count() == 1
    assert history.collected_history(events, st, quality(spark, []), status="未知", redact=False).first().job_dir == "/o/b"
    assert history.collected_history(events, st, quality(spark, []), most=1).count() == 1


def test_names(spark):
    df = spark.createDataFrame([("/lib/a/书 (一).v2.pdf",), ("/lib/...pdf",), ("x\\y\\é_b.PDF",), (None,)], "p string")
    got = df.select(T.result_folder(F.col("p"), "/lib", "/out"), T.plain_component(T.stem(F.col("p")), "book"), T.title_file_name(T.stem(F.col("p")))).collect()
    assert got[0][0] == "/out/a/书-一-.v2-rescue-result" and got[0][1] == "v2" and got[0][2] == "书 (一).v2"
    assert got[2][0] == "/out/é_b-rescue-result" and got[3][1] == "book" and got[3][2] is None
    modes = spark.createDataFrame([("book-FAST",), ("archival_x",), ("z",), (None,)], "m string").select(T.resolution(F.col("m"))).collect()
    assert [r[0] for r in modes] == [180, 300, 220, None]


def test_bodies_and_titles(spark):
    df = spark.createDataFrame([("\n\n a \n\n\n\nb\t\n",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(T.trimmed_body(F.col("t"))).collect()] == [" a\n\nb", "", None]
    lines = ["甲虫 (Beetle, sp.)", "甲虫。", "前言", "12-3", "甲虫，，乙", "甲", "，甲虫", "甲虫" * 21, "中国农业百科全书目录索引总编辑委员会编写组", None]
    got = spark.createDataFrame([(x,) for x in lines], "t string").select(T.entry_title(F.col("t"))).collect()
    assert [r[0] for r in got] == ["甲虫", None, None, None, None, None, None, None, "中国农业百科全书目录索引总编辑委员会编写组", None]


def test_entry_starts_by_both_rules(spark):
    rows = [(1, "j", 17, "甲虫\nBeetle\n长长长长长长长长长的一行\nForeign\n第一章\n目录", 1.0, "x", None), (2, "j", 3, "甲虫\nx", 1.0, "x", None), (1, "j", 17, "甲虫\nBeetle\n长长长长长长长长长的一行\nForeign\n第一章\n目录", 1.0, "x", None)]
    assert sorted((r.page_number, r.title) for r in chunks.entry_starts(page(spark, rows)).collect()) == [(17, "甲虫"), (17, "长长长长长长长长长的一行")]
    assert (3, "甲虫") in {(r.page_number, r.title) for r in chunks.entry_starts(page(spark, rows), old=False).collect()}


def test_entries_of_whole_pages(spark):
    ranges = spark.createDataFrame([("b", "甲", 1, 2), ("b", "乙", 3, 2), ("b", "丙", 3, 9), ("c", "丁", 1, 1)], "book string, title string, first_page int, last_page int")
    df = spark.createDataFrame([("b", 2, "二"), ("b", 1, None), ("b", 3, "三"), ("b", 10, "x")], "book string, page_number int, text string")
    got = {r.title: (r.n_pages, r.text) for r in chunks.entry_texts(ranges, df).collect()}
    assert got == {"甲": (2, "\n\n二"), "丙": (1, "三")}


def test_library_scan_keeps_sources_without_pages(spark):
    listed = spark.createDataFrame([("/a", 1), ("/b", 2)], "source_pdf string, number int")
    kinds = spark.createDataFrame([("j", 3, 0.5, "mixed"), ("k", 9, 0.9, "born_digital")], "job_key string, n_pages long, text_ratio double, kind string")
    made = library.library_scan(listed, kinds, status(spark, [("j", None, "/a", 1, 1, 1, None, 0), ("k", None, "/a", 1, 1, 1, None, 0), ("l", None, "/b", 1, 1, 1, None, 0)]))
    assert {r.source_pdf: r.kind for r in made.collect()} == {"/a": "born_digital", "/b": None}


def test_pieces_of_long_lines_stay_apart(spark):
    got = spark.createDataFrame([("a" * 70 + "\nbbbb\ncc",)], "t string").select(chunks.packed(F.col("t"), 60)).first()[0]
    assert got == ["a" * 60, "a" * 10 + "\n\nbbbb\ncc"]


def test_chunk_records(spark):
    rows = [(1, "j", 7, "前文\n甲虫（Beetle）\n一", 0.5, "x", None), (2, "j", 8, None, None, "x", None)]
    got = [(r.chunk_id, r.chapter, r.confidence) for r in chunks.chunk_records(page(spark, rows)).orderBy("chunk_id").collect()]
    assert got == [("j-p0007-001", None, 0.5), ("j-p0007-002", "甲虫", 0.5)]


def test_columns_by_the_best_gap_or_none():
    box = lambda x, y, w=200: [[x, y], [x + w, y], [x + w, y + 10], [x, y + 10]]
    two = [("左" * 10, box(0, i * 20)) for i in range(12)] + [("右" * 10, box(300, i * 20)) for i in range(12)]
    mixed = [b for pair in zip(two[:12], two[12:], strict=True) for b in pair]
    assert [mixed[i] for i in layout.reading_order(mixed)] == two
    below = [("左" * 10, box(0, i * 20)) for i in range(12)] + [("右" * 10, box(300, 900 + i * 20)) for i in range(12)]
    assert layout.reading_order(below[::-1]) == list(range(24))


def test_prepared_tells_what_it_did(spark):
    box = lambda x, y, w=200: [[float(a), float(b)] for a, b in ((x, y), (x + w, y), (x + w, y + 10), (x, y + 10))]
    two = [(f"左{i}行的文字有这么长", 0.9, box(0, i * 20)) for i in range(12)] + [(f"右{i}行的文字有这么长", 0.9, box(300, i * 20)) for i in range(12)]
    blocks = [b for pair in zip(two[:12], two[12:], strict=True) for b in pair]
    rows = [
        (1, "j", "书", 12, None, "\n".join(b[0] for b in blocks), 0.95, "x", None, blocks), (2, "j", "书", 2, None, "前\n言\n正文", 0.95, "x", ["old"], None), (3, "j", None, 3, None, None, None, None, None, None),
        (4, "j", "书卷", 30, None, "用绵花", 0.95, "x", [], None),
    ]
    rules = spark.createDataFrame([(1, "r", ["卷"], [("绵花", "棉花")])], "rule_order int, name string, title_keywords array<string>, replacements array<struct<wrong:string,right:string>>")
    got = {r.page_id: r for r in pages.prepared(spark.createDataFrame(rows, PAGE), rules).collect()}
    assert got[1].text == "\n".join(b[0] for b in two) and "reordered" in got[1].notes
    assert got[2].text == "前言\n正文" and got[2].notes == ["front_matter_corrected"] and got[2].warnings[0] == "old"
    assert got[3].text == "" and got[3].notes == [] and got[4].text == "用棉花" and got[4].notes == ["terms_corrected"]
    assert pages.prepared(spark.createDataFrame([], PAGE)).count() == 0
    told = audit.refreshed_pages(spark.createDataFrame(rows, PAGE), rules)
    assert {r.page_id for r in told.where("text_changes").collect()} == {1, 2, 4}


def test_readers_keep_every_object(spark, tmp_path):
    (tmp_path / "h").mkdir()
    (tmp_path / "h" / "a.jsonl").write_text('{"事件": "开始", "目标页数": 3}\n\n{"event": "end"}\n[1]\n{"cut\n{"event": "x"}\n')
    rows, bad = records.read_histories(spark, str(tmp_path / "h"))
    assert [(r.event, r.target_pages) for r in rows.collect()] == [("开始", 3), ("end", None), ("x", None)] and bad.count() == 2
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "a.json").write_text(json.dumps({"状态": "完成", "已处理页数": 4, "是否抽样": False}, ensure_ascii=False, indent=1))
    (tmp_path / "s" / "b.json").write_text("{")
    rows, bad = records.read_statuses(spark, str(tmp_path / "s"))
    assert [(r.status, r.processed_pages, r.is_sample) for r in rows.collect()] == [("完成", 4, False)] and bad.count() == 1
    for folder in ("x/数据", "知识库/数据"):
        (tmp_path / "c" / folder).mkdir(parents=True)
        (tmp_path / "c" / folder / "片段.jsonl").write_text('{"文本": "t", "页码": 1}\nbad\n')
    rows, bad = records.read_chunks(spark, str(tmp_path / "c"))
    assert [(r.text, r.source_page) for r in rows.collect()] == [("t", 1)] and bad.count() == 1


def test_listing_looks_below_its_root_only(spark, tmp_path):
    root = tmp_path / "build" / "lib"
    (root / "dist").mkdir(parents=True)
    for name in ("a.PDF", "b.txt", "dist/c.pdf"):
        (root / name).write_bytes(b"x")
    assert [r.file_name for r in records.library_listing(spark, str(root)).collect()] == ["a.PDF"]


def test_writers_of_entries_and_audits(spark, tmp_path):
    entries = spark.createDataFrame([("b", 1, "甲/乙", 1, 1, "x"), ("b", 2, "甲/乙", 2, 2, "y"), ("b", 3, None, 3, 3, "z")], "book string, entry_no int, title string, first_page int, last_page int, text string")
    index = sinks.write_entries(entries, str(tmp_path / "e"))
    assert sorted(r.name for r in index.collect()) == ["无题", "甲_乙", "甲_乙_2"] and len(list((tmp_path / "e" / "book=b").iterdir())) == 3
    sinks.write_audit_html(page(spark, [(2, "j", 2, "x", 0.5, "paddleocr", ["<a>"]), (1, "j", 1, None, None, None, None)]), str(tmp_path / "h"), "审计")
    text = "".join(p.read_text() for p in sorted((tmp_path / "h").glob("part-*")))
    assert text.index("<thead>") < text.index("<td>1</td>") < text.index("&lt;a&gt;") < text.index("</html>")
    chunks_ = spark.createDataFrame([("c1", "j1", "t"), ("c2", "j2", "u")], "chunk_id string, job_key string, text string")
    sinks.write_chunks(chunks_, str(tmp_path / "k"))
    sinks.write_chunks(chunks_.where("job_key = 'j1'").withColumn("text", F.lit("new")), str(tmp_path / "k"))
    assert sorted(r.text for r in spark.read.json(str(tmp_path / "k")).collect()) == ["new", "u"]


def test_a_folder_is_found_without_the_setting(spark, tmp_path):
    folder = tables.shared_folder(spark)
    assert folder
    made = tables.materialised(spark.range(3), "test")
    assert made.count() == 3
    tables.remove_intermediate(spark)
    with pytest.raises(Exception):
        made.count()


def test_a_folder_is_made_under_an_empty_configuration(tmp_path):
    import subprocess
    import sys
    from pathlib import Path

    code = "from codexweave.session import local_session; from codexweave.sources import tables; s = local_session(1); print(tables.materialised(s.range(2), 'x').count())"
    env = {"PATH": __import__("os").environ["PATH"], "SPARK_CONF_DIR": str(tmp_path), "HOME": str(tmp_path), "PYTHONPATH": str(Path(__file__).resolve().parents[1]), "JAVA_HOME": __import__("os").environ.get("JAVA_HOME", "")}
    env = {k: v for k, v in env.items() if v}
    done = subprocess.run([sys.executable, "-c", code], env=env, capture_output=True, text=True, timeout=120)
    assert done.stdout.strip().endswith("2"), done.stderr[-2000:]
