"""Chunks, rules, layout, rates, capacity, drift, readers and streams on small cases."""

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from codexweave.operators import capacity, chunks, classify, layout, library, rates, rules, schema_drift
from codexweave.sources import records, sinks


def pack_model(paragraphs, most):
    """Greedy packing in plain Python, for paragraphs within the limit."""
    out, open_ = [], ""
    for p in paragraphs:
        if open_ and len(open_) + len(p) + 2 > most:
            out.append(open_)
            open_ = ""
        open_ = f"{open_}\n\n{p}" if open_ else p
    return out + ([open_] if open_ else [])


def test_packed_like_the_model(spark):
    paragraphs = ["字" * n for n in (10, 30, 5, 44, 1, 20, 20, 50)]
    text = "\n\n".join(paragraphs)
    got = spark.createDataFrame([(text,), ("",), ("x" * 120,)], "t string").select(chunks.packed(F.col("t"), 50)).collect()
    assert got[0][0] == pack_model(paragraphs, 50)
    assert got[1][0] == [] and [len(c) for c in got[2][0]] == [50, 50, 20]


def test_sections_keep_headings(spark):
    text = "前文\n甲虫（Beetle）\n一\n二\n蝴蝶（Butterfly）\n三"
    rows = chunks.sections(spark.createDataFrame([(1, text), (2, None)], "page_id long, text string")).orderBy("section_no").collect()
    assert [(r.title, r.text) for r in rows] == [(None, "前文"), ("甲虫", "甲虫（Beetle）\n一\n二"), ("蝴蝶", "蝴蝶（Butterfly）\n三")]


def test_entry_ranges(spark):
    starts = spark.createDataFrame([("b", "一", 3), ("b", "二", 3), ("b", "三", 9)], "book string, title string, first_page int")
    got = chunks.entry_ranges(starts, spark.createDataFrame([("b", 12)], "book string, max_page int")).collect()
    assert sorted((r.title, r.last_page) for r in got) == [("一", 2), ("三", 12), ("二", 8)]


def test_signed_entries(spark):
    rows = [("b", 1, 1, "序言，很长的一句话。\n甲虫\n正文甲。"), ("b", 2, 2, "续甲。\n（王某）\n蝴蝶\n正文乙。\n（李某）\n尾巴，没有标题。")]
    got = chunks.signed_entries(spark.createDataFrame(rows, "book string, page_number int, page_id long, text string")).orderBy("entry_no").collect()
    assert [(r.title, r.author, r.first_page, r.last_page) for r in got] == [("甲虫", "王某", 1, 2), ("蝴蝶", "李某", 2, 2)]


RULES = "rule_order int, name string, title_keywords array<string>, replacements array<struct<wrong:string,right:string>>"


def test_rules_chain_in_order_and_need_all_keywords(spark):
    listed = spark.createDataFrame([(1, "a", [], [("甲", "乙")]), (2, "b", ["书", "卷"], [("乙", "丙")]), (3, "c", None, [("x", "x")])], RULES)
    pages = spark.createDataFrame([(1, "书一卷", "甲"), (2, "书一", "甲"), (3, None, "甲"), (4, "书", None)], "page_id long, book string, text string")
    got = {r.page_id: (r.text, r.n_changed) for r in rules.apply_rules(pages, listed).collect()}
    assert got == {1: ("丙", 2), 2: ("乙", 1), 3: ("甲", 0), 4: (None, 0)}


def test_upsert_replacement(spark):
    listed = spark.createDataFrame([(1, "a", ["k"], [("甲", "乙")])], RULES)
    changed = rules.upsert_replacement(listed, "a", ["k"], "甲", "丁").first()
    assert [(r.wrong, r.right) for r in changed.replacements] == [("甲", "丁")]
    assert rules.upsert_replacement(listed, "a", [], "甲", "丁").count() == 2
    with pytest.raises(ValueError):
        rules.upsert_replacement(listed, "a", [], "x\ny", "z")


def box(left, top, width=300.0, height=20.0):
    return [[left, top], [left + width, top], [left + width, top + height], [left, top + height]]


def test_two_columns_are_read_one_after_the_other():
    rows = [(f"left column line {i}", box(50.0, 40.0 * i)) for i in range(12)]
    rows += [(f"right column line {i}", box(500.0, 40.0 * i)) for i in range(12)]
    mixed = [r for pair in zip(rows[:12], rows[12:], strict=True) for r in pair] + [("loose", None)]
    order = [mixed[i][0] for i in layout.reading_order(mixed)]
    assert order == [r[0] for r in rows] + ["loose"]


def test_one_column_stays():
    rows = [(f"line {i} of a column", box(50.0 + 20 * (i % 3), 40.0 * i)) for i in range(30)]
    assert layout.reading_order(rows) == list(range(30))
    assert layout.reading_order([]) == []


def test_rates_reset_and_replay(spark):
    t = datetime(2025, 1, 1)
    rows = [("j", 1, 5, t), ("j", 2, 7, t + timedelta(seconds=120)), ("j", 3, 160, t + timedelta(seconds=134)), ("j", 4, 1, t + timedelta(seconds=200)), ("j", 5, 2, t + timedelta(seconds=230)), ("j", 5, 2, t + timedelta(seconds=230))]
    df = spark.createDataFrame(rows, "job_key string, snapshot_id long, processed_pages int, updated_at timestamp_ntz")
    got = {r.series: (r.pages, r.seconds_per_page) for r in rates.page_rates(rates.page_deltas(df)).collect()}
    assert got == {1: (2, 60.0), 2: (1, 30.0)}


def test_short_window_of_nineteen(spark):
    df = spark.createDataFrame([("j", i, float(i)) for i in range(1, 20)], "job string, seq int, seconds double")
    last = rates.short_window(df, "job", "seq", "seconds").orderBy(F.desc("seq")).first()
    assert (last.n, last.median_seconds, last.pages_per_minute) == (12, 13.5, round(60 / 13.5, 3))


def test_capacity_winner_within_the_band(spark):
    schema = "candidate string, workers int, threads int, pages_per_minute double, failed_pages int, low_confidence_ratio double"
    rows = [("1x2", 1, 2, 100.0, 0, 0.01), ("1x4", 1, 4, 120.0, 0, 0.01), ("2x2", 2, 2, 127.0, 0, 0.01), ("2x4", 2, 4, 130.0, 0, 0.01), ("3x4", 3, 4, 900.0, 0, 0.10)]
    assert capacity.best_trial(spark.createDataFrame(rows, schema)).first()[0] == "2x2"
    assert capacity.best_trial(spark.createDataFrame([], schema)).first()[0] is None


def test_resource_totals_keep_the_unknown_apart(spark):
    df = spark.createDataFrame([("a", None, 1.0), ("a", None, None), ("b", 5.0, None)], "k string, cpu_percent double, memory_mb double")
    got = {r.k: (r.cpu_percent, r.cpu_known, r.memory_mb) for r in capacity.resource_totals(df, "k").collect()}
    assert got == {"a": (None, 0, 1.0), "b": (5.0, 1, None)}


def test_sample_positions(spark):
    df = spark.createDataFrame([(0,), (5,), (1000,)], "n int").select(classify.sample_positions(F.col("n"), 10)).collect()
    assert df[0][0] == [] and df[1][0] == [1, 2, 3, 4, 5]
    assert df[2][0][:3] == [1, 2, 3] and df[2][0][-1] == 1000 and len(df[2][0]) <= 10


def test_document_kinds(spark):
    schema = "job_key string, page_number int, text_chars int, garble double, likely_scanned boolean, usable boolean, is_contents boolean"
    rows = [("born", i, 500, 0.0, False, True, False) for i in range(4)] + [("image", i, 0, 0.0, True, False, False) for i in range(4)]
    rows += [("broken", i, 500, 0.5, False, False, False) for i in range(4)]
    got = {r.job_key: r.kind for r in classify.document_kinds(spark.createDataFrame(rows, schema)).collect()}
    assert got == {"born": "born_digital", "image": "image_only", "broken": "broken_layer"}


def raw(spark, files, feed="f", kind="status"):
    rows, n = [], 0
    for no, objects in enumerate(files, 1):
        for line, o in enumerate(objects, 1):
            n += 1
            rows.append((n, feed, kind, f"{no}.json", no, line, o if o is None or isinstance(o, str) else json.dumps(o, ensure_ascii=False), datetime(2025, 1, 1)))
    return spark.createDataFrame(rows, "record_id long, feed string, kind string, file_name string, file_no int, line_no int, payload string, received_at timestamp_ntz")


def test_drift_names_renames_moves_and_types(spark):
    first = [{"运行编号": f"r{i}", "状态": "完成", "已处理页数": 10 + i, "引擎": "x", "备注": None} for i in range(6)]
    second = [{"运行编号": f"r{i}", "统计": {"状态": "完成"}, "完成页数": f"{10 + i}", "重试次数": 7} for i in range(3, 9)]
    files = [[*first, None, "", '{"运行编号": "cut', "[1, 2]"], second, []]
    got = {tuple(r) for r in schema_drift.found_changes(raw(spark, files)).collect()}
    assert got == {
        ("f", 2, "统计.状态", "renamed"), ("f", 2, "完成页数", "renamed"), ("f", 2, "完成页数", "retyped"), ("f", 2, "引擎", "removed"), ("f", 2, "重试次数", "added"),
    }


def test_drift_table_follows_the_renames(spark):
    files = [[{"运行编号": f"r{i}", "已处理页数": 10 + i} for i in range(4)], [{"运行编号": f"r{i}", "qty": f" {10 + i}页"} for i in range(2, 6)]]
    like = spark.createDataFrame([], "job_key string, processed_pages int, run_id string, other string")
    rows = schema_drift.consistent_table(raw(spark, files), "status", like).orderBy("record_id").collect()
    assert [r.processed_pages for r in rows] == [10, 11, 12, 13, 12, 13, 14, 15]
    assert all(r.other is None for r in rows)


def test_drift_table_with_two_fields_for_one_column(spark):
    like = spark.createDataFrame([], "processed_pages int")
    rows = schema_drift.consistent_table(raw(spark, [[{"运行编号": "r", "已处理页数": 3, "processed_pages": 4}, {"x": 1}]]), "status", like).orderBy("line_no").collect()
    assert [r.processed_pages for r in rows] == [3, None]


def test_drift_of_nothing(spark):
    assert schema_drift.found_changes(raw(spark, [])).count() == 0
    assert schema_drift.found_changes(raw(spark, [[None, ""], ["x"]])).count() == 0


def test_cheapest_pairs_against_all_permutations():
    from itertools import permutations
    from random import Random

    rng = Random(5)
    for _ in range(40):
        n, m = rng.randint(1, 4), rng.randint(1, 4)
        gain = [[rng.uniform(-3, 5) for _ in range(m)] for _ in range(n)]
        got = sum(gain[i][j] for i, j in schema_drift.cheapest_pairs(gain))
        size = max(n, m)
        best = max(sum(max(0, gain[i][p[i]]) for i in range(n) if p[i] < m) for p in permutations(range(size)))
        assert got == pytest.approx(best)


def test_versions_with_ties_and_null_sources(spark):
    schema = "snapshot_id long, job_key string, job_dir string, status string, source_pdf string, target_pages int, processed_pages int, text_pages int, blank_pages int, failed_pages int, low_confidence_pages int, total_pages int, is_sample boolean, updated_at timestamp_ntz, mode string"
    t = datetime(2025, 1, 1)
    rows = [(i, f"j{i}", f"/d/{i}", s, src, 9, p, 0, 0, 0, 0, 9, smp, t, "m") for i, (s, src, p, smp) in enumerate([("完成", "a", 9, False), (" 完成 ", "a", 9, False), ("done", None, 9, False), ("失败", "a", 9, False), ("完成", "b", 9, True), ("完成", "c", 5, False)])]
    jobs, quality = spark.createDataFrame(rows, schema), spark.createDataFrame([], "job_key string, total_pages int")
    kept = {r.job_key for r in library.selected_versions(jobs, quality).where("rank = 1").collect()}
    assert kept == {"j1", "j2"}
    assert {r.job_key: r.reason for r in library.skipped_versions(jobs, quality).collect()} == {"j0": "other version kept", "j3": "not done", "j4": "sample", "j5": "incomplete"}


def test_read_pages_in_either_spelling(spark, tmp_path):
    lines = ['{"page_number": 3, "text": "a", "confidence": 0.5}', '{"页码": 4, "文本": "b", "来源": "飞桨OCR", "警告": ["w"]}', "{cut", "", '{"text": "c"}']
    (tmp_path / "0007.jsonl").write_text("\n".join(lines), encoding="utf-8")
    pages, bad = records.read_pages(spark, str(tmp_path))
    got = sorted((r.page_number, r.text, r.source) for r in pages.collect())
    assert got == [(3, "a", None), (4, "b", "paddleocr"), (7, "c", None)] and bad.count() == 1


def test_listing_and_writers(spark, tmp_path):
    for name in ("a.pdf", "sub/b.PDF", ".git/c.pdf", "d.txt"):
        (tmp_path / "lib" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "lib" / name).write_bytes(b"x")
    assert sorted(r.file_name for r in records.library_listing(spark, str(tmp_path / "lib")).collect()) == ["a.pdf", "b.PDF"]
    pages = spark.createDataFrame([("b", 2, "zwei", "x"), ("b", 1, "eins", "x"), ("b", 3, None, "blank_page")], "book string, page_number int, text string, source string")
    sinks.write_book_text(pages, str(tmp_path / "out"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "out" / "book=b").glob("part-*")))
    assert text.index("eins") < text.index("zwei") < text.index(sinks.BLANK_PAGE)
    sinks.write_catalogue_csv(spark.createDataFrame([("p", None)], "path string, n int"), str(tmp_path / "csv"))
    parts = [p.read_text(encoding="utf-8") for p in (tmp_path / "csv").glob("part-*")]
    assert all(p.startswith("﻿path,n\n") for p in parts) and any("p,\n" in p for p in parts)
    assert records.read_rules(str(tmp_path / "none.yaml")) == ([], None)
    (tmp_path / "bad.yaml").write_text("rules: [1")
    assert records.read_rules(str(tmp_path / "bad.yaml"))[0] == [] and records.read_rules(str(tmp_path / "bad.yaml"))[1]


def test_pages_of_books(spark):
    books = spark.createDataFrame([("b", "vorher\n## 第 1 页\n\neins\n## 2\nzwei\n## 第 1 页\nneu\n"), ("n", None), ("e", "")], "book string, text string")
    assert sorted(tuple(r) for r in records.pages_of_books(books).collect()) == [("b", 1, "neu"), ("b", 2, "zwei")]


def test_stream_of_heartbeats(spark, tmp_path):
    from codexweave.streaming import monitor

    t = datetime(2025, 1, 1)
    rows = [("j", 1, 5, t), ("j", 1, 7, t + timedelta(seconds=120)), ("k", 1, 1, t), ("j", 2, 0, t + timedelta(seconds=180)), ("j", 2, 1, t + timedelta(seconds=210))]
    schema = "job_key string, pid int, pages int, ts timestamp"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    query = monitor.page_rates(stream).writeStream.outputMode("update").format("memory").queryName("page_rates").option("checkpointLocation", str(tmp_path / "cp")).start()
    query.processAllAvailable()
    query.stop()
    got = {r.job_key: (r.pages, r.seconds_per_page, r.resets) for r in spark.sql("select * from page_rates").collect()}
    assert got["j"] == (1, 30.0, 1) and got["k"][0] == 0
