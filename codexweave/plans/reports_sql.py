"""DuckDB counterparts of the queries in ``reports`` and of those in ``books`` that need more than one line."""

from codexweave.plans.books_sql import ORACLES as BOOKS
from codexweave.plans.books_sql import BLANKS, FEATURES, LATEST, LINE_END, PAGES, filled, strip

_NOW = "TIMESTAMP '2025-12-31 00:00:00'"


def half_even(x: str, digits: int) -> str:
    """Rounding of a number's decimal form, halves to the even neighbour."""
    scale = 10**digits
    d = f"(CAST({x} AS DECIMAL(30, 10)) * {scale})"
    q = f"floor({d})"
    return f"CASE WHEN {d} - {q} > 0.5 OR ({d} - {q} = 0.5 AND CAST({q} AS BIGINT) % 2 <> 0) THEN CAST({q} + 1 AS DOUBLE) ELSE CAST({q} AS DOUBLE) END / {scale}"


def duration(s: str) -> str:
    h, m, r = f"({s} // 3600)", f"(({s} % 3600) // 60)", f"({s} % 60)"
    return f"CASE WHEN {s} IS NULL THEN '未知' WHEN {h} > 0 THEN {h} || '小时' || {m} || '分' || {r} || '秒' WHEN {m} > 0 THEN {m} || '分' || {r} || '秒' ELSE {r} || '秒' END"


_LABELS = {
    "done": ("完成", "已完成", "done", "complete", "completed", "finished", "ok"), "running": ("处理中", "进行中", "启动中", "running"), "queued": ("排队", "排队中", "queued", "pending"),
    "incomplete": ("未完成", "incomplete", "partial"), "failed": ("失败", "已失败", "failed", "error", "出错"), "cancelled": ("已取消", "取消", "cancelled", "canceled"),
}


def label(status: str) -> str:
    cases = " ".join(f"WHEN lower({strip(status)}) IN ({', '.join(repr(s) for s in spelled)}) THEN '{name}'" for name, spelled in _LABELS.items())
    return f"(CASE {cases} ELSE 'unknown' END)"


def base(path: str) -> str:
    return f"list_extract(regexp_split_to_array({path}, '[/\\\\]'), -1)"


_JOBS = f"""{LATEST},
pace AS (SELECT job_key, arg_max(s, (updated_at, snapshot_id)) AS s FROM (SELECT job_key, updated_at, snapshot_id, {{'elapsed': elapsed_seconds, 'average': avg_seconds_per_page}} AS s FROM job_status WHERE job_key IS NOT NULL) GROUP BY job_key),
j0 AS (SELECT c.job_key, c.source_pdf, {label('c.status')} AS state, coalesce(nullif(c.total_pages, 0), nullif(c.quality_total, 0), c.target, 0) AS expected_pages, coalesce(c.processed, 0) AS processed_pages,
    coalesce(c.target, 0) AS target_pages, c.updated_at, p.s.elapsed AS elapsed, p.s.average AS average FROM cand c LEFT JOIN pace p USING (job_key)),
j1 AS (SELECT *, state = 'done' AND CASE WHEN expected_pages <= 0 THEN processed_pages > 0 AND processed_pages >= target_pages AND target_pages > 0 ELSE processed_pages >= expected_pages AND target_pages >= expected_pages END AS is_complete,
    coalesce(average, CASE WHEN processed_pages > 0 THEN elapsed / processed_pages END) AS raw_speed, greatest(0, datediff('second', updated_at, {_NOW})) AS age_seconds FROM j0),
j2 AS (SELECT *, CASE WHEN raw_speed IS NULL THEN NULL ELSE {half_even('raw_speed', 2)} END AS seconds_per_page,
    CASE WHEN target_pages > 0 THEN {half_even('processed_pages * 100.0 / target_pages', 1)} ELSE 0.0 END AS progress_percent,
    coalesce(state = 'running' AND processed_pages < target_pages AND age_seconds >= 600, false) AS is_stalled FROM j1),
jobs AS (SELECT *, CASE WHEN seconds_per_page IS NULL THEN NULL ELSE CAST({half_even('seconds_per_page * greatest(target_pages - processed_pages, 0)', 0)} AS BIGINT) END AS seconds_left,
    CASE WHEN is_stalled THEN 'stalled' ELSE state END AS runtime_state FROM j2)"""

_EVIDENCE = f"""{_JOBS}, {FEATURES},
ec AS (SELECT job_key, count(*) FILTER (low) AS low_confidence_pages, count(*) FILTER (low AND is_dense_index) AS protected_pages, count(*) FILTER (NOT blank AND text_chars = 0) AS blank_pages,
    count(*) FILTER (is_diagram AND n_noise_lines >= 2) AS residual_pages, count(*) FILTER (is_illustration) AS illustration_pages
  FROM (SELECT *, coalesce(source = 'blank_page', false) AS blank, NOT coalesce(source = 'blank_page', false) AND coalesce(confidence, 0) < 0.9 AS low FROM f) GROUP BY job_key),
ew AS (SELECT job_key, unnest(range(1, target + 1))::INT AS page_number FROM cand WHERE target > 0),
eu AS (SELECT job_key, count(*) AS unchecked_pages FROM (SELECT * FROM ew ANTI JOIN pages USING (job_key, page_number)) GROUP BY job_key),
ee AS (SELECT jobs.job_key, state, is_stalled, target_pages, processed_pages, low_confidence_pages, protected_pages, blank_pages, residual_pages, illustration_pages, unchecked_pages,
    jobs.job_key IN (SELECT job_key FROM quality WHERE job_key IS NOT NULL) AS has_audit,
    greatest(coalesce(unchecked_pages, 0), target_pages - processed_pages, 0) AS missing, greatest(coalesce(low_confidence_pages, 0) - coalesce(protected_pages, 0), 0) AS low
  FROM jobs LEFT JOIN ec USING (job_key) LEFT JOIN eu USING (job_key)),
eh AS (SELECT *, list_filter([
    CASE WHEN is_stalled OR state = 'failed' THEN {{'r': 'task_recovery_required', 's': 'high', 'a': 'review_and_recover_task'}} END,
    CASE WHEN missing > 0 THEN {{'r': 'incomplete_coverage', 's': CASE WHEN state = 'failed' THEN 'high' ELSE 'medium' END, 'a': 'complete_page_coverage'}} END,
    CASE WHEN low > 0 THEN {{'r': 'low_confidence_text', 's': CASE WHEN low >= 10 THEN 'high' ELSE 'medium' END, 'a': 'sample_low_confidence_pages'}} END,
    CASE WHEN coalesce(blank_pages, 0) > 0 THEN {{'r': 'blank_page_output', 's': 'high', 'a': 'review_blank_pages'}} END,
    CASE WHEN coalesce(residual_pages, 0) > 0 OR coalesce(illustration_pages, 0) > 0 THEN {{'r': 'layout_or_illustration_risk', 's': 'medium', 'a': 'manual_layout_review'}} END,
    CASE WHEN NOT has_audit THEN {{'r': 'missing_quality_evidence', 's': 'medium', 'a': 'generate_quality_audit'}} END], lambda x: x IS NOT NULL) AS held FROM ee),
ek AS (SELECT *, CASE WHEN len(held) > 0 THEN list_transform(held, lambda x: x.a) ELSE ['preserve_current_version'] END AS acts FROM eh)"""


def _n(c: str) -> str:
    return f"'\"{c}\":' || coalesce(CAST({c} AS VARCHAR), 'null')"


_CANONICAL = (
    "'{\"action_ids\":[' || array_to_string(list_transform(acts, lambda x: '\"' || x || '\"'), ',') || '],\"evidence\":{' || "
    + " || ',' || ".join([_n(c) for c in ("blank_pages", "illustration_pages", "low_confidence_pages", "processed_pages", "protected_pages")] + ["'\"refreshable_pages\":0'"] + [_n(c) for c in ("residual_pages", "state", "target_pages", "unchecked_pages")])
    + " || '},\"risk_ids\":[' || array_to_string(list_transform(held, lambda x: '\"' || x.r || '\"'), ',') || '],\"schema_version\":\"1.0\",\"strategy_version\":\"rules-v1\"}'"
)

_COUNTS = ("target_pages", "processed_pages", "text_pages", "blank_pages", "low_confidence_pages", "failed_pages")
_SNAPSHOTS = f"""
s0 AS (SELECT job_key, arg_max(s, (updated_at, snapshot_id)) AS s, min(source_pdf) AS source_pdf, min(mode) AS mode FROM (SELECT *, {{'status': status, 'job_dir': job_dir, 'engine': engine, 'updated_at': updated_at, {', '.join(f"'{c}': {c}" for c in _COUNTS)}}} AS s FROM job_status WHERE job_key IS NOT NULL) GROUP BY job_key),
q0 AS (SELECT DISTINCT ON (job_key) * FROM quality WHERE job_key IS NOT NULL ORDER BY job_key, written_at DESC NULLS LAST, quality_id DESC),
snap AS (SELECT 'backfill' AS event, s0.job_key, {base('s.job_dir')} AS job_dir, {base('s0.source_pdf')} AS source_pdf, coalesce(s.status, '未知') AS status, s0.mode, coalesce(nullif(s.engine, ''), q0.engine) AS engine,
    {', '.join(f"coalesce(nullif(s.{c}, 0), nullif(q0.{'output_pages' if c == 'processed_pages' else c}, 0), s.{c}, q0.{'output_pages' if c == 'processed_pages' else c}) AS {c}" for c in _COUNTS)}, s.updated_at AS recorded
  FROM s0 LEFT JOIN q0 ON q0.job_key = s0.job_key)"""

_SERIES = "中国农业百科全书"


def _titles(table: str) -> str:
    """Volume titles of a table's ``book``, in order and each once."""
    trim = lambda x, more="": f"trim({x}, ' -_：:{more}')"
    last = lambda x, sep: f"list_extract(string_split({x}, '{sep}'), -1)"
    first = f"""nullif(CASE WHEN contains(book, '：') THEN {strip(last('book', '：'))} WHEN contains(book, ':') THEN {strip(last('book', ':'))}
      WHEN starts_with(book, '{_SERIES}') THEN {trim(f"substr(book, {len(_SERIES) + 1})")} END, '')"""
    parts = ", ".join(f"CASE WHEN contains(t, '{d}') THEN nullif({strip(last('t', d))}, '') END" for d in ("-", "－", "—", "–"))
    return f"""SELECT book, array_to_string(list_transform(list_filter(list_zip(ts, range(1, len(ts) + 1)), lambda z: list_position(ts, z[1]) = z[2]), lambda z: z[1]), '|') AS titles
FROM (SELECT book, list_filter([t, {parts}, CASE WHEN contains(t, '分册') THEN nullif({trim(last('t', '分册'), '－—–')}, '') END], lambda x: x IS NOT NULL) AS ts FROM (SELECT book, {first} AS t FROM {table}))"""


_SOURCES = "src AS (SELECT job_key, min(source_pdf) AS source_pdf FROM job_status WHERE source_pdf IS NOT NULL AND job_key IS NOT NULL GROUP BY job_key)"
_LAYER = "coalesce(source IN ('pdf_text_layer', 'existing_ocr_text_layer'), false)"


def layer_text(x: str) -> str:
    """Text of a PDF's own layer with each line and the whole stripped."""
    return strip(f"array_to_string(list_transform(regexp_split_to_array(replace({x}, chr(0), ''), '{LINE_END}'), lambda l: {strip('l')}), chr(10))")


_BOXES = """
bx AS (SELECT page_id, blocks, list_filter(list_transform(blocks, lambda b: CASE
    WHEN len(b.bbox) = 1 AND len(b.bbox[1]) = 4 THEN {'l': b.bbox[1][1], 't': b.bbox[1][2], 'r': b.bbox[1][3], 'b': b.bbox[1][4]}
    WHEN len(b.bbox) = 4 AND len(list_filter(b.bbox, lambda p: len(p) = 1)) = 4 THEN {'l': b.bbox[1][1], 't': b.bbox[2][1], 'r': b.bbox[3][1], 'b': b.bbox[4][1]}
    ELSE {'l': list_min(list_transform(b.bbox, lambda p: p[1])), 't': list_min(list_transform(b.bbox, lambda p: p[2])), 'r': list_max(list_transform(b.bbox, lambda p: p[1])), 'b': list_max(list_transform(b.bbox, lambda p: p[2]))} END),
    lambda x: x.l IS NOT NULL AND x.b IS NOT NULL) AS bs FROM p WHERE blocks IS NOT NULL)"""

_TRIALS = """t(candidate, workers, threads, ppm, failed, low, mem, cpu, rss, use, ext) AS (VALUES
  ('1x1', 1, 1, 60.0, 0, 0.01, 9.0, 40.0, 900.0, 95.0, 3.0), ('1x2', 1, 2, 100.0, 0, 0.01, 8.0, 55.0, 950.0, 90.0, 3.0), ('1x4', 1, 4, 104.0, 0, 0.01, 8.0, 70.0, 980.0, 60.0, 2.0),
  ('2x2', 2, 2, 127.0, 0, 0.02, 6.0, 75.0, 1900.0, 84.0, 2.0), ('2x4', 2, 4, 131.0, 0, 0.02, 6.0, 88.0, 2000.0, 70.0, NULL), ('3x2', 3, 2, 150.0, 2, 0.02, 4.0, 90.0, 2800.0, 70.0, 4.0),
  ('3x4', 3, 4, 170.0, 0, 0.09, 4.0, 91.0, 2900.0, 70.0, 4.0), ('4x2', 4, 2, 140.0, 0, 0.02, 1.5, 95.0, 3900.0, 70.0, 4.0), ('4x4', 4, 4, NULL, 0, 0.0, NULL, NULL, NULL, NULL, NULL)),
r1 AS (SELECT *, list_filter([CASE WHEN coalesce(ppm, 0) <= 0 THEN '未取得有效吞吐率' END, CASE WHEN failed > 0 THEN '存在失败页' END, CASE WHEN mem <= 2 THEN '可用内存触及保留水位' END, CASE WHEN cpu > 92 THEN '整机CPU超过安全护栏' END], lambda x: x IS NOT NULL) AS rs FROM t),
b AS (SELECT arg_max({'rate': ppm, 'low': low}, ppm) AS b FROM r1 WHERE workers = 1 AND len(rs) = 0),
r2 AS (SELECT r1.*, b.b AS base, CASE WHEN len(rs) = 0 AND low > b.b.low + 0.03 THEN list_append(rs, '低置信页比例相对单 worker 基线回退') ELSE rs END AS reasons FROM r1, b)"""

_SIGNATURE = r"^\s*[（(]([\x{4E00}-\x{9FFF}·]{2,6})[）)]\s*$"
_TITLE = r"^\s*([\x{4E00}-\x{9FFF}][\x{4E00}-\x{9FFF}\w ]{1,30}?)(?:\(([a-zA-Z][a-zA-Z ._;,\-]+)\))?\s*$"

_EV = "ev AS (SELECT event_id, ts, user_id, event_type, CAST(json_extract(props, '$.k') AS INT) AS page FROM events)"
_QUEUE = f"""{_EV}, q AS (SELECT user_id, min(ts) AS created_at FROM ev WHERE event_type = 'signup' GROUP BY user_id),
l AS (SELECT user_id, max(ts) + INTERVAL 10 DAYS AS expires_at FROM ev WHERE event_type = 'purchase' GROUP BY user_id),
free AS (SELECT user_id, created_at FROM q WHERE user_id NOT IN (SELECT user_id FROM l WHERE expires_at > TIMESTAMP '2024-01-20 00:00:00'))"""

_MODES = "CASE mode WHEN 'book-fast' THEN 0.75 WHEN 'book-balanced' THEN 1.0 WHEN 'book-quality' THEN 1.8 WHEN 'book-forensic' THEN 3.0 END"

# every character of a page with its place, its kind and the run of equal characters it stands in
_CHARS = f"""
ch AS (SELECT page_id, unnest(string_split(text, '')) AS c, unnest(range(1, length(text) + 1)) AS i FROM g),
ck AS (SELECT page_id, c, i, i - row_number() OVER (PARTITION BY page_id, c ORDER BY i) AS isle FROM ch),
rn AS (SELECT page_id, sum(n) AS runs FROM (SELECT page_id, count(*) AS n FROM ck WHERE NOT regexp_matches(c, '{LINE_END}') GROUP BY page_id, c, isle HAVING count(*) >= 9) GROUP BY page_id),
gs AS (SELECT g.page_id, length(text) AS total, coalesce(runs, 0) AS runs,
    len(regexp_extract_all(text, '\\(cid:\\d+\\)')) * 5 + len(regexp_extract_all(text, '[\\x{{FFFD}}□▯■]')) * 3 + len(regexp_extract_all(text, '[\\p{{Cc}}\\p{{Cf}}\\p{{Co}}]')) * 2 - len(regexp_extract_all(text, '[\\n\\r\\t]')) * 2 AS signs,
    length(text) - len(regexp_extract_all(text, '{BLANKS}')) AS shown,
    len(regexp_extract_all(text, '[\\p{{L}}\\p{{Nd}}²³¹⁰⁴-⁹₀-₉①-⑨⑴-⑼⒈-⒐⓪⓵-⓽⓿❶-❾➀-➈➊-➒፩-፱]')) AS meant
  FROM g LEFT JOIN rn USING (page_id)),
gb AS (SELECT page_id, total, CASE WHEN total = 0 THEN 0.0 WHEN total > 0 THEN
    least(1.0, (signs + CASE WHEN shown > 0 THEN greatest(0.0, floor((0.35 - meant / shown) * total)) ELSE 0 END + runs) / greatest(total, 1)) END AS garble FROM gs)"""

ORACLES = {
    "job_reports": f"WITH {_JOBS} SELECT job_key, source_pdf, state, expected_pages, processed_pages, target_pages, is_complete, progress_percent, seconds_per_page, seconds_left, age_seconds, is_stalled, runtime_state, {duration('seconds_left')} AS left_text FROM jobs",
    "batch_reports": f"""WITH {_JOBS},
b AS (SELECT coalesce(regexp_extract(source_pdf, '^(.*)[/\\\\]', 1), '') AS folder, count(*) AS n_jobs, count(*) FILTER (is_complete) AS n_complete, count(*) FILTER (state = 'failed') AS n_failed,
  count(*) FILTER (runtime_state = 'running') AS n_running, count(*) FILTER (is_stalled) AS n_stalled, sum(processed_pages)::BIGINT AS processed_pages,
  sum(CASE WHEN NOT is_complete THEN greatest(target_pages - processed_pages, 0) ELSE 0 END)::BIGINT AS pages_left,
  round(sum(CASE WHEN runtime_state = 'running' AND seconds_per_page > 0 THEN 60.0 / seconds_per_page END), 3) AS pages_per_minute FROM jobs GROUP BY 1)
SELECT *, CASE WHEN pages_per_minute > 0 THEN round(pages_left / pages_per_minute, 1) END AS minutes_left FROM b""",
    "batch_selection": f"""WITH {_JOBS}, s AS (SELECT source_pdf, max(is_complete::INT) = 1 AS covered FROM jobs WHERE source_pdf IS NOT NULL GROUP BY source_pdf),
n AS (SELECT source_pdf, row_number() OVER (ORDER BY source_pdf) AS n FROM s WHERE NOT covered)
SELECT source_pdf, CASE WHEN covered THEN 'skipped' WHEN n <= 20 THEN 'taken' ELSE 'later' END AS action FROM s LEFT JOIN n USING (source_pdf)""",
    "state_labels": f"SELECT {label('status')} AS state, count(*) AS n FROM job_status GROUP BY 1",
    "job_coverage": f"""WITH {LATEST}, x AS (SELECT *, coalesce(nullif(processed, 0), target, 0) AS n, coalesce(nullif(total_pages, 0), nullif(quality_total, 0)) AS total FROM cand)
SELECT job_key, done AND NOT coalesce(is_sample, false) AND NOT coalesce(n < total, false) AS covers_all, done AND n >= 30 AS covers_30 FROM x""",
    "iteration_plans": f"""WITH {_EVIDENCE}
SELECT job_key, array_to_string(list_transform(held, lambda x: x.r), ',') AS risks, array_to_string(list_transform(held, lambda x: x.s), ',') AS severities, array_to_string(acts, ',') AS actions,
  len(list_filter(acts, lambda x: x NOT IN ('preserve_current_version', 'generate_quality_audit'))) > 0 AS needs_approval, 'iteration-' || left(sha256({_CANONICAL}), 16) AS plan_id FROM ek""",
    "history_collected": f"""WITH {_SNAPSHOTS},
ev AS (SELECT DISTINCT event, job_key, job_dir, source_pdf, status, mode, engine, {', '.join(_COUNTS)}, run_id, replace(replace(recorded_at, 'T', ' '), '/', '-') AS recorded FROM history)
SELECT event, job_key, {base('job_dir')} AS job_dir, {base('source_pdf')} AS source_pdf, status, mode, engine, {', '.join(_COUNTS)} FROM ev WHERE status = '完成'
UNION ALL SELECT event, job_key, job_dir, source_pdf, status, mode, engine, {', '.join(_COUNTS)} FROM snap WHERE status = '完成' AND job_key NOT IN (SELECT job_key FROM history WHERE job_key IS NOT NULL)""",
    "backfilled_events": f"WITH {_SNAPSHOTS} SELECT * FROM snap",
    "book_completions": f"SELECT job_key, coalesce(arg_max({label('status')}, (updated_at, snapshot_id)) = 'done', false) AS is_completed FROM job_status WHERE job_key IS NOT NULL GROUP BY job_key",
    "book_states": f"""WITH s AS (SELECT source_pdf, {label('status')} AS l FROM job_status WHERE source_pdf IS NOT NULL)
SELECT source_pdf, CASE WHEN bool_or(l = 'queued') THEN 'active' WHEN bool_or(l = 'done') THEN 'completed' WHEN bool_or(l IN ('failed', 'cancelled')) THEN 'failed' ELSE 'pending' END AS state FROM s GROUP BY source_pdf""",
    "page_evidence": f"""WITH {_SOURCES},
n AS (SELECT DISTINCT job_key, page_id, page_number, {_LAYER} AS layer, length({strip("coalesce(text, '')")}) AS chars FROM pages WHERE page_id IS NOT NULL AND page_number IS NOT NULL),
e AS (SELECT source_pdf, page_number, max(chars) FILTER (layer) AS direct_chars, max(chars) FILTER (NOT layer) AS recognised_chars, count(*) AS n_readings FROM n JOIN src USING (job_key) GROUP BY source_pdf, page_number)
SELECT source_pdf, page_number, direct_chars, recognised_chars, CASE WHEN direct_chars > 0 THEN 'direct' WHEN recognised_chars > 0 THEN 'recognised' ELSE 'none' END AS chosen, n_readings FROM e""",
    "resume_plan": f"""WITH {LATEST}, {_SOURCES},
w AS (SELECT job_key, source_pdf, unnest(range(1, target + 1))::INT AS page_number FROM cand WHERE target > 0),
d AS (SELECT DISTINCT source_pdf, page_number FROM pages JOIN src USING (job_key) WHERE {_LAYER} AND length({layer_text("coalesce(text, '')")}) >= 30)
SELECT job_key, page_number, CASE WHEN (job_key, page_number) IN (SELECT (job_key, page_number) FROM pages WHERE job_key IS NOT NULL AND page_number IS NOT NULL) THEN 'cached'
  WHEN source_pdf IS NOT NULL AND (source_pdf, page_number) IN (SELECT (source_pdf, page_number) FROM d WHERE page_number IS NOT NULL) THEN 'direct' ELSE 'recognise' END AS action FROM w""",
    "direct_pages": f"""WITH l AS (SELECT DISTINCT job_key, page_number, text FROM pages WHERE {_LAYER}), c AS (SELECT job_key, page_number, {layer_text("coalesce(text, '')")} AS text FROM l)
SELECT job_key, page_number, text, CAST(CASE WHEN text = '' THEN 0 ELSE 1 END AS DOUBLE) AS confidence, 'pdf_text_layer' AS source, CASE WHEN text = '' THEN 1 ELSE 0 END AS n_warnings
FROM c WHERE text <> '' AND (job_key, page_number) IN (SELECT (job_key, page_number) FROM pages WHERE confidence < 0.9 AND job_key IS NOT NULL AND page_number IS NOT NULL)""",
    "review_pages": f"""WITH {PAGES}
SELECT page_id, NOT coalesce(source = 'blank_page', false) AND (coalesce(confidence, 0) < 0.9 OR {strip("coalesce(text, '')")} = '') AS needs_review,
  len(list_filter(coalesce(warnings, []), lambda w: contains(w, '高分辨率重跑'))) > 0 AS is_upgraded,
  coalesce(confidence, 0) < 0.72 AND len(list_filter(coalesce(warnings, []), lambda w: contains(w, '高分辨率重跑未改善') OR contains(w, '高分辨率重跑失败') OR contains(w, '高分辨率重跑文字明显变少'))) > 0 AS needs_rotation FROM p""",
    "upgraded_pages": f"""WITH {PAGES}, {_SOURCES},
h AS (SELECT source_pdf, page_number, list({{'c': coalesce(confidence, 0.0), 't': coalesce(text, ''), 'n': length({strip("coalesce(text, '')")})}} ORDER BY job_key, page_id) AS h FROM p JOIN src USING (job_key) WHERE page_number IS NOT NULL GROUP BY source_pdf, page_number HAVING count(*) > 1),
z AS (SELECT source_pdf, page_number, len(h) AS n_readings, list_reduce(h, lambda a, b: CASE WHEN b.n > 0 AND (a.n = 0 OR (NOT (a.n >= 120 AND b.n < a.n * 0.85) AND (b.c > a.c OR (b.c = a.c AND b.n > a.n)))) THEN b ELSE a END) AS b FROM h)
SELECT source_pdf, page_number, n_readings, b.c AS confidence, length(b.t) AS n_chars FROM z""",
    "block_measures": f"""WITH {PAGES}, {_BOXES}
SELECT page_id, len(blocks) AS n_blocks, coalesce(round(round(list_avg(list_transform(blocks, lambda b: b.confidence)), 9), 4), 0.0) AS mean_confidence,
  CASE WHEN len(bs) > 0 THEN round(least(1.0, list_sum(list_transform(bs, lambda x: greatest(x.r - x.l, 0.0) * greatest(x.b - x.t, 0.0))) / greatest((list_max(list_transform(bs, lambda x: x.r)) - list_min(list_transform(bs, lambda x: x.l))) * (list_max(list_transform(bs, lambda x: x.b)) - list_min(list_transform(bs, lambda x: x.t))), 1.0)), 4) ELSE 0.0 END AS area_share FROM bx""",
    "volume_titles": _titles("(SELECT DISTINCT book FROM pages WHERE book IS NOT NULL)"),
    "volume_titles_of_headings": _titles(f"(SELECT DISTINCT book FROM (SELECT list_extract({filled('text')}, 1) AS book FROM documents) WHERE book IS NOT NULL)"),
    "result_folders": f"""WITH s AS (SELECT DISTINCT source_pdf FROM job_status WHERE source_pdf IS NOT NULL),
x AS (SELECT source_pdf, regexp_extract(source_pdf, '^(.*)[/\\\\][^/\\\\]*$', 1) AS parent, regexp_replace({base('source_pdf')}, '^(.+)\\.[^.]*$', '\\1') AS stem FROM s)
SELECT source_pdf, '/data/out' || CASE WHEN starts_with(parent, '/data/library') AND regexp_replace(substr(parent, 14), '^/+', '') <> '' THEN '/' || regexp_replace(substr(parent, 14), '^/+', '') ELSE '' END || '/' ||
    coalesce(nullif(regexp_replace(regexp_replace(stem, '[^\\p{{L}}\\p{{M}}\\p{{N}}_.-]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), '未命名书籍') || '-rescue-result' AS folder,
  left({strip(f"regexp_replace(regexp_replace(stem, '[\\\\/:*?\"<>|]', '_', 'g'), '{BLANKS}+', ' ', 'g')")}, 80) AS file_name,
  coalesce(nullif(regexp_replace(regexp_replace(stem, '[^A-Za-z0-9._-]+', '-', 'g'), '^[.-]+|[.-]+$', '', 'g'), ''), 'book') AS component FROM x""",
    "resolutions": """SELECT DISTINCT mode, CASE WHEN mode IS NULL THEN NULL WHEN contains(lower(mode), 'fast') THEN 180 WHEN contains(lower(mode), 'quality') OR contains(lower(mode), 'forensic') OR contains(lower(mode), 'archival') THEN 300 ELSE 220 END AS dpi FROM job_status""",
    "entry_bodies": f"""SELECT chunk_id, created_at, regexp_replace(regexp_replace(array_to_string(list_transform(regexp_split_to_array(text, '{LINE_END}'), lambda l: regexp_replace(l, '{BLANKS}+$', '')), chr(10)), '\\n{{3,}}', chr(10) || chr(10), 'g'), '^\\n+|\\n+$', '', 'g') AS text FROM chunks""",
    "entry_starts": f"""WITH {PAGES},
l AS (SELECT page_id, book, page_number, list_transform(regexp_split_to_array(coalesce(text, ''), '{LINE_END}'), lambda l: {strip('l')}) AS ls FROM p WHERE book IS NOT NULL AND page_number >= 17),
x AS (SELECT book, page_number, unnest(range(0, len(ls)))::INT AS "at", unnest(ls) AS line, unnest(list_append(ls[2:], NULL)) AS after FROM l),
m AS (SELECT *, regexp_extract(line, '^([\\x{{4E00}}-\\x{{9FFF}}][\\x{{4E00}}-\\x{{9FFF}}A-Za-z0-9·（）()]{{1,15}})\\s*$', 1) AS title FROM x)
SELECT book, page_number, "at", title FROM m WHERE title <> '' AND NOT regexp_matches(line, '^(?:\\d+$|第[一二三四五六七八九十百千]+[章节部卷编]|前言|目录|附录|索引|凡例|版权|书名|彩图)') AND (coalesce(regexp_matches(after, '^[A-Za-z]'), false) OR length(title) BETWEEN 2 AND 8)""",
    "job_estimates": f"""WITH {LATEST}, m AS (SELECT job_key, target AS n, mode FROM (SELECT cand.*, latest.mode FROM cand JOIN latest USING (job_key)))
SELECT job_key, CASE WHEN n IS NULL OR {_MODES} IS NULL THEN NULL ELSE CAST({half_even(f"n * 42.0 * ({_MODES})", 0)} AS BIGINT) END AS recognised,
  CASE WHEN n IS NULL OR {_MODES} IS NULL THEN NULL ELSE CAST({half_even(f"n * 40.0 * ({_MODES})", 0)} AS BIGINT) END AS fallback,
  CAST(greatest(1.0, CASE WHEN n IS NULL THEN NULL ELSE {half_even('n * 0.05', 0)} END) AS BIGINT) AS direct,
  CASE WHEN coalesce(n, 0) < 80 THEN 1 ELSE 2 END AS threads, CASE WHEN coalesce(n, 0) < 80 THEN 1 WHEN n >= 200 THEN 3 ELSE 2 END AS high_threads FROM m""",
    "capacity_trials": f"""WITH {_TRIALS} SELECT candidate, array_to_string(reasons, '|') AS reasons, len(reasons) = 0 AS valid, CASE WHEN len(reasons) = 0 THEN round(ppm / base.rate, 3) END AS speedup, CASE WHEN len(reasons) = 0 THEN round(ppm / base.rate / workers, 3) END AS efficiency FROM r2""",
    "capacity_winner": f"""WITH {_TRIALS}, a AS (SELECT * FROM r2 WHERE len(reasons) = 0 AND (workers <= 1 OR ppm >= base.rate * 1.05)), n AS (SELECT * FROM a WHERE ppm >= (SELECT max(ppm) FROM a) * 0.95)
SELECT candidate, workers, threads, CAST(ppm AS DOUBLE) AS pages_per_minute FROM n ORDER BY workers * threads, workers, coalesce(nullif(rss, 0), 1e300), abs(coalesce(use, 0) - 80), coalesce(nullif(ext, 0), 1e300), -ppm LIMIT 1""",
    "capacity_unsettled": f"""WITH {_TRIALS} SELECT DISTINCT w || 'x' || k AS candidate FROM range(1, 5) a(w), (VALUES (1), (2), (4)) b(k) WHERE (w = 1 OR w * k <= 14) AND w || 'x' || k NOT IN (SELECT candidate FROM t WHERE ppm IS NOT NULL)""",
    "resource_totals_nullaware": """WITH s AS (SELECT DISTINCT engine, snapshot_id, avg_seconds_per_page AS c, eta_seconds AS m, low_confidence_pages AS n FROM job_status),
g AS (SELECT engine, count(*) AS n_workers, count(snapshot_id) AS n_pids, count(c) AS cpu_known, count(m) AS memory_known, count(*) FILTER (c IS NOT NULL AND m IS NOT NULL AND n IS NOT NULL) = count(*) AS is_complete,
  sum(n)::BIGINT AS n_threads, round(sum(CAST(m AS DOUBLE)), 1) AS memory_mb, round(sum(greatest(c / 100.0 * 16, 0.0)), 2) AS cpu_cores FROM s GROUP BY engine)
SELECT *, CASE WHEN cpu_cores IS NOT NULL THEN round(least(100.0, cpu_cores / 16 * 100.0), 1) END AS cpu_percent, round(memory_mb / 64000000.0 * 100.0, 2) AS memory_percent FROM g""",
    "thread_use": """WITH m AS (SELECT user_id, event_type, max(value) AS v FROM events GROUP BY user_id, event_type)
SELECT user_id, count(*) FILTER (v >= 5)::INT AS active_threads, count(*) FILTER (v >= 80)::INT AS saturated_threads, round(least(100.0, list_sum(list_reverse_sort(list(v))[1:2]) / 2), 6) AS budget_use_percent FROM m GROUP BY user_id""",
    "benchmark_fixture_pages": """WITH m AS (SELECT i, least(999, floor((i + 0.5) * 1000 / 50))::INT AS page FROM range(0, 50) t(i)),
f AS (SELECT page, row_number() OVER (ORDER BY page) - 1 AS i FROM range(0, 1000) t(page) WHERE page NOT IN (SELECT page FROM m))
SELECT (i // 3)::INT AS worker, (i % 3)::INT AS "at", page::INT AS page FROM f WHERE i < 12 UNION ALL SELECT (i % 4)::INT, (i // 4 + 3)::INT, page FROM m""",
    "page_states": f"""WITH {_EV}, a AS (SELECT user_id, page, min(event_id) FILTER (event_type = 'view') AS d, max(event_id) FILTER (event_type = 'click') AS s, max(event_id) FILTER (event_type = 'error') AS f FROM ev GROUP BY user_id, page)
SELECT ev.user_id, ev.page, any_value(CASE WHEN d IS NOT NULL THEN 'completed' WHEN f IS NULL AND s IS NULL THEN 'unknown' WHEN f IS NULL OR s > f THEN 'started' ELSE 'failed' END) AS state,
  count(*) FILTER (event_type = 'click' AND (d IS NULL OR event_id <= d)) AS n_starts, count(*) FILTER (event_type = 'error' AND (d IS NULL OR event_id <= d)) AS n_failures, count(*) FILTER (event_type = 'click' AND event_id > d) AS late_starts
FROM ev JOIN a USING (user_id, page) GROUP BY ev.user_id, ev.page""",
    "task_attempts": "SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id)::INT AS attempt FROM events WHERE event_type = 'signup'",
    "task_reports": """WITH k AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY user_id, event_type)
SELECT user_id, sum(CASE WHEN event_type = 'signup' THEN n END)::BIGINT AS n_attempts, sum(CASE WHEN event_type = 'signup' THEN n END)::INT AS last_attempt, string_agg(event_type || '=' || n, ',' ORDER BY event_type) AS events FROM k GROUP BY user_id""",
    "queue_claimable": f"WITH {_QUEUE} SELECT user_id, created_at FROM free",
    "queue_claimed": f"WITH {_QUEUE} SELECT user_id, created_at FROM free ORDER BY created_at, user_id LIMIT 1",
    "lease_tokens": """WITH RECURSIVE p AS (SELECT user_id, event_id, date_trunc('second', ts) AS ts, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events WHERE event_type = 'purchase'),
r AS (SELECT user_id, event_id, n, ts AS since, 1 AS token, true AS granted FROM p WHERE n = 1
  UNION ALL SELECT p.user_id, p.event_id, p.n, CASE WHEN datediff('second', r.since, p.ts) >= 21600 THEN p.ts ELSE r.since END, r.token + (datediff('second', r.since, p.ts) >= 21600)::INT, datediff('second', r.since, p.ts) >= 21600 FROM r JOIN p ON p.user_id = r.user_id AND p.n = r.n + 1)
SELECT user_id, event_id, granted, token FROM r""",
    "job_progress": f"""WITH s AS (SELECT DISTINCT snapshot_id, job_key, coalesce(target_pages, 0) AS t, coalesce(processed_pages, 0) AS p, elapsed_seconds, avg_seconds_per_page FROM job_status),
x AS (SELECT *, coalesce(avg_seconds_per_page, CASE WHEN p > 0 THEN elapsed_seconds / p END) AS raw FROM s), y AS (SELECT *, CASE WHEN raw IS NULL THEN NULL ELSE {half_even('raw', 2)} END AS v FROM x)
SELECT snapshot_id, job_key, CASE WHEN t > 0 THEN {half_even('p * 100.0 / t', 1)} ELSE 0.0 END AS progress_percent, v AS seconds_per_page, CASE WHEN v IS NULL THEN NULL ELSE CAST({half_even('v * greatest(t - p, 0)', 0)} AS BIGINT) END AS seconds_left FROM y""",
    "page_rate_series": f"""WITH s AS (SELECT DISTINCT ON (job_key, snapshot_id) job_key, snapshot_id, processed_pages, updated_at FROM job_status WHERE updated_at IS NOT NULL AND processed_pages IS NOT NULL),
m AS (SELECT job_key, snapshot_id, processed_pages - lag(processed_pages) OVER w AS pages, datediff('second', lag(updated_at) OVER w, updated_at) AS seconds FROM s WINDOW w AS (PARTITION BY job_key ORDER BY snapshot_id)),
n AS (SELECT *, coalesce(pages < 0 OR seconds < 0, true) AS back FROM m), k AS (SELECT *, sum(back::INT) OVER (PARTITION BY job_key ORDER BY snapshot_id) AS series FROM n),
g AS (SELECT job_key, series::BIGINT AS series, sum(pages)::BIGINT AS pages, sum(seconds)::BIGINT AS seconds FROM k WHERE NOT back AND pages > 0 AND seconds > 0 AND NOT (pages >= 8 AND pages * 60.0 / seconds >= 10) GROUP BY job_key, series),
h AS (SELECT *, {half_even('seconds / pages', 2)} AS each FROM g)
SELECT job_key, series, pages, seconds, each AS seconds_per_page, {half_even('60 / each', 3)} AS pages_per_minute FROM h""",
    "inspection_samples": f"""WITH {LATEST}, j AS (SELECT job_key, greatest(target, 0) AS n FROM cand WHERE target IS NOT NULL),
s AS (SELECT job_key, n, CASE WHEN n = 0 THEN [] WHEN n <= 20 THEN range(1, n + 1) ELSE
  list_sort(list_distinct(list_concat(range(1, 4), list_filter(list_transform(range(1, 18), lambda i: CAST(round(1 + (n - 1) * i / 17.0) AS BIGINT)), lambda x: x BETWEEN 1 AND n))))[1:20] END AS ps FROM j)
SELECT job_key, unnest(ps)::INT AS page_number FROM s""",
    "garble_scores": f"WITH {PAGES}, g AS (SELECT page_id, text FROM p), {_CHARS} SELECT page_id, garble FROM gb",
    "document_classification": f"""WITH {PAGES}, g AS (SELECT page_id, job_key, source, {layer_text("coalesce(text, '')")} AS text FROM p), {_CHARS},
v AS (SELECT job_key, total, garble, coalesce(source NOT IN ('pdf_text_layer', 'existing_ocr_text_layer'), false) AS scanned, total >= 30 AND garble < 0.18 AS usable,
    regexp_replace(text, '{BLANKS}+', '', 'g') AS compact, text FROM g JOIN gb USING (page_id)),
c AS (SELECT *, compact <> '' AND ((regexp_matches(text, '(?i)\\bcontents\\b') OR regexp_matches(compact, '(?i)\\bcontents\\b'))::INT + (regexp_matches(text, '(?i)\\btable\\s+of\\s+contents\\b') OR regexp_matches(compact, '(?i)\\btable\\s+of\\s+contents\\b'))::INT
    + (regexp_matches(text, '(?i)\\bchapter\\b') OR regexp_matches(compact, '(?i)\\bchapter\\b'))::INT + (regexp_matches(text, '\\d+\\s*[.．]\\s*\\S+') OR regexp_matches(compact, '\\d+\\s*[.．]\\s*\\S+'))::INT
    + (regexp_matches(text, '第\\s*[一二三四五六七八九十百千万\\d]+\\s*[章节篇卷部]') OR regexp_matches(compact, '第\\s*[一二三四五六七八九十百千万\\d]+\\s*[章节篇卷部]'))::INT + (regexp_matches(text, '目\\s*录') OR regexp_matches(compact, '目\\s*录'))::INT >= 2
    OR len(regexp_extract_all(text, '\\S\\s*[.·．。]{{2,}}\\s*\\d+')) >= 3) AS contents FROM v),
r AS (SELECT job_key, count(*) AS n_pages, round(count(*) FILTER (usable) / count(*), 4) AS t, round(count(*) FILTER (scanned) / count(*), 4) AS s, round(count(*) FILTER (scanned AND total < 20) / count(*), 4) AS e,
    round(count(*) FILTER (total >= 20 AND garble >= 0.18) / count(*), 4) AS b, bool_or(contents) AS contents, round(coalesce(avg(garble) FILTER (total > 0), 1.0), 4) AS mean_garble FROM c GROUP BY job_key)
SELECT job_key, n_pages, t AS text_ratio, s AS scanned_ratio, mean_garble, CASE WHEN b >= 0.2 THEN 'broken_layer' WHEN e >= 0.8 AND t < 0.2 THEN 'image_only' WHEN s >= 0.5 AND t >= 0.5 THEN 'searchable_scan' WHEN s >= 0.2 AND t >= 0.2 THEN 'mixed'
  WHEN t >= 0.8 AND s < 0.2 THEN 'born_digital' WHEN t >= 0.6 AND contents THEN 'born_digital' WHEN t < 0.2 AND s < 0.2 THEN 'empty' ELSE 'mixed' END AS kind FROM r""",
    "text_cleanup": f"""WITH {PAGES},
l AS (SELECT page_id, text IS NULL AS none, list_filter(list_transform(regexp_split_to_array(replace(text, chr(0), ''), '{LINE_END}'), lambda l: regexp_replace(regexp_replace({strip(f"regexp_replace(l, '{BLANKS}+', ' ', 'g')")},
    '([\\x{{4E00}}-\\x{{9FFF}}]) +([\\x{{4E00}}-\\x{{9FFF}}])', '\\1\\2', 'g'), '([\\x{{4E00}}-\\x{{9FFF}}]) +([\\x{{4E00}}-\\x{{9FFF}}])', '\\1\\2', 'g')), lambda x: x <> '') AS ls FROM p),
h AS (SELECT page_id, none, regexp_replace(regexp_replace(array_to_string(ls, chr(10)), '([A-Za-z])-\\n([a-z])', '\\1\\2', 'g'), '([A-Za-z])-\\n([a-z])', '\\1\\2', 'g') AS t FROM l)
SELECT page_id, CASE WHEN none THEN NULL ELSE {strip("replace(replace(t, '0CR', 'OCR'), 'ＯＣＲ', 'OCR')")} END AS text FROM h""",
    "page_sections": f"""WITH {PAGES},
x AS (SELECT page_id, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS "at" FROM (SELECT page_id, regexp_split_to_array(coalesce(text, ''), '{LINE_END}') AS ls FROM p)),
h AS (SELECT *, regexp_matches(line, '^(第\\s*\\d+\\s*章|卷\\s*\\d+|Chapter \\d+\\.|Chapitre \\d+|\\d+\\. Kapitel)') AS opens FROM x),
k AS (SELECT *, sum(opens::INT) OVER (PARTITION BY page_id ORDER BY "at") + (NOT first_value(opens) OVER (PARTITION BY page_id ORDER BY "at"))::INT AS no FROM h),
s AS (SELECT page_id, no::INT AS section_no, min(CASE WHEN opens THEN regexp_extract(line, '^(第\\s*\\d+\\s*章|卷\\s*\\d+|Chapter \\d+\\.|Chapitre \\d+|\\d+\\. Kapitel)', 1) END) AS title, {strip('string_agg(line, chr(10) ORDER BY "at")')} AS text FROM k GROUP BY page_id, no)
SELECT * FROM s WHERE text <> ''""",
    "audit_html_rows": f"""WITH {PAGES},
x AS (SELECT page_id, page_number, coalesce(confidence, 0.0) AS c, coalesce(length(text), 0) AS n, CASE source WHEN 'pdf_text_layer' THEN 'PDF文本层' WHEN 'existing_ocr_text_layer' THEN '现有OCR文本层' WHEN 'page_cache' THEN '逐页缓存' WHEN 'blank_page' THEN '疑似空白页' WHEN 'paddleocr' THEN '飞桨OCR' WHEN 'tesseract' THEN '备用OCR' ELSE coalesce(source, '') END AS s,
  coalesce(array_to_string(warnings, '；'), '') AS w FROM p)
SELECT page_id, '<tr><td>' || coalesce(CAST(page_number AS VARCHAR), '') || '</td><td>' || s || '</td><td>' || CAST(CAST(c AS DECIMAL(10, 3)) AS VARCHAR) || '</td><td>' || n || '</td><td>' || replace(replace(replace(w, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</td></tr>' AS html FROM x""",
    "audit_jobs": f"""WITH {LATEST}, {FEATURES},
a AS (SELECT job_key, count(*) AS n_pages, count(*) FILTER (text_chars > 0) AS text_pages, count(*) FILTER (coalesce(source = 'blank_page', false)) AS blank_pages,
  count(*) FILTER (NOT coalesce(source = 'blank_page', false) AND coalesce(confidence, 0) < 0.9) AS low_confidence_pages FROM f GROUP BY job_key),
o AS (SELECT job_key, count(*) FILTER (len(list_filter(coalesce(warnings, []), lambda w: starts_with(w, '识别过程出错'))) > 0) AS failed_pages, coalesce(sum(length(text)), 0)::BIGINT AS n_chars FROM p GROUP BY job_key),
w AS (SELECT job_key, unnest(range(1, target + 1))::INT AS page_number FROM cand WHERE target > 0),
u AS (SELECT job_key, count(*) AS n_missing, min(page_number) AS first_missing FROM (SELECT * FROM w ANTI JOIN pages USING (job_key, page_number)) GROUP BY job_key),
i AS (SELECT job_key, page_number, NOT coalesce(source = 'blank_page', false) AND coalesce(confidence, 0) < 0.9 AND NOT is_dense_index AS l, NOT coalesce(source = 'blank_page', false) AND text_chars = 0 AS e, is_diagram AND n_noise_lines >= 2 AS d, is_illustration AS s FROM f),
g AS (SELECT job_key, count(*) AS n_issues, min(page_number) AS first_issue, count(*) FILTER (l) AS low_confidence, count(*) FILTER (e) AS no_text, count(*) FILTER (d) AS diagram_noise, count(*) FILTER (s) AS illustration FROM i WHERE l OR e OR d OR s GROUP BY job_key)
SELECT a.*, failed_pages, n_chars, coalesce(n_missing, 0) AS n_missing, first_missing, coalesce(n_issues, 0) AS n_issues, first_issue, coalesce(low_confidence, 0) AS low_confidence, coalesce(no_text, 0) AS no_text, coalesce(diagram_noise, 0) AS diagram_noise, coalesce(illustration, 0) AS illustration
FROM a JOIN o ON o.job_key IS NOT DISTINCT FROM a.job_key LEFT JOIN u ON u.job_key = a.job_key LEFT JOIN g ON g.job_key = a.job_key""",
    "audit_samples": f"""WITH {FEATURES},
i AS (SELECT job_key, page_number, unnest(list_filter([
  CASE WHEN NOT coalesce(source = 'blank_page', false) AND coalesce(confidence, 0) < 0.9 AND NOT is_dense_index THEN 'low_confidence' END, CASE WHEN NOT coalesce(source = 'blank_page', false) AND text_chars = 0 THEN 'no_text' END,
  CASE WHEN is_diagram AND n_noise_lines >= 2 THEN 'diagram_noise' END, CASE WHEN is_illustration THEN 'illustration' END], lambda x: x IS NOT NULL)) AS problem FROM f)
SELECT job_key || '|' || problem AS key, array_to_string(list_sort(list(DISTINCT page_number))[1:20], ',') AS page_numbers FROM i GROUP BY job_key, problem""",
    "worker_liveness": """WITH b AS (SELECT user_id, ts, count(*) FILTER (event_type = 'view') OVER (PARTITION BY user_id ORDER BY event_id) AS pages FROM events),
g AS (SELECT user_id, min(ts) AS f, max(ts) AS l, max(pages) AS m FROM b GROUP BY user_id), p AS (SELECT b.user_id, min(ts) AS s FROM b JOIN g ON g.user_id = b.user_id AND b.pages = g.m GROUP BY b.user_id),
a AS (SELECT user_id, m, epoch(TIMESTAMP '2024-01-30 23:00:00') - epoch(f) AS f, epoch(TIMESTAMP '2024-01-30 23:00:00') - epoch(l) AS l, epoch(TIMESTAMP '2024-01-30 23:00:00') - epoch(s) AS s FROM g JOIN p USING (user_id))
SELECT user_id, CASE WHEN trunc(l) >= 90 AND trunc(f) >= 120 THEN 'dead' WHEN trunc(f) < 120 THEN 'starting' WHEN m = 0 AND trunc(f) >= 600 THEN 'no first page' WHEN m > 0 AND trunc(s) >= 600 THEN 'stuck' ELSE 'alive' END AS state FROM a""",
    "new_requests": f"""WITH r AS (SELECT snapshot_id, source_pdf, mode, {label('status')} AS l, sha256('{{"mode":[' || coalesce('"' || mode || '"', 'null') || '],"source_pdf":[' || coalesce('"' || source_pdf || '"', 'null') || ']}}') AS request_key FROM job_status)
SELECT request_key, min(snapshot_id) AS snapshot_id, arg_min(source_pdf, snapshot_id) AS source_pdf, arg_min(mode, snapshot_id) AS mode FROM r WHERE request_key NOT IN (SELECT request_key FROM r WHERE l = 'done') GROUP BY request_key""",
    "thread_usage": "SELECT user_id AS pid, event_type AS thread, round(least(100.0, greatest(0.0, (max(value) - min(value)) / 60.0 * 100.0)), 3) AS cpu_percent FROM events GROUP BY user_id, event_type",
    "sanitised_numbers": """WITH r AS (SELECT DISTINCT chunk_id, regexp_extract(chunk_id, '([^-]*)-[^-]*$', 1) AS part, regexp_extract(chunk_id, '(\\d+)$', 1) AS digits FROM chunks)
SELECT chunk_id, TRY_CAST(part AS DOUBLE) AS finite, TRY_CAST(digits AS BIGINT) AS whole, least(greatest(TRY_CAST(digits AS DOUBLE), 2.0), 5.0) AS bounded FROM r""",
    "signed_entries": f"""WITH {PAGES},
l AS (SELECT book, page_number, page_id, regexp_split_to_array(coalesce(text, ''), '{LINE_END}') AS ls FROM p WHERE book IS NOT NULL),
x AS (SELECT book, page_number, page_id, unnest(range(0, len(ls))) AS i, unnest(ls) AS line FROM l),
y AS (SELECT *, regexp_matches(line, '{_SIGNATURE}') AS ends, regexp_matches(line, '{_TITLE}') AND NOT regexp_matches(line, '{_SIGNATURE}') AS opens FROM x),
z AS (SELECT *, coalesce(sum(ends::INT) OVER (PARTITION BY book ORDER BY page_number, page_id, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS entry_no FROM y),
w AS (SELECT *, min((page_number, page_id, i)) FILTER (opens) OVER (PARTITION BY book, entry_no) AS start FROM z),
h AS (SELECT * FROM w WHERE (page_number, page_id, i) >= start)
SELECT book, entry_no, regexp_extract(arg_min(line, (page_number, page_id, i)), '{_TITLE}', 1) AS title, max(CASE WHEN ends THEN regexp_extract(line, '{_SIGNATURE}', 1) END) AS author,
  min(page_number) AS first_page, max(page_number) AS last_page, {strip("string_agg(line, chr(10) ORDER BY page_number, page_id, i)")} AS text FROM h GROUP BY book, entry_no""",
    "entry_titles": f"""WITH {PAGES},
l AS (SELECT page_id, book, page_number, list_transform(regexp_split_to_array(coalesce(text, ''), '{LINE_END}'), lambda l: {strip('l')}) AS ls FROM p WHERE book IS NOT NULL),
x AS (SELECT book, page_number, unnest(range(0, len(ls)))::INT AS "at", unnest(ls) AS line FROM l),
m AS (SELECT *, {strip("regexp_extract(line, '^([\\x{4E00}-\\x{9FFF}][\\x{4E00}-\\x{9FFF}\\p{L}\\p{M}\\p{Nd}\\p{Pc}\\s\\p{Z}]{1,30}?)(?:\\(([a-zA-Z][a-zA-Z\\s\\.,;_\\-]+)\\))?[\\s\\p{Z}]*$', 1)")} AS title FROM x WHERE length(line) BETWEEN 1 AND 40)
SELECT book, page_number, "at", title FROM m WHERE length(title) >= 2 AND NOT regexp_matches(line, '^[，。、；：？！《》…—（）【】"·]') AND NOT regexp_matches(line, '[，。、；：？！《》…—（）【】"]$') AND NOT regexp_matches(line, '^[\\d\\s·\\-.]+$')
  AND NOT regexp_matches(line, '[，。、；：？！]{{2,}}') AND NOT (length(line) < 20 AND regexp_matches(line, '中国农业百科全书|编辑出版领导小组|总编辑委员会|编辑委员会|编写组主编|前言|凡例|目录|索引'))""",
}

ORACLES["entry_texts"] = f"""WITH {PAGES}, r AS ({BOOKS["entry_ranges"]}),
l AS (SELECT book, page_number, arg_max(coalesce(text, chr(0)), page_id) AS text FROM p WHERE book IS NOT NULL AND page_number IS NOT NULL GROUP BY book, page_number)
SELECT r.book, title, first_page, last_page, count(*)::INT AS n_pages, (sum(CASE WHEN text = chr(0) THEN 0 ELSE length(text) END) + 2 * (count(*) - 1))::INT AS n_chars
FROM r JOIN l ON l.book = r.book AND l.page_number BETWEEN first_page AND last_page GROUP BY r.book, title, first_page, last_page"""
ORACLES["library_scan"] = f"""WITH c AS ({BOOKS["catalog_status_left_join"]}), k AS ({ORACLES["document_classification"]}), {_SOURCES},
b AS (SELECT source_pdf, arg_max({{'kind': kind, 'text_ratio': text_ratio}}, (n_pages, job_key)) AS k FROM k JOIN src USING (job_key) GROUP BY source_pdf)
SELECT c.*, b.k.kind AS kind, b.k.text_ratio AS text_ratio FROM c LEFT JOIN b USING (source_pdf)"""
