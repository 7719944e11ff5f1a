"""DuckDB counterparts of the book queries."""

# The patterns are stated here again, so that a slip in the code under test shows as a difference. Fixed values.
BLANKS = r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
LINE_END = r"\r\n|[\n\r\x{0B}\x{0C}\x{1C}-\x{1E}\x{85}\x{2028}\x{2029}]"
CONTENTS = (r"(?i)\bcontents\b", r"(?i)\btable\s+of\s+contents\b", r"(?i)\bchapter\b", r"\d+\s*[.．]\s*\S+", r"第\s*[一二三四五六七八九十百千万\d]+\s*[章节篇卷部]", r"目\s*录")
LEADERS = r"\S\s*[.·．。]{2,}\s*\d+"
DIAGRAM_WORDS = ("箭头", "技术路线", "示意图", "流程图", "模式图", "灵敏度")
CAPTION_END = r"(?:发育图|结构图|组织图|示意图|流程图|模式图|分布图|地图)$"
MAP_CAPTION = r"图\s*\d+[^\n]*(示意图|分布图|地图)"
NOISE_GLYPHS = "0123456789OoCc口囗Ω○。"
SPLIT_LABELS = ("\n前\n言\n", "\n凡\n例\n", "\n目\n录\n", "\n委\n员", "\n主\n任", "\n编\n辑", "\n印\n制")
IMPRINT_WORDS = ("ISBN", "定价", "出版", "发行", "印刷", "开本", "第1版", "第1次")


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{BLANKS}+|{BLANKS}+$', '', 'g')"


def filled(x: str) -> str:
    return f"list_filter(list_transform(regexp_split_to_array({x}, '{LINE_END}'), lambda l: {strip('l')}), lambda l: l <> '')"


PAGES = "p AS (SELECT DISTINCT ON (page_id) * FROM pages WHERE page_id IS NOT NULL)"

LATEST = """
latest AS (
  SELECT job_key,
    arg_max(s, (updated_at, snapshot_id)) AS r, min(source_pdf) AS source_pdf, min(mode) AS mode, min(total_pages) AS total_pages
  FROM (SELECT job_key, updated_at, snapshot_id, source_pdf, mode, total_pages,
          {'status': status, 'job_dir': job_dir, 'target': target_pages, 'processed': processed_pages, 'is_sample': is_sample, 'updated_at': updated_at} AS s
        FROM job_status WHERE job_key IS NOT NULL)
  GROUP BY job_key),
totals AS (SELECT job_key, max(total_pages) AS quality_total, max(is_sample::INT) = 1 AS quality_sample FROM quality GROUP BY job_key),
cand AS (
  SELECT l.job_key, l.source_pdf, r.job_dir AS job_dir, r.target AS target, r.processed AS processed, r.updated_at AS updated_at, l.total_pages, quality_total, r.status AS status, r.is_sample AS is_sample,
    coalesce(lower(""" + strip("r.status") + """) IN ('完成', '已完成', 'done', 'complete', 'completed', 'finished', 'ok'), false) AS done,
    CASE WHEN NOT coalesce(lower(""" + strip("r.status") + """) IN ('完成', '已完成', 'done', 'complete', 'completed', 'finished', 'ok'), false) THEN 'not done'
      WHEN coalesce(r.is_sample, false) OR coalesce(quality_sample, false) OR coalesce(nullif(r.target, 0) < coalesce(nullif(l.total_pages, 0), nullif(quality_total, 0)), false) THEN 'sample'
      WHEN r.processed < coalesce(nullif(l.total_pages, 0), nullif(quality_total, 0)) THEN 'incomplete' END AS reason
  FROM latest l LEFT JOIN totals USING (job_key)),
ranked AS (
  SELECT job_key, source_pdf, job_dir, row_number() OVER (PARTITION BY coalesce(source_pdf, job_dir) ORDER BY coalesce(processed, 0) DESC, coalesce(target, 0) DESC, job_dir DESC NULLS LAST, job_key) AS rank
  FROM cand WHERE reason IS NULL),
skipped AS (
  SELECT job_key, reason FROM cand WHERE reason IS NOT NULL
  UNION ALL SELECT job_key, 'other version kept' FROM ranked WHERE rank > 1),
firsts AS (
  SELECT chunk_id, job_key, source_path, source_page, text FROM (
    SELECT c.chunk_id, c.job_key, c.source_path, c.source_page, coalesce(c.text, '') AS text,
      row_number() OVER (PARTITION BY c.source_path, c.source_page, coalesce(c.text, '') ORDER BY r.job_dir, c.chunk_id, c.created_at, c.page_end) AS n
    FROM chunks c JOIN ranked r ON r.job_key = c.job_key AND r.rank = 1)
  WHERE n = 1)"""

_CATALOG = """
catalog AS (
  SELECT source_pdf, regexp_extract(source_pdf, '^(.*)[/\\\\]', 1) AS folder, list_extract(regexp_split_to_array(source_pdf, '[/\\\\]'), -1) AS file_name,
    count(*) AS n_jobs, max(done::INT) AS done, max(processed) AS processed_pages, max(coalesce(total_pages, quality_total)) AS total_pages
  FROM cand WHERE source_pdf IS NOT NULL GROUP BY source_pdf)"""

_EMPTY = f"{strip("coalesce(text, '')")} = ''"
_BLANK = "coalesce(source = 'blank_page', false)"


def _any(column: str, words: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({column}, '{w}')" for w in words) + ")"


def _noise(l: str) -> str:
    c = f"regexp_replace({l}, '{BLANKS}+', '', 'g')"
    return f"(regexp_matches({c}, '^[{NOISE_GLYPHS}]{{1,8}}$') AND length(replace({c}, left({c}, 1), '')) = 0)"


FEATURES = f"""
{PAGES},
l AS (SELECT page_id, job_key, page_number, confidence, source, coalesce(text, '') AS t, {filled("coalesce(text, '')")} AS ls, regexp_replace(coalesce(text, ''), '{BLANKS}+', '', 'g') AS compact FROM p),
m AS (SELECT *, len(ls) AS n,
    CASE WHEN len(ls) = 0 THEN 0.0 ELSE len(list_filter(ls, lambda x: length(x) <= 8)) / len(ls) END AS short,
    CASE WHEN len(ls) = 0 THEN 0.0 ELSE len(list_filter(ls, lambda x: length(x) >= 25)) / len(ls) END AS long,
    CASE WHEN len(ls) = 0 THEN 0.0 ELSE len(list_filter(ls, lambda x: regexp_matches(x, '\\d+\\s*$'))) / len(ls) END AS tails,
    CASE WHEN len(ls) = 0 THEN 0.0 ELSE len(list_filter(ls, lambda x: contains(x, '…') OR regexp_matches(x, '\\.{{3,}}'))) / len(ls) END AS leaders,
    len(list_filter(ls, lambda x: {_noise('x')})) AS noise,
    len(regexp_extract_all(t, '图\\s*\\d+')) AS captions,
    len(list_filter(ls, lambda x: regexp_matches(x, '^\\d{{1,3}}$'))) AS scale,
    len(list_filter(ls, lambda x: regexp_matches(x, '{CAPTION_END}'))) AS ends
  FROM l),
k AS (SELECT *, n >= 20 AND tails >= 0.35 AND (leaders >= 0.2 OR n >= 50) AS dense FROM m),
d AS (SELECT *, n >= 20 AND NOT dense AND ((short >= 0.55 AND long <= 0.35 AND ({_any('t', DIAGRAM_WORDS)} OR captions >= 2 OR noise >= 4))
    OR (captions >= 2 AND noise >= 4 AND short >= 0.15 AND long <= 0.45) OR (regexp_matches(t, '{MAP_CAPTION}') AND scale >= 3)) AS diagram FROM k),
f AS (SELECT page_id, job_key, page_number, confidence, source, length({strip('t')}) AS text_chars, n AS n_lines,
    compact <> '' AND (({" + ".join(f"(regexp_matches(t, '{c}') OR regexp_matches(compact, '{c}'))::INT" for c in CONTENTS)}) >= 2 OR len(regexp_extract_all(t, '{LEADERS}')) >= 3) AS is_contents,
    dense AND NOT diagram AS is_dense_index, diagram AS is_diagram,
    (n >= 20 AND NOT dense AND ends >= 1 AND noise >= 4 AND short >= 0.35 AND long <= 0.45) AND NOT diagram AS is_illustration,
    noise AS n_noise_lines,
    CASE WHEN page_number > 20 THEN false
      WHEN {_any("(chr(10) || " + strip('t') + " || chr(10))", SPLIT_LABELS)} THEN true
      WHEN page_number > 10 THEN false WHEN length({strip('t')}) < 120 THEN true ELSE {_any('t', IMPRINT_WORDS)} END AS is_front_matter
  FROM d)"""

_RULED = f"""
{PAGES},
titles AS (SELECT DISTINCT book FROM p WHERE book IS NOT NULL),
steps AS (
  SELECT t.book, list(struct_pack(o := r.rule_order, n := r.name, reps := r.replacements) ORDER BY r.rule_order) AS steps
  FROM titles t JOIN replacement_rules r ON len(list_filter(coalesce(r.title_keywords, []), lambda k: NOT contains(t.book, k))) = 0
  GROUP BY t.book)"""

_FOLD = "list_reduce(list_concat([{'wrong': '', 'right': T}], flatten(list_transform(coalesce(s.steps, []), lambda z: z.reps))), lambda a, b: {'wrong': '', 'right': replace(a.right, b.wrong, b.right)}).right"

ORACLES = {
    "kb_candidates_selected": f"WITH {LATEST} SELECT job_key, source_pdf FROM ranked WHERE rank = 1",
    "kb_candidates_skipped": f"WITH {LATEST} SELECT job_key, reason FROM skipped",
    "kb_chunks_first_wins": f"WITH {LATEST} SELECT * FROM firsts",
    "kb_index_totals": f"""WITH {LATEST}
SELECT (SELECT count(*) FROM firsts) AS n_chunks, (SELECT coalesce(sum(length(text)), 0)::BIGINT FROM firsts) AS n_chars,
  (SELECT count(*) FROM (SELECT DISTINCT source_path, source_page FROM firsts WHERE source_path IS NOT NULL AND source_page IS NOT NULL)) AS n_pages,
  (SELECT count(*) FROM ranked WHERE rank = 1) AS n_jobs, (SELECT count(*) FROM skipped) AS n_skipped""",
    "catalog_status_left_join": f"""WITH {LATEST}, {_CATALOG}
SELECT source_pdf, folder, file_name, row_number() OVER (ORDER BY folder, source_pdf)::INT AS number, n_jobs, done, processed_pages, total_pages FROM catalog""",
    "catalog_counts": f"""WITH {LATEST}, {_CATALOG}
SELECT folder, count(*) AS n_sources, sum(done)::BIGINT AS n_done, count(*) FILTER (total_pages IS NULL) AS n_unknown_length FROM catalog GROUP BY folder""",
    "history_union_antijoin": f"""WITH {LATEST},
e AS (SELECT DISTINCT job_key, event, status, source_pdf, processed_pages, replace(replace(recorded_at, 'T', ' '), '/', '-') AS recorded FROM history)
SELECT job_key, event, status, list_extract(regexp_split_to_array(source_pdf, '[/\\\\]'), -1) AS source_pdf, processed_pages, false AS is_backfill FROM e
UNION ALL
SELECT job_key, 'backfill', status, list_extract(regexp_split_to_array(source_pdf, '[/\\\\]'), -1), processed, true FROM cand
WHERE job_key NOT IN (SELECT job_key FROM history WHERE job_key IS NOT NULL)""",
    "history_event_counts": """SELECT event, count(*) AS n, arg_max(job_key, event_no) AS last_job FROM (SELECT DISTINCT event_no, event, job_key FROM history) GROUP BY event""",
    "audit_missing_pages": f"""WITH {LATEST},
w AS (SELECT job_key, unnest(range(1, target + 1))::INT AS page_number FROM cand WHERE target > 0)
SELECT job_key, page_number FROM w ANTI JOIN pages USING (job_key, page_number)""",
    "audit_page_counters": f"""WITH {PAGES}
SELECT job_key, count(*) AS n_pages, count(*) FILTER (NOT ({_EMPTY})) AS text_pages, count(*) FILTER ({_BLANK}) AS blank_pages,
  count(*) FILTER (len(list_filter(coalesce(warnings, []), lambda w: starts_with(w, '识别过程出错'))) > 0) AS failed_pages,
  count(*) FILTER (NOT {_BLANK} AND coalesce(confidence, 0) < 0.9) AS low_confidence_pages, coalesce(sum(length(text)), 0)::BIGINT AS n_chars
FROM p GROUP BY job_key""",
    "audit_issue_rows": f"""WITH {FEATURES},
i AS (SELECT job_key, page_id, page_number, list_filter([
  CASE WHEN NOT {_BLANK} AND coalesce(confidence, 0) < 0.9 AND NOT is_dense_index THEN 'low_confidence' END,
  CASE WHEN NOT {_BLANK} AND text_chars = 0 THEN 'no_text' END,
  CASE WHEN is_diagram AND n_noise_lines >= 2 THEN 'diagram_noise' END,
  CASE WHEN is_illustration THEN 'illustration' END], lambda x: x IS NOT NULL) AS problems FROM f)
SELECT job_key, page_id, page_number, array_to_string(problems, ',') AS problems FROM i WHERE len(problems) > 0""",
    "page_features": f"WITH {FEATURES} SELECT page_id, text_chars, n_lines, is_contents, is_dense_index, is_diagram, is_illustration, n_noise_lines, is_front_matter FROM f",
    "page_quality_warnings": f"""WITH {FEATURES}
SELECT page_id, CASE WHEN {_BLANK} THEN '' ELSE array_to_string(list_filter([
  CASE WHEN coalesce(confidence, 0) < 0.9 THEN 'low_confidence' END, CASE WHEN text_chars = 0 THEN 'no_text' END,
  CASE WHEN text_chars > 0 AND text_chars < 8 THEN 'short_text' END,
  CASE WHEN page_number <= 5 AND text_chars > 0 AND text_chars < 80 THEN 'front_page' END,
  CASE WHEN is_dense_index THEN 'dense_index' END, CASE WHEN is_diagram THEN 'diagram' END,
  CASE WHEN is_illustration THEN 'illustration' END], lambda x: x IS NOT NULL), ',') END AS warnings FROM f""",
    "glossary_apply": f"""WITH {_RULED}
SELECT p.page_id, CASE WHEN p.text IS NULL THEN NULL ELSE {_FOLD.replace("T}", "p.text}")} END AS text,
  CASE WHEN p.text IS NULL THEN 0 ELSE list_reduce(list_concat([{{'text': p.text, 'n': 0, 'reps': CAST([] AS STRUCT("wrong" VARCHAR, "right" VARCHAR)[])}}],
    list_transform(coalesce(s.steps, []), lambda z: {{'text': '', 'n': 0, 'reps': z.reps}})),
    lambda a, b: {{'text': list_reduce(list_concat([{{'wrong': '', 'right': a.text}}], b.reps), lambda c, d: {{'wrong': '', 'right': replace(c.right, d.wrong, d.right)}}).right,
      'n': a.n + (list_reduce(list_concat([{{'wrong': '', 'right': a.text}}], b.reps), lambda c, d: {{'wrong': '', 'right': replace(c.right, d.wrong, d.right)}}).right <> a.text)::INT, 'reps': a.reps}}).n END AS n_changed
FROM p LEFT JOIN steps s USING (book)""",
    "warnings_distinct": f"""WITH {PAGES}
SELECT page_id, array_to_string(list_transform(list_filter(list_zip(warnings, range(1, len(warnings) + 1)), lambda z: list_position(warnings, z[1]) = z[2]), lambda z: z[1]), '|') AS warnings
FROM p WHERE warnings IS NOT NULL""",
    "confidence_by_source": f"""WITH {PAGES}
SELECT source, count(*) AS n, round(avg(confidence), 6) AS mean, round(quantile_cont(confidence, 0.05), 6) AS p05, round(quantile_cont(confidence, 0.5), 6) AS p50 FROM p GROUP BY source""",
    "page_rate_deltas": """WITH s AS (SELECT DISTINCT ON (job_key, snapshot_id) job_key, snapshot_id, processed_pages, updated_at FROM job_status WHERE updated_at IS NOT NULL AND processed_pages IS NOT NULL),
m AS (SELECT job_key, snapshot_id, processed_pages - lag(processed_pages) OVER w AS pages, datediff('second', lag(updated_at) OVER w, updated_at) AS seconds FROM s WINDOW w AS (PARTITION BY job_key ORDER BY snapshot_id))
SELECT job_key, snapshot_id, pages, seconds, coalesce(pages >= 8 AND seconds > 0 AND pages * 60.0 / nullif(seconds, 0) >= 10, false) AS is_replay FROM m WHERE pages >= 0 AND seconds >= 0""",
    "throughput_last12_median": """SELECT user_id, event_id, value, count(value) OVER w AS n, greatest(median(value) OVER w, 0.001) AS median_seconds,
  round(60 / greatest(median(value) OVER w, 0.001), 3) AS pages_per_minute
FROM events WHERE event_type = 'view' WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)""",
    "heartbeat_stalls": """WITH l AS (SELECT job_key, arg_max({'s': status, 'p': processed_pages, 't': target_pages}, (updated_at, snapshot_id)) AS r, max(updated_at) AS u FROM job_status GROUP BY job_key)
SELECT job_key, datediff('second', u, TIMESTAMP '2025-12-31 00:00:00') AS age_seconds,
  coalesce(r.p < r.t, true) AND datediff('second', u, TIMESTAMP '2025-12-31 00:00:00') >= 600 AS is_stalled
FROM l WHERE r.s IN ('处理中', '排队', 'running', 'queued')""",
    "event_state_latest": """SELECT user_id, coalesce(max(event_type) FILTER (event_type = 'purchase'), arg_max(event_type, (ts, event_id))) AS state, count(*) AS n_events FROM events GROUP BY user_id""",
    "event_cursor": "SELECT event_id, user_id, event_type FROM events WHERE event_id > 500 ORDER BY event_id LIMIT 100",
    "trial_percentiles": """SELECT event_type, count(value) AS n, round(sum(value), 3) AS total, min(value) AS least, round(quantile_cont(value, 0.5), 3) AS p50, round(quantile_cont(value, 0.95), 3) AS p95 FROM events GROUP BY event_type""",
    "capacity_matrix": """SELECT DISTINCT w || 'x' || t AS candidate, w::INT AS workers, t::INT AS threads FROM range(1, 5) a(w), (VALUES (1), (2), (4)) b(t) WHERE w = 1 OR w * t <= 14""",
    "entry_ranges": f"""WITH {PAGES},
q AS (SELECT book, page_number, list_extract({filled("coalesce(text, '')")}, 1) AS title FROM p WHERE book IS NOT NULL),
s AS (SELECT book, title, min(page_number) AS first_page FROM q WHERE regexp_matches(title, '^(第\\s*\\d+\\s*章|卷\\s*\\d+|Chapter \\d+\\.)') GROUP BY book, title),
x AS (SELECT book, max(page_number) AS max_page FROM p WHERE book IS NOT NULL GROUP BY book)
SELECT s.book, s.title, s.first_page, coalesce(lead(first_page) OVER (PARTITION BY s.book ORDER BY first_page, title) - 1, max_page) AS last_page FROM s LEFT JOIN x USING (book)""",
    "source_states": f"""WITH {LATEST}, {_CATALOG}
SELECT CASE WHEN done = 1 THEN 'done' WHEN coalesce(processed_pages, 0) > 0 THEN 'begun' ELSE 'not begun' END AS state, count(*) AS n_sources, sum(coalesce(processed_pages, 0))::BIGINT AS n_pages
FROM catalog GROUP BY 1""",
}
