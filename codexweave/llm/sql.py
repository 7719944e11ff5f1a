"""DuckDB counterparts of the pN_ queries that SQL can express."""

_BLANK = r"'[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+'"

_SOURCED = """
jobs AS (SELECT job_key, min(source_pdf) AS source_pdf FROM job_status WHERE source_pdf IS NOT NULL GROUP BY job_key),
lines AS (
  SELECT DISTINCT p.page_id, j.source_pdf, l.line
  FROM pages p JOIN jobs j USING (job_key),
  LATERAL (SELECT trim(regexp_replace(x, {blank}, ' ', 'g')) AS line FROM (SELECT unnest(string_split(p.text, chr(10))) AS x)) l
  WHERE l.line <> '' AND p.page_id IS NOT NULL),
sizes AS (SELECT source_pdf, count(DISTINCT page_id) AS source_pages FROM lines GROUP BY source_pdf),
found AS (
  SELECT source_pdf, line FROM lines JOIN sizes USING (source_pdf)
  GROUP BY source_pdf, line, source_pages
  HAVING count(*) >= 8 AND count(*) * 100 >= source_pages * 15)
""".format(blank=_BLANK)

_LIMITED = """
modes AS (SELECT job_key, min(mode) AS mode FROM job_status WHERE mode IS NOT NULL GROUP BY job_key),
items AS (
  SELECT 'page' AS item_kind, CAST(page_id AS VARCHAR) AS item_id, job_key, text FROM pages
  UNION ALL SELECT 'chunk', chunk_id, job_key, text FROM chunks)
"""

ORACLES = {
    "p1_clean": f"""WITH {_SOURCED},
drops AS (SELECT source_pdf, list(line) AS drop FROM found GROUP BY source_pdf),
q AS (SELECT DISTINCT ON (page_id) page_id, job_key, text FROM pages WHERE page_id IS NOT NULL),
k AS (SELECT q.page_id, j.source_pdf, q.text, d.drop, string_split(q.text, chr(10)) AS ls FROM q LEFT JOIN jobs j USING (job_key) LEFT JOIN drops d ON d.source_pdf = j.source_pdf),
c AS (SELECT *, list_filter(ls, lambda l: NOT list_contains(drop, trim(regexp_replace(l, {_BLANK}, ' ', 'g')))) AS kept FROM k)
SELECT page_id, source_pdf, CASE WHEN drop IS NULL THEN text ELSE array_to_string(kept, chr(10)) END AS text, CASE WHEN drop IS NULL OR text IS NULL THEN 0 ELSE len(ls) - len(kept) END::INT AS n_removed FROM c""",
    "p7_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
    "p1_found": f"WITH {_SOURCED} SELECT source_pdf, line FROM found",
    "p6_found": f"""WITH {_LIMITED}
SELECT DISTINCT i.item_kind, i.item_id
FROM items i JOIN modes m USING (job_key) JOIN split_limits s ON s.item_kind = i.item_kind AND s.mode = m.mode
WHERE length(i.text) > s.max_chars AND i.item_id IS NOT NULL""",
}
