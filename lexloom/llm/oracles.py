"""DuckDB twins of the queries that SQL can express."""

from __future__ import annotations

from lexloom.llm.quality import RULES, STOP_WORDS

S = "\\x20\\x09-\\x0D"
UP, LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def urls(rules, listed: str) -> str:
    order = sorted(rules, key=lambda x: -len(x[1]))

    def fits(r: str) -> str:
        h, slash, p = r.partition("/")
        return f"((host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{slash + p}'))"

    rule = "CASE " + " ".join(f"WHEN {fits(r)} THEN '{r}'" for _, r in order) + " END"
    verdict = "CASE " + " ".join(f"WHEN {fits(r)} THEN '{v}'" for v, r in order) + " WHEN canon <> '' AND canon IN (SELECT canon FROM c WHERE listed) THEN 'block' ELSE 'allow' END"
    return f"""WITH p AS (SELECT page_id, url, html, coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1), '{UP}', '{LOW}'), '') AS host, coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
  q AS (SELECT *, list_sort(list_filter(string_split(regexp_extract(url, '://[^?#]*\\?([^#]*)', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[a-z]+|ref|gclid|fbclid)(=|$)'))) AS ps FROM p),
  c AS (SELECT page_id, host, path, coalesce(regexp_matches(html, '{listed}'), false) AS listed, coalesce(CASE WHEN contains(url, '://') THEN regexp_replace(host, '^(www|m)\\.', '') || regexp_replace(path, '/+$', '') || CASE WHEN len(ps) > 0 THEN '?' || array_to_string(ps, '&') ELSE '' END ELSE url END, '') AS canon FROM q)
  SELECT page_id, host, path, {rule} AS rule, {verdict} AS verdict FROM c"""


def quality() -> str:
    bad = []
    for r in RULES:
        num, _, den = r.ratio.partition(" / ")
        ratio = f"({num}::DOUBLE / nullif({den}, 0))" if den else f"{num}::DOUBLE"
        bad += [f"coalesce({ratio} < {r.least}, false)"] if r.least is not None else []
        bad += [f"coalesce({ratio} > {r.most}, false)"] if r.most is not None else []
    stop = ", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS)))
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
  w AS (SELECT doc_id, t, regexp_extract_all(t, '[^{S}]+') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^{S}]')) AS ls FROM d),
  g AS (SELECT doc_id, i, array_to_string(list_slice(ws, i + 1, i + 8), ' ') AS g FROM (SELECT doc_id, ws, unnest(range(len(ws) - 7)) AS i FROM w)),
  u AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g) WHERE n > 1),
  r AS (SELECT doc_id, sum(least(8, coalesce(nxt - i, 8))) AS n FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM u) GROUP BY doc_id),
  m AS (SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars, CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words, len(ls) AS n_lines, len(list_filter(ls, lambda x: regexp_matches(x, '(\\.\\.\\.|…)[{S}]*$'))) AS n_ellipsis_lines, len(list_filter(ws, lambda x: lower(x) IN ({stop}))) AS n_stop_words FROM w LEFT JOIN r ON r.doc_id = w.doc_id),
  b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
  SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT ({" OR ".join(bad)}) AS kept FROM b"""


LINES = f"""WITH l AS (SELECT doc_id, ls, unnest(range(len(ls))) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)),
  k AS (SELECT doc_id, i, ls[i + 1] AS line, translate(trim(ls[i + 1], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UP}', '{LOW}') AS key FROM l),
  h AS (SELECT key, max(doc_id) AS top FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
  f AS (SELECT k.*, h.key IS NOT NULL AND k.doc_id <> h.top AS gone FROM k LEFT JOIN h ON h.key = k.key)
  SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM f GROUP BY doc_id"""

LINKS = """WITH RECURSIVE e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE label IS NOT NULL),
  p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.v, b.v) >= 0.93),
  c AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT c.a, p.b FROM c JOIN p ON p.a = c.b),
  n AS (SELECT a, count(*) AS n FROM p GROUP BY a)
  SELECT m.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, r.root AS component_id, m.vec_id = r.root AS kept FROM embeddings m JOIN (SELECT a, min(b) AS root FROM c GROUP BY a) r ON r.a = m.vec_id LEFT JOIN n ON n.a = m.vec_id"""
