"""Counterparts of the style, tech, API and stream queries."""

from __future__ import annotations

from crawlscope.sources import adapters as A
from oracles import common as C

SQL: dict[str, str] = {}

_ALL_PAGE_COLORS = f"""
    SELECT site, page_id, value, cnt, page_rank FROM (
    SELECT site, page_id, value, CAST(sum(cnt) AS BIGINT) AS cnt,
           row_number() OVER (PARTITION BY site, page_id ORDER BY sum(cnt) DESC, min(row(o1, o2, o3, o4))) AS page_rank
    FROM ({C.STYLE}) GROUP BY site, page_id, value)
"""
PAGE_COLORS = f"{_ALL_PAGE_COLORS} WHERE page_rank <= 25"
SQL["l5_page_colors"] = PAGE_COLORS
def _palette(page_colors: str) -> str:
    return f"""
    SELECT site, rank, coalesce(['Primary', 'Secondary', 'Accent', 'Surface', 'Muted'][rank], 'Color ' || rank) AS role, value,
           printf('#%02X%02X%02X', CAST(split_part(substr(value, 5), ',', 1) AS INT), CAST(trim(split_part(value, ',', 2)) AS INT), 0) AS hex, cnt
    FROM (SELECT site, value, CAST(sum(cnt) AS BIGINT) AS cnt,
                 row_number() OVER (PARTITION BY site ORDER BY sum(cnt) DESC, min(row(page_id, page_rank))) AS rank
          FROM ({page_colors}) GROUP BY site, value)
"""


PALETTE = f"{_palette(PAGE_COLORS)} WHERE rank <= 12"
SQL["a1_palette"] = PALETTE
SQL["a1_palette_uncut"] = _palette(_ALL_PAGE_COLORS)
TYPOGRAPHY = f"""
    WITH p AS (SELECT * FROM (
        SELECT site, page_id, family, size, weight, CAST(sum(cnt) AS BIGINT) AS cnt, arg_min(tag, row(o1, o2, o3, o4)) AS tag,
               row_number() OVER (PARTITION BY site, page_id ORDER BY sum(cnt) DESC, min(row(o1, o2, o3, o4))) AS page_rank
        FROM ({C.STYLE}) GROUP BY site, page_id, family, size, weight) WHERE page_rank <= 20)
    SELECT site, rank, family, size, weight, sample_tag, cnt FROM (
        SELECT site, family, size, weight, CAST(sum(cnt) AS BIGINT) AS cnt, arg_max(tag, row(page_id, page_rank)) AS sample_tag,
               row_number() OVER (PARTITION BY site ORDER BY sum(cnt) DESC, min(row(page_id, page_rank))) AS rank
        FROM p GROUP BY site, family, size, weight) WHERE rank <= 10
"""
SQL["a2_typography"] = TYPOGRAPHY
SQL["src7_response_log"] = f"""
SELECT site, seq, url, CASE WHEN seq % 3 = 0 THEN seq ELSE size END AS size, 'Content-Encoding,Content-Length,Server,Via' AS kept FROM ({C.FETCH})
"""
DETECTIONS = f"""
    SELECT {C.host()} AS site, page_id, CAST(3 AS BIGINT) AS rule_ord, 'jQuery' AS name, 'Likely' AS confidence, 'script src' AS evidence,
           '3.' || page_id % 10 || '.0' AS version FROM pages
    UNION ALL
    SELECT {C.host()}, page_id, 0, 'Next.js', 'Confirmed', '__NEXT_DATA__ global', '' FROM pages WHERE page_id % 5 = 1
"""
SQL["j8_fingerprint_match"] = DETECTIONS
FRAMEWORKS = f"""
    SELECT site, name, version, confidence, evidence, count(*) AS pages, min(page_id) AS first_page, any_value(rule_ord) AS rule_ord
    FROM ({DETECTIONS}) GROUP BY site, name, version, confidence, evidence
"""
SQL["a8_frameworks"] = FRAMEWORKS
TOP = f"""
    SELECT * FROM (SELECT site, seq, url, type, size, row_number() OVER (PARTITION BY site ORDER BY size DESC, seq) AS rank FROM ({C.FETCH})) WHERE rank <= 10
"""
SQL["l1_top_resources"] = TOP
SQL["f5_third_party_heavy"] = f"SELECT * FROM ({TOP}) WHERE {C.host()} <> site AND type IN ('script', 'stylesheet', 'image', 'font')"
SQL["a17_third_party_inventory"] = f"""
SELECT site, host, count(*) AS requests, CAST(sum(size) AS BIGINT) AS bytes,
       CASE host WHEN 'cdn0' THEN 'Analytics' WHEN 'cdn1' THEN 'Fonts' ELSE 'Other' END AS purpose
FROM (SELECT site, {C.host()} AS host, size FROM ({C.FETCH})) WHERE host <> site GROUP BY site, host
"""
_MAIN = f"""
    SELECT site, seq, url, status, size FROM ({C.FETCH}) WHERE type = 'document' AND {C.host()} = site
    QUALIFY row_number() OVER (PARTITION BY site ORDER BY seq) = 1
"""
SQL["w4_main_document"] = _MAIN
SQL["p7_a18_infra_signals"] = f"""
SELECT site, 'srv' || user_id % 3 AS server, 'edge' AS cdn, CASE WHEN seq % 2 = 0 THEN 'gzip' ELSE 'br' END AS compression, true AS https
FROM ({_MAIN}) m JOIN events e ON e.event_id = m.seq
"""
SQL["a9_web_vitals"] = f"""
SELECT site, arg_max(start, seq) FILTER (start IS NOT NULL) AS lcp,
       CAST(round(coalesce(sum(CAST(shift AS DECIMAL(18,6))) FILTER (NOT recent_input), 0), 3) AS DOUBLE) AS cls
FROM ({C.adapter(A.VITALS, 'events')}) GROUP BY site
"""
SQL["a10_timing_grades"] = f"""
SELECT metric, grade, count(*) AS visits, max(value) AS worst FROM (
SELECT metric, value, CASE WHEN value < lim THEN 'good' ELSE 'poor' END AS grade FROM (
    SELECT 'dom_content_loaded' AS metric, dom_content_loaded AS value, 1500 AS lim FROM t UNION ALL SELECT 'load_complete', load_complete, 3000 FROM t
    UNION ALL SELECT 'lcp', lcp, 2500 FROM t UNION ALL SELECT 'cls', cls, 0.1 FROM t)) GROUP BY metric, grade
""".replace(" FROM t", f" FROM ({C.adapter(A.TIMINGS, 'events')})")
SQL["src8_lighthouse_scores"] = """
SELECT site, category, score, CASE WHEN score >= 90 THEN 'good' WHEN score >= 50 THEN 'fair' ELSE 'poor' END AS grade FROM (
    SELECT 'report' || event_id AS site, 'performance' AS category, CAST(event_id % 101 AS DOUBLE) AS score FROM events WHERE event_id % 11 <> 0
    UNION ALL SELECT 'report' || event_id, 'best-practices', 50.0 FROM events WHERE event_id % 11 <> 0 AND event_id % 7 <> 0
    UNION ALL SELECT 'report' || event_id, 'seo', 90.0 FROM events WHERE event_id % 11 <> 0)
"""
SQL["w7_politeness"] = f"""
SELECT site, count(*) AS requests, count(*) FILTER (gap < 600000000) AS violations, min(gap) // 1000 AS min_gap_ms FROM (
    SELECT site, us - lag(us) OVER (PARTITION BY site ORDER BY us, seq) AS gap FROM (SELECT site, seq, epoch_us(ts) AS us FROM ({C.FETCH}))) GROUP BY site
"""
SQL["w8_attempt_groups"] = f"""
SELECT site, url, count(*) AS attempts, bool_or(ok) AS ok, CASE WHEN NOT bool_or(ok) THEN arg_max(error, seq) END AS last_error, count(*) > 3 AS over_limit
FROM ({C.adapter(A.ATTEMPTS, 'events')}) GROUP BY site, url
"""
CALLS = f"""
    SELECT site, seq, method, left(url, 300) AS url, status, type, content_type, {C.host()} = site AS same_origin,
           CASE WHEN content_type LIKE '%json%' THEN body END AS body_preview
    FROM ({C.FETCH}) WHERE type IN ('fetch', 'xhr')
"""
SQL["f3_f4_api_calls"] = CALLS
ENDPOINTS = f"SELECT site, url, min(seq) AS first_seq, count(*) AS calls, bool_or(same_origin) AS same_origin FROM ({CALLS}) GROUP BY site, url"
SQL["a7_endpoints"] = ENDPOINTS
API_SUMMARY = f"""
    SELECT site, count(*) AS api_calls, count(*) FILTER (same_origin) AS same_origin_calls, count(DISTINCT url) AS endpoints FROM ({CALLS}) GROUP BY site
"""
SQL["a7_api_summary"] = API_SUMMARY
GATE = f"""
    SELECT site, own_endpoints, structures, gate, CASE gate WHEN 'sufficient' THEN 'Confirmed' ELSE 'Hypothesis' END AS confidence_cap FROM (
    SELECT *, CASE WHEN own_endpoints >= 3 OR structures >= 2 THEN 'sufficient' WHEN own_endpoints = 0 THEN 'none' ELSE 'insufficient' END AS gate FROM (
    SELECT site, coalesce(own_endpoints, 0) AS own_endpoints, coalesce(structures, 0) AS structures
    FROM (SELECT site, count(DISTINCT url) FILTER (same_origin) AS own_endpoints FROM ({CALLS}) GROUP BY site)
    FULL JOIN (SELECT site, count(DISTINCT type || content_type) AS structures FROM ({CALLS}) GROUP BY site) USING (site)))
"""
SQL["a11_evidence_gate"] = GATE
SQL["a15_payload_profile"] = f"SELECT site, url, 'k' AS field, 'BIGINT' AS type, count(*) AS calls FROM ({C.FETCH}) GROUP BY site, url"
SQL["a15_payload_schema"] = f"SELECT site, url, count(*) AS calls, 'OBJECT<k: BIGINT>' AS schema FROM ({C.FETCH}) GROUP BY site, url"
# Every node of every body, as the other engine's parser walks it; list places become [].
SQL["a15_payload_fields"] = f"""
WITH bodies AS (SELECT seq, site, url, body FROM ({C.adapter({**A.FETCH_LOG, 'body': A.NESTED_BODY}, 'events')}) WHERE json_valid(body)),
nodes AS (
  SELECT DISTINCT b.seq, b.site, b.url, regexp_replace(j.fullkey, '\\[[0-9]+\\]', '[]', 'g') AS path,
         CASE j.type WHEN 'UBIGINT' THEN 'BIGINT' WHEN 'VARCHAR' THEN 'STRING' WHEN 'NULL' THEN 'VOID' ELSE j.type END AS type
  FROM bodies b, LATERAL (SELECT fullkey, type FROM json_tree(b.body)) j),
sums AS (SELECT site, url, count(*) AS bodies FROM bodies GROUP BY site, url)
SELECT site, url, path, type, count(*) AS calls, any_value(bodies) AS bodies FROM nodes JOIN sums USING (site, url) GROUP BY site, url, path, type
"""
SQL["s4_stream_request_rates"] = f"""
SELECT site, CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS start, count(*) AS requests, CAST(sum(size) AS BIGINT) AS bytes FROM ({C.FETCH}) GROUP BY 1, 2
"""
SQL["s4_stream_politeness"] = f"SELECT *, CAST(0 AS BIGINT) AS late FROM ({SQL['w7_politeness']})"
SQL["s4_stream_fresh_urls"] = f"SELECT DISTINCT site, {C.norm()} AS norm_url FROM ({C.FETCH})"
STAGES = C.adapter(A.STAGE_LOG, "orders")
SQL["s4_stream_stage_status"] = f"SELECT site, stage, arg_max(status, row(ts, seq)) AS status, count(*) AS events FROM ({STAGES}) GROUP BY site, stage"
SQL["a10_timing_rollup"] = f"""
SELECT site, count(*) AS n, round(avg(lcp), 3) AS mean, quantile_disc(lcp, 0.5) AS p50, quantile_disc(lcp, 0.75) AS p75
FROM ({C.adapter({**A.TIMINGS, 'site': A.FETCH_LOG['site']}, 'events')}) GROUP BY site
"""

# Unrounded values of the events, nearly all of them different, for a few sites.
SQL["a10_raw_quantiles"] = f"""
SELECT site, count(*) AS n, round(avg(value), 3) AS mean, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.75) AS p75
FROM (SELECT {A.FETCH_LOG['site']} AS site, value FROM events) GROUP BY site
"""
SQL["a4_distinct_sketches"] = f"""
SELECT site, kind, exact, true AS within_two_percent FROM (
  SELECT site, 'url' AS kind, count(DISTINCT url) AS exact FROM ({C.FETCH}) GROUP BY site UNION ALL SELECT site, 'call', count(DISTINCT seq) FROM ({C.FETCH}) GROUP BY site)
"""
_PER_PAGE = "(SELECT page_id, url, unnest(range(0, page_id % 4 + 1)) AS k FROM pages)"
SQL["a8_page_results"] = f"""
WITH found AS (SELECT page_id, string_agg(name || CASE WHEN version <> '' THEN ' ' || version ELSE '' END, ', ' ORDER BY rule_ord) AS frameworks FROM ({DETECTIONS}) GROUP BY page_id),
log AS (SELECT site, page_url AS url, arg_min(status, seq) FILTER (type = 'document') AS status, count(*) AS requests FROM ({C.adapter(A.PAGE_LOG, _PER_PAGE)}) GROUP BY ALL),
times AS (SELECT site, page_url AS url, max(dom_content_loaded) AS dom_content_loaded, max(load_complete) AS load_complete FROM ({C.adapter(A.PAGE_TIMES, 'pages')}) GROUP BY ALL),
vitals AS (
  SELECT site, page_url AS url, arg_max(start, seq) FILTER (start IS NOT NULL) AS lcp,
         CAST(round(coalesce(sum(CAST(shift AS DECIMAL(26,16))) FILTER (NOT recent_input), 0), 3) AS DOUBLE) AS cls FROM ({C.adapter(A.PAGE_VITALS, _PER_PAGE)}) GROUP BY ALL)
SELECT p.site, page_id, p.url, status, coalesce(frameworks, '') AS frameworks, dom_content_loaded, load_complete, lcp, cls, coalesce(requests, 0) AS requests
FROM (SELECT {C.host()} AS site, page_id, url FROM pages) p LEFT JOIN found USING (page_id) LEFT JOIN log USING (site, url)
LEFT JOIN times USING (site, url) LEFT JOIN vitals USING (site, url)
"""
