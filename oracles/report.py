"""Counterparts of the status and report queries."""

from __future__ import annotations

from oracles import common as C
from oracles import tech, web

SQL: dict[str, str] = {}

_ORDER = "(VALUES ('target', 0), ('ux', 1), ('ia', 2), ('tech', 3), ('db', 4), ('report', 5), ('handover', 6))"


def status(log: str) -> str:
    return f"""
    SELECT g.site, g.stage, coalesce(status, 'pending') AS status,
           CASE WHEN status = 'done' THEN strftime(ts, '%Y-%m-%d') END AS completed_at, coalesce(notes, '') AS notes, coalesce(artifacts, '') AS artifacts
    FROM (SELECT DISTINCT site, v.stage FROM ({tech.STAGES}), {_ORDER} v(stage, k)) g
    LEFT JOIN (SELECT site, stage, status, ts, notes FROM ({log}) QUALIFY row_number() OVER (PARTITION BY site, stage ORDER BY ts DESC, seq DESC) = 1) l USING (site, stage)
    LEFT JOIN (SELECT site, stage, arg_max(artifact, row(ts, seq)) AS artifacts FROM ({log}) WHERE artifact IS NOT NULL GROUP BY site, stage) a USING (site, stage)
    """


SQL["s1_stage_status"] = status(tech.STAGES)
_KEPT = f"""
    SELECT l.* FROM ({tech.STAGES}) l LEFT JOIN (SELECT site, max(row(ts, seq)) AS reset FROM ({tech.STAGES}) WHERE stage = 'target' AND status = 'done' GROUP BY site) r USING (site)
    WHERE stage = 'target' OR reset IS NULL OR row(ts, seq) > reset
"""
SQL["s2_downstream_reset"] = status(_KEPT)
SQL["s3_gate_check"] = f"""
WITH s AS ({status(tech.STAGES)}), needs AS (SELECT * FROM (VALUES ('ux', 'target', 1), ('ia', 'ux', 1), ('tech', 'ia', 1), ('db', 'ia', 1), ('db', 'tech', 2),
    ('report', 'ux', 1), ('report', 'ia', 2), ('report', 'tech', 3), ('report', 'db', 4)) v(stage, need, k))
SELECT s.site, n.stage, coalesce(string_agg(n.need, ',' ORDER BY n.k) FILTER (s.status <> 'done'), '') AS missing, bool_and(s.status = 'done') AS may_run
FROM needs n JOIN s ON s.stage = n.need GROUP BY s.site, n.stage
"""
REPORT = f"""
    SELECT site, ux_pages, ux_pages IS NOT NULL AS has_ux, ia_pages, nav_items, ia_pages IS NOT NULL AS has_ia, frameworks, frameworks IS NOT NULL AS has_tech,
           same_origin_calls, same_origin_calls IS NOT NULL AS has_api
    FROM (SELECT site, count(DISTINCT page_id) AS ux_pages FROM ({C.STYLE}) GROUP BY site)
    FULL JOIN (SELECT site, ia_pages, nav_items FROM (SELECT site, count(*) AS ia_pages FROM ({C.CANONICAL}) GROUP BY site)
               LEFT JOIN (SELECT site, count(*) AS nav_items FROM ({web.NAVIGATION}) GROUP BY site) USING (site)) USING (site)
    FULL JOIN (SELECT site, count(*) AS frameworks FROM ({tech.FRAMEWORKS}) GROUP BY site) USING (site)
    FULL JOIN (SELECT site, same_origin_calls FROM ({tech.API_SUMMARY})) USING (site)
"""
SQL["j7_site_report"] = REPORT
SQL["r1_report_metrics"] = f"""
SELECT site, coalesce(ia_pages, ux_pages, 0) AS pages, coalesce(nav_items, 0) AS nav_items, coalesce(frameworks, 0) AS frameworks,
       coalesce(same_origin_calls, 0) AS same_origin_calls FROM ({REPORT})
"""
GAPS = f"""
    WITH r AS ({REPORT}), g AS (
        SELECT site, 'ux_summary' AS item, 'Unknown' AS state FROM r WHERE NOT has_ux UNION ALL SELECT site, 'ia_summary', 'Unknown' FROM r WHERE NOT has_ia
        UNION ALL SELECT site, 'tech_summary', 'Unknown' FROM r WHERE NOT has_tech
        UNION ALL SELECT site, 'api_evidence', 'Hypothesis' FROM r WHERE coalesce(same_origin_calls, 0) = 0)
    SELECT * FROM g UNION ALL SELECT site, 'none', 'Confirmed' FROM r WHERE site NOT IN (SELECT site FROM g)
"""
SQL["a14_known_gaps"] = f"""
SELECT *, CASE item WHEN 'none' THEN '' WHEN 'api_evidence' THEN 'too_few_own_calls_seen' ELSE replace(item, '_summary', '_scan_not_run') END AS reason,
       CASE item WHEN 'none' THEN '' WHEN 'api_evidence' THEN 'collect_more_journeys_or_data_by_hand' ELSE 'run_' || replace(item, '_summary', '_scan') END AS action
FROM ({GAPS})
"""
FEATURES = f"""
    WITH texts AS (SELECT site, lower(text) AS t FROM ({web.NAVIGATION}) UNION ALL
        SELECT site, lower(CASE length(site) % 5 WHEN 0 THEN 'Contact us' WHEN 1 THEN 'About our Services' WHEN 2 THEN 'SHOP / Product' ELSE 'news' END) FROM ({C.SITES})),
    words AS (SELECT * FROM (VALUES ('문의', 'contact_form', 1), ('contact', 'contact_form', 2), ('portfolio', 'portfolio', 3), ('gallery', 'portfolio', 4),
        ('service', 'services', 5), ('about', 'about_team', 6), ('blog', 'blog_news', 7), ('login', 'login_signup', 8), ('signup', 'login_signup', 9),
        ('admin', 'admin', 10), ('shop', 'payment', 11), ('product', 'payment', 12)) v(word, feature, k)),
    found AS (SELECT site, feature, CAST(min(k) AS BIGINT) AS feature_ord FROM texts JOIN words ON contains(t, word) GROUP BY site, feature)
    SELECT * FROM found UNION ALL SELECT DISTINCT site, 'home', 0 FROM found
    UNION ALL SELECT site, f, k FROM ({C.SITES}), (VALUES ('home', 0), ('services', 1), ('contact_form', 2)) v(f, k) WHERE site NOT IN (SELECT site FROM found)
"""
SQL["j9_site_features"] = FEATURES
SQL["r3_feature_checklist"] = f"""
SELECT coalesce(s.site, f.site) AS site, coalesce(s.feature, f.feature) AS feature, s.feature IS NOT NULL AS standard, f.feature IS NOT NULL AS found
FROM (SELECT site, feature FROM ({C.SITES}), (VALUES ('home'), ('portfolio'), ('services'), ('about_team'), ('blog_news'), ('contact_form'), ('login_signup'),
      ('admin'), ('payment'), ('multilingual')) v(feature)) s
FULL JOIN ({FEATURES}) f ON f.site = s.site AND f.feature = s.feature
"""
_PATH = C.path()
SQL["l2_r2_report_sections"] = f"""
WITH lines AS (
    SELECT site, 'palette' AS section, rank, role || ': ' || hex || ' (' || value || ', count ' || cnt || ')' AS line FROM ({tech.PALETTE}) WHERE rank <= 5
    UNION ALL SELECT site, 'typography', rank, family || ' / ' || size || ' / ' || weight FROM ({tech.TYPOGRAPHY}) WHERE rank <= 4
    UNION ALL SELECT site, 'navigation', rank, text || ' (' || href || ')' FROM ({web.NAVIGATION}) WHERE rank <= 8
    UNION ALL SELECT site, 'frameworks', rank, name || ' (' || confidence || ')' FROM (
        SELECT *, row_number() OVER (PARTITION BY site ORDER BY first_page, rule_ord, version) AS rank FROM ({tech.FRAMEWORKS})) WHERE rank <= 6
    UNION ALL SELECT site, 'api', rank, {_PATH} FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY first_seq) AS rank FROM ({tech.ENDPOINTS})) WHERE rank <= 6),
sites AS (SELECT site FROM ({C.STYLE}) UNION SELECT site FROM ({C.SITES}) UNION SELECT site FROM ({tech.ENDPOINTS}))
SELECT * FROM lines
UNION ALL SELECT site, section, 1, 'needs_more_data' FROM sites, (VALUES ('palette'), ('typography'), ('navigation'), ('frameworks'), ('api')) v(section)
WHERE NOT EXISTS (SELECT 1 FROM lines l WHERE l.site = sites.site AND l.section = v.section)
"""
SQL["r4_request_list"] = f"""
SELECT site, CAST(k + CASE WHEN coalesce(same_origin_calls, 0) = 0 THEN 1 ELSE 0 END AS BIGINT) AS ord, request
FROM ({REPORT}), (VALUES (0, 'review_known_gaps'), (1, 'complete_budget_schedule_owner')) v(k, request)
UNION ALL SELECT site, 0, 'verify_api_structure' FROM ({REPORT}) WHERE coalesce(same_origin_calls, 0) = 0
"""
SQL["r5_confidence_rollup"] = f"""
SELECT site, count(*) FILTER (state = 'Confirmed') AS confirmed, count(*) FILTER (state = 'Likely') AS likely, count(*) FILTER (state = 'Hypothesis') AS hypothesis,
       count(*) FILTER (state = 'Unknown') AS unknown, count(*) FILTER (state IN ('Hypothesis', 'Unknown')) > 0 AS follow_up
FROM (SELECT site, state FROM ({GAPS}) UNION ALL SELECT site, confidence FROM ({tech.DETECTIONS})) GROUP BY site
"""
SQL["a11_capped_findings"] = f"""
SELECT g.site, g.item, CASE WHEN coalesce(c.confidence_cap, 'Hypothesis') = 'Hypothesis' AND g.state IN ('Confirmed', 'Likely') THEN 'Hypothesis' ELSE g.state END AS state
FROM ({GAPS}) g LEFT JOIN ({tech.GATE}) c USING (site)
"""
