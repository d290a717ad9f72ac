"""Counterparts of the tree, robots, discovery and crawl plan queries."""

from __future__ import annotations

from crawlscope.sources import adapters as A
from oracles import common as C
from oracles import web

SQL: dict[str, str] = {"s4_stream_duplicate_groups": web.SQL["j0_canonicalize_urls"]}

_DEPTH = f"CASE WHEN trim({C.path()}, '/') = '' THEN 0 ELSE len(string_split(trim({C.path()}, '/'), '/')) END"
# Pages plus one page per language folder, and the root of each site.
_TREE = f"""
    canon AS ({C.CANONICAL}),
    lang_dirs AS (SELECT site, regexp_extract(url, '^([a-z]+://[^/]+/[a-z]+)/', 1) AS url, min(page_ord) AS page_ord FROM canon GROUP BY 1, 2),
    nodes0 AS (SELECT site, url, page_ord, CAST({_DEPTH} AS BIGINT) AS depth FROM canon UNION ALL SELECT site, url, page_ord, 1 FROM lang_dirs),
    roots AS (SELECT site, CASE WHEN length(site) % 2 = 0 THEN {C.origin('first')} || '/' ELSE first END AS root_url
              FROM (SELECT site, min(url) AS first FROM lang_dirs GROUP BY site))
"""


def _parents(nodes: str) -> str:
    site_path = f"coalesce(nullif(rtrim({C.path()}, '/'), ''), '/')"
    return f"""
    pathed AS (SELECT *, {site_path} AS path, coalesce(nullif(regexp_replace({site_path}, '/[^/]*$', ''), ''), '/') AS up FROM {nodes}),
    owners AS (SELECT site, path, url AS owner FROM pathed
               QUALIFY row_number() OVER (PARTITION BY site, path ORDER BY {C.query()} <> '', page_ord) = 1),
    linked AS (SELECT p.site, p.url, p.page_ord, p.depth, p.path, r.root_url,
                      CASE WHEN p.url <> r.root_url THEN coalesce(o.owner, r.root_url) END AS parent_url
               FROM pathed p JOIN roots r USING (site) LEFT JOIN owners o ON o.site = p.site AND o.path = p.up)
    """


SQL["j4_site_parents"] = f"""
WITH {_TREE}, {_parents('nodes0')} SELECT site, url, path, root_url, parent_url FROM linked
"""
SQL["g3_j6_site_tree"] = f"""
WITH RECURSIVE {_TREE},
nodes AS (SELECT * FROM nodes0 UNION ALL
          SELECT r.site, r.root_url, -1, 0 FROM roots r WHERE NOT EXISTS (SELECT 1 FROM nodes0 n WHERE n.site = r.site AND n.url = r.root_url)),
{_parents('nodes')},
reach AS (SELECT site, root_url AS url FROM roots UNION SELECT l.site, l.url FROM linked l JOIN reach ON l.site = reach.site AND l.parent_url = reach.url),
plain AS (SELECT site, url FROM nodes0),
folders AS ({web.folders('plain')}),
placed AS ({web.content_paths('plain')})
SELECT l.site, l.url, l.parent_url, row_number() OVER (PARTITION BY l.site, l.parent_url ORDER BY l.depth, l.url) AS child_ord,
       reach.url IS NOT NULL AS in_tree, placed.content_path
FROM linked l LEFT JOIN reach USING (site, url) LEFT JOIN placed USING (site, url)
"""
SQL["w6_page_inventory"] = f"""
SELECT site, CAST({_DEPTH} AS BIGINT) AS depth, c.url, title, '' AS description, h1
FROM ({C.CANONICAL}) c JOIN (
    SELECT page_id, {web._first('h', 'title')} AS title, {web._first('h', 'h1')} AS h1 FROM (SELECT page_id, {C.visible()} AS h FROM pages)
) f ON f.page_id = c.page_ord
"""
_PREFIX = A.ROBOTS_PREFIX
SQL["src5_w3_robots_rules"] = f"""
SELECT DISTINCT site, CAST(k AS BIGINT) AS line_no, CASE k WHEN 0 THEN '/' ELSE {_PREFIX} END AS prefix
FROM (SELECT {C.host()} AS site FROM pages), (VALUES (0), (1)) v(k)
"""


def _blocked(u: str) -> str:
    return f"starts_with({C.path(u)}, {_PREFIX})"


SQL["f2_j1_robots_filter"] = f"SELECT site, url, {_blocked('url')} AS blocked FROM ({C.CANONICAL})"
SQL["j1_robots_blocked"] = f"SELECT site, url FROM ({C.CANONICAL}) WHERE {_blocked('url')}"
SQL["u4_sitemap_roots"] = f"SELECT site, origin || '/map-index.xml' AS doc_url, CAST(0 AS BIGINT) AS ord FROM ({C.SITES})"
WALK_ALL = f"""
    SELECT site, url, CAST(2 AS BIGINT) AS depth, '0.' || b || '.' || l || '.' || p AS place FROM (
    SELECT {C.host()} AS site, url,
           dense_rank() OVER (PARTITION BY {C.host()} ORDER BY page_id // 3200000) - 1 AS b,
           dense_rank() OVER (PARTITION BY {C.host()}, page_id // 3200000 ORDER BY page_id // 64) - 1 AS l,
           row_number() OVER (PARTITION BY {C.host()}, page_id // 64 ORDER BY page_id) - 1 AS p
    FROM pages)
"""
WALK = f"{WALK_ALL} QUALIFY row_number() OVER (PARTITION BY site ORDER BY b, l, p) <= 2000"
SQL["src3_walk_unbounded"] = WALK_ALL
SQL["src3_g2_sitemap_walk"] = WALK
FEEDS = f"""
    SELECT {C.host()} AS site, 'https://' || {C.host()} || '/feed/' || page_id AS doc_url, CAST(0 AS BIGINT) AS pos, url FROM pages
    UNION ALL
    SELECT {C.host()}, 'https://' || {C.host()} || '/feed/' || page_id, 1, url || '-first' FROM pages WHERE page_id % 2 = 1
"""
SQL["src4_feed_links"] = FEEDS
_FOUND = f"SELECT site, url, 'sitemap' AS source FROM ({WALK}) UNION ALL SELECT site, url, 'rss' FROM ({FEEDS})"
SQL["u1_discover_urls"] = f"SELECT site, url, max(source) AS source, count(*) AS copies FROM ({_FOUND}) GROUP BY site, url"
SQL["a6_discovery_counts"] = f"""
SELECT site, count(*) FILTER (source = 'sitemap') AS sitemap, count(*) FILTER (source = 'rss') AS rss, count(DISTINCT url) AS total_unique
FROM ({_FOUND}) GROUP BY site
"""
SQL["u2_j2_merge_seeds"] = f"""
WITH roots AS (SELECT site, url FROM ({C.CANONICAL}) WHERE rn = 1),
     allseeds AS (SELECT site, url FROM roots UNION SELECT site, {C.norm()} FROM ({_FOUND}))
SELECT s.site, s.url, r.url IS NOT NULL AS is_root FROM allseeds s LEFT JOIN roots r USING (site, url)
"""


def plan(max_pages: int, max_depth: int) -> str:
    """Breadth-first visit of the heap: children 2n and 2n+1 of page n."""
    return f"""
    WITH RECURSIVE canon AS (SELECT *, {_blocked('url')} AS blocked FROM ({C.CANONICAL})),
    walk AS (
        SELECT site, url, rn, CAST(0 AS BIGINT) AS depth, CASE WHEN blocked THEN 'blocked' WHEN url LIKE '%.html' THEN 'failed' ELSE 'ok' END AS status
        FROM canon WHERE rn = 1
        UNION ALL
        SELECT c.site, c.url, c.rn, w.depth + 1, CASE WHEN c.url LIKE '%.html' THEN 'failed' ELSE 'ok' END
        FROM walk w JOIN canon c ON c.site = w.site AND c.rn // 2 = w.rn WHERE w.status = 'ok' AND NOT c.blocked AND w.depth < {max_depth}
    )
    SELECT site, url, depth, row_number() OVER (PARTITION BY site ORDER BY depth, rn) AS visit_ord, status FROM walk
    QUALIFY row_number() OVER (PARTITION BY site ORDER BY depth, rn) <= {max_pages}
    """


SQL["g1_crawl_plan"] = plan(8, 5)
SQL["g1_crawl_plan_unbounded"] = plan(2**31 - 1, 2**31 - 1)
SQL["g1_plan_summary"] = f"""
SELECT site, count(*) FILTER (status = 'ok') AS visited, count(*) FILTER (status = 'blocked') AS blocked,
       count(*) FILTER (status = 'failed') AS failed, max(depth) AS max_depth, count(*) >= 12 AS budget_used
FROM ({plan(12, 3)}) GROUP BY site
"""
SQL["g4_journey_steps"] = f"""
WITH p AS (SELECT * FROM ({plan(50, 5)}) WHERE status = 'ok'),
     g AS (SELECT * FROM (VALUES ('french', '/fr/'), ('german', '/de/'), ('spanish', '/es/')) v(goal, prefix)),
     s AS (SELECT site, goal, min(CASE WHEN starts_with({C.path()}, prefix) THEN depth + 1 END) AS steps FROM p, g GROUP BY site, goal)
SELECT site, goal, steps, CASE WHEN steps <= 3 THEN 'good' WHEN steps <= 5 THEN 'fair' ELSE 'poor' END AS grade FROM s
"""
SQL["g4_journey_paths"] = f"""
WITH p AS (SELECT p.*, c.rn FROM ({plan(2**31 - 1, 2**31 - 1)}) p JOIN ({C.CANONICAL}) c USING (site, url)),
     g AS (SELECT * FROM (VALUES ('french', '^/fr/'), ('german', '^/de/'), ('spanish', '^/es/'), ('late', '[5-9]$')) v(goal, pattern)),
     hits AS (SELECT site, goal, arg_min(row(url, depth, rn), visit_ord) AS hit FROM p, g WHERE status = 'ok' AND regexp_matches({C.path()}, pattern) GROUP BY site, goal),
     chosen AS (SELECT site, goal, hit[1] AS goal_url, hit[2] AS depth, hit[3] AS rn FROM hits),
     places AS (SELECT site, goal, depth, unnest(range(0, depth + 1)) AS up, rn FROM chosen),
     paths AS (SELECT l.site, l.goal, string_agg(c.url, ' ' ORDER BY l.up DESC) AS path
               FROM places l JOIN ({C.CANONICAL}) c ON c.site = l.site AND c.rn = l.rn // CAST(pow(2, l.up) AS BIGINT) GROUP BY l.site, l.goal)
SELECT site, goal, goal_url, path, depth + 1 AS steps, coalesce(rn IN (2, 3), false) AS in_navigation,
       CASE WHEN depth + 1 <= 3 AND rn IN (2, 3) THEN 'good' WHEN depth + 1 <= 5 THEN 'fair' ELSE 'poor' END AS grade
FROM (SELECT DISTINCT site FROM p) CROSS JOIN (SELECT goal FROM g) LEFT JOIN chosen USING (site, goal) LEFT JOIN paths USING (site, goal)
"""
SQL["a4_crawl_summary"] = f"""
WITH v AS (SELECT site, count(*) FILTER (status = 'ok') AS visited_pages, 2 * count(*) FILTER (status = 'ok') AS screenshots,
                  count(*) FILTER (status = 'blocked') AS robots_blocked, count(*) FILTER (status = 'failed') AS failed_pages
           FROM ({plan(12, 3)}) GROUP BY site),
     f AS (SELECT site, count(DISTINCT src) FILTER (kind = 'script') AS unique_scripts, count(DISTINCT src) FILTER (kind = 'style') AS unique_styles
           FROM ({web.ASSETS}) GROUP BY site),
     d AS (SELECT site, count(*) AS discovered_urls, count(*) FILTER (raw_url NOT LIKE '%#top') AS content_mirrored,
                  count(*) FILTER (raw_url LIKE '%#top') AS content_errors FROM ({C.CANONICAL}) GROUP BY site)
SELECT * FROM v JOIN f USING (site) JOIN d USING (site)
"""
SQL["l3_scan_targets"] = f"""
SELECT site, url, CAST(rank AS BIGINT) AS rank FROM (SELECT site, url, row_number() OVER (PARTITION BY site ORDER BY page_ord) AS rank FROM ({C.CANONICAL})) WHERE rank <= 6
"""
