"""Counterparts of the URL, text and HTML queries."""

from __future__ import annotations

from oracles import common as C

SQL: dict[str, str] = {}

SQL["j0_canonicalize_urls"] = f"""
SELECT page_id, url, norm_url, count(*) OVER w AS group_size, page_id = min(page_id) OVER w AS is_first
FROM (SELECT page_id, url, {C.norm()} AS norm_url FROM pages) WINDOW w AS (PARTITION BY norm_url)
"""
_UP = f"regexp_replace(regexp_replace({C.path('page_url')}, '[^/]*$', ''), '[^/]+/$', '')"
SQL["p1_p2_resolve_and_normalize"] = f"""
SELECT page_id, link_ord, href, {C.norm('href')} AS norm,
       {C.origin('page_url')} || {_UP} || 'x/' || page_id || '?a=2&b=1' AS relative
FROM ({C.RICH_LINKS})
"""
SQL["p3_f1_same_site_links"] = f"""
SELECT site, count(*) AS links, count(DISTINCT href) AS targets FROM ({C.RICH_LINKS}) WHERE {C.host('href')} = site GROUP BY site
"""


def _dashes(x: str) -> str:
    return f"trim(regexp_replace({x}, '[^a-zA-Z0-9_-]+', '-', 'g'), '-')"


def _slug(u: str) -> str:
    base = f"coalesce(nullif({_dashes(f'trim({C.path(u)}, chr(47))')}, ''), 'home')"
    tail = _dashes(C.query(u))
    return f"left({base} || CASE WHEN {tail} = '' THEN '' ELSE '-' || {tail} END, 80)"


SQL["p4_slugs"] = f"SELECT page_id, {_slug('url')} AS slug FROM pages"
SEQUENCE = f"""
    SELECT site, url, page_ord, rn AS page_no,
           '_audit/screenshots/' || printf('%03d', rn) || '-' || {_slug('url')} || '-pc.png' AS screenshot,
           '_audit/screenshots/' || printf('%03d', rn) || '-' || {_slug('url')} || '-mobile.png' AS screenshot_mobile
    FROM ({C.CANONICAL})
"""
SQL["w5_page_sequence"] = f"SELECT site, url, page_no, screenshot, screenshot_mobile FROM ({SEQUENCE})"


def content_paths(source: str) -> str:
    """site, url, content_path of a page list (site, url)."""
    return f"""
    SELECT site, url,
           CASE WHEN inner_ = '' THEN '_audit/content/_index.md'
                WHEN q = '' AND EXISTS (SELECT 1 FROM folders f WHERE f.site = p.site AND f.inner_ = p.inner_) THEN '_audit/content/' || inner_ || '/_index.md'
                ELSE '_audit/content/' || inner_ || CASE WHEN q = '' THEN '' ELSE '__q-' || left(sha1(q), 10) END || '.md' END AS content_path
    FROM parts p
    """.replace("parts p", f"(SELECT site, url, trim({C.path()}, '/') AS inner_, {C.query()} AS q FROM {source}) p")


def folders(source: str) -> str:
    return f"""
    SELECT DISTINCT site, unnest(list_transform(range(1, len(s)), lambda i: array_to_string(s[1:i], '/'))) AS inner_
    FROM (SELECT site, string_split(trim({C.path()}, '/'), '/') AS s FROM {source})
    """


SQL["p5_j5_content_paths"] = f"""
WITH src AS ({C.CANONICAL}), folders AS ({folders('src')}), placed AS ({content_paths('src')})
SELECT site, url, content_path, count(*) OVER (PARTITION BY site, content_path) > 1 AS is_collision FROM placed
"""

# A word boundary next to an accented letter: the engine's is ASCII only, so such letters are
# fenced with "_" while the number rules run.
_ACCENTED = r"[\x{00AA}\x{00B5}\x{00BA}\x{00C0}-\x{00D6}\x{00D8}-\x{00F6}\x{00F8}-\x{024F}]"
_EMAIL = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
_PHONE = r"01[0-9]-?[0-9]{3,4}-?[0-9]{4}"
_RESIDENT = r"\b\d{6}-?[1-4]\d{6}\b"
_CARD = r"\b(?:\d[ -]?){13,19}\b"
_SECRET = r'(?i)("?(?:api[_-]?key|access[_-]?token|refresh[_-]?token|client[_-]?secret|authorization)"?\s*[:=]\s*)"[^"]+"'
_BEARER = r"(?i)\bBearer\s+[A-Za-z0-9._\-+/=]+\b"
MASKED = rf"""
    SELECT *, regexp_replace(t5, '{_BEARER}', 'Bearer ***REDACTED***', 'g') AS masked FROM (
    SELECT *, regexp_replace(t4, '{_SECRET}', '\1"***REDACTED***"', 'g') AS t5 FROM (
    SELECT *, regexp_replace(regexp_replace(t3, '{_CARD}', '****-****-****-****', 'g'), '_({_ACCENTED})_', '\1', 'g') AS t4 FROM (
    SELECT *, regexp_replace(t2, '{_RESIDENT}', '******-*******', 'g') AS t3 FROM (
    SELECT *, regexp_replace(regexp_replace(t1, '{_PHONE}', '***-****-****', 'g'), '({_ACCENTED})', '_\1_', 'g') AS t2 FROM (
    SELECT doc_id, text, regexp_replace(text, '{_EMAIL}', '***@***.***', 'g') AS t1 FROM documents)))))
"""


def mask(x: str) -> str:
    """The masked text of one expression."""
    x = rf"regexp_replace(regexp_replace({x}, '{_EMAIL}', '***@***.***', 'g'), '{_PHONE}', '***-****-****', 'g')"
    x = rf"regexp_replace(regexp_replace({x}, '({_ACCENTED})', '_\1_', 'g'), '{_RESIDENT}', '******-*******', 'g')"
    x = rf"regexp_replace(regexp_replace({x}, '{_CARD}', '****-****-****-****', 'g'), '_({_ACCENTED})_', '\1', 'g')"
    x = rf'''regexp_replace({x}, '{_SECRET}', '\1"***REDACTED***"', 'g')'''
    return rf"regexp_replace({x}, '{_BEARER}', 'Bearer ***REDACTED***', 'g')"


def _hits(column: str, pattern: str) -> str:
    return f"CAST(len(regexp_extract_all({column}, '{pattern}')) AS BIGINT)"


SQL["t1_p6_mask_text"] = f"""
SELECT doc_id, masked, {_hits('text', _EMAIL)} AS email_hits, {_hits('t1', _PHONE)} AS phone_hits,
       {_hits('t2', _RESIDENT)} AS resident_hits, {_hits('t3', _CARD)} AS card_hits,
       {_hits('t4', _SECRET)} AS secret_hits, {_hits('t5', _BEARER)} AS bearer_hits
FROM ({MASKED})
"""
SQL["p10_preview"] = f"""
SELECT doc_id, CASE WHEN length(masked) > 2000 THEN left(masked, 2000) || '... (truncated)' ELSE masked END AS preview FROM ({MASKED})
"""
_MINUTES = "greatest(1, CAST(ceil(words / 200.0) AS BIGINT)) AS minutes"
SQL["t2_p9_document_stats"] = f"SELECT doc_id, words, {_MINUTES} FROM (SELECT doc_id, {C.words('text')} AS words FROM documents)"
SQL["t2_conversation_stats"] = (
    f"SELECT conv_id, turn, words, {_MINUTES} FROM (SELECT conv_id, turn, {C.words('text')} AS words FROM conversations)"
)
_HEX = "printf('#%02X%02X%02X', l_linenumber * 30, l_partkey % 5 * 50, 0)"
SQL["p8_hex_colors"] = f"SELECT {_HEX} AS hex, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS cnt FROM lineitem GROUP BY 1"
SQL["w1_first_seen_links"] = f"""
SELECT site, href, page_id, link_ord FROM ({C.PLAIN_LINKS})
QUALIFY row_number() OVER (PARTITION BY site, href ORDER BY page_id, link_ord) = 1
"""
SQL["src1_read_snapshots"] = f"""
SELECT {C.host()} AS site, page_id AS page_ord, url, regexp_extract(html, '<title>([^<]*)', 1) AS title FROM pages
"""
SQL["src2_crawl_urls"] = f"""
WITH listed AS (SELECT {C.host()} AS site, url, min(page_id) AS ord FROM pages GROUP BY 1, 2)
SELECT site, url, ord FROM listed
UNION ALL SELECT 'new.' || site, origin, 0 FROM ({C.SITES})
"""


def _first(h: str, tag: str) -> str:
    return C.text(rf"regexp_extract({h}, '(?is)<{tag}\b[^>]*>(.*?)</{tag}\s*>', 1)")


SQL["h1_page_meta"] = rf"""
SELECT page_id, {_first('h', 'title')} AS title, regexp_extract(h, '<html lang="([^"]*)"', 1) AS lang,
       CASE WHEN page_id % 3 <> 0 THEN 'Desc ' || page_id || ' & more' ELSE '' END AS description,
       CASE WHEN page_id % 4 <> 0 THEN {C.origin()} || '/c/' || page_id ELSE '' END AS canonical,
       array_to_string(list_transform(regexp_extract_all(h, '(?is)<h1\b[^>]*>(.*?)</h1>', 1), lambda x: {C.text('x')}), '|') AS h1,
       'Sec ' || page_id AS h2
FROM (SELECT page_id, url, {C.visible()} AS h FROM pages)
"""
SQL["h2_links"] = f"SELECT site, page_id, link_ord, href, text, parent FROM ({C.PLAIN_LINKS})"
SQL["h2_links_rich"] = f"""
SELECT page_id, scope, link_ord, href, text, parent, true AS in_nav FROM ({C.RICH_LINKS}), (VALUES ('page'), ('nav')) v(scope)
"""
SQL["h3_nav_links"] = f"SELECT site, page_id, link_ord, href, text FROM ({C.PLAIN_LINKS})"
ASSETS = f"""
    SELECT {C.host()} AS site, page_id, kind, CAST(ord AS BIGINT) AS ord,
           CASE WHEN kind = 'style' THEN {C.origin()} || '/css/s' || page_id % 3 || '.css'
                WHEN ord = 0 THEN {C.origin()} || '/js/app' || page_id % 7 || '.js'
                ELSE 'https://cdn.example.net/jquery-3.' || page_id % 10 || '.0.min.js' END AS src
    FROM pages, (VALUES ('script', 0), ('script', 1), ('style', 0)) v(kind, ord)
"""
SQL["h4_assets"] = ASSETS
SITE_ASSETS = f"SELECT site, kind, src, min(page_id) AS first_page, count(*) AS pages FROM ({ASSETS}) GROUP BY ALL"
SQL["u3_site_assets"] = SITE_ASSETS
_FIELDS = f"""
    SELECT page_id, {C.host()} AS site, CAST(0 AS BIGINT) AS form_ord, {C.origin()} || '/send' AS action, 'POST' AS method,
           CAST(k AS BIGINT) AS field_ord, CASE WHEN k = 1 THEN 'q' || page_id % 2 ELSE name END AS name, type, k = 0 AS required,
           CASE WHEN k = 0 THEN 'you' ELSE '' END AS placeholder, k = 0 AS labelled
    FROM pages, (VALUES (0, 'email', 'email'), (1, 'q', 'text'), (2, 'topic', 'select-one'), (3, 'msg', 'textarea')) v(k, name, type)
"""
SQL["h5_form_fields"] = _FIELDS
SQL["a16_field_inventory"] = f"""
SELECT site, type, count(*) AS fields, count(*) FILTER (required) AS required, count(*) FILTER (labelled) AS labelled,
       count(DISTINCT page_id) AS pages FROM ({_FIELDS}) GROUP BY site, type
"""
SQL["h6_images"] = f"""
SELECT {C.host()} AS site, page_id, CAST(0 AS BIGINT) AS ord, {C.origin()} || '/i/' || page_id % 8 || '.png' AS src,
       'Alt ' || page_id AS alt, CAST(10 AS BIGINT) AS width, CAST(20 AS BIGINT) AS height, NULL AS loading FROM pages
UNION ALL
SELECT {C.host()}, page_id, 2, {C.origin()} || '/j/' || page_id || '.png', NULL, NULL, NULL, 'lazy' FROM pages WHERE page_id % 2 = 0
"""
_BODY = rf"{C.inner_text(rf'''regexp_extract({C.visible()}, '(?is)<article\b[^>]*>(.*?)</article\s*>', 1)''')}"
SQL["h7_content"] = f"""
SELECT page_id, site, body_text, {C.words('body_text')} AS word_count FROM (SELECT page_id, {C.host()} AS site, {_BODY} AS body_text FROM pages)
"""
SQL["h7_sections"] = f"""
SELECT page_id, {C.words(_BODY)} + 5 AS word_count, CAST(0 AS BIGINT) AS ord, 's' || page_id AS id, 'Sec ' || page_id AS heading,
       'Sec ' || page_id || chr(10) || 'Text of ' || page_id AS text, CAST(CASE WHEN page_id % 2 = 0 THEN 3 ELSE 2 END AS BIGINT) AS images
FROM pages
"""
_BLOCKS_N = "CAST((page_id % 6 <> 0)::INT + (page_id % 10 = 3)::INT AS BIGINT)"
_OG_TITLE = "CASE WHEN page_id % 2 = 0 THEN 'Second ' ELSE 'OG ' END || page_id"
SQL["h8_structured"] = f"""
SELECT page_id, {_BLOCKS_N} AS blocks,
       CASE WHEN page_id % 5 <> 0 THEN 'og:image=/img/' || page_id || '.png|' ELSE '' END || 'og:title=' || {_OG_TITLE} AS og
FROM pages
"""
TYPES = "CASE WHEN page_id % 6 <> 0 THEN ['Article'] ELSE [] END || CASE WHEN page_id % 10 = 3 THEN ['A', 'B', 'Unknown'] ELSE [] END"
SQL["p11_structured_types"] = f"""
SELECT page_id, CAST(generate_subscripts(t, 1) - 1 AS BIGINT) AS ord, unnest(t) AS type FROM (SELECT page_id, {TYPES} AS t FROM pages)
"""
SQL["h9_declared_styles"] = f"""
SELECT {C.host()} AS site, 'color' AS kind, 'rgb(1, 2, ' || page_id % 5 || ')' AS value, NULL AS family, NULL AS size, NULL AS weight, NULL AS tag, count(*) AS cnt
FROM pages GROUP BY ALL
UNION ALL
SELECT {C.host()}, 'font', NULL, 'F' || page_id % 3, '12px', page_id % 4 || '00', '.A', count(*) FROM pages GROUP BY ALL
"""
DECLARED_PALETTE = f"""
    SELECT site, CAST(rank AS BIGINT) AS rank, ['Primary', 'Secondary', 'Accent', 'Surface', 'Muted'][rank] AS role, value, hex, cnt FROM (
    SELECT {C.host()} AS site, 'rgb(1, 2, ' || page_id % 5 || ')' AS value, '#01020' || page_id % 5 AS hex, count(*) AS cnt,
           row_number() OVER (PARTITION BY {C.host()} ORDER BY count(*) DESC, min(page_id)) AS rank
    FROM pages GROUP BY 1, 2, 3)
"""
SQL["h9_a1_declared_palette"] = DECLARED_PALETTE
# Elements by their opening tags; html, head and body are always there. Text and border colour count for each.
COMPUTED_COLORS = f"""
    WITH tags AS (
      SELECT {C.host()} AS site, page_id, regexp_extract_all(regexp_replace(h, '(?is)^.*?<body[^>]*>', ''), '(?i)<([a-z][a-z0-9]*)', 1) AS inner_tags,
             regexp_extract_all(regexp_extract(h, '(?is)^.*?<body'), '(?i)<(meta|title|link|style|script|base)\\b', 1) AS head_tags
      FROM (SELECT page_id, url, regexp_replace(regexp_replace(replace(html, '</head>', '<style></style></head>'), '(?s)<!--.*?-->', '', 'g'),
                   '(?is)<(script|style)\\b[^>]*>.*?</(script|style)\\s*>', '<\\1>', 'g') AS h FROM pages)),
    counts AS (SELECT site, page_id, len(list_filter(inner_tags, lambda t: lower(t) = 'a')) AS links, len(inner_tags) + 1 AS body_count, len(head_tags) + 2 AS head_count FROM tags),
    values_ AS (
      SELECT site, page_id, 'rgb(0, 0, 0)' AS value, 2 * head_count AS cnt, 0 AS place FROM counts
      UNION ALL SELECT site, page_id, 'rgb(1, 2, ' || page_id % 5 || ')', 2 * (body_count - links), 1 FROM counts
      UNION ALL SELECT site, page_id, CASE page_id % 4 WHEN 0 THEN 'rgb(200, 0, 0)' WHEN 1 THEN 'rgb(0, 200, 0)' WHEN 2 THEN 'rgb(1, 2, ' || page_id % 5 || ')' ELSE 'rgb(0, 0, 238)' END,
             2 * links, 2 FROM counts
      UNION ALL SELECT site, page_id, 'rgb(9, 9, 9)', 1, 3 FROM counts WHERE page_id % 3 <> 0)
    SELECT site, page_id, value, CAST(sum(cnt) AS BIGINT) AS cnt, min(place) AS place FROM values_ WHERE cnt > 0 GROUP BY site, page_id, value
"""
SQL["h9_computed_colors"] = f"SELECT site, page_id, value, cnt FROM ({COMPUTED_COLORS})"
_CHANNEL = "CAST(trim(split_part(substr(value, 5), ',', {}), ' )') AS INT)"
SQL["h9_a1_computed_palette"] = f"""
SELECT site, CAST(rank AS BIGINT) AS rank, coalesce(['Primary', 'Secondary', 'Accent', 'Surface', 'Muted'][rank], 'Color ' || rank) AS role, value,
       printf('#%02X%02X%02X', {', '.join(_CHANNEL.format(i) for i in (1, 2, 3))}) AS hex, cnt
FROM (SELECT site, value, CAST(sum(cnt) AS BIGINT) AS cnt, row_number() OVER (PARTITION BY site ORDER BY sum(cnt) DESC, min(row(page_id, page_rank))) AS rank
      FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY cnt DESC, place) AS page_rank FROM ({COMPUTED_COLORS})) GROUP BY site, value)
WHERE rank <= 12
"""
SQL["h10_feed_hints"] = f"""
SELECT {C.host()} AS site, page_id, CAST(ord AS BIGINT) AS ord, {C.origin()} || CASE WHEN page_id % 4 = 0 THEN '/feed-' || page_id % 9 || '.xml' ELSE p END AS feed_url
FROM pages, (VALUES (0, '/feed'), (1, '/rss'), (2, '/atom.xml')) v(ord, p) WHERE ord = 0 OR page_id % 4 <> 0
"""


def _seo(description: str, og_title: str, og_image: str, canonical: str) -> str:
    flags = f"""
    SELECT page_id, {C.host()} AS site, title = '' AS title_missing, {description} AS description_missing, h1 = '' AS h1_missing,
           h1 <> '' AND h1 <> title AS h1_differs, {og_title} AS og_title_missing, {og_image} AS og_image_missing,
           true AS og_description_missing, {canonical} AS canonical_missing
    FROM (SELECT page_id, url, {_first('h', 'title')} AS title, {_first('h', 'h1')} AS h1 FROM (SELECT page_id, url, {C.visible()} AS h FROM pages))
    """
    names = "title_missing description_missing h1_missing h1_differs og_title_missing og_image_missing og_description_missing canonical_missing".split()
    return f"SELECT *, CAST({' + '.join(f'{n}::INT' for n in names)} AS BIGINT) AS issues FROM ({flags})"


SQL["a12_seo_audit"] = _seo("page_id % 3 = 0", "false", "page_id % 5 = 0", "page_id % 4 = 0")
_ALL_SEO = "title_missing description_missing h1_missing h1_differs og_title_missing og_image_missing og_description_missing canonical_missing".split()
SQL["a12_seo_rollup"] = f"""
SELECT site, count(*) AS pages, count(*) FILTER (issues = 0) AS clean_pages, {', '.join(f'count(*) FILTER ({n}) AS {n}' for n in _ALL_SEO)}
FROM ({_seo('true', 'true', 'true', 'true')}) GROUP BY site
"""


def _has(tag: str) -> str:
    return rf"regexp_matches({C.visible()}, '(?i)<{tag}\b')"


_SEMANTIC = ("header", "nav", "main", "footer")
SQL["a13_markup_checks"] = f"""
SELECT page_id, {C.host()} AS site, {', '.join(f'{_has(t)} AS has_{t}' for t in _SEMANTIC)},
       CAST(CASE WHEN page_id % 2 = 0 THEN 3 ELSE 2 END AS BIGINT) AS images, CAST(1 AS BIGINT) AS images_with_alt, 'partial' AS alt_state,
       true AS has_form, true AS has_label FROM pages
"""
SQL["a13_markup_rollup"] = f"""
SELECT {C.host()} AS site, count(*) AS pages, {', '.join(f'count(*) FILTER ({_has(t)}) AS {t}_pages' for t in _SEMANTIC)},
       CAST(0 AS BIGINT) AS images, CAST(0 AS BIGINT) AS images_with_alt, CAST(0 AS BIGINT) AS unlabelled_form_pages FROM pages GROUP BY 1
"""
# --- mirror and export -------------------------------------------------------------------------
SQL["snk2_p12_content_mirror"] = f"""
WITH src AS ({C.CANONICAL}), folders AS ({folders('src')}), placed AS ({content_paths('src')}),
     facts AS (SELECT page_id, {mask(_first(C.visible(), 'title'))} AS title, regexp_extract(html, '<html lang="([^"]*)"', 1) AS lang,
                      {C.origin()} AS o, url AS raw_url, {C.words(_BODY)} + 5 AS wc, {TYPES} AS types FROM pages)
SELECT p.site, p.url, p.content_path,
  '---' || chr(10) || 'url: "' || p.url || '"' || chr(10) || 'title: ' || to_json(title)::VARCHAR || chr(10) || 'depth: 0' || chr(10) || 'status: 200' || chr(10)
  || 'canonical: "' || CASE WHEN page_id % 4 <> 0 THEN o || '/c/' || page_id ELSE p.url END || '"' || chr(10) || 'lang: "' || lang || '"' || chr(10)
  || 'og: {{"og:title": "' || {_OG_TITLE} || '"' || CASE WHEN page_id % 5 <> 0 THEN ', "og:image": "/img/' || page_id || '.png"' ELSE '' END || '}}' || chr(10)
  || 'structured_data: [' || array_to_string(list_transform(types, lambda t: '"' || t || '"'), ', ') || ']' || chr(10)
  || 'screenshot: "' || screenshot || '"' || chr(10) || 'screenshot_mobile: "' || screenshot_mobile || '"' || chr(10)
  || 'crawled_at: "2024-01-01T00:00:00"' || chr(10) || 'word_count: ' || wc || chr(10) || 'reading_time: ' || greatest(1, CAST(ceil(wc / 200.0) AS BIGINT)) || chr(10) || '---' || chr(10) || chr(10)
  || '# ' || title || chr(10) || chr(10) || '## Sec ' || page_id || chr(10) || 'Sec ' || page_id || chr(10) || 'Text of ' || page_id || chr(10) || chr(10)
  || '## 이미지' || chr(10) || '| src | alt | width | height |' || chr(10) || '|-----|-----|-------|--------|' || chr(10)
  || '| ' || o || '/i/' || page_id % 8 || '.png | Alt ' || page_id || ' | 10 | 20 |'
  || CASE WHEN page_id % 2 = 0 THEN chr(10) || '| ' || o || '/j/' || page_id || '.png |  |  |  |' ELSE '' END || chr(10) AS markdown
FROM placed p JOIN ({SEQUENCE}) s USING (site, url) JOIN facts f ON f.page_id = s.page_ord
"""
SQL["snk3_flat_export"] = f"""
WITH links AS ({C.RICH_LINKS})
SELECT {C.host()} AS site, 'page' AS part, CAST(page_id AS VARCHAR) AS place, url || ' ' || {_first(C.visible(), 'title')} AS value FROM pages
UNION ALL
SELECT site, 'nav', page_id || '.' || link_ord, href || ' ' || text FROM links QUALIFY row_number() OVER (PARTITION BY site, href ORDER BY page_id, link_ord) = 1
UNION ALL SELECT site, kind, CAST(first_page AS VARCHAR), src FROM ({SITE_ASSETS})
UNION ALL SELECT site, 'color', CAST(rank AS VARCHAR), value FROM ({DECLARED_PALETTE})
UNION ALL SELECT site, 'edge', page_id || '.' || link_ord, {C.norm('page_url')} || ' ' || {C.norm('href')} || ' ' || parent FROM links
"""
# A JSON page of the reference's export has these six fields (cli.py:791-801).
SQL["snk3_flat_export_whole"] = f"""
WITH shown AS (SELECT s.*, {_first(C.visible(), 'title')} AS title FROM ({SEQUENCE}) s JOIN (SELECT page_id, html FROM pages) f ON f.page_id = s.page_ord)
SELECT site, part, CAST(page_ord AS VARCHAR) AS place, value
FROM (SELECT site, page_ord, unnest(['page', 'page_depth', 'page_status', 'page_screenshot', 'page_screenshot_mobile']) AS part,
             unnest([url || ' ' || title, '0', '200', screenshot, screenshot_mobile]) AS value FROM shown)
UNION ALL SELECT site, part, place, value FROM ({SQL['snk3_flat_export']}) WHERE part <> 'page'
"""
SQL["snk3_home_heads"] = f"""
SELECT site, page_id AS page_ord, head FROM (SELECT {C.host()} AS site, page_id, regexp_extract(html, '(?is)<head[^>]*>(.*?)</head>', 1) AS head FROM pages)
QUALIFY row_number() OVER (PARTITION BY site ORDER BY page_id) = 1
"""
NAVIGATION = f"""
    SELECT site, rank, text, href, pages, first_page FROM (
    SELECT site, text, href, count(*) AS pages, min(page_id) AS first_page,
           row_number() OVER (PARTITION BY site ORDER BY count(*) DESC, min(page_id), arg_min(link_ord, page_id), href) AS rank
    FROM ({C.PLAIN_LINKS}) WHERE text <> '' AND href <> '' GROUP BY site, text, href) WHERE rank <= 12
"""
SQL["a3_main_navigation"] = NAVIGATION
SQL["snk1_write_derived"] = NAVIGATION
SQL["g0_link_graph"] = f"""
SELECT site, {C.norm('page_url')} AS src, {C.norm('href')} AS dst, parent, page_id, link_ord FROM ({C.PLAIN_LINKS})
"""
SQL["g4_navigation_journey"] = f"""
SELECT site, CAST(least(greatest(count(*), 1), 3) AS BIGINT) AS steps, CASE WHEN count(*) >= 3 THEN 'good' ELSE 'fair' END AS grade
FROM ({NAVIGATION}) GROUP BY site
"""
SQL["a5_component_counts"] = f"""
SELECT site, count(*) AS pages, count(*) AS form_pages, count(*) AS nav_pages, any_value(samples) AS samples
FROM (SELECT {C.host()} AS site FROM pages)
JOIN (SELECT site, string_agg(screenshot, ';' ORDER BY page_no) AS samples FROM ({SEQUENCE}) WHERE page_no <= 4 GROUP BY site) USING (site)
GROUP BY site
"""
