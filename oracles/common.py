"""SQL text shared by the counterpart queries (DuckDB dialect)."""

from __future__ import annotations

from crawlscope.sources import adapters as A

ORIGIN = "regexp_extract({u}, '^([a-z]+://[^/?#]*)', 1)"
HOST = "regexp_extract({u}, '^[a-z]+://([^/?#]*)', 1)"
PATH = "regexp_extract({u}, '^[a-z]+://[^/?#]*([^?#]*)', 1)"
QUERY = "regexp_extract({u}, '^[^?#]*[?]([^#]*)', 1)"

_TRACKING = (
    "['utm_source','utm_medium','utm_campaign','utm_term','utm_content','fbclid','gclid','ref','source','mc_cid','mc_eid','_ga']"
)
_HIDDEN = r"(?is)<!--.*?-->|<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>"
_BLOCKS = (
    r"(?i)</?(?:address|article|aside|blockquote|br|dd|div|dl|dt|fieldset|figure|footer|form"
    r"|h[1-6]|header|hr|li|main|nav|ol|p|pre|section|table|tbody|td|th|thead|tr|ul)\b[^>]*>"
)


def host(u: str = "url") -> str:
    return HOST.format(u=u)


def origin(u: str = "url") -> str:
    return ORIGIN.format(u=u)


def path(u: str = "url") -> str:
    return PATH.format(u=u)


def query(u: str = "url") -> str:
    return QUERY.format(u=u)


def norm(u: str = "url") -> str:
    """Canonical URL for queries of plain keys and values."""
    kept = (
        f"array_to_string(list_sort(list_filter(string_split({query(u)}, '&'), "
        f"lambda p: p <> '' AND NOT list_contains({_TRACKING}, split_part(p, '=', 1)))), '&')"
    )
    return (
        f"({origin(u)} || coalesce(nullif(rtrim({path(u)}, '/'), ''), '/') || "
        f"CASE WHEN {kept} = '' THEN '' ELSE '?' || {kept} END)"
    )


def visible(h: str = "html") -> str:
    return f"regexp_replace({h}, '{_HIDDEN}', '', 'g')"


def entities(x: str) -> str:
    for entity, char in [
        ("&lt;", "'<'"), ("&gt;", "'>'"), ("&quot;", "'\"'"), ("&#39;", "''''"), ("&apos;", "''''"),
        ("&nbsp;", "chr(160)"), ("&copy;", "'©'"), ("&middot;", "'·'"), ("&amp;", "'&'"),
    ]:
        x = f"replace({x}, '{entity}', {char})"
    return x


def text(x: str) -> str:
    inner = entities(f"regexp_replace({x}, '<[^>]*>', '', 'g')")
    return rf"trim(regexp_replace({inner}, '[\s\x{{00A0}}]+', ' ', 'g'))"


def inner_text(x: str) -> str:
    lined = rf"regexp_replace(regexp_replace({x}, '\s+', ' ', 'g'), '{_BLOCKS}', chr(10), 'g')"
    bare = entities(f"regexp_replace({lined}, '<[^>]*>', '', 'g')")
    return rf"trim(regexp_replace({bare}, ' ?\n[ \n]*', chr(10), 'g'), ' ' || chr(10))"


def words(x: str) -> str:
    return rf"CAST(len(regexp_extract_all({x}, '\S+')) AS BIGINT)"


def percent(x: str) -> str:
    return (
        rf"array_to_string(list_transform(string_split({x}, ''), lambda c: CASE WHEN regexp_matches(c, '[^\x21-\x7E]') "
        r"THEN url_encode(c) ELSE c END), '')"
    )


def dom_href(h: str, u: str = "url") -> str:
    """Absolute address for targets that are absolute, start with a slash or are plain relative."""
    folder = f"regexp_replace({path(u)}, '[^/]*$', '')"
    return (
        f"CASE WHEN {h} LIKE 'http%' THEN {h} WHEN {h} LIKE '/%' THEN {origin(u)} || {percent(h)} "
        f"ELSE {origin(u)} || {folder} || {percent(h)} END"
    )


def adapter(columns: dict[str, str], source: str) -> str:
    return "SELECT " + ", ".join(f"{e} AS {n}" for n, e in columns.items()) + f" FROM {source}"


# Distinct canonical pages: site, url, page_ord, raw_url, rn.
CANONICAL = f"""
    SELECT {host('nu')} AS site, nu AS url, min(page_id) AS page_ord, arg_min(url, page_id) AS raw_url,
           row_number() OVER (PARTITION BY {host('nu')} ORDER BY min(page_id)) AS rn
    FROM (SELECT page_id, url, {norm()} AS nu FROM pages) GROUP BY nu
"""
SITES = f"SELECT {host()} AS site, arg_min({origin()}, page_id) AS origin FROM pages GROUP BY 1"
RICH = f"SELECT page_id, url, {A.RICH_HTML} AS html FROM pages"
# All anchors of the pages: page_id, url, link_ord, raw, text.
ANCHORS = rf"""
    SELECT page_id, url, CAST(i AS BIGINT) AS link_ord, regexp_extract(tok, '(?i)href="([^"]*)"', 1) AS raw, {text('tok')} AS text
    FROM (SELECT page_id, url, unnest(toks) AS tok, generate_subscripts(toks, 1) - 1 AS i
          FROM (SELECT page_id, url, regexp_extract_all({visible()}, '(?is)<a\b[^>]*>.*?</a>') AS toks FROM pages))
"""
PLAIN_LINKS = f"""
    SELECT {host()} AS site, page_id, url AS page_url, link_ord, {dom_href(entities('raw'))} AS href, text, 'NAV' AS parent
    FROM ({ANCHORS})
    QUALIFY row_number() OVER (PARTITION BY page_id, href ORDER BY link_ord) = 1
"""
# The richer pages have two more anchors behind the article, in an aside with the navigation role.
RICH_LINKS = f"""
    SELECT {host()} AS site, page_id, url AS page_url, link_ord, {dom_href(entities('raw'))} AS href, text, parent
    FROM (
        SELECT page_id, url, link_ord, raw, text, 'NAV' AS parent FROM ({ANCHORS})
        UNION ALL
        SELECT p.page_id, p.url, coalesce(n, 0) + k, CASE k WHEN 0 THEN 'aside/' || p.page_id || '?utm_source=x&b=2&a=1' ELSE 'https://other.example/' || p.page_id END,
               CASE k WHEN 0 THEN 'aside ' || p.page_id ELSE 'out' END, 'ASIDE'
        FROM pages p LEFT JOIN (SELECT page_id, count(*) AS n FROM ({ANCHORS}) GROUP BY page_id) c USING (page_id), (VALUES (0), (1)) v(k)
    )
    QUALIFY row_number() OVER (PARTITION BY page_id, href ORDER BY link_ord) = 1
"""
FETCH = adapter(A.FETCH_LOG, "events")
STYLE = adapter(A.STYLE_OBS, "lineitem")
