"""Schemas of the input tables. Reading never infers; malformed records become nulls."""

from __future__ import annotations

LINK = "STRUCT<href: STRING, text: STRING, parent: STRING>"
FORM = (
    "STRUCT<action: STRING, method: STRING, fields: ARRAY<STRUCT<name: STRING, type: STRING, "
    "required: BOOLEAN, placeholder: STRING>>>"
)

PAGE_SNAPSHOT = f"""
    site STRING, page_ord BIGINT, url STRING, title STRING, depth INT, status INT, head STRING,
    nav_links ARRAY<{LINK}>, all_links ARRAY<{LINK}>,
    scripts ARRAY<STRING>, styles ARRAY<STRING>,
    colors ARRAY<STRUCT<value: STRING, count: BIGINT>>,
    fonts ARRAY<STRUCT<family: STRING, size: STRING, weight: STRING, tag: STRING, count: BIGINT>>,
    forms ARRAY<{FORM}>,
    meta STRUCT<description: STRING, canonical: STRING, h1: ARRAY<STRING>, h2: ARRAY<STRING>>,
    performance STRUCT<domContentLoaded: BIGINT, loadComplete: BIGINT, transferSize: BIGINT, domInteractive: BIGINT>,
    screenshot STRING, screenshot_mobile STRING
"""
PAGES = "page_id BIGINT, url STRING, html STRING"
ROBOTS = "site STRING, body STRING"
DOCUMENT_STORE = "site STRING, doc_url STRING, status INT, body STRING"
FETCH_LOG = (
    "site STRING, seq BIGINT, page_url STRING, url STRING, type STRING, method STRING, status INT, "
    "size BIGINT, content_type STRING, headers MAP<STRING, STRING>, body STRING, ts TIMESTAMP"
)
STAGE_LOG = (
    "site STRING, stage STRING, status STRING, ts TIMESTAMP, seq BIGINT, notes STRING, artifacts ARRAY<STRING>"
)
LIGHTHOUSE = "site STRING, body STRING"
