"""SQL counterparts of the registered queries, by query name."""

from __future__ import annotations

from oracles import crawl, report, tech, web

ORACLES: dict[str, str] = {**web.SQL, **crawl.SQL, **tech.SQL, **report.SQL}
