"""Every query by name, with the SQL that gives the same rows."""

from garimpo.plans import frontier_queries, page_queries, report_queries, text_queries, url_queries

_MODULES = (text_queries, url_queries, page_queries, report_queries, frontier_queries)
QUERIES: dict = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLES: dict = {k: v for m in _MODULES for k, v in m.ORACLES.items()}
