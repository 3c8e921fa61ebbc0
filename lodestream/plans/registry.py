"""The registered queries of the listing, deal and operations operators, with their SQL twins."""

from __future__ import annotations

from . import deal_queries, listing_queries, ops_queries, page_queries, pipeline_queries, report_queries, stream_queries, summary_queries

QUERIES: dict = {}
SQL: dict[str, str] = {}
for _m in (ops_queries, listing_queries, deal_queries, page_queries, report_queries, stream_queries, pipeline_queries, summary_queries):
    if _twice := QUERIES.keys() & _m.QUERIES.keys():
        raise ValueError(f"two queries are named {', '.join(sorted(_twice))}")
    QUERIES |= _m.QUERIES
    SQL |= _m.SQL
