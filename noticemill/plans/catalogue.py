"""All registered queries and their equivalent SQL."""

from . import audit_queries, merge_queries, record_queries, scan_queries, text_queries

_MODULES = (record_queries, merge_queries, text_queries, audit_queries, scan_queries)
QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLE = {name: sql for module in _MODULES for name, sql in module.ORACLE.items()}
