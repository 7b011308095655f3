"""All registered queries of the frame and capture operators."""

from __future__ import annotations

from lumastack.plans import alignment_queries, capture_queries, frame_queries, log_queries

QUERIES = {**capture_queries.QUERIES, **frame_queries.QUERIES, **alignment_queries.QUERIES, **log_queries.QUERIES}
ORACLE_SQL = {**capture_queries.ORACLE_SQL, **frame_queries.ORACLE_SQL, **alignment_queries.ORACLE_SQL, **log_queries.ORACLE_SQL}
