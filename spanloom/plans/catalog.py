"""All queries of the library, by name."""

from . import corpus_queries, document_queries, judge_queries, mining_queries, repair_queries, selection_queries, source_queries, span_queries, stream_queries, text_queries, verify_queries  # noqa: F401
from .registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
