"""Imports every module that registers queries."""

from __future__ import annotations

from datalode.plans import assembly_queries, deck_queries, ingestion_queries, llmops_queries, markdown_queries, record_queries, retrieval_queries, schema_queries, stream_queries, text_queries  # noqa: F401
from datalode.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
