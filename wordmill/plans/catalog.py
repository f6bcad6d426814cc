"""Imports every module that registers queries."""

from . import join_queries, rule_queries, sequence_queries, source_queries, stat_queries, text_queries, window_queries  # noqa: F401
