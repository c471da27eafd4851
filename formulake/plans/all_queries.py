"""Imports every module that registers queries."""

from . import embedding_queries, expr_queries, index_queries, more_queries, parity_queries, relational_queries, text_queries  # noqa: F401
