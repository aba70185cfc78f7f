"""Composed queries over the sample tables, each with its SQL counterpart."""

from . import (  # noqa: F401 - importing registers the queries
    eval_queries, feature_queries, feed_queries, place_queries, prep_queries, stream_queries, text_queries, window_queries,
)
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
