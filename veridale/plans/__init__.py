"""Queries on the generated tables, one for each operator."""

from . import log_queries, more_queries, quality_queries, rule_queries, source_queries, template_queries, text_queries
from .registry import QUERIES, SQL
