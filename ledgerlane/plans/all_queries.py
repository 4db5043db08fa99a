"""Importing this module registers every query."""

from . import question_queries, statement_queries, store_queries, text_queries  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
