"""Registered queries and their SQL."""

from . import meta, models, tokens, topics
from .corpus import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES", "meta", "models", "tokens", "topics"]
