"""Registered queries and their SQL."""

from . import catalogue, intake, lexemes, names, rulesets, scores, streams, texts
from .registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES", "catalogue", "intake", "lexemes", "names", "rulesets", "scores", "streams", "texts"]
