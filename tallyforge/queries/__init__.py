"""Registered queries of the library's own operators, with their SQL where SQL can say it."""

from . import ledger, money, people, relations, schedule, sources, streams, text, tracking, windows  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
