"""Queries of the training-data operators, and their SQL where SQL can say it."""

from __future__ import annotations

from importlib import import_module

#: Each module holds QUERIES and ORACLE.
_PARTS = ["q_split", "q_neighbours", "q_names", "q_neardup", "q_conversations", "q_tokens", "q_leaks", "q_subjects"]

QUERIES: dict = {}
ORACLE: dict = {}
for _part in _PARTS:
    _m = import_module(f"tessera.llm.{_part}")
    QUERIES |= _m.QUERIES
    ORACLE |= _m.ORACLE
