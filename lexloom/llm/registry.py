"""The queries of the training-data operators, and the SQL twins of those that have one."""

from __future__ import annotations

from importlib import import_module

MODULES = ("tokenizer", "leakage", "spans", "residue", "consensus", "responses", "reading", "toxicity", "packing")

QUERIES: dict = {}
SQL: dict = {}
for _name in MODULES:
    _module = import_module(f"lexloom.llm.{_name}")
    QUERIES |= _module.QUERIES
    SQL |= getattr(_module, "SQL", {})
