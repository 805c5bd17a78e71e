"""All core queries and their SQL twins, by name."""

from __future__ import annotations

from importlib import import_module

MODULES = ("texts", "relations", "retrieve", "reports", "statistics", "reliable", "events", "extras", "variants")

QUERIES: dict = {}
SQL: dict = {}
for _name in MODULES:
    _module = import_module(f"lexloom.plans.{_name}")
    QUERIES |= _module.QUERIES
    SQL |= _module.SQL
