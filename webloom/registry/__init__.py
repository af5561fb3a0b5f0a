"""Registered queries and the SQL they are compared with."""

from __future__ import annotations

from webloom.registry import crawls, pages, reports

MODULES = [pages, reports, crawls]


def all_queries():
    return {name: fn for m in MODULES for name, fn in m.QUERIES.items()}


def all_sql():
    return {name: text for m in MODULES for name, text in m.SQL.items()}
