"""Queries by name, each a DataFrame plan and the SQL that must give the same rows.

The SQL is put together from views: a statement names the views it needs, and gets
these and what they need, in order of registration.  Floating results are rounded late, by floor, so that
the order of additions cannot show.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
VIEWS: dict[str, str] = {}


def r(x: str, digits: int = 2) -> str:
    """SQL of half_up."""
    return f"(sign({x}) * floor(abs({x}) * {10**digits}.0::DOUBLE + 0.500001) / {10**digits}.0::DOUBLE)"


def cl(x: str) -> str:
    """SQL of clamp."""
    return f"(CASE WHEN ({x}) IS NOT NULL THEN least(100.0::DOUBLE, greatest(0.0::DOUBLE, {x})) END)"


def view(name: str, sql: str) -> None:
    assert name.startswith("v_") and name not in VIEWS
    VIEWS[name] = sql


def with_views(select: str) -> str:
    """select, preceded by all views that it rests on."""
    needed, open_ = set(), [select]
    while open_:
        for name in re.findall(r"\bv_\w+", open_.pop()):
            if name not in needed:
                needed.add(name)
                open_.append(VIEWS[name])
    chain = ", ".join(f"{name} AS ({sql})" for name, sql in VIEWS.items() if name in needed)
    return f"WITH {chain} {select}" if chain else select


def query(select: str | None):
    """Register a plan under its name; select is its SQL over tables and views, None where SQL cannot express it."""

    def add(f):
        QUERIES[f.__name__] = f
        if select is not None:
            ORACLE[f.__name__] = with_views(select)
        return f

    return add
