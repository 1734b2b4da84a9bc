"""All queries of the analytics DAG, by name, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gondola.plans import checks, collected, core, corpus, facts, pricing, scores, serving, validation  # noqa: F401  each registers its queries
from gondola.plans.core import asof_carry_forward, asof_month, asof_tolerance, competitor_pulls  # noqa: F401
from gondola.plans.corpus import chunk_docs, document_flags  # noqa: F401
from gondola.plans.facts import weekly_price_fact  # noqa: F401
from gondola.plans.registry import ORACLE, QUERIES
from gondola.plans.validation import tier_changes  # noqa: F401
from gondola.sources.tables import retail  # noqa: F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
