"""All queries of the engine by name, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tesselar.plans import facts, ingestion, people, rules, surface, texts, times

PARTS = [surface.R, rules.R, ingestion.R, facts.R, people.R, texts.R, times.R]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for r in PARTS for k, f in r.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for r in PARTS for k, s in r.sql.items()}
