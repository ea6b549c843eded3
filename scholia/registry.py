"""All queries of the library and the DuckDB SQL they are compared with."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

#: Modules that define QUERIES (name to callable) and ORACLES (name to SQL).
MODULES: tuple[str, ...] = ("scholia.plans.retrieval", "scholia.plans.corpus", "scholia.plans.curation", "scholia.plans.stores", "scholia.plans.audit", "scholia.plans.answers", "scholia.plans.claims", "scholia.plans.review", "scholia.plans.study", "scholia.plans.writes", "scholia.plans.language", "scholia.plans.gates")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for m in MODULES for k, f in import_module(m).QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in import_module(m).ORACLES.items()}
