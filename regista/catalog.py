"""All registered queries of the register engine and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from regista.plans import analytics, documents, evidence, grading, packets, portfolio, reconcile, runs, sources, state, streams, text  # noqa: F401
from regista.plans.registry import ORACLES, QUERIES


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
