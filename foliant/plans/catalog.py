"""All queries of the core by name, with the SQL each is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from foliant.plans import data_plans, field_plans, late_plans, score_plans, text_plans

MODULES = (text_plans, data_plans, field_plans, late_plans, score_plans)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: f for m in MODULES for name, f in m.QUERIES.items()}
ORACLES: dict[str, str] = {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
FLAGSHIP = "coarse_recall"
