"""All registered queries of the core and their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from netloom.plans import findings, formats, problems, roundtrips

_MODULES = (problems, findings, roundtrips, formats)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return problems.p6_sessions(spark, sf_dir)


def queries() -> dict:
    return {k: f for m in _MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in _MODULES for k, s in m.ORACLE.items()}
