"""Queries of the problems on documents. They have no SQL; tests hold them against brute force on small fixtures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.llm.leakage import find_leaks
from netloom.llm.pii import mask, personal_details
from netloom.session import load


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    """Documents and the held-out items whose passages they hold."""
    return find_leaks(load(spark, sf, "documents"), load(spark, sf, "eval_items"))


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    """Different personal details of each document."""
    found = personal_details(load(spark, sf, "documents"), load(spark, sf, "person_names"))
    return found.select("doc_id", F.col("kind").alias("pii_type"), "pii_text").distinct()


def p10_masked(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with placeholders in place of personal details."""
    return mask(load(spark, sf, "documents"), load(spark, sf, "person_names"))


QUERIES = {f.__name__: f for f in (p9_found, p10_found, p10_masked)}
ORACLE: dict[str, str] = {}
