"""op9: the quality rules over all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lineloom.llm.quality_rules import apply_rules
from lineloom.llm.rows import table


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op9_quality_rules": op9_quality_rules}
#: The learned list has no SQL; the counts are tested against brute force.
ORACLE_SQL: dict[str, str] = {}
