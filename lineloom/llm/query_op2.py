"""op2: benchmark items within all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lineloom.llm.decontaminate import contaminated
from lineloom.llm.rows import table


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op2_decontamination": op2_decontamination}
#: Canonical windows and slots have no SQL; tested against brute force.
ORACLE_SQL: dict[str, str] = {}
