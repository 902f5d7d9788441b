"""op8: the toxicity of every document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lineloom.llm.rows import table
from lineloom.llm.toxicity import score_toxicity


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op8_toxicity": op8_toxicity}
#: A trained model has no SQL; tested by held-out accuracy.
ORACLE_SQL: dict[str, str] = {}
