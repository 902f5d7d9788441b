"""op3: the language of every document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lineloom.llm.language_id import identify
from lineloom.llm.rows import table


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


QUERIES = {"op3_language_id": op3_language_id}
#: A trained model has no SQL; tested against a plain Kneser-Ney model and by held-out accuracy.
ORACLE_SQL: dict[str, str] = {}
