"""op10: near-duplicates among all documents, by sets of four words."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lineloom.llm.near_dedup import near_duplicates
from lineloom.llm.rows import table

WIDTH = 4


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=WIDTH)


QUERIES = {"op10_near_dedup": op10_near_dedup}
#: Components of all similar pairs: SQL would take all pairs; tested against brute force.
ORACLE_SQL: dict[str, str] = {}
