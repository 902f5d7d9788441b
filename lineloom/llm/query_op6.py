"""op6: the secret scan over all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lineloom.llm.rows import table
from lineloom.llm.secret_scan import scan_secrets


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents")).drop("judged")


QUERIES = {"op6_secret_scan": op6_secret_scan}
#: SHA-256 over joined regular-expression spans is tested against brute force.
ORACLE_SQL: dict[str, str] = {}
