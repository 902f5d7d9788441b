"""op4: the license scan over all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lineloom.llm.license_scan import scan_licenses
from lineloom.llm.rows import table


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


QUERIES = {"op4_license_scan": op4_license_scan}
#: Labels and score come from the voting, which SQL has no counterpart of; tested against brute force.
ORACLE_SQL: dict[str, str] = {}
