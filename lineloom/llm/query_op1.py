"""op1: all pages written as WARC archives and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lineloom.llm.rows import table
from lineloom.llm.warc import warc_round_trip


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_round_trip(table(spark, sf_dir, "pages"))


QUERIES = {"op1_warc": op1_warc}
#: SQL has no base32; tested by an exact round trip.
ORACLE_SQL: dict[str, str] = {}
