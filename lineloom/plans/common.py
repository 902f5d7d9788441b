"""Tables and small inline catalogs of the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lineloom.operators.recognition import Format


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Rows dealt out by a key with few rows of each value: a file of small rows has few splits, and all the work on them would stay in as many tasks."""
    return df.repartition(key)


def formats(*texts: str) -> list[Format]:
    return [Format(i, t) for i, t in enumerate(texts)]


#: DuckDB: a token list of a column.
def duck_tokens(c: str) -> str:
    return f"regexp_extract_all({c}, '[^ \\t\\n\\r]+')"
