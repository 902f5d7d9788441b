"""op7: repeated 200-byte strings taken out of all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lineloom.llm.rows import table
from lineloom.llm.suffix_dedup import remove_repeats


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).drop("spans")


QUERIES = {"op7_suffix_dedup": op7_suffix_dedup}
#: Tested against brute force over all 200-byte strings; DuckDB has no bytes of a text by offset that would serve.
ORACLE_SQL: dict[str, str] = {}
