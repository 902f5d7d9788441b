"""op5: all documents packed into sequences of 4096 tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lineloom.llm.packing import pack
from lineloom.llm.rows import table


def tokenizer_path() -> str:
    """The place of the public vocabulary on this machine; the same on every executor."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_path())


QUERIES = {"op5_packing": op5_packing}
#: SQL has no tokenizer; tested by an exact round trip of the ids.
ORACLE_SQL: dict[str, str] = {}
