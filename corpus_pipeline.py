"""The corpus pipeline: documents in, packed sequences out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lineloom.llm.decontaminate import contaminated
from lineloom.llm.filtering import blank_spans, hashed, without
from lineloom.llm.language_id import in_known_language
from lineloom.llm.near_dedup import one_of_each
from lineloom.llm.packing import pack
from lineloom.llm.query_op5 import tokenizer_path
from lineloom.llm.secret_scan import scan_secrets
from lineloom.llm.rows import table
from lineloom.storage import materialize_alone
from lineloom.shipping import ship

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


# In every stage rows are judged by their texts: a null doc_id, or one that several texts share, is no way around it.
# Other columns pass as they are, whatever their names; an empty table gives an empty one.


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language; those that language identification rejects go.

    Null texts and texts without a letter are rejected. Equal texts, very long ones too, get one verdict. Ties go to the first language by name,
    and reject nothing.
    """
    ship(spark)
    return in_known_language(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that of the smallest doc_id; null ids come last.

    Null texts and texts without a word are linked with nothing and stay. Of repeated rows one stays. A very long text is compared by its whole set.
    """
    ship(spark)
    return one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item.

    Null and empty texts hold none and stay. Equal texts go together. Whichever of several items a text holds, it goes.
    """
    ship(spark)
    whole, key = hashed(docs)
    by_text = whole.select(F.col(key).alias("doc_id"), "text").filter("text is not null")
    return without(whole, key, contaminated(by_text, table(spark, sf_dir, "benchmark")).select("doc_id")).drop(key)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, live-looking credentials blanked out of the text.

    Null and empty texts stay as they are. Each row counts where owners are counted; equal texts are blanked alike. Spans that overlap are blanked as one.
    """
    ship(spark)
    live = F.filter("judged", lambda x: x["verdict"] == "live")
    whole, key = hashed(docs)
    by_text = whole.select(F.col(key).alias("doc_id"), "text", *(["source"] if "source" in docs.columns else []))
    found = scan_secrets(by_text).select(F.col("doc_id").alias("text_hash"), F.transform(live, lambda x: F.struct(x["start"], x["end"])).alias("spans"))
    return blank_spans(docs, found.filter(F.size("spans") > 0))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a packed sequence. A null text is empty: its document is the closing id alone. Repeated rows are packed each."""
    ship(spark)
    return pack(docs, tokenizer_path())


#: Stages in order; all but the last return the columns of documents.
STAGES: list[tuple[str, Stage]] = [
    ("language_id", language),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("secret_scan", secrets),
    ("packing", packing),
]

#: A trained model and a tokenizer have no SQL: the pipeline is tested against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over all documents, each one's result written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize_alone(lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), f"stage-{name}", zstd=True)
    return STAGES[-1][1](spark, docs, sf_dir)
