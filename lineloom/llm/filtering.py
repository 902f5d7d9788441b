"""How decisions about documents take effect on the table."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineloom.llm.rows import per_batch
from lineloom.storage import materialize

#: Ids, or spans with their texts, are broadcast up to so many in all; beyond, documents are shuffled to them.
BROADCAST_IDS, BROADCAST_SPANS = 2_000_000, 500_000


def text_hash():
    """Column: what stands for a text in decisions that hang on the text alone; a null text has one too."""
    return F.xxhash64(F.lit("text"), F.col("text").cast("string"))


def without(docs: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    """Documents whose value of the column isn't among ids (of one column, long). A null value stays."""
    gone = materialize(ids.toDF("gone_id").distinct(), "gone-ids")
    if gone.count() <= BROADCAST_IDS:
        gone = F.broadcast(gone)
    return docs.join(gone, docs[column] == gone["gone_id"], "left_anti")


def hashed(docs: DataFrame) -> tuple[DataFrame, str]:
    """The documents with a column more, the text's hash, and its name."""
    name = "text_hash"
    while name in docs.columns:
        name += "_"
    return docs.withColumn(name, text_hash()), name


def blank_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """Documents with the characters of their texts' spans (text_hash, spans: start and end, by code point) replaced by asterisks.

    Spans of equal texts are equal: of several rows of a hash any one serves.
    """
    one = materialize(spans.groupBy(F.col("text_hash").alias("span_hash")).agg(F.first("spans").alias("spans")), "blank-spans")
    if (one.agg(F.sum(F.size("spans") + 1)).first()[0] or 0) <= BROADCAST_SPANS:
        one = F.broadcast(one)
    names = docs.columns
    held, key = hashed(docs)
    # documents without spans don't leave the JVM
    whole = held.join(one, held[key] == one["span_hash"], "left_anti").select(*(held[n] for n in names))
    # the joined columns go by number: names may clash
    joined = held.join(one, held[key] == one["span_hash"]).select(*(held[n].alias(f"c{i}") for i, n in enumerate(names)), one["spans"].alias("spans"))
    at = names.index("text")

    def make(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        out = []
        for text, found in zip(b.column(at).to_pylist(), b.column(len(names)).to_pylist(), strict=True):
            if text:
                parts, end = [], 0
                for x, y in sorted((s["start"], s["end"]) for s in found):
                    x, y = max(x, end), min(y, len(text))
                    if x < y:
                        parts += [text[end:x], "*" * (y - x)]
                        end = y
                text = "".join([*parts, text[end:]])
            out.append(text)
        columns = list(b.columns[: len(names)])
        columns[at] = pa.array(out, pa.string())
        yield pa.RecordBatch.from_arrays(columns, names=[f"c{i}" for i in range(len(names))])

    schema = ", ".join(f"c{i} {t}" for i, (_, t) in enumerate(docs.dtypes))
    return whole.unionByName(per_batch(joined, make, schema).toDF(*names))
