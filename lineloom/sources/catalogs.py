"""Catalogs of formats: reading, validation and writing."""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lineloom.grammar.catalog import CatalogError, read, read_v1, strict_json
from lineloom.operators.recognition import Format

__all__ = ["CatalogError", "catalog_rows", "corpus_pages", "export_by_view", "pilot_sample", "read_formats", "record_at", "strict_json", "write_report"]


def read_formats(document: dict) -> list[Format]:
    """The formats of a flat or grouped catalog in source order. A child is None where it isn't known."""
    return [Format(c.index, c.format, c.view or "", c.child) for c in read(document).commands]


def catalog_rows(spark: SparkSession, path: str, *, strict: bool = False) -> DataFrame:
    """(source_index, view, index_in_view, format, child, record) of a catalog file that Spark reads. strict: as the matcher takes it."""
    text = spark.read.text(path, wholetext=True).first()[0]
    catalog = (read_v1 if strict else read)(strict_json(text))
    rows = [(c.index, c.view, c.index_in_view, c.format, c.child, json.dumps(dict(c.record))) for c in catalog.commands]
    return spark.createDataFrame(rows, "source_index int, view string, index_in_view int, format string, child string, record string")


def record_at(document: dict, view: str | None, index: int):
    """The record at a place of a catalog."""
    return (document["commands"] if view is None else document["views"][view])[index]


def corpus_pages(spark: SparkSession, path: str, manifest: DataFrame | None = None) -> DataFrame:
    """Documentation pages, one JSON object a file, joined to their manifest by file name; unreadable ones keep their text in _corrupt_record."""
    schema = "PageTitle string, CLIs array<string>, ParentView array<string>, FuncDef string, ParaDef array<struct<Parameters:string,Info:string>>, UsageGuidelines string, ExtraInfo string, Examples array<array<string>>, related_topics array<struct<title:string,reference_kind:string,target_files:array<string>,target_sections:array<string>>>, _corrupt_record string"
    pages = spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").json(path).withColumn("file", F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1))
    return pages if manifest is None else pages.join(manifest, "file", "left")


def export_by_view(pages: DataFrame) -> DataFrame:
    """(view, formats): the distinct formats of each view, sorted."""
    each = pages.select(F.explode("ParentView").alias("view"), "CLIs").select("view", F.explode("CLIs").alias("format"))
    return each.groupBy("view").agg(F.array_sort(F.collect_set("format")).alias("formats"))


def write_report(lines: DataFrame, path: str) -> None:
    """One JSON object a line, nulls left out."""
    lines.write.option("ignoreNullFields", "true").json(path)


def pilot_sample(rows: DataFrame, key: str, n: int, anchors: Iterable = ()) -> DataFrame:
    """The anchors, then the rows whose key hashes lowest, n in all: the same ones every time."""
    anchors = list(anchors)
    first = F.col(key).isin(anchors) if anchors else F.lit(False)
    return rows.orderBy(F.when(first, 0).otherwise(1), F.sha2(F.col(key).cast("string"), 256), key).limit(n)
