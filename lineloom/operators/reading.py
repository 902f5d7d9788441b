"""Formats as data: each distinct one read where it lies."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from lineloom.grammar.formats import lex, parse, prefixes, shape, slots, symbols
from lineloom.grammar.proving import predictive, shortest
from lineloom.grammar.values import DOCUMENT, REGISTRY, FormatError

_TOKEN = pa.struct([("kind", pa.string()), ("text", pa.string()), ("type_id", pa.string()), ("low", pa.string()), ("high", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
_READ = pa.schema([("format", pa.string()), ("tokens", pa.list_(_TOKEN)), ("error", pa.string()), ("error_start", pa.int32())])


def read_formats(formats: DataFrame, documents: bool = False) -> DataFrame:
    """(format, tokens, error, error_start) of each distinct format; bounds are decimal. documents: by the spelling of documentation."""
    registry = DOCUMENT if documents else REGISTRY

    def token(kind: str, value, text: str, start: int, end: int) -> dict:
        t = {"kind": kind, "text": text[start:end], "type_id": None, "low": None, "high": None, "start": start, "end": end}
        if kind == "declaration":
            t |= {"type_id": value.type_id, "low": None if value.low is None else str(value.low), "high": None if value.high is None else str(value.high)}
        elif kind == "repeat":
            t |= {"low": str(value[0]), "high": str(value[1])}
        return t

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for text in b.column(0).to_pylist():
                try:
                    rows.append({"format": text, "tokens": [token(k, v, text, x, y) for k, v, x, y in lex(text, registry)], "error": None, "error_start": None})
                except FormatError as e:
                    rows.append({"format": text, "tokens": [], "error": str(e), "error_start": e.start})
            yield pa.RecordBatch.from_pylist(rows, schema=_READ)

    one = "struct<kind:string,text:string,type_id:string,low:string,high:string,start:int,end:int>"
    return formats.select("format").filter("format is not null").distinct().mapInArrow(run, f"format string, tokens array<{one}>, error string, error_start int")


ANALYSIS = "format string, ordered_key string, canonical_key string, typed_key string, required array<string>, possible array<string>, any_value boolean, prefixes array<string>, shortest string, predictive boolean, slots array<string>"


def analysed(formats: DataFrame) -> DataFrame:
    """What is known of each distinct format, a row each: keys of its shape, the words its lines must and may have, beginnings that cover all its lines,
    its shortest line, whether the next word always decides, and the ids of its values. Symbols are K:word and P for a value. Formats that
    can't be read are left to read_formats().
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for text in b.column(0).to_pylist():
                try:
                    t = parse(text)
                except FormatError:
                    continue
                must, may, value = symbols(t)
                line = shortest(t)
                rows.append((text, shape(t), shape(t, ordered=False), shape(t, ordered=False, types=True), sorted(must), sorted(may), value, sorted(" ".join(p) for p in prefixes(t)), None if line is None else " ".join(line), predictive(t), [x.slot_id for x in slots(t)]))
            if rows:
                text, strings, flag = pa.string(), pa.list_(pa.string()), pa.bool_()
                types = [text] * 4 + [strings, strings, flag, strings, text, flag, strings]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=[x.split()[0] for x in ANALYSIS.split(", ")])

    return formats.select("format").filter("format is not null").distinct().mapInArrow(run, ANALYSIS)
