"""Suggestions for commands that no format reads."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from lineloom.grammar.formats import first, parse
from lineloom.grammar.program import Program
from lineloom.grammar.suggesting import MOST, suggestions


def suggest(commands: DataFrame, formats: list[str], limit: int = MOST) -> DataFrame:
    """(command, rank, score, text) of the best formats for each distinct command, by score, then the format's place."""
    shared = commands.sparkSession.sparkContext.broadcast(list(dict.fromkeys(formats)))
    schema = pa.schema([("command", pa.string()), ("rank", pa.int32()), ("score", pa.int32()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [(t, parse(t)) for t in shared.value]
        sources = [(i, t, Program(x), first(x)[0]) for i, (t, x) in enumerate(trees)]
        for b in batches:
            rows = [{"command": c, "rank": k, "score": score[0], "text": text} for c in b.column(0).to_pylist() for k, (score, _, text) in enumerate(suggestions(c, sources, limit), 1)]
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return commands.select("command").distinct().mapInArrow(run, "command string, rank int, score int, text string")
