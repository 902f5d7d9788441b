"""Recognition of lines as they arrive: an extension. Flat and system parsing keep no state between lines."""

from __future__ import annotations

from pyspark.sql import DataFrame

from lineloom.functions.text import body, indent
from lineloom.operators.recognition import Format, parse_lines


def recognised_stream(stream: DataFrame, formats: list[Format], sink, column: str = "value", **options):
    """Start a query that recognises each micro-batch of a text stream and hands it to sink(batch, epoch).

    The plan of a batch is that of a table, its anti-joins included, so it runs within foreachBatch.
    """

    def each(batch: DataFrame, epoch: int) -> None:
        rows = batch.select(indent(column).alias("indent"), body(column).alias("command"))
        sink(parse_lines(rows, formats), epoch)

    writer = stream.writeStream.foreachBatch(each)
    for k, v in options.items():
        writer = writer.option(k, v)
    return writer.start()
