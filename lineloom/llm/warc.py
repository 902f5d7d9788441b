"""WARC archives: writing, reading, and reassembly of segmented records.

A record is one row of a text sink whose line separator is the blank lines that end a record, so archives
are written through Spark's commit protocol into any store that Spark writes. They are read back as a stream
split at the version line; a record whose content itself holds that line is completed by its Content-Length.
Large blocks are cut into a first segment and continuation records. Reading groups these by the identifier
of their origin, orders them by segment number, checks that the numbers are complete and that the total
length holds, and then decodes the HTTP block, chunked framing included. Whole records take no shuffle.

Defined results: a null html is an empty payload. A page whose payload another page with a smaller page_id
has becomes a revisit record; rows that tie on the smallest page_id are all responses. A null page_id never
is the smallest. Repeated rows are each written, under an identifier of their own (the row's number is part of it), and each read back. A very long
page is cut into segments, which meet in one task: its own. An empty table gives an archive without records. Columns but page_id, url and html are
ignored. A record's memory is bound by its payload, however long the archive.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lineloom.llm.rows import bound_batches, per_batch
from lineloom.storage import fresh_path, materialize

VERSION = b"WARC/1.0\r\n"
SEGMENT_BYTES = 32_768
CHUNK_BYTES = 8_192
#: A table of repeated digests of at most so many rows is broadcast (some 30 bytes each); a larger one is joined by a shuffle.
BROADCAST_ROWS = 500_000


class WarcError(ValueError):
    """A record that doesn't keep to the format."""


def digest32(payload: bytes) -> str:
    """Bare upper-case base32 of the SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(body: bytes, size: int = CHUNK_BYTES) -> bytes:
    """Chunked transfer framing of a body."""
    parts = [b"%x\r\n%b\r\n" % (len(c), c) for lo in range(0, len(body), size) if (c := body[lo : lo + size])]
    return b"".join(parts) + b"0\r\n\r\n"


def dechunk(framed: bytes) -> bytes:
    """The body within chunked framing; extensions and trailers are passed over."""
    out, at = [], 0
    while True:
        end = framed.find(b"\r\n", at)
        if end < 0:
            raise WarcError("a chunk without its size line")
        try:
            n = int(framed[at:end].split(b";")[0].strip(), 16)
        except ValueError:
            raise WarcError(f"not a chunk size: {framed[at:end][:20]!r}") from None
        at = end + 2
        if n == 0:
            return b"".join(out)
        if len(framed) < at + n + 2 or framed[at + n : at + n + 2] != b"\r\n":
            raise WarcError("a chunk is cut short")
        out.append(framed[at : at + n])
        at += n + 2


def headers(block: bytes) -> tuple[dict[str, str], bytes]:
    """Lower-cased header fields of a block, and what follows them; the HTTP status line is passed over."""
    head, gap, rest = block.partition(b"\r\n\r\n")
    if not gap:
        raise WarcError("headers without an end")
    fields = {}
    for line in head.split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if colon and not line.startswith(b"HTTP/"):
            fields[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    return fields, rest


def _clean(value: str) -> str:
    return "".join(c for c in value if c >= " " and c != "\x7f")


def _record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    lines = [f"{k}: {v}" for k, v in [*fields, ("Content-Length", str(len(block)))]]
    return VERSION + "\r\n".join(lines).encode() + b"\r\n\r\n" + block


def page_records(row: int, page_id: int | None, url: str | None, html: str | None, first: int | None, first_row: int | None, segment_bytes: int = SEGMENT_BYTES, chunk_bytes: int = CHUNK_BYTES) -> Iterator[bytes]:
    """The records of a page, which is row `row` of its table. first: the page that has the response of an equal payload, and its row, or null."""
    payload = (html or "").encode()
    digest = digest32(payload)
    name = lambda page, at: f"<urn:lineloom:page:{'null' if page is None else page}:{digest}:{at}>"
    common = [("WARC-Record-ID", name(page_id, row)), ("WARC-Date", "2020-01-01T00:00:00Z"), ("WARC-Payload-Digest", f"sha1:{digest}")]
    common += [("WARC-Target-URI", _clean(url))] if url else []
    if first is not None and first != page_id:
        http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
        profile = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
        yield _record([("WARC-Type", "revisit"), *common, ("WARC-Profile", profile), ("WARC-Refers-To", name(first, first_row)), ("Content-Type", "application/http; msgtype=response")], http)
        return
    framing, body = (f"Content-Length: {len(payload)}", payload) if len(payload) <= chunk_bytes else ("Transfer-Encoding: chunked", chunked(payload, chunk_bytes))
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{framing}\r\n\r\n".encode() + body
    kind = [("WARC-Type", "response"), *common, ("Content-Type", "application/http; msgtype=response")]
    if len(block) <= segment_bytes:
        yield _record(kind, block)
        return
    cuts = range(0, len(block), segment_bytes)
    for k, lo in enumerate(cuts, 1):
        piece = block[lo : lo + segment_bytes]
        if k == 1:
            yield _record([*kind, ("WARC-Segment-Number", "1")], piece)
        else:
            total = [("WARC-Segment-Total-Length", str(len(block)))] if k == len(cuts) else []
            own = f"<urn:lineloom:page:{'null' if page_id is None else page_id}:{digest}:{row}:segment:{k}>"
            yield _record([("WARC-Type", "continuation"), ("WARC-Record-ID", own), ("WARC-Date", "2020-01-01T00:00:00Z"), ("WARC-Segment-Origin-ID", name(page_id, row)), ("WARC-Segment-Number", str(k)), *total], piece)


def first_pages(pages: DataFrame) -> DataFrame:
    """(sha, first, first_row) of the payloads that more than one row has; written, so that a join with it can be split where it is skewed."""
    named = F.when(F.col("page_id").isNotNull(), F.struct("page_id", "row"))
    repeated = pages.groupBy("sha").agg(F.min(named).alias("x"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("sha", F.col("x.page_id").alias("first"), F.col("x.row").alias("first_row"))
    return materialize(repeated, "warc-first")


def write_warc(pages: DataFrame, path: str, segment_bytes: int = SEGMENT_BYTES, chunk_bytes: int = CHUNK_BYTES) -> None:
    """Write the pages as gzipped archives below path."""
    picked = pages.select(F.monotonically_increasing_id().alias("row"), F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    picked = picked.withColumn("sha", F.sha1(F.coalesce("html", F.lit("")).cast("binary")))
    firsts = first_pages(picked)
    if firsts.count() <= BROADCAST_ROWS:
        firsts = F.broadcast(firsts)
    known = picked.join(firsts, "sha", "left").select("row", "page_id", "url", "html", "first", "first_row")

    def make(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        out, size = [], 0
        for page in zip(*(c.to_pylist() for c in b.columns), strict=True):
            for r in page_records(*page, segment_bytes, chunk_bytes):
                out.append(r)
                size += len(r)
            if size > 4 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])
                out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])

    records = per_batch(known, make, "record binary").select(F.col("record").cast("string").alias("value"))
    records.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").text(path)


RAW = "record_id string, type string, uri string, digest string, refers_to string, origin_id string, segment int, total_length long, block binary"


def _parse(piece: bytes) -> tuple | None:
    """The columns of RAW, or None if the record goes on beyond this piece."""
    head, gap, rest = piece.partition(b"\r\n\r\n")
    if not gap:
        return None
    fields, _ = headers(head + gap)
    n = int(fields["content-length"])
    if len(rest) < n + 4:
        return None
    if rest[n:] != b"\r\n\r\n":
        raise WarcError(f"{fields.get('warc-record-id')}: the record doesn't end after its Content-Length")
    segment, total = fields.get("warc-segment-number"), fields.get("warc-segment-total-length")
    digest = fields.get("warc-payload-digest", "").removeprefix("sha1:") or None
    return (fields.get("warc-record-id"), fields.get("warc-type"), fields.get("warc-target-uri"), digest, fields.get("warc-refers-to"), fields.get("warc-segment-origin-id"), int(segment) if segment else None, int(total) if total else None, rest[:n])


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """The raw records of the archives below path."""
    names = [x.split()[0] for x in RAW.split(", ")]
    types = [pa.string()] * 6 + [pa.int32(), pa.int64(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, file, rows, size = b"", None, [], 0
        for b in batches:
            for piece, name in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if name != file:
                    if held:
                        raise WarcError(f"{file} ends within a record")
                    file = name
                if not held and not piece:  # what stands before the first version line
                    continue
                held = held + VERSION + piece if held else piece
                if (row := _parse(held)) is not None:
                    rows.append(row)
                    size += len(held)
                    held = b""
                if size > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
                    rows, size = [], 0
        if held:
            raise WarcError(f"{file} ends within a record")
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    bound_batches(spark)
    lines = spark.read.option("lineSep", VERSION.decode()).text(path)
    return lines.select(F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("file")).mapInArrow(run, RAW)


def reassemble(numbers: list[int], totals: list[int | None], blocks: list[bytes]) -> list[bytes]:
    """The whole blocks of one origin. More than one if its segments stand there several times over."""
    order = sorted(range(len(numbers)), key=lambda i: (numbers[i], blocks[i]))
    copies = numbers.count(1)
    if not copies or len(numbers) % copies:
        raise WarcError("segments are missing")
    out = []
    for c in range(copies):
        mine = order[c::copies]
        if [numbers[i] for i in mine] != list(range(1, len(mine) + 1)):
            raise WarcError(f"segment numbers {[numbers[i] for i in mine]} have a gap")
        block = b"".join(blocks[i] for i in mine)
        if (total := totals[mine[-1]]) is None or total != len(block):
            raise WarcError(f"total length {total}, but {len(block)} bytes were found")
        out.append(block)
    return out


def decode(block: bytes) -> tuple[dict[str, str], bytes]:
    """HTTP fields and payload of a block."""
    fields, body = headers(block)
    if "chunked" in fields.get("transfer-encoding", "").lower():
        body = dechunk(body)
    elif body and fields.get("content-length", "").isdigit() and int(fields["content-length"]) != len(body):
        raise WarcError("the body's length isn't its Content-Length")
    return fields, body


READ = "record_id string, type string, uri string, digest string, refers_to string, n_segments int, payload_bytes long, payload binary"


def _decoder(keep_payload: bool):
    def make(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for rid, kind, uri, digest, refers, segments in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if segments[0]["segment"] is None:
                blocks = [segments[0]["block"]]
            else:
                blocks = reassemble([s["segment"] for s in segments], [s["total_length"] for s in segments], [s["block"] for s in segments])
            for block in blocks:
                fields, payload = decode(block)
                n = len(payload)
                if kind == "revisit":
                    n = int(fields["content-length"])
                elif digest and digest32(payload) != digest:
                    raise WarcError(f"{rid}: the payload's digest is wrong")
                rows.append((rid, kind, uri, digest or digest32(payload), refers, len(segments) // len(blocks), n, payload if keep_payload else None))
                size += len(payload) if keep_payload else 100
            if size > 4 << 20:
                yield _batch(rows)
                rows, size = [], 0
        if rows:
            yield _batch(rows)

    types = [pa.string()] * 5 + [pa.int32(), pa.int64(), pa.binary()]

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=[x.split()[0] for x in READ.split(", ")])

    return make


def read_warc(spark: SparkSession, path: str, keep_payload: bool = True) -> DataFrame:
    """One row per whole record: record_id, type, uri, digest, refers_to, n_segments, payload_bytes, payload (null if not kept).

    Only segments are shuffled, by their origin; whole records are decoded where they are read.
    """
    raw = read_records(spark, path)
    part = F.struct("segment", "total_length", "block")
    single = raw.filter("segment is null").select("record_id", "type", "uri", "digest", "refers_to", F.array(part).alias("segments"))
    many = raw.filter("segment is not null").withColumn("origin_id", F.coalesce("origin_id", "record_id"))
    first = lambda c: F.first(F.when(F.col("segment") == 1, F.col(c)), ignorenulls=True).alias(c)
    grouped = many.groupBy("origin_id").agg(first("type"), first("uri"), first("digest"), first("refers_to"), F.collect_list(part).alias("segments"))
    whole = grouped.select(F.col("origin_id").alias("record_id"), "type", "uri", "digest", "refers_to", "segments")
    make = _decoder(keep_payload)
    return per_batch(single, make, READ).unionByName(per_batch(whole, make, READ))


def warc_round_trip(pages: DataFrame) -> DataFrame:
    """Write the pages, read them back, and return what the archives say of each."""
    spark = pages.sparkSession
    path = fresh_path(spark, "warc")
    write_warc(pages, path)
    back = read_warc(spark, path, keep_payload=False)
    page = lambda c: F.expr(f"try_cast(regexp_extract({c}, '^<urn:lineloom:page:(-?[0-9]+|null):', 1) as bigint)")
    return back.select(page("record_id").alias("page_id"), "payload_bytes", F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"), page("refers_to").alias("refers_to"), "n_segments")
