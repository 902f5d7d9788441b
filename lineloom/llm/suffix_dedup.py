"""Removal of repeated byte strings by bucket-pointer refinement, distributed.

Pointers are the starts of `length`-byte strings within documents. Initial buckets are q-grams: a string falls into the
bucket of its leftmost smallest q-gram by hash, which depends on its bytes alone, so equal strings share a bucket. Runs of
neighbouring pointers with one such q-gram are a unit. Buckets with a single unit are singletons and drop out. The rest
are refined: units whose whole extent is alike are equal in all their strings, and need no more. In buckets where
extents differ, one unit of each extent is looked into. A bucket of few extents is sorted out at once by what these share before
and after the q-gram, as suffix sorters do with small buckets. In one of many, ranges of pointers are refined by the identifiers
of what all their strings share, level by level: those that no other has drop out, those that are alike as a whole
are repeats, and the rest are cut finer, down to single pointers. Each level sees only what the one before left open.

Identifiers are 64-bit hashes, compared only within a bucket of the level above.

Defined results: null text is empty; texts shorter than the string have no pointer and stay. Rows that share doc_id and text are
documents of their own, and repeats of each other; ties between representatives of an extent go to the smallest, and don't show in the result. An empty table
gives no rows. Other columns are ignored. A very long text is handled by itself,
within memory of some tens of times its size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineloom.llm import textbytes as tb
from lineloom.llm.rows import per_batch
from lineloom.storage import bucketed, materialize

LENGTH, Q = 200, 64
#: Extents up to which a bucket is sorted out at once, in one row of some SMALL * 2 * LENGTH bytes.
SMALL = 64
#: Cells of pointers at the levels of a large bucket.
WIDTHS = (32, 8, 1)
#: Bytes of documents' keys and of pointers or spans, as counted below, that are broadcast to the texts; beyond, they are shuffled
#: to the texts, which are written in buckets by their keys once, when lists are first too large.
BROADCAST_BYTES = 64 << 20
DOC_BYTES, SPAN_BYTES = 64, 48
#: Rows of one key up to which texts are written in buckets: a bucket isn't split, a shuffle of a hot key is.
MOST_ALIKE = 1000

#: A document: its id (or a hash of its text, where that is null), and a hash of its text.
KEY = ("d", "t")


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, d, t, text."""
    t = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return t.select("doc_id", F.coalesce("doc_id", F.xxhash64("text")).alias("d"), F.hash("text").alias("t"), "text")


def slide(a: np.ndarray, width: int, best=np.minimum) -> np.ndarray:
    """Best of a[i : i + width] for each i."""
    size = 1
    while 2 * size <= width:
        a = best(a[:-size], a[size:])
        size *= 2
    return best(a[: len(a) - (width - size)], a[width - size :]) if width > size else a


def units(s: tb.Slice, length: int, q: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, first pointer within it, number of pointers, bucket, extent) of the slice's units."""
    n = len(s.data)
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none, none, none, none
    lens = np.diff(s.edges)
    long = np.flatnonzero(lens >= length)
    step = np.zeros(n + 1, np.int8)
    step[s.edges[long]] = 1
    step[s.edges[long] + lens[long] - length + 1] -= 1
    valid = np.cumsum(step[:-1], dtype=np.int8)[: n - length + 1].view(bool)
    h = tb.prefix_hash(s.data)
    at = np.arange(n - q + 1)
    grams = tb.span_hash(h, at, at + q)
    low = slide(grams, length - q + 1)
    new = np.empty(len(low), bool)
    new[0] = True
    np.not_equal(low[1:], low[:-1], out=new[1:])
    new[1:] |= grams[: len(low) - 1] == low[:-1]  # the smallest q-gram was the first: it has left
    new[1:] |= ~valid[:-1]
    starts = s.edges[long]
    new[starts] = True
    new &= valid
    first = np.flatnonzero(new)
    # a unit ends before the next one, or where its document's pointers do
    doc = np.searchsorted(s.edges, first, "right") - 1
    end = np.minimum(np.append(first[1:], n), s.edges[doc + 1] - length + 1)
    extent = tb.span_hash(h, first, end - 1 + length)
    return doc, first - s.edges[doc], end - first, low[first].view(np.int64), extent.view(np.int64)


def unit_table(docs: DataFrame, length: int, q: int) -> DataFrame:
    """(d, t, at, bucket, extent); at holds the first pointer in its upper half and their number in its lower."""

    def make(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        done = 0
        for s in tb.slices(b.column(2)):
            doc, first, count, bucket, extent = units(s, length, q)
            take = pa.array(doc + done)
            yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), pa.array(first << 32 | count), pa.array(bucket), pa.array(extent)], names=["d", "t", "at", "bucket", "extent"])
            done += s.n

    return per_batch(docs.select("d", "t", "text"), make, "d long, t int, at long, bucket long, extent long")


class Texts:
    """The keyed documents, as tables of lists by key are joined to them."""

    def __init__(self, docs: DataFrame):
        self.plain, self.placed = keyed(docs), None

    def joined(self, lists: DataFrame, n_spans: int, how: str) -> DataFrame:
        """Documents with their written lists: by a broadcast of these where their number and size allow it, else by buckets of the texts, or by a shuffle of them where a key is hot."""
        if n_spans * SPAN_BYTES + lists.count() * DOC_BYTES <= BROADCAST_BYTES:
            return self.plain.join(F.broadcast(lists), list(KEY), how)
        if self.placed is None:
            most = self.plain.groupBy(*KEY).count().agg(F.max("count")).first()[0] or 0
            self.placed = bucketed(self.plain, KEY, "suffix-texts") if most <= MOST_ALIKE else self.plain
        return self.placed.join(lists, list(KEY), how)


def anchors(grams: np.ndarray, last: np.ndarray, bucket: np.ndarray, reach: int) -> np.ndarray:
    """Where the bucket's q-gram stands first at or after each unit's last pointer."""
    out = np.empty(len(last), np.int64)
    for lo in range(0, len(last), 4096):
        at = last[lo : lo + 4096, None] + np.arange(reach)
        out[lo : lo + 4096] = (grams[np.minimum(at, len(grams) - 1)] == bucket[lo : lo + 4096, None]).argmax(1)
    return last + out


def _listed(b: pa.RecordBatch, s: tb.Slice, done: int) -> tuple[pa.StructArray, np.ndarray, np.ndarray, np.ndarray]:
    """The units listed for a slice's documents, their documents, first pointers and numbers of pointers."""
    lists = b.column(3).slice(done, s.n)
    flat = lists.flatten()
    at = np.asarray(flat.field(0))
    return flat, np.repeat(np.arange(s.n), np.asarray(pc.list_value_length(lists))), at >> 32, at & 0xFFFFFFFF


def contexts(docs: Texts, lists: DataFrame, n_units: int, length: int, q: int) -> DataFrame:
    """(bucket, alone, d, t, first, left, extent): the bytes of each listed unit's extent; left: those before the q-gram."""

    def make(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        done = 0
        for s in tb.slices(b.column(2)):
            flat, doc, first, count = _listed(b, s, done)
            if len(doc):
                start = s.edges[doc] + first
                at = np.arange(len(s.data) - q + 1)
                grams = tb.span_hash(tb.prefix_hash(s.data), at, at + q)
                left = anchors(grams, start + count - 1, np.asarray(flat.field(1)).view(np.uint64), length - q + 1) - start
                data = s.data.tobytes()
                extent = [data[i:j] for i, j in zip(start.tolist(), (start + count - 1 + length).tolist(), strict=True)]
                take = pa.array(doc + done)
                yield pa.RecordBatch.from_arrays([flat.field(1), flat.field(2), b.column(0).take(take), b.column(1).take(take), pa.array(first), pa.array(left), pa.array(extent, pa.binary())], names=["bucket", "alone", "d", "t", "first", "left", "extent"])
            done += s.n

    wanted = docs.joined(lists, n_units, "inner").select("d", "t", "text", "units")
    return per_batch(wanted, make, "bucket long, alone boolean, d long, t int, first long, left long, extent binary")


def sorted_out(small: DataFrame, length: int) -> DataFrame:
    """(d, t, start, end) of what the lone units of small buckets repeat, by the lengths they share with each other on either side of the q-gram."""

    def make(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rows = []
        for members in b.column(1).to_pylist():
            n = len(members)
            left = np.array([m["left"] for m in members])
            size = np.array([len(m["extent"]) for m in members])
            before, after = int(left.max()), int((size - left).max())
            x = np.full((n, before), 256, np.int16)  # bytes before the q-gram, nearest first
            y = np.full((n, after), 256, np.int16)
            for i, m in enumerate(members):
                e = np.frombuffer(m["extent"], np.uint8)
                x[i, : left[i]] = e[: left[i]][::-1]
                y[i, : size[i] - left[i]] = e[left[i] :]
            for i, m in enumerate(members):
                if not m["alone"]:
                    continue
                shared_left = np.logical_and.accumulate((x == x[i]) & (x != 256), axis=1).sum(1)
                shared_right = np.logical_and.accumulate((y == y[i]) & (y != 256), axis=1).sum(1)
                ok = shared_left + shared_right >= length
                ok[i] = False
                if ok.any():
                    a = m["first"] + m["left"]
                    rows.append((m["d"], m["t"], a - int(shared_left[ok].max()), a + int(shared_right[ok].max())))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64()), strict=True)], names=["d", "t", "start", "end"])

    return per_batch(small.groupBy("bucket").agg(F.collect_list(F.struct("alone", "d", "t", "first", "left", "extent")).alias("members")), make, "d long, t int, start long, end long")


CELL = "bucket long, base int, core long, lo int, hi int, extent long, alone boolean, d long, t int, anchor long"


def cells(docs: Texts, lists: DataFrame, n_units: int, length: int, q: int, width: int) -> DataFrame:
    """The listed ranges of pointers cut into cells of `width`.

    A pointer goes by the number of bytes between it and its q-gram (the anchor). core: a hash of the bytes that all strings of a whole
    cell share, which no string of the cell can be repeated without; extent: of all bytes of the cell's own pointers, lo to hi.
    """

    def make(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        done = 0
        for s in tb.slices(b.column(2)):
            lists_ = b.column(3).slice(done, s.n)
            flat = lists_.flatten()
            if len(flat):
                doc = np.repeat(np.arange(s.n), np.asarray(pc.list_value_length(lists_)))
                anchor, lo, hi = (np.asarray(flat.field(k)).astype(np.int64) for k in range(3))
                n = hi // width - lo // width + 1
                row = np.repeat(np.arange(len(n)), n)
                base = (lo[row] // width + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)) * width
                low, high = np.maximum(lo[row], base), np.minimum(hi[row], base + width - 1)
                at = s.edges[doc[row]] + anchor[row]
                h = tb.prefix_hash(s.data)
                core = tb.span_hash(h, at - base, at + length - base - width + 1)
                extent = tb.span_hash(h, at - high, at + length - low)
                take, own = pa.array(doc[row] + done), pa.array(row)
                yield pa.RecordBatch.from_arrays([flat.field(3).take(own), pa.array(base.astype(np.int32)), pa.array(core.view(np.int64)), pa.array(low.astype(np.int32)), pa.array(high.astype(np.int32)), pa.array(extent.view(np.int64)), flat.field(4).take(own), b.column(0).take(take), b.column(1).take(take), pa.array(anchor[row])], names=[x.split()[0] for x in CELL.split(", ")])
            done += s.n

    wanted = docs.joined(lists, n_units, "inner").select("d", "t", "text", "ranges")
    return per_batch(wanted, make, CELL)


def anchored(docs: Texts, lists: DataFrame, n_units: int, length: int, q: int) -> DataFrame:
    """(d, t, ranges) of the listed units: anchor, lo and hi, bucket, alone."""
    one = pa.struct([("anchor", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32()), ("bucket", pa.int64()), ("alone", pa.bool_())])

    def make(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        done = 0
        for s in tb.slices(b.column(2)):
            flat, doc, first, count = _listed(b, s, done)
            if len(doc):
                start = s.edges[doc] + first
                at = np.arange(len(s.data) - q + 1)
                grams = tb.span_hash(tb.prefix_hash(s.data), at, at + q)
                anchor = anchors(grams, start + count - 1, np.asarray(flat.field(1)).view(np.uint64), length - q + 1) - s.edges[doc]
                ranges = pa.StructArray.from_arrays([pa.array(anchor), pa.array((anchor - first - count + 1).astype(np.int32)), pa.array((anchor - first).astype(np.int32)), flat.field(1), flat.field(2)], fields=list(one))
                cut = np.searchsorted(doc, np.arange(s.n + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(done, s.n), b.column(1).slice(done, s.n), pa.ListArray.from_arrays(pa.array(cut), ranges)], names=["d", "t", "ranges"])
            done += s.n

    wanted = docs.joined(lists, n_units, "inner").select("d", "t", "text", "units")
    return per_batch(wanted, make, "d long, t int, ranges array<struct<anchor:long,lo:int,hi:int,bucket:long,alone:boolean>>")


def refined(docs: Texts, lists: DataFrame, n_units: int, length: int, q: int, widths: tuple[int, ...] = WIDTHS) -> list[DataFrame]:
    """(d, t, start, end) of what the lone units of large buckets repeat, found level by level.

    At each level the pointers of a bucket are refined by the identifier of their cell's core: cells that no other shares drop
    out; cells whose whole extent another shares are repeats; the others are cut finer. At width 1 core and extent are the string.
    Widths at which the strings of a cell needn't share any bytes are passed over, as a core there would tell equal strings apart.
    """
    widths = tuple(w for w in widths if w <= length - q + 1)
    span = [(F.col("anchor") - F.col("hi")).alias("start"), (F.col("anchor") + length - F.col("lo")).alias("end")]
    ranges, n, out = materialize(anchored(docs, lists, n_units, length, q), "suffix-ranges"), n_units, []
    for width in widths:
        level = materialize(cells(docs, ranges, n, length, q, width), "suffix-cells")
        core = ["bucket", "base", "core"]
        live = level.groupBy(*core).agg(F.count(F.lit(1)).alias("n"), F.count_if("alone").alias("lone")).filter("n > 1 and lone > 0").select(*core)
        kept = materialize(level.join(materialize(live, "suffix-live"), core), "suffix-kept")
        if width == 1:
            out.append(kept.filter("alone").select(*KEY, *span))
            break
        whole = [*core, "lo", "hi", "extent"]
        groups = materialize(kept.groupBy(*whole).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("d", "t", "anchor", "alone")).alias("rep")), "suffix-groups")
        out.append(kept.filter("alone").join(groups.filter("n > 1").select(*whole), whole).select(*KEY, *span))
        left = groups.groupBy("rep.d", "rep.t").agg(F.collect_list(F.struct("rep.anchor", "lo", "hi", "bucket", (F.col("rep.alone") & (F.col("n") == 1)).alias("alone"))).alias("ranges"))
        ranges = materialize(left, "suffix-ranges")
        n = ranges.agg(F.coalesce(F.sum(F.size("ranges")), F.lit(0))).first()[0]
        if not n:
            break
    return out


def repeated_spans(docs: Texts, length: int = LENGTH, q: int = Q, small: int = SMALL) -> DataFrame:
    """(d, t, start, end) of repeated strings; spans of a document may overlap."""
    all_units = materialize(unit_table(docs.plain, length, q), "suffix-units")
    buckets = all_units.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("extent").alias("low"), F.max("extent").alias("high")).filter("n > 1")
    buckets = materialize(buckets.select("bucket", (F.col("low") == F.col("high")).alias("pure")), "suffix-buckets")
    shared = materialize(all_units.join(buckets, "bucket"), "suffix-shared")
    span = [F.shiftright("at", 32).alias("start"), (F.shiftright("at", 32) + F.col("at").bitwiseAND(F.lit(0xFFFFFFFF)) - 1 + length).alias("end")]
    whole = shared.filter("pure").select(*KEY, *span)
    mixed = shared.filter("not pure")
    extents = materialize(mixed.groupBy("bucket", "extent").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("d", "t", "at")).alias("rep")), "suffix-extents")
    again = mixed.join(extents.filter("n > 1").select("bucket", "extent"), ["bucket", "extent"]).select(*KEY, *span)
    # buckets with a lone extent are left: few extents are sorted out at once, many are refined pointer by pointer
    kinds = extents.groupBy("bucket").agg(F.count(F.lit(1)).alias("kinds"), F.count_if(F.col("n") == 1).alias("lone")).filter("lone > 0").select("bucket", (F.col("kinds") <= small).alias("small"))
    reps = extents.select("rep.*", "bucket", (F.col("n") == 1).alias("alone")).join(materialize(kinds, "suffix-kinds"), "bucket")
    listed = reps.groupBy("small", *KEY).agg(F.collect_list(F.struct("at", "bucket", "alone")).alias("units"))
    listed = materialize(listed, "suffix-listed")
    n_units = {r["small"]: r["n"] for r in listed.groupBy("small").agg(F.sum(F.size("units")).alias("n")).collect()}
    parts = [whole, again]
    if True in n_units:
        lists = listed.filter("small").drop("small")
        parts.append(sorted_out(contexts(docs, lists, n_units[True], length, q), length))
    if False in n_units:
        lists = listed.filter("not small").drop("small")
        parts += refined(docs, lists, n_units[False], length, q)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of the union of spans."""
    order = np.argsort(starts, kind="stable")
    a, b = starts[order], np.maximum.accumulate(ends[order])
    new = np.concatenate(([True], a[1:] > b[:-1]))
    return a[new], b[np.append(np.flatnonzero(new)[1:] - 1, len(b) - 1)]


def runs_of(spans: DataFrame) -> DataFrame:
    """(d, t, starts, ends): the maximal runs of each document's spans, in order. A document's spans are bound by its length."""

    def make(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        out = [merged(np.asarray(x.values), np.asarray(y.values)) for x, y in zip(b.column(2), b.column(3), strict=True)]
        cut = pa.array(np.concatenate(([0], np.cumsum([len(x) for x, _ in out]))).astype(np.int32))
        lists = [pa.ListArray.from_arrays(cut, pa.array(np.concatenate([r[k] for r in out]))) for k in (0, 1)]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *lists], names=["d", "t", "starts", "ends"])

    gathered = spans.groupBy(*KEY).agg(F.collect_list("start").alias("starts"), F.collect_list("end").alias("ends"))
    return per_batch(gathered, make, "d long, t int, starts array<long>, ends array<long>")


def remove_repeats(docs: DataFrame, length: int = LENGTH, q: int = Q, keep_text: bool = False) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (start and end pairs); keep_text: kept, the remaining bytes, too."""
    texts = Texts(docs)
    spans = repeated_spans(texts, length, q)
    lists = materialize(runs_of(spans), "suffix-spans")
    n = lists.agg(F.coalesce(F.sum(F.size("starts")), F.lit(0))).first()[0]

    def make(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for doc_id, text, starts, ends in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), b.column(2), b.column(3), strict=True):
            kept, runs = text, []
            if starts.is_valid:
                x, y = np.asarray(starts.values), np.asarray(ends.values)
                cut = [0, *np.stack((x, y), 1).ravel().tolist(), len(text)]
                runs = cut[1:-1]
                kept = b"".join(text[i:j] for i, j in zip(cut[::2], cut[1::2], strict=True))
            rows.append((doc_id, len(text), len(text) - len(kept), len(runs) // 2, hashlib.sha256(kept).hexdigest(), runs, kept if keep_text else None))
            size += len(kept)
        types = [pa.int64()] * 4 + [pa.string(), pa.list_(pa.int64()), pa.binary()]
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept"]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    full = texts.joined(lists, n, "left").select("doc_id", "text", "starts", "ends")
    out = per_batch(full, make, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<long>, kept binary")
    return out if keep_text else out.drop("kept")
