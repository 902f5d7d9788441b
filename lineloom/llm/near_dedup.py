"""MinHash near-duplicates by a multi-index Hamming join.

A document's set is its distinct word shingles. Equal sets are one class, whose smallest doc_id stands for it. A
class has a signature of K b-bit minhash symbols, split into M chunks. By the pigeonhole principle two signatures that
differ in at most M * (E + 1) - 1 symbols have a chunk with at most E = 1 differing symbols; leaving out each symbol of each
chunk in turn enumerates these errors, so such a pair shares a key. At K = 40, M = 8, E = 1 all pairs within 15
symbols are met, and a pair at similarity 0.8 is missed with a chance of 2e-5, at 0.85 of 6e-7.

Classes that share a key aren't paired with each other but with a few heads of the key: the one that shares most keys with others,
which stands in the middle of its copies, and some by chance. Candidate pairs are held to a bound on the distance of 128 one-bit
minhashes, and confirmed on the full sets. Classes of a key whose members then still lie in more than one component are open. Among
open classes the keys are split further: a pair at the threshold shares one of the rarest shingles of each (as many as a set may lack,
and one), so a hot key falls apart into the few shingles that tell its members apart. Pairs across components that share such a
shingle are held to a parity sketch of 1024 bits (each shingle flips one; sketches differ in no more bits than the sets differ in
shingles, so what this rules out is ruled out for certain), and confirmed. So no pair that shares a key and reaches the threshold goes unseen
unless its two are known to be connected.

Defined results: null or empty text, or text without a word, has an empty set and is linked with nothing. Fewer than `width`
words are one shingle, the whole sequence. Rows that share a doc_id but not their text, and rows without one, are documents of their
own, linked as their sets are; component_id is the smallest doc_id of the component, null if it has none. Of ties for a head the largest id is taken; components don't hang on it. An empty table gives no rows. Other columns are
ignored. A very long text holds its own set in memory, and no more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineloom.llm import textbytes as tb
from lineloom.llm.components import components
from lineloom.llm.filtering import without
from lineloom.llm.rows import bound_batches, per_batch, texts
from lineloom.storage import materialize

WIDTH = 5
PERCENT = 80
CHUNKS, CHUNK = 8, 5
BITS = 128
#: One-bit minhashes that a pair may differ in: a pair at 0.8 differs in 12.8 of 128, more than 33 at a chance of 1e-7.
MOST_BITS = 33
#: Heads of a key taken by chance, beside the one that shares most keys.
HEADS = 2
PARITY = 1024
#: Bytes of texts whose sketches are made at once.
SET_BYTES = 1 << 18
SKETCH = [f"s{i}" for i in range(PARITY // 64)]
#: Ids of sets to fetch are broadcast up to so many (8 bytes each); beyond, texts are shuffled to them.
BROADCAST_IDS = 2_000_000
#: Pairs of a head that one task confirms; those of a head with more are spread.
BLOCK = 256

_rng = np.random.default_rng(20240229)
_MULTIPLY = _rng.integers(1, 1 << 63, BITS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 1 << 63, BITS, dtype=np.uint64)


def sets_of(s: tb.Slice, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of the slice's documents one after another, and where each one's begin (and the end)."""
    data = tb.LOWER[s.data]
    w = tb.words(s, data, tb.NONSPACE)
    h = tb.span_hash(tb.prefix_hash(data), w.starts, w.ends)
    grams, at = tb.shingles(s, w, h, width)
    cut = np.searchsorted(at, w.of)
    parts, sizes = [], np.zeros(s.n, np.int64)
    for i in range(s.n):
        g = grams[cut[i] : cut[i + 1]]
        if len(g):
            g = np.sort(g)
            g = g[np.concatenate(([True], g[1:] != g[:-1]))]
        elif w.of[i + 1] > w.of[i]:
            g = np.array([tb.whole_hash(h, w.of[i], w.of[i + 1])], np.uint64)
        parts.append(g)
        sizes[i] = len(g)
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64), np.concatenate(([0], np.cumsum(sizes)))


#: Numbers given to documents that share a doc_id or have none lie from here on.
GIVEN = 1 << 62


def numbered(docs: DataFrame, name: str) -> DataFrame:
    """The documents with a number each in the column `name`: doc_id, or where it is null or another text has it, one made of doc_id and text."""
    doc_id, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    t = F.xxhash64(text)
    odd = docs.select(doc_id.alias("odd_id"), t.alias("t")).groupBy("odd_id").agg(F.min("t").alias("low"), F.max("t").alias("high")).filter("odd_id is null or low <> high")
    odd = materialize(odd, "near-odd")
    if odd.isEmpty():
        return docs.withColumn(name, doc_id)
    columns = [docs[c] for c in docs.columns]
    # null ids are spread by their texts
    joined = docs.join(odd.filter("odd_id is not null"), F.coalesce(docs["doc_id"].cast("long"), F.xxhash64(docs["text"].cast("string"))) == odd["odd_id"], "left")
    own = docs["doc_id"].cast("long")
    keeps = own.isNotNull() & (odd["odd_id"].isNull() | (F.xxhash64(docs["text"].cast("string")) == odd["low"]))
    given = F.xxhash64(F.lit("given"), own, docs["text"].cast("string")).bitwiseAND(F.lit(GIVEN - 1)).bitwiseOR(F.lit(GIVEN))
    return joined.select(*columns, F.when(keeps, own).otherwise(given).alias(name))


def signatures(docs: DataFrame, width: int) -> DataFrame:
    """Of documents (id, doc_id, text): id, doc_id, n_shingles, set_a and set_b (a hash of the set), symbols (16 bits each), bits_a and bits_b."""

    def make(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        done = 0
        for s in tb.slices(b.column(2)):
            g, of = sets_of(s, width)
            n = np.diff(of)
            some = np.flatnonzero(n)
            first = of[some]
            low = np.zeros((s.n, BITS), np.uint64)
            sums = np.zeros((s.n, 2), np.uint64)
            if len(some):
                for j in range(BITS):
                    low[some, j] = np.minimum.reduceat(g * _MULTIPLY[j] + _ADD[j], first)
                sums[some, 0] = np.add.reduceat(tb.mix(g + np.uint64(1)), first)
                sums[some, 1] = np.add.reduceat(tb.mix(g ^ np.uint64(0xA5A5A5A5A5A5A5A5)), first)
            low = tb.mix(low)
            symbols = np.ascontiguousarray((low[:, : CHUNKS * CHUNK] & np.uint64(0xFFFF)).astype("<u2"))
            bits = np.packbits((low >> np.uint64(33) & np.uint64(1)).astype(np.uint8), axis=1).view(np.int64)
            rows = symbols.view(f"V{2 * CHUNKS * CHUNK}").ravel()
            yield pa.RecordBatch.from_arrays(
                [b.column(0).slice(done, s.n), b.column(1).slice(done, s.n), pa.array(n), pa.array(sums[:, 0].view(np.int64)), pa.array(sums[:, 1].view(np.int64)), pa.array([r.tobytes() for r in rows], pa.binary()), pa.array(bits[:, 0]), pa.array(bits[:, 1])],
                names=["id", "doc_id", "n_shingles", "set_a", "set_b", "symbols", "bits_a", "bits_b"],
            )
            done += s.n

    return per_batch(docs, make, "id long, doc_id long, n_shingles long, set_a long, set_b long, symbols binary, bits_a long, bits_b long")


def chunk_keys(symbols: np.ndarray) -> np.ndarray:
    """Keys of signatures (rows of CHUNKS * CHUNK symbols): of each chunk, each symbol left out in turn."""
    x = tb.mix(symbols.astype(np.uint64) + (np.arange(CHUNKS * CHUNK, dtype=np.uint64) << np.uint64(20)))
    out = np.empty((len(symbols), CHUNKS * CHUNK), np.uint64)
    for c in range(CHUNKS):
        of_chunk = x[:, c * CHUNK : (c + 1) * CHUNK]
        total = of_chunk.sum(1, dtype=np.uint64)
        for e in range(CHUNK):
            out[:, c * CHUNK + e] = tb.mix(total - of_chunk[:, e] + np.uint64(c * CHUNK + e))
    return out


def keyed(classes: DataFrame) -> DataFrame:
    """(key, id, n, bits_a, bits_b): every key of every class."""

    def make(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        symbols = np.frombuffer(b"".join(b.column(4).to_pylist()), "<u2").reshape(b.num_rows, -1)
        keys = chunk_keys(symbols)
        m = keys.shape[1]
        take = pa.array(np.repeat(np.arange(b.num_rows), m))
        yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), *(b.column(i).take(take) for i in range(4))], names=["key", "id", "n", "bits_a", "bits_b"])

    return per_batch(classes.select("id", "n", "bits_a", "bits_b", "symbols"), make, "key long, id long, n long, bits_a long, bits_b long")


def alike(x: str, y: str, percent: int):
    """Column: sizes and one-bit minhashes of two sides allow the similarity."""
    bits = lambda c: F.bit_count(F.col(f"{x}.{c}").bitwiseXOR(F.col(f"{y}.{c}")))
    sizes = (F.col(f"{x}.n") * 100 >= F.col(f"{y}.n") * percent) & (F.col(f"{y}.n") * 100 >= F.col(f"{x}.n") * percent)
    return sizes & (bits("bits_a") + bits("bits_b") <= MOST_BITS)


def may_differ(x: str, y: str, percent: int):
    """Column: the parity sketches of two sides don't rule the similarity out. It allows a symmetric difference of (100 - p) / (100 + p) of the summed sizes."""
    flips = sum((F.bit_count(F.col(f"{x}.{c}").bitwiseXOR(F.col(f"{y}.{c}"))) for c in SKETCH[1:]), F.bit_count(F.col(f"{x}.{SKETCH[0]}").bitwiseXOR(F.col(f"{y}.{SKETCH[0]}"))))
    return flips * (100 + percent) <= (F.col(f"{x}.n") + F.col(f"{y}.n")) * (100 - percent)


def sets_of_ids(docs: DataFrame, ids: DataFrame, width: int, label: str) -> DataFrame:
    """(id, n, shingles, sketch) of the documents among the written ids; shingles are sorted as unsigned numbers."""
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)

    def make(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        done = 0
        for s in tb.slices(b.column(1), SET_BYTES):
            g, of = sets_of(s, width)
            n = np.diff(of)
            at = np.repeat(np.arange(s.n, dtype=np.int64) * PARITY, n) + (tb.mix(g) & np.uint64(PARITY - 1)).astype(np.int64)
            flips = (np.bincount(at, minlength=s.n * PARITY) & 1).astype(np.uint8).reshape(s.n, PARITY)
            sketch = np.packbits(flips, axis=1).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).slice(done, s.n), pa.array(n), pa.ListArray.from_arrays(pa.array(of.astype(np.int32)), pa.array(g.view(np.int64))), *(pa.array(np.ascontiguousarray(c)) for c in sketch.T)],
                names=["id", "n", "shingles", *SKETCH],
            )
            done += s.n

    schema = "id long, n long, shingles array<long>, " + ", ".join(f"{c} long" for c in SKETCH)
    return materialize(per_batch(docs.select("id", "text").join(ids, "id", "left_semi"), make, schema), f"{label}-sets")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int, label: str) -> DataFrame:
    """Those of the pairs (a, b) whose full sets are alike.

    The partners of an `a` lie behind its set in one stream, in blocks: its set is copied once a block, not once a pair, and no
    task holds more than one set beside that at hand.
    """
    many = materialize(pairs.groupBy("a").count().filter(f"count > {BLOCK}").select("a", F.ceil(F.col("count") / BLOCK).cast("long").alias("blocks")), f"{label}-many")
    block = F.coalesce(F.pmod(F.xxhash64("b"), F.col("blocks")), F.lit(0).cast("long")).alias("block")
    blocked = materialize(pairs.join(many, "a", "left").select("a", block, "b"), f"{label}-blocked")
    own = sets.select("id", "shingles")
    firsts = blocked.select("a", "block").distinct().join(own, F.col("a") == F.col("id")).select("a", "block", F.lit(None).cast("long").alias("b"), "shingles")
    others = blocked.join(own, F.col("b") == F.col("id")).select("a", "block", "b", "shingles")
    stream = firsts.unionByName(others).repartition("a", "block").sortWithinPartitions("a", "block", F.col("b").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(0, np.uint64)
        for batch in batches:
            a, b, lists = batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3)
            values, of = np.asarray(lists.flatten()).view(np.uint64), np.asarray(lists.offsets) - lists.offsets[0].as_py()
            found = []
            for i, y in enumerate(b):
                x = values[of[i] : of[i + 1]]
                if y is None:
                    held = x.copy()
                    continue
                few, more = (x, held) if len(x) < len(held) else (held, x)
                at = np.searchsorted(more, few)
                same = int((more[np.minimum(at, len(more) - 1)] == few).sum()) if len(more) else 0
                if 100 * same >= percent * (len(x) + len(held) - same):
                    found.append((a[i], y))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=["a", "b"])

    bound_batches(sets.sparkSession)
    return materialize(stream.mapInArrow(run, "a long, b long"), f"{label}-links")


def mixed(members: DataFrame, label: str) -> DataFrame:
    """(key, main): the keys whose members (key, component, ...) lie in more than one component, and the one with most of them."""
    sizes = members.groupBy("key", "component").agg(F.count(F.lit(1)).alias("size"))
    return materialize(sizes.groupBy("key").agg(F.max(F.struct("size", "component")).alias("main"), F.count(F.lit(1)).alias("kinds")).filter("kinds > 1").select("key", F.col("main.component").alias("main")), label)


def rare_shingles(sets: DataFrame, percent: int) -> DataFrame:
    """(id, key): of each set the shingles, in an order that all sets share and in which those of few sets come first, one of which any set alike
    must hold too: all that may be missing from it, and one. Shingles of a single set take such places but needn't be told.
    """
    each = sets.select("id", "n", F.explode("shingles").alias("key"))
    held = materialize(each.groupBy("key").count().filter("count > 1"), "near-shingles")
    known = each.join(held, "key").groupBy("id", "n").agg(F.array_sort(F.collect_list(F.struct("count", "key"))).alias("known"))
    places = F.size("known") - F.ceil(F.col("n") * percent / 100.0 - 1e-9).cast("int") + 1
    return known.filter(places > 0).select("id", F.explode(F.slice("known", F.lit(1), places)).alias("k")).select("id", "k.key")


def met_again(open_: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of open classes (id, component) that lie in different components, share a rare shingle, and may be alike."""
    members = materialize(rare_shingles(sets, percent).join(open_, "id"), "near-rare")
    main = mixed(members, "near-rare-main")
    split = materialize(members.join(main, "key").join(sets.select("id", "n", *SKETCH), "id"), "near-split")
    x, y = split.filter("component <> main").alias("x"), split.alias("y")
    sizes = (F.col("x.n") * 100 >= F.col("y.n") * percent) & (F.col("y.n") * 100 >= F.col("x.n") * percent)
    # of two that both lie outside the main component, one suffices
    once = (F.col("y.component") == F.col("y.main")) | (F.col("x.id") < F.col("y.id"))
    return x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.component") != F.col("y.component")) & once & sizes & may_differ("x", "y", percent)).select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()


def grouped(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Of documents (id, doc_id, text), written: id, doc_id, n_shingles, component: the smallest id of the component."""
    sigs = materialize(signatures(docs, width), "near-signatures")
    by_set = sigs.filter("n_shingles > 0").groupBy("set_a", "set_b", F.col("n_shingles").alias("n"))
    classes = materialize(by_set.agg(F.min("id").alias("id"), F.first("symbols").alias("symbols"), F.first("bits_a").alias("bits_a"), F.first("bits_b").alias("bits_b")), "near-classes")
    # keys that more than one class has, and their members
    keys = keyed(classes)
    shared = materialize(keys.groupBy("key").count().filter("count > 1"), "near-keys")
    members = materialize(keys.join(shared, "key"), "near-members")
    # first each member against the heads of its key
    popular = materialize(members.groupBy("id").agg(F.sum("count").alias("met")), "near-popular")
    fields = ("id", "n", "bits_a", "bits_b")
    rank = lambda j: F.min(F.struct(F.xxhash64(F.lit(j), "id").alias("r"), *fields)).alias(f"h{j}")
    heads = materialize(members.join(popular, "id").groupBy("key").agg(F.max(F.struct("met", *fields)).alias("top"), *(rank(j) for j in range(HEADS))), "near-heads")
    head = F.explode(F.array(*(F.struct(*(f"{h}.{c}" for c in fields)) for h in ("top", *(f"h{j}" for j in range(HEADS)))))).alias("h")
    met = members.join(heads, "key").select(F.struct(*fields).alias("m"), head)
    first = materialize(met.filter((F.col("m.id") != F.col("h.id")) & alike("m", "h", percent)).select(F.col("h.id").alias("a"), F.col("m.id").alias("b")).distinct(), "near-first")
    ids = materialize(first.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "near-first-ids")
    links = confirmed(first, sets_of_ids(docs, ids, width, "near-first"), percent, "near-first")
    found = components(links, "near-first")
    # then the classes of keys whose members lie in several components
    placed = materialize(members.select("key", "id").join(found.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id")), "near-placed")
    open_ = materialize(placed.join(mixed(placed, "near-main").select("key"), "key", "left_semi").select("id", "component").distinct(), "near-open")
    if not open_.isEmpty():
        sets = sets_of_ids(docs, open_.select("id"), width, "near-open")
        second = materialize(met_again(open_, sets, percent).join(first, ["a", "b"], "left_anti"), "near-second")
        if not second.isEmpty():
            links = materialize(links.unionByName(confirmed(second, sets, percent, "near-second")), "near-links")
            found = components(links, "near-second")
    # back to the documents, by way of the classes
    of_class = classes.select("set_a", "set_b", "n", "id").join(found.withColumnRenamed("node", "id"), "id", "left")
    of_class = materialize(of_class.select("set_a", "set_b", F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component")), "near-placed-classes")
    own = sigs.select("id", "doc_id", "n_shingles", "set_a", "set_b")
    return own.join(of_class, ["set_a", "set_b", "n_shingles"], "left").select("id", "doc_id", "n_shingles", F.coalesce("component", "id").alias("component"))


def near_duplicates(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    rows = grouped(numbered(texts(docs), "id").select("id", "doc_id", "text"), width, percent)
    if rows.filter(f"id >= {GIVEN}").isEmpty():
        rows = rows.withColumnRenamed("component", "component_id")
    else:
        rows = materialize(rows, "near-rows")
        names = materialize(rows.groupBy("component").agg(F.min("doc_id").alias("component_id")), "near-names")
        rows = rows.join(names, "component")
    return rows.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def one_of_each(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """The documents, with all their columns, less all but one of each component: the one with the smallest doc_id stays, of repeated rows any one."""
    name = "row_number"
    while name in docs.columns:
        name += "_"
    whole = numbered(docs, name)
    rows = materialize(grouped(whole.select(F.col(name).alias("id"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), width, percent).filter("n_shingles > 0"), "near-rows")
    left = without(whole, name, rows.filter("id <> component").select("id"))
    # repeated rows share a number
    again = materialize(rows.filter("id = component").groupBy("id").count().filter("count > 1").select("id"), "near-again")
    if not again.isEmpty():
        one = left.join(again, left[name] == again["id"], "left_semi").dropDuplicates([name])
        left = left.join(again, left[name] == again["id"], "left_anti").unionByName(one)
    return left.drop(name)
