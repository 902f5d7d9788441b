"""Benchmark decontamination by template canonicalisation.

Texts become sequences of lower-cased words in which numbers, units after numbers, and names (capitalised words within a
sentence) are typed placeholders. Windows of such templates are hash-joined between documents and benchmark items;
hits are grouped by diagonal, and a document holds an item if its windows cover enough of the item's words. The values that stand
in the placeholders, of each place those nearest to the heaviest diagonal, are then held against each other: where the item repeats a value the document must repeat one too, so
a question with other numbers or names is caught as re-parameterised, and a chance likeness of form is not. Windows are
also joined as they stand, so that a plain copy is found whatever its capitals, and whatever its templates would match besides.

A word that opens a sentence has a capital whatever it is. So a window with such a word stands in a third form too, with the
opening as a name. An item is found if its windows with those of the third form cover enough of it and their slots agree, or if those without do. Items of fewer words than a window are one window of their own width.
Windows of placeholders alone have no word to go by, and are joined as they stand only.

Defined results: null or empty text, and items without a word, match nothing. Rows that share doc_id and text
give the same pairs once. Items with a null text or id are left out; of items that share an item_id each text is held against the documents. Other columns of
either table are ignored, and an empty table gives no pairs. A very long text is taken by itself. Every pair is judged by itself; of several places of an
item in a document, and of several texts of an item, a plain copy goes first, then the widest coverage, then the first place.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lineloom.llm import textbytes as tb
from lineloom.llm.rows import per_batch, texts
from lineloom.storage import materialize

WIDTH = 5
MIN_COVERAGE = 0.8
MERGE_GAP = 8
#: Windows of the benchmark are broadcast up to so many (some 12 bytes each, in all 24 MB); beyond, all windows are shuffled to them.
BROADCAST_WINDOWS = 2_000_000

UNITS = "% km m cm mm mi mile miles ft feet inch inches kg g mg lb lbs ton tons l ml liter liters litre litres s sec secs second seconds min mins minute minutes h hr hrs hour hours day days week weeks month months year years usd eur gbp dollar dollars euro euros pound pounds cent cents percent mph kmh kph degrees celsius fahrenheit hz khz mhz ghz kb mb gb tb watt watts kw volt volts".split()

WORDLIKE = tb.table((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
_DIGIT = tb.table((0x30, 0x39))
_CAPITAL = tb.table((0x41, 0x5A))
_STOP = tb.table((0x0A, 0x0A), (0x21, 0x21), (0x2E, 0x2E), (0x3A, 0x3B), (0x3F, 0x3F))
LITERAL, NUMBER, UNIT, NAME = range(4)
#: Marks the third form among the kinds of a window.
NAMED = 1 << 60
_HOLDER = np.array([0, 0x1111111111111111, 0x2222222222222222, 0x3333333333333333], np.uint64)


def _word_hashes(words: list[str]) -> np.ndarray:
    s = next(tb.slices(pa.array([" ".join(words)])))
    w = tb.words(s, s.data, WORDLIKE)
    return np.sort(tb.span_hash(tb.prefix_hash(s.data), w.starts, w.ends))


_UNITS = _word_hashes([u for u in UNITS if u != "%"])


def canonical(s: tb.Slice) -> tuple[tb.Words, np.ndarray, np.ndarray, np.ndarray]:
    """Words, the hashes of their values, their kinds, and their kinds with capitalised openings of sentences as names."""
    data = tb.LOWER[s.data]
    w = tb.words(s, data, WORDLIKE)
    n = len(w.starts)
    value = tb.span_hash(tb.prefix_hash(data), w.starts, w.ends)
    kind = np.zeros(n, np.int8)
    if not n:
        return w, value, kind, kind
    count = lambda t: np.concatenate(([0], np.cumsum(t[s.data], dtype=np.int64)))
    digits, capitals, stops = count(_DIGIT), count(_CAPITAL), count(_STOP)
    size = w.ends - w.starts
    number = digits[w.ends] - digits[w.starts] == size
    first = np.zeros(n, bool)
    first[w.of[:-1][w.counts > 0]] = True
    opens = first.copy()  # opens a sentence
    opens[1:] |= stops[w.starts[1:]] > stops[w.ends[:-1]]
    lead, second = s.data[w.starts], s.data[np.minimum(w.starts + 1, len(s.data) - 1)]
    capital = _CAPITAL[lead] | (lead == 0xC3) & (second >= 0x80) & (second <= 0x9E)
    name = capital & (capitals[w.ends] - capitals[w.starts] <= 1)
    at = np.minimum(np.searchsorted(_UNITS, value), len(_UNITS) - 1)
    unit = np.zeros(n, bool)
    unit[1:] = (_UNITS[at[1:]] == value[1:]) & number[:-1] & ~first[1:]
    kind[name & ~opens], kind[unit], kind[number] = NAME, UNIT, NUMBER
    return w, value, kind, np.where((kind == LITERAL) & name, np.int8(NAME), kind)


class Filter:
    """Membership of hashes: a bitmap of their lower bits first, then the sorted array."""

    def __init__(self, hashes: np.ndarray):
        self.sorted = np.unique(hashes)
        self.mask = np.uint64((1 << max(16, int(len(self.sorted) * 16).bit_length())) - 1)
        self.bitmap = np.zeros((int(self.mask) + 1) // 8, np.uint8)
        low = self.sorted & self.mask
        np.bitwise_or.at(self.bitmap, low >> np.uint64(3), np.uint8(1) << (low & np.uint64(7)).astype(np.uint8))

    def find(self, h: np.ndarray) -> np.ndarray:
        low = h & self.mask
        maybe = np.flatnonzero(self.bitmap[low >> np.uint64(3)] >> (low & np.uint64(7)).astype(np.uint8) & np.uint8(1))
        at = np.minimum(np.searchsorted(self.sorted, h[maybe]), max(len(self.sorted) - 1, 0))
        return maybe[self.sorted[at] == h[maybe]] if len(self.sorted) else maybe[:0]


def windows(rows: DataFrame, width: int, widths: list[int] | None = None, known: Filter | None = None) -> DataFrame:
    """Of rows (id, text_hash, text): (id, text_hash, n_words, window, pos, kinds, values), of known windows only if these are given.

    Without widths each text has windows of `width` words, or is one window if it has fewer; else all windows of these widths. Each
    window stands there as it is, with kinds 0, and, where it has placeholders and a word, as a template of either form. values: hashes of
    the words in the window's places; kinds: four bits a word, and NAMED for the form with openings as names.
    """
    shared = rows.sparkSession.sparkContext.broadcast(known)

    def make(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        done = 0
        for s in tb.slices(b.column(2)):
            w, value, kind, named = canonical(s)
            for k in widths if widths is not None else range(1, width + 1):
                plain, at = tb.shingles(s, w, value, k)
                doc = np.searchsorted(w.of, at, "right") - 1
                if widths is None:
                    own = np.minimum(w.counts[doc], width) == k
                    plain, at, doc = plain[own], at[own], doc[own]
                places = at[:, None] + np.arange(k)
                grams, takes, packed = [plain], [np.arange(len(at))], [np.zeros(len(at), np.int64)]
                for kinds in (kind, named):
                    here = kinds[places]
                    holders = (here != LITERAL).sum(1)
                    ok = (holders > 0) & (holders < k)
                    if kinds is named:
                        ok &= (here != kind[places]).any(1)
                    form, first = tb.shingles(s, w, np.where(kinds == LITERAL, value, _HOLDER[kinds]), k)
                    grams.append(form[np.searchsorted(first, at[ok])])
                    takes.append(np.flatnonzero(ok))
                    packed.append((here[ok].astype(np.int64) << (4 * np.arange(k))).sum(1) + (NAMED if kinds is named else 0))
                g, t, p = np.concatenate(grams), np.concatenate(takes), np.concatenate(packed)
                if shared.value is not None:
                    hit = shared.value.find(g)
                    g, t, p = g[hit], t[hit], p[hit]
                values = pa.ListArray.from_arrays(pa.array((np.arange(len(t) + 1) * k).astype(np.int32)), pa.array(value[places[t]].ravel().view(np.int64)))
                take = pa.array(doc[t] + done)
                yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), pa.array(w.counts[doc[t]]), pa.array(g.view(np.int64)), pa.array(at[t] - w.of[doc[t]]), pa.array(p), values], names=["id", "text_hash", "n_words", "window", "pos", "kinds", "values"])
            done += s.n

    return per_batch(rows, make, "id long, text_hash long, n_words long, window long, pos long, kinds long, values array<long>")


def contaminated(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, coverage: float = MIN_COVERAGE, gap: int = MERGE_GAP) -> DataFrame:
    """Pairs found: doc_id, item_id, coverage, first_word, last_word, n_slots, reparameterised (not a plain copy, and a slot holds another value)."""
    items = benchmark.select(F.col("item_id").cast("long").alias("id"), F.col("text").cast("string").alias("text")).filter("id is not null and text is not null").distinct()
    held = materialize(windows(items.select("id", F.xxhash64("text").alias("text_hash"), "text"), width), "decontaminate-items")
    known = None
    if held.count() <= BROADCAST_WINDOWS:
        known = Filter(np.asarray(held.select("window").distinct().toArrow().column(0).combine_chunks()).view(np.uint64))
    widths = sorted(r[0] for r in held.select(F.least(F.lit(width).cast("long"), "n_words")).distinct().collect())
    rows = texts(docs).filter("doc_id is not null").select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("text_hash"), "text")
    x = windows(rows, width, widths, known).alias("x")
    y = held.select(F.col("id").alias("item_id"), F.col("text_hash").alias("item_hash"), "window", F.col("n_words").alias("item_words"), F.col("pos").alias("item_pos"), F.col("values").alias("item_values"), F.col("kinds").alias("item_kinds")).alias("y")
    named = (F.col("kinds") >= NAMED) | (F.col("item_kinds") >= NAMED)
    joined = x.join(y, "window").filter((F.col("kinds").bitwiseXOR(F.col("item_kinds")).bitwiseAND(F.lit(NAMED - 1)) == 0) & (F.size("values") == F.size("item_values")))
    # values of the placeholders: (item's, document's), and where in the item
    slot = F.filter(F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.struct((F.col("item_pos") + i).alias("at"), F.call_function("shiftright", F.col("kinds"), i * 4).bitwiseAND(F.lit(15).cast("long")).alias("kind"), F.get("item_values", i).alias("item"), F.get("values", i).alias("doc"), named.alias("named"))), lambda z: z["kind"] != 0)
    hits = joined.select(F.col("id").alias("doc_id"), "text_hash", "item_id", "item_hash", "item_words", "item_pos", "pos", (F.col("kinds") == 0).alias("plain"), named.alias("named"), slot.alias("slots"))
    key = ["doc_id", "text_hash", "item_id", "item_hash", "item_words"]
    span = F.least(F.lit(width).cast("long"), "item_words")
    votes = materialize(hits.groupBy(*key, (F.col("pos") - F.col("item_pos")).alias("diagonal")).agg(F.collect_set("item_pos").alias("held"), F.collect_set(F.when(~F.col("named"), F.col("item_pos"))).alias("held_first"), F.collect_set(F.when(F.col("plain"), F.col("item_pos"))).alias("held_plain"), F.min("pos").alias("lo"), F.max("pos").alias("hi"), F.array_distinct(F.flatten(F.collect_set("slots"))).alias("slots")), "decontaminate-votes")  # read twice below
    by = Window.partitionBy(*key).orderBy("diagonal")
    runs = votes.withColumn("run", F.sum(F.coalesce((F.col("diagonal") - F.lag("diagonal").over(by) > gap).cast("int"), F.lit(1))).over(by))
    all_of = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
    merged = runs.groupBy(*key, "run").agg(all_of("held"), all_of("held_first"), all_of("held_plain"), F.min("lo").alias("first_word"), (F.max("hi") + F.max(span) - 1).alias("last_word"))
    # of each of the item's places the slot on the diagonal nearest to the run's main one: a phrase that recurs nearby hits others too
    held_here = F.size("held")
    main = F.max(F.struct(held_here.alias("size"), (-F.col("diagonal")).alias("r"))).over(Window.partitionBy(*key, "run"))
    each = runs.select(*key, "run", "diagonal", held_here.alias("size"), (-main["r"]).alias("main"), F.explode("slots").alias("s"))
    nearest = F.struct(F.abs(F.col("diagonal") - F.col("main")).alias("far"), (-F.col("size")).alias("r"), "diagonal", F.col("s").alias("slot"))
    aligned = each.groupBy(*key, "run", F.col("s.at").alias("at")).agg(F.min(nearest).alias("x"), F.min(F.when(~F.col("s.named"), nearest)).alias("y"))
    aligned = aligned.groupBy(*key, "run").agg(F.collect_list("x.slot").alias("slots"), F.collect_list("y.slot").alias("slots_first"))
    no_slots = F.array().cast(dict(votes.dtypes)["slots"])
    merged = merged.join(aligned, [*key, "run"], "left").withColumn("slots", F.coalesce("slots", no_slots)).withColumn("slots_first", F.coalesce("slots_first", no_slots))
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-width).cast("long").alias("last"))
    step = lambda a, p: F.struct((a["n"] + F.least(span, p - a["last"])).alias("n"), p.alias("last"))
    share = lambda c: F.aggregate(c, zero, step, lambda a: a["n"]) / F.col("item_words")

    def consistent(slots: str):
        """Column: one document's value for each of the item's values."""
        pairs = F.array_distinct(F.transform(slots, lambda z: F.struct(z["kind"], z["item"], z["doc"])))
        return F.size(F.array_distinct(F.transform(pairs, lambda z: F.struct(z["kind"], z["item"])))) == F.size(pairs)

    plain = share("held_plain") >= coverage
    first = (share("held_first") >= coverage) & consistent("slots_first")
    every = (share("held") >= coverage) & consistent("slots")
    told = F.when(every, F.col("slots")).otherwise(F.col("slots_first"))
    judged = merged.select(*key, share("held").alias("coverage"), "first_word", "last_word", told.alias("slots"), plain.alias("plain"), (plain | first | every).alias("found")).filter("found")
    changed = F.exists("slots", lambda z: z["item"] != z["doc"])
    found = judged.select(*key, "coverage", "first_word", "last_word", F.size(F.array_distinct(F.transform("slots", lambda z: z["at"]))).alias("n_slots"), "plain", (~F.col("plain") & changed).alias("reparameterised"))
    best = found.groupBy("doc_id", "item_id").agg(F.max(F.struct("plain", "coverage", (-F.col("first_word")).alias("r"), "last_word", "n_slots", "reparameterised")).alias("b"))
    return best.select("doc_id", "item_id", "b.coverage", (-F.col("b.r")).alias("first_word"), "b.last_word", "b.n_slots", "b.reparameterised")
