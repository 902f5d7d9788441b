"""Language identification by interpolated Kneser-Ney character models.

One model a language, over lower-cased letters with a space on either side of a word. Counts of all orders
are gathered from a bounded sample of labelled rows, turned into interpolated Kneser-Ney probabilities, and
stored in one sorted array of n-gram hashes with a column a language. A text takes the language of the
lowest cross-entropy a character.

Rejection is calibrated on labelled texts that the models haven't seen, a share of the sample chosen by a hash of the text. Their cross-entropy
under their own language's model has a mean and a variance of two parts, one between texts and one that falls with a text's length; a text is rejected
that lies further above the mean, in those units, than all but REJECT_SHARE of the calibration texts, by the factor REJECT_SLACK.

Defined results: null text, and text without a letter, is `und` with score 0, and rejected. Ties go to the
language first in sorted order. Rows are judged one by one; repeated rows get equal results. Columns lang, source
and doc_id are never inputs of a prediction; others are ignored. Without labelled rows, as in an empty table, every text is `und`. A very
long text is judged as a whole; as a row to learn from it is passed over if it alone exceeds the sample's bytes.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lineloom.llm import textbytes as tb
from lineloom.llm.rows import per_batch
from lineloom.storage import materialize

ORDER = 4
#: The bounds of the sample that the model is fitted on: expected labelled rows of each language, bytes of each language, and bytes of all together.
SAMPLE_ROWS, SAMPLE_BYTES, TOTAL_BYTES = 1500, 8 << 20, 48 << 20
#: One in so many sampled texts calibrates the rejection.
CALIBRATE = 4
#: Share of the calibration texts that may lie beyond the bound, and the factor by which it is then widened.
REJECT_SHARE, REJECT_SLACK = 1e-3, 2.5
#: Standard deviations that the bound holds at least before it is widened, however few texts calibrate it.
LEAST_REACH = 4.0
#: The least standard deviation of a text's cross-entropy in nats, between texts and for a single character.
LEAST_BETWEEN, LEAST_WITHIN = 0.1, 2.0
#: Posterior sharpness a character.
TEMPERATURE = 25.0
UNKNOWN = "und"
#: Probability of a character that no training text has, below all n-grams.
UNSEEN = 1e-4
_SPACE = 0x20
#: Bytes of texts that are judged at once: their characters and counts take some 60 times as much.
TEXT_BYTES = 1 << 18


@functools.cache
def _fold(digits: bool = False) -> np.ndarray:
    """Code point to its lower-case letter, or to a space if it is no letter (nor digit, if these are kept)."""
    out = np.full(0x110000, _SPACE, np.uint32)
    for c in range(0x110000):
        if not 0xD800 <= c < 0xE000 and ((ch := chr(c)).isalpha() or digits and ch.isdigit()):
            low = ch.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


@dataclass
class Chars:
    """Distinct words of some documents: chars holds ' word ' after ' word '; uses says which document has which word."""

    chars: np.ndarray
    first: np.ndarray  # of each distinct word in chars, and the end
    doc: np.ndarray  # document of each use
    word: np.ndarray  # distinct word of each use
    n_docs: int


def distinct_words(texts: list[str | None], digits: bool = False) -> Chars:
    """Folded words of texts, each distinct one once."""
    raw = [(t or "") + " " for t in texts]
    codes = _fold(digits)[np.frombuffer("".join(raw).encode("utf-32-le", "surrogatepass"), np.uint32)]
    edge = np.cumsum([0, *map(len, raw)])
    letter = codes != _SPACE
    before = np.concatenate(([False], letter[:-1]))
    starts = np.flatnonzero(letter & ~before)
    ends = np.flatnonzero(~letter & before)
    doc = np.searchsorted(edge, starts, "right") - 1
    p, inv = tb.powers(len(codes) + 1)
    h = np.concatenate((np.zeros(1, np.uint64), np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * p[:-1])))
    hashes = tb.mix((h[ends] - h[starts]) * inv[starts] + (ends - starts).astype(np.uint64))
    _, one, word = np.unique(hashes, return_index=True, return_inverse=True)
    size = ends[one] - starts[one] + 2
    first = np.concatenate(([0], np.cumsum(size)))
    inner = np.arange(first[-1]) - np.repeat(first[:-1], size)
    at = np.repeat(starts[one] - 1, size) + inner
    chars = np.where((inner == 0) | (inner == np.repeat(size - 1, size)), _SPACE, codes[np.clip(at, 0, max(len(codes) - 1, 0))] if len(codes) else 0).astype(np.uint32)
    return Chars(chars, first, doc, word, len(texts))


def runs(texts: list[str | None], most: int = tb.SLICE_BYTES // 2) -> Iterator[slice]:
    """Runs of texts of at most `most` characters together, or one longer text."""
    lo = size = 0
    for hi, t in enumerate(texts):
        n = len(t or "")
        if hi > lo and size + n > most:
            yield slice(lo, hi)
            lo, size = hi, 0
        size += n
    if lo < len(texts):
        yield slice(lo, len(texts))


def all_distinct_words(texts: list[str | None], digits: bool = False) -> Chars:
    """distinct_words of many texts, a run at a time, so that no more than a run's characters are held at once."""
    place: dict[bytes, int] = {}
    docs, words = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
    for r in runs(texts):
        c = distinct_words(texts[r], digits)
        edges = (4 * c.first).tolist()
        raw = c.chars.tobytes()
        own = np.array([place.setdefault(raw[a:b], len(place)) for a, b in zip(edges[:-1], edges[1:], strict=True)], np.int32)
        docs.append((c.doc + r.start).astype(np.int32))
        words.append(own[c.word] if len(own) else np.zeros(0, np.int32))
    first = np.concatenate(([0], np.cumsum([len(w) // 4 for w in place], dtype=np.int64)))
    return Chars(np.frombuffer(b"".join(place), np.uint32), first, np.concatenate(docs), np.concatenate(words), len(texts))


def gram_hashes(c: Chars, order: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(k, position of the last character, hash) of all k-grams within words, k = 1..order. The leading space is context only."""
    inner = np.arange(len(c.chars)) - np.repeat(c.first[:-1], np.diff(c.first))
    h = np.zeros(len(c.chars), np.uint64)
    for k in range(1, order + 1):
        at = np.flatnonzero(inner >= k - 1)
        g = np.zeros(len(at), np.uint64)
        for i in range(k):
            g = g * np.uint64(0x100000001B3) + (c.chars[at - (k - 1) + i].astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        h = tb.mix(g + np.uint64(k))
        yield k, at, h


@dataclass
class Model:
    """keys: sorted hashes of all n-grams. gain, back: a row a key and a column a language. directory: first key of each top-bits bucket."""

    langs: list[str]
    order: int
    keys: np.ndarray
    gain: np.ndarray
    back: np.ndarray
    root: np.ndarray
    directory: np.ndarray
    shift: int
    floor: np.ndarray
    mean: np.ndarray  # of each language: the cross-entropy of its texts,
    between: np.ndarray  # its variance between texts,
    within: np.ndarray  # its variance for a single character,
    reach: np.ndarray  # and the standard deviations above which texts are rejected

    def find(self, h: np.ndarray) -> np.ndarray:
        """Index of each hash in keys, or len(keys)."""
        bucket = (h >> np.uint64(self.shift)).astype(np.int64)
        at, end = self.directory[bucket], self.directory[bucket + 1]
        out = np.full(len(h), len(self.keys))
        open_ = np.flatnonzero(at < end)
        while len(open_):
            a = at[open_]
            hit = self.keys[a] == h[open_]
            out[open_[hit]] = a[hit]
            at[open_] = a + 1
            open_ = open_[~hit & (a + 1 < end[open_])]
        return out

    def word_scores(self, c: Chars) -> tuple[np.ndarray, np.ndarray]:
        """Of each distinct word: log-probabilities by language, and the number of characters scored (its letters and the space after)."""
        n, m = len(c.chars), len(self.langs)
        p = np.broadcast_to(self.floor, (n, m)).copy()
        context = np.full(n, len(self.keys))  # of the (k-1)-gram that ends just before
        for k, at, h in gram_hashes(c, self.order):
            found = self.find(h)
            if k == 1:
                p[at] = self.gain[found] + self.root * self.floor
            else:
                p[at] = self.gain[found] + self.back[context[at - 1]] * p[at]
            context = np.full(n, len(self.keys))
            context[at] = found
        logp = np.log(p)
        logp[c.first[:-1]] = 0.0
        return np.add.reduceat(logp, c.first[:-1], axis=0) if len(c.first) > 1 else np.zeros((0, m)), np.diff(c.first) - 1

    def entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy a character by language of each text, and its number of characters."""
        c = distinct_words(texts)
        m = len(self.langs)
        if not len(c.word):
            return np.zeros((len(texts), m)), np.zeros(len(texts), np.int64)
        scores, sizes = self.word_scores(c)
        total = np.stack([np.bincount(c.doc, scores[c.word, j], len(texts)) for j in range(m)], 1)
        n = np.bincount(c.doc, sizes[c.word], len(texts)).astype(np.int64)
        return -total / np.maximum(n, 1)[:, None], n

    def deviations(self, e: np.ndarray, n: np.ndarray, language: np.ndarray | int) -> np.ndarray:
        """Standard deviations by which texts of n characters lie above their language's mean."""
        return (e - self.mean[language]) / np.sqrt(self.between[language] + self.within[language] / np.maximum(n, 1))

    def calibrate(self, j: int, texts: list[str]) -> None:
        """Set the rejection of language j from texts of it that the model hasn't seen."""
        parts = [self.entropies(texts[r]) for r in runs(texts)]
        if not parts:
            return
        every, n = np.concatenate([x for x, _ in parts]), np.concatenate([x for _, x in parts])
        own = (n > 0) & (every.argmin(1) == j)  # the others are labelled wrongly, more likely than not
        e, n = every[own, j], n[own]
        if not len(e):
            return
        self.mean[j] = np.average(e, weights=np.minimum(n, 1000))
        # squared distances are between + within / n: a line in 1 / n, fitted with weights for texts of many characters
        x, y = 1.0 / n, (e - self.mean[j]) ** 2
        weight = np.minimum(n, 1000.0)
        mx, my = np.average(x, weights=weight), np.average(y, weights=weight)
        spread = np.average((x - mx) ** 2, weights=weight)
        slope = max(np.average((x - mx) * (y - my), weights=weight) / spread, 0.0) if spread > 1e-12 else 0.0
        self.within[j] = max(slope, LEAST_WITHIN**2)
        self.between[j] = max(my - slope * mx, LEAST_BETWEEN**2)
        self.reach[j] = REJECT_SLACK * max(np.quantile(self.deviations(e, n, j), 1 - REJECT_SHARE), LEAST_REACH)

    def predict(self, texts: list[str | None], sharpness: float = TEMPERATURE) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and rejection of each text."""
        if not self.langs:
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        e, n = self.entropies(texts)
        best = e.argmin(1)
        z = np.exp(-sharpness * (e - e.min(1, keepdims=True)))
        score = z.max(1) / z.sum(1)
        rejected = (n == 0) | (self.deviations(e[np.arange(len(texts)), best], n, best) > self.reach[best])
        return [UNKNOWN if k == 0 else self.langs[b] for k, b in zip(n, best, strict=True)], np.where(n == 0, 0.0, score), rejected


def learned(texts: dict[str, list[str]], order: int = ORDER) -> Model:
    """Models fitted on some of each language's texts and calibrated on the others, or on all of them where there is nothing on one side."""
    apart = {k: [zlib.crc32(t.encode("utf-8", "surrogatepass")) % CALIBRATE == 0 for t in v] for k, v in texts.items()}
    pick = lambda k, side: [t for t, x in zip(texts[k], apart[k], strict=True) if x == side] or texts[k]
    return fit({k: pick(k, False) for k in texts}, order, {k: pick(k, True) for k in texts})


def fit(texts: dict[str, list[str]], order: int = ORDER, calibration: dict[str, list[str]] | None = None) -> Model:
    """Interpolated Kneser-Ney models of the languages from their texts, with absolute discounts n1 / (n1 + 2 n2)."""
    langs = sorted(texts)
    m = len(langs)
    counts: list[dict] = []
    empty = (np.zeros(0, np.uint64),) * 3 + (np.zeros(0),)
    for lang in langs:
        grams = dict.fromkeys(range(1, order + 1), empty)
        for lo in range(0, len(texts[lang]), 50):
            c = distinct_words(texts[lang][lo : lo + 50])
            if not len(c.word):
                continue
            uses = np.bincount(c.word, minlength=len(c.first) - 1)
            owner = np.repeat(np.arange(len(c.first) - 1), np.diff(c.first))
            shorter = np.zeros(len(c.chars), np.uint64)
            for k, at, h in gram_hashes(c, order):
                # context: the (k-1)-gram that ends one before; suffix: the (k-1)-gram that ends here
                ctx = shorter[at - 1] if k > 1 else np.zeros(len(at), np.uint64)
                suffix = shorter[at] if k > 1 else np.zeros(len(at), np.uint64)
                own = at > c.first[owner[at]] if k == 1 else np.ones(len(at), bool)  # the leading space isn't predicted
                shorter = np.zeros(len(c.chars), np.uint64)
                shorter[at] = h
                u0, c0, s0, n0 = grams[k]
                u, one, inv = np.unique(np.concatenate((u0, h[own])), return_index=True, return_inverse=True)
                grams[k] = (u, np.concatenate((c0, ctx[own]))[one], np.concatenate((s0, suffix[own]))[one], np.bincount(inv, np.concatenate((n0, uses[owner[at]][own]))))
        counts.append(grams)
    gains: list[tuple] = []
    for j, grams in enumerate(counts):
        for k in range(order, 0, -1):
            u, ctx, _, n = grams[k]
            if k < order and len(u):  # continuation counts: distinct characters seen before the k-gram
                longer = grams[k + 1][2]
                su, sc = np.unique(longer, return_counts=True)
                at = np.searchsorted(su, u)
                hit = (at < len(su)) & (su[np.minimum(at, len(su) - 1)] == u) if len(su) else np.zeros(len(u), bool)
                n = np.where(hit, sc[np.minimum(at, max(len(su) - 1, 0))] if len(su) else 0, n)  # word-initial k-grams have no longer one: their counts stay
            n1, n2 = (n == 1).sum(), (n == 2).sum()
            d = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
            cu, ci = np.unique(ctx, return_inverse=True)
            if not len(u):
                continue
            total = np.bincount(ci, n)
            kinds = np.bincount(ci)
            gains.append((j, k, u, np.maximum(n - d, 0) / total[ci], cu, d * kinds / total, n))
    kept = [np.concatenate((u, cu)) for _, _, u, _, cu, *_ in gains]
    keys = np.unique(np.concatenate(kept)) if kept else np.zeros(0, np.uint64)
    keys = keys[keys != 0]
    # the last row is for an n-gram or context never seen: nothing gained, full weight to the shorter context
    gain = np.zeros((len(keys) + 1, m), np.float32)
    back = np.ones((len(keys) + 1, m), np.float32)
    root = np.ones(m, np.float32)

    def put(column: np.ndarray, j: int, h: np.ndarray, values: np.ndarray) -> None:
        at = np.searchsorted(keys, h)
        ok = (at < len(keys)) & (keys[np.minimum(at, len(keys) - 1)] == h)
        column[at[ok], j] = values[ok]

    for j, _, u, g, cu, b, _ in gains:
        if len(keys):
            put(gain, j, u, g)
            put(back, j, cu, b)
        if (cu == 0).any():
            root[j] = b[cu == 0][0]
    bits = max(1, min(20, len(keys).bit_length()))
    directory = np.concatenate((np.searchsorted(keys, np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)), [len(keys)]))
    model = Model(langs, order, keys, gain, back, root, directory, 64 - bits, np.full(m, UNSEEN, np.float32), np.zeros(m), np.ones(m), np.ones(m), np.full(m, np.inf))
    for j, lang in enumerate(langs):
        model.calibrate(j, (calibration or texts)[lang])
    return model


def held_out(modulus: int = 4, remainder: int = 2):
    """Column: crc32 of doc_id as text leaves the remainder. Rows with a null doc_id are not held out."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(modulus)) == remainder, F.lit(False))


def sample(docs: DataFrame, rows: int = SAMPLE_ROWS, most: int = SAMPLE_BYTES, total: int = TOTAL_BYTES) -> dict[str, list[str]]:
    """Texts of labelled rows by language: all rows of a language with fewer, else a hash-chosen share of that expected size, up to the bytes allowed."""
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out()).select("doc_id", "text", "lang")
    counts = known.groupBy("lang").count().collect()
    if not counts:
        return {}
    most = min(most, total // len(counts))
    share = F.lit(0.0)
    for r in counts:
        share = F.when(F.col("lang") == r["lang"], min(1.0, rows / r["count"])).otherwise(share)
    draw = F.pmod(F.xxhash64(F.lit("language sample"), "doc_id", "text"), F.lit(1 << 30)) / float(1 << 30)
    size = F.octet_length("text").cast("long")
    drawn = known.filter((draw < share) & (size <= most)).select("lang", "text", F.xxhash64("doc_id", "text").alias("place"), size.alias("size"))
    before = F.sum("size").over(Window.partitionBy("lang").orderBy("place").rowsBetween(Window.unboundedPreceding, -1))
    drawn = drawn.withColumn("before", F.coalesce(before, F.lit(0))).filter(F.col("before") + F.col("size") <= most)
    out: dict[str, list[str]] = {}
    for r in drawn.orderBy("lang", "place").select("lang", "text").toLocalIterator():
        out.setdefault(r["lang"], []).append(r["text"])
    return out


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score, rejected."""
    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model or learned(sample(picked)))

    def make(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        m, done, column = shared.value, 0, b.column(2)
        for s in tb.slices(column, TEXT_BYTES):
            pred, score, rejected = m.predict(column.slice(done, s.n).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0).slice(done, s.n), b.column(1).slice(done, s.n), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], names=["doc_id", "held_out", "lang_pred", "score", "rejected"])
            done += s.n

    return per_batch(picked.select("doc_id", held_out().alias("held_out"), "text"), make, "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")


#: Rejected texts are broadcast as two hashes each up to so many; beyond, documents are shuffled to them.
BROADCAST_TEXTS = 1_000_000


def in_known_language(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """The documents that aren't rejected, with all their columns as they are.

    Whether a text is rejected hangs on nothing else, so only hashes of rejected texts leave Python, and the documents are filtered
    natively. Documents of one rejected text go together; null texts go.
    """
    text = F.col("text").cast("string")
    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), text.alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model or learned(sample(picked)))

    def make(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        done = 0
        for s in tb.slices(b.column(2), TEXT_BYTES):
            rows = b.slice(done, s.n)
            _, _, rejected = shared.value.predict(rows.column(2).to_pylist())
            yield rows.select([0, 1]).filter(pa.array(rejected))
            done += s.n

    h1, h2 = F.xxhash64(text), F.xxhash64(F.lit("second"), text)
    whole = docs.filter(text.isNotNull())
    gone = per_batch(whole.select(h1.alias("h1"), h2.alias("h2"), text.alias("text")), make, "h1 long, h2 long").distinct()
    gone = materialize(gone, "rejected-texts")
    if gone.count() <= BROADCAST_TEXTS:
        gone = F.broadcast(gone)
    return whole.join(gone, (h1 == gone["h1"]) & (h2 == gone["h2"]), "left_anti")
