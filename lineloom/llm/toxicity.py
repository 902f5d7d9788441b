"""Toxicity by subword-bag embeddings.

A word's vector is the mean of its character n-grams' vectors (hashed into buckets, the whole word being one
of them); a bag's is the mean of its words' vectors; a linear softmax of two classes over it tells toxic from not, as a
logit: the difference of the classes' weights. Vectors and softmax are trained together in numpy. The bags are windows of a
text, since a few words among very many leave no trace in the mean of a whole text: a text's logit is that of its most toxic window, and a
logistic curve over it, fitted on labelled rows that the vectors haven't seen, gives the score. Spellings never seen share n-grams with those seen.

Defined results: null or empty text, or text without a letter or digit, is scored as the median clean text. Rows
are judged one by one; repeated rows get equal scores, and ties between windows don't matter. Of several labels of a doc_id the largest counts; rows
with a null label or doc_id aren't learned from; of several texts of a labelled doc_id one, chosen by its hash, is. Labels, lang, source and doc_id are
never inputs of a score. Without both classes among the labels, as in an empty table, every score is 0. Other columns of either table are ignored. A very
long text is scored as a whole; as a row to learn from it is passed over if it alone exceeds the sample's bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lineloom.llm import textbytes as tb
from lineloom.llm.language_id import Chars, all_distinct_words, distinct_words, held_out, runs
from lineloom.llm.rows import per_batch, texts

#: The bounds of the sample that the model is fitted on: expected labelled rows of each class, and bytes in all.
SAMPLE_ROWS, SAMPLE_BYTES = 2500, 24 << 20
BUCKETS, DIM = 1 << 17, 4
GRAMS = (3, 4, 5)
WINDOW, STRIDE = 4, 2
EPOCHS, RATE = 20, 0.15
#: How fast a text's weight gathers on its most toxic windows, and how far.
SHARPEN, MOST_SHARP = 0.17, 3.0
#: Pull of the vectors towards zero.
DECAY = 0.01
MODULUS, REMAINDER = 5, 0
#: Characters whose n-grams are hashed at once.
BLOCK = 1 << 18


def subwords(c: Chars, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, distinct word) of every character n-gram of ' word ', and of the word itself."""
    size = np.diff(c.first)
    owner = np.repeat(np.arange(len(size), dtype=np.int32), size)
    left = (np.repeat(c.first[1:], size) - np.arange(len(c.chars))).astype(np.int32)  # characters from here to the word's end
    ids, words = [], []
    for k in GRAMS:
        for lo in range(0, len(left), BLOCK):
            at = lo + np.flatnonzero(left[lo : lo + BLOCK] >= k)
            g = np.zeros(len(at), np.uint64)
            for i in range(k):
                g = g * np.uint64(0x100000001B3) + (c.chars[at + i].astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
            ids.append((tb.mix(g + np.uint64(k)) % np.uint64(buckets)).astype(np.int32))
            words.append(owner[at])
    if len(size):
        p, inv = tb.powers(len(c.chars) + 1)
        h = np.concatenate((np.zeros(1, np.uint64), np.cumsum((c.chars.astype(np.uint64) + np.uint64(1)) * p[:-1])))
        whole = tb.mix((h[c.first[1:]] - h[c.first[:-1]]) * inv[c.first[:-1]] + np.uint64(77))
        ids.append((whole % np.uint64(buckets)).astype(np.int32))
        words.append(np.arange(len(size), dtype=np.int32))
    return np.concatenate(ids), np.concatenate(words)


def windows(doc: np.ndarray, n_docs: int, window: int = WINDOW, stride: int = STRIDE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first use, end use, document) of the windows over the word uses of each document, which stand in order."""
    of = np.searchsorted(doc, np.arange(n_docs + 1))
    count = np.diff(of)
    n_win = np.where(count == 0, 0, np.maximum(1, -(-(count - window) // stride) + 1))
    d = np.repeat(np.arange(n_docs), n_win)
    k = np.arange(n_win.sum()) - np.repeat(np.cumsum(n_win) - n_win, n_win)
    start = of[d] + k * stride
    return start.astype(np.int32), np.minimum(start + window, of[d + 1]).astype(np.int32), d.astype(np.int32)


@dataclass
class Model:
    """weight: each bucket's vector times the softmax's direction; a word's logit is the mean over its n-grams."""

    weight: np.ndarray
    bias: float
    slope: float
    offset: float
    empty: float = 0.0  # logit of a text without a word: that of the usual clean text

    def logits(self, texts: list[str | None]) -> np.ndarray:
        """The largest window logit of each text."""
        c = distinct_words(texts, digits=True)
        out = np.full(len(texts), self.empty)
        if not len(c.word):
            return out
        ids, words = subwords(c, len(self.weight))
        n = len(c.first) - 1
        word = np.bincount(words, self.weight[ids], n) / np.bincount(words, minlength=n)
        start, end, d = windows(c.doc, c.n_docs)
        total = np.concatenate(([0.0], np.cumsum(word[c.word])))
        z = (total[end] - total[start]) / (end - start) + self.bias
        first = np.flatnonzero(np.concatenate(([True], d[1:] != d[:-1])))
        out[d[first]] = np.maximum.reduceat(z, first)
        return out

    def score(self, texts: list[str | None]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.logits(texts) + self.offset, -30, 30)))


def _adagrad(p: np.ndarray, g: np.ndarray, seen: np.ndarray, rate: float) -> None:
    seen += g * g
    p -= rate * g / (np.sqrt(seen) + 1e-8)


def fit(examples: list[str], toxic: np.ndarray, epochs: int = EPOCHS, rate: float = RATE, buckets: int = BUCKETS, dim: int = DIM, seed: int = 7) -> Model:
    """Train vectors and softmax together by full-batch Adagrad; in toxic texts the windows weigh by how toxic they look so far."""
    toxic = np.asarray(toxic, float)
    if not len(toxic) or toxic.min() == toxic.max():
        return Model(np.zeros(buckets), 0.0, 0.0, -30.0)
    held = np.arange(len(toxic)) % 5 == 4  # these fit the curve, the others the vectors
    if min(toxic[held].min(initial=1), toxic[~held].min(initial=1)) or not toxic[held].max(initial=0) or not toxic[~held].max(initial=0):
        held = np.zeros(len(toxic), bool)
    fitted = np.flatnonzero(~held)
    c = all_distinct_words([examples[i] for i in fitted], digits=True)
    ids, words = subwords(c, buckets)
    n = len(c.first) - 1
    share = 1.0 / np.bincount(words, minlength=n)
    start, end, d = windows(c.doc, c.n_docs)
    size = (end - start).astype(float)
    first = np.flatnonzero(np.concatenate(([True], d[1:] != d[:-1])))
    y = toxic[fitted][d]
    rng = np.random.default_rng(seed)
    e = rng.normal(0, 0.1, (buckets, dim))
    w = rng.normal(0, 0.5, dim)
    w /= np.linalg.norm(w)
    b = np.zeros(1)
    seen_e, seen_w, seen_b = np.full((buckets, dim), 1e-8), np.full(dim, 1e-8), np.full(1, 1e-8)
    n_use = len(c.word)
    for epoch in range(epochs):
        by_bucket = e @ w
        word = np.bincount(words, by_bucket[ids], n) * share
        total = np.concatenate(([0.0], np.cumsum(word[c.word])))
        z = (total[end] - total[start]) / size + b[0]
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        # a text's windows share its weight: evenly at first, then by their logits
        top = np.maximum.reduceat(z, first)
        sharp = np.exp(np.minimum(epoch * SHARPEN, MOST_SHARP) * (z - np.repeat(top, np.diff(np.append(first, len(z))))))
        weight = sharp / np.repeat(np.add.reduceat(sharp, first), np.diff(np.append(first, len(z))))
        g = (p - y) * weight
        _adagrad(b, np.array([g.sum()]), seen_b, rate)
        # each use gets the sum of its windows' shares
        step = np.zeros(n_use + 1)
        np.add.at(step, start, g / size)
        np.add.at(step, end, -g / size)
        use = np.cumsum(step)[:-1]
        by_word = np.bincount(c.word, use, n) * share
        by_id = np.bincount(ids, by_word[words], buckets)
        grad_w = by_id @ e
        _adagrad(e, by_id[:, None] * w[None] + DECAY * e, seen_e, rate * 4)
        _adagrad(w, grad_w, seen_w, rate)
    model = Model(e @ w, float(b[0]), 1.0, 0.0)
    judged = np.flatnonzero(held) if held.any() else fitted
    apart = [examples[i] for i in judged]
    x, toxic = np.concatenate([model.logits(apart[r]) for r in runs(apart)]), toxic[judged]
    model.empty = float(np.median(x[toxic == 0]))
    scale = max(float(x.std()), 1e-6)
    v, a, k = x / scale, np.zeros(1), np.ones(1)
    seen_a, seen_k = np.full(1, 1e-8), np.full(1, 1e-8)
    for _ in range(600):
        g = (1 / (1 + np.exp(-np.clip(k * v + a, -30, 30))) - toxic) / len(toxic)
        _adagrad(a, np.array([g.sum()]), seen_a, 0.3)
        _adagrad(k, np.array([(g * v).sum()]), seen_k, 0.3)
    model.slope, model.offset = float(k[0]) / scale, float(a[0])
    return model


def sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, most: int = SAMPLE_BYTES) -> tuple[list[str], np.ndarray]:
    """Texts and classes of rows to learn from: all of a class with fewer, else a hash-chosen share of that expected size."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter("doc_id is not null and toxic is not null")
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).filter(~held_out(MODULUS, REMAINDER))
    counts = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    if not counts:
        return [], np.zeros(0)
    share = F.lit(0.0)
    for k, n in counts.items():
        share = F.when(F.col("toxic") == k, min(1.0, rows / n)).otherwise(share)
    drawn = known.filter(F.pmod(F.xxhash64(F.lit("toxicity sample"), "doc_id"), F.lit(1 << 30)) / float(1 << 30) < share)
    # at most some 2 * SAMPLE_ROWS rows of two numbers: bounded by the parameter
    got = texts(docs).join(F.broadcast(drawn), "doc_id").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "toxic").filter(F.octet_length("text") <= most)
    one = got.groupBy("doc_id", "toxic").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("x")).select("toxic", "x.text", F.xxhash64(F.lit("order"), "doc_id").alias("place"), F.octet_length("x.text").cast("long").alias("size"))
    # the bytes are shared by both classes, rows in an order by chance
    before = F.sum("size").over(Window.partitionBy("toxic").orderBy("place").rowsBetween(Window.unboundedPreceding, 0))
    out = [(r["text"], r["toxic"]) for r in one.withColumn("upto", before).filter(F.col("upto") <= most // 2).orderBy("place", "text").select("text", "toxic").toLocalIterator()]
    return [t for t, _ in out], np.array([y for _, y in out], float)


def score_toxicity(docs: DataFrame, labels: DataFrame | None = None, model: Model | None = None) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    if model is None:
        model = fit(*sample(docs, labels))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        m, done, column = shared.value, 0, b.column(2)
        for s in tb.slices(column):
            score = m.score(column.slice(done, s.n).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0).slice(done, s.n), b.column(1).slice(done, s.n), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])
            done += s.n

    picked = texts(docs).select("doc_id", held_out(MODULUS, REMAINDER).alias("held_out"), "text")
    return per_batch(picked, make, "doc_id long, held_out boolean, score double, predicted int")
