"""Sequence packing by minimum bin slack.

Documents are tokenised and cut into full windows and a remainder. Remainders wait in a pool; for each
window the longest waiting one is seeded and a bitset subset-sum programme over the multiset of waiting
lengths finds the fill closest to capacity, whose counts are read back stage by stage. Slack that is left
is closed by cutting one more piece. What is left of a task's pool at its end is cut into power-of-two
sequences, which need no padding. One pass over the scan: no shuffle, and a pool of bounded size a task.

Defined results: null or empty text is the single end id. Each row is packed by itself, so repeated rows give
repeated pieces. Other columns are ignored. A very long text holds its own ids in memory, and no more.
"""

from __future__ import annotations

import codecs
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from lineloom.llm.rows import bound_batches, texts

CAPACITY = 4096
END_ID = 2
#: The pool is packed once it holds POOL pieces, down to half of that.
POOL = 512
#: Distinct parts whose ids a worker keeps, some 200 bytes each; beyond, it starts anew.
CACHE_PARTS = 500_000

#: Letters and digits up to U+024F without İ, in lower case (some of which lie beyond): what the fast path reads.
_LETTER, _DIGIT = "a-zªµºß-öø-ʯⱥⱦ", "0-9²³¹¼½¾"
_PARTS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_DIGIT}]|[^\s{_DIGIT}{_LETTER}]+")
_BEYOND = re.compile("[^\x00-ɏ]|İ")
_ODD = ("<|", "\x1c", "\x1d", "\x1e", "\x1f")
#: The vocabulary's characters for bytes: printable ones stand for themselves, the others from U+0100 on. A space stays, between parts.
_PRINTABLE = {*range(0x20, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
_OTHERS = [b for b in range(0x100) if b not in _PRINTABLE or b == 0x20]
_BYTES = "".join(chr(b) if b in _PRINTABLE else chr(0x100 + _OTHERS.index(b)) for b in range(0x100))


def _beyond(text: str) -> bool:
    """Whether a text has a character that the fast path doesn't read."""
    if text.isascii():
        return False
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return _BEYOND.search(text) is not None
    return False


class PartEncoder:
    """Ids of whole texts as little-endian uint32 bytes, equal to the tokenizer's own, from ids kept by part.

    The vocabulary's pre-tokenizer cuts a text into parts that are merged each by itself, and never joins across white space. Texts
    of characters up to U+024F, which its normaliser only lower-cases, are cut here in the same way; words with others
    go to the tokenizer by themselves; and texts with separators on which Python and the tokenizer differ, or with special tokens, go
    there whole.
    """

    #: Texts whose new parts are looked up together.
    CHUNK = 64

    def __init__(self, path: str, limit: int = CACHE_PARTS):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.merger = Tokenizer(self.tokenizer.model)
        self.merger.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.parts: dict[str, bytes] = {}
        self.limit = limit

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, missing: list[str]) -> None:
        for lo in range(0, len(missing), 2000):
            some = missing[lo : lo + 2000]
            text, _ = codecs.charmap_decode(" ".join(some).encode(), "strict", _BYTES)
            ids = np.array(self.merger.encode(text, add_special_tokens=False).ids, "<u4")
            cut = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            if len(cut) != len(some) or cut[-1] != 4 * len(ids):
                raise ValueError("the tokenizer doesn't end each part with one end-of-word id")
            raw = ids.tobytes()
            self.parts.update(zip(some, [raw[a:b] for a, b in zip([0, *cut], cut, strict=False)], strict=True))

    def _cut(self, text: str) -> list[str]:
        """The parts of a text; of a word beyond the fast path the whole word, which encode() has looked up."""
        if not _beyond(text):
            return _PARTS.findall(text.lower())
        out: list[str] = []
        for w in text.split():
            if not _beyond(w):
                out += _PARTS.findall(w.lower())
            else:
                # such a word is no part, as it has a character that no part has
                if w not in self.parts:
                    self.odd[w] = self.whole(w)
                out.append(w)
        return out

    def encode(self, texts: list[str | None]) -> Iterator[bytes]:
        for lo in range(0, len(texts), self.CHUNK):
            some = texts[lo : lo + self.CHUNK]
            self.odd: dict[str, bytes] = {}
            cut = [None if not t or any(o in t for o in _ODD) else self._cut(t) for t in some]
            new = set().union(*(c for c in cut if c)).difference(self.parts, self.odd)
            if len(self.parts) + len(new) + len(self.odd) > self.limit:
                kept = set().union(*(c for c in cut if c))
                self.parts = {k: v for k, v in self.parts.items() if k in kept}
            self._learn(sorted(new))
            self.parts.update(self.odd)
            ids = self.parts.__getitem__
            for t, c in zip(some, cut, strict=True):
                yield b"" if not t else self.whole(t) if c is None else b"".join(map(ids, c))


_ENCODERS: dict[str, PartEncoder] = {}


def encoder(path: str) -> PartEncoder:
    """The worker's encoder of this vocabulary."""
    if path not in _ENCODERS:
        _ENCODERS[path] = PartEncoder(path)
    return _ENCODERS[path]


def best_fill(lengths: dict[int, int], room: int) -> dict[int, int]:
    """Counts of lengths with the largest sum of at most room, from counts at hand.

    Bit t of a reach set says that t can be made. Stage by stage one distinct length is added with its count in
    binary parts; the exact fill ends the search early. The counts are read back through the stages.
    """
    full = (1 << (room + 1)) - 1
    reach, stages = 1, []
    for length in sorted((x for x in lengths if x <= room), reverse=True):
        before, left, part = reach, min(lengths[length], room // length), 1
        while left:
            take = min(part, left)
            reach = (reach | (reach << (take * length))) & full
            left -= take
            part <<= 1
        stages.append((length, before))
        if reach >> room & 1:
            break
    total, out = reach.bit_length() - 1, {}
    for length, before in reversed(stages):
        n = 0
        while not before >> total & 1:
            total -= length
            n += 1
        if n:
            out[length] = n
    return out


class Packer:
    """Packs the documents of one task. rows: the finished pieces, one tuple each."""

    def __init__(self, first_id: int, capacity: int = CAPACITY, pool: int = POOL):
        self.capacity, self.most, self.next = capacity, pool, first_id
        self.pool: dict[int, list] = defaultdict(list)
        self.counts: dict[int, int] = {}
        self.held = self.tokens = 0
        self.rows: list[tuple] = []

    def _put(self, doc, start: int, ids: bytes, n_doc: int) -> None:
        n = len(ids) // 4
        self.pool[n].append((doc, start, ids, n_doc))
        self.counts[n] = self.counts.get(n, 0) + 1
        self.held += 1
        self.tokens += n

    def _take(self, n: int):
        piece = self.pool[n].pop()
        self.counts[n] -= 1
        if not self.counts[n]:
            del self.counts[n], self.pool[n]
        self.held -= 1
        self.tokens -= n
        return piece

    def _emit(self, pieces: list) -> None:
        at = 0
        for doc, start, ids, n_doc in pieces:
            n = len(ids) // 4
            self.rows.append((doc, start, n, zlib.crc32(ids), n_doc, self.next, at))
            at += n
        self.next += 1

    def _fill(self, capacity: int) -> None:
        """One sequence of exactly `capacity` ids; the pool holds as many."""
        fits = [n for n in self.counts if n <= capacity]
        pieces = [self._take(max(fits))] if fits else []
        room = capacity - sum(len(p[2]) // 4 for p in pieces)
        if room and self.counts:
            for n, c in best_fill(self.counts, room).items():
                for _ in range(c):
                    pieces.append(self._take(n))
                room -= n * c
        if room:  # the fill falls short: every waiting piece is longer than the room, and one is cut
            doc, start, ids, n_doc = self._take(min(self.counts))
            pieces.append((doc, start, ids[: 4 * room], n_doc))
            self._put(doc, start + room, ids[4 * room :], n_doc)
        self._emit(pieces)

    def add(self, doc, ids: bytes) -> None:
        n_doc = len(ids) // 4
        whole = n_doc - n_doc % self.capacity
        for start in range(0, whole, self.capacity):
            self._emit([(doc, start, ids[4 * start : 4 * (start + self.capacity)], n_doc)])
        if whole < n_doc:
            self._put(doc, whole, ids[4 * whole :], n_doc)
        if self.held >= self.most:
            while self.held > self.most // 2 and self.tokens >= self.capacity:
                self._fill(self.capacity)

    def finish(self) -> None:
        while self.tokens >= self.capacity:
            self._fill(self.capacity)
        while self.tokens:
            self._fill(1 << (self.tokens.bit_length() - 1))

    def take_rows(self) -> list[tuple]:
        rows, self.rows = self.rows, []
        return rows


NAMES = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
TYPES = (pa.int64(),) * len(NAMES)


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, pool: int = POOL) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(TaskContext.get().partitionId() << 32, capacity, pool)
        enc = encoder(tokenizer_path)

        def out() -> Iterator[pa.RecordBatch]:
            if rows := packer.take_rows():
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), TYPES, strict=True)], names=NAMES)

        for b in batches:
            for doc, ids in zip(b.column(0).to_pylist(), enc.encode(b.column(1).to_pylist()), strict=True):
                packer.add(doc, ids + end)
            yield from out()
        packer.finish()
        yield from out()

    bound_batches(docs.sparkSession)
    return texts(docs).mapInArrow(run, ", ".join(f"{n} long" for n in NAMES))
