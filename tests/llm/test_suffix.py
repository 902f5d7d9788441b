import hashlib
from collections import Counter

import pytest

from lineloom.llm.suffix_dedup import remove_repeats

from .helpers import CLASHES, rows_of


def brute(rows, length):
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) by counting every string."""
    data = [(i, (t or "").encode()) for i, t in rows]
    count = Counter(b[k : k + length] for _, b in data for k in range(len(b) - length + 1))
    out = []
    for i, b in data:
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if count[b[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        runs = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((i, len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


COLUMNS = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("length,q,small", [(12, 4, 64), (12, 4, 2), (40, 16, 3)])
def test_random_texts(make_docs, seed, length, q, small):
    import random

    rng = random.Random(seed)
    stock = ["".join(rng.choice("abé") for _ in range(rng.randint(5, 90))) for _ in range(12)]
    rows = []
    for i in range(60):
        parts = [rng.choice(stock) if rng.random() < 0.6 else "".join(rng.choice("xyzw é") for _ in range(rng.randint(1, 40))) for _ in range(rng.randint(0, 6))]
        rows.append((i, "".join(parts)))
    got = remove_repeats(make_docs(rows), length, q) if small == 64 else _with_small(make_docs(rows), length, q, small)
    assert rows_of(got, *COLUMNS) == brute(rows, length)


def _with_small(docs, length, q, small):
    """Buckets of more than `small` extents go through the refinement level by level."""
    from lineloom.llm import suffix_dedup

    held = suffix_dedup.repeated_spans.__defaults__
    suffix_dedup.repeated_spans.__defaults__ = (*held[:2], small)
    try:
        return remove_repeats(docs, length, q)
    finally:
        suffix_dedup.repeated_spans.__defaults__ = held


def test_edges(make_docs, words):
    passage = words(60)
    long = words(20_000)
    rows = [(0, None), (1, ""), (2, "short"), (3, passage), (4, "before " + passage + " after"), (5, "é" * 300), (6, "é" * 150 + "x"), (7, "same text " * 30), (7, "same text " * 30), (None, passage), (None, passage + "!"), (8, long), (9, long[5000:7000] + words(50)), (10, "a" * 199), (11, "a" * 200), (12, "b" * 201)]
    assert rows_of(remove_repeats(make_docs(rows, extra=CLASHES)), *COLUMNS) == brute(rows, 200)
    assert remove_repeats(make_docs([])).collect() == []


def test_kept_bytes(make_docs, words):
    passage = words(60)
    out = {r.doc_id: bytes(r.kept) for r in remove_repeats(make_docs(["start " + passage, passage + " end"]), keep_text=True).collect()}
    assert out[0].startswith(b"start") and len(out[0]) <= 7 and out[1].endswith(b"end")


def test_hot_passage(make_docs, words):
    """Hundreds of documents share a passage, each within its own surroundings."""
    passage = words(70)
    rows = [(i, f"{words(8)} {i} " + passage + f" {i} " + words(8)) for i in range(300)]
    assert rows_of(remove_repeats(make_docs(rows)), *COLUMNS) == brute(rows, 200)


def test_documents(spark, sf_dir):
    from lineloom.llm.queries import queries

    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert rows_of(queries()["op7_suffix_dedup"](spark, sf_dir), *COLUMNS) == brute(docs, 200)


def test_without_a_broadcast(spark, sf_dir, make_docs, words, monkeypatch):
    """Beyond the bound texts are shuffled to their lists, to the same end: of the whole table, of a hot passage in buckets large and small, and of repeated rows."""
    from lineloom.llm import suffix_dedup
    from lineloom.llm.queries import queries

    monkeypatch.setattr(suffix_dedup, "BROADCAST_BYTES", -1)
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert rows_of(queries()["op7_suffix_dedup"](spark, sf_dir), *COLUMNS) == brute(docs, 200)
    hot = words(60)
    rows = [(i, words(5 + i % 40) + " " + hot + " " + words(i % 30 + 1)) for i in range(90)] + [(7, "x" * 300), (7, "x" * 300), (None, hot)]
    assert rows_of(remove_repeats(make_docs(rows)), *COLUMNS) == brute(rows, 200)
    monkeypatch.setattr(suffix_dedup, "MOST_ALIKE", 1)  # the repeated row is a hot key: no buckets
    assert rows_of(remove_repeats(make_docs(rows)), *COLUMNS) == brute(rows, 200)
