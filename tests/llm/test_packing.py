import itertools
import zlib
from collections import Counter, defaultdict

import pytest

from lineloom.llm.packing import Packer, PartEncoder, best_fill, pack
from lineloom.llm.query_op5 import tokenizer_path

from .helpers import CLASHES


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


def check(rows, texts, tokenizer, capacity=4096):
    """Every id of every document lies in exactly one piece, and sequences are whole. Returns the share of padding."""
    want = Counter()
    pieces = defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
    for doc_id, same in itertools.groupby(sorted(texts, key=lambda x: repr(x[0])), key=lambda x: x[0]):
        for _, text in same:
            ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
            want[doc_id, len(ids)] += 1
            mine = sorted((p for p in pieces[doc_id] if p.doc_tokens == len(ids)), key=lambda p: p.start)
            raw = b"".join(i.to_bytes(4, "little") for i in ids)
            for p in mine:
                assert zlib.crc32(raw[4 * p.start : 4 * (p.start + p.length)]) == p.ids_crc32 and p.length > 0
            if sum(1 for x in texts if x[0] == doc_id) == 1:
                at = 0
                for p in mine:
                    assert p.start == at
                    at += p.length
                assert at == len(ids)
    assert sum(r.length for r in rows) == sum(n * k for (_, n), k in want.items())
    by_seq = defaultdict(list)
    for r in rows:
        by_seq[r.sequence_id].append(r)
    padded = used = 0
    for own in by_seq.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
        used += at
        padded += 0 if at & (at - 1) == 0 else capacity - at
    return padded / max(used, 1)


ODD = [None, "", " ", "a", "İstanbul ŞİŞLİ ßtraße ǅ", "tab\tand\x1cseparator \x85 here", "<|endoftext|> special", "ÀÉÎ don't we'll 3.14 #tags --- 漢字 かな", "🙂🙂 emoji \U0010ffff", "a" * 5000, "word " * 9000, " nbsp line", "x\n\ny\r\nz", "ab́c é", "I'M 'S'S it''s"]


def test_encoder_is_the_tokenizer(tokenizer, sf_dir):
    import pyarrow.parquet as pq

    texts = [*ODD, *pq.read_table(f"{sf_dir}/documents.parquet")["text"].to_pylist()]
    for limit in (300_000, 50):
        enc = PartEncoder(tokenizer_path(), limit)
        for t, got in zip(texts, enc.encode(texts), strict=True):
            assert got == b"".join(i.to_bytes(4, "little") for i in tokenizer.encode(t or "", add_special_tokens=False).ids), t


def test_encoder_over_every_character(tokenizer):
    """Each character up to U+0500, by itself and between letters, digits and marks, and control characters among them."""
    texts = [f"{a}{chr(c)}{b}" for c in range(1, 0x500) for a, b in (("", ""), ("a", "b"), ("É", "9"), ("'", "s"), ("¾", "-"), (" ", "ß"))]
    for t, got in zip(texts, PartEncoder(tokenizer_path()).encode(texts), strict=True):
        assert got == b"".join(i.to_bytes(4, "little") for i in tokenizer.encode(t, add_special_tokens=False).ids), repr(t)


def test_best_fill_is_the_best(rng):
    for _ in range(200):
        lengths = dict(Counter(rng.randint(1, 30) for _ in range(rng.randint(1, 8))))
        room = rng.randint(0, 60)
        got = best_fill(lengths, room)
        assert all(0 < n <= lengths[k] for k, n in got.items())
        ranges = [range(n + 1) for n in lengths.values()]
        best = max(s for c in itertools.product(*ranges) if (s := sum(k * n for k, n in zip(lengths, c, strict=True))) <= room)
        assert sum(k * n for k, n in got.items()) == best


def test_packer_leaves_no_padding(rng):
    p = Packer(5, capacity=64, pool=10)
    docs = {i: bytes(4 * rng.randint(1, 200)) for i in range(300)}
    for i, ids in docs.items():
        p.add(i, ids)
    p.finish()
    rows = p.take_rows()
    assert sum(r[2] for r in rows) == sum(len(v) // 4 for v in docs.values())
    sizes = Counter()
    for r in rows:
        sizes[r[5]] += r[2]
    assert all(s & (s - 1) == 0 for s in sizes.values()) and sum(s < 64 for s in sizes.values()) <= 6


def test_edges(make_docs, tokenizer):
    rows = [*enumerate(ODD), (None, "no id"), (3, "a"), (3, "a")]
    out = pack(make_docs(rows, extra=CLASHES), tokenizer_path()).collect()
    check(out, rows, tokenizer)
    assert pack(make_docs([]), tokenizer_path()).collect() == []


def test_documents(spark, sf_dir, tokenizer):
    from lineloom.llm.queries import queries

    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert check(queries()["op5_packing"](spark, sf_dir).collect(), texts, tokenizer) < 0.01
