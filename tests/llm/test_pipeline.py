import zlib
from collections import defaultdict

import pytest

import corpus_pipeline
from lineloom.llm.language_id import learned, sample
from lineloom.llm.query_op5 import tokenizer_path
from lineloom.llm.secret_scan import entropy, find

from .helpers import CLASHES, rows_of
from .test_decontaminate import brute as decontaminated
from .test_near import brute as grouped


def live_blanked(rows):
    """(doc_id, text) with live credentials blanked, by plain Python. rows: (doc_id, text, source)."""
    owners = defaultdict(set)
    for _, text, source in rows:
        for *_, value in find(text or ""):
            owners[value].add(source)
    out = []
    for doc_id, text, _ in rows:
        for a, b, _, value in find(text or ""):
            if len(owners[value]) < 5 and entropy(value) >= 2.5:
                text = text[:a] + "*" * (b - a) + text[b:]
        out.append((doc_id, text))
    return out


def expected(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    rejected = learned(sample(docs)).predict([t for _, t, _ in rows])[2]
    rows = [r for r, x in zip(rows, rejected, strict=True) if not x]
    kept = {d for d, _, _, k in grouped([r[:2] for r in rows], width=5) if k}
    rows = [r for r in rows if r[0] in kept]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    gone = {d for d, *_ in decontaminated([r[:2] for r in rows], items)}
    return live_blanked([r for r in rows if r[0] not in gone])


def test_run_is_the_plain_pipeline(spark, sf_dir):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    pieces = defaultdict(list)
    for r in corpus_pipeline.run(spark, sf_dir).collect():
        pieces[r.doc_id].append(r)
    want = expected(spark, sf_dir)
    assert 0 < len(want) < spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert set(pieces) == {d for d, _ in want}
    for doc_id, text in want:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        at = 0
        for p in sorted(pieces[doc_id], key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids)
            assert p.ids_crc32 == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids[at : at + p.length]))
            at += p.length
        assert at == len(ids)


def test_stages_keep_columns_and_clean_rows(spark, make_docs, sf_dir, words):
    """Each stage on its own: odd rows and extra columns pass, nothing clean goes."""
    clean = [f"{words(90)} number {i}" for i in range(12)]
    docs = make_docs([*clean, "", None, (None, words(60))], extra=CLASHES)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.dtypes == docs.dtypes, name
        assert {r.doc_id for r in out.collect()} >= set(range(12)), name
        empty = stage(spark, docs.filter("false"), sf_dir)
        assert empty.dtypes == docs.dtypes and empty.collect() == []
    assert corpus_pipeline.packing(spark, docs.filter("false"), sf_dir).collect() == []


def test_secrets_are_blanked_alone(spark, make_docs, sf_dir):
    texts = ["key é🙂 password=Xy7Kq9Lm2Pz4 and more", "nothing here", None, "password=aaaaaaaa weak"]
    out = dict(rows_of(corpus_pipeline.secrets(spark, make_docs(texts, extra=CLASHES), sf_dir), "doc_id", "text"))
    assert out[0] == "key é🙂 " + "*" * 21 + " and more" and out[1] == texts[1] and out[2] is None and out[3] == texts[3]


def test_stage_list():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "decontamination", "secret_scan", "packing"]


@pytest.mark.parametrize("broadcast", [True, False])
def test_filters_by_either_join(spark, make_docs, monkeypatch, broadcast):
    from lineloom.llm import filtering

    if not broadcast:
        monkeypatch.setattr(filtering, "BROADCAST_IDS", -1)
        monkeypatch.setattr(filtering, "BROADCAST_SPANS", -1)
    docs = make_docs(["abcdef", "ghi", (None, "jkl"), (1, "again"), (7, None)], extra=CLASHES)
    ids = spark.createDataFrame([(1,), (1,), (None,), (99,)], "doc_id long")
    assert rows_of(filtering.without(docs, "doc_id", ids), "doc_id", "text") == [(0, "abcdef"), (7, None), (None, "jkl")]
    hashes = {r.text: r.h for r in docs.select("text", filtering.text_hash().alias("h")).collect()}
    spans = spark.createDataFrame([(hashes["abcdef"], [(1, 3), (2, 5)]), (hashes["abcdef"], [(1, 3), (2, 5)]), (hashes["again"], [(0, 1)]), (hashes["jkl"], [(2, 9)])], "text_hash long, spans array<struct<start:long,end:long>>")
    assert rows_of(filtering.blank_spans(docs, spans), "doc_id", "text") == [(0, "a****f"), (1, "*gain"), (1, "ghi"), (7, None), (None, "jk*")]


def test_rows_without_an_id_of_their_own(spark, make_docs, sf_dir, words):
    """Null and shared ids: one of each group stays, whoever holds the id."""
    t, u = words(120), words(90)
    docs = make_docs([(5, t), (None, t), (None, t), (5, u), (3, u + " end"), (9, u), (9, u), (None, "alone " + words(40)), (8, words(60)), (8, words(60))], extra=CLASHES)
    same = [(8, docs.filter("doc_id = 8").first().text)] * 2
    assert corpus_pipeline.near_dedup(spark, docs, sf_dir).filter("doc_id = 8").count() == 2
    kept = rows_of(corpus_pipeline.near_dedup(spark, docs.filter("doc_id <> 8 or doc_id is null"), sf_dir), "doc_id", "text")
    assert sorted((k[0] is None, k[0] or 0) for k in kept) == [(False, 3), (False, 5), (True, 0)] and (5, t) in kept
    assert len(corpus_pipeline.near_dedup(spark, make_docs([*same, (None, "")]), sf_dir).collect()) == 2
    secret = "password=Xy7Kq9Lm2Pz4"
    blanked = corpus_pipeline.secrets(spark, make_docs([(None, secret), (1, "no"), (1, secret)]), sf_dir)
    assert rows_of(blanked, "doc_id", "text") == [(1, "*" * 21), (1, "no"), (None, "*" * 21)]
    item = spark.read.parquet(f"{sf_dir}/benchmark.parquet").first().text
    assert rows_of(corpus_pipeline.decontamination(spark, make_docs([(None, item), (2, item), (2, "clean words")]), sf_dir), "doc_id", "text") == [(2, "clean words")]
