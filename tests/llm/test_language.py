import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from lineloom.llm.language_id import fit, identify, in_known_language, learned, sample

from .helpers import CLASHES, rows_of


def words_of(text):
    return "".join(c.lower() if c.isalpha() and len(c.lower()) == 1 else c if c.isalpha() else " " for c in text).split()


class Plain:
    """Interpolated Kneser-Ney with dictionaries: the last character of a k-gram, given the k - 1 before it."""

    def __init__(self, texts, order):
        self.order = order
        self.counts = [None, *(Counter() for _ in range(order))]
        for t in texts:
            for w in words_of(t):
                s = f" {w} "
                for k in range(1, order + 1):
                    for i in range(len(s) - k + 1):
                        if k > 1 or i > 0:
                            self.counts[k][s[i : i + k]] += 1
        for k in range(order - 1, 0, -1):
            longer = Counter(g[1:] for g in self.counts[k + 1])
            for g in self.counts[k]:
                self.counts[k][g] = longer.get(g, self.counts[k][g])
        self.total, self.kinds, self.discount = {}, {}, {}
        for k in range(1, order + 1):
            n = Counter(self.counts[k].values())
            self.discount[k] = n[1] / (n[1] + 2 * n[2]) if n[1] and n[2] else 0.5
            self.total[k], self.kinds[k] = defaultdict(int), defaultdict(int)
            for g, c in self.counts[k].items():
                self.total[k][g[:-1]] += c
                self.kinds[k][g[:-1]] += 1

    def p(self, context, c):
        if context is None:
            return 1e-4
        k = len(context) + 1
        shorter = self.p(context[1:] if context else None, c)
        total = self.total[k].get(context, 0)
        if not total:
            return shorter
        d = self.discount[k]
        return max(self.counts[k][context + c] - d, 0) / total + d * self.kinds[k][context] / total * shorter

    def entropy(self, text):
        logs = [math.log(self.p(s[max(0, i - self.order + 1) : i], s[i])) for w in words_of(text) for s in [f" {w} "] for i in range(1, len(s))]
        return -sum(logs) / len(logs)


TRAIN = {"aa": ["banana and cabana", "an apple, a pear; bananas", "abracadabra"], "bb": ["xylo zyx quux", "zyzzy quux xyz", "quip xyzzy"]}


def test_kneser_ney_is_the_plain_one():
    for order in (1, 2, 3, 4):
        model = fit(TRAIN, order)
        plain = {k: Plain(v, order) for k, v in TRAIN.items()}
        for text in ("banana", "quux and a xylophone", "Ünseen wörds", "zzz"):
            got, _ = model.entropies([text])
            assert got[0] == pytest.approx([plain[k].entropy(text) for k in ("aa", "bb")], rel=1e-3)


def test_one_length_for_every_split():
    """A text's figures don't hang on what it is judged with."""
    model = fit(TRAIN, 3)
    texts = ["banana xyz", None, "", "  1 2 3 !", "quux", "banana " * 500]
    together, _ = model.entropies(texts)
    for t, e in zip(texts, together, strict=True):
        assert np.allclose(model.entropies([t])[0][0], e)


def test_rejection():
    """Other scripts and noise lie beyond any language's own texts; more of the same doesn't."""
    text = {"aa": ["the banana and the cabana and a bandana " * 3] * 40, "bb": ["xylo zyx quux quip zyzzy " * 4] * 40}
    model = fit(text, 3)
    pred, score, rejected = model.predict(["the bandana and a banana and the cabana", "漢字仮名交じり文" * 20, "wpfgk mvjhd wkpgf jjhvm dkwpf gmvhj" * 9, None, "123"])
    assert pred[0] == "aa" and pred[3:] == ["und", "und"] and score[3] == score[4] == 0
    assert rejected.tolist() == [False, True, True, True, True]


def test_edges(make_docs):
    rows = ["banana", None, "", "42 -- !", "banana", (None, "xylo quux"), (7, "banana"), (7, "banana"), "quux " * 40_000]
    model = fit(TRAIN)
    out = rows_of(identify(make_docs(rows, extra=CLASHES), model), "doc_id", "held_out", "lang_pred", "score")
    assert len(out) == len(rows)
    for doc_id, held, lang, score in out:
        assert held == (doc_id is not None and zlib.crc32(str(doc_id).encode()) % 4 == 2)
        assert (lang == "und") == (doc_id in (1, 2, 3)) and 0 <= score <= 1
    assert identify(make_docs([])).collect() == []
    assert {r.lang_pred for r in identify(make_docs(["a b"], langs=[None])).collect()} == {"und"}


def test_kept_rows_are_as_they_were(make_docs):
    docs = make_docs(["banana cabana", None, "quux zyx", "漢字" * 90], extra=CLASHES)
    out = in_known_language(docs, fit({"aa": TRAIN["aa"] * 30, "bb": TRAIN["bb"] * 30}))
    assert out.dtypes == docs.dtypes
    assert rows_of(out) == rows_of(docs.filter("doc_id in (0, 2)"))


def test_rejection_is_calibrated_on_texts_unseen(rng):
    """Of new texts of the language next to none is rejected, of texts drawn from other letters nearly all; the bound widens for short texts."""
    word = lambda letters: "".join(rng.choice(letters) for _ in range(rng.randint(2, 7)))
    vocabulary = {k: [word(v) for _ in range(150)] for k, v in {"aa": "aeioubdt", "bb": "xyzqkwu"}.items()}
    text = lambda k: " ".join(rng.choice(vocabulary[k]) for _ in range(rng.choice([3, 30, 300])))
    model = learned({k: [text(k) for _ in range(300)] for k in vocabulary})
    fresh = [text(k) for k in vocabulary for _ in range(300)]
    assert model.predict(fresh)[2].mean() <= 0.005
    other = [" ".join(word("ghjlmnprsvcf") for _ in range(40)) for _ in range(100)]
    assert model.predict(other)[2].mean() >= 0.99
    assert (model.reach < 40).all() and (model.within > 0).all()
    # wrong labels don't widen the bound
    mixed = learned({"aa": [text("aa") for _ in range(300)] + [text("bb") for _ in range(6)], "bb": [text("bb") for _ in range(300)]})
    assert mixed.predict(other)[2].mean() >= 0.99


def test_sample_is_bounded(make_docs, words):
    docs = make_docs([words(200) for _ in range(60)], langs=["en", "fr", "de"] * 20)
    held = {k: sum(len(t.encode()) for t in v) for k, v in sample(docs, total=9000).items()}
    assert set(held) <= {"en", "fr", "de"} and all(0 < n <= 3000 for n in held.values())
    assert sum(map(len, sample(docs).values())) == docs.filter("crc32(cast(doc_id as string)) % 4 <> 2").count()


def test_query_is_the_plain_models(spark, sf_dir):
    """Every prediction of the query against dictionaries fitted on the same labelled rows, gathered by plain Python."""
    from lineloom.llm.queries import queries

    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    texts = defaultdict(list)
    for r in rows:
        if r.lang is not None and r.text is not None and zlib.crc32(str(r.doc_id).encode()) % 4 != 2:
            texts[r.lang].append(r.text)
    plain = {k: Plain([t for t in v if zlib.crc32(t.encode()) % 4] or v, 4) for k, v in texts.items()}
    out = {r.doc_id: r for r in queries()["op3_language_id"](spark, sf_dir).collect()}
    assert len(out) == len(rows)
    for r in rows:
        text = (r.text or "")[:3000]
        if not words_of(text) or len(r.text) > 3000:
            continue
        e = sorted((p.entropy(text), k) for k, p in plain.items())
        assert out[r.doc_id].lang_pred == e[0][1] or e[1][0] - e[0][0] < 1e-3
        z = sum(math.exp(-25 * (x - e[0][0])) for x, _ in e)
        assert out[r.doc_id].score == pytest.approx(1 / z, abs=0.02)


def test_many_languages(make_docs):
    """Each language has a column; repeated and clashing rows don't matter."""
    alphabet = "abcdefghijklmnopqrstuvwxyz"
    langs = [f"l{a}{b}" for a in alphabet[:10] for b in alphabet[:6]]
    text = {k: f"{k[1] * 3}{k[2]} {k[2] * 4}{k[1]} " * 6 for k in langs}
    model = fit({k: [t, t] for k, t in text.items()})
    pred, score, _ = model.predict([text[k] for k in langs])
    assert pred == langs and ((0 <= score) & (score <= 1)).all()


def test_held_out_accuracy(spark, sf_dir):
    from lineloom.llm.queries import queries

    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf_dir}/documents.parquet").filter("lang is not null and text is not null").collect()}
    out = [r for r in queries()["op3_language_id"](spark, sf_dir).collect() if r.held_out and r.doc_id in truth and r.lang_pred != "und"]
    assert len(out) > 20
    assert sum(r.lang_pred == truth[r.doc_id] for r in out) >= 0.97 * len(out)
