import zlib

import numpy as np
import pytest

from lineloom.llm.toxicity import BUCKETS, GRAMS, STRIDE, WINDOW, fit, sample, score_toxicity, subwords

from .helpers import CLASHES


@pytest.fixture
def labelled(words, rng):
    bad = ["worthless", "idiot", "scumbag", "moron"]
    texts, toxic = [], []
    for i in range(400):
        w = words(rng.randint(20, 120)).split()
        if i % 3 == 0:
            for _ in range(rng.randint(2, 6)):
                w[rng.randrange(len(w))] = rng.choice(bad)
        texts.append(" ".join(w))
        toxic.append(i % 3 == 0)
    return texts, np.array(toxic, float)


def test_learns_and_generalises_to_misspellings(labelled, words):
    model = fit(*labelled)
    plain = model.score([words(60) for _ in range(60)])
    seen = model.score([f"{words(30)} you idiot worthless moron {words(30)}" for _ in range(20)])
    odd = model.score([f"{words(30)} you idiiot worthlesss moronn scumbagg {words(30)}" for _ in range(20)])
    assert (plain < 0.5).mean() > 0.9 and (seen >= 0.5).mean() > 0.9 and odd.mean() > plain.mean() + 0.3


def test_one_class_and_empty_text(labelled, words):
    assert fit([], np.zeros(0)).score(["x", None]).max() < 1e-6
    assert fit(["a b", "c d"], np.zeros(2)).score(["a"]).max() < 1e-6
    model = fit(*labelled)
    s = model.score([None, "", "?!", " "])
    assert len(set(s.tolist())) == 1 and s[0] < 0.5
    texts = [words(20), None, "idiot", words(5000), ""]
    assert np.allclose(model.score(texts), [model.score([t])[0] for t in texts])


def plain_logit(model, text):
    """The largest window's logit, word by word and n-gram by n-gram."""
    from lineloom.llm.language_id import distinct_words

    words = "".join(c.lower() if c.isalnum() and len(c.lower()) == 1 else c if c.isalpha() or c.isdigit() else " " for c in text or "").split()
    if not words:
        return model.empty

    def vector(word):
        ids, _ = subwords(distinct_words([word], digits=True))
        assert len(ids) == 1 + sum(max(0, len(word) + 2 - k + 1) for k in GRAMS) and max(ids) < BUCKETS
        return sum(model.weight[i] for i in ids) / len(ids)

    of = [vector(w) for w in words]
    starts = [0] + [s for s in range(STRIDE, len(of), STRIDE) if s + WINDOW - STRIDE < len(of)]
    return max(sum(of[s : s + WINDOW]) / len(of[s : s + WINDOW]) for s in starts) + model.bias


def test_scores_are_the_plain_ones(labelled, words):
    model = fit(*labelled)
    texts = [words(n) for n in range(1, 30)] + ["idiot", "Worthless MORON idiott", "", None, "?", "a b", words(300)]
    got = model.logits(texts)
    assert np.allclose(got, [plain_logit(model, t) for t in texts], atol=1e-9)
    assert np.allclose(model.score(texts), 1 / (1 + np.exp(-(model.slope * got + model.offset))))


def test_training_lowers_the_loss(labelled):
    """More epochs part the classes further, and every n-gram of a toxic text has learned something."""
    texts, y = labelled
    few, many = (fit(texts, y, epochs=n) for n in (1, 20))
    gap = lambda m: (m.logits(texts)[y == 1].mean() - m.logits(texts)[y == 0].mean()) / m.logits(texts).std()
    assert gap(many) > gap(few) and gap(many) > 1.5


def test_sample_is_bounded(spark, make_docs, labelled):
    texts, toxic = labelled
    rows = [*enumerate(texts), (3, "another text of three"), (3, "another text of three")]
    labels = spark.createDataFrame([(i, 1, int(y)) for i, y in enumerate(toxic)] + [(3, 1, 0)], "doc_id long, quality int, toxic int")
    got, y = sample(make_docs(rows, extra=CLASHES), labels)
    assert len(got) == sum(zlib.crc32(str(i).encode()) % 5 != 0 for i in range(len(texts))) and set(y) == {0.0, 1.0}
    got, y = sample(make_docs(rows), labels, most=20_000)
    assert 0 < sum(map(len, got)) <= 20_000 and set(y) == {0.0, 1.0}
    again, _ = sample(make_docs(rows, parts=5), labels, most=20_000)
    assert again == got


def test_edges(spark, make_docs, labelled):
    texts, toxic = labelled
    rows = [*enumerate(texts), (1000, None), (1001, ""), (None, "idiot"), (5, texts[5]), (1002, "clean words " * 20_000)]
    labels = [(i, 1, int(y), "x", "y") for i, y in enumerate(toxic)] + [(None, 1, 1, "x", "y"), (7, None, None, "x", "y"), (7, 1, 1, "x", "y"), (5000, 1, 1, "x", "y")]
    out = score_toxicity(make_docs(rows, extra=CLASHES), spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text string, score string")).collect()
    assert len(out) == len(rows)
    for r in out:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.predicted for r in score_toxicity(make_docs(["a", None]), none).collect()} == {0}
    assert score_toxicity(make_docs([]), none).collect() == []


def test_held_out_ranking(spark):
    import os

    from lineloom.llm.queries import queries

    d = "/root/testdata/sf0.1" if os.path.isdir("/root/testdata/sf0.1") else None
    if d is None:
        pytest.skip("no tables")
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{d}/labels.parquet").filter("toxic is not null").collect()}
    held = [(r.score, truth[r.doc_id], r.predicted) for r in queries()["op8_toxicity"](spark, d).collect() if r.held_out and r.doc_id in truth]
    s, y = np.array([h[0] for h in held]), np.array([h[1] for h in held])
    rank = np.argsort(np.argsort(s))
    auc = (rank[y == 1].sum() - y.sum() * (y.sum() - 1) / 2) / (y.sum() * (len(y) - y.sum()))
    assert auc > 0.93
    assert (np.array([h[2] for h in held]) == y).mean() > 0.9
