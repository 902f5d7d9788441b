import re

import pytest

from lineloom.llm.near_dedup import BITS, chunk_keys, near_duplicates

from .helpers import CLASHES, rows_of

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, width):
    w = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(UPPER))
    if not w:
        return set()
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} or {tuple(w)}


def brute(rows, width=4, percent=80):
    """(doc_id, n_shingles, component_id, kept) by holding every pair's sets against each other."""
    sets = [shingles(t, width) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                up[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    out = []
    for i, (d, _) in enumerate(rows):
        c = least.get(root(i), d)
        out.append((d, len(sets[i]), c if sets[i] else d, d == (c if sets[i] else d)))
    return sorted(out, key=repr)


def edited(text, k, rng):
    w = text.split()
    for _ in range(k):
        w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
    return " ".join(w)


COLUMNS = ("doc_id", "n_shingles", "component_id", "kept")


@pytest.mark.parametrize("width", [4, 5])
def test_random_groups(make_docs, words, rng, width):
    texts = []
    for _ in range(25):
        t = words(rng.randint(3, 300))
        texts += [t] * rng.randint(1, 3)
        texts += [edited(t, rng.randint(1, 1 + len(t.split()) // 25), rng) for _ in range(rng.randint(0, 5))]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    assert rows_of(near_duplicates(make_docs(rows), width=width), *COLUMNS) == brute(rows, width)


def test_edges(make_docs, words):
    long = words(30_000)
    rows = [(0, None), (1, ""), (2, " \t\n"), (3, "one"), (4, "ONE"), (5, "one two three"), (6, "One Two\nthree"), (7, "é É"), (8, "É é"), (9, "a a a a a a"), (10, "a a a a"), (30, long), (31, long + " tail"), (32, long[: len(long) // 2]), (20, words(80)), (20, words(80)), (40, "x y z w v"), (40, "x y z w v")]
    got = rows_of(near_duplicates(make_docs(rows, extra=CLASHES), width=4), *COLUMNS)
    assert got == brute(rows, 4)
    assert near_duplicates(make_docs([])).collect() == []


def test_null_ids_stand_for_none(make_docs, words):
    t = words(50)
    out = rows_of(near_duplicates(make_docs([(5, t), (None, t), (3, t), (None, "alone " * 9)])), "doc_id", "component_id", "kept")
    assert (3, 3, True) in out and (5, 3, False) in out and len(out) == 4


def test_chain_and_ties(make_docs, words):
    """Neighbours of a chain are alike, its ends aren't; all is one component."""
    w = words(400).split()
    rows = [(100 - i, " ".join(w[10 * i : 10 * i + 200])) for i in range(20)]
    want = brute(rows, 4)
    assert len({c for _, _, c, _ in want}) == 1
    assert rows_of(near_duplicates(make_docs(rows), width=4), *COLUMNS) == want


def test_hot_group_with_fringe(make_docs, words, rng):
    """Hundreds of slightly different copies of one text, and texts at the threshold's edge."""
    t = words(120)
    rows = [(i, edited(t, rng.randint(0, 4), rng)) for i in range(300)] + [(1000 + i, edited(t, 8, rng)) for i in range(30)]
    assert rows_of(near_duplicates(make_docs(rows), width=4), *COLUMNS) == brute(rows, 4)


def test_keys_of_the_join(rng):
    """Two signatures that differ in at most 15 symbols of 40 share a key, wherever these lie."""
    import numpy as np

    g = np.random.default_rng(3)
    assert BITS >= 40
    for _ in range(300):
        a = g.integers(0, 1 << 16, 40).astype(np.uint16)
        b = a.copy()
        at = g.choice(40, 15, replace=False)
        b[at] ^= 1
        assert set(chunk_keys(a[None]).ravel().tolist()) & set(chunk_keys(b[None]).ravel().tolist())


def test_documents(spark, sf_dir):
    from lineloom.llm.queries import queries

    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert rows_of(queries()["op10_near_dedup"](spark, sf_dir), *COLUMNS) == brute(docs, 4)
