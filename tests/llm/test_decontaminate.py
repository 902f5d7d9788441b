import functools
import re
from collections import defaultdict

import pytest

from lineloom.llm.decontaminate import UNITS, contaminated

from .helpers import CLASHES, rows_of

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
W, COVER, GAP = 5, 0.8, 8
HOLDERS = ("NAME", "UNIT", "NUMBER")


@functools.cache
def canonical(text):
    """(value, form, form with capitalised openings as names) of every word; a form is the value, or NUMBER, UNIT or NAME."""
    out, before, end = [], None, None
    for m in re.finditer("[0-9A-Za-z\u0080-\U0010ffff]+", text):
        raw, value = m[0], m[0].translate(UPPER)
        opens = end is None or re.search(r"[\n!.:;?]", text[end : m.start()])
        form = value
        capital = re.match("[A-ZÀ-Þ]", raw) and len(re.findall("[A-Z]", raw)) <= 1
        if not opens and capital:
            form = "NAME"
        if before is not None and value in UNITS and re.fullmatch("[0-9]+", before):
            form = "UNIT"
        if re.fullmatch("[0-9]+", raw):
            form = "NUMBER"
        out.append((value, form, "NAME" if capital and form == value else form))
        before, end = value, m.end()
    return out


@functools.cache
def windows(text, width):
    return list(_windows(text, width))


def _windows(text, width):
    c = canonical(text)
    for i in range(len(c) - width + 1):
        w = c[i : i + width]
        yield i, ("plain", *(v for v, *_ in w))
        forms = [[x[k] for x in w] for k in (1, 2)]
        for k, form in enumerate(forms):
            if 0 < sum(f in HOLDERS for f in form) < width and (k == 0 or form != forms[0]):
                yield i, (("form", "named")[k], *form)


def covered(at, width):
    return len({p + k for p in at for k in range(width)})


def judge(text, item):
    a, b = canonical(text), canonical(item)
    width = min(W, len(b))
    places = defaultdict(list)
    same = lambda x: ("plain" if x[0] == "plain" else "form", *x[1:])
    for q, y in windows(item, width):
        places[same(y)].append((q, y[0]))
    # a window of either form may be met by one of the other
    hits = [(p - q, q, p, (kind, *x[1:])) for p, x in windows(text, width) for q, kind in places.get(same(x), ()) for kind in [max(kind, x[0])]]
    runs = []
    for h in sorted(hits):
        if runs and h[0] - runs[-1][-1][0] <= GAP:
            runs[-1].append(h)
        else:
            runs.append([h])
    found = []
    for run in runs:
        share = covered({q for _, q, _, _ in run}, width) / len(b)
        plain = covered({q for _, q, _, x in run if x[0] == "plain"}, width) / len(b) >= COVER
        weight = defaultdict(set)
        for d, q, _, _ in run:
            weight[d].add(q)
        main = max(weight, key=lambda d: (len(weight[d]), -d))

        def told(kinds):
            nearest = {}
            for d, q, p, x in run:
                if x[0] in kinds:
                    for k in range(width):
                        if x[1 + k] in HOLDERS:
                            y = (abs(d - main), -len(weight[d]), d, x[1 + k], b[q + k][0], a[p + k][0])
                            nearest[q + k] = min(nearest.get(q + k, y), y)
            slots = {s[3:] for s in nearest.values()}
            return slots, len({s[:2] for s in slots}) == len(slots)

        first = covered({q for _, q, _, x in run if x[0] != "named"}, width) / len(b)
        slots_first, ok_first = told(("form",))
        slots, ok = told(("form", "named"))
        every = share >= COVER and ok
        if plain or every or first >= COVER and ok_first:
            found.append((plain, share, -min(p for *_, p, _ in run), not plain and any(s[1] != s[2] for s in (slots if every else slots_first))))
    return max(found) if found else None


def brute(docs, items):
    out = {}
    for d, text in docs:
        for i, item in items:
            best = judge(text or "", item or "") if d is not None and i is not None and canonical(item or "") else None
            if best:
                out[d, i] = max(best, out.get((d, i), best))
    return sorted(((*k, round(b[1], 9), -b[2], b[3]) for k, b in out.items()), key=repr)


def found(df):
    return sorted(((r.doc_id, r.item_id, round(r.coverage, 9), r.first_word, r.reparameterised) for r in df.collect()), key=repr)


ITEMS = [
    (1, "Anna buys 12 apples and 5 pears for 30 dollars. How many fruits does Anna have in all when Bob takes 5 of them away?"),
    (2, "The train runs 120 km in 3 hours, then rests for 45 minutes before it runs back at the same speed."),
    (3, "step 1 then rest, step 2 then rest, step 3 then rest, step 4 then rest, step 5 then rest"),
    (4, "too short"),
    (5, None),
    (None, "this item has no number of its own and so is left out"),
    (1, "Anna buys 12 apples and 5 pears for 30 dollars. How many fruits does Anna have in all when Bob takes 5 of them away?"),
]
DOCS = [
    ITEMS[0][1],
    "Intro words here. Yesterday Mary buys 7 apples and 9 pears for 80 dollars. How many fruits does Mary have in all when John takes 9 of them away? The end.",
    "Mary buys 7 apples and 9 pears for 80 dollars. How many fruits does Lucy have in all when John takes 4 of them away?",
    "the TRAIN RUNS 120 KM IN 3 HOURS, THEN RESTS FOR 45 MINUTES BEFORE IT RUNS BACK AT THE SAME SPEED.",
    "The train runs 80 miles in 2 days, then rests for 10 seconds before it runs back at the same speed.",
    "A word before. " + ITEMS[2][1] + " A word after.",
    "The train runs 120 km in 3 hours. Nothing else is alike here, not a word of it.",
    None,
    "",
    "Anna buys 12 apples",
    "prose " * 30_000 + ITEMS[1][1],
    "The train quickly runs 120 km in 3 hours, then rests for 45 minutes before it really runs back at the same speed.",
]


def test_planted_cases(spark, make_docs):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    out = {(r.doc_id, r.item_id): r for r in contaminated(make_docs(DOCS), items).collect()}
    assert set(out) == {(0, 1), (1, 1), (3, 2), (4, 2), (5, 3), (10, 2), (11, 2)}
    assert not out[0, 1].reparameterised and out[1, 1].reparameterised and out[4, 2].reparameterised and not out[5, 3].reparameterised and not out[3, 2].reparameterised
    assert out[10, 2].first_word == 30_000


def test_brute_force(spark, make_docs):
    rows = [*enumerate(DOCS[:10]), (11, DOCS[11]), (3, DOCS[3]), (None, DOCS[0])]
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert found(contaminated(make_docs(rows, extra=CLASHES), items)) == brute(rows, ITEMS[:6])


@pytest.mark.parametrize("seed", range(2))
def test_random_texts(spark, make_docs, seed):
    import random

    rng = random.Random(seed)
    vocabulary = ["go", "stop", "Ann", "Bob", "3", "14", "km", "hours", "the", "in", "of", "and", "Été"]
    text = lambda n: "".join(rng.choice(vocabulary) + rng.choice([" ", " ", " ", ", ", ". "]) for _ in range(n))
    items = [(i, text(rng.randint(4, 14))) for i in range(12)]
    docs = []
    for i in range(60):
        t = text(rng.randint(0, 30))
        if i % 2:
            t += rng.choice(items)[1] + text(rng.randint(0, 10))
        docs.append((i, t))
    assert found(contaminated(make_docs(docs), spark.createDataFrame(items, "item_id long, text string"))) == brute(docs, items)


def test_short_items_and_windows_of_placeholders(spark, make_docs):
    items = [(1, "capital of France today"), (2, "12 + 30 = 42 and 7 - 3 = 4"), (3, "Ann has 5 pens. Bob has 9 pens. Cy has 2 pens. How many pens are there in all?"), (4, "Zyzzyva"), (4, "another text of item four, of more words"), (5, "")]
    docs = [
        "What is the capital of France today, then?", "What is the capital of Spain today, then?", "the capital of a land today",
        "See 15 + 31 = 46 and 9 - 2 = 7, said someone.", "See 15 + 15 = 30 and 9 - 2 = 7", "12 and 12 12 12 12",
        "Well. Eve has 3 pens. Tom has 4 pens. Lee has 8 pens. How many pens are there in all?", "a zyzzyva flew", "It was another text of item four, of more words.", "Nothing of that. How many pens are there?",
    ]
    df = spark.createDataFrame([(*i, "x", 1) for i in items], "item_id long, text string, window string, kinds long")
    out = contaminated(make_docs(docs), df)
    assert found(out) == brute([*enumerate(docs)], items)
    assert {(r.doc_id, r.item_id, r.reparameterised) for r in out.collect()} == {(0, 1, False), (1, 1, True), (3, 2, True), (4, 2, True), (6, 3, True), (7, 4, False), (8, 4, False)}


def test_phrases_that_recur_nearby(spark, make_docs):
    """A template window that recurs hits neighbouring diagonals, which say nothing of the slots."""
    form = "She bought {} red apples and she bought {} red apples and she bought {} red apples in all at {} shops."
    items = [(1, form.format(3, 4, 5, 6)), (2, form.format(3, 3, 5, 6))]
    docs = [form.format(30, 40, 50, 60), form.format(30, 30, 50, 60), items[0][1]]
    out = {(r.doc_id, r.item_id): r.reparameterised for r in contaminated(make_docs(docs), spark.createDataFrame(items, "item_id long, text string")).collect()}
    # different values of the item may become one; one value can't become two; (2, 2) has 20 of 21 words as they stand
    assert out == {(0, 1): True, (1, 1): True, (1, 2): True, (2, 1): False, (2, 2): False}


def test_empty_tables(spark, make_docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert contaminated(make_docs(DOCS), none).collect() == []
    assert contaminated(make_docs([]), spark.createDataFrame(ITEMS, "item_id long, text string")).collect() == []


def test_without_a_broadcast(spark, make_docs, monkeypatch):
    """Beyond the bound all windows are joined by a shuffle, to the same end."""
    from lineloom.llm import decontaminate

    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    want = rows_of(contaminated(make_docs(DOCS), items))
    monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", 0)
    assert rows_of(contaminated(make_docs(DOCS), items)) == want


def test_documents(spark, sf_dir):
    """All documents that hold an item's words in a row, and no other."""
    from lineloom.llm.queries import queries

    words = lambda t: " " + " ".join(v for v, *_ in canonical(t or "")) + " "
    docs = [(r.doc_id, words(r.text)) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    items = [(r.item_id, words(r.text)) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    out = queries()["op2_decontamination"](spark, sf_dir)
    assert {(r.doc_id, r.item_id) for r in out.collect()} >= {(d, i) for d, t in docs for i, x in items if x in t}
    assert {r.doc_id for r in out.collect()} == {d for d, t in docs if any(x in t for _, x in items)}
