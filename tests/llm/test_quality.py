import re
from collections import Counter

from lineloom.llm.quality_rules import Condition, Rule, apply_rules, learn, verdict

from .helpers import CLASHES, rows_of

WORD = re.compile("[^\x20\x09-\x0d]+")
COLUMNS = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def base(text):
    text = text or ""
    w = WORD.findall(text)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = Counter(windows)
    covered = {j for i, x in enumerate(windows) if n[x] > 1 for j in range(i, i + 3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w)


TEXTS = [
    None,
    "",
    " \t\n\x0b\x0c\r ",
    "one two three one two three",
    "a b c a b c a b",
    "line\nline\n line\nline \n\nline\r\nline\r\n",
    " nbsp is a word\x1c here 🙂🙂 é",
    "# heading * $ % & | < > ##",
    "x " * 30_000,
    " ".join(f"w{i}" for i in range(60)),
    " ".join(f"w{i % 40}" for i in range(80)),
    "a\nb\na\nb\na",
    "".join("\U0001f600" for _ in range(50)) + " end",
]


def test_counts(make_docs):
    rows = [*enumerate(TEXTS), (4, TEXTS[4]), (4, TEXTS[4]), (None, TEXTS[3])]
    out = apply_rules(make_docs(rows, extra=CLASHES), rules=[])
    assert rows_of(out, *COLUMNS) == sorted([(i, *base(t)) for i, t in rows], key=repr)
    assert all(r.kept == (not r.base_failed) for r in out.collect())


def test_random_counts(make_docs, rng):
    rows = [(i, "".join(rng.choice(["a", "b", "c", " ", " ", "\n", "|", "é", "\t"]) for _ in range(rng.randint(0, 200)))) for i in range(300)]
    assert rows_of(apply_rules(make_docs(rows), rules=[]), *COLUMNS) == sorted([(i, *base(t)) for i, t in rows], key=repr)


def test_empty_tables(spark, make_docs):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert apply_rules(make_docs([]), labels).collect() == []
    assert [r.kept for r in apply_rules(make_docs(["w%d " % i + " ".join(f"x{i}{j}" for j in range(60)) for i in range(3)]), labels).collect()] == [True] * 3


def test_covering_finds_the_rule():
    cuts = {"a": [0.1, 0.5], "b": [1.0]}
    cells = {(x, y): ((50, 0, 25, 0) if x == 2 and y == 0 else (0, 50, 0, 25)) for x in range(3) for y in range(2)}
    rules = learn(cells, cuts)
    assert len(rules) == 1 and not rules[0].keep and set(rules[0].conditions) == {Condition("a", 1, True, 0.5), Condition("b", 0, False, 1.0)}
    assert learn({}, cuts) == [] and learn({(0, 0): (5, 0, 5, 0)}, cuts) == [] and learn({(0, 0): (0, 5, 0, 5)}, cuts) == []


def test_order_counts():
    """Bad texts are those above the cut of a, but for those above the cut of b: the exception comes first."""
    cuts = {"a": [0.5], "b": [0.5]}
    cells = {(0, 0): (0, 300, 0, 150), (0, 1): (0, 300, 0, 150), (1, 1): (0, 100, 0, 50), (1, 0): (60, 14, 30, 7)}
    rules = learn(cells, cuts)
    assert rules == [] or not rules[-1].keep
    cells[1, 0] = (60, 2, 30, 1)
    rules = learn(cells, cuts)
    assert [r.keep for r in rules] == [False] and set(rules[0].conditions) == {Condition("a", 0, True, 0.5), Condition("b", 0, False, 0.5)}


def plain_verdict(rules, x):
    for rule in rules:
        if all((x[c.feature] > c.threshold) == c.above for c in rule.conditions):
            return rule.keep
    return True


def test_verdict_is_the_first_rule_that_holds(spark, make_docs, rng):
    rules = [
        Rule((Condition("symbols", 0, True, 0.2), Condition("bars", 0, False, 0.1)), True),
        Rule((Condition("symbols", 0, True, 0.1),), False),
        Rule((Condition("dup_lines", 0, True, 0.3),), False),
        Rule((Condition("mean_word", 0, False, 3.0), Condition("repeats", 0, True, 0.01)), False),
    ]
    texts = ["\n".join(" ".join(rng.choice(["word", "x", "#", "|", "longerword", "Cap"] if i % 2 else ["word", "longerword", f"w{rng.randint(0, 99)}"]) for _ in range(20)) for _ in range(rng.choice([3, 6]))) for i in range(60)]
    texts += [texts[1] + "\n" + texts[1], "# " * 80, "a b c d " * 20]
    out = {r.doc_id: r.kept for r in apply_rules(make_docs(texts), rules=rules).collect()}
    for i, t in enumerate(texts):
        n, chars, symbols, dups, repeats, failed = base(t)
        lines = sum(bool(WORD.search(x)) for x in t.split("\n"))
        x = {"mean_word": chars / n, "symbols": symbols / n, "dup_lines": dups / lines, "repeats": repeats / n, "capitals": 0, "bars": t.count("|") / n}
        assert out[i] == (not failed and plain_verdict(rules, x)), i
    assert len(set(out.values())) == 2 and verdict([]) is not None


def test_very_long_text(make_docs, rng):
    """Two million words, counted exactly."""
    text = " ".join(map(str, rng.choices(range(20_000), k=2_000_000)))
    assert rows_of(apply_rules(make_docs([text]), rules=[]), *COLUMNS) == [(0, *base(text))]


def test_pruning_drops_what_does_not_hold():
    """A condition that only the growing rows bear out goes."""
    cuts = {"a": [0.5], "b": [0.5]}
    cells = {(1, 1): (40, 0, 20, 0), (1, 0): (10, 4, 20, 0), (0, 1): (0, 50, 0, 25), (0, 0): (0, 50, 0, 25)}
    assert learn(cells, cuts)[0] == Rule((Condition("a", 0, True, 0.5),), False)


def test_native_plan(spark, sf_dir):
    """No Python on the executors; rules learned from the labels part good from bad."""
    from lineloom.llm.queries import queries

    out = queries()["op9_quality_rules"](spark, sf_dir)
    plan = out._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    assert rows_of(out, *COLUMNS) == sorted([(r.doc_id, *base(r.text)) for r in docs], key=repr)


def test_learned_rules_agree_with_labels(spark):
    import os

    import pytest

    from lineloom.llm.queries import queries

    d = "/root/testdata/sf0.01"
    if not os.path.isdir(d):
        pytest.skip("no tables")
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{d}/labels.parquet").filter("quality is not null").collect()}
    judged = [(r.kept, truth[r.doc_id]) for r in queries()["op9_quality_rules"](spark, d).filter("not base_failed").collect() if r.doc_id in truth]
    good = [k for k, q in judged if q]
    bad = [k for k, q in judged if not q]
    assert sum(good) >= 0.9 * len(good)
    assert len(bad) >= 3 and sum(bad) <= 0.5 * len(bad)
