"""Views restored from pages and from the prompts of examples."""

import pytest

from lineloom.operators import restoring as R

PAGES = "file string, CLIs array<string>, ParentView array<string>, FuncDef string, Examples array<array<string>>"
COMMANDS = "id int, file string, format_index int, format string, view string, target string"

POOL = ["<H> system-view", "[~H] pool test", "[*H-pool-test] address 10.0.0.0 24", "[*H-pool-test] rule 5", "[*H-pool-test-rule5] mask 9"]
ROWS = [
    ("pool.json", ["pool <name>"], ["System  view"], None, []),
    ("address.json", ["address <ip> <len>"], ["Pool view"], None, [POOL[:3], ["<H> system-view", "[H] pool b", "[H-b] quit", "[H] address 1 2"]]),
    ("rule.json", ["rule <id>"], ["Pool view"], None, []),
    ("mask.json", ["mask <m>"], ["Rule view"], None, [POOL]),
    ("two.json", ["rule <id>"], ["Rule view", "Zone view"], None, [POOL[:4]]),
    ("bad.json", ["x { a"], ["Zone view"], None, [POOL]),
]
LIST = [(0, "pool.json", 0, "pool <name>", "System view", None), (1, "address.json", 0, "address <ip> <len>", "Pool view", None), (2, "rule.json", 0, "rule <id>", "Pool view", None), (3, "mask.json", 0, "mask <m>", "Rule view", None)]


def tables(spark, rows=ROWS, commands=LIST):
    return spark.createDataFrame(commands, COMMANDS), spark.createDataFrame(rows, PAGES)


def test_switches_follow_prompts(spark):
    """The pool's target isn't known by the time the rule is met, so only what leads out of the entry view is seen at first."""
    commands, pages = tables(spark)
    assert {(r.id, r.target, r.file, r.example) for r in R.example_switches(commands, pages, "System view").collect()} == {(0, "pool view", "address.json", 0)}
    known, pages = tables(spark, commands=[(*c[:5], "pool view") if c[0] == 0 else c for c in LIST])
    assert {(r.id, r.target) for r in R.example_switches(known, pages, "System view").collect()} == {(0, "pool view"), (2, "rule view")}


def test_restored_views(spark):
    commands, pages = tables(spark, commands=[(*c[:5], "pools") if c[0] == 0 else c for c in LIST[:3]])
    # the page says "pools"; the address' page calls it the Pool view, which goes by the other name
    assert {(r.id, r.view, r.target, r.source) for r in R.restore(commands, pages, "System  View").collect()} == {(0, "system view", "pools", "stated"), (1, "pools", None, None), (2, "pools", None, None)}


def test_contradictions_are_raised(spark):
    commands, pages = tables(spark)
    with pytest.raises(ValueError, match="broken hierarchy.*rule view"):
        R.restore(commands, pages, "System view")
    with pytest.raises(ValueError, match="another format"):
        R.restore(tables(spark, commands=[(0, "pool.json", 0, "pool <n>", "System view", None)])[0], pages, "System view")
    observed = spark.createDataFrame([(0, "pool view"), (1, "pool view")], "id int, target string")
    both = spark.createDataFrame([(0, "a", 0, "a", "s", "x"), (1, "a", 0, "b", "s", "y")], COMMANDS)
    assert [(r.parent, r.n_targets) for r in R.restored(both, observed)[1].collect()] == [("pool view", 2)]


def test_problems(spark):
    commands, pages = tables(spark, commands=[(0, "no.json", 0, "x", "a", None), (1, "pool.json", 3, "pool <name>", "System view", None), (2, "pool.json", 0, "pool <name>", "Pool view", None), (3, "pool.json", 0, "pool <name>", "system VIEW", None)])
    assert {tuple(r) for r in R.source_problems(commands, pages).collect()} == {(0, "no page"), (1, "another format"), (2, "another parent view")}
    views = spark.createDataFrame([("a", "b"), ("a", "gone"), ("b", None), ("z", "lost")], "view string, target string")
    assert {tuple(r) for r in R.hierarchy_problems(views, "a").collect()} == {("gone", "a target without commands"), ("z", "nothing leads to it")}
    assert ("q", "no entry view") in {tuple(r) for r in R.hierarchy_problems(views, "q").collect()}


def test_empty(spark):
    commands, pages = tables(spark)
    assert R.example_switches(commands, pages.limit(0), "System view").collect() == []
    assert R.example_switches(commands.limit(0), pages, "System view").collect() == []
