"""Questions on views, their pages, and answers to them."""

import json

import pytest
from pyspark.sql import functions as F

from lineloom.operators import evidence as E
from lineloom.storage import written

PAGES = "file string, PageTitle string, CLIs array<string>, ParentView array<string>, FuncDef string, ParaDef array<struct<Parameters:string,Info:string>>, UsageGuidelines string, Examples array<array<string>>, related_topics array<struct<title:string,target_files:array<string>>>"
ANSWERS = "id int, kind string, target string, members array<string>, evidence array<struct<file:string,field:string,quote:string>>"


def page(file, views, func="", use="", to=(), examples=()):
    return file, file, [], views, func, [("p", "an area's number")], use, [list(e) for e in examples], [("t", list(to))]


@pytest.fixture(scope="module")
def case(spark):
    pages = spark.createDataFrame(
        [
            page("area.json", ["System view"], "The area command enters the routing area view.", to=["net.json"]),
            page("net.json", ["OSPF area view", "IS-IS area view"], use="Short."),
            page("cost.json", ["OSPF area view"], use="First run the area command in the Area view."),
            page("mtu.json", ["OSPF area view"], use="x"),
            page("quit.json", ["System view"], "The quit command returns to the area view.", to=["net.json"]),
            page("all.json", ["All views"], "Nothing of an area."),
            page("lone.json", None, None, None),
        ],
        PAGES,
    )
    commands = spark.createDataFrame(
        [
            (0, "area.json", "area <n>", ["System view"], "Routing area view", False),
            (1, "area.json", "area <n> more", ["System view"], "Routing area view", False),
            (2, "quit.json", "quit", ["System view"], "OSPF area view", False),
            (3, "mtu.json", "mtu <n>", ["OSPF area view"], "system VIEW", False),
            (4, "all.json", "any", ["All views"], None, True),
            (5, "cost.json", "cost", ["OSPF area view"], None, False),
        ],
        "id int, file string, format string, parent_views array<string>, requested string, uncertain boolean",
    )
    asked = written(E.questions(commands, pages, ("All views",)))
    ranked = written(E.candidates(asked, commands, pages, ("All views",)))
    return pages, commands, asked, ranked, written(E.supporting(asked, ranked, pages))


def test_questions(case):
    assert {(r.id, r.file, r.requested, tuple(r.commands), r.exits) for r in case[2].collect()} == {(0, "area.json", "Routing area view", (0, 1), False), (2, "quit.json", "OSPF area view", (2,), True), (4, "all.json", None, (4,), False)}


def test_candidates_and_pages(case):
    *_, ranked, chosen = case
    got = {}
    for r in ranked.orderBy("rank").collect():
        got.setdefault(r.id, []).append(r.view)
    assert got == {0: ["OSPF area view", "IS-IS area view"], 4: ["OSPF area view", "IS-IS area view"]}
    pages = {}
    for r in chosen.collect():
        pages.setdefault(r.id, set()).add(r.file)
    assert pages == {0: {"area.json", "net.json"}, 2: {"quit.json"}, 4: {"all.json", "mtu.json", "net.json"}}


def test_pages_that_name_the_command_come_before_others(spark, case):
    pages = case[0].withColumn("related_topics", F.array().cast(dict(case[0].dtypes)["related_topics"]))
    asked = case[2].filter("id = 0")
    ranked = E.candidates(asked, case[1], pages)
    assert {r.file for r in E.supporting(asked, ranked, pages).collect()} == {"area.json", "cost.json", "net.json"}


def test_mentions(spark, case):
    names = spark.createDataFrame([("area",), ("the area",), ("acl number",), ("first",)], "name string")
    texts = spark.createDataFrame([("a", "run the  Area command; the acl number command and area commands"), ("b", "acl-number command"), ("c", None), ("d", "command area")], "file string, UsageGuidelines string")
    assert {tuple(r) for r in E.mentions(texts, names).collect()} == {("a", "area"), ("a", "the area"), ("a", "acl number")}


def test_requests(case):
    pages, _, asked, ranked, chosen = case
    got = {r.id: json.loads(r.request) for r in E.requests(asked, ranked, chosen, pages).collect()}
    assert got[0]["candidate_views"] == ["OSPF area view", "IS-IS area view"] and [p["file"] for p in got[0]["pages"]] == ["area.json", "net.json"]
    assert got[2]["candidate_views"] == [] and got[0]["commands"] == [0, 1]


PROSE = ("area.json", "FuncDef", "enters the routing area view")
CASES = [
    (("alias", "OSPF area view", [], [PROSE, ("net.json", "ParentView", "OSPF area view")]), set()),
    (("alias", "System view", None, [PROSE]), set()),
    (("alias", "OSPF area view", [], [PROSE]), {"the evidence doesn't name the target"}),
    (("alias", "OSPF area view", [], [PROSE, ("net.json", "ParentView", "OSPF")]), {"a part of a parent view's name", "the evidence doesn't name the target"}),
    (("alias", "OSPF area view", [], [("net.json", "ParentView", "OSPF area view")]), {"a relation without prose"}),
    (("alias", None, ["System view"], [PROSE]), {"a fixed transition takes one target and no members"}),
    (("group", "Routing area view", ["OSPF area view", "IS-IS area view"], [PROSE, ("net.json", "UsageGuidelines", "Short")]), set()),
    (("group", "Other", ["OSPF area view", "OSPF area view"], [PROSE]), {"a group goes by another name than asked for", "members twice", "a member without prose"}),
    (("group", None, [], [PROSE]), {"a group takes a target that isn't a member, and members", "a group goes by another name than asked for"}),
    (("alias", "System view", [], [("mtu.json", "UsageGuidelines", "x"), PROSE]), {"a quotation that isn't in a page shown"}),
    (("alias", "System view", [], [("area.json", "FuncDef", "not there"), PROSE]), {"a quotation that isn't in a page shown"}),
    (("exit_parent", None, [], [("area.json", "ParaDef", "area's number")]), set()),
    (("exit_parent", "x", [], [PROSE]), {"leaving for the parent has no target and no members"}),
    (("unknown", None, ["Zoo"], None), {"members that are no candidates", "members without a relation"}),
    (("missing", None, [], []), {"a missing view without a name"}),
    ((None, None, [], []), {"a kind that isn't one"}),
    (("ambiguous", None, ["IS-IS area view"], []), set()),
]


def test_answers(spark, case):
    """Each answer by itself, as an answer to a copy of the first question."""
    pages, commands, asked, ranked, chosen = case
    of = spark.range(len(CASES)).select(F.col("id").cast("int").alias("copy"))
    copies = lambda d: d.filter("id = 0").crossJoin(of).withColumn("id", F.col("copy")).drop("copy")
    answers = spark.createDataFrame([(i, *a) for i, (a, _) in enumerate(CASES)] + [(99, "unknown", None, [], [])], ANSWERS)
    problems = E.answer_problems(answers, copies(asked), copies(ranked), copies(chosen), E.views_with_commands(commands), pages)
    got = {}
    for r in problems.collect():
        got.setdefault(r.id, set()).add(r.problem)
    assert got.pop(99) == {"an answer to no question"}
    assert {i: got.get(i, set()) for i in range(len(CASES))} == {i: w for i, (_, w) in enumerate(CASES)}
    assert {r.id for r in E.taken_answers(answers, problems).collect()} == {i for i, (_, w) in enumerate(CASES) if not w}


def test_empty(spark, case):
    pages, commands, *_ = case
    asked = E.questions(commands.limit(0), pages)
    ranked = E.candidates(asked, commands, pages)
    assert E.supporting(asked, ranked, pages).collect() == []
