"""Documentation pages: formats, types, transitions, examples, checks."""

import pytest
from pyspark.sql import functions as F

from lineloom.functions.pages import prompt, switch_evidence
from lineloom.grammar.sessions import read_example
from lineloom.operators import corpus as C

PAGES = "file string, PageTitle string, CLIs array<string>, ParentView array<string>, FuncDef string, ParaDef array<struct<Parameters:string,Info:string>>, UsageGuidelines string, Examples array<array<string>>, related_topics array<struct<title:string,reference_kind:string,target_files:array<string>,target_sections:array<string>>>, section string"


def page(file, title, clis, views, func="", para=(), examples=(), topics=(), section=None):
    return file, title, clis, views, func, list(para), "", [list(e) for e in examples], list(topics), section


@pytest.fixture(scope="module")
def pages(spark):
    session = ["<H> system-view", "[~H] pool test", "[*H-pool-test] address 10.0.0.0 24", "[*H-pool-test] rule 5", "[*H-pool-test-rule5] mask 9"]
    broken = ["[H] pool x", "[H-pool-x] quit", "[Z] address 1 2"]
    return spark.createDataFrame(
        [
            page("pool.json", "pool", ["pool <name>", "undo pool <name>"], ["System view"], "The pool command creates an address pool and displays the Pool view.", [("name", "Specifies the name. The value is a string of 1 to 9.")], topics=[("t", "k", ["address.json", "gone.json"], ["2.2"])], section="2.1"),
            page("address.json", "address", ["address <ip> <len>", "display address"], ["Pool view"], "", [("ip", "Specifies an IPv4 address in dotted decimal notation."), ("len", "The value is an integer ranging from 1 to 32.")], [session, broken], section="2.2"),
            page("rule.json", "rule", ["rule <id>"], ["Pool view"], "The rule command may enter the Rule view.", [("id", "An integer."), ("other", "x")], section="2.3"),
            page("mask.json", "mask", ["mask <m> &<1-3>"], ["Rule view"], "", [("m", "Something else.")], [session, ["pool test", " rule 5", "  mask 9"]]),
        ],
        PAGES,
    )


def test_formats_and_types(spark, pages):
    got = {(r.file, r.format_index): (r.converted, r.unknown) for r in C.mock_formats(pages).collect()}
    assert got == {
        ("pool.json", 0): ("pool STRING<1-65535>", []),
        ("pool.json", 1): ("undo pool STRING<1-65535>", []),
        ("address.json", 0): ("address X.X.X.X INTEGER<1-32>", []),
        ("rule.json", 0): ("rule INTEGER<0-4294967295>", []),
        ("mask.json", 0): ("mask <m> &<1-3>", ["m"]),
    }
    notes = spark.createDataFrame([("pool.json", 0, "name", "unknown"), ("address.json", 0, "ip", "ipv4-address"), ("rule.json", 0, "zz", "string")], "file string, format_index int, name string, type string")
    typed = {(r.file, r.format_index, r["name"]): (r.type, r.changed) for r in C.completed_types(pages, notes).collect()}
    assert typed["pool.json", 0, "name"] == ("string", True) and typed["address.json", 0, "ip"] == ("ipv4-address", False) and typed["mask.json", 0, "m"] == ("unknown", True)
    assert [r["name"] for r in C.stray_types(pages, notes).collect()] == ["zz"]


@pytest.mark.parametrize(
    "description,want",
    [
        ("The value is a string bound to an IPv4 address", "STRING<1-65535>"),
        ("Specifies a MAC address in H-H-H format", "H-H-H"),
        ("Specifies an IPv6 address", "X:X::X:X"),
        ("Specifies the IPv6 prefix", "X:X::X:X/M"),
        ("IPv6 prefix length, an integer ranging from 1 to 128", "INTEGER<1-128>"),
        ("An integer ranging from 9 to 1", "INTEGER<0-4294967295>"),
        ("A hexadecimal number", "HEX<0-FFFFFFFF>"),
        ("AS number in dotted notation", None),
        ("Number: 2-byte", None),
        ("anything", None),
    ],
)
def test_placeholders(spark, description, want):
    from pyspark.sql import functions as F

    from lineloom.functions.pages import placeholder

    assert spark.createDataFrame([(description,)], "d string").select(placeholder(F.col("d"))).first()[0] == want


def test_views_said(pages):
    assert [(r.file, r.format_index, r.view) for r in C.stated_switches(pages).collect()] == [("pool.json", 0, "pool view")]


SAID = [
    ("acl [ number ] <n>", "The acl number command enters the Basic ACL view. The acl command enters the ACL view.", ("Basic ACL view", "The acl number command enters the Basic ACL view.")),
    ("acl <n>", "The acl command enters the X view or the B view.", None),
    ("acl <n>", "The acl command does not enter the X view.", None),
    ("acl <n>", "The acl command can't fail and enters the X view.", None),
    ("acl <n>", "The acl command enters the X view\nand more", ("X view", "The acl command enters the X view")),
    ("acl <n>", "Note: the ACL command creates an ACL and displays the ACL-adv view.", ("ACL-adv view", "the ACL command creates an ACL and displays the ACL-adv view.")),
    ("acl <n>", "The rule command enters the X view.", None),
    ("acl <n>", "The acl command enters the view.", None),
    ("acl <n>", "The acl command enters the c b view. The acl command opens the C B view.", ("c b view", "The acl command enters the c b view.")),
    ("acl <n>", "The acl command enters the X view. The acl command opens the B view.", None),
    ("acl <n>", "The acl command enters the X view of this view.", None),
    ("acl <n>", "The acl command, though, enters the X view.", ("X view", None)),
    ("acl <n>", "", None),
    ("acl <n>", "The command enters the X view. command", None),
    ("acl <n>", "The acl command enters the current view.", None),
]


def test_sentences_about_views(spark):
    rows = [(i, f, t) for i, (f, t, _) in enumerate(SAID)]
    out = {r.i: r.e for r in spark.createDataFrame(rows, "i int, f string, t string").select("i", switch_evidence(F.col("f"), F.col("t")).alias("e")).collect()}
    for i, (f, t, want) in enumerate(SAID):
        if want and want[1] is None:  # a comma within the subject: not a statement about the command
            want = None
        assert (out[i] and tuple(out[i])) == want, (f, t)


def test_sentences_about_views_at_length(spark):
    """Each word is looked at a bounded number of times, and a sentence begins at its first word after a tab too."""
    rows = ["See\tbelow \tthe acl command enters the X view.", "Of (the -(the acl command enters the X view.", "The acl command " + "enters the X view " * 50_000, "the " + "the a " * 50_000 + "commands enter the X view."]
    df = spark.createDataFrame(list(enumerate(rows)), "i int, t string").select("i", switch_evidence(F.lit("acl <n>"), F.col("t")).alias("e"))
    out = dict(df.select("i", F.struct("e.view", F.substring("e.text", 1, 40).alias("text")).alias("e")).collect())
    assert [tuple(out[i]) for i in range(4)] == [("X view", "the acl command enters the X view."), ("X view", "the acl command enters the X view."), ("X view", "The acl command enters the X view enters"), (None, None)]


def test_views_said_are_read_by_many_tasks(spark, tmp_path):
    """A table of small rows is one split, and its texts are dealt out nevertheless."""
    import __spark_entry__

    spark.range(1000).selectExpr("id AS p_partkey", "concat('red', id % 10, ' x') AS p_name", "cast(id % 50 AS int) AS p_size").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = __spark_entry__.queries()["q_views_said"](spark, str(tmp_path))
        assert out.select(F.spark_partition_id()).distinct().count() > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_prompts(spark):
    rows = ["<H> show x ", "[~H-a] b 2", " [*H]c", "[H]", "plain", "<a <b> c", "[]", "<>x", None, "[a [b] c"]
    p, c = prompt(F.col("line"))
    out = [tuple(r) for r in spark.createDataFrame([(x,) for x in rows], "line string").select(p, c).collect()]
    assert out == [("<H>", "show x"), ("[H-a]", "b 2"), ("[H]", "c"), ("[H]", ""), *[(None, None)] * 6]


def test_related_and_sample(pages):
    got = {(r.file, r.other) for r in C.related(pages).collect()}
    assert got == {(f, f) for f in ("pool.json", "address.json", "rule.json", "mask.json")} | {("pool.json", "address.json")}
    assert [r.file for r in C.pilot(pages, 2).collect()][0] == "rule.json" and C.pilot(pages, 9).count() == 4


def test_sessions():
    said, problems = read_example(["caption", "<H> system-view", "[~H] a 1", "[*H-a] b 2", "[*H-a-b] c", "[*H-a-b] quit", "[*H-a] d", "[*H-a] return", "<H> show"])
    assert [(s.text, [w.text for w in s.within], s.rooted) for s in said if s.text not in ("quit", "return", "system-view")] == [("a 1", [], True), ("b 2", ["a 1"], True), ("c", ["a 1", "b 2"], True), ("d", ["a 1"], True), ("show", [], False)]
    assert problems == []
    _, problems = read_example(["[H] a", "[H-a] quit", "[Z] b"])
    assert [p[1] for p in problems] == ["unknown_initial_context", "unexpected_prompt_after_exit"]
    said, problems = read_example(["<H> system-view", "[H] sysname N", "[N] a", "[N-a] b"])
    assert problems == [] and [w.text for w in said[-1].within] == ["a"]
    said, _ = read_example(["a", "\tb", "        c", "  d", "#", " e"])
    assert [(s.text, [w.text for w in s.within], s.rooted) for s in said] == [("a", [], True), ("b", ["a"], True), ("c", ["a"], True), ("d", ["a"], True), ("e", [], False)]


def test_switches_from_examples(spark, pages):
    rows = [("pool.json", 0, "System view", 0, "pool <name>"), ("pool.json", 1, "System view", 1, "undo pool <name>"), ("address.json", 0, "Pool view", 0, "address <ip> <len>"), ("rule.json", 0, "Pool view", 1, "rule <id>"), ("mask.json", 0, "Rule view", 0, "mask <m> &<1-3>")]
    records = spark.createDataFrame([(*r, "[]", []) for r in rows], "file string, format_index int, view string, index int, format string, types string, targets array<string>")
    found, left = C.recover_switches(records, pages, "System view")
    assert {(r.view, r["index"]): (r.targets, r.first_pass) for r in found.collect()} == {("System view", 0): (["Pool view"], 1), ("Pool view", 1): (["Rule view"], 2)}
    assert left.collect() == []
    _, problems = C.example_commands(pages)
    assert {r.reason for r in problems.collect()} >= {"unexpected_prompt_after_exit"}


def test_names_and_answers(spark):
    names = spark.createDataFrame([("ACL View",), ("acl  view",), ("Pool view",), ("Rule View",)], "view string")
    asked = spark.createDataFrame([("ACL View",), ("ACL VIEW",), ("pool  VIEW",), ("none",)], "asked string")
    assert {r.asked: (r.status, r.target, r.method) for r in C.resolved_names(asked, names).collect()} == {"ACL View": ("resolved", "ACL View", "exact"), "ACL VIEW": ("ambiguous", None, None), "pool  VIEW": ("resolved", "Pool view", "normalized"), "none": ("missing", None, None)}
    rows = spark.createDataFrame([(1, "x", "alias", "pool view", []), (2, None, "exit_view", "rule view", []), (3, None, "group", "Every view", ["Pool view", "gone"]), (4, "x", "group", "Other", ["gone"]), (5, "x", "unknown", None, []), (6, None, "unknown", None, []), (7, None, "exit_parent", None, []), (8, "x", "alias", "acl VIEW", [])], "id int, requested string, kind string, target string, members array<string>")
    assert {r.id: (r.status, r.target) for r in C.answered(rows, names).collect()} == {1: ("resolved", "Pool view"), 2: ("exit_view", "Rule View"), 3: ("grouped", "Every view"), 4: ("missing", None), 5: ("missing", None), 6: ("unknown", None), 7: ("exit_parent", None), 8: ("ambiguous", None)}


def test_hierarchy_and_shared(spark):
    edges = spark.createDataFrame([("r", "a"), ("a", "b"), ("x", "y"), ("a", "gone")], "src string, dst string")
    views = spark.createDataFrame([("r",), ("a",), ("b",), ("x",), ("y",)], "view string")
    got = {r.view: (r.reachable, r.has_commands) for r in C.hierarchy_report(edges, views, "r").collect()}
    assert got == {"r": (True, True), "a": (True, True), "b": (True, True), "gone": (True, False), "x": (False, True), "y": (False, True)}
    m = spark.createDataFrame([("a", 1), ("b", 2), ("s", 3), ("a", 3)], "view string, id int")
    assert sorted(map(tuple, C.with_shared(m, ["s"]).collect())) == [("a", 1), ("a", 3), ("b", 2), ("b", 3), ("s", 3)]


def test_retrieval(spark):
    focus = spark.createDataFrame([(1, "the basic acl", ["Zone view"])], "id int, text string, linked array<string>")
    views = spark.createDataFrame([("Basic ACL view",), ("ACL view",), ("Pool view",), ("Zone view",)], "view string")
    assert [r.view for r in C.ranked_views(focus, views).orderBy("rank").collect()] == ["Basic ACL view", "ACL view", "Zone view"]


def test_annotation_checks(spark, pages):
    schema = "file string, format_index int, types array<struct<name:string,type:string>>, target string, quote string, issues array<string>, selectors array<array<string>>"
    good = [("pool.json", 0, [("name", "string")], "Pool view", "displays the Pool view", [], [["name"]]), ("pool.json", 1, [], None, None, ["parameter_types"], []), ("address.json", 0, [("ip", "ipv4-address"), ("len", "integer")], None, None, [], [["ip", "len"]]), ("rule.json", 0, [("id", "unknown")], None, None, ["parameter_types"], []), ("mask.json", 0, [("m", "string")], None, None, [], [])]
    assert C.annotation_problems(spark.createDataFrame(good, schema), pages).collect() == []
    bad = [("pool.json", 0, [("name", "string"), ("name", "text")], "Pool view", "not there", ["switch_to_view"], []), ("address.json", 0, [("ip", "unknown"), ("zz", "string")], None, None, [], [["len", "ip"]]), ("address.json", 1, [], None, None, [], []), ("mask.json", 0, [("m", "string")], None, None, [], []), ("mask.json", 0, [("m", "string")], None, None, [], [])]
    got = {(r.file, r.format_index, r.problem) for r in C.annotation_problems(spark.createDataFrame(bad, schema), pages).collect()}
    assert {p for *_, p in got} == {"format without an annotation", "annotation without a format", "format annotated twice", "a name has two types", "a type for a name that isn't there", "values without a type or a word on it", "a target without a quote that names it", "an uncertain transition with a target", "a selector of names that aren't there or that stand apart"}


def test_positions_and_counts(spark):
    s = spark.createDataFrame([("a", 0, [0, 2]), ("b", 1, [0])], "file string, command_start int, format_indices array<int>")
    assert {(r.position, r.problem) for r in C.position_problems(C.source_positions(s), 4).collect()} == {(1, "taken twice"), (2, "missing"), (3, "missing")}
    c = spark.createDataFrame([("A", "a", [], 0), ("B", None, ["switch_to_view"], 2), (None, None, ["x"], 0)], "target string, canonical string, issues array<string>, n_unresolved_contexts int")
    assert tuple(C.assembly_counts(c).first()) == (3, 1, 1, 1, 1, 2)


def test_extraction_asks_once(spark, pages):
    def client(text):
        if "rule" in text.split("PageTitle")[1][:12]:
            raise ValueError("no")
        return "ok"

    first = C.extracted(pages, client)
    assert {r.file: (r.response, r.error) for r in first.collect()}["rule.json"] == (None, "ValueError: no")
    cache = spark.createDataFrame(first.collect(), first.schema)
    again = C.extracted(pages, lambda t: "new", cache)
    assert {r.file: r.response for r in again.collect()} == {"pool.json": "ok", "address.json": "ok", "mask.json": "ok", "rule.json": "new"}
    assert {r.response for r in C.extracted(pages, lambda t: "new", cache, version="2").collect()} == {"new"}


def test_coverage_by_target(spark):
    t = spark.createDataFrame([("A", "unresolved"), ("B", "resolved"), ("C", "unresolved"), ("D", "unresolved")], "right_view string, status string")
    k = spark.createDataFrame([("a", "A", "covered"), ("b", "A", "covered"), ("c", "C", "partial"), ("c", "B", "covered")], "left_view string, right_view string, status string")
    assert {r.right_view: r.resolution for r in C.coverage_by_target(t, k).collect()} == {"A": "ambiguous", "B": "resolved", "C": "partial", "D": "missing"}
