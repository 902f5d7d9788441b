"""Single lines, whole configurations, and that the distributed parser says what the plain one does."""

import json

import pytest

from lineloom.grammar.catalog import CatalogError, read, read_v1, recovered, strict_json, with_types
from lineloom.grammar.formats import parse
from lineloom.grammar.values import FormatError
from lineloom.parser import ConfigurationParser, LineParser, nested, physical_lines, summary

TREE = {
    "type": "grouped",
    "entry_view": "root",
    "global_view": "all",
    "views": {
        "root": [{"format": "enter <x>", "switch_to_view": "child"}, {"format": "enter fast", "switch_to_view": "leaf"}, {"format": "keep INTEGER<1-9>"}, {"format": "odd", "switch_to_view": {"status": "unresolved"}}],
        "child": ["name STRING<1-4>", {"format": "deep", "switch_to_view": "leaf"}],
        "leaf": ["set { a | b } *", "vlan { INTEGER<1-99> [ to INTEGER<1-99> ] } &<1-3>", "name <n>"],
        "all": ["help"],
    },
}
TEXT = "enter 1\n name abc\n deep\n  set b a\n  vlan 10 to 20 30\n#\n name x\nodd\n set a\nkepe 5\n help\nkeep 50\n\nhelp\n name q\nenter fast\n set a\n #\n set b\n\tdeep\n"


def brief(r):
    return r["line_number"], r["kind"], r["status"], r["view"], r["context_issue"] and (r["context_issue"]["code"], r["context_issue"]["source_line"])


def test_contexts():
    got = [brief(r) for r in ConfigurationParser(LineParser(TREE, mode="hierarchy")).parse(TEXT)]
    assert got[:17] == [
        (1, "command", "unique", "root", None),
        (2, "command", "unique", "child", None),
        (3, "command", "unique", "child", None),
        (4, "command", "unique", "leaf", None),
        (5, "command", "unique", "leaf", None),
        (6, "separator", None, None, None),
        (7, "unresolved_command", "ambiguous", None, ("outside_view", 7)),
        (8, "command", "unique", "root", None),
        (9, "unresolved_command", "unique", None, ("unresolved_transition", 8)),
        (10, "error", None, "root", None),
        (11, "unresolved_command", "unique", None, ("parent_parse_error", 10)),
        (12, "error", None, "root", None),
        (13, "blank", None, None, None),
        (14, "command", "unique", "root", None),
        (15, "unresolved_command", "ambiguous", None, ("outside_view", 15)),
        (16, "command", "unique", "root", None),
        (17, "command", "unique", "leaf", None),
    ]


def test_more_specific_format_decides_the_context():
    p = LineParser(TREE, mode="hierarchy")
    r = p.parse("enter fast")
    assert [m["original_pattern"] for m in r["matches"]] == ["enter fast"] and p.child_view(r) == "leaf"
    assert p.child_view(p.parse("help", view="child")) == "child"


def test_parts_of_a_catalog():
    p = LineParser(TREE)
    assert p.parse("keep 5")["kind"] == "command" and p.parse(" keep 5")["kind"] == "error"
    assert p.parse(" name abc")["status"] == "ambiguous"  # of two views
    assert p.parse(" help")["kind"] == p.parse("help")["kind"] == "command"
    assert p.parse(" #")["kind"] == "separator" and p.parse_flat("#")["kind"] == "error"
    assert p.parse("name abc")["error"]["message"].endswith("Search was restricted to system view 'root'.")


def test_spans_and_captures():
    r = LineParser({"commands": ["vlan { INTEGER<1-99> [ to INTEGER<1-99> ] } &<1-3>"]}).parse("  vlan 10 to 20 30 ")
    m = r["matches"][0]
    assert [(v["raw"], v["start"], v["end"], v["slot_id"], v["iterations"]) for v in m["parameters"]] == [("10", 7, 9, "p:7", [{"id": "r:5", "n": 0}]), ("20", 13, 15, "p:26", [{"id": "r:5", "n": 0}]), ("30", 16, 18, "p:7", [{"id": "r:5", "n": 1}])]
    assert m["variation"] == "vlan INTEGER<1-99> to INTEGER<1-99> INTEGER<1-99>" and m["trace"][-1] == {"kind": "repeat", "path": "root.1", "selected": ["2"]}


def test_equal_and_ambiguous():
    p = LineParser({"commands": ["a <x>", "a <x>", "b <x>", "b <y>", "c { <x> | <x> }"]})
    assert p.parse("a 1")["status"] == "equivalent" and p.parse("b 1")["status"] == "ambiguous" and p.parse("c 1")["status"] == "ambiguous"
    assert [m["pattern_id"][-1] for m in p.parse("a 1")["matches"]] == ["0", "1"]


def test_messages():
    p = LineParser({"commands": ["show clock", "show date", "port INTEGER<1-9> X.X.X.X", "text STRING<2-3>"]})
    e = p.parse("show")["error"]
    assert (e["code"], e["position"]) == ("syntax_error", 4) and [x["description"] for x in e["expected"]] == ["'clock'", "'date'"]
    assert "Parsing stopped at column 5; expected 'clock' or 'date'." in e["message"]
    e = p.parse("shwo clock")["error"]
    assert e["code"] == "unknown_command" and e["suggestions"][0] == "show clock" and e["position"] == 0
    e = p.parse("port 10 1.1.1.300")["error"]
    assert e["code"] == "validation_error" and [(f["reason_code"], f["start"], f["expected"]) for f in e["failures"]] == [("above_maximum", 5, "<= 9"), ("invalid_ipv4_address", 8, "four decimal octets from 0 to 255")]
    assert "2 parameter values failed validation: value '10' is invalid for INTEGER<1-9>: value must be at most 9; " in e["message"]
    e = p.parse("port x 1.1.1.1")["error"]
    assert e["failures"][0]["reason_code"] == "not_applicable" and e["failures"][0]["message"] == "value does not match INTEGER<1-9>"


def test_free_text_alone_reads_remarks():
    p = LineParser({"commands": ["TEXT<1-80>", "say TEXT<1-10>"]})
    assert p.parse("! a remark")["kind"] == "command" and p.parse("no remark")["kind"] == "error"
    assert p.parse("say two  words ")["matches"][0]["parameters"][0]["raw"] == "two  words"


def test_types_of_names():
    p = LineParser({"commands": [{"format": "port <n>", "parameter_types": [{"parameter_name": "n", "parameter_type": "integer"}]}]})
    assert p.parse("port 5")["matches"][0]["parameters"][0]["normalized"] == "5" and p.parse("port x")["kind"] == "error"
    for types in ({"m": "integer"}, {"n": "enum"}, {"n": "odd"}):
        with pytest.raises(FormatError):
            with_types(parse("port <n>"), types)


@pytest.mark.parametrize("bad", [5, {"type": "odd"}, {"commands": [5]}, {"commands": []}, {"type": "grouped", "entry_view": "x", "views": {}}, {"commands": ["a"], "views": {}}, {"type": "grouped", "entry_view": "r", "views": {"r": [{"format": "a", "switch_to_view": "q"}]}}, {"type": "grouped", "entry_view": "r", "global_view": "r", "views": {"r": ["a"]}}])
def test_bad_catalogs(bad):
    with pytest.raises(CatalogError):
        read(bad)


HEAD = {"schema_version": 1, "source": "device", "vendor": "v", "device": "d", "model_type": "m", "type": "flat"}


@pytest.mark.parametrize("change", [{"schema_version": True}, {"source": "x"}, {"vendor": " "}, {"commands": ["a"]}, {"commands": [{"format": "a\nb"}]}, {"commands": [{"format": "a", "id": 1}]}, {"commands": [{"format": "a", "parameter_types": []}]}, {"commands": [{"format": "a", "switch_to_view": None}]}, {"shared_views": []}])
def test_bad_v1_catalogs(change):
    assert read_v1(HEAD | {"commands": [{"format": "a"}]}).commands[0].format == "a"
    with pytest.raises(CatalogError):
        read_v1(HEAD | {"commands": [{"format": "a"}]} | change)


def test_json_and_recovered_transitions():
    with pytest.raises(CatalogError):
        strict_json('{"a": 1, "a": 2}')
    doc = {"type": "grouped", "entry_view": "r", "views": {"r": [{"format": "a"}, {"format": "b", "switch_to_view": "q"}, {"format": "c"}], "q": [{"format": "d"}]}}
    out = recovered(doc, read(doc), {0: "q", 1: None})
    assert [r.get("switch_to_view", "stay") for r in out["views"]["r"]] == ["q", "stay", {"status": "unresolved"}] and "switch_to_view" not in doc["views"]["r"][0]


def test_lines():
    assert physical_lines("") == [] and physical_lines("a\r\nb\rc\n") == ["a", "b", "c"] and physical_lines("\n") == [""]
    assert nested([(0, "a"), (1, "#"), (1, "b"), (0, "c"), (2, "d"), (1, "e"), (1, "")]) == [(None, 0), (None, 0), (None, 0), (None, 0), (3, 1), (3, 1), (None, 0)]
    with pytest.raises(ValueError):
        LineParser({"commands": ["a"]}).parse("a\nb")
    with pytest.raises(TypeError):
        LineParser({"commands": ["a"]}).parse("a", True)


def plain(v):
    """Structs of Spark as dictionaries."""
    from pyspark.sql import Row

    if isinstance(v, Row):
        return {k: plain(x) for k, x in v.asDict().items()}
    return [plain(x) for x in v] if isinstance(v, list) else v


@pytest.mark.parametrize("mode,contextual", [("hierarchy", None), ("system", None), ("system", False)])
def test_distributed_is_the_plain_one(spark, mode, contextual):
    from lineloom.operators.configurations import json_lines, parse_configurations, report

    texts = {"c1": TEXT, "c2": "", "c3": "\n\n", "c4": TEXT.replace("\n", "\r\n") + "\n  # \nenter 2\n name abc\n", "c5": None}
    rows = spark.createDataFrame(list(texts.items()), "config_id string, text string").repartition(3)
    parsed = parse_configurations(rows, TREE, mode=mode, contextual=contextual)
    got = {(r.config_id, r.line_no): plain(r) for r in parsed.collect()}
    want = {(c, r["line_number"]): r for c, t in texts.items() for r in ConfigurationParser(LineParser(TREE, mode=mode), contextual).parse(t or "")}
    assert got.keys() == want.keys()
    for k, r in want.items():
        for c in ("raw", "kind", "status", "view", "context_issue", "matches", "error"):
            assert got[k][c] == r[c], (k, c)
    counts = {r.config_id: r.asDict() for r in report(parsed).collect()}
    for c, t in texts.items():
        s = summary(ConfigurationParser(LineParser(TREE, mode=mode), contextual).parse(t or ""))
        assert counts.get(c, dict.fromkeys(s, 0) | {"config_id": c}) == s | {"config_id": c}
    assert all("null" not in json.loads(r.json) for r in json_lines(parsed).collect())


def test_empty_input(spark):
    from lineloom.operators.configurations import parse_configurations

    none = spark.createDataFrame([], "config_id long, text string")
    for mode in ("system", "hierarchy"):
        assert parse_configurations(none, TREE, mode=mode).collect() == []


def test_types_of_the_users_own_are_read_by_all_tasks(spark):
    """A registry with a type made here, by a closure, reaches the workers; lines are those of the plain parser."""
    import re

    from lineloom.grammar.values import INVALID, REGISTRY, VALID, Probe, ValueType
    from lineloom.operators.configurations import parse_configurations

    least = 3
    even = REGISTRY.copy()
    even.add(ValueType("even", "numeric", lambda d, raw: Probe(VALID, int(raw)) if raw.isdigit() and int(raw) % 2 == 0 and len(raw) >= least else Probe(INVALID, code="odd"), re.compile("EVEN")))
    document = {"type": "grouped", "entry_view": "top", "views": {"top": [{"format": "port EVEN", "switch_to_view": "in"}], "in": ["set EVEN end"]}}
    text = "port 100\n set 222 end\n set 7 end\nport 12\n"
    for mode in ("system", "hierarchy"):
        plain = ConfigurationParser(LineParser(document, even, mode)).parse(text)
        got = parse_configurations(spark.createDataFrame([(1, text)], "config_id int, text string"), document, mode=mode, registry=even).orderBy("line_no").collect()
        assert [(r.kind, r.status) for r in got] == [(r["kind"], r["status"]) for r in plain]
        assert got[0].status == "matched" or got[0].kind == "command"
    with pytest.raises(ValueError):
        parse_configurations(spark.createDataFrame([(1, text)], "config_id int, text string"), {"commands": ["port EVEN {"]}, registry=even)


ODD = ["", None, "\n", "a", "a\n", "a\n\n", "a\r\nb\rc\n\r", " \x1c a b　\n \t\n\x85# \n  #\n x\x0b y\x0c", "\r", "  \n   deep\n​z﻿ \n\x00q\x1f", "\U0001f600 x \U0001f600\n \U0001f600"]


def test_lines_without_contexts_are_cut_alike(spark):
    """Texts of any ends and blanks, by built-in functions and by plain Python, in batches of few and of many lines."""
    from lineloom.operators.configurations import BLANKS, BATCH_LINES, configuration_lines, plain_lines
    from lineloom.parser import structure

    long = "".join(f"{' ' * (i % 3)}x {i}\n" for i in range(BATCH_LINES + 7))
    rows = [(k, t) for k, t in enumerate([*ODD, *(f"{a}b{a}c" for a in BLANKS), long, *ODD])]
    want = set()
    for k, t in rows:
        lines = physical_lines(t or "")
        want |= {(k, i, raw, d, None if p is None else p + 1, level, raw.strip()) for i, (raw, (d, p, level)) in enumerate(zip(lines, structure(lines), strict=True), 1)}
    df = spark.createDataFrame(rows, "c long, t string").coalesce(1)
    cut = [tuple(r) for r in configuration_lines(df, "c", "t").collect()]
    assert len(cut) == len(want) and set(cut) == want
    cut = [tuple(r) for r in plain_lines(df, "c", "t").collect()]
    assert len(cut) == len(want) and set(cut) == {(k, i, raw, d, command) for k, i, raw, d, _, _, command in want}


@pytest.mark.parametrize("document", [{"commands": ["a <x>"]}, TREE])
def test_python_sees_distinct_commands_alone(spark, document):
    """Without contexts from above, and in more than one task however short they are."""
    from pyspark.sql import functions as F

    from lineloom.operators.configurations import parse_configurations, recognised

    rows = spark.range(1000).selectExpr("id AS config_id", "concat('a ', id % 500) AS text")
    plan = parse_configurations(rows, document)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1
    asked = rows.selectExpr("cast(null AS string) AS view_in", "cast(null AS string) AS issue_in", "0 AS depth", "text AS command")
    found = recognised(asked, {"commands": ["a <x>"]}, "system", "flat")
    at = found.select("command", F.spark_partition_id().alias("at")).collect()
    assert len(at) == 500 and len({r["at"] for r in at}) > 1
