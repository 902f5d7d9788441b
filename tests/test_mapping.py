"""Mapping of catalogs, its lookup and replay, and the recovery of views."""

import json

import pytest

from lineloom.grammar.aligning import aligned, replay
from lineloom.grammar.formats import parse
from lineloom.grammar.languages import intersection
from lineloom.grammar.proving import predictive, shortest, witnesses
from lineloom.grammar.ruling import RuleError, application, check, holds
from lineloom.operators import hierarchy as H
from lineloom.operators import mapping as M
from lineloom.operators.configurations import parse_configurations

HEAD = {"schema_version": 1, "vendor": "v", "device": "d", "model_type": "m", "type": "grouped"}


def types(**kw):
    return [{"parameter_name": k, "parameter_type": v} for k, v in kw.items()]


DEVICE = HEAD | {
    "source": "device",
    "entry_view": "root",
    "views": {
        "root": [{"format": "enter INTEGER<1-9>"}, {"format": "keep STRING<1-4>"}, {"format": "vlan { INTEGER<1-99> [ to INTEGER<1-99> ] } &<1-3>"}],
        "a": [{"format": "name STRING<1-4> [ x ]"}, {"format": "deep { x | y }"}, {"format": "old X.X.X.X"}],
        "b": [{"format": "set { p | q }"}, {"format": "more X.X.X.X"}, {"format": "enter INTEGER<1-9>"}],
    },
}
DOCUMENTS = HEAD | {
    "source": "documentation",
    "entry_view": "Root",
    "views": {
        "Root": [{"format": "enter <id>", "switch_to_view": "A", "parameter_types": types(id="integer"), "creates": [{"kind": "thing"}]}, {"format": "keep <k>"}, {"format": "vlan { <first> [ to <last> ] } &<1-3>", "parameter_types": types(first="integer", last="integer")}],
        "A": [{"format": "name <n>", "parameter_types": types(n="string")}, {"format": "deep x", "switch_to_view": "B"}, {"format": "deep y", "switch_to_view": "B"}],
        "B": [{"format": "set { q | p }"}, {"format": "old <where> more", "parameter_types": types(where="ipv4-address")}],
    },
}


@pytest.fixture(scope="module")
def mapped(spark):
    return M.map_catalogs(spark, DEVICE, DOCUMENTS)


def test_stages_and_scopes(mapped):
    got = {(r.format, r.view): (r.status, r.stage) for r in mapped.devices.collect()}
    assert got == {
        ("enter INTEGER<1-9>", "root"): ("matched", "exact"),
        ("keep STRING<1-4>", "root"): ("matched", "exact"),
        ("vlan { INTEGER<1-99> [ to INTEGER<1-99> ] } &<1-3>", "root"): ("matched", "exact"),
        ("name STRING<1-4> [ x ]", "a"): ("matched", "intersection"),
        ("deep { x | y }", "a"): ("matched", "intersection"),
        ("old X.X.X.X", "a"): ("partial", "prefix"),
        ("set { p | q }", "b"): ("matched", "reordered"),
        ("more X.X.X.X", "b"): ("unmatched", None),
        ("enter INTEGER<1-9>", "b"): ("unmatched", None),  # documented in the entry view alone
    }
    n = {(r.what, r.value): r.n for r in M.summary(mapped).collect()}
    assert n["device status", "matched"] == 6 and n["pair status", "prefix_match"] == 1


def test_types_keep_pairs_apart(spark):
    device = HEAD | {"type": "flat", "source": "device", "commands": [{"format": "a INTEGER<1-9>"}, {"format": "b { STRING<1-2> | c INTEGER<1-2> }"}]}
    docs = HEAD | {"type": "flat", "source": "documentation", "commands": [{"format": "a <x>", "parameter_types": types(x="ipv4-address")}, {"format": "b { c <n> | <s> }", "parameter_types": types(n="integer", s="string")}]}
    m = M.map_catalogs(spark, device, docs)
    got = {r.format: (r.status, r.stage) for r in m.devices.collect()}
    assert got == {"a INTEGER<1-9>": ("unmatched", None), "b { STRING<1-2> | c INTEGER<1-2> }": ("matched", "reordered")}
    pair = m.pairs.collect()[0]
    assert [(b.document, b.device) for b in pair.bindings] == [("p:12", "p:4"), ("p:6", "p:20")]


def test_a_budget_that_ends_is_unknown(spark):
    m = M.map_catalogs(spark, DEVICE, DOCUMENTS, steps=3)
    got = {r.format: r.status for r in m.devices.filter("view = 'a'").collect()}
    assert got["deep { x | y }"] == "unknown"


def test_lookup_and_replay(spark, mapped):
    rows = spark.createDataFrame([(1, "enter 5\n name ab\n name ab x\nvlan 10 to 20 30\n")], "config_id int, text string")
    parsed = parse_configurations(rows, DEVICE)
    out = {(r.line_no, r.document_id): r for r in M.semantic_lookup(parsed, mapped).collect()}
    assert set(out) == {(1, "doc:0"), (2, "doc:3"), (3, "doc:3"), (4, "doc:2")}
    assert json.loads(out[1, "doc:0"].creates) == [{"kind": "thing"}] and out[2, "doc:3"].needs_trace and not out[4, "doc:2"].needs_trace
    names = {r.slot_id: r.name for r in M.slots_of(mapped.documentation).filter("id = 'doc:2'").collect()}
    assert sorted((names[p.slot_id], p.raw, p.iterations[0].n) for p in out[4, "doc:2"].parameters) == [("first", "10", 0), ("first", "30", 1), ("last", "20", 0)]
    ways = M.replayed(parsed, mapped).collect()
    assert [(r.line_no, r.document_id, [(b.document, b.raw) for b in r.bindings]) for r in ways] == [(2, "doc:3", [("p:5", "ab")])]


def test_replay_of_repeats():
    g = intersection(parse("v { <a> | <b> to <c> } &<1-2>"), parse("v { INTEGER<1-9> [ to INTEGER<1-9> ] } &<1-2>")).graph()
    from lineloom.parser import LineParser

    m = LineParser({"commands": ["v { INTEGER<1-9> [ to INTEGER<1-9> ] } &<1-2>"]}).parse("v 1 to 2 3")["matches"][0]
    ways = replay(g, m)
    assert [[(w["document"], w["raw"], w["iterations"][0][1]) for w in x] for x in ways] == [[("p:10", "1", 0), ("p:17", "2", 0), ("p:4", "3", 1)]]
    assert replay(g, m, limit=2) is None


def test_alignment_by_shape():
    a, b = parse("{ x <p> | y <q> } z <r>"), parse("{ y <s> | x <t> } z <u>")
    assert [(p.declared.text, q.declared.text) for p, q, *_ in aligned(a, b, False, False)] == [("<p>", "<t>"), ("<q>", "<s>"), ("<r>", "<u>")]


def test_recovery(spark):
    p = H.prepare_catalogs(spark, DEVICE, DOCUMENTS, "hierarchy")
    views = p.catalog["views"]
    assert views["root"][0]["switch_to_view"] == "a" and views["root"][1]["switch_to_view"] == {"status": "unresolved"}  # <k> has no type
    assert "switch_to_view" not in views["root"][2]
    assert p.recovery.references["root"] == ("Root",)
    checks = {(r.left_view, r.right_view): r.status for r in p.recovery.coverage.collect()}
    assert checks["a", "A"] == "covered" and checks["b", "B"] == "partial"  # a part of B isn't in b
    doc = H.mapping_document(p.mapped, p)
    json.dumps(doc)
    assert doc["hierarchy"]["targets"]["A"]["device_view"] == "a" and set(doc["devices"]) == {r.id for r in p.mapped.devices.collect()}


def test_conflicting_ways_block_a_view(spark):
    """Two declared ways make a view out differently: it is given up, and what followed from it."""
    d = HEAD | {"source": "device", "entry_view": "r", "views": {"r": [{"format": "x", "switch_to_view": "a"}, {"format": "y", "switch_to_view": "a"}, {"format": "z", "switch_to_view": "c"}], "a": [{"format": "go", "switch_to_view": "b"}], "b": [{"format": "end"}], "c": [{"format": "own"}]}}
    r = HEAD | {"source": "documentation", "entry_view": "R", "views": {"R": [{"format": "x", "switch_to_view": "A"}, {"format": "y", "switch_to_view": "Q"}, {"format": "z", "switch_to_view": "C"}], "A": [{"format": "go", "switch_to_view": "B"}], "Q": [{"format": "other"}], "B": [{"format": "fin"}], "C": [{"format": "mine"}]}}
    got = H.recover(M.map_catalogs(spark, d, r, "hierarchy"))
    assert "b" not in got.references and got.references["c"] == ("C",) and got.references["r"] == ("R",)


def test_unknown_types_never_prove(spark):
    d = HEAD | {"source": "device", "entry_view": "r", "views": {"r": [{"format": "go"}], "a": [{"format": "s STRING<1-9>"}, {"format": "t"}]}}
    r = HEAD | {"source": "documentation", "entry_view": "R", "views": {"R": [{"format": "go"}], "A": [{"format": "s <v>"}, {"format": "t"}]}}
    m = M.map_catalogs(spark, d, r, "hierarchy")
    assert [(x.left_view, x.right_view, x.status) for x in H.view_coverage(m).collect()] == [("a", "A", "unknown")]
    assert H.references(H.view_coverage(m)) == {}


def test_shortest_and_witnesses():
    assert shortest(parse("a [ b ] { c | d e }")) == ("K:a", "K:c")
    assert witnesses(parse("a [ b ]"), parse("a { b | c }")) == {"document_only": ("K:a",), "common": ("K:a", "K:b"), "device_only": ("K:a", "K:c")}
    assert predictive(parse("a { b | c } <x>")) and not predictive(parse("a { <y> | c } <x>")) and not predictive(parse("a [ b ] b")) and not predictive(parse("<x> &<1-3> <y>"))


def test_rules():
    b = [{"name": "n", "value": 5, "iterations": [("r:1", 0)]}, {"name": "n", "value": 9, "iterations": [("r:1", 1)]}, {"name": "m", "value": 1, "iterations": [("r:1", 0)]}]
    assert holds({"op": "gt", "parameter": "n", "value": 8}, b) and not holds({"op": "gt", "parameter": "n", "value": 8}, b, {"r:1": 0})
    assert holds({"op": "all", "args": []}, b) and not holds({"op": "any", "args": []}, b) and holds({"op": "not", "arg": {"op": "exists", "parameter": "q"}}, b)
    with pytest.raises(RuleError):
        holds({"op": "lt", "parameter": "n", "value": "x"}, b)
    for bad in ({"op": "odd"}, {"op": "eq", "parameter": "zz", "value": 1}, 5, {"op": "all"}, {"op": "not"}, {"op": "eq", "parameter": "n"}):
        with pytest.raises(RuleError):
            check(bad, frozenset({"n"}))
    rules = [{"condition": "parameter_name", "parameter_name": "m", "when": {"op": "eq", "parameter": "n", "value": 5}}, {"condition": "command", "when": False}]
    assert [k for k, _ in application(rules, [b])[1]] == ["active", "inactive"] and application(rules, [b])[0] == "applied"
    assert application(rules, [b, []])[0] == "ambiguous" and application(rules, [])[0] == "not_applicable" and application(rules, None)[0] == "unknown"


def test_rules_of_parsed_lines(spark, mapped):
    from lineloom.operators.corpus import applications

    rows = spark.createDataFrame([(1, "vlan 10 to 20 30\nenter 3\n name q\n")], "config_id int, text string")
    rules = {"doc:2": [{"condition": "parameter_name", "parameter_name": "first", "when": {"op": "exists", "parameter": "last"}}], "doc:0": [{"condition": "command", "when": {"op": "gt", "parameter": "id", "value": 5}}], "doc:3": [{"condition": "command"}]}
    out = {(r.line_no, r.document_id): (r.status, json.loads(r.rules)) for r in applications(parse_configurations(rows, DEVICE), mapped, rules).collect()}
    assert out[1, "doc:2"][0] == "applied" and len(out[1, "doc:2"][1][0][1]) == 1  # of the round that has a last
    assert out[2, "doc:0"][0] == "inactive" and out[3, "doc:3"][0] == "applied"


def test_saved_mappings(spark, mapped, tmp_path):
    path = f"file://{tmp_path}/m"
    M.save_mapping(mapped, path)
    back = M.load_mapping(spark, path)
    assert sorted(map(repr, back.pairs.collect())) == sorted(map(repr, mapped.pairs.collect())) and back.documentation.trees.keys() == mapped.documentation.trees.keys()
    assert H.mapping_document(back) == H.mapping_document(mapped)


def test_formats_without_views(spark):
    m = M.map_formats(spark, ["a <x> b", "c"], ["a <y> b", "c d"], syntax="document")
    assert {r.format: (r.status, r.stage) for r in m.devices.collect()} == {"a <x> b": ("matched", "exact"), "c": ("unmatched", None)}
    assert M.compare("c <id> a", "c INTEGER<1-100> b", {"id": "integer"}) == "prefix_only" and M.compare("a [ b ]", "a", steps=1) == "unknown"
    from lineloom.operators.corpus import self_matches

    own = M.map_formats(spark, ["a <x>", "a <x>", "b"], ["a <x>", "a <x>", "b"], syntax="document")
    assert tuple(self_matches(own).first()) == (3, 3, 3, 2)


def test_command_line(tmp_path, capsys):
    from lineloom.__main__ import main

    (tmp_path / "c.json").write_text(json.dumps({"commands": ["keep INTEGER<1-9>"]}))
    (tmp_path / "good.txt").write_text("keep 5\n")
    (tmp_path / "bad.txt").write_text("keep 5\nkepe\n")
    args = ["parse", "--patterns", str(tmp_path / "c.json"), "--config"]
    assert main([*args, str(tmp_path / "good.txt")]) == 0 and json.loads(capsys.readouterr().out)["summary"]["commands"] == 1
    assert main([*args, str(tmp_path / "bad.txt")]) == 1
    assert main([*args, str(tmp_path / "none.txt")]) == 2


def test_the_valid_part_of_a_catalog(spark):
    """Bad formats and types are left out and told; the rest is mapped as if they weren't there."""
    bad = json.loads(json.dumps(DEVICE))
    bad["views"]["a"].insert(1, {"format": "open {"})
    bad["views"]["b"].append({"format": "HEX<9-1>"})
    good, left = M.usable(bad)
    assert good == DEVICE and [(x["view"], x["index"], x["format"]) for x in left] == [("a", 1, "open {"), ("b", 3, "HEX<9-1>")] and all(x["error"] for x in left)
    docs = json.loads(json.dumps(DOCUMENTS))
    docs["views"]["A"].append({"format": "name <-bad>"})
    docs["views"]["B"].append({"format": "x <n>", "parameter_types": types(m="integer")})
    good, left = M.usable(docs)
    assert good == DOCUMENTS and len(left) == 2
    with pytest.raises(ValueError):
        M.map_catalogs(spark, bad, DOCUMENTS)


def test_readings_are_not_moved_by_their_document(spark, tmp_path):
    """Readings of a large table are of few documents: they stay where lines met their results, which are as many as there are commands."""
    from lineloom.operators.configurations import parse_configurations

    head = {"schema_version": 1, "vendor": "v", "device": "d", "model_type": "m", "type": "flat"}
    device = head | {"source": "device", "commands": [{"format": "a INTEGER<0-999>"}]}
    mapped = M.map_catalogs(spark, device, head | {"source": "documentation", "commands": [{"format": "a <n>"}]})
    spark.range(1000).selectExpr("id AS config_id", "concat('a ', id) AS text").coalesce(1).write.parquet(f"{tmp_path}/t")
    found = M.semantic_lookup(parse_configurations(spark.read.parquet(f"{tmp_path}/t"), device), mapped)
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin [document_id" in plan and "SortMergeJoin [document_id" not in plan
    assert "SortMergeJoin [command" in plan and "BroadcastHashJoin [command" not in plan
    assert {(r.config_id, r.parameters[0].raw) for r in found.collect()} == {(i, str(i)) for i in range(1000)}
