"""Reports of experiments, and lookup of lines read against documentation itself."""

import pytest

from lineloom.operators import configurations as C
from lineloom.operators import experiments as X
from lineloom.operators.mapping import direct_lookup, map_catalogs
from lineloom.parser import LineParser

HEAD = {"schema_version": 1, "vendor": "v", "device": "d", "model_type": "m", "type": "flat"}
GROUPED = {"type": "grouped", "source": "documentation", "entry_view": "top", "views": {"top": [{"format": "in <n>", "switch_to_view": "under", "creates": [{"kind": "k"}]}, {"format": "in STRING<1-9>"}], "under": [{"format": "set <m>"}]}}


def test_parsing_report(spark):
    configs = spark.createDataFrame([("a", "in x\n set y\nset z\nnothing\n"), ("b", ""), ("c", "\n")], "config_id string, text string")
    parsed = C.parse_configurations(configs, GROUPED, mode="hierarchy")
    expected = spark.createDataFrame([("a", 1, "top"), ("a", 2, "top"), ("a", 4, None)], "config_id string, line_no int, view string")
    got = {r.config_id: r for r in X.parsing_report(parsed, expected).collect()}
    a = got["a"]
    kinds = [(r.kind, r.view, r.context_issue and r.context_issue.code) for r in parsed.filter("config_id = 'a'").orderBy("line_no").collect()]
    commands = [k for k in kinds if k[0] in ("command", "unresolved_command")]
    assert (a.recognized, a.errors, a.known_context) == (len(commands), sum(k == "error" for k, *_ in kinds), sum(v is not None for _, v, _ in commands))
    assert sum(x.n for x in a.context_issues) == sum(i is not None for *_, i in commands) and a.parameters_without_slots == 0
    wanted = {1: "top", 2: "top", 4: None}
    assert {(x.line, x.expected, x.actual) for x in a.unexpected_views} == {(n, w, kinds[n - 1][1]) for n, w in wanted.items() if kinds[n - 1][1] != w}
    assert got["c"].recognized == 0 and got["c"].unexpected_views == [] and "b" not in got
    assert {x.expected for x in X.parsing_report(parsed, expected, "under").filter("config_id = 'a'").first().unexpected_views} <= {None}


def test_matching_report(spark):
    m = map_catalogs(spark, HEAD | {"source": "device", "commands": [{"format": "a INTEGER<1-9>"}, {"format": "b"}]}, HEAD | {"source": "documentation", "commands": [{"format": "a <n>"}]})
    got = {(r.what, r.value): r.n for r in X.matching_report(m, 3, 1).collect()}
    assert got == {("device_occurrences", None): 2, ("device_statuses", "matched"): 1, ("device_statuses", "unmatched"): 1, ("pair_stages", "exact"): 1, ("pair_relations", m.pairs.first().status): 1, ("bindings", None): 1, ("invalid_documentation_occurrences", None): 3, ("unresolved_transitions", None): 1}


def test_direct_lookup(spark):
    configs = spark.createDataFrame([("a", "in x\n set y\n")], "config_id string, text string")
    parsed = C.parse_configurations(configs, GROUPED, mode="hierarchy")
    rows = {(r.line_no, r["view"], r.index_in_view, tuple((p.name, p.raw) for p in r.parameters), r.creates) for r in direct_lookup(parsed, GROUPED).collect()}
    plain = {(r.line_no, m.pattern_index) for r in parsed.collect() for m in r.matches}
    want = {0: ("top", 0, (("n", "x"),), '[{"kind": "k"}]'), 1: ("top", 1, (), "[]"), 2: ("under", 0, (("m", "y"),), "[]")}
    assert rows == {(line, *want[i]) for line, i in plain}
    other = {"commands": [{"format": "other"}, {"format": "in STRING<1-9>"}]}
    with pytest.raises(Exception, match="against this documentation"):
        direct_lookup(parsed, other).collect()


def test_direct_lookup_moves_no_readings(spark):
    configs = spark.createDataFrame([("a", "in x\n set y\n")], "config_id string, text string")
    plan = direct_lookup(C.parse_configurations(configs, GROUPED), GROUPED)._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin [at" in plan and "SortMergeJoin [at" not in plan


def test_from_json_file(tmp_path):
    (tmp_path / "c.json").write_text('{"commands": ["say <x>"]}', encoding="utf-8")
    assert LineParser.from_json_file(str(tmp_path / "c.json")).parse("say a")["matches"]
