"""Joins of catalogs, language relations, contexts, graphs, rules and corpus utilities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lineloom.functions import pages
from lineloom.operators import context, graphs, hierarchy, mapping, matching, reading, rules
from lineloom.plans.common import spread, table
from lineloom.sources.catalogs import export_by_view, pilot_sample


def _nations(spark: SparkSession, d: str) -> list[int]:
    """The 25 nations' keys: a catalog has a format for each."""
    return sorted(r[0] for r in table(spark, d, "nation").select("n_nationkey").collect())


HEAD = {"schema_version": 1, "vendor": "v", "device": "d", "model_type": "m", "type": "flat"}
#: By the remainder of the nation's key by 6: a device's format and a document's, and the types that the document states.
KINDS = [
    ("old w{} X.X.X.X name", "old w{} <address> name", {}),
    ("set w{} {{ red | blue }} INTEGER<1-9>", "set w{} {{ blue | red }} <level>", {}),
    ("vlan w{} INTEGER<1-99> to INTEGER<1-99>", "vlan w{} <first> [ to <last> ]", {}),
    ("pre w{} INTEGER<1-9> more", "pre w{} <x>", {}),
    ("cold w{} ring extra", "cold w{} ring", {}),
    ("odd w{} X.X.X.X {{ a | b }}", "odd w{} <n> {{ b | a }}", {"n": "integer"}),
]


def _catalogs(spark: SparkSession, d: str) -> tuple[dict, dict]:
    device, document = [], []
    for k in _nations(spark, d):
        x, y, types = KINDS[k % 6]
        device.append({"format": x.format(k)})
        document.append({"format": y.format(k)} | ({"parameter_types": [{"parameter_name": n, "parameter_type": t} for n, t in types.items()]} if types else {}))
    return HEAD | {"source": "device", "commands": device}, HEAD | {"source": "documentation", "commands": document}


def _matched(spark: SparkSession, d: str) -> DataFrame:
    """(device, document, stage, status, n_bindings) of the mapped catalogs."""
    m = mapping.map_catalogs(spark, *_catalogs(spark, d))
    x = m.device.records.select("id", F.col("format").alias("device"))
    y = m.documentation.records.select(F.col("id").alias("document_id"), F.col("format").alias("document"))
    return m.pairs.join(x, "id").join(y, "document_id").select("device", "document", "stage", "status", F.size("bindings").alias("n_bindings"))


def q_exact_join(spark: SparkSession, d: str) -> DataFrame:
    """Formats of one shape whose values fit each other."""
    return _matched(spark, d).filter("stage = 'exact'").select("device", "document", "n_bindings")


def q_canonical_join(spark: SparkSession, d: str) -> DataFrame:
    """Formats of one shape in any order whose values fit each other once they are aligned."""
    return _matched(spark, d).filter("stage in ('exact', 'reordered')").select("device", "document", "n_bindings")


def q_staged(spark: SparkSession, d: str) -> DataFrame:
    return _matched(spark, d)


def q_mapping_summary(spark: SparkSession, d: str) -> DataFrame:
    return mapping.summary(mapping.map_catalogs(spark, *_catalogs(spark, d)))


def q_type_compat(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of categories that fit each other; one that isn't known fits any."""
    t = lambda name, mod: table(spark, d, "customer").select(F.when(F.col("c_custkey") % mod > 0, F.col("c_mktsegment")).alias(name)).distinct()
    x, y = t("left_type", 7), t("right_type", 5)
    return x.join(y, F.col("left_type").isNull() | F.col("right_type").isNull() | (F.col("left_type") == F.col("right_type")))


def q_symbol_filter(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of nations each of whose sides may say what the other must, by the segments of their customers."""
    c = table(spark, d, "customer").groupBy("c_nationkey").agg(F.collect_set("c_mktsegment").alias("possible"), F.collect_set(F.when(F.col("c_acctbal") > 9000, F.col("c_mktsegment"))).alias("required"))
    c = c.select(F.col("c_nationkey").cast("string").alias("format"), "possible", "required", F.lit(False).alias("any_value"))
    pairs = c.select(F.col("format").alias("device")).join(c.select(F.col("format").alias("document")), F.col("device") < F.col("document"))
    return matching.symbol_filter(pairs, c, c)


def q_prefix_compat(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of parts' names and first words one of which is a beginning of the other."""
    t = table(spark, d, "part")
    first = F.substring_index("p_name", " ", 1)
    x = t.select(F.col("p_name").alias("format"), F.array(F.split("p_name", " ")).alias("prefixes")).distinct()
    y = t.select(first.alias("format"), F.array(F.array(first)).alias("prefixes")).distinct()
    return matching.prefix_candidates(x, y)


def _views(spark: SparkSession, d: str) -> tuple[dict, dict]:
    """Catalogs with a view for each region, which the entry view leads to, and in it a format for each nation; that of every eighth nation is documented otherwise."""
    nations = sorted(tuple(r) for r in table(spark, d, "nation").select("n_nationkey", "n_regionkey").collect())
    regions = sorted({r for _, r in nations})
    said = lambda k: "make w{} {{ a | c }}" if k % 8 == 3 else ("make w{} {{ b | a }}", "make w{} a")[k % 2]
    device = {"root": [{"format": f"enter r{r}"} for r in regions]} | {f"v{r}": [{"format": f"make w{k} {{ a | b }}"} for k, s in nations if s == r] for r in regions}
    document = {"Root": [{"format": f"enter r{r}", "switch_to_view": f"V{r}"} for r in regions]} | {f"V{r}": [{"format": said(k).format(k)} for k, s in nations if s == r] for r in regions}
    head = HEAD | {"type": "grouped"}
    return head | {"source": "device", "entry_view": "root", "views": device}, head | {"source": "documentation", "entry_view": "Root", "views": document}


def q_view_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Which device views have all that a documented view has of its own."""
    return hierarchy.view_coverage(mapping.map_catalogs(spark, *_views(spark, d), "hierarchy"))


def q_recovered_transitions(spark: SparkSession, d: str) -> DataFrame:
    """Where the entry view's formats lead to, as far as the recovered views tell."""
    p = hierarchy.prepare_catalogs(spark, *_views(spark, d), "hierarchy")
    x = p.mapped.device.records.filter("view = 'root'").select("id", "format")
    return p.recovery.transitions.join(x, "id").select("format", "known", "target")


def q_scope_partition(spark: SparkSession, d: str) -> DataFrame:
    """Formats of entry views meet those of entry views, others others."""
    nations = _nations(spark, d)
    of = lambda by, entry, other: {v: [{"format": f"keep w{k}"} for k in nations if (k % by == 0) == (v == entry)] for v in (entry, other)}
    head = HEAD | {"type": "grouped"}
    m = mapping.map_catalogs(spark, head | {"source": "device", "entry_view": "root", "views": of(2, "root", "v")}, head | {"source": "documentation", "entry_view": "Root", "views": of(3, "Root", "V")})
    return m.devices.select("format", "view", "status", "stage")


#: By the remainder of the part's size by 4: a format with the size in it.
ANALYSED = ["w{} {{ red | blue }} [ end ]", "w{} <x> [ end ]", "w{} [ a ] a", "w{} {{ b | a INTEGER<1-9> }} *"]


def q_format_analysis(spark: SparkSession, d: str) -> DataFrame:
    """Words, beginnings, shortest lines and values of formats, and whether they are read a word at a time."""
    size = table(spark, d, "part").select("p_size", F.element_at(F.array(*(F.lit(x) for x in ANALYSED)), F.col("p_size") % 4 + 1).alias("x"))
    text = F.regexp_replace(F.regexp_replace(F.replace("x", F.lit("{}"), F.col("p_size").cast("string")), r"\{\{", "{"), r"\}\}", "}")
    out = reading.analysed(size.select(text.alias("format")))
    joined = lambda c: F.array_join(c, ",").alias(c)
    return out.select("format", joined("required"), joined("possible"), "any_value", joined("prefixes"), "shortest", "predictive", joined("slots"))


def q_shape_keys(spark: SparkSession, d: str) -> DataFrame:
    """Formats of one shape: values' names and, without order, choices' places don't count."""
    k, n = F.col("n_nationkey"), F.col("n_nationkey").cast("string")
    text = F.when(k % 3 == 0, F.concat(F.lit("do { a | b <x"), n, F.lit("> } r"), F.col("n_regionkey"))).when(k % 3 == 1, F.concat(F.lit("do { b <y"), n, F.lit("> | a } r"), F.col("n_regionkey"))).otherwise(F.concat(F.lit("do { a | b INTEGER<1-"), k + 2, F.lit("> } r"), F.col("n_regionkey")))
    of = table(spark, d, "nation").select(text.alias("format"), F.col("n_regionkey").alias("region"))
    g = of.join(reading.analysed(of), "format")
    size = lambda c: F.countDistinct(c).cast("long").alias(f"n_{c}")
    return g.groupBy("region").agg(F.count(F.lit(1)).alias("n"), size("ordered_key"), size("canonical_key"), size("typed_key"))


def q_views_said(spark: SparkSession, d: str) -> DataFrame:
    """The view that a description says a format enters."""
    k, name = F.col("p_partkey") % 5, F.substring_index("p_name", " ", 1)
    start = F.concat(F.lit("The w"), F.col("p_size").cast("string"), F.lit(" command"))
    text = (
        F.when(k == 0, F.concat(start, F.lit(" creates an entry and displays the "), name, F.lit(" pool view.")))
        .when(k == 1, F.concat(start, F.lit(" may enter the "), name, F.lit(" view.")))
        .when(k == 2, F.concat(F.lit("The other command enters the "), name, F.lit(" view.")))
        .when(k == 3, F.concat(start, F.lit(" enters the "), name, F.lit(" view. "), start, F.lit(" opens the last one view.")))
        .otherwise(F.concat(F.lit("Some words. "), F.replace(start, F.lit(" command"), F.lit(" set command")), F.lit(" enters the big view. "), start, F.lit(" opens a "), name, F.lit(" view.")))
    )
    t = spread(table(spark, d, "part").select("p_partkey", "p_name", "p_size"), "p_partkey").select("p_partkey", F.concat(F.lit("w"), F.col("p_size").cast("string"), F.lit(" [ set ] <x>")).alias("format"), text.alias("text"))
    found = t.select("p_partkey", pages.switch_evidence(F.col("format"), F.col("text")).alias("e"))
    return found.select("p_partkey", F.col("e.view").alias("view"), F.col("e.text").alias("said"))


def q_prompts(spark: SparkSession, d: str) -> DataFrame:
    """Prompts and commands of sessions."""
    k, role = F.col("turn") % 4, F.col("role")
    line = F.when(k == 0, F.concat(F.lit(" <"), role, F.lit("> go ")).alias("x")).when(k == 1, F.concat(F.lit("[~"), role, F.lit("-x]go 2"))).when(k == 2, F.concat(F.lit("[*"), role, F.lit("]"))).otherwise(F.concat(role, F.lit(" [a]")))
    prompt, command = pages.prompt(line)
    return table(spark, d, "conversations").select("conv_id", "turn", prompt.alias("prompt"), command.alias("command"))


def q_adjacent_values(spark: SparkSession, d: str) -> DataFrame:
    """Whether two values stand side by side in a format."""
    k = F.col("p_partkey") % 3
    text = F.when(k == 0, "set <a.b>  <c> end").when(k == 1, "set <c> <a.b>").otherwise("set <a.b> to <c>")
    t = table(spark, d, "part").select("p_partkey", text.alias("format"))
    return t.select("p_partkey", pages.adjacent(F.col("format"), F.array(F.lit("a.b"), F.lit("c"))).alias("side_by_side"), F.array_join(pages.names_of(F.col("format")), ",").alias("names"))


def q_pages_by_view(spark: SparkSession, d: str) -> DataFrame:
    """The formats of each view, as pages are written out: a page for each part, which stands in two views."""
    p = table(spark, d, "part").select(F.array("p_brand", "p_type").alias("ParentView"), F.array("p_name", F.concat(F.lit("undo "), F.col("p_name"))).alias("CLIs"))
    return export_by_view(p).select("view", F.array_join("formats", "|").alias("formats"))


def q_staged_fallback(spark: SparkSession, d: str) -> DataFrame:
    """Orders' priorities met as a whole, the rest by their first character."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("device"), F.col("o_orderpriority").alias("key"))
    docs = spark.createDataFrame([("1-URGENT",), ("5-LOW",), ("3-OTHER",), ("9-NONE",)], "key string")
    full = o.join(F.broadcast(docs), "key").select("device", F.col("key").alias("document"), F.lit("exact").alias("stage"))
    rest = o.join(full, "device", "left_anti")
    more = rest.join(F.broadcast(docs.withColumnRenamed("key", "document")), F.substring("key", 1, 1) == F.substring("document", 1, 1)).select("device", "document", F.lit("prefix").alias("stage"))
    return full.unionByName(more).groupBy("document", "stage").agg(F.count(F.lit(1)).alias("n"))


def q_stage_mixed(spark: SparkSession, d: str) -> DataFrame:
    pairs = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.when(F.col("l_returnflag") == "R", "prefix").otherwise(F.col("l_returnflag")).alias("stage"), F.when(F.col("l_linenumber") == 7, "unknown").otherwise("matched").alias("status"), F.when(F.col("l_linenumber") == 7, "unavailable").otherwise("structural").alias("binding_mode"))
    return mapping.device_status(table(spark, d, "orders").select(F.col("o_orderkey").alias("id")), pairs)


#: By the remainder of the nation's key by 6: a device's format, a document's, and how the languages lie to each other.
RELATIONS = [
    ("c w{} {{ b | a }}", "c w{} {{ a | b }}"),
    ("a w{}", "a w{} [ b ]"),
    ("a w{} [ b ]", "a w{}"),
    ("a w{} {{ c | d }}", "a w{} {{ d | e }}"),
    ("w{} {{ a | b }} *", "w{} {{ a [ b ] | b [ a ] }}"),
    ("w{} {{ a }} &<1-3>", "w{} {{ a }} &< 1 - 2 >"),
]


def _sides(spark: SparkSession, device: list[str], document: list[str]) -> tuple[mapping.Side, mapping.Side]:
    x = HEAD | {"source": "device", "commands": [{"format": f} for f in device]}
    y = HEAD | {"source": "documentation", "commands": [{"format": f} for f in document]}
    return mapping.side(spark, x, documents=False, follow=False), mapping.side(spark, y, documents=True, follow=False)


def q_relation(spark: SparkSession, d: str) -> DataFrame:
    """How the languages of a device's format and a document's lie to each other."""
    nations = _nations(spark, d)
    x, y = _sides(spark, [RELATIONS[k % 6][0].format(k) for k in nations], [RELATIONS[k % 6][1].format(k) for k in nations])
    of = lambda s, c: s.records.select("source_index", F.col("k").alias(c), F.col("format").alias(f"{c}_format"))
    pairs = of(x, "device").join(of(y, "document"), "source_index")
    found = mapping.products(spark, pairs, x, y, False)
    return found.join(pairs, ["device", "document"]).select(F.col("device_format").alias("device"), F.col("document_format").alias("document"), F.col("status").alias("relation"))


#: By the remainder of the nation's key by 5: a subject, two choices, and whether these have all that it has.
COVERED = [("c w{} {{ a }} &<1-3>", "c w{} a", "c w{} a a a", False), ("c w{} {{ a | b }}", "c w{} a", "c w{} b", True), ("c w{} [ a ]", "c w{}", "c w{} a", True), ("c w{} {{ a | b }} *", "c w{} a [ b ]", "c w{} b [ a ]", True), ("c w{} {{ a | b | d }}", "c w{} a", "c w{} b", False)]


def q_covered_by(spark: SparkSession, d: str) -> DataFrame:
    """Whether all lines of a format are lines of some of its choices."""
    nations = _nations(spark, d)
    x, y = _sides(spark, [COVERED[k % 5][0].format(k) for k in nations], [c.format(k) for k in nations for c in COVERED[k % 5][1:3]])
    choices = y.records.groupBy(F.floor(F.col("source_index") / 2).cast("int").alias("source_index")).agg(F.array_sort(F.collect_list("k")).alias("choices"))
    asked = x.records.join(choices, "source_index").select("k", "choices", "format")
    return hierarchy.proofs(asked, x, y).join(asked, ["k", "choices"]).select(F.col("format").alias("subject"), "covered")


#: By the remainder of the part's key by 8: a declaration with the part's size in it.
SPELLINGS = ["<{}st>", "<x/{}>", "<_x{}>", "<ip:port{}>", "HEX<0x{}-0xff>", "a &< 1 - {} >", "INTEGER<-{}-+99>", "STRING<{}-60>"]


def q_declarations(spark: SparkSession, d: str) -> DataFrame:
    """Declarations in all their spellings, read where they lie."""
    t = table(spark, d, "part").select("p_size", F.element_at(F.array(*(F.lit(x) for x in SPELLINGS)), (F.col("p_partkey") % 8 + 1).cast("int")).alias("x"))
    read = reading.read_formats(t.select(F.replace("x", F.lit("{}"), F.col("p_size").cast("string")).alias("format")))
    one = F.element_at("tokens", -1)
    return read.select("format", F.size("tokens").alias("n_tokens"), one["kind"].alias("kind"), one["type_id"].alias("type_id"), one["low"].cast("long").alias("low"), one["high"].cast("long").alias("high"), "error")


def _edges(spark: SparkSession, d: str) -> DataFrame:
    """A supplier leads to two others of which it knows the numbers."""
    s = table(spark, d, "supplier").select("s_suppkey")
    return s.select(F.col("s_suppkey").alias("src"), F.explode(F.array((F.col("s_suppkey") * 3 + 1) % 97, (F.col("s_suppkey") * 7 + 2) % 89)).alias("dst"))


def q_reachable(spark: SparkSession, d: str) -> DataFrame:
    return graphs.reachable(_edges(spark, d), spark.createDataFrame([(5,)], "node long"))


def q_trim_reach(spark: SparkSession, d: str) -> DataFrame:
    e = _edges(spark, d).filter("src % 4 <> 0").distinct()
    return graphs.trimmed(e, spark.createDataFrame([(1,)], "node long"), spark.createDataFrame([(50,), (60,)], "node long"))


def q_context_stack(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations").select(F.col("conv_id").alias("config_id"), F.col("turn").alias("line_no"), (F.col("turn") * 7 % 5).alias("indent"), F.when(F.col("turn") % 6 == 5, "#").otherwise(F.col("role")).alias("command"))
    return context.parents(rows).select("config_id", F.col("line_no").cast("long").alias("line_no"), "parent_line")


def q_child_context(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_custkey", F.when(F.col("o_orderkey") % 20 > 0, F.col("o_orderstatus")).alias("child"))
    return context.child_context(o, ["o_custkey"])


def q_prompt_transition(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.col("role").alias("prompt"))
    return context.prompt_transitions(rows, ["conv_id"], "turn")


def q_conflicting(spark: SparkSession, d: str) -> DataFrame:
    return graphs.conflicts(table(spark, d, "part"), ["p_brand", "p_name"], "p_type")


def q_effects(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.concat(F.lit("v"), F.col("o_custkey") % 3).alias("view"), F.col("o_custkey").cast("string").alias("format"), F.when(F.col("o_orderkey") % 31 == 0, "unknown").when(F.col("o_orderkey") % 2 == 0, "switch").otherwise("stay").alias("kind"), F.concat(F.lit("v"), F.col("o_custkey") % 4).alias("target"))
    return graphs.effects(o)


def q_follow_declared(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("n_nationkey").cast("long")
    declared = table(spark, d, "nation").select(k.alias("left"), k.alias("right"), (k + 1).alias("left_target"), (k + 1).alias("right_target"))
    odd = spark.createDataFrame([(10, 10, 12, 13), (20, 20, 99, 98)], "left long, right long, left_target long, right_target long")
    return graphs.follow_declared(declared.unionByName(odd).distinct(), spark.createDataFrame([(0, 0)], "left long, right long"))


def q_example_fixpoint(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier").select(F.when(F.col("s_suppkey") % 10 > 0, F.concat(F.lit("c"), F.floor(F.col("s_suppkey") / 2).cast("long"))).alias("parent"), F.concat(F.lit("c"), F.col("s_suppkey")).alias("child"), F.array(F.concat(F.lit("v"), F.col("s_nationkey"))).alias("views"))
    return graphs.example_fixpoint(s, "entry")


def q_semantic_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Matches to devices to documents to records, in a scope."""
    match = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    device = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey"))
    document = table(spark, d, "nation").select("n_nationkey", F.col("n_regionkey").alias("r_regionkey"))
    record = table(spark, d, "region").filter("r_name <> 'ASIA'")
    return match.join(device, "c_custkey").join(document, "n_nationkey").join(record, "r_regionkey").select("o_orderkey", "r_name")


def _orders_captures(spark: SparkSession, d: str) -> DataFrame:
    """Of each order its lines' values: quantity as a number, the flag as a text."""
    line = table(spark, d, "lineitem")
    one = F.array(F.struct(F.lit("supplier").alias("name"), F.col("l_suppkey").cast("long").alias("number"), F.col("l_suppkey").cast("string").alias("text")), F.struct(F.lit("flag").alias("name"), F.lit(None).cast("long").alias("number"), F.col("l_returnflag").alias("text")))
    return line.groupBy("l_orderkey").agg(F.flatten(F.collect_list(one)).alias("captures"))


WHEN = {"op": "all", "args": [{"op": "gt", "parameter": "supplier", "value": 90}, {"op": "any", "args": [{"op": "eq", "parameter": "flag", "value": "R"}, {"op": "not", "arg": {"op": "exists", "parameter": "flag"}}]}]}


def q_rule_exists(spark: SparkSession, d: str) -> DataFrame:
    return _orders_captures(spark, d).filter(rules.predicate(WHEN)).select("l_orderkey")


def q_rule_effects(spark: SparkSession, d: str) -> DataFrame:
    out = rules.apply_rules(_orders_captures(spark, d), [{"when": WHEN, "entity": "late"}, {"entity": "flag", "parameter": "flag"}])
    return out.select("l_orderkey", F.array_join(F.array_sort("effects"), ",").alias("effects"))


def q_rule_agreement(spark: SparkSession, d: str) -> DataFrame:
    readings = table(spark, d, "lineitem").select("l_orderkey", F.when(F.col("l_suppkey") % 3 > 0, F.array("l_linestatus")).otherwise(F.array().cast("array<string>")).alias("effects"))
    return rules.agreement(readings, ["l_orderkey"])


def q_pilot_sample(spark: SparkSession, d: str) -> DataFrame:
    return pilot_sample(table(spark, d, "documents").select("doc_id"), "doc_id", 50, [3, 7])


def q_json_access(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


def q_binding_order(spark: SparkSession, d: str) -> DataFrame:
    """Values of equal type paired by their occurrence: the n-th of one side with the n-th of the other."""
    w = lambda c: Window.partitionBy("l_orderkey", "l_returnflag").orderBy(c)
    x = table(spark, d, "lineitem").select("l_orderkey", "l_returnflag", "l_linenumber", "l_partkey")
    a = x.withColumn("n", F.row_number().over(w("l_linenumber")))
    b = x.withColumn("n", F.row_number().over(Window.partitionBy("l_orderkey", "l_returnflag").orderBy("l_partkey", "l_linenumber"))).withColumnRenamed("l_linenumber", "other")
    return a.join(b.select("l_orderkey", "l_returnflag", "n", "other"), ["l_orderkey", "l_returnflag", "n"]).select("l_orderkey", "l_linenumber", "other")


def _said(text: str) -> str:
    """A format with the nation's key in it, as SQL."""
    return "'" + text.format("' || n_nationkey || '") + "'"


def _cases(kinds, names: tuple[str, ...]) -> str:
    """SQL of the nations, with the formats of their kind by name; @ stands for more columns."""
    each = [f"CASE n_nationkey % {len(kinds)} " + " ".join(f"WHEN {i} THEN {_said(x[j])}" for i, x in enumerate(kinds)) + f" END AS {name}" for j, name in enumerate(names)]
    return f"SELECT {', '.join(each)}, @ FROM nation"


_STAGED = "(" + _cases(KINDS, ("device", "document")).replace("@", "CASE n_nationkey % 6 WHEN 0 THEN 'exact' WHEN 1 THEN 'reordered' WHEN 2 THEN 'intersection' WHEN 3 THEN 'prefix' END AS stage, CASE n_nationkey % 6 WHEN 2 THEN 'device_subset' WHEN 3 THEN 'prefix_match' ELSE 'equivalent' END AS status, CASE n_nationkey % 6 WHEN 2 THEN 2 ELSE 1 END AS n_bindings") + ")"

QUERIES = {n: f for n, f in globals().items() if n.startswith("q_")}

_SUP = "(SELECT s_suppkey AS src, (s_suppkey * 3 + 1) % 97 AS dst FROM supplier UNION ALL SELECT s_suppkey, (s_suppkey * 7 + 2) % 89 FROM supplier)"
_TRIM = f"(SELECT DISTINCT * FROM {_SUP} WHERE src % 4 <> 0)"
_CAP_RULE = "max(l_suppkey) > 90 AND count(*) FILTER (l_returnflag = 'R') > 0"

ORACLE_SQL = {
    "q_type_compat": "SELECT * FROM (SELECT DISTINCT CASE WHEN c_custkey % 7 > 0 THEN c_mktsegment END AS left_type FROM customer), (SELECT DISTINCT CASE WHEN c_custkey % 5 > 0 THEN c_mktsegment END AS right_type FROM customer) WHERE left_type IS NULL OR right_type IS NULL OR left_type = right_type",
    "q_symbol_filter": "WITH c AS (SELECT c_nationkey, list(DISTINCT c_mktsegment) AS p, coalesce(list(DISTINCT c_mktsegment) FILTER (c_acctbal > 9000), []) AS r FROM customer GROUP BY 1) SELECT x.c_nationkey::VARCHAR AS device, y.c_nationkey::VARCHAR AS document FROM c x JOIN c y ON x.c_nationkey::VARCHAR < y.c_nationkey::VARCHAR WHERE list_has_all(y.p, x.r) AND list_has_all(x.p, y.r)",
    "q_prefix_compat": "SELECT DISTINCT x.p_name AS device, y.w AS document FROM part x JOIN (SELECT DISTINCT split_part(p_name, ' ', 1) AS w FROM part) y ON split_part(x.p_name, ' ', 1) = y.w",
    "q_exact_join": f"SELECT device, document, n_bindings FROM {_STAGED} WHERE stage = 'exact'",
    "q_canonical_join": f"SELECT device, document, n_bindings FROM {_STAGED} WHERE stage IN ('exact', 'reordered')",
    "q_staged": f"SELECT * FROM {_STAGED} WHERE stage IS NOT NULL",
    "q_mapping_summary": f"""WITH s AS {_STAGED} SELECT 'device status' AS what, CASE stage WHEN 'prefix' THEN 'partial' ELSE CASE WHEN stage IS NULL THEN 'unmatched' ELSE 'matched' END END AS value, count(*) AS n FROM s GROUP BY ALL
        UNION ALL SELECT 'device stage', stage, count(*) FROM s GROUP BY ALL UNION ALL SELECT 'pair status', status, count(*) FROM s WHERE stage IS NOT NULL GROUP BY ALL
        UNION ALL SELECT 'bindings', NULL, sum(n_bindings) FROM s WHERE stage IS NOT NULL""",
    "q_relation": _cases(RELATIONS, ("device", "document")).replace("@", "CASE n_nationkey % 6 WHEN 0 THEN 'equivalent' WHEN 1 THEN 'device_subset' WHEN 2 THEN 'document_subset' WHEN 3 THEN 'overlap' WHEN 4 THEN 'equivalent' ELSE 'document_subset' END AS relation"),
    "q_covered_by": _cases([x[:1] for x in COVERED], ("subject",)).replace("@", "n_nationkey % 5 IN (1, 2, 3) AS covered"),
    "q_declarations": """WITH t AS (SELECT DISTINCT p_partkey % 8 AS k, p_size AS s FROM part)
        SELECT CASE k WHEN 0 THEN '<' || s || 'st>' WHEN 1 THEN '<x/' || s || '>' WHEN 2 THEN '<_x' || s || '>' WHEN 3 THEN '<ip:port' || s || '>' WHEN 4 THEN 'HEX<0x' || s || '-0xff>' WHEN 5 THEN 'a &< 1 - ' || s || ' >' WHEN 6 THEN 'INTEGER<-' || s || '-+99>' ELSE 'STRING<' || s || '-60>' END AS format,
        CASE k WHEN 5 THEN 2 ELSE 1 END AS n_tokens, CASE k WHEN 5 THEN 'repeat' ELSE 'declaration' END AS kind, CASE WHEN k < 4 THEN 'named' WHEN k = 4 THEN 'hex' WHEN k = 6 THEN 'integer' WHEN k = 7 THEN 'string' END AS type_id,
        CASE k WHEN 4 THEN (s // 10) * 16 + s % 10 WHEN 5 THEN 1 WHEN 6 THEN -s WHEN 7 THEN s END AS low, CASE k WHEN 4 THEN 255 WHEN 5 THEN s WHEN 6 THEN 99 WHEN 7 THEN 60 END AS high, NULL AS error FROM t""",
    "q_view_coverage": "SELECT 'v' || n_regionkey AS left_view, 'V' || n_regionkey AS right_view, CASE WHEN bool_or(n_nationkey % 8 = 3) THEN 'partial' ELSE 'covered' END AS status FROM nation GROUP BY n_regionkey",
    "q_recovered_transitions": "SELECT 'enter r' || n_regionkey AS format, NOT bool_or(n_nationkey % 8 = 3) AS known, CASE WHEN NOT bool_or(n_nationkey % 8 = 3) THEN 'v' || n_regionkey END AS target FROM nation GROUP BY n_regionkey",
    "q_scope_partition": "SELECT 'keep w' || n_nationkey AS format, CASE WHEN n_nationkey % 2 = 0 THEN 'root' ELSE 'v' END AS view, CASE WHEN (n_nationkey % 2 = 0) = (n_nationkey % 3 = 0) THEN 'matched' ELSE 'unmatched' END AS status, CASE WHEN (n_nationkey % 2 = 0) = (n_nationkey % 3 = 0) THEN 'exact' END AS stage FROM nation",
    "q_format_analysis": """WITH t AS (SELECT DISTINCT p_size % 4 AS k, p_size AS s, 'w' || p_size AS w FROM part)
        SELECT CASE k WHEN 0 THEN w || ' { red | blue } [ end ]' WHEN 1 THEN w || ' <x> [ end ]' WHEN 2 THEN w || ' [ a ] a' ELSE w || ' { b | a INTEGER<1-9> } *' END AS format,
        CASE k WHEN 2 THEN 'a,' || w ELSE w END AS required, CASE k WHEN 0 THEN 'blue,end,red,' || w WHEN 1 THEN 'end,' || w WHEN 2 THEN 'a,' || w ELSE 'a,b,' || w END AS possible, k IN (1, 3) AS any_value,
        CASE k WHEN 0 THEN printf('K:%1$s K:blue,K:%1$s K:blue K:end,K:%1$s K:red,K:%1$s K:red K:end', w) WHEN 1 THEN printf('K:%1$s P,K:%1$s P K:end', w) WHEN 2 THEN printf('K:%1$s K:a,K:%1$s K:a K:a', w) ELSE printf('K:%1$s K:a P,K:%1$s K:b', w) END AS prefixes,
        'K:' || w || CASE k WHEN 0 THEN ' K:blue' WHEN 1 THEN ' P' WHEN 2 THEN ' K:a' ELSE ' K:b' END AS shortest, k <> 2 AS predictive, CASE k WHEN 1 THEN 'p:' || len(w) + 1 WHEN 3 THEN 'p:' || len(w) + 9 ELSE '' END AS slots FROM t""",
    "q_shape_keys": "SELECT n_regionkey AS region, count(*) AS n, count(DISTINCT n_nationkey % 3 = 1) AS n_ordered_key, 1 AS n_canonical_key, count(DISTINCT CASE WHEN n_nationkey % 3 = 2 THEN 'i' ELSE '' END) AS n_typed_key FROM nation GROUP BY 1",
    "q_views_said": """SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN split_part(p_name, ' ', 1) || ' pool view' WHEN 4 THEN 'big view' END AS view,
        CASE p_partkey % 5 WHEN 0 THEN 'The w' || p_size || ' command creates an entry and displays the ' || split_part(p_name, ' ', 1) || ' pool view.' WHEN 4 THEN 'The w' || p_size || ' set command enters the big view.' END AS said FROM part""",
    "q_prompts": "SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN '<' || role || '>' WHEN 1 THEN '[' || role || '-x]' WHEN 2 THEN '[' || role || ']' END AS prompt, CASE turn % 4 WHEN 0 THEN 'go' WHEN 1 THEN 'go 2' WHEN 2 THEN '' END AS command FROM conversations",
    "q_adjacent_values": "SELECT p_partkey, p_partkey % 3 = 0 AS side_by_side, CASE p_partkey % 3 WHEN 1 THEN 'c,a.b' ELSE 'a.b,c' END AS names FROM part",
    "q_pages_by_view": "WITH v AS (SELECT unnest([p_brand, p_type]) AS view, p_name FROM part), f AS (SELECT view, unnest([p_name, 'undo ' || p_name]) AS f FROM v) SELECT view, array_to_string(list_sort(list(DISTINCT f)), '|') AS formats FROM f GROUP BY 1",
    "q_staged_fallback": "WITH d(k) AS (VALUES ('1-URGENT'), ('5-LOW'), ('3-OTHER'), ('9-NONE')), f AS (SELECT o_orderkey, k FROM orders JOIN d ON k = o_orderpriority) SELECT k AS document, 'exact' AS stage, count(*) AS n FROM f GROUP BY 1 UNION ALL SELECT k, 'prefix', count(*) FROM orders o JOIN d ON k[1:1] = o_orderpriority[1:1] WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.o_orderkey = o.o_orderkey) GROUP BY 1",
    "q_stage_mixed": """WITH p AS (SELECT o_orderkey, CASE WHEN l_linenumber <> 7 THEN CASE l_returnflag WHEN 'R' THEN 'prefix' ELSE l_returnflag END END AS s, l_linenumber = 7 AS u FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey)
        SELECT o_orderkey AS id, CASE WHEN count(DISTINCT s) > 1 THEN 'mixed' ELSE min(s) END AS stage, CASE WHEN bool_or(s = 'prefix') THEN 'partial' WHEN count(s) > 0 THEN 'matched' WHEN bool_or(u) THEN 'unknown' ELSE 'unmatched' END AS status FROM p GROUP BY 1""",
    "q_reachable": f"WITH RECURSIVE e AS {_SUP}, r AS (SELECT 5::BIGINT AS node, 0 AS depth UNION SELECT dst, depth + 1 FROM r JOIN e ON src = node WHERE depth < 40) SELECT node, min(depth) AS depth FROM r GROUP BY node",
    "q_trim_reach": f"WITH RECURSIVE e AS {_TRIM}, f AS (SELECT 1::BIGINT AS node UNION SELECT dst FROM f JOIN e ON src = node), b AS (SELECT unnest([50, 60])::BIGINT AS node UNION SELECT src FROM b JOIN e ON dst = node) SELECT src, dst FROM e WHERE src IN (FROM f) AND src IN (FROM b) AND dst IN (FROM f) AND dst IN (FROM b)",
    "q_context_stack": """WITH r AS (SELECT conv_id, turn, turn * 7 % 5 AS i, turn % 6 = 5 AS sep, lead(turn % 6 = 5) OVER (PARTITION BY conv_id ORDER BY turn) AS closed FROM conversations),
        p AS (SELECT r.conv_id, r.turn, o.turn AS above, o.i FROM r JOIN r o ON o.conv_id = r.conv_id AND o.turn < r.turn AND o.i < r.i AND NOT o.sep AND NOT o.closed AND NOT r.sep),
        ok AS (SELECT * FROM p WHERE NOT EXISTS (SELECT 1 FROM r k WHERE k.conv_id = p.conv_id AND k.turn > p.above AND k.turn < p.turn AND k.i <= p.i))
        SELECT r.conv_id AS config_id, r.turn AS line_no, max(above) AS parent_line FROM r LEFT JOIN ok ON ok.conv_id = r.conv_id AND ok.turn = r.turn GROUP BY ALL""",
    "q_child_context": "WITH o AS (SELECT o_custkey, CASE WHEN o_orderkey % 20 > 0 THEN o_orderstatus END AS c FROM orders), g AS (SELECT o_custkey, count(*) FILTER (c IS NULL) AS u, count(DISTINCT c) AS k, min(c) AS c FROM o GROUP BY 1) SELECT o_custkey, CASE WHEN u = 0 AND k = 1 THEN c END AS child, CASE WHEN u > 0 THEN 'unresolved_transition' WHEN k > 1 THEN 'ambiguous_transition' END AS issue FROM g",
    "q_prompt_transition": "SELECT conv_id, turn, role AS from_prompt, nxt AS to_prompt FROM (SELECT *, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS nxt FROM conversations) WHERE nxt <> role",
    "q_conflicting": "SELECT p_brand, p_name, count(DISTINCT p_type) AS n_targets FROM part GROUP BY ALL HAVING n_targets > 1",
    "q_effects": "WITH o AS (SELECT 'v' || o_custkey % 3 AS view, o_custkey::VARCHAR AS format, CASE WHEN o_orderkey % 31 = 0 THEN 'unknown' WHEN o_orderkey % 2 = 0 AND o_custkey % 3 <> o_custkey % 4 THEN 'switch:v' || o_custkey % 4 ELSE 'stay' END AS e FROM orders) SELECT view, format, CASE WHEN count(*) FILTER (e = 'unknown') = 0 AND count(DISTINCT e) = 1 THEN min(e) END AS effect FROM o GROUP BY ALL",
    "q_follow_declared": "WITH RECURSIVE e AS (SELECT n_nationkey::BIGINT AS l, n_nationkey::BIGINT AS r, n_nationkey::BIGINT + 1 AS lt, n_nationkey::BIGINT + 1 AS rt FROM nation UNION ALL VALUES (10, 10, 12, 13), (20, 20, 99, 98)), f AS (SELECT 0::BIGINT AS l, 0::BIGINT AS r UNION SELECT lt, rt FROM f JOIN e ON e.l = f.l AND e.r = f.r WHERE lt <> 12) SELECT l AS \"left\", r AS \"right\" FROM f",
    "q_example_fixpoint": "WITH RECURSIVE s AS (SELECT CASE WHEN s_suppkey % 10 > 0 THEN 'c' || (s_suppkey // 2) END AS parent, 'c' || s_suppkey AS child, 'v' || s_nationkey AS v FROM supplier), k AS (SELECT child AS command, 'entry' AS view FROM s WHERE parent IS NULL UNION SELECT s.child, s.v FROM k JOIN s ON s.parent = k.command) SELECT * FROM k",
    "q_semantic_lookup": "SELECT o_orderkey, r_name FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey WHERE r_name <> 'ASIA'",
    "q_rule_exists": f"SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING {_CAP_RULE}",
    "q_rule_effects": f"SELECT l_orderkey, array_to_string(list_sort(list_distinct(list_concat(CASE WHEN {_CAP_RULE} THEN ['late'] ELSE [] END, list('flag:' || l_returnflag)))), ',') AS effects FROM lineitem GROUP BY 1",
    "q_rule_agreement": "SELECT l_orderkey, CASE WHEN count(DISTINCT CASE WHEN l_suppkey % 3 > 0 THEN l_linestatus ELSE '' END) > 1 THEN 'ambiguous' WHEN max(l_suppkey % 3) > 0 THEN 'applied' ELSE 'inactive' END AS status FROM lineitem GROUP BY 1",
    "q_pilot_sample": "SELECT doc_id FROM documents ORDER BY CASE WHEN doc_id IN (3, 7) THEN 0 ELSE 1 END, sha256(doc_id::VARCHAR), doc_id LIMIT 50",
    "q_json_access": "SELECT event_id, json_extract(props, '$.k')::BIGINT AS k FROM events",
    "q_binding_order": "WITH a AS (SELECT l_orderkey, l_returnflag, l_linenumber, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber) AS n FROM lineitem), b AS (SELECT l_orderkey, l_returnflag, l_linenumber AS other, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_partkey, l_linenumber) AS n FROM lineitem) SELECT l_orderkey, l_linenumber, other FROM a JOIN b USING (l_orderkey, l_returnflag, n)",
}
