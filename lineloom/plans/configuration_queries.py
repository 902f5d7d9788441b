"""Whole configurations, derived from conversations and parts: reports, contexts, captured values; and pages, names and views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lineloom.functions.pages import parameter_description, placeholder, stated_type
from lineloom.operators import configurations as C
from lineloom.operators import corpus, evidence, experiments, restoring
from lineloom.operators.mapping import direct_lookup, map_catalogs, semantic_lookup
from lineloom.plans.common import table
from lineloom.storage import written

PARTS = {"type": "grouped", "entry_view": "top", "views": {"top": ["user"], "under": ["assistant", "tool <x>"]}}
CONTEXTS = {"type": "grouped", "entry_view": "top", "views": {"top": [{"format": "user", "switch_to_view": "under"}], "under": ["assistant"]}}
NUMBERS = {"commands": ["take { INTEGER<0-30> [ to INTEGER<0-30> ] } &<1-4>"]}
HEAD = {"schema_version": 1, "vendor": "v", "device": "d", "model_type": "m", "type": "flat"}
DEVICE = HEAD | {"source": "device", "commands": [{"format": "take { INTEGER<0-30> [ to INTEGER<0-30> ] } &<1-4>"}, {"format": "give STRING<1-9> [ now ]"}]}
MANUAL = HEAD | {"source": "documentation", "commands": [{"format": "take { <first> [ to <last> ] } &<1-4>", "creates": [{"kind": "range"}]}, {"format": "give <what>"}, {"format": "give <what> later"}]}


def _conversations(spark: SparkSession, d: str, indent) -> DataFrame:
    """(config_id, text): each conversation's roles as lines, indented."""
    line = F.when(F.col("turn") % 7 == 6, "").when(F.col("turn") % 11 == 10, "#").otherwise(F.concat(F.repeat(F.lit(" "), indent), F.col("role")))
    g = table(spark, d, "conversations").groupBy(F.col("conv_id").alias("config_id")).agg(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))).alias("x"))
    return g.select("config_id", F.concat(F.array_join(F.transform("x", lambda x: x["line"]), "\n"), F.lit("\n")).alias("text"))


def q_configuration_report(spark: SparkSession, d: str) -> DataFrame:
    """Counts of each configuration, its lines searched in the part that their indentation says."""
    return C.report(C.parse_configurations(_conversations(spark, d, (F.col("turn") % 2).cast("int")), PARTS))


def q_configuration_contexts(spark: SparkSession, d: str) -> DataFrame:
    """The kind, view and issue of every line by its context."""
    parsed = C.parse_configurations(_conversations(spark, d, (F.col("turn") % 2).cast("int")), CONTEXTS, mode="hierarchy")
    return parsed.select("config_id", "line_no", "kind", "view", F.col("context_issue.code").alias("issue"), F.col("context_issue.source_line").alias("issue_line"))


def _numbers(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    line = F.concat_ws(" ", F.lit("take"), (k % 31).cast("string"), F.when(k % 2 == 0, F.concat(F.lit("to "), (k % 29).cast("string"))), F.when(k % 3 == 0, (k % 23).cast("string")))
    return table(spark, d, "part").select(k.alias("config_id"), line.alias("text"))


def q_captured_values(spark: SparkSession, d: str) -> DataFrame:
    """Values with their slots, places and rounds of the repeat."""
    v = C.captured_values(C.parse_configurations(_numbers(spark, d), NUMBERS))
    return v.select("config_id", "slot_id", F.col("normalized").cast("int").alias("value"), F.col("iterations")[0]["n"].alias("round"), "start")


def q_semantic_bindings(spark: SparkSession, d: str) -> DataFrame:
    """What the manual calls the values of each line, in which round."""
    m = map_catalogs(spark, DEVICE, MANUAL)
    found = semantic_lookup(C.parse_configurations(_numbers(spark, d), DEVICE), m)
    return found.select("config_id", "document_id", F.explode("parameters").alias("p")).select("config_id", "document_id", F.col("p.slot_id").alias("slot_id"), F.col("p.raw").cast("int").alias("value"), F.col("p.iterations")[0]["n"].alias("round"))


def _descriptions(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    text = F.when(k % 7 == 0, "The value is a string.").when(k % 7 == 1, F.concat(F.lit("An integer ranging from 1 to "), F.col("p_size").cast("string"), F.lit("."))).when(k % 7 == 2, "Specifies an IPv4 address in dotted decimal notation.").when(k % 7 == 3, "Specifies an IPv6 prefix.").when(k % 7 == 4, "A MAC address.").when(k % 7 == 5, "The name is a String of letters.").otherwise(F.concat(F.lit("See "), F.col("p_name")))
    return table(spark, d, "part").select("p_partkey", F.array(F.struct(F.col("p_brand").alias("Parameters"), F.lit("other").alias("Info")), F.struct(F.concat(F.lit("x or "), F.col("p_type")).alias("Parameters"), text.alias("Info"))).alias("defs"), "p_type")


def q_described_types(spark: SparkSession, d: str) -> DataFrame:
    """Declarations and types read from descriptions of values."""
    t = _descriptions(spark, d).select("p_partkey", parameter_description(F.col("defs"), F.lit("x")).alias("about"))
    return t.select("p_partkey", placeholder(F.col("about")).alias("declaration"), stated_type(F.col("about"), F.lit(None).cast("string")).alias("type"))


def q_resolved_names(spark: SparkSession, d: str) -> DataFrame:
    """Segments by their name or by its spelling without regard to case and spaces."""
    names = table(spark, d, "customer").select(F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).otherwise(F.concat(F.initcap("c_mktsegment"), F.lit(" Y"))).alias("view")).distinct()
    asked = table(spark, d, "customer").select(F.when(F.col("c_custkey") % 3 == 0, F.col("c_mktsegment")).when(F.col("c_custkey") % 3 == 1, F.concat(F.lower("c_mktsegment"), F.lit("  y"))).otherwise(F.concat(F.lit("no "), F.col("c_mktsegment"))).alias("asked"))
    return corpus.resolved_names(asked, names).select("asked", "status", "target", "method")


def q_shared_members(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "nation").select(F.concat(F.lit("v"), F.col("n_regionkey")).alias("view"), F.col("n_nationkey").alias("id"))
    return corpus.with_shared(m, ["v2"])


def q_hierarchy_report(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    edges = table(spark, d, "supplier").filter(k % 3 > 0).select(F.concat(F.lit("v"), k % 20).alias("src"), F.concat(F.lit("v"), (k * 2 + 1) % 30).alias("dst"))
    views = table(spark, d, "supplier").select(F.concat(F.lit("v"), k % 25).alias("view")).distinct()
    return corpus.hierarchy_report(edges, views, "v1")


def q_direct_lookup(spark: SparkSession, d: str) -> DataFrame:
    """What the manual says of the values of lines that were read against the manual itself."""
    found = direct_lookup(C.parse_configurations(_numbers(spark, d), MANUAL), MANUAL)
    return found.select("config_id", "index_in_view", F.get_json_object("creates", "$[0].kind").alias("creates"), F.explode("parameters").alias("p")).select("config_id", "index_in_view", "creates", F.col("p.name").alias("name"), F.col("p.raw").cast("int").alias("value"))


def q_parsing_report(spark: SparkSession, d: str) -> DataFrame:
    """Counts of each configuration by its contexts, and the lines that aren't in the entry view as they should be."""
    parsed = C.parse_configurations(_conversations(spark, d, (F.col("turn") % 2).cast("int")), CONTEXTS, mode="hierarchy")
    expected = table(spark, d, "conversations").select(F.col("conv_id").alias("config_id"), F.lit(1).alias("line_no"), F.lit("top").alias("view")).distinct()
    r = experiments.parsing_report(parsed, expected)
    return r.select("config_id", "recognized", "errors", "unresolved", "known_context", F.aggregate("context_issues", F.lit(0).cast("long"), lambda n, x: n + x["n"]).alias("issues"), F.size("unexpected_views").alias("unexpected"))


def _sessions(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Commands and pages: a view for each region, entered by a command that says nothing of it (by its name in region 0), and in it one command for each nation, whose page shows it."""
    n, r = F.col("n_nationkey").cast("string"), F.col("n_regionkey").cast("string")
    nation = table(spark, d, "nation")
    text = lambda *x: F.concat(*(F.lit(y) if isinstance(y, str) else y for y in x))
    last = F.when(F.col("n_nationkey") % 7 == 4, "other").otherwise(text("make w", n, " 7"))
    example = F.array(F.lit("<H> system-view"), text("[H] enter r", r), text("[~H-r", r, "] ", last))
    entry = nation.groupBy("n_regionkey").agg(F.lit(1)).select((1000 + F.col("n_regionkey")).alias("id"), text("enter", r, ".json").alias("file"), text("enter r", r).alias("format"), F.lit("System view").alias("view"), F.when(F.col("n_regionkey") == 0, "first region").alias("target"), F.array().cast("array<array<string>>").alias("Examples"))
    local = nation.select(F.col("n_nationkey").alias("id"), text("w", n, ".json").alias("file"), text("make w", n, " <size>").alias("format"), text("Region  ", r, " view").alias("view"), F.lit(None).cast("string").alias("target"), F.array(example).alias("Examples"))
    rows = entry.unionByName(local)
    return rows.select("id", "file", F.lit(0).alias("format_index"), "format", "view", "target"), rows.select("file", F.array("format").alias("CLIs"), F.array("view").alias("ParentView"), "Examples")


def q_example_switches(spark: SparkSession, d: str) -> DataFrame:
    """Views that the prompts of examples show commands to lead to."""
    return restoring.example_switches(*_sessions(spark, d), "System view").select("id", "target")


def q_restored_views(spark: SparkSession, d: str) -> DataFrame:
    return restoring.restore(*_sessions(spark, d), "System view").select("id", "view", "target", "source")


def _pages(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Commands and pages: a page for each part, in a view named by its brand, that names its brand's first page and is said to enter a view named by its type."""
    p = table(spark, d, "part").withColumn("brand", F.substring_index("p_brand", "#", -1))
    first = p.groupBy("p_brand").agg(F.min("p_partkey").alias("head"))
    p = p.join(first, "p_brand")
    file = F.col("p_partkey").cast("string")
    none = F.array().cast("array<array<string>>")
    use = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("Run the item"), F.lpad(F.col("head").cast("string"), 7, "0"), F.lit(" command."))).otherwise("None.")
    topics = F.array(F.struct(F.lit("t").alias("title"), F.array(F.col("head").cast("string")).alias("target_files")))
    pages = p.select(file.alias("file"), file.alias("PageTitle"), F.array().cast("array<string>").alias("CLIs"), F.array(F.concat(F.lit("Brand "), "brand")).alias("ParentView"), F.when(F.col("p_partkey") % 5 == 0, "Returns to it.").otherwise("Enters it.").alias("FuncDef"), F.lit(None).cast("array<struct<Parameters:string,Info:string>>").alias("ParaDef"), use.alias("UsageGuidelines"), none.alias("Examples"), topics.alias("related_topics"))
    return p.select(F.col("p_partkey").alias("id"), file.alias("file"), F.concat(F.lit("item"), F.lpad(file, 7, "0"), F.lit(" <x>")).alias("format"), F.array(F.concat(F.lit("Brand "), "brand")).alias("parent_views"), F.when(F.col("p_partkey") % 7 == 0, F.concat(F.lit("brand  "), "brand")).when(F.col("p_partkey") % 7 == 1, F.concat(F.lit("Brand "), "brand", F.lit(" kind"))).alias("requested"), (F.col("p_partkey") % 7 == 2).alias("uncertain")), pages


def q_view_questions(spark: SparkSession, d: str) -> DataFrame:
    """Transitions that names alone don't settle."""
    return evidence.questions(*_pages(spark, d)).select("id", "requested", "exits")


def q_candidate_views(spark: SparkSession, d: str) -> DataFrame:
    """Views to look at for each question, in order."""
    commands, pages = _pages(spark, d)
    return evidence.candidates(evidence.questions(commands, pages), commands, pages)


def q_supporting_pages(spark: SparkSession, d: str) -> DataFrame:
    """The pages to answer each question from."""
    commands, pages = _pages(spark, d)
    asked = written(evidence.questions(commands, pages))
    return evidence.supporting(asked, evidence.candidates(asked, commands, pages), pages)


QUERIES = {n: f for n, f in globals().items() if n.startswith("q_")}

_LINES = """(SELECT conv_id, turn, (row_number() OVER (PARTITION BY conv_id ORDER BY turn))::INT AS line_no, role, turn % 2 AS depth,
    CASE WHEN turn % 7 = 6 THEN 'blank' WHEN turn % 11 = 10 THEN 'separator' ELSE 'text' END AS k FROM conversations)"""
_LAST = "(SELECT p_partkey AS config_id, p_partkey % 31 AS a, CASE WHEN p_partkey % 2 = 0 THEN p_partkey % 29 END AS b, CASE WHEN p_partkey % 3 = 0 THEN p_partkey % 23 END AS c FROM part)"

_CONTEXTS = f"""WITH l AS (SELECT * FROM {_LINES}),
        s AS (SELECT *, lead(k) OVER (PARTITION BY conv_id ORDER BY turn) AS after FROM l WHERE k <> 'blank'),
        up AS (SELECT c.conv_id, c.line_no, max_by(p.line_no, p.line_no) AS pl, max_by(p.role, p.line_no) AS pr, max_by(p.k, p.line_no) AS pk, max_by(p.after, p.line_no) AS pa FROM s c JOIN s p ON p.conv_id = c.conv_id AND p.line_no < c.line_no AND (p.depth = 0 OR p.k = 'separator') AND c.depth = 1 AND c.k = 'text' GROUP BY ALL),
        j AS (SELECT l.*, CASE WHEN pk = 'text' AND pa = 'text' THEN pl END AS pl, CASE WHEN pk = 'text' AND pa = 'text' THEN pr END AS pr FROM l LEFT JOIN up USING (conv_id, line_no))
        SELECT conv_id AS config_id, line_no,
          CASE WHEN k <> 'text' THEN k WHEN pl IS NULL THEN CASE role WHEN 'user' THEN 'command' WHEN 'assistant' THEN 'unresolved_command' ELSE 'error' END
               WHEN pr = 'user' THEN CASE role WHEN 'assistant' THEN 'command' WHEN 'user' THEN 'unresolved_command' ELSE 'error' END ELSE CASE WHEN role IN ('user', 'assistant') THEN 'unresolved_command' ELSE 'error' END END AS kind,
          CASE WHEN k <> 'text' THEN NULL WHEN pl IS NULL THEN CASE WHEN role <> 'assistant' THEN 'top' END WHEN pr = 'user' THEN CASE WHEN role <> 'user' THEN 'under' END END AS view,
          CASE WHEN k <> 'text' THEN NULL WHEN pl IS NULL THEN CASE WHEN role = 'assistant' THEN 'outside_view' END WHEN pr = 'user' THEN CASE WHEN role = 'user' THEN 'outside_view' END WHEN pr = 'assistant' THEN 'outside_view' ELSE 'parent_parse_error' END AS issue,
          CASE WHEN k <> 'text' THEN NULL WHEN pl IS NULL THEN CASE WHEN role = 'assistant' THEN line_no END WHEN pr = 'user' THEN CASE WHEN role = 'user' THEN line_no END ELSE pl END AS issue_line FROM j"""
_ASKED = """(SELECT p_partkey AS id, split_part(p_brand, '#', 2) AS b, CASE p_partkey % 7 WHEN 0 THEN 'brand  ' || split_part(p_brand, '#', 2) WHEN 1 THEN 'Brand ' || split_part(p_brand, '#', 2) || ' kind' END AS requested, p_partkey % 5 = 0 AS exits
    FROM part WHERE p_partkey % 7 IN (1, 2) OR p_partkey % 7 = 0 AND p_partkey % 5 = 0)"""
_HEADS = "(SELECT split_part(p_brand, '#', 2) AS b, min(p_partkey) AS head FROM part GROUP BY 1)"
_RANKED = f"""(SELECT id, a.b AS own, v.b AS b, (row_number() OVER (PARTITION BY id ORDER BY v.b <> a.b, v.b))::INT AS rank FROM {_ASKED} a JOIN {_HEADS} v ON NOT exits AND (v.b = a.b OR requested IS NOT NULL) QUALIFY rank <= 12)"""

ORACLE_SQL = {
    "q_configuration_report": f"""WITH l AS (SELECT *, k = 'text' AND (depth = 0 AND role = 'user' OR depth = 1 AND role = 'assistant') AS ok FROM {_LINES})
        SELECT conv_id AS config_id, count(*) AS total, count(*) FILTER (k = 'blank') AS blank, count(*) FILTER (ok) AS commands, 0::BIGINT AS ambiguous, count(*) FILTER (k = 'text' AND NOT ok) AS errors, 0::BIGINT AS unresolved FROM l GROUP BY 1""",
    "q_configuration_contexts": _CONTEXTS,
    "q_captured_values": f"""SELECT config_id, 'p:7' AS slot_id, a::INT AS value, 0 AS round, 5 AS start FROM {_LAST}
        UNION ALL SELECT config_id, 'p:26', b::INT, 0, 5 + length(a::VARCHAR) + 4 FROM {_LAST} WHERE b IS NOT NULL
        UNION ALL SELECT config_id, 'p:7', c::INT, 1, 5 + length(a::VARCHAR) + 1 + CASE WHEN b IS NULL THEN 0 ELSE length(b::VARCHAR) + 4 END FROM {_LAST} WHERE c IS NOT NULL""",
    "q_semantic_bindings": f"""SELECT config_id, 'doc:0' AS document_id, 'p:7' AS slot_id, a::INT AS value, 0 AS round FROM {_LAST}
        UNION ALL SELECT config_id, 'doc:0', 'p:20', b::INT, 0 FROM {_LAST} WHERE b IS NOT NULL UNION ALL SELECT config_id, 'doc:0', 'p:7', c::INT, 1 FROM {_LAST} WHERE c IS NOT NULL""",
    "q_described_types": """SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN 'STRING<1-65535>' WHEN 1 THEN 'INTEGER<1-' || p_size || '>' WHEN 2 THEN 'X.X.X.X' WHEN 3 THEN 'X:X::X:X/M' WHEN 4 THEN 'H-H-H' WHEN 5 THEN 'STRING<1-65535>' END AS declaration,
        CASE WHEN p_partkey % 7 IN (0, 5) THEN 'string' ELSE 'unknown' END AS type FROM part""",
    "q_resolved_names": """WITH n AS (SELECT DISTINCT CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) || ' Y' END AS v FROM customer),
        a AS (SELECT DISTINCT CASE c_custkey % 3 WHEN 0 THEN c_mktsegment WHEN 1 THEN lower(c_mktsegment) || '  y' ELSE 'no ' || c_mktsegment END AS q FROM customer),
        m AS (SELECT q, (SELECT v FROM n WHERE v = q) AS same, (SELECT list(v) FROM n WHERE lower(v) = lower(regexp_replace(q, ' +', ' ', 'g'))) AS near FROM a)
        SELECT q AS asked, CASE WHEN same IS NOT NULL OR len(near) = 1 THEN 'resolved' WHEN len(near) > 1 THEN 'ambiguous' ELSE 'missing' END AS status, coalesce(same, CASE WHEN len(near) = 1 THEN near[1] END) AS target, CASE WHEN same IS NOT NULL THEN 'exact' WHEN len(near) = 1 THEN 'normalized' END AS method FROM m""",
    "q_shared_members": "SELECT DISTINCT v AS view, id FROM (SELECT 'v' || n_regionkey AS v, n_nationkey AS id FROM nation UNION ALL SELECT 'v' || r_regionkey, n_nationkey FROM region, nation WHERE n_regionkey = 2 AND r_regionkey <> 2)",
    "q_hierarchy_report": """WITH RECURSIVE e AS (SELECT 'v' || s_suppkey % 20 AS src, 'v' || (s_suppkey * 2 + 1) % 30 AS dst FROM supplier WHERE s_suppkey % 3 > 0), r AS (SELECT 'v1' AS v UNION SELECT dst FROM r JOIN e ON src = v), h AS (SELECT DISTINCT 'v' || s_suppkey % 25 AS v FROM supplier)
        SELECT v AS view, v IN (FROM r) AS reachable, v IN (FROM h) AS has_commands FROM (SELECT v FROM h UNION SELECT dst FROM e)""",
    "q_direct_lookup": f"""SELECT config_id, 0 AS index_in_view, 'range' AS creates, 'first' AS name, a::INT AS value FROM {_LAST}
        UNION ALL SELECT config_id, 0, 'range', 'last', b::INT FROM {_LAST} WHERE b IS NOT NULL UNION ALL SELECT config_id, 0, 'range', 'first', c::INT FROM {_LAST} WHERE c IS NOT NULL""",
    "q_parsing_report": f"""SELECT config_id, count(*) FILTER (kind IN ('command', 'unresolved_command')) AS recognized, count(*) FILTER (kind = 'error') AS errors, count(*) FILTER (kind = 'unresolved_command') AS unresolved,
        count(*) FILTER (kind IN ('command', 'unresolved_command') AND view IS NOT NULL) AS known_context, count(*) FILTER (kind IN ('command', 'unresolved_command') AND issue IS NOT NULL) AS issues, (count(*) FILTER (line_no = 1 AND view IS DISTINCT FROM 'top'))::INT AS unexpected FROM ({_CONTEXTS}) GROUP BY 1""",
    "q_example_switches": "SELECT 1000 + n_regionkey AS id, 'region ' || n_regionkey || ' view' AS target FROM nation WHERE n_nationkey % 7 <> 4 GROUP BY ALL",
    "q_restored_views": """WITH s AS (SELECT DISTINCT n_regionkey AS r FROM nation WHERE n_nationkey % 7 <> 4)
        SELECT DISTINCT 1000 + n_regionkey AS id, 'system view' AS view, CASE WHEN n_regionkey = 0 THEN 'first region' WHEN n_regionkey IN (FROM s) THEN 'region ' || n_regionkey || ' view' END AS target, CASE WHEN n_regionkey = 0 THEN 'stated' WHEN n_regionkey IN (FROM s) THEN 'example' END AS source FROM nation
        UNION ALL SELECT n_nationkey, CASE WHEN n_regionkey = 0 AND 0 IN (FROM s) THEN 'first region' ELSE 'region ' || n_regionkey || ' view' END, NULL, NULL FROM nation""",
    "q_view_questions": f"SELECT id, requested, exits FROM {_ASKED}",
    "q_candidate_views": f"SELECT id, 'Brand ' || b AS view, rank FROM {_RANKED}",
    "q_supporting_pages": f"""WITH w AS (SELECT p_partkey AS p, p_partkey % 3 = 0 AS says, split_part(p_brand, '#', 2) AS b FROM part),
        j AS (SELECT id, r.b, p::VARCHAR AS file, says, own = r.b AND head IN (p, id) AS near, head = id AND says AS named FROM {_RANKED} r JOIN w ON w.b = r.b JOIN {_HEADS} h ON h.b = r.b),
        k AS (SELECT *, row_number() OVER (PARTITION BY id, b ORDER BY NOT near, NOT named, says, file) AS place FROM j)
        SELECT id, file FROM k WHERE place = 1 OR place = 2 AND near UNION SELECT id, id::VARCHAR FROM {_ASKED}""",
}
