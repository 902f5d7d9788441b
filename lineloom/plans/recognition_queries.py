"""Recognition, resolution, errors and suggestions over part names and derived command lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lineloom.operators import recognition as R
from lineloom.operators.suggestions import suggest
from lineloom.plans.common import formats, table

GRAMMAR = formats("red <item>", "{ blue | cold } { bolt | ring }", "small ENUM{ring,rod,gear}", "old <item>", "old STRING<4-4>", "new bolt", "new bolt", "hot STRING<1-4>")
LINEAR = formats("red <item>", "small ENUM{ring,rod,gear}", "old STRING<4-4>", "new bolt", "hot STRING<1-4>", "large widget")


def _names(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", F.col("p_name").alias("command"))


def _set_lines(spark: SparkSession, d: str) -> DataFrame:
    """set <first word> size <n> [<second word>] of each part, with some words left out or doubled."""
    w = F.split("p_name", " ")
    k = F.col("p_partkey")
    line = F.concat_ws(" ", F.lit("set"), F.when(k % 4 != 0, F.lit("a")), F.when(k % 3 != 0, F.lit("b")), F.when(k % 5 == 0, F.lit("a")), F.when(k % 7 == 0, F.lit("c")), F.when(k % 11 == 0, w[0]))
    return table(spark, d, "part").select("p_partkey", line.alias("command"))


def _numbers(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    count = (k % 6).cast("int")
    numbers = F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda i: (k * i % 20).cast("string"))
    line = F.concat_ws(" ", F.lit("vlan"), F.when(count > 0, F.array_join(F.slice(numbers, F.lit(1), count), " ")))
    return table(spark, d, "part").select("p_partkey", line.alias("command"))


def _outcomes(rows: DataFrame, catalog, **how) -> DataFrame:
    return rows.join(R.automaton_results(R.distinct_commands(rows), catalog, **how), "command")


def q_status(spark: SparkSession, d: str) -> DataFrame:
    return _outcomes(_names(spark, d), GRAMMAR).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


def q_linear_match(spark: SparkSession, d: str) -> DataFrame:
    rows = _names(spark, d)
    found = R.linear_probed(R.linear_matches(R.distinct_commands(rows), LINEAR)).select("command", "format", "status")
    return rows.join(found, "command").select("p_partkey", "format", "status")


def q_literal_prefix(spark: SparkSession, d: str) -> DataFrame:
    """Formats whose leading words a command begins with."""
    rows = _names(spark, d)
    leads = spark.createDataFrame([("red",), ("new bolt",), ("old",), ("cold ring",)], "lead string")
    parts = R.distinct_commands(rows).select("command", F.explode(F.transform(F.sequence(F.lit(1), F.size("folded")), lambda i: F.array_join(F.slice("folded", F.lit(1), i), " "))).alias("lead"))
    return rows.join(parts.join(F.broadcast(leads), "lead"), "command").select("p_partkey", "lead")


def q_choice(spark: SparkSession, d: str) -> DataFrame:
    return _outcomes(_names(spark, d), formats("{ red | blue } { bolt | ring | rod }")).filter("outcome = 'unique'").select("p_partkey", "command")


def q_optional(spark: SparkSession, d: str) -> DataFrame:
    return _outcomes(_set_lines(spark, d), formats("set [ a ] [ b ]")).filter("outcome = 'unique'").select("p_partkey", "command")


def q_set(spark: SparkSession, d: str) -> DataFrame:
    return _outcomes(_set_lines(spark, d), formats("set { a | b | c } *")).select("p_partkey", (F.col("outcome") == "unique").alias("accepted"))


def q_repeat(spark: SparkSession, d: str) -> DataFrame:
    return _outcomes(_numbers(spark, d), formats("vlan INTEGER<1-15> &<2-4>")).select("p_partkey", "outcome")


def q_duplicate_fanout(spark: SparkSession, d: str) -> DataFrame:
    rows = _names(spark, d)
    found = R.linear_matches(R.distinct_commands(rows), formats("new bolt", "red <item>")).select("command", "format")
    return rows.join(R.fan_out(found, formats("new bolt", "red <item>", "new bolt")), "command").select("p_partkey", "pattern_index", "pattern_id")


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    line = table(spark, d, "lineitem")
    return line.select("l_orderkey", "l_linenumber", F.array((F.col("l_partkey") % 3).cast("int"), (F.col("l_suppkey") % 3).cast("int"), F.col("l_linenumber") % 2).alias("ranks"), (F.col("l_partkey") % 2 == 0).alias("good"))


def q_skyline(spark: SparkSession, d: str) -> DataFrame:
    return R.skyline(_vectors(spark, d), ["l_orderkey"]).groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.min("l_linenumber").alias("first_line"))


def q_blocking(spark: SparkSession, d: str) -> DataFrame:
    v = _vectors(spark, d)
    return R.blocked(v.filter("good"), v.filter("not good"), ["l_orderkey"]).groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))


def q_first_wins(spark: SparkSession, d: str) -> DataFrame:
    return R.first_wins(table(spark, d, "part").select("p_name", "p_brand", "p_partkey"), ["p_name"], ["p_partkey"])


def q_furthest_progress(spark: SparkSession, d: str) -> DataFrame:
    """What was expected furthest on, of commands that nothing reads."""
    rows = _names(spark, d)
    out = _outcomes(rows, formats("red bolt", "red ring", "blue rod now", "cold")).filter(F.col("outcome").isin("syntax_error", "unknown_command"))
    return out.select("p_partkey", "outcome", F.col("furthest").cast("long").alias("furthest"), F.array_join(F.array_sort("expected"), "|").alias("expected"))


def q_error_codes(spark: SparkSession, d: str) -> DataFrame:
    return _outcomes(_numbers(spark, d), formats("vlan INTEGER<5-9>", "vlan INTEGER<1-9> INTEGER<1-9>")).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


def q_report(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "part").select((F.col("p_partkey") % 50).alias("config_id"), F.when(F.col("p_size") % 7 == 0, "").when(F.col("p_size") % 7 == 1, "#").otherwise(F.col("p_name")).alias("command"))
    return R.report(R.parse_lines(t, GRAMMAR))


def q_suggest_top5(spark: SparkSession, d: str) -> DataFrame:
    """Formats of one word that differs in at most one place from a misspelt one."""
    w = F.split("p_name", " ")[1]
    wrong = table(spark, d, "part").select(F.concat(F.substring(w, 1, 1), F.substring(w, 3, 10)).alias("command")).distinct()
    return suggest(wrong, ["anvil", "bolt", "gear", "gizmo", "plate", "ring", "rod", "widget"]).select("command", "rank", "text")


_TERNARY = "(SELECT l_orderkey, l_linenumber, (l_partkey % 3)::INT AS a, (l_suppkey % 3)::INT AS b, l_linenumber % 2 AS c, l_partkey % 2 = 0 AS good FROM lineitem)"
_LESS = "w.l_orderkey = v.l_orderkey AND w.a <= v.a AND w.b <= v.b AND w.c <= v.c AND (w.a < v.a OR w.b < v.b OR w.c < v.c)"
_SET = "(SELECT p_partkey, 'set' || CASE WHEN p_partkey % 4 <> 0 THEN ' a' ELSE '' END || CASE WHEN p_partkey % 3 <> 0 THEN ' b' ELSE '' END || CASE WHEN p_partkey % 5 = 0 THEN ' a' ELSE '' END || CASE WHEN p_partkey % 7 = 0 THEN ' c' ELSE '' END || CASE WHEN p_partkey % 11 = 0 THEN ' ' || split_part(p_name, ' ', 1) ELSE '' END AS command FROM part)"
_NUM = "(SELECT p_partkey, (p_partkey % 6)::INT AS n, list_transform(range(1, (p_partkey % 6)::INT + 1), lambda i: p_partkey * i % 20) AS v FROM part)"
_GRAMMAR_CASE = """CASE WHEN a = 'red' THEN 'unique' WHEN a IN ('blue', 'cold') THEN CASE WHEN b IN ('bolt', 'ring') THEN 'unique' ELSE 'syntax_error' END
    WHEN a = 'small' THEN CASE WHEN b IN ('ring', 'rod', 'gear') THEN 'unique' ELSE 'validation_error' END
    WHEN a = 'old' THEN CASE WHEN length(b) = 4 THEN 'equivalence' ELSE 'unique' END
    WHEN a = 'new' THEN CASE WHEN b = 'bolt' THEN 'unique' ELSE 'syntax_error' END
    WHEN a = 'hot' THEN CASE WHEN length(b) <= 4 THEN 'unique' ELSE 'validation_error' END ELSE 'unknown_command' END"""
_P = "(SELECT p_partkey, p_size, p_name, split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS b FROM part)"
# old <item> and old STRING<4-4> both read a word of four letters, with values of different types: ambiguous
_STATUS = _GRAMMAR_CASE.replace("'equivalence'", "'ambiguous'")

QUERIES = {f.__name__: f for f in (q_status, q_linear_match, q_literal_prefix, q_choice, q_optional, q_set, q_repeat, q_duplicate_fanout, q_skyline, q_blocking, q_first_wins, q_furthest_progress, q_error_codes, q_report, q_suggest_top5)}

ORACLE_SQL = {
    "q_status": f"SELECT {_STATUS} AS outcome, count(*) AS n FROM {_P} GROUP BY ALL",
    "q_linear_match": f"""SELECT p_partkey, 'red <item>' AS format, 'valid' AS status FROM {_P} WHERE a = 'red'
        UNION ALL SELECT p_partkey, 'small ENUM{{ring,rod,gear}}', CASE WHEN b IN ('ring','rod','gear') THEN 'valid' ELSE 'strange' END FROM {_P} WHERE a = 'small'
        UNION ALL SELECT p_partkey, 'old STRING<4-4>', CASE WHEN length(b) = 4 THEN 'valid' ELSE 'invalid' END FROM {_P} WHERE a = 'old'
        UNION ALL SELECT p_partkey, 'new bolt', 'valid' FROM {_P} WHERE p_name = 'new bolt'
        UNION ALL SELECT p_partkey, 'hot STRING<1-4>', CASE WHEN length(b) <= 4 THEN 'valid' ELSE 'invalid' END FROM {_P} WHERE a = 'hot'
        UNION ALL SELECT p_partkey, 'large widget', 'valid' FROM {_P} WHERE p_name = 'large widget'""",
    "q_literal_prefix": "SELECT p_partkey, lead FROM part JOIN (VALUES ('red'), ('new bolt'), ('old'), ('cold ring')) v(lead) ON p_name = lead OR starts_with(p_name, lead || ' ')",
    "q_choice": f"SELECT p_partkey, p_name AS command FROM {_P} WHERE a IN ('red', 'blue') AND b IN ('bolt', 'ring', 'rod')",
    "q_optional": f"SELECT p_partkey, command FROM {_SET} WHERE command IN ('set', 'set a', 'set b', 'set a b')",
    "q_set": f"SELECT p_partkey, len(w) > 0 AND len(list_distinct(w)) = len(w) AND len(list_filter(w, lambda x: x NOT IN ('a', 'b', 'c'))) = 0 AS accepted FROM (SELECT p_partkey, string_split(command, ' ')[2:] AS w FROM {_SET})",
    "q_repeat": f"SELECT p_partkey, CASE WHEN n NOT BETWEEN 2 AND 4 THEN 'syntax_error' WHEN len(list_filter(v, lambda x: x NOT BETWEEN 1 AND 15)) = 0 THEN 'unique' ELSE 'validation_error' END AS outcome FROM {_NUM}",
    "q_duplicate_fanout": "SELECT p_partkey, i::INT AS pattern_index, 'pattern:' || sha256(f)[1:20] || ':' || o AS pattern_id FROM part JOIN (VALUES (0, 'new bolt', 0), (1, 'red <item>', 0), (2, 'new bolt', 1)) v(i, f, o) ON p_name = f OR (f = 'red <item>' AND starts_with(p_name, 'red '))",
    "q_skyline": f"WITH x AS {_TERNARY} SELECT l_orderkey, count(*) AS n, min(l_linenumber) AS first_line FROM x v WHERE NOT EXISTS (SELECT 1 FROM x w WHERE {_LESS}) GROUP BY l_orderkey",
    "q_blocking": f"WITH x AS {_TERNARY} SELECT l_orderkey, count(*) AS n FROM x v WHERE good AND EXISTS (SELECT 1 FROM x w WHERE NOT w.good AND {_LESS}) GROUP BY l_orderkey",
    "q_first_wins": "SELECT p_name, p_brand, p_partkey FROM part QUALIFY row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) = 1",
    "q_furthest_progress": f"""SELECT p_partkey, CASE WHEN a IN ('red', 'blue', 'cold') THEN 'syntax_error' ELSE 'unknown_command' END AS outcome,
        CASE WHEN a IN ('red', 'cold') THEN 1 WHEN a = 'blue' THEN CASE WHEN b = 'rod' THEN 2 ELSE 1 END ELSE 0 END::BIGINT AS furthest,
        CASE WHEN a = 'red' THEN 'bolt|ring' WHEN a = 'cold' THEN 'end of command' WHEN a = 'blue' THEN CASE WHEN b = 'rod' THEN 'now' ELSE 'rod' END ELSE '' END AS expected
        FROM {_P} WHERE p_name NOT IN ('red bolt', 'red ring')""",
    "q_error_codes": f"SELECT CASE WHEN n = 1 THEN CASE WHEN v[1] BETWEEN 5 AND 9 THEN 'unique' ELSE 'validation_error' END WHEN n = 2 THEN CASE WHEN v[1] BETWEEN 1 AND 9 AND v[2] BETWEEN 1 AND 9 THEN 'unique' ELSE 'validation_error' END ELSE 'syntax_error' END AS outcome, count(*) AS n FROM {_NUM} GROUP BY ALL",
    "q_report": f"""WITH x AS (SELECT p_partkey % 50 AS config_id, p_size % 7 AS s, {_STATUS} AS o FROM {_P})
        SELECT config_id, count(*) AS n_lines, count(*) FILTER (s > 1 AND o IN ('unique', 'ambiguous')) AS n_commands, count(*) FILTER (s = 0) AS n_blank, count(*) FILTER (s = 1) AS n_separators,
        count(*) FILTER (s > 1 AND o NOT IN ('unique', 'ambiguous')) AS n_errors, count(*) FILTER (s > 1 AND o = 'ambiguous') AS n_ambiguous FROM x GROUP BY config_id""",
    "q_suggest_top5": """WITH w AS (SELECT DISTINCT split_part(p_name, ' ', 2) AS word FROM part), c AS (SELECT DISTINCT word[1:1] || word[3:] AS command FROM w),
        s AS (SELECT command, f, damerau_levenshtein(command, f) AS dist, i FROM c, (VALUES ('anvil', 0), ('bolt', 1), ('gear', 2), ('gizmo', 3), ('plate', 4), ('ring', 5), ('rod', 6), ('widget', 7)) v(f, i)
          WHERE dist <= CASE WHEN length(command) <= 4 THEN 1 WHEN length(command) <= 8 THEN 2 ELSE 3 END AND round_even(1000.0 * dist / greatest(length(command), length(f)), 0) <= 450)
        SELECT command, (row_number() OVER (PARTITION BY command ORDER BY round_even(1000.0 * dist / greatest(length(command), length(f)), 0), i))::INT AS rank, f AS text FROM s QUALIFY rank <= 5""",
}
