"""Lines, tokens, identifiers, value tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lineloom.functions.probes import probe
from lineloom.functions.text import body, fold, indent, normal_name, short_hash, terms, tokens
from lineloom.grammar.values import REGISTRY
from lineloom.operators.recognition import config_lines
from lineloom.plans.common import duck_tokens, table


def _flat(df: DataFrame, declaration: str, raw, *keys) -> DataFrame:
    """One test of a column as raw, status, normal, code."""
    d, _ = REGISTRY.read(declaration, 0)
    return df.select(*keys, raw.alias("raw")).select("*", probe(d, F.col("raw")).alias("p")).select(*keys, "raw", F.col("p.status").alias("status"), F.col("p.normal").alias("normal"), F.col("p.code").alias("code"))


def q_lines(spark: SparkSession, d: str) -> DataFrame:
    rows = config_lines(table(spark, d, "documents"), "doc_id", "text")
    return rows.select(F.col("config_id").alias("doc_id"), F.col("line_no").cast("long").alias("line_no"), F.length("raw").cast("long").alias("n_chars"))


def q_tokens(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "part").select("p_partkey", F.concat_ws("  ", F.lit("show"), "p_name", "p_type").alias("line"))
    return t.select("p_partkey", F.posexplode(tokens("line")).alias("pos", "token")).select("p_partkey", F.col("pos").cast("long").alias("pos"), fold("token").alias("token"))


def q_indent_scope(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "orders").select(F.concat(F.repeat(F.lit(" "), (F.col("o_orderkey") % 4).cast("int")), F.lit("order "), F.col("o_orderpriority"), F.lit(" ")).alias("line"))
    t = t.select(indent("line").cast("long").alias("depth"), body("line").alias("command"))
    return t.groupBy(F.when(F.col("depth") > 0, "nested").otherwise("system").alias("scope"), "depth", "command").agg(F.count(F.lit(1)).alias("n"))


def q_pattern_ids(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("p_name").orderBy("p_partkey")
    return table(spark, d, "part").select("p_partkey", F.concat(F.lit("pattern:"), short_hash("p_name"), F.lit(":"), (F.row_number().over(w) - 1).cast("string")).alias("pattern_id"))


def q_probe_integer(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "part")
    raw = F.when(F.col("p_partkey") % 5 == 0, F.col("p_type")).when(F.col("p_partkey") % 5 == 1, F.concat(F.lit("-"), F.col("p_size"))).when(F.col("p_partkey") % 5 == 2, F.concat(F.lit("+0"), F.col("p_size"))).otherwise(F.col("p_size").cast("string"))
    return _flat(t, "INTEGER<5-30>", raw, "p_partkey")


def q_probe_hex(spark: SparkSession, d: str) -> DataFrame:
    raw = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("0x"), F.hex("o_orderkey"))).when(F.col("o_orderkey") % 3 == 1, F.lower(F.hex("o_custkey"))).otherwise(F.concat(F.lit("g"), F.hex("o_orderkey")))
    return _flat(table(spark, d, "orders"), "HEX<80-FFD>", raw, "o_orderkey").select("o_orderkey", "raw", "status", F.col("normal").cast("long").alias("normal"), "code")


def q_probe_string(spark: SparkSession, d: str) -> DataFrame:
    raw = F.when(F.col("p_partkey") % 3 == 0, F.col("p_name")).when(F.col("p_partkey") % 3 == 1, F.col("p_type")).otherwise(F.col("p_brand"))
    return _flat(table(spark, d, "part"), "STRING<6-7>", raw, "p_partkey")


def q_probe_enum(spark: SparkSession, d: str) -> DataFrame:
    return _flat(table(spark, d, "customer"), "ENUM{Building,FURNITURE,machinery}", F.col("c_mktsegment"), "c_custkey")


def q_probe_ipv4(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "orders")
    part = lambda c, m: (F.col(c) % m).cast("string")
    raw = F.concat_ws(".", F.lit("010"), part("o_orderkey", 300), part("o_custkey", 260), F.when(F.col("o_orderkey") % 7 == 0, F.lit("")).when(F.col("o_orderkey") % 11 == 0, F.lit("1.2")).when(F.col("o_orderkey") % 13 == 0, F.lit("x")).otherwise(part("o_orderkey", 256)))
    return _flat(t, "X.X.X.X", raw, "o_orderkey")


def q_probe_mac(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "orders")
    raw = F.concat_ws("-", F.hex("o_custkey"), F.when(F.col("o_orderkey") % 5 == 0, F.lit("12345")).when(F.col("o_orderkey") % 5 == 1, F.lit("zz")).otherwise(F.hex(F.col("o_orderkey") % 4096)), F.lit("1"))
    return _flat(t, "H-H-H", raw, "o_orderkey")


def _dates(spark: SparkSession, d: str):
    k = F.col("o_orderkey")
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    return table(spark, d, "orders"), F.lpad((k % 2100).cast("string"), 4, "0"), two(k % 14), two(k % 32)


def q_probe_dates(spark: SparkSession, d: str) -> DataFrame:
    t, y, m, day = _dates(spark, d)
    raw = F.when(F.col("o_orderkey") % 9 == 0, F.concat_ws("/", y, m, day)).otherwise(F.concat_ws("-", y, m, day))
    return _flat(t, "YYYY-MM-DD", raw, "o_orderkey")


def q_probe_month_day(spark: SparkSession, d: str) -> DataFrame:
    t, _, m, day = _dates(spark, d)
    return _flat(t, "MM-DD", F.concat_ws("-", m, day), "o_orderkey")


def q_probe_time(spark: SparkSession, d: str) -> DataFrame:
    two = lambda m: F.lpad((F.col("o_orderkey") % m).cast("string"), 2, "0")
    return _flat(table(spark, d, "orders"), "HH:MM:SS", F.concat_ws(":", two(26), two(61), two(62)), "o_orderkey")


def q_probe_text(spark: SparkSession, d: str) -> DataFrame:
    return _flat(table(spark, d, "part"), "TEXT<8-10>", F.col("p_name"), "p_partkey").drop("raw")


def q_view_names(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "customer").select(normal_name(F.concat(F.lit("  "), F.col("c_mktsegment"), F.lit("   View "))).alias("name"))
    return t.groupBy("name").agg(F.count(F.lit(1)).alias("n"))


def q_terms(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select("item_id", F.explode(terms("text")).alias("term"))


_SLOT = """WITH t AS ({t}) SELECT {keys}, raw, status, normal, code FROM (SELECT *, {status} AS status FROM t) u
CROSS JOIN LATERAL (SELECT CASE WHEN status = 'valid' THEN {normal} END AS normal, CASE WHEN status = 'invalid' THEN {code} END AS code)"""


def _sql(t: str, keys: str, status: str, normal: str, code: str) -> str:
    return _SLOT.format(t=t, keys=keys, status=status, normal=normal, code=code)


_Y, _M, _D = "lpad((o_orderkey % 2100)::VARCHAR, 4, '0')", "lpad((o_orderkey % 14)::VARCHAR, 2, '0')", "lpad((o_orderkey % 32)::VARCHAR, 2, '0')"
_T2 = "lpad((o_orderkey % {})::VARCHAR, 2, '0')"
_SEGMENT = "CASE c_mktsegment WHEN 'BUILDING' THEN 'Building' WHEN 'FURNITURE' THEN 'FURNITURE' WHEN 'MACHINERY' THEN 'machinery' END"

QUERIES = {f.__name__: f for f in (q_lines, q_tokens, q_indent_scope, q_pattern_ids, q_probe_integer, q_probe_hex, q_probe_string, q_probe_enum, q_probe_ipv4, q_probe_mac, q_probe_dates, q_probe_month_day, q_probe_time, q_probe_text, q_view_names, q_terms)}

ORACLE_SQL = {
    "q_lines": r"""WITH d AS (SELECT doc_id, regexp_replace(text, '(\r\n|\r|\n)$', '') AS t FROM documents WHERE text <> ''),
        l AS (SELECT doc_id, unnest(string_split_regex(t, '\r\n|\r|\n')) AS raw, generate_subscripts(string_split_regex(t, '\r\n|\r|\n'), 1) AS line_no FROM d)
        SELECT doc_id, line_no, length(raw) AS n_chars FROM l""",
    "q_tokens": f"WITH t AS (SELECT p_partkey, {duck_tokens(chr(39) + 'show  ' + chr(39) + ' || p_name || ' + chr(39) + '  ' + chr(39) + ' || p_type')} AS ts FROM part) SELECT p_partkey, generate_subscripts(ts, 1) - 1 AS pos, lower(unnest(ts)) AS token FROM t",
    "q_indent_scope": "SELECT CASE WHEN o_orderkey % 4 > 0 THEN 'nested' ELSE 'system' END AS scope, o_orderkey % 4 AS depth, 'order ' || o_orderpriority AS command, count(*) AS n FROM orders GROUP BY ALL",
    "q_pattern_ids": "SELECT p_partkey, 'pattern:' || sha256(p_name)[1:20] || ':' || (row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) - 1)::VARCHAR AS pattern_id FROM part",
    "q_probe_integer": _sql("SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN p_type WHEN 1 THEN '-' || p_size WHEN 2 THEN '+0' || p_size ELSE p_size::VARCHAR END AS raw FROM part", "p_partkey", "CASE WHEN NOT regexp_full_match(raw, '[+-]?[0-9]+') THEN 'not_applicable' WHEN try_cast(raw AS HUGEINT) BETWEEN 5 AND 30 THEN 'valid' ELSE 'invalid' END", "try_cast(raw AS HUGEINT)::VARCHAR", "CASE WHEN try_cast(raw AS HUGEINT) < 5 THEN 'below_minimum' ELSE 'above_maximum' END"),
    "q_probe_hex": _sql("SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN '0x' || upper(to_hex(o_orderkey)) WHEN 1 THEN lower(to_hex(o_custkey)) ELSE 'g' || upper(to_hex(o_orderkey)) END AS raw, CASE o_orderkey % 3 WHEN 0 THEN o_orderkey WHEN 1 THEN o_custkey END AS v FROM orders", "o_orderkey", "CASE WHEN v IS NULL THEN 'not_applicable' WHEN v BETWEEN 128 AND 4093 THEN 'valid' ELSE 'invalid' END", "v", "CASE WHEN v < 128 THEN 'below_minimum' ELSE 'above_maximum' END"),
    "q_probe_string": _sql("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN p_type ELSE p_brand END AS raw FROM part", "p_partkey", "CASE WHEN NOT contains(raw, ' ') AND length(raw) BETWEEN 6 AND 7 THEN 'valid' ELSE 'invalid' END", "raw", "CASE WHEN contains(raw, ' ') THEN 'invalid_token' WHEN length(raw) < 6 THEN 'too_short' ELSE 'too_long' END"),
    "q_probe_enum": f"SELECT c_custkey, c_mktsegment AS raw, CASE WHEN {_SEGMENT} IS NULL THEN 'not_applicable' ELSE 'valid' END AS status, {_SEGMENT} AS normal, NULL::VARCHAR AS code FROM customer",
    "q_probe_ipv4": _sql("SELECT o_orderkey, '010.' || (o_orderkey % 300) || '.' || (o_custkey % 260) || '.' || CASE WHEN o_orderkey % 7 = 0 THEN '' WHEN o_orderkey % 11 = 0 THEN '1.2' WHEN o_orderkey % 13 = 0 THEN 'x' ELSE (o_orderkey % 256)::VARCHAR END AS raw, o_orderkey % 300 AS b, o_custkey % 260 AS c FROM orders", "o_orderkey", "CASE WHEN contains(raw, 'x') THEN 'not_applicable' WHEN o_orderkey % 7 = 0 OR o_orderkey % 11 = 0 OR b > 255 OR c > 255 THEN 'invalid' ELSE 'valid' END", "'10.' || b || '.' || c || '.' || (o_orderkey % 256)", "'invalid_ipv4_address'"),
    "q_probe_mac": _sql("SELECT o_orderkey, upper(to_hex(o_custkey)) || '-' || CASE o_orderkey % 5 WHEN 0 THEN '12345' WHEN 1 THEN 'zz' ELSE upper(to_hex(o_orderkey % 4096)) END || '-1' AS raw FROM orders", "o_orderkey", "CASE o_orderkey % 5 WHEN 1 THEN 'not_applicable' WHEN 0 THEN 'invalid' ELSE CASE WHEN length(split_part(raw, '-', 1)) <= 4 THEN 'valid' ELSE 'invalid' END END", "array_to_string(list_transform(string_split(lower(raw), '-'), lambda p: lpad(p, 4, '0')), '-')", "'invalid_mac'"),
    "q_probe_dates": _sql(f"SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN {_Y} || '/' || {_M} || '/' || {_D} ELSE {_Y} || '-' || {_M} || '-' || {_D} END AS raw FROM orders", "o_orderkey", "CASE WHEN contains(raw, '/') THEN 'not_applicable' WHEN raw[1:4] <> '0000' AND try_strptime(raw, '%Y-%m-%d') IS NOT NULL THEN 'valid' ELSE 'invalid' END", "raw", "'invalid_datetime'"),
    "q_probe_month_day": _sql(f"SELECT o_orderkey, {_M} || '-' || {_D} AS raw FROM orders", "o_orderkey", "CASE WHEN try_strptime('2000-' || raw, '%Y-%m-%d') IS NOT NULL THEN 'valid' ELSE 'invalid' END", "raw", "'invalid_datetime'"),
    "q_probe_time": _sql(f"SELECT o_orderkey, {_T2.format(26)} || ':' || {_T2.format(61)} || ':' || {_T2.format(62)} AS raw FROM orders", "o_orderkey", "CASE WHEN o_orderkey % 26 < 24 AND o_orderkey % 61 < 60 AND o_orderkey % 62 < 60 THEN 'valid' ELSE 'invalid' END", "raw", "'invalid_datetime'"),
    "q_probe_text": "SELECT p_partkey, CASE WHEN length(p_name) BETWEEN 8 AND 10 THEN 'valid' ELSE 'invalid' END AS status, CASE WHEN length(p_name) BETWEEN 8 AND 10 THEN p_name END AS normal, CASE WHEN length(p_name) < 8 THEN 'too_short' WHEN length(p_name) > 10 THEN 'too_long' END AS code FROM part",
    "q_view_names": "SELECT lower(c_mktsegment) || ' view' AS name, count(*) AS n FROM customer GROUP BY ALL",
    "q_terms": "SELECT DISTINCT item_id, term FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM benchmark) WHERE term NOT IN ('view','views','the','of','a','an','and','command','family','address')",
}
