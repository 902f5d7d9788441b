"""Reports of experiments: what configurations gave against a catalog, and what two catalogs gave against each other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lineloom.operators.mapping import Mapped


def parsing_report(parsed: DataFrame, expected: DataFrame | None = None, entry: str | None = None) -> DataFrame:
    """A row of counts per configuration: config_id, recognized, errors, unresolved, ambiguous, known_context, context_issues (code, n), parameters_without_slots, unexpected_views.

    parsed: rows of configurations.parse_configurations(). expected: (config_id, line_no, view) of lines whose view is known, null where they
    have none; unexpected_views are the lines that got another (line, expected, actual). entry: that of a search by parts, where any other
    view is none.
    """
    command = F.col("kind").isin("command", "unresolved_command")
    code = F.when(command, F.col("context_issue.code"))
    bare = F.aggregate("matches", F.lit(0), lambda n, m: n + F.size(F.filter(m["parameters"], lambda p: F.coalesce(F.length(p["slot_id"]), F.lit(0)) == 0)))
    counts = parsed.groupBy("config_id").agg(
        F.count_if(command).alias("recognized"),
        F.count_if(F.col("kind") == "error").alias("errors"),
        F.count_if(F.col("kind") == "unresolved_command").alias("unresolved"),
        F.count_if(command & (F.col("status") == "ambiguous")).alias("ambiguous"),
        F.count_if(command & F.col("view").isNotNull()).alias("known_context"),
        F.coalesce(F.sum(F.when(command, bare)), F.lit(0)).alias("parameters_without_slots"),
    )
    issues = parsed.select("config_id", code.alias("code")).filter("code is not null").groupBy("config_id", "code").agg(F.count(F.lit(1)).alias("n")).groupBy("config_id").agg(F.array_sort(F.collect_list(F.struct("code", "n"))).alias("context_issues"))
    out = counts.join(issues, "config_id", "left")
    none: Column = F.array().cast("array<struct<line:int,expected:string,actual:string>>")
    if expected is None:
        other = none
    else:
        want = F.col("view") if entry is None else F.when(F.col("view") == entry, F.col("view"))
        e = expected.select("config_id", "line_no", want.alias("expected"))
        wrong = parsed.select("config_id", "line_no", F.col("view").alias("actual")).join(e, ["config_id", "line_no"]).filter(~F.col("expected").eqNullSafe(F.col("actual")))
        wrong = wrong.groupBy("config_id").agg(F.array_sort(F.collect_list(F.struct(F.col("line_no").cast("int").alias("line"), "expected", "actual"))).alias("unexpected"))
        out, other = out.join(wrong, "config_id", "left"), F.coalesce("unexpected", none)
    return out.select(*counts.columns, F.coalesce("context_issues", F.array().cast("array<struct<code:string,n:bigint>>")).alias("context_issues"), other.alias("unexpected_views"))


def matching_report(m: Mapped, left_out: int = 0, unresolved: int = 0) -> DataFrame:
    """(what, value, n): device_occurrences, and by value device_statuses, pair_stages, pair_relations; bindings; and the counts given: documents left out as invalid, transitions left open."""
    n = F.count(F.lit(1)).cast("long").alias("n")
    by = lambda rows, c, what: rows.groupBy(F.col(c).alias("value")).agg(n).select(F.lit(what).alias("what"), "value", "n")
    whole = lambda rows, count, what: rows.agg(F.coalesce(count, F.lit(0)).cast("long").alias("n")).select(F.lit(what).alias("what"), F.lit(None).cast("string").alias("value"), "n")
    given = m.devices.sparkSession.createDataFrame([("invalid_documentation_occurrences", None, left_out), ("unresolved_transitions", None, unresolved)], "what string, value string, n long")
    parts = [whole(m.devices, F.count(F.lit(1)), "device_occurrences"), by(m.devices, "status", "device_statuses"), by(m.pairs, "stage", "pair_stages"), by(m.pairs, "status", "pair_relations"), whole(m.pairs, F.sum(F.size("bindings")), "bindings")]
    for p in parts:
        given = given.unionByName(p)
    return given
