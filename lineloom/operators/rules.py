"""Documented rules over captured values: predicate trees as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COMPARE = {"eq": lambda a, b: a == b, "ne": lambda a, b: a != b, "lt": lambda a, b: a < b, "le": lambda a, b: a <= b, "gt": lambda a, b: a > b, "ge": lambda a, b: a >= b}


class PredicateError(ValueError):
    """A predicate that isn't well formed."""


def predicate(tree, captures: str = "captures") -> Column:
    """A predicate over captures: array<struct<name, number, text>>.

    Comparisons hold if any capture of the name satisfies them; without one they don't. all of nothing holds, any of nothing doesn't.
    """
    if tree == "always" or tree is True:
        return F.lit(True)
    if tree is False:
        return F.lit(False)
    if not isinstance(tree, dict) or "op" not in tree:
        raise PredicateError(f"not a predicate: {tree!r}")
    op = tree["op"]
    if op == "not":
        return ~predicate(tree["arg"], captures)
    if op in ("all", "any"):
        out = F.lit(op == "all")
        for x in tree["args"]:
            out = out & predicate(x, captures) if op == "all" else out | predicate(x, captures)
        return out
    name = tree.get("parameter")
    if not isinstance(name, str):
        raise PredicateError(f"{op} needs a parameter")
    if op == "exists":
        return F.coalesce(F.exists(captures, lambda c: c["name"] == name), F.lit(False))
    if op not in COMPARE:
        raise PredicateError(f"no such operation: {op}")
    value = tree.get("value")
    if isinstance(value, bool) or not isinstance(value, (int, float, str)):
        raise PredicateError(f"{op} needs a number or a text")
    if isinstance(value, str) and op not in ("eq", "ne"):
        raise PredicateError(f"{op} needs a number")
    of = "text" if isinstance(value, str) else "number"
    return F.coalesce(F.exists(captures, lambda c: (c["name"] == name) & F.coalesce(COMPARE[op](c[of], F.lit(value)), F.lit(False))), F.lit(False))


def apply_rules(rows: DataFrame, rules: list[dict], captures: str = "captures") -> DataFrame:
    """Adds effects: of each rule (when, entity, and parameter if it makes one effect a value), what it gives for the row."""
    none = F.array().cast("array<string>")

    def values(name: str, entity: str) -> Column:
        return F.transform(F.filter(captures, lambda c: c["name"] == name), lambda c: F.concat(F.lit(f"{entity}:"), c["text"]))

    parts = []
    for r in rules:
        found = values(r["parameter"], r["entity"]) if r.get("parameter") else F.array(F.lit(r["entity"]))
        parts.append(F.when(predicate(r.get("when", "always"), captures), found).otherwise(none))
    return rows.withColumn("effects", F.array_distinct(F.concat(*parts)) if parts else F.array().cast("array<string>"))


def agreement(readings: DataFrame, by: list[str]) -> DataFrame:
    """applied, inactive or ambiguous: whether all readings of a line have the same effects."""
    sorted_ = readings.withColumn("key", F.array_join(F.array_sort("effects"), "\x1f"))
    g = sorted_.groupBy(*by).agg(F.countDistinct("key").alias("n"), F.max(F.size("effects")).alias("most"))
    return g.select(*by, F.when(F.col("n") > 1, "ambiguous").when(F.col("most") > 0, "applied").otherwise("inactive").alias("status"))
