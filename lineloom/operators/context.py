"""Contexts: which line a line stands under, and where commands lead."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lineloom.parser import nested


def parents(rows: DataFrame) -> DataFrame:
    """Adds parent_line to rows (config_id, line_no, indent, command): the line each stands under.

    A configuration is bound by its file and is one group here. Where the texts themselves are at hand, configuration_lines()
    finds the same without a shuffle.
    """

    def stack(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("line_no")
        numbers = g.line_no.tolist()
        found = [None if p is None else numbers[p] for p, _ in nested(zip(g.indent, g.command.fillna(""), strict=True))]
        return g.assign(parent_line=pd.array(found, dtype="Int64"))[["config_id", "line_no", "parent_line"]]

    kind = dict(rows.dtypes)["config_id"]
    found = rows.select("config_id", F.col("line_no").cast("long").alias("line_no"), F.col("indent").cast("long").alias("indent"), "command").groupBy("config_id").applyInPandas(stack, f"config_id {kind}, line_no long, parent_line long")
    return rows.join(found, ["config_id", "line_no"])


def child_context(targets: DataFrame, by: list[str], target: str = "child") -> DataFrame:
    """Of all readings of a line: the one view they lead to, or the issue. A null target is one that isn't known."""
    g = targets.groupBy(*by).agg(F.count_if(F.col(target).isNull()).alias("open"), F.countDistinct(target).alias("kinds"), F.min(target).alias("child"))
    issue = F.when(F.col("open") > 0, "unresolved_transition").when(F.col("kinds") > 1, "ambiguous_transition")
    return g.select(*by, F.when(issue.isNull(), F.col("child")).alias("child"), issue.alias("issue"))


def prompt_transitions(rows: DataFrame, by: list[str], order: str, prompt: str = "prompt") -> DataFrame:
    """Places at which the prompt of a session changes: from, to, and the order's value."""
    w = Window.partitionBy(*by).orderBy(order)
    after = rows.withColumn("to_prompt", F.lead(prompt).over(w))
    return after.filter((F.col("to_prompt").isNotNull()) & (F.col("to_prompt") != F.col(prompt))).select(*by, order, F.col(prompt).alias("from_prompt"), "to_prompt")
