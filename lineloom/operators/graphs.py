"""Views as a graph: reachability, coverage of one view's formats by another's, and recovery of transitions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineloom.storage import written


def reachable(edges: DataFrame, start: DataFrame) -> DataFrame:
    """(node, depth) of the nodes that edges (src, dst) reach from start (node), by the shortest way."""
    found = written(start.select("node").distinct().withColumn("depth", F.lit(0)))
    front, depth = found, 0
    while not front.isEmpty():
        depth += 1
        new = front.join(edges, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct().join(found, "node", "left_anti")
        front = written(new.withColumn("depth", F.lit(depth)))
        found = found.unionByName(front)
    return found


def trimmed(edges: DataFrame, start: DataFrame, ends: DataFrame) -> DataFrame:
    """Edges on some way from start to an end."""
    onward = reachable(edges, start).select("node")
    back = reachable(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), ends).select("node")
    live = onward.join(back, "node", "left_semi")
    return edges.join(live.withColumnRenamed("node", "src"), "src", "left_semi").join(live.withColumnRenamed("node", "dst"), "dst", "left_semi").select("src", "dst")


def conflicts(targets: DataFrame, by: list[str], target: str) -> DataFrame:
    """Groups whose rows name more than one target."""
    return targets.groupBy(*by).agg(F.countDistinct(target).alias("n_targets")).filter("n_targets > 1")


def effects(evidence: DataFrame) -> DataFrame:
    """Of documented effects (view, format, kind, target): the one that a format has in a view, if they agree.

    Any unknown leaves it open; a switch to the own view counts as staying.
    """
    kind = F.when((F.col("kind") == "switch") & (F.col("target") == F.col("view")), "stay").otherwise(F.col("kind"))
    e = evidence.withColumn("effect", F.concat_ws(":", kind, F.when(kind == "switch", F.col("target"))))
    g = e.groupBy("view", "format").agg(F.count_if(F.col("kind") == "unknown").alias("open"), F.countDistinct("effect").alias("n"), F.min("effect").alias("effect"))
    return g.select("view", "format", F.when((F.col("open") == 0) & (F.col("n") == 1), F.col("effect")).alias("effect"))


def follow_declared(declared: DataFrame, entry: DataFrame) -> DataFrame:
    """Links (device view, documentation view) found by following declared transitions side by side.

    declared: (left, right, left_target, right_target). A left view that two right views claim is a conflict: both claims are
    blocked and the walk starts anew, until none conflicts. Growing the blocked set isn't monotone, so each restart is a full walk.
    """
    blocked = None
    while True:
        found = written(entry.select("left", "right").distinct())
        while True:
            step = found.join(declared, ["left", "right"]).select(F.col("left_target").alias("left"), F.col("right_target").alias("right")).distinct()
            if blocked is not None:
                step = step.join(blocked, "left", "left_anti")
            new = written(step.join(found, ["left", "right"], "left_anti"))
            if new.isEmpty():
                break
            found = written(found.unionByName(new))
        clash = conflicts(found, ["left"], "right").select("left")
        clash = clash.join(entry.select("left"), "left", "left_anti")
        if clash.isEmpty():
            return found
        blocked = written(clash if blocked is None else blocked.unionByName(clash).distinct())


def example_fixpoint(observed: DataFrame, entry: str) -> DataFrame:
    """Places (command, view) recovered from examples (parent, child; a null parent: at the entry), in synchronous passes.

    A child's source is the entry view or every view its parent leads to; the parent then leads to all views of the child.
    views: observed.views, the catalog's views of the child.
    """
    rows = observed.select("parent", "child", F.explode("views").alias("view"))
    known = written(rows.filter("parent is null").select(F.col("child").alias("command"), F.lit(entry).alias("view")).distinct())
    while True:
        step = rows.join(known.select(F.col("command").alias("parent")).distinct(), "parent").select(F.col("child").alias("command"), "view").distinct()
        new = written(step.join(known, ["command", "view"], "left_anti"))
        if new.isEmpty():
            return known
        known = written(known.unionByName(new))
