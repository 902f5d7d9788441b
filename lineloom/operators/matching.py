"""Matching of two catalogs: exact, reordered, intersection, and prefix stages.

The first two are equi-joins on shape keys. Pairs for the third come from an index: formats meet if one of a
bounded cover of beginnings is a prefix of the other's, which is an equi-join on (length, beginning), and if each may
say the words that the other must. Only such pairs reach the language product, in an Arrow function; what has no
match goes on to the prefix stage by an anti-join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def structural_pairs(devices: DataFrame, documents: DataFrame, key: str) -> DataFrame:
    """Pairs of one shape whose values may fit each other: place by place where the order counts, else once they are aligned. A type that isn't known fits any."""
    x, y = devices.alias("x"), documents.alias("y")
    fits = F.forall(F.zip_with("x.types", "y.types", lambda a, b: a.isNull() | b.isNull() | (a == b)), lambda v: v)
    joined = x.join(y, F.col(f"x.{key}") == F.col(f"y.{key}"))
    if key == "ordered_key":
        joined = joined.filter(fits)
    return joined.select(F.col("x.format").alias("device"), F.col("y.format").alias("document"))


def prefix_candidates(devices: DataFrame, documents: DataFrame, column: str = "prefixes") -> DataFrame:
    """Pairs one of whose beginnings is a prefix of the other's. P stands for any one symbol, so beginnings are cut before it."""
    fixed = lambda p: F.slice(p, 1, F.coalesce(F.nullif(F.array_position(p, "P"), F.lit(0)) - 1, F.size(p)).cast("int"))
    cut = lambda d, name: d.select(F.col("format").alias(name), F.explode(F.array_distinct(F.transform(column, fixed))).alias("p"))
    every = lambda d: d.select("*", F.explode(F.sequence(F.lit(0), F.size("p"))).alias("n")).withColumn("part", F.array_join(F.slice("p", F.lit(1), F.col("n")), "\x1f"))
    x, y = cut(devices, "device"), cut(documents, "document")
    whole = lambda d: d.withColumn("n", F.size("p")).withColumn("part", F.array_join("p", "\x1f"))
    shorter = whole(x).drop("p").join(every(y).drop("p"), ["n", "part"])
    longer = every(x).drop("p").join(whole(y).drop("p"), ["n", "part"])
    return shorter.select("device", "document").unionByName(longer.select("device", "document")).distinct()


def symbol_filter(pairs: DataFrame, devices: DataFrame, documents: DataFrame) -> DataFrame:
    """Pairs each of whose sides may say what the other must."""
    x = devices.select(F.col("format").alias("device"), F.col("required").alias("xr"), F.col("possible").alias("xp"), F.col("any_value").alias("xv"))
    y = documents.select(F.col("format").alias("document"), F.col("required").alias("yr"), F.col("possible").alias("yp"), F.col("any_value").alias("yv"))
    left = F.size(F.array_except("xr", "yp")) == 0
    right = F.size(F.array_except("yr", "xp")) == 0
    return pairs.join(x, "device").join(y, "document").filter(left & right).select("device", "document")
