"""Views of a documentation's catalog restored from what its pages say and from the prompts of their examples.

commands: (id, file, format_index, format, view: the parent view as its page writes it, target: the view entered, as normal_name() has
it, or null). pages: as lineloom.operators.corpus has them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lineloom.functions.pages import prompt
from lineloom.functions.text import normal_name
from lineloom.operators.corpus import hierarchy_report, matched_texts
from lineloom.operators.graphs import conflicts
from lineloom.operators.reading import analysed
from lineloom.storage import written

#: What opens the entry view, and first words of commands that open none.
OPENING = "system-view"
BACKWARD = ("undo", "quit", "return")
MOST_TOLD = 20


def any_value(format_: Column) -> Column:
    """A format whose named values take any word."""
    return F.regexp_replace(format_, r"(?<!&)<[^<>]+>", "STRING<1-65535>")


def source_problems(commands: DataFrame, pages: DataFrame) -> DataFrame:
    """(id, problem) of commands that their page doesn't have so: its format at the place, and its view among the parents."""
    p = pages.select("file", "CLIs", F.transform("ParentView", normal_name).alias("parents"), F.lit(True).alias("there"))
    j = commands.join(p, "file", "left")
    told = F.when(F.col("there").isNull(), "no page").when(~F.get("CLIs", F.col("format_index")).eqNullSafe(F.col("format")), "another format").when(~F.coalesce(F.array_contains("parents", normal_name("view")), F.lit(False)), "another parent view")
    return j.select("id", told.alias("problem")).filter("problem is not null")


def _sessions(pages: DataFrame) -> DataFrame:
    """(file, example, target, said: array of (prompt, text), lines) of examples with two prompts or more, of pages with one parent view."""
    one = pages.filter(F.size("ParentView") == 1).select("file", normal_name(F.get("ParentView", F.lit(0))).alias("target"), F.posexplode("Examples").alias("example", "lines"))

    def line(x: Column) -> Column:
        p, text = prompt(x)
        return F.struct(p.alias("prompt"), text.alias("text"))

    said = F.filter(F.transform("lines", line), lambda x: x["prompt"].isNotNull())
    return one.withColumn("said", said).filter(F.size("said") > 1)


def _walk(entry: str, kind: str) -> Column:
    """The ids of commands after which a session's prompts are its last one for good, read in views that are known by then."""
    said, views = F.col("said"), "array<string>"
    final = F.element_at(said, -1)["prompt"]
    # the last line that doesn't stand at the final prompt: what changes later isn't final
    other = F.array_max(F.filter(F.sequence(F.lit(0), F.size(said) - 1), lambda i: F.get(said, i)["prompt"] != final))

    def step(acc: Column, i: Column) -> Column:
        s, after = F.get(said, i), F.get(said, i + 1)["prompt"]
        first = F.get(F.split(s["text"], r"\s+"), F.lit(0))
        opens = (s["text"] == OPENING) & F.startswith(s["prompt"], F.lit("<"))
        here = F.coalesce(F.element_at(acc["known"], s["prompt"]), F.array().cast(views))
        mine = F.filter(F.coalesce(F.element_at("readings", i), F.array().cast(f"array<struct<id:{kind},view:string,target:string>>")), lambda c: F.array_contains(here, c["view"]))
        moves = (s["prompt"] != after) & ~first.isin(*BACKWARD)
        to = F.array_distinct(F.filter(F.transform(mine, lambda c: c["target"]), lambda t: t.isNotNull()))
        put = lambda v: F.map_concat(F.map_filter(acc["known"], lambda k, _: k != after), F.create_map(after, v))
        known = F.when(opens, put(F.array(F.lit(entry)))).when(moves & (F.size(to) > 0), put(to)).otherwise(acc["known"])
        found = F.when(~opens & moves & (i >= F.coalesce(other, F.lit(-1))), F.array_union(acc["found"], F.transform(mine, lambda c: c["id"]))).otherwise(acc["found"])
        return F.struct(known.alias("known"), found.alias("found"))

    start = F.struct(F.create_map().cast(f"map<string,{views}>").alias("known"), F.array().cast(f"array<{kind}>").alias("found"))
    return F.aggregate(F.sequence(F.lit(0), F.size(said) - 2), start, step)["found"]


def example_switches(commands: DataFrame, pages: DataFrame, entry: str) -> DataFrame:
    """(id, target, file, example, text) of commands after which an example's prompt changes to its last one; the first example of each target.

    The example's page has one parent view, the target, and the example's last command is one of the page's own. Which views a prompt may
    stand for follows from the commands before: the entry view's prompt is known, and a command counts where its view is. Pages with a
    format that can't be read are left out; a command's format that can't be read is an error.
    """
    sessions = _sessions(pages).join(pages.select("file", F.explode("CLIs").alias("format")), "file", "left_semi")
    each = pages.select("file", F.explode("CLIs").alias("format")).withColumn("format", any_value(F.col("format"))).distinct()
    odd = each.join(written(analysed(each).select("format")), "format", "left_anti").select("file").distinct()
    sessions, each = written(sessions.join(odd, "file", "left_anti")), each.join(odd, "file", "left_anti")
    own = commands.select("id", any_value(F.col("format")).alias("format"), normal_name("view").alias("view"), "target")
    told = sessions.select("file", "example", F.posexplode("said").alias("at", "s")).select("file", "example", "at", F.col("s.text").alias("text"))
    formats = each.select("format").unionByName(own.select("format")).distinct().withColumn("types", F.lit("[]"))
    readings = written(matched_texts(told.select("text"), formats))
    last = sessions.select("file", "example", F.element_at("said", -1)["text"].alias("text")).join(readings, "text").join(each, ["file", "format"], "left_semi").select("file", "example").distinct()
    met = told.join(readings, "text").join(own, "format").groupBy("file", "example", "at").agg(F.collect_set(F.struct("id", "view", "target")).alias("c"))
    met = met.groupBy("file", "example").agg(F.map_from_entries(F.collect_list(F.struct("at", "c"))).alias("readings"))
    seen = sessions.join(last, ["file", "example"], "left_semi").join(met, ["file", "example"])
    found = seen.select(F.explode(_walk(" ".join(entry.split()).lower(), dict(commands.dtypes)["id"])).alias("id"), "target", "file", "example", F.array_join("lines", "\n").alias("text"))
    return found.groupBy("id", "target").agg(F.min(F.struct("file", "example", "text")).alias("x")).select("id", "target", "x.*")


def restored(commands: DataFrame, observed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The commands (id, format, view, target, source) with their restored views; and documented views whose commands lead to several (parent, n_targets).

    A command without a target gets the one that examples show, if they show one alone. A view that a command with a target is seen
    to lead to goes by that target's name.
    """
    one = observed.groupBy("id").agg(F.min("target").alias("seen"), F.count_distinct("target").alias("n")).filter("n = 1").select("id", "seen")
    c = commands.select("id", "format", normal_name("view").alias("parent"), "target").join(one, "id", "left")
    c = c.withColumn("source", F.when(F.col("target").isNotNull(), "stated").when(F.col("seen").isNotNull(), "example")).withColumn("target", F.coalesce("target", "seen"))
    led = observed.select("id", F.col("target").alias("parent")).join(c.filter("target is not null").select("id", "target"), "id").select("parent", "target").distinct()
    alias = led.groupBy("parent").agg(F.min("target").alias("alias"))
    out = c.join(alias, "parent", "left").select("id", "format", F.coalesce("alias", "parent").alias("view"), "target", "source")
    return out, conflicts(led, ["parent"], "target")


def hierarchy_problems(views: DataFrame, entry: str) -> DataFrame:
    """(view, problem) of a hierarchy (view, target): an entry view without commands, reachable targets without any, views that nothing leads to."""
    entry_ = views.sparkSession.createDataFrame([(entry,)], "view string").join(views.select("view"), "view", "left_anti").withColumn("problem", F.lit("no entry view"))
    edges = views.filter("target is not null").select(F.col("view").alias("src"), F.col("target").alias("dst")).distinct()
    at = hierarchy_report(edges, views.select("view").distinct(), entry)
    told = F.when(F.col("reachable") & ~F.col("has_commands"), "a target without commands").when(F.col("has_commands") & ~F.col("reachable"), "nothing leads to it")
    return entry_.unionByName(at.select("view", told.alias("problem")).filter("problem is not null"))


def restore(commands: DataFrame, pages: DataFrame, entry: str) -> DataFrame:
    """The commands with restored views and targets. Raises ValueError where pages, destinations or the hierarchy contradict, naming the first."""
    entry_ = " ".join(entry.split()).lower()

    def none(rows: DataFrame, what: str) -> None:
        if first := rows.limit(MOST_TOLD).collect():
            raise ValueError(f"{what}: {[tuple(r) for r in first]}")

    none(source_problems(commands, pages), "commands that pages don't have so")
    out, several = restored(commands, written(example_switches(commands, pages, entry)))
    out = written(out)
    none(several, "views that lead to several")
    none(hierarchy_problems(out, entry_), "views of a broken hierarchy")
    return out
