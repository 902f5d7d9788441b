"""Questions on views that names alone don't settle, the pages to answer them from, and the check of answers against these pages.

commands: (id, file, format, parent_views: array<string>, requested: the view said to be entered or null, uncertain: whether its
transition was left open). pages: as lineloom.operators.corpus has them. shared: views whose commands stand in all views.

A question is a row, and its candidate views, its pages and its answer's citations are tables by the question's id. What is joined are
equal keys: a view that many pages have gives a question the pages that it links or that name its command, and one page chosen
beforehand for the view, never all of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lineloom.operators.corpus import MOST_VIEWS, ranked_views, resolved_names

#: Words of descriptions that say that a command leaves a view, kinds of answers, fields that may be quoted, examples shown.
LEAVING = r"(?i)\b(?:quits?|returns?|exits?|leaves?)\b"
KINDS = ("alias", "group", "ambiguous", "missing", "unknown", "exit_parent", "exit_view")
FIELDS = ("FuncDef", "UsageGuidelines", "ParaDef", "ParentView", "Examples")
MOST_EXAMPLES = 3

_STRINGS = "array<string>"


def views_with_commands(commands: DataFrame, shared: tuple[str, ...] = ()) -> DataFrame:
    """(view) of the views that have commands, without the shared ones."""
    return commands.select(F.explode("parent_views").alias("view")).filter(F.col("view").isNotNull() & ~F.col("view").isin(*shared)).distinct()


def leaves(text: Column) -> Column:
    return F.rlike(F.coalesce(text, F.lit("")), F.lit(LEAVING))


def questions(commands: DataFrame, pages: DataFrame, shared: tuple[str, ...] = ()) -> DataFrame:
    """(id, file, requested, commands: array of ids, format, exits) of each page and view said to be entered that has to be asked.

    Asked are targets that aren't one view's name, all targets of pages that speak of leaving, and commands without a target whose transition
    is open. id is the least command's, and format is its format.
    """
    open_ = commands.filter("requested is not null or uncertain").join(pages.select("file", leaves(F.col("FuncDef")).alias("exits")), "file")
    named = resolved_names(open_.filter("requested is not null").select(F.col("requested").alias("asked")), views_with_commands(commands, shared))
    known = named.filter("status = 'resolved'").select(F.col("asked").alias("requested"), F.lit(True).alias("one"))
    asked = open_.join(known, "requested", "left").filter("exits or one is null")
    g = asked.groupBy("file", "requested", "exits").agg(F.min(F.struct("id", "format")).alias("first"), F.array_sort(F.collect_set("id")).alias("commands"))
    return g.select(F.col("first.id").alias("id"), "file", "requested", "commands", F.col("first.format").alias("format"), "exits")


def links(pages: DataFrame) -> DataFrame:
    """(file, other): pages one of which names the other's file, both ways."""
    to = pages.select("file", F.explode("related_topics").alias("t")).select("file", F.explode("t.target_files").alias("other"))
    to = to.join(pages.select(F.col("file").alias("other")), "other", "left_semi")
    return to.select("file", "other").unionByName(to.select(F.col("other").alias("file"), F.col("file").alias("other"))).distinct()


def candidates(asked: DataFrame, commands: DataFrame, pages: DataFrame, shared: tuple[str, ...] = (), most: int = MOST_VIEWS) -> DataFrame:
    """(id, view, rank): views of pages to look at for each question. Questions of commands that leave a view have none."""
    inner = asked.filter("not exits")
    views = pages.select(F.explode("ParentView").alias("view")).filter(F.col("view").isNotNull() & ~F.col("view").isin(*shared)).distinct()
    own = views_with_commands(commands, shared).withColumn("own", F.lit(True))
    text = inner.join(pages.select("file", "FuncDef"), "file").select("id", F.coalesce("requested", "FuncDef", F.lit("")).alias("text"))
    near = inner.select("id", "file").join(links(pages), "file").join(pages.select(F.col("file").alias("other"), F.explode("ParentView").alias("view")), "other")
    linked = near.groupBy("id").agg(F.collect_set("view").alias("linked"))
    focus = text.join(linked, "id", "left").withColumn("linked", F.coalesce("linked", F.array().cast(_STRINGS)))
    return ranked_views(focus, views.join(own, "view", "left").withColumn("own", F.coalesce("own", F.lit(False))), most)


def command_name(format_: Column) -> Column:
    """The words that a format begins with, else all up to its first white space; in lower case, one space between them."""
    words = F.regexp_extract(format_, r"^[\w-]+(?:\s+[\w-]+)*", 0)
    return F.lower(F.regexp_replace(F.when(words != "", words).otherwise(F.regexp_extract(format_, r"^\s*(\S+)", 1)), r"\s+", " "))


def mentions(pages: DataFrame, names: DataFrame) -> DataFrame:
    """(file, name): pages whose guidelines say "<name> command", of the names (name) asked for; words go with their hyphens."""
    longest = names.agg(F.coalesce(F.max(F.size(F.split("name", " "))), F.lit(0))).first()[0]
    run = pages.select("file", F.explode(F.regexp_extract_all(F.lower(F.coalesce("UsageGuidelines", F.lit(""))), F.lit(r"[\w-]+(?:\s+[\w-]+)+"), F.lit(0))).alias("run"))
    word = run.select("file", F.split("run", r"\s+").alias("words")).select("file", "words", F.posexplode("words").alias("at", "word"))
    said = word.filter(F.rlike("word", F.lit(r"^command\b")) & (F.col("at") > 0)).select("file", "words", "at", F.explode(F.sequence(F.lit(1), F.least(F.col("at"), F.lit(max(longest, 1))))).alias("n"))
    name = F.array_join(F.slice("words", F.col("at") - F.col("n") + 1, F.col("n")), " ")
    return said.select("file", name.alias("name")).distinct().join(names.select("name").distinct(), "name", "left_semi").select("file", "name")


def supporting(asked: DataFrame, ranked: DataFrame, pages: DataFrame) -> DataFrame:
    """(id, file): the pages of each question: its own, and of each candidate view (id, view, rank) the first page, with the second if it is linked.

    First come linked pages, those that name the question's command, those of one view, those with short guidelines.
    """
    of = pages.select("file", F.explode("ParentView").alias("view")).filter("view is not null").distinct()
    size = pages.select("file", (F.size("ParentView") != 1).alias("several"), F.length(F.coalesce("UsageGuidelines", F.lit(""))).alias("n"))
    of = of.join(size, "file")
    named = asked.withColumn("name", command_name(F.col("format")))
    linked = named.select("id", "file").join(links(pages), "file").select("id", F.col("other").alias("file"))
    naming = named.select("id", "name").join(mentions(pages, named), "name").select("id", "file")
    best = of.groupBy("view").agg(F.min(F.struct("several", "n", "file")).alias("best")).select("view", "best.*").withColumns({"far": F.lit(True), "silent": F.lit(True)})
    near = linked.withColumns({"far": F.lit(False), "silent": F.lit(True)}).unionByName(naming.withColumns({"far": F.lit(True), "silent": F.lit(False)}))
    near = near.groupBy("id", "file").agg(F.min("far").alias("far"), F.min("silent").alias("silent")).join(of, "file").join(ranked.select("id", "view"), ["id", "view"], "left_semi")
    every = near.unionByName(ranked.select("id", "view").join(best, "view"), allowMissingColumns=True)
    every = every.groupBy("id", "view", "file", "several", "n").agg(F.min("far").alias("far"), F.min("silent").alias("silent"))
    at = Window.partitionBy("id", "view").orderBy("far", "silent", "several", "n", "file")
    taken = every.withColumn("place", F.row_number().over(at)).filter("place <= 2 and (place = 1 or not far)")
    return asked.select("id", "file").unionByName(taken.select("id", "file")).distinct()


def requests(asked: DataFrame, ranked: DataFrame, chosen: DataFrame, pages: DataFrame) -> DataFrame:
    """(id, request): each question as JSON: its commands, candidate views in order and pages; what there is of views with commands is the same for all, and a table of its own."""
    page = pages.select("file", F.struct("file", "PageTitle", "ParentView", "FuncDef", "UsageGuidelines", "ParaDef", F.slice("Examples", 1, MOST_EXAMPLES).alias("Examples"), F.size("Examples").alias("examples_total")).alias("page"))
    views = ranked.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("rank", "view"))).alias("v")).select("id", F.transform("v", lambda v: v["view"]).alias("candidate_views"))
    texts = chosen.join(page, "file").groupBy("id").agg(F.array_sort(F.collect_list("page")).alias("pages"))
    out = asked.join(views, "id", "left").join(texts, "id", "left")
    return out.select("id", F.to_json(F.struct(F.col("requested").alias("requested_target"), "commands", "format", F.coalesce("candidate_views", F.array().cast(_STRINGS)).alias("candidate_views"), "pages")).alias("request"))


def _strings(field: Column) -> Column:
    """The texts of a page's field that a citation names."""
    none = lambda t: F.array().cast(t)
    para = F.coalesce("ParaDef", none("array<struct<Parameters:string,Info:string>>"))
    said = F.when(field == "FuncDef", F.array("FuncDef")).when(field == "UsageGuidelines", F.array("UsageGuidelines")).when(field == "ParentView", F.col("ParentView"))
    said = said.when(field == "ParaDef", F.concat(F.transform(para, lambda p: p["Parameters"]), F.transform(para, lambda p: p["Info"])))
    return said.when(field == "Examples", F.flatten(F.slice(F.coalesce("Examples", none("array<array<string>>")), 1, MOST_EXAMPLES)))


def answer_problems(answers: DataFrame, asked: DataFrame, ranked: DataFrame, chosen: DataFrame, present: DataFrame, pages: DataFrame) -> DataFrame:
    """(id, problem) of answers that can't be taken. answers: (id, kind, target, members: array<string>, evidence: array<struct<file,field,quote>>); present: (view).

    Quotations stand in one text of the field of a page that the question shows, those of parent views whole. What prose covers are
    the views of quoted pages and candidates that a quotation names. Nulls of members and evidence are empty; answers to no question are a problem.
    """
    none = lambda t: F.array().cast(t)
    a = answers.withColumns({"members": F.coalesce("members", none(_STRINGS)), "evidence": F.coalesce("evidence", none("array<struct<file:string,field:string,quote:string>>"))})
    cited = a.select("id", F.explode("evidence").alias("e")).select("id", F.col("e.file").alias("file"), F.col("e.field").alias("field"), F.col("e.quote").alias("quote"))
    shown = cited.join(chosen.select("id", "file", F.lit(True).alias("shown")).distinct(), ["id", "file"], "left").join(pages.select("file", *FIELDS), "file", "left")
    stands = F.col("shown").isNotNull() & (F.length("quote") > 0) & F.exists(_strings(F.col("field")), lambda s: F.contains(s, F.col("quote")))
    prose = F.col("field") != "ParentView"
    seen = shown.withColumn("stands", F.coalesce(stands, F.lit(False)))
    whole = prose | F.array_contains("ParentView", F.col("quote"))
    of = lambda c: F.flatten(F.collect_set(c))
    proof = seen.groupBy("id").agg(
        F.max(~F.col("stands")).alias("unfounded"),
        F.max(F.col("stands") & ~whole).alias("fragment"),
        F.collect_set(F.when(~prose, F.col("quote"))).alias("scopes"),
        F.collect_set(F.when(prose, F.lower("quote"))).alias("quotes"),
        of(F.when(prose, F.col("ParentView"))).alias("around"),
    )
    said = a.select("id", F.explode(F.array_union(F.col("members"), F.array_compact(F.array("target")))).alias("view"))
    known = ranked.select("id", "view").unionByName(said.join(present.select("view").distinct(), "view", "left_semi").select("id", "view")).distinct()
    known = said.join(known, ["id", "view"], "left_semi").groupBy("id").agg(F.collect_set("view").alias("known"))
    j = a.join(asked.select("id", "requested", F.lit(True).alias("there")), "id", "left").join(proof, "id", "left").join(known, "id", "left")
    j = j.withColumns({c: F.coalesce(c, none(_STRINGS)) for c in ("scopes", "quotes", "around", "known")} | {c: F.coalesce(c, F.lit(False)) for c in ("unfounded", "fragment", "there")})
    covered = lambda v: F.array_contains("around", v) | (F.array_contains("known", v) & F.exists("quotes", lambda q: F.contains(q, F.lower(v))))
    kind, target, members = F.col("kind"), F.col("target"), F.col("members")
    some, empty = F.size(members) > 0, F.coalesce(F.length(target), F.lit(0)) == 0
    fixed = kind.isin("alias", "exit_view")
    rules: list[tuple[str, Column]] = [
        ("an answer to no question", ~F.col("there")),
        ("a kind that isn't one", kind.isNull() | ~kind.isin(*KINDS)),
        ("a quotation that isn't in a page shown", F.col("unfounded")),
        ("a part of a parent view's name", F.col("fragment")),
        ("members twice", F.size(F.array_distinct(members)) < F.size(members)),
        ("members that are no candidates", F.size(F.array_except(members, "known")) > 0),
        ("a relation without prose", kind.isin("alias", "group", "exit_parent", "exit_view") & (F.size("quotes") == 0)),
        ("a fixed transition takes one target and no members", fixed & (empty | some)),
        ("the evidence doesn't name the target", fixed & ~empty & ~(covered(target) | F.array_contains("scopes", target))),
        ("a group takes a target that isn't a member, and members", (kind == "group") & (empty | ~some | F.array_contains(members, target))),
        ("a group goes by another name than asked for", (kind == "group") & ~target.eqNullSafe(F.col("requested"))),
        ("a member without prose", (kind == "group") & F.exists(members, lambda v: ~covered(v))),
        ("leaving for the parent has no target and no members", (kind == "exit_parent") & (target.isNotNull() | some)),
        ("members without a relation", kind.isin("unknown", "missing") & some),
        ("a missing view without a name", (kind == "missing") & empty),
    ]
    return j.select("id", F.explode(F.array_compact(F.array(*(F.when(c, F.lit(p)) for p, c in rules)))).alias("problem"))


def taken_answers(answers: DataFrame, problems: DataFrame) -> DataFrame:
    """The answers without a problem: what corpus.answered() goes on with."""
    return answers.join(problems.select("id").distinct(), "id", "left_anti")
