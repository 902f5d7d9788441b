"""From pages of documentation to catalogs: formats, types, transitions, and the checks of annotations.

pages: (file, PageTitle, CLIs, ParentView, FuncDef, ParaDef, UsageGuidelines, Examples, related_topics, and section), as
sources.catalogs.corpus_pages() reads them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lineloom.functions.pages import NAVIGATION, adjacent, names_of, parameter_description, placeholder, stated_type, switch_evidence
from lineloom.functions.text import normal_name, terms
from lineloom.grammar.sessions import read_example
from lineloom.operators.graphs import reachable
from lineloom.storage import written
from lineloom.parser import LineParser

#: Commands that only show things, titles that come first in a sample, and sizes of a retrieval.
SHOWING = "display"
ANCHORS = ("acl number", "acl ipv6", "bgp", "interface", "ipv4-family", "ipv6-family", "rule", "peer", "port trunk allow-pass vlan")
MOST_VIEWS = 12


def page_formats(pages: DataFrame, showing: bool = False) -> DataFrame:
    """(file, format_index, format, names) of each format; those that only show things are left out, and places stay as they were."""
    each = pages.select("file", F.posexplode("CLIs").alias("format_index", "format"))
    kept = each if showing else each.filter(F.lower(F.regexp_extract("format", r"^\s*(\S+)", 1)) != SHOWING)
    return kept.withColumn("names", names_of(F.col("format")))


def described(pages: DataFrame) -> DataFrame:
    """(file, format_index, format, at, name, description) of each named value."""
    each = page_formats(pages).select("file", "format_index", "format", F.posexplode("names").alias("at", "name"))
    return each.join(pages.select("file", "ParaDef"), "file").select("file", "format_index", "format", "at", "name", parameter_description(F.col("ParaDef"), F.col("name")).alias("description"))


def mock_formats(pages: DataFrame) -> DataFrame:
    """(file, format_index, format, converted, unknown): formats with declared types in place of names, as far as descriptions tell them."""
    typed = described(pages).withColumn("to", placeholder(F.col("description")))
    g = typed.groupBy("file", "format_index").agg(F.array_sort(F.collect_list(F.struct("at", "name", "to"))).alias("values"))
    out = page_formats(pages).join(g, ["file", "format_index"], "left").withColumn("values", F.coalesce("values", F.array().cast("array<struct<at:int,name:string,to:string>>")))
    put = lambda acc, v: F.when(v["to"].isNull(), acc).otherwise(F.replace(acc, F.concat(F.lit("<"), v["name"], F.lit(">")), v["to"]))
    missing = F.array_sort(F.transform(F.filter("values", lambda v: v["to"].isNull()), lambda v: v["name"]))
    return out.select("file", "format_index", "format", F.aggregate("values", F.col("format"), put).alias("converted"), missing.alias("unknown"))


def completed_types(pages: DataFrame, annotations: DataFrame) -> DataFrame:
    """(file, format_index, name, before, type, changed) of every named value; annotations: (file, format_index, name, type)."""
    known = annotations.select("file", "format_index", "name", F.col("type").alias("before"))
    out = described(pages).join(known, ["file", "format_index", "name"], "left").withColumn("type", stated_type(F.col("description"), F.col("before")))
    return out.select("file", "format_index", "name", "before", "type", (~F.col("type").eqNullSafe(F.col("before"))).alias("changed"))


def stray_types(pages: DataFrame, annotations: DataFrame) -> DataFrame:
    """Annotations of names that their format hasn't."""
    return annotations.join(described(pages).select("file", "format_index", "name"), ["file", "format_index", "name"], "left_anti")


def stated_switches(pages: DataFrame) -> DataFrame:
    """(file, format_index, view, text) of formats whose page plainly says which view they enter."""
    each = page_formats(pages).join(pages.select("file", "FuncDef"), "file").withColumn("e", switch_evidence("format", F.coalesce("FuncDef", F.lit(""))))
    return each.filter("e.view is not null").select("file", "format_index", normal_name("e.view").alias("view"), F.col("e.text").alias("text"))


def related(pages: DataFrame) -> DataFrame:
    """(file, other): pages that a page names, by file or by section, and itself; each once."""
    topic = pages.select("file", F.explode_outer("related_topics").alias("t"))
    by_file = topic.select("file", F.explode("t.target_files").alias("other")).join(pages.select(F.col("file").alias("other")), "other", "left_semi")
    own = pages.select("file", F.col("file").alias("other"))
    out = own.unionByName(by_file)
    if "section" in pages.columns:
        section = topic.select("file", F.explode("t.target_sections").alias("section")).join(pages.filter("section is not null").select("section", F.col("file").alias("other")), "section")
        out = out.unionByName(section.select("file", "other"))
    return out.distinct()


def pilot(pages: DataFrame, n: int, anchors: tuple[str, ...] = ANCHORS) -> DataFrame:
    """(file, place): two pages of each anchor's title first, then those whose file's hash is least, n in all."""
    titles = pages.select("file", "PageTitle").join(F.broadcast(pages.sparkSession.createDataFrame(list(enumerate(anchors)), "anchor int, title string")), (F.col("PageTitle") == F.col("title")) | F.startswith(F.col("PageTitle"), F.concat(F.col("title"), F.lit(" ("))))
    first = titles.withColumn("k", F.row_number().over(Window.partitionBy("anchor").orderBy("file"))).filter("k <= 2").groupBy("file").agg(F.min(F.struct("anchor", "k")).alias("lead"))
    all_ = pages.select("file").join(first, "file", "left").orderBy(F.col("lead").isNull(), "lead", F.sha2("file", 256), "file").limit(n)
    return all_.select("file", F.col("lead").isNotNull().alias("anchor"))


def example_commands(pages: DataFrame, host: str = "") -> tuple[DataFrame, DataFrame]:
    """Commands (file, example, line, text, within: array of texts, rooted) and problems (file, example, line, reason, prompt) of all examples.

    An example whose prompts contradict its commands gives problems alone.
    """
    schema = "file string, example int, line int, text string, within array<string>, rooted boolean, reason string"
    arrow = pa.schema([("file", pa.string()), ("example", pa.int32()), ("line", pa.int32()), ("text", pa.string()), ("within", pa.list_(pa.string())), ("rooted", pa.bool_()), ("reason", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for file, n, lines in zip(*(c.to_pylist() for c in b.columns), strict=True):
                said, problems = read_example([x or "" for x in lines], host)
                rows += [{"file": file, "example": n, "line": at, "text": shown, "reason": reason} for at, reason, shown in problems]
                if not any(reason.startswith("unexpected_prompt") for _, reason, _ in problems):
                    rows += [{"file": file, "example": n, "line": s.line, "text": s.text, "within": [w.text for w in s.within], "rooted": s.rooted} for s in said]
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    out = written(pages.select("file", F.posexplode("Examples").alias("example", "lines")).mapInArrow(run, schema))
    return out.filter("reason is null").drop("reason"), out.filter("reason is not null").select("file", "example", "line", "reason", F.col("text").alias("prompt"))


def matched_texts(texts: DataFrame, formats: DataFrame) -> DataFrame:
    """(text, format) of every valid reading of distinct texts; formats: (format, types as JSON). Syntax alone decides."""
    import json

    rows = [{"format": r["format"], "parameter_types": json.loads(r["types"] or "[]")} for r in formats.select("format", "types").distinct().collect()]
    shared = texts.sparkSession.sparkContext.broadcast({"type": "grouped", "entry_view": "syntax", "views": {"syntax": rows}})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = LineParser(shared.value)
        for b in batches:
            found = [(t, f) for t in b.column(0).to_pylist() if t and "\n" not in t and "\r" not in t for f in dict.fromkeys(m["original_pattern"] for m in p.parse(t.strip())["matches"])]
            yield pa.RecordBatch.from_pylist([{"text": t, "format": f} for t, f in found], schema=pa.schema([("text", pa.string()), ("format", pa.string())]))

    return texts.select("text").distinct().mapInArrow(run, "text string, format string")


def recover_switches(records: DataFrame, pages: DataFrame, entry: str, shared: tuple[str, ...] = (), host: str = "") -> tuple[DataFrame, DataFrame]:
    """Views that records lead to, from the examples of pages; and what stayed open.

    records: (file, format_index, view, index, format, types, targets: array of views known before). A command of an example that its
    own page documents, within others, shows that the innermost of these leads to the views that the catalog has the command in. What
    the outer ones may be is bound by the views known so far, so passes go on until one adds nothing; a pass sees only what the
    passes before it found. Returns (view, index, targets, first_pass) and (file, example, line, reason).
    """
    spark = records.sparkSession
    said, _ = example_commands(pages, host)
    said = said.withColumn("o", F.xxhash64("file", "example", "line"))
    readings = written(matched_texts(said.select("text").unionByName(said.select(F.explode("within").alias("text"))), records))
    place = written(records.select("file", "format_index", "view", "index", "format"))
    local = place.filter(~F.col("view").isin([*shared]))
    globals_ = place.filter(F.col("view").isin([*shared])).select("file", "format_index").distinct()
    child = said.filter((F.size("within") > 0) & ~F.col("text").isin(*NAVIGATION)).join(readings, "text").join(local.select("file", "format_index", "format", F.col("view").alias("target")), ["file", "format"]).join(globals_, ["file", "format_index"], "left_anti")
    seen = written(child.groupBy("o", "file", "example", "line", "within", "rooted", "format_index").agg(F.collect_set("target").alias("views")))
    deepest = seen.agg(F.coalesce(F.max(F.size("within")), F.lit(0))).first()[0]
    targets = written(records.filter(F.size("targets") > 0).select("view", "index", F.explode("targets").alias("target")).withColumn("first_pass", F.lit(0)))
    everywhere = spark.createDataFrame([(v,) for v in shared], "state string")
    n = 0
    while True:
        n += 1
        # views in which the k-th enclosing command may stand, one step at a time
        at = seen.filter("rooted").select("o", "format_index", "within", "views", F.lit(entry).alias("state"))
        ready = None
        for k in range(deepest):
            here = at.select("o", "format_index", "within", "views", "state").unionByName(at.select("o", "format_index", "within", "views").distinct().crossJoin(F.broadcast(everywhere))).filter(F.size("within") > k).withColumn("text", F.get("within", F.lit(k)))
            met = here.join(readings, "text").join(place.select("format", F.col("view").alias("state"), "index"), ["format", "state"])
            last = met.filter(F.size("within") == k + 1).select("o", "views", F.col("state").alias("view"), "index")
            ready = last if ready is None else ready.unionByName(last)
            at = met.filter(F.size("within") > k + 1).join(targets.select(F.col("view").alias("state"), "index", "target"), ["state", "index"]).select("o", "format_index", "within", "views", F.col("target").alias("state")).distinct()
        if ready is None:
            break
        ready = written(ready)
        new = written(ready.select("view", "index", F.explode("views").alias("target")).distinct().join(targets, ["view", "index", "target"], "left_anti").withColumn("first_pass", F.lit(n)))
        if new.isEmpty():
            break
        targets = written(targets.unionByName(new))
    found = targets.groupBy("view", "index").agg(F.array_sort(F.collect_set("target")).alias("targets"), F.max("first_pass").alias("first_pass"))
    placed = ready.select("o").distinct() if ready is not None else seen.select("o").limit(0)
    left = seen.join(placed, "o", "left_anti").select("file", "example", "line", F.when(F.col("rooted"), "parent_format_not_matched").otherwise("source_context_unknown").alias("reason")).distinct()
    return found, left


def resolved_names(asked: DataFrame, names: DataFrame) -> DataFrame:
    """(asked, status, target, method, candidates): views by their exact name, else by their name without regard to case and spaces; several leave it ambiguous. names: (view)."""
    exact = names.select(F.col("view").alias("asked"), F.col("view").alias("same"))
    near = names.groupBy(normal_name("view").alias("key")).agg(F.array_sort(F.collect_set("view")).alias("near"))
    a = asked.select("asked").distinct().withColumn("key", normal_name("asked")).join(exact, "asked", "left").join(near, "key", "left")
    one = F.size("near") == 1
    status = F.when(F.col("same").isNotNull() | one, "resolved").when(F.size("near") > 1, "ambiguous").when(F.col("asked").isNull(), "unknown").otherwise("missing")
    return a.select("asked", status.alias("status"), F.coalesce("same", F.when(one, F.element_at("near", 1))).alias("target"), F.when(F.col("same").isNotNull(), "exact").when(one, "normalized").alias("method"), F.when(F.col("same").isNull() & (F.size("near") > 1), F.col("near")).alias("candidates"))


def answered(rows: DataFrame, present: DataFrame) -> DataFrame:
    """The status of transitions for which documents gave an answer: rows (id, requested, kind, target, members), present (view).

    alias and exit_view lead to a view that there is; group to an aggregate of the members that there are; the rest stay open, unknown
    ones as missing where a target was asked for.
    """
    there = resolved_names(rows.filter("target is not null").select(F.col("target").alias("asked")), present).select(F.col("asked").alias("target"), F.col("status").alias("at"), F.col("target").alias("view"))
    every = present.agg(F.collect_set("view").alias("all_views"))
    r = rows.join(there, "target", "left").crossJoin(F.broadcast(every))  # one row: the names of the views
    members = F.array_intersect(F.coalesce("members", F.array().cast("array<string>")), "all_views")
    named = F.col("kind").isin("alias", "exit_view")
    status = (
        F.when(named & (F.col("at") == "resolved"), F.when(F.col("kind") == "exit_view", "exit_view").otherwise("resolved"))
        .when(named, F.when(F.col("at") == "ambiguous", "ambiguous").otherwise("missing"))
        .when(F.col("kind") == "group", F.when(F.col("at").isin("resolved", "ambiguous"), "ambiguous").when(F.size(members) == 0, "missing").otherwise("grouped"))
        .when((F.col("kind") == "unknown") & F.col("requested").isNotNull(), "missing")
        .otherwise(F.col("kind"))
    )
    return r.withColumn("status", status).select("id", "status", F.when(F.col("status").isin("resolved", "exit_view"), F.col("view")).when(F.col("status") == "grouped", F.col("target")).alias("target"), F.when(F.col("status") == "grouped", members).alias("members"))


def hierarchy_report(edges: DataFrame, views: DataFrame, entry: str) -> DataFrame:
    """(view, reachable, has_commands) of every view that there is or that an edge (src, dst) leads to."""
    start = edges.sparkSession.createDataFrame([(entry,)], "node string")
    reach = reachable(edges, start).select(F.col("node").alias("view"), F.lit(True).alias("reachable"))
    all_ = views.select("view").unionByName(edges.select(F.col("dst").alias("view"))).distinct()
    return all_.join(reach, "view", "left").join(views.select("view", F.lit(True).alias("has_commands")).distinct(), "view", "left").select("view", F.coalesce("reachable", F.lit(False)).alias("reachable"), F.coalesce("has_commands", F.lit(False)).alias("has_commands"))


def with_shared(members: DataFrame, shared: list[str]) -> DataFrame:
    """(view, id): the records of each view that isn't shared, and those of shared views in all of them; each once."""
    common = members.filter(F.col("view").isin(shared)).select("id").distinct()
    views = members.filter(~F.col("view").isin(shared)).select("view").distinct()
    return members.unionByName(F.broadcast(views).crossJoin(common)).dropDuplicates(["view", "id"])  # views are few: each gets the shared records


def ranked_views(focus: DataFrame, views: DataFrame, most: int = MOST_VIEWS) -> DataFrame:
    """(id, view, rank): views to look at for each question. focus: (id, text, linked: array of views); views: (view, and own: whether it has commands of its own; without it all have).

    Views that share a term, first, or that linked pages have; then linked ones, those with commands, those with more shared terms, by
    name. It retrieves, and decides nothing.
    """
    own = F.coalesce("own", F.lit(False)) if "own" in views.columns else F.lit(True)
    v = views.select("view", own.alias("own")).groupBy("view").agg(F.max("own").alias("own"))
    t = v.select("view", F.explode(terms("view")).alias("term"))
    q = focus.select("id", F.explode(terms("text")).alias("term"))
    shared = q.join(t, "term").groupBy("id", "view").agg(F.count(F.lit(1)).alias("n"))
    linked = focus.select("id", F.explode("linked").alias("view")).distinct().withColumn("linked", F.lit(True))
    both = shared.join(linked, ["id", "view"], "full").join(v, "view")
    order = Window.partitionBy("id").orderBy(F.col("n").isNull(), F.col("linked").isNull(), ~F.col("own"), F.desc("n"), "view")
    return both.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most).select("id", "view", "rank")


def annotation_problems(annotations: DataFrame, pages: DataFrame) -> DataFrame:
    """(file, format_index, problem) of annotations that can't be taken.

    annotations: (file, format_index, types: array<struct<name,type>>, target, quote, issues: array<string>, selectors: array<array<string>>).
    Every format once; types for its own names, each once, and a word on those that lack one; a target with a quote from the page
    that names it; selectors of several names that stand side by side.
    """
    f = page_formats(pages)
    none = lambda t: F.array().cast(t)
    page_text = pages.select("file", F.concat_ws("\n", "PageTitle", F.array_join("CLIs", "\n"), F.array_join("ParentView", "\n"), "FuncDef", F.array_join(F.transform(F.coalesce("ParaDef", none("array<struct<Parameters:string,Info:string>>")), lambda p: F.concat_ws("\n", p["Parameters"], p["Info"])), "\n"), "UsageGuidelines", F.array_join(F.flatten("Examples"), "\n")).alias("page_text"))
    counted = annotations.groupBy("file", "format_index").agg(F.count(F.lit(1)).alias("n"))
    missing = f.join(counted, ["file", "format_index"], "left_anti").select("file", "format_index", F.lit("format without an annotation").alias("problem"))
    odd = counted.join(f, ["file", "format_index"], "left_anti").select("file", "format_index", F.lit("annotation without a format").alias("problem"))
    twice = counted.filter("n > 1").select("file", "format_index", F.lit("format annotated twice").alias("problem"))
    a = annotations.join(f, ["file", "format_index"]).join(page_text, "file")
    given = F.transform(F.coalesce("types", none("array<struct<name:string,type:string>>")), lambda t: t["name"])
    open_ = F.array_union(F.array_except("names", given), F.transform(F.filter("types", lambda t: t["type"] == "unknown"), lambda t: t["name"]))
    has_issue = lambda c: F.coalesce(F.array_contains("issues", c), F.lit(False))
    quoted = F.coalesce((F.length("quote") > 0) & F.contains(F.col("page_text"), F.col("quote")) & F.contains(F.lower("quote"), F.lower("target")), F.lit(False))
    rules: list[tuple[str, Column]] = [
        ("a name has two types", F.size(F.array_distinct(given)) < F.size(given)),
        ("a type for a name that isn't there", F.size(F.array_except(given, "names")) > 0),
        ("values without a type or a word on it", (F.size(open_) > 0) & ~has_issue("parameter_types")),
        ("a target without a quote that names it", F.col("target").isNotNull() & ~quoted),
        ("an uncertain transition with a target", F.col("target").isNotNull() & has_issue("switch_to_view")),
        ("a selector of names that aren't there or that stand apart", F.exists(F.coalesce("selectors", none("array<array<string>>")), lambda s: (F.size(F.array_except(s, "names")) > 0) | (F.size(F.array_distinct(s)) < F.size(s)) | ((F.size(s) > 1) & ~adjacent(F.col("format"), s)))),
    ]
    found = a.select("file", "format_index", F.explode(F.array_compact(F.array(*(F.when(c, F.lit(p)) for p, c in rules)))).alias("problem"))
    return missing.unionByName(odd).unionByName(twice).unionByName(found)


def assembly_counts(commands: DataFrame) -> DataFrame:
    """One row of counts over annotated commands (target, canonical, issues, n_unresolved_contexts)."""
    open_ = F.coalesce(F.array_contains("issues", "switch_to_view"), F.lit(False))
    has = F.col("target").isNotNull()
    return commands.agg(F.count(F.lit(1)).alias("formats_annotated"), F.count_if(F.size("issues") <= 0).alias("formats_complete"), F.count_if(has & ~open_).alias("transitions_established"), F.count_if(open_).alias("transitions_unresolved"), F.count_if(has & F.col("canonical").isNull()).alias("targets_without_groups"), F.coalesce(F.sum("n_unresolved_contexts"), F.lit(0)).alias("unresolved_requirement_contexts"))


def source_positions(sources: DataFrame) -> DataFrame:
    """(position, file, format_index) of sources (file, command_start, format_indices)."""
    return sources.select("file", "command_start", F.posexplode("format_indices").alias("k", "format_index")).select((F.col("command_start") + F.col("k")).alias("position"), "file", "format_index")


def position_problems(positions: DataFrame, n_commands: int) -> DataFrame:
    """(position, problem) of positions that are taken twice, lie outside, or are missing of 0..n_commands-1."""
    twice = positions.groupBy("position").count().filter("count > 1").select("position", F.lit("taken twice").alias("problem"))
    outside = positions.filter((F.col("position") < 0) | (F.col("position") >= n_commands)).select("position", F.lit("out of range").alias("problem"))
    all_ = positions.sparkSession.range(n_commands).select(F.col("id").alias("position"))
    missing = all_.join(positions.select(F.col("position").cast("long").alias("position")), "position", "left_anti").select("position", F.lit("missing").alias("problem"))
    cast = lambda d: d.withColumn("position", F.col("position").cast("long"))
    return cast(twice).unionByName(cast(outside)).unionByName(missing)


def extracted(pages: DataFrame, client: Callable[[str], str], cache: DataFrame | None = None, version: str = "") -> DataFrame:
    """(fingerprint, file, response, error): what a client answers for each page's JSON; pages whose fingerprint is in the cache (fingerprint, file, response, error) aren't asked again.

    The client is any picklable function of a text; one that calls a service is the caller's own.
    """
    payload = pages.select("file", F.to_json(F.struct(*[c for c in pages.columns if c != "_corrupt_record"])).alias("payload")).withColumn("fingerprint", F.sha2(F.concat(F.lit(version + "\0"), "payload"), 256))
    todo = payload if cache is None else payload.join(cache.filter("error is null").select("fingerprint"), "fingerprint", "left_anti")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got, wrong = [], []
            for text in b.column(2).to_pylist():
                try:
                    got.append(client(text))
                    wrong.append(None)
                except Exception as e:  # noqa: BLE001  a page's failure is its own row
                    got.append(None)
                    wrong.append(f"{type(e).__name__}: {e}")
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(got, pa.string()), pa.array(wrong, pa.string())], names=["fingerprint", "file", "response", "error"])

    new = todo.select("fingerprint", "file", "payload").mapInArrow(run, "fingerprint string, file string, response string, error string")
    return new if cache is None else new.unionByName(payload.select("fingerprint").join(cache, "fingerprint").filter("error is null").select("fingerprint", "file", "response", "error"))


def coverage_by_target(targets: DataFrame, checks: DataFrame) -> DataFrame:
    """(right_view, resolution, covered, partial, unknown): what is known of each documented view's counterpart. targets: (right_view, status); checks: (left_view, right_view, status)."""
    of = lambda s: F.array_sort(F.collect_set(F.when(F.col("c.status") == s, F.col("left_view")))).alias(s)
    g = targets.alias("t").join(checks.alias("c"), F.col("t.right_view") == F.col("c.right_view"), "left").groupBy(F.col("t.right_view").alias("right_view"), F.col("t.status").alias("status")).agg(of("covered"), of("partial"), of("unknown"))
    resolution = F.when(F.col("status") == "resolved", "resolved").when(F.size("covered") > 1, "ambiguous").when(F.size("unknown") > 0, "unknown").when(F.size("partial") > 0, "partial").otherwise("missing")
    return g.select("right_view", resolution.alias("resolution"), "covered", "partial", "unknown")


def self_matches(mapped) -> DataFrame:
    """One row: records, matched records, those matched with themselves, bindings; of a catalog mapped to itself."""
    own = mapped.pairs.join(mapped.device.records.select("id", F.col("source_index").alias("n")), "id").filter(F.col("document_id") == F.concat(F.lit("doc:"), "n"))
    one = mapped.devices.agg(F.count(F.lit(1)).alias("records"), F.count_if(F.col("status") == "matched").alias("matched"))
    return one.crossJoin(own.agg(F.count(F.lit(1)).alias("itself"), F.coalesce(F.sum(F.size("bindings")), F.lit(0)).alias("bindings")))  # one row each


def applications(parsed: DataFrame, mapped, rules: Mapping[str, list[dict]]) -> DataFrame:
    """(config_id, line_no, pattern_id, document_id, status, rules) of documented rules over each reading of each line. rules: by document id."""
    import json

    from lineloom.grammar.aligning import replay
    from lineloom.grammar.formats import slots
    from lineloom.grammar.languages import intersection
    from lineloom.grammar.ruling import application

    one = parsed.select("config_id", "line_no", F.explode("matches").alias("m")).withColumn("id", F.col("m.pattern_id"))
    todo = one.join(mapped.pairs.filter("stage <> 'prefix'").select("id", "document_id", "status"), "id").join(mapped.device.records.select("id", F.col("k").alias("left_k")), "id").join(mapped.documentation.records.select(F.col("id").alias("document_id"), F.col("k").alias("right_k")), "document_id")
    todo = todo.select("config_id", "line_no", "id", "document_id", "left_k", "right_k", "status", F.to_json("m").alias("m"))
    shared = parsed.sparkSession.sparkContext.broadcast((mapped.device.trees, mapped.documentation.trees, dict(rules)))
    kind = dict(parsed.dtypes)["config_id"]

    def value(v: dict):
        return int(v["normalized"]) if v["type"] in ("integer", "hex") else v["normalized"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        xs, ys, rules_ = shared.value
        graphs: dict = {}
        for b in batches:
            status, told = [], []
            for doc, left, right, known, m in zip(*(b.column(i).to_pylist() for i in (3, 4, 5, 6, 7)), strict=True):
                match = json.loads(m)
                match.setdefault("parameters", [])
                if (left, right) not in graphs:
                    p = intersection(ys[right], xs[left])
                    graphs[left, right] = p and p.graph()
                graph = graphs[left, right]
                ways = None if graph is None or known == "unknown" else replay(graph, match)
                names = {s.slot_id: s.declared.text.strip("<>") for s in slots(ys[right])}
                types = {v["slot_id"]: v["type_id"] for v in match["parameters"]}
                bound = ways and [[{"name": names[w["document"]], "value": value({"normalized": w["normalized"], "type": types[w["device"]]}), "iterations": [tuple(i) for i in w["iterations"]]} for w in way] for way in ways]
                s, each = application(rules_.get(doc, []), None if ways is None else bound or [])
                status.append(s)
                told.append(json.dumps(each))
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(4)), pa.array(status, pa.string()), pa.array(told, pa.string())], names=["config_id", "line_no", "pattern_id", "document_id", "status", "rules"])

    return todo.mapInArrow(run, f"config_id {kind}, line_no int, pattern_id string, document_id string, status string, rules string")
