"""Whole configurations, distributed.

One row of text is one configuration: its lines, their indentation and the line each stands under are found within the row, without
a shuffle. Lines are recognised once for each distinct (scope, command, indentation) and joined back. In hierarchy mode this goes
level by level of indentation: a level's views follow from the level above by a join, so that a configuration's lines are spread
over all tasks, and the number of rounds is that of the deepest nesting.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineloom.grammar.results import ERROR, ISSUE, MATCH
from lineloom.storage import written
from lineloom.grammar.values import REGISTRY, Registry
from lineloom.parser import LineParser, physical_lines, structure

RESULT = f"kind string, status string, view string, context_issue {ISSUE}, matches array<{MATCH}>, error {ERROR}, child_view string, child_issue string"

#: What one batch of lines holds before it is passed on.
BATCH_LINES, BATCH_CHARS = 5_000, 1_000_000
#: Most tasks for each core that recognise commands.
TASKS_A_CORE = 4
#: What counts as a blank around a command.
BLANKS = "".join(c for c in map(chr, range(sys.maxunicode + 1)) if c.isspace())


def configuration_lines(configs: DataFrame, config_id: str, text: str) -> DataFrame:
    """(config_id, line_no, raw, depth, parent_line, level, command) of every physical line; parent_line is null at the top, for blank lines and for #."""
    kind = dict(configs.dtypes)[config_id]

    names = ["config_id", "line_no", "raw", "depth", "parent_line", "level", "command"]

    def batch(ids: pa.Array, take: list[int], columns: list[list]) -> pa.RecordBatch:
        types = [pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string()]
        return pa.RecordBatch.from_arrays([ids.take(pa.array(take, pa.int32())), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            take: list[int] = []
            columns: list[list] = [[] for _ in names[1:]]
            held = 0
            for k in range(b.num_rows):
                value = b.column(1)[k].as_py() or ""
                lines = physical_lines(value)
                if not lines:
                    continue
                depth, parent, level = zip(*structure(lines), strict=True)
                take += [k] * len(lines)
                for c, x in zip(columns, (range(1, len(lines) + 1), lines, depth, (None if p is None else p + 1 for p in parent), level, (x.strip() for x in lines)), strict=True):
                    c.extend(x)
                held += len(value)
                if held >= BATCH_CHARS or len(take) >= BATCH_LINES:
                    yield batch(b.column(0), take, columns)
                    take, columns, held = [], [[] for _ in names[1:]], 0
            if take:
                yield batch(b.column(0), take, columns)

    picked = configs.select(F.col(config_id).alias("config_id"), F.col(text).cast("string").alias("text"))
    return picked.mapInArrow(run, f"config_id {kind}, line_no int, raw string, depth int, parent_line int, level int, command string")


def plain_lines(configs: DataFrame, config_id: str, text: str) -> DataFrame:
    """(config_id, line_no, raw, depth, command) of every physical line, as configuration_lines() has them, where nothing asks for the lines that others stand under."""
    every = F.split(F.col(text).cast("string"), "\r\n|\r|\n")
    lines = configs.select(F.col(config_id).alias("config_id"), F.posexplode(every).alias("at", "raw"), F.size(every).alias("n"))
    # a line end at the end opens no new line
    lines = lines.filter((F.col("raw") != "") | (F.col("at") < F.col("n") - 1))
    blanks = F.lit(BLANKS)
    return lines.select("config_id", (F.col("at") + 1).alias("line_no"), "raw", (F.length("raw") - F.length(F.ltrim("raw", blanks))).alias("depth"), F.btrim("raw", blanks).alias("command"))


class _Shared:
    """A catalog, with the types its formats may declare, that each Python worker compiles once."""

    _held: dict = {}

    def __init__(self, document: Mapping, mode: str, registry: Registry = REGISTRY):
        import json

        self.text, self.mode = json.dumps(document), mode
        # types of the user's own hold functions, which plain pickling doesn't take
        self.registry = None if registry is REGISTRY else cloudpickle.dumps(registry)

    def parser(self) -> LineParser:
        k = (self.text, self.mode, self.registry)
        if k not in _Shared._held:
            _Shared._held.clear()
            _Shared._held[k] = LineParser.from_json(self.text, mode=self.mode, registry=REGISTRY if self.registry is None else cloudpickle.loads(self.registry))
        return _Shared._held[k]


def recognised(commands: DataFrame, document: Mapping, mode: str, how: str, registry: Registry = REGISTRY) -> DataFrame:
    """Results of distinct (view, issue_code, depth, command); how: flat, system or view. Issues and results name line 1; the caller puts in its own."""
    LineParser(document, registry, mode)  # a bad catalog fails here, and not in the tasks
    shared = commands.sparkSession.sparkContext.broadcast(_Shared(document, mode, registry))
    schema = "view_in string, issue_in string, depth int, command string, " + RESULT
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value.parser()
        for b in batches:
            rows = []
            for view, issue, depth, command in zip(*(c.to_pylist() for c in b.columns), strict=True):
                line = " " * depth + command
                if how == "flat":
                    r = p.parse_flat(line)
                elif how == "system":
                    r = p.parse(line)
                elif view is not None:
                    r = p.parse(line, view=view)
                else:
                    r = p.parse_unresolved(line, 1, {"code": issue, "message": "", "source_line": 0})
                child, child_issue = p.child_frame(r) if how == "view" else (None, None)
                rows.append({"view_in": view, "issue_in": issue, "depth": depth, "command": command, "child_view": child, "child_issue": child_issue and child_issue["code"]} | {k: r[k] for k in ("kind", "status", "view", "context_issue", "matches", "error")})
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    # commands are short and take long: left to their bytes, adaptive execution would put them into one task
    spark, keys = commands.sparkSession, ["view_in", "issue_in", "depth", "command"]
    n = min(int(spark.conf.get("spark.sql.shuffle.partitions")), TASKS_A_CORE * spark.sparkContext.defaultParallelism)
    # Spark takes results to be as small as the files that the commands come from, and would broadcast them, and leave lines in the splits of those
    return commands.select(keys).distinct().repartition(n, *keys).mapInArrow(run, schema).hint("merge")


COLUMNS = ["config_id", "line_no", "raw", "depth", "kind", "status", "view", "context_issue", "matches", "error"]


def _special(lines: DataFrame, separators: bool) -> DataFrame:
    """Blank lines and separators, as results."""
    kind = F.when(F.col("command") == "", "blank").otherwise("separator")
    null = lambda t: F.lit(None).cast(t)
    picked = lines.filter((F.col("command") == "") | ((F.col("command") == "#") & F.lit(separators)))
    return picked.select("config_id", "line_no", "raw", "depth", kind.alias("kind"), null("string").alias("status"), null("string").alias("view"), null(ISSUE).alias("context_issue"), F.array().cast(f"array<{MATCH}>").alias("matches"), null(ERROR).alias("error"))


def parse_configurations(configs: DataFrame, document: Mapping, *, config_id: str = "config_id", text: str = "text", mode: str = "system", contextual: bool | None = None, registry: Registry = REGISTRY) -> DataFrame:
    """One row per physical line: COLUMNS. contextual: false for a flat search of a grouped catalog. registry: the types that formats may declare."""
    parser = LineParser(document, registry, mode)
    grouped = parser.entry_view is not None
    contextual = grouped if contextual is None else contextual
    if contextual and not grouped:
        raise ValueError("contexts need a grouped catalog")
    if not contextual or mode == "system":
        lines = plain_lines(configs, config_id, text)
        body = lines.filter((F.col("command") != "") & ~((F.col("command") == "#") & F.lit(contextual)))
        how = "system" if contextual else "flat"
        asked = body.withColumns({"view_in": F.lit(None).cast("string"), "issue_in": F.lit(None).cast("string")})
        # what a line means doesn't hang on how far in it stands, but its places do
        found = recognised(asked, document, mode, how, registry).drop("view_in", "issue_in")
        return body.join(found, ["command", "depth"]).select(*COLUMNS).unionByName(_special(lines, contextual))
    lines = written(configuration_lines(configs, config_id, text))
    body = lines.filter((F.col("command") != "") & (F.col("command") != "#"))
    deepest = body.agg(F.max("level")).first()[0]
    parts = [_special(lines, True)]
    above = None
    for level in range((deepest if deepest is not None else -1) + 1):
        here = body.filter(F.col("level") == level)
        if above is None:
            asked = here.withColumns({"view_in": F.lit(parser.entry_view), "issue_in": F.lit(None).cast("string"), "issue_line": F.lit(None).cast("int")})
        else:
            under = above.select("config_id", F.col("line_no").alias("parent_line"), F.col("child_view").alias("view_in"), F.col("child_issue").alias("issue_in"), F.col("child_line").alias("issue_line"))
            asked = here.join(under, ["config_id", "parent_line"])
        asked = written(asked)
        found = recognised(asked, document, mode, "view", registry).alias("f")
        a = asked.alias("a")
        on = (F.col("a.command") == F.col("f.command")) & (F.col("a.depth") == F.col("f.depth")) & F.col("a.view_in").eqNullSafe(F.col("f.view_in")) & F.col("a.issue_in").eqNullSafe(F.col("f.issue_in"))
        # an issue found here names this line, one inherited names the line it arose at
        at = F.when(F.col("a.issue_in").isNotNull(), F.col("issue_line")).otherwise(F.col("line_no"))
        message = F.coalesce(*(F.when(F.col("context_issue.code") == c, m) for c, m in _messages()), F.col("context_issue.message"))
        issue = F.when(F.col("context_issue").isNotNull(), F.struct(F.col("context_issue.code").alias("code"), message.alias("message"), at.cast("int").alias("source_line")))
        done = written(a.join(found, on).select("a.config_id", "line_no", "raw", "a.depth", "kind", "status", "view", issue.alias("context_issue"), "matches", "error", "child_view", "child_issue", at.cast("int").alias("child_line")))
        parts.append(done.select(*COLUMNS))
        above = done
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _messages():
    from lineloom.grammar.results import ISSUES

    return ISSUES.items()


def report(parsed: DataFrame) -> DataFrame:
    """Counts of each configuration. commands has the ambiguous and the unresolved ones in it."""
    kind = F.col("kind")
    command = kind.isin("command", "unresolved_command")
    return parsed.groupBy("config_id").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(kind == "blank").alias("blank"),
        F.count_if(command).alias("commands"),
        F.count_if(command & (F.col("status") == "ambiguous")).alias("ambiguous"),
        F.count_if(kind == "error").alias("errors"),
        F.count_if(kind == "unresolved_command").alias("unresolved"),
    )


def json_lines(parsed: DataFrame) -> DataFrame:
    """(config_id, line_no, json): each line's result, nulls left out."""
    return parsed.select("config_id", "line_no", F.to_json(F.struct("line_no", "raw", "kind", "status", "view", "context_issue", "matches", "error"), {"ignoreNullFields": "true"}).alias("json"))


def captured_values(parsed: DataFrame) -> DataFrame:
    """(config_id, line_no, pattern_id, slot_id, declaration, type_id, raw, normalized, start, end, iterations) of every value of every match."""
    m = parsed.select("config_id", "line_no", F.explode("matches").alias("m"))
    v = m.select("config_id", "line_no", F.col("m.pattern_id").alias("pattern_id"), F.explode("m.parameters").alias("v"))
    return v.select("config_id", "line_no", "pattern_id", "v.slot_id", "v.declaration", "v.type_id", "v.raw", "v.normalized", "v.start", "v.end", "v.iterations")
