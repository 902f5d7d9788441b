"""Recognition of command lines against a catalog of formats.

Lines are reduced to distinct (scope, command) pairs first. Formats of words and values alone (tier 1) are joined
natively: on the first word, the number of tokens and the words' places. The rest (tier 2) runs as an Arrow
function over the distinct commands, with the programs broadcast; formats are grammar, not data, and their
number is checked. Duplicate formats run once and are joined back to each of their sources.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lineloom.functions.probes import BY_FUNCTION, by_function, probe_each
from lineloom.functions.text import body, fold, indent, lines, tokens
from lineloom.grammar.formats import Slot, Word, first, is_linear, key, leading_words, parse
from lineloom.grammar.program import Program, recognize, resolve
from lineloom.grammar.values import FormatError

#: Formats a broadcast grammar may have.
MOST_FORMATS = 200_000


@dataclass(frozen=True)
class Format:
    """A source format: its place in the catalog, its id, its view, and where it leads."""

    index: int
    text: str
    view: str = ""
    child: str | None = None


def pattern_ids(formats: list[Format]) -> list[str]:
    """pattern:<hash>:<occurrence> of each format."""
    seen: dict[str, int] = {}
    out = []
    for f in formats:
        n = seen.get(f.text, 0)
        seen[f.text] = n + 1
        out.append(f"pattern:{key(f.text)}:{n}")
    return out


def parsed(formats: list[Format]) -> dict[str, object]:
    """Trees by distinct format; all failures are gathered before one is raised."""
    if len(formats) > MOST_FORMATS:
        raise ValueError(f"{len(formats)} formats are more than a broadcast grammar may have ({MOST_FORMATS})")
    out, wrong = {}, []
    for f in formats:
        if f.text not in out:
            try:
                out[f.text] = parse(f.text)
            except FormatError as e:
                wrong.append(f"{f.index}: {f.text!r}: {e} ({e.start}-{e.end})")
    if wrong:
        raise FormatError("; ".join(wrong))
    return out


def config_lines(configs: DataFrame, config_id: str, text: str) -> DataFrame:
    """(config_id, line_no, raw, indent, command, scope) of the physical lines of each configuration."""
    each = configs.select(F.col(config_id).alias("config_id"), F.posexplode(lines(F.col(text))).alias("at", "raw"))
    return each.select("config_id", (F.col("at") + 1).alias("line_no"), "raw", indent("raw").alias("indent"), body("raw").alias("command")).withColumn("scope", F.when(F.col("indent") > 0, "nested").otherwise("system"))


def distinct_commands(rows: DataFrame, *by: str) -> DataFrame:
    """Each command once a scope, without blanks and separators; tokens and their folded forms."""
    kept = rows.filter((F.col("command") != "") & ~F.col("command").startswith("#")).select(*by, "command").distinct()
    return kept.withColumn("tokens", tokens("command")).withColumn("folded", F.transform("tokens", fold))


SLOT = "struct<at:int,type_id:string,low:decimal(38,0),high:decimal(38,0),choices:array<string>,takes_rest:boolean>"


def linear_matches(commands: DataFrame, formats: list[Format]) -> DataFrame:
    """Tier 1: (…, format, arity, takes_rest, ranks, slots) for each command that a linear format reads to its end.

    By the first word where a format has one; formats that begin with a value meet every command, and their arity decides.
    """
    rows = []
    for text, tree in parsed(formats).items():
        if not is_linear(tree):
            continue
        items = tree.items
        words = [(i, fold_word(x.text)) for i, x in enumerate(items) if isinstance(x, Word)]
        values = [(i, x.declared) for i, x in enumerate(items) if isinstance(x, Slot)]
        rest = bool(values) and values[-1][1].takes_rest
        wide = lambda n: None if n is None else Decimal(n)
        slots = [(i, d.type_id, wide(d.low), wide(d.high), list(d.choices), d.takes_rest) for i, d in values]
        rows.append((text, words[0][1] if words and words[0][0] == 0 else None, len(items), rest, rest and len(items) == 1, words, [0 if isinstance(x, Word) else x.declared.rank for x in items], slots))
    spark = commands.sparkSession
    table = F.broadcast(spark.createDataFrame(rows, f"format string, lead string, arity int, takes_rest boolean, remark boolean, words array<struct<at:int,word:string>>, ranks array<int>, slots array<{SLOT}>"))
    by_word = commands.join(table.filter("lead is not null"), F.col("folded")[0] == F.col("lead"))
    by_value = commands.join(table.filter("lead is null and not takes_rest"), F.size("folded") == F.col("arity")).unionByName(commands.join(table.filter("lead is null and takes_rest"), F.size("folded") >= F.col("arity")))
    fits = F.when(F.col("takes_rest"), F.size("folded") >= F.col("arity")).otherwise(F.size("folded") == F.col("arity"))
    said = F.forall("words", lambda w: F.get("folded", w["at"]) == w["word"])
    return by_word.unionByName(by_value).filter(fits & said & (~F.col("remark") | F.col("command").startswith("!"))).drop("lead", "words", "remark")


def fold_word(s: str) -> str:
    from lineloom.grammar.values import fold as fold_text

    return fold_text(s)


def _value_at(slot: Column) -> Column:
    """The token that a slot reads; of one that takes the rest, the rest of the command as it stands."""
    place = F.concat(F.lit(r"^(?U)(?:[^\s\x1c-\x1f]+[\s\x1c-\x1f]+){"), slot["at"].cast("string"), F.lit("}"))
    return F.when(slot["takes_rest"], F.regexp_replace(F.col("command"), place, F.lit(""))).otherwise(F.get("tokens", slot["at"]))


def linear_probed(matches: DataFrame) -> DataFrame:
    """Adds probes: the test of each value's token, in order, and status: valid, invalid or strange.

    One expression a type tests the slots of all formats. Types that need a function are tested on their distinct tokens.
    """
    odd = lambda s: s["type_id"].isin(*BY_FUNCTION)
    asked = matches.filter(F.exists("slots", odd)).select("command", "format", "tokens", F.explode(F.filter("slots", odd)).alias("s")).select("command", "format", "s", _value_at(F.col("s")).alias("token"))
    once = asked.select(F.col("s.type_id").alias("type_id"), "token").distinct()
    tested = None
    for t in BY_FUNCTION:
        part = once.filter(F.col("type_id") == t).select("type_id", "token", by_function(t, F.col("token")).alias("p"))
        tested = part if tested is None else tested.unionByName(part)
    held = asked.withColumn("type_id", F.col("s.type_id")).join(tested, ["type_id", "token"]).groupBy("command", "format").agg(F.map_from_entries(F.collect_list(F.struct(F.col("s.at"), "p"))).alias("by_function"))
    probe = lambda s: F.coalesce(F.try_element_at("by_function", s["at"]), probe_each(s["type_id"], s["low"], s["high"], s["choices"], _value_at(s)))
    probed = matches.join(held, ["command", "format"], "left").withColumn("probes", F.transform("slots", probe)).drop("by_function", "slots")
    bad = lambda s: F.exists("probes", lambda p: p["status"] == s)
    return probed.withColumn("status", F.when(bad("not_applicable"), "strange").when(bad("invalid"), "invalid").otherwise("valid"))


RESULTS = "command string, outcome string, formats array<string>, readings int, furthest int, expected array<string>"


def automaton_results(commands: DataFrame, formats: list[Format], retain_all: bool = False) -> DataFrame:
    """Tier 2: each distinct command resolved against all formats: outcome (unique, ambiguous, equivalent, validation_error, syntax_error, unknown_command)."""
    trees = parsed(formats)
    spark = commands.sparkSession
    shared = spark.sparkContext.broadcast(trees)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = list(shared.value)
        programs = [Program(shared.value[t]) for t in texts]
        by_lead: dict[str | None, list[int]] = {}
        for i, t in enumerate(texts):
            words, value, _ = first(shared.value[t])
            for w in [*words, *([None] if value else [])]:
                by_lead.setdefault(w, []).append(i)
        leads = {i: leading_words(shared.value[t]) for i, t in enumerate(texts)}
        for b in batches:
            rows = []
            for command in b.column(0).to_pylist():
                words = [fold_word(w) for w in command.split()]
                starts = sorted({*by_lead.get(words[0], ()), *by_lead.get(None, ())}) if words else []
                paths, owners, furthest, expected = [], {}, 0, []
                for i in starts:
                    lead = leads[i]
                    n = next((k for k, (x, y) in enumerate(zip(lead, words, strict=False)) if x != y), min(len(lead), len(words)))
                    if n < len(lead):  # fails within its leading words: no need to run it
                        at, want = n, [lead[n]]
                    else:
                        o = recognize(programs[i], command)
                        at, want = len(command[: o.furthest].split()), [w[1:-1] if w[0] == w[-1] == "'" else w for w in o.expected]
                        for p in o.accepted:
                            owners[id(p)] = texts[i]
                            paths.append(p)
                    if at > furthest:
                        furthest, expected = at, []
                    if at == furthest:
                        expected += [w for w in want if w not in expected]
                kind, best = resolve(paths, retain_all)
                found = [owners[id(p)] for p in best]
                if kind == "matched":
                    outcome = "unique" if len(best) == 1 else "ambiguous"
                    if len(best) > 1 and len({tuple((c.slot.declared.type_id, c.raw) for c in p.captured) for p in best}) == 1 and len(set(found)) == len(found):
                        outcome = "equivalent"
                else:
                    outcome = "validation_error" if kind == "invalid" else "syntax_error" if furthest else "unknown_command"
                rows.append((command, outcome, list(dict.fromkeys(found)), len(best), furthest, expected if kind == "none" else []))
            yield pa.RecordBatch.from_pylist([dict(zip(("command", "outcome", "formats", "readings", "furthest", "expected"), r, strict=True)) for r in rows], schema=pa.schema([("command", pa.string()), ("outcome", pa.string()), ("formats", pa.list_(pa.string())), ("readings", pa.int32()), ("furthest", pa.int32()), ("expected", pa.list_(pa.string()))]))

    return commands.select("command").mapInArrow(run, RESULTS)


def skyline(candidates: DataFrame, by: list[str], ranks: str = "ranks") -> DataFrame:
    """Candidates that none of the same group dominates. Distinct vectors are held against each other, not rows."""
    from lineloom.functions.text import dominates

    vectors = candidates.select(*by, F.col(ranks).alias("other")).distinct()
    same = [F.col(f"c.{k}").eqNullSafe(F.col(f"v.{k}")) for k in by]
    on = same[0]
    for s in same[1:]:
        on = on & s
    return candidates.alias("c").join(vectors.alias("v"), on & dominates(F.col("v.other"), F.col(f"c.{ranks}")), "left_anti")


def blocked(valid: DataFrame, invalid: DataFrame, by: list[str], ranks: str = "ranks") -> DataFrame:
    """Valid readings that an invalid one, more specific, dominates."""
    from lineloom.functions.text import dominates

    wrong = invalid.select(*by, F.col(ranks).alias("other")).distinct().alias("w")
    on = dominates(F.col("w.other"), F.col(f"v.{ranks}"))
    for k in by:
        on = on & F.col(f"v.{k}").eqNullSafe(F.col(f"w.{k}"))
    return valid.alias("v").join(wrong, on, "left_semi")


def first_wins(rows: DataFrame, identity: list[str], order: list[str]) -> DataFrame:
    """Of rows with one identity the first in order."""
    by = Window.partitionBy(*identity).orderBy(*order)
    return rows.withColumn("_place", F.row_number().over(by)).filter("_place = 1").drop("_place")


def fan_out(results: DataFrame, formats: list[Format]) -> DataFrame:
    """Results of distinct formats joined to every source that has the format: adds pattern_index, pattern_id, view, child."""
    spark: SparkSession = results.sparkSession
    rows = [(f.text, f.index, i, f.view, f.child) for f, i in zip(formats, pattern_ids(formats), strict=True)]
    return results.join(F.broadcast(spark.createDataFrame(rows, "format string, pattern_index int, pattern_id string, view string, child string")), "format")


def report(lines_: DataFrame) -> DataFrame:
    """Counts of each configuration: lines, commands, blanks, separators, errors, and by outcome."""
    kind = F.col("kind")
    return lines_.groupBy("config_id").agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.count_if(kind == "command").alias("n_commands"),
        F.count_if(kind == "blank").alias("n_blank"),
        F.count_if(kind == "separator").alias("n_separators"),
        F.count_if(kind == "error").alias("n_errors"),
        F.count_if(F.col("outcome") == "ambiguous").alias("n_ambiguous"),
    )


def parse_lines(rows: DataFrame, formats: list[Format], separators: bool = True, retain_all: bool = False) -> DataFrame:
    """Each line with its kind and outcome: distinct commands are recognised once and joined back."""
    found = automaton_results(distinct_commands(rows), formats, retain_all)
    joined = rows.join(found, "command", "left")
    matched = F.col("outcome").isin("unique", "equivalent", "ambiguous")
    kind = F.when(F.col("command") == "", "blank").when(F.lit(separators) & F.col("command").startswith("#"), "separator").when(matched, "command").otherwise("error")
    return joined.withColumn("kind", kind)
