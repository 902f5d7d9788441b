"""The mapping of one catalog to another, as tables.

Formats are keyed by their text and types, so that each distinct one is parsed and compared once, and pairs of keys are found by
the joins of lineloom.operators.matching. Source records join to their keys, and which of them may meet is a relation between
classes of views. What no record has a full match for goes on to the prefix stage by an anti-join. An exhausted budget is a pair
of status unknown, and stays one.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lineloom.grammar import catalog as cat
from lineloom.grammar.aligning import aligned
from lineloom.grammar.formats import parse, prefixes, shape, slots, symbols
from lineloom.grammar.languages import MAX_STEPS, intersection, relation
from lineloom.grammar.values import DOCUMENT, REGISTRY, FormatError, category, compatible
from lineloom.operators.matching import prefix_candidates, structural_pairs, symbol_filter
from lineloom.storage import written

BINDING = "array<struct<document:string,device:string,document_rounds:array<string>,device_rounds:array<string>>>"
PAIR = f"device string, document string, status string, stage string, binding_mode string, bindings {BINDING}, graph string"
KEY = "format string, text string, ordered_key string, canonical_key string, typed_key string, required array<string>, possible array<string>, any_value boolean, prefixes array<array<string>>, value_prefixes array<array<string>>, types array<string>, slot_at array<int>, known boolean"
_PAIR_ARROW = pa.schema([("device", pa.string()), ("document", pa.string()), ("status", pa.string()), ("stage", pa.string()), ("binding_mode", pa.string()), ("bindings", pa.list_(pa.struct([("document", pa.string()), ("device", pa.string()), ("document_rounds", pa.list_(pa.string())), ("device_rounds", pa.list_(pa.string()))]))), ("graph", pa.string())])


@dataclass
class Side:
    """A catalog's records and trees. records: (id, k, format, view, index_in_view, source_index, switch, target, record); k names the format and its types."""

    catalog: cat.Catalog
    trees: dict
    keys: DataFrame
    records: DataFrame

    @property
    def documents(self) -> bool:
        return self.catalog.header.get("source") == "documentation"


@dataclass
class Mapped:
    """devices: (id, format, view, index_in_view, status, stage); pairs: (id, document_id, status, stage, binding_mode, bindings, graph), by record."""

    device: Side
    documentation: Side
    devices: DataFrame
    pairs: DataFrame


def key_of(text: str, types) -> str:
    return hashlib.sha256(json.dumps([text, sorted(types)]).encode()).hexdigest()[:24]


def side(spark: SparkSession, doc: Mapping, *, documents: bool, follow: bool) -> Side:
    """Read, parse and key one catalog. documents: ids are doc:<n>; else pattern ids."""
    c = cat.read_v1(doc, follow=follow)
    named = c.header["source"] == "documentation"
    trees, rows, wrong = {}, {}, []
    for x in c.commands:
        k = key_of(x.format, x.types)
        if k not in trees:
            try:
                t = cat.with_types(parse(x.format, DOCUMENT if named else REGISTRY, policy=not named), dict(x.types))
            except FormatError as e:
                wrong.append(f"{x.index}: {x.format!r}: {e}")
                continue
            trees[k] = t
            must, may, value = symbols(t)
            cover = sorted(prefixes(t))
            held = list(slots(t))
            kinds = [category(s.declared.type_id) for s in held]
            rows[k] = (k, x.format, shape(t), shape(t, ordered=False), shape(t, ordered=False, types=True), sorted(must), sorted(may), value, [list(p) for p in cover], [list(p) for p in sorted({p[: p.index("P") + 1] for p in cover if "P" in p})], kinds, [s.at for s in held], all(kinds))
    if wrong:
        raise FormatError("; ".join(wrong))
    ids = [f"doc:{x.index}" for x in c.commands] if documents else cat.pattern_ids([x.format for x in c.commands])
    records = [(i, key_of(x.format, x.types), x.format, x.view, x.index_in_view, x.index, *transition(x.record), json.dumps(dict(x.record))) for i, x in zip(ids, c.commands, strict=True)]
    return Side(c, trees, spark.createDataFrame(list(rows.values()), KEY), spark.createDataFrame(records, "id string, k string, format string, view string, index_in_view int, source_index int, switch string, target string, record string"))


def usable(doc: Mapping) -> tuple[dict, list[dict]]:
    """The part of a device's or a documentation catalog that side() takes, and the commands left out, with their errors."""
    named = doc.get("source") == "documentation"
    return cat.valid_part(doc, lambda text, types: symbols(cat.with_types(parse(text, DOCUMENT if named else REGISTRY, policy=not named), types)))


def transition(record: Mapping) -> tuple[str, str | None]:
    """absent, stay, unresolved, or switch and its target: what a record says of where it leads."""
    if "switch_to_view" not in record:
        return "absent", None
    to = record["switch_to_view"]
    return ("stay", None) if to is None else ("unresolved", None) if to == cat.UNRESOLVED else ("switch", to)


def structural(spark: SparkSession, pairs: DataFrame, left: Side, right: Side, ordered: bool) -> DataFrame:
    """PAIR rows of pairs of one shape whose values fit; those whose types don't are left to the later stages."""
    shared = spark.sparkContext.broadcast((left.trees, right.trees))
    stage = "exact" if ordered else "reordered"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        xs, ys = shared.value
        for b in batches:
            rows = []
            for device, document in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                typed = not ordered and shape(xs[device], False, True) == shape(ys[document], False, True)
                found = aligned(ys[document], xs[device], ordered, typed)
                if all(compatible(category(p.declared.type_id), category(q.declared.type_id)) for p, q, *_ in found):
                    links = sorted((q.at, p.at, m, n) for p, q, m, n in found)
                    rows.append({"device": device, "document": document, "status": "equivalent", "stage": stage, "binding_mode": "structural", "bindings": [{"document": f"p:{p}", "device": f"p:{q}", "document_rounds": list(m), "device_rounds": list(n)} for q, p, m, n in links], "graph": None})
            yield pa.RecordBatch.from_pylist(rows, schema=_PAIR_ARROW)

    return pairs.select("device", "document").mapInArrow(run, PAIR)


def products(spark: SparkSession, pairs: DataFrame, left: Side, right: Side, prefix: bool, steps: int = MAX_STEPS) -> DataFrame:
    """PAIR rows of what the languages of each pair have in common; pairs with nothing in common give none."""
    shared = spark.sparkContext.broadcast((left.trees, right.trees))
    stage = "prefix" if prefix else "intersection"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        xs, ys = shared.value
        for b in batches:
            rows = []
            for device, document in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                p = intersection(ys[document], xs[device], prefix, steps)
                status, mode = "unknown", "unavailable"
                if p is not None:
                    if not p.nonempty or prefix and not p.bindings:
                        continue
                    mode = "prefix_dependent" if prefix else "path_dependent"
                    # the relation comes second: a proof that runs out doesn't undo the bindings
                    status = "prefix_match" if prefix else relation(ys[document], xs[device], steps) or "matched"
                links = [{"document": f"p:{d}", "device": f"p:{v}", "document_rounds": [], "device_rounds": []} for d, v in p.bindings] if p else []
                rows.append({"device": device, "document": document, "status": status, "stage": stage, "binding_mode": mode, "bindings": links, "graph": json.dumps(p.graph()) if p else None})
            yield pa.RecordBatch.from_pylist(rows, schema=_PAIR_ARROW)

    return pairs.select("device", "document").mapInArrow(run, PAIR)


def scopes(left: Side, right: Side, mode: str, links: Mapping[str, tuple[str, ...]] | None = None) -> list[tuple[str | None, str | None]] | None:
    """Pairs of views whose records may meet; None: any. links: documentation views of device views, as recovered; views without any are free."""
    x, y = left.catalog, right.catalog
    if not x.grouped or not y.grouped:
        return None
    if mode == "hierarchy" or links is not None:
        links = links if links is not None else {x.entry: (y.entry,)}
        always = {*y.shared, *([y.global_view] if y.global_view else [])}
        return [(v, w) for v in x.views for w in y.views if v not in links or w in links[v] or w in always]
    system, other = {y.entry, y.global_view} - {None}, set(y.views) - {y.entry}
    part = lambda v: system | other if v == x.global_view else system if v == x.entry else other
    return [(v, w) for v in x.views for w in part(v)]


def _placed(spark: SparkSession, pairs: DataFrame, left: Side, right: Side, allowed) -> DataFrame:
    """Pairs of keys as pairs of records, within what the views allow."""
    x = left.records.select("id", F.col("k").alias("device"), F.col("view").alias("left_view"))
    y = right.records.select(F.col("id").alias("document_id"), F.col("k").alias("document"), F.col("view").alias("right_view"))
    out = pairs.join(x, "device").join(y, "document")
    if allowed is not None:
        table = spark.createDataFrame(allowed, "left_view string, right_view string")
        out = out.join(F.broadcast(table), ["left_view", "right_view"], "left_semi")
    return out.select("id", "document_id", "status", "stage", "binding_mode", "bindings", "graph")


def map_catalogs(spark: SparkSession, device_doc: Mapping, documentation_doc: Mapping, mode: str = "system", steps: int = MAX_STEPS) -> Mapped:
    """All full matches of each device record, and prefix matches of those with none."""
    follow = mode == "hierarchy"
    x, y = side(spark, device_doc, documents=False, follow=follow), side(spark, documentation_doc, documents=True, follow=follow)
    if not y.documents:
        raise cat.CatalogError("the source of the second catalog must be documentation")
    exact = structural(spark, structural_pairs(x.keys, y.keys, "ordered_key"), x, y, True)
    open_ = structural_pairs(x.keys, y.keys, "canonical_key").join(exact, ["device", "document"], "left_anti")
    shaped = written(exact.unionByName(structural(spark, open_, x, y, False)))
    met = symbol_filter(prefix_candidates(x.keys, y.keys), x.keys, y.keys).join(shaped, ["device", "document"], "left_anti")
    full = written(shaped.unionByName(products(spark, met, x, y, False, steps)))
    return _finished(spark, x, y, full, scopes(x, y, mode), steps)


def refined(spark: SparkSession, m: Mapped, links: Mapping[str, tuple[str, ...]], steps: int = MAX_STEPS) -> Mapped:
    """The mapping within recovered views. Full pairs are kept; only records that lose theirs are looked at for prefixes again."""
    full = m.pairs.filter("stage <> 'prefix'").join(m.device.records.select("id", F.col("k").alias("device")), "id").join(m.documentation.records.select(F.col("id").alias("document_id"), F.col("k").alias("document")), "document_id")
    keyed = written(full.dropDuplicates(["device", "document"]).select("device", "document", "status", "stage", "binding_mode", "bindings", "graph"))
    return _finished(spark, m.device, m.documentation, keyed, scopes(m.device, m.documentation, "hierarchy", links), steps)


def _finished(spark: SparkSession, x: Side, y: Side, full: DataFrame, allowed, steps: int) -> Mapped:
    placed = written(_placed(spark, full, x, y, allowed))
    bound = placed.filter("binding_mode <> 'unavailable'")
    rest = x.records.join(bound, "id", "left_anti")
    keys = x.keys.join(rest.select(F.col("k").alias("format")), "format", "left_semi")
    begun = products(spark, prefix_candidates(keys, y.keys, "value_prefixes"), x, y, True, steps)
    begun = _placed(spark, begun, x, y, allowed).join(rest.select("id"), "id", "left_semi")
    pairs = written(placed.unionByName(begun))
    of = device_status(x.records, pairs)
    return Mapped(x, y, of.select("id", "format", "view", "index_in_view", "source_index", "status", "stage"), pairs)


def device_status(devices: DataFrame, pairs: DataFrame) -> DataFrame:
    """The devices (id, …) with status (matched, partial, unknown or unmatched) and stage (mixed where there are several) by their pairs (id, status, stage, binding_mode)."""
    g = pairs.groupBy("id").agg(F.collect_set(F.when(F.col("binding_mode") != "unavailable", F.col("stage"))).alias("stages"), F.count_if(F.col("status") == "unknown").alias("open"))
    of = devices.join(g, "id", "left")
    some = F.coalesce(F.size("stages") > 0, F.lit(False))
    status = F.when(some & ~F.array_contains("stages", "prefix"), "matched").when(some, "partial").when(F.col("open") > 0, "unknown").otherwise("unmatched")
    stage = F.when(some, F.when(F.size("stages") > 1, "mixed").otherwise(F.element_at("stages", 1)))
    return of.withColumn("status", status).withColumn("stage", stage).drop("stages", "open")


def summary(m: Mapped) -> DataFrame:
    """(what, value, n): devices by status and by stage, pairs by status, and bindings."""
    by = lambda df, c, what: df.groupBy(F.col(c).alias("value")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(what).alias("what"), "value", "n")
    bindings = m.pairs.select(F.lit("bindings").alias("what"), F.lit(None).cast("string").alias("value"), F.size("bindings").cast("long").alias("n")).groupBy("what", "value").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    return by(m.devices, "status", "device status").unionByName(by(m.devices, "stage", "device stage")).unionByName(by(m.pairs, "status", "pair status")).unionByName(bindings)


def graphs_of(m: Mapped) -> DataFrame:
    """(automaton_id, graph): each distinct graph once, a:0, a:1 … by its first appearance."""
    from pyspark.sql import Window

    first = m.pairs.filter("graph is not null").join(m.device.records.select("id", "source_index"), "id").groupBy("graph").agg(F.min(F.struct("source_index", "document_id")).alias("at"))
    return first.select(F.concat(F.lit("a:"), (F.row_number().over(Window.orderBy("at")) - 1).cast("string")).alias("automaton_id"), "graph")


def slots_of(s: Side) -> DataFrame:
    """(id, slot_id, name, declaration, type_id) of every value of every record."""
    rows = [(k, x.slot_id, x.declared.text.strip("<>"), x.declared.text, x.declared.type_id) for k, t in s.trees.items() for x in slots(t)]
    spark = s.records.sparkSession
    return s.records.select("id", "k").join(F.broadcast(spark.createDataFrame(rows, "k string, slot_id string, name string, declaration string, type_id string")), "k").drop("k")


def semantic_lookup(parsed: DataFrame, m: Mapped) -> DataFrame:
    """What documents say of each parsed line: one row per reading and document.

    Columns: config_id, line_no, pattern_id, variation_id, document_id, status, binding_mode, parameters (document slot, device slot, raw,
    normalized, rounds of the document), needs_trace, creates, requires. Documents of the other part of the catalog than the line's are left out.
    """
    x, y = m.device.catalog, m.documentation.catalog
    one = parsed.select("config_id", "line_no", (F.col("depth") > 0).alias("nested"), F.explode("matches").alias("m")).select("config_id", "line_no", "nested", F.col("m.pattern_id").alias("id"), F.col("m.variation_id").alias("variation_id"), F.col("m.parameters").alias("values"))
    record = m.documentation.records.select(F.col("id").alias("document_id"), "view", F.get_json_object("record", "$.creates").alias("creates"), F.get_json_object("record", "$.requires").alias("requires"))
    # a catalog's records, which the driver has had in hand: left to choose, Spark moves all readings by the few documents they are of
    out = one.join(m.pairs, "id").join(F.broadcast(record), "document_id")
    if x.grouped and y.grouped:
        over = F.lit(False) if y.global_view is None else F.col("view") == y.global_view
        out = out.filter(over | ((F.col("view") != y.entry) == F.col("nested")))
    bound = F.flatten(
        F.transform(
            "bindings",
            lambda b: F.transform(
                F.filter("values", lambda v: v["slot_id"] == b["device"]),
                lambda v: F.struct(b["document"].alias("slot_id"), b["device"].alias("device_slot_id"), v["raw"].alias("raw"), v["normalized"].alias("normalized"), F.zip_with(b["document_rounds"], v["iterations"], lambda d, i: F.struct(d.alias("id"), i["n"].alias("n"))).alias("iterations")),
            ),
        )
    )
    whole = F.col("binding_mode") == "structural"
    return out.select("config_id", "line_no", F.col("id").alias("pattern_id"), "variation_id", "document_id", "status", "binding_mode", F.when(whole, bound).alias("parameters"), (~whole).alias("needs_trace"), "creates", "requires")


def direct_lookup(parsed: DataFrame, documentation: Mapping) -> DataFrame:
    """What a documentation catalog says of lines that were read against itself: one row per reading, by its place in the catalog.

    Columns: config_id, line_no, pattern_id, variation_id, view (null in a flat catalog), index_in_view, parameters (name, of declarations in
    angle brackets, slot_id, type_id, raw, normalized, start, end, iterations), creates, requires. A reading of another catalog raises.
    """
    spark = parsed.sparkSession
    rows = [(c.index, c.view, c.index_in_view, c.format, *(json.dumps(c.record.get(k) or []) for k in ("creates", "requires"))) for c in cat.read(documentation).commands]
    record = spark.createDataFrame(rows, "at int, view string, index_in_view int, format string, creates string, requires string")
    one = parsed.select("config_id", "line_no", F.explode("matches").alias("m")).select("config_id", "line_no", "m", F.col("m.pattern_index").alias("at"))
    named = F.filter("m.parameters", lambda p: F.startswith(p["declaration"], F.lit("<")) & F.endswith(p["declaration"], F.lit(">")))
    about = F.transform(named, lambda p: F.struct(F.substr(p["declaration"], F.lit(2), F.length(p["declaration"]) - 2).alias("name"), *(p[c].alias(c) for c in ("slot_id", "type_id", "raw", "normalized", "start", "end", "iterations"))))
    own = F.when(F.col("format").eqNullSafe(F.col("m.original_pattern")), F.col("m.pattern_id")).otherwise(F.raise_error(F.lit("the lines weren't read against this documentation")).cast("string"))
    # left to choose, Spark moves all readings, with all that they hold, by the few formats they are of
    return one.join(F.broadcast(record), "at", "left").select("config_id", "line_no", own.alias("pattern_id"), F.col("m.variation_id").alias("variation_id"), "view", "index_in_view", about.alias("parameters"), "creates", "requires")


def replayed(parsed: DataFrame, m: Mapped) -> DataFrame:
    """(config_id, line_no, pattern_id, document_id, way, bindings): each accepting way of a path-dependent pair, over each reading of each line; a null way where the search ran out."""
    from lineloom.grammar.aligning import replay

    one = parsed.select("config_id", "line_no", F.explode("matches").alias("m")).withColumn("id", F.col("m.pattern_id"))
    todo = one.join(m.pairs.filter("binding_mode = 'path_dependent'").select("id", "document_id", "graph"), "id").select("config_id", "line_no", "id", "document_id", "graph", F.to_json("m").alias("m"))
    kind = dict(parsed.dtypes)["config_id"]
    bound = pa.list_(pa.struct([("document", pa.string()), ("device", pa.string()), ("raw", pa.string()), ("normalized", pa.string()), ("iterations", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            take, ways, found = [], [], []
            for i, (graph, match) in enumerate(zip(b.column(4).to_pylist(), b.column(5).to_pylist(), strict=True)):
                got = json.loads(match)
                got.setdefault("parameters", [])
                every = replay(json.loads(graph), got)
                for n, way in enumerate([None] if every is None else every):
                    take.append(i)
                    ways.append(None if every is None else n)
                    found.append(None if way is None else [{"document": w["document"], "device": w["device"], "raw": w["raw"], "normalized": w["normalized"], "iterations": json.dumps(w["iterations"])} for w in way])
            at = pa.array(take, pa.int32())
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(at) for c in range(4)), pa.array(ways, pa.int32()), pa.array(found, bound)], names=["config_id", "line_no", "pattern_id", "document_id", "way", "bindings"])

    return todo.mapInArrow(run, f"config_id {kind}, line_no int, pattern_id string, document_id string, way int, bindings array<struct<document:string,device:string,raw:string,normalized:string,iterations:string>>")


SCHEMA_VERSION = 1


def _document(s: Side) -> dict:
    """A catalog's document again, from its header and records."""
    out, c = dict(s.catalog.header), s.catalog
    if not c.grouped:
        return out | {"commands": [dict(x.record) for x in c.commands]}
    return out | {"views": {v: [dict(x.record) for x in c.commands if x.view == v] for v in c.views}}


def save_mapping(m: Mapped, path: str) -> None:
    """Tables devices and pairs as Parquet below path, and the catalogs beside them. Spark's committer makes each whole or absent."""
    spark = m.pairs.sparkSession
    m.devices.write.parquet(f"{path}/devices")
    m.pairs.write.parquet(f"{path}/pairs")
    head = [(SCHEMA_VERSION, json.dumps(_document(m.device)), json.dumps(_document(m.documentation)))]
    spark.createDataFrame(head, "schema_version int, device string, documentation string").coalesce(1).write.parquet(f"{path}/catalogs")


def load_mapping(spark: SparkSession, path: str) -> Mapped:
    """A saved mapping; its pairs must name records that its catalogs have."""
    head = spark.read.parquet(f"{path}/catalogs").first()
    if head is None or head["schema_version"] != SCHEMA_VERSION:
        raise cat.CatalogError(f"no mapping of schema version {SCHEMA_VERSION}")
    x = side(spark, json.loads(head["device"]), documents=False, follow=False)
    y = side(spark, json.loads(head["documentation"]), documents=True, follow=False)
    pairs = spark.read.parquet(f"{path}/pairs")
    strange = pairs.join(x.records, "id", "left_anti").select("id").unionByName(pairs.join(y.records.select(F.col("id").alias("document_id")), "document_id", "left_anti").select("id"))
    if not strange.isEmpty():
        raise cat.CatalogError("pairs name records that the catalogs haven't")
    return Mapped(x, y, spark.read.parquet(f"{path}/devices"), pairs)


def flat_catalog(formats: list, source: str) -> dict:
    """A flat catalog of formats, or of records, under a plain header."""
    return {"schema_version": 1, "source": source, "vendor": "-", "device": "-", "model_type": "-", "type": "flat", "commands": [{"format": f} if isinstance(f, str) else f for f in formats]}


def map_formats(spark: SparkSession, targets: list, documents: list, syntax: str = "device", steps: int = MAX_STEPS) -> Mapped:
    """Match formats without views. syntax: whether the targets declare values as devices do, or name them as documents do."""
    if syntax not in ("device", "document"):
        raise ValueError("syntax must be device or document")
    return map_catalogs(spark, flat_catalog(targets, "device" if syntax == "device" else "documentation"), flat_catalog(documents, "documentation"), steps=steps)


def compare(document: str, device: str, types: Mapping[str, str] | None = None, steps: int = MAX_STEPS) -> str:
    """How the language of one documented format stands to that of a device's: equivalent, …, or unknown."""
    t = cat.with_types(parse(document, DOCUMENT, policy=False), dict(types or {}))
    return relation(t, parse(device), steps) or "unknown"
