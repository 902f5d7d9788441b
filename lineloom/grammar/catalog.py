"""Catalogs of command formats: the runtime reader and the strict one of matching, with all their checks."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field, replace

from lineloom.grammar.formats import Many, Node, Pick, Row, Slot, parse
from lineloom.grammar.values import REGISTRY, FormatError, Registry

UNRESOLVED = {"status": "unresolved"}


class CatalogError(ValueError):
    """A catalog that doesn't keep to its schema."""


@dataclass(frozen=True)
class Command:
    """A source record. child: the view it leads to (its own if it stays), None if that isn't known. types: of named values."""

    index: int
    format: str
    view: str | None
    index_in_view: int
    child: str | None
    types: tuple[tuple[str, str], ...] = ()
    record: Mapping = field(default_factory=dict, hash=False, compare=False)


@dataclass(frozen=True)
class Catalog:
    commands: tuple[Command, ...]
    views: tuple[str, ...] = ()
    entry: str | None = None
    global_view: str | None = None
    shared: tuple[str, ...] = ()
    header: Mapping = field(default_factory=dict, hash=False, compare=False)

    @property
    def grouped(self) -> bool:
        return self.entry is not None


def strict_json(text: str):
    """JSON whose objects name no key twice."""

    def once(pairs):
        if len({k for k, _ in pairs}) < len(pairs):
            raise CatalogError(f"an object names a key twice: {[k for k, _ in pairs]}")
        return dict(pairs)

    return json.loads(text, object_pairs_hook=once)


def _need(ok, message: str) -> None:
    if not ok:
        raise CatalogError(message)


def _types(value) -> tuple[tuple[str, str], ...]:
    _need(isinstance(value, (list, tuple)), "parameter_types must be an array")
    out: dict[str, str] = {}
    for v in value:
        _need(isinstance(v, Mapping), "entries of parameter_types must be objects")
        name, kind = v.get("parameter_name"), v.get("parameter_type")
        _need(isinstance(name, str) and name.strip(), "parameter_name must be a text")
        _need(isinstance(kind, str) and kind.strip(), "parameter_type must be a text")
        _need(name not in out, f"{name!r} has its type stated twice")
        out[name] = kind
    return tuple(out.items())


def _groups(doc: Mapping, layout: str) -> tuple[dict, str | None, str | None]:
    """Records by view, the entry view and the global view."""
    if layout == "flat":
        _need(not {"views", "entry_view", "global_view", "shared_views"} & doc.keys(), "a flat catalog has no views")
        return {None: doc.get("commands")}, None, None
    _need(layout == "grouped", "type must be flat or grouped")
    views, entry, over = doc.get("views"), doc.get("entry_view"), doc.get("global_view")
    _need("commands" not in doc, "a grouped catalog has no commands of its own")
    _need(isinstance(views, Mapping) and all(isinstance(v, str) and v.strip() for v in views), "views must map names to arrays")
    _need(isinstance(entry, str) and entry in views, "entry_view must be one of the views")
    if "global_view" in doc:
        _need(isinstance(over, str) and over in views and over != entry, "global_view must be one of the views, and not entry_view")
    return dict(views), entry, over


def _commands(groups: dict, *, follow: bool, record_check) -> list[Command]:
    out: list[Command] = []
    for view, records in groups.items():
        _need(isinstance(records, (list, tuple)), "commands must be an array")
        for i, r in enumerate(records):
            text = r.get("format") if isinstance(r, Mapping) else r
            _need(isinstance(text, str) and text.strip(), f"{view or 'commands'}[{i}]: a format must be a text")
            record = r if isinstance(r, Mapping) else {"format": r}
            record_check(record, view, i)
            to = record.get("switch_to_view")
            if to is None or view is not None and not follow:
                child = view
            elif view is not None and to == UNRESOLVED:
                child = None
            else:
                _need(view is not None and isinstance(to, str) and to in groups, f"{view or 'commands'}[{i}]: switch_to_view must be a view, null, or unresolved")
                child = to
            out.append(Command(len(out), text, view, i, child, _types(record.get("parameter_types", ())), record))
    _need(out, "a catalog must have commands")
    return out


def read(doc: Mapping, *, follow: bool = True) -> Catalog:
    """A catalog as the parser takes it: texts or records, flat by default. follow: check and keep transitions."""
    _need(isinstance(doc, Mapping), "a catalog is an object")
    groups, entry, over = _groups(doc, doc.get("type", "flat"))
    return Catalog(tuple(_commands(groups, follow=follow, record_check=lambda *_: None)), tuple(v for v in groups if v is not None), entry, over, tuple(doc.get("shared_views") or ()), {k: v for k, v in doc.items() if k not in ("commands", "views")})


def read_v1(doc: Mapping, *, follow: bool = True) -> Catalog:
    """A catalog as the matcher takes it: with a header, and records alone."""
    _need(isinstance(doc, Mapping), "a catalog is an object")
    _need(type(doc.get("schema_version")) is int and doc["schema_version"] == 1, "schema_version must be 1")
    _need(doc.get("source") in ("device", "documentation"), "source must be device or documentation")
    for k in ("vendor", "device", "model_type"):
        _need(isinstance(doc.get(k), str) and doc[k].strip(), f"{k} must be a text")
    groups, entry, over = _groups(doc, doc.get("type", ""))
    shared = doc.get("shared_views", [])
    if follow and entry is not None:
        _need(isinstance(shared, list) and all(isinstance(v, str) and v in groups for v in shared) and len(set(shared)) == len(shared) and entry not in shared, "shared_views must be distinct views other than entry_view")

    def check(r: Mapping, view: str | None, i: int) -> None:
        at = f"{view or 'commands'}[{i}]"
        _need("\n" not in r["format"] and "\r" not in r["format"], f"{at}: a format is one line")
        _need("id" not in r, f"{at}: ids are made here")
        _need(doc["source"] != "device" or "parameter_types" not in r, f"{at}: types of a device stand in its formats")
        _need(view is not None or "switch_to_view" not in r, f"{at}: no views to switch to")

    for records in groups.values():
        _need(isinstance(records, list) and all(isinstance(r, Mapping) for r in records), "commands must be arrays of objects")
    return Catalog(tuple(_commands(groups, follow=follow, record_check=check)), tuple(v for v in groups if v is not None), entry, over, tuple(shared), {k: v for k, v in doc.items() if k not in ("commands", "views")})


def valid_part(document: Mapping, read_one: Callable[[str, Mapping[str, str]], object]) -> tuple[dict, list[dict]]:
    """The catalog without the commands that read_one(format, types) refuses with a FormatError, and these: view, index in it, format and error.

    All else stays as it is; a view may end up without a command. An error of the catalog itself is raised.
    """
    wrong: dict[int, str] = {}
    commands = read(document).commands
    for c in commands:
        try:
            read_one(c.format, dict(c.types))
        except FormatError as e:
            wrong[c.index] = str(e)
    places = {(c.view, c.index_in_view) for c in commands if c.index in wrong}
    kept = lambda rows, view: [x for i, x in enumerate(rows) if (view, i) not in places]
    out = dict(document)
    if "views" in document:
        out["views"] = {v: kept(rows, v) for v, rows in document["views"].items()}
    else:
        out["commands"] = kept(document["commands"], None)
    return out, [{"view": c.view, "index": c.index_in_view, "format": c.format, "error": wrong[c.index]} for c in commands if c.index in wrong]


def with_types(tree: Node, types: Mapping[str, str], registry: Registry = REGISTRY) -> Node:
    """The tree with the stated types in place of named values; bounds and built-in types stay. A name that isn't there is an error."""
    for name, kind in types.items():
        if kind != "unknown" and (kind not in registry.types or registry.types[kind].family == "enum"):
            raise FormatError(f"{kind!r} is no type for {name!r}")
    unused = set(types)

    def walk(n: Node) -> Node:
        if isinstance(n, Slot):
            name = n.declared.text[1:-1] if n.declared.text[:1] == "<" and n.declared.text[-1:] == ">" else None
            unused.discard(name)
            kind = types.get(name, "unknown") if name else "unknown"
            return replace(n, declared=replace(n.declared, type_id=kind)) if n.declared.type_id == "named" and kind != "unknown" else n
        if isinstance(n, Row):
            return Row(tuple(map(walk, n.items)))
        if isinstance(n, Pick):
            return replace(n, choices=tuple(map(walk, n.choices)))
        return replace(n, body=walk(n.body)) if isinstance(n, Many) else n

    out = walk(tree)
    if unused:
        raise FormatError(f"types are stated for names that aren't there: {sorted(unused)}")
    return out


def trees(catalog: Catalog, registry: Registry = REGISTRY) -> dict[tuple, Row]:
    """Trees by (format, types); all failures are gathered before one is raised."""
    out, wrong = {}, []
    for c in catalog.commands:
        k = c.format, c.types
        if k not in out:
            try:
                out[k] = with_types(parse(c.format, registry), dict(c.types), registry)
            except FormatError as e:
                wrong.append(f"{c.index}: {c.format!r}: {e} ({e.start}-{e.end})")
    if wrong:
        raise FormatError("; ".join(wrong))
    return out


def pattern_ids(texts: list[str]) -> list[str]:
    """pattern:<hash>:<occurrence> of each format in order."""
    seen: dict[str, int] = {}
    out = []
    for t in texts:
        n = seen.get(t, 0)
        seen[t] = n + 1
        out.append(f"pattern:{hashlib.sha256(t.encode()).hexdigest()[:20]}:{n}")
    return out


def recovered(doc: Mapping, catalog: Catalog, transitions: Mapping[int, str | None]) -> dict:
    """The document with the transitions found: a view, none for those that stay, unresolved for the rest."""
    out = json.loads(json.dumps(doc))
    for c in catalog.commands:
        record = out["views"][c.view][c.index_in_view]
        if c.index not in transitions:
            record["switch_to_view"] = dict(UNRESOLVED)
        elif transitions[c.index] is None:
            record.pop("switch_to_view", None)
        else:
            record["switch_to_view"] = transitions[c.index]
    return out
