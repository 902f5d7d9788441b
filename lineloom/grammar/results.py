"""What a line turns into: matches, errors and their wording, as plain dictionaries in the shape of the result columns."""

from __future__ import annotations

import hashlib
import json

from lineloom.grammar.program import Outcome, Path, dominates, skyline
from lineloom.grammar.values import INVALID, OTHER, Registry, fold, issue

#: Most failures and expectations that a message shows.
SHOWN_FAILURES, SHOWN_EXPECTED = 3, 5

PARAMETER = "struct<type_id:string,declaration:string,raw:string,normalized:string,start:int,end:int,slot_id:string,iterations:array<struct<id:string,n:int>>>"
MATCH = f"struct<pattern_id:string,pattern_index:int,original_pattern:string,variation:string,variation_id:string,parameters:array<{PARAMETER}>,trace:array<struct<kind:string,path:string,selected:array<string>>>,source_view:string>"
FAILURE = "struct<type_id:string,declaration:string,raw:string,start:int,end:int,message:string,reason_code:string,expected:string,actual:string>"
ERROR = f"struct<code:string,message:string,position:int,expected:array<struct<description:string,position:int>>,failures:array<{FAILURE}>,candidate_patterns:array<string>,candidate_variations:array<string>,suggestions:array<string>>"
ISSUE = "struct<code:string,message:string,source_line:int>"

#: Messages of context issues.
ISSUES = {
    "parent_parse_error": "The parent command could not be parsed; its child view is unknown.",
    "unresolved_transition": "The parent command has an unresolved view transition.",
    "ambiguous_transition": "The parent command matches formats with different view transitions.",
}


def outside_issue(view: str, line: int) -> dict:
    return {"code": "outside_view", "message": f"Parsing failed in view {view!r}. Complete matches were found in other views; the context is unconfirmed.", "source_line": line}


def context_issue(code: str, line: int) -> dict:
    return {"code": code, "message": ISSUES[code], "source_line": line}


class Candidate:
    """A path of one source format."""

    __slots__ = ("index", "path", "pattern", "pattern_id", "view")

    def __init__(self, path: Path, index: int, pattern: str, pattern_id: str, view: str | None):
        self.path, self.index, self.pattern, self.pattern_id, self.view = path, index, pattern, pattern_id, view

    def match(self, offset: int) -> dict:
        p = self.path
        variation = " ".join(p.parts)
        trace = [{"kind": k, "path": place, "selected": [str(x) for x in chosen]} for k, place, chosen in p.trace()]
        told = "\0".join((self.pattern_id, fold(variation), json.dumps(trace)))
        return {
            "pattern_id": self.pattern_id,
            "pattern_index": self.index,
            "original_pattern": self.pattern,
            "variation": variation,
            "variation_id": hashlib.sha256(told.encode()).hexdigest()[:20],
            "parameters": [
                {"type_id": c.slot.declared.type_id, "declaration": c.slot.declared.text, "raw": c.raw, "normalized": str(c.normal), "start": c.start + offset, "end": c.end + offset, "slot_id": c.slot.slot_id, "iterations": [{"id": i, "n": n} for i, n in c.iterations]}
                for c in p.captured
            ],
            "trace": trace,
            "source_view": self.view,
        }


def _same(m: dict) -> tuple:
    """Matches alike in this are one."""
    return m["pattern_id"], fold(m["variation"]), tuple((v["type_id"], v["declaration"], v["raw"], v["slot_id"], tuple((i["id"], i["n"]) for i in v["iterations"])) for v in m["parameters"])


def _meaning(m: dict) -> tuple:
    """Matches alike in this say the same."""
    return fold(m["variation"]), tuple((v["type_id"], v["declaration"], v["raw"], v["normalized"]) for v in m["parameters"])


def matches_of(candidates: list[Candidate], offset: int) -> list[dict]:
    """In order of sources and decisions, each once."""
    ordered = sorted(range(len(candidates)), key=lambda i: (candidates[i].index, candidates[i].path.order, i))
    out: dict[tuple, dict] = {}
    for i in ordered:
        m = candidates[i].match(offset)
        out.setdefault(_same(m), m)
    return list(out.values())


def status_of(matches: list[dict]) -> str:
    if len({m["source_view"] for m in matches}) > 1:
        return "ambiguous"
    if len(matches) == 1:
        return "unique"
    slots: dict[str, set] = {}
    for m in matches:
        slots.setdefault(m["pattern_id"], set()).add(tuple((v["slot_id"], tuple((i["id"], i["n"]) for i in v["iterations"])) for v in m["parameters"]))
    return "equivalent" if all(len(s) == 1 for s in slots.values()) and len({_meaning(m) for m in matches}) == 1 else "ambiguous"


def settle(candidates: list[Candidate], offset: int, retain_all: bool = False) -> tuple[list[dict], dict | None]:
    """(matches, None) or ([], error): the least dominated valid readings, unless a more specific one fails its values."""
    valid = [c for c in candidates if c.path.valid]
    if valid and retain_all:
        return matches_of(valid, offset), None
    best = _front(valid)
    wrong = _front([c for c in candidates if not c.path.valid and all(r.status == INVALID for r in c.path.rejected)])
    free = [c for c in best if not any(dominates(w.path.ranks, c.path.ranks) for w in wrong)]
    if free:
        return matches_of(free, offset), None
    if best:
        blame = [w for w in wrong if any(dominates(w.path.ranks, c.path.ranks) for c in best)]
    else:
        blame = wrong or _front([c for c in candidates if not c.path.valid])
    return [], validation_error(blame, offset)


def _front(candidates: list[Candidate]) -> list[Candidate]:
    left = {id(p) for p in skyline([c.path for c in candidates])}
    return [c for c in candidates if id(c.path) in left]


def _once(items: list) -> list:
    return list(dict.fromkeys(items))


def validation_error(candidates: list[Candidate], offset: int) -> dict:
    ordered = sorted(candidates, key=lambda c: c.index)
    failures = []
    for c in ordered:
        for r in c.path.rejected:
            d = r.declared
            if r.status == OTHER:
                message, code, wanted, actual = f"value does not match {d.text}", "not_applicable", d.text, r.raw
            else:
                message, wanted = issue(d, r.code)
                code, actual = r.code, r.raw
            failures.append((d.type_id, d.text, r.raw, r.start + offset, r.end + offset, message, code, wanted, actual))
    failures = _once(failures)
    patterns = _once([c.pattern for c in ordered])
    shown = "; ".join(f"value {f[2]!r} is invalid for {f[1]}: {f[5]}" for f in failures[:SHOWN_FAILURES])
    if (more := len(failures) - SHOWN_FAILURES) > 0:
        shown += f"; and {more} more {'failure' if more == 1 else 'failures'}"
    what = f"pattern {patterns[0]!r}" if len(patterns) == 1 else f"{len(patterns)} candidate patterns"
    return {
        "code": "validation_error",
        "message": f"The command structure matched {what}, but {len(failures)} parameter {'value' if len(failures) == 1 else 'values'} failed validation: {shown}. Inspect failures, candidate_patterns, and candidate_variations for complete details.",
        "position": failures[0][3] if failures else None,
        "expected": [],
        "failures": [dict(zip(("type_id", "declaration", "raw", "start", "end", "message", "reason_code", "expected", "actual"), f, strict=True)) for f in failures],
        "candidate_patterns": patterns,
        "candidate_variations": _once([" ".join(c.path.parts) for c in ordered]),
        "suggestions": [],
    }


def listed(items: list[str]) -> str:
    """a; a or b; a, b, or c; a, b, c, d, e, and 2 more options."""
    shown, more = items[:SHOWN_EXPECTED], len(items) - SHOWN_EXPECTED
    if not shown:
        return "a valid continuation"
    joined = shown[0] if len(shown) == 1 else " or ".join(shown) if len(shown) == 2 else f"{', '.join(shown[:-1])}, or {shown[-1]}"
    return f"{joined}, and {more} more {'option' if more == 1 else 'options'}" if more > 0 else joined


def syntax_error(command: str, o: Outcome, offset: int, suggestions: list[str]) -> dict:
    expected = sorted(o.expected)
    unknown = o.furthest == 0
    reason = "No complete command pattern accepted the first token." if unknown else f"Parsing stopped at column {o.furthest + offset + 1}; expected {listed(expected)}."
    if suggestions:
        rows = "\n".join(f"  {i}. {s}" for i, s in enumerate(suggestions, 1))
        message = f"Command {command!r} was not recognized. Did you mean:\n{rows}\nReason: {reason}"
    else:
        if not o.may_suggest:
            end = "Keyword suggestions were not generated because an applicable parameter-led pattern matched farther than any literal-led pattern."
        else:
            end = f"No {'similar' if unknown else 'sufficiently similar'} literal command patterns were found."
        message = f"Command {command!r} was not recognized. {reason} {end}"
    return {
        "code": "unknown_command" if unknown else "syntax_error",
        "message": message,
        "position": o.furthest + offset,
        "expected": [{"description": e, "position": o.furthest + offset} for e in expected],
        "failures": [],
        "candidate_patterns": [],
        "candidate_variations": [],
        "suggestions": suggestions,
    }


__all__ = ["Candidate", "Registry", "context_issue", "matches_of", "outside_issue", "settle", "status_of", "syntax_error", "validation_error"]
