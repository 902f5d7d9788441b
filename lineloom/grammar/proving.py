"""Shortest lines of a format, witnesses of how two formats differ, and a conservative test that a format reads every line in one way."""

from __future__ import annotations

import heapq

from lineloom.grammar.formats import Many, Node, Pick, Row, first
from lineloom.grammar.languages import MAX_STEPS, Budget, Exhausted, Language, has_types


def _search(languages: list[Language], typed: bool, wanted, steps: int) -> dict:
    """Shortest words, then the first in order, for each name of wanted(accepts) not yet found; {} entries where the budget ends."""
    budget = Budget(steps)
    out: dict[str, tuple[str, ...]] = {}
    try:
        start = tuple(x.start(budget) for x in languages)
        heap, seen = [(0, (), 0, start)], {start}
        serial = 0
        while heap:
            _, said, _, states = heapq.heappop(heap)
            for name in wanted([x.accepts(s) for x, s in zip(languages, states, strict=True)]):
                out.setdefault(name, said)
            moves = [x.moves(s, typed, budget) for x, s in zip(languages, states, strict=True)]
            for k in sorted(set().union(*moves)):
                nxt = tuple(m.get(k, frozenset()) for m in moves)
                if nxt not in seen:
                    budget.spend()
                    seen.add(nxt)
                    serial += 1
                    heapq.heappush(heap, (len(said) + 1, (*said, k), serial, nxt))
    except Exhausted:
        out["_exhausted"] = ()
    return out


def shortest(tree: Row, steps: int = MAX_STEPS) -> tuple[str, ...] | None:
    """The shortest line, as symbols K:word and P; the first in order of equal ones."""
    return _search([Language(tree)], False, lambda a: ["line"] if a[0] else [], steps).get("line")


def witnesses(document: Row, device: Row, steps: int = MAX_STEPS) -> dict[str, tuple[str, ...]]:
    """The shortest lines that both formats have, and that only one has, as far as there are any."""
    name = {(True, True): "common", (True, False): "document_only", (False, True): "device_only"}
    got = _search([Language(document), Language(device)], has_types(document), lambda a: [name[tuple(a)]] if any(a) else [], steps)
    return {k: v for k, v in got.items() if not k.startswith("_")}


def predictive(tree: Node) -> bool:
    """Whether the next symbol always decides: then every line is read in one way. False proves nothing."""

    def firsts(n: Node) -> tuple[set[str], bool]:
        words, value, empty = first(n)
        return {*words, *(["\0value"] if value else [])}, empty

    def clash(a: set[str], b: set[str]) -> bool:
        # a value may read what a word reads
        return bool(a & b) or "\0value" in a and bool(b) or "\0value" in b and bool(a)

    def walk(n: Node, after: set[str]) -> bool:
        if isinstance(n, Row):
            for x in reversed(n.items):
                if not walk(x, after):
                    return False
                own, empty = firsts(x)
                after = own | after if empty else own
            return True
        if isinstance(n, Pick):
            heads = [firsts(c) for c in n.choices]
            if any(e for _, e in heads) or any(clash(a, b) for i, (a, _) in enumerate(heads) for b, _ in heads[:i]):
                return False
            every = set().union(*(a for a, _ in heads))
            if (n.optional or n.unordered) and clash(every, after):
                return False
            return all(walk(c, after | every if n.unordered else after) for c in n.choices)
        if isinstance(n, Many):
            own, empty = firsts(n.body)
            return not empty and (n.low == n.high or not clash(own, after)) and walk(n.body, own | after)
        return True

    return walk(tree, set())
