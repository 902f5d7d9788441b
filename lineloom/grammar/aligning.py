"""Values of two formats of one shape that stand for each other, and the replay of a product's ways over a parsed line."""

from __future__ import annotations

from collections import defaultdict

from lineloom.grammar.formats import Many, Node, Pick, Row, Slot, shape
from lineloom.grammar.values import fold


def plain(n: Node) -> Node:
    """Without braces around one thing, and without sequences of one."""
    while True:
        if isinstance(n, Pick) and len(n.choices) == 1 and not n.optional and not n.unordered:
            n = n.choices[0]
        elif isinstance(n, Row) and len(n.items) == 1:
            n = n.items[0]
        else:
            return n


def flat(n: Node) -> list[Node]:
    n = plain(n)
    return [y for x in n.items for y in flat(x)] if isinstance(n, Row) else [n]


def aligned(document: Node, device: Node, ordered: bool, typed: bool, rounds: tuple = ((), ())) -> list[tuple[Slot, Slot, tuple, tuple]]:
    """(document slot, device slot, ids of the repeats around each). Unordered choices pair by shape, the n-th of a shape with the n-th."""
    a, b = (document, device) if ordered else (plain(document), plain(device))
    if isinstance(a, Slot):
        return [(a, b, *rounds)]
    if isinstance(a, Many):
        return aligned(a.body, b.body, ordered, typed, ((*rounds[0], f"r:{a.at}"), (*rounds[1], f"r:{b.at}")))
    if isinstance(a, Row):
        pairs = zip(a.items, b.items, strict=True) if ordered else zip(flat(a), flat(b), strict=True)
        return [x for p, q in pairs for x in aligned(p, q, ordered, typed, rounds)]
    if not isinstance(a, Pick):
        return []
    if ordered:
        return [x for p, q in zip(a.choices, b.choices, strict=True) for x in aligned(p, q, ordered, typed, rounds)]
    waiting: dict[str, list[Node]] = defaultdict(list)
    for q in b.choices:
        waiting[shape(q, False, typed)].append(q)
    return [x for p in a.choices for x in aligned(p, waiting[shape(p, False, typed)].pop(0), ordered, typed, rounds)]


def replay(graph: dict, match: dict, limit: int = 200_000) -> list[list[dict]] | None:
    """What each accepting way of a product binds, for a parsed line: (document slot, its rounds, device slot, raw, normalized). None: beyond the limit.

    The device side of a way must say what the match said: the same words, and values of the same slots in the same rounds.
    """
    atoms: list[tuple] = []
    values = iter(match["parameters"])
    held = {p["declaration"] for p in match["parameters"]}
    left = list(match["parameters"])
    for part in _parts(match["variation"], held):
        if left and part == left[0]["declaration"]:
            v = next(values)
            left.pop(0)
            atoms.append((int(v["slot_id"][2:]), [[i["id"], i["n"]] for i in v["iterations"]], v))
        else:
            atoms.append((fold(part), None, None))
    out = defaultdict(list)
    for e in graph["edges"]:
        out[e[0]].append(e)
    ends, found, stack, steps = set(graph["ends"]), [], [(s, 0, ()) for s in graph["starts"]], 0
    while stack:
        node, at, bound = stack.pop()
        steps += 1
        if steps > limit:
            return None
        if at == len(atoms):
            if node in ends and list(bound) not in found:
                found.append(list(bound))
            continue
        what, rounds, v = atoms[at]
        for _, to, label, doc, doc_rounds, dev, dev_rounds in out[node]:
            if v is None and label == f"K:{what}":
                stack.append((to, at + 1, bound))
            elif v is not None and dev == what and [list(r) for r in dev_rounds] == rounds:
                stack.append((to, at + 1, (*bound, {"document": f"p:{doc}", "iterations": doc_rounds, "device": f"p:{dev}", "raw": v["raw"], "normalized": v["normalized"]})))
    return found


def _parts(variation: str, declarations: set[str]) -> list[str]:
    """Words and declarations of a variation; a declaration may have spaces in it."""
    out, words = [], variation.split(" ")
    i = 0
    while i < len(words):
        n = next((k for k in range(len(words), i, -1) if " ".join(words[i:k]) in declarations), i + 1)
        out.append(" ".join(words[i:n]))
        i = n
    return out
