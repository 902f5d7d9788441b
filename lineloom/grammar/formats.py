"""Formats as trees, and what follows from their shape: keys, first tokens, symbols and bounded prefixes."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

from lineloom.grammar.values import REGISTRY, Declared, FormatError, Registry, category, fold

MAX_DEPTH, MAX_WIDTH = 8, 64


@dataclass(frozen=True)
class Word:
    text: str
    at: int = -1


@dataclass(frozen=True)
class Slot:
    declared: Declared
    at: int = -1

    @property
    def slot_id(self) -> str:
        return f"p:{self.at}"


@dataclass(frozen=True)
class Many:
    """low to high copies of a body."""

    body: Node
    low: int
    high: int
    at: int = -1


@dataclass(frozen=True)
class Pick:
    """One of the choices, none if optional; several in any order if unordered."""

    choices: tuple[Node, ...]
    optional: bool
    unordered: bool
    at: int = -1


@dataclass(frozen=True)
class Row:
    items: tuple[Node, ...]


Node = Word | Slot | Many | Pick | Row

_REPEAT = re.compile(r"&<\s*(\d+)\s*-\s*(\d+)\s*>")
_STOP = re.compile(r"[\s{}\[\]|*&]")
_LIKE_DECLARATION = re.compile(r"^(?:[A-Z]+<|ENUM\{|<[^>]*>?$)")


def lex(text: str, registry: Registry = REGISTRY) -> Iterator[tuple[str, object, int, int]]:
    """(kind, value, start, end): declaration, repeat, symbol or word."""
    at = 0
    while at < len(text):
        if text[at].isspace():
            at += 1
        elif (found := registry.read(text, at)) is not None:
            yield "declaration", found[0], at, found[1]
            at = found[1]
        elif m := _REPEAT.match(text, at):
            yield "repeat", (int(m[1]), int(m[2])), at, m.end()
            at = m.end()
        elif text[at] in "{}[]|*":
            yield "symbol", text[at], at, at + 1
            at += 1
        elif text[at] == "&":
            raise FormatError("a stray &", at, at + 1)
        elif text[at] == "<" and registry.angled:
            raise FormatError("no placeholder begins here", at, at + 1)
        else:
            m2 = _STOP.search(text, at)
            end = m2.start() if m2 else len(text)
            yield "word", text[at:end], at, end
            at = end


def parse(text: str, registry: Registry = REGISTRY, policy: bool = True) -> Row:
    """The tree of a format. policy: what the recogniser asks for besides, which formats of documents need not keep to."""
    tokens = list(lex(text, registry))
    place = 0

    def peek(*symbols: str) -> bool:
        return place < len(tokens) and tokens[place][0] == "symbol" and tokens[place][1] in symbols

    def fail(message: str):
        start, end = tokens[place][2:] if place < len(tokens) else (len(text), len(text))
        raise FormatError(message, start, end)

    def repeated(node: Node, at: int) -> Node:
        nonlocal place
        if place < len(tokens) and tokens[place][0] == "repeat":
            low, high = tokens[place][1]
            if low > high:
                fail("the bounds of a repeat are the wrong way round")
            if isinstance(node, Word):
                fail("only a declaration or a group can be repeated")
            place += 1
            return Many(node, low, high, at)
        return node

    def row(within: bool) -> Row:
        nonlocal place
        items: list[Node] = []
        while place < len(tokens):
            kind, value, start, _ = tokens[place]
            if kind == "word":
                place += 1
                items.append(Word(str(value), start))
            elif kind == "declaration":
                place += 1
                items.append(repeated(Slot(value, start), start))
            elif peek("{", "["):
                items.append(group())
            elif peek("*") or (peek("|") and not within):
                place += 1
                items.append(Word(str(value), start))
            elif kind == "repeat":
                fail("a repeat of nothing")
            else:
                break
        if not items:
            fail("an empty sequence")
        return Row(tuple(items))

    def group() -> Node:
        nonlocal place
        opening, start = tokens[place][1], tokens[place][2]
        place += 1
        choices = [row(True)]
        while peek("|"):
            place += 1
            choices.append(row(True))
        if not peek("}" if opening == "{" else "]"):
            fail("a group isn't closed")
        place += 1
        unordered = peek("*")
        if unordered:
            place += 1
        return repeated(Pick(tuple(choices), opening == "[", unordered, start), start)

    out = row(False)
    if place < len(tokens):
        fail("a bracket that closes nothing")
    if policy:
        check(out)
    return out


def check(tree: Node) -> None:
    """Policy: nothing may look like a declaration that isn't one; a value that takes the rest of the line stands last, and not in a repeat."""

    def walk(n: Node, last: bool, inside: bool) -> None:
        if isinstance(n, Word):
            if _LIKE_DECLARATION.match(n.text):
                raise FormatError(f"{n.text} looks like a declaration", n.at, n.at + len(n.text))
        elif isinstance(n, Slot):
            if n.declared.takes_rest and (not last or inside):
                raise FormatError(f"{n.declared.text} must end the format", n.at, n.at + len(n.declared.text))
        elif isinstance(n, Row):
            for i, x in enumerate(n.items):
                walk(x, last and i == len(n.items) - 1, inside)
        elif isinstance(n, Pick):
            for x in n.choices:
                walk(x, last and not n.unordered, inside or n.unordered)
        else:
            walk(n.body, False, True)

    walk(tree, True, False)


def slots(tree: Node) -> Iterator[Slot]:
    if isinstance(tree, Slot):
        yield tree
    for x in tree.items if isinstance(tree, Row) else tree.choices if isinstance(tree, Pick) else (tree.body,) if isinstance(tree, Many) else ():
        yield from slots(x)


def is_linear(tree: Row) -> bool:
    """Words and values alone: one path, which joins can follow."""
    return all(isinstance(x, (Word, Slot)) for x in tree.items)


def shape(tree: Node, ordered: bool = True, types: bool = False) -> str:
    """A text that formats of one shape share, whatever their parameters' names and bounds; choices sorted unless ordered."""
    if isinstance(tree, Word):
        return f"w({fold(tree.text)})"
    if isinstance(tree, Slot):
        return f"p({category(tree.declared.type_id) or '?'})" if types else "p"
    if isinstance(tree, Many):
        return f"m{tree.low}-{tree.high}({shape(tree.body, ordered, types)})"
    if isinstance(tree, Row):
        parts: list[str] = []
        for x in tree.items:
            inner = x
            while not ordered and isinstance(inner, Pick) and len(inner.choices) == 1 and not inner.optional and not inner.unordered:
                inner = inner.choices[0]
            s = shape(inner, ordered, types)
            parts.append(s[2:-1] if not ordered and isinstance(inner, Row) and s.startswith("r(") else s)
        return f"r({','.join(parts)})"
    parts = [shape(x, ordered, types) for x in tree.choices]
    return f"{'o' if tree.optional else 'c'}{'*' if tree.unordered else ''}({'|'.join(parts if ordered else sorted(parts))})"


def key(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()[:20]


def first(tree: Node) -> tuple[frozenset[str], bool, bool]:
    """Words that may come first, whether a value may, and whether nothing may."""
    if isinstance(tree, Word):
        return frozenset((fold(tree.text),)), False, False
    if isinstance(tree, Slot):
        return frozenset(), True, False
    if isinstance(tree, Many):
        w, p, e = first(tree.body)
        return w, p, e or tree.low == 0
    words: frozenset[str] = frozenset()
    value = False
    if isinstance(tree, Row):
        for x in tree.items:
            w, p, e = first(x)
            words, value = words | w, value or p
            if not e:
                return words, value, False
        return words, value, True
    empty = tree.optional
    for x in tree.choices:
        w, p, e = first(x)
        words, value, empty = words | w, value or p, empty or e
    return words, value, empty


def leading_words(tree: Row, folded: bool = True) -> list[str]:
    """The words every line of this format begins with."""
    out = []
    for x in tree.items:
        if not isinstance(x, Word):
            break
        out.append(fold(x.text) if folded else x.text)
    return out


def symbols(tree: Node) -> tuple[frozenset[str], frozenset[str], bool]:
    """Words in every line, words in any line, and whether a value may stand for a word."""
    if isinstance(tree, Word):
        s = frozenset((fold(tree.text),))
        return s, s, False
    if isinstance(tree, Slot):
        return frozenset(), frozenset(), True
    if isinstance(tree, Many):
        r, p, v = symbols(tree.body)
        return (r if tree.low else frozenset()), p, v
    parts = [symbols(x) for x in (tree.items if isinstance(tree, Row) else tree.choices)]
    possible = frozenset().union(*(p for _, p, _ in parts))
    value = any(v for *_, v in parts)
    if isinstance(tree, Row):
        return frozenset().union(*(r for r, *_ in parts)), possible, value
    return (frozenset() if tree.optional else frozenset.intersection(*(r for r, *_ in parts))), possible, value


def prefixes(tree: Node, depth: int = MAX_DEPTH, width: int = MAX_WIDTH) -> set[tuple[str, ...]]:
    """Beginnings that together cover every line of the format: of `depth` symbols, or shorter where a line ends or there'd be too many. P is a value."""
    Item = tuple[tuple[str, ...], bool]  # a beginning, and whether it goes on

    def limited(items: set[Item]) -> set[Item]:
        n = depth
        while len(items) > width and n:
            n -= 1
            items = {(p[:n], go and len(p) < n) if len(p) > n else (p, go) for p, go in items}
        return items

    def extend(begun: set[Item], node: Node) -> set[Item]:
        out = {x for x in begun if not x[1] or len(x[0]) >= depth}
        live = begun - out
        if not live:
            return out
        if isinstance(node, (Word, Slot)):
            s = f"K:{fold(node.text)}" if isinstance(node, Word) else "P"
            out |= {((*p, s), True) for p, _ in live}
        elif isinstance(node, Row):
            for x in node.items:
                live = extend(live, x)
            out |= live
        elif isinstance(node, Many):
            now = live
            for i in range(min(node.high, depth + 1)):
                if i >= node.low:
                    out |= now
                now = extend(now, node.body)
            out |= now
        else:
            if node.optional:
                out |= live
            for x in node.choices:
                got = extend(live, x)
                # a set may go on with any other choice: from here on all is open
                out |= {(p, False) for p, _ in got} if node.unordered else got
        return limited(out)

    return {p for p, _ in extend({((), True)}, tree)}
