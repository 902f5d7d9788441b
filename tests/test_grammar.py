"""The grammar against an independent generator of all lines of a format."""

import itertools

import pytest

from lineloom.grammar.formats import Many, Pick, Row, Slot, Word, is_linear, parse, prefixes, shape, slots, symbols
from lineloom.grammar.languages import included, intersection, relation
from lineloom.grammar.program import Program, dominates, recognize, resolve
from lineloom.grammar.values import FormatError, Registry, ValueType, fold, probe

LONGEST = 6


def lines(n) -> set:
    """All lines of a format of words, up to LONGEST."""
    if isinstance(n, Word):
        return {(fold(n.text),)}
    if isinstance(n, Row):
        out = {()}
        for x in n.items:
            out = {a + b for a in out for b in lines(x) if len(a + b) <= LONGEST}
        return out
    if isinstance(n, Many):
        body, now, out = {w for w in lines(n.body) if w}, {()}, set()
        for i in range(n.high + 1):
            out |= now if i >= n.low else set()
            now = {x + y for x in now for y in body if len(x + y) <= LONGEST}
        return out
    out = {()} if n.optional else set()
    if not n.unordered:
        return out.union(*(lines(c) for c in n.choices))
    parts = [{w for w in lines(c) if w} for c in n.choices]
    for r in range(1, len(parts) + 1):
        for order in itertools.permutations(parts, r):
            now = {()}
            for p in order:
                now = {x + y for x in now for y in p if len(x + y) <= LONGEST}
            out |= now
    return out


FORMATS = ["a", "a b", "{ a | b }", "[ a ] b", "{ a | b } *", "[ a | b ] *", "{ a | b } &<1-3>", "{ a [ b ] } *", "[ a [ b ] | b ] * a", "{ { a | b } * } &<1-2>", "[ [ a ] b ]", "{ a } &<0-2> b"]


@pytest.mark.parametrize("text", FORMATS)
def test_recognition_is_the_language(text):
    tree = parse(text)
    program = Program(tree)
    want = {w for w in lines(tree) if len(w) <= 4}
    got = {w for k in range(5) for w in itertools.product("ab", repeat=k) if recognize(program, " ".join(w)).accepted}
    assert got == want


@pytest.mark.parametrize("x,y", list(itertools.product(FORMATS[:10], repeat=2)))
def test_relations_agree_with_the_languages(x, y):
    a, b = lines(parse(x)), lines(parse(y))
    got = relation(parse(x), parse(y))
    if a == b:
        assert got == "equivalent"
    elif not a & b:
        assert got in ("disjoint", "prefix_only")
    elif a < b:
        assert got == "document_subset"
    elif b < a:
        assert got == "device_subset"
    else:
        assert got == "overlap"
    assert included(parse(x), [parse(y)]) == (a <= b)
    assert intersection(parse(x), parse(y)).nonempty == bool(a & b)


@pytest.mark.parametrize("x,y", list(itertools.product(FORMATS, repeat=2)))
def test_indexes_keep_all_pairs_that_meet(x, y):
    if not lines(parse(x)) & lines(parse(y)):
        return
    px, py = prefixes(parse(x)), prefixes(parse(y))
    assert any(p[: min(len(p), len(q))] == q[: min(len(p), len(q))] for p in px for q in py)
    rx, sx, _ = symbols(parse(x))
    ry, sy, _ = symbols(parse(y))
    assert rx <= sy and ry <= sx


def test_union_of_choices_and_budget():
    assert included(parse("c { a | b }"), [parse("c a"), parse("c b")])
    assert included(parse("c { a } &<1-3>"), [parse("c a"), parse("c a a a")]) is False
    assert included(parse("{ a | b | c | d } *"), [parse("{ a | b | c | d } *")], steps=20) is None
    assert relation(parse("{ a | b | c } *"), parse("{ a | b | c } *"), steps=10) is None


def test_types_in_relations():
    assert relation(parse("c <id> a"), parse("c INTEGER<1-100> b")) == "prefix_only"
    assert relation(parse("c INTEGER<1-9>"), parse("c X.X.X.X")) == "prefix_only"
    assert relation(parse("c INTEGER<1-9>"), parse("c INTEGER<1-100>")) == "equivalent"
    assert intersection(parse("v <id> n <x>"), parse("v INTEGER<1-99> [ n STRING<1-9> ]")).bindings == ((2, 2), (9, 20))


def test_shapes():
    assert shape(parse("c { a | b }"), False) == shape(parse("c { b | a }"), False)
    assert shape(parse("c { a | b }")) != shape(parse("c { b | a }"))
    assert shape(parse("c { a }"), False) == shape(parse("c a"), False)
    assert is_linear(parse("a <x>")) and not is_linear(parse("a [ b ]"))
    assert [s.slot_id for s in slots(parse("a <x> b <y>"))] == ["p:2", "p:8"]


@pytest.mark.parametrize("text", ["", "{ a", "a }", "{ }", "a & b", "a &<1-2>", "{ a } &<3-1>", "INTEGER<5", "TEXT<1-9> b", "{ TEXT<1-9> } &<1-2>", "INTEGER<9-1>", "ENUM{a,A}", "{ a | }"])
def test_malformed_formats(text):
    with pytest.raises(FormatError):
        parse(text)


@pytest.mark.parametrize(
    "declaration,raw,status,normal",
    [
        ("INTEGER<1-15>", "abc", "not_applicable", None),
        ("INTEGER<1-15>", "16", "invalid", None),
        ("INTEGER<1-15>", "+07", "valid", 7),
        ("HEX<80-FD>", "0xfd", "valid", 253),
        ("H-H-H", "1-aB-CD09", "valid", "0001-00ab-cd09"),
        ("H-H-H", "1-2", "invalid", None),
        ("X:X::X:X/M", "2001:0DB8::0001/064", "valid", "2001:db8::1/64"),
        ("X:X::X:X", "fe80::1%eth0", "invalid", None),
        ("X.X.X.X", "010.1.1.1", "valid", "10.1.1.1"),
        ("X.X.X.X", "1.1.1.256", "invalid", None),
        ("MM-DD", "02-29", "valid", "02-29"),
        ("YYYY-MM-DD", "2023-02-29", "invalid", None),
        ("YYYY-MM-DD", "0000-01-01", "invalid", None),
        ("ENUM{Up,down}", "UP", "valid", "Up"),
        ("STRING<2-3>", "abcd", "invalid", None),
        ("<any>", "x", "valid", "x"),
        ("HH:MM:SS", "24:00:00", "invalid", None),
    ],
)
def test_probes(declaration, raw, status, normal):
    p = probe(declaration, raw)
    assert (p.status, p.normal) == (status, normal)


def test_more_specific_readings_win():
    o = [p for f in ("old <x>", "old INTEGER<1-9>") for p in recognize(Program(parse(f)), "old 5").accepted]
    kind, best = resolve(o)
    assert kind == "matched" and len(best) == 1 and best[0].captured[0].normal == 5
    o = [p for f in ("old <x>", "old INTEGER<1-9>") for p in recognize(Program(parse(f)), "old 50").accepted]
    assert resolve(o)[0] == "invalid"  # the invalid number blocks the general reading
    assert dominates((0, 1), (0, 2, 5)) and not dominates((), (1,))


def test_repeat_coordinates():
    o = recognize(Program(parse("vlan { INTEGER<1-99> [ to INTEGER<1-99> ] } &<1-3>")), "vlan 10 to 20 30")
    assert [(c.normal, c.iterations[0][1]) for c in o.accepted[0].captured] == [(10, 0), (20, 0), (30, 1)]


def test_custom_types():
    import re

    r = Registry()
    from lineloom.grammar.values import Probe

    r.add(ValueType("even", "numeric", lambda d, raw: Probe("valid", int(raw)) if raw.isdigit() and int(raw) % 2 == 0 else Probe("invalid"), re.compile("EVEN")))
    p = Program(parse("n EVEN", r))
    assert recognize(p, "n 4", r).accepted[0].valid and not recognize(p, "n 3", r).accepted[0].valid
    with pytest.raises(ValueError):
        r.add(r.types["even"])


def test_spellings_of_declarations():
    """Names with digits, slashes, colons and underscores first; prefixed hexadecimal bounds; spaced repeats; and what is none."""
    import pytest

    from lineloom.grammar.formats import lex
    from lineloom.grammar.values import DOCUMENT, FormatError

    kinds = lambda t, *r: [(k, v.type_id if k == "declaration" else v) for k, v, *_ in lex(t, *r)]
    for name in ("<1st>", "<x/y>", "<_x>", "<ip:port>", "<a.b-c>"):
        assert kinds(name) == kinds(name, DOCUMENT) == [("declaration", "named")]
    assert kinds("<hh:mm>") == [("declaration", "time")] and kinds("<hh:mm>", DOCUMENT) == [("declaration", "named")]
    d = next(lex("HEX<0x10-0XfF>"))[1]
    assert (d.type_id, d.low, d.high) == ("hex", 16, 255)
    assert kinds("x &< 1 - 3 >") == [("word", "x"), ("repeat", (1, 3))]
    for bad in ("<>", "<-a>", "<a b>", "a <x"):
        with pytest.raises(FormatError):
            list(lex(bad, DOCUMENT))
    with pytest.raises(FormatError):
        parse_checked("HEX<0xff-0x10>")


def parse_checked(text):
    from lineloom.grammar.formats import parse

    return parse(text)
