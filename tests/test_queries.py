"""Every registered query of the engine against its SQL, and what has none against plain Python."""

import math

import duckdb
import pytest

from lineloom import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, sf_dir, name):
    df = registry.queries()[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    r = con.sql(sql)
    assert sorted(r.columns) == columns
    at = [r.columns.index(c) for c in columns]
    assert got == sorted((tuple(plain(x[i]) for i in at) for x in r.fetchall()), key=repr)


def test_stages_are_those_of_the_languages(spark, sf_dir):
    """Against every pair of formats by itself: full pairs are those whose languages meet, and equivalent ones are plainly so."""
    from lineloom.grammar.catalog import with_types
    from lineloom.grammar.formats import parse
    from lineloom.grammar.languages import intersection
    from lineloom.grammar.values import DOCUMENT
    from lineloom.plans import relation_queries as q

    device, document = q._catalogs(spark, sf_dir)
    typed = {y["format"]: with_types(parse(y["format"], DOCUMENT, policy=False), {t["parameter_name"]: t["parameter_type"] for t in y.get("parameter_types", ())}) for y in document["commands"]}
    rows = q.q_staged(spark, sf_dir).collect()
    full = {(r.device, r.document) for r in rows if r.stage != "prefix"}
    assert full == {(x["format"], y) for x in device["commands"] for y, t in typed.items() if intersection(t, parse(x["format"])).nonempty}
    assert not {r.device for r in rows if r.stage == "prefix"} & {x for x, _ in full}


def test_types_that_do_not_fit_are_no_match(spark):
    """An address and an integer of one shape, in the same order and in another."""
    from lineloom.operators.mapping import map_catalogs
    from lineloom.plans.relation_queries import HEAD

    types = [{"parameter_name": "n", "parameter_type": "integer"}]
    for x, y in (("old X.X.X.X name", "old <n> name"), ("odd X.X.X.X { a | b }", "odd <n> { b | a }")):
        m = map_catalogs(spark, HEAD | {"source": "device", "commands": [{"format": x}]}, HEAD | {"source": "documentation", "commands": [{"format": y, "parameter_types": types}]})
        assert not [r for r in m.pairs.collect() if r.status == "equivalent"]


def test_tiers_agree(spark):
    """The native tier reads linear formats as the automaton does."""
    from lineloom.grammar.program import Program, recognize
    from lineloom.operators import recognition as R

    formats = [R.Format(i, t) for i, t in enumerate(["a INTEGER<1-9>", "a <x> b", "<x> STRING<2-3>", "say TEXT<3-8>", "a ENUM{b,c}", "at X.X.X.X HH:MM:SS", "on MM-DD", "h HEX<10-ff>", "to X:X::X:X", "net X:X::X:X/M H-H-H", "TEXT<1-9>"])]
    texts = ["a 5", "a 50", "a x b", "a b", "q abc", "q a", "say hi there", "say x", "at 1.2.3.4 10:00:00", "at 1.2.3.400 25:00:00", "on 02-29", "on 13-01", "h 0x1F", "h 5", "to ::1", "to 1:2", "A C", "zz", "net ::1/64 1-2-3", "net ::1/640 1-2", "say a  b", "! rem", "q a\tb", "a +5", "a 99999999999999999999999999999999999999999"]
    rows = R.distinct_commands(spark.createDataFrame([(t,) for t in texts], "command string"))
    got = {(r.command, r.format, r.status) for r in R.linear_probed(R.linear_matches(rows, formats)).select("command", "format", "status").collect()}
    trees = R.parsed(formats)
    want = set()
    for t in texts:
        for f, tree in trees.items():
            for p in recognize(Program(tree), t).accepted:
                want.add((t, f, "valid" if p.valid else "strange" if p.strange else "invalid"))
    assert got == want


def test_entry_without_the_corpus_part(tmp_path):
    """The rest imports and lists its queries when the corpus operators are taken out."""
    import os
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{root}/lineloom", tmp_path / "lineloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    assert not (tmp_path / "corpus_pipeline.py").exists()
    code = "import __spark_entry__ as e; q = e.queries(); assert 'q_status' in q and not any(n.startswith('op') for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)


def test_stream(spark, tmp_path):
    from lineloom.plans.recognition_queries import GRAMMAR
    from lineloom.streaming.lines import recognised_stream

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("red x\nnew bolt\nnothing\n\n")
    got = []
    q = recognised_stream(spark.readStream.text(str(tmp_path / "in")), GRAMMAR, lambda b, _: got.extend(r.kind for r in b.select("kind").collect()), checkpointLocation=str(tmp_path / "state"))
    q.processAllAvailable()
    q.stop()
    assert sorted(got) == ["blank", "command", "command", "error"]
