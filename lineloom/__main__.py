"""python -m lineloom parse | match | prepare: reports on standard output as JSON.

Ends with 0; with 1 if lines failed or records have no match; with 2 if an input can't be read.
"""

from __future__ import annotations

import argparse
import json
import sys


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lineloom", description=__doc__)
    sub = p.add_subparsers(dest="what", required=True)
    a = sub.add_parser("parse", help="read a configuration against a catalog")
    a.add_argument("--patterns", required=True)
    a.add_argument("--config", required=True)
    a.add_argument("--mode", choices=("system", "hierarchy"), default="system")
    a.add_argument("--flat", action="store_true", help="search all formats for each line")
    for name, text in (("match", "match a device catalog with documentation"), ("prepare", "match, and recover views and transitions")):
        a = sub.add_parser(name, help=text)
        a.add_argument("--patterns", required=True)
        a.add_argument("--documents", required=True)
        a.add_argument("--save", help="folder for the mapping's tables")
        if name == "prepare":
            a.add_argument("--mode", choices=("system", "hierarchy"), default="hierarchy")
    return p


def _read(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def parse(args) -> tuple[dict, bool]:
    from lineloom.parser import ConfigurationParser, LineParser, summary

    parser = LineParser.from_json(_read(args.patterns), mode=args.mode)
    lines = ConfigurationParser(parser, False if args.flat else None).parse(_read(args.config))
    told = [{k: v for k, v in r.items() if v is not None} for r in lines]
    s = summary(lines)
    return {"lines": told, "summary": s}, s["errors"] == 0


def match(args) -> tuple[dict, bool]:
    from pyspark.sql import SparkSession

    from lineloom.grammar.catalog import strict_json
    from lineloom.operators.hierarchy import mapping_document, prepare_catalogs
    from lineloom.operators.mapping import save_mapping
    from lineloom.shipping import ship

    device, documents = strict_json(_read(args.patterns)), strict_json(_read(args.documents))
    spark = SparkSession.builder.getOrCreate()
    ship(spark)
    p = prepare_catalogs(spark, device, documents, getattr(args, "mode", "system"))
    if args.save:
        save_mapping(p.mapped, args.save)
    out = mapping_document(p.mapped, p)
    if args.what == "prepare":
        out["catalog"] = p.catalog
    return out, all(d["status"] == "matched" for d in out["devices"].values())


def main(argv: list[str] | None = None) -> int:
    args = _parser().parse_args(argv)
    try:
        out, well = (parse if args.what == "parse" else match)(args)
    except (OSError, ValueError) as e:
        print(f"{type(e).__name__}: {e}", file=sys.stderr)
        return 2
    json.dump(out, sys.stdout, ensure_ascii=False, indent=2)
    print()
    return 0 if well else 1


if __name__ == "__main__":
    sys.exit(main())
