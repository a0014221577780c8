"""Commands: spark-submit foliant/cli.py, or python -m foliant.cli, with a command and its options."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="foliant")
    p.add_argument("--root", default=".", help="the folder that holds pages, ocr_text, intermediate, output and logs")
    sub = p.add_subparsers(dest="command", required=True)
    for name, text in (("aggregate", "write the tables of a document"), ("status", "the job of a document"), ("documents", "list documents"), ("clear", "remove what was made of a document"), ("pages", "pages that a stage has still to work on")):
        c = sub.add_parser(name, help=text)
        if name != "documents":
            c.add_argument("doc")
        if name == "pages":
            c.add_argument("--stage", default="names", choices=["classify", "names", "meta", "places"])
    n = sub.add_parser("normalize", help="normal form of a name, a place or a date")
    n.add_argument("kind", choices=["name", "place", "date"])
    n.add_argument("text")
    n.add_argument("--year", type=int)
    c = sub.add_parser("compare", help="whether two names may be one person's")
    c.add_argument("first")
    c.add_argument("second")
    return p


def main(args: list[str] | None = None) -> int:
    a = parser().parse_args(args)
    from foliant.functions import plain

    if a.command == "normalize":
        out = plain.iso_date(a.text, a.year) if a.kind == "date" else getattr(plain, a.kind)(a.text)
    elif a.command == "compare":
        out = plain.same_person(a.first, a.second)
    else:
        from pyspark.sql import SparkSession

        from foliant.engine import Engine
        from foliant.sources import artifacts

        engine = Engine(SparkSession.builder.appName("foliant").getOrCreate(), Path(a.root))
        if a.command == "documents":
            out = [r.asDict() for r in engine.documents().orderBy("doc_id").toLocalIterator()]
        elif a.command == "pages":
            files = engine.artifacts(a.doc)
            out = [r["page"] for r in artifacts.resumed(artifacts.pages(files), files, a.stage).orderBy("page").toLocalIterator()]
        else:
            out = getattr(engine, a.command)(a.doc)
    json.dump(out, sys.stdout, ensure_ascii=False, indent=2)
    print()
    return 0


if __name__ == "__main__":
    sys.exit(main())
