"""Command line: index, search, compose, stats. Exit codes: 0 done, 1 failed, 2 misused."""

from __future__ import annotations

import argparse
import json
import os
import re
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from pagelore.compose import compose
from pagelore.library import Library, LibraryError
from pagelore.operators.filters import Filters
from pagelore.sources.opc import DeckError


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="pagelore")
    sub = p.add_subparsers(dest="command", required=True)
    x = sub.add_parser("index", help="scan a folder into a library")
    x.add_argument("folder")
    x.add_argument("--library", required=True)
    x = sub.add_parser("search", help="find slides")
    x.add_argument("query")
    x.add_argument("--library", required=True)
    x.add_argument("--limit", type=int, default=20)
    x.add_argument("--json", action="store_true")
    x = sub.add_parser("compose", help="build a deck from deck.pptx:index picks")
    x.add_argument("picks", nargs="+")
    x.add_argument("--out", required=True)
    x.add_argument("--title", default="Composed")
    x.add_argument("--fit", choices=["keep", "fit", "fill"], default="keep")
    x = sub.add_parser("stats", help="what a library holds")
    x.add_argument("--library", required=True)
    x.add_argument("--json", action="store_true")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    try:
        a = parser().parse_args(argv)
    except SystemExit as e:
        return int(e.code or 0)
    try:
        if a.command == "compose":
            picks = []
            for s in a.picks:
                m = re.fullmatch(r"(.+):0*([1-9]\d*)", s)
                if not m:
                    print(f"not a pick: {s}", file=sys.stderr)
                    return 2
                picks.append((m[1], int(m[2])))
            data, report = compose(picks, lambda p: open(p, "rb").read(), a.title, a.fit)
            with open(a.out, "wb") as f:
                f.write(data)
            print(f"{report.slides} slides from {report.decks} decks")
            for w in report.warnings:
                print(f"warning: {w}", file=sys.stderr)
            return 0
        spark = spark or SparkSession.builder.appName("pagelore").getOrCreate()
        if a.command != "index" and not Library.present(spark, a.library):
            raise LibraryError(f"no library at {a.library}")
        lib = Library(spark, a.library)
        if a.command == "index":
            lib.add_root(os.path.abspath(a.folder))
            got = lib.scan()
            print(", ".join(f"{got[k]} {k}" for k in ("indexed", "unchanged", "removed", "skipped")))
        elif a.command == "search":
            hits = lib.search(a.query, Filters(limit=a.limit)).collect()
            place = {r.id: (r.deck_path, r.slide_index, r.title) for r in lib.slides().where(F.col("id").isin([h.slide_id for h in hits])).collect()} if hits else {}
            out = [{"deck": place[h.slide_id][0], "slide": place[h.slide_id][1], "title": place[h.slide_id][2], "score": h.score, "snippet": h.snippet} for h in hits]
            if a.json:
                print(json.dumps(out, indent=2, ensure_ascii=False))
            for o in () if a.json else out:
                print(f"{o['deck']}:{o['slide']}  {o['title'] or ''}  {re.sub('</?mark>', '', o['snippet'])}")
        else:
            row = lib.stats_overview().first().asDict(recursive=True)
            print(json.dumps(row, indent=2) if a.json else f"{row['decks']} decks, {row['slides']} slides, {row['bytes']} bytes")
        return 0
    except (LibraryError, DeckError, OSError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
