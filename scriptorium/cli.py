"""Command line: check, eval, classes, languages, readability, identity.

    python -m scriptorium.cli check --lang bn PATH
    python -m scriptorium.cli eval FOLDER --lang bn --baseline FOLDER --strict
"""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from scriptorium.config import ERROR_CLASSES
from scriptorium.functions import identity
from scriptorium.functions.normalize import normalize
from scriptorium.functions.readability import score
from scriptorium.packs.base import get_pack, languages


def text_of(argument: str) -> str:
    """Standard input for -, a file's text for its path, else the argument itself."""
    if argument == "-":
        return sys.stdin.read()
    try:
        return Path(argument).read_text(encoding="utf-8") if Path(argument).is_file() else argument
    except OSError:
        return argument


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="scriptorium")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("check", "readability"):
        c = sub.add_parser(name)
        c.add_argument("text")
        c.add_argument("--lang", default="bn", choices=languages())
    e = sub.add_parser("eval")
    e.add_argument("gold")
    e.add_argument("--lang", default="bn", choices=languages())
    e.add_argument("--baseline")
    e.add_argument("--update-baseline", metavar="FOLDER")
    e.add_argument("--strict", action="store_true")
    for name in ("classes", "languages"):
        sub.add_parser(name)
    i = sub.add_parser("identity")
    i.add_argument("action", choices=("new", "verify"))
    i.add_argument("phrase", nargs="?", default="")
    a = p.parse_args(argv)
    if a.command == "check":
        from pyspark.sql import SparkSession

        from scriptorium.plans.check import check

        spark = SparkSession.builder.getOrCreate()
        found = check(spark.createDataFrame([(0, text_of(a.text))], "doc_id int, text string"), a.lang)["edits"]
        for line in found.filter("surfaced").orderBy("start").toJSON().toLocalIterator():
            print(line)
    elif a.command == "eval":
        from pyspark.sql import SparkSession

        from scriptorium.plans.evaluation import gated
        from scriptorium.sources.tables import markdown, write_baseline

        per_class, headline, gate = gated(SparkSession.builder.getOrCreate(), a.gold, a.lang, a.baseline, a.strict)
        print(markdown(per_class))
        print(headline.toJSON().first())
        rows = gate.collect()  # at most a row for each gate and class
        for r in rows:
            print(r["severity"], r["code"], r["message"], sep="\t", file=sys.stderr)
        if a.update_baseline:
            write_baseline(per_class, a.update_baseline)
        return int(any(r["severity"] == "blocker" for r in rows))
    elif a.command == "readability":
        print(json.dumps(score(normalize(text_of(a.text))[0], get_pack(a.lang).rules), ensure_ascii=False))
    elif a.command == "classes":
        for name, (category, stage) in ERROR_CLASSES.items():
            print(name, category, "-" if stage is None else stage, sep="\t")
    elif a.command == "languages":
        print(*languages(), sep="\n")
    elif a.action == "new":
        print(identity.phrase())
    else:
        try:
            identity.parsed(a.phrase)
        except ValueError as e:
            print(e, file=sys.stderr)
            return 1
        print("ok")
    return 0


if __name__ == "__main__":
    sys.exit(main())
