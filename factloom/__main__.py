"""python -m factloom --tables FOLDER [--query EDN] [--explain] [-i]: run queries over Parquet tables or a datom log."""

from __future__ import annotations

import argparse
import ast as literals
import sys

from pyspark.sql import SparkSession

from .database import Database
from .edn import Keyword
from .fmt import markdown
from .query import QueryError


def value(text: str) -> object:
    if text.startswith(":"):
        return Keyword(text)
    try:
        return literals.literal_eval({"true": "True", "false": "False"}.get(text, text))
    except (ValueError, SyntaxError):
        return text


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="factloom", description=__doc__)
    p.add_argument("--tables", help="folder of Parquet tables")
    p.add_argument("--db", help="folder of a datom log")
    p.add_argument("--query")
    p.add_argument("--explain", action="store_true")
    p.add_argument("-i", action="store_true", help="read queries and commands from standard input")
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("factloom").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    db = Database.over(spark, a.tables) if a.tables else Database(spark, path=a.db)

    def run(text: str) -> int:
        try:
            print(db.explain(text) if a.explain else markdown(db.q(text)))
        except QueryError as e:
            print(f"error: {e}", file=sys.stderr)
            return 1
        return 0

    if a.query:
        return run(a.query)
    for line in sys.stdin if a.i else ():
        line = line.strip()
        if line == ".exit":
            break
        if line == ".help":
            print(".add E A V | .help | .exit | [:find ...]")
        elif line.startswith(".add "):
            e, attribute, v = line[5:].split(None, 2)
            tx = db.transaction()
            tx.add(e, attribute, value(v))
            print(tx.commit())
        elif line:
            run(line)
    return 0


if __name__ == "__main__":
    sys.exit(main())
