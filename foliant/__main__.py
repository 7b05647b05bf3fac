"""Command line: index, search, browse, read and remove documents of a library.

``python -m foliant <root> index <folder>``, ``search <words>``, ``browse``, ``pages <name> <list>``,
``outline <name>``, ``remove <name>...``, ``evaluate <questions file>``, ``calculate <expression>``, ``doc-meta``: what is known
of each document. ``--policy <JSON file>`` names report types by folder and name; ``search --routed`` searches where
a question's period, type, company and region say.
"""

from __future__ import annotations

import argparse
import json
import sys


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="foliant", description=__doc__)
    out.add_argument("root", help="folder of the library")
    out.add_argument("--policy", help="JSON file of a routing policy")
    commands = out.add_subparsers(dest="command", required=True)
    for name, arguments in {
        "index": ["folder"], "search": ["query"], "browse": [], "pages": ["name", "pages"], "outline": ["name"],
        "remove": ["names+"], "evaluate": ["questions"], "calculate": ["expression"], "doc-meta": [],
    }.items():
        command = commands.add_parser(name)
        for a in arguments:
            command.add_argument(a.rstrip("+"), nargs="+" if a.endswith("+") else None)
        if name in ("search", "evaluate"):
            command.add_argument("-k", type=int, default=5)
        if name == "search":
            command.add_argument("--routed", action="store_true")
        if name in ("browse", "doc-meta"):
            command.add_argument("--offset", type=int, default=0)
            command.add_argument("--limit", type=int, default=20)
    return out


def run(spark, arguments: list[str]) -> object:
    """The answer to a command, of plain values."""
    from pyspark.sql import functions as F

    from foliant.functions import calc
    from foliant.functions.policy import Policy
    from foliant.library import Library
    from foliant.sources import readers

    given = parser().parse_args(arguments)
    policy = Policy()
    if given.policy:
        with open(given.policy, encoding="utf-8") as file:
            policy = Policy.of(json.load(file))
    library = Library(spark, given.root, policy=policy)

    def asked():
        rows = readers.questions(spark, given.questions)
        return rows.select(F.col("id").alias("query_id"), F.col("question").alias("query"), F.coalesce("expected", F.lit("")).alias("expected"), F.array().cast("array<int>").alias("pages"))

    def one(query: str):
        return spark.createDataFrame([("q", query)], "query_id string, query string")

    answers = {
        "index": lambda: {"indexed": library.index(readers.changed_files(spark, given.folder, None, [".md", ".markdown"]))},
        "search": lambda: [r.asDict() for r in library.routed_search(one(given.query), given.k).orderBy("rank").collect()] if given.routed else library.search_pages(given.query, top_k=given.k),
        "doc-meta": lambda: [{k: d.get(k) for k in ("name", "period", "report_type", "report_type_source", "company", "region")} for d in library.browse(given.offset, given.limit)],
        "browse": lambda: library.browse(given.offset, given.limit),
        "pages": lambda: library.page_content(given.name, given.pages),
        "outline": lambda: library.structure(given.name),
        "remove": lambda: library.remove(given.names),
        "evaluate": lambda: library.evaluated(asked(), given.k).first().asDict(),
        "calculate": lambda: calc.evaluate(given.expression),
    }
    return answers[given.command]()


def main() -> int:
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("foliant").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    print(json.dumps(run(spark, sys.argv[1:]), ensure_ascii=False, default=str))
    return 0


if __name__ == "__main__":
    sys.exit(main())
