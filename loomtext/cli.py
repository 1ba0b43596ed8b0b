"""Command line: ``python -m loomtext.cli build|search|boolean|phrase|stats``."""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import SparkSession

from .config import Config, as_dict, load, update
from .operators import analysis, boolean, index, phrase, ranking, reports


def session() -> SparkSession:
    return SparkSession.builder.appName("loomtext").config("spark.sql.adaptive.enabled", "true").getOrCreate()


def query_table(spark: SparkSession, texts: list[str], config: Config):
    """(qid, text, tokens): queries analyzed as the documents are."""
    raw = spark.createDataFrame(list(enumerate(dict.fromkeys(texts), 1)), "qid long, text string")
    tokens = analysis.analyze(raw, config.analyzer, "qid", "text").withColumnRenamed("doc_id", "qid")
    return raw.join(tokens, "qid")


def search(queries, tables: dict, config: Config):
    """The best documents from the stored tables, of which only the queries' terms are read."""
    asked = config.retrieval
    return ranking.search_stored(queries, ranking.pick_terms(queries, tables), asked.top_k, asked.min_similarity, asked.tfidf_method)


def missing(path: str) -> list[str]:
    """What of an index isn't there yet."""
    return [n for n in index.TABLES if "://" not in path and not os.path.isdir(f"{path}/{n}")]


def interactive(spark: SparkSession, tables: dict, config: Config, lines=sys.stdin, out=sys.stdout) -> None:
    """Commands: help, config, methods, stats, method NAME, quit; anything else is searched for."""
    for line in lines:
        word, _, rest = line.strip().partition(" ")
        if word == "quit":
            return
        if word == "help":
            print("help config methods stats method quit", file=out)
        elif word == "config":
            print(as_dict(config), file=out)
        elif word == "methods":
            print(ranking.METHODS, file=out)
        elif word == "stats":
            print(index.positional_stats(tables["tf"]).first().asDict(), file=out)
        elif word == "method" and rest:
            try:
                config = update(config, {"retrieval": {"tfidf_method": ranking.check_method(rest)}})
            except ValueError as error:
                print(error, file=out)
        elif word:
            found = search(query_table(spark, [line.strip()], config), tables, config)
            for row in found.orderBy("rank").collect():
                print(f"{row['rank']:>3}. {row['doc_id']}  {row['similarity']:.4f}", file=out)


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("command", choices=("build", "search", "boolean", "phrase", "stats", "interactive"))
    parser.add_argument("index")
    parser.add_argument("query", nargs="*")
    parser.add_argument("--documents", help="Parquet with doc_id and text, for build")
    parser.add_argument("--config")
    parser.add_argument("--top-k", type=int)
    parser.add_argument("--method")
    parser.add_argument("--report")
    args = parser.parse_args(argv)
    config = load(args.config)
    given = {k: v for k, v in (("top_k", args.top_k), ("tfidf_method", args.method)) if v is not None}
    config = update(config, {"retrieval": given})
    ranking.check_method(config.retrieval.tfidf_method)
    spark = session()
    if args.command == "build":
        index.write_index(analysis.analyze(spark.read.parquet(args.documents), config.analyzer), args.index)
        return 0
    if gone := missing(args.index):
        print(f"build the index first; missing: {', '.join(gone)}", file=sys.stderr)
        return 1
    tables = index.read_index(spark, args.index)
    if args.command == "stats":
        print(index.positional_stats(tables["tf"]).first().asDict())
    elif args.command == "interactive":
        interactive(spark, tables, config)
    elif args.command == "search":
        queries = query_table(spark, args.query, config)
        found = search(queries, tables, config)
        print(reports.retrieval_report(found, queries, as_dict(config.retrieval), args.report))
    else:
        occurrences = tables["positions"].selectExpr("doc_id", "explode(positions) AS pos", "term")
        run = (lambda q: phrase.phrase(q, occurrences)) if args.command == "phrase" else (lambda q: boolean.search(q, tables["tf"].select("term", "doc_id"), optimize=True))
        for q in args.query:
            ids = [r["doc_id"] for r in run(q).orderBy("doc_id").toLocalIterator()]
            print(f"{q}: {len(ids)}: {ids}")
    return 0


if __name__ == "__main__":
    sys.exit(main())
