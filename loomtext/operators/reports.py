"""Reports and result files: small outputs that the driver formats."""

from __future__ import annotations

import json
import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import file_slug
from ..sources.stored import store


def preview(lists: DataFrame, n: int = 10) -> DataFrame:
    """(term, df, first_ids) of the first ``n`` terms."""
    return lists.orderBy("term").limit(n).select("term", "df", F.slice("doc_ids", 1, 10).alias("first_ids"))


def result_rows(results: DataFrame, queries: DataFrame) -> DataFrame:
    """(qid, file, body): a JSON body for each query's results and the name of its file."""
    lists = results.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "doc_id", "similarity"))).alias("results"))
    named = queries.join(lists, "qid", "left")
    body = F.to_json(F.struct(F.col("text").alias("query"), F.coalesce(F.size("results"), F.lit(0)).alias("total"), "results"))
    return named.select("qid", F.concat(F.lit("query_"), F.col("qid"), F.lit("_"), file_slug(F.col("text")), F.lit(".json")).alias("file"), body.alias("body"))


def text_of(results: DataFrame, queries: DataFrame) -> DataFrame:
    """(qid, file, body): a text body for each query's results and the name of its file."""
    lists = results.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "doc_id", "similarity"))).alias("results"))
    line = F.transform("results", lambda r: F.format_string("%d. document %s, similarity %.6f", r["rank"], r["doc_id"].cast("string"), r["similarity"]))
    body = F.concat_ws("\n", F.concat(F.lit("Query: "), "text"), F.concat(F.lit("Results: "), F.coalesce(F.size("results"), F.lit(0))), F.array_join(line, "\n"))
    named = queries.join(lists, "qid", "left")
    return named.select("qid", F.concat(F.lit("query_"), F.col("qid"), F.lit("_"), file_slug(F.col("text")), F.lit(".txt")).alias("file"), body.alias("body"))


def save_results(results: DataFrame, queries: DataFrame, folder: str, form: str = "json") -> list[str]:
    """One JSON or TXT file a query (K12); a batch's results are ``top_k`` rows a query."""
    system, inner = store(folder)
    system.create_dir(inner, recursive=True)
    paths = []
    for row in {"json": result_rows, "txt": text_of}[form](results, queries).toLocalIterator():
        paths.append(f"{folder}/{row['file']}")
        with system.open_output_stream(f"{inner}/{row['file']}") as file:
            file.write(row["body"].encode())
    return paths


def retrieval_report(results: DataFrame, queries: DataFrame, stats: dict, path: str | None = None) -> str:
    """A text report by query with the collection's statistics."""
    by_query = {}
    for row in results.orderBy("qid", "rank").toLocalIterator():
        by_query.setdefault(row["qid"], []).append(row)
    lines = ["Retrieval report", "=" * 60, *(f"{k}: {v}" for k, v in stats.items()), ""]
    for q in queries.orderBy("qid").toLocalIterator():
        rows = by_query.get(q["qid"], [])
        lines.append(f"Query {q['qid']}: {q['text']} ({len(rows)} results)")
        lines += [f"  {r['rank']:>3}. {r['doc_id']}  {r['similarity']:.4f}" for r in rows]
    text = "\n".join(lines) + "\n"
    if path:
        with open(path, "w", encoding="utf-8") as file:
            file.write(text)
    return text


def save_statistics(results: DataFrame, path: str) -> dict:
    """Counts and similarity extremes over all queries as JSON."""
    row = results.agg(F.countDistinct("qid").alias("queries"), F.count("*").alias("results"), F.max("similarity").alias("max"), F.min("similarity").alias("min"), F.avg("similarity").alias("mean")).first()
    with open(path, "w", encoding="utf-8") as file:
        json.dump(row.asDict(), file, indent=1)
    return row.asDict()


def timed(run: Callable[[], DataFrame]) -> tuple[list, float]:
    """(sorted rows, seconds) of one execution."""
    began = time.perf_counter()
    rows = sorted(tuple(r) for r in run().collect())
    return rows, time.perf_counter() - began


def compare(queries: list[str], one: Callable[[str], DataFrame], other: Callable[[str], DataFrame]) -> list[dict]:
    """For each query, both counts, seconds and whether the answers agree."""
    out = []
    for q in queries:
        (a, s), (b, t) = timed(lambda q=q: one(q)), timed(lambda q=q: other(q))
        out.append({"query": q, "n": len(a), "equal": a == b, "seconds": s, "other_seconds": t, "ratio": s / t if t else None})
    return out


def summary(rows: list[dict]) -> dict:
    """Counts, agreement and seconds (average, least, most) of a comparison."""
    seconds = [r["seconds"] for r in rows]
    return {
        "queries": len(rows), "agreeing": sum(r["equal"] for r in rows), "average_seconds": sum(seconds) / len(rows) if rows else None,
        "least_seconds": min(seconds, default=None), "most_seconds": max(seconds, default=None),
    }


def save_comparison(rows: list[dict], path: str) -> str:
    """The rows of ``compare`` and their summary as JSON at ``path`` and as text beside it."""
    lines = [f"{r['query']}: {r['n']} rows, {'equal' if r['equal'] else 'DIFFERENT'}, {r['seconds']:.3f} s and {r['other_seconds']:.3f} s" for r in rows]
    text = "\n".join([*lines, *(f"{k}: {v}" for k, v in summary(rows).items())]) + "\n"
    system, inner = store(path)
    for name, body in ((inner, json.dumps({"rows": rows, "summary": summary(rows)}, indent=1)), (inner.removesuffix(".json") + ".txt", text)):
        with system.open_output_stream(name) as file:
            file.write(body.encode())
    return text
