"""Ranked retrieval: TF-IDF weights, cosine similarity, top-k, batches and query statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.stored import checkpointed, stored

METHODS = {
    "standard": "tf * ln(N / df)",
    "log": "(1 + ln tf) * ln(N / df)",
    "augmented": "(0.5 + 0.5 tf / max tf) * ln(N / df)",
    "binary": "ln(N / df) for terms that occur",
}


def check_method(method: str) -> str:
    """The method, or an error that lists those there are."""
    if method not in METHODS:
        raise ValueError(f"unknown TF-IDF method {method!r}; there are {', '.join(METHODS)}")
    return method


def weight(tf: Column, df: Column, n: Column, max_tf: Column, method: str = "standard") -> Column:
    """The TF-IDF weight of a term that occurs."""
    idf = F.when(df > 0, F.log(n / df)).otherwise(0.0)
    part = {"standard": tf.cast("double"), "log": 1 + F.log(tf), "augmented": 0.5 + 0.5 * tf / max_tf, "binary": F.lit(1.0)}[check_method(method)]
    return part * idf


def quantised(similarity: Column) -> Column:
    """Six decimals, rounded half up in plain arithmetic, so that engines and runs agree on ties."""
    return F.floor(similarity * 1e6 + 0.5) / 1e6


def document_frequencies(tf: DataFrame) -> DataFrame:
    """(term, df, cf)."""
    return tf.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def collection_size(tf: DataFrame) -> DataFrame:
    """(n_docs): documents with terms, one row."""
    return tf.agg(F.countDistinct("doc_id").alias("n_docs"))


def document_weights(tf: DataFrame, method: str = "standard", df: DataFrame | None = None) -> DataFrame:
    """(doc_id, term, w): the sparse vectors (R2).

    The join on terms is left to Spark: frequent terms skew it, and AQE splits them.
    """
    df = df if df is not None else document_frequencies(tf)
    # The greatest frequency goes with its document's rows, as a join after would shuffle them once more.
    greatest = F.max("tf").over(Window.partitionBy("doc_id")) if check_method(method) == "augmented" else F.lit(1)
    rows = tf.withColumn("max_tf", greatest).join(df.select("term", "df"), "term").join(F.broadcast(collection_size(tf)))  # one row
    return rows.select("doc_id", "term", weight(F.col("tf"), F.col("df"), F.col("n_docs"), F.col("max_tf"), method).alias("w"))


def document_norms(tf: DataFrame, method: str = "standard") -> DataFrame:
    """(doc_id, norm), computed once rather than for each query."""
    tables = statistics(tf, method, keep_norms=False)
    return tables["doc_stats"].select("doc_id", F.col(f"norm_{method}").alias("norm"))


#: Terms at most whose document frequencies go to every executor.
FREQUENT_TERMS = 1 << 17


def _with_df(tf: DataFrame, terms: DataFrame) -> DataFrame:
    """(doc_id, tf, df) of all rows; ``tf`` and ``terms`` are read twice, so they should be stored.

    The most frequent terms, ``FREQUENT_TERMS`` at most, are broadcast: they make up most rows, which then need no
    shuffle and no sort, and no frequent term skews a task. The other rows meet their terms by a join of sorted rows, as
    terms compress so well that a table under Spark's size threshold may be far larger once it is broadcast.
    """
    # Terms by the bits of their frequency: at most 64 rows tell from which power of two on there are few enough.
    bits = {r["bits"]: r["n"] for r in terms.groupBy(F.length(F.bin("df")).alias("bits")).agg(F.count("*").alias("n")).collect()}
    least, n = 63, 0
    while least > 1 and n + bits.get(least - 1, 0) <= FREQUENT_TERMS:
        least, n = least - 1, n + bits.get(least - 1, 0)
    known = terms.select("term", "df")
    frequent, rare = known.where(F.col("df") >= 1 << (least - 1)), known.where(F.col("df") < 1 << (least - 1))
    columns = ["doc_id", "tf", "df"]
    rows = tf.join(F.broadcast(frequent), "term").select(columns)  # FREQUENT_TERMS rows at most
    if least == 1:
        return rows
    return rows.union(tf.join(F.broadcast(frequent.select("term")), "term", "left_anti").join(rare.hint("merge"), "term").select(columns))


def _document_stats(tf: DataFrame, terms: DataFrame, methods=tuple(METHODS)) -> DataFrame:
    """(doc_id, doc_len, max_tf, n_terms) and ``norm_<method>`` for each method, from one join and one grouping.

    The augmented weight squared is (0.25 + 0.5 tf / m + 0.25 (tf / m)**2) idf**2 with the document's greatest frequency m,
    so three sums do, and m need not be joined to the rows first.
    """
    idf = weight(F.lit(1), F.col("df"), F.col("n_docs"), F.lit(1), "binary")
    sums = {"standard": [F.col("tf") * F.col("tf")], "log": [F.pow(1 + F.log("tf"), F.lit(2.0))], "augmented": [F.lit(1.0), F.col("tf"), F.col("tf") * F.col("tf")], "binary": [F.lit(1.0)]}
    rows = _with_df(tf, terms).join(F.broadcast(collection_size(tf)))  # one row
    rows = rows.select("doc_id", "tf", idf.alias("idf")).withColumn("idf2", F.col("idf") * F.col("idf"))
    totals = [F.sum(part * F.col("idf2")).alias(f"{m}_{i}") for m in methods for i, part in enumerate(sums[check_method(m)])]
    out = rows.groupBy("doc_id").agg(F.sum("tf").alias("doc_len"), F.max("tf").alias("max_tf"), F.count("*").alias("n_terms"), *totals)
    share = F.lit(1.0) / F.col("max_tf")
    square = {m: F.col(f"{m}_0") for m in methods}
    if "augmented" in methods:
        square["augmented"] = 0.25 * F.col("augmented_0") + 0.5 * share * F.col("augmented_1") + 0.25 * share * share * F.col("augmented_2")
    return out.select("doc_id", "doc_len", "max_tf", "n_terms", *[F.sqrt(square[m]).alias(f"norm_{m}") for m in methods])


def query_terms(queries: DataFrame) -> DataFrame:
    """(qid, term, qtf, q_max) from queries(qid, tokens)."""
    tf = queries.select("qid", F.explode("tokens").alias("term")).groupBy("qid", "term").agg(F.count("*").alias("qtf"))
    return tf.withColumn("q_max", F.max("qtf").over(Window.partitionBy("qid")))


def statistics(tf: DataFrame, method: str = "standard", norms: DataFrame | None = None, keep_norms: bool = True) -> dict[str, DataFrame]:
    """What a search needs, of term frequencies that aren't stored: tf (cut here, as all the rest reads it), terms, collection and doc_stats."""
    tf = stored(tf, "frequencies")
    terms = stored(document_frequencies(tf), "terms")
    stats = norms.withColumnRenamed("norm", f"norm_{method}") if norms is not None else _document_stats(tf, terms, (method,))
    return {"tf": tf, "terms": terms, "collection": collection_size(tf), "doc_stats": stored(stats, "norms") if norms is None and keep_norms else stats}


def stored_statistics(tf: DataFrame, terms: DataFrame) -> dict[str, DataFrame]:
    """The tables that an index keeps beside ``tf`` and ``terms`` (term, df, cf): collection (n_docs), doc_stats with a norm for each method."""
    return {"collection": collection_size(tf), "doc_stats": _document_stats(tf, terms)}


def query_weights(queries: DataFrame, tables: dict[str, DataFrame], method: str = "standard") -> DataFrame:
    """(qid, term, df, qw) of the queries' known terms (R3), cut here: its size then tells whether postings need a shuffle to meet it."""
    rows = query_terms(queries).join(tables["terms"].select("term", "df"), "term").join(F.broadcast(tables["collection"]))  # one row
    return stored(rows.select("qid", "term", "df", weight(F.col("qtf"), F.col("df"), F.col("n_docs"), F.col("q_max"), method).alias("qw")), "query-weights")


def scores(queries: DataFrame, tables: dict[str, DataFrame], method: str = "standard") -> DataFrame:
    """(qid, doc_id, similarity) of documents that share a term with the query (R4): postings of its terms, then norms of the documents found."""
    qw = query_weights(queries, tables, method)
    rows = tables["tf"].join(qw, "term").join(F.broadcast(tables["collection"]))  # one row
    if method == "augmented":
        stats = tables["doc_stats"]
        maxima = stats.select("doc_id", "max_tf") if "max_tf" in stats.columns else tables["tf"].groupBy("doc_id").agg(F.max("tf").alias("max_tf"))
        rows = rows.join(maxima, "doc_id")
    else:
        rows = rows.withColumn("max_tf", F.lit(1))
    w = weight(F.col("tf"), F.col("df"), F.col("n_docs"), F.col("max_tf"), method)
    dots = rows.groupBy("qid", "doc_id").agg(F.sum(F.col("qw") * w).alias("dot"))
    lengths = qw.groupBy("qid").agg(F.sqrt(F.sum(F.col("qw") * F.col("qw"))).alias("q_norm"))
    norms = tables["doc_stats"].select("doc_id", F.col(f"norm_{method}").alias("norm"))
    full = dots.join(norms, "doc_id").join(lengths, "qid")
    cosine = F.when((F.col("q_norm") > 0) & (F.col("norm") > 0), F.col("dot") / (F.col("q_norm") * F.col("norm"))).otherwise(0.0)
    return full.select("qid", "doc_id", quantised(cosine).alias("similarity"))


def search(queries: DataFrame, tf: DataFrame, top_k: int = 10, min_similarity: float = 0.0, method: str = "standard", norms: DataFrame | None = None) -> DataFrame:
    """``search_stored`` over term frequencies without stored statistics, which are made first."""
    return search_stored(queries, pick_terms(queries, statistics(tf, check_method(method), norms)), top_k, min_similarity, method)


#: Distinct query terms up to which postings are picked by value, so that row groups without them aren't read.
PICKED_TERMS = 1000


def pick_terms(queries: DataFrame, tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The tables with postings and terms of the queries alone, for stored tables sorted by term; many queries leave them whole."""
    words = [r["term"] for r in queries.select(F.explode("tokens").alias("term")).distinct().limit(PICKED_TERMS + 1).collect()]
    if len(words) > PICKED_TERMS:
        return tables
    return tables | {n: tables[n].where(F.col("term").isin(*words)) for n in ("tf", "terms")}


def search_stored(queries: DataFrame, tables: dict[str, DataFrame], top_k: int = 10, min_similarity: float = 0.0, method: str = "standard") -> DataFrame:
    """(qid, rank, doc_id, similarity) of the best documents of each query (R5, R7), from tf, terms, collection and doc_stats.

    With ``min_similarity`` 0 documents without shared terms count with score 0.
    For each query it is enough to fill up with the ``top_k`` smallest ids, so the
    collection is never paired with the queries. Ties go by id.
    """
    order = Window.partitionBy("qid").orderBy(F.desc("similarity"), "doc_id")
    best = lambda rows: rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_k)
    found = scores(queries, tables, check_method(method)).where(F.col("similarity") >= min_similarity)
    if min_similarity <= 0:
        # The best top_k of each query, cut here, tell which queries are short, and all their matches.
        found = checkpointed(best(found).drop("rank"))
        asked = queries.where(F.size("tokens") > 0).select("qid").distinct()
        others = _unmatched(asked, found, tables["doc_stats"], top_k)
        found = found.union(others.select("qid", "doc_id", F.lit(0.0).alias("similarity")))
    return best(found).select("qid", F.col("rank").cast("long").alias("rank"), "doc_id", "similarity")


def _unmatched(asked: DataFrame, found: DataFrame, stats: DataFrame, top_k: int) -> DataFrame:
    """For queries with fewer matches than ``top_k``, documents that don't match, by id."""
    short = asked.join(found.groupBy("qid").agg(F.count("*").alias("n")), "qid", "left").where(F.coalesce("n", F.lit(0)) < top_k).select("qid")
    # A short query has fewer than top_k matches, so among the 2 top_k smallest ids enough are free.
    first = stats.select("doc_id").orderBy("doc_id").limit(2 * top_k)
    return first.join(short).join(found, ["qid", "doc_id"], "left_anti")


def with_matches(results: DataFrame, queries: DataFrame, docs: DataFrame) -> DataFrame:
    """Adds doc_length, matched_terms (query tokens in order, repeats kept) and match_count (R6). ``docs(doc_id, tokens)``."""
    rows = results.join(queries.select("qid", F.col("tokens").alias("q")), "qid").join(docs.select("doc_id", "tokens"), "doc_id")
    matched = F.filter("q", lambda t: F.array_contains("tokens", t))
    return rows.select("qid", "rank", "doc_id", "similarity", F.size("tokens").cast("long").alias("doc_length"), matched.alias("matched_terms"), F.size(matched).cast("long").alias("match_count"))


def query_statistics(queries: DataFrame, tf: DataFrame) -> DataFrame:
    """(qid, term, qtf, df, collection_frequency, cf, idf) by query term; unknown terms have zeros."""
    wanted = query_terms(queries)
    df = document_frequencies(tf.join(wanted.select("term").distinct(), "term", "left_semi"))
    rows = wanted.join(df, "term", "left").join(F.broadcast(collection_size(tf)))  # one row
    known = F.coalesce("df", F.lit(0))
    idf = F.when(known > 0, quantised(F.log(F.col("n_docs") / F.col("df")))).otherwise(0.0)
    return rows.select("qid", "term", "qtf", known.alias("df"), known.alias("collection_frequency"), F.coalesce("cf", F.lit(0)).alias("cf"), idf.alias("idf"))


def vocabulary_coverage(queries: DataFrame, tf: DataFrame) -> DataFrame:
    """(qid, token_count, unique_tokens, known_tokens): coverage by token, repeats counted."""
    stats = query_statistics(queries, tf)
    return stats.groupBy("qid").agg(F.sum("qtf").alias("token_count"), F.count("*").alias("unique_tokens"), F.sum(F.when(F.col("df") > 0, F.col("qtf")).otherwise(0)).alias("known_tokens"))


def similarity_stats(results: DataFrame) -> DataFrame:
    """(qid, results, max_similarity, min_similarity)."""
    return results.groupBy("qid").agg(F.count("*").alias("results"), F.max("similarity").alias("max_similarity"), F.min("similarity").alias("min_similarity"))


def overall_stats(results: DataFrame) -> DataFrame:
    """(queries, results, max_similarity, min_similarity, mean_similarity) over all queries, one row."""
    s = F.col("similarity")
    return results.agg(F.countDistinct("qid").alias("queries"), F.count("*").alias("results"), F.max(s).alias("max_similarity"), F.min(s).alias("min_similarity"), quantised(F.avg(s)).alias("mean_similarity"))
