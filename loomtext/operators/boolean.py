"""Boolean retrieval over postings(term, doc_id)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import codec as C
from ..plans import boolean_ast as A
from ..sources.stored import checkpointed


def term_postings(posting: DataFrame, term: str) -> DataFrame:
    """(doc_id) of one term, lower-cased; empty if unknown."""
    return posting.where(F.col("term") == term.lower()).select("doc_id").distinct()


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    """(doc_id) in both (B1)."""
    return a.join(b, "doc_id", "left_semi")


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    """(doc_id) in either (B2)."""
    return a.union(b).distinct()


def complement(universe: DataFrame, a: DataFrame) -> DataFrame:
    """(doc_id) of the universe that are not in ``a``."""
    return universe.join(a, "doc_id", "left_anti")


def universe_of(posting: DataFrame) -> DataFrame:
    """(doc_id) of documents with postings."""
    return posting.select("doc_id").distinct()


def set_plan(tree, posting: DataFrame, universe: DataFrame | None = None) -> DataFrame:
    """One lookup a term, joined as sets; a negated operand of AND becomes an anti join."""
    everything = lambda: universe if universe is not None else universe_of(posting)
    if isinstance(tree, A.Term):
        return term_postings(posting, tree.word)
    if isinstance(tree, A.Nothing):
        return everything().where(F.lit(False))
    if isinstance(tree, A.Everything):
        return everything()
    if isinstance(tree, A.Not):
        return complement(everything(), set_plan(tree.of, posting, universe))
    if isinstance(tree, A.Or):
        return reduce(DataFrame.union, (set_plan(p, posting, universe) for p in tree.parts)).distinct()
    plain = [p for p in tree.parts if not isinstance(p, A.Not)]
    out = reduce(intersect, (set_plan(p, posting, universe) for p in plain)) if plain else everything()
    return reduce(lambda done, p: complement(done, set_plan(p.of, posting, universe)), (p for p in tree.parts if isinstance(p, A.Not)), out)


def _condition(tree, flag: dict[str, Column]) -> Column:
    if isinstance(tree, A.Term):
        return flag[tree.word]
    if isinstance(tree, A.Not):
        return ~_condition(tree.of, flag)
    if isinstance(tree, A.And):
        return reduce(Column.__and__, (_condition(p, flag) for p in tree.parts))
    if isinstance(tree, A.Or):
        return reduce(Column.__or__, (_condition(p, flag) for p in tree.parts))
    return F.lit(isinstance(tree, A.Everything))


def flag_plan(tree, posting: DataFrame, universe: DataFrame | None = None) -> DataFrame:
    """One scan and one shuffle: a flag by term and document, then one filter.

    Documents without any of the terms only matter if the tree holds with all flags
    down; then, and only then, all documents are grouped.
    """
    words = A.terms(tree)
    if not words:
        return set_plan(tree, posting, universe)
    rows = posting.select("doc_id", "term")
    if A.holds(tree, ()):
        if universe is not None:
            rows = rows.where(F.col("term").isin(*words)).union(universe.select("doc_id", F.lit(None).cast("string")))
    else:
        rows = rows.where(F.col("term").isin(*words))
    flags = rows.groupBy("doc_id").agg(*[F.max(F.coalesce(F.col("term") == w, F.lit(False))).alias(f"f{i}") for i, w in enumerate(words)])
    return flags.where(_condition(tree, {w: F.col(f"f{i}") for i, w in enumerate(words)})).select("doc_id")


def frequencies(posting: DataFrame, words: list[str]) -> dict[str, int]:
    """Document frequencies of a query's few terms."""
    rows = posting.where(F.col("term").isin(*words)).groupBy("term").agg(F.countDistinct("doc_id").alias("n")) if words else None
    return {r["term"]: r["n"] for r in rows.collect()} if rows is not None else {}


def search(query: str, posting: DataFrame, universe: DataFrame | None = None, plan: str = "flag", optimize: bool = False) -> DataFrame:
    """(doc_id) that match a query (B8, B9). ``optimize`` looks the terms' frequencies up first."""
    tree = A.parse(query)
    tree = A.simplify(tree, frequencies(posting, A.terms(tree)) if optimize else None)
    if plan == "flag":
        return flag_plan(tree, posting, universe)
    # The sets of all terms come from one reading of the postings; the universe is only read if the tree needs it.
    found = checkpointed(posting.where(F.col("term").isin(*A.terms(tree))).select("term", "doc_id"))
    return set_plan(tree, found, universe if universe is not None else universe_of(posting))


def flat_search(query: str, posting: DataFrame) -> DataFrame:
    """The flat reading: any AND intersects all terms, else any OR unites them, else the query is one term."""
    parts = query.split()
    words = list(dict.fromkeys(p.lower() for p in parts if p not in ("AND", "OR")))
    if "AND" in parts:
        found = posting.where(F.col("term").isin(*words)).groupBy("doc_id").agg(F.countDistinct("term").alias("n"))
        return found.where(F.col("n") == len(words)).select("doc_id")
    if "OR" in parts:
        return posting.where(F.col("term").isin(*words)).select("doc_id").distinct()
    return term_postings(posting, query.strip())


def _words(query: str) -> tuple[list[str], str]:
    """The words of a flat query in order, and what unites them."""
    parts = query.split()
    joint = "AND" if "AND" in parts else "OR" if "OR" in parts else ""
    return ([p.lower() for p in parts if p not in ("AND", "OR")] if joint else [query.strip().lower()]), joint


def compressed_search(query: str, encoded: DataFrame) -> DataFrame:
    """(doc_id) of the flat reading over ``encoded(term, df, vb)``, of which only the query's lists are decoded."""
    words, _ = _words(query)
    ids = C.ungaps(C.vb_decode("vb"))
    rows = encoded.where(F.col("term").isin(*words)).select("term", F.explode(ids).alias("doc_id"))
    return flat_search(query, rows)


def decoded_lists(query: str, encoded: DataFrame) -> DataFrame:
    """(terms, known_terms, decoded_lists, decoded_bytes) of the flat reading, one row: an AND stops at its first unknown term."""
    words, joint = _words(query)
    spark = encoded.sparkSession
    asked = spark.range(1).select(F.posexplode(F.array(*map(F.lit, words))).alias("at", "term"))
    found = encoded.where(F.col("term").isin(*words)).select("term", F.octet_length("vb").alias("bytes"))
    rows = asked.join(found, "term", "left")
    stop = F.coalesce(F.min(F.when(F.col("bytes").isNull(), F.col("at"))).over(Window.partitionBy()), F.lit(len(words)))  # as many rows as the query has words
    rows = rows.withColumn("read", F.col("bytes").isNotNull() & ((F.col("at") < stop) if joint == "AND" else F.lit(True)))
    return rows.agg(
        F.count("*").alias("terms"), F.count("bytes").alias("known_terms"), F.count_if("read").alias("decoded_lists"),
        F.coalesce(F.sum(F.when(F.col("read"), F.col("bytes"))), F.lit(0)).cast("long").alias("decoded_bytes"),
    )


def decode_count(query: str, known: set[str]) -> int:
    """Lists that the flat reading decodes: an AND stops at its first unknown term."""
    parts = query.split()
    words = [p.lower() for p in parts if p not in ("AND", "OR")]
    if "AND" in parts:
        n = 0
        for w in words:
            if w not in known:
                break
            n += 1
        return n
    if "OR" in parts:
        return sum(w in known for w in words)
    return int(query.strip().lower() in known)
