"""Phrase and proximity queries over occurrences(doc_id, pos, term)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def phrase(query: str, occurrences: DataFrame, merged: bool = False) -> DataFrame:
    """(doc_id) that hold the words of ``query`` one after the other (H1, H2).

    Word i of the phrase at position p votes for the start p - i; a start with all
    votes is a match. One scan and one shuffle, whatever the phrase's length.
    With ``merged``, a document set of the joined term, if any, is the answer (Q30).
    """
    words = query.lower().split()
    if not words:
        return occurrences.select("doc_id").where(F.lit(False))
    if merged and len(words) > 1:
        joined = "_".join(words)
        alone = occurrences.where(F.col("term") == joined).select("doc_id").distinct()
        apart = _grouped(words, occurrences)
        known = occurrences.where(F.col("term") == joined).limit(1).agg(F.count("*").alias("known"))
        return alone.union(apart.join(F.broadcast(known), F.col("known") == 0, "left_semi"))  # one row
    return _grouped(words, occurrences)


def _grouped(words: list[str], occurrences: DataFrame) -> DataFrame:
    if len(words) == 1:
        return occurrences.where(F.col("term") == words[0]).select("doc_id").distinct()
    slots = F.filter(F.transform(F.array(*map(F.lit, words)), lambda w, i: F.when(w == F.col("term"), i)), lambda i: i.isNotNull())
    votes = occurrences.where(F.col("term").isin(*set(words))).select("doc_id", "pos", F.explode(slots).alias("slot"))
    starts = votes.groupBy("doc_id", (F.col("pos") - F.col("slot")).alias("start")).agg(F.count("*").alias("n"))
    return starts.where(F.col("n") == len(words)).select("doc_id").distinct()


def phrase_by_join(query: str, occurrences: DataFrame) -> DataFrame:
    """The same as a chain of self joins on document and position, for two or three rare words."""
    words = query.lower().split()
    if not words:
        return occurrences.select("doc_id").where(F.lit(False))
    found = occurrences.where(F.col("term") == words[0]).select("doc_id", "pos")
    for i, word in enumerate(words[1:], 1):
        there = occurrences.where(F.col("term") == word).select("doc_id", (F.col("pos") - i).alias("pos"))
        found = found.join(there, ["doc_id", "pos"], "left_semi")
    return found.select("doc_id").distinct()


def proximity(a: str, b: str, k: int, occurrences: DataFrame) -> DataFrame:
    """(doc_id) where ``a`` and ``b`` stand at most ``k`` words apart, in any order; terms as given (H3).

    Nearest neighbours are enough: each occurrence looks at the last and the next one of either term.
    """
    if a == b:
        return occurrences.where(F.col("term") == a).select("doc_id").distinct()
    rows = occurrences.where(F.col("term").isin(a, b))
    # Positions of two terms in one document: no longer than the document.
    lists = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "term"))).alias("at"))
    pairs = F.zip_with(F.slice("at", 1, F.greatest(F.size("at") - 1, F.lit(0))), F.slice("at", 2, F.greatest(F.size("at"), F.lit(1))), lambda x, y: (x["term"] != y["term"]) & (y["pos"] - x["pos"] <= k))
    return lists.where(F.exists(pairs, lambda hit: hit.isNotNull() & hit)).select("doc_id")
