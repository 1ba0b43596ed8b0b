"""Registered queries of the secret scan."""

from __future__ import annotations

from pyspark.sql import functions as F

from .common import table
from .secrets import joined, scan, train


def ordinary_words(docs):
    """(word, n) of the words of letters of all documents, as labelled ordinary strings."""
    words = docs.select(F.explode(F.split("text", r"[\x20\x09-\x0D]+")).alias("word")).where(F.col("word").rlike("^[A-Za-z]{6,}$"))
    return words.groupBy("word").agg(F.count("*").alias("n"))


def words_weight(docs, documents: int = 1000) -> float:
    """What a word counts so that all documents weigh as much as ``documents`` of them: else strings made by rule would fade as the input grows."""
    return min(1.0, documents / max(docs.count(), 1))


def op2_secrets_markov(spark, sf_dir):
    """One row per document: counts of the base forms, the digest of their spans, and all spans."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = scan(docs, table=train(spark, ordinary_words(docs), words_weight(docs)))
    base = F.filter("secrets", lambda x: x["kind"] != "random")
    count = lambda kind: F.size(F.filter("secrets", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return out.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("secrets")).alias("spans"))


QUERIES = {"op2_secrets_markov": op2_secrets_markov}
ORACLES: dict[str, str] = {}
