"""Documents to terms: tokenise, filter with reasons, normalise; and the counters of each step."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import AnalyzerConfig
from ..functions import text as T


def raw_tokens(docs: DataFrame, config: AnalyzerConfig, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, raw) with the tokens before any rule."""
    text = F.col(text_col)
    if config.merge_phrases and config.phrases:
        text = T.merge_phrases(text, config.phrases)
        if config.profile == "letters":
            # Merged phrases keep their underscores.
            return docs.select(F.col(id_col).alias("doc_id"), F.regexp_extract_all(text, F.lit(r"[\p{L}_]+"), F.lit(0)).alias("raw"))
    return docs.select(F.col(id_col).alias("doc_id"), T.tokens(text, config.profile).alias("raw"))


def _reason(token, config: AnalyzerConfig):
    return T.removal_reason(token, config, config.profile == "letters" and not config.merge_phrases)


def judged_tokens(docs: DataFrame, config: AnalyzerConfig, **columns) -> DataFrame:
    """(doc_id, token, reason) by token; ``reason`` is null for those that stay."""
    exploded = raw_tokens(docs, config, **columns).select("doc_id", F.explode("raw").alias("token"))
    return exploded.withColumn("reason", _reason(F.col("token"), config))


def filter_counts(docs: DataFrame, config: AnalyzerConfig, **columns) -> DataFrame:
    """(reason, n) over all tokens, with ``kept`` and ``original``."""
    judged = judged_tokens(docs, config, **columns)
    counted = judged.groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))
    return counted.union(counted.agg(F.lit("original").alias("reason"), F.sum("n").alias("n")).where("n is not null"))


def normalised(token, config: AnalyzerConfig):
    """Lemma lookup is a join (see ``lemmatized``); without it, the stem if asked for, else the token in lower case."""
    bare = F.lower(T.strip_prefix(token))
    return F.when(token.contains("_"), T.strip_prefix(token)).otherwise(T.stem(bare)) if config.stem and not config.lemmatize else bare


def analyze(docs: DataFrame, config: AnalyzerConfig | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, tokens): each document's terms in order (T9). No shuffle; one array expression without stemming."""
    config = config or AnalyzerConfig()
    raw = raw_tokens(docs, config, id_col, text_col)
    kept = F.filter("raw", lambda t: _reason(t, config).isNull())
    if config.profile == "letters" and not config.merge_phrases and (config.lemmatize or not config.stem):
        return raw.select("doc_id", kept.alias("tokens"))  # runs of lower-case letters are normalised as they are
    if config.stem and not config.lemmatize:
        # The stemmer is a pandas function, which arrays' lambdas can't call.
        position = raw.select("doc_id", F.posexplode_outer(kept).alias("pos", "token"))
        stemmed = position.select("doc_id", "pos", normalised(F.col("token"), config).alias("token")).where("token is null or token <> ''")
        return stemmed.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.when(F.col("token").isNotNull(), F.struct("pos", "token")))), lambda x: x["token"]).alias("tokens"))
    return raw.select("doc_id", F.filter(F.transform(kept, lambda t: F.lower(T.strip_prefix(t))), lambda t: t != "").alias("tokens"))


def lemmatized(tokens: DataFrame, lexicon: DataFrame, tags: DataFrame | None = None) -> DataFrame:
    """``tokens(doc_id, pos, term)`` with lemmas of ``lexicon(surface, tag, lemma)``; unknown terms stay.

    ``tags(doc_id, pos, tag)`` gives Treebank tags, ``tags(doc_id, tag)`` one for all of a document; nouns where there is none.
    Whether the lexicon is broadcast is left to Spark's size threshold.
    """
    tagged = tokens.join(tags, [c for c in ("doc_id", "pos") if c in tags.columns], "left") if tags is not None else tokens.withColumn("tag", F.lit("N"))
    tagged = tagged.withColumn("tag", T.wordnet_pos(F.coalesce("tag", F.lit("N"))))
    joined = tagged.join(lexicon.select(F.col("surface").alias("term"), "tag", "lemma"), ["term", "tag"], "left")
    return joined.select("doc_id", "pos", F.when(F.col("term").contains("_"), F.col("term")).otherwise(F.coalesce("lemma", "term")).alias("term"))


def pipeline_totals(docs: DataFrame, config: AnalyzerConfig, **columns) -> DataFrame:
    """Documents, tokens before and after, and the reduction in percent."""
    sizes = raw_tokens(docs, config, **columns).select(
        F.size("raw").cast("long").alias("before"), F.size(F.filter("raw", lambda t: _reason(t, config).isNull())).cast("long").alias("after")
    )
    return sizes.agg(
        F.count("*").alias("documents"), F.sum("before").alias("original_tokens"), F.sum("after").alias("final_tokens"),
        ((1 - F.sum("after") / F.sum("before")) * 100).alias("reduction_percent"),
    )
