"""All queries of this subpackage and their SQL."""

from __future__ import annotations

from . import queries_chat, queries_dedup, queries_leaks, queries_mixing, queries_scores, queries_text


def pipeline(spark, sf_dir):
    """All stages of the corpus pipeline."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


_MODULES = (queries_scores, queries_text, queries_leaks, queries_dedup, queries_chat, queries_mixing)
QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()} | {"pipeline": pipeline}
ORACLES = {k: s for m in _MODULES for k, s in m.ORACLES.items()}
