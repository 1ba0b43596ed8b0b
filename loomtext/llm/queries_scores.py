"""Registered queries of the two classifiers."""

from __future__ import annotations

from .common import crc_mod, table
from .quality import train_quality, with_quality
from .toxicity import train, with_toxicity


def op1_quality_bradley_terry(spark, sf_dir):
    """One row per document: whether it was held out, its score and class."""
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    model = train_quality(docs, labels.where(crc_mod(labels["doc_id"], 3) != 1))
    out = with_quality(docs, model)
    return out.select("doc_id", (crc_mod(out["doc_id"], 3) == 1).alias("held_out"), "score", "predicted")


def op8_toxicity_counterfactual(spark, sf_dir):
    """One row per document: whether it was held out, its score and class."""
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    model = train(docs, labels.where(crc_mod(labels["doc_id"], 4) != 2))
    out = with_toxicity(docs, model, threshold=0.3)
    return out.select("doc_id", (crc_mod(out["doc_id"], 4) == 2).alias("held_out"), "score", "predicted")


QUERIES = {"op1_quality_bradley_terry": op1_quality_bradley_terry, "op8_toxicity_counterfactual": op8_toxicity_counterfactual}
ORACLES: dict[str, str] = {}
