"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of ``documents``. Null ids, repeated ids and repeated rows,
null, empty and very long texts, empty tables and columns of any other name are
defined for each stage; a column of ``docs`` that is named as a helper of an
operator passes through unchanged.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.llm.common import crc_mod, shared_folder, table, unused
from loomtext.llm.decontaminate import decontaminate
from loomtext.llm.line_dedup import deduplicate_lines
from loomtext.llm.mixing import mix_sources
from loomtext.llm.simhash import simhash_deduplicate
from loomtext.llm.toxicity import train, with_toxicity


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier rejects go.

    Null and empty texts are scored as empty; rows of null or equal ids are scored each by itself; without labels all stay.
    """
    labels = table(spark, sf_dir, "labels")
    model = train(docs.select("doc_id", "text"), labels.where(crc_mod(labels["doc_id"], 4) != 2))
    own = unused(docs)
    return with_toxicity(docs, model, threshold=0.3, prefix=own).where(f"{own}predicted = 0").select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of three-line windows go; a document of which nothing but white space is left goes with them.

    Texts of fewer than three lines stay, null and empty ones too; of rows equal in id and text one counts as the first.
    ``n_chars`` follows the text where lines went.
    """
    own = unused(docs)
    out = deduplicate_lines(docs, prefix=own)
    changed = F.col(f"{own}n_removed") > 0
    out = out.where(~changed | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return out.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (5-word Jaccard of 0.8 or more) stays: that of the smallest doc_id.

    Null ids come after all others; of several texts under one id each is judged by itself; of equal rows one stays;
    texts without words are copies of each other.
    """
    return simhash_deduplicate(docs, shingle=5, similarity=0.8).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go; null and empty texts hold none."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: the documents it takes words of, with ``size``, ``source_size``, ``target`` and ``taken``.

    Columns of these names are replaced. Every row is taken by itself, equal ones too; they are told apart by their
    place in ``docs``, which must read the same twice, as files do. Texts without words aren't taken; a null source is one.
    """
    own = unused(docs)
    row = f"{own}row"
    keyed = docs.drop("size", "source_size", "target", "taken").withColumn(row, F.monotonically_increasing_id())
    mixed = mix_sources(keyed, row_col=row).where("taken > 0").select(F.col("row").alias(row), "size", "source_size", "target", "taken")
    return keyed.join(mixed, row).drop(row)


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
]

#: A trained model has no SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def _remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder through Spark's file systems."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``.

    What lies between goes to the folder of ``spark.checkpoint.dir``; a stage's table is removed when the next one is
    written, and the last one stays, as the result reads it.
    """
    base = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = table(spark, sf_dir, "documents"), None
    for at, (name, stage) in enumerate(STAGES):
        path = f"{base}/{at}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            _remove(spark, before)
        before = path
    return docs
