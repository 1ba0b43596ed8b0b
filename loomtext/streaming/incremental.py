"""Incremental tokenising of arriving documents; an extension, with the same analyzer as the batch path."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..config import AnalyzerConfig
from ..operators.analysis import analyze
from ..operators.index import term_frequencies


def stream_documents(spark: SparkSession, folder: str, schema) -> DataFrame:
    """Documents from Parquet files as they land in ``folder``."""
    return spark.readStream.schema(schema).parquet(folder)


def append_tokens(docs: DataFrame, path: str, checkpoint: str, config: AnalyzerConfig | None = None) -> StreamingQuery:
    """Analyzed documents appended to Parquet; stateless, so it never grows."""
    return analyze(docs, config).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def append_frequencies(docs: DataFrame, path: str, checkpoint: str, config: AnalyzerConfig | None = None) -> StreamingQuery:
    """Term frequencies of each batch appended under its number, so that a repeated batch overwrites itself."""

    def write(batch: DataFrame, number: int) -> None:
        term_frequencies(analyze(batch, config)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
