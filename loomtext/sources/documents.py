"""Readers and writers of documents, token files, events and text indexes."""

from __future__ import annotations

import itertools
import os

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from .stored import store

EVENT = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("name", T.StringType()), T.StructField("time", T.StringType()),
    T.StructField("venue", T.StructType([T.StructField("name", T.StringType())])), T.StructField("description", T.StringType()),
])


def read_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def read_events(spark: SparkSession, folder: str, max_files: int | None = None) -> DataFrame:
    """(file_name, id, name, time, venue_name, description) of event files with a description.

    Malformed files give null fields and fall out with those that lack a
    description. ``max_files`` takes the first by name. Of equal ids the last file wins.
    """
    files = spark.read.option("pathGlobFilter", "PastEvent*.[xX][mM][lL]").text(folder, wholetext=True)
    name = F.col("_metadata.file_name")
    if max_files is not None:
        # Names alone settle which files count; their contents are read after.
        first = files.select(name.alias("chosen")).orderBy("chosen").limit(max_files)
        files = files.select(name.alias("file_name"), "value").join(first, F.col("file_name") == F.col("chosen"), "left_semi")
    else:
        files = files.select(name.alias("file_name"), "value")
    return parse_events(files)


def parse_events(files: DataFrame) -> DataFrame:
    """The events of files(file_name, value) with a description."""
    parsed = files.select("file_name", F.from_xml("value", EVENT, {"mode": "PERMISSIVE"}).alias("e"))
    described = parsed.where(F.coalesce(F.length("e.description"), F.lit(0)) > 0)
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    return described.select("file_name", blank("e.id").alias("id"), blank("e.name").alias("name"), blank("e.time").alias("time"), blank("e.venue.name").alias("venue_name"), X.clean_markup(X.html_unescape("e.description"), "(?U)").alias("description"))


def event_documents(events: DataFrame) -> DataFrame:
    """(doc_id, text) of events with an id, the last file of each id."""
    order = Window.partitionBy("id").orderBy(F.desc("file_name"))
    last = events.where(F.col("id") != "").withColumn("n", F.row_number().over(order)).where("n = 1")
    return last.select(X.doc_number(F.col("id"), None).alias("doc_id"), F.col("description").alias("text"))


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, tokens) of ``{id}.txt`` files with one token a line; empty files are no documents."""
    try:
        store(folder)
    except (ValueError, OSError):  # a store that only Spark knows: the driver lists it
        name = F.url_decode(F.replace(F.col("_metadata.file_name"), F.lit("+"), F.lit("%2B")))
        files = spark.read.option("pathGlobFilter", "*.txt").text(folder, wholetext=True).select(name.alias("file_name"), "value")
    else:
        files = _read_files(_list_files(spark, folder), folder).select("file_name", F.col("value").cast("string").alias("value"))
    files = files.where("file_name <> 'mwe_phrases.txt'")
    lines = F.filter(F.transform(F.split("value", "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")
    name = F.regexp_extract("file_name", r"^(.*)\.[^.]*$", 1)
    return files.select(X.doc_number(name, None).alias("doc_id"), lines.alias("tokens")).where(F.size("tokens") > 0)


#: Names or bytes of files in one batch.
LISTED_NAMES, READ_BYTES = 1 << 16, 1 << 23


def _list_files(spark: SparkSession, folder: str) -> DataFrame:
    """(file_name) of the folder's text files, listed by a task, so that the driver holds no name, whatever their number."""

    def names():
        system, inner = store(folder)
        if isinstance(system, fs.LocalFileSystem):
            with os.scandir(inner) as found:
                yield from (entry.name for entry in found if entry.is_file())
        else:
            yield from (info.base_name for info in system.get_file_info(fs.FileSelector(inner)) if info.is_file)

    def run(batches):
        for batch in batches:
            # Hidden files are none, as for Spark's readers.
            chosen = (name for name in names() if name.endswith(".txt") and name[0] not in "._")
            while len(batch) and (part := list(itertools.islice(chosen, LISTED_NAMES))):
                yield pa.RecordBatch.from_pydict({"file_name": pa.array(part, pa.string())})

    return spark.range(0, 1, 1, 1).mapInArrow(run, "file_name string")


def _read_files(names: DataFrame, folder: str) -> DataFrame:
    """(file_name, value) of whole files; each task reads a share of the names, however small the files are."""

    def run(batches):
        system, inner = store(folder)
        for batch in batches:
            held, values, size = [], [], 0
            for name in batch.column("file_name").to_pylist():
                with system.open_input_stream(f"{inner}/{name}") as file:
                    values.append(file.read())
                held.append(name)
                size += len(values[-1])
                if size >= READ_BYTES:
                    yield pa.RecordBatch.from_pydict({"file_name": pa.array(held, pa.string()), "value": pa.array(values, pa.binary())})
                    held, values, size = [], [], 0
            yield pa.RecordBatch.from_pydict({"file_name": pa.array(held, pa.string()), "value": pa.array(values, pa.binary())})

    tasks = int(names.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return names.repartition(tasks).mapInArrow(run, "file_name string, value binary")


def write_token_files(docs: DataFrame, folder: str) -> None:
    """A file with one token a line for each document (K2), written by the executors into a folder of any store that Arrow knows."""

    def write(batches):
        system, inner = store(folder)
        system.create_dir(inner, recursive=True)
        for batch in batches:
            for number, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                with system.open_output_stream(f"{inner}/{number}.txt") as file:
                    file.write(text.encode())
            yield batch.select(["doc_id"]).slice(0, 0)

    rows = docs.select("doc_id", F.coalesce(F.array_join("tokens", "\n"), F.lit("")).alias("text"))
    rows.mapInArrow(write, docs.select("doc_id").schema).write.format("noop").mode("overwrite").save()


def write_phrases(spark: SparkSession, phrases, folder: str) -> None:
    """The phrase lexicon, one a line in lexicon order (K3)."""
    rows = spark.createDataFrame([(i, p) for i, p in enumerate(X.order_phrases(phrases))], "i int, value string")
    rows.coalesce(1).sortWithinPartitions("i").select("value").write.mode("overwrite").text(folder)


def read_phrases(spark: SparkSession, folder: str) -> list[str]:
    return X.order_phrases(r["value"] for r in spark.read.text(folder).where("value <> ''").toLocalIterator())


def write_text_index(lists: DataFrame, folder: str) -> None:
    """``term<TAB>id,id,...`` by term (K4)."""
    line = F.concat_ws("\t", "term", F.concat_ws(",", F.col("doc_ids").cast("array<string>")))
    lists.orderBy("term").select(line.alias("value")).write.mode("overwrite").text(folder)


def read_text_index(spark: SparkSession, folder: str) -> DataFrame:
    """(term, df, doc_ids); lines without exactly one tab are passed over."""
    parts = spark.read.text(folder).select(F.split("value", "\t").alias("p")).where(F.size("p") == 2)
    ids = F.filter(F.transform(F.split(F.col("p")[1], ","), lambda x: x.try_cast("bigint")), lambda x: x.isNotNull())
    return parts.select(F.col("p")[0].alias("term"), F.size(ids).cast("long").alias("df"), ids.alias("doc_ids"))


def write_positional_text(ppostings: DataFrame, folder: str) -> None:
    """``term total; doc:p1,p2; doc:p...`` by term (K5)."""
    order = F.array_sort(F.collect_list(F.struct("doc_id", "positions")))
    lists = ppostings.groupBy("term").agg(F.sum("tf").alias("cf"), order.alias("docs"))
    parts = F.transform("docs", lambda d: F.concat(d["doc_id"].cast("string"), F.lit(":"), F.concat_ws(",", d["positions"].cast("array<string>"))))
    line = F.concat_ws("; ", F.concat_ws(" ", "term", F.col("cf").cast("string")), F.array_join(parts, "; "))
    lists.orderBy("term").select(line.alias("value")).write.mode("overwrite").text(folder)


def read_positional_text(spark: SparkSession, folder: str) -> DataFrame:
    """(term, doc_id, tf, positions) of ``term total; doc:p1,p2; ...`` lines."""
    parts = spark.read.text(folder).select(F.split("value", "; ").alias("p"))
    rows = parts.select(F.regexp_extract(F.col("p")[0], r"^(.*) \d+$", 1).alias("term"), F.explode(F.slice("p", 2, F.size("p"))).alias("d"))
    halves = rows.select("term", F.split("d", ":").alias("h"))
    positions = F.split(F.col("h")[1], ",").cast("array<bigint>")
    return halves.select("term", F.col("h")[0].cast("long").alias("doc_id"), F.size(positions).cast("long").alias("tf"), positions.alias("positions"))


def dictionary_report(dictionary: DataFrame) -> DataFrame:
    """(line): the dictionary in fixed columns, long terms cut."""
    return dictionary.orderBy("term").select(F.format_string("%-30s%-15d%-15d", X.shown_term(F.col("term")), "doc_freq", "text_pointer").alias("line"))
