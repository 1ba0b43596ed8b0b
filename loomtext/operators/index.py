"""Inverted indexes as tables: term frequencies, postings, positional postings, dictionaries, encodings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import IndexConfig
from ..functions import codec as C
from ..functions.text import doc_number
from ..sources.stored import checkpointed
from .ranking import document_frequencies, stored_statistics


def by_document(docs: DataFrame, distinct: bool = False) -> DataFrame:
    """(doc_id, tokens) with all rows of an id in one task, so that what is grouped by id and term needs no shuffle after.

    Documents move as arrays, before they are exploded, and all readings of them share that one shuffle. The arrays are
    exploded by ``explode_outer``: for a plain ``explode`` the optimizer adds a filter on the array's size, which it moves
    below and which tokenises every text once more.
    """
    tokens = F.array_distinct("tokens") if distinct else F.col("tokens")
    return docs.select("doc_id", tokens.alias("tokens")).repartition("doc_id")


def occurrences(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, term) from ``docs(doc_id, tokens)``; positions count from 1 in the normalised stream."""
    exploded = docs.select("doc_id", F.posexplode_outer("tokens").alias("at", "term")).where("at is not null")
    return exploded.select("doc_id", (F.col("at") + 1).cast("long").alias("pos"), "term")


def term_frequencies(docs: DataFrame) -> DataFrame:
    """(doc_id, term, tf) (A5)."""
    terms = by_document(docs).select("doc_id", F.explode_outer("tokens").alias("term")).where("term is not null")
    return terms.groupBy("doc_id", "term").agg(F.count("*").alias("tf"))


def document_stats(tf: DataFrame) -> DataFrame:
    """(doc_id, doc_len, max_tf, n_terms)."""
    return tf.groupBy("doc_id").agg(F.sum("tf").alias("doc_len"), F.max("tf").alias("max_tf"), F.count("*").alias("n_terms"))


def postings(docs: DataFrame) -> DataFrame:
    """(term, doc_id), distinct (I3). Duplicates within a document go before the shuffle."""
    terms = by_document(docs, distinct=True).select("doc_id", F.explode_outer("tokens").alias("term"))
    return terms.where("term is not null").select("term", "doc_id").distinct()


def index_lists(posting: DataFrame) -> DataFrame:
    """(term, df, doc_ids) with sorted lists, for encoding.

    A list is as long as its term is frequent, as the encoded forms need; queries use the long form.
    """
    return posting.groupBy("term").agg(F.count("*").alias("df"), F.sort_array(F.collect_list("doc_id")).alias("doc_ids"))


def positional_postings(docs: DataFrame) -> DataFrame:
    """(term, doc_id, tf, positions) (I4)."""
    ordered = by_document(docs).sortWithinPartitions("doc_id")
    return ordered.mapInArrow(_positions_by_term, f"term string, doc_id {docs.schema['doc_id'].dataType.simpleString()}, tf long, positions array<long>")


#: Documents whose positions are grouped at once.
GROUPED_DOCUMENTS = 1000


def _positions_by_term(batches):
    """Rows of (term, doc_id, tf, positions) from batches of (doc_id, tokens) in the order of ids; an id's rows are grouped together."""
    held = None
    for batch in batches:
        for at in range(0, len(batch), GROUPED_DOCUMENTS):
            part = pa.Table.from_batches([batch.slice(at, GROUPED_DOCUMENTS)])
            held = part if held is None else pa.concat_tables([held, part])
            # The last id may go on in what follows.
            ids = held.column("doc_id").combine_chunks()
            last, cut = ids[len(ids) - 1], len(ids) - 1
            while cut and ids[cut - 1] == last:
                cut -= 1
            if cut:
                yield from _grouped(held.slice(0, cut))
                held = held.slice(cut)
    if held is not None and len(held):
        yield from _grouped(held)


def _grouped(docs: pa.Table):
    docs = docs.combine_chunks()
    ids, lists = docs.column("doc_id").chunk(0).dictionary_encode(null_encoding="encode"), docs.column("tokens").chunk(0)
    terms = lists.flatten().dictionary_encode()
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    owner = np.repeat(ids.indices.to_numpy(zero_copy_only=False).astype(np.int64), sizes)
    pos = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + 1
    key = owner * max(1, len(terms.dictionary)) + terms.indices.to_numpy(zero_copy_only=False)
    order = np.lexsort((pos, key)) if len(ids.dictionary) < len(docs) else np.argsort(key, kind="stable")
    starts = np.flatnonzero(np.diff(key[order], prepend=-1))
    if not len(starts):
        return
    tf = np.diff(np.append(starts, len(order)))
    offsets = pa.array(np.append(starts, len(order)).astype(np.int32))
    chosen = pa.array(order[starts])
    yield pa.RecordBatch.from_arrays([
        terms.dictionary.take(terms.indices.take(chosen)), ids.dictionary.take(pa.array(owner[order[starts]])), pa.array(tf), pa.ListArray.from_arrays(offsets, pa.array(pos[order])),
    ], names=["term", "doc_id", "tf", "positions"])


def index_stats(posting: DataFrame) -> DataFrame:
    """(unique_terms, total_postings, avg_postings_per_term) (A2)."""
    by_term = posting.groupBy("term").agg(F.count("*").alias("df"))
    return by_term.agg(F.count("*").alias("unique_terms"), F.sum("df").alias("total_postings"), F.avg("df").alias("avg_postings_per_term"))


def positional_stats(tf: DataFrame) -> DataFrame:
    """Index statistics with occurrences (A3)."""
    by_term = tf.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))
    return by_term.agg(
        F.count("*").alias("unique_terms"), F.sum("df").alias("total_postings"), F.sum("cf").alias("total_frequency"), F.avg("cf").alias("avg_frequency_per_term")
    )


def collection_stats(docs: DataFrame) -> DataFrame:
    """(total_documents, total_terms, avg_doc_length, vocabulary_size) over documents with terms."""
    full = docs.where(F.size("tokens") > 0)
    sizes = full.agg(F.count("*").alias("total_documents"), F.sum(F.size("tokens")).alias("total_terms"), F.avg(F.size("tokens")).alias("avg_doc_length"))
    words = full.select(F.explode(F.array_distinct("tokens")).alias("term")).distinct().agg(F.count("*").alias("vocabulary_size"))
    return sizes.crossJoin(words)  # one row each


def _numbered(terms: DataFrame, sizes: list[str]) -> DataFrame:
    """``ordinal`` by term, ``n_terms``, and for each size column the exclusive running sum ``<size>_before``, all across ranges of terms.

    Rows are dealt by ranges of terms; each range is numbered by itself and shifted
    by the totals of the ranges before it. No single task sees all terms. The ranges
    are cut from a sample, so they are settled once, in a checkpoint: totals and rows
    that dealt them anew, each for itself, could disagree on where a range ends.
    """
    ranged = checkpointed(terms.repartitionByRange("term").withColumn("__part", F.spark_partition_id()))
    totals = ranged.groupBy("__part").agg(F.count("*").alias("__n"), *[F.sum(s).alias(f"__s_{s}") for s in sizes])
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    shifts = totals.select(
        "__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__n_before"), F.sum("__n").over(whole).alias("n_terms"),
        *[F.coalesce(F.sum(f"__s_{s}").over(before), F.lit(0)).alias(f"__{s}_before") for s in sizes],
    )
    inside = Window.partitionBy("__part").orderBy("term")
    above = inside.rowsBetween(Window.unboundedPreceding, -1)
    out = ranged.join(F.broadcast(shifts), "__part")  # one row for each partition
    return out.select(
        *terms.columns, "n_terms", (F.row_number().over(inside) + F.col("__n_before")).cast("long").alias("ordinal"),
        *[(F.coalesce(F.sum(s).over(above), F.lit(0)) + F.col(f"__{s}_before")).cast("long").alias(f"{s}_before") for s in sizes],
    )


def dictionary(posting: DataFrame, list_bytes: str | None = None) -> DataFrame:
    """(term, doc_freq, ordinal, text_pointer, binary_pointer).

    ``text_pointer`` sums the lengths of the id lists plus a line feed each; ``binary_pointer`` sums 4 bytes a posting.
    """
    sized = posting.groupBy("term").agg(
        F.count("*").alias("doc_freq"), (F.sum(F.length(F.col("doc_id").cast("string"))) + F.count("*")).cast("long").alias("text"), (F.count("*") * 4).alias("binary")
    )
    return _numbered(sized, ["text", "binary"]).select("term", "doc_freq", "ordinal", F.col("text_before").alias("text_pointer"), F.col("binary_before").alias("binary_pointer"))


def positional_dictionary(tf: DataFrame) -> DataFrame:
    """(term, doc_freq, total_freq, ordinal, pointer) of the positional binary form: 4 bytes, and 8 + 2 tf a document."""
    sized = tf.groupBy("term").agg(F.count("*").alias("doc_freq"), F.sum("tf").alias("total_freq"), (F.lit(4) + F.sum(8 + 2 * F.col("tf"))).cast("long").alias("bytes"))
    return _numbered(sized, ["bytes"]).select("term", "doc_freq", "total_freq", "ordinal", F.col("bytes_before").alias("pointer"))


def compressed_dictionary(lists: DataFrame, config: IndexConfig | None = None) -> DataFrame:
    """(ordinal, term, prefix, is_anchor, term_ptr, term_len, freq, ptr): terms in one string with an anchor every K.

    ``ptr`` is the place of the term's variable-byte list.
    """
    k = (config or IndexConfig()).k_interval
    sized = lists.select("term", F.col("df").alias("freq"), F.length("term").cast("long").alias("chars"), vb_bytes(F.col("doc_ids")).alias("bytes"))
    out = _numbered(sized, ["chars", "bytes"])
    anchor = (F.col("ordinal") % k == 0) | (F.col("ordinal") == F.col("n_terms"))
    return out.select("ordinal", "term", F.substring("term", 1, 8).alias("prefix"), anchor.alias("is_anchor"), F.col("chars_before").alias("term_ptr"), F.col("chars").alias("term_len"), "freq", F.col("bytes_before").alias("ptr"))


def top_terms(posting: DataFrame, n: int) -> DataFrame:
    """(term, doc_freq) of the ``n`` most frequent terms, ties by term (O3)."""
    return posting.groupBy("term").agg(F.count("*").alias("doc_freq")).orderBy(F.desc("doc_freq"), "term").limit(n)


# ----------------------------------------------------------------- encodings


#: Ids that one block of a list covers.
BLOCK_IDS = 1 << 20


def gap_rows(posting: DataFrame, block_ids: int = BLOCK_IDS) -> DataFrame:
    """(term, block, doc_id, gap) in long form.

    A list is cut into blocks of ids, each sorted by itself; the first id of a block takes
    its gap from the last one of the block before. So no task sorts all documents of a term,
    and what is carried is one row for each block but a term's first.
    """
    rows = posting.select("term", "doc_id", F.floor(F.col("doc_id") / block_ids).alias("block"))
    lasts = rows.groupBy("term", "block").agg(F.max("doc_id").alias("last"))
    carried = lasts.withColumn("carried", F.lag("last").over(Window.partitionBy("term").orderBy("block"))).where("carried is not null").drop("last")
    rows = rows.withColumn("before", F.lag("doc_id").over(Window.partitionBy("term", "block").orderBy("doc_id"))).join(carried, ["term", "block"], "left")
    return rows.select("term", "block", "doc_id", (F.col("doc_id") - F.coalesce("before", "carried", F.lit(0))).cast("long").alias("gap"))


def encoded_blocks(posting: DataFrame, block_ids: int = BLOCK_IDS) -> DataFrame:
    """(term, block, df, vb): the codes of each block of a list, which follow one another in the list's code (K8).

    However frequent a term is, a row holds ``block_ids`` documents at most.
    """
    codes = F.sort_array(F.collect_list(F.struct("doc_id", C.vb_hex(F.col("gap")).alias("code"))))
    blocks = gap_rows(posting, block_ids).groupBy("term", "block").agg(codes.alias("codes"))
    return blocks.select("term", "block", F.size("codes").cast("long").alias("df"), F.unhex(F.array_join(F.col("codes.code"), "")).alias("vb"))


def vb_bytes(doc_ids):
    """Bytes of the variable-byte code of a list's gaps."""
    return F.aggregate(C.gaps(doc_ids), F.lit(0).cast("long"), lambda s, g: s + C.vb_length(g))


def encoded_lists(lists: DataFrame) -> DataFrame:
    """(term, df, vb): gap and variable-byte coded lists as binary (K8)."""
    return lists.select("term", "df", F.unhex(C.vb_hex_list(C.gaps(F.col("doc_ids")))).alias("vb"))


def compression_stats(posting: DataFrame) -> DataFrame:
    """(postings, uncompressed_bytes, vb_bytes, ratio)."""
    sized = gap_rows(posting).agg(F.count("*").alias("postings"), (F.count("*") * 4).alias("uncompressed_bytes"), F.sum(C.vb_length(F.col("gap"))).alias("vb_bytes"))
    return sized.withColumn("ratio", F.col("vb_bytes") / F.col("uncompressed_bytes"))


def binary_lists(lists: DataFrame) -> DataFrame:
    """(term, df, ids): lists as little-endian 32-bit ids."""
    byte = lambda x, k: F.lpad(F.hex(F.shiftright(x, 8 * k).bitwiseAND(255)), 2, "0")
    code = F.transform("doc_ids", lambda x: F.concat(*[byte(x, k) for k in range(4)]))
    return lists.select("term", "df", F.unhex(F.array_join(code, "")).alias("ids"))


def encoded_positions(ppostings: DataFrame) -> DataFrame:
    """(term, vb): count of documents, then by document its gap, count of positions and their gaps (C11)."""
    hex_of = F.concat(C.vb_hex(F.col("tf")), C.vb_hex_list(C.gaps(F.col("positions"))))
    order = F.sort_array(F.collect_list(F.struct("doc_id", hex_of.alias("code"))))
    whole = ppostings.groupBy("term").agg(order.alias("rows"))
    # A row's own id and the one before; the column of all ids, asked for in here, would be made anew for every document.
    gap = lambda r, i: F.when(i == 0, r["doc_id"]).otherwise(r["doc_id"] - F.get(F.col("rows"), i - 1)["doc_id"])
    codes = F.transform("rows", lambda r, i: F.concat(C.vb_hex(gap(r, i)), r["code"]))
    return whole.select("term", F.unhex(F.concat(C.vb_hex(F.size("rows").cast("long")), F.array_join(codes, ""))).alias("vb"))


def masked_postings(posting: DataFrame, bits: int = 28) -> DataFrame:
    """Ids as numbers of ``bits`` bits, then distinct."""
    return posting.select("term", doc_number(F.col("doc_id"), bits).alias("doc_id")).distinct()


def width_report(posting: DataFrame, config: IndexConfig | None = None) -> DataFrame:
    """(max_doc_id, overflowing, truncated_terms): what the fixed widths would lose."""
    config = config or IndexConfig()
    ids = posting.agg(F.max("doc_id").alias("max_doc_id"), F.count_if(F.col("doc_id") >= 1 << config.doc_id_bits).alias("overflowing"))
    terms = posting.select("term").distinct().agg(F.count_if(F.octet_length("term") > config.term_bytes).alias("truncated_terms"))
    return ids.crossJoin(terms)  # one row each


#: The tables of a stored index.
TABLES = ("tf", "terms", "collection", "doc_stats", "dictionary", "positions")


def write_index(docs: DataFrame, path: str) -> None:
    """All tables of an index as Parquet under ``path``, postings and terms by ranges of terms, so that a lookup reads few row groups.

    Document frequencies, the collection's size and each document's norm by method are computed here once, not by search.
    """
    spark = docs.sparkSession
    # Positions move as 32-bit numbers, which hold any place in an array.
    short = positional_postings(docs).select("term", "doc_id", F.col("positions").cast("array<int>").alias("positions"))
    ranged = short.repartitionByRange("term").sortWithinPartitions("term", "doc_id")
    whole = ranged.select("term", "doc_id", F.size("positions").cast("long").alias("tf"), F.col("positions").cast("array<long>").alias("positions"))
    whole.write.mode("overwrite").parquet(f"{path}/positions")
    # In the order of the positions, by file, so frequencies need no shuffle of their own.
    spark.read.parquet(f"{path}/positions").select("doc_id", "term", "tf").write.mode("overwrite").parquet(f"{path}/tf")
    tf = spark.read.parquet(f"{path}/tf")
    document_frequencies(tf).repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/terms")
    for name, table in stored_statistics(tf, spark.read.parquet(f"{path}/terms")).items():
        table.write.mode("overwrite").parquet(f"{path}/{name}")
    dictionary(tf.select("term", "doc_id")).write.mode("overwrite").parquet(f"{path}/dictionary")


def read_index(spark, path: str) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{path}/{name}") for name in TABLES}
