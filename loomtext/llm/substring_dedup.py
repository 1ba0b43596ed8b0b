"""Substring deduplication on a compacted de Bruijn graph of words.

Every window of ``k`` consecutive words is an edge between two nodes of k-1
words; an edge that occurs twice or more anywhere is a repeat, and every word
that a repeat covers goes. There are as many edges as words, so they are
compacted before anything is shuffled, first within a document, then in the graph:

1. Consecutive windows that share their minimizer (the leftmost of the smallest
   hashes of the ``m``-word grams in the window) form one *path* of edges. Equal
   windows have equal minimizers at equal offsets, so they can only meet inside
   paths of the same minimizer.
2. A count of minimizers over all documents leaves those of two or more paths,
   and among them those whose paths differ; paths of other minimizers hold no
   repeat. Both sets travel back as bitmaps of fixed size. A wrong bit only lets
   through a path, or edges, without repeats.
3. Paths of equal words are one row of one aggregation: if two or more occur,
   each of their edges is a repeat, with no work by edge. Adjoining equal paths of
   a document, as a word said over and over makes them, are one row.
4. The remaining paths share a minimizer with other words. They, and one copy of
   each repeated path beside them, are laid out as edges between nodes; edges of
   two or more occurrences are counted, and the nodes between them that have more
   than one edge in or out are where the graph branches. The repeated edges of a
   path that occurs once join up across nodes that don't branch, and each such
   nonbranching path is one span.
5. Spans go to their source coordinates, where the words that stand there are
   verified against the repeat before they are cut out: a path by the XXH64 of all
   its words, a nonbranching path of edges by those of its first and last k-1 words
   (between them all, as a path has k-m+1 edges at most and m is 2 or more). What differs stays.

Nodes, paths and spans are told apart by XXH64 of the words as they stand, two for
an edge, and for a path beside its minimizer and a second hash. No key is ever
gathered: hot paths and edges only meet partial aggregates and skew-splittable
joins; what a window function holds is one path.

Cases: null texts have no words, and an empty result text; texts shorter than
``k`` words are kept whole; repeated rows are repeats of each other; rows are
told apart by id and text, so equal or null ids are no matter; other columns
are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, checkpointed, q_hash, session_of, slices, text_bytes, words_of

#: Words of a minimizer gram.
GRAM = 8


def leftmost_least(values: np.ndarray, span: int) -> np.ndarray:
    """The place of the least of every ``span`` consecutive values, the leftmost of equal ones."""
    place, size = np.arange(len(values)), 1
    while size < span:
        step = min(size, span - size)
        left, right = place[:-step], place[step:]
        place = np.where(values[right] < values[left], right, left)
        size += step
    return place


def paths_of(document: np.ndarray, words: np.ndarray, bounds: np.ndarray, k: int, m: int):
    """The paths of some documents: (document, first window, windows, minimizer, content hash).

    Windows count from the first word of their document.
    """
    n = len(words)
    none = np.zeros(0, np.int64)
    nothing = (none, none, none, none.view(np.uint64), none.view(np.uint64))
    if n < k or not (np.diff(bounds) >= k).any():
        return nothing
    at = np.arange(n - m + 1)
    grams = q_hash(words, at, at + m, 1)
    place = leftmost_least(grams, k - m + 1)
    starts = np.arange(n - k + 1)
    inside = starts + k <= bounds[document[: n - k + 1] + 1]
    starts, place = starts[inside], place[inside]
    own = document[starts]
    first = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (own[1:] != own[:-1])]))
    count = np.diff(np.append(first, len(starts)))
    begin = starts[first]
    return own[first], begin - bounds[own[first]], count, grams[place[first]], q_hash(words, begin, begin + count - 1 + k, 0)


def _runs(document: np.ndarray, first: np.ndarray, count: np.ndarray, minimizer: np.ndarray, content: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first path, paths) of each run of adjoining equal paths, as a word said over and over makes them."""
    if not len(first):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = np.ones(len(first), bool)
    new[1:] = (document[1:] != document[:-1]) | (first[1:] != first[:-1] + count[:-1]) | (minimizer[1:] != minimizer[:-1]) | (content[1:] != content[:-1])
    heads = np.flatnonzero(new)
    return heads, np.diff(np.append(heads, len(first)))


class Spelled:
    """The words of one text, joined by one space, and digests of any of its stretches."""

    def __init__(self, text: bytes):
        self.words = text.split()
        self.joined = b" ".join(self.words)
        self.ends = np.cumsum([len(w) + 1 for w in self.words]).tolist()

    def digest(self, begin: int, end: int) -> int:
        """XXH64 of the words from ``begin`` to ``end``, signed."""
        start = self.ends[begin - 1] if begin else 0
        value = xxhash.xxh64_intdigest(self.joined[start : self.ends[end - 1] - 1])
        return value - (1 << 64) if value >> 63 else value

    def holds(self, at: int, n: int, times: int, head: int, tail: int | None, k: int) -> bool:
        """Whether the span says what its repeat does: ``times`` paths of the digest ``head``, or edges between the nodes ``head`` and ``tail``."""
        if at + n - 1 + k > len(self.words):
            return False
        if tail is not None:
            return self.digest(at, at + k - 1) == head and self.digest(at + n, at + n + k - 1) == tail
        size = n // times
        return all(self.digest(at + t * size, at + (t + 1) * size - 1 + k) == head for t in range(times))


def _paths(docs: DataFrame, k: int, m: int):
    """All paths as (minimizer, content, times), for counting."""

    def run(batches):
        for part in slices(batches, "text"):
            document, first, count, minimizer, content = paths_of(*words_of(part.column(0)), k, m)
            heads, times = _runs(document, first, count, minimizer, content)
            yield pa.RecordBatch.from_arrays([pa.array(minimizer[heads].view(np.int64)), pa.array(content[heads].view(np.int64)), pa.array(times)], names=["mh", "c1", "times"])

    return docs.select("text").mapInArrow(run, "mh long, c1 long, times long")


def shared_minimizers(docs: DataFrame, k: int, m: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Two bitmaps of 2**bits bits: minimizers of two or more paths, and those whose paths differ in content."""
    seen = _paths(docs, k, m).groupBy("mh").agg(F.sum("times").alias("n"), F.min("c1").alias("low"), F.max("c1").alias("high")).where("n > 1")
    slot = F.shiftrightunsigned(F.xxhash64("mh"), 64 - bits)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), slot.bitwiseAND(63).cast("int"))
    # At most 2**(bits-6) rows of two 64-bit words reach the driver, whatever the input.
    rows = seen.groupBy(F.shiftrightunsigned(slot, 6).alias("word")).agg(F.bit_or(bit).alias("seen"), F.bit_or(F.when(F.col("low") != F.col("high"), bit).otherwise(0)).alias("differ")).toArrow()
    out = []
    for name in ("seen", "differ"):
        bitmap = np.zeros(1 << (bits - 6), np.uint64)
        bitmap[rows.column("word").to_numpy()] = rows.column(name).to_numpy().view(np.uint64)
        out.append(bitmap)
    return out[0], out[1]


def _member(bitmap: np.ndarray, slot: np.ndarray) -> np.ndarray:
    return (bitmap[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) == 1


def _xxh64_of_long(values: np.ndarray) -> np.ndarray:
    """Spark's xxhash64 (seed 42) of long columns, vectorised: XXH64 of eight bytes."""
    p1, p2, p3, p4, p5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    rotl = lambda x, r: (x << np.uint64(r)) | (x >> np.uint64(64 - r))
    h = np.uint64(42 + 0x27D4EB2F165667C5 + 8 & (1 << 64) - 1) ^ (rotl(values * p2, 31) * p1)
    h = rotl(h, 27) * p1 + p4
    h ^= h >> np.uint64(33)
    h *= p2
    h ^= h >> np.uint64(29)
    h *= p3
    return h ^ (h >> np.uint64(32))


def _candidates(docs: DataFrame, k: int, m: int, shared, bits: int, with_nodes: bool) -> DataFrame:
    """The paths whose minimizer is in the first bitmap; with the digests of their nodes if it is in the second."""

    def run(batches):
        seen, differ = shared.value
        for part in slices(batches, "text"):
            document, first, count, minimizer, content = paths_of(*words_of(part.column(2)), k, m)
            heads, times = _runs(document, first, count, minimizer, content)
            slot = _xxh64_of_long(minimizer[heads]) >> np.uint64(64 - bits)
            known = _member(seen, slot)
            keep, times = heads[known], times[known]
            laid = _member(differ, slot[known]) if with_nodes else np.zeros(len(keep), bool)
            text, spelled, at_doc, digests, nodes, sizes = part.column(2), None, -1, [], [], []
            for d, p, n, lay in zip(document[keep].tolist(), first[keep].tolist(), count[keep].tolist(), laid.tolist(), strict=True):
                if d != at_doc:
                    spelled, at_doc = Spelled(text[d].as_py().encode()), d
                digests.append(spelled.digest(p, p + n - 1 + k))
                if lay:
                    nodes += [spelled.digest(x, x + k - 1) for x in range(p, p + n + 1)]
                sizes.append(n + 1 if lay else 0)
            arrays = [pa.array(x[keep].view(np.int64)) for x in (minimizer, content)] + [pa.array(digests, pa.int64())]
            arrays += [part.column(0).take(pa.array(document[keep])), part.column(1).take(pa.array(document[keep])), pa.array(first[keep].astype(np.int32)), pa.array((count[keep] * times).astype(np.int32)), pa.array(times.astype(np.int32))]
            names = ["mh", "c1", "c2", "id", "tk", "at", "n", "times"]
            if with_nodes:
                offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                arrays.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(nodes, pa.int64())))
                names.append("ns")
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    schema = "mh long, c1 long, c2 long, id long, tk long, at int, n int, times int" + ", ns array<long>" * with_nodes
    return docs.mapInArrow(run, schema)


def _edges(paths: DataFrame) -> DataFrame:
    """(id, tk, at, copies, i, a, b): the edges of laid-out paths, in place, between the nodes a and b."""
    nodes = paths.where("size(ns) > 1").select("id", "tk", "at", "copies", "ns", F.posexplode(F.slice("ns", 1, F.size("ns") - 1)).alias("i", "a"))
    return nodes.select("id", "tk", "at", "copies", "i", "a", F.col("ns")[F.col("i") + 1].alias("b"))


def nonbranching(compact: DataFrame) -> DataFrame:
    """(id, tk, at, n, head, tail): the repeated edges of paths that occur once, joined up across nodes that don't branch.

    ``compact`` has one row for the paths of equal words. Degrees count distinct repeated edges.
    """
    counted = _edges(compact).groupBy("a", "b").agg(F.sum("copies").alias("occurrences"), F.max(F.col("copies") == 1).alias("single"))
    repeated = checkpointed(counted.where("occurrences > 1").select("a", "b", "single"))
    ends = repeated.select(F.col("a").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("in")).union(repeated.select("b", F.lit(0), F.lit(1)))
    branching = ends.groupBy("node").agg(F.sum("out").alias("out"), F.sum("in").alias("in")).where("`out` > 1 or `in` > 1").select("node", F.lit(True).alias("cut"))
    own = _edges(compact.where("copies = 1")).join(repeated.where("single").select("a", "b"), ["a", "b"], "left_semi")
    own = own.join(branching, F.col("b") == F.col("node"), "left")
    path = Window.partitionBy("id", "tk", "at").orderBy("i")
    joins = (F.lag("i").over(path) == F.col("i") - 1) & F.lag("cut").over(path).isNull()
    own = own.withColumn("new", F.when(F.coalesce(joins, F.lit(False)), 0).otherwise(1)).withColumn("run", F.sum("new").over(path))
    runs = own.groupBy("id", "tk", "at", "run").agg(F.min("i").alias("i"), F.count("*").cast("int").alias("n"), F.min_by("a", "i").alias("head"), F.max_by("b", "i").alias("tail"))
    return runs.select("id", "tk", (F.col("at") + F.col("i")).cast("int").alias("at"), "n", "head", "tail")


def repeated_spans(docs: DataFrame, k: int = 35, m: int = GRAM, bitmap_bits: int = 28) -> DataFrame:
    """(id, tk, at, n, times, head, tail): n repeated windows from window ``at`` on, for ``docs(id, tk, text)``, and what verifies them."""
    spark = session_of(docs)
    shared = spark.sparkContext.broadcast(shared_minimizers(docs, k, m, bitmap_bits))
    path = ["mh", "c1", "c2"]
    whole = _candidates(docs, k, m, shared, bitmap_bits, True)
    # All copies of a path have the same nodes, so min() takes any; of a path that occurs once, the coordinates are its own.
    compact = checkpointed(whole.groupBy(*path).agg(F.sum("times").alias("copies"), F.min("ns").alias("ns"), F.min("id").alias("id"), F.min("tk").alias("tk"), F.min("at").alias("at")))
    edges = nonbranching(compact).select("id", "tk", "at", "n", F.lit(1).alias("times"), "head", "tail")
    copied = compact.where("copies > 1").select(*path)
    paths = _candidates(docs, k, m, shared, bitmap_bits, False).join(copied, path, "left_semi")
    return paths.select("id", "tk", "at", "n", "times", F.col("c2").alias("head"), F.lit(None).cast("long").alias("tail")).union(edges)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 35, m: int = GRAM, bitmap_bits: int = 28) -> DataFrame:
    """(id, n_words, n_removed, kept_text) with one row per row of ``docs``; kept words are joined by one space."""
    if not 1 <= m <= k or k < 2:
        raise ValueError("a minimizer must fit in a window, and a node needs a word")
    bounded_batches(session_of(docs))
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(text_col)).alias("tk"), F.col(text_col).alias("text"))
    spans = repeated_spans(docs, k, m, bitmap_bits)
    # A document has fewer spans than words, so its list is no larger than its text.
    spans = spans.groupBy(F.col("id").alias("span_id"), F.col("tk").alias("span_tk")).agg(F.collect_list(F.struct("at", "n", "times", "head", "tail")).alias("spans"))
    joined = docs.join(spans, F.col("id").eqNullSafe(F.col("span_id")) & (F.col("tk") == F.col("span_tk")), "left")

    def run(batches):
        for part in slices(batches, "text"):
            out = {"n_words": [], "n_removed": [], "kept_text": []}
            for text, spans in zip(text_bytes(part.column(1)), part.column(2), strict=True):
                words = text.split()
                total = len(words)
                if spans.is_valid:
                    spelled, step = Spelled(text), np.zeros(total + 1, np.int64)
                    at, n, times, head, tail = (spans.values.field(i).to_pylist() for i in range(5))
                    for span in zip(at, n, times, head, tail, strict=True):
                        if spelled.holds(*span, k):
                            step[span[0]] += 1
                            step[span[0] + span[1] - 1 + k] -= 1
                    keep = np.cumsum(step[:-1]) == 0
                    words = [w for w, yes in zip(words, keep.tolist(), strict=True) if yes]
                out["n_words"].append(total)
                out["n_removed"].append(total - len(words))
                out["kept_text"].append(b" ".join(words))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out["n_words"], pa.int64()), pa.array(out["n_removed"], pa.int64()), pa.array(out["kept_text"], pa.binary()).cast(pa.string())], names=["id", *out])

    return joined.select("id", "text", "spans").mapInArrow(run, "id long, n_words long, n_removed long, kept_text string")
