"""SimHash near-duplicates linked through BK-trees.

A document's fingerprint is the bitwise majority over the XXH64 hashes of its
word shingles. Documents link when their fingerprints differ in ``radius`` bits
or fewer; a group is a connected component of links.

Search: the 64 bits are cut into 8 blocks. Fingerprints at most two bits apart
agree on at least 6 blocks, so each distinct fingerprint goes to one shard for
every choice of ``8 - radius`` blocks. All members of a shard agree on 48 bits
(for radius 2), so a shard has 2**16 members at the very most, whatever the
input. Each shard becomes a BK-tree, children keyed by their integer Hamming
distance to the parent, and a search follows only the edges whose key lies
within the radius of the distance to the node. A shard emits the links of a
spanning forest; no pair within the radius is lost from the components.

Cases: null and empty texts and texts of white space have fingerprint zero,
which links like any other; repeated rows and equal texts share a fingerprint
and hence a group; rows with a null id stay, and take the smallest non-null id
of their group (null where there is none); other columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bktree import BKTree
from .common import bounded_batches, checkpointed, session_of, slices, text_bytes
from .components import connected_components, one_of_each
from .simhash_similar import similar_groups

BLOCKS = 8
WIDTH = 64 // BLOCKS


def fingerprints_of(texts: list[bytes], shingle: int = 3, seed: int = 42) -> np.ndarray:
    """The fingerprint of each UTF-8 text, as uint64."""
    hashes, counts, digest, join = [], [], xxhash.xxh64_intdigest, b" ".join
    for text in texts:
        words = text.lower().split()
        if len(words) > shingle:
            grams = zip(*(words[i:] for i in range(shingle)))
            own = [digest(join(g), seed) for g in grams]
        elif words:
            own = [digest(join(words), seed)]
        else:
            own = []
        hashes += own
        counts.append(len(own))
    out = np.zeros(len(texts), np.uint64)
    count = np.array(counts, np.int64)
    some = np.flatnonzero(count)
    if len(some):
        bits = np.unpackbits(np.array(hashes, ">u8").view(np.uint8).reshape(-1, 8), axis=1)
        starts = np.concatenate([[0], np.cumsum(count[some])[:-1]])
        ones = np.add.reduceat(bits, starts, axis=0, dtype=np.uint32)
        majority = 2 * ones.astype(np.int64) > count[some][:, None]
        out[some] = np.packbits(majority, axis=1).view(">u8").ravel().astype(np.uint64)
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, seed: int = 42, *keep: str) -> DataFrame:
    """(id, fp) with one row per input row, and the long columns of ``keep``; ``fp`` is the fingerprint as a signed 64-bit integer."""

    def run(batches):
        for part in slices(batches, "text", 1 << 19):
            fp = fingerprints_of(text_bytes(part.column(1)), shingle, seed)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fp.view(np.int64)), *part.columns[2:]], names=["id", "fp", *keep])

    bounded_batches(session_of(docs))
    columns = [F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), *keep]
    return docs.select(*columns).mapInArrow(run, ", ".join(f"{n} long" for n in ("id", "fp", *keep)))


def shard_links(values: list[int], radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among distinct fingerprints of one shard, found by its BK-tree."""
    tree, root, out = BKTree(), list(range(len(values))), []
    for new, value in enumerate(values):
        for other in tree.within(value, radius):
            a, b = other, new
            while root[a] != a:
                root[a] = root[root[a]]
                a = root[a]
            while root[b] != b:
                root[b] = root[root[b]]
                b = root[b]
            if a != b:
                root[max(a, b)] = min(a, b)
                out.append((values[min(a, b)], values[max(a, b)]))
        tree.add(value)
    return out


def _masks(radius: int) -> list[int]:
    """For each choice of blocks that are kept, the bits they cover."""
    block = (1 << WIDTH) - 1
    return [sum(block << (WIDTH * i) for i in kept) for kept in combinations(range(BLOCKS), BLOCKS - radius)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(distinct: DataFrame, radius: int = 2) -> DataFrame:
    """Links (a, b) that connect all fingerprints of ``distinct(fp)`` within the radius of each other."""

    def run(batches):
        held = {"shard": np.zeros(0, np.int64), "key": np.zeros(0, np.int64), "fp": np.zeros(0, np.int64)}

        def emit(shard, key, fp):
            cut = np.flatnonzero(np.concatenate([[True], (shard[1:] != shard[:-1]) | (key[1:] != key[:-1]), [True]]))
            sizes, out = np.diff(cut), []
            for g in np.flatnonzero(sizes > 1):
                out += shard_links(fp[cut[g] : cut[g + 1]].view(np.uint64).tolist(), radius)
            pairs = np.array(out, np.uint64).reshape(-1, 2).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], names=["a", "b"])

        for batch in batches:
            now = {n: np.concatenate([held[n], batch.column(i).to_numpy(zero_copy_only=False)]) for i, n in enumerate(held)}
            if not len(now["fp"]):
                continue
            # The last shard may go on in the next batch; at most 2**16 rows wait for it.
            last = (now["shard"] == now["shard"][-1]) & (now["key"] == now["key"][-1])
            whole = len(last) - int(np.argmin(last[::-1])) if not last.all() else 0
            held = {n: x[whole:] for n, x in now.items()}
            if whole:
                yield emit(*(x[:whole] for x in now.values()))
        if len(held["fp"]):
            yield emit(*held.values())

    spark = session_of(distinct)
    bounded_batches(spark, 20000)
    keys = F.array(*[F.col("fp").bitwiseAND(F.lit(_signed(m))) for m in _masks(radius)])
    dealt = distinct.select("fp", F.posexplode(keys).alias("shard", "key")).select(F.col("shard").cast("long"), "key", "fp")
    dealt = dealt.repartition("shard", "key").sortWithinPartitions("shard", "key", "fp")
    return dealt.mapInArrow(run, "a long, b long")


def hex_of(column: Column) -> Column:
    """16 lower-case hex digits of a signed 64-bit column."""
    return F.lower(F.lpad(F.hex(column), 16, "0"))


def _prints_and_groups(docs: DataFrame, id_col: str, text_col: str, shingle: int, radius: int, seed: int, *keep: str) -> tuple[DataFrame, DataFrame]:
    """The fingerprints of ``docs``, and (fp, first_id, component) of each distinct one."""
    if not 0 <= radius < BLOCKS:
        raise ValueError(f"radius must be from 0 to {BLOCKS - 1}")
    # Cut here: fingerprints are dear, and both the search and the result read them.
    prints = checkpointed(fingerprints(docs, id_col, text_col, shingle, seed, *keep))
    distinct = prints.groupBy("fp").agg(F.min("id").alias("first_id"))
    members = connected_components(links(distinct.select("fp"), radius))
    return prints, distinct.join(members, distinct.fp == members.id, "left").select("fp", "first_id", F.coalesce("component", "fp").alias("component"))


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 2, seed: int = 42) -> DataFrame:
    """(id, fp, component_id) with one row per row of ``docs``."""
    prints, labelled = _prints_and_groups(docs, id_col, text_col, shingle, radius, seed)
    smallest = labelled.groupBy("component").agg(F.min("first_id").alias("component_id"))
    return prints.join(labelled.join(smallest, "component").select("fp", "component_id"), "fp")


def simhash_deduplicate(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 2, seed: int = 42, similarity: float | None = None,
) -> DataFrame:
    """``docs`` with one document of each group: the one of the smallest id (null ids after all others; see ``one_of_each``).

    With ``similarity`` a group is one of near copies by the Jaccard similarity of their shingles (see ``simhash_similar``),
    else one of fingerprints within ``radius`` bits.
    """
    if similarity is not None:
        return one_of_each(docs, similar_groups(docs, id_col, text_col, shingle, similarity), id_col, text_col)
    prints, labelled = _prints_and_groups(docs.select(id_col, text_col, F.xxhash64(text_col).alias("__tk")), id_col, text_col, shingle, radius, seed, "__tk")
    members = prints.join(labelled, "fp").select("id", F.col("__tk").alias("tk"), "component")
    return one_of_each(docs, members, id_col, text_col)
