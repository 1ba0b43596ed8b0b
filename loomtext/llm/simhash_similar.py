"""SimHash near-duplicates at a given Jaccard similarity of word shingles.

Two documents link when the sets of their ``shingle``-word shingles have a
Jaccard similarity of ``threshold`` or more; a group is a connected component.

At a similarity of 0.8 the 64-bit SimHashes of two texts differ in about ten
bits. A radius that holds such pairs leaves no block of the fingerprint to deal
shards by, so min-wise hashes deal them:

1. A set goes to ``bands`` shards, by keys of ``rows`` minima each. Two sets of
   similarity s share no shard with probability (1 - s**rows)**bands: under 3e-6
   at 0.8 with the defaults, less above.
2. Equal sets are one member. Shards of one member go; of shards with the same
   members one stays (told by count, least, greatest and XOR of hashes).
3. In a shard every group found so far is a BK-tree of the SimHashes of its sets.
   A new set searches each tree within ``radius`` bits, and what it meets there is
   compared shingle by shingle until a link to the group is found or ruled out. A
   bit of two sets at 0.8 differs with a chance of 0.19 at most (small sets; 0.15
   for large ones), so more than 28 of 64 differ with one under 1e-6.

These two chances are the only loss; nothing is capped. A shard's distinct sets
are held by one task while it is worked on.

Cases: texts are lower-cased by ASCII and cut at ASCII white space; fewer words
than a shingle are one shingle; null texts, empty ones and white space have the
empty set, and are copies of each other; null and equal ids are told apart by text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bktree import BKTree
from .common import bounded_batches, checkpointed, mix, session_of, slices, text_bytes
from .components import connected_components

#: Bits in which the SimHashes of two linked sets may differ.
RADIUS = 28


def shingle_hashes(text: bytes, shingle: int) -> list[int]:
    """XXH64 of the shingles of a text in order; repeated ones are repeated."""
    words, digest, join = text.lower().split(), xxhash.xxh64_intdigest, b" ".join
    if len(words) > shingle:
        return [digest(join(g)) for g in zip(*(words[i:] for i in range(shingle)))]
    return [digest(join(words))] if words else []


def band_keys(hashes: np.ndarray, starts: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """``bands`` keys for each of the runs of ``hashes`` that begin at ``starts`` (none is empty)."""
    draws = mix(np.arange(1, 2 * bands * rows + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    out = np.zeros((len(starts), bands), np.uint64)
    for i in range(bands * rows):
        least = np.minimum.reduceat(hashes * (draws[2 * i] | np.uint64(1)) + draws[2 * i + 1], starts)
        band = i // rows
        out[:, band] = mix(out[:, band] + least + np.uint64(band))
    return out


def sketches(docs: DataFrame, shingle: int, bands: int, rows: int) -> DataFrame:
    """(id, tk, sid, n, keys) of ``docs(id, tk, text)``: ``sid`` stands for the set, ``n`` is its size."""

    def run(batches):
        for part in slices(batches, "text", 1 << 19):
            own = [np.array(shingle_hashes(t, shingle), np.uint64) for t in text_bytes(part.column(2))]
            sets = [np.unique(h) for h in own]
            count = np.array([len(s) for s in sets], np.int64)
            some = np.flatnonzero(count)
            keys = np.zeros((0, bands), np.uint64)
            if len(some):
                keys = band_keys(np.concatenate(sets), np.concatenate([[0], np.cumsum(count[some])[:-1]]), bands, rows)
            sid = np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], np.uint64)
            offsets = np.concatenate([[0], np.cumsum(np.where(count > 0, bands, 0))]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.ravel().view(np.int64)))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(sid.view(np.int64)), pa.array(count), lists], names=["id", "tk", "sid", "n", "keys"])

    return docs.mapInArrow(run, "id long, tk long, sid long, n long, keys array<long>")


def simhashes(sets: list[np.ndarray]) -> np.ndarray:
    """The 64-bit SimHash of each set of hashes: a bit is 1 if set in over half of them."""
    out = np.zeros(len(sets), np.uint64)
    for i, own in enumerate(sets):
        bits = np.unpackbits(own.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        out[i] = np.packbits(2 * bits.sum(0, dtype=np.int64) > len(own)).view(">u8")[0]
    return out


class Group:
    """Sets that are joined, in a BK-tree of their SimHashes."""

    def __init__(self):
        self.tree, self.sets, self.largest = BKTree(), {}, 0

    def add(self, fp: int, sid: int, own: np.ndarray) -> None:
        if fp not in self.sets:
            self.tree.add(fp)
        self.sets.setdefault(fp, []).append((sid, own))
        self.largest = max(self.largest, len(own))

    def take(self, other: Group) -> None:
        for fp, members in other.sets.items():
            for sid, own in members:
                self.add(fp, sid, own)


class Linker:
    """Joins the sets of one shard, given by size from small to large, and says which pairs it joined."""

    def __init__(self, threshold: float, radius: int = RADIUS):
        self.threshold, self.radius = threshold, radius
        self.groups: list[Group] = []

    def similar(self, small: np.ndarray, large: np.ndarray) -> bool:
        at = np.minimum(np.searchsorted(large, small), len(large) - 1)
        both = int(np.count_nonzero(large[at] == small))
        return both / (len(small) + len(large) - both) >= self.threshold

    def match(self, group: Group, fp: int, own: np.ndarray) -> int | None:
        for at in group.tree.within(fp, self.radius):
            for other, theirs in group.sets[group.tree.values[at]]:
                if len(theirs) / len(own) >= self.threshold and self.similar(theirs, own):
                    return other
        return None

    def add(self, sid: int, fp: int, own: np.ndarray) -> list[tuple[int, int]]:
        found, met, apart = [], [], []
        for group in self.groups:
            other = self.match(group, fp, own)
            if other is not None:
                found.append((other, sid))
                met.append(group)
            elif group.largest / len(own) >= self.threshold:
                apart.append(group)
            # Else all of the group are too small for this set and for those to come.
        joined = max(met, key=lambda g: len(g.tree.values), default=None) or Group()
        for group in met:
            if group is not joined:
                joined.take(group)
        joined.add(fp, sid, own)
        self.groups = [*apart, joined]
        return found


def verified_links(members: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b) that connect all sets of ``members(key, sid, n, fp, grams)`` under one key and of the similarity asked for."""

    def run(batches):
        key, last, linker = None, None, None
        for batch in batches:
            out = []
            for k, sid, fp, grams in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3, 4)), strict=True):
                if k != key or linker is None:
                    key, last, linker = k, None, Linker(threshold)
                if sid != last:
                    out += linker.add(sid, fp % (1 << 64), np.frombuffer(grams, np.uint64))
                last = sid
            pairs = np.array(out, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], names=["a", "b"])

    dealt = members.select("key", "sid", "n", "fp", "grams").repartition("key").sortWithinPartitions("key", "n", "sid")
    return dealt.mapInArrow(run, "a long, b long")


def shingle_links(docs: DataFrame, prints: DataFrame, shingle: int, threshold: float) -> DataFrame:
    """Links (a, b) between the ``sid`` of similar sets, for ``docs(id, tk, text)`` and their sketches."""

    def run(batches):
        for part in slices(batches, "text", 1 << 19):
            sets = [np.unique(np.array(shingle_hashes(t, shingle), np.uint64)) for t in text_bytes(part.column(2))]
            yield pa.RecordBatch.from_arrays([*part.columns[:2], pa.array(simhashes(sets).view(np.int64)), pa.array([x.tobytes() for x in sets], pa.binary())], names=["sid", "n", "fp", "grams"])

    keyed = prints.select("sid", F.explode("keys").alias("key")).distinct()
    shards = keyed.groupBy("key").agg(F.count("*").alias("m"), F.min("sid").alias("low"), F.max("sid").alias("high"), F.bit_xor(F.xxhash64("sid")).alias("all"))
    shards = shards.where("m > 1").groupBy("m", "low", "high", "all").agg(F.min("key").alias("key"))
    chosen = checkpointed(keyed.join(shards.select("key"), "key", "left_semi"))
    # One row stands for each set: its text gives the shingles again.
    sets = prints.groupBy("sid").agg(F.min("n").alias("n"), F.min(F.struct("id", "tk")).alias("row"))
    needed = sets.join(chosen.select("sid").distinct(), "sid", "left_semi").select("sid", "n", F.col("row.id").alias("__id"), F.col("row.tk").alias("__tk"))
    texts = docs.join(needed, F.col("id").eqNullSafe(F.col("__id")) & (F.col("tk") == F.col("__tk"))).select("sid", "n", "text")
    grams = texts.mapInArrow(run, "sid long, n long, fp long, grams binary")
    return verified_links(chosen.join(grams, "sid"), threshold)


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, threshold: float = 0.8, bands: int = 24, rows: int = 4) -> DataFrame:
    """(id, tk, component) with one row per row of ``docs``; ``tk`` is the XXH64 of the text."""
    bounded_batches(session_of(docs))
    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("tk"), F.col(text_col).alias("text"))
    # Cut here: shingles are dear, and both the search and the result read what comes of them.
    prints = checkpointed(sketches(plain, shingle, bands, rows))
    members = connected_components(shingle_links(plain, prints, shingle, threshold)).withColumnRenamed("id", "set")
    return prints.join(members, prints.sid == members.set, "left").select("id", "tk", F.coalesce("component", "sid").alias("component"))
