"""Benchmark decontamination by spaced-seed hashing.

Words are runs of ASCII letters and digits, case folded, and non-ASCII
characters. A document is contaminated by an item if 16 consecutive words of the
item stand in the document with at most 3 substitutions (items of 8 to 15 words:
the whole item, with one substitution for every five words). Items of fewer
than 8 words are no evidence and match nothing.

Search: fixed masks pick some of the positions in a window and ignore the rest.
The masks below leave one placement untouched whatever positions such a number
of substitutions hits, so no overlap is missed. Hashes under the masks of the
items are joined with those at every position of the documents, and each hit is
verified word by word in all windows that hold it.

The benchmark is read in blocks of ``block_words`` words at most (one item at
least), and each block is joined with all documents: that bounds what a
worker and the driver hold, and benchmarks of any size take the same path.

Hits are spread out and verified in chunks of ``CHUNK``, of which only the best
window of each text and item stays, so a seed that recurs any number of times on
both sides takes time but no memory.

Cases: null and empty texts have no words; repeated rows are found each by
itself; ids of any type, null among them, are carried; benchmarks without usable
items find nothing; other columns are ignored (``find_leaks``) or kept
(``decontaminate``).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import MATCH_CLASS, MATCH_FOLD, bounded_batches, mix, session_of, slices, words_of

WINDOW, SHORTEST = 16, 8
#: Fixed masks: positions that count. The first two serve items of 16 words or more, the others shorter ones.
MASKS = ((0, 1, 2, 4, 5), (0, 1, 2, 3, 4), (0, 1, 2, 4), (0, 1, 2, 3))
BITS = 22
#: Hits that one step verifies.
CHUNK = 1 << 15


def masked(words: np.ndarray, which: int) -> np.ndarray:
    """The hash under a mask at every position where it fits."""
    mask = MASKS[which]
    n = len(words) - mask[-1]
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, which + 1, np.uint64)
    for i, x in enumerate(mask):
        out += words[x : x + n] * np.uint64(0x9E3779B97F4A7C15 * (2 * i + 1) % (1 << 64))
    return mix(out)


@dataclass
class Index:
    """The seeds of one block of items."""

    ids: list
    words: np.ndarray
    bounds: np.ndarray  # of the items in words
    seeds: list[np.ndarray]  # by mask, sorted
    places: list[np.ndarray]  # of the seeds, in words
    maps: list[np.ndarray]  # by mask: which of 2**BITS slots hold a seed

    @classmethod
    def of(cls, ids: list, texts: list[str | None]) -> Index:
        document, words, bounds = words_of(pa.array(texts, pa.string()), MATCH_CLASS, MATCH_FOLD)
        length = np.diff(bounds)
        seeds, places, maps = [], [], []
        for which, mask in enumerate(MASKS):
            own = masked(words, which)
            at = np.arange(len(own))
            fit = at + mask[-1] < bounds[document[at] + 1]
            long = length[document[at]] >= WINDOW
            fit &= long if which < 2 else ~long & (length[document[at]] >= SHORTEST)
            order = np.argsort(own[fit], kind="stable")
            seeds.append(own[fit][order])
            places.append(at[fit][order])
            slots = np.zeros(1 << BITS, bool)
            slots[seeds[-1] >> np.uint64(64 - BITS)] = True
            maps.append(slots)
        return cls(ids, words, bounds, seeds, places, maps)

    def hits(self, document: np.ndarray, words: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Chunks of (place in the documents' words, place in the items' words) that agree under a mask."""
        for which, mask in enumerate(MASKS):
            if not len(self.seeds[which]):
                continue
            own = masked(words, which)
            at = np.flatnonzero(self.maps[which][own >> np.uint64(64 - BITS)])
            at = at[at + mask[-1] < bounds[document[at] + 1]]
            low = np.searchsorted(self.seeds[which], own[at], "left")
            ends = np.cumsum(np.searchsorted(self.seeds[which], own[at], "right") - low)
            for begin in range(0, int(ends[-1]) if len(ends) else 0, CHUNK):
                # Hit number n is of the first place whose running count of hits is above n.
                n = np.arange(begin, min(begin + CHUNK, int(ends[-1])))
                of = np.searchsorted(ends, n, "right")
                before = np.where(of > 0, ends[of - 1], 0)
                yield at[of], self.places[which][low[of] + n - before]

    def leaks(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(text, item, first word in the text, first word in the item, words that agree), the best window of each pair."""
        document, words, bounds = words_of(column, MATCH_CLASS, MATCH_FOLD)
        best = (np.zeros(0, np.int64),) * 5
        if not len(words) or not len(self.words):
            return best
        for p, q in self.hits(document, words, bounds):
            found = self._verified(p, q, document, words, bounds)
            if len(found[0]):
                best = self._best(*(np.concatenate(x) for x in zip(best, found, strict=True)))
        return best

    def _best(self, text, item, at, q, score):
        order = np.lexsort((q, at, -score, item, text))
        text, item, at, q, score = (x[order] for x in (text, item, at, q, score))
        first = np.ones(len(text), bool)
        first[1:] = (text[1:] != text[:-1]) | (item[1:] != item[:-1])
        return tuple(x[first] for x in (text, item, at, q, score))

    def _verified(self, hp, hq, document, words, bounds):
        ho = np.searchsorted(self.bounds, hq, "right") - 1
        size = np.minimum(np.diff(self.bounds)[ho], WINDOW)
        out = []
        for w in np.unique(size):
            these = size == w
            a, b, o = hp[these], hq[these], ho[these]
            d = document[a]
            steps = np.arange(-(w - 1), w)
            x, y = a[:, None] + steps, b[:, None] + steps
            valid = (x >= bounds[d][:, None]) & (x < bounds[d + 1][:, None]) & (y >= self.bounds[o][:, None]) & (y < self.bounds[o + 1][:, None])
            same = valid & (words[np.where(valid, x, 0)] == self.words[np.where(valid, y, 0)])
            sums = lambda m: np.cumsum(np.pad(m.astype(np.int16), ((0, 0), (1, 0))), axis=1)
            agree, inside = (s[:, w:] - s[:, :-w] for s in (sums(same), sums(valid)))
            agree = np.where(inside == w, agree, -1)
            best = agree.argmax(1)
            score = agree[np.arange(len(a)), best]
            yes = score >= w - w // 5
            shift = (best - (w - 1))[yes]
            out.append((d[yes], o[yes], a[yes] + shift - bounds[d[yes]], b[yes] + shift - self.bounds[o[yes]], score[yes].astype(np.int64)))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def blocks(benchmark: DataFrame, id_col: str, text_col: str, block_words: int) -> Iterator[Index]:
    """Indexes over blocks of items; the driver holds one block at a time."""
    ids, texts, total = [], [], 0
    rows = benchmark.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    for row in rows.toLocalIterator():
        words = len(row["text"]) // 2 + 1
        if ids and total + words > block_words:
            yield Index.of(ids, texts)
            ids, texts, total = [], [], 0
        ids.append(row["id"])
        texts.append(row["text"])
        total += words
    if ids:
        yield Index.of(ids, texts)


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text", block_words: int = 2_000_000,
) -> DataFrame:
    """(doc_id, item_id, doc_word, item_word, n_equal): each contaminated row with each of its items, and the best window."""
    spark = session_of(docs)
    bounded_batches(spark)
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    items = benchmark.schema[item_col].dataType
    item_type = to_arrow_type(items)
    schema = f"doc_id {docs.schema[id_col].dataType.simpleString()}, item_id {items.simpleString()}, doc_word long, item_word long, n_equal long"
    out = spark.createDataFrame([], schema)
    for index in blocks(benchmark, id_col=item_col, text_col=item_text_col, block_words=block_words):
        shared = spark.sparkContext.broadcast(index)

        def run(batches, shared=shared):
            index = shared.value
            item_ids = pa.array(index.ids, item_type)
            for part in slices(batches, "text"):
                text, item, at, place, score = index.leaks(part.column(1))
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(text)), item_ids.take(pa.array(item)), *map(pa.array, (at, place, score))], names=["doc_id", "item_id", "doc_word", "item_word", "n_equal"])

        out = out.union(source.mapInArrow(run, schema))
    return out


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_words: int = 2_000_000,
) -> DataFrame:
    """The rows of ``docs`` that no item contaminates."""
    spark = session_of(docs)
    bounded_batches(spark)
    where = docs.columns.index(text_col)
    for index in blocks(benchmark, id_col=item_col, text_col=item_text_col, block_words=block_words):
        shared = spark.sparkContext.broadcast(index)

        def run(batches, shared=shared):
            index = shared.value
            for part in slices(batches, text_col):
                keep = np.ones(part.num_rows, bool)
                keep[index.leaks(part.column(where))[0]] = False
                yield part.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
