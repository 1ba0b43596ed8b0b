"""Helpers shared by the operators of this subpackage.

Executor-side code works on Arrow batches in slices of bounded size, so a
worker's memory follows the slice (and the longest single text), never the
partition.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.stored import checkpointed, shared_folder  # noqa: F401  (for the modules here)

#: Words as every contract defines them: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Text bytes that one vectorised step handles.
SLICE_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def session_of(df: DataFrame) -> SparkSession:
    return df.sparkSession


def bounded_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Bound the Arrow batches that Spark sends to Python workers by rows and, where the version can, by bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def unused(df: DataFrame, stem: str = "__") -> str:
    """A prefix that no column of ``df`` begins with, so that helper columns clash with none."""
    taken = [c.lower() for c in df.columns]
    while any(c.startswith(stem) for c in taken):
        stem += "_"
    return stem


# --------------------------------------------------------------- Arrow slices


def as_binary(column: pa.Array) -> pa.Array:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.large_binary())


def slices(batches, column: str, limit: int = SLICE_BYTES):
    """Yield record batches whose ``column`` holds about ``limit`` bytes at most (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        text = as_binary(batch.column(batch.schema.get_field_index(column)))
        ends = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
        at = 0
        while at < batch.num_rows:
            to = int(np.searchsorted(ends, ends[at] + limit, "right")) - 1
            to = min(max(to, at + 1), batch.num_rows)
            yield batch.slice(at, to - at)
            at = to


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of every text, b'' for null."""
    return [x or b"" for x in as_binary(column).to_pylist()]


# ------------------------------------------------------- vectorised tokenising

P = np.uint64(0x9E3779B97F4A7C15 | 1)
P_INVERSE = np.uint64(pow(int(P), -1, 1 << 64))
_Q = (np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93))


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finalizer."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


BYTE_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_POWERS: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; grown as needed and kept up to a slice's length."""
    have = _POWERS.get(int(base))
    if have is None or len(have) < n:
        out = np.ones(max(n, 1 << 16), np.uint64)
        out[1:] = base
        np.multiply.accumulate(out, out=out)
        if n <= 2 * SLICE_BYTES:
            _POWERS[int(base)] = out
        have = out
    return have[:n]


def range_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: np.uint64, inverse: np.uint64) -> np.ndarray:
    """Polynomial hashes of values[start:end], each relative to its own start."""
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(base, len(values)), out=sums[1:])
    return mix((sums[ends] - sums[starts]) * powers(inverse, len(values) + 1)[starts] + (ends - starts).astype(np.uint64) * np.uint64(0x9FB21C651E98DF25))


def q_hash(words: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """Hash of a range of word hashes; ``which`` picks one of two independent functions."""
    q = _Q[which]
    return range_hash(words, starts, ends, q, np.uint64(pow(int(q), -1, 1 << 64)))


SPACE_CLASS = np.ones(256, bool)
SPACE_CLASS[[0x20, *range(0x09, 0x0E)]] = False
#: For matching: ASCII letters fold to lower case; ASCII letters, digits and every non-ASCII byte belong to words.
MATCH_CLASS = np.array([chr(b).isalnum() if b < 128 else True for b in range(256)])
MATCH_FOLD = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


def words_of(column: pa.Array, in_word: np.ndarray = SPACE_CLASS, fold: np.ndarray | None = None):
    """(document index, hash) of every word of a string column, and the first word of each document (n+1 values).

    Null and empty texts have no words. Hashes depend on the word's bytes alone.
    """
    text = as_binary(column).fill_null(b"")
    offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
    low, high = int(offsets[0]), int(offsets[-1])
    offsets = offsets - low
    none = np.zeros(0, np.int64)
    if high == low:
        return none, none.astype(np.uint64), np.zeros(len(text) + 1, np.int64)
    data = np.frombuffer(text.buffers()[2], np.uint8, count=high)[low:]
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = in_word[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    starts = np.flatnonzero(inside[1:] & (~inside[:-1] | first))
    ends = np.flatnonzero(inside[:-1] & (~inside[1:] | first))
    values = (BYTE_VALUE[fold] if fold is not None else BYTE_VALUE)[data]
    hashes = range_hash(values, starts, ends, P, P_INVERSE)
    bounds = np.searchsorted(starts, offsets, "left")
    document = np.repeat(np.arange(len(text)), np.diff(bounds))
    return document, hashes, bounds


def crc_mod(column, modulus: int):
    """crc32 of the decimal text of a column, modulo ``modulus``; -1 for null."""
    return F.coalesce(F.crc32(column.cast("string").cast("binary")) % modulus, F.lit(-1))
