"""The fixed binary index formats.

Tables are the native form; these files are for exchange. A format is one file in
term order: executors write ranges of terms, which one task joins. Dictionary and
lists are read by the executors, each its own range, neighbouring lists together.
Lists beyond 32-bit pointers go to further volumes. Paths may be of any store that
Arrow knows, or local or mounted ones, which all executors share.
"""

from __future__ import annotations

import struct
import sys
import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import IndexConfig, SkipConfig
from ..functions.codec import decode_vb, encode_vb, skip_step_of
from .stored import store

RECORD = struct.Struct("<20sII")
RECORD_TYPE = np.dtype([("term", "S20"), ("count", "<u4"), ("pointer", "<u4")])


def _gaps(ids: list[int]) -> list[int]:
    return [b - a for a, b in zip([0, *ids], ids, strict=False)]


def _running(gaps: list[int]) -> list[int]:
    out, total = [], 0
    for g in gaps:
        total += g
        out.append(total)
    return out


def encode_ids(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def encode_gaps(ids: list[int]) -> bytes:
    return encode_vb(_gaps(ids))


def encode_skips(ids: list[int], config: SkipConfig, base: int = 0) -> bytes:
    """Ids with a marker, target id and target place after each that has a pointer (F8)."""
    n, step = len(ids), skip_step_of(len(ids), config)
    out = bytearray()
    for i, doc in enumerate(ids):
        out += struct.pack("<I", doc)
        if n >= config.min_list_length and (i + 1) % step == 0 and i < n - 1:
            target = min(i + step, n - 1)
            out += struct.pack("<III", config.marker_binary, ids[target], base + 4 * target + 12 * (target // step))
    return bytes(out)


def decode_skips(data: bytes, count: int, config: SkipConfig | None = None) -> tuple[list[int], list[tuple[int, int, int]]]:
    """(ids, [(place, target id, target place)])."""
    marker = (config or SkipConfig()).marker_binary
    numbers = [n for (n,) in struct.iter_unpack("<I", data[: len(data) // 4 * 4])]
    ids, skips, at = [], [], 0
    while at < len(numbers):
        if numbers[at] == marker and ids and at + 2 < len(numbers):
            skips.append((len(ids) - 1, numbers[at + 1], numbers[at + 2]))
            at += 3
        elif len(ids) == count:
            break
        else:
            ids.append(numbers[at])
            at += 1
    return ids, skips


def encode_positions(docs: list[tuple[int, list[int]]]) -> bytes:
    """Count of documents, then id, frequency and 16-bit positions of each (F11); larger positions clamp."""
    out = bytearray(struct.pack("<I", len(docs)))
    for doc, positions in docs:
        out += struct.pack(f"<II{len(positions)}H", doc, len(positions), *(min(p, 0xFFFF) for p in positions))
    return bytes(out)


def decode_positions(data: bytes, at: int = 0) -> dict[int, list[int]]:
    """Positions by document; the stored count is trusted."""
    (n,) = struct.unpack_from("<I", data, at)
    at, out = at + 4, {}
    for _ in range(n):
        doc, tf = struct.unpack_from("<II", data, at)
        out[doc] = sorted(struct.unpack_from(f"<{tf}H", data, at + 8))
        at += 8 + 2 * tf
    return out


def encode_positions_vb(docs: list[tuple[int, list[int]]]) -> bytes:
    """Count of documents, then gap, frequency and gaps of positions of each, in variable-byte code."""
    out = encode_vb([len(docs)])
    for gap, (_, positions) in zip(_gaps([d for d, _ in docs]), docs, strict=True):
        out += encode_vb([gap, len(positions), *_gaps(positions)])
    return out


def decode_positions_vb(data: bytes, at: int = 0) -> dict[int, list[int]]:
    """Positions by document of the variable-byte form."""
    (n,), at = decode_vb(data, 1, at)
    doc, out = 0, {}
    for _ in range(n):
        (gap, tf), at = decode_vb(data, 2, at)
        numbers, at = decode_vb(data, tf, at)
        doc += gap
        out[doc] = _running(numbers)
    return out


def _writable(path: str):
    system, inner = store(path)
    system.create_dir(inner.rpartition("/")[0] or ".", recursive=True)
    return system.open_output_stream(inner)


def read_range(path: str, pointer: int, size: int) -> bytes:
    """``size`` bytes from a place on, fewer at the end of the file."""
    system, inner = store(path)
    with system.open_input_file(inner) as file:
        file.seek(pointer)
        return file.read(max(0, min(size, file.size() - pointer)))


def encode_at(ids: list[int], base: int) -> bytes:
    """Default skip form, with places from the start of the file."""
    return encode_skips(ids, SkipConfig(), base)


def _summed(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Running sums that start anew with each list of ``lengths``."""
    total = np.cumsum(values)
    starts = (np.cumsum(lengths) - lengths)[lengths > 0]
    return total - np.repeat((total - values)[starts], lengths[lengths > 0])


def _differences(values: np.ndarray, lengths: np.ndarray, before: int = 0) -> np.ndarray:
    """The first number of each list, then differences; the first list's first number less ``before``."""
    out = np.diff(values, prepend=0)
    starts = (np.cumsum(lengths) - lengths)[lengths > 0]
    out[starts] = values[starts]
    out[:1] -= before
    return out


def _vb(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Variable-byte code of all numbers in a row, and the bytes of each."""
    sizes = np.ones(len(numbers), np.int64)
    for k in range(1, 9):
        sizes += numbers >= 1 << (7 * k)
    ends = np.cumsum(sizes) - 1
    out = np.empty(int(sizes.sum()), np.uint8)
    out[ends] = (numbers & 127) + 128
    for k in range(1, int(sizes.max(initial=1))):
        longer = sizes > k
        out[ends[longer] - k] = (numbers[longer] >> (7 * k)) & 127
    return out, sizes


def _unvb(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of a variable-byte string, and the place after each."""
    codes = np.frombuffer(data, np.uint8)
    ends = np.flatnonzero(codes >= 128)
    sizes = np.diff(ends, prepend=-1)
    out = (codes[ends] & 127).astype(np.int64)
    for k in range(1, int(sizes.max(initial=1))):
        longer = sizes > k
        out[longer] += (codes[ends[longer] - k] & 127).astype(np.int64) << (7 * k)
    return out, ends + 1


def _unsigned(numbers: np.ndarray) -> np.ndarray:
    if len(numbers) and (numbers.min() < 0 or numbers.max() > 0xFFFFFFFF):
        raise OverflowError("the fixed format holds 32-bit ids")
    return numbers.astype("<u4")


def _list_codes(batches, encode):
    """(term, count, code) of each row of (term, doc_ids); a code's places count from the code before the first."""
    at = 0
    for batch in batches:
        terms, lists = batch.column("term").to_pylist(), batch.column("doc_ids")
        if encode in (encode_ids, encode_gaps):
            ids, lengths = lists.flatten().to_numpy(zero_copy_only=False), np.diff(lists.offsets.to_numpy())
            if encode is encode_ids:
                code, sizes = _unsigned(ids).tobytes(), 4 * lengths
            else:
                code, each = _vb(_differences(ids, lengths))
                code, sizes = code.tobytes(), np.diff(np.concatenate([[0], np.cumsum(each)])[np.concatenate([[0], np.cumsum(lengths)])])
            ends = np.cumsum(sizes).tolist()
            for term, n, start, end in zip(terms, lengths.tolist(), [0, *ends], ends):
                yield term, n, code[start:end]
        else:
            for term, ids in zip(terms, lists.to_pylist()):
                code = encode(ids, at) if encode is encode_at else encode(ids)
                at += len(code)
                yield term, len(ids), code


def _position_codes(batches, encode):
    """(term, documents, code) from rows of (term, doc_id, positions) in that order; a list's pieces wait for its last row."""
    plain, open_term, count, pieces, last = encode is encode_positions, None, 0, [], 0

    def closed():
        header = struct.pack("<I", count) if plain else encode_vb([count])
        return open_term, count, header + b"".join(pieces)

    for batch in batches:
        words = batch.column("term").dictionary_encode()
        codes = words.indices.to_numpy(zero_copy_only=False)
        docs = batch.column("doc_id").to_numpy(zero_copy_only=False)
        lists = batch.column("positions")
        positions, tf = lists.flatten().to_numpy(zero_copy_only=False), np.diff(lists.offsets.to_numpy()).astype(np.int64)
        starts = np.flatnonzero(np.diff(codes, prepend=-1)) if len(codes) else np.empty(0, np.int64)
        runs = np.diff(np.append(starts, len(codes)))
        names = words.dictionary.take(words.indices.take(pa.array(starts))).to_pylist()
        heads = np.cumsum(tf) - tf  # where each document's positions begin
        where = np.arange(len(positions)) - np.repeat(heads, tf)
        if plain:
            first = heads + 4 * np.arange(len(tf))
            halves = np.empty(len(positions) + 4 * len(tf), "<u2")
            ids = _unsigned(docs)
            halves[first], halves[first + 1], halves[first + 2], halves[first + 3] = ids & 0xFFFF, ids >> 16, tf & 0xFFFF, tf >> 16
            halves[np.repeat(first + 4, tf) + where] = np.minimum(positions, 0xFFFF)
            code, ends = halves.tobytes(), 2 * (first + 4 + tf)
        else:
            first = heads + 2 * np.arange(len(tf))
            numbers = np.empty(len(positions) + 2 * len(tf), np.int64)
            same = len(names) and names[0] == open_term
            numbers[first], numbers[first + 1] = _differences(docs, runs, last if same else 0), tf
            numbers[np.repeat(first + 2, tf) + where] = _differences(positions, tf)
            code, sizes = _vb(numbers)
            code, ends = code.tobytes(), np.cumsum(sizes)[first + 1 + tf]
        bounds = np.concatenate([[0], ends])[np.append(starts, len(codes))].tolist() if len(codes) else []
        for name, n, start, end in zip(names, runs.tolist(), bounds, bounds[1:]):
            if name != open_term:
                if open_term is not None:
                    yield closed()
                open_term, count, pieces = name, 0, []
            count += n
            pieces.append(code[start:end])
        last = int(docs[-1]) if len(docs) else last
    if open_term is not None:
        yield closed()


def _record(term: bytes, count: int, pointer: int) -> bytes:
    return RECORD.pack(term, count, pointer)


#: Bytes of lists that one file's 32-bit pointers reach; what is beyond goes to further volumes (``path.1``, ...).
VOLUME_BYTES = 1 << 32


def _volume(path: str, number: int) -> str:
    return path if number == 0 else f"{path}.{number}"


def _write_files(rows: DataFrame, dictionary_path: str, lists_path: str, codes, encode, config: IndexConfig | None = None, volume_bytes: int = VOLUME_BYTES) -> int:
    """A dictionary of 28-byte records and the lists they point to; bytes of lists.

    Each task writes the files of its range of terms, with places from its own start. One task then joins them in
    order, part by part, and adds what lies before a part to its places, so nothing passes through the driver but
    a name and three numbers a part.
    """
    width, spark = (config or IndexConfig()).term_bytes, rows.sparkSession

    def write(batches):
        coded, number, at = codes(batches, encode), TaskContext.get().partitionId(), 0
        entry = next(coded, None)
        while entry is not None:
            name, origin = f"{lists_path}.part-{uuid.uuid4().hex}", at
            with _writable(name + ".d") as dictionary, _writable(name) as lists:
                while entry is not None and (at == origin or at + len(entry[2]) - origin <= volume_bytes):
                    term, n, code = entry
                    dictionary.write(_record(term.encode()[:width], n, at - origin))
                    lists.write(code)
                    at, entry = at + len(code), next(coded, None)
            yield pa.RecordBatch.from_pydict({"number": [number], "origin": [origin], "name": [name], "bytes": [at - origin]})

    parts = sorted(tuple(r) for r in rows.mapInArrow(write, "number long, origin long, name string, bytes long").collect())
    volumes, size = [[]], 0
    for _, origin, name, n in parts:
        if size + n > volume_bytes and size:
            volumes.append([])
            size = 0
        volumes[-1].append((name, size, size - origin))
        size += n
    marker = SkipConfig().marker_binary

    def join(numbered) -> None:
        number, names = numbered
        with _writable(_volume(dictionary_path, number)) as dictionary, _writable(_volume(lists_path, number)) as lists:
            for name, base, shift in names:
                records = np.frombuffer(read_range(name + ".d", 0, 1 << 62), RECORD_TYPE).copy()
                records["pointer"] += np.uint32(base)
                dictionary.write(records.tobytes())
                data = read_range(name, 0, 1 << 62)
                if encode is encode_at:
                    numbers = np.frombuffer(data, "<u4").copy()
                    numbers[np.flatnonzero(numbers == marker) + 2] += np.uint32(shift & 0xFFFFFFFF)
                    data = numbers.tobytes()
                lists.write(data)
                for path in (name, name + ".d"):
                    system, inner = store(path)
                    system.delete_file(inner)

    spark.sparkContext.parallelize(list(enumerate(volumes)), len(volumes)).foreach(join)
    return sum(part[3] for part in parts)


def export_index(lists: DataFrame, dictionary_path: str, lists_path: str, encode=encode_ids, volume_bytes: int = VOLUME_BYTES) -> int:
    """``lists(term, df, doc_ids)`` as files."""
    rows = lists.select("term", "doc_ids").repartitionByRange("term").sortWithinPartitions("term")
    return _write_files(rows, dictionary_path, lists_path, _list_codes, encode, volume_bytes=volume_bytes)


def export_positions(ppostings: DataFrame, dictionary_path: str, lists_path: str, encode=encode_positions, volume_bytes: int = VOLUME_BYTES) -> int:
    """``ppostings(term, doc_id, tf, positions)`` as files, in the fixed or the variable-byte form (K11); documents stay rows until they are bytes."""
    rows = ppostings.select("term", "doc_id", "positions").repartitionByRange("term").sortWithinPartitions("term", "doc_id")
    return _write_files(rows, dictionary_path, lists_path, _position_codes, encode, volume_bytes=volume_bytes)


#: Dictionary records that one task reads.
RECORDS_A_TASK = 1 << 16


def _size(path: str) -> int:
    system, inner = store(path)
    info = system.get_file_info(inner)
    return info.size if info.is_file else -1


def read_entries(spark: SparkSession, path: str) -> DataFrame:
    """(term, doc_freq, pointer, at, volume, end) of every record of a fixed-record dictionary, by its place over all volumes.

    ``end`` is the pointer of the next record, null for the last of a volume.
    """
    counts = []
    while (size := _size(_volume(path, len(counts)))) >= 0:
        counts.append(size // RECORD.size)
    firsts = np.cumsum([0, *counts])

    def read(batches):
        for batch in batches:
            for start, n in zip(batch.column("id").to_pylist(), [RECORDS_A_TASK] * len(batch)):
                for v in range(len(counts)):
                    low, high = max(start, int(firsts[v])), min(start + n, int(firsts[v + 1]))
                    if low >= high:
                        continue
                    records = np.frombuffer(read_range(_volume(path, v), (low - int(firsts[v])) * RECORD_TYPE.itemsize, (high - low + 1) * RECORD_TYPE.itemsize), RECORD_TYPE)
                    own = records[: high - low]
                    ends = np.append(records["pointer"][1:], 0)[: len(own)].astype(np.int64)
                    closed = np.arange(len(own)) + 1 >= len(records)  # the last of a volume has none after it
                    terms = [x.decode("utf-8", "ignore") for x in own["term"].tolist()]
                    columns = [pa.array(terms, pa.string()), pa.array(own["count"].astype(np.int64)), pa.array(own["pointer"].astype(np.int64)), pa.array(np.arange(low, high)), pa.array(np.full(len(own), v, np.int32)), pa.array(ends, mask=closed)]
                    yield pa.RecordBatch.from_arrays(columns, names=["term", "doc_freq", "pointer", "at", "volume", "end"])

    total = int(firsts[-1])
    tasks = -(-total // RECORDS_A_TASK)
    starts = spark.range(0, total, RECORDS_A_TASK, max(1, tasks))
    return starts.mapInArrow(read, "term string, doc_freq long, pointer long, at long, volume int, end long")


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """(term, doc_freq, pointer, at) of a fixed-record dictionary; of equal cut terms the last wins."""
    last = read_entries(spark, path).groupBy("term").agg(F.max(F.struct("at", "doc_freq", "pointer", "volume", "end")).alias("x"))
    return last.select("term", "x.doc_freq", "x.pointer", "x.at", "x.volume", "x.end")


def read_list(path: str, pointer: int, count: int) -> list[int]:
    """One list of plain ids."""
    data = read_range(path, pointer, 4 * count)
    return [n for (n,) in struct.iter_unpack("<I", data[: len(data) // 4 * 4])]


def read_vb_list(path: str, pointer: int, count: int) -> list[int]:
    """One list of variable-byte gaps."""
    return _running(decode_vb(read_range(path, pointer, 5 * count), count)[0])


def read_skip_list(path: str, pointer: int, count: int, next_pointer: int | None = None) -> tuple[list[int], list[tuple[int, int, int]]]:
    """One list with skip pointers; without the next pointer, enough for a pointer after every id is read."""
    return decode_skips(read_range(path, pointer, (next_pointer - pointer) if next_pointer is not None else 16 * count), count)


#: Bytes of neighbouring lists that one reading takes.
READ_BYTES = 1 << 22


def _runs(batch: pa.RecordBatch, lists_path: str):
    """(rows, data, places): neighbouring lists of a batch of entries, read together."""
    pointers, volumes = batch.column("pointer").to_numpy(), batch.column("volume").to_numpy()
    ends = batch.column("end").to_pandas()
    order = np.lexsort((pointers, volumes))
    sizes = {}
    at = 0
    while at < len(order):
        first = order[at]
        path = _volume(lists_path, int(volumes[first]))
        rows, end = [], int(pointers[first])
        while at < len(order) and volumes[order[at]] == volumes[first] and pointers[order[at]] == end and (not rows or end - pointers[first] < READ_BYTES):
            row = order[at]
            if ends[row] != ends[row]:
                end = sizes.setdefault(path, _size(path))
            else:
                end = int(ends[row])
            rows.append(row)
            at += 1
        rows = np.array(rows)
        yield rows, read_range(path, int(pointers[first]), end - int(pointers[first])), pointers[rows] - pointers[first]


def _ids_of(form: str, data: bytes, counts: np.ndarray) -> np.ndarray:
    """The ids of neighbouring lists, one after the other."""
    if form == "vb":
        return _summed(_unvb(data)[0], counts)
    numbers = np.frombuffer(data, "<u4")
    if form == "skips":
        marks = np.flatnonzero(numbers == SkipConfig().marker_binary)
        kept = np.ones(len(numbers), bool)
        kept[np.concatenate([marks, marks + 1, marks + 2])] = False
        numbers = numbers[kept]
    return numbers.astype(np.int64)


def read_index(spark: SparkSession, dictionary_path: str, lists_path: str, form: str = "plain", every: bool = False) -> DataFrame:
    """(term, at, df, doc_ids) of all lists, sorted again (S13); ``form`` is plain, vb or skips. ``every`` keeps all of equal cut terms."""
    entries = (read_entries if every else read_dictionary)(spark, dictionary_path)

    def load(batches):
        for batch in batches:
            df = batch.column("doc_freq").to_numpy()
            for rows, data, _ in _runs(batch, lists_path):
                counts = df[rows]
                ids = _ids_of(form, data, counts)
                if len(ids) != counts.sum():
                    raise ValueError(f"{len(ids)} ids in {lists_path} where the dictionary counts {counts.sum()}")
                owner = np.repeat(np.arange(len(rows)), counts)
                if ((np.diff(ids) < 0) & (np.diff(owner) == 0)).any():
                    ids = ids[np.lexsort((ids, owner))]
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(ids))
                kept = batch.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([kept.column("term"), kept.column("at"), kept.column("doc_freq"), lists], names=["term", "at", "df", "doc_ids"])

    return entries.mapInArrow(load, "term string, at long, df long, doc_ids array<long>")


def _hops(places, counts, step) -> tuple[np.ndarray, np.ndarray]:
    """Where each document's record begins, list after list: the next place depends on the record."""
    out = []
    for at, n in zip(places, counts):
        for _ in range(n):
            out.append(at)
            at = step(at)
    return np.array(out, np.int64), np.array(counts, np.int64)


def _positions_of(form: str, data: bytes, places: np.ndarray):
    """(documents of each list, ids, frequencies, positions) of neighbouring lists; the stored counts are trusted."""
    if form == "plain":
        halves = memoryview(data).cast("H") if sys.byteorder == "little" else np.frombuffer(data, "<u2").tolist()
        starts = (places // 2).tolist()
        at, counts = _hops([s + 2 for s in starts], [halves[s] | halves[s + 1] << 16 for s in starts], lambda at: at + 4 + (halves[at + 2] | halves[at + 3] << 16))
        numbers = np.frombuffer(data, "<u2").astype(np.int64)
        ids, tf, first = numbers[at] | numbers[at + 1] << 16, numbers[at + 2] | numbers[at + 3] << 16, at + 4
    else:
        numbers, after = _unvb(data)
        plain = numbers.tolist()
        starts = np.searchsorted(after, places, "right").tolist()
        at, counts = _hops([s + 1 for s in starts], [plain[s] for s in starts], lambda at: at + 2 + plain[at + 1])
        ids, tf, first = _summed(numbers[at], counts), numbers[at + 1], at + 2
    positions = numbers[np.repeat(first - (np.cumsum(tf) - tf), tf) + np.arange(int(tf.sum()))]
    return counts, ids, tf, positions if form == "plain" else _summed(positions, tf)


#: Documents in one batch of positions that a reader gives on.
POSITION_ROWS = 1 << 16


def read_positions(spark: SparkSession, dictionary_path: str, lists_path: str, form: str = "plain", every: bool = False) -> DataFrame:
    """(term, at, doc_id, tf, positions) of a positional index (S16, S17); ``form`` is plain or vb, ``every`` as in ``read_index``."""
    entries = (read_entries if every else read_dictionary)(spark, dictionary_path)

    def load(batches):
        for batch in batches:
            for rows, data, places in _runs(batch, lists_path):
                counts, ids, tf, positions = _positions_of(form, data, places)
                owner, ends = np.repeat(rows, counts), np.concatenate([[0], np.cumsum(tf)])
                for low in range(0, len(ids), POSITION_ROWS):
                    high = min(low + POSITION_ROWS, len(ids))
                    kept = batch.take(pa.array(owner[low:high]))
                    lists = pa.ListArray.from_arrays(pa.array((ends[low : high + 1] - ends[low]).astype(np.int32)), pa.array(positions[ends[low] : ends[high]]))
                    yield pa.RecordBatch.from_arrays([kept.column("term"), kept.column("at"), pa.array(ids[low:high]), pa.array(tf[low:high]), lists], names=["term", "at", "doc_id", "tf", "positions"])

    return entries.mapInArrow(load, "term string, at long, doc_id long, tf long, positions array<long>")


# ------------------------------------------------- dictionary as one string


def write_compressed_dictionary(entries, path: str, k: int = 4) -> None:
    """(term, freq, pointer) in term order as one string with an anchor every ``k`` entries."""
    entries = list(entries)
    text = "".join(t for t, _, _ in entries)
    coded = text.encode()
    with _writable(path) as file:
        file.write(struct.pack("<I", len(coded)) + coded + struct.pack("<IB", len(entries), k))
        at = 0
        for i, (term, freq, pointer) in enumerate(entries, 1):
            anchor = i % k == 0 or i == len(entries)
            file.write(term.encode()[:8].ljust(8, b"\0") + (at.to_bytes(3, "little") if anchor else bytes([min(len(term), 255)])) + struct.pack("<II", freq, pointer))
            at += len(term)


def read_compressed_dictionary(path: str) -> dict[str, tuple[int, int]]:
    """{term: (freq, pointer)} (S14). An anchor gives its place, the others their lengths; an anchor's own length is what is left to the next."""
    data = read_range(path, 0, 1 << 62)
    (size,) = struct.unpack_from("<I", data)
    text = data[4 : 4 + size].decode("utf-8", "replace")
    count, k = struct.unpack_from("<IB", data, 4 + size)
    at, rows = 9 + size, []
    for i in range(1, count + 1):
        prefix, anchor = data[at : at + 8], i % k == 0 or i == count
        width = 3 if anchor else 1
        value = int.from_bytes(data[at + 8 : at + 8 + width], "little")
        rows.append((prefix, anchor, value, *struct.unpack_from("<II", data, at + 8 + width)))
        at += 16 + width
    out, place = {}, 0
    # For each entry, where the next anchor begins and how long the entries between are, told from the end.
    following, between, behind = [None] * count, [0] * count, (None, 0)
    for i in range(count - 1, -1, -1):
        following[i], between[i] = behind
        _, anchor, value, _, _ = rows[i]
        behind = (value, 0) if anchor else (behind[0], behind[1] + value)
    for i, (prefix, anchor, value, freq, pointer) in enumerate(rows):
        if anchor:
            place = value
            length = (len(text) if following[i] is None else following[i] - between[i]) - place
        else:
            length = value
        term = text[place : place + length] if 0 < length <= len(text) - place else prefix.rstrip(b"\0").decode("utf-8", "ignore")
        out[term] = (freq, pointer)
        place += length
    return out


#: Characters of terms in one file: an anchor's place has three bytes.
VOLUME_CHARS = 1 << 20


def export_compressed_dictionary(dictionary: DataFrame, folder: str, k: int = 4, volume_chars: int = VOLUME_CHARS) -> list[str]:
    """``dictionary(ordinal, term, freq, ptr)`` as files of terms in one string each, in term order; their paths.

    Tasks write their ranges of ordinals, in several files where a range's terms are more than an anchor's place can tell.
    """
    rows = dictionary.select("ordinal", "term", "freq", "ptr").repartitionByRange("ordinal").sortWithinPartitions("ordinal")

    def write(batches):
        made, held, chars = [], [], 0

        def close():
            path = f"{folder}/terms-{held[0][0]:012d}-{uuid.uuid4().hex}.bin"
            write_compressed_dictionary([e[1:] for e in held], path, k)
            made.append(path)

        for batch in batches:
            for entry in zip(*(c.to_pylist() for c in batch.columns)):
                if held and chars + len(entry[1]) > volume_chars:
                    close()
                    held, chars = [], 0
                held.append(entry)
                chars += len(entry[1])
        if held:
            close()
        yield pa.RecordBatch.from_pydict({"path": pa.array(made, pa.string())})

    return sorted(r["path"] for r in rows.mapInArrow(write, "path string").collect())


def read_compressed_dictionaries(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(term, freq, pointer) of all files of ``export_compressed_dictionary``, a task a file."""

    def load(batches):
        for batch in batches:
            for number in batch.column("id").to_pylist():
                found = read_compressed_dictionary(paths[number])
                freqs, pointers = zip(*found.values()) if found else ((), ())
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array(freqs, pa.int64()), pa.array(pointers, pa.int64())], names=["term", "freq", "pointer"])

    return spark.range(0, len(paths), 1, max(1, len(paths))).mapInArrow(load, "term string, freq long, pointer long")
