"""A toxicity classifier that is regularised by counterfactuals.

Texts are bags of hashed word parts (whole words, and prefixes, so that forms of
a stem count together). A logistic model is fitted on a bounded sample of
labelled texts. Besides the labels it sees one counterfactual of every sampled
text: one that names a group of people has its identity terms swapped for
others of their kind, and one that names none has a neutral mention of a group
put in, at a place and of a kind that follow from the text. The squared change
of the score between the two is penalised, so that naming a group moves a score
no more than naming another group, or none.

The terms are a parameter; the default names groups in English, French, German
and Spanish. Without terms there is nothing to regularise by, which is an error
unless the penalty is 0.

Bounds: ``per_class`` labelled rows of each class are fitted, the smallest by a
hash of their id, one row an id (of several, the one of the smallest text hash);
``features`` word parts are kept, chosen by how far apart their rates in the two
classes are. Scoring reads every text whole, in one pass without a shuffle.

Cases: a null text scores as an empty one, which gets the model's intercept;
labels other than 0 and 1 (null included), null ids and labels without a
document are not learnt from; repeated labels count once, the larger label
winning; with fewer than two classes every score is the share of label 1 (0
without labels); all rows and their other columns stay, but for columns named
``score`` and ``predicted``, which are replaced.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BYTE_VALUE, MATCH_CLASS, P, P_INVERSE, as_binary, bounded_batches, checkpointed, mix, powers, session_of, slices, text_bytes

#: Terms for groups of people by kind and language; a swap stays within a kind.
IDENTITY_TERMS = (
    ("women", "men", "girls", "boys", "mothers", "fathers"), ("woman", "man", "girl", "boy", "mother", "father"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"), ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"), ("black", "white", "asian", "latino", "african", "european"),
    ("immigrants", "refugees", "natives", "foreigners"), ("blind", "deaf", "disabled", "elderly", "young"),
    ("femmes", "hommes", "filles", "garçons"), ("musulmans", "chrétiens", "juifs", "athées"), ("immigrés", "réfugiés", "étrangers"), ("aveugles", "sourds", "handicapés"),
    ("frauen", "männer", "mädchen", "jungen"), ("muslime", "christen", "juden", "atheisten"), ("einwanderer", "flüchtlinge", "ausländer"), ("blinde", "gehörlose", "behinderte"),
    ("mujeres", "hombres", "niñas", "niños"), ("musulmanes", "cristianos", "judíos", "ateos"), ("inmigrantes", "refugiados", "extranjeros"), ("ciegos", "sordos", "discapacitados"),
)
PREFIXES = (3, 4, 5, 6, 7, 8, 9)
WHOLE = 0


def parts_of(column: pa.Array):
    """(document, hash) of every part of every word, kind of part by kind of part."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    text = as_binary(pc.utf8_lower(column)).fill_null(b"")
    n = len(text)
    offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + n + 1]
    low, high = int(offsets[0]), int(offsets[-1])
    offsets = offsets - low
    if high == low:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    data = np.frombuffer(text.buffers()[2], np.uint8, count=high)[low:]
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = MATCH_CLASS[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    starts = np.flatnonzero(inside[1:] & (~inside[:-1] | first))
    ends = np.flatnonzero(inside[:-1] & (~inside[1:] | first))
    own = np.searchsorted(offsets, starts, "right") - 1
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_VALUE[data] * powers(P, len(data)), out=sums[1:])
    back = powers(P_INVERSE, len(data) + 1)[starts]
    documents, hashes = [own], [mix((sums[ends] - sums[starts]) * back + np.uint64(WHOLE))]
    for size in PREFIXES:
        long = np.flatnonzero(ends - starts >= size)
        documents.append(own[long])
        hashes.append(mix((sums[starts[long] + size] - sums[starts[long]]) * back[long] + np.uint64(size)))
    return np.concatenate(documents), np.concatenate(hashes)


def counts_of(column: pa.Array, vocabulary: np.ndarray, parts=parts_of):
    """(document, feature, count) of the parts in the sorted vocabulary."""
    document, part = parts(column)
    if not len(vocabulary):
        return (np.zeros(0, np.int64),) * 3
    # Most parts are no features: a bitmap of 2**20 bits (2**17 bytes) turns them away.
    slot = part >> np.uint64(44)
    bitmap = np.zeros(1 << 20, bool)
    bitmap[vocabulary >> np.uint64(44)] = True
    some = bitmap[slot]
    document, part = document[some], part[some]
    at = np.searchsorted(vocabulary, part)
    at[at == len(vocabulary)] = 0
    hit = vocabulary[at] == part
    cell, count = np.unique(document[hit] * len(vocabulary) + at[hit], return_counts=True)
    return cell // len(vocabulary), cell % len(vocabulary), count


def naming(terms=IDENTITY_TERMS) -> re.Pattern:
    return re.compile(r"\b(?:" + "|".join(re.escape(t) for kind in terms for t in kind) + r")\b", re.I)


def swapped(text: str, terms=IDENTITY_TERMS, pattern: re.Pattern | None = None) -> str:
    """The text with each identity term replaced by the next of its kind."""
    to = {t: kind[(i + 1) % len(kind)] for kind in terms for i, t in enumerate(kind)}
    return (pattern or naming(terms)).sub(lambda m: to[m[0].lower()], text)


def counterfactual(text: str, terms=IDENTITY_TERMS, pattern: re.Pattern | None = None) -> str:
    """The text with its identity terms swapped, or, if it has none, with one put in after one of its words."""
    pattern = pattern or naming(terms)
    if pattern.search(text):
        return swapped(text, terms, pattern)
    draw = zlib.crc32(text.encode())
    kind = terms[draw % len(terms)]
    term = kind[draw // len(terms) % len(kind)]
    gap = text.find(" ", draw % (len(text) + 1))
    return f"{text} {term}" if gap < 0 else f"{text[:gap]} {term}{text[gap:]}"


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, change: np.ndarray, penalty: float = 1.0, l2: float = 1e-3, steps: int = 400, touched: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """Logistic weights and intercept; ``change`` holds the changes that the counterfactuals make to the features ``touched`` (all by default).

    Minimises mean weighted log loss + l2 |w|^2 + penalty * mean (change @ w)^2 by Nesterov steps.
    """
    n = max(1e-9, weight.sum())
    touched = np.arange(x.shape[1]) if touched is None else touched
    x, change = np.asarray(x, np.float32), np.asarray(change, np.float32)
    scale = np.einsum("ij,ij->i", x, x) @ weight / n
    step = 1.0 / (0.25 * float(scale + 1) + 2 * l2 + 2 * penalty * (float((change * change).sum()) / len(change) if len(change) else 0.0))
    step *= 8  # the bound by the trace is far too careful; a step that raises the loss is taken back below
    w, b = np.zeros(x.shape[1]), 0.0
    vw, vb, last, momentum = w.copy(), b, np.inf, 1.0
    for _ in range(steps):
        at = vw.astype(np.float32)
        z = (x @ at).astype(float) + vb
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        e = weight * (p - y) / n
        moved = (change @ at[touched]).astype(float) if len(change) else np.zeros(0)
        loss = float((weight * (np.logaddexp(0, z) - y * z)).sum() / n + l2 * vw @ vw + (penalty * (moved**2).mean() if len(moved) else 0))
        if loss > last + 1e-9:
            step, momentum, vw, vb, last = step / 2, 1.0, w.copy(), b, np.inf
            continue
        last = loss
        gw = e.astype(np.float32) @ x + 2 * l2 * vw
        if len(moved):
            gw[touched] += 2 * penalty * moved.astype(np.float32) @ change / len(moved)
        nw, nb = vw - step * gw, vb - step * float(e.sum())
        after = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        vw, vb = nw + (momentum - 1) / after * (nw - w), nb + (momentum - 1) / after * (nb - b)
        w, b, momentum = nw, nb, after
    return w, b


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, per_class: int) -> tuple[DataFrame, dict[int, int]]:
    """(id, text, label) of at most ``per_class`` rows of each class, one an id, by a hash of the id; and the classes' sizes over all ``labels``."""
    clean = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("label"))
    sizes = {r["label"]: r["n"] for r in clean.groupBy("label").agg(F.count("*").alias("n")).collect()}
    ranked = [clean.where(F.col("label") == c).orderBy(F.xxhash64("id"), "id").limit(per_class) for c in (0, 1)]
    chosen = ranked[0].union(ranked[1])
    # Two classes of per_class rows of 12 bytes: the bound of this broadcast.
    met = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id")
    # An id may have any number of rows; one of them is taken, so the bound is one of rows.
    return met.groupBy("id", "label").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")), sizes


def telling_parts(sample: DataFrame, size: int, parts=parts_of) -> np.ndarray:
    """The hashes, sorted, of the word parts whose document rates differ most between the classes, in units of their standard error."""

    def run(batches):
        for part in slices(batches, "text", 1 << 20):
            label = part.column(1).to_numpy(zero_copy_only=False)
            document, hashes = parts(part.column(0))
            order = np.lexsort((hashes, document))
            document, hashes = document[order], hashes[order]
            new = np.ones(len(hashes), bool)
            new[1:] = (document[1:] != document[:-1]) | (hashes[1:] != hashes[:-1])
            kinds, at = np.unique(hashes[new], return_inverse=True)
            of = label[document[new]]
            counts = [np.bincount(at, weights=of == c, minlength=len(kinds)).astype(np.int64) for c in (0, 1)]
            yield pa.RecordBatch.from_arrays([pa.array(kinds.view(np.int64)), pa.array(counts[0]), pa.array(counts[1])], names=["part", "n0", "n1"])

    total = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    counted = sample.select("text", "label").mapInArrow(run, "part long, n0 long, n1 long").groupBy("part").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    a, b = F.col("n1") + 0.5, F.col("n0") + 0.5
    odds = F.log(a / (total.get(1, 0) - F.col("n1") + 0.5)) - F.log(b / (total.get(0, 0) - F.col("n0") + 0.5))
    top = counted.where("n0 + n1 > 1").orderBy((F.abs(odds) / F.sqrt(1 / a + 1 / b)).desc(), "part").limit(size)
    return np.sort(top.select("part").toArrow().column(0).to_numpy().view(np.uint64))


def _counted(sample: DataFrame, vocabulary: np.ndarray) -> DataFrame:
    """(id, label, features, values): the features of each text of ``sample(id, label, text)``."""

    def run(batches):
        for part in slices(batches, "text", 1 << 20):
            document, feature, count = counts_of(part.column(2), vocabulary)
            yield pa.RecordBatch.from_arrays([*part.columns[:2], *_lists(document, feature, np.log1p(count), part.num_rows)], names=["id", "label", "features", "values"])

    return sample.select(F.col("id").cast("string").alias("id"), "label", "text").mapInArrow(run, "id string, label int, features array<int>, values array<float>")


def _changed(sample: DataFrame, vocabulary: np.ndarray, terms) -> DataFrame:
    """(id, features, values): what the counterfactual of each text changes of its features."""

    def run(batches):
        pattern, size = naming(terms), len(vocabulary)
        for part in slices(batches, "text", 1 << 20):
            texts = [t.decode() for t in text_bytes(part.column(1))]
            cells, values = [], []
            for sign, side in ((-1, texts), (1, [counterfactual(t, terms, pattern) for t in texts])):
                document, feature, count = counts_of(pa.array(side, pa.string()), vocabulary)
                cells.append(document * size + feature)
                values.append(sign * np.log1p(count))
            cell, at = np.unique(np.concatenate(cells), return_inverse=True)
            change = np.bincount(at, weights=np.concatenate(values), minlength=len(cell))
            cell, change = cell[change != 0], change[change != 0]
            yield pa.RecordBatch.from_arrays([part.column(0), *_lists(cell // size, cell % size, change, part.num_rows)], names=["id", "features", "values"])

    return sample.select(F.col("id").cast("string").alias("id"), "text").mapInArrow(run, "id string, features array<int>, values array<float>")


def _lists(document: np.ndarray, feature: np.ndarray, value: np.ndarray, rows: int) -> list[pa.Array]:
    ends = pa.array(np.searchsorted(document, np.arange(rows + 1)).astype(np.int32))
    return [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (feature.astype(np.int32), value.astype(np.float32))]


def _dense(rows: pa.Table, columns: int) -> np.ndarray:
    out = np.zeros((rows.num_rows, columns), np.float32)
    if rows.num_rows:
        lists = rows.column("features").combine_chunks()
        row = np.repeat(np.arange(rows.num_rows), np.diff(lists.offsets.to_numpy()))
        out[row, lists.flatten().to_numpy()] = rows.column("values").combine_chunks().flatten().to_numpy()
    return out


class Toxicity:
    """A fitted model: sorted part hashes, their weights, an intercept."""

    def __init__(self, vocabulary: np.ndarray, weights: np.ndarray, intercept: float):
        self.vocabulary, self.weights, self.intercept = vocabulary, weights, intercept

    def score(self, column: pa.Array) -> np.ndarray:
        document, feature, count = counts_of(column, self.vocabulary)
        z = self.intercept + np.bincount(document, weights=self.weights[feature] * np.log1p(count), minlength=len(column))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def train(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    per_class: int = 2500, features: int = 2000, penalty: float = 1.0, l2: float = 3e-5, terms=IDENTITY_TERMS,
) -> Toxicity:
    """Fit on a bounded sample of ``docs`` that ``labels`` covers.

    The driver holds ``2 * per_class`` rows of ``features`` single-precision numbers (40 MB with the defaults), and of
    the counterfactuals only the features that they touch.
    """
    if penalty > 0 and not any(terms):
        raise ValueError("there are no identity terms to make counterfactuals with")
    bounded_batches(session_of(docs))
    sample, sizes = labelled_sample(docs, labels, id_col, text_col, label_col, per_class)
    if len(sizes) < 2:
        share = float(next(iter(sizes), 0))
        return Toxicity(np.zeros(0, np.uint64), np.zeros(0), 30.0 if share else -30.0)
    # Cut here: all documents are read for it, and what follows needs the sample alone.
    sample = checkpointed(sample)
    vocabulary = telling_parts(sample, features)
    named = [t for kind in terms for t in kind]
    if named:
        vocabulary = np.unique(np.concatenate([vocabulary, parts_of(pa.array([" ".join(named)]))[1][: len(named)]]))
    rows = _counted(sample, vocabulary).toArrow().sort_by("id")
    if not {0, 1} <= set(rows.column("label").to_pylist()):
        return Toxicity(np.zeros(0, np.uint64), np.zeros(0), 0.0)
    y = rows.column("label").to_numpy().astype(float)
    x = _dense(rows, len(vocabulary))
    change, touched = np.zeros((0, 0), np.float32), np.zeros(0, np.int64)
    if penalty > 0:
        changed = _changed(sample, vocabulary, terms).toArrow().sort_by("id")
        touched = np.unique(changed.column("features").combine_chunks().flatten().to_numpy())
        if not len(touched):
            raise ValueError("no counterfactual changes any feature")
        change = _dense(changed, len(vocabulary))[:, touched]
    share = {c: sizes[c] / sum(sizes.values()) for c in (0, 1)}
    weight = np.where(y == 1, share[1] / max(1, (y == 1).sum()), share[0] / max(1, (y == 0).sum())) * len(y)
    weights, intercept = fit(x, y, weight, change, penalty, l2, touched=touched)
    return Toxicity(vocabulary, weights, intercept)


def with_toxicity(docs: DataFrame, model: Toxicity, text_col: str = "text", threshold: float = 0.3, prefix: str = "") -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 from the threshold on), after ``prefix``, added."""
    added = [f"{prefix}score", f"{prefix}predicted"]
    docs = docs.drop(*added)
    shared = session_of(docs).sparkContext.broadcast(model)
    where, names = docs.columns.index(text_col), docs.columns

    def run(batches):
        fitted = shared.value
        for part in slices(batches, text_col, 1 << 20):
            score = fitted.score(part.column(where))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=[*names, *added])

    bounded_batches(session_of(docs))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{fields}, `{added[0]}` double, `{added[1]}` int")
