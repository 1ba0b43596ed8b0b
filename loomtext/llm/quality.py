"""A quality classifier learnt from preferences (Bradley-Terry).

A text is a row of numbers: surface statistics (the rates of character classes and
of each ASCII punctuation sign, of words that repeat the word before, the length
of words and of the text) and the rates of those words and word pairs whose
document rates differ most between the labels. Pairs of a preferred (label 1) and
another (label 0) labelled text are drawn with a seed; the probability that the
first wins is the logistic of the difference of their scores, so logistic loss on
feature differences fits the score. A document is good from a quantile of the
scores on: the one that leaves as large a share below as label 0 has. ``score`` is
the logistic of the distance to that threshold, so it is 0.5 there.

Bounds: ``per_class`` labelled rows of each class, one an id, ``pairs`` pairs and
``terms`` words and word pairs are fitted. Scoring reads every text whole, in one
pass without a shuffle.

Cases: a null text is scored as an empty one; labels other than 0 and 1 (null
included), null ids and labels without a document are not learnt from; repeated
labels count once, the larger label winning; of several rows of an id the one of
the smallest text hash is learnt from; with fewer than two classes every score is
that class (0.5 without labels); all rows and other columns stay, but for columns
named ``score`` and ``predicted``, which are replaced.
"""

from __future__ import annotations

import string

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import MATCH_CLASS, MATCH_FOLD, as_binary, bounded_batches, checkpointed, mix, session_of, slices, words_of
from .toxicity import counts_of, labelled_sample, telling_parts

_SIGNS = np.array([ord(c) for c in string.punctuation])
_GROUPS = [
    np.arange(ord("A"), ord("Z") + 1), np.arange(ord("a"), ord("z") + 1), np.arange(ord("0"), ord("9") + 1),
    np.array([32]), np.array([10]), np.array([0, *range(1, 10), *range(11, 32), 127]), np.arange(128, 256), _SIGNS,
]
N_SURFACE = len(_GROUPS) + len(_SIGNS) + 5
#: Against the standardised surface statistics, a term that makes up a hundredth of a text counts so much.
TERM_SCALE = 0.5


def terms_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of every word, folded to lower case, and of every two words in a row."""
    document, words, _ = words_of(column, MATCH_CLASS, MATCH_FOLD)
    pair = np.flatnonzero(document[1:] == document[:-1])
    pairs = mix(words[pair] * np.uint64(0x9E3779B97F4A7C15) + words[pair + 1])
    return np.concatenate([document, document[pair]]), np.concatenate([words, pairs])


def features_of(column: pa.Array, vocabulary: np.ndarray | None = None) -> np.ndarray:
    """(texts, N_SURFACE + terms): surface statistics, then the rates of the sorted term hashes of ``vocabulary``."""
    surface = surface_of(column)
    if vocabulary is None or not len(vocabulary):
        return surface
    document, feature, count = counts_of(column, vocabulary, terms_of)
    rates = np.zeros((len(column), len(vocabulary)))
    total = np.bincount(words_of(column, MATCH_CLASS, MATCH_FOLD)[0], minlength=len(column))
    rates[document, feature] = TERM_SCALE * np.log1p(100 * count / total[document])
    return np.hstack([surface, rates])


def surface_of(column: pa.Array) -> np.ndarray:
    """(texts, N_SURFACE) surface statistics."""
    text = as_binary(column).fill_null(b"")
    n = len(text)
    offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + n + 1]
    low, high = int(offsets[0]), int(offsets[-1])
    size = np.diff(offsets)
    counts = np.zeros((n, 256))
    if high > low:
        data = np.frombuffer(text.buffers()[2], np.uint8, count=high)[low:]
        counts = np.bincount(np.repeat(np.arange(n) * 256, size) + data, minlength=n * 256).reshape(n, 256).astype(float)
    length = np.maximum(size, 1)[:, None]
    rates = np.column_stack([counts[:, g].sum(1) for g in _GROUPS] + [counts[:, _SIGNS]]) / length
    document, words, bounds = words_of(column)
    total = np.diff(bounds)
    again = np.zeros(n)
    if len(words) > 1:
        same = (words[1:] == words[:-1]) & (document[1:] == document[:-1])
        again = np.bincount(document[1:][same], minlength=n).astype(float)
    upper = counts[:, _GROUPS[0]].sum(1) / np.maximum(1, counts[:, np.concatenate(_GROUPS[:2])].sum(1))
    shape = [np.log1p(100 * again / np.maximum(1, total)), size / np.maximum(1, total) / 10, np.log1p(total) / 5, np.log1p(10 * upper), (total == 0).astype(float)]
    return np.column_stack([np.log1p(100 * rates), *shape])


def bradley_terry(good: np.ndarray, bad: np.ndarray, pairs: int = 20000, l2: float = 1e-3, seed: int = 1) -> np.ndarray:
    """Weights that maximise the likelihood that each drawn good row beats its bad row; Newton steps."""
    rng = np.random.default_rng(seed)
    d = good[rng.integers(0, len(good), pairs)] - bad[rng.integers(0, len(bad), pairs)]
    w = np.zeros(d.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(d @ w, -30, 30)))
        gradient = d.T @ (p - 1) / pairs + 2 * l2 * w
        hessian = (d * (p * (1 - p))[:, None]).T @ d / pairs + 2 * l2 * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


class Quality:
    """A fitted model: term hashes, centre and scale of the features, weights and threshold; ``fixed`` overrides all."""

    def __init__(self, vocabulary=None, centre=None, scale=None, weights=None, threshold=0.0, fixed: float | None = None):
        self.vocabulary, self.centre, self.scale, self.weights, self.threshold, self.fixed = vocabulary, centre, scale, weights, threshold, fixed

    def score(self, column: pa.Array) -> np.ndarray:
        if self.fixed is not None:
            return np.full(len(column), self.fixed)
        raw = (features_of(column, self.vocabulary) - self.centre) / self.scale @ self.weights
        return 1 / (1 + np.exp(-np.clip(raw - self.threshold, -30, 30)))


def weighted_quantile(values: np.ndarray, weights: np.ndarray, share: float) -> float:
    """Halfway between the values on both sides of the place where ``share`` of the weight is reached."""
    order = np.argsort(values, kind="stable")
    values, below = values[order], np.cumsum(weights[order]) / weights.sum()
    at = min(int(np.searchsorted(below, share - 1e-9)), len(values) - 1)
    return float((values[at] + values[min(at + 1, len(values) - 1)]) / 2)


def fit_quality(x: np.ndarray, y: np.ndarray, share_bad: float, pairs: int = 20000, seed: int = 1, vocabulary: np.ndarray | None = None) -> Quality:
    # Surface statistics are standardised; terms, most of them rare, keep their own scale.
    centre, scale = x.mean(0), x.std(0) + 1e-3
    centre[N_SURFACE:], scale[N_SURFACE:] = 0, 1
    z = (x - centre) / scale
    w = bradley_terry(z[y == 1], z[y == 0], pairs, seed=seed)
    raw = z @ w
    weight = np.where(y == 0, share_bad / (y == 0).sum(), (1 - share_bad) / (y == 1).sum())
    return Quality(vocabulary, centre, scale, w, weighted_quantile(raw, weight, share_bad))


def train_quality(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    per_class: int = 4000, pairs: int = 20000, seed: int = 1, terms: int = 200,
) -> Quality:
    """Fit on a bounded sample of ``docs`` that ``labels`` covers."""
    bounded_batches(session_of(docs))
    sample, sizes = labelled_sample(docs, labels, id_col, text_col, label_col, per_class)
    if len(sizes) < 2:
        return Quality(fixed=float(next(iter(sizes))) if sizes else 0.5)
    # Cut here: all documents are read for it, and what follows needs the sample alone.
    sample = checkpointed(sample)
    vocabulary = telling_parts(sample, terms, terms_of)
    width = N_SURFACE + len(vocabulary)

    def run(batches):
        for part in slices(batches, "text"):
            x = features_of(part.column(0), vocabulary)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * width), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([part.column(1).cast(pa.int32()), part.column(2), lists], names=["label", "id", "x"])

    rows = sample.select("text", "label", sample["id"].cast("string").alias("id")).mapInArrow(run, "label int, id string, x array<double>").toArrow()
    rows = rows.sort_by([("id", "ascending")]).combine_chunks()
    y = rows.column("label").to_numpy()
    if not {0, 1} <= set(y.tolist()):
        return Quality(fixed=0.5)
    x = np.array(rows.column("x").combine_chunks().flatten()).reshape(-1, width)
    return fit_quality(x, y, sizes[0] / (sizes[0] + sizes[1]), pairs, seed, vocabulary)


def with_quality(docs: DataFrame, model: Quality, text_col: str = "text") -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 from 0.5 on) added."""
    docs = docs.drop("score", "predicted")
    shared = session_of(docs).sparkContext.broadcast(model)
    where, names = docs.columns.index(text_col), docs.columns

    def run(batches):
        fitted = shared.value
        for part in slices(batches, text_col):
            score = fitted.score(part.column(where))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=[*names, "score", "predicted"])

    bounded_batches(session_of(docs))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{fields}, score double, predicted int")
