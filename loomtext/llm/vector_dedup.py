"""Embedding near-duplicates by quantised tile products.

Vectors of one label are compared by cosine. Each unit vector x is rounded to
eight-bit codes c with a step s, x = s c + e, and the norm of e is kept. Tile
products of codes are taken over 1024 components at a time, where single precision
is exact (1024 * 127**2 < 2**24), and summed in double precision; and

    |x.y - s_x s_y c_x.c_y| <= |e_x| (1 + |e_y|) + |e_y| (1 + |e_x|) + |e_x| |e_y|

bounds the error of every pair (Cauchy-Schwarz; |s c| <= 1 + |e|), so only pairs
that may reach the threshold are computed again, in double precision.

Equal vectors of a label are one vector with a count first. The rest is dealt by
a hash into tiles of about ``tile`` vectors (fewer where they are long, so that a
tile holds ``TILE_VALUES`` components at most), and each pair of tiles of a label is
one unit of work; a tile pair is passed over if the angle between the tiles'
centres less both radii is beyond the threshold's. Of a tile pair, what leaves
is a count of links by vector and a spanning forest of the links, never the
links themselves. All pairs of one label are compared, so the work grows with
the square of the largest label's distinct vectors, spread evenly over tasks.

Cases: null labels, and vectors that are null, empty, zero or hold null or
non-finite components link with nothing; vectors of different lengths are not
compared; vectors are scaled by their largest component first, so that no square
overflows or vanishes; each row is a vector of its own, also under an id that
another row has, and links count rows; a component is named by the smallest
non-null id among its rows (null if there is none); an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, checkpointed, session_of
from .components import connected_components

TILE = 1024
#: Components that a tile holds at most, about.
TILE_VALUES = 1 << 20
#: Components over which a product of codes is exact in single precision.
EXACT = 1024


def quantise(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes as int8, steps, norms of what rounding left) of unit rows."""
    step = np.maximum(np.abs(unit).max(1), 1e-300) / 127
    codes = np.rint(unit / step[:, None]).astype(np.int8)
    # The slack covers the rounding of these few double operations themselves.
    left = np.linalg.norm(unit - codes * step[:, None], axis=1) + 1e-12
    return codes, step, left


def code_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The whole-number products of the rows of two arrays of eight-bit codes, exactly."""
    out = np.zeros((len(a), len(b)))
    for at in range(0, a.shape[1], EXACT):
        out += a[:, at : at + EXACT].astype(np.float32) @ b[:, at : at + EXACT].astype(np.float32).T
    return out


def tile_links(a: np.ndarray, b: np.ndarray | None, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows i of ``a`` and j of ``b`` with cosine >= threshold; without ``b``, pairs i < j of ``a``.

    ``a`` and ``b`` are unit vectors in double precision.
    """
    other = a if b is None else b
    (ca, sa, ea), (cb, sb, eb) = quantise(a), quantise(other)
    about = code_products(ca, cb) * sa[:, None] * sb[None, :]
    slack = ea[:, None] * (1 + eb[None, :]) + eb[None, :] * (1 + ea[:, None]) + ea[:, None] * eb[None, :]
    maybe = about + slack >= threshold
    if b is None:
        maybe = np.triu(maybe, 1)
    i, j = np.nonzero(maybe)
    yes = np.zeros(len(i), bool)
    for at in range(0, len(i), 1 << 16):
        part = slice(at, at + (1 << 16))
        yes[part] = np.einsum("ij,ij->i", a[i[part]], other[j[part]]) >= threshold
    return i[yes], j[yes]


def _forest(i: np.ndarray, j: np.ndarray, ids: list[int]) -> list[tuple[int, int]]:
    root: dict[int, int] = {}
    out = []

    def find(x):
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in zip(i.tolist(), j.tolist(), strict=True):
        a, b = find(a), find(b)
        if a != b:
            root[b] = a
            out.append((ids[a], ids[b]))
    return out


def _unit(tile: pa.ListScalar) -> np.ndarray:
    """The unit vectors of a list of vectors of one length."""
    x = tile.values.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(tile.values), -1)
    x /= np.abs(x).max(1)[:, None]
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _apart(a: np.ndarray, b: np.ndarray, threshold: float) -> bool:
    """Whether the tiles' centres and radii rule out any link."""
    angle = lambda x: np.arccos(np.clip(x, -1, 1))
    centres = [x.mean(0) for x in (a, b)]
    norms = [np.linalg.norm(c) for c in centres]
    if min(norms) < 1e-9:
        return False
    ca, cb = (c / n for c, n in zip(centres, norms, strict=True))
    return bool(angle(ca @ cb) - angle((a @ ca).min()) - angle((b @ cb).min()) > angle(threshold) + 1e-6)


def _compare(pairs: DataFrame, threshold: float) -> DataFrame:
    """(kind, a, b): kind 0, vector a has b more linked rows; kind 1, an edge between a and b."""

    def run(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                row = {name: batch.column(i)[at] for i, name in enumerate(batch.schema.names)}
                own, a = row["own"].as_py(), _unit(row["va"])
                ids, counts = row["ia"].as_py(), np.array(row["na"].as_py())
                if own:
                    i, j = tile_links(a, None, threshold)
                    links = np.zeros(len(ids), np.int64)
                    np.add.at(links, i, counts[j])
                    np.add.at(links, j, counts[i])
                else:
                    b = _unit(row["vb"])
                    if _apart(a, b, threshold):
                        continue
                    i, j = tile_links(a, b, threshold)
                    j = j + len(ids)
                    ids, counts = ids + row["ib"].as_py(), np.concatenate([counts, row["nb"].as_py()])
                    links = np.zeros(len(ids), np.int64)
                    np.add.at(links, i, counts[j])
                    np.add.at(links, j, counts[i])
                some = np.flatnonzero(links).tolist()
                edges = _forest(i, j, ids)
                kind = np.concatenate([np.zeros(len(some), np.int32), np.ones(len(edges), np.int32)])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(kind), pa.array([ids[x] for x in some] + [e[0] for e in edges], pa.int64()), pa.array([int(links[x]) for x in some] + [e[1] for e in edges], pa.int64())],
                    names=["kind", "a", "b"],
                )

    bounded_batches(session_of(pairs), 4)
    return pairs.mapInArrow(run, "kind int, a long, b long")


def near_vectors(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    threshold: float = 0.98, tile: int = TILE,
) -> DataFrame:
    """(id, n_links, component_id) with one row per row of ``vectors``."""
    v = F.col("v")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("v"))
    # A key for each row: ids may be null or equal.
    rows = checkpointed(rows.withColumn("row", F.monotonically_increasing_id()))
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    usable = rows.where(F.col("label").isNotNull() & v.isNotNull() & (F.size(v) > 0) & F.coalesce(finite, F.lit(False)) & F.exists(v, lambda x: x != 0))
    distinct = usable.groupBy("label", "v").agg(F.min("row").alias("node"), F.count("*").alias("copies"))
    distinct = checkpointed(distinct)
    family = ["label", "dim"]
    placed = distinct.withColumn("dim", F.size("v"))
    sizes = placed.groupBy(*family).agg(F.ceil(F.count("*") / F.least(F.lit(tile), F.greatest(F.lit(TILE_VALUES) / F.col("dim"), F.lit(1)))).cast("int").alias("tiles"))
    placed = placed.join(sizes, family).withColumn("tile", F.pmod(F.xxhash64("v"), F.col("tiles")).cast("int"))
    # A hash deals about ``tile`` vectors to each.
    tiles = placed.groupBy(*family, "tiles", "tile").agg(F.collect_list(F.struct("node", "copies", "v")).alias("x"))
    tiles = checkpointed(tiles.select(*family, "tiles", "tile", F.col("x.node").alias("i"), F.col("x.copies").alias("n"), F.col("x.v").alias("v")))
    left = tiles.select(*family, F.explode(F.sequence(F.col("tile"), F.col("tiles") - 1)).alias("other"), F.col("tile").alias("mine"), F.col("i").alias("ia"), F.col("n").alias("na"), F.col("v").alias("va"))
    right = tiles.select(*family, F.col("tile").alias("other"), F.col("i").alias("ib"), F.col("n").alias("nb"), F.col("v").alias("vb"))
    same = F.col("mine") == F.col("other")
    empty = lambda c: F.when(same, None).otherwise(F.col(c)).alias(c)
    pairs = left.join(right, [*family, "other"]).select(same.alias("own"), "ia", "na", "va", *map(empty, ("ib", "nb", "vb")))
    found = checkpointed(_compare(pairs, threshold))
    counts = found.where("kind = 0").groupBy(F.col("a").alias("node")).agg(F.sum("b").alias("others"))
    components = connected_components(found.where("kind = 1").select("a", "b"))
    nodes = distinct.join(counts, "node", "left").join(components, distinct["node"] == components["id"], "left")
    nodes = nodes.select("label", "v", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("component"))
    members = usable.join(nodes, ["label", "v"]).select("row", "n_links", "component")
    named = members.join(rows.select("row", "id"), "row")
    smallest = named.groupBy("component").agg(F.min("id").alias("component_id"))
    linked = members.join(smallest, "component").select("row", "n_links", "component_id")
    out = rows.select("row", "id").join(linked, "row", "left")
    return out.select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("n_links").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"))
