"""Connected components of a graph given as an edge table, and what stays of each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, unused


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(id, component) for every end of ``edges(a, b)``; ``component`` is the smallest id reachable.

    Alternating large-star and small-star steps (Kiveris et al., 2014). Each
    step takes the smallest neighbour with a partially aggregated ``min`` and
    rewires by an equi-join, so no neighbourhood is ever gathered in one task;
    every round ends in a reliable checkpoint. Null ends and loops are ignored.
    """
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = checkpointed(edges)
    before = None
    for _ in range(max_rounds):
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        rewired = large.join(lower, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = checkpointed(rewired.union(lower.select("u", F.col("m").alias("v"))).distinct())
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).union(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


def one_of_each(docs: DataFrame, members: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each group of ``members(id, tk, component)``, where ``tk`` is the XXH64 of the text.

    The one of the smallest id stays, null ids last, then of the smallest
    ``tk``. Rows are told apart by id and text: others of its id stay, and of
    rows equal in both one stays.
    """
    own = unused(docs)
    id_, tk = f"{own}id", f"{own}tk"
    rows = members.select("id", "tk", "component").distinct()
    first = rows.groupBy("component").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "tk")).alias("first"))
    gone = rows.join(first, "component").where(~(F.col("id").eqNullSafe(F.col("first.id")) & (F.col("tk") == F.col("first.tk"))))
    gone = gone.select(F.col("id").alias(f"{own}gone_id"), F.col("tk").alias(f"{own}gone_tk"))
    keyed = docs.withColumns({id_: F.col(id_col).cast("long"), tk: F.xxhash64(text_col)})
    kept = keyed.join(gone, F.col(id_).eqNullSafe(F.col(f"{own}gone_id")) & (F.col(tk) == F.col(f"{own}gone_tk")), "left_anti")
    return kept.dropDuplicates([id_, tk]).drop(id_, tk)
