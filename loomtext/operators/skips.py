"""Skip pointers over posting lists."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import SkipConfig
from ..functions import codec as C
from ..functions.codec import skip_step_of
from ..plans import boolean_ast as A


def skip_steps(posting: DataFrame, config: SkipConfig) -> DataFrame:
    """(term, df, step, pointers)."""
    step = C.skip_step(F.col("df"), config)
    steps = posting.groupBy("term").agg(F.count("*").alias("df")).withColumn("step", step)
    pointers = F.when(F.col("df") < config.min_list_length, 0).otherwise(F.floor((F.col("df") - 1) / F.col("step")))
    return steps.withColumn("pointers", pointers.cast("long"))


def skip_pointers(lists: DataFrame, config: SkipConfig) -> DataFrame:
    """(term, pos, target_pos, target_doc_id, target_offset) from ``lists(term, df, doc_ids)``.

    ``target_offset`` is the target's place in the term's binary list: 4 bytes an id, 12 a pointer before it.
    """
    df = F.col("df")
    sized = lists.where(df >= config.min_list_length).withColumn("step", C.skip_step(df, config)).where(F.col("step") < df)
    rows = sized.select("term", "df", "step", "doc_ids", F.explode(F.sequence(F.col("step") - 1, df - 2, F.col("step"))).alias("pos"))
    target = F.least(F.col("pos") + F.col("step"), F.col("df") - 1)
    before = F.floor(F.col("target_pos") / F.col("step"))
    return rows.withColumn("target_pos", target).select(
        "term", "pos", "target_pos", F.get("doc_ids", F.col("target_pos").cast("int")).alias("target_doc_id"), (F.col("target_pos") * 4 + before * 12).cast("long").alias("target_offset")
    )


def skip_dictionary(posting: DataFrame, config: SkipConfig) -> DataFrame:
    """(term, doc_freq, bytes, pointers, pointer) of the binary form with skip pointers."""
    from .index import _numbered

    sized = skip_steps(posting, config).select("term", F.col("df").alias("doc_freq"), "pointers", (F.col("df") * 4 + F.col("pointers") * 12).alias("bytes"))
    return _numbered(sized, ["bytes"]).select("term", "doc_freq", "bytes", "pointers", F.col("bytes_before").alias("pointer"))


def skip_stats(posting: DataFrame, config: SkipConfig) -> DataFrame:
    """(terms_with_pointers, total_pointers, extra_bytes)."""
    steps = skip_steps(posting, config)
    return steps.agg(F.count_if(F.col("pointers") > 0).alias("terms_with_pointers"), F.sum("pointers").alias("total_pointers"), (F.sum("pointers") * 12).alias("extra_bytes"))


def skip_overhead(lists: DataFrame, config: SkipConfig) -> DataFrame:
    """Bytes that pointers add to the variable-byte form: a marker and the target's code each."""
    pointers = skip_pointers(lists, config)
    return pointers.agg(F.count("*").alias("pointers"), F.sum(1 + C.vb_length(F.col("target_doc_id"))).alias("vb_extra_bytes"))


def merge_with_skips(a: list[int], b: list[int], step: int) -> tuple[list[int], int, int]:
    """(common ids, comparisons, jumps) of two sorted lists, where ``b`` has a pointer every ``step`` places.

    The textbook rule: at a pointer, jump while its target is not beyond the sought id.
    """
    out, i, j, compared, jumps = [], 0, 0, 0, 0
    while i < len(a) and j < len(b):
        compared += 1
        if a[i] == b[j]:
            out.append(a[i])
            i, j = i + 1, j + 1
        elif a[i] < b[j]:
            i += 1
        else:
            moved = False
            while step > 1 and (j + 1) % step == 0 and j < len(b) - 1:
                target = min(j + step, len(b) - 1)
                compared += 1
                if b[target] > a[i]:
                    break
                j, moved, jumps = target, True, jumps + 1
            if not moved:
                j += 1
    return out, compared, jumps


def evaluate_with_skips(tree, lists: dict[str, list[int]], universe: list[int], config: SkipConfig, counts: dict[str, int]) -> list[int]:
    """Sorted ids that match a boolean tree, ANDs merged over skip pointers; ``counts`` adds up comparisons and jumps."""
    if isinstance(tree, A.Term):
        return lists.get(tree.word, [])
    if isinstance(tree, A.Nothing):
        return []
    if isinstance(tree, A.Everything):
        return universe
    if isinstance(tree, A.Not):
        out = set(evaluate_with_skips(tree.of, lists, universe, config, counts))
        return [x for x in universe if x not in out]
    parts = [evaluate_with_skips(p, lists, universe, config, counts) for p in tree.parts]
    if isinstance(tree, A.Or):
        return sorted(set().union(*parts))
    done, *rest = sorted(parts, key=len)
    for other in rest:
        step = skip_step_of(len(other), config) if len(other) >= config.min_list_length else 0
        done, compared, jumps = merge_with_skips(done, other, step)
        counts["comparisons"] += compared
        counts["jumps"] += jumps
    return done


def search_with_skips(query: str, posting: DataFrame, config: SkipConfig | None = None, block: int = 1 << 20) -> DataFrame:
    """(block, doc_ids, comparisons, jumps): a boolean query by merges over skip pointers, block of ids by block.

    A block covers ``block`` ids, so what a task holds is bounded by that and the number of the query's terms; each
    block's part of a list has pointers of its own. Documents matter only in blocks where a term occurs, unless the
    query holds for documents without any of its terms.
    """
    config = config or SkipConfig()
    tree = A.parse(query)
    words = A.terms(tree)
    rows = posting.where(F.col("term").isin(*words)).select("doc_id", "term")
    if A.holds(tree, ()):
        rows = rows.union(posting.select("doc_id", F.lit(None).cast("string")).distinct())
    else:
        rows = rows.union(rows.select("doc_id", F.lit(None).cast("string")).distinct())
    lists = rows.groupBy(F.floor(F.col("doc_id") / block).alias("block"), "term").agg(F.sort_array(F.collect_set("doc_id")).alias("ids"))
    lists = lists.groupBy("block").agg(F.collect_list(F.struct("term", "ids")).alias("lists"))

    def run(batches):
        for batch in batches:
            out = []
            for number, own in zip(batch["block"], batch["lists"], strict=True):
                by = {x["term"]: list(map(int, x["ids"])) for x in own}
                counts = {"comparisons": 0, "jumps": 0}
                found = evaluate_with_skips(tree, by, by.get(None, []), config, counts)
                out.append((number, found, counts["comparisons"], counts["jumps"]))
            yield pd.DataFrame(out, columns=["block", "doc_ids", "comparisons", "jumps"])

    return lists.mapInPandas(run, "block long, doc_ids array<long>, comparisons long, jumps long")


def term_positions(lists: DataFrame) -> DataFrame:
    """(term, doc_id, i, df): each posting with its place in its list."""
    order = Window.partitionBy("term").orderBy("doc_id")
    return lists.select("term", "df", F.posexplode("doc_ids").alias("i", "doc_id")).withColumn("i", F.col("i").cast("long")) if "doc_ids" in lists.columns else lists.withColumn("i", F.row_number().over(order) - 1)
