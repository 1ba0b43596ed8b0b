"""Query workloads made from the head of a dictionary, and consistency checks between two answers."""

from __future__ import annotations

import random
from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

OPERATORS = ("AND", "OR")


def _slots(*names) -> list[str]:
    return [f"{{{n}}}" for n in names]


def _shapes() -> list[str]:
    """Query shapes over slots named by frequency band (high, middle, low) and by initial: pairs, chains, negations, groups."""
    bands, initials = _slots("h0", "h1", "m0", "l0"), _slots("a0", "b0", "c0")
    out = [f"{x} {op} {y}" for op in OPERATORS for x, y in combinations(bands, 2)]
    out += [f" {op} ".join(slots) for op in OPERATORS for slots in (initials[:2], initials)]
    out += [f"NOT {x}" for x in bands[::2]]
    for inner, outer in (OPERATORS, OPERATORS[::-1]):
        group = f"({bands[0]} {inner} {bands[2]})"
        out += [f"{group} {outer} {bands[1]}", f"{bands[1]} {outer} {group}", f"({group} {outer} {bands[3]}) AND NOT {bands[1]}"]
    return out


def _flat_shapes(terms: int = 4) -> list[str]:
    """Queries without groups over the first ``terms`` terms: each alone, then neighbours by two and three."""
    slots = _slots(*range(terms))
    return slots + [f" {op} ".join(slots[at : at + n]) for op in OPERATORS for n in (2, 3) for at in range(terms - n + 1)]


def _grouped_shapes() -> list[str]:
    a, b, c, d = _slots(*range(4))
    out = [shape for x, y in (OPERATORS, OPERATORS[::-1]) for shape in (f"({a} {x} {b}) {y} {c}", f"({a} {x} {b}) {y} ({c} {x} {d})")]
    return [*out, *(f"({shape}) AND NOT {d}" for shape in out[::2])]


SHAPES, FLAT_SHAPES, GROUPED_SHAPES = _shapes(), _flat_shapes(), _grouped_shapes()


def tertiles(posting: DataFrame, n: int = 3) -> DataFrame:
    """(band, place, term, doc_freq): the ``n`` most frequent terms of each third of the terms by frequency.

    Thirds are cut by rank. Ranks come from counts by frequency, of which there are
    few, so no task sorts the vocabulary; places within a frequency are dealt by term.
    """
    df = posting.groupBy("term").agg(F.count("*").alias("doc_freq"))
    by_freq = df.groupBy("doc_freq").agg(F.count("*").alias("terms"))
    above = Window.orderBy(F.desc("doc_freq")).rowsBetween(Window.unboundedPreceding, -1)
    ranks = by_freq.withColumns({"before": F.coalesce(F.sum("terms").over(above), F.lit(0)), "total": F.sum("terms").over(Window.partitionBy())})
    third = F.floor(F.col("total") / 3)
    cuts = [F.lit(0), third, F.floor(F.col("total") * 2 / 3)]
    # Only frequencies that hold one of the wanted ranks keep their terms.
    wanted = [(F.col("before") < c + n) & (F.col("before") + F.col("terms") > c) for c in cuts]
    held = df.join(ranks, "doc_freq").where(wanted[0] | wanted[1] | wanted[2])
    ranked = held.withColumn("rank", F.col("before") + F.row_number().over(Window.partitionBy("doc_freq").orderBy("term")) - 1)
    band = F.when(F.col("rank") >= cuts[2], "low").when(F.col("rank") >= cuts[1], "mid").otherwise("high")
    start = F.when(F.col("rank") >= cuts[2], cuts[2]).when(F.col("rank") >= cuts[1], cuts[1]).otherwise(cuts[0])
    placed = ranked.withColumns({"band": band, "place": (F.col("rank") - start).cast("long")})
    return placed.where(F.col("place") < n).select("band", "place", "term", "doc_freq")


def by_letter(posting: DataFrame, letters: int = 3) -> DataFrame:
    """(letter, term, doc_freq): the most frequent term of each of the first ``letters`` initials."""
    df = posting.groupBy("term").agg(F.count("*").alias("doc_freq"))
    best = df.groupBy(F.substring("term", 1, 1).alias("letter")).agg(F.min(F.struct((-F.col("doc_freq")).alias("less"), "term")).alias("best"))
    return best.select("letter", "best.term", (-F.col("best.less")).alias("doc_freq")).orderBy("letter").limit(letters)


def dictionary_queries(posting: DataFrame, limit: int = len(SHAPES)) -> list[str]:
    """Boolean queries over high, middle and low frequencies and different initials."""
    slots = {f"{r['band'][0]}{r['place']}": r["term"] for r in tertiles(posting).collect()}
    for name, row in zip("abc", by_letter(posting).collect(), strict=False):
        slots[f"{name}0"] = row["term"]
    out = []
    for shape in SHAPES:
        try:
            out.append(shape.format(**slots))
        except KeyError:
            continue
    return out[:limit]


def comprehensive_queries(posting: DataFrame, mode: str = "balanced", limit: int = 20, seed: int = 42) -> list[str]:
    """Seeded mixes of shapes: ``and``, ``or``, ``not``, ``mixed`` or ``balanced``."""
    pool = dictionary_queries(posting, len(SHAPES))
    kinds = {
        "and": [q for q in pool if "OR" not in q and "NOT" not in q],
        "or": [q for q in pool if "OR" in q.split() and "AND" not in q.split()],
        "not": [q for q in pool if q.startswith("NOT")],
        "mixed": [q for q in pool if "(" in q],
        "balanced": pool,
    }
    chosen = list(kinds[mode])
    random.Random(seed).shuffle(chosen)
    return chosen[:limit]


def flat_queries(top: list[str]) -> list[str]:
    """Single, AND and OR queries over the most frequent terms."""
    return [s.format(*top) for s in FLAT_SHAPES] if len(top) > 3 else list(top[:1])


def boolean_queries(top: list[str]) -> list[str]:
    return [s.format(*top) for s in GROUPED_SHAPES]


def corpus_phrases(docs: DataFrame, n: int = 10) -> DataFrame:
    """(phrase, docs): the two-word phrases of most documents, a lexicon where none is given (T4) and a phrase workload.

    A document's repeats go before the shuffle.
    """
    pairs = F.zip_with(F.slice("tokens", 1, F.size("tokens") - 1), F.slice("tokens", 2, F.size("tokens")), lambda a, b: F.concat_ws(" ", a, b))
    rows = docs.where(F.size("tokens") > 1).select(F.explode(F.array_distinct(pairs)).alias("phrase"))
    return rows.groupBy("phrase").agg(F.count("*").alias("docs")).orderBy(F.desc("docs"), "phrase").limit(n)


def phrase_queries(docs: DataFrame, n: int = 6, distances: tuple[int, ...] = (5, 3, 10)) -> list[tuple]:
    """Phrases, one in capitals, and (term, term, distance) of the same words."""
    found = [r["phrase"] for r in corpus_phrases(docs, n).collect()]
    upper = [p.upper() if i == n - 1 else p for i, p in enumerate(found)]
    return [("phrase", p) for p in upper] + [("proximity", *p.split(), k) for p, k in zip(found, distances, strict=False)]


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of either side that the other lacks, with the side; empty if the answers agree."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).union(b.exceptAll(a).withColumn("side", F.lit("right")))


def consistency(a: DataFrame, b: DataFrame) -> DataFrame:
    """(left_rows, right_rows, differing): sizes of two answers and of their symmetric difference, one row."""
    sides = a.select(*a.columns, F.lit(1).alias("l"), F.lit(0).alias("r")).union(b.select(*a.columns, F.lit(0), F.lit(1)))
    rows = sides.groupBy(*a.columns).agg(F.sum("l").alias("l"), F.sum("r").alias("r"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return rows.agg(total("l").alias("left_rows"), total("r").alias("right_rows"), total(F.abs(F.col("l") - F.col("r"))).alias("differing"))
