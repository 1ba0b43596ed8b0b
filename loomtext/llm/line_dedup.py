"""Line deduplication by overlapping windows of three lines.

A text is cut at line feeds; lines of white space alone take no part. Every
three consecutive lines of one document form a window, and windows overlap.
A window that occurs more than once anywhere keeps its first occurrence (the
smallest document id, then text hash, then place) and loses the later ones: the
lines that any later occurrence covers are removed, overlapping occurrences
being merged. Windows are judged on the input, not on what is left.

The whole path is DataFrame functions. Windows are compared by 128 bits of
hashes. A repeated window is counted with a partially aggregated ``min`` of its
place and met again by an equi-join whose hot side Spark can split; nothing
is gathered by window. Only the places to remove are gathered by document.

Cases: null texts stay null with no lines; texts with fewer than three lines
stay; rows with equal or null ids (null before all others) are told apart by
their text; of rows equal in both, one counts as the first, whose windows are
judged as those of any row, and each further one loses every line that a window
covers (they are told apart by their place in the input, which must read the same
twice, as files do); other columns are kept as they are, but for columns named
``n_lines`` and ``n_removed`` (after ``prefix``), which are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import unused

SIZE = 3


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _filled(lines: Column) -> Column:
    """(line, its place) of every line that is not white space alone."""
    numbered = F.transform(lines, lambda x, i: F.struct(x.alias("line"), i.alias("i")))
    return F.filter(numbered, lambda x: x["line"].rlike(r"[^\x20\x09-\x0D]"))


def _windows(filled: Column, size: int) -> Column:
    """(h1, h2) of each window, at the place of its first line among the filled lines."""
    count = F.size(filled) - size + 1

    def one(i):
        lines = [filled[(i + k).cast("int")]["line"] for k in range(size)]
        return F.struct(F.xxhash64(*lines).alias("h1"), F.xxhash64(F.lit("second"), *lines[::-1]).alias("h2"))

    return F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), one))


def later_windows(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """(id, tk, at) of every window of ``docs(id, tk, text)`` that occurs earlier in the corpus."""
    filled = docs.select("id", "tk", F.explode(F.array(_filled(_lines(F.col("text"))))).alias("filled"))
    place = filled.select("id", "tk", F.posexplode(_windows(F.col("filled"), size)).alias("at", "w")).select("id", "tk", "at", "w.h1", "w.h2")
    first = place.groupBy("h1", "h2").agg(F.min(F.struct("id", "tk", "at")).alias("first"), F.count("*").alias("n")).where("n > 1").select("h1", "h2", "first")
    return place.join(first, ["h1", "h2"]).where(~F.struct("id", "tk", "at").eqNullSafe(F.col("first"))).select("id", "tk", "at")


def deduplicate_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, prefix: str = "") -> DataFrame:
    """``docs`` with ``text_col`` less its removed lines, and ``n_lines`` and ``n_removed`` (after ``prefix``) added."""
    docs = docs.drop(f"{prefix}n_lines", f"{prefix}n_removed")
    names, own = docs.columns, unused(docs)
    id_, tk, row, at, copy = (f"{own}{n}" for n in ("id", "tk", "row", "at", "copy"))
    docs = docs.withColumns({tk: F.xxhash64(F.col(text_col)), id_: F.col(id_col), row: F.monotonically_increasing_id()})
    plain = docs.select(F.col(id_).alias("id"), F.col(tk).alias("tk"), F.col(text_col).alias("text"))
    # No more places than lines in the document.
    gone = later_windows(plain, size).groupBy("id", "tk").agg(F.collect_set("at").alias("at"))
    rows = docs.groupBy(F.col(id_).alias("id"), F.col(tk).alias("tk")).agg(F.min(row).alias("first"), F.count("*").alias("n")).where("n > 1")
    both = gone.select("id", "tk", "at", F.lit(None).cast("long").alias("first")).union(rows.select("id", "tk", F.lit(None), "first"))
    known = both.groupBy("id", "tk").agg(F.first("at", True).alias(at), F.first("first", True).alias(copy)).withColumnsRenamed({"id": f"{own}gone_id", "tk": f"{own}gone_tk"})
    joined = docs.join(known, F.col(id_).eqNullSafe(F.col(f"{own}gone_id")) & (F.col(tk) == F.col(f"{own}gone_tk")), "left")
    # inline() keeps each step's arrays from being computed again for every element of the next.
    again = F.coalesce(F.col(row) != F.col(copy), F.lit(False))
    lines = _once(joined, **{f"{own}lines": F.when(F.col(at).isNotNull() | again, _lines(F.col(text_col)))})
    places = _once(lines, **{f"{own}places": F.transform(_filled(F.col(f"{own}lines")), lambda x: x["i"])})
    count = F.size(f"{own}places")
    every = F.when(count >= size, F.sequence(F.lit(0), count - 1))
    some = F.array_distinct(F.flatten(F.transform(F.col(at), lambda a: F.sequence(a, a + size - 1))))
    covered = _once(places, **{f"{own}covered": F.when(again, every).otherwise(some)})
    hit = F.col(f"{own}covered").isNotNull()
    dropped = F.transform(F.col(f"{own}covered"), lambda c: F.col(f"{own}places")[c])
    kept = _once(covered, **{f"{own}kept": F.array_except(F.sequence(F.lit(0), F.size(f"{own}lines") - 1), dropped)})
    text = F.array_join(F.transform(F.col(f"{own}kept"), lambda p: F.col(f"{own}lines")[p]), "\n")
    lines_of = F.length(F.col(text_col)) - F.length(F.replace(F.col(text_col), F.lit("\n"))) + 1
    return kept.select(
        *[F.when(hit, text).otherwise(F.col(n)).alias(n) if n == text_col else F.col(n) for n in names],
        F.coalesce(lines_of, F.lit(0)).cast("long").alias(f"{prefix}n_lines"),
        F.coalesce(F.when(hit, F.size(f"{own}covered")), F.lit(0)).cast("long").alias(f"{prefix}n_removed"),
    )


def _once(df: DataFrame, **columns: Column) -> DataFrame:
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))
