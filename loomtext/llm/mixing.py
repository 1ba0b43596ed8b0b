"""Mixing sources to target weights by Sainte-Lague apportionment.

Sources get shares of a token budget by weight; no source is given more than
``repeat`` times its own words, and what it can't take is shared again by weight
(water filling). The budget is dealt in blocks of ``block`` words: the highest
quotients target / (2k + 1) win a block each, first among sources, then among
the shards of each source by their words. A shard lays its documents in a
seeded order, cuts the row of words into blocks and takes its quota: each block
as often as the quota holds all of them, and of the rest an evenly spaced
selection from a seeded offset. A document's ``taken`` is the number of its
words in taken blocks, repeats counted. Everything past the word count runs on
(id, source, size) rows, and is deterministic.

Cases: null texts have size 0 and take nothing; a null source is a source of
its own, after all others; sources without words get target 0; repeated rows
are taken each by itself, in a defined order up to their equality (``row_col``
names a column that tells them apart, where the caller needs to know which is
which); null ids order as empty text; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, checkpointed

#: Words of a block.
BLOCK = 32
#: Documents of a shard, about.
SHARD_DOCS = 1024
#: Parts in which the documents of a source meet what is known of it.
SALTS = 64


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _seeded(salt: str, column: Column, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:{salt}:"), F.coalesce(column.cast("string"), F.lit(""))))


def _number(digest: Column) -> Column:
    """The first 32 bits of a hex digest."""
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def water_fill(sources: DataFrame, weights: tuple[int, ...], share: float, repeat: int) -> DataFrame:
    """Adds ``target`` to ``sources(key, source_size)``; one row per source, so the windows are as small as that list."""
    ranked = sources.withColumn("rank", F.row_number().over(Window.orderBy("key")))
    ranked = ranked.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int")).cast("long"))
    ranked = ranked.withColumn("cap", F.col("source_size") * repeat)
    order = Window.orderBy(F.col("cap") / F.col("w"), "rank")
    above = order.rowsBetween(Window.unboundedPreceding, -1)
    below = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    level = (F.sum("source_size").over(everything) * share - F.coalesce(F.sum("cap").over(above), F.lit(0))) / F.sum("w").over(below)
    ranked = ranked.withColumn("level", level)
    # The first source, by cap over weight, whose cap is not passed sets the level for itself and all after it.
    ranked = ranked.withColumn("level", F.min(F.when(F.col("level") <= F.col("cap") / F.col("w"), F.struct(F.col("cap") / F.col("w"), "rank", "level"))).over(everything)["level"])
    return ranked.withColumn("target", F.when(F.col("level").isNull(), F.col("cap").cast("double")).otherwise(F.least(F.col("cap").cast("double"), F.col("level") * F.col("w"))))


def sainte_lague(rows: DataFrame, group: list[str], by: str, key: str, seats: str) -> DataFrame:
    """Deals ``seats`` (one number for each group) among the rows of a group by highest quotients ``by`` / (2k + 1).

    Adds ``quota``. A divisor that gives no seat too many deals almost all of
    them at once; only the last 1.5 seats a row or so are ranked by quotient.
    """
    whole = Window.partitionBy(*group)
    rows = rows.withColumns({"__w": F.sum(by).over(whole).cast("double"), "__n": F.count("*").over(whole)})
    some = (F.col("__w") > 0) & (F.col(seats) > F.col("__n"))
    rows = rows.withColumn("__low", F.when(some, F.floor(F.col(by) * (F.col(seats) - F.col("__n")) / F.col("__w") + 0.5)).otherwise(0).cast("long"))
    rows = rows.withColumn("__rest", F.col(seats) - F.sum("__low").over(whole))
    more = F.least(F.col("__rest"), F.ceil(F.col(by) / F.col("__w") * F.col("__n") * 1.5) + 1)
    tried = rows.where((F.col(by) > 0) & (F.col("__rest") > 0)).select(*group, key, "__rest", F.col(by).alias("__by"), F.explode(F.sequence(F.col("__low"), F.col("__low") + more - 1)).alias("__k"))
    ranked = tried.withColumn("__r", F.row_number().over(whole.orderBy((F.col("__by") / (F.col("__k") * 2 + 1)).desc(), key, "__k")))
    won = ranked.where("__r <= __rest").groupBy(*group, key).agg(F.count("*").alias("__won"))
    out = rows.join(won, [*group, key] if key not in group else group, "left")
    return out.withColumn("quota", F.col("__low") + F.coalesce("__won", F.lit(0))).drop("__w", "__n", "__low", "__rest", "__won")


def mix_sources(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, repeat: int = 2, block: int = BLOCK, seed: int = 9,
    shard_docs: int = SHARD_DOCS, row_col: str | None = None,
) -> DataFrame:
    """(id, tk, size, source_size, target, taken) with one row per row of ``docs``; ``tk`` is the text's hash. With ``row_col`` also ``row``, its value."""
    extra = ["row"] if row_col else []
    key = F.coalesce(F.concat(F.lit("a"), F.col(source_col).cast("string")), F.lit("b"))
    text = F.col(text_col)
    sized = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("tk"), key.alias("key"), words(text).alias("size"), *[F.col(row_col).alias(r) for r in extra])
    # Cut here: counting words reads all text, and the rest needs only these small rows.
    sized = checkpointed(sized)
    sources = sized.groupBy("key").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    sources = water_fill(sources, weights, share, repeat).withColumn("one", F.lit(1))
    sources = sources.withColumn("seats", F.floor(F.sum("target").over(Window.partitionBy()) / block + 0.5).cast("long"))
    sources = sainte_lague(sources, ["one"], "target", "key", "seats")
    sources = checkpointed(sources.select("key", "source_size", "target", F.col("quota").alias("source_quota"), F.ceil(F.col("docs") / shard_docs).cast("long").alias("shards")))
    # A source may hold most rows: each source is laid out SALTS times, and its documents meet one of the copies.
    copies = sources.select("key", "shards", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))
    dealt = sized.withColumn("seed", _seeded("doc", F.col("id"), seed)).withColumn("salt", F.pmod(F.xxhash64("seed"), F.lit(SALTS)))
    dealt = dealt.join(copies, ["key", "salt"]).withColumn("shard", F.pmod(_number("seed"), F.col("shards"))).drop("shards", "salt")
    shards = dealt.groupBy("key", "shard").agg(F.sum("size").alias("words")).join(sources.select("key", "source_size", "target", "source_quota"), "key")
    shards = sainte_lague(shards, ["key"], "words", "shard", "source_quota")
    blocks = F.greatest(F.ceil(F.col("words") / block), F.lit(1)).cast("long")
    shards = shards.withColumn("blocks", blocks).select(
        "key", "shard", "blocks", "source_size", "target",
        F.least(F.expr("quota div blocks"), F.lit(repeat)).cast("long").alias("times"),
        F.when(F.expr("quota div blocks") >= repeat, 0).otherwise(F.expr("quota % blocks")).cast("long").alias("extra"),
        F.pmod(_number(_seeded("block", F.concat_ws(":", "key", "shard"), seed)), F.col("blocks")).alias("offset"),
    )
    row = Window.partitionBy("key", "shard").orderBy("seed", "tk", "id", *extra).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    laid = dealt.withColumn("to", F.sum("size").over(row)).join(shards, ["key", "shard"])

    def before(x: Column) -> Column:
        """Words of extra blocks among the first x words of the shard: block j is taken where (j + offset) * extra / blocks steps up."""
        j = F.floor(x / block).cast("long")
        steps = lambda i: F.floor((i + F.col("offset")) * F.col("extra") / F.col("blocks")).cast("long")
        return (steps(j) - steps(F.lit(0).cast("long"))) * block + (steps(j + 1) - steps(j)) * (x - j * block)

    taken = F.col("times") * F.col("size") + before(F.col("to")) - before(F.col("to") - F.col("size"))
    return laid.select("id", "tk", "size", "source_size", "target", taken.cast("long").alias("taken"), *extra)
