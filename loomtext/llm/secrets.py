"""Secret scans: fixed forms plus character Markov models, in DataFrame functions only.

Base forms are found with regular expressions. Beyond them, runs of token
characters are candidates: two first-order Markov models over character classes,
one of random strings and one of ordinary identifiers, give each candidate a
log-likelihood ratio per character, and those above ``threshold`` are reported
as kind ``random``. The models are add-one smoothed transition counts of
labelled samples, counted by Spark; the samples are made by rule from a seed, or
given. Scoring looks transitions up in a map literal of at most (classes + 1)
squared entries.

Spans are code points, end exclusive. Within a kind they are the leftmost
non-overlapping matches; a random span that meets a base span is dropped.

Cases: null and empty texts have no spans; repeated rows are scanned each by
itself; all rows and other columns stay, columns of the added names are replaced.
"""

from __future__ import annotations

import base64
import hashlib
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Kind, pattern, least length of the group that counts, and that group.
BASE = (
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8, 2),
    ("access", r"AKIA[A-Z0-9]+", 16, 0),
    ("hex", r"[0-9a-f]+", 32, 0),
)
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
#: Bits of log-likelihood ratio per character from which a candidate is a secret.
THRESHOLD = 0.5


def strict(pattern: str, least: int, group: int) -> str:
    """The pattern with its last run at the least length: found wherever a match long enough is."""
    literal = 4 if pattern.startswith("AKIA") else 0
    return pattern[:-2] + f"{{{least - literal},}})" if group else pattern[:-1] + f"{{{least - literal},}}"


def find(text: Column, pattern: str, might: str, group: int = 0, least: int = 0) -> Column:
    """Array of (start, end, found) for the leftmost non-overlapping matches whose group has ``least`` characters.

    Each match is extracted together with the text since the one before, so that
    places are running sums of lengths. Texts without ``might`` are passed over.
    """
    # \G: after the last match there is one attempt, not one from every place.
    lazy = F.lit(rf"(?s)\G(.*?)({pattern})")
    hit = text.rlike(might)
    part = lambda n: F.when(hit, F.regexp_extract_all(text, lazy, F.lit(n)))
    parts = F.arrays_zip(part(0).alias("a"), part(2).alias("b"), part(2 + group).alias("c"))
    kind = "array<struct<start:bigint,end:bigint,found:string,size:bigint>>"
    begin = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(kind).alias("spans"))

    def step(done, p):
        end = done["at"] + F.length(p["a"])
        span = F.struct((end - F.length(p["b"])).alias("start"), end.alias("end"), p["b"].alias("found"), F.length(p["c"]).cast("long").alias("size"))
        return F.struct(end.alias("at"), F.when(F.length(p["c"]) >= least, F.concat(done["spans"], F.array(span))).otherwise(done["spans"]).alias("spans"))

    return F.coalesce(F.aggregate(parts, begin, step)["spans"], F.array().cast(kind))


# ------------------------------------------------------------- Markov models

ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
#: Ordinary words that identifiers are made of.
PARTS = """get set is has to from with user name value list item count index file path line text data time date size type key
node tree map set array string number total average min max first last next previous start end begin finish open close
read write load save update delete create remove insert select order group filter join query table column row page
request response handler service client server config option default parent child element document window button
label message error warning status result output input buffer stream channel event action state model view controller
test case example source target version build release module package import export function method class object
property attribute parameter argument variable constant static public private protected internal external""".split()


def labelled_strings(n: int = 400, seed: int = 2) -> tuple[list[str], list[str]]:
    """(random strings, ordinary identifiers), made by rule from a seed."""
    noise = [hashlib.sha512(f"{seed}:{i}".encode()).digest() for i in range(n)]
    random = [base64.b64encode(x)[:44].decode() for x in noise] + [base64.urlsafe_b64encode(x)[:40].decode() for x in noise] + [x.hex()[:40] for x in noise[: n // 2]] + [base64.b32encode(x)[:32].decode() for x in noise[: n // 2]]
    words = [[PARTS[b % len(PARTS)] for b in x[:4]] for x in noise]
    ordinary = ["_".join(w) for w in words] + ["-".join(w) for w in words] + ["/".join(w) for w in words] + ["".join(w) for w in words]
    ordinary += [w[0] + "".join(p.title() for p in w[1:]) for w in words] + ["_".join(w).upper() for w in words] + [f"{w[0]}{x[5] % 100}_{w[1]}_20{x[6] % 30:02d}" for w, x in zip(words, noise, strict=True)]
    ordinary += [c * 60 for c in "-=_/+" for _ in range(20)] + ["0123456789" * 4] * 20
    return random, ordinary


def train(spark: SparkSession, ordinary_words: DataFrame | None = None, weight: float = 1.0) -> list[float]:
    """Bits that the transition from ALPHABET[i] to ALPHABET[j] speaks for a random string, at i * size + j.

    ``ordinary_words(word, n)`` adds ordinary strings that occur n times, each occurrence counted as ``weight``.
    """
    random, ordinary = labelled_strings()
    given = spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.lit("\n".join(v)).alias("all")) for k, v in (("r", random), ("o", ordinary))])).alias("x"))
    strings = given.select("x.kind", F.explode(F.split("x.all", "\n")).alias("s"), F.lit(1).cast("long").alias("n"))
    if ordinary_words is not None:
        strings = strings.union(ordinary_words.select(F.lit("w"), "word", "n"))
    pairs = strings.where(F.length("s") > 1).select("kind", "n", F.explode(F.transform(F.sequence(F.lit(1), F.length("s") - 1), lambda i: F.substring("s", i, 2))).alias("pair"))
    counts = {(r["kind"], r["pair"]): r["n"] for r in pairs.groupBy("kind", "pair").agg(F.sum("n").alias("n")).collect() if all(c in ALPHABET for c in r["pair"])}
    # Whole counts meet their weight here, so that sums don't hang on their order.
    for (kind, pair), n in list(counts.items()):
        if kind == "w":
            counts["o", pair] = counts.get(("o", pair), 0) + weight * n
    size = len(ALPHABET)
    out = []
    for a in ALPHABET:
        total = {k: sum(counts.get((k, a + b), 0) for b in ALPHABET) + size for k in "ro"}
        out += [math.log2((counts.get(("r", a + b), 0) + 1) / total["r"]) - math.log2((counts.get(("o", a + b), 0) + 1) / total["o"]) for b in ALPHABET]
    return out


def ratio(string: Column, table: list[float]) -> Column:
    """Mean log-likelihood ratio, in bits a transition; for strings over ALPHABET of two characters or more."""
    size = len(ALPHABET)
    chars = F.split(string, "")
    at = lambda c: F.call_function("locate", c, F.lit(ALPHABET)) - 1
    n = F.length(string)
    bits = F.lit([round(x, 4) for x in table])
    each = F.zip_with(F.slice(chars, 1, n - 1), F.slice(chars, 2, n - 1), lambda a, b: F.element_at(bits, (at(a) * size + at(b) + 1).cast("int")))
    return F.aggregate(each, F.lit(0.0), lambda x, y: x + y) / (n - 1)


def scan(docs: DataFrame, text_col: str = "text", table: list[float] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with ``secrets`` added: spans (start, kind_order, end, kind) by start and kind, base kinds first."""
    if table is None:
        table = train(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    kinds = [k for k, *_ in BASE] + ["random"]
    found = {}
    for kind, pattern, least, group in BASE:
        might = strict(pattern, least, group)
        found[kind] = find(text, pattern if group else might, might, group, least)
    found["random"] = find(text, CANDIDATE, CANDIDATE)
    spans = docs.select("*", F.inline(F.array(F.struct(*[c.alias(f"__{k}") for k, c in found.items()]))))

    def tagged(column: str, order: int):
        return F.transform(F.col(column), lambda x: F.struct(x["start"].alias("start"), F.lit(order).alias("kind_order"), x["end"].alias("end"), F.lit(kinds[order]).alias("kind")))

    base = F.concat(*[tagged(f"__{k}", i) for i, k in enumerate(kinds[:-1])])
    likely = F.filter(F.col("__random"), lambda x: ratio(x["found"], table) > threshold)
    spans = spans.select("*", F.inline(F.array(F.struct(base.alias("__base"), likely.alias("__likely")))))
    apart = F.filter(F.col("__likely"), lambda x: ~F.exists(F.col("__base"), lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])))
    spans = spans.select("*", apart.alias("__apart"))
    more = tagged("__apart", len(BASE))
    kept = [c for c in docs.columns if c != "secrets"]
    return spans.select(*kept, F.array_sort(F.concat("__base", more)).alias("secrets"))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
