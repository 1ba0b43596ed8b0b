"""Text functions over columns: markup cleaning, tokenising, token rules, normalising."""

from __future__ import annotations

import html
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import AnalyzerConfig

# ------------------------------------------------------------------- markup

#: White space as the token rules count it, for engines whose \s is ASCII only.
SPACE = r"[\s\x{00A0}\x{2028}\x{2029}]"


def _each(f, values: pd.Series) -> pd.Series:
    """f of every value; null for null, also where all are."""
    return pd.Series([None if x is None or x is pd.NA or x != x else f(x) for x in values], dtype=object)


def _unescaped(text: pd.Series) -> pd.Series:
    return _each(html.unescape, text)


def html_unescape(text) -> Column:
    """Character references to characters; Spark has no such function."""
    return F.pandas_udf(_unescaped, "string")(text)


def clean_markup(text: Column, flags: str = "") -> Column:
    """Line breaks for br and p tags, no other tags, no runs of blank lines, no white space around.

    White space is ASCII, or Unicode's with the flags ``(?U)``.
    """
    text = F.regexp_replace(text, flags + r"<br\s*/?>|</?p>", "\n")
    text = F.regexp_replace(text, r"<[^>]+>", "")
    text = F.regexp_replace(text, flags + r"\n\s*\n\s*\n+", "\n\n")
    return F.regexp_replace(text, flags + r"^\s+|\s+\z", "")


# --------------------------------------------------------------- tokenising


def _treebank(text: str) -> list[str]:
    """An approximation of Treebank splitting: punctuation and clitics come off, hyphens and inner dots stay."""
    text = re.sub(r"([?!;:,\"()\[\]{}<>&%$#*|~`]|--+|\.\.\.)", r" \1 ", text)
    text = re.sub(r"(?<!\.)\.(\s|$)", r" . \1", text)
    text = re.sub(r"(?i)(n't)\b", r" \1", text)
    text = re.sub(r"(?i)('s|'m|'d|'re|'ve|'ll)\b", r" \1", text)
    return text.split()


def _treebanked(text: pd.Series) -> pd.Series:
    return _each(_treebank, text)


def treebank_tokens(text) -> Column:
    return F.pandas_udf(_treebanked, "array<string>")(text)


def tokens(text: Column, profile: str = "letters") -> Column:
    """Array of raw tokens of lower-cased text."""
    text = F.lower(text)
    if profile == "letters":
        return F.regexp_extract_all(text, F.lit(r"\p{L}+"), F.lit(0))
    if profile == "whitespace":
        return F.filter(F.split(text, r"[ \t\r\n\f]+"), lambda x: x != "")
    if profile == "treebank":
        return treebank_tokens(text)
    raise ValueError(f"unknown profile: {profile}")


def order_phrases(phrases) -> list[str]:
    """More words first, then by text (T5)."""
    return sorted({p.lower() for p in phrases}, key=lambda p: (-len(p.split()), p))


def merge_phrases(text: Column, phrases, shared: bool = True) -> Column:
    """Joins the words of each phrase by underscores, one phrase after the other in lexicon order.

    A fold over the lexicon inside one expression, whatever its size; a phrase's pattern is only tried where its text occurs.
    Two neighbours of one phrase may share the sign between them (``of the of the``); without ``shared`` the sign belongs to
    the first, and the second stays as it is.
    """
    quoted = lambda p: p.replace(" ", "_").replace("\\", "\\\\").replace("$", "\\$")
    outside = r"[^\p{L}\p{N}_]"
    pattern = (lambda p: rf"(?U)\b{re.escape(p)}\b") if shared else (lambda p: rf"(\A|{outside}){re.escape(p)}({outside}|\z)")
    to = quoted if shared else (lambda p: f"$1{quoted(p)}$2")
    steps = [F.struct(F.lit(p).alias("text"), F.lit(pattern(p)).alias("pattern"), F.lit(to(p)).alias("to")) for p in order_phrases(phrases)]
    if not steps:
        return F.lower(text)
    return F.aggregate(F.array(*steps), F.lower(text), lambda done, p: F.when(F.contains(done, p["text"]), F.regexp_replace(done, p["pattern"], p["to"])).otherwise(done))


# -------------------------------------------------------------- token rules

#: The marks of URLs and other special tokens.
SPECIAL = ("http", "www.", ".com", ".org", ".net", ".html", ".php", "@", "//")


def is_only_underscores(t: Column) -> Column:
    """Nothing, or no ASCII letter or digit, beside underscores, blanks, apostrophes and hyphens."""
    return ~t.rlike("[a-zA-Z0-9]")


def is_special(t: Column) -> Column:
    """Holds a mark of a URL."""
    return t.rlike("(?i)" + "|".join(s.replace(".", r"\.") for s in SPECIAL))


def is_punctuation(t: Column) -> Column:
    """Holds a sign that is no letter, digit, underscore or blank, and no underscore."""
    return ~t.contains("_") & t.rlike(r"[^\p{L}\p{N}_\s]")


def is_number(t: Column) -> Column:
    """Holds a decimal digit of any script."""
    return t.rlike(r"\p{Nd}")


def is_stopword(t: Column, words) -> Column:
    """A stopword, unless the token has an underscore (P5)."""
    return ~t.contains("_") & F.lower(t).isin(*words) if words else F.lit(False)


REASONS = ("underscores_only", "special", "punctuation", "number", "stopword", "short")


def removal_reason(t: Column, config: AnalyzerConfig, letters: bool = False) -> Column:
    """Why a token goes: the first rule that holds, or null.

    ``letters`` says that tokens are runs of lower-case letters: they hold no sign or
    digit, and of the special marks only one, so fewer rules need to look.
    """
    reason = F.when(is_only_underscores(t), "underscores_only").when(t.contains("http") if letters else is_special(t), "special")
    if config.remove_punctuation and not letters:
        reason = reason.when(is_punctuation(t), "punctuation")
    if config.remove_numbers and not letters:
        reason = reason.when(is_number(t), "number")
    if config.remove_stopwords and config.stopwords:
        reason = reason.when(is_stopword(t, config.stopwords), "stopword")
    if config.remove_short_words:
        reason = reason.when(F.length(t) < config.min_word_length, "short")
    return reason


def strip_prefix(t: Column) -> Column:
    """Without apostrophes and hyphens in front."""
    return F.regexp_replace(t, r"^['-]+", "")


def wordnet_pos(tag: Column) -> Column:
    """Coarse part of speech of a Treebank tag; noun by default."""
    return F.when(tag.startswith("J"), "a").when(tag.startswith("V"), "v").when(tag.startswith("R"), "r").otherwise("n")


# ----------------------------------------------------------------- stemming

_V = "aeiou"


def _consonant(word: str, i: int) -> bool:
    c = word[i]
    return c not in _V and not (c == "y" and i > 0 and _consonant(word, i - 1))


def _measure(stem: str) -> int:
    """How often a consonant follows a vowel."""
    kinds = [_consonant(stem, i) for i in range(len(stem))]
    return sum(1 for a, b in zip(kinds, kinds[1:]) if not a and b)


def _vowel(stem: str) -> bool:
    return any(not _consonant(stem, i) for i in range(len(stem)))


def _double(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _consonant(word, len(word) - 1)


def _cvc(word: str) -> bool:
    n = len(word)
    return n > 2 and _consonant(word, n - 3) and not _consonant(word, n - 2) and _consonant(word, n - 1) and word[-1] not in "wxy"


#: Fixed values of the published Porter algorithm: suffix, replacement.
STEP_2 = (("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"))
STEP_3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def porter(word: str) -> str:
    """The stem of a lower-case word by Porter's algorithm (1980)."""
    if len(word) < 3:
        return word
    for suffix, to in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if word.endswith(suffix):
            word = word[: len(word) - len(suffix)] + to
            break
    if word.endswith("eed"):
        if _measure(word[:-3]) > 0:
            word = word[:-1]
    else:
        cut = next((s for s in ("ed", "ing") if word.endswith(s) and _vowel(word[: -len(s)])), None)
        if cut:
            word = word[: -len(cut)]
            if word.endswith(("at", "bl", "iz")):
                word += "e"
            elif _double(word) and word[-1] not in "lsz":
                word = word[:-1]
            elif _measure(word) == 1 and _cvc(word):
                word += "e"
    if word.endswith("y") and _vowel(word[:-1]):
        word = word[:-1] + "i"
    for rules in (STEP_2, STEP_3):
        for suffix, to in sorted(rules, key=lambda r: -len(r[0])):
            if word.endswith(suffix):
                if _measure(word[: -len(suffix)]) > 0:
                    word = word[: -len(suffix)] + to
                break
    for suffix in sorted(STEP_4, key=len, reverse=True):
        if word.endswith(suffix):
            stem = word[: -len(suffix)]
            if _measure(stem) > 1 and (suffix != "ion" or stem[-1:] in ("s", "t")):
                word = stem
            break
    if word.endswith("e"):
        stem = word[:-1]
        if _measure(stem) > 1 or _measure(stem) == 1 and not _cvc(stem):
            word = stem
    if word.endswith("ll") and _measure(word[:-1]) > 1:
        word = word[:-1]
    return word


def _stemmed(word: pd.Series) -> pd.Series:
    return _each({w: porter(w) for w in word.dropna().unique()}.get, word)


def stem(word) -> Column:
    return F.pandas_udf(_stemmed, "string")(word)


# ------------------------------------------------------------- ids, display


def doc_number(doc_id: Column, bits: int | None = 28) -> Column:
    """A document id as a number: without ``event_`` in front, else a 31-bit hash of it; masked to ``bits``."""
    text = F.regexp_replace(doc_id.cast("string"), "^event_", "")
    number = F.coalesce(text.try_cast("bigint"), F.xxhash64(text).bitwiseAND(0x7FFFFFFF))
    return number.bitwiseAND((1 << bits) - 1) if bits else number


def file_slug(text: Column) -> Column:
    """First 20 characters: letters, digits, blank, hyphen and underscore, blanks as underscores."""
    return F.replace(F.trim(F.regexp_replace(F.substring(text, 1, 20), r"[^\p{L}\p{N} _-]", "")), F.lit(" "), F.lit("_"))


def shown_size(n: Column) -> Column:
    """Bytes as B, KB or MB with two decimals, halves to even."""
    shown = lambda unit, name: F.format_string(f"%.2f {name}", F.bround(n / unit, 2))
    return F.when(n < 1024, F.format_string("%d B", n)).when(n < 1 << 20, shown(1024, "KB")).otherwise(shown(1 << 20, "MB"))


def shown_term(t: Column, width: int = 28) -> Column:
    """Terms wider than ``width`` cut, with dots."""
    return F.when(F.length(t) > width, F.concat(F.substring(t, 1, width - 3), F.lit("..."))).otherwise(t)
