"""Configuration: frozen dataclasses, read from JSON, merged recursively."""

from __future__ import annotations

import dataclasses
import json
from dataclasses import dataclass, field
from typing import Any

#: English stopwords (articles, pronouns, prepositions, auxiliaries and contraction stems).
STOPWORDS = tuple("""
a about above after again against all am an and any are as at be because been before being below between both but by
can could did do does doing down during each few for from further had has have having he her here hers herself him
himself his how i if in into is it its itself just me more most my myself no nor not now of off on once only or other
our ours ourselves out over own same she should so some such than that the their theirs them themselves then there
these they this those through to too under until up very was we were what when where which while who whom why will
with you your yours yourself yourselves
""".split())


@dataclass(frozen=True)
class AnalyzerConfig:
    """How text becomes terms. ``profile`` is letters, whitespace or treebank."""

    profile: str = "letters"
    merge_phrases: bool = False
    phrases: tuple[str, ...] = ()
    remove_punctuation: bool = True
    remove_numbers: bool = True
    remove_stopwords: bool = True
    remove_short_words: bool = True
    min_word_length: int = 2
    stopwords: tuple[str, ...] = STOPWORDS
    lemmatize: bool = True
    stem: bool = False


@dataclass(frozen=True)
class SkipConfig:
    """Skip pointers: how far apart, and from what list length on."""

    enabled: bool = True
    strategy: str = "sqrt"
    step: int | None = None
    min_list_length: int = 3
    linear_factor: int = 10
    marker_binary: int = 0xFFFFFFFF
    marker_vb: int = 0xFD


@dataclass(frozen=True)
class IndexConfig:
    """Physical widths of the binary formats."""

    term_bytes: int = 20
    k_interval: int = 4
    doc_id_bits: int = 28
    skip: SkipConfig = field(default_factory=SkipConfig)


@dataclass(frozen=True)
class RetrievalConfig:
    tfidf_method: str = "standard"
    top_k: int = 10
    min_similarity: float = 0.0


@dataclass(frozen=True)
class Config:
    analyzer: AnalyzerConfig = field(default_factory=AnalyzerConfig)
    index: IndexConfig = field(default_factory=IndexConfig)
    retrieval: RetrievalConfig = field(default_factory=RetrievalConfig)


def update(config: Any, changes: dict[str, Any]) -> Any:
    """A copy with ``changes`` merged in, level by level; unknown names are an error."""
    known = {f.name for f in dataclasses.fields(config)}
    if unknown := set(changes) - known:
        raise KeyError(f"unknown settings: {', '.join(sorted(unknown))}")
    new = {}
    for name, value in changes.items():
        old = getattr(config, name)
        if dataclasses.is_dataclass(old) and isinstance(value, dict):
            new[name] = update(old, value)
        else:
            new[name] = tuple(value) if isinstance(old, tuple) else value
    return dataclasses.replace(config, **new)


def load(path: str | None) -> Config:
    """The defaults with the JSON file at ``path`` merged in."""
    if path is None:
        return Config()
    with open(path, encoding="utf-8") as file:
        return update(Config(), json.load(file))


def as_dict(config: Any) -> dict[str, Any]:
    return dataclasses.asdict(config)
