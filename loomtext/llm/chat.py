"""Chat formatting with typed content parts.

A message holds plain text or a JSON list of parts such as
``{"type": "text", "text": ...}`` or ``{"type": "image", "url": ..., "tokens": 256}``.
A visitor walks the parts in order: text is escaped, every image, audio or
document part becomes a placeholder, and an attachment record keeps its
reference, kind, place and expanded token count. Turns are marked by

    <|im_start|>role\\n ... <|im_end|>\\n

Escaping is reversible: between ``<`` and ``|`` one backslash is put in front of
those that stand there, so no text can hold a control string. Roles also have
backslashes and line feeds escaped. The loss mask is a list of code point spans
over the formatted text that cover what assistants say, and nothing else.

Cases: a null text is empty, a null role is the empty role; turns are ordered by
turn (nulls first), then role, then text, so repeated rows stay and tie nowhere;
rows with a null conversation id form one conversation; a text that isn't a JSON
list of well-formed parts is plain text as a whole (a part is an object with a
text ``type``; its ``text`` and ``url`` are text or null, its ``tokens`` an
integer from 0 to 2**63 - 1 or null, and no text has a lone surrogate); a part's
own token count goes before the kind's, but counts beyond 2**63 - 1 in all make
the conversation's sum stop there; unknown kinds of parts become ``<|file|>``; an
empty list of parts is plain text; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, session_of

START, END = "<|im_start|>", "<|im_end|>"
PLACEHOLDERS = {"image": "<|image|>", "audio": "<|audio|>", "document": "<|document|>"}
#: Tokens that a placeholder expands to where its part doesn't say.
TOKENS = {"image": 256, "audio": 128, "document": 512, "file": 64}


def escape(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\1\\|", text)


def unescape(text: str) -> str:
    return re.sub(r"<(\\*)\\\|", r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


@dataclass
class Visitor:
    """Flattens the parts of one conversation into text, with a loss mask and attachments."""

    out: list[str] = field(default_factory=list)
    size: int = 0
    loss: list[tuple[int, int]] = field(default_factory=list)
    attachments: list[dict] = field(default_factory=list)

    def put(self, text: str) -> None:
        self.out.append(text)
        self.size += len(text)

    def visit(self, part: dict) -> None:
        (self.visit_text if part["type"] == "text" else self.visit_file)(part)

    def visit_text(self, part: dict) -> None:
        self.put(escape(part.get("text") or ""))

    def visit_file(self, part: dict) -> None:
        kind = part["type"] if part["type"] in PLACEHOLDERS else "file"
        tokens = part.get("tokens")
        self.attachments.append({"kind": kind, "reference": part.get("url") or str(part.get("id") or ""), "at": self.size, "tokens": TOKENS[kind] if tokens is None else tokens})
        self.put(PLACEHOLDERS.get(kind, "<|file|>"))

    def turn(self, role: str, parts: list[dict]) -> None:
        self.put(f"{START}{escape_role(role)}\n")
        begin = self.size
        for part in parts:
            self.visit(part)
        if role == "assistant" and self.size > begin:
            self.loss.append((begin, self.size))
        self.put(f"{END}\n")

    def text(self) -> str:
        return "".join(self.out)


#: The largest token count, which is the largest long.
MOST = (1 << 63) - 1


def _plain(value) -> bool:
    """A text without lone surrogates, or null."""
    return value is None or isinstance(value, str) and not any("\ud800" <= c <= "\udfff" for c in value)


def _well_formed(part) -> bool:
    if not isinstance(part, dict) or not isinstance(part.get("type"), str):
        return False
    tokens, key = part.get("tokens"), part.get("id")
    counted = tokens is None or isinstance(tokens, int) and not isinstance(tokens, bool) and 0 <= tokens <= MOST
    named = _plain(key) or isinstance(key, int) and abs(key) <= MOST
    return counted and named and all(_plain(part.get(name)) for name in ("type", "text", "url"))


def parts_of(content: str | None, typed: bool = True) -> list[dict]:
    """The parts of a message: those of a JSON list of well-formed typed parts, else one text part."""
    if typed and content and content.lstrip()[:1] == "[":
        try:
            parts = json.loads(content)
        except (ValueError, RecursionError):
            parts = None
        if isinstance(parts, list) and parts and all(map(_well_formed, parts)):
            return parts
    return [{"type": "text", "text": content or ""}]


def format_turns(turns: list[tuple[str | None, str | None]], typed: bool = True) -> Visitor:
    visitor = Visitor()
    for role, content in turns:
        visitor.turn(role or "", parts_of(content, typed))
    return visitor


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of every turn of a formatted conversation, unescaped; placeholders stay."""
    return [(unescape_role(m[1]), unescape(m[2])) for m in re.finditer(r"<\|im_start\|>(.*?)\n(.*?)<\|im_end\|>\n", formatted, re.S)]


SCHEMA = "conv_id long, n_turns long, formatted string, loss array<struct<start:long,end:long>>, attachments array<struct<kind:string,reference:string,at:long,tokens:long>>, expanded_tokens long"


def format_conversations(turns: DataFrame, typed: bool = True) -> DataFrame:
    """One row per conversation of ``turns(conv_id, turn, role, text)``; see SCHEMA. ``typed`` reads JSON lists as parts.

    A conversation's turns meet in one row, as its formatted text must.
    """

    def run(batches):
        for batch in batches:
            rows = {n: [] for n in names}
            for conv, all_turns in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                visitor = format_turns([(t["role"], t["text"]) for t in all_turns], typed)
                loss = [{"start": a, "end": b} for a, b in visitor.loss]
                for name, value in zip(names, (conv, len(all_turns), visitor.text(), loss, visitor.attachments, min(MOST, sum(a["tokens"] for a in visitor.attachments))), strict=True):
                    rows[name].append(value)
            yield pa.RecordBatch.from_pydict(rows, schema=schema)

    long, string = pa.int64(), pa.string()
    spans = pa.list_(pa.struct([("start", long), ("end", long)]))
    files = pa.list_(pa.struct([("kind", string), ("reference", string), ("at", long), ("tokens", long)]))
    schema = pa.schema([("conv_id", long), ("n_turns", long), ("formatted", string), ("loss", spans), ("attachments", files), ("expanded_tokens", long)])
    names = schema.names
    bounded_batches(session_of(turns), 500)
    grouped = turns.groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    return grouped.mapInArrow(run, SCHEMA)


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of each conversation, from its formatted text and loss mask alone."""

    def run(batches):
        for batch in batches:
            out = {n: [] for n in ("n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")}
            for text, loss in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                turns = read_turns(text)
                said = "".join(unescape(text[s["start"] : s["end"]]) for s in loss)
                digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
                for name, value in zip(out, (len(turns), digest("".join(f"{r}\n{t}\n" for r, t in turns)), len(said), digest(said), len(text)), strict=True):
                    out[name].append(value)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, out.values())], names=["conv_id", *out])

    return formatted.select("conv_id", "formatted", "loss").mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
