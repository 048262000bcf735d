"""Chat formatting with typed content parts.

A message is a list of parts: text, image, audio or document. A visitor walks
the parts of each turn in order and flattens them to one string: text is
escaped, any other part becomes a numbered placeholder, and its reference and
the number of tokens it will expand to are recorded beside the string.

The template marks a turn by a header line, ``### Role:``, and an end mark,
`` </turn>``. Three characters start control strings: a backslash, ``<`` and
``#``. Inside texts and references each of them gets a backslash in front, so no
text can forge a header, an end mark or a placeholder, and taking those backslashes
away gives every text back as it was. Roles are escaped too, with ``:`` and
line feeds as well.

The loss mask covers the text of assistant turns, as code point ranges of the
formatted string, between header and end mark. ``read_back`` parses a formatted
string into turns and, with the mask, into the text under the loss.

Defined cases: null texts are empty, null roles read back as empty; turns are
ordered by turn (nulls first), then role and text, so ties and repeated rows
keep one order; each row is a turn of its own; all rows with a null conversation
id are one conversation. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HEAD, END = "### ", " </turn>\n"
_ESCAPED = re.compile(r"[\\<#]")
_ESCAPED_ROLE = re.compile(r"[\\<#:\n]")
_BACK = re.compile(r"\\(.)", re.DOTALL)
_PLACE = re.compile(r"<(image|audio|document):(\d+)>")
#: How many tokens one attachment expands to, by kind, where the part itself names none.
EXPANDED = {"image": 256, "audio": 128, "document": 512}


def escape(text: str) -> str:
    return _ESCAPED.sub(r"\\\g<0>", text)


def unescape(text: str) -> str:
    return _BACK.sub(r"\1", text)


@dataclass(frozen=True)
class Part:
    """One content part. Text parts have ``text``; others a reference and, if known, a token count."""

    kind: str
    text: str = ""
    reference: str = ""
    tokens: int | None = None


@dataclass
class Formatted:
    text: str = ""
    loss: list[tuple[int, int]] = field(default_factory=list)
    #: kind, reference, expanded tokens; in the order of their placeholders.
    attachments: list[tuple[str, str, int]] = field(default_factory=list)


class Flattener:
    """Visits parts in order and builds the formatted string of one conversation."""

    def __init__(self, expanded: dict[str, int] | None = None):
        self.expanded = EXPANDED | (expanded or {})
        self.out: list[str] = []
        self.length = 0
        self.loss: list[tuple[int, int]] = []
        self.attachments: list[tuple[str, str, int]] = []

    def _write(self, text: str) -> None:
        self.out.append(text)
        self.length += len(text)

    def turn(self, role: str | None, parts: Iterable[Part]) -> None:
        self._write(f"{HEAD}{_header(role or '')}: ")
        for part in parts:
            start = self.length
            getattr(self, f"visit_{part.kind}")(part)
            if role == "assistant" and part.kind == "text":
                self.loss.append((start, self.length))
        self._write(END)

    def visit_text(self, part: Part) -> None:
        self._write(escape(part.text))

    def _attach(self, part: Part) -> None:
        self._write(f"<{part.kind}:{len(self.attachments)}>")
        self.attachments.append((part.kind, part.reference, self.expanded[part.kind] if part.tokens is None else part.tokens))

    visit_image = visit_audio = visit_document = _attach

    def done(self) -> Formatted:
        return Formatted("".join(self.out), self.loss, self.attachments)


def _header(role: str) -> str:
    """A plain role with a capital; any other opens with a backslash, so no two roles look alike."""
    if role.isascii() and role.isalpha() and role.islower():
        return role.capitalize()
    return role and "\\" + role[0] + _ESCAPED_ROLE.sub(r"\\\g<0>", role[1:])


def _role(header: str) -> str:
    return unescape(header) if header.startswith("\\") else header.lower()


def format_conversation(turns: Iterable[tuple[str | None, Iterable[Part]]], expanded: dict[str, int] | None = None) -> Formatted:
    flattener = Flattener(expanded)
    for role, parts in turns:
        flattener.turn(role, parts)
    return flattener.done()


_HEADER = re.compile(r"### ((?:[^\\:]|\\.)*): ", re.DOTALL)


def read_back(formatted: Formatted) -> list[tuple[str, list[Part]]]:
    """The turns of a formatted string. Raises ``ValueError`` on anything :func:`format_conversation` can't have made."""
    text, at, turns = formatted.text, 0, []
    while at < len(text):
        head = _HEADER.match(text, at)
        end = text.find(END, head.end()) if head else -1  # an escaped "<" is never part of an end mark
        if end < 0:
            raise ValueError(f"no turn at {at}")
        turns.append((_role(head[1]), _parts(text[head.end() : end], formatted)))
        at = end + len(END)
    return turns


def _parts(body: str, formatted: Formatted) -> list[Part]:
    out, at = [], 0
    for m in _PLACE.finditer(body):
        before = body[at : m.start()]
        if (len(before) - len(before.rstrip("\\"))) % 2:
            continue  # an escaped "<" opens no placeholder
        if before:
            out.append(Part("text", unescape(before)))
        kind, reference, tokens = formatted.attachments[int(m[2])]
        out.append(Part(kind, reference=reference, tokens=tokens))
        at = m.end()
    if body[at:] or not out:
        out.append(Part("text", unescape(body[at:])))
    return out


def loss_text(formatted: Formatted) -> str:
    """All text under the loss mask, unescaped, with nothing between."""
    return "".join(unescape(formatted.text[a:b]) for a, b in formatted.loss)


_OUT = "formatted string, loss array<struct<start:long,end:long>>, attachments array<struct<kind:string,reference:string,tokens:long>>, tokens_expanded long"


def _grouped(turns: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str, parts_col: str | None) -> DataFrame:
    fields = [F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text")]
    if parts_col:
        fields.append(F.col(parts_col).alias("parts"))
    return turns.groupBy(F.col(id_col).alias("conv_id")).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("turns"))


def chat_format(
    turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", parts_col: str | None = None,
    expanded: dict[str, int] | None = None,
) -> DataFrame:
    """One row per conversation: the formatted string, its loss mask, attachments and expanded tokens.

    One shuffle, of the turns by conversation. ``parts_col``, if given, holds
    ``array<struct<kind,text,reference,tokens>>`` and goes before ``text_col`` where it isn't empty.
    """
    @F.pandas_udf(_OUT)
    def flat(conversations: pd.Series) -> pd.DataFrame:
        rows = []
        for own in conversations:
            f = format_conversation(((t["role"], _parts_of(t)) for t in own), expanded)
            loss = [{"start": a, "end": b} for a, b in f.loss]
            kept = [{"kind": k, "reference": r, "tokens": n} for k, r, n in f.attachments]
            rows.append((f.text, loss, kept, sum(n for *_, n in f.attachments)))
        return pd.DataFrame(rows, columns=["formatted", "loss", "attachments", "tokens_expanded"])

    grouped = _grouped(turns, id_col, turn_col, role_col, text_col, parts_col)
    return grouped.select("conv_id", flat("turns").alias("f")).select("conv_id", "f.*")


def _parts_of(turn) -> list[Part]:
    if "parts" in turn and turn["parts"] is not None and len(turn["parts"]):
        return [Part(p["kind"], p["text"] or "", p["reference"] or "", None if pd.isna(p["tokens"]) else int(p["tokens"])) for p in turn["parts"]]
    return [Part("text", turn["text"] or "")]


def digest(formatted: DataFrame) -> DataFrame:
    """``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars``, all read back from the output."""

    @F.pandas_udf("n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string")
    def parsed(text: pd.Series, loss: pd.Series) -> pd.DataFrame:
        rows = []
        for t, mask in zip(text, loss, strict=True):
            f = Formatted(t, [(int(m["start"]), int(m["end"])) for m in mask])
            turns = read_back(f)
            whole = "".join(f"{role}\n{''.join(p.text for p in parts)}\n" for role, parts in turns)
            under = loss_text(f)
            rows.append((len(turns), _sha(whole), len(under), _sha(under)))
        return pd.DataFrame(rows, columns=["n_turns", "turns_sha256", "loss_chars", "loss_sha256"])

    return formatted.select("conv_id", parsed("formatted", "loss").alias("p"), F.length("formatted").cast("long").alias("formatted_chars")).select(
        "conv_id", "p.*", "formatted_chars"
    )


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8")).hexdigest()
