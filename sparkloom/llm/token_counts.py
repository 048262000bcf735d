"""Token counts by the whole-token shortcut.

A pre-token that is itself a vocabulary string, and for which the merge rules
are proven to end in that one token, counts 1 without any merging. All other
pre-tokens are merged, and their counts remembered in a table of bounded size.

The proof runs once, on the driver, with the library's own model and
pre-tokeniser: which vocabulary strings end in one token, and which characters it takes
for letters, numbers and white space (every character is asked, so texts of any
script are cut like the library cuts them). It goes to the workers as a broadcast
of about the vocabulary's size.

Defined cases: a null text counts as empty (0 bytes, 0 tokens); strings of
special tokens inside a text are one token each, as the library does by
default; texts are never cut, however long; repeated rows are counted each; columns of the
input besides the id and the text are ignored, whatever their names.
"""

from __future__ import annotations

import functools
import json
import re
import sys
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _byte_chars() -> dict[int, str]:
    """The printable stand-in for each byte value: itself if printable, else the next free one from 256."""
    out, free = {}, 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
            out[b] = chr(b)
        else:
            out[b], free = chr(free), free + 1
    return out


def whole_tokens(model, vocabulary: dict[str, int]) -> dict[str, int]:
    """The vocabulary strings, as text, that the merge rules turn into that one token."""
    back = {c: b for b, c in _byte_chars().items()}
    out = {}
    for token, number in vocabulary.items():
        got = model.tokenize(token)
        if len(got) == 1 and got[0].id == number:
            try:
                out[bytes(back[c] for c in token).decode("utf-8")] = 1
            except (KeyError, UnicodeDecodeError):
                continue  # a piece of a character is no pre-token
    return out


HIGH = 0x250
#: All characters but the planes that hold none (4 to 13) and those for private use, which are symbols.
_ASKED = [chr(i) for i in (*range(0xD800), *range(0xE000, 0x40000), *range(0xE0000, 0xE1000))]


def _joins(pre_tokenizer, before: str, asked: list[str], step: int = 4096) -> set[str]:
    """The characters that the pre-tokeniser leaves in one piece with ``before``."""
    wide, out = len(before) + 2, set()
    for at in range(0, len(asked), step):
        own = asked[at : at + step]
        pieces = pre_tokenizer.pre_tokenize_str("".join(f"{before}{c}\n" for c in own))
        # cells of the same width; a cell's character joins if a piece runs from the cell's start over it
        out.update(own[start // wide] for _, (start, end) in pieces if start % wide == 0 and end - start > len(before))
    return out


def _ranges(chars: set[str]) -> str:
    """A character class for ``re``, without its brackets."""
    points, out = sorted(map(ord, chars)), []
    for p in points:
        if out and p == out[-1][1] + 1:
            out[-1][1] = p
        else:
            out.append([p, p])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in out)


def _pattern(letters: set[str], numbers: set[str], spaces: set[str]) -> str:
    """The alternatives of byte-level BPE's pre-tokenisation."""
    letter, number, space = _ranges(letters), _ranges(numbers), _ranges(spaces)
    return (
        rf" ?[{letter}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[{number}]+| ?[^{space}{letter}{number}]+"
        rf"|[{space}]+(?![^{space}])|[{space}]+"
    )


@dataclass
class Proof:
    """What is proven about a tokenizer file. ``fits`` is false where texts must go through the library whole."""

    path: str
    fits: bool
    whole: dict[str, int] = field(default_factory=dict)
    pieces: str = ""
    low: str = ""  # the same for texts without characters from ``HIGH`` on; small classes are faster
    special: str = ""


@functools.lru_cache(maxsize=8)
def prove(path: str) -> Proof:
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
    added = spec.get("added_tokens") or []
    plain = not any(a["single_word"] or a["lstrip"] or a["rstrip"] or a["normalized"] for a in added)
    # anything but plain byte-level BPE goes through the library whole
    if not (
        model["type"] == "BPE" and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and plain
        and spec.get("normalizer") is None and not model.get("ignore_merges") and not model.get("dropout") and not model.get("unk_token")
    ):
        return Proof(path, False)
    left, classes = _ASKED, []
    for sign in "a1!":
        classes.append(_joins(tokenizer.pre_tokenizer, sign, left))
        left = [c for c in left if c not in classes[-1]]
    sets = [classes[0], classes[1], set(left)]
    pieces, low = _pattern(*sets), _pattern(*({c for c in s if ord(c) < HIGH} for s in sets))
    # the library takes the leftmost, and of those the longest, special string
    strings = sorted((a["content"] for a in added), key=len, reverse=True)
    return Proof(path, True, whole_tokens(tokenizer.model, model["vocab"]), pieces, low, "|".join(map(re.escape, strings)))


class PieceCounts(dict):
    """Pre-token to number of tokens. Misses are merged by the library's model, and kept while there is room."""

    def __init__(self, model, whole: dict[str, int], room: int):
        super().__init__(whole)
        self.model, self.table, self.room, self.merges = model, _byte_chars(), room, 0

    def __missing__(self, piece: str) -> int:
        self.merges += 1
        n = len(self.model.tokenize(piece.encode("utf-8").decode("latin-1").translate(self.table)))
        size = sys.getsizeof(piece) + 100  # bytes, with the entry
        if size <= self.room:
            self.room -= size
            self[piece] = n
        return n


class Counter:
    """Counts the tokens of texts as ``Tokenizer.encode(text, add_special_tokens=False)`` gives them."""

    def __init__(self, proof: Proof, room: int = 64 << 20):
        from tokenizers import Tokenizer

        self.tokenizer, self.fits = Tokenizer.from_file(proof.path), proof.fits
        if self.fits:
            self.counts = PieceCounts(self.tokenizer.model, proof.whole, room)
            self.pieces, self.low = re.compile(proof.pieces), re.compile(proof.low)
            self.high = re.compile(f"[{chr(HIGH)}-{chr(sys.maxunicode)}]")
            self.special = re.compile(proof.special) if proof.special else None

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if not self.fits:
            return len(self.tokenizer.encode(text, add_special_tokens=False))
        if self.special is None or not self.special.search(text):
            return self._plain(text)
        parts = self.special.split(text)
        return len(parts) - 1 + sum(map(self._plain, parts))

    def _plain(self, text: str) -> int:
        pattern = self.pieces if self.high.search(text) else self.low
        return sum(map(self.counts.__getitem__, pattern.findall(text)))


_counters: dict[str, Counter] = {}


def _counter(proof: Proof) -> Counter:
    if proof.path not in _counters:
        _counters[proof.path] = Counter(proof)
    return _counters[proof.path]


def n_tokens(text: Column, proof) -> Column:
    """The number of tokens of a text column; Arrow batches, one tokenizer per worker. ``proof``: a broadcast :class:`Proof`."""

    @F.pandas_udf("long")
    def tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = _counter(proof.value)
        for texts in batches:
            yield pd.Series([counter.count(t) for t in texts], dtype="int64")

    return tokens(text)


def token_counts(
    docs: DataFrame, tokenizer_path: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per input row: ``doc_id, n_bytes, n_tokens, over_limit``. A narrow stage: no shuffle."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    proof = docs.sparkSession.sparkContext.broadcast(prove(tokenizer_path))
    counted = docs.select(
        F.col(id_col).alias("doc_id"),
        F.octet_length(text).cast("long").alias("n_bytes"),
        n_tokens(text, proof).alias("n_tokens"),
    )
    return counted.withColumn("over_limit", F.col("n_tokens") > F.lit(limit))
