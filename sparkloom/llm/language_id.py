"""Language identification by rank-order profiles of character n-grams.

Each language's profile is the list of its most frequent n-grams (one to three
letters, word edges marked). A document's own most frequent n-grams are ranked
the same way, and the language whose ranks are least out of place wins.

Training reads a bounded sample: per language about ``max_train_docs`` rows,
taken by a hash of the id. Prediction reads every whole text.

Defined cases: a null text, or one without letters, is ``und`` with score 0;
so is every text if no row can be learned from. Ties between languages go to
the first by name, ties between n-grams to the smaller code. Very long texts are counted
in pieces, with the counts of the whole. More than ``max_languages`` languages are an error.
Rows are scored one by one, so repeated rows repeat; null ids are kept. Other columns of the
input are ignored, whatever their names.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UNKNOWN = "und"
_BITS = np.int64(21)
#: Stands for the edge of a word; no code point.
_EDGE = np.int64(0x110000)
_PIECE = 1 << 20


@functools.cache
def _letters() -> np.ndarray:
    """Which code points are letters."""
    import sys

    out = np.zeros(sys.maxunicode + 1, dtype=bool)
    out[[i for i in range(sys.maxunicode + 1) if chr(i).isalpha()]] = True
    return out


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams of a text as sorted 63-bit codes, and their counts."""
    text, parts = text.lower(), []
    last = np.zeros(1, np.int64)  # the last points before this piece: an edge, then up to two
    for at in range(0, max(len(text), 1), _PIECE):
        points = np.frombuffer(text[at : at + _PIECE].encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
        points = np.where(_letters()[points], points, 0)
        own = np.concatenate([last, points] if at + _PIECE < len(text) else [last, points, [0]])
        own = own[~((own == 0) & np.concatenate([[False], own[:-1] == 0]))]  # one mark between words
        # the n-grams that end in this piece; an edge has a code of its own, so no two n-grams share one
        k, coded = len(last), np.where(own == 0, _EDGE, own)
        two = coded[k - 1 : -1] << _BITS | coded[k:]
        at_three = np.arange(max(k, 2), len(own))
        at_three = at_three[own[at_three - 1] != 0]
        three = (coded[at_three - 2] << _BITS | coded[at_three - 1]) << _BITS | coded[at_three]
        parts.append(np.unique(np.concatenate([own[k:][own[k:] != 0], two, three]), return_counts=True))
        last = own[-2:]
    if len(parts) == 1:
        return parts[0]
    codes, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return codes, np.bincount(at, weights=np.concatenate([p[1] for p in parts]), minlength=len(codes)).astype(np.int64)


def top(codes: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The ``size`` most frequent codes, in rank order."""
    return codes[np.argsort(-counts, kind="stable")[:size]]


@dataclass(frozen=True)
class Profiles:
    languages: list[str]
    codes: np.ndarray  # sorted, of all languages
    ranks: np.ndarray  # language x code; ``size`` where a profile lacks the code
    size: int

    @classmethod
    def of(cls, ranked: dict[str, list[int]], size: int) -> Profiles:
        languages = sorted(ranked)
        codes = np.unique(np.concatenate([np.empty(0, np.int64), *(np.array(ranked[x], np.int64) for x in languages)]))
        ranks = np.full((len(languages), len(codes)), size, dtype=np.int64)
        for i, x in enumerate(languages):
            ranks[i, np.searchsorted(codes, np.array(ranked[x], np.int64))] = np.arange(len(ranked[x]))
        return cls(languages, codes, ranks, size)

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.languages:
            return UNKNOWN, 0.0
        own = top(*grams(text), self.size)
        if not len(own):
            return UNKNOWN, 0.0
        at = np.minimum(np.searchsorted(self.codes, own), len(self.codes) - 1)
        known = self.codes[at] == own
        theirs = np.where(known, self.ranks[:, at], self.size)
        apart = np.where(theirs == self.size, self.size, np.abs(theirs - np.arange(len(own)))).sum(axis=1)
        best = int(np.argmin(apart))
        return self.languages[best], float(1 - apart[best] / (self.size * len(own)))


def held_out(id_column: Column) -> Column:
    """Rows that nothing is learned from: crc32 of the id's text leaves 1 modulo 3."""
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(
    docs: DataFrame, max_train_docs: int = 2000, size: int = 400, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    max_languages: int = 1000,
) -> Profiles:
    """Learn profiles from rows with a language and a text that are not held out.

    What reaches the driver is ``size`` n-grams a language.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).filter(
        F.col("lang").isNotNull() & ~held_out(F.col("id"))
    )
    there = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(max_languages + 1).collect()}
    if len(there) > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    if not there:
        return Profiles.of({}, size)
    whole = 1 << 30
    share = [(x, whole if n <= max_train_docs else int(whole * max_train_docs / n)) for x, n in there.items()]
    shares = F.broadcast(docs.sparkSession.createDataFrame(share, "lang string, share long"))  # one row a language
    picked = rows.join(shares, "lang").filter(F.pmod(F.xxhash64("id", F.lit(11)), F.lit(whole)) < F.col("share"))

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for lang, texts in frame.groupby("lang")["text"]:
                parts = [grams(t) for t in texts if t]
                if parts:
                    codes, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
                    n = np.bincount(at, weights=np.concatenate([p[1] for p in parts])).astype(np.int64)
                    yield pd.DataFrame({"lang": lang, "code": codes, "n": n})

    counted = (
        picked.select("lang", "text").mapInPandas(count, "lang string, code long, n long")
        .groupBy("lang", "code").agg(F.sum("n").alias("n"))
    )
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), F.asc("code")))
    ranked: dict[str, list[int]] = {x: [] for x in there}
    for r in sorted(counted.withColumn("place", place).filter(F.col("place") <= size).collect(), key=lambda r: r["place"]):
        ranked[r["lang"]].append(r["code"])
    return Profiles.of({x: codes for x, codes in ranked.items() if codes}, size)


def predict(text: Column, profiles: Profiles) -> Column:
    """A struct of ``lang_pred`` and ``score`` for a text column; Arrow batches."""

    # texts become Python's one at a time, so a worker holds a batch once
    @F.arrow_udf("lang_pred string, score double")
    def lang(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            found = [profiles.predict(t.as_py()) for t in texts]
            yield pa.StructArray.from_arrays([pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], ["lang_pred", "score"])

    return lang(text)


def language_id(docs: DataFrame, profiles: Profiles | None = None, id_col: str = "doc_id", text_col: str = "text", **training) -> DataFrame:
    """One row per input row: ``doc_id, held_out, lang_pred, score``."""
    profiles = profiles or train(docs, id_col=id_col, text_col=text_col, **training)
    return docs.select(
        F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), predict(F.col(text_col), profiles).alias("p")
    ).select("doc_id", "held_out", "p.lang_pred", "p.score")
