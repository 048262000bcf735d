"""Toxicity by class-conditional Kneser-Ney models.

Two interpolated models, one of toxic and one of ordinary texts, give a probability
to every word after the one before it. Counts are of documents, so neither copies nor a line repeated inside a text
count twice. A pair backs off to its word, and a word by its spelling, to its first eight, six and four letters,
and from there to counts that both classes share:

    p(w | v) = max(c(v w) - d'', 0) / c(v .) + left_v * p(w)
    p(w) = max(c(w) - d, 0) / N + left * q8(w)
    qk(w) = max(t(stem) - d', 0) / T * s(w | stem) + left_k * q(k-2)(w)
    q2(w) = s(w)

t(stem) is the Kneser-Ney continuation count: how many different words of the class go on
from the stem (so endings never seen still speak for the class that has many of them);
s is the shared distribution. Each class has its own counts and its own backoff weights.
Counts below ``least_pair``, ``least`` (words) and ``least_stem`` are discounted whole, so a rare
expression has the odds of the shared counts. Both columns sum to 1 over the words seen
and, for each stem, one place for all its other words.

A text is judged by the difference of its log-likelihoods per word under the two
models: over all of its words, and over its 1, 3, 8 and 20 most telling ones, since
a few toxic words in a long text hardly move the mean. A logistic curve, fitted on labelled
rows kept out of the counts, turns these differences into a score.

Training reads a bounded sample: about ``max_train_docs`` labelled rows of each
class, by a hash of the id. Scoring reads every whole text. What reaches the driver are the
words, pairs (as hashes) and stems of the sample that pass these thresholds, and five numbers
for each row the curve is fitted on; no texts.

Defined cases: null and empty texts, and texts without words, have differences of 0 and get
the score of that; without labels of both classes the score is the share of toxic labels (0
if there are none); labels that are null or contradict each other for one id
are not learned from; equal labelled texts are learned from once a class; repeated rows are
scored each; null ids are kept; very long texts are scored whole. Other columns are ignored,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm import _text
from sparkloom.llm._graph import saved
from sparkloom.llm.language_id import held_out

TELLING = (1, 3, 8, 20)
STEMS = (8, 6, 4)
_SHARE = 1 << 30


def _hashed(words: pa.Array) -> np.ndarray:
    return pd.util.hash_array(words.to_numpy(zero_copy_only=False).astype(object), categorize=False) if len(words) else np.empty(0, np.uint64)


def pair_keys(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return _text.mix(first * np.uint64(0x9E3779B97F4A7C15) + second)


def followers(offsets: np.ndarray) -> np.ndarray:
    """The places of words that aren't the first of their text."""
    some = np.ones(int(offsets[-1]), bool)
    some[offsets[:-1][np.diff(offsets) > 0]] = False
    return np.flatnonzero(some)


@dataclass
class Table:
    """For each expression (by hash, sorted) and class, its discounted share over its shared probability."""

    keys: np.ndarray = field(default_factory=lambda: np.empty(0, np.uint64))
    ratio: np.ndarray = field(default_factory=lambda: np.empty((0, 2)))
    left: np.ndarray = field(default_factory=lambda: np.ones(2))  # the weight of what is backed off to

    def find(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros((len(keys), 2))
        i = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where((self.keys[i] == keys)[:, None], self.ratio[i], 0)


@dataclass
class Model:
    """Columns are ordinary and toxic. Probabilities are kept over the shared one, which both columns divide by."""

    words: Table = field(default_factory=Table)
    stems: list[Table] = field(default_factory=list)
    pairs: Table = field(default_factory=Table)  # of pairs of words, over the second one's shared probability
    after: Table = field(default_factory=Table)  # for each first word of kept pairs, 1 less what is left to its second ones
    total: float = 1.0  # the shared mass
    curve: np.ndarray | None = None  # logistic weights, the constant last
    base: float = 0.0

    def ratios(self, words: pa.Array) -> np.ndarray:
        """p(w) / s(w) for each word, by class."""
        p, weight = self.words.find(_hashed(words)), self.words.left
        length = pc.utf8_length(words).to_numpy(zero_copy_only=False)
        for n, table in zip(STEMS, self.stems, strict=False):
            long = length > n
            if long.any():
                p[long] += weight * table.find(_hashed(pc.utf8_slice_codeunits(words.filter(pa.array(long)), 0, n)))
            weight = weight * table.left
        return p + weight

    def differences(self, flat: pa.Array, offsets: np.ndarray) -> np.ndarray:
        """log p(word | toxic) - log p(word | ordinary), each word after the one before it in its text; each spelling is looked up once."""
        if not len(flat):
            return np.empty(0)
        coded = flat.dictionary_encode()
        names, at = coded.dictionary.cast(pa.string()), coded.indices.to_numpy()
        r = self.ratios(names)[at]
        if len(self.pairs.keys):
            hashes = _hashed(names)
            taken = self.after.find(hashes)
            second = followers(offsets)
            v, w = at[second - 1], at[second]
            own = taken[v].any(axis=1)  # other words begin no pair that is kept
            second, v, w = second[own], v[own], w[own]
            r[second] = self.pairs.find(pair_keys(hashes[v], hashes[w])) + (1 - taken[v]) * r[second]
        r = np.log(r)
        return r[:, 1] - r[:, 0]

    def features(self, texts) -> np.ndarray:
        flat, offsets = _text.words(texts, _text.LOWER_ALNUM)
        own = self.differences(flat, offsets)
        out = np.zeros((len(offsets) - 1, 1 + len(TELLING)))
        most = max(TELLING)
        for i in range(len(out)):
            x = own[offsets[i] : offsets[i + 1]]
            if len(x):
                best = np.sort(np.partition(x, len(x) - most)[-most:] if len(x) > most else x)[::-1]
                out[i] = [x.mean(), *(best[:k].sum() / k for k in TELLING)]
        return out

    def scores(self, texts) -> np.ndarray:
        if self.curve is None:
            return np.full(len(texts), self.base)
        z = self.features(texts) @ self.curve[:-1] + self.curve[-1]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    mean, spread = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.column_stack([(x - mean) / spread, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z.T * (weight * p * (1 - p) + 1e-9)) @ z + ridge * np.eye(len(w)), z.T @ (weight * (p - y)) + ridge * w)
        w = w - step * min(1, 5 / (np.abs(step).max() + 1e-12))
    return np.append(w[:-1] / spread, w[-1] - (w[:-1] * mean / spread).sum())


def _table(rows: DataFrame, discount: float, least: int, total: float) -> Table:
    """From rows of ``name, n0, n1, mass``: counts by class, and the shared mass of which ``total`` is the whole.

    Only names with ``least`` in either class reach the driver.
    """
    sums = rows.agg(F.sum("n0"), F.sum("n1")).first()
    often = rows.filter((F.col("n0") >= least) | (F.col("n1") >= least)).toArrow().to_pandas()
    n, table = often[["n0", "n1"]].to_numpy().astype(float), Table()
    share = np.where(n < least, 0, np.maximum(n - discount, 0)) / np.maximum([sums[0] or 0, sums[1] or 0], 1)
    keys = _hashed(pa.array(often["name"], pa.string()))
    order = np.argsort(keys)
    table.keys, table.ratio = keys[order], (share / (often["mass"].to_numpy()[:, None] / total))[order]
    table.left = 1 - share.sum(axis=0)
    return table


def estimate(words: DataFrame, discount: float, least: int, stem_discount: float, least_stem: int) -> Model:
    """Both models from ``name, n0, n1``: in how many texts of each class a word stands."""
    size, stem = F.length("name"), lambda n: F.substring("name", 1, n)
    words = words.withColumn("mass", F.col("n0") + F.col("n1") + 0.5)
    by_stem, places = [], 0
    for i, n in enumerate(STEMS):
        # every stem has a place for words that were not seen: its own, and those of the longer stems below it
        below = sum((F.countDistinct(F.when(size > k, stem(k))) for k in STEMS[:i]), F.lit(0))
        rows = words.filter(size > n).groupBy(stem(n).alias("s")).agg(
            F.count(F.when(F.col("n0") > 0, 1)).alias("n0"), F.count(F.when(F.col("n1") > 0, 1)).alias("n1"), (F.sum("mass") + 0.5 * (below + 1)).alias("mass")
        ).withColumnRenamed("s", "name")
        by_stem.append(saved(rows))
        places += by_stem[-1].count()
    total = (words.agg(F.sum("mass")).first()[0] or 0) + 0.5 * (places + 1)
    return Model(_table(words, discount, least, total), [_table(rows, stem_discount, least_stem, total) for rows in by_stem], total=total)


PAIRS = "v long, w long, n0 long, n1 long"


def count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many texts of each class a pair of words stands, in each slice; words as hashes."""
    for part in _text.text_slices(batches, "text"):
        flat, offsets = _text.words(part["text"], _text.LOWER_ALNUM)
        coded = flat.dictionary_encode()
        n, at = max(len(coded.dictionary), 1), coded.indices.to_numpy().astype(np.int64)
        second = followers(offsets)
        doc = np.repeat(np.arange(part.num_rows), np.diff(offsets))[second]
        names, pair = np.unique(at[second - 1] * n + at[second], return_inverse=True)
        once = np.unique(doc * max(len(names), 1) + pair)  # each pair once a text
        toxic, pair = part["toxic"].to_numpy()[once // max(len(names), 1)].astype(bool), once % max(len(names), 1)
        counts = [np.bincount(pair[own], minlength=len(names)) for own in (~toxic, toxic)]
        hashes = _hashed(coded.dictionary.cast(pa.string())).view(np.int64)
        columns = [hashes[names // n] if len(names) else np.empty(0, np.int64), hashes[names % n] if len(names) else np.empty(0, np.int64), *counts]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["v", "w", "n0", "n1"])


def with_pairs(model: Model, words: DataFrame, pairs: DataFrame, discount: float, least: int) -> Model:
    """Adds pairs of words, from ``v, w, n0, n1`` (hashes and counts by class); ``words`` as for :func:`estimate`. ``least`` is no less than that of words.

    Only pairs with ``least`` in either class, and their first words, reach the driver.
    """
    whole = pairs.groupBy("v").agg(F.sum("n0").alias("all0"), F.sum("n1").alias("all1"))
    often = pairs.filter((F.col("n0") >= least) | (F.col("n1") >= least)).join(whole, "v").toArrow().to_pandas()
    if not len(often):
        return model
    n, every = often[["n0", "n1"]].to_numpy().astype(float), often[["all0", "all1"]].to_numpy().astype(float)
    share = np.where(n < least, 0, np.maximum(n - discount, 0)) / np.maximum(every, 1)
    known = words.filter((F.col("n0") >= least) | (F.col("n1") >= least)).select("name", (F.col("n0") + F.col("n1") + 0.5).alias("mass")).toArrow().to_pandas()
    names = _hashed(pa.array(known["name"], pa.string()))
    order = np.argsort(names)
    v, w = (often[c].to_numpy().view(np.uint64) for c in ("v", "w"))
    mass = known["mass"].to_numpy()[order][np.searchsorted(names[order], w)]
    keys = pair_keys(v, w)
    by_key = np.argsort(keys)
    model.pairs = Table(keys[by_key], (share / (mass[:, None] / model.total))[by_key])
    firsts, at = np.unique(v, return_inverse=True)
    model.after = Table(firsts, np.column_stack([np.bincount(at, share[:, c]) for c in (0, 1)]))
    return model


def train(
    docs: DataFrame, labels: DataFrame, max_train_docs: int = 5000, discount: float = 1.5, least: int = 3, stem_discount: float = 2.0, least_stem: int = 4,
    pair_discount: float = 1.5, least_pair: int = 10, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
) -> Model:
    """Fit both models and the curve. What reaches the driver is bounded by the sample."""
    told = (
        labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("toxic"))
        .filter(F.col("id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("id")))
        .groupBy("id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("other"))
        .filter(F.col("toxic") == F.col("other")).drop("other")
    )
    there = {r["toxic"]: r["n"] for r in told.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    base = there.get(1, 0) / max(sum(there.values()), 1)
    if len(there) < 2:
        return Model(base=base)
    share = {c: _SHARE if n <= max_train_docs else int(_SHARE * max_train_docs / n) for c, n in there.items()}
    told = told.filter(F.pmod(F.xxhash64("id", F.lit(8)), F.lit(_SHARE)) < F.when(F.col("toxic") == 1, share[1]).otherwise(share[0]))
    # the ids are about ``max_train_docs`` a class, so they can go to every executor and the texts stay where they are
    sample = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("text is not null").join(F.broadcast(told), "id")
    # equal texts are on the same side of the cut
    sample = saved(sample.select("toxic", "text").distinct().withColumn("curve", F.pmod(F.xxhash64("text", F.lit(9)), F.lit(4)) == 0))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _text.text_slices(batches, "text"):
            flat, offsets = _text.words(part["text"], _text.LOWER_ALNUM)
            coded = flat.dictionary_encode()
            names = coded.dictionary.cast(pa.string())
            doc = np.repeat(np.arange(part.num_rows), np.diff(offsets))
            pairs = np.unique(doc * max(len(names), 1) + coded.indices.to_numpy())  # each word once a text
            toxic = part["toxic"].to_numpy()[pairs // max(len(names), 1)].astype(bool)
            at = pairs % max(len(names), 1)
            n = [np.bincount(at[own], minlength=len(names)) for own in (~toxic, toxic)]
            yield pa.RecordBatch.from_arrays([names, pa.array(n[0], pa.int64()), pa.array(n[1], pa.int64())], ["name", "n0", "n1"])

    words = saved(
        sample.filter(~F.col("curve")).select("toxic", "text").mapInArrow(count, "name string, n0 long, n1 long")
        .groupBy("name").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    )
    pairs = saved(sample.filter(~F.col("curve")).select("toxic", "text").mapInArrow(count_pairs, PAIRS).groupBy("v", "w").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")))
    model = with_pairs(estimate(words, discount, least, stem_discount, least_stem), words, pairs, pair_discount, max(least_pair, least))
    model.base = base
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [f"f{i}" for i in range(1 + len(TELLING))]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _text.text_slices(batches, "text"):
            x = shared.value.features(part["text"])
            yield pa.RecordBatch.from_arrays([part["toxic"].combine_chunks(), *(pa.array(x[:, i]) for i in range(len(names)))], ["toxic", *names])

    rows = sample.filter("curve").select("toxic", "text").mapInArrow(measure, ", ".join(["toxic int", *(f"{n} double" for n in names)])).toArrow().to_pandas()
    y = rows["toxic"].to_numpy()
    if 0 < y.sum() < len(y):
        counted = {c: max((y == c).sum(), 1) for c in (0, 1)}
        weight = np.where(y == 1, base / counted[1], (1 - base) / counted[0]) * len(y)
        model.curve = _logistic(rows[names].to_numpy(), y, weight)
    return model


def score(text: Column, model: Model) -> Column:
    @F.pandas_udf("double")
    def toxic(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            rows = pa.RecordBatch.from_arrays([pa.array(texts, pa.large_string())], ["text"])
            yield pd.Series(np.concatenate([np.empty(0), *(model.scores(part["text"]) for part in _text.text_slices([rows], "text"))]))

    return toxic(text)


def toxicity(
    docs: DataFrame, labels: DataFrame, threshold: float = 0.7, model: Model | None = None, id_col: str = "doc_id", text_col: str = "text", **training
) -> DataFrame:
    """One row per input row: ``doc_id, held_out, score, predicted``."""
    model = model or train(docs, labels, id_col=id_col, text_col=text_col, **training)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the training sample

    class Lazy:
        def scores(self, texts):
            return shared.value.scores(texts)

    scored = docs.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), score(F.col(text_col), Lazy()).alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))
