"""A corpus from raw documents: five stages, each written as Parquet and read again for the next.

1. language_id: documents of none of the wanted languages go: those without a letter, those that
   resemble no profile (score below ``LEAST_SCORE``), and those told to be in another language.
2. near_duplicates: of each component of near copies (five-word n-grams, Jaccard 0.8) the one with
   the smallest id stays.
3. repeated_passages: 13-word windows that start in a document with a smaller id are cut out;
   documents that lose every word go. ``n_chars`` follows the text.
4. decontamination: documents that hold a window of a benchmark item go.
5. mixing: sources are drawn to temperature weights, every document at least once and none
   more than twice; one row for each draw.

All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import _rows
from sparkloom.llm import decontamination as contaminated
from sparkloom.llm import language_id as languages
from sparkloom.llm import mixing as sources
from sparkloom.llm._graph import shared_folder
from sparkloom.llm.ngram_jaccard import one_of_each
from sparkloom.llm.substring_dedup import without_repeats

#: No SQL: profiles, suffix arrays and factor parsing have no form there. Tests compare with brute force.
ORACLE_SQL = None


#: Languages to keep; None: all that ``documents`` names.
WANTED: tuple[str, ...] | None = None
#: Texts in a language that profiles were learned for score above 0.4, those in none of them mostly below 0.3.
LEAST_SCORE = 0.3


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps what is told to be in a wanted language. Learns from the languages that ``documents`` gives."""
    profiles = languages.train(docs)
    found = _rows.packed(docs, text="text").withColumn("found", languages.predict(F.col("text"), profiles))
    kept = (F.col("found.lang_pred") != languages.UNKNOWN) & (F.col("found.score") >= LEAST_SCORE)
    if WANTED is not None:
        kept = kept & F.col("found.lang_pred").isin(*WANTED)
    return _rows.unpacked(found.filter(kept), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_of_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cut = without_repeats(docs)
    if "n_chars" not in docs.columns:
        return cut
    n = F.length("text").cast(docs.schema["n_chars"].dataType)
    return cut.withColumn("n_chars", F.when(F.col("text").isNotNull(), n).otherwise(F.col("n_chars")))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return contaminated.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sources.mix(docs, max_repeats=2.0)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("decontamination", decontamination),
    ("mixing", mixing),
]


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written to the shared folder before the next reads it.

    A stage's folder is deleted once the next one is written; the last is what the result reads.
    """
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for i, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            _delete(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
