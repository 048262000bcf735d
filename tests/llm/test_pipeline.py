"""The pipeline, stage by stage, against plain answers; and the registered queries on the smallest tables."""

import os

import pytest
from pyspark.sql import functions as F

import brute
import corpus_pipeline
from sparkloom.llm import mixing, queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """What each stage returned, written and read again."""
    folder = tmp_path_factory.mktemp("stages")
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, f in corpus_pipeline.STAGES:
        f(spark, docs, SF).write.parquet(f"{folder}/{name}")
        out.append((name, docs, docs := spark.read.parquet(f"{folder}/{name}")))
    return {name: (before, after) for name, before, after in out}


def pairs(frame):
    return [(r["doc_id"], r["text"]) for r in frame.select("doc_id", "text").collect()]


def test_order_and_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_duplicates", "repeated_passages", "decontamination", "mixing"]
    assert all(stages[n][1].columns == COLUMNS for n in list(stages)[:-1])


def test_language_id_keeps_all_texts_with_letters_of_the_test_tables(stages):
    before, after = stages["language_id"]
    assert dict(pairs(after)) == {i: t for i, t in pairs(before) if t and any(c.isalpha() for c in t)}


def test_language_id_rejects_other_languages(spark, monkeypatch):
    en, de = "the old man and the sea and the boy were there", "der alte mann und das meer und der junge waren da"
    rows = [(i, en, "en") for i in range(9)] + [(10 + i, de, "de") for i in range(9)]
    rows += [(20, "старик и море", None), (21, "老人与海", None), (22, "the sea", None), (23, "vanhus ja xzqk pvq kiik qqyx vuuy jkx", None), (24, "12 !", None), (25, None, "en"), (26, "und das meer", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = {r["doc_id"] for r in corpus_pipeline.language_id(spark, docs, SF).collect()}
    assert found == {*range(9), *range(10, 19), 22, 26}
    monkeypatch.setattr(corpus_pipeline, "WANTED", ("en",))
    assert {r["doc_id"] for r in corpus_pipeline.language_id(spark, docs, SF).collect()} == {*range(9), 22}


def test_near_duplicates(stages):
    before, after = stages["near_duplicates"]
    found = brute.components(pairs(before))
    assert dict(pairs(after)) == {i: t for i, t in pairs(before) if found[i][1] == i}


def test_repeated_passages(stages):
    before, after = stages["repeated_passages"]
    found = brute.substring_dedup(pairs(before))
    want = {i: t if found[i][1] == 0 else found[i][2] for i, t in pairs(before) if found[i][0] == 0 or found[i][1] < found[i][0]}
    assert dict(pairs(after)) == want
    assert all(r["n_chars"] == len(r["text"]) for r in after.collect() if found[r["doc_id"]][1])


def test_decontamination(spark, stages):
    before, after = stages["decontamination"]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    found = brute.contamination(pairs(before), items)
    assert dict(pairs(after)) == {i: t for i, t in pairs(before) if not found[i][4]}


def test_mixing(stages):
    before, after = stages["mixing"]
    assert after.columns == COLUMNS + list(mixing.ADDED)
    assert {i for i, _ in pairs(after)} == {i for i, _ in pairs(before)}
    assert after.groupBy("doc_id", "mix_epoch").count().filter("count > 1").isEmpty() and after.agg({"mix_epoch": "max"}).first()[0] <= 1


def test_run_gives_the_last_stage(spark, stages):
    key = lambda frame: sorted((r["doc_id"], r["mix_epoch"], r["mix_key"], r["text"]) for r in frame.collect())
    assert key(corpus_pipeline.run(spark, SF)) == key(stages["mixing"][1])


CLASHING = [
    "id", "row", "slice", "block", "hash", "anchor", "place", "source_place", "part", "guest", "key", "next", "number", "edited", "n", "s", "t", "epoch", "weight", "full", "prefix",
    "left", "upto", "found", "spans", "items", "longest", "n_words", "n_removed", "factors", "kept", "cls", "comp", "rep", "component_id", "lang_pred", "score", "held_out",
    "__id", "__lang", "__sum", "__was", "__row", "__slice", "__part", "__text", "__cls", "__guest", "Text", "term", "toxic", "name", "curve",
]


def test_stages_keep_the_values_of_clashing_columns(spark):
    """Columns with the names the stages use themselves, each with values of its own."""
    text = lambda i: " ".join(f"the{i * 31 + k} and{k * i} of" for k in range(30))
    rows = [(i, text(i), "en", "s" if i % 3 else None, i) for i in range(1, 30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.select("*", *[F.concat(F.lit(c), F.lit(":"), F.col("doc_id")).alias(c) for c in CLASHING])
    want = {tuple(r) for r in docs.drop("n_chars").collect()}
    for name, f in corpus_pipeline.STAGES:
        got = f(spark, docs, SF)
        assert got.columns[: len(docs.columns)] == docs.columns, name
        assert {tuple(r) for r in got.select(*[f"`{c}`" for c in docs.columns if c != "n_chars"]).collect()} == want, name


def test_stages_take_very_long_texts(spark):
    long = " ".join(f"the{i} and of" for i in range(40_000))
    rows = [(1, long, "en", "s", len(long)), (2, long + " more", "en", "s", 0), (3, "the and of", "en", "t", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = {name: sorted(r["doc_id"] for r in f(spark, docs, SF).select("doc_id").distinct().collect()) for name, f in corpus_pipeline.STAGES}
    assert kept == {"language_id": [1, 2, 3], "near_duplicates": [1, 3], "repeated_passages": [1, 2, 3], "decontamination": [1, 2, 3], "mixing": [1, 2, 3]}


def test_run_leaves_only_its_result(spark):
    import glob

    folder = spark.conf.get("spark.checkpoint.dir")
    before = set(glob.glob(f"{folder}/pipeline-*/*"))
    corpus_pipeline.run(spark, SF)
    assert [p.rsplit("/", 1)[1] for p in set(glob.glob(f"{folder}/pipeline-*/*")) - before] == ["4-mixing"]


def test_stages_take_extra_columns_and_empty_tables(spark, odd):
    benchmark = spark.read.parquet(f"{SF}/benchmark.parquet")
    assert benchmark.columns == ["item_id", "text"]
    for name, f in corpus_pipeline.STAGES:
        for docs in (odd, odd.limit(0)):
            got = f(spark, docs, SF)
            assert got.columns[: len(odd.columns)] == odd.columns, name
            assert got.count() <= (10 if name == "mixing" else 5)  # a draw may repeat a row


@pytest.mark.parametrize("operator", ["language_id", "lm", "tokens", "contamination", "jaccard", "toxicity", "dedup", "fingerprints"])
def test_operators_ignore_clashing_columns(spark, docs, operator):
    """The same answer with and without them."""
    from sparkloom.llm import decontamination, fingerprints, language_id, ngram_jaccard, substring_dedup, token_counts, toxicity
    from sparkloom.llm.lm_scoring import lm_scores

    bench = spark.createDataFrame([(1, "a b c d"), (2, "x")], "item_id long, text string")
    told = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    tokenizers = pytest.importorskip("public_tokenizers")
    run = {
        "language_id": language_id.language_id, "lm": lm_scores, "tokens": lambda d: token_counts.token_counts(d, tokenizers.path("byte_bpe_50k.json")),
        "contamination": lambda d: decontamination.contamination(d, bench), "jaccard": ngram_jaccard.ngram_jaccard, "toxicity": lambda d: toxicity.toxicity(d, told),
        "dedup": substring_dedup.substring_dedup, "fingerprints": fingerprints.fingerprints,
    }[operator]
    more = docs.select("*", *[F.lit(f"{c}!").alias(c) for c in CLASHING])
    key = lambda frame: sorted(map(repr, frame.collect()))
    assert key(run(more)) == key(run(docs))


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - {"op12_source_divergence"}))  # which has no row for a document
def test_queries_answer_every_row(spark, name):
    table = "conversations" if name == "op5_chat_format" else "documents"
    there = spark.read.parquet(f"{SF}/{table}.parquet")
    n = there.select("conv_id").distinct().count() + 1 if table == "conversations" else there.count()
    got = queries.queries()[name](spark, SF).count()
    assert got >= n if name == "op3_mixing" else got == n


def test_mixing_matches_its_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    got, want = queries.queries()["op3_mixing"](spark, SF).toPandas(), con.sql(queries.MIXING_SQL).df()
    key = lambda f: sorted(map(tuple, f[sorted(f.columns)].itertuples(index=False)))
    assert sorted(got.columns) == sorted(want.columns) and key(got) == key(want)
