"""Line dedup, source divergence and the manifest against plain answers, and on the odd cases their modules define."""

import os
import random
import tracemalloc

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import brute
from sparkloom.llm import divergence as sources
from sparkloom.llm import line_dedup as lines
from sparkloom.llm import manifest as merkle
from sparkloom.llm import queries

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def same(got, want):
    assert sorted(map(repr, got)) == sorted(map(repr, want))


SMALL = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
@pytest.mark.parametrize("name", ["op11_line_dedup", "op12_source_divergence", "op13_merkle_manifest"])
def test_queries_match_their_sql(spark, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SMALL}/documents.parquet'")
    got, want = queries.queries()[name](spark, SMALL), con.sql(queries.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    same(map(tuple, got.select(*want.columns).collect()), want.fetchall())


# 11 line dedup


def line_rows(seed, n=80):
    r = random.Random(seed)
    shared = ["Subscribe to our newsletter today", "  ALL rights reserved, worldwide. ", "ÄÖÜ große Überschrift über allem", "short line", "İstanbul'da bir İYİ gün daha geçti", "x" * 20, "y" * 19]
    rows = []
    for i in range(n):
        own = [f"line {i} {k} of this document only" for k in range(r.randint(0, 4))] + r.choices(shared, k=r.randint(0, 5))
        own = [r.choice([x, x.swapcase(), f"\t{x}\x0b", f"{x}\r", f" {x}"]) for x in own] + [""] * r.randint(0, 2)
        r.shuffle(own)
        rows.append((r.choice([i, i, i, 7, None]), "\n".join(own)))
    return [*rows, (200, None), (201, ""), (202, "\n\n"), (203, "Subscribe to our newsletter today\n" * 3000), (204, "z" * 200_000)]


@pytest.mark.parametrize("limits", [{}, {"hot": 3}, {"hot": 0, "most_hot": 2}, {"hot": 10, "least_docs": 2}])
def test_line_dedup(spark, limits):
    rows = line_rows(5)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = brute.line_dedup(rows, least_docs=limits.get("least_docs", 3))
    assert sum(w[2] for w in want) > 50
    same([(*x[:3], x["kept"]) for x in lines.line_dedup(docs, **limits).select("doc_id", "n_lines", "n_dropped", "kept").collect()], want)


def test_line_bitmaps_are_runs(spark):
    same_line = "the same line in each of them"
    text = "\n".join(["a", same_line, same_line, "b", "c", same_line])
    docs = spark.createDataFrame([(i, text) for i in range(3)], "doc_id long, text string")
    got = {r["doc_id"]: r["keep"] and [tuple(x) for x in r["keep"]] for r in lines.line_dedup(docs).collect()}
    assert got[2] is None and [(f, min(n, 9)) for f, n in got[0]] == [(0, 1), (3, 2), (6, 9)]
    marks = lines.keep_bitmaps(docs)
    assert marks.columns == ["id", "t", "dropped", "keep"] and marks.count() == 2


def test_lines_of_one_document_are_not_repeated(spark):
    text = "only this document says this\n" * 5
    docs = spark.createDataFrame([(1, text), (1, text), (2, text), (None, text), (None, text + "x")], "doc_id long, text string")
    assert {r["doc_id"]: r["n_dropped"] for r in lines.line_dedup(docs).collect()} == {1: 5, 2: 0, None: 5}
    assert all(not r["n_dropped"] for r in lines.line_dedup(docs.filter("doc_id = 1")).collect())


def test_line_dedup_keeps_rows_and_columns(spark, odd, none):
    named = odd.withColumn("keep", F.lit(1)).withColumn("t", F.lit("t")).withColumn("row", F.lit(0)).withColumn("text", F.concat("text", F.lit("\nanother line that all of them have")))
    got = lines.without_repeated_lines(named, least_docs=2)
    assert got.columns == named.columns and got.count() == named.count()
    same(got.drop("text").collect(), named.drop("text").collect())
    assert lines.line_dedup(none).count() == 0 and lines.without_repeated_lines(none).count() == 0


def test_line_dedup_runs_in_the_jvm(docs):
    plan = lines.line_dedup(docs)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "MapInArrow"))


# 12 source divergence


@pytest.mark.parametrize("limits", [{}, {"few_groups": 0}, {"most_terms": 3}])
def test_divergence(spark, limits):
    r = random.Random(3)
    words = ["the", "The", "ÀB", "àb", "straße", "x1y", "don't", "é", "naïve", "zz", *[f"w{chr(97 + i)}" for i in range(20)]]
    rows = [(" ".join(r.choices(words, k=r.randint(0, 30))), r.choice(["en", "de", None, ""]), r.choice(["s", "s", "s", "t", "u", None, "v,w"])) for _ in range(120)]
    rows += [(None, "en", "silent"), ("", None, "silent"), ("9 8 !", "fr", "a"), ("one two", "fr", "b"), ("rare", "it", "only")] + [("same words " * 50, "en", "copies")] * 4
    docs = spark.createDataFrame([(i, *x, 1) for i, x in enumerate(rows)], DOCS).repartition(5)
    got = sources.divergence(docs, **limits)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"] and dict(got.dtypes)["value"] == "bigint" and dict(got.dtypes)["rank"] == "int"
    same(map(tuple, got.collect()), brute.divergence(rows, most_terms=limits.get("most_terms", 200)))


def test_divergence_odd_cases(spark, odd, none):
    rows = [(x["text"], x["lang"], x["source"]) for x in odd.collect()]
    same(map(tuple, sources.divergence(odd).collect()), brute.divergence(rows))
    assert sources.divergence(none).count() == 0


def test_counting_takes_a_bounded_part_of_a_workers_memory():
    text = " ".join(f"w{'abcdefghij'[i % 10]} term{'abcdefghij'[i % 7]}" for i in range(2000))
    batch = pa.record_batch({"lang": ["en"] * 1000, "source": [f"s{i % 7}" for i in range(1000)], "text": [text] * 1000})
    tracemalloc.start()
    try:
        rows = sum(out.num_rows for out in sources.counted(iter([batch])))
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert rows and most < 100 << 20, most  # numpy's; a batch of 20 MB has 4 million words


def test_divergence_of_large_counts(spark):
    """Counts that overflow 64 bits when multiplied stay exact."""
    n = 5 * 10**12
    counts = spark.createDataFrame([(n, 2 * n, 3)], "n long, total long, size long")
    assert counts.select(sources.chance(F.col("n"), "total", "size")).first()[0] == 1 + 10**9 * (n + 1) // (2 * n + 3)


def test_slices_cut_between_documents(monkeypatch, spark):
    rows = [("one two three one", "en", f"s{i % 2}", i) for i in range(50)]
    import pyarrow as pa

    batch = pa.RecordBatch.from_pylist([{"text": t, "lang": a, "source": s} for t, a, s, _ in rows])
    for size in (1, 40, 1 << 20):
        found = pa.Table.from_batches(sources.counted(iter([batch]), size)).group_by(["source", "term"]).aggregate([("n", "sum"), ("docs", "sum")]).to_pylist()
        assert {(x["source"], x["term"]): (x["n_sum"], x["docs_sum"]) for x in found if x["term"]} == {(s, w): (50 if w == "one" else 25, 25) for s in ("s0", "s1") for w in ("one", "two", "three")}


# 13 manifest


def tree_rows(case):
    r = random.Random(9)
    text = lambda: "".join(r.choices("aBcÄé ", k=r.randint(0, 12)))
    if case == "many languages":
        return [(i, text(), f"l{i % 75:02d}", "s", i) for i in range(400)]
    if case == "one large":
        return [(i, text(), "en" if i % 9 else r.choice(["de", None, "", "ä", "z"]), r.choice(["s", None]), r.choice([1, None])) for i in range(1300)]
    if case == "ties":
        return [(None, "A", "x", "s", 1)] * 20 + [(5, text(), "x", "s", 1) for _ in range(9)] + [(5, "same", "x", "s", 1)] * 9 + [(6, None, None, None, None)]
    return [(i, text(), "en", "s", 1) for i in range(int(case))]


@pytest.mark.parametrize("case", ["0", "1", "2", "8", "9", "64", "65", "512", "513", "many languages", "one large", "ties"])
def test_manifest(spark, case):
    rows = tree_rows(case)
    got = merkle.manifest(spark.createDataFrame(rows, DOCS).repartition(3))
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    same(map(tuple, got.collect()), brute.manifest(rows))


def test_manifest_notices_only_changes(spark):
    rows = [(i, "ABC" if i % 2 else "abc", "en", "s", 3) for i in range(60)]
    got = {x["doc_id"]: x["verified"] for x in merkle.manifest(spark.createDataFrame(rows, DOCS)).collect()}
    changed = {i for i in range(60) if i % 2 and brute.zlib.crc32(str(i).encode()) % 3 == 0}
    assert changed and {i for i, ok in got.items() if not ok} == changed


def test_manifest_odd_cases(spark, odd):
    rows = [(x["doc_id"], x["text"], x["lang"], x["source"], x["n_chars"]) for x in odd.collect()]
    same(map(tuple, merkle.manifest(odd.withColumn("leaf", F.lit(1)).withColumn("id", F.lit(2))).collect()), brute.manifest(rows))
    long = [(1, "Ab c" * 500_000, "en", "s", None), (2, None, "en", "s", None)]
    same(map(tuple, merkle.manifest(spark.createDataFrame(long, DOCS)).collect()), brute.manifest(long))


def test_a_block_waits_for_all_its_nodes():
    with pytest.raises(RuntimeError, match="heard from 1 nodes"):
        merkle._heard((("t", 0), [(0, 5, "d", None)]))
