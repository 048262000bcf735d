"""Every query with SQL gives what DuckDB gives on the smallest tables."""

import os
import textwrap

import duckdb
import pyarrow.parquet as pq
import pytest

from sparkloom.operators import shards
from sparkloom.plans import catalogue

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = ("documents", "conversations", "events", "pages")


def _rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(tuple("None" if v is None or v != v else str(v) for v in r) for r in frame.astype(object).itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_matches_sql(spark, duck, name):
    got, want = catalogue.queries()[name](spark, SF).toPandas(), duck.sql(catalogue.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert _rows(got) == _rows(want)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_wordwrap_fills_all_documents_as_textwrap(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r["doc_id"]: r["v"] for r in catalogue.queries()["template_wordwrap"](spark, SF).collect()}
    fill = lambda line: "\n".join(textwrap.wrap(line, width=60, expand_tabs=False, replace_whitespace=False))
    assert got == {i: "\n".join(map(fill, t.splitlines())) for i, t in texts.items()}


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", ["shard_by_file_index", "merge_in_order"])
def test_files_are_more_as_a_table_grows(spark, duck, name, monkeypatch, tmp_path):
    """A task that writes a file reads no more of a larger table."""
    monkeypatch.setattr(shards, "FILE_ROWS", 10, raising=False)
    monkeypatch.setattr(catalogue, "_scratch", lambda _: str(tmp_path / "t"))
    got, want = catalogue.queries()[name](spark, SF).toPandas(), duck.sql(catalogue.oracle_sql()[name]).df()
    assert _rows(got) == _rows(want)
    sizes = [pq.ParquetFile(f).metadata.num_rows for f in (tmp_path / "t").rglob("part-*.parquet") if "out" not in f.parts]
    assert sum(sizes) == len(want) and max(sizes) < 30


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_flagship(spark):
    assert catalogue.flagship(spark, SF).count() == spark.read.parquet(f"{SF}/documents.parquet").count()


def test_entry_module_lists_everything():
    import __spark_entry__

    assert set(catalogue.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
