"""Saved datasets read in parts and by column."""

import json

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparkloom import sources
from sparkloom.functions.paths import root_fields
from sparkloom.plans.config import from_dict
from sparkloom.plans.rewrite import run
from sparkloom.sources import arrow_dir


@pytest.fixture
def foreign(tmp_path):
    """One large file of another writer, with batches of 100 rows."""
    table = pa.table({"i": pa.array(range(5000), pa.int64()), "t": [f"text {i} " * (i % 30) for i in range(5000)], "l": [[i, i + 1] for i in range(5000)]})
    with pa.OSFile(str(tmp_path / "data-00000-of-00001.arrow"), "wb") as f, pa.ipc.new_stream(f, table.schema) as out:
        out.write_table(table, max_chunksize=100)
    (tmp_path / "state.json").write_text(json.dumps({"_data_files": [{"filename": "data-00000-of-00001.arrow"}]}))
    return str(tmp_path)


def load(spark, path, **more):
    return sources.load(spark, sources.ArrowDirConfig(path, **more))


def test_ends_of_batches_are_found_in_headers(foreign):
    path = arrow_dir.files(foreign)[0]
    with pa.OSFile(path) as f:
        ends = arrow_dir.batch_ends(f)
    assert len(ends) == 50 and sorted(ends) == ends and ends[-1] < pa.OSFile(path).size()
    dictionary = pa.table({"d": pa.array(["a", "b", "a"]).dictionary_encode()})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, dictionary.schema) as out:
        out.write_table(dictionary)
    assert arrow_dir.batch_ends(pa.BufferReader(sink.getvalue())) is None


@pytest.mark.parametrize("split", [1, 10_000, 100_000, 1 << 30])
def test_a_large_file_is_read_in_parts(spark, foreign, split):
    df = load(spark, foreign, split_bytes=split)
    parts = df.select(F.spark_partition_id().alias("p"), "i", "t", F.col("l")[1].alias("n")).collect()
    assert [(r["i"], r["t"], r["n"]) for r in parts] == [(i, f"text {i} " * (i % 30), i + 1) for i in range(5000)]  # in order, each once
    n = len({r["p"] for r in parts})
    assert n == {1: 50, 1 << 30: 1}.get(split, n) and (split > 10**6 or n > 3)


def test_own_files_say_where_batches_end(spark, foreign, tmp_path):
    out = str(tmp_path / "own")
    arrow_dir.write(load(spark, foreign).withColumn("t", F.repeat("t", 100)).coalesce(1), out)
    noted = arrow_dir.noted_ends(out)
    assert [len(v) > 1 for v in noted.values()] == [True]
    df = load(spark, out, split_bytes=8 << 20)
    assert df.rdd.getNumPartitions() > 1 and [r["i"] for r in df.select("i").collect()] == list(range(5000))


def test_batches_are_small_however_many_rows_come_at_a_time(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(arrow_dir, "BATCH_BYTES", 10_000, raising=False)
    table = pa.table({"i": list(range(3000)), "t": ["x" * (i % 40) for i in range(3000)]})
    writer = arrow_dir._Writer(str(tmp_path / "w"), None, True)
    writer._stream("data-0.arrow", table.schema, iter(table.to_batches()))
    with pa.ipc.open_stream(pa.OSFile(str(tmp_path / "w" / "data-0.arrow"))) as f:
        sizes = [b.nbytes for b in f]
    assert len(sizes) > 5 and max(sizes) < 20_000
    with pa.OSFile(str(tmp_path / "w" / "data-0.arrow"), "wb") as f, pa.ipc.new_stream(f, table.schema) as out:
        out.write_table(table)  # one batch, as another writer may have made it
    reader = arrow_dir.ArrowDir({"path": str(tmp_path / "w")})
    read = list(reader.reader(reader.schema()).read(arrow_dir._Part(arrow_dir.files(str(tmp_path / "w"))[0])))
    assert max(b.nbytes for b in read) < 20_000 and pa.Table.from_batches(read).equals(table)


def test_only_named_columns_are_decoded(spark, foreign):
    for split in (None, 10_000):
        df = load(spark, foreign, columns=["l", "i"], split_bytes=split)
        assert df.columns == ["i", "l"] and [tuple(r) for r in df.limit(2).collect()] == [(0, [0, 1]), (1, [1, 2])]
    reader = arrow_dir.ArrowDir({"path": foreign, "columns": '["i"]'})
    part = next(iter(reader.reader(reader.schema()).read(arrow_dir._Part(arrow_dir.files(foreign)[0]))))
    assert part.schema.names == ["i"]


def test_a_plan_asks_for_the_columns_it_reads(spark, foreign, tmp_path, monkeypatch):
    asked = []
    monkeypatch.setattr(arrow_dir._Reader, "__init__", lambda self, path, schema, split, f=arrow_dir._Reader.__init__: asked.append(schema.names) or f(self, path, schema, split))
    loaded = []
    from sparkloom.sources import loaders

    entry = loaders.LOADERS["loadable"]
    monkeypatch.setitem(loaders.LOADERS, "loadable", loaders.Loader(entry.config, lambda s, c: loaded.append(c.columns) or entry.load(s, c)))
    raw = {
        "loading_params": {"datasets": [{"type": "loadable", "path": foreign, "output_dir": str(tmp_path / "out")}]},
        "processing_params": {"inputs": [{"name": "n", "key": "l[1]"}], "output_schema": {"n": "{{ n }}"}, "remove_columns": True},
    }
    run(spark, from_dict(raw))
    assert loaded == [["l"]] and spark.read.parquet(f"{tmp_path}/out/shard_0").agg(F.sum("n")).first()[0] == sum(range(1, 5001))


def test_fields_that_a_path_reads():
    cases = {"a": {"a"}, "a.b[0].c": {"a"}, "a[?b == `1`].c": {"a"}, "a || b.c": {"a", "b"}, "{x: a, y: [b, 'z']}": {"a", "b"}, "join(',', a[*].b)": {"a"}, "max_by(a, &b).c": {"a"}, "a | b": {"a"}, "!a && `1`": {"a"}, "@": None, "keys(@)": None, "*": None, "[a, @.b]": None}
    assert {p: root_fields(p) for p in cases} == cases
