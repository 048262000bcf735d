"""Shard indexes, merging in order, and shards that several jobs write."""

import json
import threading

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import shard_index, shards
from sparkloom.plans.config import from_dict
from sparkloom.plans.rewrite import run


@pytest.fixture
def uneven(spark, tmp_path):
    """A Parquet folder of files of 3, 200, 0, 40 and 90 rows."""
    path, start = str(tmp_path / "t"), 0
    for i, n in enumerate((3, 200, 0, 40, 90)):
        spark.range(start, start + n, 1, 1).select(F.col("id").alias("i"), F.repeat(F.lit("x"), (F.col("id") % 50).cast("int")).alias("t")).write.mode("append").parquet(f"{tmp_path}/f{i}")
        part = next((tmp_path / f"f{i}").glob("*.parquet"))
        (tmp_path / "t").mkdir(exist_ok=True)
        part.rename(tmp_path / "t" / f"part-{i:05d}.parquet")
        start += n
    (tmp_path / "t" / "_SUCCESS").touch()
    return path


def numbers(df):
    return [r["i"] for r in df.collect()]


@pytest.mark.parametrize("k", [1, 2, 7, 333, 400])
def test_file_shards(spark, uneven, k):
    index, df = shards.file_index(spark, uneven), spark.read.parquet(uneven)
    assert index.total == 333
    for i in {0, 1 % k, k // 2, k - 1}:
        part = shards.shard(df, k, i, index=index)
        assert part.columns == df.columns and sorted(numbers(part)) == list(range(*shards.span(333, k, i)))
    strided = shards.shard(df, 4, 1, "strided", index=index)
    assert sorted(numbers(strided)) == list(range(1, 333, 4))


def test_a_file_shard_reads_only_its_files(spark, uneven):
    index, df = shards.file_index(spark, uneven), spark.read.parquet(uneven)
    part = shards.shard(df, 10, 9, index=index)  # positions 300 to 332 are in the last file
    assert [f.rsplit("/", 1)[1] for f in part.inputFiles()] == ["part-00004.parquet"]
    assert "Exchange hash" not in part._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("kind", ["long", "string", "double", "timestamp", "date"])
def test_key_shards(spark, kind):
    value = {"long": "id % 7", "string": "concat('v', id % 7)", "double": "(id % 7) / 3", "timestamp": "timestamp_seconds((id % 7) * 1000 + 0.123456)", "date": "date_add(date'2024-01-01', cast(id % 7 as int))"}[kind]
    df = spark.range(400).select(F.col("id").alias("i"), F.expr(f"if(id % 11 = 0, null, {value})").alias("v")).repartition(5)
    index = shard_index.KeyIndex.from_json(shard_index.KeyIndex.of(df, "v").to_json())
    assert len(index.counts) > 2 and index.total == 400
    whole = shards.with_shard(df, 6, index=index).collect()
    order = sorted(whole, key=lambda r: r[shards.POSITION])
    assert [r[shards.POSITION] for r in order] == list(range(400))
    assert [r["v"] for r in order] == sorted((r["v"] for r in order), key=lambda v: (v is not None, v) if v is not None else (False,))
    for i in range(6):
        assert sorted(numbers(shards.shard(df, 6, i, index=index))) == sorted(r["i"] for r in whole if r[shards.SHARD] == i)


def test_a_key_shard_filters_before_it_shuffles(spark, tmp_path):
    spark.range(5000).select(F.col("id").alias("i"), F.col("id").alias("v")).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    index = shards.key_index(df, "v")
    plan = shards.shard(df, 100, 50, index=index)._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.index("Exchange ") :]  # of the one range that the shard lies in
    assert "Filter" in below and "GreaterThanOrEqual(v," in plan and "LessThanOrEqual(v," in plan
    assert sorted(numbers(shards.shard(df, 100, 50, index=index))) == list(range(2500, 2550))


def test_jobs_count_once(spark, uneven, tmp_path, monkeypatch):
    """The first of N jobs leaves the index; the others count nothing."""
    built = []
    for cls in (shard_index.FileIndex, shard_index.KeyIndex):
        monkeypatch.setattr(cls, "of", classmethod(lambda c, *a, f=cls.of.__func__, **k: built.append(c.__name__) or f(c, *a, **k)))
    base = {"processing_params": {"inputs": [{"name": "i", "key": "i"}], "output_schema": {"j": "{{ i }}"}, "remove_columns": True}}
    for order in (None, "i"):
        out = str(tmp_path / f"out-{order}")
        for i in range(5):
            loading = {"datasets": [{"type": "parquet", "path": uneven, "output_dir": out}], "num_shards": 5, "shard_id": i} | ({"order": order} if order else {})
            run(spark, from_dict(base | {"loading_params": loading}))
        shards.merge(spark, out, f"{out}-merged")
        assert [r["j"] for r in spark.read.parquet(f"{out}-merged").orderBy("j").collect()] == list(range(333))
    assert built == ["FileIndex", "KeyIndex"]
    with pytest.raises(ValueError, match="another table"):
        shards.file_index(spark, f"{tmp_path}/f1", f"{tmp_path}/out-None/_index.json")


def test_merged_parquet_is_in_shard_order(spark, uneven, tmp_path):
    df = shards.in_order(spark, uneven)
    assert numbers(df) == list(range(333)) and numbers(shards.in_order(spark, uneven, most_files=2)) == list(range(333))
    sizes = (150, 3, 100, 80)
    for i, at in enumerate((0, 150, 153, 253)):
        shards.write_shard(spark, df.filter(F.col("i").between(at, at + sizes[i] - 1)), str(tmp_path / "in"), i, 4)
    shards.merge(spark, str(tmp_path / "in"), str(tmp_path / "merged"))
    assert numbers(shards.read_shard(spark, str(tmp_path / "merged"))) == list(range(333))
    index = shards.file_index(spark, str(tmp_path / "merged"))
    placed = index.numbered(spark.read.parquet(str(tmp_path / "merged")), "position").collect()
    assert all(r["i"] == r["position"] for r in placed) and len(placed) == 333


def test_of_two_launches_with_other_numbers_one_is_refused(spark, tmp_path):
    out, failed, barrier = str(tmp_path / "o"), [], threading.Barrier(4)

    def launch(n):
        barrier.wait()
        try:
            shards.write_shard(spark, spark.range(n).coalesce(1), out, 0, n)
        except ValueError:
            failed.append(n)

    threads = [threading.Thread(target=launch, args=(n,)) for n in (2, 3, 4, 5)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    there = json.loads((tmp_path / "o" / shards.MANIFEST).read_text())["num_shards"]
    assert sorted([*failed, there]) == [2, 3, 4, 5] and spark.read.parquet(f"{out}/shard_0").count() == there
    assert not [p.name for p in (tmp_path / "o").iterdir() if p.name.startswith(("_writing", "_old")) or p.suffix == ".tmp"]


def test_a_shard_that_two_jobs_write_is_one_of_theirs(spark, tmp_path):
    out = str(tmp_path / "o")
    threads = [threading.Thread(target=lambda n=n: shards.write_shard(spark, spark.range(n).repartition(3), out, 1, 2)) for n in (10, 20, 30)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert spark.read.parquet(f"{out}/shard_1").count() in (10, 20, 30) and shards.shard_dirs(spark, out) == ["shard_1"]
    assert not list((tmp_path / "o" / "shard_1").glob("_writing*"))


def test_a_failed_write_leaves_the_old_shard(spark, tmp_path):
    out = str(tmp_path / "o")
    shards.write_shard(spark, spark.range(4), out, 0, 1)
    with pytest.raises(Exception, match="stop"):
        shards.write_shard(spark, spark.range(9).filter(F.raise_error(F.lit("stop")).cast("boolean")), out, 0, 1)
    assert spark.read.parquet(f"{out}/shard_0").count() == 4 and not list((tmp_path / "o").glob("_writing*"))
