import hashlib
import json
import os
import random

import pandas as pd
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkloom import cli, sources
from sparkloom.functions.values import PlanError
from sparkloom.operators import generate, shards
from sparkloom.plans.config import ConfigError, expand, from_dict
from sparkloom.plans.rewrite import rewrite, validate
from sparkloom.streaming import rewrite_stream

MOCK = """
processors:
  - type: llm
    backend: stub
    server_args: {model_path: some/model, tp_size: 1}
    sampling_params: {temperature: 0.1}
loading_params:
  datasets:
    - {path: $DATA/data.jsonl, type: JSONL, output_dir: $DATA/out/data}
    - path: {train: $DATA/absent/train.jsonl, test: $DATA/absent/test.jsonl}
      type: JSONL
      output_dir: $DATA/out/absent
  num_shards: "4"
  shard_id: $SHARD
  conversations_field: conversations
  batch_size: 64
processing_params:
  inputs: [{name: text, key: text}]
  outputs:
    - name: formatted
      type: llm
      output_type: JSON
      output_schema: [question, answer]
      prompt: "Ask about:\\n{{ text }}"
  remove_columns: True
  output_schema:
    conversations:
      - {role: user, content: "{{ formatted.question }}"}
      - {role: assistant, content: "{{ formatted.answer }}"}
"""


def config(outputs=(), schema=None, inputs=(("text", "text"),), processors=({"type": "llm", "backend": "stub"},), remove=True, **loading):
    return from_dict({
        "processors": list(processors), "loading_params": loading,
        "processing_params": {"inputs": [{"name": n, "key": k} for n, k in inputs], "outputs": list(outputs), "output_schema": schema or {"t": "{{ text }}"}, "remove_columns": remove},
    })


@pytest.fixture
def data(tmp_path, monkeypatch):
    with (tmp_path / "data.jsonl").open("w") as f:
        f.writelines(json.dumps({"text": f"sentence {i % 5}", "a": i}) + "\n" for i in range(103))
    monkeypatch.setenv("DATA", str(tmp_path))
    return tmp_path


def test_run_and_merge_from_the_command_line(spark, data, monkeypatch, capsys):
    path = data / "c.yaml"
    path.write_text(MOCK)
    for i in range(4):
        monkeypatch.setenv("SHARD", str(i))
        with pytest.warns(UserWarning, match="no effect"):
            cli.main(["run", "--config", str(path)])
    assert sorted(os.listdir(data / "out")) == ["data"]
    assert [spark.read.parquet(f"{data}/out/data/shard_{i}").count() for i in range(4)] == [26, 26, 26, 25]
    cli.main(["merge", "--input-dir", f"{data}/out", "--output-dir", f"{data}/merged"])
    assert '"merged": 4' in capsys.readouterr().out
    merged = spark.read.parquet(f"{data}/merged/data")
    assert merged.columns == ["conversations"] and merged.count() == 103
    assert merged.first()["conversations"][0]["content"].startswith("question:")


def test_jsonl_keeps_column_order_and_fails_fast(spark, data):
    df = sources.load(spark, sources.JsonlConfig(str(data / "data.jsonl")))
    assert df.columns == ["text", "a"] and sources.rows(df) == 103
    (data / "bad.jsonl").write_text('{"a": 1}\nnot json\n')
    with pytest.raises(Exception, match="(?i)malformed"):
        sources.load(spark, sources.JsonlConfig(str(data / "bad.jsonl"))).collect()
    loaded = sources.load_all(spark, [sources.JsonlConfig("/none"), sources.JsonlConfig(str(data / "data.jsonl"))])
    assert len(loaded) == 1
    with pytest.raises(sources.LoadError):
        sources.load_all(spark, [sources.JsonlConfig("/none")])


def test_splits_get_all_columns(spark, data):
    (data / "x.jsonl").write_text('{"a": 1, "b": "x"}\n')
    (data / "y.jsonl").write_text('{"b": "y"}\n')
    got = sources.load(spark, sources.JsonlConfig({"x": str(data / "x.jsonl"), "y": str(data / "y.jsonl")}))
    assert set(got["y"].columns) == {"a", "b"} and got["y"].first()["a"] is None


def _save(path, rows, files=2):
    os.makedirs(path)
    names = []
    for i in range(files):
        names.append(f"data-{i:05d}-of-{files:05d}.arrow")
        t = pa.Table.from_pylist(rows[i::files])
        with pa.OSFile(f"{path}/{names[-1]}", "wb") as f, pa.ipc.new_stream(f, t.schema) as w:
            w.write_table(t)
    with open(f"{path}/state.json", "w") as f:
        json.dump({"_data_files": [{"filename": n} for n in names]}, f)


def test_saved_datasets(spark, tmp_path):
    rows = [{"a": i, "s": {"x": str(i)}, "l": [i]} for i in range(10)]
    _save(str(tmp_path / "one"), rows)
    got = sources.load(spark, sources.ArrowDirConfig(str(tmp_path / "one")))
    assert sorted(r["a"] for r in got.select("a").collect()) == list(range(10)) and got.schema["s"].dataType.simpleString() == "struct<x:string>"
    _save(str(tmp_path / "two/train"), rows)
    _save(str(tmp_path / "two/test"), rows[:3], 1)
    (tmp_path / "two/dataset_dict.json").write_text('{"splits": ["train", "test"]}')
    got = sources.load(spark, sources.ArrowDirConfig(str(tmp_path / "two")))
    assert list(got) == ["train", "test"] and got["test"].count() == 3


def test_registries_name_what_they_know():
    assert {"JSONL", "loadable", "parquet"} <= set(sources.LOADERS)
    with pytest.raises(ValueError, match="JSONL"):
        sources.loaders.named("nope")
    with pytest.raises(ValueError, match="llm"):
        generate.named("nope")


@settings(max_examples=12, deadline=None)
@given(n=st.integers(0, 40), k=st.integers(1, 9), parts=st.integers(1, 4), layout=st.sampled_from(["contiguous", "strided"]))
def test_shards_partition_the_rows(spark, n, k, parts, layout):
    df = spark.range(0, n, 1, parts).select(F.col("id").alias("x"))
    got = {r["x"]: r["s"] for r in shards.with_shard(df, k, layout).select("x", F.col(shards.SHARD).alias("s")).collect()}
    each, more = divmod(n, k)
    bounds = [each * i + min(i, more) for i in range(k + 1)]
    want = {x: x % k if layout == "strided" else next(i for i in range(k) if bounds[i] <= x < bounds[i + 1]) for x in range(n)}
    assert got == want


@pytest.mark.parametrize("layout", ["contiguous", "strided"])
def test_ordered_shards_of_wide_rows_lose_nothing(spark, layout):
    """Shards are made by separate jobs; shuffles may be coalesced otherwise in each."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        wide = [F.lit(f"{k}" * 500).alias(f"c{k}") for k in range(5)]
        df = spark.range(7000).select((F.col("id") * 7919 % 7000).alias("id"), F.lit("mine").alias("__id"), F.lit(1).alias("__shard"), F.lit(2).alias("__position"), *wide)
        parts = [shards.shard(df, 3, i, layout, "id") for i in range(3)]
        ids = [sorted(r["id"] for r in p.select("id").collect()) for p in parts]
        want = [list(range(i, 7000, 3)) for i in range(3)] if layout == "strided" else [list(range(2334)), list(range(2334, 4667)), list(range(4667, 7000))]
        assert ids == want
        whole = shards.concat(parts)
        assert whole.columns == df.columns and whole.exceptAll(df).isEmpty() and whole.count() == 7000
        with pytest.raises(ValueError, match="name others"):
            shards.with_shard(df, 3)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_shards_by_a_column_with_ties_nulls_and_repeats(spark):
    r = random.Random(1)
    rows = [(r.choice([None, "a", "b", "a", "c"]), r.randint(0, 3), {"k": r.randint(0, 2)}) for _ in range(500)] + [("a", 7, None)] * 200
    df = spark.createDataFrame(rows, "s string, n int, m map<string,int>").repartition(5)
    got = shards.with_shard(df, 4, order="s", position_col="at", shard_col="part").collect()
    assert sorted(x["at"] for x in got) == list(range(700))
    assert [x["s"] or "" for x in sorted(got, key=lambda x: x["at"])] == sorted(s or "" for s, *_ in rows)
    for by in (None, "s"):  # after a shuffle too, each row is in one shard
        made = df.groupBy("s", "n").count()
        assert sorted(map(tuple, shards.concat([shards.shard(made, 3, i, order=by) for i in range(3)]).collect()), key=repr) == sorted(map(tuple, made.collect()), key=repr)


def test_shard_merge_is_identity(spark, tmp_path):
    df = spark.range(0, 50, 1, 3).withColumn("s", F.col("id").cast("string"))
    for i in range(7):
        shards.write_shard(spark, {"train": shards.shard(df, 7, i), "test": df.limit(i)}, f"{tmp_path}/in/d", i, 7)
    os.makedirs(tmp_path / "in/d/shard_x")
    report = shards.merge(spark, f"{tmp_path}/in", f"{tmp_path}/out")
    assert report["d"]["missing"] == [] and report["d"]["not_found"] == 1
    assert sorted(spark.read.parquet(f"{tmp_path}/out/d/train").collect()) == sorted(df.collect())
    assert spark.read.parquet(f"{tmp_path}/out/d/test").count() == 21
    with pytest.raises(ValueError, match="of 7"):
        shards.write_shard(spark, df, f"{tmp_path}/in/d", 0, 5)


def test_merge_reports_and_errors(spark, tmp_path):
    df = spark.range(3)
    for i in (0, 2, 10):
        df.write.parquet(f"{tmp_path}/root/shard_{i}")
    df.limit(0).write.parquet(f"{tmp_path}/root/shard_3")
    assert shards.shard_dirs(spark, f"{tmp_path}/root") == ["shard_0", "shard_2", "shard_3", "shard_10"]
    report = shards.merge(spark, f"{tmp_path}/root", f"{tmp_path}/whole")[""]
    assert (report["merged"], report["empty"], report["missing"][:2]) == (3, 1, [1, 4])
    with pytest.raises(RuntimeError, match="no shards"):
        shards.merge(spark, f"{tmp_path}/whole", f"{tmp_path}/x")
    with pytest.raises(RuntimeError, match="is bigint and string"):
        shards.concat([df, df.select(F.col("id").cast("string"))])
    with pytest.raises(RuntimeError, match="splits"):
        shards.concat_datasets([df, {"a": df}])
    with pytest.raises(RuntimeError):
        shards.concat_datasets([])


def test_null_inputs_stop_the_run_even_unused(spark):
    df = spark.createDataFrame([("a", 1), ("b", None)], "text string, n int")
    plan = rewrite(df, config(inputs=(("text", "text"), ("n", "n"))))
    with pytest.raises(Exception, match="input 'n'"):
        plan.count()
    assert rewrite(df, config()).count() == 2


def test_keep_or_drop_columns(spark):
    df = spark.createDataFrame([("a", 1)], "text string, n int")
    kept = rewrite(df, config(schema={"n": "{{ text }}", "z": ["{{ text }}"]}, remove=False))
    assert kept.first().asDict() == {"text": "a", "n": "a", "z": ["a"]}
    assert rewrite(df, config()).columns == ["t"]


def test_outputs_in_order(spark):
    one, two = {"name": "a", "type": "llm", "prompt": "{{ text }}"}, {"name": "b", "type": "llm", "prompt": "{{ a }}"}
    validate(config([one, two]).processing_params)
    with pytest.raises(PlanError, match="'b' needs a"):
        validate(config([two, one]).processing_params)
    with pytest.raises(PlanError, match="no processor"):
        rewrite(spark.createDataFrame([("a",)], "text string"), config([one], processors=()))
    with pytest.raises(PlanError, match="output_schema"):
        config([one | {"output_type": "JSON"}])


@pytest.mark.parametrize(("text", "ok"), [('{"q": "x"}', True), ("{}", True), ("", True), ("not json", False), ('{"z": "x"}', False)])
def test_json_is_checked(spark, text, ok):
    """A backend's JSON must parse and have the schema's keys; an empty answer is an empty object."""
    df = spark.createDataFrame([("x", text)], "text string, answer string")
    var = generate.LLMVar("a", "llm", "{{ text }}", ["q"], "JSON")
    made = generate.parsed(F.col("answer"), var)
    got = df.select(made.col.getField("q").alias("q"))
    if ok:
        assert got.first()["q"] == ("x" if "q" in text else None)
    else:
        with pytest.raises(Exception, match="(?i)malformed|keys are missing|parse"):
            got.collect()


def test_each_row_is_generated_once(spark, tmp_path):
    """Both fields are read, and the second variable reads the first, yet each prompt is asked for once."""
    one = {"name": "a", "type": "llm", "prompt": "{{ text }}", "output_type": "JSON", "output_schema": ["q", "r"]}
    two = {"name": "b", "type": "llm", "prompt": "{{ a.q }}{{ a.r }}"}
    plan = rewrite(spark.createDataFrame([("x",)], "text string"), config([one, two], {"q": "{{ a.q }}", "r": "{{ a.r }}{{ a.q }}", "b": "{{ b }}{{ b }}"}))
    assert plan._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 2


def test_count_mismatch_is_an_error():
    import pandas as pd

    class Short:
        def generate(self, prompts, params):
            return []

    generate.BACKENDS["short"] = Short
    try:
        with pytest.raises(RuntimeError, match="0 texts for 2"):
            list(generate.stage("short", {}, {}, 2)(iter([pd.Series(["a", "b", "c"])])))
    finally:
        generate.BACKENDS.pop("short")


def test_prompts_become_pythons_a_piece_at_a_time():
    import pyarrow as pa

    seen = []

    def run(prompts):
        for p in prompts:
            seen.append(len(p))
            yield p.map(str.upper) if len(p) else p

    batches = [pa.array([f"p{i}" for i in range(n)], pa.string()) for n in (7, 0, 3, 1)]
    got = list(generate.in_pieces(run, 3)(iter(batches)))
    assert [g.to_pylist() for g in got] == [[x.upper() for x in b.to_pylist()] for b in batches]
    assert seen == [3, 3, 1, 0, 3, 1]


def test_config(monkeypatch):
    monkeypatch.setenv("X", "5")
    assert expand({"$X": ["$X", "$UNSET_NAME", 3]}) == {"$X": ["5", "$UNSET_NAME", 3]}
    assert from_dict(None).loading_params.num_shards == 1
    assert from_dict({"loading_params": {"num_shards": "3", "shard_id": "2", "batch_size": 0}}).loading_params.batch_size == 1
    for bad in ({"num_shards": 0}, {"num_shards": "0"}, {"shard_id": 1}, {"num_shards": "x"}):
        with pytest.raises(ConfigError):
            from_dict({"loading_params": bad})
    with pytest.raises(ConfigError, match="known: JSONL"):
        from_dict({"loading_params": {"datasets": [{"type": "csv", "path": "x"}]}})
    with pytest.raises(ConfigError, match="lacks path"):
        from_dict({"loading_params": {"datasets": [{"type": "JSONL"}]}})
    with pytest.warns(UserWarning, match="left out"):
        made = from_dict({"processors": [{"type": "llm", "sampling_params": {"t": 1}, "odd": 1}]})
    assert made.processors[0].default_sampling_params == {"t": 1}


def test_streams(spark, data, tmp_path):
    spark.read.json(str(data / "data.jsonl")).repartition(3).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("a long, text string").parquet(f"{tmp_path}/in")
    q = rewrite_stream(stream, config([{"name": "g", "type": "llm", "prompt": "{{ text }}"}], {"v": "{{ g }}!"}), f"{tmp_path}/out", f"{tmp_path}/check", availableNow=True)
    assert q.awaitTermination(120)
    assert spark.read.parquet(f"{tmp_path}/out").count() == 103
    with pytest.raises(ValueError):
        rewrite_stream(spark.range(1), config(), "x", "y")


def test_streams_are_refused_as_tables(spark, monkeypatch):
    monkeypatch.setitem(sources.LOADERS, "rate", sources.loaders.Loader(sources.ParquetConfig, lambda s, c: s.readStream.format("rate").load()))
    with pytest.raises(RuntimeError, match="streaming"):
        sources.load(spark, sources.ParquetConfig("x", type="rate"))


def test_a_processor_without_a_backend_is_an_error(spark):
    raw = {"processors": [{"type": "llm", "server_args": {"model_path": "m"}}], "processing_params": {"inputs": [{"name": "x", "key": "x"}], "output_schema": {"y": "{{ x }}"}}}
    with pytest.raises(PlanError, match="needs a backend"):
        rewrite(spark.createDataFrame([("a",)], "x string"), from_dict(raw))


class Flaky:
    """Fails twice, then answers with its settings and the prompt."""

    calls = 0

    def __init__(self, **server):
        self.server = server

    def generate(self, prompts, params):
        Flaky.calls += 1
        if Flaky.calls <= 2:
            raise OSError("not yet")
        return [f"{self.server['model_path']}/{self.server['tp_size']}/{self.server['apply_chat_template']}/{p}" for p in prompts]


def test_model_settings_retries_and_chat_templates():
    generate.BACKENDS["flaky"] = Flaky
    try:
        config = generate.LLMConfig(backend="flaky", server_args={"model_path": "m", "tp_size": 2, "backend_args": {"more": 1}})
        assert config.options() == {"model_path": "m", "tp_size": 2, "apply_chat_template": True, "more": 1}
        run = generate.stage("flaky", config.options(), {}, 3, retries=2, in_flight=1, wait=0.01)
        got = list(run(iter([pd.Series([str(i) for i in range(8)]), pd.Series([], dtype=object)])))
        assert got[0].tolist() == [f"m/2/True/{i}" for i in range(8)] and not len(got[1])
        Flaky.calls = 0
        with pytest.raises(OSError, match="not yet"):
            list(generate.stage("flaky", config.options(), {}, 3, retries=1, in_flight=1, wait=0.01)(iter([pd.Series(["a"])])))
        many = generate.stage("stub", {}, {}, 2, in_flight=5)
        assert list(many(iter([pd.Series(list("abcdefg"))])))[0].tolist() == [hashlib.md5(c.encode()).hexdigest() for c in "abcdefg"]
    finally:
        del generate.BACKENDS["flaky"]


def test_prompts_by_a_chat_template(spark):
    template = "{% for m in messages %}<|{{ m.role }}|>{{ m.content }}<|end|>{% endfor %}{% if add_generation_prompt %}<|assistant|>{% endif %}"
    raw = {
        "processors": [{"type": "llm", "backend": "stub", "chat_template": template}],
        "processing_params": {"inputs": [{"name": "x", "key": "x"}], "outputs": [{"name": "a", "type": "llm", "prompt": "Say {{ x }}"}], "output_schema": {"y": "{{ a }}"}, "remove_columns": True},
    }
    got = rewrite(spark.createDataFrame([("é",)], "x string"), from_dict(raw)).first()["y"]
    assert got == hashlib.md5("<|user|>Say é<|end|><|assistant|>".encode()).hexdigest()


def test_saved_datasets_are_written_read_and_merged(spark, tmp_path):
    df = spark.range(50).select(F.col("id"), F.concat(F.lit("t"), "id").alias("t"), F.array("id", F.lit(None)).alias("a"), F.struct(F.lit(1.5).alias("x")).alias("s")).repartition(4)
    for i in range(3):
        shards.write_shard(spark, {"train": shards.shard(df, 3, i, order="id"), "test": df.limit(i)}, f"{tmp_path}/in/d", i, 3, "loadable")
    shards.merge(spark, f"{tmp_path}/in", f"{tmp_path}/out", "loadable")
    whole = sources.load(spark, sources.ArrowDirConfig(f"{tmp_path}/out/d"))
    key = lambda t: sorted(map(repr, t.collect()))
    assert set(whole) == {"train", "test"} and key(whole["train"]) == key(df) and whole["test"].count() == 3
    # written again, a folder holds the new rows only; without rows it keeps the columns
    shards.write_shard(spark, df.limit(0), f"{tmp_path}/again", 0, 1, "loadable")
    empty = shards.read_shard(spark, f"{tmp_path}/again/shard_0")
    assert empty.count() == 0 and empty.columns == df.columns
    shards.write_shard(spark, df, f"{tmp_path}/again", 0, 1, "loadable")
    assert key(shards.read_shard(spark, f"{tmp_path}/again/shard_0")) == key(df)
    with pytest.raises(ConfigError, match="output_format"):
        from_dict({"loading_params": {"output_format": "csv"}})
