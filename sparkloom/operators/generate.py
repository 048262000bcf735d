"""Derived variables: processors by type name, and text generation behind pluggable backends.

A generator stage is one Arrow-batched function over the prompts, and only they
travel to Python: batches of ``batch_size`` prompts go to the backend, ``in_flight`` of them
at a time in each task, and it must give one text for each. A failed batch is asked for again,
``retries`` times, after waiting twice as long each time. What it made should be written once (a sink or a
checkpoint) before it is used more than once, for a second action would generate
again.

A backend is an object of the worker, started once and shared by its tasks. Where it is a model that needs a whole executor or a
GPU, ``resources`` asks for them for this stage alone (``{"cpus": 8, "gpu": 1}`` for each task), so one
task, and one engine, has an executor to itself and keeps it busy with ``in_flight`` batches. With a ``log_dir``, finished batches are
kept there until the folder is deleted, and a task that is tried again doesn't ask for them again.
"""

from __future__ import annotations

import hashlib
import json
import time
import urllib.request
from collections import Counter, deque
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from typing import Any, Protocol

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.functions import templates
from sparkloom.functions.paths import compile_path
from sparkloom.functions.values import PlanError, Value, array, described, from_description, is_mixed, literal, struct
from sparkloom.operators import engines
from sparkloom.operators.shards import free_name

#: The struct columns that hold the variables and the source's row while a table is rewritten, so that no two names can meet.
VARIABLES, ROW = "__variables", "__row"


class Backend(Protocol):
    def generate(self, prompts: Sequence[str], params: dict[str, Any]) -> list[str]:
        """One text for each prompt."""


class StubBackend:
    """Deterministic texts, for tests: the prompt's MD5, or an object with it in each field of the schema."""

    def __init__(self, **server: Any):
        self.server = server

    def generate(self, prompts: Sequence[str], params: dict[str, Any]) -> list[str]:
        fields = list((params.get("json_schema") or {}).get("properties", {}))
        digest = [hashlib.md5(p.encode()).hexdigest() for p in prompts]
        return [json.dumps({f: f"{f}:{d}" for f in fields}) for d in digest] if fields else digest


class HttpBackend:
    """An endpoint that takes ``{"prompts": [...], "params": {...}, "server_args": {...}}`` and gives ``{"texts": [...]}``.

    ``server_args`` are the model's settings of the configuration (``model_path``, ``tp_size`` and so on), and
    ``apply_chat_template``: whether the endpoint is to wrap each prompt as a user's message by the model's own template.
    """

    def __init__(self, url: str, timeout: float = 600, **server: Any):
        self.url, self.timeout, self.server = url, timeout, server

    def generate(self, prompts: Sequence[str], params: dict[str, Any]) -> list[str]:
        body = json.dumps({"prompts": list(prompts), "params": params, "server_args": self.server}).encode()
        request = urllib.request.Request(self.url, body, {"Content-Type": "application/json"})
        with urllib.request.urlopen(request, timeout=self.timeout) as answer:
            return json.load(answer)["texts"]


#: Backends by name. They get ``backend_args`` and all other ``server_args`` as keywords, and must bear calls from several threads.
BACKENDS: dict[str, Callable[..., Backend]] = {"stub": StubBackend, "http": HttpBackend}


@dataclass
class LLMConfig:
    type: str = "llm"
    backend: str | None = None
    server_args: dict[str, Any] = field(default_factory=dict)
    default_sampling_params: dict[str, Any] = field(default_factory=dict)
    chat_template: str | None = None  # over ``messages`` and ``add_generation_prompt``; without it the backend applies the model's
    retries: int = 3
    in_flight: int = 4
    log_dir: str | None = None  # a folder that all workers reach, for the answers of finished batches
    resources: dict[str, float] = field(default_factory=dict)  # of each task of the generating stage: ``cpus`` and others by name

    def options(self) -> dict[str, Any]:
        own = {k: v for k, v in self.server_args.items() if k != "backend_args"}
        return own | {"apply_chat_template": self.chat_template is None} | dict(self.server_args.get("backend_args") or {})


@dataclass
class OutputVar:
    """A derived variable."""

    name: str
    type: str

    def needs(self) -> set[str]:
        raise NotImplementedError

    def is_computable(self, names: set[str]) -> bool:
        return self.needs() <= names


@dataclass
class LLMVar(OutputVar):
    prompt: str = ""
    output_schema: list[str] = field(default_factory=list)
    output_type: str = "plain"

    def needs(self) -> set[str]:
        return templates.free_variables(self.prompt)

    @property
    def is_json(self) -> bool:
        return self.output_type == "JSON"

    def struct_type(self) -> T.StructType:
        if not self.output_schema:
            raise PlanError(f"variable {self.name!r}: JSON output needs an output_schema")
        return T.StructType([T.StructField(f, T.StringType()) for f in self.output_schema])

    def json_schema(self) -> dict[str, Any]:
        return {"type": "object", "properties": {f: {"type": "string"} for f in self.output_schema}, "required": list(self.output_schema)}


@dataclass
class ExprVar(OutputVar):
    """An addition of ours: a variable derived by a template or a path, without generation."""

    template: str | None = None
    key: str | None = None

    def needs(self) -> set[str]:
        return templates.free_variables(self.template) if self.template is not None else set()


class Processor(Protocol):
    def apply(self, df: DataFrame, var: Any) -> DataFrame:
        """``df`` with the variable added to its struct of variables."""


@dataclass(frozen=True)
class Entry:
    processor: Callable[..., Processor]
    config: type
    output_var: type


PROCESSORS: dict[str, Entry] = {}


def processor(name: str, config: type, output_var: type):
    """Registers a processor class under a type name; returns the class."""

    def add(cls):
        PROCESSORS[name] = Entry(cls, config, output_var)
        return cls

    return add


def named(name: str) -> Entry:
    if name not in PROCESSORS:
        raise ValueError(f"unknown processor type {name!r}; known: {', '.join(sorted(PROCESSORS))}")
    return PROCESSORS[name]


#: Where a field of the variables says which types a VARIANT in it may have.
_TYPE = "type"


def named_fields(values: dict[str, Value]) -> Column:
    """The variables as one struct; the types of mixed ones go along with the fields."""
    made = [v.col.alias(k, metadata={_TYPE: json.dumps(described(v.type))}) if is_mixed(v.type) else v.col.alias(k) for k, v in values.items()]
    return F.struct(*made)


def variables(df: DataFrame) -> dict[str, Value]:
    kind = df.schema[VARIABLES].dataType
    known = {f.name: from_description(json.loads(f.metadata[_TYPE])) if _TYPE in f.metadata else f.dataType for f in kind.fields}
    return {name: Value(F.col(VARIABLES).getField(name), t) for name, t in known.items()}


def with_variable(df: DataFrame, name: str, value: Value) -> DataFrame:
    return df.withColumn(VARIABLES, named_fields({k: v for k, v in variables(df).items() if k != name} | {name: value}))


@processor("llm", LLMConfig, LLMVar)
class LLMProcessor:
    def __init__(self, config: LLMConfig, batch_size: int = 64):
        if config.backend is None:
            raise PlanError(f"a processor of type {config.type!r} needs a backend; known: {', '.join(sorted(BACKENDS))}")
        if config.backend not in BACKENDS:
            raise ValueError(f"unknown backend {config.backend!r}; known: {', '.join(sorted(BACKENDS))}")
        self.config, self.batch_size = config, batch_size

    def apply(self, df: DataFrame, var: LLMVar) -> DataFrame:
        params = dict(self.config.default_sampling_params)
        kind: T.DataType = T.StringType()
        if var.is_json:
            kind, params["json_schema"] = var.struct_type(), var.json_schema()
        c = self.config
        run = stage(c.backend, c.options(), params, self.batch_size, c.retries, c.in_flight, log=c.log_dir and (c.log_dir, var.name))
        text, prompt = free_name(df, "__text"), self._prompt(templates.render(var.prompt, variables(df)))
        if c.resources:
            made = _with_resources(df, text, prompt, in_pieces(run, 16 * self.batch_size), c.resources)
        else:  # not deterministic, so no later projection may evaluate it twice
            made = df.withColumn(text, F.arrow_udf(in_pieces(run, 16 * self.batch_size), T.StringType()).asNondeterministic()(prompt))
        value = parsed(F.col(text), var) if var.is_json else Value(F.coalesce(text, F.lit("")), kind)
        return with_variable(made, var.name, value).drop(text)

    def _prompt(self, text: Value) -> Column:
        """The prompt as one message of a user, by the chat template."""
        if self.config.chat_template is None:
            return text.col
        message = literal({"role": "user"})
        messages = array([struct({"role": message.field("role"), "content": text})])
        return templates.render(self.config.chat_template, {"messages": messages, "add_generation_prompt": literal(True)}).col


def parsed(text: Column, var: LLMVar) -> Value:
    """A backend's JSON as a struct. Malformed text and missing keys are errors; no text is an empty object."""
    kind = var.struct_type()
    text = F.coalesce(F.when(text != "", text), F.lit("{}"))
    keys = F.json_object_keys(text)
    # FAILFAST lets missing keys pass; an empty object is the one answer that may lack them
    absent = F.exists(F.array(*map(F.lit, var.output_schema)), lambda k: ~F.array_contains(keys, k))
    error = F.raise_error(F.concat(F.lit(f"variable {var.name}: keys are missing in "), text)).cast(kind)
    return Value(F.when((F.size(keys) > 0) & absent, error).otherwise(F.from_json(text, kind, {"mode": "FAILFAST"})), kind)


def _with_resources(df: DataFrame, text: str, prompt: Column, run: Callable, resources: dict[str, float]) -> DataFrame:
    """As a stage of its own, whose tasks get these resources. All columns travel through Arrow, unread but for the prompt."""
    from pyspark.resource import ResourceProfileBuilder, TaskResourceRequests

    wanted = TaskResourceRequests()
    for name, amount in resources.items():
        wanted = wanted.cpus(int(amount)) if name == "cpus" else wanted.resource(name, float(amount))
    asked = free_name(df, "__prompt")
    schema = T.StructType([*df.schema.fields, T.StructField(asked, T.StringType()), T.StructField(text, T.StringType())])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: deque[pa.RecordBatch] = deque()

        def prompts() -> Iterator[pa.Array]:
            for batch in batches:
                waiting.append(batch)
                yield batch.column(batch.schema.get_field_index(asked))

        for texts in run(prompts()):
            batch = waiting.popleft()
            yield pa.RecordBatch.from_arrays([*batch.columns, texts], names=[*batch.schema.names, text])

    return df.withColumn(asked, prompt).mapInArrow(each, schema, profile=ResourceProfileBuilder().require(wanted).build).drop(asked)


def in_pieces(run: Callable[[Iterator[pd.Series]], Iterator[pd.Series]], rows: int) -> Callable[[Iterator[pa.Array]], Iterator[pa.Array]]:
    """A function over batches of prompts as one over Arrow's, of which so many rows at a time become Python's."""

    def each(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        waiting: deque[int] = deque()  # pieces of each batch under way

        def pieces() -> Iterator[pd.Series]:
            for batch in batches:
                starts = range(0, max(len(batch), 1), rows)
                waiting.append(len(starts))
                for at in starts:
                    yield pd.Series(batch.slice(at, rows).to_pylist(), dtype=object)

        answers = run(pieces())
        for first in answers:
            texts = [pa.array(first.tolist(), pa.string())]
            for _ in range(waiting.popleft() - 1):
                texts.append(pa.array(next(answers).tolist(), pa.string()))
            yield pa.concat_arrays(texts)

    each.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return each


def stage(
    backend: str, options: dict, params: dict, batch_size: int, retries: int = 3, in_flight: int = 4, wait: float = 0.5, log: tuple[str, str] | None = None,
) -> Callable[[Iterator[pd.Series]], Iterator[pd.Series]]:
    """The function over batches of prompts. ``log``: the folder of answers and the variable's name."""
    factory = BACKENDS[backend]  # goes along to the workers, which don't know what is registered here
    kept = log and (log[0], engines.mark(log[1], backend, options, params))

    def run(prompts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        answers = engines.AnswerLog(*kept, _partition()) if kept else None
        done = answers.read() if answers else {}
        seen: Counter = Counter()

        def ask(part: list[tuple[engines.Key | int, str]]) -> tuple[dict[engines.Key | int, str], str | None]:
            texts = [p for _, p in part]
            for attempt in range(retries + 1):
                try:
                    got = engines.engine(factory, options).generate(texts, dict(params))
                    break
                except Exception:
                    if attempt == retries:
                        raise
                    time.sleep(wait * 2**attempt)
            if len(got) != len(part):
                raise RuntimeError(f"{len(got)} texts for {len(part)} prompts")
            found = {k: text for (k, _), text in zip(part, got, strict=True)}
            return found, answers.add(found) if answers else None

        with ThreadPoolExecutor(max(in_flight, 1)) as pool:
            for batch in prompts:
                asked = batch.tolist()
                keys = engines.keys(asked, seen) if answers else list(range(len(asked)))  # what the log goes by grows with the task
                left = [(k, p) for k, p in zip(keys, asked, strict=True) if k not in done]
                parts = [left[at : at + batch_size] for at in range(0, len(left), batch_size)]
                new, files = {}, []
                for found, path in pool.map(ask, parts):
                    new |= found
                    files += [path] if path else []
                if answers:
                    answers.gather(files, new)
                yield pd.Series([new[k] if k in new else done[k] for k in keys], dtype=object)

    run.__annotations__ = {"prompts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return run


def _partition() -> int:
    from pyspark import TaskContext

    context = TaskContext.get()
    return context.partitionId() if context else 0


@dataclass
class ExprConfig:
    type: str = "expr"


@processor("expr", ExprConfig, ExprVar)
class ExprProcessor:
    def __init__(self, config: ExprConfig, batch_size: int = 64):
        pass

    def apply(self, df: DataFrame, var: ExprVar) -> DataFrame:
        if (var.template is None) == (var.key is None):
            raise PlanError(f"variable {var.name!r} needs a template or a key")
        if var.template is not None:
            return with_variable(df, var.name, templates.compile_template(var.template, variables(df)))
        return with_variable(df, var.name, compile_path(var.key, struct(variables(df))))
