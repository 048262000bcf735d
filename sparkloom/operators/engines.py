"""What text generation keeps outside a task: the engines of a worker, and a log of answers.

An engine is started by the first batch that needs it and then shared by all tasks that the Python worker runs, so a
model is loaded once a worker and not once a task. The log holds the answers of finished batches in a folder that all workers reach; a
task that is tried again reads what its partition has there and asks for the rest only.
"""

from __future__ import annotations

import atexit
import contextlib
import hashlib
import json
import posixpath
import threading
import uuid
from collections import Counter
from collections.abc import Callable, Sequence
from typing import Any

from pyarrow import fs

from sparkloom.sources.arrow_dir import opened

_ENGINES: dict[str, Any] = {}
_LOCK = threading.Lock()


def engine(factory: Callable[..., Any], options: dict[str, Any]) -> Any:
    """This worker's engine for a backend and its options; it is closed, if it can be, when the worker ends."""
    key = json.dumps([factory.__module__, factory.__qualname__, options], sort_keys=True, default=str)
    with _LOCK:
        if key not in _ENGINES:
            _ENGINES[key] = factory(**options)
            if hasattr(_ENGINES[key], "close"):
                atexit.register(_ENGINES[key].close)
        return _ENGINES[key]


def stop_engines() -> None:
    """Forgets the engines of this process."""
    with _LOCK:
        _ENGINES.clear()


Key = tuple[str, int]


def keys(prompts: Sequence[str], seen: Counter) -> list[Key]:
    """A key for each prompt: its hash, and how often the task has had it before."""
    out = []
    for p in prompts:
        digest = hashlib.sha256(p.encode()).hexdigest()
        out.append((digest, seen[digest]))
        seen[digest] += 1
    return out


class AnswerLog:
    """The answers of one partition of one generation: small files, each moved to its name once it is whole.

    ``mark`` tells generations apart: the same prompts to another backend, or with other parameters, are not the same.
    """

    def __init__(self, folder: str, mark: str, partition: int):
        self.system, base = opened(folder)
        self.base = posixpath.join(base, mark, f"{partition:06d}")

    def read(self) -> dict[Key, str]:
        out: dict[Key, str] = {}
        for info in self._segments():
            with self.system.open_input_stream(info.path) as f:
                out.update(((digest, i), text) for digest, i, text in json.loads(f.read()))
        return out

    def _segments(self) -> list[fs.FileInfo]:
        found = self.system.get_file_info(fs.FileSelector(self.base, allow_not_found=True))
        return [i for i in found if i.base_name.endswith(".json")]

    def add(self, answers: dict[Key, str]) -> str:
        self.system.create_dir(self.base, recursive=True)
        name = uuid.uuid4().hex
        made, path = posixpath.join(self.base, f"{name}.tmp"), posixpath.join(self.base, f"{name}.json")
        with self.system.open_output_stream(made) as f:
            f.write(json.dumps([[*k, text] for k, text in answers.items()]).encode())
        self.system.move(made, path)
        return path

    def gather(self, paths: list[str], answers: dict[Key, str]) -> None:
        """One file in place of several."""
        if len(paths) > 1:
            self.add(answers)
            for path in paths:
                with contextlib.suppress(FileNotFoundError):
                    self.system.delete_file(path)


def mark(*parts: Any) -> str:
    return hashlib.sha256(json.dumps(parts, sort_keys=True, default=str).encode()).hexdigest()[:16]
