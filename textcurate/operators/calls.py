"""What a run of paid calls shares: a limit of calls under way, and a log of the answers that were paid for.

The limit is held by the shape of the plan: rows are dealt to so many tasks that tasks times
calls of a task never exceed it, whatever the cluster's size; stages of one chain of calls
follow one another, as each begins with such a shuffle. Speculative copies of tasks would
add to it, so leave `spark.speculation` off for stages that call.

The log keeps each answer, in a file named by what was asked, before its row is returned.
A task that Spark runs again, and a run that is started again, finds it there and doesn't
ask a second time. Files are written beside their name and renamed, so none is ever half.
"""

from __future__ import annotations

import contextlib
import hashlib
import json
import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame


def limited(df: DataFrame, calls: int, concurrency: int) -> tuple[DataFrame, int]:
    """(df dealt to so many tasks that calls / tasks fit, calls that each may have under way)."""
    if calls < 1:
        raise ValueError("the limit of calls must be positive")
    each = min(concurrency, calls)
    return df.repartition(calls // each), each


class CallLog:
    """Answers by request in a folder that all executors share: a local or mounted one, or one that pyarrow opens."""

    def __init__(self, folder: str):
        self.folder = folder

    def _open(self):
        from pyarrow import fs

        where = self.folder
        if where.startswith(("file:", "/")):
            return None, where.removeprefix("file://").removeprefix("file:")
        return fs.FileSystem.from_uri(where)

    @staticmethod
    def name(*asked: object) -> str:
        return hashlib.sha256(json.dumps(asked, ensure_ascii=True, default=str).encode()).hexdigest()

    def get(self, name: str) -> dict | None:
        there, base = self._open()
        path = f"{base}/{name[:2]}/{name}.json"
        if there is None:
            with contextlib.suppress(FileNotFoundError), open(path, encoding="utf-8") as f:
                return json.load(f)
            return None
        with contextlib.suppress(FileNotFoundError), there.open_input_stream(path) as f:
            return json.loads(f.read())
        return None

    def put(self, name: str, answer: dict) -> None:
        there, base = self._open()
        folder = f"{base}/{name[:2]}"
        part, path, data = f"{folder}/.{name}-{uuid.uuid4().hex}", f"{folder}/{name}.json", json.dumps(answer, ensure_ascii=False).encode()
        if there is None:
            os.makedirs(folder, exist_ok=True)
            with open(part, "wb") as f:
                f.write(data)
                f.flush()
                os.fsync(f.fileno())
            os.replace(part, path)
            return
        there.create_dir(folder, recursive=True)
        with there.open_output_stream(part) as f:
            f.write(data)
        there.move(part, path)

    def once(self, asked: tuple, call: Callable[[], dict]) -> dict:
        """The logged answer to what is asked, or call()'s, logged before it is returned."""
        name = self.name(*asked)
        have = self.get(name)
        if have is None:
            have = call()
            self.put(name, have)
        return have
