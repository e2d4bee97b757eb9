"""Small text files on whatever store Spark reads: reports, manifests, settings.

Everything goes through Hadoop's file systems, so a path means the same here as for a table.
"""

from __future__ import annotations

import json
import tempfile
import uuid
from typing import Any

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession


def _there(path: str):
    spark = SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return spark._jvm, at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def exists(path: str) -> bool:
    _, fs, at = _there(path)
    return fs.exists(at)


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below the folder in spark.checkpoint.dir, which all executors share.

    Only where that setting is absent (local tests) is a folder of our own set.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = "file://" + tempfile.mkdtemp(prefix="textcurate-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/textcurate/{name}-{uuid.uuid4().hex}"


def names(path: str) -> list[str]:
    """Names of a folder's members; none if it isn't there."""
    _, fs, at = _there(path)
    return [f.getPath().getName() for f in fs.listStatus(at)] if fs.exists(at) else []


def delete(path: str) -> None:
    """Delete a file or folder, if it is there."""
    _, fs, at = _there(path)
    fs.delete(at, True)


def checkpointed(df: DataFrame) -> DataFrame:
    """df computed once, in the folder of checkpoints; Spark's cleaner removes it where the session asks for that."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(scratch(df.sparkSession, "checkpoints"))
    return df.checkpoint()


def write_text(path: str, text: str) -> None:
    """Write beside the path first and rename over it, so that a reader meets the old file or the new one."""
    jvm, fs, at = _there(path)
    part = jvm.org.apache.hadoop.fs.Path(f"{path}.part")
    out = fs.create(part, True)
    try:
        out.write(text.encode())
    finally:
        out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), fs.getConf())
    over = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    how = SparkContext._gateway.new_array(over, 1)
    how[0] = over.OVERWRITE
    context.rename(fs.makeQualified(part), fs.makeQualified(at), how)


def read_text(path: str) -> str | None:
    """The file's text; None if it isn't there."""
    jvm, fs, at = _there(path)
    if not fs.exists(at):
        return None
    stream = fs.open(at)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def write_json(path: str, value: Any) -> None:
    write_text(path, json.dumps(value, ensure_ascii=False, indent=2, default=str))


def read_json(path: str) -> Any:
    """The value of a JSON file; None if it isn't there."""
    text = read_text(path)
    return None if text is None else json.loads(text)


def load_config(path: str) -> dict[str, Any]:
    """Settings of a .json or YAML file; none if the file is missing or empty."""
    text = read_text(path)
    if not text or not text.strip():
        return {}
    if path.endswith(".json"):
        return json.loads(text) or {}
    import yaml

    return yaml.safe_load(text) or {}


def dig(value: Any, *keys: str) -> Any:
    """The value under a path of keys; None wherever the path leaves the dictionaries."""
    for k in keys:
        value = value.get(k) if isinstance(value, dict) else None
    return value
