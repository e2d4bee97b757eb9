"""Exports read in splits against the parser of whole documents."""

import json
import random

import pytest
from pyspark.sql import functions as F

from textcurate.sources import exports, readers

rng = random.Random(17)
SIGNS = ['"', "\\", "{", "}", "[", "]", "a", "é", "😀", "\n", '"messages": [', '"name": "x"', '{"type":"message"}', "\\\\", " "]


def words(n):
    return "".join(rng.choice(SIGNS) for _ in range(rng.randrange(n)))


def document(n, name="news {of} [the] \"day\"", first=True, extra=True):
    def message(i):
        m = {"id": i, "type": rng.choice(["message", "message", "service"]), "date": f"2024-01-{i % 28 + 1:02d}T10:00:00", "text": rng.choice([words(60), [words(9), {"type": "bold", "text": words(9)}], "", None])}
        if rng.random() < 0.3:
            m["messages"] = [{"id": -1, "type": "message", "name": words(5)}]
        if rng.random() < 0.2:
            m["reactions"] = [{"deep": [{"x": {"}": words(20)}}]}]
        return m if rng.random() < 0.95 else rng.choice([5, None, "}{", [1, {"type": "message", "id": 7}]])

    doc = {}
    if first and name is not None:
        doc["name"] = name
    if extra:
        doc |= {"about": {"messages": [{"id": -2, "type": "message"}], "name": "inner"}, "list": [{"id": -3, "type": "message"}], "note": 'it says "messages": [ {'}
    doc["messages"] = [message(i) for i in range(n)]
    if extra:
        doc["after"] = [{"id": -4, "type": "message"}]
    if not first and name is not None:
        doc["name"] = name
    return doc


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture
def tiny_splits(spark):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.execution.arrow.maxRecordsPerBatch")
    before = {k: spark.conf.get(k) for k in names}

    def use(size, batch):
        for k, v in zip(names, (size, min(size, 16), batch)):
            spark.conf.set(k, str(v))

    yield use
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("size, batch", [(64, 3), (97, 1), (400, 7), (5000, 10_000), (1 << 27, 5)])
def test_splits_equal_whole_documents(spark, tmp_path, tiny_splits, size, batch):
    docs = {
        "a": document(40), "b": document(25, first=False), "c": document(12, name=None, extra=False), "d": document(0), "e": {"name": "no messages"}, "f": {"messages": {"id": 1, "type": "message"}},
        "g": document(6, name="née } Ünï\\\"" * 30, first=False), "h": {"messages": [], "name": 5}, "i": {"messages": [[{"type": "message", "id": 9}], {"type": "message", "id": 3, "text": "}" * 300}]}, "j": {"name": None, "messages": [{"type": "message"}]},
    }
    for k, (name, doc) in enumerate(docs.items()):
        d = tmp_path / name
        d.mkdir()
        (d / "result.json").write_text(json.dumps(doc, ensure_ascii=k % 2 == 0, indent=[None, 1, 3][k % 3]) + ["", "\n", " \n\n"][k % 3])
    want = rows(readers.parse_export(spark.read.text(f"{tmp_path}/*/result.json", wholetext=True).select("value", F.input_file_name().alias("file"))))
    assert len(want) > 40
    tiny_splits(size, batch)
    got = readers.read_export(spark, f"{tmp_path}/*/result.json")
    assert rows(got) == want
    if size < 100:
        assert exports.chunks(spark, f"{tmp_path}/a/result.json").select("start").distinct().count() > 30


def test_broken_and_empty_exports(spark, tmp_path):
    for name, text in {"cut": '{"name": "x", "messages": [{"id": 1, "type": "message", "text": "half', "list": '{"messages": [{"id": 1}', "none": ""}.items():
        (tmp_path / f"{name}.json").write_text(text)
    for name in ("cut", "list"):
        with pytest.raises(ValueError, match="whole"):
            readers.read_export(spark, str(tmp_path / f"{name}.json"))
    assert readers.read_export(spark, str(tmp_path / "none.json")).collect() == []


def test_one_line_export_is_dealt_out(spark, tmp_path, tiny_splits):
    """One document of a single line, read by many tasks, message by message."""
    n = 40_000
    with open(tmp_path / "result.json", "w") as f:
        f.write('{"name":"big","messages":[')
        f.write(",".join(json.dumps({"id": i, "type": "message", "date": "2024-01-01T00:00:00", "text": f"message {i} " + "x{}" * (i % 30)}) for i in range(n)))
        f.write("]}")
    tiny_splits(1 << 18, 2000)
    out = readers.read_export(spark, str(tmp_path / "result.json"))
    assert exports.chunks(spark, str(tmp_path / "result.json")).rdd.getNumPartitions() > 8
    assert tuple(out.agg(F.count("*"), F.count_distinct("post_id"), F.min("post_id"), F.max("post_id"), F.sum(F.length("text"))).first()) == (
        n, n, 0, n - 1, sum(len(f"message {i} ") + 3 * (i % 30) for i in range(n))
    )
