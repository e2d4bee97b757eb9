"""Message exports of any size: JSON documents that are read in splits.

An export is one JSON object whose `messages` hold an object a message, often in a single
line, so that neither lines nor a parser of whole documents can deal it out. Spark's text
reader can: with `}` as the line separator it cuts a file of any store into splits, and no
record is longer than what lies between two closing braces. What a split lacks is its
beginning's state: inside a string or not, how deep, in which list. Tasks first sum up each
split for both answers to the first question (quotes, brackets outside strings), the driver
carries the states from split to split (a few numbers for each), and a second pass cuts the
messages. A message that crosses splits comes in parts, which a third pass over the
same splits sends to one group a message. Only messages are ever parsed as JSON.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUOTE, ESCAPE, BRACE, CLOSE = 34, 92, 123, 125
_STEP = np.zeros(256, np.int8)
_STEP[[ord("{"), ord("[")]] = 1
_STEP[[ord("}"), ord("]")]] = -1
_LIST = re.compile(rb'"messages"\s*:\s*\Z')
_NAME = re.compile(rb'"name"\s*:\s*(?:(")|([^\s,}\]"\[{]+))')
#: Bytes of a split's first string that are kept for a name that begins in the split before.
LEAD = 1 << 20


def chunks(spark: SparkSession, path: str) -> DataFrame:
    """value (the text between two closing braces), file, start (of the split that holds it)."""
    rows = spark.read.option("lineSep", "}").text(path)
    return rows.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, bool, np.ndarray]]:
    """(file, start, first of its split, bytes): each record after the brace that ended the one before."""
    seen = None
    for b in batches:
        files, starts = b.column(1), b.column(2).to_numpy()
        if not len(starts):
            continue
        # a batch can hold several splits
        cut = np.flatnonzero(np.concatenate([[True], (starts[1:] != starts[:-1]) | _changes(files)]))
        for i, j in zip(cut.tolist(), [*cut[1:].tolist(), len(starts)]):
            where = (files[i].as_py(), int(starts[i]))
            text = b.column(0).slice(i, j - i)
            wide = np.int64 if pa.types.is_large_string(text.type) else np.int32
            at = np.frombuffer(text.buffers()[1], wide, j - i + 1, text.offset * np.dtype(wide).itemsize).astype(np.int64)
            data = np.frombuffer(text.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
            buf = np.insert(data, at[:-1] - at[0], CLOSE)
            fresh = where != seen
            seen = where
            yield *where, fresh, buf[1:] if fresh and where[1] == 0 else buf


def _changes(files: pa.Array) -> np.ndarray:
    codes = files.dictionary_encode().indices.to_numpy()
    return codes[1:] != codes[:-1]


def real_quotes(buf: np.ndarray) -> np.ndarray:
    """Places of the quotes that an even number of backslashes precedes."""
    q = np.flatnonzero(buf == QUOTE)
    before = np.zeros(len(q), np.int64)
    which = np.flatnonzero((q > 0) & (buf[q - 1] == ESCAPE))
    at = q[which] - 1
    while len(which):
        before[which] += 1
        at = at - 1
        more = (at >= 0) & (buf[at] == ESCAPE)
        which, at = which[more], at[more]
    return q[before % 2 == 0]


def brackets(buf: np.ndarray, quotes: np.ndarray, inside: bool) -> tuple[np.ndarray, np.ndarray]:
    """(places, +1 or -1) of the brackets outside strings; inside: the buffer begins in a string."""
    at = np.flatnonzero(_STEP[buf])
    at = at[((np.searchsorted(quotes, at) & 1) > 0) == inside]
    return at, _STEP[buf[at]].astype(np.int64)


def opens_messages(buf: np.ndarray, quotes: np.ndarray, inside: bool, at: int) -> bool:
    """Whether the bracket at a place outside strings opens the value of a key `messages` (and is a list)."""
    if buf[at] != ord("["):
        return False
    found = _LIST.search(buf[:at].tobytes())  # a key and its list stand in one record
    k = int(np.searchsorted(quotes, found.start())) if found else len(quotes)
    return k < len(quotes) and quotes[k] == found.start() and (k & 1 > 0) == inside


class Split:
    """What one split does to the state, for a beginning outside (0) and inside a string (1)."""

    def __init__(self):
        self.odd, self.lead, self.lead_ends, self.begun = False, b"", False, False
        self.depth, self.low = [0, 0], [0, 0]
        self.lists: list[dict[int, bool]] = [{}, {}]  # by depth: whether the last value that began there was the list of messages
        self.names: list[dict[int, list]] = [{}, {}]  # by depth: [raw name, ended, quoted]
        self.open: list[list | None] = [None, None]

    def add(self, buf: np.ndarray) -> None:
        quotes = real_quotes(buf)
        if not self.lead_ends and len(self.lead) < LEAD:
            end = int(quotes[0]) if len(quotes) else len(buf)
            self.lead, self.lead_ends = self.lead + buf[:end].tobytes()[: LEAD - len(self.lead)], len(quotes) > 0
        text, named = None, None
        for h in (0, 1):
            inside = bool(h) != self.odd
            at, step = brackets(buf, quotes, inside)
            after = self.depth[h] + np.cumsum(step)
            low = min(self.low[h], int(after.min(initial=self.low[h])))
            if low < self.low[h]:
                self.low[h] = low
                self.lists[h] = {d: x for d, x in self.lists[h].items() if d <= low + 1}
                self.names[h] = {d: x for d, x in self.names[h].items() if d <= low + 1}
            for d in (low, low + 1):  # the depth of the document's own keys, if the split reaches it
                own = np.flatnonzero((step > 0) & (after - step == d))
                if len(own):
                    self.lists[h][d] = opens_messages(buf, quotes, inside, int(at[own[-1]]))
            if self.open[h] is not None:
                end = int(quotes[0]) if len(quotes) else len(buf)
                self.open[h][0] += buf[:end].tobytes()
                self.open[h][1] = len(quotes) > 0
                self.open[h] = None if len(quotes) else self.open[h]
            if text is None:
                text = buf.tobytes()
                named = list(_NAME.finditer(text))
            for m in named:
                k = int(np.searchsorted(quotes, m.start()))
                if k == len(quotes) or quotes[k] != m.start() or (k & 1 > 0) != inside:
                    continue
                b = int(np.searchsorted(at, m.start()))
                d = int(after[b - 1]) if b else self.depth[h]
                if d > low + 1:
                    continue
                if m[2]:
                    self.names[h][d] = [m[2], True, False]
                    continue
                later = int(np.searchsorted(quotes, m.end()))
                ended = later < len(quotes)
                self.names[h][d] = [text[m.end() : int(quotes[later]) if ended else len(text)], ended, True]
                self.open[h] = None if ended else self.names[h][d]
            if len(after):
                self.depth[h] = int(after[-1])
        self.odd ^= bool(len(quotes) & 1)

    def summary(self) -> str:
        spelt = lambda raw: raw.decode("latin-1")  # noqa: E731  bytes as they are
        return json.dumps(
            [
                self.odd, spelt(self.lead), self.lead_ends,
                [[self.depth[h], self.low[h], list(self.lists[h].items()), [(d, spelt(n), e, q) for d, (n, e, q) in self.names[h].items()]] for h in (0, 1)],
            ]
        )


def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    split, where = None, None
    row = lambda: pa.RecordBatch.from_arrays([pa.array([where[0]]), pa.array([where[1]], pa.int64()), pa.array([split.summary()])], names=["file", "start", "summary"])
    for file, start, fresh, buf in pieces(batches):
        if fresh:
            if split is not None:
                yield row()
            split, where = Split(), (file, start)
        split.add(buf)
    if split is not None:
        yield row()


def states(rows: list) -> tuple[dict[tuple[str, int], tuple[bool, int, bool, int]], dict[str, str | None]]:
    """By split: (begins in a string, depth, in the list of messages, start of the split where its open message begins); by file: its name.

    A document that ends too early, or is no document, raises ValueError.
    """
    out, names = {}, {}
    for file in sorted({r["file"] for r in rows}):
        inside, depth, listed, owner, name, name_open = False, 0, False, 0, None, False
        for r in sorted((r for r in rows if r["file"] == file), key=lambda r: r["start"]):
            odd, lead, lead_ends, both = json.loads(r["summary"])
            out[file, r["start"]] = (inside, depth, listed, owner)
            if name_open:  # goes on in this split's first string
                name, name_open = name + lead, not lead_ends
            delta, low, lists, found = both[inside]
            for d, raw, ended, quoted in found:
                if d + depth == 1:
                    name, name_open = ('"' + raw if quoted else raw), quoted and not ended
            if depth + low <= 1:
                listed = dict((d, x) for d, x in lists).get(1 - depth, listed)
            if depth + low <= 2:
                owner = r["start"]
            inside, depth = inside != odd, depth + delta
        if inside or depth not in (0, 1):  # the last brace ends the last record and is not in it
            raise ValueError(f"{file} is not a whole JSON document")
        names[file] = _plain(name)
    return out, names


def _plain(raw: str | None) -> str | None:
    if raw is None:
        return None
    value = json.loads(raw.encode("latin-1").decode() + ('"' if raw.startswith('"') else ""), strict=False)
    return value if value is None or isinstance(value, str) else raw


def cut(batches: Iterator[pa.RecordBatch], known: dict[tuple[str, int], tuple[bool, int, bool, int]], whole: bool) -> Iterator[pa.RecordBatch]:
    """(file, owner, start, begins, value): whole messages, or the parts of those that cross splits."""
    found: list[tuple] = []
    held: list[bytes] | None = None  # of the message that is open
    begins = keep = False

    def batch():
        file, owner, start, begin, value = zip(*found)
        return pa.RecordBatch.from_arrays(
            [pa.array(file, pa.string()), pa.array(owner, pa.int64()), pa.array(start, pa.int64()), pa.array(begin, pa.bool_()), pa.array(value, pa.binary()).cast(pa.string())],
            names=["file", "owner", "start", "begins", "value"],
        )

    def part(owner: int) -> None:
        if held is not None and keep and not whole:
            found.append((*where[:1], owner, where[1], begins, b"".join(held)))

    where, owner = None, 0
    for file, start, fresh, buf in pieces(batches):
        if fresh:
            part(where[1] if begins else owner) if where else None
            where = (file, start)
            inside, depth, listed, owner = known[where]
            held, begins, keep = ([], False, listed) if depth > 2 else (None, False, False)
        quotes = real_quotes(buf)
        at, step = brackets(buf, quotes, inside)
        after = depth + np.cumsum(step)
        own = np.flatnonzero(((step > 0) & (after - step <= 2) & (after - step >= 1)) | ((step < 0) & (after == 2)))
        last = 0
        for k in own.tolist():
            p = int(at[k])
            if step[k] < 0:
                if held is not None:
                    held.append(buf[last : p + 1].tobytes())
                    if keep and begins and whole:
                        found.append((file, start, start, True, b"".join(held)))
                    elif not begins:
                        part(owner)
                held = None
            elif after[k] == 2:
                listed = opens_messages(buf, quotes, inside, p)
            else:
                held, begins, keep, last = [], True, listed and buf[p] == BRACE, p
        if held is not None:
            held.append(buf[last:].tobytes() if keep else b"")
        if len(after):
            depth = int(after[-1])
        inside ^= bool(len(quotes) & 1)
        if len(found) > 1000:
            yield batch()
            found.clear()
    if where:
        part(where[1] if begins else owner)
    if found:
        yield batch()


def messages(spark: SparkSession, path: str) -> DataFrame:
    """file, name (of the document, null without one), value: the JSON text of each object in `messages`."""
    rows = chunks(spark, path)
    known, names = states(rows.mapInArrow(summarise, "file string, start long, summary string").collect())  # a row for each split
    shared = spark.sparkContext.broadcast(known)  # four numbers for each split

    def cutter(whole: bool):
        return lambda batches: cut(batches, shared.value, whole)

    schema = "file string, owner long, start long, begins boolean, value string"
    out = rows.mapInArrow(cutter(True), schema).select("file", "value")
    if len(known) > len(names):
        parts = rows.mapInArrow(cutter(False), schema).groupBy("file", "owner").agg(F.array_sort(F.collect_list(F.struct("start", "begins", "value"))).alias("p"))
        # a value of the list that is no object has no beginning
        out = out.unionByName(parts.where("p[0].begins").select("file", F.array_join("p.value", "").alias("value")))
    called = spark.createDataFrame(list(names.items()), "f string, name string")
    return out.join(F.broadcast(called), F.col("file") == F.col("f"), "left").select("file", "name", "value")
