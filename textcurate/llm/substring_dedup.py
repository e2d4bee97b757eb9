"""Removal of repeated byte strings by a prefix-free parse and suffix arrays of its dictionary.

A text's windows are its `length`-byte substrings. The trigger of a window is the smallest
rolling hash of its TRIGGER-byte substrings, so equal windows have equal triggers wherever
they stand, and runs of windows with one trigger are the phrases of the parse; each phrase
spells the bytes of all its windows. The parse needs the dictionary for nothing deeper: a
suffix's first `length` bytes never leave its phrase, so equal phrases are parse suffixes that
agree to that depth, and the corpus order is that of the dictionary's suffixes, each taken as
often as its phrase occurs.

Triggers are counted first: one that occurs at one place proves all windows of its phrase
unique, which is most of a corpus. Of the others, phrases of the same bytes are one entry of the
dictionary, and all windows of an entry that occurs several times are repeated. Entries that
occur once but share their trigger are opened, next to one copy of each other entry of that
trigger: their suffixes are ordered to the depth of `length` bytes (suffixes.py), and those
that tie are repeated. The entries of a trigger that has more than OPENED bytes or ENTRIES of them
are not held together; their windows' 64-bit hashes are counted instead, over all tasks.

Equal texts are one text for all of this; a text that occurs several times is removed whole
if it has `length` bytes. Texts are never shuffled: what a pass needs to know of a text is
looked up (lookup.py).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchors import Rolling, phrases
from .hashing import U
from .linking import join_hot
from .lookup import WHOLE_KEY, SharedKeys, Values, count_keys, write_values
from .runtime import lean, materialize
from .suffixes import suffix_ranks

TRIGGER = 40
#: Bytes of a trigger's entries, and entries, that a task holds and orders at once.
OPENED, ENTRIES = 1 << 21, 1024
#: Bytes of a text that are parsed at once.
PIECE = 1 << 20
#: What is looked up of a text that occurs several times: whether it stands for its copies.
STANDS, COPY = 0, 1


def _pieces(text: bytes, length: int):
    """(offset, part) of a long text; parts overlap so that each window is in one part."""
    if len(text) <= PIECE + length:
        yield 0, text
        return
    for a in range(0, len(text) - length + 1, PIECE):
        yield a, text[a : a + PIECE + length - 1]


def text_phrases(text: bytes, length: int) -> tuple[np.ndarray, ...]:
    """(trigger, entry hash, first window, windows, several) of a text's phrases."""
    out = []
    for a, part in _pieces(text, length):
        if len(part) < length:
            continue
        r = Rolling(np.frombuffer(part, np.uint8))
        trigger, first, count, several = phrases(r.all(TRIGGER), length - TRIGGER + 1)
        out.append((trigger, r.of(first, first + count - 1 + length), first + a, count, several))
    if not out:
        none = np.empty(0, np.int64)
        return none.astype(U), none.astype(U), none, none, none.astype(bool)
    return tuple(np.concatenate(x) for x in zip(*out))


def remove_spans(text: bytes, runs: list[tuple[int, int]], length: int) -> tuple[bytes, int, int]:
    """(kept bytes, removed bytes, maximal removed runs) for runs (first window, windows)."""
    edge = np.zeros(len(text) + 1, np.int32)
    for s, n in runs:
        edge[s] += 1
        edge[min(s + n - 1 + length, len(text))] -= 1
    gone = np.cumsum(edge[:-1]) > 0
    kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
    return kept, int(gone.sum()), int(np.count_nonzero(np.diff(np.concatenate([[0], gone.astype(np.int8)])) == 1))


def _parses(batches, copies: Values, length: int):
    """(doc, phrases) of the texts (doc, text) of batches, of equal texts of one only."""
    for b in batches:
        for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
            own = copies.get(doc)
            if own is None or own[0] == STANDS:
                yield doc, text_phrases(text.as_py(), length)


def repeated_runs(texts: DataFrame, copies, length: int) -> DataFrame:
    """(doc, s, n) of the runs of repeated windows in the distinct texts (doc, text binary).

    copies: looked up by doc, STANDS or COPY of the texts that occur several times.
    """

    def triggers(batches):
        for _, (t, _, _, n, several) in _parses(batches, Values(copies), length):
            yield t
            if several.any():
                yield t[several]  # a trigger that one phrase holds twice counts as shared

    folder, sizes = count_keys(texts, triggers)

    def parse(batches):
        keys = SharedKeys(folder, sizes)
        cols, size = [[] for _ in range(6)], 0
        for doc, (t, e, s, n, several) in _parses(batches, Values(copies), length):
            keep = keys.times(t) > 1
            for c, x in zip(cols, (t[keep], e[keep], np.full(int(keep.sum()), doc), s[keep], n[keep], several[keep])):
                c.append(x)
            size += len(cols[0][-1])
            if size > 1 << 18:
                yield _phrase_batch(cols)
                cols, size = [[] for _ in range(6)], 0
        if size:
            yield _phrase_batch(cols)

    met = materialize(texts.mapInArrow(lean(parse), "trigger long, entry long, doc long, s int, n int, several boolean"), "phrases")
    entries = materialize(
        met.groupBy("trigger", "entry").agg(F.count("*").alias("times"), F.min(F.struct("doc", "s", "n")).alias("one"), F.max("several").alias("several")), "entries"
    )
    # the dictionary entries to open: their first place stands for all of them
    bytes_ = F.sum(F.col("one.n") + F.lit(length - 1)).alias("bytes")
    single = entries.groupBy("trigger").agg(F.max(F.col("times") == 1).alias("any"), F.count("*").alias("times"), F.max("several").alias("several"), bytes_)
    single = single.where("any and (times > 1 or several)").select("trigger", "times", ((F.col("bytes") > OPENED) | (F.col("times") > ENTRIES)).alias("hot"))
    opened = join_hot(entries.select("trigger", "one"), single, "trigger", "opened")
    opened = write_values(
        opened.select(F.col("one.doc").alias("key"), "trigger", F.col("one.s").cast("long").alias("s"), F.col("one.n").cast("long").alias("n"), F.col("hot").cast("long").alias("hot")),
        "opened", ("s", "n", "trigger", "hot"),
    )

    def spell(batches):
        places = Values(opened)
        for b in batches:
            rows, size = [], 0
            for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
                own = places.get(doc)
                if own is None:
                    continue
                text = text.as_py()
                for s, n, trigger, hot in own.tolist():
                    rows.append((trigger, doc, s, bool(hot), text[s : s + n - 1 + length]))
                    size += len(rows[-1][4])
                    if size > 1 << 21:
                        yield _spelt(rows)
                        rows, size = [], 0
            if rows:
                yield _spelt(rows)

    spelt = materialize(texts.mapInArrow(lean(spell), "trigger long, doc long, s int, hot boolean, bytes binary"), "spelt")

    def compare(batches):
        held, size = [], 0
        for b in batches:
            trigger, doc, s, text = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_numpy(), b.column(3).to_pylist()
            for x in zip(trigger, doc, s, text):
                if size >= OPENED and x[0] != held[-1][0]:
                    yield _runs(held, length, _ties(held, length))
                    held, size = [], 0
                held.append(x)
                size += len(x[3])
        if held:
            yield _runs(held, length, _ties(held, length))

    columns = ("trigger", "doc", "s", "bytes")
    cold = spelt.where("not hot").select(*columns).repartition("trigger").sortWithinPartitions("trigger").mapInArrow(lean(compare), "doc long, s int, n int")

    several = entries.where("times > 1").select("entry", "times")
    whole = join_hot(met.select("entry", "doc", "s", "n"), several, "entry", "repeated").select("doc", "s", "n")
    found = whole.unionByName(cold)
    hot = spelt.where("hot").select(*columns)
    if hot.isEmpty():
        return found

    def window_hashes(batches):
        for b in batches:
            for text in b.column(3):
                yield Rolling(np.frombuffer(text.as_py(), np.uint8)).all(length)

    hot_folder, hot_sizes = count_keys(hot, window_hashes, WHOLE_KEY)

    def look(batches):
        keys = SharedKeys(hot_folder, hot_sizes, WHOLE_KEY)
        for b in batches:
            held = list(zip(*(b.column(k).to_pylist() for k in range(4))))
            if held:
                yield _runs(held, length, keys.times(np.concatenate([Rolling(np.frombuffer(x[3], np.uint8)).all(length) for x in held])) > 1)

    return found.unionByName(hot.mapInArrow(lean(look), "doc long, s int, n int"))


def _phrase_batch(cols) -> pa.RecordBatch:
    t, e, d, s, n, several = (np.concatenate(c) for c in cols)
    return pa.RecordBatch.from_arrays(
        [pa.array(t.view(np.int64)), pa.array(e.view(np.int64)), pa.array(d.astype(np.int64)), pa.array(s.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(several)],
        names=["trigger", "entry", "doc", "s", "n", "several"],
    )


def _spelt(rows) -> pa.RecordBatch:
    t, d, s, h, b = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(t, pa.int64()), pa.array(d, pa.int64()), pa.array(s, pa.int32()), pa.array(h, pa.bool_()), pa.array(b, pa.binary())], names=["trigger", "doc", "s", "hot", "bytes"])


def _windows(rows, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place in its bytes, place in the bytes of all rows) of the windows of rows (.., bytes)."""
    sizes = np.array([len(x[3]) for x in rows])
    counts = sizes - length + 1
    row = np.repeat(np.arange(len(rows)), counts)
    within = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    return row, within, (np.cumsum(sizes) - sizes)[row] + within


def _ties(rows, length: int) -> np.ndarray:
    """Of the windows of rows, those whose suffix ties with another's to the depth of a window."""
    at = _windows(rows, length)[2]
    rank = suffix_ranks(np.frombuffer(b"".join(x[3] for x in rows), np.uint8), length)[at]
    return np.bincount(rank)[rank] > 1


def _runs(rows, length: int, twice: np.ndarray) -> pa.RecordBatch:
    """(doc, s, n) of the runs of marked windows of rows (trigger, doc, s, bytes)."""
    row, within, _ = _windows(rows, length)
    begin = twice & np.concatenate([[True], ~twice[:-1] | (row[1:] != row[:-1])])
    end = twice & np.concatenate([~twice[1:] | (row[1:] != row[:-1]), [True]])
    b, e = np.flatnonzero(begin), np.flatnonzero(end)
    doc, s = np.array([x[1] for x in rows], np.int64), np.array([x[2] for x in rows], np.int64)
    return pa.RecordBatch.from_arrays([pa.array(doc[row[b]]), pa.array((s[row[b]] + within[b]).astype(np.int32)), pa.array((e - b + 1).astype(np.int32))], names=["doc", "s", "n"])


def deduplicate(documents: DataFrame, length: int = 200, texts: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if `texts`, `kept` (the bytes that are left).

    One row for each row of documents. Null text: no bytes. Repeated rows are copies of one
    another like any equal texts. Null ids and further columns are allowed; an empty table
    gives no rows.
    """
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    doc_id = F.col("doc_id").cast("long").alias("doc_id")
    rows = documents.select(doc_id, F.xxhash64(doc_id, F.xxhash64(text)).alias("doc"), text.alias("text"))
    long = rows.where(F.octet_length("text") >= length)
    keyed = materialize(long.select(F.xxhash64("text").alias("dig"), "doc"), "texts")
    times = keyed.groupBy("dig").agg(F.count("*").alias("times"), F.min("doc").alias("stands")).where("times > 1")
    copies = join_hot(keyed, times, "dig", "copies")
    copies = write_values(copies.select(F.col("doc").alias("key"), F.when(F.col("doc") == F.col("stands"), STANDS).otherwise(COPY).cast("long").alias("value")), "copies")
    runs = repeated_runs(long.select("doc", "text"), copies, length)
    runs = write_values(runs.select(F.col("doc").alias("key"), F.col("s").cast("long").alias("s"), F.col("n").cast("long").alias("n")), "runs", ("s", "n"))

    def cut(batches):
        again, found = Values(copies), Values(runs)
        for b in batches:
            out, size = [], 0
            for i, (doc_id, doc, text) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2))):
                text = text.as_py()
                spans = found.get(doc) if len(text) >= length else None
                if len(text) >= length and again.get(doc) is not None:
                    kept, gone, n = b"", len(text), 1
                elif spans is None:
                    kept, gone, n = text, 0, 0
                else:
                    kept, gone, n = remove_spans(text, spans.tolist(), length)
                out.append((doc_id, len(text), gone, n, hashlib.sha256(kept).hexdigest(), kept)[: len(names)])
                size += len(kept)
                if size > 1 << 24 or i == b.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)
                    out, size = [], 0

    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: 6 if texts else 5]
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
    return rows.mapInArrow(lean(cut), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if texts else ""))
