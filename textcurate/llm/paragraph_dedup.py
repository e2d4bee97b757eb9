"""Near-duplicate paragraphs by MinHash banding, exact verification and components.

Two kinds of units are compared, over whole texts:

Lines. Each line with a word is a paragraph; its set holds its 5-word shingles, or one shingle
of all its words if they are fewer. Exact copies collapse by the digest of their sets.
Signatures of BANDS x ROWS minima put paragraphs into one cell a band: a pair of similarity
0.8 meets in some cell with probability 1 - (1 - 0.8**ROWS)**BANDS = 0.998. Pairs in cells are
verified on their exact Jaccard similarity (linking.classes); a component is a class.

Blocks, which don't depend on line breaks: BLOCK words from each anchor on, anchors being the
least 3-word hashes of any NEAR in a row. Two documents that share BLOCK + 2 * NEAR - 2 = 51
words in a row choose an equal anchor there, so such a passage is always found, wherever its
lines break. A block with another word inside falls below 0.8 (20 of 21 words + 4 shingles), so
blocks are classes by their digest alone.

Of a class only the place that comes first by (doc_id, hash of id and text, place) stays. Keys that
occur once, which is most of a corpus, are found by counting sorted keys, and places that a
later pass needs are looked up by document (lookup.py): texts are read three times, never shuffled.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchors import sliding_minima
from .hashing import _BASE, _INV, _MULT, SPACE, U, batches, digest, hash_words, mix, powers, word_spans
from .linking import SET_SCHEMA, classes, join_hot, set_batch, set_row, shared_cells
from .lookup import SharedKeys, Values, count_keys, write_values
from .runtime import lean, materialize

BANDS, ROWS, WIDTH = 9, 3, 5
BLOCK, NEAR, ANCHOR = 25, 14, 3
_SEEDS = np.random.Generator(np.random.PCG64(7)).integers(1 << 62, 1 << 63, 2 * BANDS * ROWS, dtype=np.uint64)
_A, _B = _SEEDS[: BANDS * ROWS] | U(1), _SEEDS[BANDS * ROWS :]
LINE, A_BLOCK = 0, 1


class Units:
    """Lines and blocks of a batch of texts; see the module."""

    def __init__(self, buf: np.ndarray, bounds: np.ndarray, min_words: int):
        self.bounds = bounds
        ends = np.flatnonzero(buf == 10)
        starts = np.concatenate([[0], ends[:-1] + 1])
        doc = np.searchsorted(bounds, starts, "right") - 1
        s, e = self.word_starts, self.word_ends = word_spans(buf, SPACE)
        self.words = w = hash_words(buf, s, e)
        first = np.searchsorted(s, starts)
        n = np.searchsorted(s, ends) - first
        pick = np.flatnonzero(n >= max(min_words, 1))
        self.line_doc = doc[pick]
        self.line = (np.arange(len(starts)) - np.searchsorted(starts, bounds[doc]))[pick]
        self.first, self.n = first[pick], n[pick]
        self.doc_words = np.searchsorted(s, bounds)

    def shingles(self) -> tuple[np.ndarray, np.ndarray]:
        """(hashes, bounds) of the lines' shingles, repeats included."""
        w, n = self.words, self.n
        count = np.maximum(n - WIDTH + 1, 1)
        at = np.concatenate([[0], np.cumsum(count)])
        if not len(n):
            return np.empty(0, U), at
        few = np.flatnonzero(n < WIDTH)
        with np.errstate(over="ignore"):
            m = max(0, len(w) - WIDTH + 1)
            acc = np.zeros(len(w), U)
            for k in range(WIDTH):
                acc[:m] += w[k : k + m] * _MULT[k]
            whole = n[few].astype(U)
            for k in range(WIDTH - 1):
                long = n[few] > k
                whole[long] += w[self.first[few[long]] + k] * _MULT[k]
        h = mix(acc)[np.repeat(self.first - at[:-1], count) + np.arange(at[-1])]
        h[at[:-1][few]] = mix(whole)
        return h, at

    def blocks(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, number of its first word in the text, digest) of the blocks."""
        w, none = self.words, np.empty(0, np.int64)
        if len(w) < BLOCK + NEAR:
            return none, none, none
        with np.errstate(over="ignore"):
            m = len(w) - ANCHOR + 1
            h = mix(sum(w[k : k + m] * _MULT[k] for k in range(ANCHOR)))
            run = np.zeros(len(w) + 1, U)
            np.cumsum(w * powers(_BASE, len(w)), out=run[1:])
        of = np.repeat(np.arange(len(self.doc_words) - 1), np.diff(self.doc_words))
        low = sliding_minima(h, NEAR)
        low[of[: len(low)] != of[NEAR + ANCHOR - 2 :][: len(low)]] = 0  # runs that cross texts choose nothing
        edge = np.zeros(NEAR - 1, U)
        most = ~sliding_minima(~np.concatenate([edge, low, edge]), NEAR)
        p = np.flatnonzero(most[: len(w) - BLOCK + 1] == h[: len(w) - BLOCK + 1])
        p = p[of[p] == of[p + BLOCK - 1]]
        with np.errstate(over="ignore"):
            d = mix((run[p + BLOCK] - run[p]) * powers(_INV, len(w))[p] + U(BLOCK)).view(np.int64)
        return of[p], p - self.doc_words[of[p]], d


def units(texts, min_words: int):
    """(first text, number of texts, Units) of batches of texts."""
    for first, last, buf, bounds in batches(texts):
        yield first, last - first, Units(buf, bounds, min_words)


def distinct_sets(hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(digest, size) of each paragraph's set: digest(np.unique(...)) of all paragraphs at once."""
    of = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    order = np.lexsort((hashes, of))
    h = hashes[order]
    keep = np.concatenate([[True], (h[1:] != h[:-1]) | (of[1:] != of[:-1])])
    h, of = h[keep], of[keep]
    first = np.searchsorted(of, np.arange(len(bounds) - 1))
    size = np.diff(np.append(first, len(of)))
    with np.errstate(over="ignore"):
        rank = (np.arange(len(of)) - first[of] + 1).astype(U)
        total = np.add.reduceat(mix(h + mix(rank)), first)
        return mix(total + size.astype(U)).view(np.int64), size


def signatures(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """(paragraphs, BANDS) cells. The hashes are mixed already, so a * h + b permutes them well enough."""
    out = np.zeros((len(bounds) - 1, BANDS), U)
    with np.errstate(over="ignore"):
        for band in range(BANDS):
            for r in range(ROWS):
                k = band * ROWS + r
                low = np.minimum.reduceat(hashes * _A[k] + _B[k], bounds[:-1])
                out[:, band] = mix(out[:, band] * U(31) + low + U(band))
    return out.view(np.int64)


def _cut(values: np.ndarray, of: np.ndarray, n: int) -> pa.Array:
    """Binary array of n rows: the bytes of the values (sorted by row) of each row."""
    at = np.searchsorted(of, np.arange(n + 1)) * values.itemsize * (values.shape[1] if values.ndim > 1 else 1)
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(at.astype(np.int32).tobytes()), pa.py_buffer(np.ascontiguousarray(values).tobytes())])


def _joined(column: pa.Array, kind=np.int64) -> tuple[np.ndarray, np.ndarray]:
    """(values, row of each) of a binary column."""
    parts = [x.as_buffer() for x in column]
    sizes = np.array([x.size // np.dtype(kind).itemsize for x in parts], np.int64)
    return np.frombuffer(b"".join(parts), kind), np.repeat(np.arange(len(parts)), sizes)


def removals(documents: DataFrame, min_words: int = 1, num: int = 4, den: int = 5) -> DataFrame:
    """doc_id, n_bytes, removed, kept_sha256 and counts for every row of documents.

    removed: array of (s, e), the maximal runs of removed bytes. Counts: n_removed (bytes),
    n_spans (runs), n_paragraphs_repeated (lines that have a near duplicate, the one that stays
    included), n_paragraphs_removed, n_passages_repeated (blocks that another document has too,
    the ones that stay included).

    A removed line goes with its line end (at a text's end, with the one before). A block goes from its first word to its last, but
    for bytes of blocks that stay in the same text. Lines of fewer than `min_words` words stay
    as they are. Null text: no bytes. Equal rows (same id and text) count once and get the same
    result. Null ids and further columns are allowed; an empty table gives no rows.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    doc_id = F.col("doc_id").cast("long").alias("doc_id")
    rows = documents.select(doc_id, F.xxhash64(doc_id, F.xxhash64(text)).alias("doc"), text.alias("text"))

    def read(batches_):
        for b in batches_:
            for first, n, u in units(b.column(2), min_words):
                h, at = u.shingles()
                block_doc, block_at, blocks = u.blocks()
                ids = one = np.empty(0, np.int64)
                cells = np.empty((0, BANDS), np.int64)
                if len(u.n):
                    ids, size = distinct_sets(h, at)
                    # one of each set; sets of n members reach at most n / (n + 1) with any other set
                    one = np.sort(np.unique(ids, return_index=True)[1])
                    one = one[den * size[one] >= num * (size[one] + 1)]
                    if len(one):
                        m = np.diff(at)[one]
                        ends = np.concatenate([[0], np.cumsum(m)])
                        cells = signatures(h[np.repeat(at[one] - ends[:-1], m) + np.arange(ends[-1])], ends)
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).slice(first, n), b.column(1).slice(first, n),
                        _cut(ids, u.line_doc, n), _cut(u.line.astype(np.int32), u.line_doc, n), _cut(ids[one], u.line_doc[one], n), _cut(cells, u.line_doc[one], n),
                        _cut(blocks, block_doc, n), _cut(block_at.astype(np.int32), block_doc, n),
                    ],
                    names=["doc_id", "doc", "ids", "lines", "banded", "cells", "blocks", "starts"],
                )

    schema = "doc_id long, doc long, ids binary, lines binary, banded binary, cells binary, blocks binary, starts binary"
    table = materialize(rows.mapInArrow(lean(read), schema), "units")

    def keys_of(batches_):
        for b in batches_:
            for c in range(3):
                yield _joined(b.column(c))[0].view(U)

    folder, sizes = count_keys(table.select("ids", "cells", "blocks"), keys_of)

    def pick(batches_):
        keys = SharedKeys(folder, sizes)
        for b in batches_:
            at = {name: _joined(b.column(name), np.int32 if name in ("lines", "starts") else np.int64) for name in ("ids", "lines", "banded", "cells", "blocks", "starts")}
            ids, id_doc = at["ids"]
            blocks, block_doc = at["blocks"]
            cells = at["cells"][0].reshape(-1, BANDS)
            meets = keys.times(cells.ravel().view(U)).reshape(-1, BANDS) > 1 if len(cells) else np.zeros((0, BANDS), bool)
            row, band = np.nonzero(meets)
            place = np.flatnonzero((keys.times(ids.view(U)) > 1) | np.isin(ids, at["banded"][0][meets.any(1)]))
            block = np.flatnonzero(keys.times(blocks.view(U)) > 1)
            doc_id, doc = b.column(0), b.column(1).to_numpy()
            yield picked(LINE, ids[place], pa.nulls(len(place), pa.int64()), doc_id.take(pa.array(id_doc[place])), doc[id_doc[place]], at["lines"][0][place])
            yield picked(A_BLOCK, blocks[block], pa.nulls(len(block), pa.int64()), doc_id.take(pa.array(block_doc[block])), doc[block_doc[block]], at["starts"][0][block])
            none = pa.nulls(len(row), pa.int64())
            yield picked(2, at["banded"][0][row], pa.array(cells[row, band]), none, none, pa.nulls(len(row), pa.int32()))

    def picked(kind, ids, cells, doc_id, doc, at):
        arrays = [pa.array(np.full(len(ids), kind, np.int32)), pa.array(ids), cells, doc_id, pa.array(doc, pa.int64()), pa.array(at, pa.int32())]
        return pa.RecordBatch.from_arrays(arrays, names=["kind", "id", "cell", "doc_id", "doc", "at"])

    found = materialize(table.mapInArrow(lean(pick), "kind int, id long, cell long, doc_id long, doc long, at int"), "picked")
    places, blocks = (found.where(f"kind = {k}").select("id", "doc_id", "doc", "at") for k in (LINE, A_BLOCK))
    members = shared_cells(found.where("kind = 2").select("cell", "id"))

    first = F.min(F.struct("doc_id", "doc", "at"))
    wanted = places.groupBy("id").agg(first.alias("f")).join(members.select("id").distinct(), "id", "left_semi")
    wanted = write_values(wanted.select(F.col("f.doc").alias("key"), F.col("f.at").cast("long").alias("value")), "wanted")

    def build(batches_):
        values = Values(wanted)
        for b in batches_:
            lines = [values.get(k) for k in b.column(1).to_pylist()]
            own = [i for i, x in enumerate(lines) if x is not None]
            if not own:
                continue
            out, size = [], 0
            for t, n, u in units(b.column(2).take(pa.array(own)), min_words):
                h, at = u.shingles()
                want = np.isin(u.line_doc.astype(np.int64) << 40 | u.line, np.concatenate([i << 40 | lines[own[t + i]] for i in range(n)]))
                for k in np.flatnonzero(want):
                    s = np.unique(h[at[k] : at[k + 1]])
                    out.append((digest(s), *set_row(s)))
                    size += len(s)
                    if size > 1 << 18:
                        yield set_batch(out)
                        out, size = [], 0
            if out:
                yield set_batch(out)

    # equal rows give equal sets, and nothing else does
    sets = materialize(rows.mapInArrow(lean(build), SET_SCHEMA).dropDuplicates(["id"]), "sets")
    marks = _marked(places, LINE, classes(members, sets, num, den)).unionByName(_marked(blocks, A_BLOCK))
    marks = write_values(marks, "marks")

    def cut(batches_):
        values = Values(marks)
        for b in batches_:
            n, runs, sha, counts = [], [], [], []
            for key, t in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                t = t.encode("utf-8", "surrogatepass")
                spans, line, gone, passages = _spans(t, values.get(key))
                n.append(len(t))
                runs.append([{"s": int(s), "e": int(e)} for s, e in spans])
                sha.append(hashlib.sha256(_rest(t, spans)).hexdigest())
                counts.append((sum(int(e - s) for s, e in spans), len(spans), gone, line, passages))
            c = list(zip(*counts)) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), *(pa.array(x, pa.int64()) for x in c[:2]), pa.array(sha, pa.string()), *(pa.array(x, pa.int64()) for x in c[2:]), pa.array(runs, pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())])))],
                names=[x.split()[0] for x in out.split(", ")[:8]] + ["removed"],
            )

    out = (
        "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_paragraphs_removed long, n_paragraphs_repeated long, n_passages_repeated long, "
        "removed array<struct<s:int,e:int>>"
    )
    return rows.mapInArrow(lean(cut), out)


def _marked(places: DataFrame, kind: int, found: DataFrame | None = None) -> DataFrame:
    """(key, value) of the places (id, doc_id, doc, at) of classes of several places.

    found: (node, component) of the ids that are in one class with another.
    value: at * 8 + 4 if the place goes + 2 if another document has the class too + kind.
    """
    place = F.struct("doc_id", "doc", "at")
    each = places.groupBy("id").agg(F.count("*").alias("rows"), F.min(place).alias("keep"), F.max(place).alias("last"), F.min("doc").alias("lo"), F.max("doc").alias("hi"))
    if found is not None:
        each = materialize(each.join(found, each["id"] == found["node"], "left").withColumn("class", F.coalesce("component", "id")).drop("node", "component"), "unit-classes")
        of = each.groupBy("class").agg(F.count("*").alias("times"), F.min("keep").alias("keep"), F.max("last").alias("last"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        each = join_hot(each.select("id", "rows", "class"), of, "class", "classes")
    of = each.where("keep.doc <> last.doc or keep.at <> last.at").select(
        "id", F.col("rows").alias("times"), F.col("keep.doc").alias("k_doc"), F.col("keep.at").alias("k_at"), (F.col("lo") != F.col("hi")).alias("spread")
    )
    goes = (F.col("doc") != F.col("k_doc")) | (F.col("at") != F.col("k_at"))
    value = F.col("at").cast("long") * 8 + F.when(goes, 4).otherwise(0) + F.when(F.col("spread"), 2).otherwise(0) + kind
    return join_hot(places, of, "id", "units").select(F.col("doc").alias("key"), value.alias("value"))


def _rest(text: bytes, spans) -> bytes:
    at, parts = 0, []
    for s, e in spans:
        parts.append(text[at:s])
        at = e
    return b"".join([*parts, text[at:]])


def _spans(text: bytes, marks: np.ndarray | None) -> tuple[list[tuple[int, int]], int, int, int]:
    """(removed runs, lines repeated, lines removed, blocks that other documents have) of a text's marks."""
    if marks is None:
        return [], 0, 0, 0
    at, goes, spread, block = marks >> 3, (marks & 4) > 0, (marks & 2) > 0, (marks & 1) == A_BLOCK
    edge = np.zeros(len(text) + 1, np.int32)
    buf = np.frombuffer(text, np.uint8)
    if block.any():
        s, e = word_spans(buf, SPACE)
        for which, step in ((block & goes, 1), (block & ~goes, -1)):  # bytes of blocks that stay are taken out again
            cover = np.zeros(len(text) + 1, np.int32)
            np.add.at(cover, s[at[which]], 1)
            np.add.at(cover, e[at[which] + BLOCK - 1], -1)
            cover = np.cumsum(cover) > 0
            edge = cover.astype(np.int32) if step > 0 else edge * ~cover
    lines = at[goes & ~block]
    if len(lines):
        ends = np.append(np.flatnonzero(buf == 10), len(text) - 1)
        starts = np.concatenate([[0], ends[:-1] + 1])
        cover = np.zeros(len(text) + 1, np.int32)
        if lines[-1] == len(ends) - 1:  # the run of lines at a text's end takes the line end before it
            run = lines[-1] - lines == np.arange(len(lines))[::-1]
            k = lines[run].min()
            cover[max(starts[k] - 1, 0)] += 1
            cover[starts[k]] -= 1
        np.add.at(cover, starts[lines], 1)
        np.add.at(cover, ends[lines] + 1, -1)
        edge = np.maximum(edge, np.cumsum(cover) > 0)
    step = np.diff(np.concatenate([[0], edge[: len(text)], [0]]))
    spans = list(zip(np.flatnonzero(step == 1), np.flatnonzero(step == -1)))
    return spans, int((~block).sum()), len(lines), int((block & spread).sum())


def deduplicate(documents: DataFrame, min_words: int = 1, num: int = 4, den: int = 5) -> DataFrame:
    """removals() without the spans."""
    return removals(documents, min_words, num, den).drop("removed")
