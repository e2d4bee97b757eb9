"""SentencePiece encoding and decoding by a forward pass over a shared-prefix trie.

The distinct marked words of a batch (blanks become the word mark) are sorted, which is a
depth-first walk of their trie: each word keeps the forward states of the prefix it shares
with the word before and only adds states for its own rest. The state of a prefix is the
last piece of its best segmentation. For a model whose pieces merge by score (BPE), the best
path is the one whose neighbouring pieces are stable, that is, merging the two pieces' text
alone gives back these two; exactly one last piece qualifies for each prefix, so the Viterbi
step keeps that one. A model's byte pieces stand for characters it lacks.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import lean

MARK = "▁"
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Words of up to 24 characters whose ids a worker remembers, at most (some 200 bytes each); others are encoded anew.
REMEMBERED = 600_000
#: Stability results that a worker remembers before it starts afresh.
STABLE = 500_000
#: Texts that a worker holds as Python strings at once.
SLICE = 512
#: Characters of text whose distinct words are sorted at once.
CHARS = 1 << 22
_UNIT = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


def units_of(text: str) -> list[str]:
    """The marked words of a text."""
    if MARK not in text and "  " not in text and text[0] != " " and text[-1] != " ":
        return [MARK + w for w in text.split(" ")]
    return _UNIT.findall(MARK + text.replace(" ", MARK))


def load_pieces(model_file: str) -> list[tuple[str, float, int]]:
    """(piece, score, kind) of a model file; kind 0: piece, 1: byte, 2: not for text."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
    kinds = [1 if sp.is_byte(i) else 2 if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) else 0 for i in range(sp.get_piece_size())]
    return [(sp.id_to_piece(i), sp.get_score(i), k) for i, k in enumerate(kinds)]


class Codec:
    def __init__(self, pieces: list[tuple[str, float, int]]):
        self.ids = {p: i for i, (p, _, k) in enumerate(pieces) if k == 0}
        self.score = {p: s for p, s, k in pieces if k == 0}
        byte = {int(p[1:-1], 16): i for i, (p, _, k) in enumerate(pieces) if k == 1}
        self.byte = [byte.get(x) for x in range(256)]
        self.unknown = next((i for i, (_, _, k) in enumerate(pieces) if k == 2), 0)
        self.text = [bytes([int(p[1:-1], 16)]) if k == 1 else b"" if k == 2 else p.replace(MARK, " ").encode() for p, _, k in pieces]
        self.letters = np.frombuffer(b"".join(self.text), np.uint8)
        self.lengths = np.array([len(t) for t in self.text])
        self.begins = np.cumsum(self.lengths) - self.lengths
        if any(re.search(f"[^{MARK}]{MARK}", p) for p in self.ids):
            raise ValueError("pieces across a word mark are not supported")
        # a piece that its own characters don't merge to can never be on a path
        self.rank = {p: -s for p, s in self.score.items() if len(p) > 1}
        self.usable = {p for p in self.ids if len(p) == 1 or self.merge(p) == [p]}
        self.halves = {}
        for p in self.usable:
            if len(p) > 1:  # the last merge that makes p joins the two pieces its text has without p
                whole = self.score.pop(p)
                self.halves[p] = tuple(self.merge(p))
                self.score[p] = whole
        # lengths, longest first, of the pieces that may end where these three (or two) characters do
        ends: dict[str, set[int]] = {}
        for p in self.usable:
            if len(p) > 2:
                ends.setdefault(p[-3:], set()).add(len(p))
        self.ends2 = {p: (2, 1) for p in self.usable if len(p) == 2}
        self.ends3 = {k: (*sorted(v, reverse=True), *self.ends2.get(k[1:], (1,))) for k, v in ends.items()}
        self.names = {i: p for p, i in self.ids.items()}
        self.stable: dict[int, bool] = {}
        self.known: dict[str, bytes] = {}

    def merge(self, word: str) -> list[str]:
        """Pieces by merging the best-scored pair, leftmost first, again and again."""
        n, score = len(word), self.score
        part, nxt, prev = list(word), list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []

        def offer(i: int) -> None:
            j = nxt[i]
            if j < n and (s := score.get(part[i] + part[j])) is not None:
                heap.append((-s, i, part[i], part[j])) if not ready else heapq.heappush(heap, (-s, i, part[i], part[j]))

        ready = False
        for i in range(n - 1):
            offer(i)
        heapq.heapify(heap)
        ready = True
        while heap:
            _, i, a, b = heapq.heappop(heap)
            if part[i] != a or (j := nxt[i]) >= n or part[j] != b:
                continue
            part[i], part[j], nxt[i] = a + b, "", nxt[j]
            if nxt[j] < n:
                prev[nxt[j]] = i
            offer(i)
            if prev[i] >= 0:
                offer(prev[i])
        return [p for p in part if p]

    def fits(self, a: str, b: str) -> bool:
        """Whether merging a + b leaves a and b: no merge across their border comes due first.

        The merges inside a and b are undone from the last to the first; at each point the
        pieces then at the border must not have been the better, or equally good left, pair.
        """
        rank, halves, due, left_first = self.rank, self.halves, float("inf"), True
        while True:
            r = rank.get(a + b)
            if r is not None and (r < due or r == due and not left_first):
                out = False
                break
            ra, rb = rank.get(a, -1.0), rank.get(b, -1.0)
            if ra < 0 and rb < 0:
                out = True
                break
            if ra > rb:
                due, a, left_first = ra, halves[a][1], True
            else:
                due, b, left_first = rb, halves[b][0], False
        return out

    def spell(self, c: str) -> list[int]:
        """Ids of a character without a piece."""
        own = [self.byte[x] for x in c.encode("utf-8", "surrogatepass")]
        return [self.unknown] if None in own else own

    def pack(self, pieces: Iterable[str]) -> bytes:
        out = array("i")
        for p in pieces:
            i = self.ids.get(p)
            out.extend(self.spell(p) if i is None else (i,))
        return out.tobytes()

    def encode_words(self, words: Iterable[str]) -> dict[str, bytes]:
        """Packed ids of each distinct word."""
        out: dict[str, bytes] = {}
        ids, usable, ends2, ends3, names, stable = self.ids, self.usable, self.ends2, self.ends3, self.names, self.stable
        unknown = -1  # a character without a piece: merges with nothing
        before, last, back = "", [unknown], [0]  # of each prefix: its last piece and where that begins
        for word in sorted(words):
            if word.startswith(MARK + MARK):  # pieces of marks only have equal scores, which the merge itself orders
                out[word] = self.pack(self.merge(word))
                continue
            n, keep = len(word), 0
            for x, y in zip(before, word):
                if x != y:
                    break
                keep += 1
            del last[keep + 1 :], back[keep + 1 :]
            for i in range(keep + 1, n + 1):
                if i > 2:
                    tail = word[i - 3 : i]
                    steps = ends3.get(tail) or ends2.get(tail[1:], (1,))
                else:
                    steps = (2, 1) if i == 2 else (1,)
                for step in steps:
                    j = i - step
                    if j < 0:
                        continue
                    piece = word[j:i]
                    now = ids.get(piece, unknown)
                    if now == unknown or piece not in usable:
                        if step > 1:
                            continue
                        break
                    if not j or last[j] == unknown:
                        break
                    key = last[j] << 32 | now
                    ok = stable.get(key)
                    if ok is None:
                        if len(stable) >= STABLE:
                            stable.clear()
                        ok = stable[key] = self.fits(names[last[j]], piece)
                    if ok:
                        break
                last.append(now)
                back.append(j)
            before = word
            path, i = [], n
            while i:
                now, j = last[i], back[i]
                if now == unknown:
                    path.extend(reversed(self.spell(word[j:i])))
                else:
                    path.append(now)
                i = j
            path.reverse()
            out[word] = array("i", path).tobytes()
        return out

    def encode(self, texts: list[str | None]) -> Iterator[bytes]:
        """Packed int32 ids of each text; null and empty texts have none."""
        i = 0
        while i < len(texts):
            j, held, total = i, [], 0
            while j < len(texts) and (j == i or total < CHARS):
                t = texts[j]
                held.append(units_of(t) if t else [])
                total += len(t or "")
                j += 1
            known = self.known
            own = self.encode_words({w for units in held for w in units if w not in known})
            for units in held:
                yield b"".join([known.get(w) or own[w] for w in units])
            if len(known) < REMEMBERED:
                for w, b in own.items():
                    if len(w) <= 24:
                        known[w] = b
                        if len(known) >= REMEMBERED:
                            break
            i = j

    def decode_all(self, encoded: list[bytes]) -> Iterator[tuple[bytes, int]]:
        """(UTF-8 bytes, characters) of each of several texts' ids, spelt out at once."""
        ids = np.frombuffer(b"".join(encoded), np.int32)
        size = self.lengths[ids]
        ends = np.concatenate([[0], np.cumsum(size)])
        letters = self.letters[np.repeat(self.begins[ids] - ends[:-1], size) + np.arange(ends[-1])]
        points = np.concatenate([[0], np.cumsum((letters & 0xC0) != 0x80)])
        bounds = ends[np.concatenate([[0], np.cumsum([len(e) // 4 for e in encoded])])]
        data = letters.tobytes()
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            a += data[a : a + 1] == b" " and b > a
            yield data[a:b], int(points[b] - points[a])

    def decode(self, ids: bytes | np.ndarray) -> str:
        ids = np.frombuffer(ids, np.int32) if isinstance(ids, bytes) else ids
        text = self.text
        return b"".join([text[i] for i in ids.tolist()]).removeprefix(b" ").decode("utf-8", "replace")


#: By model file; compiled once in a worker.
_codecs: dict[str, Codec] = {}


class Tokenizer:
    """DataFrame operators over one model; its pieces (a bounded vocabulary) are broadcast once.

    Null text gives null ids, null ids null text; empty gives empty. Columns keep their
    order and the result column replaces one of the same name.
    """

    def __init__(self, spark, model_file: str = MODEL):
        self.shared, self.key = spark.sparkContext.broadcast(load_pieces(model_file)), model_file

    def _codec(self):
        shared, key = self.shared, self.key
        return lambda: _codecs.get(key) or _codecs.setdefault(key, Codec(shared.value))

    def encode(self, df: DataFrame, text: str = "text", to: str = "ids") -> DataFrame:
        codec = self._codec()

        @F.pandas_udf("array<int>")
        def run(texts):
            values = texts.astype(object).where(texts.notna(), None).tolist()
            out = [np.frombuffer(b, np.int32) for b in codec().encode(values)]
            return type(texts)([None if t is None else x for t, x in zip(values, out)], dtype=object)

        return df.withColumn(to, run(text))

    def decode(self, df: DataFrame, ids: str = "ids", to: str = "text") -> DataFrame:
        codec = self._codec()

        @F.pandas_udf("string")
        def run(column):
            c = codec()
            return type(column)([None if x is None else c.decode(np.asarray(x, np.int32)) for x in column], dtype=object)

        return df.withColumn(to, run(ids))

    def report(self, documents: DataFrame) -> DataFrame:
        """doc_id, n_tokens, ids_sha256 (of the int32 ids, little-endian), n_decoded (characters), round_trip.

        round_trip: decoding gives the text back, a word mark in it read as a blank. Null
        text: as empty. One row for each row; repeated rows, null ids and further columns allowed.
        """
        codec = self._codec()

        def run(batches):
            c = codec()
            for b in (whole.slice(at, SLICE) for whole in batches for at in range(0, whole.num_rows, SLICE)):
                texts = b.column(1).to_pylist()
                n, sha, size, same = [], [], [], []
                encoded = list(c.encode(texts))
                for t, ids, (back, points) in zip(texts, encoded, c.decode_all(encoded)):
                    good = back == (t or "").replace(MARK, " ").encode("utf-8", "surrogatepass")
                    n.append(len(ids) // 4)
                    sha.append(hashlib.sha256(ids).hexdigest())
                    size.append(points if good else len(back.decode("utf-8", "replace")))
                    same.append(good)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(size, pa.int64()), pa.array(same, pa.bool_())],
                    names=["doc_id", "n_tokens", "ids_sha256", "n_decoded", "round_trip"],
                )

        rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        return rows.mapInArrow(lean(run), "doc_id long, n_tokens long, ids_sha256 string, n_decoded long, round_trip boolean")
