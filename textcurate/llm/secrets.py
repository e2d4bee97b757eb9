"""Secret scanning with one combined deterministic automaton for all rules.

One forward pass of the combined automaton over a buffer finds the lines that hold a secret of
any rule. Over such a line alone, one backward pass of a second combined automaton marks every
byte at which some rule's match starts, so that no start is tried in vain: each match is then
read from its start to its end, and the next is sought behind it. All passes are linear.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .automaton import Automaton, compile_rules, scan_lanes
from .hashing import batches
from .runtime import lean

# Fixed values: (kind, pattern of the prefix, pattern of the body, fold case in the prefix, least body, least span).
RULES = [
    ("assign", "(password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?", "[A-Za-z0-9+/_.=\\-]", True, 12, 0),
    ("access", "AKIA", "[A-Z0-9]", False, 1, 18),
    ("hex", "", "[0-9a-f]", False, 16, 0),
    ("github", "gh[pousr]_", "[A-Za-z0-9]", False, 36, 0),
    ("jwt", "eyJ[A-Za-z0-9_\\-]+\\.eyJ[A-Za-z0-9_\\-]+\\.", "[A-Za-z0-9_\\-]", False, 16, 0),
]
BASE = ("assign", "access", "hex")


class Scanner:
    """All rules of RULES: the combined automata find lines and starts, the rules' own the ends."""

    def __init__(self) -> None:
        long = []
        short = []
        self.rules: list[tuple[Automaton, Automaton | None, int, int]] = []
        for kind, prefix, body, fold, least, span in RULES:
            pre = _fold(prefix) if fold else prefix
            low = least if kind in ("assign", "hex") else 1  # fewer counters to combine; the rule's own automaton decides
            long.append((f"{pre}{body}{{{low},}}", False))
            short.append((f"{pre}{body}+", False))
            self.rules.append((compile_rules(short[-1:]), compile_rules([(pre, False)]) if pre else None, least, span))
        self.combined = compile_rules(long, anywhere=True)
        self.starts = compile_rules(short, anywhere=True, backward=True)
        self.resets = self.combined.resets()
        if not self.resets[10]:
            raise ValueError("a rule may not cross lines")

    def segment(self, data: bytes, a: int, b: int) -> list[tuple[int, int, int]]:
        """(start, end, rule) of each rule's leftmost non-overlapping matches within data[a:b]."""
        out = []
        marks = self.starts.accepting(data, range(b - 1, a - 1, -1))[::-1]
        for r, (whole, pre, least, span) in enumerate(self.rules):
            e = a
            for i, mask in marks:
                if i < e or not mask >> r & 1:
                    continue
                e = whole.longest(data, i, b)
                body = e - (pre.longest(data, i, e) if pre else i)
                if body >= least and e - i >= span:
                    out.append((i, e, r))
        return out

    def scan(self, buf: np.ndarray) -> list[tuple[int, int, int]]:
        """(start, end, rule) of a buffer of lines, by start, then rule."""
        hits = scan_lanes(self.combined, buf, self.resets)
        if not len(hits):
            return []
        cuts = np.concatenate([[-1], np.flatnonzero(self.resets[buf]), [len(buf)]])
        parts = np.unique(np.searchsorted(cuts, hits))
        data = buf.tobytes()
        out = [x for p in parts for x in self.segment(data, int(cuts[p - 1]) + 1, int(cuts[p]))]
        return sorted(out, key=lambda x: (x[0], x[2]))

    def texts(self, texts: Sequence[str | None] | pa.Array) -> Iterator[tuple[int, list[tuple[int, int, int]]]]:
        """(text number, spans in code points) of the texts that have any."""
        for first, _, buf, at in batches(texts):
            found = self.scan(buf)
            docs = np.searchsorted(at, [x[0] for x in found], "right") - 1 if found else []
            by: dict[int, list] = {}
            for d, x in zip(docs, found):
                by.setdefault(int(d), []).append(x)
            for d, xs in by.items():
                points = np.concatenate([[0], np.cumsum((buf[at[d] : at[d + 1]] & 0xC0) != 0x80)])
                yield first + d, [(int(points[s - at[d]]), int(points[e - at[d]]), r) for s, e, r in xs]


def _fold(pattern: str) -> str:
    """The pattern with each letter outside classes and escapes in either case."""
    out, i, inside = [], 0, False
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            size = 4 if pattern[i + 1] == "x" else 2
            out.append(pattern[i : i + size])
            i += size
            continue
        inside = c == "[" or inside and c != "]"
        out.append(f"[{c.lower()}{c.upper()}]" if c.isalpha() and not inside else c)
        i += 1
    return "".join(out)


_scanner: list[Scanner] = []


def scanner() -> Scanner:
    """The worker's scanner, compiled once."""
    if not _scanner:
        _scanner.append(Scanner())
    return _scanner[0]


def scan_secrets(documents: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans: one row per row of documents.

    Spans are kind:start:end in code points, end exclusive, by start, then in the order of
    RULES. Null or empty text has none (empty spans, digest of no bytes). Repeated rows, null
    ids and further columns are allowed; no rows give no rows. Map-only: nothing is shuffled.
    """

    def scan(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = scanner()
        kinds = [r[0] for r in RULES]
        for b in parts:
            found = dict(s.texts(b.column(1)))
            spans, sha, counts = [], [], {k: [] for k in BASE}
            for i in range(b.num_rows):
                own = found.get(i, [])
                text = [f"{kinds[r]}:{a}:{e}" for a, e, r in own]
                base = [t for t, x in zip(text, own) if kinds[x[2]] in BASE]
                spans.append(",".join(text))
                sha.append(hashlib.sha256(",".join(base).encode()).hexdigest())
                for k in BASE:
                    counts[k].append(sum(kinds[r] == k for _, _, r in own))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array(counts[k], pa.int64()) for k in BASE), pa.array(sha, pa.string()), pa.array(spans, pa.string())],
                names=["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans"],
            )

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(lean(scan), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact(documents: DataFrame, mark: str = "[secret]") -> DataFrame:
    """documents with each secret span of `text` (overlaps joined) replaced by `mark`; other columns as they are.

    Texts without secrets stay as they are; n_chars, if there, follows the text.
    """

    @F.pandas_udf("string")
    def clean(texts):
        out = texts.astype(object).where(texts.notna(), None)
        values = out.tolist()
        for i, spans in scanner().texts(values):
            t, parts, at = values[i], [], 0
            for a, e, _ in spans:
                if a >= at:
                    parts += [t[at:a], mark]
                at = max(at, e)
            values[i] = "".join([*parts, t[at:]])
        return type(texts)(values, dtype=object)

    out = documents.withColumn("text", clean("text"))
    return out.withColumn("n_chars", F.length("text").cast(documents.schema["n_chars"].dataType)) if "n_chars" in documents.columns else out
