"""op3_paragraph_dedup on what a minimum of words and whole lines as the only unit leave out."""

import collections
import hashlib
import random
import re

import numpy as np
from pyspark.sql import functions as F

from textcurate.llm import paragraph_dedup
from textcurate.llm.hashing import _MULT, digest, hash_words, mix, word_spans
from textcurate.llm.queries import op3_paragraph_dedup


def shingles(line):
    w = re.findall(r"[^\x20\x09-\x0D]+", line.lower())
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def blocks_of(text):
    """(number of the first word, words) of a text's blocks, anchor by anchor."""
    w = re.findall(rb"[^\x20\x09-\x0D]+", text.encode())
    if len(w) < paragraph_dedup.BLOCK:
        return w, []
    buf = np.frombuffer(text.encode(), np.uint8)
    h = hash_words(buf, *word_spans(buf)).tolist()
    near, k = paragraph_dedup.NEAR, paragraph_dedup.ANCHOR
    mixed = [int(mix(np.array([sum(h[i + j] * int(_MULT[j]) for j in range(k)) % (1 << 64)], np.uint64))[0]) for i in range(len(w) - k + 1)]
    anchors = {i for s in range(len(mixed) - near + 1) for i in range(s, s + near) if mixed[i] == min(mixed[s : s + near])}
    return w, [(i, tuple(x.lower() for x in w[i : i + paragraph_dedup.BLOCK])) for i in sorted(anchors) if i + paragraph_dedup.BLOCK <= len(w)]


def by_blocks(rows, docs):
    """(doc_id, text) -> (removed positions, blocks that another document has); docs: the rows' hashes."""
    rows = list(dict.fromkeys(rows))
    key = lambda i, t: (i is not None, i or 0, docs[i, t])  # noqa: E731  null ids come first
    places = collections.defaultdict(list)
    for i, t in rows:
        for at, words in blocks_of(t)[1]:
            places[words].append((i, t, at))
    gone, kept, spread = collections.defaultdict(set), collections.defaultdict(set), collections.Counter()
    for own in places.values():
        if len(own) > 1:
            stays = min(own, key=lambda x: (key(*x[:2]), x[2]))
            for i, t, at in own:
                (kept if (i, t, at) == stays else gone)[i, t].add(at)
                spread[i, t] += len({x[:2] for x in own}) > 1
    out = {}
    for i, t in rows:
        spans = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", t.encode())]
        cover = lambda ats: {p for a in ats for p in range(spans[a][0], spans[a + paragraph_dedup.BLOCK - 1][1])}
        out[i, t] = (cover(gone[i, t]) - cover(kept[i, t]), spread[i, t])
    return out


def test_op3_blocks_like_brute_force(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 6)))
    passages = [[word() for _ in range(n)] for n in (51, 60, 120, 51)]
    rows = []
    for i in range(24):
        t = [word() for _ in range(rng.randint(0, 60))] + passages[i % 4] + [word() for _ in range(rng.randint(0, 60))]
        rows.append((i, " ".join(x + ("\n" if rng.random() < 0.05 else "") for x in t)))
    clean = [(100 + i, " ".join(word() for _ in range(300))) for i in range(10)]
    rows += clean + [(200, "a b " * 400), (201, " ".join(word() for _ in range(25)) + " é" * 60), (None, rows[0][1]), (None, rows[1][1]), (3, "\n".join(passages[0])), rows[5], rows[6]]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("doc", "id", "class", "at")})
    docs = {(r["doc_id"], r["text"]): r["h"] for r in df.select("doc_id", "text", F.xxhash64("doc_id", F.xxhash64("text")).alias("h")).collect()}
    want = by_blocks(rows, docs)
    got = paragraph_dedup.removals(df, min_words=10_000).collect()
    assert len(got) == len(rows)
    texts = collections.defaultdict(list)
    for i, t in rows:
        texts[i, hashlib.sha256(b"".join(t.encode()[p : p + 1] for p in range(len(t.encode())) if p not in want[i, t][0])).hexdigest()].append(t)
    for r in got:
        t = texts[r["doc_id"], r["kept_sha256"]][0]
        gone, spread = want[r["doc_id"], t]
        assert {p for x in r["removed"] for p in range(x["s"], x["e"])} == gone and r["n_removed"] == len(gone) and r["n_bytes"] == len(t.encode())
        assert r["n_spans"] == sum(p - 1 not in gone for p in gone) and r["n_passages_repeated"] == spread
        assert (r["n_passages_repeated"] > 0) == (r["doc_id"] is None or r["doc_id"] < 24)


def test_op3_empty_null_and_long(spark):
    assert paragraph_dedup.deduplicate(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    long = " ".join(f"w{i}" for i in range(400_000))
    rows = [(1, None), (1, None), (2, ""), (3, long + "\nends here"), (4, "starts there " + long), (5, "x" * 3_000_000), (6, "\n" * 100_000)]
    got = {r["doc_id"]: r for r in paragraph_dedup.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1]["n_bytes"] == got[2]["n_removed"] == got[5]["n_removed"] == got[6]["n_removed"] == got[3]["n_removed"] == 0
    assert got[4]["n_removed"] == len(rows[4][1]) and got[3]["n_passages_repeated"] == got[4]["n_passages_repeated"] > 20_000


def by_lines(rows):
    """(doc_id, n_removed, kept, paragraphs removed, paragraphs repeated) by brute force; ids are distinct."""
    lines = [(i, k, shingles(x)) for i, t in rows for k, x in enumerate(t.split("\n")) if shingles(x)]
    up = list(range(len(lines)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, (_, _, a) in enumerate(lines):
        for j, (_, _, b) in enumerate(lines[:i]):
            if 5 * len(a & b) >= 4 * len(a | b):
                x, y = sorted((find(i), find(j)))
                up[y] = x
    groups = collections.defaultdict(list)
    for n, line in enumerate(lines):
        groups[find(n)].append(line[:2])
    repeated = [sorted(g) for g in groups.values() if len(g) > 1]
    gone = {x for g in repeated for x in g[1:]}
    for i, t in rows:
        kept = "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in gone)
        yield i, len(t.encode()) - len(kept.encode()), hashlib.sha256(kept.encode()).hexdigest(), sum(x[0] == i for x in gone), sum(x[0] == i for g in repeated for x in g)


def saved(spark, tmp_path, rows):
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    return op3_paragraph_dedup(spark, str(tmp_path)).collect()


def test_op3_takes_lines_of_any_length(spark, tmp_path):
    licence = "you should have received a copy of the general public licence"
    nine = " ".join(f"near{k}" for k in range(13))
    rows = [(i, f"own{i} text\n{licence}\n\nHome\nonly{i}") for i in range(4)]
    rows += [(4, "home\n" + nine), (5, nine + " more"), (6, "a b"), (7, "b a"), (8, "A  b"), (9, ""), (10, " \n ")]
    got = {tuple(r[c] for c in ("doc_id", "n_removed", "kept_sha256", "n_paragraphs_removed", "n_paragraphs_repeated")) for r in saved(spark, tmp_path, rows)}
    assert got == set(by_lines(rows))


def test_digests_at_once():
    g = np.random.default_rng(5)
    bounds = np.concatenate([[0], np.cumsum(g.integers(1, 9, 50))])
    h = g.integers(0, 6, bounds[-1]).astype(np.uint64)
    digs, sizes = paragraph_dedup.distinct_sets(h, bounds)
    for k, (a, b) in enumerate(zip(bounds[:-1], bounds[1:])):
        assert digs[k] == digest(np.unique(h[a:b])) and sizes[k] == len(set(h[a:b].tolist()))
