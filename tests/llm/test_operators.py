"""Operators against brute force on small tables with nulls, empty and long texts, ties, repeats and clashing columns."""

import collections
import hashlib
import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from textcurate.llm import arrays, decontaminate, hilbert_shards, jaccard_join, kneser_ney, linking, lookup, pieces, runtime, secrets, substring_dedup, topk, toxicity
from textcurate.llm.automaton import compile_rules
from textcurate.llm.rtree import CountRTree, count_vector, may_link, overlap
from textcurate.llm.runtime import connected_components
from textcurate.llm.suffixes import suffix_ranks

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
rng = random.Random(11)
VOCAB = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 5))) for _ in range(400)]


def sentence(n):
    return " ".join(rng.choice(VOCAB) for _ in range(n))


def edited(text, k):
    w = text.split(" ")
    for _ in range(k):
        w[rng.randrange(len(w))] = rng.choice(VOCAB)
    return " ".join(w)


def corpus():
    base = [sentence(n) for n in (60, 120, 200)]
    rows = [(i, edited(base[i % 3], rng.randint(0, 6))) for i in range(45)]
    rows += [(50 + i, sentence(40) + "\n" + base[0] + "\n" + sentence(5)) for i in range(4)]
    rows += [(60, None), (61, ""), (62, " \n "), (63, "a b"), (64, "A b"), (65, "x"), (66, "ab " * 3000), (67, "q" * 900), (3, rows[3][1]), (3, "other text of the same id"), (None, rows[4][1]), (None, None)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("id", "n", "cell", "spans", "score", "lang", "source")})


def shingles(text, k=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def components(n, pairs):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_op1_jaccard_join(spark):
    rows = corpus()
    sets = [shingles(t) for _, t in rows]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    comp = components(len(rows), pairs)
    least = {}
    for (i, _), c in zip(rows, comp):
        least[c] = min(x for x in (i, least.get(c)) if x is not None) if i is not None or least.get(c) is not None else None
    want = collections.Counter((i, len(s), least[c] if s else i) for (i, _), s, c in zip(rows, sets, comp))
    got = collections.Counter(tuple(r) for r in jaccard_join.classes_of(frame(spark, rows)).collect())
    assert got == want
    assert jaccard_join.classes_of(frame(spark, [])).collect() == []


def test_count_tree_bounds_overlap():
    g = np.random.default_rng(3)
    sets = [np.unique(g.integers(0, 1 << 63, n, dtype=np.uint64)) for n in g.integers(1, 300, 60)]
    sets += [np.unique(np.concatenate([s[: int(len(s) * 0.95)], g.integers(0, 1 << 63, 3, dtype=np.uint64)])) for s in sets]
    points, sizes = np.array([count_vector(s) for s in sets]).astype(np.int64), np.array([len(s) for s in sets])
    tree = CountRTree(points, sizes)
    for i, s in enumerate(sets):
        hit = set(tree.search(points[i], len(s), 4, 5).tolist())
        for j, t in enumerate(sets):
            both = overlap(s, t)
            assert both == len(np.intersect1d(s, t)) <= np.minimum(points[i], points[j]).sum()
            if 5 * both >= 4 * (len(s) + len(t) - both):
                assert j in hit and may_link(np.int64(both), np.int64(len(s)), np.int64(len(t)), 4, 5)
    assert len(CountRTree(points[:0], sizes[:0]).search(points[0], 3, 4, 5)) == 0


def test_connected_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 99), (99, 98), (5, 5), (200, 200)]
    got = dict(map(tuple, connected_components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert all(got[i] == 0 for i in range(31)) and got[100] == got[99] == got[98] == 98 and got[200] == 200


def without_repeats(rows, length):
    """Rows of op2 by brute force, and what is left of each text."""
    data = [(i, (t or "").encode()) for i, t in rows]
    count = collections.Counter(b[k : k + length] for _, b in data for k in range(len(b) - length + 1))
    for i, b in data:
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if count[b[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        left = bytes(x for x, g in zip(b, gone) if not g)
        yield i, len(b), sum(gone), len(re.findall(b"\1+", gone)), hashlib.sha256(left).hexdigest(), left


@pytest.mark.parametrize("opened", [substring_dedup.OPENED, 1])
def test_op2_substring_dedup(spark, monkeypatch, opened):
    monkeypatch.setattr(substring_dedup, "OPENED", opened)  # with 1, every trigger is counted by window hashes
    length, rows = 60, corpus()
    got = [tuple(r) for r in substring_dedup.deduplicate(frame(spark, rows), length, texts=True).collect()]
    assert sorted(((*r[:5], bytes(r[5])) for r in got), key=str) == sorted(without_repeats(rows, length), key=str)
    assert substring_dedup.deduplicate(frame(spark, []), length).collect() == []


def test_op2_hot_trigger_and_long_text(spark):
    line = "every one of these texts has this very line of text"
    rows = [(i, "".join(rng.choice("abcdefgh ") for _ in range(90)) + line + "".join(rng.choice("abcdefgh ") for _ in range(90))) for i in range(12_000)]
    rows += [(20_000 + i, rows[i][1][5:215] + "x" * i) for i in range(5)]
    long = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(1_300_000))
    part = long[1_048_400:1_048_900]  # over the seam of two parts of a long text
    rows += [(30_000, long), (30_001, "before " + part + " after"), (30_002, "y" * 1_200_000)]
    got = {r["doc_id"]: tuple(r) for r in substring_dedup.deduplicate(frame(spark, rows)).collect()}
    small = [r for r in rows if len(r[1]) < 10_000]
    want = {r[0]: r[:5] for r in without_repeats([*small, (30_000, part)], 200)}
    assert all(got[i] == want[i] for i, _ in small)
    left = long.replace(part, "").encode()
    assert got[30_000] == (30_000, len(long), len(part), 1, hashlib.sha256(left).hexdigest()) and got[30_002][2:4] == (1_200_000, 1)


@pytest.mark.parametrize("depth", [3, 8, 20, 200])
def test_suffix_ranks(depth):
    g = np.random.default_rng(depth)
    for n in (0, 1, 5, 300):
        for letters in (1, 2, 4):
            b = g.integers(0, letters, n).astype(np.uint8)
            own = [b.tobytes()[i : i + depth] for i in range(n)]
            assert suffix_ranks(b, depth).tolist() == [sum(y < x for y in own) for x in own]


def test_op4_hilbert(spark):
    rows = corpus()
    out = hilbert_shards.shard(frame(spark, rows), 5).collect()
    sizes = collections.Counter(r["shard"] for r in out)
    assert len(out) == len(rows) and max(sizes.values()) - min(sizes.values()) <= 1
    for s in sizes:
        assert sorted(r["slot"] for r in out if r["shard"] == s) == list(range(sizes[s]))
    assert collections.Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in out) == collections.Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows)
    ranked = [r["hilbert"] for r in sorted(out, key=lambda r: (r["shard"], r["slot"]))]
    assert ranked == sorted(ranked) and hilbert_shards.shard(frame(spark, []), 5).collect() == []


def test_hilbert_shards_can_be_skipped(spark, tmp_path):
    langs, sources = ["de", "en", "es", "fr"], [f"src{i:02d}" for i in range(20)]
    rows = [(i, "x" * int(2 ** rng.uniform(3, 12)), rng.choice(langs), rng.choice(sources), 1) for i in range(6000)] + [(None, None, None, None, 2), (1, "", "en", None, 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int")
    stats = hilbert_shards.write_shards(df, str(tmp_path / "shards"), 24).collect()
    assert len(stats) == 24 and sum(r["rows"] for r in stats) == len(rows)
    held = lambda r, d, v: r[f"least_{d}"] is not None and r[f"least_{d}"] <= v <= r[f"greatest_{d}"]
    share = lambda test: sum(map(test, stats)) / len(stats)
    by_lang = np.mean([share(lambda r, v=v: held(r, "lang", v)) for v in langs])
    by_source = np.mean([share(lambda r, v=v: held(r, "source", v)) for v in sources])
    by_size = np.mean([share(lambda r, v=v: held(r, "size", v)) for v in (20, 100, 700, 3000)])
    by_two = np.mean([share(lambda r, v=v, w=w: held(r, "lang", v) and held(r, "source", w)) for v in langs for w in sources])
    assert max(by_lang, by_source, by_size) < 0.65 and by_two < 0.3, (by_lang, by_source, by_size, by_two)
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert sorted(map(str, map(tuple, back.select(*df.columns).collect()))) == sorted(map(str, rows))
    one = {(r["doc_id"], r["text_crc32"]): (r["shard"], r["slot"]) for r in hilbert_shards.shard(df, 24).collect()}
    assert {(r["doc_id"], r["c"]): (r["shard"], r["slot"]) for r in back.select("doc_id", F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("c"), "shard", "slot").collect()} == one


def test_hilbert_curve_is_continuous():
    g = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), -1).reshape(-1, 3)
    h = hilbert_shards.hilbert_index(g, 3)
    assert sorted(h) == list(range(512)) and (np.abs(np.diff(g[np.argsort(h)], axis=0)).sum(1) == 1).all()


KINDS = [
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12, 0),
    ("access", "(AKIA)([A-Z0-9]+)", 0, 18),
    ("hex", "()([0-9a-f]+)", 16, 0),
    ("github", "(gh[pousr]_)([A-Za-z0-9]+)", 36, 0),
    ("jwt", r"(eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.)([A-Za-z0-9_-]+)", 16, 0),
]


def all_spans(t):
    """(start, kind number, end) by regular expressions; base kinds come first in KINDS."""
    return sorted((m.start(), k, m.end()) for k, (_, p, body, whole) in enumerate(KINDS) for m in re.finditer(p, t) if len(m[2]) >= body and len(m[0]) >= whole)


def test_op5_secrets(spark):
    bits = ["password", "Token", "api_key", "APIKEY", "=", ":", " ", '"', "abcdef0123456789", "AKIA", "ABCD1234EFGH5678", "é", "\n", ",", "abcdefghijklm", "==", "ghp_" + "a" * 36, "gho_", "eyJ", "eyJhbGciOi", "."]
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.randint(0, 30)))) for i in range(400)] + [(400, None), (401, "a" * 100_000), (None, "token=xxsecret: abcdefghijkl"), (5, ""), (5, "")]
    name = lambda spans: ",".join(f"{KINDS[k][0]}:{a}:{e}" for a, k, e in spans)
    for r, (_, t) in zip(secrets.scan_secrets(frame(spark, rows)).collect(), rows):
        want = all_spans(t or "")
        assert r["spans"] == name(want)
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(k == x for _, k, _ in want) for x in range(3)]
        assert r["base_sha256"] == hashlib.sha256(name(x for x in want if x[1] < 3).encode()).hexdigest()
    clean = secrets.redact(frame(spark, rows)).collect()
    assert not any(all_spans(r["text"] or "") for r in clean) and secrets.scan_secrets(frame(spark, [])).collect() == []


@pytest.mark.parametrize("text", ["eyJ" * 330_000, "x" * 1_000_000, "token: " * 150_000, "token" + " " * 1_000_000, "deadbeef" * 130_000])
def test_op5_time_is_linear(text):
    scanner = secrets.scanner()
    for t in (text, text + " token=abcdefghijklmnop", text + "token=abcdefghijklmnop"):
        began = time.time()
        got = dict(scanner.texts([t])).get(0, [])
        assert time.time() - began < 4 and [(a, k, e) for a, e, k in got] == all_spans(t.replace("eyJeyJ", "eyj" * 2))


@pytest.mark.parametrize("pattern", ["a(b|c)*d?", "[a-c]{3,}x", "(ab|a)(c|bcd)"])
def test_automaton_is_longest_match(pattern):
    a = compile_rules([(pattern, False)])
    for _ in range(300):
        t = "".join(rng.choice("abcdx") for _ in range(8))
        want = max((k for k in range(1, 9) if re.fullmatch(pattern, t[:k])), default=-1)
        assert a.longest(t.encode(), 0, 8) == want


@pytest.mark.parametrize("most", [decontaminate.MAX_LITERALS, 0])
def test_op6_decontamination(spark, monkeypatch, most):
    monkeypatch.setattr(decontaminate, "MAX_LITERALS", most)  # with 0, shingles are joined
    item = sentence(30)
    w = item.split(" ")
    bench = spark.createDataFrame([(1, item), (2, "solo"), (3, None), (4, "..."), (5, " ".join(w[5:20])), (5, "two words")], "item_id long, text string")
    rows = corpus() + [(70, "pre " + " ".join(w[2:14]).upper().replace("É", "é") + " post"), (71, " ".join(w[:9])), (72, "so solo!"), (73, "two words"), (73, "two words")]

    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOW))

    items = [(str(r["item_id"]), words(r["text"])) for r in bench.collect()]
    want = []
    for i, t in rows:
        d, hit, found = words(t), set(), set()
        for name, x in items:
            size = min(10, len(x))
            wins = {tuple(x[k : k + size]) for k in range(len(x) - size + 1)} if x else set()
            for k in range(len(d) - size + 1):
                if x and tuple(d[k : k + size]) in wins:
                    hit.update(range(k, k + size))
                    found.add(name)
        want.append((i, len(d), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    got = [tuple(r) for r in decontaminate.decontaminate(frame(spark, rows), bench).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert decontaminate.decontaminate(frame(spark, []), bench).collect() == [] and decontaminate.decontaminate(frame(spark, rows[:2]), bench.limit(0)).count() == 2


def test_op7_top_k(spark, monkeypatch):
    g = np.random.default_rng(5)
    v = [(i, [float(x) for x in g.normal(0, 0.2, 8)]) for i in range(260)] + [(i, [0.1] * 8) for i in range(300, 340)]
    v += [(1000, None), (1001, [0.1, None] * 4), (1002, [float("nan")] * 8), (1050, [float("inf")] * 8)]
    df = spark.createDataFrame(v, "vec_id long, embedding array<float>").withColumn("score", F.lit(1))
    q = topk.quantise(df)
    rows = {r["id"]: np.array(r["v"]) for r in q.collect()}
    assert len(rows) == 300
    monkeypatch.setattr(topk, "FILE", 2)
    got = topk.top_k(q, q.where("id % 50 = 0"), 5).collect()
    want = [(a, r, i, -s) for a in rows if a % 50 == 0 for r, (s, i) in enumerate(sorted((-int(rows[a] @ x), i) for i, x in rows.items() if i != a)[:5], 1)]
    assert sorted(map(tuple, got)) == sorted(want)
    for a in (0, 50, 300):
        mine = [r for r in topk.top_k(q, q.where(F.col("id") == a), 5).orderBy("rank").collect()]
        want = sorted(((-int(rows[a] @ x), i) for i, x in rows.items() if i != a))[:5]
        assert [(-r["score"], r["vec_id"]) for r in mine] == want
    assert topk.top_k(q.limit(3), q.limit(1), 5).count() == 2 and topk.top_k(q, q.limit(0)).count() == 0


@pytest.mark.parametrize("scale", [1, 200, 1 << 40])
def test_impact_index_is_exact(scale):
    g = np.random.default_rng(scale)
    v = (g.normal(0, 1, (3000, 16)) * scale).astype(np.int64)
    v[100:200] = v[0]
    ids = g.permutation(3000) - 5
    q = v[[0, 5, 100, 2999]]
    index = topk.ImpactIndex(ids, v)
    skip = np.array([ids[0], -99, ids[150], ids[2999]])
    for least in (np.full(4, np.iinfo(np.int64).min), np.sort(v @ q.T, 0)[-3] if scale < 1 << 40 else np.full(4, np.iinfo(np.int64).min)):
        for row, own, bound, (s, i) in zip(q, skip, least, index.search(q, 5, skip, least)):
            with np.errstate(over="ignore"):
                want = sorted((-int(x @ row), int(k)) for k, x in zip(ids, v) if k != own)[:5]
            keep = [x for x in want if -x[0] >= bound]
            assert [(-int(a), int(b)) for a, b in zip(s, i)][: len(keep)] == keep


def test_op7_blocks_and_repeated_ids(spark, monkeypatch):
    g = np.random.default_rng(8)
    v = [(i, [float(x) for x in g.normal(0, 0.2, 6)]) for i in range(20_000)] + [(7, [0.5] * 6), (7, [0.5] * 6), (8, [0.1] * 3)]
    q = topk.quantise(spark.createDataFrame(v, "vec_id long, embedding array<float>")).coalesce(1)  # more than a block, fewer than HELD
    mine = topk.top_k(q, q.where("id in (50, 100) and size(v) = 6"), 5).collect()
    rows = [(i, np.floor(256 * np.array(x, np.float32).astype(float)).astype(int)) for i, x in v if len(x) == 6]
    for a in (50, 100):
        want = sorted((-int(rows[a][1] @ x), i) for i, x in rows if i != a)[:5]
        assert [(-r["score"], r["vec_id"]) for r in sorted(mine, key=lambda r: r["rank"]) if r["query_id"] == a] == want


def test_decoder_finds_the_best_path():
    counts = toxicity.trigram_counts(np.frombuffer((" the idiot vile stupid apple " * 30 + "boot success committee ").encode(), np.uint8))
    d = toxicity.Decoder(counts)

    def paths(word):
        """(cost of signs, text) of every path through the lattice."""
        out, before = [(0.0, "")], ""
        for ch in word:
            ways = [(ch, 0.0)] if ch.isalpha() else [(c, toxicity.COST_LEET) for c in toxicity.LEET.get(ch, "")]
            ways += [("", toxicity.COST_GAP)] if ch in toxicity.GAPS else []
            ways += [("", toxicity.COST_REPEAT)] if ch == before else []
            out = [(cost + w, text + c) for cost, text in out for c, w in (ways or [("", 2.0)])]
            before = ch
        return out

    def cost(text):
        k = [0, 0, *(ord(c) - 96 for c in text), 0]
        return sum(d.cost[a][b][c] for a, b, c in zip(k, k[1:], k[2:]))

    for word in ("v1le", "1d10t", "ssttuuppiidd", "v.i.l.e", "appl3", "st*p1d", "b00t", "vvv1lle"):
        best = min((w + cost(t), t) for w, t in paths(word))
        got = d.decode(word)
        assert min(w + cost(t) for w, t in paths(word) if t == got) == pytest.approx(best[0])
    assert d.decode("ssttuuppiidd") == "stupid" and d.decode("v1le") == "vile"


def test_tricky_words_are_found():
    buf = b"a plain line of words\nv 1 l  e then ssttuuppiidd and 1diot fuuun at 12 x\ny z"
    found = [w for _, w in toxicity.tricky_words(np.frombuffer(buf, np.uint8))]
    assert set(found) == {"v1le", "ssttuuppiidd", "1diot", "fuuun", "yz"}


def test_op8_toxicity(spark):
    rows = [(i, sentence(30) + (" vile idiotic" if i % 4 == 0 else "")) for i in range(600)] + [(900, None), (901, ""), (None, "vile")]
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(600)], "doc_id long, quality int, toxic int")
    df = frame(spark, rows)
    model = toxicity.train(df, labels)
    out = {r["doc_id"]: r for r in toxicity.score(df, model).collect()}
    held = [r for i, r in out.items() if r["held_out"] and i is not None and i < 600]
    assert len(held) > 100 and all(r["predicted"] == int(i % 4 == 0) for i, r in out.items() if r in held) and out[900]["score"] == out[901]["score"] < 0.5
    tricky = frame(spark, [(1, sentence(20) + " v1le 1diot1c"), (2, sentence(20) + " v i l e i d i o t i c")])
    assert all(r["score"] > out[900]["score"] for r in toxicity.score(tricky, model).collect())
    assert toxicity.reject(df, model).count() == sum(r["score"] < 0.7 for r in out.values())
    empty = toxicity.train(frame(spark, []), labels.limit(0))
    assert toxicity.score(frame(spark, rows[:3]), empty).count() == 3


def test_op10_pieces(spark):
    sentencepiece = pytest.importorskip("sentencepiece")
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    bits = ["a", "the", "ing", " ", "  ", "\n", "é", "😀", "<s>", "12", "http", "://", "er", "ree"]
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.randint(0, 40)))) for i in range(300)] + [(400, None), (401, "a" * 5000), (402, " " * 300), (403, "▁x y")] + corpus()
    t = pieces.Tokenizer(spark)
    ids = t.encode(frame(spark, rows))
    for r in ids.select("text", "ids").collect():
        assert r["ids"] is None if r["text"] is None else r["ids"] == sp.encode(r["text"])
    assert t.decode(ids, "ids", "back").where("not (back <=> replace(text, '▁', ' '))").count() == 0
    assert all(r["round_trip"] for r in t.report(frame(spark, rows)).collect()) and t.report(frame(spark, [])).count() == 0


@pytest.mark.parametrize(("block", "pivots"), [(2048, 4), (8, 0), (5, 1)])
def test_cells_are_searched_whole(spark, monkeypatch, block, pivots):
    monkeypatch.setattr(linking, "BLOCK", block)
    monkeypatch.setattr(linking, "PIVOTS", pivots)
    g = np.random.default_rng(block)
    sets = []
    for n in (20, 60, 400, 513, 700, 900):
        base = np.unique(g.integers(0, 1 << 63, n, dtype=np.uint64))
        for k in range(8):  # copies with ever more members exchanged: some link, some only by others
            keep = base[g.random(len(base)) >= 0.03 * k]
            sets.append(np.unique(np.concatenate([keep, g.integers(0, 1 << 63, len(base) - len(keep), dtype=np.uint64)])))
    ids = [int(x) for x in g.permutation(len(sets) * 3)[: len(sets)]]
    table = spark.createDataFrame([(i, *linking.set_row(s)) for i, s in zip(ids, sets)], linking.SET_SCHEMA)
    cells = [(1, i) for i in ids] + [(2, i) for i in ids[::2]]
    members = linking.shared_cells(spark.createDataFrame(cells + cells[:5], "cell long, id long"))
    got = dict(map(tuple, linking.classes(members, table).collect()))
    pairs = [(a, b) for a in range(len(sets)) for b in range(a) if 5 * overlap(sets[a], sets[b]) >= 4 * (len(sets[a]) + len(sets[b]) - overlap(sets[a], sets[b]))]
    comp = components(len(sets), pairs)
    least = {c: min(i for i, x in zip(ids, comp) if x == c) for c in comp}
    assert pairs and {i: got.get(i, i) for i in ids} == {i: least[c] for i, c in zip(ids, comp)}


def test_join_hot_keeps_every_row(spark, monkeypatch):
    monkeypatch.setattr(linking, "LEAST_HOT", 10)
    monkeypatch.setattr(linking, "HOT", 20)
    rows = spark.createDataFrame([(1, i) for i in range(400)] + [(k, k) for k in range(2, 200)] + [(999, 0)], "key long, v long")
    of = rows.where("key < 999").groupBy("key").agg(F.count("*").alias("times"), F.max("v").alias("most"))
    got = linking.join_hot(rows, of, "key", "t").collect()
    assert sorted((r["key"], r["v"]) for r in got) == sorted((r["key"], r["v"]) for r in rows.where("key < 999").collect())
    assert all(r["most"] == (399 if r["key"] == 1 else r["key"]) for r in got)


def test_values_and_keys_by_lookup(spark):
    g = np.random.default_rng(9)
    keys = [int(x) for x in g.integers(-(1 << 63), (1 << 63) - 1, 50)]
    rows = [(keys[i % 50], int(v)) for i, v in enumerate(g.integers(0, 9, 400))]
    where = lookup.write_values(spark.createDataFrame(rows, "key long, value long"), "t")
    values = lookup.Values(where)
    assert all(values.get(k).tolist() == sorted({v for x, v in rows if x == k}) for k in keys) and values.get(12345) is None
    two = lookup.Values(lookup.write_values(spark.createDataFrame([(5, 2, 1), (5, 1, 7), (5, 1, 7)], "key long, a long, b long"), "t", ("a", "b")))
    assert two.get(5).tolist() == [[1, 7], [2, 1]]
    none = lookup.Values(lookup.write_values(spark.createDataFrame([], "key long, value long"), "t"))
    assert none.get(5) is None
    hashes = g.integers(0, 1 << 64, 300, dtype=np.uint64)
    table = spark.createDataFrame([(h.tobytes(),) for h in np.concatenate([hashes, hashes[:100], hashes[:10]])], "h binary").repartition(5)
    folder, sizes = lookup.count_keys(table, lambda batches: (np.frombuffer(x.as_py(), np.uint64) for b in batches for x in b.column(0)))
    assert lookup.SharedKeys(folder, sizes).times(hashes).tolist() == [3] * 10 + [2] * 90 + [1] * 200


def test_arrays_on_other_stores(tmp_path, monkeypatch):
    monkeypatch.setattr(arrays, "is_local", lambda path: False)
    folder = f"file://{tmp_path}/deep"
    arrays.save_array(folder, "x.npy", np.arange(5))
    arrays.save_array(folder, "x.npy", np.arange(7))
    copy = arrays.map_array(folder, "x.npy")
    assert copy.tolist() == list(range(7)) and arrays.map_array(folder, "x.npy").filename == copy.filename
    arrays._drop_copies()
    assert not __import__("os").path.exists(copy.filename)


def test_temporary_tables_go(spark):
    import os

    with runtime.temporary(spark):
        kept = runtime.materialize(spark.range(3).toDF("x"), "t")
        path = runtime.local_path(kept.inputFiles()[0]).rsplit("/", 1)[0]
        assert os.path.exists(path)
    assert not os.path.exists(path)


def test_very_long_texts(spark):
    long = " ".join(f"w{i % 70_000} x{i}" for i in range(150_000))  # some 2 MB
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"
    rows = [(1, long), (2, long + " and more"), (3, "w1 x1 " * 50), (4, long[: len(long) // 2] + " " + item + " " + long[len(long) // 2 :])]
    df = frame(spark, rows)
    got = {r["doc_id"]: r for r in jaccard_join.classes_of(df).collect()}
    assert {i: r["component_id"] for i, r in got.items()} == {1: 1, 2: 1, 3: 3, 4: 1} and got[1]["n_shingles"] == 299_996
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    hits = {r["doc_id"]: (r["n_words"], r["n_hit"]) for r in decontaminate.decontaminate(df, bench).collect()}
    assert hits == {1: (300_000, 0), 2: (300_002, 0), 3: (100, 0), 4: (len(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", rows[3][1])), 11)}
    model = toxicity.train(df, spark.createDataFrame([(1, 1, 0), (2, 1, 1)], "doc_id long, quality int, toxic int"))
    assert toxicity.score(df, model).count() == 4
    scores = {r["doc_id"]: r["n_tokens"] for r in kneser_ney.score_documents(df).collect()}
    assert scores[1] == 300_001 and scores[3] == 101
    assert sum(r["size"] for r in hilbert_shards.shard(df, 2).collect()) == sum(len(t) + 8 for _, t in rows)


def pipeline_tables(spark, folder, rows, labels, items):
    d = spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, doc string")
    d.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    good, item, twice = sentence(80), sentence(20), sentence(60)
    rows = [(i, sentence(50)) for i in range(300)] + [(i, sentence(30) + " vile idiotic " + sentence(10)) for i in range(300, 400)]
    special = [(500, good), (501, good), (502, edited(good, 1)), (503, sentence(10) + " " + item), (504, sentence(20) + " password=abcdefghijklmnop"), (505, None), (505, None), (506, "")]
    special += [(None, good), (None, twice), (None, twice), (507, sentence(40)), (507, sentence(40)), (500, sentence(40)), (None, sentence(40)), (508, sentence(20) + " v1le and v i l e " + sentence(20) + " id1otic")]
    labels = [(i, 1, int(i >= 300)) for i in range(400)]
    pipeline_tables(spark, tmp_path, rows + special, labels, [(1, item)])
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    # toxic ones go; of good's class the smallest id stays; of the equal rows of null id one stays
    want = collections.Counter([*range(300), 500, 500, 504, 505, 505, 506, 507, 507, None, None])
    assert collections.Counter(r["doc_id"] for r in out) == want and all(r["round_trip"] for r in out)
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns
    assert "password" not in corpus_pipeline.secrets(spark, docs, str(tmp_path)).where("doc_id = 504").first()["text"]


def test_pipeline_of_nothing(spark, tmp_path):
    import corpus_pipeline

    pipeline_tables(spark, tmp_path, [], [], [])
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
