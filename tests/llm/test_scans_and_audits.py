"""Licence scans, spelling variants and filter audits against brute force, with nulls, ties, repeats and clashing columns."""

import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from textcurate.llm import filter_audit, license_scan, spelling
from textcurate.llm.license_templates import NOTICES, PHRASES, STATEMENTS

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
rng = random.Random(5)


def frame(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema).withColumns({c: F.lit("clash") for c in ("w", "n", "hits", "run", "key", "label", "mask", "total", "template", "word", "flags", "digest")})


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))


# licence scans


def filler(n):
    return " ".join(rng.choice(["the", "work", "of", "license", "general", "public", "software", "über", "and"]) for _ in range(n))


def licensed_rows():
    rows = [(i, filler(30) + "\n" + text + "\n" + filler(20)) for i, (_, text) in enumerate(STATEMENTS + NOTICES)]
    for i, (_, text) in enumerate(NOTICES):
        w = text.split()
        for k in (10, 30, 40):
            w.insert(min(k, len(w)), "indeed")
        rows.append((100 + i, filler(10) + " " + " ".join(w[:-2])))
        rows.append((120 + i, " ".join(text.split()[: len(w) // 2])))
    rows += [(200, None), (201, ""), (202, " -- "), (203, "MIT"), (204, "mit-license, MIT License; Apache  license"), (205, "general public, license"), (206, "General Public public license")]
    rows += [(207, "MIT License " * 4000), (208, ("q" * 70 + " ") * 2000), (None, "MIT License"), (None, None), (204, "apache license twice: apache license"), (207, "MIT License " * 4000)]
    return rows


def scan_brute(text, templates, least=0.8):
    w = words(text)
    starts, base_labels, labels, best = [], set(), set(), 0.0
    for label, base, t in templates:
        t = words(t)
        n, k = len(t), 4 if len(t) >= 4 else min(len(t), 2)
        if not n:
            continue
        at = defaultdict(list)
        for j in range(n - k + 1):
            at[tuple(t[j : j + k])].append(j)
        by = defaultdict(set)
        for p in range(len(w) - k + 1):
            for j in at.get(tuple(w[p : p + k]), ()):
                by[p - j].add(j)
        slack = 8 if n >= 64 and not base else 0
        for d in by:
            near = [(e, j) for e in range(d - slack, d + slack + 1) for j in by.get(e, ())]
            covered = {x for _, j in near for x in range(j, j + k)}
            share = len(covered) / max(n, max(e + j for e, j in near) + k - min(e + j for e, j in near))
            best = max(best, share)
            if share >= least:
                labels.add(label)
            if base and share == 1:
                starts.append(d)
                base_labels.add(label)
    return len(w), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base_labels)), ",".join(sorted(labels)), best


def templates():
    return [(label, True, t) for label, t in PHRASES] + [(label, False, t) for label, t in STATEMENTS + NOTICES]


def test_op11_license_scan(spark, monkeypatch):
    rows = licensed_rows()
    known = {t: scan_brute(t, templates()) for _, t in rows}
    want = Counter((i, *known[t]) for i, t in rows)
    for (label, _), i in zip(STATEMENTS + NOTICES, range(100)):
        assert label in known[rows[i][1]][5].split(","), label
    for i, (label, text) in enumerate(NOTICES):
        edited = next(t for d, t in rows if d == 100 + i)
        if len(words(text)) >= license_scan.LONG:
            assert label in known[edited][5].split(",")
        if label in ("bsd", "isc", "mpl", "zlib"):  # half a notice is none
            assert label not in known[next(t for d, t in rows if d == 120 + i)][5].split(",")
    made = license_scan.templates_of(spark)
    got = license_scan.scan_licenses(frame(spark, rows), made)
    assert Counter(tuple(r) for r in got.collect()) == want
    assert known["General Public public license"][1] == 0 and known["general public, license"][2:4] == (0, 0)
    monkeypatch.setattr(license_scan, "MAX_LITERALS", 10)
    assert Counter(tuple(r) for r in license_scan.scan_licenses(frame(spark, rows), made).collect()) == want


def test_op11_spans_and_empty_tables(spark):
    text = "one two MIT License three " + NOTICES[0][1]
    docs, made = frame(spark, [(1, text), (2, None), (3, "nothing here")]), license_scan.templates_of(spark)
    spans = sorted(tuple(r) for r in license_scan.license_spans(docs, made).collect())
    n = len(words(NOTICES[0][1]))
    assert spans == [(1, "mit", 2, 4, 1.0), (1, "mit", 5, 5 + n, 1.0)]
    assert license_scan.scan_licenses(frame(spark, []), made).collect() == []
    none = license_scan.scan_licenses(docs, made.where("false")).orderBy("doc_id").collect()
    assert [(r.doc_id, r.n_base, r.first_word, r.labels, r.score) for r in none] == [(1, 0, None, "", 0.0), (2, 0, None, "", 0.0), (3, 0, None, "", 0.0)]
    short = license_scan.templates_of(spark, [("x", "MIT"), ("none", " -- ")], [])
    assert [tuple(r)[2:6] for r in license_scan.scan_licenses(docs, short).where("doc_id = 1").collect()] == [(1, 2, 2, "x")]


def test_op11_is_native(spark):
    plan = license_scan.scan_licenses(frame(spark, licensed_rows()[:3]), license_scan.templates_of(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan


# spelling variants


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def variants_brute(rows, least_length=6, least=5, ratio=5, drop=199):
    n = Counter()
    for i, t in rows:
        for run in re.findall("[a-zÀ-ÿ]+", (t or "").translate(LOW)):
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if drop and h % drop == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= least_length and c >= least}
    nears = {w: [x for x in n if near(w, x)] for w in n}
    best = {w: min(x, key=lambda y: (-n[y], y)) for w, x in nears.items() if x}
    form = {w: f for w, f in best.items() if n[f] >= ratio * n[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted((w, form.get(w), root(w), c, len(nears[w]), n[form[w]] if w in form else None) for w, c in n.items())


def spelt_rows():
    stems = ["".join(rng.choice("abcdeéÀ") for _ in range(rng.randint(5, 9))) for _ in range(25)] + ["aaaaaa", "aaaaaaa", "abababab", "bababab", "aaaaab", "ÿ×÷ÿ×÷"]

    def edit(w):
        i, kind = rng.randrange(len(w) + 1), rng.randrange(3)
        c = rng.choice("abcdéx")
        return w[:i] + c + w[i:] if kind == 0 else w[:i] + w[i + 1 :] if kind == 1 else w[:i] + c + w[i + 1 :]

    bag = [(s, rng.choice([5, 30, 150])) for s in stems] + [(edit(s), rng.choice([3, 5, 6, 25])) for s in stems for _ in range(12)]
    special = [("chainab", 5), ("chainac", 25), ("chaimac", 125), ("chaumac", 625), ("tiedwrd", 5), ("tiedwrx", 25), ("tiedwra", 25)]
    flat = [w for w, c in bag for _ in range(c)]
    rng.shuffle(flat)
    rows = [(i, " ".join(w.upper() if w.isascii() and i % 3 == 0 else w for w in flat[40 * i : 40 * i + 40])) for i in range(len(flat) // 40 + 1)]
    return rows + [(800, " ".join(w for w, c in special for _ in range(c))), (7, rows[7][1]), (7, rows[7][1]), (None, rows[3][1]), (None, None), (900, ""), (901, "123 4"), (902, "longword " * 3000), (903, "z" * 5000)]


@pytest.mark.parametrize("drop", [199, 3, None])
def test_op12_spelling_variants(spark, drop):
    rows = spelt_rows()
    want = variants_brute(rows, drop=drop)
    got = sorted((tuple(r) for r in spelling.group_variants(frame(spark, rows), drop_one_in=drop).collect()), key=lambda r: r[0])
    assert got == want
    assert sum(r[1] is not None for r in want) > 5 and any(r[4] > 5 for r in want)
    if drop is None:
        assert {r[0]: r[2] for r in want}["chainab"] == "chaumac" and {r[0]: r[1] for r in want}["tiedwrd"] == "tiedwra"


def test_op12_every_edit_of_random_words(spark):
    """All near pairs of a dense vocabulary, short words included."""
    vocabulary = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(4, 8))) for _ in range(500)} | {"é" + "".join(p) for p in itertools.product("ab", repeat=4)})
    got = {tuple(r) for r in spelling.near_pairs(spark.createDataFrame([(w, 1) for w in vocabulary], "word string, n long")).collect()}
    assert got == {(a, b) for a in vocabulary for b in vocabulary if near(a, b)}
    with pytest.raises(ValueError):
        spelling.near_pairs(spark.createDataFrame([("abc", 1)], "word string, n long"))


def test_op12_sends_no_words_through_the_driver(spark, monkeypatch):
    """Whatever Spark estimates, tables of words are merged; only the counts of bigrams (8,100 rows at most) are broadcast."""
    plans, write = [], spelling.materialize
    told = lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString())
    monkeypatch.setattr(spelling, "materialize", lambda df, *a: told(df) or write(df, *a))
    rows = [(i, w) for i, w in enumerate(["letters"] * 125 + ["leters"] * 25 + ["lettars"] * 5)]
    out = spelling.group_variants(frame(spark, rows), drop_one_in=None)
    told(out)
    assert sorted(tuple(r)[:3] for r in out.collect()) == [("leters", "letters", "letters"), ("lettars", "letters", "letters"), ("letters", None, "letters")]
    assert sum(p.count("BroadcastHashJoin") for p in plans) == 1


def test_op12_empty(spark):
    assert spelling.group_variants(frame(spark, [])).collect() == []
    assert spelling.group_variants(frame(spark, [(1, None), (2, "short")])).collect() == []


# filter interaction audit


def audited_rows():
    def text(n, distinct, caps=0, sign=""):
        return " ".join(("W" * caps or "w") + str(rng.randrange(distinct)) for _ in range(n)) + sign

    rows = [(i, text(rng.choice([20, 99, 100, 140]), rng.choice([30, 5000]), rng.choice([0, 0, 1, 3]), rng.choice(["", "", " $", "|"])), rng.choice(["en", "de", None, ""])) for i in range(160)]
    rows += [(rng.choice([-5, 300 + i, 20]), rows[rng.randrange(160)][1], rng.choice(["en", "de", "fr"])) for i in range(60)]
    rows += [(500, None, "en"), (501, "", "de"), (502, " \t", "en"), (None, rows[0][1], "en"), (None, None, None), (500, None, "en"), (3, rows[3][1], "en"), (3, "another text", "en")]
    return rows + [(600, "AB" * 20000, "en"), (601, "é w " * 9000, "en"), (None, "a text of null ids only", "en"), (None, "a text of null ids only", "en")]


def audit_brute(rows, labels):
    first = {}
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    masks = defaultdict(list)
    for i, t, lang in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and first[t] < i}
        masks[lang or ""].append((fails, any(x == i and q == 1 for x, q, _ in labels if x is not None), any(x == i and y == 1 for x, _, y in labels if x is not None)))
    out = []
    for part, docs in masks.items():
        total, own = Counter(), []
        for order in itertools.permutations("ABCDE"):
            alive = docs
            for step, f in enumerate(order, 1):
                gone = [d for d in alive if d[0][f]]
                alive = [d for d in alive if not d[0][f]]
                total[f] += len(gone)
                bad = [d for d in docs if d[0][f]]
                own.append((part, "".join(order), step, len(alive), len(gone), len(bad) - len(gone), sum(sum(d[0].values()) == 1 for d in bad), sum(d[1] for d in gone), sum(d[2] for d in gone), f))
        out += [(*r[:-1], total[r[-1]]) for r in own]
    return sorted(out)


def test_op13_filter_audit(spark):
    rows = audited_rows()
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 320, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1)]
    docs = frame(spark, rows, "doc_id long, text string, lang string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("text", F.lit("clash"))
    got = sorted(tuple(r) for r in filter_audit.audit(docs, marks).collect())
    assert got == audit_brute(rows, labels)
    assert len(got) == 600 * 4
    assert filter_audit.audit(docs.where("false"), marks).collect() == []
    unlabelled = filter_audit.audit(docs, marks.where("false")).agg(F.sum("good_lost"), F.sum("toxic_lost"), F.count("*")).first()
    assert tuple(unlabelled) == (0, 0, 2400)


def test_op13_other_filters(spark):
    docs = frame(spark, [(1, "a", "x"), (2, "bb", "x"), (3, None, "x"), (4, "ccc", None)], "doc_id long, text string, lang string")
    marks = spark.createDataFrame([(2, 1, 0)], "doc_id long, quality int, toxic int")
    got = filter_audit.audit(docs, marks, failures={"S": F.length("text") < 3, "N": F.col("text").isNull()}, copies=None)
    assert sorted(tuple(r)[:5] for r in got.where("part = 'x'").collect()) == [("x", "NS", 1, 2, 1), ("x", "NS", 2, 0, 2), ("x", "SN", 1, 1, 2), ("x", "SN", 2, 0, 1)]
    with pytest.raises(ValueError):
        filter_audit.order_steps(docs, list("ABCDEFGH"))
