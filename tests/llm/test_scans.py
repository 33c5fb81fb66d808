"""License scan, spelling variants and vector codes against brute force; nulls, empties, ties, extra columns."""

from __future__ import annotations

import hashlib
import math
import random
import re
import sys
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from oracle import both
from tideway.llm import licenses, queries, spelling, vectors

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.parametrize("name", ["op11_licenses", "op12_spelling", "op13_vector_codes"])
def test_query_equals_its_sql(spark, sf, name):
    got, want = both(spark, sf, queries.QUERIES[name], queries.SQL[name])
    assert got == want and got


# ---------------------------------------------------------------- 11


def plain_words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[0-9a-z\x80-\U0010ffff]+", low)


def plain_scan(text, rows, share):
    """Places and blocks of a text, by trying every notice in every block."""
    w = plain_words(text)
    places = sorted((i, label) for p, label in licenses.PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split())
    found = {}
    for k, (label, needs, notice) in enumerate(rows):
        own = plain_words(notice)
        width = 8
        while width < len(own):
            width *= 2
        for start in range(0, max(1, len(w)), width):
            block = set(w[start : start + 2 * width])
            common = set(own) & block
            if 100 * len(common) >= share * len(set(own)) and set(plain_words(needs)) <= block:
                found.setdefault((width, start), []).append((start, k, len(common) / len(set(own))))
    best = [r for rows_ in found.values() for r in rows_ if r[2] == max(x[2] for x in rows_)]
    return len(w), places, sorted(best)


def scanned(df, *args):
    return [(r.doc_id, r.n_words, [(p.place, p.label) for p in r.places], [(b.start, b.notice, b.containment) for b in r.blocks]) for r in licenses.scan(df, *args).collect()]


@pytest.mark.parametrize("seed", range(3))
def test_op11_filters_lose_and_add_nothing(spark, seed):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(30)] + ["été", "日本", "mit", "license", "cc", "by"]
    weights = [1 / (i + 1) for i in range(len(vocab))]
    rows = [(f"l{k}", "", " ".join(rng.choices(vocab, weights, k=rng.choice((1, 3, 8, 9, 20, 40))))) for k in range(15)]
    rows += [("twin", "", rows[3][2]), ("needs", "mit", rows[4][2] + " MIT")]
    texts = [" ".join(rng.choices(vocab, weights, k=rng.choice((0, 1, 5, 30, 200)))) for _ in range(60)]
    texts += [rows[k][2].upper() + " / " + rng.choice(texts) for k in range(15)] + ["x " * 7 + rows[8][2]]
    for share in (60, 80, 100):
        df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
        want = [(i, *plain_scan(t, rows, share)) for i, t in enumerate(texts)]
        assert sorted(scanned(df, rows, share)) == sorted(want)


def test_op11_notices_with_changed_words_are_labelled(spark):
    mit = next(t for label, _, t in licenses.NOTICES if label == "mit" and "hereby" in t)
    cut = mit.replace("associated ", "").replace("merge, ", "").replace("documentation", "manual")
    lgpl = next(t for label, _, t in licenses.NOTICES if label == "lgpl")
    rows = [(1, "Some words before.\n" + cut + "\nand after"), (2, lgpl), (3, "Licensed under CC BY-NC 4.0."), (4, "software is free of charge, any person may copy it under the license version 2.0"), (5, "GNU\nGeneral-Public  license, apache LICENSE; apache license"), (6, None), (7, ""), (7, ""), (None, "the MIT license")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"n_words": F.lit("x"), "places": F.lit(1), "row": F.lit(2)})
    got = sorted([tuple(r) for r in licenses.labelled(licenses.scan(df)).collect()], key=str)
    by = {r[0]: r for r in got}
    assert by[1][5:7] == ("", "mit") and 0.8 <= by[1][7] < 1
    assert by[2][6] == "lgpl" and by[2][5] == "" and by[3][5:] == ("cc-by", "cc-by,cc-by-nc", 1.0)
    assert by[4] == (4, 16, 0, None, None, "", "", 0.0)
    assert by[5] == (5, 8, 3, 0, 6, "apache,gpl", "apache,gpl", 1.0)
    assert [r for r in got if r[0] == 7] == [(7, 0, 0, None, None, "", "", 0.0)] * 2 and by[6] == (6, 0, 0, None, None, "", "", 0.0)
    assert by[None][5] == "mit"
    assert licenses.scan(df.limit(0)).count() == 0


def test_op11_long_texts_are_cut_between_words(monkeypatch):
    rng = random.Random(3)
    for size in (1, 2, 3, 7, 50):
        monkeypatch.setattr(licenses, "PIECE", size)
        for _ in range(60):
            text = "".join(rng.choices("aB9é日 -\n", k=rng.randint(0, 40)))
            assert [w.decode() for w in licenses.words_of(text)] == plain_words(text)


def test_op11_bounds():
    with pytest.raises(ValueError, match="no word"):
        licenses.notices([("a", "", "...")])
    with pytest.raises(ValueError, match="bytes"):
        licenses.notices([("a", "", "word " * licenses.MOST_BYTES)])


# ---------------------------------------------------------------- 12


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


@pytest.mark.parametrize("large", [500, 3])
def test_op12_pairs_equal_all_pairs(spark, monkeypatch, large):
    monkeypatch.setattr(spelling, "LARGE", large)
    rng = random.Random(4)
    words = {"".join(rng.choices("ab", k=rng.randint(0, 6))) for _ in range(200)} | {"".join(rng.choices("abcÀÿ*", k=rng.randint(1, 5))) for _ in range(200)} | {"a" * k for k in range(12)} | {"x" * 3000, "x" * 2999, "x" * 1500 + "y" + "x" * 1499}
    words = sorted(words)
    df = spark.createDataFrame([(w, i) for i, w in enumerate(words)] + [(None, 1)], "word string, n long").withColumns({"wid": F.lit("x"), "node": F.lit(1)})
    got = [(r.a, r.na, r.b, r.nb) for r in spelling.one_edit_pairs(df).collect()]
    assert len(got) == len({frozenset((a, b)) for a, _, b, _ in got})
    assert {frozenset((a, b)) for a, _, b, _ in got} == {frozenset((a, b)) for i, a in enumerate(words) for b in words[:i] if one_edit(a, b)}
    assert all(words[na] == a and words[nb] == b for a, na, b, nb in got)
    assert spelling.one_edit_pairs(df.limit(0)).count() == 0


def plain_variants(words):
    near = {a: [b for b in words if one_edit(a, b)] for a in words}
    best = {a: min(bs, key=lambda b: (-words[b], b)) for a, bs in near.items() if bs}
    form = {a: b for a, b in best.items() if words[b] >= 5 * words[a]}

    def root(a):
        return root(form[a]) if a in form else a

    return sorted((a, form.get(a), root(a), n, len(near[a]), words.get(form.get(a))) for a, n in words.items())


def test_op12_forms_and_roots(spark):
    rng = random.Random(6)
    words = {"".join(rng.choices("abc", k=rng.randint(1, 5))): rng.choice((5, 6, 25, 30, 31, 125, 700, 4000)) for _ in range(150)}
    words |= {"z" * k: 5**k for k in range(1, 13)}  # a chain of forms
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    got = [(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.variants(df).collect()]
    assert sorted(got, key=lambda r: r[0]) == plain_variants(words)


def test_op12_vocabulary_equals_brute_force(spark, sf, monkeypatch):
    monkeypatch.setattr(spelling, "HELD", 50)
    monkeypatch.setattr(spelling, "PIECE", 100)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd = spark.createDataFrame([(1, None, "", "", 0), (2, "", "", "", 0), (3, "abcdef ÀÉbcdeÿ abcdef̀ ×÷abcd " * 400, "", "", 0), (3, "abcdef " * 3, "", "", 0), (None, "abcdeF 0abcdef_abcdef", "", "", 0), (4, "q" * 5000 + " " + "q" * 5000, "", "", 0)], DOCS).withColumn("n", F.lit("x"))
    for df in (docs, odd):
        total = Counter()
        for r in df.select("doc_id", "text").collect():
            for run in re.findall("[A-Za-zÀ-ÿ]+", r.text or ""):
                run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
                h = zlib.crc32(f"{'' if r.doc_id is None else r.doc_id}:{run}".encode())
                i = h % len(run)
                total[run[:i] + run[i + 1 :] if h % 199 == 0 else run] += 1
        want = {w: n for w, n in total.items() if len(w) >= 6 and n >= 5}
        assert {r.word: r.n for r in spelling.vocabulary(df).collect()} == want
    assert spelling.variants(spelling.vocabulary(odd.limit(0))).count() == 0


# ---------------------------------------------------------------- 13

VECS = "vec_id long, embedding array<float>, label int"


def plain_codes(rows, parts=8, entries=16, rounds=6):
    kept = [(i, [math.floor(4096 * x) for x in v], label) for i, v, label in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(kept[0][1]) // parts
    part = lambda v, p: v[p * width : (p + 1) * width]
    books = [[part(v, p) for _, v, _ in kept[:entries]] for p in range(parts)]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    pick = lambda x, book: min(range(len(book)), key=lambda e: (dist(x, book[e]), e))
    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for _, v, _ in kept:
                groups.setdefault(pick(part(v, p), books[p]), []).append(part(v, p))
            books[p] = [[sum(c) // len(groups[e]) for c in zip(*groups[e])] if e in groups else entry for e, entry in enumerate(books[p])]
    out, sums = [], Counter()
    for i, v, label in kept:
        code = [pick(part(v, p), books[p]) for p in range(parts)]
        error = sum(dist(part(v, p), books[p][e]) for p, e in enumerate(code))
        out.append((i, "".join(f"{e:02x}" for e in code), error, label))
        sums[label] += error
    digest = hashlib.sha256(",".join(str(x) for book in books for entry in book for x in entry).encode()).hexdigest()
    return sorted(((i, code, error, sums[label], digest) for i, code, error, label in out), key=str)


def coded(df):
    return sorted([(r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in vectors.compressed(df).collect()], key=str)


@pytest.mark.parametrize("size", [120, 16, 5])
def test_op13_equals_brute_force(spark, size):
    rng = random.Random(size)
    rows = [(i * 7 % 1000, [float(np.float32(rng.choice((0, 0.25, rng.gauss(0, 1), rng.gauss(3, 0.1))))) for _ in range(16)], rng.choice((1, 1, 1, 2, None))) for i in range(size)]
    rows += [rows[0], (None, [0.5] * 16, None), (2000, None, 1), (2001, [None] + [0.0] * 15, 1), (2002, [math.nan] + [0.0] * 15, 2), (2003, [math.inf] + [0.0] * 15, 3)]
    df = spark.createDataFrame(rows, VECS)
    assert coded(df.withColumns({"x": F.lit(1), "code": F.lit("y"), "of": F.lit(0)})) == plain_codes(rows)


def test_op13_many_labels_and_large_sums(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(vectors, "LARGE", 3)
    rng = random.Random(1)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(8)], rng.choice((None, 1, 1, 1, i))) for i in range(90)]
    df = spark.createDataFrame(rows, VECS.replace("float", "double"))
    assert coded(df) == plain_codes(rows)


def test_op13_odd_vectors(spark):
    rows = [(i, [float(i)] * 9, 1) for i in range(20)] + [(50, [1.0], 1), (51, [], 1), (52, [3e38] * 9, 1), (53, [-3e38] * 9, None)]
    got = {r[0]: r for r in coded(spark.createDataFrame(rows, VECS))}
    assert set(got) == {*range(20), 52, 53} and max(r[2] for r in got.values()) < 2**63
    none = spark.createDataFrame([(1, None, 1)], VECS)
    assert coded(none) == coded(none.limit(0)) == []


def test_op13_annulus_is_exact():
    rng = np.random.default_rng(2)
    for scale in (3, 50, 1 << 30):
        for _ in range(40):
            x, e = rng.integers(-scale, scale + 1, (30, 3)), rng.integers(-scale, scale + 1, (int(rng.integers(1, 20)), 3))
            d = ((x[:, None].astype(object) - e[None].astype(object)) ** 2).sum(axis=2)
            where, best = vectors.nearest(x, e)
            assert where.tolist() == [min(range(len(e)), key=lambda k: (row[k], k)) for row in d] and best.tolist() == [min(row) for row in d]
