"""Spelling variants, fill-in-middle and exact search against plain versions, and their edge cases."""

from __future__ import annotations

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapeforms.llm import exact_search, fill_middle, queries, spelling

DOCS = "doc_id long, text string"
VECTORS = "vec_id long, embedding array<float>"


# Spelling variants.
def plain_words(docs):
    n = collections.Counter()
    for i, text in docs:
        for x in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            x = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x)
            h = zlib.crc32(f"{'' if i is None else i}:{x}".encode())
            if h % 97 == 0:
                x = x[: h % len(x)] + x[h % len(x) + 1 :]
            n[x] += 1
    return {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}


def differ_by_one(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(n):
    near = {w: [x for x in n if differ_by_one(w, x)] for w in n}
    forms = {}
    for w, xs in near.items():
        best = min(xs, key=lambda x: (-n[x], x), default=None)
        forms[w] = best if best is not None and n[best] >= 2 * n[w] else None

    def root(w):
        while forms[w] is not None:
            w = forms[w]
        return w

    return {(w, forms[w], root(w), n[w], len(near[w]), n[forms[w]] if forms[w] else None) for w in n}


def found(rows):
    return {(r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in rows.collect()}


def test_variants_of_random_words(spark):
    rng = random.Random(3)
    long = "".join(rng.choice("ab") for _ in range(150))
    made = ["".join(rng.choice("abé") for _ in range(rng.randint(5, 8))) for _ in range(900)] + [long, long[:70] + "c" + long[71:], long[1:], long[:-1], "x" + long, "aaaaa", "aaaaaa", "aaaaaaa"]
    n = {w: rng.choice([3, 3, 4, 6, 9, 20, 50, 200]) for w in made}
    vocab = spark.createDataFrame(list(n.items()), "word string, n long").repartition(5)
    want = plain_variants(n)
    assert found(spelling.variants(vocab)) == want
    assert found(spelling.variants(vocab, block=7)) == want  # large groups are dealt into chunks


def test_variants_of_one_hot_group(spark):
    """All words share their first half, and so one key; blocks are far smaller."""
    rng = random.Random(4)
    n = {"hothothot" + "".join(rng.choice("abc") for _ in range(9)): rng.randint(3, 40) for _ in range(500)}
    vocab = spark.createDataFrame(list(n.items()), "word string, n long")
    assert found(spelling.variants(vocab, block=40)) == plain_variants(n)


def test_variants_of_all_given_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    n = plain_words([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert len(n) > 1000
    assert found(queries.op11_spelling_variants(spark, "/root/testdata/sf0.001")) == plain_variants(n)


def test_words_of_odd_rows(spark):
    docs = [(1, None), (None, "Straße straße STRASSE Éa éa a×b÷c"), (2, ""), (2, "x1y2z3 don't"), (2, "x1y2z3 don't"), *((i, f"draws{chr(97 + i % 26)} Longer_words") for i in range(300))]
    frame = spark.createDataFrame(docs, DOCS).selectExpr("doc_id", "text", "1 as n", "'q' as word", "'r' as _x")
    assert {r["word"]: r["n"] for r in spelling.vocabulary(frame).collect()} == plain_words(docs)
    assert spelling.variants(spelling.vocabulary(spark.createDataFrame([], DOCS))).collect() == []


def test_roots_follow_long_chains(spark):
    forms = [(f"w{i:03}", f"w{i + 1:03}") for i in range(60)] + [("a", "b")]
    got = {r["word"]: r["root"] for r in spelling.roots(spark.createDataFrame(forms, "word string, form string")).collect()}
    assert got == {**{f"w{i:03}": "w060" for i in range(60)}, "a": "b"}


def test_wavelet_tree_reports_rectangles():
    rng = np.random.default_rng(1)
    for size in (1, 2, 3, 64, 100):
        values = rng.permutation(size)
        tree = spelling.WaveletTree(values)
        box = np.sort(rng.integers(0, size + 1, (50, 2)), axis=1), np.sort(rng.integers(0, size + 1, (50, 2)), axis=1)
        of, value = tree.report(box[0][:, 0], box[0][:, 1], box[1][:, 0], box[1][:, 1])
        want = {(i, int(v)) for i in range(50) for v in values[box[0][i, 0] : box[0][i, 1]] if box[1][i, 0] <= v < box[1][i, 1]}
        assert set(zip(of.tolist(), value.tolist(), strict=True)) == want and len(of) == len(want)


# Fill-in-middle.
def plain_middle(i, text):
    text = text or ""
    lines = re.findall("[^\n]*\n|[^\n]+", text)
    h = hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * j : 8 * j + 8], 16) for j in range(4))
    n = len(lines)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 100:
        return n, "plain", text, None, None
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
    return (n, "spm", f"<S>{s}<P>{p}<M>{m}", len(p), len(m)) if h4 % 100 < 50 else (n, "psm", f"<P>{p}<S>{s}<M>{m}", len(p), len(m))


def test_fill_in_middle_of_odd_texts(spark):
    rng = random.Random(5)
    texts = [None, "", "\n", "\n\n\n", "a", "a\n", "\na", "x<P>y", "<", "<S", "a<P\n>b<S\n<M\n", "é\n日本\n\U0001f600\n", "long " * 50_000 + "\n" + "z\n" * 3000]
    texts += ["".join(rng.choice("ab\n\n<PSM>é\U0001f600\r") for _ in range(rng.randint(0, 60))) for _ in range(400)]
    rows = [(i if i % 50 else None, t) for i, t in enumerate(texts)] + [(7, "a\nb\nc"), (7, "a\nb\nc")]
    docs = spark.createDataFrame(rows, DOCS).selectExpr("doc_id", "text", "'gives way' as form", "1 as _row", "text as _text")
    made = fill_middle.transformed(docs)
    assert made.columns == ["doc_id", "text", "_row", "_text", "n", "form", "output", "prefix_chars", "middle_chars"]
    got = made.withColumn("back", fill_middle.restored(F.col("output"), F.col("form"))).collect()
    want = collections.Counter((i, t, *plain_middle(i, t)) for i, t in rows)
    assert collections.Counter((r["doc_id"], r["text"], r["n"], r["form"], r["output"], r["prefix_chars"], r["middle_chars"]) for r in got) == want
    assert all(r["back"] == (r["text"] or "") for r in got)
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}
    assert fill_middle.transformed(spark.createDataFrame([], DOCS)).collect() == []


def test_fill_in_middle_at_other_rates(spark):
    docs = spark.createDataFrame([(i, f"a{i}\nb\nc\n") for i in range(400)], DOCS)
    forms = collections.Counter(r["form"] for r in fill_middle.transformed(docs, rate=50, suffix_first=0).collect())
    assert set(forms) == {"plain", "psm"} and 140 < forms["plain"] < 260


def test_ranked_bits():
    rng = random.Random(6)
    for size in (1, 2, 7, 64, 1000):
        text = bytes(rng.choice(b"a\n") for _ in range(size))
        starts = [i for i in range(size) if i == 0 or text[i - 1] == 10]
        bits = fill_middle.line_starts(text)
        assert [fill_middle.place(bits, size, k) for k in range(len(starts) + 1)] == [*starts, size]


# Exact search.
def plain_search(rows, k=20):
    whole = [(i, [int(np.floor(64 * np.float64(np.float32(x)))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(np.float32(x)) for x in v)]
    out = collections.Counter()
    for i, q in whole:
        if i % 20:
            continue
        scores = sorted((-max(-(1 << 63), min((1 << 63) - 1, sum(a * b for a, b in zip(q, v, strict=True)))), j) for j, v in whole if j != i and len(v) == len(q))[:k]
        out.update((i, r, j, -s) for r, (s, j) in enumerate(scores, 1))
    return out


def searched(spark, rows, **how):
    frame = spark.createDataFrame(rows, VECTORS).selectExpr("vec_id", "embedding", "1 as cell", "2 as id", "3 as dim", "4 as rank")
    return collections.Counter(tuple(r) for r in exact_search.top_k(frame.repartition(3), F.col("vec_id") % 20 == 0, **how).select("query_id", "rank", "vec_id", "score").collect())


@pytest.mark.parametrize("small", [{}, {"shard": 60, "block": 4}])
def test_search_equals_all_pairs(spark, small):
    rng = np.random.default_rng(7)
    middles = rng.standard_normal((6, 9))
    rows = [(int(i), (middles[i % 6] + 0.2 * rng.standard_normal(9)).tolist()) for i in range(500)]
    rows += [(500 + i, rows[3][1]) for i in range(250)]  # a large group of copies
    rows += [(1000, None), (1020, [None] * 9), (1040, [float("nan")] * 9), (1060, [float("inf"), *[0.0] * 8]), (None, rows[0][1]), (1080, []), (1081, []), (1100, [1.0, 2.0]), (1101, [0.5, 2.0]), (1120, [0.0] * 9), (40, rows[7][1]), (40, rows[40][1])]
    assert searched(spark, rows, **small) == plain_search(rows)


def test_search_of_large_components(spark):
    rng = np.random.default_rng(8)
    rows = [(i, (rng.standard_normal(5) * 10.0 ** rng.integers(0, 20)).tolist()) for i in range(200)]
    assert searched(spark, rows, shard=30, block=3) == plain_search(rows)


def test_search_of_few_or_none(spark):
    assert searched(spark, [(20, [1.0])]) == {}
    assert searched(spark, [(20, [1.0]), (3, [2.0])]) == {(20, 1, 3, 64 * 128): 1}
    assert exact_search.top_k(spark.createDataFrame([], VECTORS), F.col("vec_id") % 20 == 0).collect() == []


def test_bounds_pass_over_most_of_a_tree():
    """Two distant groups: a query meets the leaves of its own only."""
    rng = np.random.default_rng(9)
    points = np.floor(64 * np.concatenate((rng.normal(1, 0.05, (500, 8)), rng.normal(-1, 0.05, (500, 8)))))
    tree = exact_search.Tree.built(np.arange(1000), points)
    met = []
    tree.scores = lambda rows, q, exact: met.append(rows.stop - rows.start) or (tree.points[rows] @ q).astype(np.int64)
    list(tree.search(points[:1], np.array([0]), 20))
    assert sum(met) <= 550
