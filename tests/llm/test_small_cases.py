"""Each operator on nulls, empty and long texts, ties, repeated rows, empty tables and extra columns, held against brute force."""

from __future__ import annotations

import base64
import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers as P
import pytest
import xxhash
from pyspark.sql import functions as F

from tapeforms.llm import bpe, chat, embed_dedup, html_extract, line_dedup, mixing, quality, shared, simhash, token_store, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long, h long"
RNG = random.Random(4)
WORDS = ["the", "of", "and", "to", "it", *("".join(RNG.choice("abcdefghij") for _ in range(RNG.randint(3, 9))) for _ in range(300))]


def prose(n: int) -> str:
    return " ".join(RNG.choice(WORDS) for _ in range(n))


BASE = prose(120)
LONG = "\n".join(prose(12) for _ in range(3000))
TEXTS = [
    BASE, BASE, BASE.replace(" the ", " a ", 1), BASE.upper(), None, "", "  \n\t ", "word", "a b c", LONG, LONG, prose(60) + "\n" + BASE, "é́ İ 中文 🙂 'll x<|endoftext|>y\x1c\xa0z\r\n" * 9,
    "x" * 30_000, "ab " * 5000, *(prose(40) for _ in range(20)),
]
ROWS = [(i, t, "en", None if i % 5 == 0 else f"s{i % 3}", 0, 1) for i, t in enumerate(TEXTS)] + [(None, BASE, None, None, None, None), (7, "word", "en", "s1", 0, 1)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def components(n, linked):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(n):
        for j in range(i):
            if linked(i, j):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 300)] + [(5000, 5000)]
    got = shared.components(spark.createDataFrame(edges, "u long, v long")).collect()
    groups = collections.defaultdict(set)
    for r in got:
        groups[r.component].add(r.node)
    assert sorted(map(len, groups.values())) == [201, 300]


def test_simhash(docs, none):
    def want(t):
        words = (t or "").encode().lower().split()
        if not words:
            return 0
        grams = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
        hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
        return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))

    fps = [want(r[1]) for r in ROWS]
    root = components(len(ROWS), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 4)
    least = [min((ROWS[j][0] for j in range(len(ROWS)) if root[j] == root[i] and ROWS[j][0] is not None), default=None) for i in range(len(ROWS))]
    expected = collections.Counter((r[0], f"{f:016x}", c) for r, f, c in zip(ROWS, fps, least, strict=True))
    for block in (4096, 3):
        assert collections.Counter(map(tuple, simhash.near_duplicates(docs, block=block).collect())) == expected
    assert simhash.near_duplicates(none).count() == 0
    assert {r.doc_id for r in simhash.deduplicated(docs).collect()} == {*least, None}


def test_trie_finds_what_brute_force_finds():
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    keys = np.unique(np.concatenate([keys, keys ^ (np.uint64(1) << rng.integers(0, 64, 300, dtype=np.uint64)), keys[:50] ^ np.uint64(0b1011)]))
    found = {(min(a, b), max(a, b)) for i, j in simhash.traverse(keys, np.array([0]), np.array([len(keys)]), 4, 0) for a, b in zip(i.tolist(), j.tolist(), strict=True)}
    assert found == {(i, j) for j in range(len(keys)) for i in range(j) if int(keys[i] ^ keys[j]).bit_count() <= 4}


def test_line_dedup(spark, none):
    a, b = prose(30), prose(25)
    rows = [(1, f"{a}\n{prose(20)}\n{b}", 1), (2, f"{a}.\n\n{b.upper()}\nshort", 1), (3, None, 1), (4, "", 1), (5, "short\nshort", 1), (None, a, 1), (1, f"{a}\n{prose(20)}\n{b}", 2), (1, f"{a}\n{prose(20)}\n{b}", 2)]
    rows[6] = (1, rows[0][1], 2)
    df = spark.createDataFrame(rows[:7], "doc_id long, text string, h long")
    got = {(r.doc_id, r.h): (r.text, r.n_lines, r.n_dropped) for r in line_dedup.with_lines_dropped(df, block=2).collect()}
    assert got[1, 1] == (rows[0][1], 3, 0) == got[1, 2]
    assert got[2, 1] == ("\nshort", 3, 2) and got[3, 1] == (None, 0, 0) and got[4, 1] == ("", 0, 0) and got[5, 1] == ("short\nshort", 2, 0)
    assert got[None, 1] == ("", 1, 1)
    assert sorted(r.doc_id for r in line_dedup.deduplicated(df).collect() if r.doc_id) == [1, 1, 2, 3, 4, 5]
    assert line_dedup.with_lines_dropped(none.drop("h")).count() == 0


def test_lines_of_any_length_are_deduplicated(spark, tmp_path):
    import corpus_pipeline
    from tapeforms.llm import queries

    near = "".join(chr(0x4E00 + i) for i in range(19))
    lines = ["short", "SHORT", " short ", "a", "A", "ab", "-" * 7, "-" * 12, "1234567", "12345678", near, near + "!", near[:9], near, *(f"line {i % 6}" for i in range(12)), "\u00a0", "", "", *(prose(3)[:19] for _ in range(20))]
    texts = ["\n".join(lines[i : i + 3]) for i in range(0, len(lines), 3)]
    df = spark.createDataFrame([(i, t, "en", "s", len(t), i) for i, t in enumerate(texts)], DOCS)
    df.write.parquet(str(tmp_path / "documents.parquet"))
    x = [line_dedup.normal(t) for t in lines]
    first = components(len(x), lambda i, j: x[i] and x[j] and line_dedup.alike(line_dedup.shingles(x[i]), line_dedup.shingles(x[j]), 0.8))
    left = [[line for at, line in enumerate(lines[i : i + 3], i) if first[at] == at] for i in range(0, len(lines), 3)]
    got = {r.doc_id: (r.text, r.n_dropped) for r in queries.op7_line_dedup(spark, str(tmp_path)).collect()}
    assert got == {i: ("\n".join(a), min(3, len(lines) - 3 * i) - len(a)) for i, a in enumerate(left)}
    kept = {r.doc_id: r.text for r in corpus_pipeline.drop_duplicate_lines(spark, df, str(tmp_path)).collect()}
    assert kept == {i: got[i][0] for i in got if got[i][1] == 0 or got[i][0].strip(" \n")}


CLASH = {"lang": "_row", "h": "_k", "n_chars": "_text"}


def test_names_of_the_operators_own_columns_may_be_there(docs):
    other = docs.withColumnsRenamed(CLASH)
    for change in (quality.kept, line_dedup.deduplicated, simhash.deduplicated, mixing.taken_rows):
        assert change(other).columns == other.columns
        assert change(other).count() == change(docs).count()


def test_bitmaps_bound_the_difference():
    lines = [prose(20).lower() for _ in range(30)]
    lines += [x.replace("e", "o", 2) for x in lines]
    maps = line_dedup.bitmaps(lines)
    for i in range(60):
        for j in range(i):
            assert (maps[i] ^ maps[j]).bit_count() <= len(line_dedup.shingles(lines[i]) ^ line_dedup.shingles(lines[j]))


def test_quality(docs, none):
    def figures(t):
        t = t or ""
        words = [w.decode() for w in t.encode().split()]
        lines = [x for x in t.split("\n") if x.encode().split()]
        grams = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
        twice = collections.Counter(grams)
        covered = {i + k for i, g in enumerate(grams) if twice[g] > 1 for k in range(8)}
        return len(words), sum(map(len, words)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)

    got = quality.judged(docs).select("doc_id", "text", *quality.FIGURES, "base_failed", "kept").collect()
    assert len(got) == len(ROWS)
    for r in got:
        want = figures(r.text)
        assert tuple(r[2:7]) == want, r.doc_id
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0]) and not (r.kept and r.base_failed)
    assert quality.kept(none).count() == 0 and quality.kept(docs).columns == docs.columns
    # Two words of equal CRC-32 are two words.
    head = " ".join(f"w{i}" for i in range(7))
    texts = [f"{head} plumless and {head} buckeroo", "plumless buckeroo " * 15, f"{head} plumless {head} buckeroo {head} plumless", "buckeroo buckeroo " * 3]
    same = docs.sparkSession.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in quality.judged(same).collect()}
    assert zlib.crc32(b"plumless") == zlib.crc32(b"buckeroo")
    for i, t in enumerate(texts):
        assert got[i].n_repeat_words == figures(t)[4], i
    assert got[0].n_repeat_words == 0 < got[2].n_repeat_words
    assert got[1].stutter_ratio == 0 and got[3].stutter_ratio == 5 / 6
    clash = docs.withColumnsRenamed({"lang": "n_words", "h": "kept"})
    assert quality.kept(clash).columns == clash.columns and quality.kept(clash).count() == quality.kept(docs).count()


def test_bpe_equals_the_library(docs, none):
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    own = bpe.codec(path, P.PATTERN)
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=own.ranks, special_tokens={})
    want = collections.Counter()
    for r in ROWS:
        ids = np.array(library.encode_ordinary(r[1] or ""), dtype="<u4").tobytes()
        want[r[0], len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest()] += 1
    assert collections.Counter(map(tuple, bpe.round_trip(docs, path, P.PATTERN).collect())) == want
    assert bpe.round_trip(none, path, P.PATTERN).count() == 0
    rng = random.Random(2)
    for _ in range(3000):
        s = "".join(rng.choice("ab \n\t'stll12é中🙂́\x85\xa0.,!") for _ in range(rng.randint(0, 60)))
        assert own.text(s) == np.array(library.encode_ordinary(s), dtype="<u4").tobytes(), s
    for _ in range(300):
        s = bytes(rng.choice(b"abcdetion") for _ in range(rng.randint(1, 300)))
        assert list(own.tree(s, bpe.LEAF)) == list(own.tree(s, 40)) == list(own.merged_by_heap(s)) == library._encode_single_piece(s)
    odd = [" ", "\n", "\t", "\r\n", "\xa0", "\u3000", "a", "B", "é", "中", "1", ".", ",", "'s", "ab", "\x1c", "\x85", "🙂", "\u0301", "<|endoftext|>"]
    texts = ["".join(rng.choice(odd) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    assert own.texts(pa.array(texts, pa.large_string())) == [np.array(library.encode_ordinary(s), dtype="<u4").tobytes() for s in texts]
    long = "ab" * 3000
    assert own.piece(long) == np.array(library.encode_ordinary(long), dtype="<u4").tobytes()


def test_word_encoder_equals_the_library():
    rng = random.Random(3)
    own = token_store.WordEncoder(P.path("word_bpe_49k.json"))
    odd = [" ", "\n", "\t", "\r\n", "\xa0", "a", "B", "é", "中", "1", ".", ",", "x.", "Y,", "'s", "\x1c", "\x85", "🙂", "\u0301", "\u0307", "I", "İ", "\u212a", "\x01", "<|endoftext|>", "<|ENDOFTEXT|>", "ﬁ"]
    assert own.by_word
    for _ in range(60):
        texts = ["".join(rng.choice(odd) for _ in range(rng.randint(0, 40))) for _ in range(50)]
        ids, begins = own.texts(pa.array(texts, pa.large_string()))
        assert [ids[a:b].tobytes() for a, b in zip(begins, begins[1:], strict=False)] == own.encode(texts)
    assert not token_store.splits_at_spaces({"pre_tokenizer": {"type": "ByteLevel"}})


def test_token_store(spark, docs, none, tmp_path):
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    folder = token_store.write(docs, f"file://{tmp_path}/a", path, 2)
    got = token_store.read_documents(spark, folder).orderBy("start").collect()
    assert [r.doc_id for r in got] == sorted((r[0] for r in ROWS if r[0] is not None)) + [None]
    by_id = collections.defaultdict(collections.Counter)
    for r in ROWS:
        ids = np.array([*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 2], dtype="<u4").tobytes()
        by_id[r[0]][len(ids) // 4, zlib.crc32(ids)] += 1
    at = 0
    found = collections.defaultdict(collections.Counter)
    for r in got:
        assert r.start == at
        at += r.n_tokens
        found[r.doc_id][r.n_tokens, r.ids_crc32] += 1
    assert found == by_id
    ids = {r.start: bytes(r.ids) for r in token_store.read_ids(spark, folder).collect()}
    assert all(zlib.crc32(ids[r.start]) == r.ids_crc32 for r in got)
    names = [r.name for r in token_store.read_chunks(spark, folder).select("name").collect()]
    assert len(names) == len({bytes(n) for n in names})
    assert token_store.read_documents(spark, token_store.write(none, f"file://{tmp_path}/b", path, 2)).count() == 0
    spoilt = next((tmp_path / "a" / "chunks").iterdir())
    data = bytearray(spoilt.read_bytes())
    data[60] ^= 1
    spoilt.write_bytes(data)
    with pytest.raises(Exception, match="chunk|frame|decompress"):
        token_store.read_documents(spark, folder).collect()


def test_mixing(spark, none):
    rng = random.Random(9)
    rows = [(i, " ".join(["w"] * rng.randint(1, 60)), "en", ["a", "b", "c", "d", None][min(4, int(rng.random() ** 3 * 5))], 0, 1) for i in range(900)]
    rows += [(900, None, "en", "a", 0, 1), (901, "", "en", None, 0, 1), (None, "w w w", "en", "b", 0, 1), (5, rows[5][1], "en", rows[5][3], 0, 1)]
    df = spark.createDataFrame(rows, DOCS)
    got = mixing.taken(df, fan=16).collect()
    assert len(got) == len(rows)
    total = sum(r.size for r in got)
    by = collections.defaultdict(list)
    for r in got:
        by[r.source_size, r.target].append(r)
        assert r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
    assert math.isclose(sum(t for _, t in by), total, rel_tol=1e-9)
    for (size, target), some in by.items():
        assert sum(r.size for r in some) == size and target <= 3 * size + 1e-6
        assert abs(sum(r.taken for r in some) - target) <= max(r.size for r in some) * 2
    again = mixing.taken(df.repartition(7), fan=16).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert mixing.taken(none).count() == 0
    assert mixing.taken_rows(df).columns == df.columns


def test_targets_share_out_what_full_sources_leave(spark):
    sizes = {"a": 10, "b": 1000, "c": 20, "d": 500, None: 70}
    got = {r.source: r.target for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    order, weight = ["a", "b", "c", "d", None], {}
    for i, s in enumerate(order):
        weight[s] = (1, 2, 3)[i % 3]
    full, left = {}, float(sum(sizes.values()))
    while True:
        open_ = [s for s in order if s not in full]
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > 3 * sizes[s]]
        if not over:
            break
        for s in over:
            full[s] = 3.0 * sizes[s]
            left -= full[s]
    assert all(math.isclose(got[s], (full | share)[s]) for s in order)


def test_chat(spark):
    kind = "conv_id long, turn long, role string, text string, n long"
    base = [("user", "hi"), ("assistant", "<|im_end|> yes"), ("user", None)]
    rows = [(c, t, *base[t], 0) for c, n in ((1, 1), (2, 2), (3, 3), (4, 3)) for t in range(n)] + [(5, 0, "user", "hi", 0), (5, 7, "assistant", "no", 0), (None, 0, "user", "", 0), (6, None, None, None, 0), (6, 0, "user", "hi", 0)]
    got = {r.conv_id: r for r in chat.formatted(spark.createDataFrame(rows, kind)).collect()}
    assert set(got) == {3, 5, 6, None}
    assert got[3].n_copies == 2 and got[3].n_turns == 3 and got[3].text == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\n< |im_end|> yes<|im_end|>\n<|im_start|>user\n<|im_end|>\n"
    assert chat.formatted(spark.createDataFrame([], kind)).count() == 0


def test_embeddings(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((30, 24))
    near = np.concatenate([base, base + 0.15 * rng.standard_normal((30, 24)), base[:5] + 0.3 * rng.standard_normal((5, 24)), np.repeat(base[:1], 40, 0), base[:1] + 0.05 * rng.standard_normal((60, 24))])
    rows = [(i, [float(x) for x in v], i % 2 if i < 60 else 0) for i, v in enumerate(near)]
    odd = [(900, None, 0), (901, [0.0] * 24, 0), (902, [float("nan")] * 24, 0), (903, [None] * 24, 0), (904, rows[0][1], None), (905, [], 0), (906, [2.0] * 5, 0), (907, [1.0] * 5, 0), (None, rows[0][1], 0), (0, rows[0][1], 0)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, label int").repartition(3)
    every = rows + odd
    sound = [r[1] is not None and r[2] is not None and len(r[1]) > 0 and all(x is not None and math.isfinite(x) for x in r[1]) and any(r[1]) for r in every]

    def linked(i, j):
        a, b = every[i], every[j]
        return sound[i] and sound[j] and a[2] == b[2] and len(a[1]) == len(b[1]) and np.dot(a[1], b[1]) / np.linalg.norm(a[1]) / np.linalg.norm(b[1]) >= 0.93

    n = [sum(linked(i, j) for j in range(len(every)) if i != j) for i in range(len(every))]
    root = components(len(every), linked)
    want = collections.Counter()
    for i, r in enumerate(every):
        ids = [every[j][0] for j in range(len(every)) if root[j] == root[i] and every[j][0] is not None]
        c = min(ids, default=None)
        want[r[0], n[i], c, r[0] is not None and r[0] == c] += 1
    for block in (512, 8):
        got = collections.Counter(map(tuple, embed_dedup.near_duplicates(df, block=block).collect()))
        assert got == want
    assert embed_dedup.near_duplicates(df.limit(0)).count() == 0


def test_no_link_of_a_large_group_near_the_threshold_is_lost(spark):
    rng = np.random.default_rng(1000)
    x = rng.standard_normal(64) / 8 + 0.27 / 8 * rng.standard_normal((1000, 64))
    df = spark.createDataFrame([(i, v, 0) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>, label long")
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    want = ((x @ x.T) >= 0.93).sum(axis=1) - 1
    got = {r.vec_id: r.n_links for r in embed_dedup.near_duplicates(df).collect()}
    assert want.sum() == 2 * 241_893 and got == dict(enumerate(want.tolist()))


def test_work_of_a_vector_grows_slowly_with_its_label(spark):
    """Of a thousand times as many vectors, each costs less than a hundred times the work, since bits grow with them."""
    sizes = [10**6, 10**7, 10**8, 10**9]
    got = spark.createDataFrame([(n,) for n in sizes], "n long").select("n", embed_dedup.plan(F.col("n"), embed_dedup.COSINE, embed_dedup.MISS).alias("p")).collect()
    work = {r.n: r.p.work for r in got}
    assert work[10**9] < 100 * work[10**6] and max(r.p.bits for r in got) > 15
    assert all(abs((1 - (1 - np.arccos(embed_dedup.COSINE) / np.pi) ** r.p.bits) ** r.p.bands / embed_dedup.MISS - 1) < 1 or (1 - (1 - np.arccos(embed_dedup.COSINE) / np.pi) ** r.p.bits) ** r.p.bands <= embed_dedup.MISS for r in got)


def test_estimates_are_unbiased_and_within_their_bounds():
    rng = np.random.default_rng(5)
    x = rng.standard_normal((2000, 64))
    y = x * 0.9 + 0.4 * rng.standard_normal((2000, 64))
    x, y = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in (x, y))
    true = (x * y).sum(1)
    codes = [embed_dedup.Codes.read(64, embed_dedup.Codes.of(v).stored()) for v in (x, y)]
    estimate, error = codes[0].estimates(codes[1]).diagonal(), codes[0].errors(codes[1], 0.85).diagonal()
    assert abs((estimate - true).mean()) < 0.01
    near = true >= 0.85
    assert near.sum() > 1000 and (estimate + embed_dedup.SIGMAS * error >= true)[near].all()
    spread = ((estimate - true) / error)[near].std()
    assert 0.5 < spread < 1.1


def test_planted_pairs_among_many_vectors_are_found_with_and_without_bands(spark, monkeypatch):
    rng = np.random.default_rng(8)
    base = rng.standard_normal((2500, 64))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    other = rng.standard_normal((2500, 64))
    other -= (other * base).sum(axis=1, keepdims=True) * base
    other /= np.linalg.norm(other, axis=1, keepdims=True)
    c = rng.uniform(0.931, 0.97, (2500, 1))
    x = np.concatenate([base, c * base + np.sqrt(1 - c * c) * other])
    df = spark.createDataFrame([(i, v, 0) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>, label int")
    want = dict(enumerate((((x @ x.T) >= 0.93).sum(axis=1) - 1).tolist()))
    assert sum(want.values()) >= 5000
    for bits in (0, 8):
        monkeypatch.setattr(embed_dedup, "COPY", 500 if bits == 0 else -100_000)
        chosen = spark.range(1).select(embed_dedup.plan(F.lit(5000.0), 0.93, embed_dedup.MISS)["bits"]).first()[0]
        assert (chosen > 0) == (bits > 0)
        got = {r.vec_id: r.n_links for r in embed_dedup.near_duplicates(df, block=1024).collect()}
        assert got == want


def test_html(spark):
    def page(body, url="http://h.example/x"):
        return url, f"<html><head><title>t</title></head><body class='nav-open'>{body}</body></html>"

    offer = "<div class=x><p>Call us now</p><p>for offers</p></div>"
    rows = [page(f"<nav><a>menu</a></nav><header>top</header><article><h1>One &amp; two</h1><p>a  b\n c<b>d<br><p>e&nbsp;f {i}{offer}<div class='user-comments'><p>nice</p></div></article><footer>f</footer>") for i in range(12)]
    rows += [page(f"{offer}<p>text {i}</p><form><p>mail</p></form>", "http://other.example/y") for i in range(12)]
    rows += [page("<p>only<script>var a='</p>';</script> one<li>two", None), (None, None), ("odd", ""), ("http://h.example/z", "<article><p>cut &am")]
    df = spark.createDataFrame([(i, *r, "keep") for i, r in enumerate(rows)], "page_id long, url string, html string, template string")
    got = {r.page_id: r.text for r in html_extract.extracted(df).collect()}
    assert all(got[i] == f"One & two\na b cd\ne f {i}" for i in range(12)), got[0]
    assert all(got[12 + i] == f"text {i}" for i in range(12)), got[12]
    assert got[24] == "only one\ntwo" and got[25] == got[26] == "" and got[27] == "cut &am"
    assert html_extract.extracted(df.limit(0)).count() == 0


def test_html_names_delete_no_content(spark):
    bodies = {
        "<div class='content has-sidebar'><p>real text</p></div>": "real text", "<article class='post no-sidebar'><p>real text</p></article>": "real text",
        "<div class='site with-menu'><div class=menu>m</div><article><p>real text</p></article></div>": "real text",
        "<div class='sidebar-layout menu'><article><p>real text</p></article></div>": "real text",
        "<article><p>one</p><div class='share-price-table'><p>two</p></div><div class='ad-free'>three</div></article>": "one\ntwo\nthree",
        "<article><p>one</p><section class='discussion'><p>no</p></section><div class=reply>no</div><div class='ad-slot'>no</div><ul class='share-buttons'><li>no</ul></article>": "one",
        "<article><p>one</p><div id='user-comments'><p>no</p></div><div class='site-nav'>no</div><div class='related-posts'>no</div></article>": "one",
    }
    df = spark.createDataFrame([(i, "http://h/", b) for i, b in enumerate(bodies)], "page_id long, url string, html string")
    assert {r.page_id: r.text for r in html_extract.extracted(df).collect()} == dict(enumerate(bodies.values()))


def test_html_keeps_near_equal_articles_and_drops_menus_by_structure(spark):
    links = "".join(f"<li><a href=/{i}>Section {i}</a></li>" for i in range(5))
    report = prose(60).split()
    parts = [prose(12).split() for _ in range(5)]
    bodies = {
        "<p>The formula <math>E=mc</math> holds</p>": "The formula E=mc holds",
        "<p>Use <span class='search'>search</span> here, <a class='share' href=/x>share</a> there</p>": "Use search here, share there",
        "<p>one</p><div id='respond'><p>no</p></div><ol class='commentlist'><li>no</li></ol>": "one",
        f"<div class=q><ul>{links}</ul></div><p>real text with one <a href=/x>link</a></p>": "real text with one link",
        f"<ul>{links}</ul>": "\n".join(f"Section {i}" for i in range(5)),
        f"<article><p>one</p><ul>{links}</ul></article>": "one\n" + "\n".join(f"Section {i}" for i in range(5)),
    }
    rows = [(f"http://h{i}/", b, want) for i, (b, want) in enumerate(bodies.items())]
    for i in range(12):  # one paragraph that differs in a word, and five of them
        one = " ".join([*report[:30], f"town{i}", *report[30:]])
        five = [" ".join([*p[:6], f"town{i}", *p[6:]]) for p in parts]
        rows += [("http://weather/", f"<div class=w><p>{one}</p></div>", one), ("http://five/", "".join(f"<p>{x}</p>" for x in five), "\n".join(five))]
    df = spark.createDataFrame([(i, u, b) for i, (u, b, _) in enumerate(rows)], "page_id long, url string, html string")
    assert {r.page_id: r.text for r in html_extract.extracted(df).collect()} == {i: w for i, (_, _, w) in enumerate(rows)}


def test_html_templates_without_telling_names(spark):
    """Against a plain count: menus, offers and closing lines that vary in a word go on hosts with many pages; text stays, and so do equal pages."""
    rng = random.Random(6)
    rows, want = [], []
    for host, n in (("a.example", 300), ("b.example", 25), ("c.example", 3)):
        menu = [prose(2) for _ in range(8)]
        offer, closing = prose(20).split(), prose(15).split()
        for i in range(n):
            text = [prose(rng.randint(20, 60)) for _ in range(3)]
            top = "".join(f"<div>{m if k != i % 8 else 'here now'}</div>" for k, m in enumerate(menu))
            vary = [" ".join([*words[:7], f"w{i}", *words[8:]]) for words in (offer, closing)]
            if host == "b.example" and i >= 15:  # an article with an offer in it
                html, shown = f"<article><p>{text[0]}</p><div><p>{vary[0]}</p></div><p>{text[1]}</p></article>", [text[0], text[1]]
                plain = [text[0], vary[0], text[1]]
            else:
                html = f"<div class=q1>{top}</div><div class=q2><p>{vary[0]}</p></div><div class=q3><p>{text[0]}</p><p>{text[1]}</p>{text[2]}</div><div class=q4>{vary[1]}</div>"
                shown, plain = text, None
            if n < html_extract.LEAST_PAGES:
                shown = [*(m if k != i % 8 else "here now" for k, m in enumerate(menu)), vary[0], *text, vary[1]]
            rows.append((len(rows), f"http://{host}/{i}", html))
            want.append("\n".join(shown))
    same = "<div><p>the same page</p><p>many times over</p></div>"
    rows += [(len(rows) + k, "http://d.example/", same) for k in range(40)]
    want += ["the same page\nmany times over"] * 40
    got = {r.page_id: r.text for r in html_extract.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == dict(enumerate(want))


def test_warc(spark, tmp_path):
    rows = [(1, "http://a/\r\nx", "same"), (2, None, "same"), (3, "http://c", "é" * 5000), (9, "http://d", "same"), (4, "u", None), (5, "u", ""), (6, "u", "WARC/1.1\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\n"), (9, "http://d", "same"), (None, "u", "same")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    path = f"file://{tmp_path}/w"
    warc.archive(df, path)
    got = collections.Counter(map(tuple, warc.archived_pages(spark, path).collect()))
    want = collections.Counter()
    for i, _, html in rows:
        data = (html or "").encode()
        top = max(j for j, _, h in rows if (h or "") == (html or "") and j is not None)
        want[i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if i == top else "revisit", None if i == top else top] += 1
    assert got == want
    plan = warc.read(spark, path, payload=False).where("warc_type = 'revisit' and target_uri = 'u'")
    assert plan.count() == 2 and plan.select("payload").distinct().first()[0] is None
    parts = warc.WarcReader(path, True).partitions()
    assert len(parts) == 3
    empty = f"file://{tmp_path}/e"
    warc.archive(df.limit(0), empty)
    assert warc.archived_pages(spark, empty).count() == 0


def test_warc_splits_and_reads_foreign_gzip(spark, tmp_path):
    import gzip

    writer = warc.WarcWriter(f"file://{tmp_path}/w", roll=5000, split=1000, overwrite=False)
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"warc_type": ["resource"] * 40, "record_id": [f"<r{i}>" for i in range(40)], "payload": [bytes([i]) * 300 for i in range(40)]})
    writer.commit([writer.write(iter([batch]))])
    reader = warc.WarcReader(f"file://{tmp_path}/w", True)
    parts = reader.partitions()
    rows = [r for p in parts for b in reader.read(p) for r in b.to_pylist()]
    assert len(parts) > 10 and sorted(r["record_id"] for r in rows) == sorted(f"<r{i}>" for i in range(40)) and all(r["payload"] == bytes([int(r["record_id"][2:-1])]) * 300 for r in rows)
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "x.warc.gz").write_bytes(b"".join(gzip.compress(warc.as_record({"warc_type": "resource", "record_id": f"<{i}>", "payload": b"p"})) for i in range(3)))
    assert warc.read(spark, f"file://{tmp_path}/f").where("record_id = '<1>'").count() == 1
