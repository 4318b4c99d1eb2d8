"""Line dedup, the mix and the whole pipeline against plain versions over all pairs."""

from __future__ import annotations

import collections
import hashlib
import random

import corpus_pipeline
import duckdb
import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from tapeforms.llm import line_dedup, mixing, queries, simhash

RNG = random.Random(12)
WORDS = ["the", "of", "and", "to", "in", "is", *("".join(RNG.choice("abcdefghijklmnop") for _ in range(RNG.randint(3, 10))) for _ in range(400))]


def sentence(n: int) -> str:
    return " ".join(RNG.choice(WORDS) for _ in range(n))


def changed(line: str) -> str:
    at = RNG.randrange(len(line))
    return line[:at] + RNG.choice("xyz") + line[at + 1 :]


def roots(n, links):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for i, j in links:
        a, b = find(i), find(j)
        up[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def without_duplicate_lines(docs: dict[int, str | None]) -> dict[int, str | None]:
    """Every line against every other: exact Jaccard similarity of their shingles, and that they share a band, which nearly all do."""
    places = collections.defaultdict(list)
    for i in sorted(docs):
        for n, line in enumerate((docs[i] or "").split("\n")):
            if (x := line_dedup.normal(line)):
                places[x].append((i, n))
    lines = list(places)
    sets = [line_dedup.shingles(x) if len(x) >= line_dedup.SHINGLE else {x} for x in lines]
    long = [i for i, x in enumerate(lines) if len(x) >= line_dedup.SHINGLE]
    keys = dict(zip(long, line_dedup.band_keys([lines[i] for i in long]), strict=True)) if long else {}
    near = [(a, b) for a in long for b in long if b < a and line_dedup.alike(sets[a], sets[b], line_dedup.SIMILARITY)]
    links = [(a, b) for a, b in near if (keys[a] == keys[b]).any()]
    assert len(links) >= 0.99 * len(near)
    groups = collections.defaultdict(list)
    for x, root in zip(lines, roots(len(lines), links), strict=True):
        groups[root] += places[x]
    gone = collections.defaultdict(set)
    for some in groups.values():
        for i, n in some:
            if (i, n) != min(some):
                gone[i].add(n)
    return {i: t if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone[i]) for i, t in docs.items()}


@pytest.fixture(scope="module")
def rows():
    pool = [sentence(RNG.randint(8, 16)) for _ in range(60)]
    out = []
    for i in range(120):
        lines = [sentence(RNG.randint(8, 20)) for _ in range(RNG.randint(3, 6))]
        lines += [RNG.choice(pool) if RNG.random() < 0.5 else changed(RNG.choice(pool)) for _ in range(RNG.randint(0, 4))]
        lines += RNG.choice(([], [""], ["ok"], ["Same Line  of text here to see"], ["same line of text here to see"]))
        RNG.shuffle(lines)
        out.append((i, "\n".join(lines)))
    copies = [(120 + k, out[k][1]) for k in range(8)]
    near = [(130 + k, out[20 + k][1].replace(" the ", " a ", 1)) for k in range(8)]
    odd = [(140, None), (141, ""), (142, " \n\t"), (143, "word " * 4000), (144, "\n".join(sentence(12) for _ in range(400)))]
    return [*out, *copies, *near, *odd]


def frame(spark, rows):
    """With sources of null as well, and with columns named like those that the operators add."""
    full = [(i, t, "en", None if i % 7 == 0 else f"s{i % 3}", len(t or ""), i, "x", 1.5) for i, t in rows]
    return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, h long, component string, size double")


def test_line_dedup_equals_all_pairs(spark, rows):
    docs = frame(spark, rows)
    got = {r.doc_id: r.text for r in line_dedup.with_lines_dropped(docs.repartition(5), min_chars=0).collect()}
    want = without_duplicate_lines(dict(rows))
    assert got == want and sum(len(want[i] or "") < len(t or "") for i, t in rows) > 60


def test_mix_comes_near_its_targets(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(["w"] * (int(rng.expovariate(1 / 300)) + 1)), "en", f"s{i % 12}", 0, i, "x", 0.0) for i in range(1200)]
    got = mixing.taken(spark.createDataFrame(rows, frame(spark, []).schema)).collect()
    source = {r[0]: r[3] for r in rows}
    taken, target = collections.Counter(), {}
    for r in got:
        taken[source[r.doc_id]] += r.taken
        target[source[r.doc_id]] = r.target
        assert r.taken <= 3 * r.size
    assert all(abs(taken[s] - t) <= 0.02 * t for s, t in target.items())


def test_near_dedup_keeps_one_row_of_repeated_ones(spark):
    text = sentence(80)
    other, third = sentence(90), sentence(70)
    rows = [(1, text), (1, text), (2, text), (3, other), (3, third), (3, text), (None, text), (4, None)]
    docs = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, fp long")
    got = [(r.doc_id, r.text) for r in simhash.deduplicated(docs).collect()]
    assert sorted(got, key=str) == sorted([(1, text), (3, other), (3, third), (None, text), (4, None)], key=str)


def test_every_stage_of_the_pipeline_equals_a_plain_version(spark, rows, tmp_path):
    docs = frame(spark, rows)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    stages = dict(corpus_pipeline.STAGES)
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    kept = {i for i, ok in con.execute(f"select doc_id, kept from ({queries.OP8_SQL})").fetchall() if ok}
    one = stages["quality_rules"](spark, docs, "")
    assert {r.doc_id for r in one.collect()} == kept and one.columns == docs.columns and 140 not in kept and 143 not in kept
    texts = {i: t for i, t in rows if i in kept}
    two = stages["line_dedup"](spark, one, "")
    left = {i: t for i, t in without_duplicate_lines(texts).items() if t.strip(" \t\n\x0b\f\r") or t == texts[i]}
    assert {r.doc_id: r.text for r in two.collect()} == left and two.columns == docs.columns
    three = stages["simhash_near_dedup"](spark, two, "")
    ids = sorted(left)
    prints = [simhash.fingerprint(left[i]) for i in ids]
    links = [(a, b) for a in range(len(ids)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= simhash.BUDGET]
    heads = {ids[r] for r in roots(len(ids), links)}
    assert {r.doc_id for r in three.collect()} == heads and three.columns == docs.columns
    three = three.cache()
    four = stages["source_mix"](spark, three, "")
    times = collections.Counter(r.doc_id for r in four.collect())
    want = {r.doc_id: (r.taken // r.size if r.size else None) for r in mixing.taken(three).collect()}
    assert four.columns == docs.columns and set(times) <= heads and all(times[i] == n for i, n in want.items() if n is not None)
    import tiktoken

    ranks = corpus_pipeline.bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    last = stages["byte_bpe"](spark, four.where("true"), "").collect()
    assert collections.Counter(r.doc_id for r in last) == times
    for r in last:
        ids_ = np.array(library.encode_ordinary(left[r.doc_id]), dtype="<u4").tobytes()
        assert bytes(r.ids) == ids_ and r.decoded_sha256 == hashlib.sha256(left[r.doc_id].encode()).hexdigest()
    empty = corpus_pipeline.run
    docs.limit(0).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert empty(spark, str(tmp_path / "none")).count() == 0
    assert docs.agg(F.count(F.lit(1))).first()[0] == len(rows)
