"""Line dedup: what travels, and that its short cuts change nothing."""

from __future__ import annotations

import collections
import random

import numpy as np
import pytest

from tapeforms.llm import line_dedup, shared

RNG = random.Random(5)


def lines_of(letters: str, n: int = 30) -> list[str]:
    """Lines over these letters, with near copies."""
    first = ["".join(RNG.choice(letters) for _ in range(RNG.randint(7, 90))) for _ in range(n)]
    return first + [x[: len(x) // 2] + RNG.choice(letters) + x[len(x) // 2 :] for x in first] + [x[:-1] + x for x in first]


@pytest.mark.parametrize("letters", ["ab", "abcdefghij klmnop", "".join(map(chr, range(0x4E00, 0x4E00 + 900))), "a\ud800\U0010ffff b"])
@pytest.mark.parametrize("k", [1, 5, 7, 70])
def test_numbers_of_shingles_compare_as_their_sets_do(letters, k):
    lines = dict(enumerate(x for x in lines_of(letters) if len(x) >= k))
    known = line_dedup.Shingles(lines, k)
    if k == 7 and len(letters) < 512:
        assert all(len(known._codes(i)) == len(line_dedup.shingles(x, k)) for i, x in lines.items())
    for i in lines:
        for j in lines:
            assert known.alike(i, j, 0.8) == line_dedup.alike(line_dedup.shingles(lines[i], k), line_dedup.shingles(lines[j], k), 0.8)


def test_normal_form_of_odd_white_space():
    odd = ["", " ", "A", " A b ", "A  b", "A\tb", "A B", " x y", "x\x1fy", "\x85", "É　ß ", "a​b C", "\ud800 X", "İ I"]
    assert [line_dedup.normal(x) for x in odd] == [" ".join(x.split()).lower() for x in odd]


def test_a_tasks_pairs_are_packed_by_part():
    pairs = np.array([[RNG.randint(-(1 << 63), (1 << 63) - 1), n] for n in range(500)])
    part, data = line_dedup.packed(pairs, 7)
    got = {p: np.frombuffer(x, dtype=np.int64).reshape(-1, 2) for p, x in zip(part.to_pylist(), data.to_pylist(), strict=True)}
    assert sorted(map(tuple, np.concatenate(list(got.values())).tolist())) == sorted(map(tuple, pairs.tolist()))
    assert all(int(x) % (1 << 64) % 7 == p for p, rows in got.items() for x in rows[:, 0])


def test_buckets_of_two_lines_and_more(spark):
    keys = {key: {RNG.randint(-(1 << 63), (1 << 63) - 1) for _ in range(RNG.choice([1, 1, 1, 2, 5, 40]))} for key in (RNG.randint(-(1 << 63), (1 << 63) - 1) for _ in range(300))}
    rows = []
    for _ in range(3):  # tasks that know some of the same lines
        part, data = line_dedup.packed(np.array([(k, h) for k, hs in keys.items() for h in hs]), 4)
        rows += zip(part.to_pylist(), data.to_pylist(), strict=True)
    found = spark.createDataFrame([*((p, bytearray(x)) for p, x in rows), (None, None)], "part int, pairs binary").repartition(3)
    got = collections.defaultdict(set)
    for r in line_dedup.buckets(found, 4).collect():
        assert r.n == len(keys[r.key]) and r.least == min(keys[r.key]) and r.h not in got[r.key]
        got[r.key].add(r.h)
    assert got == {k: hs for k, hs in keys.items() if len(hs) > 1}
    assert line_dedup.buckets(found.where("part is null"), 4).count() == 0


def test_keys_that_no_other_line_has_never_become_rows(spark, monkeypatch):
    """Of 400 lines only two are near: there is no window over all keys, and the rows of keys, wherever they are cut or shuffled, are few."""
    rows = [(i, "".join(RNG.choice("abcdefghijklmnop ") for _ in range(60))) for i in range(400)]
    rows[7] = (7, rows[3][1] + "!")
    df = spark.createDataFrame(rows, "doc_id long, text string")
    plans, sizes = [], []
    cut = shared.cut

    def watched(d):
        plans.append(d._jdf.queryExecution().executedPlan().toString())
        out = cut(d)
        if "key" in out.columns:
            sizes.append(out.count())
        return out

    monkeypatch.setattr(shared, "cut", watched)
    gone = line_dedup.dropped_lines(df, min_chars=0).collect()
    assert [sorted(r.lines) for r in gone] == [[0]]
    assert sizes and max(sizes) <= 2 * line_dedup.BANDS
    assert not any("Window" in p or "explode" in p for p in plans[:3])


def test_hot_group_in_chunks_and_small_groups_by_least_line(spark):
    """Blocks of 4 lines: one group of copies far beyond that, and small ones."""
    base = "the quick brown fox jumps over the lazy dog and runs away from it all " * 2
    rows = [(i, f"{base}{i:02d}") for i in range(40)] + [(100 + i, "".join(RNG.choice("abcdefghij") for _ in range(50)) * 2 + str(i % 2)) for i in range(20)]
    rows += [(200 + i, t + "~") for i, (_, t) in enumerate(rows[40:])]
    out = line_dedup.with_lines_dropped(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), min_chars=0, block=4)
    assert {r.doc_id for r in out.collect() if r.n_dropped == 0} == {0, *range(100, 120)}


def test_blocks_with_known_counts_are_the_same(spark):
    rows = [(k, h, n) for k, n in enumerate([1, 2, 3, 9, 30]) for h in range(n)]
    df = spark.createDataFrame(rows, "key long, h long, n long")
    plain, known = (shared.blocks(df, ["key"], "h", 4, count).select("key", "h", "chunk", "a", "b") for count in (None, "n"))
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, known.collect()))
