"""Hard negatives against a search of all pairs in whole numbers."""

import math
import random
import struct
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quire.llm import negatives

KIND = "vec_id long, label int, embedding array<float>, q int, norm string, rank int, id int, shell int"


def vectors_of(spark, rows):
    return spark.createDataFrame([(i, y, v, 0, "x", 0, 0, 0) for i, y, v in rows], KIND).repartition(3)


def brute(rows, is_anchor, positives=5, negatives=3, low=50, high=95):
    held = {}
    for i, y, v in sorted((r for r in rows if None not in r and None not in r[2]), key=lambda r: r[1]):
        if all(map(math.isfinite, v)):
            held.setdefault(i, (y, [math.floor(256 * x) for x in v]))
    found = set()
    for a, (y, q) in held.items():
        if not is_anchor(a):
            continue
        score = lambda b: sum(m * n for m, n in zip(q, held[b][1]))
        fit = [b for b in held if b != a and len(held[b][1]) == len(q)]
        near = sorted((b for b in fit if held[b][0] == y), key=lambda b: (-score(b), b))[:positives]
        for p in near:
            ok = [b for b in fit if held[b][0] != y and low * score(p) <= 100 * score(b) <= high * score(p)]
            for k, b in enumerate(sorted(ok, key=lambda b: (-score(b), b))[:negatives]):
                found.add((a, p, k + 1, b, score(p), score(b)))
    return found


def searched(df, **how):
    rows = negatives.hard_negatives(df, F.col("vec_id") % 5 == 0, **how).collect()
    got = Counter((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in rows)
    assert not got or max(got.values()) == 1
    return set(got)


@pytest.fixture(scope="module")
def rows():
    """Norms from 0 to 8, near and equal vectors, ties, and rows that take no part."""
    rng = random.Random(7)
    centres = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(5)]
    out = []
    for i in range(400):
        c, s = rng.choice(centres), rng.choice([0.0, 0.05, 0.3, 1.0, 3.0])
        out.append((i, rng.randrange(4), [s * float(x + rng.choice([0, 0.2]) * rng.gauss(0, 1)) for x in c]))
    out += [(400 + i, i % 3, out[0][2]) for i in range(30)]
    out += [(500, None, [1.0] * 6), (501, 1, None), (None, 1, [1.0] * 6), (502, 1, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (503, 1, [math.nan] + [1.0] * 5), (504, 1, [math.inf] + [1.0] * 5)]
    out += [(505, 1, []), (510, 2, []), (511, 3, [])] + [(520 + i, i % 2, [1.0, 0.5 * i]) for i in range(12)]
    return [(i, y, v and [single(x) for x in v]) for i, y, v in out]


def single(x):
    return x if x is None else struct.unpack("f", struct.pack("f", x))[0]


def test_negatives_match_brute_force(spark, rows, monkeypatch):
    want = brute(rows, lambda i: i % 5 == 0)
    assert len(want) > 300
    df = vectors_of(spark, rows)
    assert searched(df) == want
    monkeypatch.setattr(negatives, "BUCKET", 16)
    monkeypatch.setattr(negatives, "BLOCK", 8)
    assert searched(df, shell=40) == want
    monkeypatch.setattr(negatives, "BUCKET_BYTES", 100)
    assert searched(df, shell=150) == want


def test_windows_and_numbers_of_the_caller(spark, rows):
    for how in ({"positives": 2, "negatives": 1, "low": -20, "high": 40}, {"positives": 7, "negatives": 9, "low": 0, "high": 100}):
        assert searched(vectors_of(spark, rows[:150]), shell=30, **how) == brute(rows[:150], lambda i: i % 5 == 0, **how)


def test_repeated_ids_count_once_and_few_rows_give_few(spark, rows):
    again = rows[:60] + rows[:60] + [(5, -1, rows[9][2]), (6, 9, rows[3][2])]
    assert searched(vectors_of(spark, again)) == brute(again, lambda i: i % 5 == 0)
    for few in ([], rows[:1], [(0, 1, [1.0]), (1, 1, [1.0])], [(0, 1, [1.0]), (1, 2, [1.0])], [(0, None, [1.0])]):
        assert searched(vectors_of(spark, few)) == set()
    one = [(0, 1, [1.0, 0.0]), (1, 1, [1.0, 0.0]), (2, 2, [0.75, 0.0]), (3, 3, [0.75, 9.0])]
    assert searched(vectors_of(spark, one)) == {(0, 1, 1, 2, 65536, 49152), (0, 1, 2, 3, 65536, 49152)}


def test_norms_prune(spark, monkeypatch):
    """Long rows that fill the windows keep the anchors among them from the shells of short ones."""
    long = [(i, i % 2, [10.0 - (i % 7) * 0.001, 0.01 * (i % 11)]) for i in range(65)]
    short = [(1001 + 5 * i, i % 2, [0.01, 0.01]) for i in range(640)]
    met, real = [], negatives._meeting
    monkeypatch.setattr(negatives, "BLOCK", 16)
    monkeypatch.setattr(negatives, "_meeting", lambda *a: (met.append((a[4], real(*a).count())), real(*a))[1])
    got = searched(vectors_of(spark, long + short), shell=70, high=100)
    assert got == brute(long + short, lambda i: i % 5 == 0, high=100) and len(got) == 13 * 5 * 3
    assert [n > 0 for _, n in met] == [at == 0 for at, _ in met] and len(met) >= 6


def test_a_norm_too_large_is_refused(spark):
    with pytest.raises(Exception, match="norm"):
        searched(vectors_of(spark, [(0, 1, [2.0e5]), (1, 1, [1.0])]))
