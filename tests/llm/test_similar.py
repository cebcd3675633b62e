"""Near-duplicates of the pipeline against brute force, and a near copy that two bits of SimHash let pass."""

import random
from itertools import combinations

import pytest

import corpus_pipeline as P
from quire.llm import similar, simhash
from tests.llm.test_operators import docs_of, words


def grams(text):
    ws = (text or "").lower().split()
    return {tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))} if ws else set()


def alike(a, b):
    return a == b or 5 * len(a & b) >= 4 * len(a | b)


def edited(rng, text, n):
    ws = text.split()
    for _ in range(n):
        ws[rng.randrange(len(ws))] = f"new{rng.randrange(10**6)}"
    return " ".join(ws)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(8)
    base = [words(rng, rng.randint(1, 200)) for _ in range(25)]
    out = base + [edited(rng, rng.choice(base), rng.randint(0, 4)) for _ in range(80)]
    grown = words(rng, 60)
    for _ in range(8):  # a chain, each near the last only
        grown += " " + words(rng, 12)
        out.append(grown)
    phrase = words(rng, 12)
    out += [f"{phrase} {words(rng, rng.randint(0, 6))}" for _ in range(40)]
    return out + [None, "", " \n ", base[0], base[0], "a b", "A  b", "a b c d e"]


def test_similar_matches_brute_force(spark, texts):
    sets, parent = [grams(t) for t in texts], list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(range(len(texts)), 2):
        if alike(sets[a], sets[b]):
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    want = {i: find(i) for i in range(len(texts))}
    assert 30 < len(set(want.values())) < len(texts) - 40
    for crowd, size, part in ((64, 1 << 23, 1 << 21), (2, 2000, 30)):
        got = {r.doc_id: r.component_id for r in similar.near_duplicates(docs_of(spark, texts, clash=True), crowd, size, part).collect()}
        assert got == want


def test_pipeline_drops_near_copies_beyond_two_bits(spark):
    rng = random.Random(4)
    first = words(rng, 120)
    copy = edited(rng, first, 2)
    bits = bin((simhash.simhash(first.encode()) ^ simhash.simhash(copy.encode())) & (2**64 - 1)).count("1")
    assert bits > 2 and alike(grams(first), grams(copy))
    docs = docs_of(spark, [first, copy, words(rng, 120)])
    assert {r.doc_id for r in P.drop_near_duplicates(spark, docs, "").collect()} == {0, 2}
