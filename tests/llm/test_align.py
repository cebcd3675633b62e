"""Token alignment against ranges compared pair by pair over whole texts."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quire.llm import align
from tests.llm.test_operators import docs_of, words

FILES = align._files(f"{align.TOKENIZERS}/{align.A}", f"{align.TOKENIZERS}/{align.B}")


def encoded(text, side):
    ids = side.encode([text])[0]
    return ids, [side.bytes[i] for i in ids]


def brute(texts):
    """Digest rows of whole texts: every A token is held against every B token, groups are cut at ends of both."""
    a, b = align.ByteLevel(FILES[0]), align.Pieces(FILES[1])
    found, pairs = [], Counter()
    for t in texts:
        groups, links = [], []
        if t:
            (ia, ba), (ib, bb) = encoded(" " + t, a), encoded(t, b)
            if b"".join(ba) == b"".join(bb) == (" " + t).encode():
                ea, eb = np.cumsum([len(x) for x in ba]), np.cumsum([len(x) for x in bb])
                for i, x in enumerate(ia):
                    for j, y in enumerate(ib):
                        if ea[i] - len(ba[i]) < eb[j] and eb[j] - len(bb[j]) < ea[i]:
                            links.append((x, y))
                i = j = 0
                for end in sorted({*ea} & {*eb}):
                    k, m = list(ea).index(end) + 1, list(eb).index(end) + 1
                    groups.append(",".join(map(str, ia[i:k])) + "|" + ",".join(map(str, ib[j:m])))
                    i, j = k, m
        pairs.update(links)
        found.append((groups, links))
    most = defaultdict(int)
    for (x, y), n in pairs.items():
        most[y] = max(most[y], n)
    rows = []
    for groups, links in found:
        text = ";".join(groups)
        na, nb = (sum(len(g.split("|")[s].split(",")) for g in groups) for s in (0, 1))
        rows.append((na, nb, len(groups), len(links), sum(pairs[x] == most[x[1]] for x in links), sum(pairs[x] for x in links), hashlib.sha256(text.encode()).hexdigest() if text else ""))
    return rows, pairs, most, [g for g, _ in found]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(6)
    marks = ["<|endoftext|>", "</s>", "<s>", "don't", "x  y", "\n\n", "tab\there", "naïve", "日本語", "🙂", "1234567", "a b", " ", "ß", "<0x41>", "a.b,c"]
    out = [" ".join(rng.choice([words(rng, 3), *marks]) for _ in range(rng.randint(1, 30))) for _ in range(60)]
    out += [None, "", " ", "  ", "\n", " lead", "trail ", "▁", "a ▁b c", "x▁", "\x00", "a \x00 b", "é" * 40, out[0], out[0], out[1], "word " * 300 + "end", "日" * 500]
    return out


def test_alignment_matches_brute_force(spark, texts):
    want, pairs, most, groups = brute(texts)
    assert sum(not w[0] for w in want) >= 4 and max(w[2] for w in want) > 100
    df = docs_of(spark, texts, clash=True).repartition(5)
    columns = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    for size in (1 << 24, 2000):
        got = {r.doc_id: tuple(r[c] for c in columns) for r in align.align(df, size=size).collect()}
        assert got == dict(enumerate(want))
    found = {(r.a, r.b): (r.n, r.best) for r in align.pair_counts(df).collect()}
    assert found == {(x, y): (n, n == most[y]) for (x, y), n in pairs.items()}
    lists = {r.doc_id: [",".join(map(str, g.a)) + "|" + ",".join(map(str, g.b)) for g in r.groups] for r in align.groups(df).collect()}
    assert lists == dict(enumerate(groups))


def test_alignment_starts_anew_when_many_pieces_are_kept(spark, texts, monkeypatch):
    aligner = align.Aligner(*FILES)
    whole = [b";".join(aligner.groups[i] for i in d) for d in aligner.read(texts)]
    monkeypatch.setattr(align, "KEPT", 40)
    small = [b";".join(aligner.groups[i] for i in aligner.read([t])[0]) for t in texts]
    assert whole == small
    rows = {len(x) for x in align._shard(FILES)(pa.table({"id": [*range(len(texts))], "text": texts}))["sha"].to_pylist()}
    assert rows == {len(texts)}


def test_alignment_of_empty_tables_and_null_or_repeated_ids(spark):
    df = docs_of(spark, ["same text", "same text", None, "other"], ids=[None, 3, 3, None])
    rows = align.align(df.withColumn("doc_id", F.col("doc_id").cast("string"))).collect()
    assert Counter((r.doc_id, r.n_a > 0) for r in rows) == Counter({(None, True): 2, ("3", True): 1, ("3", False): 1})
    assert align.align(df.limit(0)).count() == 0


def test_union_find_joins_chains_and_stars():
    rng = np.random.default_rng(2)
    for _ in range(50):
        n = int(rng.integers(1, 60))
        a, b = rng.integers(0, n, (2, int(rng.integers(0, 60))))
        want = [*range(n)]
        for _ in range(n):
            for x, y in zip(a, b):
                want[x] = want[y] = min(want[x], want[y])
        got = align.union_find(a, b, n)
        assert got.tolist() == want
