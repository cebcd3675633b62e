"""Operators of quire.llm against brute force, on small tables with nulls, ties, repeats and clashing columns."""

import base64
import gzip
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations, product

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import decontam, exact, langid, licenses, lines, mixing, simhash, tokens, toxicity, warc
from quire.llm._common import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Extra columns with names the operators use themselves.
CLASH = "_runs int, _doc long, _hash long, _row int, _n int, block string, row int, own_id long, runs int, component_id string, fp string, size string, taken int, h1 int, key int, row_hash int, words int, score int, removed_runs int, n int"


def docs_of(spark, texts, ids=None, sources=None, clash=False):
    rows = [(i, t, None if t is None else "en", s, None if t is None else len(t)) for i, t, s in zip(ids or range(len(texts)), texts, sources or ["a"] * len(texts))]
    df = spark.createDataFrame(rows, SCHEMA)
    if clash:
        for c in CLASH.split(", "):
            name, kind = c.split()
            df = df.withColumn(name, F.lit(None).cast(kind))
    return df


def words(rng, n):
    return " ".join(rng.choice(["ba", "ke", "lo", "mi", "nu", "ra", "so", "tu"]) + rng.choice(["x", "y", "z", "q", "w"]) for _ in range(n))


@pytest.fixture(scope="module")
def messy(spark):
    rng = random.Random(3)
    base = [words(rng, rng.randint(1, 40)) for _ in range(30)]
    texts = base + base[:8] + [None, None, "", "  \n ", "Ünï çödé " * 5, words(rng, 9000)]
    texts += [t + " end" for t in base[:6]]
    return docs_of(spark, texts, clash=True)


def test_simhash_matches_brute_force(spark, messy):
    for bucket in (64, 2):
        got = {r.doc_id: (r.fp, r.component_id) for r in simhash.near_duplicates(messy, bucket=bucket).collect()}
        fp = {r.doc_id: simhash.simhash((r.text or "").encode()) for r in messy.collect()}
        parent = {i: i for i in fp}

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in combinations(sorted(fp), 2):
            if bin((fp[a] ^ fp[b]) & (2**64 - 1)).count("1") <= 2:
                x, y = sorted((find(a), find(b)))
                parent[y] = x
        assert got == {i: (fp[i], find(i)) for i in fp}


def test_simhash_links_chains_and_crowds(spark):
    rng = random.Random(1)
    chain, x = [], rng.getrandbits(64)
    for _ in range(120):
        chain.append(x)
        x ^= 1 << rng.randrange(64)
    others = [rng.getrandbits(64) for _ in range(300)]
    values = sorted({simhash._signed(v) for v in chain + others})
    fps = spark.createDataFrame([(v,) for v in values], "fp long")
    for bucket in (1000, 8, 2):
        edges = {(min(r.a, r.b), max(r.a, r.b)) for r in simhash.links(fps, bucket=bucket).collect()}
        assert all(bin((a ^ b) & (2**64 - 1)).count("1") <= 2 for a, b in edges)
        true = {(a, b) for a, b in combinations(values, 2) if bin((a ^ b) & (2**64 - 1)).count("1") <= 2}
        roots = {}
        for name, es in (("got", edges), ("true", true)):
            parent = {v: v for v in values}

            def find(v):
                while parent[v] != v:
                    v = parent[v]
                return v

            for a, b in es:
                p, q = sorted((find(a), find(b)))
                parent[q] = p
            roots[name] = {v: find(v) for v in values}
        assert roots["got"] == roots["true"]


def test_simhash_grows_chains_in_crowded_buckets(spark):
    """Fingerprints that share 27 bits or more meet under longer keys, and the densest around values one bit away."""
    rng = random.Random(21)
    values = set()
    for _ in range(6):
        base = rng.getrandbits(64)
        for _ in range(60):  # far from each other, but equal in one head
            values.add((base & ((1 << 27) - 1)) | rng.getrandbits(37) << 27)
        for _ in range(25):  # within a few bits
            values.add(base ^ sum({1 << rng.randrange(64) for _ in range(rng.randint(0, 3))}))
    values = sorted(map(simhash._signed, values))
    fps = spark.createDataFrame([(v,) for v in values], "fp long")
    true = {(a, b) for a, b in combinations(values, 2) if bin((a ^ b) & (2**64 - 1)).count("1") <= 2}
    for bucket in (30, 5):
        edges = {(r.a, r.b) for r in simhash.links(fps, bucket=bucket).collect()}
        assert all(bin((a ^ b) & (2**64 - 1)).count("1") <= 2 and a < b for a, b in edges)
        for e in (edges, true):
            parent = {v: v for v in values}

            def find(v):
                while parent[v] != v:
                    v = parent[v]
                return v

            for a, b in sorted(e):
                p, q = sorted((find(a), find(b)))
                parent[q] = p
            if e is edges:
                found = {v: find(v) for v in values}
        assert found == {v: find(v) for v in values}


def test_components_of_a_star_a_path_and_nothing(spark):
    edges = [(0, i) for i in range(1, 40)] + [(100 + i, 101 + i) for i in range(25)] + [(7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(40)} | {100 + i: 100 for i in range(26)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_exact_groups_even_when_fingerprints_collide(spark, messy):
    data = messy.collect()
    groups = defaultdict(list)
    for r in data:
        groups[r.text or ""].append(r.doc_id)
    want = {i: (max(g), len(g), i == max(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for i in g}
    for primes in (exact.PRIMES, (2, 3)):
        got = {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact.exact_duplicates(messy, primes=primes, bases=(1, 1) if primes == (2, 3) else exact.BASES).collect()}
        assert got == want


def test_exact_colliding_rows_with_null_and_repeated_ids(spark):
    texts = ["ab", "ba", "ab", "ba", "ad", "da", "ad", None, "", "c"]
    ids = [None, None, None, 7, 5, 5, 5, None, 5, None]
    want = Counter()
    groups = defaultdict(list)
    for t, i in zip(texts, ids):
        groups[t or ""].append(i)
    for t, i in zip(texts, ids):
        g = groups[t or ""]
        keep = max((x for x in g if x is not None), default=None)
        want[i, keep, len(g), i == keep, hashlib.sha256((t or "").encode()).hexdigest()] += 1
    for primes, bases in ((exact.PRIMES, exact.BASES), ((2, 3), (1, 1))):
        got = Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact.exact_duplicates(docs_of(spark, texts, ids, clash=True), primes, bases).collect())
        assert got == want


def test_exact_fingerprints_compose():
    data = bytes(random.Random(2).randrange(256) for _ in range(5000))
    whole = exact.polynomial(data)
    for cut in (0, 1, 777, 4999, 5000):
        parts = [exact.polynomial(data[:cut]), exact.polynomial(data[cut:])]
        assert whole == [exact.combine(a, b, 5000 - cut, base, prime) for a, b, base, prime in zip(*parts, exact.BASES, exact.PRIMES)]
    assert whole == exact.polynomial(data, chunk=64)
    slow = 0
    for byte in data:
        slow = (slow * exact.BASES[0] + byte) % exact.PRIMES[0]
    assert whole[0] == slow


def test_exact_null_and_repeated_ids(spark):
    df = docs_of(spark, ["x", "x", "x", "y", "y"], ids=[None, 3, 3, None, None])
    got = Counter((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact.exact_duplicates(df).collect())
    assert got == Counter({(None, 3, 3, False): 1, (3, 3, 3, True): 2, (None, None, 2, True): 2})


def brute_lines(docs, least):
    """Lines covered by runs of ``least`` words or more that stand earlier."""
    seqs = {d: [(p, x, len(x.split())) for p, x in enumerate((t or "").split("\n")) if x.split()] for d, t in docs}
    spots = [(d, i) for d in sorted(seqs) for i in range(len(seqs[d]))]
    gone = defaultdict(set)
    for n, (d, i) in enumerate(spots):
        for e, j in spots[:n]:
            k = total = 0
            while i + k < len(seqs[d]) and j + k < len(seqs[e]) and seqs[d][i + k][1] == seqs[e][j + k][1]:
                total += seqs[d][i + k][2]
                k += 1
            if total >= least:
                gone[d] |= set(range(seqs[d][i][0], seqs[d][i + k - 1][0] + 1))
    return gone


def test_line_dedup_matches_brute_force(spark):
    rng = random.Random(8)
    pool = [words(rng, rng.randint(1, 9)) for _ in range(12)] + ["", "  "]
    texts = ["\n".join(rng.choice(pool) for _ in range(rng.randint(0, 30))) for _ in range(25)]
    texts += [None, "", "\n\n", texts[3], words(rng, 60), words(random.Random(8), 60)]
    df = docs_of(spark, texts, clash=True)
    for least in (12, 30):
        gone = brute_lines(list(enumerate(texts)), least)
        got = {r.doc_id: (r.text, sum(x["last"] - x["first"] + 1 for x in r.removed_runs or [])) for r in lines.dedup_lines(df, least).collect()}
        for i, t in enumerate(texts):
            kept = None if t is None else "\n".join(x for p, x in enumerate(t.split("\n")) if p not in gone[i])
            assert got[i] == (kept, len(gone[i])), i


def test_line_dedup_keeps_columns_and_repeated_rows(spark):
    long = words(random.Random(1), 60)
    df = docs_of(spark, [long, long, long, "short"], ids=[1, 1, 2, None], clash=True)
    out = lines.dedup_lines(df)
    assert out.columns[: len(SCHEMA.split(", "))] == [c.split()[0] for c in SCHEMA.split(", ")]
    assert Counter((r.doc_id, r.text) for r in out.collect()) == Counter({(1, long): 2, (2, ""): 1, (None, "short"): 1})
    assert lines.dedup_lines(df.limit(0)).count() == 0


def test_mix_targets_and_copies(spark):
    rng = random.Random(4)
    texts = [words(rng, rng.randint(0, 60)) for _ in range(600)] + [None, "", " "]
    sources = [rng.choice(["a", "a", "a", "b", "c", None]) for _ in texts]
    df = docs_of(spark, texts, sources=sources, clash=True)
    rows = mixing.mix(df).collect()
    assert len(rows) == len(texts) and Counter(map(tuple, rows)) == Counter(map(tuple, mixing.mix(df).collect()))
    size = Counter()
    for t, s in zip(texts, sources):
        size[s] += len((t or "").split())
    target, taken = {}, Counter()
    for r in rows:
        assert r.size == len((texts[r.doc_id] or "").split()) and r.source_size == size[sources[r.doc_id]]
        assert r.taken == r.copies * r.size and 0 <= r.taken <= 2 * r.size
        target[sources[r.doc_id]] = r.target
        taken[sources[r.doc_id]] += r.taken
    assert sum(target.values()) == pytest.approx(1.5 * sum(size.values()))
    for s in target:
        assert target[s] <= 2 * size[s] + 1e-6 and abs(taken[s] - target[s]) <= 70
    assert mixing.mix(df.limit(0)).count() == 0


def water_fill(sizes, weights, share, cap):
    """Targets by filling the sources one by one."""
    targets = [0.0] * len(sizes)
    order = sorted(range(len(sizes)), key=lambda i: (cap * sizes[i] / weights[i], i))
    left, weight = share * sum(sizes), float(sum(weights))
    while order and left > 0 and left / weight > cap * sizes[order[0]] / weights[order[0]]:
        i = order.pop(0)
        targets[i] = cap * sizes[i]
        left, weight = left - targets[i], weight - weights[i]
    for i in order:
        targets[i] = max(0.0, left / weight * weights[i])
    return targets


def test_targets_match_water_filling(spark):
    assert water_fill([100, 100, 100], [5, 2, 1], 1.5, 2) == pytest.approx([200, 500 / 3, 250 / 3])
    rng = random.Random(11)
    for sizes, share in (([100, 100, 100], 1.5), ([10, 1000], 1.5), ([0, 0], 1.5), ([7], 1.5), ([5, 5, 5], 2.5), ([rng.randint(0, 10 ** rng.randint(1, 6)) for _ in range(700)], 1.5)):
        df = spark.createDataFrame([(f"s{i:04}", n) for i, n in enumerate(sizes)], "key string, source_size long").repartition(7)
        got = {r.key: r.target for r in mixing.targets(df, share, (5, 2, 1), 2.0).collect()}
        want = water_fill(sizes, [(5.0, 2.0, 1.0)[i % 3] for i in range(len(sizes))], share, 2.0)
        assert [got[f"s{i:04}"] for i in range(len(sizes))] == pytest.approx(want)


def test_mix_of_null_and_repeated_ids_does_not_depend_on_partitions(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RUN", 16)
    rng = random.Random(2)
    texts = [words(rng, 100 + k % 10) for k in range(150)] + ["same text here"] * 90 + [None] * 9
    ids = [None if k % 3 else k % 7 for k in range(150)] + [None] * 90 + [3] * 9
    df = docs_of(spark, texts, ids, [("a", "b", None)[k % 2] for k in range(len(texts))], clash=True)
    found = [Counter((r.doc_id, r.size, r.target, r.taken, r.copies) for r in mixing.mix(df.repartition(n)).collect()) for n in (1, 7, 13)]
    assert found[0] == found[1] == found[2] and sum(found[0].values()) == len(texts)


def brute_licences(text, templates=licenses.TEMPLATES):
    """(n_words, base places, template places) by plain loops over every start."""
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
    base = sorted((k, label) for p, label in licenses.BASE for k in range(len(ws)) if ws[k : k + len(p.split())] == p.split())
    places = set()
    for t in templates:
        parts = licenses.words_of(t.text)
        spots = []
        for key in map(licenses.words_of, t.keys):
            at = next(i for i in range(len(parts)) if parts[i : i + len(key)] == key)
            spots.append({k - at for k in range(len(ws)) if ws[k : k + len(key)] == key})
        places |= {(t.label, o) for o in set.intersection(*spots)}
    return len(ws), base, places


def test_license_scan_matches_brute_force(spark):
    rng = random.Random(5)
    pool = ["MIT", "License", "license", "apache", "general", "public", "é", "x", "GNU", "version", "2.0", "under the", "cc", "by", "nc", "4.0", "sa", "Licensed", "\u212a", "Lesser"]
    texts = [" ".join(rng.choice(pool) for _ in range(rng.randint(0, 60))) for _ in range(60)]
    texts += [None, "", "mit-license", "x_mit license9", "MIT LICENSE \u212a", "cc0 1", "cc by", "Permission is hereby granted, free of charge", "Redistribution and use in source and binary forms without modification"]
    for _ in range(40):  # whole, cut and damaged notices of several licences in one file
        parts = []
        for t in rng.sample(licenses.TEMPLATES, rng.randint(1, 12)):
            ws = t.text.split()
            if rng.random() < 0.3:
                del ws[rng.randrange(len(ws))]
            parts.append(" ".join(ws[rng.randint(0, 2) :]))
        texts.append(rng.choice(["; ", " notice\n"]).join(parts))
    got = {r.doc_id: r for r in licenses.scan(docs_of(spark, texts, clash=True)).collect()}
    for i, t in enumerate(texts):
        n, base, places = brute_licences(t)
        assert (got[i].n_words, [(b.start, b.label) for b in got[i].base]) == (n, base), t
        assert {(m.label, m.offset) for m in got[i].matches} == places, t
        assert all(0 < m.share <= 1 for m in got[i].matches)


def test_license_scan_takes_templates_of_the_caller(spark):
    own = (licenses.Template("one", "word of licensing word", ("licensing",)), licenses.Template("two", "a b a b", ("a b a b",)))
    texts = ["licensing", "a b a b a b", "b a b", None]
    got = {r.doc_id: {(m.label, m.offset) for m in r.matches} for r in licenses.scan(docs_of(spark, texts), own).collect()}
    assert got == {i: brute_licences(t, own)[2] for i, t in enumerate(texts)} and got[0] == {("one", -2)} and len(got[1]) == 2
    with pytest.raises(ValueError):
        licenses.entries((licenses.Template("x", "a b", ("c",)),))


def test_license_scan_needs_no_word_outside_the_phrases(spark):
    texts = ["Published under CC BY-SA 4.0", "Creative Commons Attribution 4.0 International", "CC0 1.0 Universal", "(cc by nc)", "creative commons attribution sharealike", "cc by", "cc0 1"]
    got = {r.doc_id: {m.label for m in r.matches} for r in licenses.scan(docs_of(spark, texts)).collect()}
    assert got == {0: {"cc-by-sa"}, 1: {"cc-by"}, 2: {"cc0"}, 3: {"cc-by-nc"}, 4: {"cc-by-sa"}, 5: set(), 6: set()}


def test_license_scan_finds_all_licences_of_one_file(spark):
    text = "; ".join(t.text for t in licenses.TEMPLATES)
    rows = licenses.scan(docs_of(spark, [text, "x", licenses.TEMPLATES[0].text])).collect()
    got = {r.doc_id: r for r in rows}
    at = 0
    for t in licenses.TEMPLATES:
        assert (t.label, at, 1.0) in {(m.label, m.offset, m.share) for m in got[0].matches}, t
        at += len(licenses.words_of(t.text))


def weighed_items(texts):
    bags = [decontam.words((t or "").encode()) for t in texts]
    df = Counter(w for bag in bags for w in set(bag))
    terms = [[(w, n, df[w]) for w, n in sorted(Counter(bag).items())] for bag in bags]
    lengths = [len(bag) for bag in bags if bag]
    return terms, len(lengths), sum(lengths) / len(lengths)


def test_wand_finds_what_exhaustive_search_finds(monkeypatch):
    rng = random.Random(6)
    texts = [words(rng, rng.randint(3, 30)) for _ in range(60)] + [None, ""]
    terms, total, mean = weighed_items(texts)
    for spans in (512, 5):
        monkeypatch.setattr(decontam, "SPANS", spans)
        index = decontam.Items([t or "" for t in texts], terms, total, mean).indexes[0]
        for _ in range(100):
            asked = set(rng.sample(range(len(index.terms)), rng.randint(1, min(25, len(index.terms)))))
            high = index.ceilings(np.array([0]), np.array([len(asked)]), np.array(sorted(asked)))[0]
            assert high >= max(index.exhaustive(asked, 0.0).values()) - 1e-5
            for threshold in (0.05, 0.3, 0.7):
                assert index.search(asked, threshold) == pytest.approx(index.exhaustive(asked, threshold))


def test_leaks_are_found_at_any_place(spark):
    rng = random.Random(7)
    alphabet = [words(rng, 1) + str(i) for i in range(3000)]
    make = lambda n: " ".join(rng.choice(alphabet) for _ in range(n))
    items = [(f"item-{i}", f"{make(rng.randint(8, 40))}? {make(rng.randint(3, 12))}.") for i in range(19)] + [("long", f"{make(500)}? {make(30)}."), ("null", None)]
    texts, want = [], set()
    for k in range(60):
        i, item = items[k % 20]
        pad, tail = make(rng.randint(0, 400)), make(rng.randint(0, 50))
        texts.append(f"{pad} {item} {tail}" if k % 3 else f"{pad} {item[: len(item) // 3]} {tail}")
        if k % 3:
            want.add((k, i))
    texts += [None, "", "?"]
    df, bench = docs_of(spark, texts, clash=True), spark.createDataFrame(items, "item_id string, text string")
    found = decontam.find_leaks(df, bench.withColumn("row", F.lit(1)))
    assert {(r.doc_id, r.item_id) for r in found.collect()} == want
    assert decontam.find_leaks(df, bench.limit(0)).count() == 0


def test_scores_do_not_depend_on_how_the_benchmark_is_cut(spark):
    rng = random.Random(17)
    items = [(i, f"{words(rng, rng.randint(6, 30))}? {words(rng, rng.randint(2, 9))}.") for i in range(60)]
    texts = [f"{words(rng, 30)} {items[k % 60][1]}" if k % 2 else words(rng, 150) for k in range(80)]
    df, bench = docs_of(spark, texts), spark.createDataFrame(items, "item_id int, text string")
    terms, total, mean = weighed_items([t for _, t in items])
    whole = decontam.Items([t for _, t in items], terms, total, mean)
    for threshold, overlap in ((0.6, 0.0), (0.9, 0.0), (0.6, 0.8)):
        want = {(k, i): row for k, i, *row in whole.leaks([t.encode() for t in texts], threshold, overlap)}
        for size in (600, 1 << 24):
            got = {(r.doc_id, r.item_id): [r.score, r.question_overlap, r.answer_overlap] for r in decontam.find_leaks(df, bench, threshold, overlap, size).collect()}
            assert got == want, (threshold, overlap, size)


def test_toxicity_learns_without_negatives(spark):
    rng = random.Random(9)
    texts, labels = [], []
    for i in range(1200):
        bad = rng.random() < 0.2
        texts.append(words(rng, 40) + (" grumph vile " if bad else ""))
        labels.append((i, 1, int(bad)))
    texts += [None, "", "1 2 3"]
    df, lab = docs_of(spark, texts, clash=True), spark.createDataFrame(labels + [(None, 1, 1), (5, 1, None)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.score_toxicity(df, toxicity.train(df, lab)).collect()}
    assert len(got) == len(texts) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    assert np.mean([got[i].predicted == y for i, _, y in labels]) > 0.98
    assert got[1200].score == got[1201].score == got[1202].score < 0.5
    none = toxicity.train(df.limit(0), lab.limit(0))
    assert toxicity.score_toxicity(df, none).filter("predicted = 1").count() == 0


def test_toxicity_lowers_a_prior_that_text_refutes():
    rng = random.Random(12)
    docs = [(words(rng, 50) + (" grumph vile" if i % 7 == 0 else "")).encode() for i in range(280)]
    bags = [toxicity.features(d) for d in docs]
    model = toxicity.fit(toxicity.Bags.of(bags[::7]), toxicity.Bags.of(bags), 0.4)
    assert [*np.flatnonzero(model.score(docs) >= 0.5)] == [*range(0, 280, 7)]


def test_toxicity_step_is_the_gradient_of_the_corrected_risk():
    rng = np.random.default_rng(4)

    def sparse(rows, dense):
        full = rng.integers(0, 4, (rows, 6)) * (rng.random((rows, 6)) < dense)
        return (*np.nonzero(full), full[np.nonzero(full)].astype(float), rows), full

    (p, fp), (u, fu) = sparse(9, 0.8), sparse(30, 0.2)
    signs = set()
    for prior in (0.1, 0.3, 0.9):
        for scale in (0.1, 2.0):
            w, b = abs(rng.normal(0, scale, 6)), float(rng.normal(-scale, scale))

            def loss(x):
                margin = lambda m: m @ x[:6] + x[6]
                pos = prior * np.log1p(np.exp(-margin(fp))).mean()
                neg = np.log1p(np.exp(margin(fu))).mean() - prior * np.log1p(np.exp(margin(fp))).mean()
                return pos, neg

            pos, neg, step = toxicity.risk_and_step(p, u, prior, w, b, 0.01)
            assert (pos, neg) == pytest.approx(loss(np.append(w, b)))
            signs.add(neg >= 0)
            held = lambda x: 0.005 * (x[:6] ** 2).sum()
            goal = (lambda x: sum(loss(x)) + held(x)) if neg >= 0 else (lambda x: -loss(x)[1] + held(x))
            x, e = np.append(w, b), 1e-6
            numeric = [(goal(x + e * d) - goal(x - e * d)) / (2 * e) for d in np.eye(7)]
            assert np.allclose(step, numeric, atol=1e-6)
    assert signs == {True, False}


def test_language_id_labels_switched_text(spark):
    rng = random.Random(10)
    stems = {"en": ["the", "ing", "ship", "th", "ow"], "de": ["sch", "keit", "über", "der", "ung"], "fr": ["eau", "été", "oir", "les", "que"]}
    say = lambda lang, n: " ".join("".join(rng.choices(stems[lang], k=2)) for _ in range(n))
    rows = [(i, say(lang, 60), lang) for i, lang in enumerate(["en", "de", "fr"] * 40)]
    df = spark.createDataFrame(rows + [(900, None, "en"), (901, "12 34", "de"), (902, "", None)], "doc_id long, text string, lang string")
    model = langid.train(df)
    got = {r.doc_id: r for r in langid.identify(df.withColumn("score", F.lit(1)), model).collect()}
    assert np.mean([got[i].lang_pred == lang for i, _, lang in rows]) > 0.97
    assert all((got[i].lang_pred, got[i].score) == ("und", 0.0) for i in (900, 901, 902)) and all(0 <= r.score <= 1 for r in got.values())
    tags = model.tag(say("en", 12) + " " + say("fr", 12))
    assert sum(t[2] == "en" for t in tags[:12]) >= 11 and sum(t[2] == "fr" for t in tags[12:]) >= 11
    empty = langid.train(df.limit(0))
    assert {r.lang_pred for r in langid.identify(df, empty).collect()} == {"und"}
    texts = [r[1] for r in rows[:7]] + ["", "a", say("de", 700)]
    one = np.array([model.predict([t])[0] for t in texts])
    assert np.allclose(model.predict(texts), one, atol=1e-3)


def test_language_id_forward_backward_matches_enumeration():
    rng = np.random.default_rng(3)
    model = langid.Crf(["a", "b", "c"], {})
    model.step, model.begin = rng.normal(size=(3, 3)), rng.normal(size=3)
    lengths = np.array([4, 1, 0, 5, 2])
    unary = np.exp(rng.normal(size=(lengths.sum(), 3)))
    got = model.marginals(unary, lengths)
    at = 0
    for n in lengths:
        want, total = np.zeros((n, 3)), 0.0
        for path in product(range(3), repeat=int(n)):
            p = np.prod([unary[at + t, y] for t, y in enumerate(path)]) if n else 1.0
            p *= np.exp(sum(model.begin[y] if t == 0 else model.step[path[t - 1], y] for t, y in enumerate(path)))
            total += p
            for t, y in enumerate(path):
                want[t, y] += p
        assert np.allclose(got[at : at + n], want / total, atol=1e-5)
        at += n
    gamma, joint = langid._expectations(model, unary[:8], 4, 3)
    assert np.allclose(gamma, model.marginals(unary[:8], np.array([4, 4])), atol=1e-5)
    want = np.zeros((3, 3))
    for at in (0, 4):
        paths = {y: np.prod([unary[at + t, y[t]] for t in range(4)]) * np.exp(model.begin[y[0]] + sum(model.step[a, b] for a, b in zip(y, y[1:]))) for y in product(range(3), repeat=4)}
        for y, p in paths.items():
            for a, b in zip(y, y[1:]):
                want[a, b] += p / sum(paths.values())
    assert np.allclose(joint, want, atol=1e-5)


def test_language_id_takes_numerals_for_no_letters_and_bounds_its_sample(spark):
    rows = [(i, ("ein kleines haus steht hier " if i % 2 else "the small house stands here ") * 3, "de" if i % 2 else "en") for i in range(60)]
    rows += [(100 + i, f"noise {i}", f"x{i:03}") for i in range(200)]
    df = spark.createDataFrame(rows + [(900, "\u00b2 \u00bd \u2460 \u2167 12 _", None), (901, "\u00b2haus", None), (None, None, None)], "doc_id long, text string, lang string")
    model = langid.train(df, max_langs=2)
    assert model.labels == ["de", "en"]
    got = {r.doc_id: r for r in langid.identify(df, model).collect()}
    assert (got[900].lang_pred, got[900].score, got[None].lang_pred, got[901].lang_pred) == ("und", 0.0, "und", "de")
    tie = langid.Crf(["a", "b"], {})
    assert {(r.lang_pred, r.score) for r in langid.identify(df.filter("doc_id = 901"), tie).collect()} == {("a", 0.5)}


def test_token_scan_round_trip(spark, tmp_path):
    rng = np.random.default_rng(1)
    lengths = [0, 3, 0, 0, 5000, 1, 70000, 0]
    flat = np.concatenate([np.r_[rng.integers(0, 9, n), 9] for n in lengths] + [rng.integers(0, 9, 11)]).astype("<u2")
    flat.tofile(tmp_path / "a.tokens")
    np.array([9, 9], "<u2").tofile(tmp_path / "b.tokens")
    (tmp_path / "c.tokens").write_bytes(b"")
    for block in (64, 1 << 20):
        got = sorted((r.file, r.ordinal, r.n_tokens) for r in tokens.count_tokens(spark, f"file://{tmp_path}", separator=9, block=block).collect())
        assert got == [("a.tokens", i, n) for i, n in enumerate([*lengths, 11])] + [("b.tokens", 0, 0), ("b.tokens", 1, 0)]


def test_document_tokens_match_the_tokenizer(spark, messy):
    encode = tokens.encoder(*tokens.vocabulary(f"{tokens.TOKENIZERS}/{tokens.RANKS}")).encode_ordinary
    got = {r.doc_id: r.n_tokens for r in tokens.document_tokens(messy).collect()}
    assert got == {r.doc_id: len(encode(r.text or "")) for r in messy.collect()}
    assert tokens.document_tokens(messy.limit(0)).count() == 0


def test_warc_round_trip_and_links(spark, tmp_path):
    pages = [(1, "http://a.b/c d\n", "<title>T &amp; U</title><p>x<script>y</script><br>z &lt;b&gt;<a href='/q'>l</a>"), (2, None, None), (2, None, None), (None, "http://x", "<!-- a")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("record", F.lit(1))
    rows = warc.page_derivatives(df).collect()
    assert len(rows) == 8
    ids = {warc.response(*p).get("WARC-Record-ID") for p in pages}
    assert {r.refers_to for r in rows} == ids
    text = next(bytes(r.block).decode() for r in rows if r.page_id == 1 and r.warc_type == "conversion")
    assert text == "T & U\nx\nz <b>l"
    for r in rows:
        (back,) = warc.read_records(bytes(r.record))
        assert back.block == bytes(r.block) and warc.sha1(back.block) == r.block_digest == back.get("warc-block-digest")
    records = [warc.response(*p) for p in pages]
    (tmp_path / "x.warc.gz").write_bytes(warc.write_records(records))
    files = warc.file_derivatives(spark.read.format("binaryFile").load(f"file://{tmp_path}"))
    assert Counter(r.record_id for r in files.collect()) == Counter(r.record_id for r in rows)
    with pytest.raises(ValueError):
        list(warc.read_records(records[0].to_bytes()[:-30]))


def independent_records(data):
    """(headers, block) of plain WARC bytes, split by hand."""
    found = []
    while data.strip():
        head, data = data.lstrip(b"\r\n").split(b"\r\n\r\n", 1)
        fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
        n = int(fields["Content-Length"])
        found.append((fields, data[:n]))
        data = data[n:]
    return found


def test_warc_files_with_broken_records(spark, tmp_path):
    good = [warc.response(i, f"http://h/{i}", f"<p>page {i}</p>") for i in range(4)]
    raw = [r.to_bytes() for r in good]
    bad = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: many\r\n\r\nx\r\n\r\n"
    files = {"a.warc": raw[0] + bad + raw[1], "b.warc": raw[2][:-30], "c.warc": b"no warc at all", "d.warc": b"", "e.warc.gz": warc.write_records(good[3:])[:-9], "f.warc.gz": warc.write_records(good)}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    read = spark.read.format("binaryFile").load(f"file://{tmp_path}")
    seen = [sorted((r.path[-9:], r.refers_to or "", r.warc_type or "", bool(r.error)) for r in warc.file_derivatives(f).collect()) for f in (read, read.select("path"))]
    assert seen[0] == seen[1]
    per = Counter((p.split("/")[-1], e) for p, _, _, e in seen[0])
    assert per == Counter({("a.warc", False): 4, ("a.warc", True): 1, ("b.warc", True): 1, ("c.warc", True): 1, ("e.warc.gz", True): 1, ("e.warc.gz", False): per["e.warc.gz", False], ("f.warc.gz", False): 8})
    for fields, block in independent_records(b"".join(raw)):
        assert fields["WARC-Block-Digest"] == "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()


def test_warc_bodies_are_decoded():
    page = "<title>é</title><p>text \u4e2d</p>"

    def conversion(body, *headers):
        block = "\r\n".join(["HTTP/1.1 200 OK", "Content-Type: text/html", *headers, "", ""]).encode() + body
        source = warc.Record([("WARC-Type", "response"), ("WARC-Record-ID", "<urn:x>"), ("Content-Length", str(len(block)))], block)
        meta, text = warc.derive(source)
        assert text.get("WARC-Refers-To") == meta.get("WARC-Refers-To") == "<urn:x>"
        return text.block.decode(), b"not-decoded" in meta.block

    raw = page.encode()
    chunked = b"".join(b"%x;q=1\r\n%s\r\n" % (len(raw[i : i + 7]), raw[i : i + 7]) for i in range(0, len(raw), 7)) + b"0\r\n\r\n"
    packed = gzip.compress(raw)
    want = ("é\ntext \u4e2d", False)
    assert conversion(raw) == want
    assert conversion(chunked, "Transfer-Encoding: chunked") == want
    assert conversion(packed, "Content-Encoding: gzip") == want
    assert conversion(zlib.compress(raw), "Content-Encoding: deflate") == conversion(zlib.compress(raw)[2:-4], "content-encoding: deflate") == want
    assert conversion(b"%x\r\n%s\r\n0\r\n\r\n" % (len(packed), packed), "Transfer-Encoding: chunked", "Content-Encoding: gzip") == want
    for body, header in ((packed[:9], "Content-Encoding: gzip"), (b"zz\r\n", "Transfer-Encoding: chunked"), (raw, "Content-Encoding: br")):
        assert conversion(body, header) == ("", True)


def test_license_scan_of_a_text_with_very_many_phrases(spark):
    """Work follows the number of matches, not its square."""
    n = 200_000
    text = "mit license " * n + "general public license"
    row = licenses.scan(docs_of(spark, [text, "mit license mit"])).filter("doc_id = 0").selectExpr("n_words", "size(base) AS n", "base[0] AS first", "base[size(base) - 1] AS last", "size(matches) AS m").first()
    assert (row.n_words, row.n, row.first.start, row.last.start, row.last.label) == (2 * n + 3, n + 1, 0, 2 * n, "gpl")


def test_language_id_learns_from_repeated_rows(spark):
    """Equal rows count once in the sample, so no language is lost or floods it."""
    rng = random.Random(31)
    names = [f"l{i:02}" for i in range(12)]
    stems = {x: ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=3)) for _ in range(5)] for x in names}
    say = lambda x, n: " ".join("".join(rng.choices(stems[x], k=2)) for _ in range(n))
    whole = [(i, say(x, 40), x) for i, x in enumerate(names)]
    df = spark.createDataFrame(whole, "doc_id long, text string, lang string").crossJoin(spark.range(1500).select(F.lit(0).alias("n"))).drop("n")
    learned = {r.lang for r in df.filter(~langid.held_out()).select("lang").distinct().collect()}
    model = langid.train(df)
    assert set(model.labels) == learned and 6 <= len(learned) < 12
    more = spark.createDataFrame([(100 + i, say(x, 40), x) for i in range(50) for x in names], "doc_id long, text string, lang string")
    assert set(langid.train(df.unionByName(more)).labels) == set(names)


def test_language_id_keeps_marks_with_their_letters():
    assert langid.LETTERS.findall("हिन्दी में été ́x 12") == ["हिन्दी", "में", "été", "x"]


def test_toxicity_brings_only_telling_buckets(spark):
    """Very long texts are read whole, and ``most`` bounds what is learned from them."""
    rng = random.Random(13)
    vocabulary = [f"w{''.join(rng.choices('abcdefghijklmnop', k=7))}" for _ in range(30_000)]
    rows, labels = [], []
    for i in range(300):
        bad = i % 5 == 0
        ws = rng.sample(vocabulary, 20_000 if i % 60 == 7 or i % 60 == 10 else 30)
        rows.append(" ".join(ws + (["zzgrumph", "qqvile"] if bad else [])))
        labels.append((i, int(bad)))
    df, lab = docs_of(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int")
    for most in (4096, 2):
        model = toxicity.train(df, lab, most=most)
        assert 0 < np.count_nonzero(model.weights) <= most
        got = {r.doc_id: r.predicted for r in toxicity.score_toxicity(df, model).collect()}
        assert np.mean([got[i] == y for i, y in labels]) > 0.97
    seen, held = np.array([9, 9, 3, 9, 9]), np.array([0, 9, 0, 2, 1])
    assert [*toxicity.telling(seen, held, 10, 10)] == [0, 3, 4] and [*toxicity.telling(seen, held, 10, 10, most=2)] == [0, 4]
