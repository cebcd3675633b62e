"""Language-model scores against a recursion over dictionaries of whole n-grams."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import lm
from tests.llm.test_operators import docs_of, words

END = ""


def brute(texts, learn, order):
    """(n_tokens, n_known, base, score) of each text, with the function p(word, context)."""
    lists = [[w.decode() for w in (t or "").encode().lower().split()] + [END] for t in texts]
    count = {k: Counter() for k in range(1, order + 1)}
    for ws, ok in zip(lists, learn):
        for k in range(1, order + 1) if ok else ():
            line = ws if k == 1 else [END, *ws]
            for i in range(len(line) - k + 1):
                gram = tuple(line[i : i + k])
                if END not in gram[1:-1]:
                    count[k][gram] += 1
    total, distinct = sum(count[1].values()), len(count[1])
    mass = {}
    for k in range(2, order + 1):
        sizes, numbers = [0] * 64, [0] * 64
        for n in count[k - 1].values():
            numbers[n.bit_length() - 1] += 1
            sizes[n.bit_length() - 1] += n
        mass[k] = lm.backoff_mass(numbers, sizes, sum(n == 1 for n in count[k].values()))

    def p(word, context):
        if not context:
            return (count[1][(word,)] + 0.5) / (total + 0.5 * (distinct + 1))
        k, below = len(context) + 1, p(word, context[1:])
        return (count[k][(*context, word)] + mass[k] * below) / (count[k - 1][context] + mass[k])

    rows = []
    for ws in lists:
        line, score = [END, *ws], 0.0
        for i in range(1, len(line)):
            score += math.log10(p(line[i], tuple(line[max(0, i - order + 1) : i])))
        rows.append((len(ws), sum(count[1][(w,)] > 0 for w in ws), sum(math.log10(p(w, ())) for w in ws), score))
    return rows, total, p, count


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(12)
    out = [words(rng, rng.randint(1, 60)) for _ in range(50)]
    out += [None, "", " \t\n", out[0], out[0], "Ünï ÜNÏ \x1c \xa0 a", "one", words(rng, 4000), "unseen words only here"]
    return out


@pytest.mark.parametrize("order", (1, 2, 3, 4))
def test_scores_match_brute_force(spark, texts, order):
    learn = [i % 5 != 1 for i in range(len(texts))]
    want, total, _, _ = brute(texts, learn, order)
    df = docs_of(spark, texts, clash=True).withColumn("learn", F.lit(7)).withColumn("told", F.lit(7)).repartition(3)
    for size, part in ((1 << 24, 1 << 22), (900, 64)):
        got = {r.doc_id: r for r in lm.score_texts(df, F.col("doc_id") % 5 != 1, order, size, part).collect()}
        assert len(got) == len(texts)
        for i, (n, known, base, score) in enumerate(want):
            r = got[i]
            assert (r.learned, r.n_tokens, r.n_known, r.train_tokens) == (learn[i], n, known, total)
            assert (r.base_score, r.score) == pytest.approx((base, score)), i


def test_probabilities_of_a_context_add_up_to_one(texts):
    _, _, p, count = brute(texts[:40], [True] * 40, 3)
    vocabulary = [w for (w,) in count[1]]
    for context in [(), ("bax",), (END,), ("bax", "key"), ("never",), ("bax", "never")]:
        assert sum(p(w, context) for w in vocabulary) + p("new word", context) == pytest.approx(1)


def test_model_foretells_texts_better_than_single_tokens(spark):
    rng = random.Random(3)
    pool = [words(rng, 1) + str(i) for i in range(60)]
    after = {w: rng.sample(pool, 3) for w in pool}

    def text():
        line = [rng.choice(pool)]
        while len(line) < 50:
            line.append(rng.choice(after[line[-1]]))
        return " ".join(line)

    rows = lm.score_texts(docs_of(spark, [text() for _ in range(300)]), F.col("doc_id") % 5 != 1).filter("NOT learned").collect()
    assert len(rows) == 60 and all(r.score > r.base_score + 30 for r in rows)


def test_scores_of_nothing_learned_of_no_rows_and_of_repeated_ids(spark):
    df = docs_of(spark, ["a b", "a b", None], ids=[None, 4, 4])
    rows = lm.score_texts(df, F.lit(None).cast("boolean")).collect()
    assert Counter((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in rows) == Counter({(None, 3, 0, 0, 0.0, 0.0): 1, (4, 3, 0, 0, 0.0, 0.0): 1, (4, 1, 0, 0, 0.0, 0.0): 1})
    assert lm.score_texts(df.limit(0), F.lit(True)).count() == 0
    with pytest.raises(ValueError):
        lm.score_texts(df, F.lit(True), 0)


def test_automaton_takes_failure_arcs(spark):
    """States carry on over known n-grams and fall back to the longest known suffix."""
    texts = ["a b c", "a b d", "b c a"]
    _, _, p, _ = brute(texts, [True] * 3, 3)
    row = lm.score_texts(docs_of(spark, [*texts, "a b a c"]), F.col("doc_id") < 3, 3).filter("doc_id = 3").first()
    steps = [p("a", (END,)), p("b", (END, "a")), p("a", ("a", "b")), p("c", ("b", "a")), p(END, ("a", "c"))]
    assert row.score == pytest.approx(sum(map(math.log10, steps)))


def test_backoff_mass_meets_the_share_of_rare_grams():
    rng = np.random.default_rng(5)
    for _ in range(20):
        counts = rng.integers(1, 500, 40)
        numbers, sizes = defaultdict(int), defaultdict(int)
        for c in counts:
            numbers[int(c).bit_length() - 1] += 1
            sizes[int(c).bit_length() - 1] += int(c)
        n, s = ([d[i] for i in range(64)] for d in (numbers, sizes))
        once = int(rng.integers(1, counts.sum()))
        m = lm.backoff_mass(n, s, once)
        mean = [(a, b / a) for a, b in zip(n, s) if a]
        assert sum(a * c * m / (c + m) for a, c in mean) == pytest.approx(once, rel=1e-3)
