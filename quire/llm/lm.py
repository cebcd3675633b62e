"""Language-model scores by a weighted backoff automaton.

N-grams of all training texts are counted whole, over shards and then over ranges of their hashes.
Each shard gets back the counts of its own n-grams and builds from them the part of the automaton that
its texts can reach: the n-grams known in training that are shorter than ``order`` are states, each has
an arc for every known continuation and a failure arc to its longest known suffix.  A text is walked
once from left to right: where the state has no arc for the next token its failure arc is taken, and the
weights, log10 probabilities, add up.

Smoothing interpolates: p(w | h) = (c(h w) + m p(w | h')) / (c(h) + m), with h' one token shorter and the
base distribution of single tokens below; a failure arc weighs m / (c(h) + m).  For each order m is the
value at which the weight of all failure arcs, by how often their states are left, is what the share of
n-grams seen once estimates for unseen ones (Good-Turing).  A document's end precedes its first token.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import materialize, release, small_batches, text_batches
from .shards import ASKED, asked_rows, blob, by_shard, dealt, one_list, pack, sharded, told, unpack

ORDER = 2
#: Bytes of text in a shard, n-grams counted in one task at a time, about, and the least number of such parts.
SHARD, PART, PARTS = 4 << 20, 1 << 20, 64
#: What is added to the count of every token.
ADDED = 0.5
END = b""


class Ids(dict):
    """Numbers of tokens in the order they are met; the end is 0."""

    def __init__(self):
        super().__init__({END: 0})

    def __missing__(self, token: bytes) -> int:
        self[token] = n = len(self)
        return n


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Windows:
    """The n-grams of a shard: of each order the distinct hashes, and which of them starts at each place.

    Documents are laid end to end in ``sequence`` behind one more end, so an end stands before each.  A
    window of k tokens holds no end but as its first or last token; ``gram[k]`` has the number of its hash
    among ``hashes[k]`` where one starts, and -1 at other places.
    """

    def __init__(self, tokens: np.ndarray, hashes: np.ndarray, order: int):
        self.sequence = np.concatenate([np.zeros(1, np.int32), tokens.astype(np.int32)])
        end = self.sequence == 0
        h = single = hashes[self.sequence]
        self.hashes, self.gram = {}, {}
        for k in range(1, order + 1):
            if k > 1:
                h = _mixed(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + single[k - 1 :] + np.uint64(k))
            ok = np.ones(len(h), bool)
            ok[0] = k > 1
            for j in range(1, k - 1):
                ok &= ~end[j : j + len(h)]
            self.hashes[k], gram = np.unique(h[ok], return_inverse=True)
            self.gram[k] = np.full(len(h), -1, np.int32)
            self.gram[k][ok] = gram
        self.gram[1][0] = self.gram[1][np.flatnonzero(end)[1]]  # no token of a document, but a context


def _shard(rows: pa.Table) -> dict[str, pa.Array]:
    ids, docs = Ids(), []
    look = ids.__getitem__
    for text in text_batches(rows.column(1)):
        words = text.lower().split()
        words.append(END)
        docs.append(np.fromiter(map(look, words), np.uint32, len(words)))
    hashes = np.fromiter((xxhash.xxh64_intdigest(w, 11) for w in ids), np.uint64, len(ids))
    return {
        "ids": one_list(rows.column(0)),
        "learn": one_list(rows.column(2)),
        "lengths": blob(pack(np.array([len(d) for d in docs], np.int64))),
        "seq": blob(pack(np.concatenate([*docs, np.zeros(0, np.uint32)]))),
        "vocab": blob(hashes.tobytes()),
        "tokens": pa.array([sum(map(len, docs))]),
        "trained": pa.array([sum(len(d) for d, x in zip(docs, rows.column(2).to_pylist()) if x)]),
    }


def _windows(x: dict, order: int) -> tuple[Windows, np.ndarray]:
    lengths = unpack(x["lengths"].as_py()).astype(np.int64)
    hashes = np.frombuffer(x["vocab"].as_py(), np.uint64)
    return Windows(unpack(x["seq"].as_py()), hashes, order), lengths


def _asked(order: int, bits: int):
    """Of each part of the hash range a shard's n-grams of each order and how often its training texts hold them."""

    def run(x: dict) -> pa.RecordBatch:
        out = []
        held, lengths = _windows(x, order)
        learn = np.concatenate([[False], np.repeat(x["learn"].values.to_numpy(zero_copy_only=False).astype(bool), lengths)])
        for k in range(1, order + 1):
            # A window belongs to the document of its last token.
            n = np.bincount(held.gram[k][(held.gram[k] >= 0) & learn[k - 1 :]], minlength=len(held.hashes[k]))
            out += [(p, x["shard"].as_py(), k, hashes, counts) for p, hashes, counts in dealt(held.hashes[k], n, bits)]
        return asked_rows(out)

    return run


def backoff_mass(numbers, sizes, once: int) -> float:
    """The m of one order: contexts of mean count sizes[i] / numbers[i], numbers[i] of each, give ``once`` of their uses to failure arcs."""
    n, c = np.array(numbers, float), np.array(sizes, float)
    c = np.divide(c, n, out=np.zeros_like(c), where=n > 0)
    low, high = -3.0, 6.0
    for _ in range(60):
        m = (low + high) / 2
        if (n * c * 10**m / (c + 10**m)).sum() < once:
            low = m
        else:
            high = m
    return 10**low


class Automaton:
    """States, arcs and failure arcs over the n-grams of a shard.

    A state is an n-gram shorter than the order, the empty context among them.  ``arcs[k]`` has the weight
    of the arc to each n-gram of order k from the one without its last token, NaN where there is none;
    ``fails[k]`` that of the failure arc from each n-gram of order k to the one without its first token, 0
    where the n-gram is unknown, which makes it as good as the shorter one.  Both are looked up by the
    number an n-gram has in the shard, so the text's own window finds the arc.
    """

    def __init__(self, held: Windows, counts: dict[int, np.ndarray], single: np.ndarray, mass: dict[int, float]):
        """``single`` holds the probability of each distinct token, ``counts`` the counts of each order's n-grams."""
        self.held, self.order = held, max(held.hashes)
        self.arcs, self.fails = {1: np.log10(single)}, {}  # the empty context has an arc for every token
        below = single
        for k in range(2, self.order + 1):
            place = np.empty(len(held.hashes[k]), np.int64)  # where each n-gram stands
            starts = np.flatnonzero(held.gram[k] >= 0)
            place[held.gram[k][starts]] = starts
            prefix, suffix, m = held.gram[k - 1][place], held.gram[k - 1][place + 1], mass[k]
            below = (counts[k] + m * below[suffix]) / (counts[k - 1][prefix] + m)
            self.arcs[k] = np.where(counts[k] > 0, np.log10(below), np.nan)
            self.fails[k - 1] = np.log10(m / (counts[k - 1] + m))

    def walk(self, start: int, n: int) -> float:
        """log10 probability of the document whose ``n`` tokens, its end last, begin at ``start``."""
        places = np.arange(start, start + n)
        arcs = [self.arcs[k][self.held.gram[k][np.maximum(places - k + 1, 0)]].tolist() for k in range(1, self.order + 1)]
        fails = [None] + [self.fails[k][self.held.gram[k][np.maximum(places - k, 0)]].tolist() for k in range(1, self.order)]
        deepest = self.order - 1
        state, total = min(1, deepest), 0.0  # an end has been read
        for i in range(n):
            weight = arcs[state][i]
            while weight != weight:
                total += fails[state][i]
                state -= 1
                weight = arcs[state][i]
            total += weight
            if state < deepest:
                state += 1
        return total


def _scored(order: int, bits: int, total: int, distinct: int, mass: dict[int, float]):
    def run(x: dict) -> pa.RecordBatch:
        held, lengths = _windows(x, order)
        found = sorted((t["kind"].as_py(), t["part"].as_py(), i) for i, t in enumerate(x["told"]))
        counts = {k: np.concatenate([unpack(x["told"][i]["counts"].as_py()).astype(np.int64) for n, _, i in found if n == k]) for k in range(1, order + 1)}
        single = (counts[1] + ADDED) / (total + ADDED * (distinct + 1))
        gram = held.gram[1][1:]
        starts = np.cumsum(lengths) - lengths
        base = np.add.reduceat(np.log10(single)[gram], starts)
        known = np.add.reduceat((counts[1] > 0)[gram].astype(np.int64), starts)
        model = Automaton(held, counts, single, mass)
        score = [model.walk(a + 1, n) for a, n in zip(starts.tolist(), lengths.tolist())]
        columns = [x["ids"].values, x["learn"].values, pa.array(lengths), pa.array(known), pa.array(np.full(len(lengths), total)), pa.array(base), pa.array(score, pa.float64())]
        return pa.record_batch(columns, ["doc_id", "learned", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return run


def score_texts(docs: DataFrame, learn: Column, order: int = ORDER, size: int = SHARD, part: int = PART) -> DataFrame:
    """(doc_id, learned, n_tokens, n_known, train_tokens, base_score, score) for each row of ``docs``.

    The model learns from the rows where ``learn`` is true, all of them; ``train_tokens`` are their
    tokens, ``n_known`` those of the row's tokens that stand among them, ``base_score`` is the row's log10
    probability by single tokens alone, ``score`` that by the automaton of ``order``.  Null and blank texts
    are an end alone; without training texts every token has probability 1.  Texts are read whole, however
    long; repeated rows count, and come out, as often as they stand; doc_id may be null or of any type;
    other columns are ignored.  Tokens and n-grams are known by 64-bit hashes.
    """
    if order < 1:
        raise ValueError("n-grams have a token at least")
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text", F.coalesce(learn, F.lit(False)).alias("learn"))
    held = sharded(rows, _shard, f"ids array<{kind}>, learn array<boolean>, lengths binary, seq binary, vocab binary, tokens long, trained long", "tokens", size)
    sums = held.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tokens", "trained"))).first()
    bits = max(PARTS - 1, sums["tokens"] * order // part).bit_length()
    asked = by_shard(held.select("shard", "learn", "lengths", "seq", "vocab"), _asked(order, bits), ASKED)
    totals = materialize(told(asked, bits), "counts")
    stats = {k: [0, 0, [0] * 64, [0] * 64] for k in range(1, order + 1)}
    summed = totals.filter("known IS NOT NULL").groupBy("kind").agg(F.sum("known"), F.sum("once"), *(F.sum(F.col(c)[i]) for c in ("numbers", "sizes") for i in range(64)))
    for r in summed.collect():  # a row for each order
        stats[r[0]] = [r[1], r[2], [*r[3:67]], [*r[67:131]]]
    mass = {k: backoff_mass(*stats[k - 1][2:], stats[k][1]) for k in range(2, order + 1)}
    counts = totals.groupBy("shard").agg(F.collect_list(F.struct("kind", "part", "counts")).alias("told"))
    both = held.drop("tokens", "trained").join(counts, "shard")
    schema = f"doc_id {kind}, learned boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    out = materialize(by_shard(both, _scored(order, bits, sums["trained"], stats[1][0], mass), schema), "scores")
    release(held, totals)
    return out


def held_out() -> Column:
    """True for the fifth of documents that is never learned from (null ids count as the text '')."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 1


def op11_lm_scores(spark, sf_dir: str) -> DataFrame:
    small_batches(spark)
    out = score_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"), ~held_out())
    return out.select("doc_id", (~F.col("learned")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
