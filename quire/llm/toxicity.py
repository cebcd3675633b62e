"""Toxicity by non-negative positive-unlabelled learning.

A linear model over hashed words and word beginnings is trained from confirmed toxic documents (P) and
unlabelled text (U).  With class prior q the risk is
    q * E_P[loss(+)] + max(0, E_U[loss(-)] - q * E_P[loss(-)]),
and where the second term falls below zero its gradient is reversed, as the non-negative estimator
prescribes.  No document is ever taken as a negative.
"""

from __future__ import annotations

from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import arrow_map, materialize, release, small_batches, text_batches

BUCKETS = 1 << 18
#: Bounds of the training sample: documents of either kind, and buckets that weigh anything.
MAX_POSITIVE, MAX_UNLABELLED, MAX_KEPT = 2000, 6000, 4096
#: Letters of a word: a-z and all bytes beyond ASCII; A-Z are lowered, all else separates.
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def word_buckets(word: bytes) -> tuple[int, int, int]:
    """The word itself and its first four and five bytes, hashed."""
    return crc32(word, 1) % BUCKETS, crc32(word[:4], 2) % BUCKETS, crc32(word[:5], 3) % BUCKETS


def features(text: bytes) -> dict[int, int]:
    """Number of distinct words of the text behind each bucket."""
    found: dict[int, int] = {}
    for word in set(text.translate(TABLE).split()):
        for b in word_buckets(word):
            found[b] = found.get(b, 0) + 1
    return found


class Known(dict):
    """Weights of words met so far by a worker."""

    def __init__(self, weights: np.ndarray):
        self.weights = weights

    def __missing__(self, word: bytes) -> float:
        a, b, c = word_buckets(word)
        self[word] = x = float(self.weights[a] + self.weights[b] + self.weights[c])
        return x


@dataclass
class ToxicModel:
    weights: np.ndarray
    bias: float
    prior: float

    def score(self, texts: list[bytes]) -> np.ndarray:
        """Probability of label 1 for each text; each distinct word adds the weights of its buckets."""
        known, out = self.__dict__.setdefault("known", Known(self.weights)), np.empty(len(texts))
        for i, text in enumerate(texts):
            out[i] = self.bias + sum(map(known.__getitem__, set(text.translate(TABLE).split())))
            if len(known) > 300_000:
                known.clear()
        return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


@dataclass
class Bags:
    """Features of many documents, flat: document i has buckets[starts[i]:starts[i + 1]] and their counts."""

    starts: np.ndarray
    buckets: np.ndarray
    counts: np.ndarray

    @classmethod
    def of(cls, docs: list[dict[int, int]]) -> Bags:
        sizes = [len(d) for d in docs]
        flat = lambda values: np.fromiter((x for d in docs for x in values(d)), np.int32, sum(sizes))
        return cls(np.cumsum([0, *sizes]), flat(dict.keys), flat(dict.values))

    def __len__(self) -> int:
        return len(self.starts) - 1


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def risk_and_step(p, u, prior: float, w: np.ndarray, b: float, ridge: float) -> tuple[float, float, np.ndarray]:
    """(positive part, negative part, direction) of the corrected risk at weights ``w`` and bias ``b``.

    ``p`` and ``u`` are (rows, columns, values, number of rows).  The risk is the positive part plus the
    negative part where that is not below zero; the direction is the gradient of the sum then, and of
    minus the negative part alone otherwise.  Weights are held by half ``ridge`` times their square.
    """
    fp, fu = (np.bincount(x[0], x[2] * w[x[1]], x[3]) + b for x in (p, u))
    positive = prior * np.logaddexp(0, -fp).mean()
    negative = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
    if negative >= 0:
        gp, gu = -prior * (_sigmoid(-fp) + _sigmoid(fp)) / p[3], _sigmoid(fu) / u[3]
    else:
        gp, gu = prior * _sigmoid(fp) / p[3], -_sigmoid(fu) / u[3]
    step = np.bincount(p[1], p[2] * gp[p[0]], len(w)) + np.bincount(u[1], u[2] * gu[u[0]], len(w)) + ridge * w
    return positive, negative, np.append(step, gp.sum() + gu.sum())


def telling(seen: np.ndarray, held: np.ndarray, positives: int, unlabelled: int, most: int = MAX_KEPT, least: int = 4, surprise: float = 4.0) -> np.ndarray:
    """The buckets that weigh anything, from the numbers of positives and of unlabelled texts that hold each.

    They stand in ``least`` positives, and there ``surprise`` standard deviations more often than in
    unlabelled text; of more than ``most`` the most surprising stay.
    """
    usual = (held + 0.5) * positives / max(1, unlabelled)
    excess = (seen - usual) / np.sqrt(np.maximum(usual, 1e-9))
    keep = np.flatnonzero((seen >= min(least, positives)) & (excess >= surprise))
    return np.sort(keep[np.argsort(-excess[keep], kind="stable")[:most]])


def fit(positive: Bags, unlabelled: Bags, prior: float, keep: np.ndarray | None = None, rounds: int = 200, rate: float = 0.1, ridge: float = 1e-3) -> ToxicModel:
    """Train by Adam on the non-negative risk, on the buckets of ``keep`` alone (else those that ``telling`` finds).

    A ``prior`` above what the unlabelled text allows is lowered.  Without positives every text scores near 0.
    """
    if not len(positive) or not len(unlabelled):
        return ToxicModel(np.zeros(BUCKETS, np.float32), -30.0 if not len(positive) else 0.0, prior)
    if keep is None:
        keep = telling(*(np.bincount(x.buckets, minlength=BUCKETS) for x in (positive, unlabelled)), len(positive), len(unlabelled))
    place = np.full(BUCKETS, -1, np.int32)
    place[keep] = np.arange(len(keep))

    def sparse(docs: Bags):
        cols = place[docs.buckets]
        ok = cols >= 0
        rows = np.repeat(np.arange(len(docs)), np.diff(docs.starts))[ok]
        return rows, cols[ok], np.minimum(docs.counts[ok], 4).astype(np.float64), len(docs)

    p, u = sparse(positive), sparse(unlabelled)
    # Unlabelled text holds at least prior times the positives' share of any event, so an event bounds the
    # prior: here, holding one of the buckets kept.  It matters where labels were not drawn evenly.
    share = lambda x: len(np.unique(x[0])) / x[3]
    if share(p) > 0:
        prior = min(prior, max(0.001, share(u) / share(p)))
    w, b = np.zeros(len(keep)), float(np.log(prior / (1 - prior)))
    m, v = np.zeros(len(keep) + 1), np.zeros(len(keep) + 1)
    for t in range(1, rounds + 1):
        grad = risk_and_step(p, u, prior, w, b, ridge)[2]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    full = np.zeros(BUCKETS, np.float32)
    full[keep] = w
    return ToxicModel(full, float(b), prior)


def held_out(doc_id=None):
    """True for the fifth of documents whose labels are never learned from (null ids count as the text '')."""
    key = F.coalesce((F.col("doc_id") if doc_id is None else doc_id).cast("string"), F.lit(""))
    return F.crc32(key.cast("binary")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED, most: int = MAX_KEPT) -> ToxicModel:
    """Learn from at most ``max_positive`` documents marked toxic and ``max_unlabelled`` others, by hash of doc_id.

    Held-out documents are left out on both sides.  A document with several labels is toxic if one says
    so; of rows that share a doc_id the least text is read.  The class prior is the share of toxic among
    all labelled documents that are not held out, kept within 0.001 and 0.999.  Texts are read whole.
    What comes to the driver is how many texts hold each bucket, and of each text the buckets that weigh
    anything, ``most`` at most.
    """
    order = F.xxhash64(F.lit(11), F.col("doc_id"))
    usable = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = usable.agg(F.count("*").alias("n"), F.coalesce(F.sum((F.col("toxic") == 1).cast("int")), F.lit(0)).alias("k")).first()
    prior = min(max(counts.k / max(1, counts.n), 0.001), 0.999)
    n = docs.count()
    unit = lambda c: c.bitwiseAND(F.lit((1 << 40) - 1)) / float(1 << 40)
    some = lambda df, bound, of: df.filter(unit(order) < min(1.0, 2.0 * bound / max(1, of))).orderBy(order, "doc_id").limit(bound)
    ids = some(usable.filter("toxic = 1"), max_positive, counts.k).select("doc_id")
    others = some(docs.filter(F.col("doc_id").isNotNull() & ~held_out()).select("doc_id"), max_unlabelled, n).distinct()
    wanted = ids.withColumn("toxic", F.lit(True)).unionByName(others.withColumn("toxic", F.lit(False)))  # max_positive + max_unlabelled rows
    texts = docs.select("doc_id", "text").join(F.broadcast(wanted), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))

    def found(batch: pa.RecordBatch) -> pa.RecordBatch:
        kind, each = pa.list_(pa.int32()), [features(t) for t in text_batches(batch.column(1))]
        return pa.record_batch([batch.column(0), pa.array([[*f] for f in each], kind), pa.array([[*f.values()] for f in each], kind)], ["toxic", "b", "n"])

    bags = materialize(arrow_map(texts.select("toxic", "text"), found, "toxic boolean, b array<int>, n array<int>"), "bags")
    sizes = {r.toxic: r["count"] for r in bags.groupBy("toxic").count().collect()}
    by_bucket = bags.select("toxic", F.explode("b").alias("b")).groupBy("b").agg(F.count_if("toxic").alias("p"), F.count_if(~F.col("toxic")).alias("u")).toArrow()  # BUCKETS rows at most
    held = np.zeros((2, BUCKETS), np.int64)
    for row, c in enumerate(("p", "u")):
        held[row, by_bucket.column("b").to_numpy()] = by_bucket.column(c).to_numpy()
    keep = telling(*held, sizes.get(True, 0), sizes.get(False, 0), most)

    def kept(batch: pa.RecordBatch) -> pa.RecordBatch:
        lists = batch.column(0)
        b, n = lists.flatten().to_numpy(), batch.column(1).flatten().to_numpy()
        row = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
        ok = np.isin(b, keep)
        ends = np.concatenate([[0], np.cumsum(np.bincount(row[ok], minlength=len(lists)))])
        return pa.record_batch([pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x[ok])) for x in (b, n)], ["b", "n"])

    def read(toxic: bool) -> Bags:
        rows = arrow_map(bags.filter(F.col("toxic") == toxic).select("b", "n"), kept, "b array<int>, n array<int>").toArrow()
        b, n = rows.column("b").combine_chunks(), rows.column("n").combine_chunks()
        if not len(b):
            return Bags.of([])
        return Bags(b.offsets.to_numpy().astype(np.int64) - b.offsets[0].as_py(), b.flatten().to_numpy(), n.flatten().to_numpy())

    model = fit(read(True), read(False), prior, keep)
    release(bags)
    return model


def score_toxicity(docs: DataFrame, model: ToxicModel) -> DataFrame:
    """(doc_id, score, predicted) for each row of ``docs``; null and wordless texts get the bias alone.

    Very long texts are read whole.  Repeated rows score alike; other columns are ignored.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        s = model.score(text_batches(batch.column(1)))
        return pa.record_batch([batch.column(0), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    return arrow_map(docs.select("doc_id", "text"), run, f"doc_id {kind}, score double, predicted int")


def op7_toxicity(spark, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_toxicity(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")
