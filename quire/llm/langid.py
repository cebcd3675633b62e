"""Language of words and documents by a linear-chain conditional random field.

A word's potentials come from hashed character n-grams with word edges marked (so prefixes and
suffixes are features of their own) and from lexicons of frequent words of each language; transition
weights are learned with them, from sequences that switch language.  Words are labelled by
forward-backward over the whole text, so stretches of code-switched text get their own labels.
"""

from __future__ import annotations

import re
from collections import Counter
from unicodedata import category

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import arrow_map, materialize, release, small_batches, text_batches



def _class(chars: list[str]) -> str:
    """A class of characters, by ranges."""
    runs: list[list[int]] = []
    for c in map(ord, chars):
        if runs and runs[-1][1] == c - 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    return "[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in runs) + "]"


_ALL = [chr(i) for i in range(0x110000)]
#: Runs of letters and of the marks that combine with them.  Numerals such as a half or a superscript are
#: word characters to ``re`` but no letters; texts without any of these, and without marks, are read by
#: the shorter pattern, which says the same of them.
LETTERS = re.compile(_class([c for c in _ALL if c.isalpha()]) + _class([c for c in _ALL if c.isalpha() or category(c)[0] == "M"]) + "*")
PLAIN, ODD = re.compile(r"[^\W\d_]+"), re.compile("[²³¹¼½¾\u0300-\U0010ffff]")


def words_of(text: str) -> list[str]:
    return (LETTERS if ODD.search(text) else PLAIN).findall(text)


BUCKETS = 1 << 16
ORDERS = (2, 3, 4)
#: Bounds of the training sample: languages (the commonest), documents of each, words and characters
#: read of each, words of a lexicon.
MAX_LANGS, MAX_DOCS, MAX_WORDS, MAX_CHARS, LEXICON = 64, 120, 400, 8000, 200
CACHE = 200_000


def ngrams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(word index, bucket) of every character n-gram of ``words``, edges included."""
    flat = np.frombuffer(("\x02" + "\x03\x02".join(words) + "\x03").encode("utf-32-le"), np.uint32).astype(np.uint64)
    word = np.cumsum(flat == 2) - 1
    at, bucket = [], []
    h = flat.copy()
    for n in range(2, max(ORDERS) + 1):
        h = h[: len(h) - 1] * np.uint64(0x9E3779B97F4A7C15) + flat[n - 1 :]
        if n in ORDERS:
            ok = word[: len(h)] == word[n - 1 :]
            mixed = (h[ok] ^ (h[ok] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9 + 2 * n)
            at.append(word[: len(h)][ok])
            bucket.append((mixed >> np.uint64(48)).astype(np.int64))
    return np.concatenate(at), np.concatenate(bucket)


class Crf:
    """Weights of the field; ``labels`` are the languages learned."""

    def __init__(self, labels: list[str], lexicon: dict[str, int]):
        k = len(labels)
        self.labels, self.lexicon = labels, lexicon
        self.gram, self.lex = np.zeros((BUCKETS, k)), np.zeros((k, k))
        self.step, self.begin = np.zeros((k, k)), np.zeros(k)
        self.known: dict[str, int] = {}
        self.rows = np.zeros((0, k), np.float32)

    def potentials(self, words: list[str]) -> np.ndarray:
        """Unary potentials of ``words``, in logarithms."""
        k = len(self.labels)
        out = np.zeros((len(words), k))
        for i in range(0, len(words), 50_000):
            part = words[i : i + 50_000]
            at, bucket = ngrams(part)
            for c in range(k):
                out[i : i + len(part), c] = np.bincount(at, self.gram[bucket, c], len(part))
        listed = np.array([self.lexicon.get(w, -1) for w in words], np.int64)
        out[listed >= 0] += self.lex[listed[listed >= 0]]
        return out

    def look_up(self, text: str) -> np.ndarray:
        """Rows of ``self.rows`` for the text's words; new words are added, and kept while they are few."""
        known, ids, fresh = self.known, [], []
        base = len(self.rows)
        for w in words_of(text.lower()):
            i = known.get(w)
            if i is None:
                known[w] = i = base + len(fresh)
                fresh.append(w)
            ids.append(i)
        if fresh:
            p = self.potentials(fresh)
            self.rows = np.concatenate([self.rows, np.exp(p - p.max(1, keepdims=True)).astype(np.float32)])
        return np.array(ids, np.int64)

    def marginals(self, unary: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Label probabilities of every word by forward-backward over sequences laid end to end.

        ``unary`` holds exponentiated potentials; sequences advance together, longest first.
        """
        order = np.argsort(-lengths, kind="stable")
        starts = (np.cumsum(lengths) - lengths)[order]
        sizes = lengths[order]
        longest = int(sizes[0]) if len(sizes) else 0
        alive = np.searchsorted(-sizes, -np.arange(longest), side="left")  # sequences longer than t
        step = np.exp(self.step).astype(np.float32)
        fore, back = np.empty_like(unary), np.ones_like(unary)
        prev = None
        for t in range(longest):
            at = starts[: alive[t]] + t
            x = unary[at] * (np.exp(self.begin).astype(np.float32) if t == 0 else prev[: alive[t]] @ step)
            prev = x / x.sum(1, keepdims=True)
            fore[at] = prev
        for t in range(longest - 2, -1, -1):
            at = starts[: alive[t + 1]] + t
            x = (back[at + 1] * unary[at + 1]) @ step.T
            back[at] = x / x.sum(1, keepdims=True)
        both = fore * back
        return both / both.sum(1, keepdims=True)

    def predict(self, texts: list[str]) -> np.ndarray:
        """Expected number of words of each language in each text."""
        out = np.zeros((len(texts), len(self.labels)))
        if not self.labels:
            return out
        if len(self.known) > CACHE:
            self.known.clear()
            self.rows = self.rows[:0]
        ids = [self.look_up(t) for t in texts]
        lengths = np.array([len(i) for i in ids], np.int64)
        if lengths.sum():
            found = self.marginals(self.rows[np.concatenate(ids)], lengths)
            doc = np.repeat(np.arange(len(texts)), lengths)
            for c in range(found.shape[1]):
                out[:, c] = np.bincount(doc, found[:, c], len(texts))
        return out

    def tag(self, text: str) -> list[tuple[int, int, str, float]]:
        """(start, end, language, probability) of each word of one text."""
        spans = [m.span() for m in LETTERS.finditer(text)]
        words = [text[a:b].lower() for a, b in spans]
        if not words or not self.labels:
            return []
        p = self.potentials(words)
        found = self.marginals(np.exp(p - p.max(1, keepdims=True)).astype(np.float32), np.array([len(words)]))
        best = found.argmax(1)
        return [(a, b, self.labels[k], float(found[i, k])) for i, ((a, b), k) in enumerate(zip(spans, best))]


def fit(sample: list[tuple[str, str]], rounds: int = 40, seed: int = 5, length: int = 24) -> Crf:
    """Train on (text, language) pairs: words carry their text's language, sequences splice texts together."""
    labels = sorted({lang for _, lang in sample})
    k = len(labels)
    docs = [(words_of(t.lower())[:MAX_WORDS], labels.index(lang)) for t, lang in sample]
    docs = [d for d in docs if d[0]]
    counts = [Counter(w for ws, y in docs if y == c for w in ws) for c in range(k)]
    lexicon: dict[str, int] = {}
    for c in range(k):  # a word frequent in several languages belongs to the one where it is most so
        for w, n in sorted(counts[c].items(), key=lambda x: (-x[1], x[0]))[:LEXICON]:
            if all(n >= counts[o][w] for o in range(c)) and all(n > counts[o][w] for o in range(c + 1, k)):
                lexicon[w] = c
    model = Crf(labels, lexicon)
    if k < 2:
        return model
    rng = np.random.default_rng(seed)
    pieces = []
    for ws, y in docs:
        at = 0
        while at < len(ws):
            n = int(rng.integers(3, 16))
            pieces.append((ws[at : at + n], y))
            at += n
    rng.shuffle(pieces)
    # Documents mostly stay in one language, so half of the sequences are of one; the rest switch.
    pieces = sorted(pieces[: len(pieces) // 2], key=lambda p: p[1]) + pieces[len(pieces) // 2 :]
    words, gold = [w for ws, _ in pieces for w in ws], np.array([y for ws, y in pieces for _ in ws])
    n = len(words) // length * length
    if not n:
        n = len(words)
        length = n
    words, gold = words[:n], gold[:n]
    unique = sorted(set(words))
    place = {w: i for i, w in enumerate(unique)}
    ids = np.array([place[w] for w in words])
    at, bucket = ngrams(unique)
    listed = np.array([lexicon.get(w, -1) for w in unique])
    used = np.unique(bucket)
    short = np.searchsorted(used, bucket)
    lengths = np.full(n // length, length)
    hot = np.eye(k)[gold]
    heads = np.arange(0, n, length)
    pairs = np.setdiff1d(np.arange(1, n), heads)
    params = [np.zeros((len(used), k)), np.zeros((k, k)), np.zeros((k, k)), np.zeros(k)]
    squares = [np.full_like(p, 1e-3) for p in params]
    for _ in range(rounds):
        w, model.lex, model.step, model.begin = params
        logit = np.stack([np.bincount(at, w[short, c], len(unique)) for c in range(k)], 1)
        logit[listed >= 0] += model.lex[listed[listed >= 0]]
        unary = np.exp(logit - logit.max(1, keepdims=True))[ids]
        gamma, joint = _expectations(model, unary, length, k)
        diff = hot - gamma
        by_word = np.stack([np.bincount(ids, diff[:, c], len(unique)) for c in range(k)], 1)
        moved = np.zeros((k, k))
        np.add.at(moved, (gold[pairs - 1], gold[pairs]), 1)
        grads = [
            np.stack([np.bincount(short, by_word[at, c], len(used)) for c in range(k)], 1) - 0.01 * w,
            np.stack([by_word[listed == c].sum(0) for c in range(k)]),
            moved - joint,
            diff[heads].sum(0),
        ]
        for p, s, g in zip(params, squares, grads):
            s += g * g
            p += 0.3 * g / np.sqrt(s)
    model.gram[used], model.lex, model.step, model.begin = params
    return model


def _expectations(model: Crf, unary: np.ndarray, length: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Word marginals and the expected number of each transition, over sequences of one length."""
    u = unary.reshape(-1, length, k)
    step = np.exp(model.step)
    fore, back = np.empty_like(u), np.ones_like(u)
    for t in range(length):
        x = u[:, t] * (np.exp(model.begin) if t == 0 else fore[:, t - 1] @ step)
        fore[:, t] = x / x.sum(1, keepdims=True)
    joint = np.zeros((k, k))
    for t in range(length - 2, -1, -1):
        ahead = back[:, t + 1] * u[:, t + 1]
        x = ahead @ step.T
        pair = fore[:, t][:, :, None] * step[None] * ahead[:, None, :]
        joint += (pair / pair.sum((1, 2), keepdims=True)).sum(0)
        back[:, t] = x / x.sum(1, keepdims=True)
    both = fore * back
    return (both / both.sum(2, keepdims=True)).reshape(-1, k), joint


def held_out():
    """True for the quarter of documents that is never learned from (null ids count as the text '')."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4 == 2


def train(docs: DataFrame, max_docs: int = MAX_DOCS, max_langs: int = MAX_LANGS) -> Crf:
    """Learn from at most ``max_docs`` documents of each of the ``max_langs`` commonest languages.

    Documents are taken by hash of doc_id and text, held-out ones excluded; rows equal in language, doc_id
    and text count once.  Of each the first MAX_WORDS words, in its first MAX_CHARS characters, are learned
    from.  Languages tied in number go by name.
    """
    usable = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
    usable = usable.select("lang", "text", F.xxhash64(F.lit(3), F.col("doc_id").cast("string"), "text").alias("order"))
    distinct = materialize(usable.select("lang", "order").distinct(), "sample")
    langs = distinct.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(max_langs)  # that many rows
    unit = F.col("order").bitwiseAND(F.lit((1 << 40) - 1)) / float(1 << 40)
    # Of n hashes so many fall below the bound that max_docs of them are there, or all are.
    some = distinct.join(F.broadcast(langs), "lang").filter(unit * F.col("n") < 1.5 * max_docs + 20)
    place = F.row_number().over(Window.partitionBy("lang").orderBy(unit, "order"))
    picked = some.select("lang", "order", place.alias("place")).filter(F.col("place") <= max_docs)  # max_langs * max_docs rows
    short = usable.select("lang", "order", F.substring("text", 1, MAX_CHARS).alias("text"))
    kept = short.join(F.broadcast(picked), ["lang", "order"]).groupBy("lang", "place").agg(F.min("text").alias("text")).collect()
    release(distinct)
    return fit([(r.text, r.lang) for r in sorted(kept, key=lambda r: (r.lang, r.place))])


def identify(docs: DataFrame, model: Crf) -> DataFrame:
    """(doc_id, lang_pred, score, mix) for each row of ``docs``; of languages that tie the first by name wins.

    ``score`` is the predicted language's share of the text's expected words, ``mix`` the share of each
    language.  Null texts and texts without a letter are ``und`` with score 0, as is every text when no
    language could be learned.  Whole texts are read; repeated rows come out alike.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = model.predict([t.decode("utf-8", "replace") for t in text_batches(batch.column(1))])
        total = found.sum(1)
        share = found / np.maximum(total, 1e-9)[:, None]
        best = share.argmax(1) if share.shape[1] else np.zeros(len(share), int)
        names = [model.labels[b] if n > 0 else "und" for b, n in zip(best, total)]
        score = [min(1.0, float(share[i, b])) if total[i] > 0 else 0.0 for i, b in enumerate(best)]
        mix = [list(zip(model.labels, map(float, s))) if n > 0 else [] for s, n in zip(share, total)]
        return pa.record_batch(
            [batch.column(0), pa.array(names, pa.string()), pa.array(score, pa.float64()), pa.array(mix, pa.map_(pa.string(), pa.float64()))], ["doc_id", "lang_pred", "score", "mix"]
        )

    return arrow_map(docs.select("doc_id", "text"), run, f"doc_id {kind}, lang_pred string, score double, mix map<string,double>")


def label_words(docs: DataFrame, model: Crf) -> DataFrame:
    """(doc_id, words) with words an array of start, end (characters), lang, probability."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    item = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string()), ("p", pa.float64())]))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        tags = [[dict(zip(("start", "end", "lang", "p"), x)) for x in model.tag(t.decode("utf-8", "replace"))] for t in text_batches(batch.column(1))]
        return pa.record_batch([batch.column(0), pa.array(tags, item)], ["doc_id", "words"])

    return arrow_map(docs.select("doc_id", "text"), run, f"doc_id {kind}, words array<struct<start:int,end:int,lang:string,p:double>>")


def op2_language_id(spark, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify(docs, train(docs)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
