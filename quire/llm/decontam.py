"""Benchmark decontamination: BM25 over test items with block-max WAND, every training passage a query.

Test items are the indexed documents, in blocks of neighbouring items with the largest impact of each
term kept per block.  Document frequencies, the number of items and their mean length are those of the
whole benchmark, however it is cut.  Impacts are divided by the item's score against itself, so one
threshold serves all items.  Passages are overlapping windows of a document's words, long enough to hold
any item of a length class whole.  Bounds are first summed for all passages of a batch at once, over
blocks of blocks; what passes is walked by block-max WAND, which returns all items at or above the
threshold.  An item counts as leaked when the passage also holds most of the five-word shingles of both
its question and its answer.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import arrow_map, materialize, release, skew_join, small_batches, text_batches

#: Words of ASCII letters and digits and of anything beyond ASCII, in bytes: what a passage is cut into.
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or 48 <= b <= 57 or b >= 128 else 32 for b in range(256))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[a-z0-9\x{80}-\x{10FFFF}]+"  # the same words to Spark, on text whose A-Z are lowered
K1, B = 1.2, 0.75
THRESHOLD, SHINGLE, OVERLAP = 0.6, 5, 0.8
#: Items of a block, and most blocks of blocks.
BLOCK, SPANS = 4, 512
#: Bytes of item text in one index; a larger benchmark takes one pass over the corpus for each so many.
INDEX_BYTES = 16 << 20
#: Least words of a passage's half; items longer than that have passages of their own, four times as long each.
STRIDE = 64


def words(text: bytes) -> list[bytes]:
    return text.translate(TABLE).split()


def question_answer(text: str) -> tuple[list[bytes], list[bytes]]:
    """Words of an item's question and answer: its last sentence or line answers, if there is another before."""
    parts = [words(p.encode()) for p in re.split(r"(?<=[.?!])\s+|\n", text)]
    parts = [p for p in parts if p]
    if len(parts) < 2:
        return sum(parts, []), sum(parts, [])
    return sum(parts[:-1], []), parts[-1]


def shingles(ws: list[bytes], n: int = SHINGLE) -> set[tuple[bytes, ...]]:
    return {tuple(ws[i : i + n]) for i in range(max(1, len(ws) - n + 1))} if ws else set()


def stride_of(n_words: int) -> int:
    """Half the passage length for items of so many words."""
    stride = STRIDE
    while stride < n_words:
        stride *= 4
    return stride


class Lists:
    """Values in lists laid end to end: list i is [starts[i]:starts[i + 1]]."""

    def __init__(self, owner: np.ndarray, at: np.ndarray, value: np.ndarray, n: int):
        key = owner.astype(np.int64) * (int(at.max()) + 1 if len(at) else 1) + at
        order = np.argsort(key, kind="stable")
        first = np.flatnonzero(np.r_[True, np.diff(key[order]) > 0]) if len(key) else np.zeros(0, np.int64)
        self.at = at[order][first].astype(np.int64)
        self.value = np.maximum.reduceat(value[order], first) if len(first) else value
        self.starts = np.searchsorted(owner[order][first], np.arange(n + 1))

    def get(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        a, b = self.starts[i], self.starts[i + 1]
        return self.at[a:b], self.value[a:b]


class Index:
    """Inverted index of the test items of one length class, with impacts and their maxima by block.

    ``items`` has (key, words, terms) with terms a list of (term, count in the item, items that hold it).
    """

    def __init__(self, items: list[tuple[int, int, list[tuple[bytes, int, int]]]], total: int, mean: float, stride: int = STRIDE, k1: float = K1, b: float = B, block: int = BLOCK):
        middle = lambda terms: sorted(t for t, _, _ in terms)[len(terms) // 2]
        items = sorted(items, key=lambda x: (middle(x[2]), x[0]))
        self.keys, self.stride, self.block = [x[0] for x in items], stride, block
        self.terms = {w: i for i, w in enumerate(sorted({w for x in items for w, _, _ in x[2]}))}
        term, item, impact = [], [], []
        for d, (_, length, terms) in enumerate(items):
            norm = k1 * (1 - b + b * length / mean)
            score = [math.log(1 + (total - df + 0.5) / (df + 0.5)) * n * (k1 + 1) / (n + norm) for _, n, df in terms]
            whole = math.fsum(score)
            term += [self.terms[w] for w, _, _ in terms]
            item += [d] * len(terms)
            impact += [s / whole for s in score]
        term, item, impact = np.array(term, np.int64), np.array(item, np.int64), np.array(impact)
        n = len(self.terms)
        blocks = -(-len(items) // block)
        wide = max(1, -(-blocks // SPANS))  # blocks in a block of blocks
        self.spans = -(-blocks // wide)
        self.postings = Lists(term, item, impact, n)
        self.bounds = Lists(term, item // block, impact, n)
        self.tops = np.zeros(n)
        np.maximum.at(self.tops, term, impact)
        coarse = Lists(term, item // block // wide, impact, n)
        # Terms of many blocks are added up as rows of a matrix, the others entry by entry.
        many = np.diff(coarse.starts) * 8 >= self.spans
        self.row = np.where(many, np.cumsum(many) - 1, -1)
        self.rows = np.zeros((int(many.sum()), self.spans), np.float32)
        owner = np.repeat(np.arange(n), np.diff(coarse.starts))
        self.rows[self.row[owner[many[owner]]], coarse.at[many[owner]]] = coarse.value[many[owner]]
        self.coarse = coarse
        self.walked: dict[int, tuple] = {}

    def ceilings(self, starts: np.ndarray, ends: np.ndarray, term: np.ndarray) -> np.ndarray:
        """The most any item can score against each passage, passage i having term[starts[i]:ends[i]]."""
        high = np.zeros(len(starts), np.float32)
        for j in range(0, len(starts), 2048):
            a, b, n = starts[j], ends[min(j + 2048, len(starts)) - 1], len(starts[j : j + 2048])
            terms, passage = term[a:b], np.repeat(np.arange(n), (ends - starts)[j : j + 2048])
            listed = self.row[terms] < 0
            t, p = terms[listed], passage[listed]
            size = self.coarse.starts[t + 1] - self.coarse.starts[t]
            at = np.repeat(self.coarse.starts[t] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            sums = np.bincount(np.repeat(p, size) * self.spans + self.coarse.at[at], self.coarse.value[at], n * self.spans).astype(float).reshape(n, self.spans)
            t, p = terms[~listed], passage[~listed]
            if len(t):
                first = np.flatnonzero(np.r_[True, p[1:] != p[:-1]])
                for i in range(0, self.spans, 64):
                    sums[p[first], i : i + 64] += np.add.reduceat(self.rows[self.row[t], i : i + 64], first, axis=0)
            high[j : j + 2048] = sums.max(1)
        return high

    def exhaustive(self, terms: set[int], threshold: float) -> dict[int, float]:
        """Scores by brute force, for tests."""
        parts: dict[int, list[float]] = {}
        for t in terms:
            for d, s in zip(*self.postings.get(t)):
                parts.setdefault(int(d), []).append(float(s))
        return {d: x for d, p in parts.items() if (x := math.fsum(p)) >= threshold - 1e-9}

    def _cursor(self, term: int) -> tuple[list[int], list[float], dict[int, float], float]:
        """Items, impacts, bounds by block and largest impact of a term, as Python values from its first use on."""
        if term not in self.walked:
            items, impacts = self.postings.get(term)
            at, bound = self.bounds.get(term)
            self.walked[term] = items.tolist(), impacts.tolist(), dict(zip(at.tolist(), bound.tolist())), float(self.tops[term])
        return self.walked[term]

    def search(self, terms: set[int], threshold: float) -> dict[int, float]:
        """All items scoring ``threshold`` or more for a set of terms, by block-max WAND."""
        cursors = [[p[0][0], 0, p] for p in map(self._cursor, sorted(terms))]
        found: dict[int, float] = {}
        slack = threshold - 1e-9

        def move(c, target):
            items = c[2][0]
            c[1] = i = bisect_left(items, target, c[1])
            c[0] = items[i] if i < len(items) else math.inf

        while cursors:
            cursors = [c for c in cursors if c[0] < math.inf]
            cursors.sort(key=lambda c: c[0])
            most, pivot = 0.0, -1
            for i, c in enumerate(cursors):
                most += c[2][3]
                if most >= slack:
                    pivot = i
                    break
            if pivot < 0:
                break
            doc = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == doc:
                pivot += 1
            block = doc // self.block
            if sum(c[2][2].get(block, 0.0) for c in cursors[: pivot + 1]) < slack:
                # No item of this block can reach the threshold with these terms: go to its end, or to the next term's item.
                ahead = (block + 1) * self.block
                if pivot + 1 < len(cursors):
                    ahead = min(ahead, cursors[pivot + 1][0])
                for c in cursors[: pivot + 1]:
                    move(c, ahead)
            elif cursors[0][0] == doc:
                score = math.fsum(c[2][1][c[1]] for c in cursors[: pivot + 1])
                for c in cursors[: pivot + 1]:
                    move(c, doc + 1)
                if score >= slack:
                    found[doc] = score
            else:
                for c in cursors[:pivot]:
                    if c[0] < doc:
                        move(c, doc)
        return found

    def hits(self, bags: list[list[bytes]], threshold: float):
        """(text, first word of the passage, key, score) of every item that reaches the threshold."""
        get, stride, n = self.terms.get, self.stride, len(self.terms)
        term, passage, first = [], [], [0]
        for ws in bags:
            ids = np.fromiter((get(w, -1) for w in ws), np.int64, len(ws))
            at = np.flatnonzero(ids >= 0)
            cell = at // stride
            # Passage i covers cells i and i + 1, so a word belongs to passages cell - 1 and cell.
            for shift in (1, 0):
                ok = cell >= shift
                term.append(ids[at[ok]])
                passage.append(first[-1] + cell[ok] - shift)
            first.append(first[-1] + max(1, -(-len(ws) // stride)))
        pairs = np.unique(np.concatenate(passage) * n + np.concatenate(term)) if passage and n else np.zeros(0, np.int64)
        if not len(pairs):
            return
        passage, term = pairs // n, pairs % n
        starts = np.flatnonzero(np.r_[True, passage[1:] != passage[:-1]])
        ends = np.r_[starts[1:], len(passage)]
        for k in np.flatnonzero(self.ceilings(starts, ends, term) >= threshold - 1e-4):
            text = int(np.searchsorted(first, passage[starts[k]], side="right")) - 1
            at = int(passage[starts[k]] - first[text]) * stride
            for d, score in self.search({*map(int, term[starts[k] : ends[k]])}, threshold).items():
                yield text, at, self.keys[d], score


class Items:
    """Test items with an index for each length class; items are known by their place in ``texts``."""

    def __init__(self, texts: list[str], terms: list[list[tuple[bytes, int, int]]], total: int, mean: float, block: int = BLOCK):
        self.texts = texts
        classes: dict[int, list] = {}
        for i, found in enumerate(terms):
            length = sum(n for _, n, _ in found)
            if found:
                classes.setdefault(stride_of(length), []).append((i, length, found))
        self.indexes = [Index(items, total, mean, stride, block=block) for stride, items in sorted(classes.items())]
        self.parts: dict[int, list[set]] = {}

    def shingled(self, i: int) -> list[set]:
        """Shingles of an item's question and answer, kept while they are few."""
        if i not in self.parts:
            if len(self.parts) > 4096:
                self.parts.clear()
            self.parts[i] = [shingles(p) for p in question_answer(self.texts[i])]
        return self.parts[i]

    def leaks(self, texts: list[bytes], threshold: float = THRESHOLD, overlap: float = OVERLAP) -> list[tuple[int, int, float, float, float]]:
        """(text, item, score, question overlap, answer overlap) of every verified hit, best passage each."""
        bags = [words(t) for t in texts]
        best: dict[tuple[int, int], tuple] = {}
        for index in self.indexes:
            held: dict[tuple[int, int, int], set] = {}
            for text, at, item, score in index.hits(bags, threshold):
                shares = []
                for part in self.shingled(item):
                    n = len(next(iter(part)))
                    if (text, at, n) not in held:
                        if len(held) > 64:
                            held.clear()
                        held[text, at, n] = shingles(bags[text][at : at + 2 * index.stride], n)
                    shares.append(len(part & held[text, at, n]) / len(part))
                if min(shares) >= overlap:
                    row = (score, *shares)
                    best[text, item] = max(best.get((text, item), row), row)
        return [(t, i, *row) for (t, i), row in sorted(best.items())]


def weighed(benchmark: DataFrame) -> tuple[DataFrame, int, float]:
    """Items with words as (item_id, text, n_bytes, terms), their number and mean length.

    ``terms`` holds each word with its count in the item and the number of items that hold it.
    """
    bag = F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(WORD), F.lit(0))
    items = benchmark.filter(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select("item_id", "text").distinct()
    items = materialize(items.withColumn("bag", bag).filter(F.size("bag") > 0).withColumn("row", F.xxhash64("item_id", "text")), "items")
    stats = items.agg(F.count("*").alias("n"), F.avg(F.size("bag")).alias("mean")).first()
    counts = materialize(items.select("row", "item_id", F.explode("bag").alias("word")).groupBy("row", "item_id", "word").agg(F.count("*").cast("int").alias("n")), "counts")
    frequency = materialize(counts.groupBy("word").agg(F.count("*").alias("df")), "frequency")
    joined = skew_join(counts, frequency, ["word"], "df", counts.count())
    terms = joined.groupBy("row", "item_id").agg(F.array_sort(F.collect_list(F.struct(F.encode("word", "UTF-8").alias("word"), "n", "df"))).alias("terms"))
    out = items.drop("bag").join(terms, ["row", "item_id"]).select("item_id", "text", "row", F.octet_length("text").alias("n_bytes"), "terms")
    out = materialize(out, "weighed")
    release(items, counts, frequency)
    return out, stats.n, stats.mean or 1.0


def find_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP, index_bytes: int = INDEX_BYTES) -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap), a row for each item a document holds.

    Null and wordless texts and items match nothing; ids may be of any type; items of equal text are all
    reported; repeated rows of ``docs`` repeat their rows.  What is sent to the executors is an index of
    about ``index_bytes`` of item text (one longer item stands alone); a larger benchmark takes that many
    passes over ``docs``, with the same results.
    """
    spark = docs.sparkSession
    kind, item_kind = docs.schema["doc_id"].dataType.simpleString(), benchmark.schema["item_id"].dataType.simpleString()
    schema = f"doc_id {kind}, item_id {item_kind}, score double, question_overlap double, answer_overlap double"
    items, total, mean = weighed(benchmark)
    size = items.agg(F.sum("n_bytes")).first()[0] or 0
    shards = max(1, -(-int(size) // index_bytes))
    out = None
    for shard in range(shards):
        part = items.filter(F.pmod(F.col("row"), F.lit(shards)) == shard).orderBy("row", "item_id").select("item_id", "text", "terms").toArrow()
        terms = [[(t["word"], t["n"], t["df"]) for t in found] for found in part.column("terms").to_pylist()]
        sent = spark.sparkContext.broadcast((part.column("item_id").combine_chunks(), Items(part.column("text").to_pylist(), terms, total, mean)))

        def run(batch: pa.RecordBatch, sent=sent) -> pa.RecordBatch:
            ids, index = sent.value
            found = index.leaks(text_batches(batch.column(1)), threshold, overlap)
            take = batch.column(0).take(pa.array([h[0] for h in found], pa.int64()))
            held = ids.take(pa.array([h[1] for h in found], pa.int64()))
            return pa.record_batch([take, held, *(pa.array([h[k] for h in found], pa.float64()) for k in (2, 3, 4))], ["doc_id", "item_id", "score", "question_overlap", "answer_overlap"])

        found = arrow_map(docs.select("doc_id", "text"), run, schema)
        out = found if out is None else out.unionByName(found)
    return out


def op6_decontaminate(spark, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return find_leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
