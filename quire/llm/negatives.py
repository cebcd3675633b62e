"""Hard negatives by norm-bucketed search.

Vectors are dealt out by falling norm into shells, and each shell into buckets of a bounded size; anchors
stand in blocks.  By Cauchy-Schwarz no row of a bucket scores more against an anchor than the product of
the anchor's norm and the bucket's largest.  The shells are searched in rounds, the longest vectors first
and each round larger than all before it.  An anchor meets a bucket only if that product reaches the
lower limit of one of its windows and, once it has them, its kth best score so far; the blocks leave out
whole shells by the same bound.  One product of two matrices scores a block and a bucket, and each
anchor passes on its k best of a bucket at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import arrow_map, materialize, release, small_batches
from .shards import blob

SCALE, POSITIVES, NEGATIVES, LOW, HIGH = 256, 5, 3, 50, 95
#: Rows and bytes of a bucket, anchors of a block, rows of a shell, most shells, and how much larger each round is.
BUCKET, BUCKET_BYTES, BLOCK, SHELL, SHELLS, GROWTH = 4096, 2 << 20, 256, 1 << 15, 4096, 4
#: Scores are exact in double precision below, and are told apart together with a place in a bucket.
MOST = 1 << 50
LEAST = -MOST


def quantized(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, label, q, norm): floor(scale * x) of each component as 4-byte integers, and their norm.

    Rows with a null vec_id, label or vector, and those with a null or non-finite component, take no part.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        lists = batch.column(2)
        flat, ends = lists.flatten(), np.cumsum(lists.value_lengths().fill_null(0).to_numpy())
        x = flat.cast(pa.float64()).to_numpy(zero_copy_only=False)  # a null becomes NaN
        sizes = np.diff(ends, prepend=0)
        row = np.repeat(np.arange(len(lists)), sizes)
        ok = np.bincount(row, ~np.isfinite(x), len(lists)) == 0
        q = np.floor(scale * np.where(np.isfinite(x), x, 0))
        norm = np.sqrt(np.bincount(row, q * q, len(lists)))
        ok &= ~np.asarray(lists.is_null()) & ~np.asarray(batch.column(0).is_null()) & ~np.asarray(batch.column(1).is_null())
        if (norm[ok] ** 2 >= MOST).any():
            raise ValueError(f"a vector's norm times {scale} is 2 ** 25 or more")
        q, keep = q.astype("<i4"), np.flatnonzero(ok)
        data = [q[e - n : e].tobytes() for e, n in zip(ends[keep].tolist(), sizes[keep].tolist())]
        take = pa.array(keep)
        return pa.record_batch([batch.column(0).take(take), batch.column(1).take(take), pa.array(data, pa.binary()), pa.array(norm[keep])], ["vec_id", "label", "q", "norm"])

    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "embedding")
    return arrow_map(rows, run, "vec_id long, label long, q binary, norm double")


def _runs(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """The rows of a task in order, in tables of up to ``rows`` rows and BUCKET_BYTES bytes, each of vectors of one length."""
    held, n, size, width = [], 0, 0, None
    for batch in batches:
        at, widths = 0, pc.binary_length(batch.column("q")).to_numpy()
        while at < batch.num_rows:
            w = int(widths[at])
            if held and (w != width or n >= rows or size >= BUCKET_BYTES):
                yield pa.Table.from_batches(held)
                held, n, size = [], 0, 0
            width = w
            other = np.flatnonzero(widths[at:] != w)
            most = max(1, min(rows - n, (BUCKET_BYTES - size) // max(1, w)))
            step = min(int(other[0]) if len(other) else batch.num_rows - at, most)
            held.append(batch.slice(at, step))
            n, size, at = n + step, size + step * w, at + step
    if held:
        yield pa.Table.from_batches(held)


def _matrix(column: pa.ChunkedArray) -> bytes:
    return b"".join(column.to_pylist())


def buckets(rows: DataFrame, shell: int = SHELL) -> tuple[DataFrame, list[float]]:
    """Buckets (shell, ids, labels, q, norm), their rows by falling norm and each by id, and the largest norm of each shell."""
    n = rows.count()
    shells = max(1, min(SHELLS, -(-n // shell)))
    ordered = rows.repartitionByRange(shells, F.desc("norm"), F.length("q"), "vec_id").coalesce(shells).sortWithinPartitions(F.desc("norm"), F.length("q"), "vec_id")
    numbered = ordered.withColumn("shell", F.spark_partition_id())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in _runs(batches, BUCKET):
            run = run.sort_by("vec_id")
            data = [run["vec_id"].to_numpy().tobytes(), run["label"].to_numpy().tobytes(), _matrix(run["q"])]
            yield pa.record_batch([run["shell"].chunk(0)[:1], *map(blob, data), pa.array([pc.max(run["norm"]).as_py()])], ["shell", "ids", "labels", "q", "norm"])

    made = materialize(numbered.mapInArrow(run, "shell int, ids binary, labels binary, q binary, norm double"), "buckets")
    largest = {r[0]: r[1] for r in made.groupBy("shell").agg(F.max("norm")).collect()}  # SHELLS rows at most
    top = [largest.get(i, 0.0) for i in range(max(largest, default=-1) + 1)]
    return made, top


BLOCKS = "block_id long, a_ids binary, a_labels binary, a_q binary, a_norms binary, w_at binary, w_no binary, w_low binary, w_high binary, reach double"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of anchors with their windows; ``reach`` is the least norm that any window still asks for."""
    for run in _runs(batches, BLOCK):
        wins = run["windows"].combine_chunks()
        flat = wins.flatten()
        at = np.repeat(np.arange(len(wins)), wins.value_lengths().to_numpy())
        no, low, high = (flat.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("no", "low", "high"))
        norms = run["norm"].to_numpy()
        reach = np.where(low > 0, low / np.maximum(norms[at], 1e-300), 0.0).min() if len(low) else np.inf
        data = [run["anchor_id"].to_numpy().tobytes(), run["label"].to_numpy().tobytes(), _matrix(run["q"]), norms.tobytes(), at.tobytes(), no.tobytes(), low.tobytes(), high.tobytes()]
        yield pa.record_batch([pa.array([int(run["anchor_id"][0].as_py())]), *map(blob, data), pa.array([float(reach)])], [c.split()[0] for c in BLOCKS.split(", ")])


def _met(same: bool, k: int):
    """Of a block and a bucket: (anchor_id, no, id, score), the k best of each window there."""

    def one(x: dict) -> list[np.ndarray]:
        ints = lambda c: np.frombuffer(x[c], np.int64)
        ids, labels, norms = ints("a_ids"), ints("a_labels"), np.frombuffer(x["a_norms"], float)
        at, no, low, high = ints("w_at"), ints("w_no"), ints("w_low"), ints("w_high")
        own, own_labels = ints("ids"), ints("labels")
        found = [np.zeros(0, np.int64)] * 4
        if not len(own) or len(x["a_q"]) // max(1, len(ids)) != len(x["q"]) // len(own):
            return found  # vectors of other lengths have no product
        open_ = np.flatnonzero((norms[at] * x["norm"]) * (1 + 1e-9) + 1e-9 >= low)
        if not len(open_):
            return found
        rows, place = np.unique(at[open_], return_inverse=True)
        a = np.frombuffer(x["a_q"], "<i4").reshape(len(ids), -1)[rows].astype(float)
        b = np.frombuffer(x["q"], "<i4").reshape(len(own), -1).astype(float)
        scores = (a @ b.T).astype(np.int64)  # exact: below 2 ** 50
        fits = (labels[rows][:, None] == own_labels) == same
        fits &= ids[rows][:, None] != own
        for j in np.unique(no[open_]):
            w = open_[no[open_] == j]
            r = place[no[open_] == j]
            s = scores[r]
            row, col = np.nonzero(fits[r] & (s >= low[w][:, None]) & (s <= high[w][:, None]))
            value = s[row, col]
            order = np.lexsort((own[col], -value, row))
            row, col, value = row[order], col[order], value[order]
            first = np.searchsorted(row, np.arange(len(w)))
            keep = np.arange(len(row)) - first[row] < k
            row, col, value = row[keep], col[keep], value[keep]
            found = [np.concatenate(y) for y in zip(found, (ids[at[w]][row], np.full(len(row), j), own[col], value))]
        return found

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        parts = [one(x) for x in batch.to_pylist()]
        columns = [np.concatenate(c) for c in zip(*parts)]
        return pa.record_batch([pa.array(columns[0]), pa.array(columns[1].astype(np.int32)), *map(pa.array, columns[2:])], ["anchor_id", "no", "id", "score"])

    return run


def _meeting(asking: DataFrame, blocks: int, made: DataFrame, top: list[float], at: int, upto: int) -> DataFrame:
    """Each block of anchors with the buckets of those shells from ``at`` to ``upto`` that are within its reach."""
    order = (F.desc("norm"), F.length("q"), F.col("anchor_id"))
    dealt = asking.repartitionByRange(blocks, *order).coalesce(blocks).sortWithinPartitions(*order)
    norms = F.array(*(F.lit(x * (1 + 1e-9) + 1e-9) for x in top[at:upto]))
    reached = F.filter(F.transform(norms, lambda x, i: F.when(x >= F.col("reach"), i + at)), lambda i: i.isNotNull())
    return dealt.mapInArrow(_blocks, BLOCKS).withColumn("shell", F.explode(reached)).join(made.filter(F.col("shell").between(at, upto - 1)), "shell").drop("shell", "block_id", "reach")


def search(anchors: DataFrame, made: DataFrame, top: list[float], same: bool, k: int) -> DataFrame:
    """(anchor_id, no, id, score, rank): the k best rows of each window, equal scores by id.

    ``anchors`` has anchor_id, label, q, norm and windows, an array of (no, low, high); rows of the
    anchor's label are searched if ``same``, else all others.
    """
    best = Window.partitionBy("anchor_id", "no").orderBy(F.desc("score"), "id")
    found, at, n = None, 0, 1
    blocks = max(1, -(-anchors.count() // BLOCK))
    while at < len(top):
        upto = min(len(top), at + n)
        asking = anchors
        if found is not None:
            # A window that has its k rows asks for more than the last of them, or as much at a lesser id.
            full = found.filter(F.col("rank") == k).groupBy("anchor_id").agg(F.map_from_entries(F.collect_list(F.struct("no", "score"))).alias("last"))
            raised = F.transform("windows", lambda w: F.struct(w["no"].alias("no"), F.greatest(w["low"], F.coalesce(F.try_element_at("last", w["no"]), w["low"])).alias("low"), w["high"].alias("high")))
            asking = anchors.join(full, "anchor_id", "left").withColumn("windows", F.coalesce(F.when(F.col("last").isNotNull(), raised), F.col("windows"))).drop("last")
        new = arrow_map(_meeting(asking, blocks, made, top, at, upto), _met(same, k), "anchor_id long, no int, id long, score long")
        both = new if found is None else new.unionByName(found.drop("rank"))
        before, found = found, materialize(both.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k), "nearest")
        if before is not None:
            release(before)
        at, n = upto, n * GROWTH
    return found


def _percent(score: Column, percent: int) -> Column:
    """floor(percent * score / 100), in whole numbers."""
    x = score * percent
    return F.call_function("div", x - F.pmod(x, F.lit(100)), F.lit(100))


def hard_negatives(vectors: DataFrame, anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, scale: int = SCALE, shell: int = SHELL) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows of ``vectors`` where ``anchor`` is true.

    ``vectors`` has vec_id, label and embedding; of an anchor and each of its ``positives`` nearest rows of
    its label come the ``negatives`` nearest rows of other labels whose score is ``low`` to ``high`` percent
    of the positive's, so none below a negative score.  Scores are products of floor(scale * x), ties go by
    vec_id.  Rows with a null vec_id, label, vector or component, and those with a component that is not
    finite, take no part; of rows that share a vec_id the least label and vector counts, so repeated rows
    count once; vectors of different lengths never meet, empty ones score 0.  ``anchor`` may use vec_id and
    label only.  A norm of 2 ** 25 / scale or more is an error.  Other columns are ignored.
    """
    rows = materialize(quantized(vectors, scale), "vectors")
    again = rows.groupBy("vec_id").count().filter("count > 1").limit(1)
    if not again.isEmpty():
        rows = materialize(rows.groupBy("vec_id").agg(F.min(F.struct("label", "q", "norm")).alias("x")).select("vec_id", "x.*"), "distinct")
    made, top = buckets(rows, shell)
    own = rows.filter(anchor).select(F.col("vec_id").alias("anchor_id"), "label", "q", "norm")
    whole = F.array(F.struct(F.lit(0).alias("no"), F.lit(LEAST).cast("long").alias("low"), F.lit(MOST).cast("long").alias("high")))
    near = search(own.withColumn("windows", whole), made, top, True, positives)
    if near is None:
        near = vectors.sparkSession.createDataFrame([], "anchor_id long, no int, id long, score long, rank int")
    near = near.select("anchor_id", F.col("rank").alias("no"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    limits = near.select("anchor_id", "no", (-_percent(-F.col("positive_score"), low)).alias("low"), _percent(F.col("positive_score"), high).alias("high")).filter("low <= high")
    asking = own.join(limits.groupBy("anchor_id").agg(F.collect_list(F.struct("no", "low", "high")).alias("windows")), "anchor_id")
    found = search(materialize(asking, "asking"), made, top, False, negatives)
    if found is None:
        found = vectors.sparkSession.createDataFrame([], "anchor_id long, no int, id long, score long, rank int")
    return found.withColumnRenamed("id", "negative_id").withColumnRenamed("score", "negative_score").join(near, ["anchor_id", "no"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op12_hard_negatives(spark, sf_dir: str) -> DataFrame:
    small_batches(spark)
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(vectors.withColumn("label", label), F.col("vec_id") % 50 == 0)


ORACLE = """
WITH whole AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_sum(list_transform(range(1, len(a.q) + 1), lambda i: a.q[i] * b.q[i])) AS BIGINT) AS score
  FROM whole a JOIN whole b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
near AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM pairs WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, id AS negative_id, positive_score, score AS negative_score
FROM near JOIN pairs USING (anchor_id)
WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id)
QUALIFY row_number() OVER w <= 3
"""
