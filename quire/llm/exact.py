"""Exact dedup with composable polynomial fingerprints.

The fingerprint of a byte string b of length n is sum(b[i] * base**(n-1-i)) modulo a prime, for two
primes.  Fingerprints of neighbouring chunks combine: F(x + y) = F(x) * base**len(y) + F(y), so a huge
text is hashed chunk by chunk.  Texts of equal fingerprints and lengths are then compared with their
group's kept text chunk by chunk; texts that prove different form groups of their own.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import arrow_map, materialize, release, skew_join, small_batches, text_batches

PRIMES, BASES = (2147483647, 2147483629), (1000003, 998244353)
CHUNK = 1 << 13  # byte * power sums stay below 2**53, exact in doubles
COMPARE = 1 << 16  # bytes compared at a time
SPREAD = 256  # members of a group that share one copy of the kept text
ROW = ("row_a", "row_b")  # hashes by which a row is known


def _powers(base: int, prime: int, n: int) -> np.ndarray:
    out = [1]
    for _ in range(n - 1):
        out.append(out[-1] * base % prime)
    return np.array(out[::-1], np.float64)


def combine(left: int, right: int, right_len: int, base: int, prime: int) -> int:
    """The fingerprint of x + y from those of x and y."""
    return (left * pow(base, right_len, prime) + right) % prime


def chunk_prints(data: bytes, powers: np.ndarray, prime: int) -> list[tuple[int, int]]:
    """(fingerprint, length) of each chunk of ``data``, computed independently of each other."""
    chunk = powers.shape[0]
    raw = np.frombuffer(data, np.uint8).astype(np.float64)
    full = len(raw) // chunk
    out = [(int(x) % prime, chunk) for x in raw[: full * chunk].reshape(full, chunk) @ powers] if full else []
    rest = raw[full * chunk :]
    return out + ([(int(rest @ powers[chunk - len(rest) :]) % prime, len(rest))] if len(rest) else [])


def polynomial(data: bytes, primes=PRIMES, bases=BASES, chunk: int = CHUNK, powers=None) -> list[int]:
    """The fingerprint of ``data`` for each prime, combined from its chunks'."""
    powers = powers or [_powers(b, p, chunk) for b, p in zip(bases, primes)]
    found = []
    for base, prime, pw in zip(bases, primes, powers):
        h = 0
        for i in range(0, len(data), chunk << 7):  # doubles of 1 MB of text at a time
            for part, n in chunk_prints(data[i : i + (chunk << 7)], pw, prime):
                h = combine(h, part, n, base, prime)
        found.append(h)
    return found


def _prints(primes, bases, chunk):
    powers = [_powers(b, p, chunk) for b, p in zip(bases, primes)]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = text_batches(batch.column(1))
        prints = np.array([polynomial(t, primes, bases, chunk, powers) for t in texts], np.int64).reshape(-1, 2)
        return pa.record_batch(
            [batch.column(0), *batch.columns[2:], pa.array(prints[:, 0]), pa.array(prints[:, 1]), pa.array([len(t) for t in texts], pa.int64()), pa.array([hashlib.sha256(t).hexdigest() for t in texts])],
            ["doc_id", *ROW, "h1", "h2", "n_bytes", "text_sha256"],
        )

    return run


def exact_duplicates(docs: DataFrame, primes=PRIMES, bases=BASES, chunk: int = CHUNK) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Null texts equal empty ones.  The largest doc_id of equal texts stays (nulls are smaller than any
    id); rows repeated with that very id are the same document and all show kept.  Columns other
    than doc_id and text are ignored.  Fingerprints that collide decide nothing: every row but the one
    its group is compared with, null and repeated ids included, is held against that row's text, and
    rows that differ form groups of their own.  A row is known by 128 bits of hash over id and text.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    source = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    source = source.withColumns({name: F.xxhash64(F.lit(i), F.col("doc_id").isNull(), "doc_id", "text") for i, name in enumerate(ROW)})
    rows = materialize(
        arrow_map(source, _prints(primes, bases, chunk), f"doc_id {kind}, {', '.join(f'{c} long' for c in ROW)}, h1 long, h2 long, n_bytes long, text_sha256 string"),
        "prints",
    )
    key = ["h1", "h2", "n_bytes"]
    total = rows.count()
    groups = materialize(_groups(rows, key), "groups")
    grouped = skew_join(rows, groups, key, "group_size", total)
    done = grouped.filter("group_size = 1")
    open_ = materialize(grouped.filter("group_size > 1").withColumn("differs", F.lit(0)), "copies")
    key.append("differs")
    texts = source.drop("doc_id").join(open_.select(*ROW).distinct().hint("merge"), [*ROW], "left_semi").distinct()
    pieces = texts.select(*ROW, F.encode("text", "UTF-8").alias("raw"))
    pieces = pieces.select(*ROW, "raw", F.explode(F.sequence(F.lit(0), (F.greatest(F.octet_length("raw"), F.lit(1)) - 1).cast("int"), F.lit(COMPARE))).alias("at"))
    pieces = materialize(pieces.select(*ROW, "at", F.expr(f"substring(raw, at + 1, {COMPARE})").alias("piece")), "pieces")
    while True:
        salts = F.ceil(F.col("group_size") / SPREAD).cast("int")
        other = (F.col(ROW[0]) != F.col("head")[ROW[0]]) | (F.col(ROW[1]) != F.col("head")[ROW[1]])
        mine = open_.filter(other).select(*key, *ROW, F.pmod(F.col(ROW[0]), salts).cast("int").alias("salt")).distinct().join(pieces, [*ROW])
        heads = open_.select(*key, "head.*", "group_size").drop("doc_id").distinct()
        theirs = heads.join(pieces, [*ROW]).select(*key, "at", F.col("piece").alias("kept_piece"), F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
        wrong = materialize(mine.join(theirs, [*key, "salt", "at"]).filter("piece <> kept_piece").select(*key, *ROW).distinct(), "different")
        if wrong.isEmpty():
            break
        split = open_.join(wrong.withColumn("moved", F.lit(1)), [*key, *ROW], "left")
        split = split.withColumn("differs", F.col("differs") + F.coalesce("moved", F.lit(0))).drop("moved", "head", "keep_id", "group_size")
        split = materialize(split, "split")
        before, open_ = open_, materialize(skew_join(split, _groups(split, key), key, "group_size", split.count()), "copies")
        release(before, split, wrong)
    release(pieces)
    cols = ["doc_id", "keep_id", "group_size", F.coalesce(F.col("doc_id").eqNullSafe(F.col("keep_id")), F.lit(False)).alias("kept"), "text_sha256"]
    return done.select(*cols).unionByName(open_.select(*cols))


def _groups(rows: DataFrame, key: list[str]) -> DataFrame:
    """Size of each group, its largest doc_id, and the row of that id all others are compared with."""
    head = F.max(F.struct("doc_id", *ROW))  # a null id is the least
    return rows.groupBy(*key).agg(head.alias("head"), F.count("*").alias("group_size")).withColumn("keep_id", F.col("head.doc_id"))


def op10_exact_duplicates(spark, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return exact_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
