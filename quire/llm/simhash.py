"""SimHash near-duplicates with pigeonring filtering.

Fingerprints are cut into an odd number of segments on a ring.  If two fingerprints differ in at most
``limit`` bits, some segment starts a chain whose cumulative differences never exceed the
proportional budget ``floor(l * limit / segments)`` for every chain length l.  The first budgets are
0, so that chain's head is an equality key to join on; the later ones prune before the full check.
A bucket with more than ``bucket`` fingerprints is not paired up: its chain grows by the next segment,
which may differ in one bit, so its members meet under a longer key that each takes in all its one-bit
forms.  What is crowded even there lies within a few bits, and meets through the 65 values within one
bit of each member, which finds every pair within two bits in linear space.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import arrow_map, components, materialize, release, skew_join, small_batches, text_batches

SEGMENTS, LIMIT, BUCKET = 7, 2, 64


def simhash(text: bytes, shingle: int = 3) -> int:
    """Signed 64-bit SimHash of one text; the brute-force form of ``_fingerprints``."""
    words = text.lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    bits = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    return bits - (1 << 64) if bits >> 63 else bits


def _fingerprints(shingle: int):
    block = 1 << 16  # shingles held as bits at a time

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        digest = xxhash.xxh64_digest
        out = np.zeros(batch.num_rows, np.uint64)
        for k, text in enumerate(text_batches(batch.column(1))):
            words = text.lower().split()
            n = len(words)
            if not n:
                continue
            if n <= shingle:
                grams = [b" ".join(words)]
            else:
                grams = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
            raw = np.frombuffer(b"".join([digest(g, 42) for g in grams]), np.uint8).reshape(-1, 8)
            count = sum(np.unpackbits(raw[i : i + block], axis=1).sum(0, dtype=np.int64) for i in range(0, len(raw), block))
            out[k] = np.packbits(2 * count > len(raw)).view(">u8")[0]
        return pa.record_batch([batch.column(0), pa.array(out.view(np.int64))], ["doc_id", "fp"])

    return run


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp) for each row; a text without words has fingerprint 0."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return arrow_map(docs.select("doc_id", "text"), _fingerprints(shingle), f"doc_id {kind}, fp long")


def _signed(x: int) -> int:
    x &= (1 << 64) - 1
    return x - (1 << 64) if x >> 63 else x


def ring_masks(segments: int) -> list[int]:
    """The bits of each segment, as unsigned masks; lengths differ by one at most."""
    cuts = [64 * i // segments for i in range(segments + 1)]
    return [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:])]


def links(fps: DataFrame, limit: int = LIMIT, segments: int = SEGMENTS, bucket: int = BUCKET) -> DataFrame:
    """All pairs (a, b) that connect distinct fingerprints at ``limit`` bits or fewer.

    ``fps`` has one row per fingerprint in column ``fp``.  Pairs within buckets of up to ``bucket``
    members are complete, in longer keys as in shorter; beyond both, members link to the least member
    around each value one bit away, which leaves the same components; that step is exact at 2 bits, the
    only ``limit`` taken.
    """
    if limit != 2:
        raise ValueError("fingerprints link at 2 bits or fewer")
    masks = ring_masks(segments)
    budget = [length * limit // segments for length in range(segments + 1)]
    head = sum(1 for x in budget[1:] if x == 0)
    chain = lambda i, n: sum(masks[(i + j) % segments] for j in range(n))
    bits = lambda mask: [_signed(1 << b) for b in range(64) if mask >> b & 1]
    differ = F.col("a").bitwiseXOR(F.col("b"))
    within = F.lit(False)
    for i in range(segments):
        ok = F.lit(True)
        for n in range(head + 1, segments):
            if budget[n] < budget[n + 1] or n == segments - 1:
                ok = ok & (F.bit_count(differ.bitwiseAND(F.lit(_signed(chain(i, n))))) <= budget[n])
        within = within | ((F.col("i") == i) & ok)
    checked = lambda pairs: pairs.filter(within).filter(F.bit_count(differ) <= limit).select("a", "b")

    def sized(keyed: DataFrame, name: str) -> DataFrame:
        sizes = materialize(keyed.groupBy("i", "key").agg(F.count("*").alias("n"), F.count_if("own").alias("owners")).filter("n > 1 AND owners > 0"), f"{name}-buckets")
        met = materialize(skew_join(keyed, sizes, ["i", "key"], "n", keyed.count()), name)
        release(sizes)
        return met

    heads = [F.struct(F.lit(i).alias("i"), F.col("fp").bitwiseAND(F.lit(_signed(chain(i, head)))).alias("key")) for i in range(segments)]
    met = sized(fps.select("fp", F.explode(F.array(*heads)).alias("k")).select("fp", "k.i", "k.key", F.lit(True).alias("own")), "met")
    groups = met.filter(F.col("n") <= bucket).groupBy("i", "key").agg(F.collect_list("fp").alias("m"))
    pairs = checked(groups.select("i", "m", F.explode("m").alias("a")).select("i", "a", F.explode("m").alias("b")).filter("a < b"))
    crowd = met.filter(F.col("n") > bucket).select("i", "fp")
    if crowd.isEmpty():
        return pairs

    # The key of the next length: own fingerprints as they are, guests with one bit of the last segment turned.
    turned = [F.when(F.col("i") == i, F.array(F.lit(0).cast("long"), *map(F.lit, bits(masks[(i + head) % segments])))) for i in range(segments)]
    mask = F.coalesce(*(F.when(F.col("i") == i, F.lit(_signed(chain(i, head + 1)))) for i in range(segments)))
    longer = crowd.select("i", "fp", F.explode(F.coalesce(*turned)).alias("x"))
    longer = sized(longer.select("i", "fp", F.col("fp").bitwiseXOR(F.col("x")).bitwiseAND(mask).alias("key"), (F.col("x") == 0).alias("own")), "longer")
    few = longer.filter(F.col("n") <= bucket).groupBy("i", "key").agg(F.collect_list(F.when(F.col("own"), F.col("fp"))).alias("o"), F.collect_list("fp").alias("m"))
    more = checked(few.select("i", "m", F.explode("o").alias("a")).select("i", "a", F.explode("m").alias("b")).filter("a <> b"))
    pairs = pairs.unionByName(more.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))

    dense = longer.filter(F.col("n") > bucket).select("fp").distinct()
    near = [F.col("fp")] + [F.col("fp").bitwiseXOR(F.lit(_signed(1 << b))) for b in range(64)]
    around = dense.select("fp", F.explode(F.array(*near)).alias("z")).groupBy("z").agg(F.collect_set("fp").alias("m"))  # 65 at most
    star = around.filter(F.size("m") > 1).select(F.array_min("m").alias("a"), F.explode("m").alias("b")).filter("a < b").distinct()
    return pairs.unionByName(star)


def near_duplicates(docs: DataFrame, shingle: int = 3, limit: int = LIMIT, segments: int = SEGMENTS, bucket: int = BUCKET) -> DataFrame:
    """(doc_id, fp, component_id) for each row of ``docs``; component_id is the least doc_id reachable.

    Null and blank texts have fingerprint 0 and link like any other.  Repeated rows come out as often
    as they come in; a null doc_id never names a component unless its component has no other id.
    """
    slim = materialize(fingerprints(docs, shingle), "fingerprints")
    fps = materialize(slim.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("rows")), "distinct")
    return named(slim, fps, links(fps, limit, segments, bucket))


def named(slim: DataFrame, fps: DataFrame, pairs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id) for each row of ``slim``, from the distinct ``fps`` and the ``pairs`` that link them."""
    root = materialize(components(pairs), "components")
    # One label per fingerprint: its component's least doc_id, or its own where nothing links.
    member = fps.join(root, fps["fp"] == root["node"]).select("fp", "first_id", "root")
    member = materialize(member, "members")
    label = member.groupBy("root").agg(F.min("first_id").alias("component_id"), F.count("*").alias("n"))
    joined = skew_join(member, label, ["root"], "n", member.count()).select("fp", "component_id")
    named = materialize(fps.join(joined, "fp", "left").select("fp", "rows", F.coalesce("component_id", "first_id").alias("component_id")), "labels")
    return skew_join(slim, named, ["fp"], "rows", slim.count()).select("doc_id", "fp", "component_id")


def op9_simhash_near_duplicates(spark, sf_dir: str) -> DataFrame:
    small_batches(spark)
    out = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
