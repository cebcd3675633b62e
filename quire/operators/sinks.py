"""Writers that may run again: a document's chunks take the place of those written before."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut

BUCKETS = 64


def _files(df: DataFrame, path: str):
    context = df.sparkSession.sparkContext
    hadoop = context._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(context._jsc.hadoopConfiguration()), hadoop


def content(chunks: DataFrame) -> DataFrame:
    """(doc, print): one hash of all of a document's chunks."""
    row = F.struct(*(c for c in sorted(chunks.columns) if c not in ("doc", "bucket")))
    return chunks.groupBy("doc").agg(F.xxhash64(F.array_sort(F.collect_list(F.xxhash64(row)))).alias("print"))


def write_chunks(docs: DataFrame, chunks: DataFrame, path: str, buckets: int = BUCKETS) -> int:
    """Replaces the chunks of the documents ``docs`` (doc) at ``path`` by ``chunks`` (doc, idx and more); returns the number of buckets written.

    Documents are dealt to ``buckets`` folders by hash.  Only folders that hold a document whose chunks have changed
    are written again, with the chunks of their other documents as they are, so a second run of the same input leaves
    every file in place.  A document without chunks loses those it had.
    """
    spark = docs.sparkSession
    bucket = F.pmod(F.xxhash64("doc"), F.lit(buckets)).cast("int")
    asked = docs.select("doc").distinct()
    new = chunks.join(asked, "doc", "left_semi")
    files, root = _files(docs, path)
    if not files.exists(root):
        new.withColumn("bucket", bucket).repartition(buckets, "bucket").write.partitionBy("bucket").parquet(path)
        return new.select(bucket.alias("b")).distinct().count()
    old = spark.read.schema(f"{', '.join(f'`{c}` {t}' for c, t in chunks.dtypes)}, bucket int").parquet(path)
    held = old.join(asked, "doc", "left_semi")
    changed = content(new).withColumnRenamed("print", "now").join(content(held).withColumnRenamed("print", "was"), "doc", "full").filter(~F.col("now").eqNullSafe(F.col("was"))).select("doc")
    changed = cut(changed)
    touched = {r[0] for r in changed.select(bucket.alias("b")).distinct().collect()}  # ``buckets`` rows at most
    if not touched:
        return 0
    hit = F.col("bucket").isin(*touched)
    kept = old.filter(hit).join(changed, "doc", "left_anti")
    fresh = new.join(changed, "doc", "left_semi").withColumn("bucket", bucket)
    rows = cut(kept.unionByName(fresh))  # what is read must not be what is overwritten
    rows.repartition(buckets, "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    left = {r[0] for r in rows.select("bucket").distinct().collect()}
    for b in touched - left:
        files.delete(_files(docs, f"{path}/bucket={b}")[1], True)
    return len(touched)
