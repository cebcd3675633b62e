"""Shared plumbing of the training-data operators: scratch tables, skew-safe joins, components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key is hot when it holds more than 1/HOT_PARTS of all rows, so at most HOT_PARTS keys are hot.
HOT_PARTS = 512
#: Bytes of an Arrow batch handed to Python by the registered queries.
BATCH = 16 << 20
#: Rows of a narrow table that a task may write by itself.
TASK_ROWS = 1 << 17


def scratch_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir.

    Where it is unset a local session takes a temporary folder of the machine; a cluster has no folder
    that all its machines share by itself, so there it must be set.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return (base or f"file://{tempfile.gettempdir()}/checkpoints").rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder, deleted when the session's file system closes."""
    path = f"{scratch_dir(spark)}/quire/{uuid.uuid4().hex}-{name}"
    _files(spark, path).deleteOnExit(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path))
    return path


def _files(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def remove(spark: SparkSession, path: str) -> None:
    _files(spark, path).delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path), True)


def materialize(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts lineage, survives lost executors.

    Where ``df`` and what it is made from are known to have at most about ``rows`` rows, each task
    writes TASK_ROWS of them, so that small tables take few tasks however many shuffle partitions there are.
    """
    spark = df.sparkSession
    if rows is not None:
        df = df.coalesce(1 + rows // TASK_ROWS)
    path = scratch_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def release(*written: DataFrame) -> None:
    """Delete tables ``materialize`` wrote that no later step reads."""
    for df in written:
        remove(df.sparkSession, df._scratch)


def skew_join(left: DataFrame, right: DataFrame, keys: list[str], weight: str, total: int) -> DataFrame:
    """Inner equi-join where ``right`` has one row per key and ``weight`` counts the key's left rows.

    Keys with more than ``total / HOT_PARTS`` rows are joined by broadcasting their right rows
    (there are at most HOT_PARTS of them, whatever the data); all other keys are shuffled.
    """
    hot = F.col(weight) * HOT_PARTS > F.lit(total)
    heavy = right.filter(hot)
    few = F.broadcast(heavy)
    cold = left.join(F.broadcast(heavy.select(*keys)), keys, "left_anti")
    return left.join(few, keys).unionByName(cold.join(right.filter(~hot), keys))


def text_batches(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """The UTF-8 bytes of each text of an Arrow column, null as empty, without decoding."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def arrow_map(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """mapInArrow over one batch at a time, in slices of bounded text so that memory stays bounded.

    Spark's batches are bounded by rows and, through spark.sql.execution.arrow.maxBytesPerBatch, bytes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                out = fn(part)
                if out is not None:
                    yield out

    return df.mapInArrow(run, schema)


def slices(batch: pa.RecordBatch, max_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows of about ``max_bytes`` each; a longer row stands alone."""
    rows = batch.num_rows
    if not rows:
        return
    step = max(1, min(rows, int(max_bytes * rows / max(1, batch.nbytes))))
    start = 0
    while start < rows:
        part = batch.slice(start, step)
        while part.num_rows > 1 and part.nbytes > 4 * max_bytes:
            part = part.slice(0, max(1, part.num_rows // 4))
        yield part
        start += part.num_rows


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an undirected edge list of longs: (node, root), root the smallest node.

    Alternates large-star and small-star steps until the edge set no longer changes; each step is a
    grouped minimum (combined on the map side) and a skew-safe join, so hubs are never gathered.
    Nodes without an edge do not appear.
    """
    spark = edges.sparkSession
    e = materialize(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct(), "edges"
    )
    before = None
    while True:
        seen = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == before or not seen[0]:
            break
        before, ends = seen, 2 * seen[0]
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialize(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"), F.count("*").alias("deg")), "large", ends)
        large = skew_join(both, least, ["u"], "deg", ends).filter("v > u")
        e1 = materialize(large.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large-star", ends)
        release(least, e)
        least = materialize(e1.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("deg")), "small", ends)
        small = skew_join(e1, least, ["u"], "deg", e1.count()).filter("v <> m")
        e = materialize(
            small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct(),
            "small-star",
            ends,
        )
        release(least, e1)
    roots = e.groupBy("u").agg(F.min("v").alias("root"))
    return roots.select(F.col("u").alias("node"), "root").unionByName(
        roots.select(F.col("root").alias("node"), "root").distinct()
    )


def small_batches(spark: SparkSession) -> None:
    """Cut the session's Arrow batches to BATCH bytes if they may be larger; the registered queries ask for it, operators do not."""
    size = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(size).rstrip("b")
    if not (now.isdigit() and int(now) <= BATCH):
        spark.conf.set(size, f"{BATCH}b")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
