"""Session builder and table access."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def session(master: str | None = None, shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution and UTC; cluster sizing stays with the caller."""
    builder = SparkSession.builder.appName("quire").config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in conf.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, size: int = 16 << 20) -> None:
    """Cut the session's Arrow batches to ``size`` bytes if they may be larger, so that ten thousand long texts are never held in Python at once."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name).rstrip("b")
    if not (now.isdigit() and int(now) <= size):
        spark.conf.set(name, f"{size}b")


@dataclass(frozen=True)
class Scope:
    """Rows a caller may see: tenant, then vendor, then owner.  None leaves a level open, an empty set closes it."""

    tenant: str | None = None
    vendors: frozenset[int] | None = None
    owners: frozenset[int] | None = None

    def apply(self, df: DataFrame, tenant: str = "tenant_id", vendor: str = "vendor_id", owner: str = "owner_id") -> DataFrame:
        for values, column in ((None if self.tenant is None else {self.tenant}, tenant), (self.vendors, vendor), (self.owners, owner)):
            if values is not None:
                df = df.filter(F.col(column).isin(*sorted(values))) if values else df.limit(0)
        return df


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder all executors share."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{(base or 'file:///tmp/checkpoints').rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and written to the checkpoint folder all executors share: its lineage ends there.

    The folder is spark.checkpoint.dir; where the session sets none, a single machine takes one of its own.
    """
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        base = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not base and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(base or "/tmp/checkpoints")
    return df.checkpoint()


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet to the folder all executors share, and read from there; unlike ``cut`` it is computed once."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
