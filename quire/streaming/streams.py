"""Streams over files and events.

The batch forms of the limits are in ``operators.usage``; these run continuously.  Event-time windows
with watermarks are additions of this library.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def file_stream(spark: SparkSession, path: str, schema: str, fmt: str = "parquet", files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).format(fmt).load(path)


def ingest(docs: DataFrame, work: Callable[[DataFrame], DataFrame], out: str, failed: str, checkpoint: str, tries: int = 3) -> StreamingQuery:
    """Run ``work`` on each batch and write its rows by batch, so that a repeated batch replaces itself.

    A batch that fails ``tries`` times goes to ``failed`` with the reason instead of stopping the stream.
    """

    def each(batch: DataFrame, number: int) -> None:
        for attempt in range(1, tries + 1):
            try:
                work(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")
                return
            except Exception as e:  # the batch is kept with its reason
                if attempt == tries:
                    batch.withColumn("reason", F.lit(str(e)[:500])).write.mode("overwrite").parquet(f"{failed}/batch={number}")

    return docs.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def tumbling(events: DataFrame, ts: str, width: str, keys: list[str], late: str = "10 minutes") -> DataFrame:
    """Counts by event-time window and key; events later than ``late`` are dropped."""
    timed = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return timed.groupBy(F.window(ts, width), *keys).agg(F.count("*").alias("n")).select("window.start", "window.end", *keys, "n")


def sliding(events: DataFrame, ts: str, width: str, step: str, keys: list[str], late: str = "10 minutes") -> DataFrame:
    timed = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return timed.groupBy(F.window(ts, width, step), *keys).agg(F.count("*").alias("n")).select("window.start", "window.end", *keys, "n")


def sessions(events: DataFrame, ts: str, gap: str, keys: list[str], late: str = "10 minutes") -> DataFrame:
    timed = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return timed.groupBy(F.session_window(ts, gap), *keys).agg(F.count("*").alias("n")).select("session_window.start", "session_window.end", *keys, "n")


def once(events: DataFrame, ts: str, keys: list[str], late: str = "10 minutes") -> DataFrame:
    """Events without repeats of a key within the watermark."""
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def rate_limit(events: DataFrame, key: str, ts: str, limit: int, window_seconds: int, order: str = "event_id") -> DataFrame:
    """(key, order, n, rejected) with windows that open at a key's first event; state is one window a key."""
    kinds = dict(events.dtypes)
    micros = events.select(key, order, F.unix_micros(F.col(ts).cast("timestamp")).alias("t"))
    width = window_seconds * 1_000_000

    def walk(k: tuple, frames: Iterator, state: GroupState) -> Iterator:
        import pandas as pd

        start, n = state.get if state.exists else (0, 0)
        rows = pd.concat(list(frames)).sort_values(["t", order])
        counts = []
        for t in rows["t"]:
            if n == 0 or t >= start + width:
                start, n = t, 0
            n += 1
            counts.append(n)
        state.update((int(start), int(n)))
        yield pd.DataFrame({key: k[0], order: rows[order].to_numpy(), "n": counts, "rejected": [c > limit for c in counts]})

    schema = f"{key} {kinds[key]}, {order} {kinds[order]}, n long, rejected boolean"
    return micros.groupBy(key).applyInPandasWithState(walk, schema, "start long, n long", "append", GroupStateTimeout.NoTimeout)
