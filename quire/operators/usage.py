"""Metering and limits over event logs: fixed windows, aligned counters, roll-ups and retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def rate_limit(events: DataFrame, keys: list[str], ts: str, limit: int, window_seconds: int, order: str = "event_id") -> DataFrame:
    """(keys, order, n, rejected): n counts a key's events since its window opened.

    A window opens with the first event after the last one closed, so a key's events are walked in time
    order: partitions are sorted by key and time and streamed, holding one key's window at a time.
    """
    t = F.unix_micros(F.col(ts).cast("timestamp"))
    slim = events.select(*keys, F.col(order), t.alias("_t")).repartition(*keys).sortWithinPartitions(*keys, "_t", order)
    kinds = dict(events.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in (*keys, order)) + ", n long, rejected boolean"
    width = window_seconds * 1_000_000

    def walk(frames):
        key, start, n = None, 0, 0
        for pdf in frames:
            counts = []
            for row in zip(*(pdf[k] for k in keys), pdf["_t"]):
                if row[:-1] != key or row[-1] >= start + width:
                    key, start, n = row[:-1], row[-1], 0
                n += 1
                counts.append(n)
            out = pdf[[*keys, order]].copy()
            out["n"] = counts
            out["rejected"] = out["n"] > limit
            yield out

    return slim.mapInPandas(walk, schema)


def running_count(events: DataFrame, keys: list[str], unit: str, ts: str, order: str) -> DataFrame:
    """Counter of each key that starts again with every aligned ``unit`` (hour, day, minute)."""
    w = Window.partitionBy(*keys, F.date_trunc(unit, ts)).orderBy(ts, order)
    return events.withColumn("n", F.row_number().over(w))


def cost(tokens_in: Column, tokens_out: Column, price_in: Column, price_out: Column, blended: Column) -> Column:
    """Price per million tokens by direction, or the blended price where a direction has none."""
    split = (tokens_in * price_in + tokens_out * price_out) / 1e6
    return F.coalesce(split, blended * (tokens_in + tokens_out) / 1e6)


def rollup(events: DataFrame, day: Column, label: str, user: str, value: str) -> DataFrame:
    """Calls and value by (day, label) over all users (user null) and by (day, label, user), in one pass."""
    base = events.select(day.alias("day"), F.col(label).alias("label"), F.col(user).alias("user"), F.col(value).alias("value"))
    return base.groupingSets([["day", "label"], ["day", "label", "user"]], "day", "label", "user").agg(F.count("*").alias("calls"), F.sum("value").alias("total"))


def trailing(events: DataFrame, ts: str, days: int) -> DataFrame:
    """Events of the last ``days`` days up to the latest event."""
    latest = events.agg(F.max(ts).alias("latest"))
    return events.join(F.broadcast(latest)).filter(F.col(ts) >= F.col("latest") - F.expr(f"INTERVAL {days} DAYS")).drop("latest")
