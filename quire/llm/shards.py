"""Documents in shards: rows of a bounded size that hold many documents, packed for numpy.

What an operator learns about words or tokens of the whole corpus is counted once a shard before it is
shuffled, and comes back once a shard.  A shard is about so many bytes of text; a longer text stands alone.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from ._common import materialize, slices


def give_back() -> None:
    """Freed memory goes back to the system between shards, as a worker lives through many tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def pack(values: np.ndarray) -> bytes:
    """Unsigned values in as many bytes as the largest needs, all lowest bytes first, which compresses well."""
    raw = np.ascontiguousarray(values, "<u8").view(np.uint8).reshape(-1, 8)
    used = np.flatnonzero(raw.any(0))
    width = int(used[-1]) + 1 if len(used) else 1
    return bytes([width]) + raw[:, :width].T.tobytes()


def unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8, offset=1).reshape(data[0], -1)
    raw = np.zeros((planes.shape[1], 8), np.uint8)
    raw[:, : data[0]] = planes.T
    return raw.view("<u8")[:, 0].copy()


def pack_sorted(values: np.ndarray, start: int = 0) -> bytes:
    """Ascending unsigned values from ``start`` on, by their differences."""
    return pack(np.diff(values.astype(np.uint64), prepend=np.uint64(start)))


def unpack_sorted(data: bytes, start: int = 0) -> np.ndarray:
    return np.cumsum(unpack(data), dtype=np.uint64) + np.uint64(start)


def gathered(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.Table]:
    """The rows of a task in tables of about ``size`` bytes."""
    held, n = [], 0
    for batch in batches:
        for part in slices(batch):
            held.append(part)
            n += part.nbytes
            if n >= size:
                yield pa.Table.from_batches(held)
                held, n = [], 0
    if held:
        yield pa.Table.from_batches(held)


def sharded(docs: DataFrame, fn: Callable[[pa.Table], dict[str, pa.Array]], schema: str, name: str, size: int) -> DataFrame:
    """One row for each shard of ``docs``, written out: its number and what ``fn`` makes of its rows.

    Numbers follow tasks; as the table is written once and read again, they hold whatever is repeated.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 24
        for i, rows in enumerate(gathered(batches, size)):
            found = fn(rows)
            yield pa.record_batch([pa.array([first + i]), *found.values()], ["shard", *found])
            del rows, found
            give_back()

    return materialize(docs.mapInArrow(run, f"shard long, {schema}"), name)


def by_shard(shards: DataFrame, fn: Callable[[dict], pa.RecordBatch | None], schema: str) -> DataFrame:
    """``fn`` of each shard by itself, its columns by name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                out = fn({c: batch.column(i)[k] for i, c in enumerate(batch.schema.names)})
                if out is not None:
                    yield out
                del out
                give_back()

    return shards.mapInArrow(run, schema)


def one_list(column: pa.ChunkedArray | pa.Array) -> pa.Array:
    """A list array of one row that holds the whole column."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), flat)


def blob(data: bytes) -> pa.Array:
    return pa.array([data], pa.binary())


def dealt(hashes: np.ndarray, counts: np.ndarray, bits: int, width: int = 64) -> Iterator[tuple[int, bytes, bytes]]:
    """(part, hashes, counts) of each of the 2 ** bits parts of the hash range that ascending hashes of ``width`` bits fall to."""
    cuts = np.searchsorted(hashes >> np.uint64(width - bits), np.arange((1 << bits) + 1, dtype=np.uint64))
    for p in np.flatnonzero(np.diff(cuts)).tolist():
        yield p, pack_sorted(hashes[cuts[p] : cuts[p + 1]], p << (width - bits)), pack(counts[cuts[p] : cuts[p + 1]])


ASKED = "part long, shard long, kind int, hashes binary, counts binary"
TOLD = "shard long, kind int, part long, counts binary, known long, once long, numbers array<long>, sizes array<long>"


def asked_rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = [*zip(*rows)] or [()] * 5
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary())
    return pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds)], ["part", "shard", "kind", "hashes", "counts"])


def told(asked: DataFrame, bits: int, width: int = 64) -> DataFrame:
    """The sums of the counts that all shards give for a hash, to each shard in the order it asked.

    ``asked`` has a row for each shard, kind and part, so a hash that all texts hold is there once a shard.
    In one row of each part and kind stand, of the hashes with a sum above 0, how many there are, how many
    sum up to 1, and by power of two their number and sum.
    """

    def run(table: pa.Table) -> pa.Table:
        part, out = table["part"][0].as_py(), []
        kinds = table["kind"].to_numpy()
        for k in np.unique(kinds).tolist():
            rows = table.filter(pa.array(kinds == k))
            held = [unpack_sorted(h, part << (width - bits)) for h in rows["hashes"].to_pylist()]
            sizes = [len(h) for h in held]
            flat = np.concatenate(held)
            order = np.argsort(flat, kind="stable")
            new = np.concatenate([[True], np.diff(flat[order]) > 0])
            total = np.add.reduceat(np.concatenate([unpack(n) for n in rows["counts"].to_pylist()])[order].astype(np.int64), np.flatnonzero(new))
            back = np.empty(len(flat), np.int64)
            back[order] = total[np.cumsum(new) - 1]
            known = total[total > 0]
            size = np.log2(known).astype(int)
            stats = (len(known), int((known == 1).sum()), np.bincount(size, minlength=64).tolist(), np.bincount(size, known, 64).astype(np.int64).tolist())
            for i, (shard, counts) in enumerate(zip(rows["shard"].to_pylist(), np.split(back, np.cumsum(sizes)[:-1]))):
                out.append((shard, k, part, pack(counts), *(stats if i == 0 else (None,) * 4)))
        types = (pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()))
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out), types)], names=["shard", "kind", "part", "counts", "known", "once", "numbers", "sizes"])

    return asked.groupBy("part").applyInArrow(run, TOLD)
