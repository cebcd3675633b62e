"""Token counts of flat token files by a separator scan.

A token file is nothing but token ids of one width, documents ended by a separator id, with no index.
Blocks of the files are searched for separators independently, each giving the lengths of the pieces
between them; a prefix scan over the blocks' separator counts numbers the documents, and pieces of
one number are added up, so a document may span any number of blocks.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import materialize, remove, scratch_path, slices, small_batches, text_batches

TOKENIZERS = "/opt/tokenizers"
RANKS = "byte_bpe_50k.tiktoken"
#: Ids of the vocabulary above and the free id after them, which separates documents.
SEPARATOR, WIDTH = 50256, 2
BLOCK = 4 << 20  # bytes of a file searched at a time


def vocabulary(ranks: str) -> tuple[bytes, str]:
    """The file of ranks and the vocabulary's word pattern, read on the driver and sent to the executors."""
    from public_tokenizers import PATTERN

    with open(ranks, "rb") as f:
        return f.read(), PATTERN


def encoder(ranks: bytes, pattern: str):
    """Byte-level BPE from ranks, one token and its rank a line."""
    import tiktoken

    found = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=found, special_tokens={})


def _open(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def write_token_files(docs: DataFrame, path: str, ranks: str = f"{TOKENIZERS}/{RANKS}", separator: int = SEPARATOR) -> DataFrame:
    """Tokenize ``docs`` into one flat file for each partition under ``path``; returns (file, ordinal, doc_id).

    Null texts give no tokens, only a separator.  A file appears under its name once it is whole; every
    attempt of a task has a name of its own, and the table returned, written out by then, names only
    the files of attempts that count, so rows of another order in a repeated task do no harm.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary(ranks))  # one vocabulary file, some 500 kB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        name = f"part-{context.partitionId():06d}-{context.taskAttemptId()}.tokens"
        store, root = _open(path)
        store.create_dir(root, recursive=True)
        draft = f"{root}/_{name}"
        encode, ordinal = encoder(*sent.value).encode_ordinary, 0
        with store.open_output_stream(draft) as out:
            for batch in batches:
                for part in slices(batch):
                    for text in text_batches(part.column(1)):
                        out.write(np.array([*encode(text.decode("utf-8", "replace")), separator], f"<u{WIDTH}").tobytes())
                    rows = part.num_rows
                    yield pa.record_batch([pa.array([name] * rows), pa.array(range(ordinal, ordinal + rows), pa.int64()), part.column(0)], ["file", "ordinal", "doc_id"])
                    ordinal += rows
        if ordinal:
            store.move(draft, f"{root}/{name}")
        else:
            store.delete_file(draft)

    return materialize(docs.select("doc_id", "text").mapInArrow(run, f"file string, ordinal long, doc_id {kind}"), "manifest")


def block_pieces(tokens: np.ndarray, separator: int) -> np.ndarray:
    """Lengths between separators; the first continues what came before, the last is not ended."""
    ends = np.flatnonzero(tokens == separator)
    return np.diff(np.r_[-1, ends, len(tokens)]) - 1


def count_tokens(spark, path: str, separator: int = SEPARATOR, width: int = WIDTH, block: int = BLOCK) -> DataFrame:
    """(file, ordinal, n_tokens) of every document in the ``*.tokens`` files under ``path``.

    Empty documents count 0 tokens; what follows a file's last separator is a document if it has
    tokens; an empty file, or no file, gives no rows.  A file's trailing odd bytes are not a token.
    """
    step = block // width * width
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.tokens").load(path).select("path", "length").filter(F.col("length") >= width)
    blocks = files.select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(step).cast("long"))).alias("at"))
    spread = max(1, min(10_000, int(blocks.count())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p, at in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                store, name = _open(p)
                with store.open_input_file(name) as f:
                    f.seek(at)
                    raw = f.read(step)
                lengths = block_pieces(np.frombuffer(raw, f"<u{width}", len(raw) // width), separator)
                n = len(lengths)
                yield pa.record_batch([pa.array([os.path.basename(name)] * n), pa.array([at] * n, pa.int64()), pa.array(range(n), pa.int64()), pa.array(lengths), pa.array([n - 1] * n, pa.int64())], ["file", "at", "k", "n", "ends"])

    pieces = materialize(blocks.repartition(spread, "path", "at").mapInArrow(run, "file string, at long, k long, n long, ends long"), "pieces")
    # One row for each block of a file: few beside its tokens.
    ends = pieces.filter("k = 0").select("file", "at", F.coalesce(F.sum("ends").over(Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    numbered = pieces.join(ends, ["file", "at"]).select("file", (F.col("before") + F.col("k")).alias("ordinal"), "n", (F.col("k") < F.col("ends")).alias("ended"))
    whole = numbered.groupBy("file", "ordinal").agg(F.sum("n").alias("n_tokens"), F.max("ended").alias("ended"))
    return whole.filter("ended OR n_tokens > 0").select("file", "ordinal", "n_tokens")


def document_tokens(docs: DataFrame, ranks: str = f"{TOKENIZERS}/{RANKS}") -> DataFrame:
    """(doc_id, n_tokens) for each row of ``docs``, through token files in the shared folder."""
    path = scratch_path(docs.sparkSession, "tokens")
    manifest = write_token_files(docs, path, ranks)
    if manifest.isEmpty():
        return manifest.select("doc_id", F.lit(0).cast("long").alias("n_tokens"))
    counts = count_tokens(docs.sparkSession, path)  # from pieces written out, so the token files may go
    remove(docs.sparkSession, path)
    return manifest.join(counts, ["file", "ordinal"]).select("doc_id", "n_tokens")


def op8_token_counts(spark, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return document_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"))
