"""Alignment of two tokenizers' tokens over the same bytes.

A's and B's tokens are the nodes of a bipartite graph, and tokens whose byte ranges overlap are linked.
Its connected components, found by union-find, are the minimal groups: runs of A tokens and of B tokens
that cover the same bytes and can't be cut further.  The links of each component are then counted by pair of
token ids over the whole corpus.

A text is cut at every single space between two characters that are no white space.  Both tokenizers
end a token there, whatever stands around it (A's pattern takes a space only as the first of a token;
none of B's pieces holds a space behind another character, which is checked as the model is read), so
pieces are encoded and aligned once, however often they stand in a corpus.  A text one of whose pieces
doesn't give its own bytes back is encoded as a whole.
"""

from __future__ import annotations

import hashlib
import os
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import arrow_map, materialize, release, small_batches
from .shards import blob, by_shard, one_list, pack, pack_sorted, sharded, unpack, unpack_sorted

TOKENIZERS = "/opt/tokenizers"
A, B = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Pieces kept aligned by a worker; when there are more, it starts anew.
KEPT = 300_000
#: Bytes of text in a shard.
SHARD = 8 << 20
CUT = re.compile(r"(?<=\S) (?=\S)")


def byte_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones are themselves."""
    same = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in same]
    return {chr(b): b for b in same} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteLevel:
    """Tokenizer A: byte-level BPE of the tokenizers library."""

    def __init__(self, data: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_buffer(data)
        self.tokenizer.encode_special_tokens = True
        byte = byte_alphabet()
        vocab = self.tokenizer.get_vocab()
        self.bytes = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.bytes[i] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()

    def encode(self, texts: list[str]) -> list[list[int]]:
        # What the library holds of a text is many times its ids, so few are held at a time.
        few = (texts[i : i + 2048] for i in range(0, len(texts), 2048))
        return [e.ids for part in few for e in self.tokenizer.encode_batch_fast(part, add_special_tokens=False)]


class Pieces:
    """Tokenizer B: a sentencepiece model, which puts a space before each text by itself."""

    def __init__(self, data: bytes):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_proto=data)
        self.bytes = []
        for i in range(self.model.get_piece_size()):
            piece = self.model.id_to_piece(i)
            self.bytes.append(bytes([int(piece[3:5], 16)]) if self.model.is_byte(i) else piece.replace("▁", " ").encode())
        #: No piece holds a space behind another character.
        self.cuts = not any(b" " in b.lstrip(b" ") for i, b in enumerate(self.bytes) if not (self.model.is_control(i) or self.model.is_unknown(i)))

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


def union_find(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least node of each node's component, of ``n`` nodes and edges (a, b), all edges at a time.

    The larger of an edge's two roots is hung under the smaller, and paths are halved until every node
    points to its root.
    """
    parent = np.arange(n)
    while True:
        x, y = parent[a], parent[b]
        if (x == y).all():
            return parent
        np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))
        while ((above := parent[parent]) != parent).any():
            parent = above


def aligned(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links (A token, B token) and the group of every token, A's first, from the ends of tokens over the same bytes.

    Between two neighbouring ends lies one token of either side, so each stretch is a link.
    """
    cuts = np.union1d(ends_a, ends_b)
    a, b = np.searchsorted(ends_a, cuts), np.searchsorted(ends_b, cuts)
    return a, b, union_find(a, len(ends_a) + b, len(ends_a) + len(ends_b))


class Aligner:
    """Aligned pieces by number, kept while they are few: counts, group strings, and links as B id << 32 | A id."""

    def __init__(self, a: bytes, b: bytes):
        self.a, self.b = ByteLevel(a), Pieces(b)
        self.size_a, self.size_b = (np.array([len(x) for x in t.bytes]) for t in (self.a, self.b))
        # Every id with each mark that may follow it: of its own side, of the other side, of the next group, of the end.
        self.marked_a = np.array([b"%d%s" % (i, m) for i in range(len(self.a.bytes)) for m in (b",", b"|")], object)
        self.marked_b = np.array([b"%d%s" % (i, m) for i in range(len(self.b.bytes)) for m in (b",", b";", b"\n")], object)
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.groups: list[bytes] = []
        self.counts = np.zeros((0, 4), np.int64)  # A tokens, B tokens, groups, links
        self.ok = np.zeros(0, bool)
        self.starts, self.links = np.zeros(1, np.int64), np.zeros(0, np.int64)

    def add(self, pieces: list[str]) -> None:
        """Encode and align new pieces, all at a time."""
        ids_a, ids_b = self.a.encode([" " + p for p in pieces]), self.b.encode(pieces)
        of_a, of_b = self.a.bytes, self.b.bytes
        ok = np.empty(len(pieces), bool)
        for k, p in enumerate(pieces):
            raw = b" " + p.encode("utf-8", "replace")
            ok[k] = b"".join([of_a[i] for i in ids_a[k]]) == raw and b"".join([of_b[i] for i in ids_b[k]]) == raw
            if not ok[k]:
                ids_a[k] = ids_b[k] = ()
        n_a, n_b = (np.array([len(x) for x in ids], np.int64) for ids in (ids_a, ids_b))
        flat_a, flat_b = (np.fromiter((i for x in ids for i in x), np.int64, n.sum()) for ids, n in ((ids_a, n_a), (ids_b, n_b)))
        piece_a, piece_b = np.repeat(np.arange(len(pieces)), n_a), np.repeat(np.arange(len(pieces)), n_b)
        a, b, root = aligned(np.cumsum(self.size_a[flat_a]), np.cumsum(self.size_b[flat_b]))
        n_links = np.bincount(piece_a[a], minlength=len(pieces))
        # Tokens group by group, A's before B's; a root is its group's first A token.
        side = np.r_[np.zeros(len(flat_a), np.int8), np.ones(len(flat_b), np.int8)]
        order = np.lexsort((side, root))
        root, side, piece = root[order], side[order], np.r_[piece_a, piece_b][order]
        same = np.r_[root[1:] == root[:-1], False] if len(root) else np.zeros(0, bool)
        alike = same & np.r_[side[1:] == side[:-1], False] if len(root) else same
        last = np.r_[piece[1:] != piece[:-1], True] if len(root) else same
        n_groups = np.bincount(piece[~same], minlength=len(pieces))
        ids = np.r_[flat_a, flat_b][order]
        text = np.empty(len(ids), object)
        first = side == 0
        text[first] = self.marked_a[2 * ids[first] + ~alike[first]]
        text[~first] = self.marked_b[3 * ids[~first] + np.where(alike, 0, np.where(last, 2, 1))[~first]]
        strings = b"".join(text.tolist()).split(b"\n")
        at = iter(strings)
        self.groups += [next(at) if n else b"" for n in n_a.tolist()]
        for p in pieces:
            self.number[p] = len(self.number)
        self.counts = np.concatenate([self.counts, np.stack([n_a, n_b, n_groups, n_links], 1)])
        self.ok = np.concatenate([self.ok, ok])
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(n_links)])
        self.links = np.concatenate([self.links, flat_b[b] << 32 | flat_a[a]])

    def look_up(self, docs: list[list[str]]) -> list[np.ndarray]:
        new = {p for d in docs for p in d}.difference(self.number)
        if new:
            self.add(sorted(new))
        return [np.fromiter(map(self.number.__getitem__, d), np.int64, len(d)) for d in docs]

    def read(self, texts: list[str | None]) -> list[np.ndarray]:
        """Numbers of the pieces of each text; none where a text has no tokens."""
        if len(self.number) > KEPT:
            self.clear()
        docs = self.look_up([[] if not t else CUT.split(t) if self.b.cuts else [t] for t in texts])
        odd = [k for k, d in enumerate(docs) if not self.ok[d].all()]
        for k, whole in zip(odd, self.look_up([[texts[k]] for k in odd])):
            docs[k] = whole if self.ok[whole].all() else whole[:0]
        return docs


_aligners: dict[bytes, Aligner] = {}


def _aligner(a: bytes, b: bytes) -> Aligner:
    """One for each pair of tokenizers in a worker, as reading them takes long."""
    key = hashlib.sha256(a + b).digest()
    if key not in _aligners:
        _aligners.clear()
        _aligners[key] = Aligner(a, b)
    return _aligners[key]


def _decoded(column: pa.ChunkedArray | pa.Array) -> list[str | None]:
    return [None if x is None else x.decode("utf-8", "replace") for x in column.cast(pa.binary()).to_pylist()]


def _files(a: str, b: str) -> tuple[bytes, bytes]:
    """Read on the driver and sent to the executors."""
    with open(a, "rb") as f, open(b, "rb") as g:
        return f.read(), g.read()


def groups(docs: DataFrame, a: str = f"{TOKENIZERS}/{A}", b: str = f"{TOKENIZERS}/{B}") -> DataFrame:
    """(doc_id, groups) for each row of ``docs``: an array of (a, b), the ids of each minimal group's tokens in order."""
    kind, files = docs.schema["doc_id"].dataType.simpleString(), _files(a, b)
    item = pa.list_(pa.struct([("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32()))]))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        aligner = _aligner(*files)
        texts = [b";".join([aligner.groups[i] for i in d]) for d in aligner.read(_decoded(batch.column(1)))]
        found = [[{"a": x.split(","), "b": y.split(",")} for x, y in (g.split("|") for g in t.decode().split(";"))] if t else [] for t in texts]
        found = [[{k: [*map(int, v)] for k, v in g.items()} for g in d] for d in found]
        return pa.record_batch([batch.column(0), pa.array(found, item)], ["doc_id", "groups"])

    return arrow_map(docs.select("doc_id", "text"), run, f"doc_id {kind}, groups array<struct<a:array<int>,b:array<int>>>")


def _shard(files: tuple[bytes, bytes]):
    def run(rows: pa.Table) -> dict[str, pa.Array]:
        aligner = _aligner(*files)
        docs, sha, counts = [], [], []
        used: dict[int, int] = {}
        links, sizes = [], []
        for at in range(0, rows.num_rows, 128):
            before = aligner.number
            found = aligner.read(_decoded(rows.column(1).slice(at, 128)))
            if aligner.number is not before or not at:
                place = np.zeros(0, np.int64)  # numbers of another start mean other pieces
            place = np.concatenate([place, np.full(len(aligner.groups) - len(place), -1, np.int64)])
            flat = np.concatenate(found)
            new = np.unique(flat)
            new = new[place[new] < 0]
            place[new] = len(sizes) + np.arange(len(new))
            for i in new.tolist():
                part = aligner.links[aligner.starts[i] : aligner.starts[i + 1]]
                links.append(part)
                sizes.append(len(part))
            for d in found:
                docs.append(place[d])
                counts.append(aligner.counts[d].sum(0))
                text = b";".join([aligner.groups[i] for i in d.tolist()])
                sha.append(hashlib.sha256(text).hexdigest() if len(d) else "")
        flat = np.concatenate([*links, np.zeros(0, np.int64)])
        pairs, pair = np.unique(flat, return_inverse=True)
        seq = np.concatenate([*docs, np.zeros(0, np.int64)]).astype(np.int64)
        times = np.bincount(seq, minlength=len(sizes))
        n = np.bincount(pair, np.repeat(times, sizes), len(pairs)).astype(np.int64)
        counts = np.array(counts, np.int64).reshape(-1, 4)
        names = ("n_a", "n_b", "n_groups", "n_links")
        return {
            "ids": one_list(rows.column(0)),
            "sha": one_list(pa.array(sha, pa.string())),
            **{c: one_list(pa.array(counts[:, i])) for i, c in enumerate(names)},
            "lengths": blob(pack(np.array([len(d) for d in docs], np.int64))),
            "seq": blob(pack(seq)),
            "sizes": blob(pack(np.array(sizes, np.int64))),
            "links": blob(pack(pair)),
            "pairs": blob(pack_sorted(pairs)),
            "times": blob(pack(n)),
        }

    return run


def _asked(x: dict) -> pa.RecordBatch:
    pairs, n = unpack_sorted(x["pairs"].as_py()).astype(np.int64), unpack(x["times"].as_py()).astype(np.int64)
    return pa.record_batch([pa.array(np.full(len(pairs), x["shard"].as_py(), np.int64)), pa.array(pairs), pa.array(n)], ["shard", "pair", "n"])


def _answered(x: dict) -> pa.RecordBatch:
    pairs = unpack_sorted(x["pairs"].as_py())
    count, best = np.zeros(len(pairs), np.int64), np.zeros(len(pairs), bool)
    told = x["told"].values  # none where no text of the shard has tokens
    if told is not None and len(told):
        at = np.searchsorted(pairs, told.field("pair").to_numpy().astype(np.uint64))
        count[at], best[at] = told.field("n").to_numpy(), told.field("best").to_numpy(zero_copy_only=False)
    sizes, link = unpack(x["sizes"].as_py()).astype(np.int64), unpack(x["links"].as_py()).astype(np.int64)
    seq, lengths = unpack(x["seq"].as_py()).astype(np.int64), unpack(x["lengths"].as_py()).astype(np.int64)

    def summed(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        upto = np.concatenate([[0], np.cumsum(values)])
        ends = np.cumsum(sizes)
        return upto[ends] - upto[ends - sizes]

    sums = [summed(summed(v[link].astype(np.int64), sizes)[seq], lengths) for v in (best, count)]
    columns = [x["ids"].values, *(x[c].values for c in ("n_a", "n_b", "n_groups", "n_links")), pa.array(sums[0]), pa.array(sums[1]), x["sha"].values]
    return pa.record_batch(columns, ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])


def shards(docs: DataFrame, a: str = f"{TOKENIZERS}/{A}", b: str = f"{TOKENIZERS}/{B}", size: int = SHARD) -> DataFrame:
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"ids array<{kind}>, sha array<string>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, lengths binary, seq binary, sizes binary, links binary, pairs binary, times binary"
    return sharded(docs.select("doc_id", "text"), _shard(_files(a, b)), schema, "aligned", size)


def asked(held: DataFrame) -> DataFrame:
    """(shard, pair, n): how many links of a shard hold a pair of ids."""
    return by_shard(held.select("shard", "pairs", "times"), _asked, "shard long, pair long, n long")


def counted(asked: DataFrame) -> DataFrame:
    """(pair, n, best): links of the corpus that hold the pair, and whether no other pair of its B id has more."""
    counts = asked.groupBy("pair").agg(F.sum("n").alias("n")).withColumn("b", F.shiftright("pair", 32))
    most = counts.groupBy("b").agg(F.max("n").alias("most"))
    return counts.join(most, "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def pair_counts(docs: DataFrame, a: str = f"{TOKENIZERS}/{A}", b: str = f"{TOKENIZERS}/{B}") -> DataFrame:
    """(a, b, n, best) for each pair of ids that some link holds."""
    found = counted(asked(shards(docs, a, b)))
    return found.select(F.col("pair").bitwiseAND(F.lit((1 << 32) - 1)).cast("int").alias("a"), F.shiftright("pair", 32).cast("int").alias("b"), "n", "best")


def align(docs: DataFrame, a: str = f"{TOKENIZERS}/{A}", b: str = f"{TOKENIZERS}/{B}", size: int = SHARD) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) for each row of ``docs``.

    Null and empty texts, and texts that a tokenizer doesn't give back byte by byte, have no tokens: zeros
    and an empty digest.  Whole texts are read, however long; repeated rows count, and come out, as often
    as they stand; doc_id may be null or of any type; other columns are ignored.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    held = shards(docs, a, b, size)
    rows = materialize(asked(held), "pairs")
    counts = materialize(counted(rows), "pair-counts")
    told = rows.select("shard", "pair").join(counts, "pair").groupBy("shard").agg(F.collect_list(F.struct("pair", "n", "best")).alias("told"))
    both = held.select("shard", "ids", "sha", "n_a", "n_b", "n_groups", "n_links", "lengths", "seq", "sizes", "links", "pairs").join(told, "shard", "left")
    out = materialize(by_shard(both, _answered, f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"), "alignment")
    release(held, rows, counts)
    return out


def op13_token_alignment(spark, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return align(spark.read.parquet(f"{sf_dir}/documents.parquet"))
