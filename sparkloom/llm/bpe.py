"""Byte-level BPE by a segment tree over byte positions.

A leaf stands for a byte position. A live position (the start of a part) holds the rank of the pair it
forms with the next live part, others hold no rank; an inner node holds the least of its children, so the
root names the leftmost pair of least rank. A merge joins two parts: the right one's position dies, and
the ranks at the merged part and at the live neighbour before it change, which are three point updates
of logarithmic depth. Short pretokens go through the same tree many at a time, as rows of an array.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.arrow import release_memory
from sparkloom.llm.pretokens import pretokens

NONE = 1 << 40  # above any rank
WIDEST = 32  # bytes of the pretokens that go many at a time
KEPT = 400_000  # pretokens that a task remembers


class RankTable:
    """The vocabulary of a rank file: bytes by rank, and the rank of each pair of parts that may merge."""

    def __init__(self, path: str):
        fs, at = pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)
        with fs.open_input_stream(at) as f:
            lines = f.read().split(b"\n")
        self.ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x)}
        self.parts = {r: t for t, r in self.ranks.items()}
        self.size = max(self.parts) + 1
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = {}
        for t, r in self.ranks.items():
            for cut in range(1, len(t)):
                a, b = self.ranks.get(t[:cut]), self.ranks.get(t[cut:])
                if a is not None and b is not None:
                    pairs[a * self.size + b] = r
        self.pairs = pairs
        self.keys = np.array(sorted(pairs), np.int64)
        self.values = np.array([pairs[k] for k in self.keys.tolist()], np.int64)

    def pair_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * self.size + b
        i = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[i] == key, self.values[i], NONE)


@lru_cache(maxsize=4)
def rank_table(path: str) -> RankTable:
    return RankTable(path)


def encode_long(table: RankTable, piece: bytes) -> list[int]:
    """Ids of one pretoken of any length: O(n log n)."""
    n, pairs, size = len(piece), table.pairs, table.size
    if n < 2:
        return [int(table.byte_ids[b]) for b in piece]
    width = 1 << (n - 1).bit_length()
    ids = [int(table.byte_ids[b]) for b in piece]
    tree = [NONE] * (2 * width)
    for i in range(n - 1):
        tree[width + i] = pairs.get(ids[i] * size + ids[i + 1], NONE)
    for i in range(width - 1, 0, -1):
        tree[i] = min(tree[2 * i], tree[2 * i + 1])
    after = [*range(1, n), -1]
    before = [-1, *range(n - 1)]

    def put(i: int, value: int) -> None:
        i += width
        tree[i] = value
        i >>= 1
        while i:
            low = tree[2 * i] if tree[2 * i] <= tree[2 * i + 1] else tree[2 * i + 1]
            if tree[i] == low:
                return
            tree[i] = low
            i >>= 1

    while tree[1] != NONE:
        i, rank = 1, tree[1]
        while i < width:
            i = 2 * i if tree[2 * i] == rank else 2 * i + 1
        i -= width
        j = after[i]
        k = after[j]
        ids[i], ids[j] = rank, -1
        after[i] = k
        put(j, NONE)
        if k >= 0:
            before[k] = i
            put(i, pairs.get(rank * size + ids[k], NONE))
        else:
            put(i, NONE)
        if before[i] >= 0:
            put(before[i], pairs.get(ids[before[i]] * size + rank, NONE))
    return [x for x in ids if x >= 0]


def encode_rows(table: RankTable, pieces: list[bytes]) -> list[list[int]]:
    """Ids of pretokens of at most WIDEST bytes, all through one array of trees."""
    if not pieces:
        return []
    lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
    width = 1 << int(max(1, int(lengths.max()) - 1)).bit_length()
    m = len(pieces)
    raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(m, width)
    there = np.arange(width) < lengths[:, None]
    ids = np.where(there, table.byte_ids[raw], -1)
    tree = np.full((m, 2 * width), NONE, np.int64)
    tree[:, width : 2 * width - 1] = np.where(there[:, 1:], table.pair_ranks(ids[:, :-1], ids[:, 1:]), NONE)
    level = width
    while level > 1:
        level //= 2
        tree[:, level : 2 * level] = np.minimum(tree[:, 2 * level : 4 * level : 2], tree[:, 2 * level + 1 : 4 * level : 2])
    after = np.where(np.arange(1, width + 1) < lengths[:, None], np.arange(1, width + 1), -1)
    before = np.broadcast_to(np.arange(-1, width - 1), (m, width)).copy()

    def put(rows: np.ndarray, at: np.ndarray, values: np.ndarray) -> None:
        node = at + width
        tree[rows, node] = values
        while len(node) and node[0] > 1:
            node = node >> 1
            tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])

    rows = np.flatnonzero(tree[:, 1] != NONE)
    while len(rows):
        rank = tree[rows, 1]
        node = np.ones(len(rows), np.int64)
        while node[0] < width:
            node = np.where(tree[rows, 2 * node] == rank, 2 * node, 2 * node + 1)
        i = node - width
        j = after[rows, i]
        k = after[rows, j]
        ids[rows, i], ids[rows, j] = rank, -1
        after[rows, i] = k
        put(rows, j, np.full(len(rows), NONE, np.int64))
        follows = k >= 0
        before[rows[follows], k[follows]] = i[follows]
        put(rows, i, np.where(follows, table.pair_ranks(rank, ids[rows, k]), NONE))
        p = before[rows, i]
        has = p >= 0
        put(rows[has], p[has], table.pair_ranks(ids[rows[has], p[has]], rank[has]))
        rows = rows[tree[rows, 1] != NONE]
    flat = ids[ids >= 0].tolist()
    ends = np.cumsum((ids >= 0).sum(1)).tolist()
    return [flat[a:b] for a, b in zip([0, *ends[:-1]], ends)]


class Encoder:
    """Encodes whole texts; each pretoken's ids are computed once and remembered, up to a bound."""

    def __init__(self, table: RankTable):
        self.table = table
        self.known: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        known = self.known
        split = [pretokens(t) for t in texts]
        new = list({p for own in split for p in own if p not in known})
        if len(known) + len(new) > KEPT:
            known.clear()
            new = list({p for own in split for p in own})
        by_width: dict[int, list[tuple[str, bytes]]] = {}
        for p in new:
            raw = p.encode()
            rank = self.table.ranks.get(raw)  # a pretoken in the vocabulary is that one id
            if rank is not None:
                known[p] = rank.to_bytes(4, "little")
            elif len(raw) > WIDEST:
                known[p] = np.array(encode_long(self.table, raw), "<u4").tobytes()
            else:
                by_width.setdefault((len(raw) - 1).bit_length(), []).append((p, raw))
        for own in by_width.values():
            for at in range(0, len(own), 20_000):
                part = own[at : at + 20_000]
                for (p, _), ids in zip(part, encode_rows(self.table, [raw for _, raw in part])):
                    known[p] = np.array(ids, "<u4").tobytes()
        return [b"".join(map(known.__getitem__, own)) for own in split]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.table.parts.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def encoder(path: str) -> Encoder:
    return Encoder(rank_table(path))


def text_groups(texts: list[str], limit: int = 2_000_000) -> Iterator[list[str]]:
    """Runs of texts of about ``limit`` characters, so that memory follows the limit and the longest text."""
    own, chars = [], 0
    for t in texts:
        own.append(t)
        chars += len(t)
        if chars >= limit:
            yield own
            own, chars = [], 0
    if own:
        yield own


def encoded(docs: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids", as_digests: bool = False, check: bool = False) -> DataFrame:
    """``docs`` with the ids of each whole text, as packed little-endian unsigned 32-bit integers.

    Null and empty texts have no ids. All rows and all other columns stay, repeated rows too; a column
    already named like the new one is replaced. ``as_digests``: instead of the ids themselves, a struct of
    their number, their SHA-256 and the SHA-256 of the bytes they decode to. ``check``: the ids are decoded
    again, and the job fails if they do not give the text.
    """
    kept = [c for c in docs.columns if c != ids_col]
    shape = "struct<n_tokens:bigint,ids_sha256:string,decoded_sha256:string>" if as_digests else "binary"
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in kept), f"`{ids_col}` {shape}"])
    kind = pa.struct([("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]) if as_digests else pa.binary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        for batch in batches:
            at, column = 0, batch.schema.get_field_index(text_col)
            for group in text_groups(["" if t is None else t for t in batch.column(column).to_pylist()]):
                out = coder.encode(group)
                if check and any(coder.decode(ids) != t.encode() for ids, t in zip(out, group)):
                    raise ValueError("ids do not decode to their text")
                if as_digests:
                    out = [{"n_tokens": len(ids) // 4, "ids_sha256": hashlib.sha256(ids).hexdigest(), "decoded_sha256": hashlib.sha256(coder.decode(ids)).hexdigest()} for ids in out]
                part = batch.slice(at, len(group))
                at += len(group)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, kind)], [*batch.schema.names, ids_col])
        del coder
        release_memory()

    return docs.select(*[F.col(f"`{c}`") for c in kept]).mapInArrow(run, schema)


def decoded(rows: DataFrame, path: str, ids_col: str = "ids", bytes_col: str = "decoded") -> DataFrame:
    """``rows`` with the bytes that the ids in ``ids_col`` stand for; null ids give null."""
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != bytes_col), f"`{bytes_col}` binary"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch.slice(at, 500)
                got = [None if x is None else coder.decode(x) for x in part.column(batch.schema.get_field_index(ids_col)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(got, pa.binary())], [*batch.schema.names, bytes_col])

    return rows.select(*[F.col(f"`{c}`") for c in rows.columns if c != bytes_col]).mapInArrow(run, schema)


def op8_byte_bpe(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = encoded(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), as_digests=True)
    return found.select("doc_id", "ids.n_tokens", "ids.ids_sha256", "ids.decoded_sha256")
