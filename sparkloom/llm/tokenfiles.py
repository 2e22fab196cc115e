"""Token ids in binary shards with keyed access.

A shard holds the documents of one range of keys in ascending order:

    magic | ids of document 0, 1, ... (unsigned 16 or 32 bits each) | offsets | index | footer (JSON) | its length | magic

``offsets`` (n + 1 unsigned 64-bit numbers) count ids. The index is a minimal perfect hash over the distinct
keys: levels of bits, then for each slot a 32-bit fingerprint of the key, the number of its first document
and how many documents have it. A look-up hashes the key, takes the slot, compares the fingerprint and
seeks to the ids; its cost does not depend on the size of the shard.

Tasks write shards through a file system that all executors share, each under a name of its own; a shard
counts only once its task's manifest row is committed, so lost executors and retries leave no trace.
"""

from __future__ import annotations

import bisect
import json
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.arrow import release_memory
from sparkloom.llm.bpe import text_groups
from sparkloom.llm.mphf import PerfectHash, key_hashes
from sparkloom.session import scratch_dir, stored

MAGIC = b"LOOMTOK1"
KEPT_BYTES = 96 << 20  # of the chunks that a worker remembers, with their ids
FIRST_BYTES = 24 << 20  # and of those that follow no blank
LONGEST = 1_000  # bytes of a chunk that is worth remembering; a text with a longer one goes to the library whole
LINE = 2_000  # new words that are encoded as one text
_edge = re.compile(r"^$|^\s|\s$|\s\s")
_runs = re.compile(r"(\s{2,})")
_shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that name themselves, the others follow from 256 on
_names = {b: chr(b) for b in _shown} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in _shown)}
_odd_space = re.compile("[\x1c-\x1f]")


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pafs.LocalFileSystem(), uri)


class ChunkStore:
    """Ids of chunks, in three arrays: the chunks, all their ids, and where each one's begin."""

    def __init__(self, kind: str):
        self.kind = kind
        self.clear()

    def clear(self) -> None:
        self.chunks = pa.array([], pa.string())
        self.ids = np.zeros(0, self.kind)
        self.starts = np.zeros(1, np.int64)

    @property
    def held(self) -> int:
        return self.chunks.nbytes + self.ids.nbytes + self.starts.nbytes

    def find(self, chunks: pa.Array) -> np.ndarray:
        """The number of each chunk, -1 where it is not there."""
        return pc.fill_null(pc.index_in(chunks, value_set=self.chunks), -1).to_numpy(zero_copy_only=False).astype(np.int64)

    def get(self, number: int) -> bytes:
        return self.ids[self.starts[number] : self.starts[number + 1]].tobytes()

    def add(self, chunks: list[str], ids: list[bytes]) -> None:
        self.chunks = pa.concat_arrays([self.chunks, pa.array(chunks, pa.string())])
        self.starts = np.concatenate((self.starts, self.starts[-1] + np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)) // np.dtype(self.kind).itemsize)))
        self.ids = np.concatenate((self.ids, np.frombuffer(b"".join(ids), self.kind)))


class TextTokenizer:
    """A tokenizer of the tokenizers library. Where it splits texts by the byte-level pattern and nothing
    before that changes them, what stands between single blanks is encoded once and remembered, up to a bound.

    The pattern gives a blank to the word after it, so a text without two white spaces in a row is its first
    chunk and then ' ' with each further chunk, each encoded by itself. Of a longer run of white space the
    last one counts so, and those before it are one pretoken.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        fs, at = open_fs(path)
        with fs.open_input_stream(at) as f:
            spec = f.read().decode()
        self.tokenizer = Tokenizer.from_str(spec)
        self.size = self.tokenizer.get_vocab_size()
        made = json.loads(spec)
        pre, added = made.get("pre_tokenizer") or {}, made.get("added_tokens") or []
        self.by_chunk = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not made.get("normalizer") and not made.get("truncation") and not made.get("padding")
        # the library looks for added tokens in a text before anything else, so texts that hold one go to it whole
        self.added = re.compile("|".join(sorted((re.escape(t["content"]) for t in added), reverse=True))) if added else None
        self.by_chunk = self.by_chunk and not any(t.get("normalized") for t in added)
        self.first: dict[str, bytes] = {}  # ids of a chunk
        self.first_held = 0
        self.stores: dict[str, ChunkStore] = {}  # ids of a blank and a chunk, by type
        if self.by_chunk:  # a character of a token's name is a byte
            spelled = made | {"pre_tokenizer": {"type": "WhitespaceSplit"}, "added_tokens": []}
            self.spelled = Tokenizer.from_str(json.dumps(spelled))
            self.lengths = np.zeros(max(self.tokenizer.get_vocab().values()) + 1, np.int64)
            for token, i in self.tokenizer.get_vocab().items():
                self.lengths[i] = len(token)

    def ids_of(self, texts: list[str], kind: str) -> list[np.ndarray]:
        return [np.array(e.ids, kind) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def word_ids(self, words: list[str], blank: str, kind: str) -> list[bytes]:
        """Ids of pretokens of letters, after ``blank`` or nothing. They go many to a text, spelled in the
        names of bytes and apart by blanks, past the pattern; the lengths of the tokens tell which are whose."""
        out: list[bytes] = []
        for at in range(0, len(words), 8 * LINE):
            raw = [(blank + f"\n{blank}".join(words[i : i + LINE])).encode() for i in range(at, min(at + 8 * LINE, len(words)), LINE)]
            texts = [x.decode("latin-1").translate(_names).replace(_names[10], " ") for x in raw]
            for x, e in zip(raw, self.spelled.encode_batch_fast(texts, add_special_tokens=False)):
                ids = np.array(e.ids, kind)
                ends = np.flatnonzero(np.frombuffer(x + b"\n", np.uint8) == 10)
                ends -= np.arange(len(ends))
                stop = np.searchsorted(until := np.cumsum(self.lengths[ids]), ends)
                if not (until[stop] == ends).all():
                    raise ValueError("the tokenizer joined words")
                packed, cuts = ids.tobytes(), ((stop + 1) * ids.itemsize).tolist()
                out += [packed[i:j] for i, j in zip([0, *cuts], cuts)]
        return out

    def learn(self, chunks: list[str], known: dict[str, bytes], kind: str) -> dict[str, bytes]:
        """Ids of new chunks after a blank; ``known`` has those of other chunks. A comma or full stop after letters is a
        pretoken of its own, and so is a line end that no other white space is next to."""
        marks = {c: self.ids_of([c], kind)[0].tobytes() for c in ".,\n"}
        words = {c for c in chunks if c.isalpha()}
        marked, broken, rest = [], [], []
        for c in chunks:
            if c in words:
                continue
            if c[-1:] in ".," and c[:-1].isalpha():
                marked.append((c, c[:-1]))
            elif "\n" in c:
                broken.append((c, c.split("\n")))
            else:
                rest.append(c)
        heads = {p[0] for _, p in broken if p[0] not in known}
        rest += [c for c in heads if not c.isalpha()]
        words.update([c for c in heads if c.isalpha()])
        words.update([stem for _, stem in marked if stem not in known])
        own = list(words)
        out = dict(zip(own, self.word_ids(own, " ", kind)))
        out.update([(c, ids.tobytes()) for c, ids in zip(rest, self.ids_of([" " + c for c in rest], kind) if rest else ())])
        of = lambda c: out[c] if c in out else known[c]
        out.update([(c, of(stem) + marks[c[-1]]) for c, stem in marked])
        self.learn_first({t for _, p in broken for t in p[1:]}, kind)
        out.update([(c, of(p[0]) + b"".join([marks["\n"] + self.first[t] for t in p[1:]])) for c, p in broken])
        return out

    def learn_first(self, chunks: set[str], kind: str) -> None:
        """Encode new chunks that follow no blank."""
        new = [c for c in chunks if c not in self.first]
        alone = [c for c in new if c.isalpha()]
        others = [c for c in new if not c.isalpha()]
        self.first.update(zip(alone, self.word_ids(alone, "", kind)))
        self.first.update([(c, ids.tobytes()) for c, ids in zip(others, self.ids_of(others, kind) if others else ())])
        self.first_held += sum(150 + 2 * len(c) + len(self.first[c]) for c in new)

    def pieces(self, text: str) -> list[tuple[bool, list[str]]]:
        """A text with runs of white space as parts: whether their chunks follow a blank each, and the chunks."""
        if _odd_space.search(text):  # here engines differ on what is white space
            return [(False, [text])]
        parts: list[tuple[bool, list[str]]] = []
        blank, cut = False, _runs.split(text)
        for own, run in zip(cut[::2], [*cut[1::2], ""]):
            if own:
                first, *rest = own.split(" ")
                parts.append((False, [" " + first if blank else first]))
                parts += [(False, [" " + c]) if _edge.search(c) else (True, [c]) for c in rest] if any(map(_edge.search, rest)) else [(True, rest)]
            if run:
                blank = run[-1] == " "
                parts.append((False, [run[:-1]] if blank else [run[:-1], run[-1]]))
        if cut[-1] == "":  # at the end a run is one pretoken
            parts[-1] = (False, [cut[-2]])
        return parts

    def encode(self, texts: list[str], kind: str) -> list[bytes]:
        if not self.by_chunk:
            return [ids.tobytes() for ids in self.ids_of(texts, kind)]
        if self.added is not None and (marked := [i for i, t in enumerate(texts) if self.added.search(t)]):
            own = dict(zip(marked, self.ids_of([texts[i] for i in marked], kind)))
            rest = iter(self.encode([t for i, t in enumerate(texts) if i not in own], kind))
            return [own[i].tobytes() if i in own else next(rest) for i in range(len(texts))]
        # all texts are cut at blanks, and chunks numbered, looked up and put together, as arrays
        firsts = [t.partition(" ")[0] for t in texts]
        rest = pa.array([t[len(f) + 1 :] if len(f) < len(t) else None for t, f in zip(texts, firsts)], pa.string())
        lists = pc.split_pattern(rest, " ")
        coded = lists.flatten().dictionary_encode()
        store = self.stores.setdefault(kind, ChunkStore(kind))
        if store.held > KEPT_BYTES:
            store.clear()
        if self.first_held > FIRST_BYTES:
            self.first.clear()
            self.first_held = 0
        chunks = coded.dictionary
        many = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        place = coded.indices.to_numpy(zero_copy_only=False).astype(np.int32)
        long = pc.greater(pc.binary_length(chunks), LONGEST).to_numpy(zero_copy_only=False)
        whole = {i for i, f in enumerate(firsts) if len(f) > LONGEST}
        if long.any():
            whole.update(np.unique(np.repeat(np.arange(len(texts)), many)[long[place]]).tolist())
        if whole:
            own = dict(zip(sorted(whole), self.ids_of([texts[i] for i in sorted(whole)], kind)))
            rest = iter(self.encode([t for i, t in enumerate(texts) if i not in own], kind))
            return [own[i].tobytes() if i in own else next(rest) for i in range(len(texts))]
        ends = pc.match_substring_regex(chunks, "[.,]$")
        breaks = pc.match_substring(chunks, "\n")
        stems = pc.utf8_slice_codeunits(chunks.filter(ends), 0, -1)
        heads = pc.list_element(pc.split_pattern(chunks.filter(breaks), "\n", max_splits=1), 0)
        asked = pa.concat_arrays([chunks, stems, heads])
        number = store.find(asked)
        number, other = number[: len(chunks)], number[len(chunks) :]
        held = np.flatnonzero(other >= 0)
        known = {c: store.get(n) for c, n in zip(asked.take(pa.array(held + len(chunks))).to_pylist(), other[held].tolist())} if (number < 0).any() else {}
        unseen = np.flatnonzero(number < 0)
        new = chunks.take(pa.array(unseen)).to_pylist()
        edgy = {i for i, c in zip(unseen.tolist(), new) if not c.isalpha() and _edge.search(c)}  # beside white space; never stored
        odd = {i for i, f in enumerate(firsts) if f and (f[-1].isspace() or _runs.search(f))}
        if edgy:
            flags = np.zeros(len(chunks), bool)
            flags[list(edgy)] = True
            odd.update(np.unique(np.repeat(np.arange(len(texts)), many)[flags[place]]).tolist())
        fresh = [c for i, c in zip(unseen.tolist(), new) if i not in edgy]
        learnt = self.learn(fresh, known, kind)
        before = len(store.chunks)
        store.add(fresh, [learnt[c] for c in fresh])
        number[[i for i in unseen.tolist() if i not in edgy]] = np.arange(before, len(store.chunks))
        self.learn_first({f for i, f in enumerate(firsts) if i not in odd}, kind)
        out: dict[int, bytes] = {}
        if odd:  # texts with runs of white space, chunk by chunk
            split = {i: self.pieces(texts[i]) for i in odd}
            more = sorted({c for parts in split.values() for after, own in parts if after for c in own})
            at = store.find(pa.array(more, pa.string()))
            here = {c: store.get(n) for c, n in zip(more, at.tolist()) if n >= 0}
            here |= self.learn([c for c in more if c not in here], here, kind)
            self.learn_first({c for parts in split.values() for after, own in parts if not after for c in own}, kind)
            out = {i: b"".join([here[c] if after else self.first[c] for after, own in parts for c in own]) for i, parts in split.items()}
        begin = np.where(number >= 0, store.starts[:-1][number] if len(store.chunks) else 0, 0)
        sizes = np.where(number >= 0, np.diff(store.starts)[number] if len(store.chunks) else 0, 0).astype(np.int32)
        n = sizes[place]
        ends = np.cumsum(n, dtype=np.int32)
        total = int(ends[-1]) if len(ends) else 0
        flat = store.ids[np.repeat(begin[place] - (ends - n), n) + np.arange(total, dtype=np.int32)]
        upto = np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(many)))].tolist()
        return [out[i] if i in out else self.first[f] + flat[a:b].tobytes() for i, (f, a, b) in enumerate(zip(firsts, upto, upto[1:]))]


@lru_cache(maxsize=2)
def text_tokenizer(path: str) -> TextTokenizer:
    return TextTokenizer(path)


class ShardWriter:
    """Writes one shard; ids go to the file as they come, only keys and sizes stay in memory."""

    def __init__(self, uri: str, kind: str):
        self.fs, at = open_fs(uri)
        self.fs.create_dir(at.rpartition("/")[0], recursive=True)
        self.file = self.fs.open_output_stream(at)
        self.file.write(MAGIC)
        self.kind, self.width = kind, np.dtype(kind).itemsize
        self.keys: list = []
        self.sizes: list[int] = []
        self.written = 0

    def add(self, key, ids: bytes) -> None:
        if self.keys and key != self.keys[-1] and (key is None or (self.keys[-1] is not None and key < self.keys[-1])):
            raise ValueError("keys must come in ascending order")
        self.file.write(ids)
        self.written += len(ids)
        self.keys.append(key)
        self.sizes.append(len(ids) // self.width)

    def close(self) -> None:
        offsets = np.concatenate(([0], np.cumsum(self.sizes))).astype("<u8")
        first = [i for i, k in enumerate(self.keys) if not i or k != self.keys[i - 1]]
        counts = np.diff([*first, len(self.keys)])
        h = key_hashes([self.keys[i] for i in first])
        index = PerfectHash.build(h)
        slot = index.numbers(h)
        prints, places, many = np.empty(len(h), "<u4"), np.empty(len(h), "<u8"), np.empty(len(h), "<u4")
        prints[slot], places[slot], many[slot] = fingerprint(h), first, counts
        at, sections = len(MAGIC) + int(offsets[-1]) * self.width, {}
        for name, data in [("offsets", offsets), ("prints", prints), ("places", places), ("many", many), *((f"level{i}", x) for i, x in enumerate(index.levels))]:
            raw = data.tobytes()
            self.file.write(raw)
            sections[name] = [at, len(raw)]
            at += len(raw)
        footer = json.dumps({"kind": self.kind, "documents": len(self.keys), "keys": len(h), "levels": len(index.levels), "sections": sections}).encode()
        self.file.write(footer + struct.pack("<I", len(footer)) + MAGIC)
        self.file.close()


def fingerprint(h: np.ndarray) -> np.ndarray:
    return ((h[:, 0] ^ (h[:, 1] >> np.uint64(17))) & np.uint64(0xFFFFFFFF)).astype("<u4")


class ShardReader:
    """Keyed access to one shard."""

    def __init__(self, uri: str):
        fs, at = open_fs(uri)
        self.file = fs.open_input_file(at)
        size = self.file.size()
        tail = self.file.read_at(12, size - 12)
        length = struct.unpack("<I", tail[:4])[0]
        if tail[4:] != MAGIC or self.file.read_at(8, 0) != MAGIC:
            raise ValueError(f"{uri} is not a token shard")
        self.footer = json.loads(self.file.read_at(length, size - 12 - length))
        part = lambda name, kind: np.frombuffer(self.file.read_at(self.footer["sections"][name][1], self.footer["sections"][name][0]), kind)
        self.kind = np.dtype(self.footer["kind"])
        self.offsets, self.prints, self.places, self.many = part("offsets", "<u8"), part("prints", "<u4"), part("places", "<u8"), part("many", "<u4")
        self.index = PerfectHash([part(f"level{i}", "<u8") for i in range(self.footer["levels"])])

    def find(self, keys: list) -> list[range]:
        """The numbers of each key's documents; none where the fingerprint says that the key is not here."""
        h = key_hashes(keys)
        slot = self.index.numbers(h)
        ok = (slot >= 0) & (slot < len(self.prints))
        ok[ok] = self.prints[slot[ok]] == fingerprint(h[ok])
        return [range(int(self.places[s]), int(self.places[s]) + int(self.many[s])) if good else range(0) for s, good in zip(slot.tolist(), ok.tolist())]

    def read(self, number: int) -> np.ndarray:
        a, b = int(self.offsets[number]), int(self.offsets[number + 1])
        return np.frombuffer(self.file.read_at((b - a) * self.kind.itemsize, len(MAGIC) + a * self.kind.itemsize), self.kind)

    def close(self) -> None:
        self.file.close()


def write_token_files(
    docs: DataFrame, folder: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, shard_bytes: int = 1 << 30
) -> DataFrame:
    """Encode whole texts and write them as shards in ascending key order; the manifest, a row per shard.

    Each document's ids end with ``end_id``; null and empty texts have that one alone. Rows with equal keys
    follow each other in text order and share a look-up; null keys come first. Other columns are ignored.
    A shard is closed once it has ``shard_bytes`` of ids; rows of one key may be dealt to several tasks and shards.
    Manifest: ``(shard, uri, documents, ids, least, greatest, has_null)``, shards numbered in key order.
    """
    kind_of_key = docs.schema[id_col].dataType.simpleString()
    names = ["shard", "uri", "documents", "ids", "least", "greatest", "has_null"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = text_tokenizer(tokenizer)
        kind = "<u2" if max(coder.size - 1, end_id) < 1 << 16 else "<u4"
        end = np.array([end_id], kind).tobytes()
        part, name, seq = TaskContext.get().partitionId(), uuid.uuid4().hex[:12], 0
        writer, uri, done, key_type = None, "", [], None

        def close() -> tuple:
            writer.close()
            there = [k for k in writer.keys if k is not None]
            least, greatest = (there[0], there[-1]) if there else (None, None)
            return part << 32 | seq, uri, len(writer.keys), sum(writer.sizes), least, greatest, writer.keys[0] is None

        for batch in batches:
            key_type = batch.column(0).type
            keys, texts, at = batch.column(0).to_pylist(), ["" if t is None else t for t in batch.column(1).to_pylist()], 0
            for group in text_groups(texts, 8_000_000):
                for ids in coder.encode(group, kind):
                    if writer is None:
                        uri = f"{folder}/shard-{part:06d}-{seq:04d}-{name}.tok"
                        writer = ShardWriter(uri, kind)
                    writer.add(keys[at], ids + end)
                    at += 1
                    if writer.written >= shard_bytes:
                        done.append(close())
                        writer, seq = None, seq + 1
        release_memory()
        if writer is not None:
            done.append(close())
        if done:
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), key_type, key_type, pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*done), kinds)], names)

    rows = docs.select(F.col(id_col).alias("key"), F.col(text_col).alias("text"))
    dealt = rows.repartitionByRange("key", F.substring("text", 1, 64)).sortWithinPartitions("key", "text")
    schema = f"shard bigint, uri string, documents bigint, ids bigint, least {kind_of_key}, greatest {kind_of_key}, has_null boolean"
    return stored(dealt.mapInArrow(run, schema), "manifest")


def read_token_files(manifest: DataFrame, keys: DataFrame, id_col: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """Look up each distinct key of ``keys``; a row per document found: ``(id_col, start, n_tokens, ids_crc32)``.

    ``start`` counts the ids of all documents before it in the files. ``with_ids`` adds them, as packed
    little-endian unsigned 32-bit integers. Keys that are not there give no row. The manifest has a row per
    shard and goes to every task; keys are dealt by range, so that a task opens few shards.
    """
    shards = manifest.orderBy("shard").collect()
    named = [s for s in shards if s.least is not None]
    bounds, tops, uris = [s.least for s in named], [s.greatest for s in named], [s.uri for s in named]
    nulls = [s.uri for s in shards if s.has_null]
    base, total = {}, 0
    for s in shards:
        base[s.uri] = total
        total += s.ids
    schema = f"`{id_col}` {keys.schema[id_col].dataType.simpleString()}, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids binary" * with_ids

    def shards_of(key) -> list[str]:
        if key is None:
            return nulls
        to = bisect.bisect_right(bounds, key)
        at = to
        while at and tops[at - 1] >= key:
            at -= 1
        return uris[at:to]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, opened = None, None
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        names = [id_col, "start", "n_tokens", "ids_crc32", "ids"][: 4 + with_ids]
        for batch in batches:
            own: dict[str, list] = {}
            for k in batch.column(0).to_pylist():
                for uri in shards_of(k):
                    own.setdefault(uri, []).append(k)
            out: list[tuple] = []
            held = 0
            for uri, wanted in own.items():
                if uri != opened:
                    if reader is not None:
                        reader.close()
                    reader, opened = ShardReader(uri), uri
                for k, numbers in zip(wanted, reader.find(wanted)):
                    for i in numbers:
                        ids = reader.read(i).astype("<u4").tobytes()
                        out.append((k, base[uri] + int(reader.offsets[i]), len(ids) // 4, zlib.crc32(ids), ids if with_ids else None)[: 4 + with_ids])
                        held += len(ids) if with_ids else 1
                        if held > 1 << 24:
                            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), [batch.column(0).type, *kinds])], names)
                            out, held = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), [batch.column(0).type, *kinds])], names)
        if reader is not None:
            reader.close()

    return keys.select(id_col).distinct().repartitionByRange(max(1, len(shards)), id_col).sortWithinPartitions(id_col).mapInArrow(run, schema)


def op4_token_files(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    manifest = write_token_files(docs, f"{scratch_dir(spark)}/tokens", public_tokenizers.path("byte_bpe_50k.json"))
    return read_token_files(manifest, docs)
