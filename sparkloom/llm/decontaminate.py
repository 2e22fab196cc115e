"""Benchmark decontamination on a distributed positional inverted index.

The corpus is indexed in shards of a bounded number of words. A shard holds its terms in order, for each
of them the sorted positions in the shard's documents (delta-coded), and its documents' ids and sizes. It knows nothing
of any benchmark, so an index is built once (:func:`build_index`), kept as a table, and searched by whichever test items come
(:func:`search_index`). Shards are rows, never shuffled: corpus-wide counts of the searched terms are sums over
shard rows, and a search runs shard by shard.

A phrase is found by intersecting its terms' lists, each shifted by the term's offset, from the term that
is rarest in the corpus onwards; with ``slop`` above 0 a term may be that many words off its place.

Items are cut into windows by Spark, and windows come in blocks of a bounded number of bytes. A block is sent to all
tasks; further blocks are further passes over the index, whose hits are merged by row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.arrow import byte_values, release_memory
from sparkloom.session import stored

#: Lower-cases A-Z, keeps 0-9, a-z and all bytes of characters beyond ASCII, and turns the rest into blanks.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(WORD_BYTES).split()


def item_windows(words: list, size: int) -> list[tuple]:
    """All runs of ``size`` words; of fewer, the whole; of none, none."""
    return [tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))] if words else []


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_words: int = 2_000_000) -> DataFrame:
    """``(shard, ids, sizes, terms, starts, places)``, a row per shard, stored in the shared folder.

    ``terms``: all words of the shard in byte order, joined by blanks; ``starts``: where each one's postings begin; ``places``: all
    postings, as differences within a term; documents lie one free place apart. Ids keep their type, whatever it is.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, base = TaskContext.get().partitionId(), 0, 0
        ids: list[pa.Array] = []
        sizes: list[int] = []
        number: dict[bytes, int] = {}
        found: list[np.ndarray] = []
        places: list[np.ndarray] = []

        def close() -> pa.RecordBatch:
            names = list(number)
            by_name = sorted(range(len(names)), key=names.__getitem__)
            rank = np.empty(len(names), np.int32)
            rank[by_name] = np.arange(len(names), dtype=np.int32)
            term = rank[np.concatenate(found)] if found else np.zeros(0, np.int32)
            place = np.concatenate(places) if places else np.zeros(0, np.int32)
            order = np.argsort(term, kind="stable")
            term, place = term[order], place[order]
            starts = np.searchsorted(term, np.arange(len(names) + 1)).astype(np.uint32)
            gaps = np.diff(place, prepend=np.int32(0)).astype(np.uint32)
            gaps[starts[:-1]] = place[starts[:-1]]  # each list begins anew
            own = pa.concat_arrays(ids)
            listed = pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own)
            packed = [np.array(sizes, np.uint32).tobytes(), b" ".join(names[i] for i in by_name), starts.tobytes(), gaps.tobytes()]
            columns = [pa.array([part << 32 | seq], pa.int64()), listed, *(pa.array([x], pa.binary()) for x in packed)]
            return pa.RecordBatch.from_arrays(columns, ["shard", "ids", "sizes", "terms", "starts", "places"])

        for batch in batches:
            from_row = 0
            for row, text in enumerate(byte_values(batch.column(1)), 1):
                words = words_of(text)
                for w in words:
                    if w not in number:
                        number[w] = len(number)
                found.append(np.fromiter(map(number.__getitem__, words), np.int32, len(words)))
                places.append(np.arange(base, base + len(words), dtype=np.int32))
                sizes.append(len(words))
                base += len(words) + 1  # a free place between documents
                if base >= shard_words:
                    ids.append(batch.column(0).slice(from_row, row - from_row))
                    yield close()
                    ids, sizes, number, found, places, base, seq, from_row = [], [], {}, [], [], 0, seq + 1, row
            if from_row < len(batch):
                ids.append(batch.column(0).slice(from_row))
        if sizes:
            yield close()
        del number, found, places
        release_memory()

    kind = docs.schema[id_col].dataType.simpleString()
    if not 0 < shard_words < 1 << 22:
        raise ValueError("shard_words must be under 4,194,304")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return stored(rows.mapInArrow(run, f"shard bigint, ids array<{kind}>, sizes binary, terms binary, starts binary, places binary"), "index")


def match_places(lists: list[np.ndarray], offsets: list[int], slop: int = 0) -> np.ndarray:
    """Places at which the phrase starts, given its terms' positions, rarest first, and their offsets in it."""
    at = lists[0] - offsets[0]
    for places, offset in zip(lists[1:], offsets[1:]):
        if not len(at) or not len(places):
            return at[:0]
        i = np.searchsorted(places, at + offset - slop)
        at = at[(i < len(places)) & (places[np.minimum(i, len(places) - 1)] <= at + offset + slop)]
    return at


def postings_of(terms: bytes, starts: bytes, places: bytes, wanted) -> dict[bytes, np.ndarray]:
    """The positions of those ``wanted`` terms that a shard has."""
    begin, gaps = np.frombuffer(starts, np.uint32), np.frombuffer(places, np.uint32)
    return {t: np.cumsum(gaps[begin[i] : begin[i + 1]], dtype=np.int64) for i, t in enumerate(terms.split()) if t in wanted}


def search_shard(lists: dict[bytes, np.ndarray], sizes: np.ndarray, windows: dict[bytes, list[int]], counts: dict[bytes, int], slop: int):
    """``(marks, hits)``: marks is 1 for each place hit; hits are rows of (document, item)."""
    bases = np.concatenate(([0], np.cumsum(sizes + 1)))
    change = np.zeros(int(bases[-1]) + 1, np.int32)
    pairs = []
    for packed, items in windows.items():
        window = packed.split()
        if any(t not in lists for t in window):
            continue
        order = sorted(range(len(window)), key=lambda i: (counts[window[i]], i))
        at = match_places([lists[window[i]] for i in order], order, slop)
        if slop and len(at):  # all within one document
            at = at[(at >= 0) & (at + len(window) <= bases[-1])]
            doc = np.searchsorted(bases, at, "right") - 1
            at = at[at + len(window) <= bases[doc] + sizes[doc]]
        if len(at):
            change[at] += 1
            change[at + len(window)] -= 1
            docs_hit = np.unique(np.searchsorted(bases, at, "right") - 1)
            pairs += [np.stack([docs_hit, np.full(len(docs_hit), i)]) for i in items]
    hits = np.unique(np.concatenate(pairs, axis=1).T, axis=0) if pairs else np.zeros((0, 2), np.int64)
    return (np.cumsum(change[:-1]) > 0).astype(np.int8), hits


def window_table(items: DataFrame, item_col: str, item_text_col: str, size: int) -> DataFrame:
    """``(name, window)``, each once: the windows of all items with an id, words joined by blanks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cut = [[b" ".join(w) for w in item_windows(words_of(t), size)] for t in byte_values(batch.column(1))]
            row = np.repeat(np.arange(len(cut)), [len(x) for x in cut])
            windows = pa.array([w for own in cut for w in own], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), windows], ["name", "window"])

    named = items.where(F.col(item_col).isNotNull())
    name = F.to_json(item_col) if named.schema[item_col].dataType.typeName() in ("struct", "array", "map") else F.col(item_col).cast("string")
    return stored(named.select(name.alias("name"), F.col(item_text_col).alias("text")).mapInArrow(run, "name string, window binary").distinct(), "windows")


def _block_hits(index: DataFrame, rows: list[tuple[str, bytes]], slop: int) -> DataFrame:
    """``(row, id, n_words, spans, items)`` of each document for one block of windows; spans are merged runs of words hit."""
    names = sorted({n for n, _ in rows})
    number = {n: i for i, n in enumerate(names)}
    windows: dict[bytes, list[int]] = {}
    for n, window in rows:
        windows.setdefault(window, []).append(number[n])
    terms = frozenset(t for w in windows for t in w.split())
    sent_terms = index.sparkSession.sparkContext.broadcast(terms)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own, starts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                n = np.diff(np.frombuffer(starts, np.uint32).astype(np.int64))
                there = [(t, int(n[i])) for i, t in enumerate(own.split()) if t in sent_terms.value]
                yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in there], pa.binary()), pa.array([n for _, n in there], pa.int64())], ["term", "n"])

    found = index.select("terms", "starts").mapInArrow(count, "term binary, n bigint").groupBy("term").agg(F.sum("n").alias("n"))
    counts = {bytes(r.term): r.n for r in found.collect()}  # not more than the block has terms
    sent = index.sparkSession.sparkContext.broadcast((windows, counts, names))
    kind = index.schema["ids"].dataType.elementType.simpleString()
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows, counts, names = sent.value
        for batch in batches:
            shards, packed = batch.column(0).to_pylist(), [batch.column(i).to_pylist() for i in range(2, 6)]
            for at, (shard, raw_sizes, terms, starts, places) in enumerate(zip(shards, *packed)):
                sizes = np.frombuffer(raw_sizes, np.uint32).astype(np.int64)
                marks, hits = search_shard(postings_of(terms, starts, places, counts), sizes, windows, counts, slop)
                bases = np.concatenate(([0], np.cumsum(sizes + 1)))
                edge = np.flatnonzero(np.diff(marks, prepend=0, append=0))
                begin, end = edge[::2], edge[1::2]
                doc = np.searchsorted(bases, begin, "right") - 1
                spans: list[list] = [[] for _ in sizes]
                for d, s, e in zip(doc.tolist(), (begin - bases[doc]).tolist(), (end - bases[doc]).tolist()):
                    spans[d].append({"start": s, "end": e})
                items: list[list] = [[] for _ in sizes]
                for d, i in hits.tolist():
                    items[d].append(names[i])
                ids = batch.column(1).slice(at, 1).flatten()
                row = (shard >> 32 << 42 | (shard & 0xFFFFFFFF) << 22) + np.arange(len(sizes))  # a shard has no more documents than words
                columns = [pa.array(row, pa.int64()), ids, pa.array(sizes), pa.array(spans, span), pa.array(items, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(columns, ["row", "id", "n_words", "spans", "items"])
        release_memory()

    schema = f"row bigint, id {kind}, n_words bigint, spans array<struct<start:bigint,end:bigint>>, items array<string>"
    return index.mapInArrow(run, schema)


def _merged(lists):
    """One list of disjoint runs from several, as a column: overlapping and touching runs are joined."""
    runs = F.array_sort(F.flatten(lists))
    empty = F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)")

    def step(done, run):
        last = F.element_at(done, -1)
        joined = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], run["end"]).alias("end"))))
        return F.when((F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["end"] >= run["start"]), joined).otherwise(F.concat(done, F.array(run)))

    return F.aggregate(runs, empty, step)


def search_index(
    index: DataFrame, items: DataFrame, id_col: str = "doc_id", item_col: str = "item_id", item_text_col: str = "text", size: int = 10, slop: int = 0,
    block_chars: int = 64_000_000,
) -> DataFrame:
    """What :func:`decontaminate` returns, from an index of :func:`build_index`. Windows are taken in blocks of about ``block_chars`` bytes."""
    windows = window_table(items, item_col, item_text_col, size)
    total = windows.agg(F.sum(F.length("window") + F.length("name"))).first()[0] or 0
    blocks = -(-total // block_chars) or 1
    hits = None
    for i in range(blocks):
        own = windows if blocks == 1 else windows.where(F.pmod(F.xxhash64("window"), F.lit(blocks)) == i)
        one = _block_hits(index, [(r.name, bytes(r.window)) for r in own.collect()], slop)
        if blocks > 1:
            one = stored(one, "hits")
        hits = one if hits is None else hits.unionByName(one)
    if blocks > 1:
        lists = [_merged(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items")]
        hits = hits.groupBy("row").agg(F.first("id").alias("id"), F.first("n_words").alias("n_words"), *lists)
    n_hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])
    return hits.select(F.col("id").alias(id_col), "n_words", n_hit.alias("n_hit"), "spans", "items", (n_hit > 0).alias("contaminated"))


def decontaminate(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", size: int = 10,
    slop: int = 0, block_chars: int = 64_000_000, shard_words: int = 2_000_000,
) -> DataFrame:
    """One row per row of ``docs``: ``(id_col, n_words, n_hit, spans, items, contaminated)``.

    ``spans``: runs of words hit, as [start, end) word numbers, in order; ``n_hit`` is their total length.
    ``items``: ids, as strings in string order, of the items with a window that occurs; an id names one
    item, however often it is there, and items with a null id take no part. ``slop`` 0 asks for exact
    phrases; above that, for windows with each word at most ``slop`` places off; then the span is that of
    the undisturbed phrase. Null and empty texts have no words. Repeated rows give repeated results; other
    columns are ignored; either table may be empty. Ids of either table may be of any type; those of items that are
    structures are named by their JSON.
    """
    index = build_index(docs, id_col, text_col, shard_words)
    return search_index(index, items, id_col, item_col, item_text_col, size, slop, block_chars)


def op6_decontamination(spark, sf_dir: str) -> DataFrame:
    found = decontaminate(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    digest = F.sha2(F.array_join("items", ","), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), digest.alias("items_sha256"), "contaminated")


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = "regexp_extract_all(" + _LOWER + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP6_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
i AS (SELECT item_id, {_WORDS.format("coalesce(text, '')")} AS w FROM benchmark WHERE item_id IS NOT NULL),
iw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(list_slice(w, s, s + least(len(w), 10) - 1), ' ') AS g
       FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS s FROM i WHERE len(w) > 0)),
dw AS (SELECT r, s, n, array_to_string(list_slice(w, s, s + n - 1), ' ') AS g
       FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n)),
m AS (SELECT r, s, n, item_id FROM dw JOIN iw USING (n, g)),
h AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS p FROM (SELECT DISTINCT r, s, n FROM m)) GROUP BY r),
t AS (SELECT r, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS names FROM (SELECT DISTINCT r, item_id::VARCHAR AS k FROM m) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN t USING (r)
"""
