"""Stupid-backoff scores from the corpus's own n-gram counts.

Documents are packed into blocks: a block's distinct words as 64-bit hashes and its texts as word numbers.
For each order a block's n-grams (hashes chained over word hashes) are counted within the block and cut
into buckets by ranges of the hash. A count table, partitioned by these buckets, sums all blocks' rows; joined back to
the exploded n-grams of each block it gives every n-gram its corpus count, and a block's scores are summed
per document. Rows of these tables are arrays of sorted keys and counts rather than single n-grams: a
row per n-gram and document would take several times the disk and time.

An n-gram is on the corpus often enough to be scored only if both shorter ones in it are. So 1- and 2-grams
are counted in full, and of each higher order those that the order below leaves.

No key is hot: a block sends one row per bucket and order, with each n-gram once.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.arrow import byte_values
from sparkloom.session import scratch_dir, stored


def block_table(docs: DataFrame, id_col: str, text_col: str, block_words: int) -> DataFrame:
    """``(block, ids, sizes, vocab, words)``: texts of about ``block_words`` words to a block, lower-cased
    (A-Z) and cut at ASCII white space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        ids: list = []
        sizes: list[int] = []
        number: dict[bytes, int] = {}
        texts: list[np.ndarray] = []
        held = 0

        def close() -> pa.RecordBatch:
            vocab = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in number), np.uint64, len(number))
            words = np.concatenate(texts) if texts else np.zeros(0, np.uint32)
            values = [[part << 32 | seq], [ids], [np.array(sizes, np.uint32).tobytes()], [vocab.tobytes()], [packed_words(words)], [len(words)]]
            kinds = [pa.int64(), pa.list_(pa.string()), pa.binary(), pa.binary(), pa.binary(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds)], ["block", "ids", "sizes", "vocab", "words", "n"])

        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), byte_values(batch.column(1))):
                words = text.lower().split()
                for w in words:
                    if w not in number:
                        number[w] = len(number)
                texts.append(np.fromiter(map(number.__getitem__, words), np.uint32, len(words)))
                ids.append(key)
                sizes.append(len(words))
                held += len(words)
                if held >= block_words:
                    yield close()
                    ids, sizes, number, texts, held, seq = [], [], {}, [], 0, seq + 1
        if ids:
            yield close()

    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "block bigint, ids array<string>, sizes binary, vocab binary, words binary, n bigint")


def _mixed(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    x = (before * np.uint64(0x9E3779B97F4A7C15)) ^ word
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def packed_words(words: np.ndarray) -> bytes:
    """Word numbers byte by byte of all: frequent words have low numbers, so the high bytes compress well."""
    return np.ascontiguousarray(words.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def unpacked_words(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def gram_places(sizes: bytes, vocab: bytes, words: bytes, order: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For k from 1: the hash of the ``k``-gram that ends at each place of a block, and the places where its
    document is that long yet. An order's arrays go before the next one's come."""
    word = np.frombuffer(vocab, np.uint64)[unpacked_words(words)]
    size = np.frombuffer(sizes, np.uint32).astype(np.int64)
    starts = np.concatenate((np.zeros(1, np.int64), np.cumsum(size)))[:-1]
    gram, here = word, np.ones(len(word), bool)
    for k in range(1, order + 1):
        if k > 1:
            before = np.empty_like(gram)
            before[1:], before[:1] = gram[:-1], 0
            gram = _mixed(before, word)
            del before
            here[starts[size >= k - 1] + k - 2] = False
        yield k, gram, here


def packed_keys(keys: np.ndarray) -> bytes:
    """Sorted keys as differences, byte by byte of all: the high bytes are zero and compress to nothing."""
    return np.ascontiguousarray(np.diff(keys, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T).tobytes()


def unpacked_keys(raw: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view(np.uint64).ravel(), dtype=np.uint64)


def packed_counts(counts: np.ndarray) -> bytes:
    """Counts in the narrowest unsigned type that holds them all, after a byte that tells its width."""
    kind = np.min_scalar_type(int(counts.max(initial=0)))
    return bytes([kind.itemsize]) + counts.astype(kind).tobytes()


def unpacked_counts(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, f"<u{raw[0]}", offset=1)


def bucket_cuts(keys: np.ndarray, buckets: int) -> list[tuple[int, int, int]]:
    """``(bucket, from, to)`` of the buckets, ranges of the key, that have some of the sorted ``keys``."""
    bucket = ((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
    cuts = np.concatenate(([0], np.flatnonzero(np.diff(bucket)) + 1, [len(keys)])).tolist()
    return [(int(bucket[a]), a, b) for a, b in zip(cuts, cuts[1:]) if b > a]


def survivors(here: np.ndarray, before: np.ndarray | None, least: int) -> np.ndarray:
    """Places whose ``k``-gram can be on the corpus ``least`` times: both ``k - 1``-grams in it are, by their counts ``before``."""
    if before is None:
        return here.copy()
    often = before >= least
    out = here & often
    out[1:] &= often[:-1]
    return out


def counts_of(keys: np.ndarray, held: dict, k: int, buckets: int) -> np.ndarray:
    """The corpus counts of sorted distinct ``keys``; ``held`` has packed totals by (k, bucket)."""
    cuts = bucket_cuts(keys, buckets) if len(keys) else []
    return np.concatenate([np.zeros(0), *(unpacked_counts(held[k, b]) for b, _, _ in cuts)])


def counts_at(gram: np.ndarray, there: np.ndarray, held: dict, k: int, buckets: int) -> np.ndarray:
    """The corpus count of the ``k``-gram at each place of ``there``, 0 elsewhere."""
    own = gram[there]
    order = np.argsort(own)
    own = own[order]
    first = np.ones(len(own), bool)
    first[1:] = own[1:] != own[:-1]
    count = counts_of(own[first], held, k, buckets)
    found = np.empty(len(own))
    found[order] = count[np.cumsum(first) - 1] if len(count) else 0.0
    f = np.zeros(len(gram))
    f[there] = found
    return f


def word_counts(row, held: dict, buckets: int) -> np.ndarray:
    """The corpus count of the word at each place."""
    vocab = np.frombuffer(row["vocab"], np.uint64)
    keys, at = np.unique(vocab, return_inverse=True)
    return counts_of(keys, held, 1, buckets)[at][unpacked_words(row["words"])]


def _rows_of(name: int, k: int, gram: np.ndarray, buckets: int) -> list[tuple]:
    keys, counts = np.unique(gram, return_counts=True)
    return [(name, k, b, packed_keys(keys[s:e]), packed_counts(counts[s:e])) for b, s, e in bucket_cuts(keys, buckets)] if len(keys) else []


CUT = "block bigint, k int, bucket int, keys binary, counts binary"


def first_cuts(blocks: DataFrame, order: int, buckets: int) -> DataFrame:
    """The 1- and 2-grams of each block, all of them, cut into buckets."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
        for batch in batches:
            for name, *parts in zip(*(batch.column(i).to_pylist() for i in range(4))):
                for k, gram, here in gram_places(*parts, min(order, 2)):
                    if out := _rows_of(name, k, gram[here], buckets):
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], ["block", "k", "bucket", "keys", "counts"])

    return blocks.select("block", "sizes", "vocab", "words").mapInArrow(cut, CUT)


def next_cuts(blocks: DataFrame, totals: DataFrame, k: int, least: int, buckets: int) -> DataFrame:
    """The ``k``-grams of each block that can be there ``least`` times, by the totals of all shorter ones, cut into buckets."""

    def cut(rows: pd.DataFrame, totals: pd.DataFrame) -> pd.DataFrame:
        row = rows.iloc[0]
        held = dict(zip(zip(totals["k"], totals["bucket"]), totals["totals"]))
        before, out = None, []
        for n, gram, here in gram_places(row["sizes"], row["vocab"], row["words"], k):
            there = survivors(here, before, least)
            if n == k:
                out = _rows_of(row["block"], k, gram[there], buckets)
            elif n > 1:  # counts of words leave nothing out
                before = counts_at(gram, there, held, n, buckets)
        return pd.DataFrame(out, columns=["block", "k", "bucket", "keys", "counts"])

    return blocks.groupBy("block").cogroup(totals.groupBy("block")).applyInPandas(cut, CUT)


def count_table(cuts: DataFrame) -> DataFrame:
    """``(block, k, bucket, totals)``: the corpus counts of a block's distinct n-grams in that bucket, by key."""

    def total(rows: pd.DataFrame) -> pd.DataFrame:
        each = [unpacked_keys(x) for x in rows["keys"]]
        _, where = np.unique(np.concatenate(each), return_inverse=True)
        sums = np.bincount(where, weights=np.concatenate([unpacked_counts(x) for x in rows["counts"]]))[where].astype(np.uint64)
        own = np.split(sums, np.cumsum([len(x) for x in each])[:-1])
        return pd.DataFrame({"block": rows["block"], "k": rows["k"], "bucket": rows["bucket"], "totals": [packed_counts(x) for x in own]})

    return cuts.groupBy("k", "bucket").applyInPandas(total, "block bigint, k int, bucket int, totals binary")


def bucketed(blocks: DataFrame) -> DataFrame:
    """``blocks`` written so that its rows are dealt out by ``block`` already: it is joined by block several times, and never shuffled."""
    spark = blocks.sparkSession
    name, parts = f"loom_blocks_{uuid.uuid4().hex}", 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks.write.option("compression", "zstd").option("path", f"{scratch_dir(spark)}/blocks").bucketBy(parts, "block").sortBy("block").saveAsTable(name)
    table = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # its files stay, and so does the reading plan
    return table


def lm_scores(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = 3, alpha: float = 0.4, min_count: int = 2,
    block_words: int = 3_000_000, bucket_keys: int = 1_000_000,
) -> DataFrame:
    """``(id_col, n_words, score)`` of each row; ``score`` is the sum of its words' natural log scores.

    A word's score is f(its k-gram) / f(the k-gram without its last word) for the longest k of at most
    ``order`` that its place in the document allows; where k is over 1 and f(its k-gram) is under
    ``min_count``, it is ``alpha`` times the score at k - 1. At 1 it is f(word) / all words. Counts f are
    over all rows of ``docs``. Null and empty texts have no words and score 0. Repeated rows count and
    score each for itself; other columns are ignored; an empty table gives none.

    N-grams are told apart by 64-bit hashes: of n distinct ones, each shares its hash with another with a
    probability of n / 2**64, which is 5e-8 for 10**12 of them.
    """
    least = max(1, min_count)
    blocks = bucketed(block_table(docs, id_col, text_col, block_words))
    words = blocks.agg(F.sum("n")).first()[0] or 0
    buckets = max(1, -(-words * min(order, 2) // bucket_keys))
    packed = blocks.select("block", "ids", "sizes", "vocab", "words")
    totals = stored(count_table(first_cuts(blocks, order, buckets)), "totals")
    for k in range(3, order + 1):
        cuts = next_cuts(packed, totals, k, least, buckets)
        totals = totals.unionByName(stored(count_table(cuts), "totals"))

    def score(rows: pd.DataFrame, totals: pd.DataFrame) -> pd.DataFrame:
        row = rows.iloc[0]
        held = dict(zip(zip(totals["k"], totals["bucket"]), totals["totals"]))
        before = s = None
        for k, gram, here in gram_places(row["sizes"], row["vocab"], row["words"], order):
            if k == 1:
                f = word_counts(row, held, buckets)
                s = f / max(1, words)
            else:
                counted = survivors(here, before if k > 2 else None, least)
                f = counts_at(gram, counted, held, k, buckets)
                seen = counted & (f >= min_count)
                s[here & ~seen] *= alpha
                at = np.flatnonzero(seen)
                s[at] = f[at] / before[at - 1]
            before = f
        logs, size = np.log(s), np.frombuffer(row["sizes"], np.uint32).astype(np.int64)
        scores = [float(logs[e - z : e].sum()) for e, z in zip(np.cumsum(size).tolist(), size.tolist())]
        return pd.DataFrame({"id": pd.Series(list(row["ids"]), dtype=object), "n_words": size, "score": scores})

    kind = docs.schema[id_col].dataType.simpleString()
    found = packed.groupBy("block").cogroup(totals.groupBy("block")).applyInPandas(score, "id string, n_words bigint, score double")
    return found.select(F.col("id").cast(kind).alias(id_col), "n_words", "score")


def op10_lm_scoring(spark, sf_dir: str) -> DataFrame:
    found = lm_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_words", F.round("score", 4).alias("lm_score"))


OP10_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id,
           regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
t AS (SELECT r, unnest(w) AS w, unnest(range(1, len(w) + 1)) AS p FROM d),
g AS (SELECT r, p, w, lag(w) OVER (PARTITION BY r ORDER BY p) AS v, lag(w, 2) OVER (PARTITION BY r ORDER BY p) AS x FROM t),
u AS (SELECT w, count(*) AS n FROM t GROUP BY w),
b AS (SELECT v, w, count(*) AS n FROM g WHERE v IS NOT NULL GROUP BY v, w),
c AS (SELECT x, v, w, count(*) AS n FROM g WHERE x IS NOT NULL GROUP BY x, v, w),
s AS (SELECT g.r, ln(CASE WHEN c.n >= 2 THEN c.n / bb.n ELSE CASE WHEN g.x IS NULL THEN 1.0 ELSE 0.4 END::DOUBLE
             * CASE WHEN b.n >= 2 THEN b.n / uu.n ELSE CASE WHEN g.v IS NULL THEN 1.0 ELSE 0.4 END::DOUBLE * u.n / (SELECT count(*) FROM t) END END) AS l
      FROM g JOIN u ON g.w = u.w LEFT JOIN b ON g.v = b.v AND g.w = b.w LEFT JOIN u AS uu ON g.v = uu.w
      LEFT JOIN c ON g.x = c.x AND g.v = c.v AND g.w = c.w LEFT JOIN b AS bb ON g.x = bb.v AND g.v = bb.w)
SELECT doc_id, len(d.w)::BIGINT AS n_words, round(coalesce(l, 0), 4) AS lm_score FROM d LEFT JOIN (SELECT r, sum(l) AS l FROM s GROUP BY r) USING (r)
"""
