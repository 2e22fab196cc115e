"""SimHash near-duplicate classes.

A fingerprint is embedded as the bit counts of its 32 two-bit segments. The Manhattan distance of two
such vectors never exceeds the Hamming distance of the fingerprints, so it serves as a lower bound: pairs
are sought on a grid of unit cells in blocks of segments, tested with the bound, then verified exactly.

By pigeonhole, two fingerprints at most ``k`` bits apart lie at most ``k // g`` apart in one of ``g``
blocks of segments; ``g`` is chosen so that this is 2 or less, and then a cell exists that is one step or
less from both. Each fingerprint is entered in its own cell and those one step away (about 25 cells a
block), and one equi-join on the cell finds every candidate.

Exact copies share a fingerprint and are one row before anything is joined. Dense groups of near copies
are linked first by stars over fingerprints that agree outside one window of ``k`` bits (any two of which
are within ``k``), so that the grid join only needs pairs between different stars.

Sets of shingles far less alike than that are found by longer fingerprints (:func:`long_fingerprint`), by
equality of one of many blocks of their bits; :mod:`sparkloom.llm.jaccard` tests what they find on the sets.

Joins of tables that grow with the corpus are merge joins by a hint: fingerprints are small in their files, and Spark, which takes a
join's size from there, would send millions of exploded rows through the driver just before the files are large enough to stop it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.llm.arrow import byte_values, free_names, release_memory
from sparkloom.operators.components import connected_components
from sparkloom.session import stored

LOW = 0x5555555555555555
CHUNK = 1 << 15
LONG = 2048  # bits of a long fingerprint
MULTIPLIERS = np.random.default_rng(42).integers(0, 1 << 63, LONG // 64, np.uint64) * np.uint64(2) + np.uint64(1)
FILTER_BITS = 1 << 26


def fingerprint_of(text: bytes, width: int = 4, seed: int = 42) -> int:
    """64-bit SimHash of lower-cased ``width``-word shingles, repeats included; 0 if there is no word."""
    words = text.lower().split()  # bytes: lower() changes A-Z only, split() cuts at 0x20 and 0x09-0x0D
    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    counts = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, CHUNK):
        to = min(n, at + CHUNK)
        last = ends[at + width - 1 : to + width - 1] if len(words) >= width else ends[-1:]
        h = np.fromiter([digest(line[s:e], seed) for s, e in zip(starts[at:to].tolist(), last.tolist())], np.uint64, to - at)
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def long_fingerprint(hashes: np.ndarray) -> np.ndarray:
    """SimHash of ``LONG`` bits of a set of 64-bit hashes, as unsigned words: each hash is multiplied to a row of bits, and a
    bit is 1 if set in over half of the rows."""
    counts = np.zeros(LONG, np.int64)
    for at in range(0, len(hashes), 255):  # the sum of 255 bits fits the byte that it is made in
        x = np.multiply.outer(hashes[at : at + 255], MULTIPLIERS)
        x ^= x >> np.uint64(32)
        bits = np.unpackbits(x.view(np.uint8), axis=1, bitorder="little")
        counts += bits.view(np.uint64).sum(0).view(np.uint8)
    return np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.uint64)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, seed: int = 42, also: dict[str, Column] | None = None) -> DataFrame:
    """``(id, fp)`` of each row, and the columns ``also``; ``fp`` is the fingerprint as a signed long. Null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint_of(x, width, seed) for x in byte_values(batch.column(0))], np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(found.view(np.int64))], [*batch.schema.names[1:], "fp"])
        release_memory()

    rows = docs.select(F.col(text_col).alias("text"), F.col(id_col).alias("id"), *[c.alias(name) for name, c in (also or {}).items()])
    return rows.mapInArrow(run, ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema[1:]), "fp bigint"]))


def segment_counts(fp: Column) -> Column:
    """Bit counts of the 32 two-bit segments, each in unary (0, 01, 11), so that XOR and bit count give Manhattan distance."""
    up = F.shiftrightunsigned(fp, 1)
    return fp.bitwiseOR(up).bitwiseAND(F.lit(LOW)).bitwiseOR(F.shiftleft(fp.bitwiseAND(up).bitwiseAND(F.lit(LOW)), 1))


def spread(fps: DataFrame) -> DataFrame:
    """A small table dealt out by fingerprint before its rows are multiplied; a given number of parts is not merged again."""
    return fps.repartition(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _cells(fps: DataFrame, k: int) -> DataFrame:
    """``fps`` with a row for each grid cell ``(block, cell)`` that it is entered in."""
    blocks = max(1, -(-(k + 1) // 3))
    step = 1 if k // blocks else 0
    cuts = [2 * (32 * i // blocks) for i in range(blocks + 1)]
    lists = []
    for i in range(blocks):
        mask = F.lit(_signed(((1 << cuts[i + 1]) - 1) ^ ((1 << cuts[i]) - 1)))
        own = segment_counts(F.col("fp")).bitwiseAND(mask)
        near = [own] + [own.bitwiseXOR(F.lit(_signed(1 << j))) for j in range(cuts[i], cuts[i + 1])] * step
        block = F.lit(i).alias("block")
        lists.append(F.array(*[F.struct(block, c.alias("cell")) for c in near]))

    def valid(e: Column) -> Column:  # a high unary bit needs its low bit
        c = e["cell"]
        return F.shiftrightunsigned(c, 1).bitwiseAND(F.lit(LOW)).bitwiseAND(F.bitwise_not(c)) == 0

    return spread(fps.select("fp", "class")).select("fp", "class", F.explode(F.filter(F.concat(*lists), valid)).alias("e")).select("fp", "class", "e.block", "e.cell")


def links_between(fps: DataFrame, k: int) -> DataFrame:
    """Pairs of classes with fingerprints ``k`` bits apart or less: ``(src, dst)`` of ``(fp, class)`` rows."""
    cells = _cells(fps, k)
    a, b = cells.alias("a"), cells.hint("merge").alias("b")
    x, y = F.col("a.fp"), F.col("b.fp")
    bound = F.bit_count(segment_counts(x).bitwiseXOR(segment_counts(y))) <= k
    exact = F.bit_count(x.bitwiseXOR(y)) <= k
    meet = (F.col("a.block") == F.col("b.block")) & (F.col("a.cell") == F.col("b.cell"))
    return a.join(b, meet & (x < y) & (F.col("a.class") != F.col("b.class")) & bound & exact).select(F.col("a.class").alias("src"), F.col("b.class").alias("dst")).distinct()


def _stars(fps: DataFrame, k: int) -> DataFrame:
    """Edges from each fingerprint to the least one that agrees with it outside a window of ``k`` bits."""
    masks = [_signed(((1 << 64) - 1) ^ (((1 << 64) - 1) & (((1 << k) - 1) << at))) for at in range(0, 64, k)]
    keys = F.array(*[F.struct(F.lit(i).alias("w"), F.col("fp").bitwiseAND(F.lit(m)).alias("rest")) for i, m in enumerate(masks)])
    rows = spread(fps.select("fp")).select("fp", F.explode(keys).alias("key")).select("fp", "key.w", "key.rest")
    least = rows.groupBy("w", "rest").agg(F.min("fp").alias("dst"), F.max("fp").alias("top")).where("dst < top").drop("top")
    return rows.join(least.hint("merge"), ["w", "rest"]).where("fp <> dst").select(F.col("fp").alias("src"), "dst").distinct()


def near_duplicate_classes(fps: DataFrame, k: int = 4) -> DataFrame:
    """``(fp, root)`` of each distinct fingerprint: fingerprints chained by steps of ``k`` bits or less share a root."""
    one = fps.select("fp").distinct()
    if k > 0:
        stars = connected_components(_stars(one, k), "src", "dst")
        one = stored(one.join(stars.hint("merge"), one.fp == stars.node, "left").select("fp", F.coalesce("component", "fp").alias("class")), "stars")
    else:
        return one.select("fp", F.col("fp").alias("root"))
    merged = connected_components(links_between(one, k), "src", "dst")
    return one.join(merged.hint("merge"), one["class"] == merged.node, "left").select("fp", F.coalesce("component", "class").alias("root"))


def _classed(docs: DataFrame, id_col: str, text_col: str, width: int, k: int, seed: int, also: dict[str, Column] | None = None) -> tuple[DataFrame, DataFrame]:
    """The rows of :func:`fingerprints`, and ``(fp, root, component_id)`` of each distinct fingerprint."""
    rows = stored(fingerprints(docs, id_col, text_col, width, seed, also), "fingerprints")
    least = stored(rows.groupBy("fp").agg(F.min("id").alias("least")), "least")
    classes = stored(near_duplicate_classes(least, k).join(least.hint("merge"), "fp"), "classes")
    first = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows, classes.join(first.hint("merge"), "root").select("fp", "root", "component_id")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, k: int = 4, seed: int = 42) -> DataFrame:
    """``(id_col, fingerprint, component_id)`` for each row of ``docs``.

    ``fingerprint``: 16 lowercase hex digits. ``component_id``: the smallest id reachable over links of
    ``k`` differing bits or less, its own included. Null and empty texts have fingerprint zero and are
    linked like any other; rows with a null id take part, but name a component only if all its ids are
    null. Repeated rows give repeated results; other columns are ignored; an empty table gives none.
    """
    rows, named = _classed(docs, id_col, text_col, width, k, seed)
    return rows.join(named.hint("merge"), "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def bits_of(rows: DataFrame, bits: int = FILTER_BITS) -> np.ndarray:
    """A bit set of a fixed size with the bits that the hashes ``row`` name; at most ``bits / 64`` words go to the driver."""
    at = F.pmod("row", F.lit(bits))
    found = rows.select(F.shiftright(at, 6).alias("word"), F.expr(f"shiftleft(1L, int(pmod(row, {bits}L) & 63))").alias("bit"))
    words = found.groupBy("word").agg(F.bit_or("bit").alias("bits")).toPandas()
    out = np.zeros(bits >> 6, np.int64)
    out[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64)
    return out.view(np.uint64)


def in_bits(bits: np.ndarray, column: pa.Array) -> np.ndarray:
    """Whether the bit that each hash of ``column`` names is set."""
    at = np.mod(column.to_numpy(), len(bits) << 6).astype(np.uint64)
    return ((bits[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1)).astype(bool)


def split_by(docs: DataFrame, hashed: Column, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``docs`` in two: those whose hash may be a ``row`` of ``rows``, all that are and a few others, and those whose hash is none."""
    sent = docs.sparkSession.sparkContext.broadcast(bits_of(rows))
    (own,) = free_names(docs, "hashed")
    marked = docs.withColumn(own, hashed)

    def taking(there: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bits = sent.value
            for batch in batches:
                held = batch.filter(pa.array(in_bits(bits, batch.column(batch.num_columns - 1)) == there))
                if held.num_rows:
                    yield pa.RecordBatch.from_arrays(held.columns[:-1], held.schema.names[:-1])
            release_memory()

        return marked.mapInArrow(run, docs.schema)

    return taking(True), taking(False)


def first_of_each(docs: DataFrame, rows: DataFrame, classes: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Of each class the row of ``docs`` with the smallest id stays, null ids last.

    ``rows``: ``(id, mark, fp)`` of each row of ``docs``, where ``mark`` is ``xxhash64`` of its text;
    ``classes``: ``(fp, root)``. Rows with that id and different texts are told apart by the mark; of rows
    with the same id and text one stays. All columns stay. The rows that go are told by a bit set of bounded
    size, and only those that it lets pass are joined to ``docs``, so other texts are not shuffled.
    """
    mark = F.xxhash64(text_col)
    gone_id, gone_mark, own_mark, number = free_names(docs, "gone_id", "gone_mark", "mark", "number")
    keyed = rows.groupBy("fp", "id", "mark").agg(F.count("*").alias("n")).join(classes, "fp")
    keyed = stored(keyed.select("root", F.struct(F.col("id").isNull().alias("none"), "id", "mark").alias("key"), "n"), "keyed")
    first = keyed.groupBy("root").agg(F.min("key").alias("first"))
    gone = keyed.join(first, "root").where(F.col("key") != F.col("first"))
    gone = stored(gone.select(F.col("key.id").alias(gone_id), F.col("key.mark").alias(gone_mark)), "gone")
    may_go, stay = split_by(docs, F.xxhash64(F.col(id_col), mark), gone.select(F.xxhash64(gone_id, gone_mark).alias("row")))
    kept = stay.union(may_go.join(gone, F.col(id_col).eqNullSafe(F.col(gone_id)) & (mark == F.col(gone_mark)), "left_anti"))
    if keyed.where("n > 1").limit(1).count():
        at = F.row_number().over(Window.partitionBy(F.col(id_col), F.col(own_mark)).orderBy(F.col(own_mark)))
        kept = kept.withColumn(own_mark, mark).withColumn(number, at).where(F.col(number) == 1).drop(own_mark, number)
    return kept


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, k: int = 4, seed: int = 42) -> DataFrame:
    """``docs`` without near duplicates by fingerprint: of each component one row stays, as in :func:`first_of_each`."""
    rows, named = _classed(docs, id_col, text_col, width, k, seed, {"mark": F.xxhash64(text_col)})
    return first_of_each(docs, rows, named.select("fp", "root"), id_col, text_col)


def op1_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    return simhash_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
