"""Near duplicates by SimHash, tested by the Jaccard similarity of word shingle sets.

Two sets of similarity ``s`` and like sizes stand at an angle of ``arccos(2 s / (1 + s))``, at 0.8 27.3 degrees (less, if
their sizes differ), so each bit of their SimHashes differs with probability 0.1515. A set has a fingerprint of 2,048 bits. It is
cut into 192 blocks of 16 bits (128 of bits that stand together, 64 of bits 128 apart), and two sets are a candidate pair if they
agree in a block and differ in 40 bits or fewer of the first 128. At 0.8 a pair fails one or the other with probability 4e-6, far
less above. In sets of under ten shingles counts tie often; such sets meet also by equality but for one shingle, which loses none.
A candidate pair must then pass a bound that loses nothing: a set's sketch is 512 bits, and each of its shingles turns over
one of them, so two sketches differ in no more bits than the sets differ in shingles. The pairs left are tested on
their whole shingle sets, so no pair below the threshold is linked.

Texts with equal sets are one row before anything is joined. Groups of near copies are linked first by
stars over 32 blocks of 24 bits: each text is tested against the text of its blocks that meets most others. Only pairs of different
stars are sought after that, by the blocks of 16 bits, in two steps. The first writes no pairs: a semi join tells which sets
have any candidate, by rows of 128 bits, and does not ask again for those that it has found. The second joins these sets alone, with sizes
and sketches in their rows, so that the bound is part of the join and pairs that it rules out are never written: in a group of
texts that are like each other but not like enough, these are nearly all pairs. They are still compared, as are sets that agree in a block
by chance, 0.003 times a pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from sparkloom.llm.arrow import byte_values, release_memory
from sparkloom.llm.simhash import FILTER_BITS, LONG, bits_of, first_of_each, in_bits, long_fingerprint, spread
from sparkloom.operators.components import connected_components
from sparkloom.session import shuffles_removed, stored

STARS = 32  # blocks of 24 bits
BLOCKS, PASS = 192, 32  # blocks of 16 bits, and how many are joined at once
TESTED = 128  # bits of a fingerprint that go along
SMALL = 9
SKETCH = 8  # words of 64 bits
_bits_of = bits_of


def shingle_set(text: bytes, width: int = 5, seed: int = 42) -> np.ndarray:
    """Sorted distinct hashes of lower-cased ``width``-word shingles; a shorter text is one shingle, one without words none."""
    words = text.lower().split()  # bytes, cut as in simhash.fingerprint_of
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    last = ends[width - 1 :] if len(words) >= width else ends[-1:]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(line[s:e], seed) for s, e in zip(starts.tolist(), last.tolist())), np.uint64, len(last)))


def star_blocks(words: np.ndarray) -> np.ndarray:
    """``STARS`` blocks of 24 bits of each row's fingerprint, numbered in the bits above these."""
    parts = words.view(np.uint8).reshape(len(words), -1)[:, : 3 * STARS].reshape(len(words), STARS, 3).astype(np.int64)
    return parts[:, :, 0] | parts[:, :, 1] << 8 | parts[:, :, 2] << 16 | np.arange(STARS) << 24


def search_blocks(words: np.ndarray, first: int = 0, to: int = BLOCKS) -> np.ndarray:
    """The blocks ``first`` to ``to`` of 16 bits of each row's fingerprint, numbered in the bits above these."""
    near = words.view(np.uint16).reshape(len(words), -1)
    bits = np.unpackbits(words.view(np.uint8).reshape(len(words), -1), axis=1, bitorder="little").reshape(len(words), 16, -1)
    apart = np.packbits(bits.transpose(0, 2, 1), axis=2, bitorder="little").reshape(len(words), -1).view(np.uint16)
    return np.concatenate((near, apart), axis=1)[:, first:to].astype(np.int64) | np.arange(first, to) << 16


def most_bits(percent: int) -> int:
    """Of ``TESTED`` bits as many as two sets of ``percent`` similarity may differ in: five deviations above the mean."""
    p = np.arccos(2 * percent / (100 + percent)) / np.pi
    return int(np.ceil(TESTED * p + 5 * np.sqrt(TESTED * p * (1 - p))))


def small_keys(hashes: np.ndarray) -> list[int]:
    """Keys of a set of ``SMALL`` shingles or fewer, and of it without each of them; none for others."""
    if not 1 < len(hashes) <= SMALL:
        return []
    return [_set_key(hashes), *(_set_key(np.delete(hashes, i)) for i in range(len(hashes)))]


def sketch_of(hashes: np.ndarray) -> np.ndarray:
    """Each shingle turns over one of the bits: whether a bit's number of shingles is odd."""
    odd = np.bincount((hashes >> np.uint64(55)).astype(np.int64), minlength=64 * SKETCH) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _set_key(hashes: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(hashes.tobytes())).view(np.int64))


def set_rows(docs: DataFrame, id_col: str, text_col: str, width: int, seed: int, mark: Column) -> DataFrame:
    """``(id, mark, row, fp, n, sketch, bits, small)`` of each row: ``row`` is a hash of id and text, ``fp`` names the
    shingle set, ``n`` is the set's size, ``bits`` its SimHash. Null text counts as empty."""
    long_list = pa.list_(pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(x, width, seed) for x in byte_values(batch.column(0))]
            made = [pa.array([_set_key(s) for s in sets], pa.int64()), pa.array(map(len, sets), pa.int64())]
            made += [pa.array([sketch_of(s) for s in sets], long_list), pa.array([long_fingerprint(s).tobytes() for s in sets], pa.binary())]
            made += [pa.array([small_keys(s) for s in sets], long_list)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *made], [*batch.schema.names[1:], "fp", "n", "sketch", "bits", "small"])
        release_memory()

    rows = docs.select(F.col(text_col).alias("text"), F.col(id_col).alias("id"), mark.alias("mark"), F.xxhash64(id_col, text_col).alias("row"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, mark bigint, row bigint, fp bigint, n bigint, sketch array<bigint>, bits binary, small array<bigint>")


def _in_blocks(nodes: DataFrame, blocks, tested: bool = False, known: Broadcast | None = None, only: Broadcast | None = None) -> DataFrame:
    """``nodes`` with a row for each ``block`` that ``blocks`` makes of a fingerprint, in place of ``bits``.

    ``tested`` adds the bits to test; words of a ``sketch`` become columns. ``known``: a bit set, which a column of that name
    tells of each ``fp``, 1 if it is there. ``only``: a bit set that leaves out all others.
    """
    kept = [c for c in nodes.columns if c not in ("bits", "sketch")]
    words = [f"s{i}" for i in range(TESTED // 64 * tested)]
    sketch = [f"k{i}" for i in range(SKETCH * ("sketch" in nodes.columns))]
    marks = ["known"] * (known is not None)
    names = [*kept, *words, *sketch, *marks]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if only is not None:
                batch = batch.filter(pa.array(in_bits(only.value, batch.column("fp"))))
            for at in range(0, len(batch), 2_000):
                part = batch.slice(at, 2_000)
                bits = np.frombuffer(b"".join(part.column("bits").to_pylist()), np.uint64).reshape(-1, LONG // 64)
                found = blocks(bits)
                columns = [part.column(c).to_numpy() for c in kept] + [bits[:, i].view(np.int64) for i in range(len(words))]
                if sketch:
                    columns += list(part.column("sketch").flatten().to_numpy().reshape(-1, SKETCH).T)
                if marks:
                    columns.append(in_bits(known.value, part.column("fp")).astype(np.int64))
                rows = [pa.array(np.repeat(c, found.shape[1])) for c in columns]
                yield pa.RecordBatch.from_arrays([*rows, pa.array(found.ravel().astype(np.int32))], [*names, "block"])
        release_memory()

    # no nulls: else Spark adds filters to one side of a join, and its sides no longer share a shuffle
    made = StructType([*(StructField(c, LongType(), False) for c in names), StructField("block", IntegerType(), False)])
    return nodes.select(*kept, *["sketch"] * bool(sketch), "bits").mapInArrow(run, made)


def _differing(words: str, many: int) -> Column:
    """Bits that differ in the columns ``words`` of the sides ``a`` and ``b``."""
    differ = F.lit(0)
    for i in range(many):
        differ = differ + F.bit_count(F.col(f"a.{words}{i}").bitwiseXOR(F.col(f"b.{words}{i}")))
    return differ


def sets_with_candidates(classed: DataFrame, percent: int) -> np.ndarray:
    """A bit set (as of :func:`simhash.bits_of`) of each ``fp`` of ``(fp, class, bits)`` rows that is in a candidate pair of different classes.

    Sets that share a bit with one of these are in it too.
    """
    context = classed.sparkSession.sparkContext
    found = np.zeros(FILTER_BITS >> 6, np.uint64)
    for first in range(0, BLOCKS, PASS):
        sent = context.broadcast(found)
        rows = _in_blocks(classed.select("fp", "class", "bits"), lambda words, first=first: search_blocks(words, first, first + PASS), tested=True, known=sent)
        a, b = rows.alias("a"), rows.alias("b")
        near = (F.col("a.class") != F.col("b.class")) & (F.col("a.fp") != F.col("b.fp")) & (_differing("s", TESTED // 64) <= most_bits(percent))
        unknown = 2 * F.col("a.known") <= F.col("b.known")  # whatever b is; all columns of both sides are used, so they share a shuffle
        own = a.join(b, (F.col("a.block") == F.col("b.block")) & unknown & near, "left_semi")
        found = found | bits_of(own.select(F.col("fp").alias("row")))
        sent.unpersist()
    return found


def pairs_in_blocks(classed: DataFrame, percent: int) -> DataFrame:
    """``(src, dst)``: the candidate pairs of ``(fp, class, n, sketch, bits)`` rows of different classes that are :func:`within_bound`; some repeat."""
    able = classed.sparkSession.sparkContext.broadcast(sets_with_candidates(classed, percent))
    found = None
    for first in range(0, BLOCKS, PASS):
        rows = _in_blocks(classed.select("fp", "class", "n", "sketch", "bits"), lambda words, first=first: search_blocks(words, first, first + PASS), tested=True, only=able)
        a, b = rows.alias("a"), rows.alias("b")
        near = (F.col("a.class") < F.col("b.class")) & (_differing("s", TESTED // 64) <= most_bits(percent))
        own = a.join(b, (F.col("a.block") == F.col("b.block")) & near & _may_be_alike("a.n", "b.n", _differing("k", SKETCH), percent))
        own = stored(own.select(F.col("a.fp").alias("src"), F.col("b.fp").alias("dst")), "near")
        found = own if found is None else found.unionByName(own)
    return found


def pairs_of_small(classed: DataFrame) -> DataFrame:
    """``(src, dst)``: pairs of ``(fp, class, small)`` rows of different classes whose sets are equal but for one shingle of each."""
    keyed = spread(classed.where("size(small) > 0").select("fp", "class", "small")).select("fp", "class", F.explode("small").alias("key"))
    a, b = keyed.alias("a"), keyed.alias("b")
    met = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.class") < F.col("b.class")))
    return met.select(F.col("a.fp").alias("src"), F.col("b.fp").alias("dst")).distinct()


def _sets_of(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, width: int, seed: int) -> DataFrame:
    """``(fp, hashes)`` of the sets whose ``(fp, row)`` is in ``wanted``.

    Which texts are cut again is told by a bit set of bounded size, so texts are not shuffled; the few that
    it lets pass in excess go in the join.
    """
    sent = docs.sparkSession.sparkContext.broadcast(bits_of(wanted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = sent.value
        for batch in batches:
            there = in_bits(bits, batch.column(1))
            sets = [shingle_set(x, width, seed) for x in byte_values(batch.column(0).filter(pa.array(there)))]
            hashes = pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array([_set_key(s) for s in sets], pa.int64()), hashes], ["fp", "hashes"])
        release_memory()

    made = docs.select(F.col(text_col).alias("text"), F.xxhash64(id_col, text_col).alias("row")).mapInArrow(run, "fp bigint, hashes array<bigint>")
    return made.join(wanted.select("fp"), "fp", "left_semi").groupBy("fp").agg(F.first("hashes").alias("hashes"))


def _alike(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``(src, dst)`` whose sets have that similarity or more."""
    a, b = sets.select(F.col("fp").alias("src"), F.col("hashes").alias("x")), sets.select(F.col("fp").alias("dst"), F.col("hashes").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    held = pairs.join(a, "src").join(b, "dst").select("src", "dst", both.alias("both"), (F.size("x") + F.size("y")).alias("sum"))
    return held.where(100 * F.col("both") >= percent * (F.col("sum") - F.col("both"))).select("src", "dst")


def _may_be_alike(n: str, m: str, differ: Column, percent: int) -> Column:
    sizes = 100 * F.least(n, m) >= percent * F.greatest(n, m)
    return sizes & ((100 + percent) * differ <= (100 - percent) * (F.col(n) + F.col(m)))


def within_bound(n: str, m: str, x: str, y: str, percent: int) -> Column:
    """What holds for all pairs of ``percent`` similarity or more: their sizes are near, and their sketches differ in
    no more bits than sets of these sizes may differ in shingles."""
    bits = F.lit(0)
    for i in range(SKETCH):
        bits = bits + F.bit_count(F.col(x)[i].bitwiseXOR(F.col(y)[i]))
    return _may_be_alike(n, m, bits, percent)


def _bounded(nodes: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """Those rows of ``pairs`` whose sizes and sketches are :func:`within_bound`."""
    a, b = nodes.select(F.col("fp").alias("src"), "n", F.col("sketch").alias("x")), nodes.select(F.col("fp").alias("dst"), F.col("n").alias("m"), F.col("sketch").alias("y"))
    return pairs.join(a, "src").join(b, "dst").where(within_bound("n", "m", "x", "y", percent)).select(*pairs.columns)


def _stars(nodes: DataFrame, percent: int) -> DataFrame:
    """``(src, dst)``: of each set the one within the bound, among those that meet most others in its blocks of 24 bits."""
    keyed = _in_blocks(spread(nodes.select("fp", "bits")), star_blocks)
    shared = keyed.groupBy("block").agg(F.count("*").alias("members")).where("members > 1")
    met = stored(keyed.join(shared, "block").select("fp", "block", "members"), "met")
    ranked = met.join(met.groupBy("fp").agg(F.sum("members").alias("degree")), "fp").select("fp", "block", "degree")
    tops = ranked.groupBy("block").agg(F.max(F.struct("degree", "fp")).alias("top"))
    near = met.join(tops, "block").where(F.col("fp") != F.col("top.fp")).select(F.col("fp").alias("src"), F.col("top.fp").alias("dst"), F.col("top.degree").alias("degree")).distinct()
    best = _bounded(nodes, near, percent).groupBy("src").agg(F.max(F.struct("degree", "dst")).alias("top"))
    return best.select("src", F.col("top.dst").alias("dst"))


def similar_classes(docs: DataFrame, rows: DataFrame, id_col: str, text_col: str, width: int, percent: int, seed: int) -> DataFrame:
    """``(fp, root)`` of each distinct set of ``rows``: sets chained by steps of ``percent`` similarity or more share a root."""
    picked = [F.min("row").alias("row"), *(F.first(c).alias(c) for c in ("n", "sketch", "bits", "small"))]
    nodes = stored(rows.groupBy("fp").agg(*picked), "nodes")
    able = nodes.where(F.col("n") * (100 - percent) >= percent)  # a smaller set is like no other, and a larger has such a set's neighbours only
    stars = stored(_stars(able, percent), "stars")
    linked = stored(_verified(docs, nodes, stars, id_col, text_col, width, percent, seed), "linked")
    classes = connected_components(linked)

    classed = able.join(classes, able.fp == classes.node, "left").select("fp", F.coalesce("component", "fp").alias("class"), "n", "sketch", "bits", "small")
    classed = stored(spread(classed), "classed")  # in many files, as each pass makes many rows of one
    near = pairs_in_blocks(classed, percent).unionByName(_bounded(nodes, pairs_of_small(classed), percent))
    pairs = stored(near.distinct(), "pairs")
    crossed = stored(_verified(docs, nodes, pairs, id_col, text_col, width, percent, seed), "crossed")
    merged = connected_components(linked.unionByName(crossed))
    return nodes.join(merged, nodes.fp == merged.node, "left").select("fp", F.coalesce("component", "fp").alias("root"))


def _verified(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, id_col: str, text_col: str, width: int, percent: int, seed: int) -> DataFrame:
    """The ``pairs`` that hold on whole shingle sets."""
    ends = pairs.select(F.explode(F.array("src", "dst")).alias("fp")).distinct()
    wanted = stored(nodes.select("fp", "row").join(ends, "fp", "left_semi"), "wanted")
    sets = stored(_sets_of(docs, wanted, id_col, text_col, width, seed), "sets")
    return _alike(pairs, sets, percent)


def one_of_each_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80, seed: int = 42) -> DataFrame:
    """``docs`` without near duplicates: pairs found by SimHash whose sets of ``width``-word shingles have a Jaccard similarity of
    ``percent`` or more are linked, and of each component one row stays, as in :func:`simhash.first_of_each`.
    Null and texts without words are alike. All columns stay, whatever their names; an empty table stays empty.
    """
    with shuffles_removed(docs.sparkSession):
        rows = stored(set_rows(docs, id_col, text_col, width, seed, F.xxhash64(text_col)), "shingled")
        classes = similar_classes(docs, rows, id_col, text_col, width, percent, seed)
        return first_of_each(docs, rows.select("id", "mark", "fp"), classes, id_col, text_col)
