"""Exact Jaccard join of n-gram sets by prefix trees.

One order holds for all n-grams: by the count of the bucket that an n-gram's hash falls in, over the whole
corpus, then by the hash. Two sets of similarity ``t`` share one of the first ``n - ceil(t n) + 1`` n-grams in that
order, rarest first, so only these are compared between documents; any order gives the same links, and this one keeps
common passages out of them.

Sets are tested in a tree: those that may link to the same set are put in a trie, commonest n-grams first,
where near copies share long paths. The trie is walked once against that set; the overlap of a path is counted
once for all sets below it, and a subtree is left as soon as the n-grams that remain cannot bring the overlap
to what is needed. The trie is held as its sorted sequences and the lengths of their common beginnings.

Equal sets are one row before anything is joined. Sets are first tested against the set of their n-grams that
meets most others, which links groups of near copies as stars; after that only sets of
different classes that share an n-gram are paired, under a bound on their sizes and sketches that is part of the join. Before whole sets
are fetched, a pair must have enough of its first n-grams in common: the bound of :func:`_reachable`, which loses nothing either.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.llm.arrow import byte_values, release_memory
from sparkloom.llm.jaccard import _bits_of, sketch_of, within_bound
from sparkloom.operators.components import connected_components
from sparkloom.session import stored

BUCKETS = 18  # bits of a hash that name its bucket
MEMO = 1 << 20  # words that a worker remembers
STEP = 512  # n-grams of a path that are looked up at once
BLOCK = 1 << 21  # n-grams of the sets in one trie


class WordHashes(dict):
    """64-bit hashes of words, remembered."""

    def __init__(self, seed: int):
        super().__init__()
        self.seed = seed

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word, self.seed)
        return found


def _multipliers(width: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 63, width, np.uint64) * np.uint64(2) + np.uint64(1)


def gram_set(text: bytes, width: int, hashes: WordHashes, multipliers: np.ndarray) -> np.ndarray:
    """Sorted distinct 64-bit hashes of lower-cased ``width``-word n-grams; a shorter text is one, one without words none."""
    words = text.lower().split()  # bytes: lower() changes A-Z only, split() cuts at 0x20 and 0x09-0x0D
    if not words:
        return np.zeros(0, np.uint64)
    ids = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    m = min(width, len(ids))
    out = np.full(len(ids) - m + 1, m, np.uint64)
    for j in range(m):
        out += ids[j : len(ids) - m + 1 + j] * multipliers[j]
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xD6E8FEB86659FD93)
    out ^= out >> np.uint64(32)
    return np.unique(out)


def prefix_length(n: int, percent: int) -> int:
    """So many first n-grams of a set of ``n``: one of them is in any set of that similarity."""
    return n - -(-percent * n // 100) + 1


def in_order(grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Rarest bucket first, then by hash; ``grams`` are sorted."""
    return grams[np.argsort(counts[(grams >> np.uint64(64 - BUCKETS)).astype(np.int64)], kind="stable")]


def walked(probe: np.ndarray, members: list[tuple[int, np.ndarray]], percent: int) -> list[int]:
    """Of the sets ``members`` ``(key, sequence)`` those with that similarity to ``probe`` or more, by one walk of their trie."""
    order = sorted(range(len(members)), key=lambda i: members[i][1].tobytes())
    inside = np.sort(probe)
    before, counted, out = np.zeros(0, probe.dtype), np.zeros(1, np.int64), []
    for i in order:
        key, path = members[i]
        need = -(-percent * (len(path) + len(inside)) // (100 + percent))
        m = min(len(path), len(counted) - 1)
        apart = np.flatnonzero(before[:m] != path[:m])
        at = int(apart[0]) if len(apart) else m
        counted = counted[: at + 1]
        overlap = int(counted[-1])
        while overlap < need and overlap + min(len(path) - at, len(inside) - overlap) >= need:
            part = path[at : at + STEP]
            found = np.searchsorted(inside, part)
            found[found == len(inside)] = 0
            counted = np.concatenate((counted, overlap + np.cumsum(inside[found] == part)))
            overlap, at = int(counted[-1]), at + len(part)
        before = path
        if overlap >= need:
            out.append(key)
    return out


def gram_rows(docs: DataFrame, id_col: str, text_col: str, width: int, seed: int) -> DataFrame:
    """``(id, row, fp, n)`` of each row, and in rows of their own ``(buckets, counts)``, what a task has counted."""
    rows = docs.select(F.col(text_col).alias("text"), F.col(id_col).alias("id"), F.xxhash64(id_col, text_col).alias("row"))
    long, many = T.LongType(), T.ArrayType(T.IntegerType())
    schema = T.StructType([T.StructField("id", rows.schema["id"].dataType), *(T.StructField(c, k) for c, k in (("row", long), ("fp", long), ("n", long), ("buckets", many), ("counts", many)))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, multipliers, seen, kind = WordHashes(seed), _multipliers(width, seed), np.zeros(1 << BUCKETS, np.int64), None
        ints = pa.list_(pa.int32())
        for batch in batches:
            kind, fps, sizes = batch.schema.field(1).type, [], []
            for x in byte_values(batch.column(0)):
                grams = gram_set(x, width, hashes, multipliers)
                np.add.at(seen, (grams >> np.uint64(64 - BUCKETS)).astype(np.int64), 1)
                fps.append(xxhash.xxh3_64_intdigest(grams.tobytes()))
                sizes.append(len(grams))
            none = pa.nulls(len(sizes), ints)
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(sizes, pa.int64()), none, none], schema.names)
        if kind is not None:
            at = np.flatnonzero(seen)
            for lot in np.array_split(at, max(1, len(at) >> 14)):
                nothing = pa.nulls(1, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.nulls(1, kind), nothing, nothing, nothing, pa.array([lot], ints), pa.array([np.minimum(seen[lot], 2**31 - 1)], ints)], schema.names)
        release_memory()

    return rows.mapInArrow(run, schema)


def _order_of(rows: DataFrame) -> np.ndarray:
    """The count of each bucket over the whole corpus; their number is fixed."""
    each = rows.where("buckets is not null").select(F.explode(F.arrays_zip("buckets", "counts")).alias("x"))
    found = each.groupBy(F.col("x.buckets").alias("bucket")).agg(F.sum("x.counts").alias("n")).toArrow()
    out = np.zeros(1 << BUCKETS, np.int64)
    out[found.column("bucket").to_numpy()] = found.column("n").to_numpy()
    return out


def _made_of(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, width: int, seed: int, counts, schema: str, make: Callable) -> DataFrame:
    """What ``make`` gives for the ordered sets of the rows that ``wanted`` names by ``row``; a few others may come along, as the
    rows are told by a bit set, of 32 MB at most, and texts are not shuffled."""
    bits = 1 << min(28, max(20, (16 * wanted.count()).bit_length()))
    sent = docs.sparkSession.sparkContext.broadcast(_bits_of(wanted, bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, order, hashes, multipliers = sent.value, counts.value, WordHashes(seed), _multipliers(width, seed)
        for batch in batches:
            at = np.mod(batch.column(1).to_numpy(), len(bits) << 6).astype(np.uint64)
            there = ((bits[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1)).astype(bool)
            sets = (gram_set(x, width, hashes, multipliers) for x in byte_values(batch.column(0).filter(pa.array(there))))
            yield make([(int(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes())).view(np.int64)), s, in_order(s, order)) for s in sets if len(s)])
        release_memory()

    return docs.select(F.col(text_col).alias("text"), F.xxhash64(id_col, text_col).alias("row")).mapInArrow(run, schema)


def _prefixes(percent: int) -> Callable:
    longs = pa.list_(pa.int64())

    def make(sets: list) -> pa.RecordBatch:
        first = [o[: prefix_length(len(o), percent)].view(np.int64) for _, _, o in sets]
        return pa.RecordBatch.from_arrays([pa.array([f for f, _, _ in sets], pa.int64()), pa.array([len(s) for _, s, _ in sets], pa.int64()), pa.array([sketch_of(s) for _, s, _ in sets], longs), pa.array(first, longs)], ["fp", "n", "sketch", "grams"])

    return make


def _whole(sets: list) -> pa.RecordBatch:
    made = [pa.array([f for f, _, _ in sets], pa.int64()), pa.array([len(s) for _, s, _ in sets], pa.int64()), pa.array([o[::-1].view(np.int64) for _, _, o in sets], pa.list_(pa.int64()))]
    return pa.RecordBatch.from_arrays(made, ["fp", "n", "path"])


def tree_join(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The ``pairs`` ``(src, dst)`` with that similarity or more; ``sets``: ``(fp, n, path)``.

    The sets ``src`` of a ``dst`` make a trie that ``dst`` walks; one that many may link to has several tries, of at most
    ``BLOCK`` n-grams on average.
    """
    sized = pairs.join(sets.select(F.col("fp").alias("src"), "n"), "src")
    tries = sized.groupBy("dst").agg(F.ceil(F.sum("n") / BLOCK).cast("int").alias("tries"))
    block = F.pmod(F.xxhash64("src"), F.col("tries")).cast("int").alias("block")
    members = pairs.join(tries, "dst").select(F.col("src").alias("fp"), "dst", block, "src")
    probes = tries.select(F.col("dst").alias("fp"), "dst", F.explode(F.sequence(F.lit(0), F.col("tries") - 1)).alias("block"), F.lit(None).cast("bigint").alias("src"))
    dealt = members.unionByName(probes).join(sets.select("fp", "path"), "fp").select("dst", "block", "src", "path")
    dealt = dealt.repartition("dst", "block").sortWithinPartitions("dst", "block", F.col("src").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, probe, members = None, None, []

        def told() -> pa.RecordBatch:
            found = walked(probe, members, percent)
            return pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array([now[0]] * len(found), pa.int64())], ["src", "dst"])

        for batch in batches:
            dst, block, src = (batch.column(i).to_pylist() for i in range(3))
            path = batch.column(3)
            for i, key in enumerate(zip(dst, block)):
                own = path[i].values.to_numpy()
                if key != now:
                    if members:
                        yield told()
                    now, members = key, []
                if src[i] is None:
                    probe = own
                else:
                    members.append((src[i], own))
        if members:
            yield told()
        release_memory()

    return dealt.mapInArrow(run, "src bigint, dst bigint")


def gram_classes(docs: DataFrame, rows: DataFrame, id_col: str, text_col: str, width: int, percent: int, seed: int) -> DataFrame:
    """``(fp, root)`` of each set that has a link: sets chained by steps of ``percent`` similarity or more share a root."""
    counts = docs.sparkSession.sparkContext.broadcast(_order_of(rows))
    nodes = stored(rows.where("n > 0").groupBy("fp").agg(F.min("row").alias("row")), "nodes")

    def made(wanted: DataFrame, schema: str, make: Callable) -> DataFrame:
        return _made_of(docs, wanted, id_col, text_col, width, seed, counts, schema, make)

    sets = stored(made(nodes, "fp bigint, n bigint, sketch array<bigint>, grams array<bigint>", _prefixes(percent)), "prefixes")
    grams = sets.select("fp", F.explode("grams").alias("gram"))
    shared = grams.groupBy("gram").agg(F.count("*").alias("members")).where("members > 1")
    entries = grams.join(shared, "gram").groupBy("fp").agg(F.sum("members").alias("degree"), F.collect_list("gram").alias("grams"))
    one = sets.select("fp", "n", "sketch", (F.col("n") - F.size("grams")).alias("rest"))
    met = stored(entries.join(one, "fp").dropDuplicates(["fp"]), "met")  # sets with an n-gram in common with another

    ranked = met.select("fp", "degree", F.explode("grams").alias("gram"))
    tops = ranked.groupBy("gram").agg(F.max(F.struct("degree", "fp")).alias("top")).select("gram", F.col("top.fp").alias("dst"))
    votes = ranked.select("fp", "gram").join(tops, "gram").where("fp <> dst").groupBy("fp", "dst").agg(F.count("*").alias("votes"))
    stars = votes.groupBy("fp").agg(F.max(F.struct("votes", "dst")).alias("best")).select(F.col("fp").alias("src"), F.col("best.dst").alias("dst"))
    a, b = met.select(F.col("fp").alias("src"), "n", "rest", F.col("sketch").alias("x"), F.col("grams").alias("g")), met.select(F.col("fp").alias("dst"), F.col("n").alias("m"), F.col("rest").alias("left"), F.col("sketch").alias("y"), F.col("grams").alias("h"))
    both = stars.join(a, "src").join(b, "dst").where(within_bound("n", "m", "x", "y", percent)).withColumn("both", F.size(F.array_intersect("g", "h")))
    stars = stored(both.where(_reachable(percent)).select("src", "dst"), "stars")
    linked = stored(_tested(made, nodes, stars, percent), "linked")
    classes = connected_components(linked)

    classed = stored(met.join(classes, met.fp == classes.node, "left").select("fp", "n", "rest", "sketch", "grams", F.coalesce("component", "fp").alias("class")), "classed")
    kinds = classed.select("fp", "class", F.explode("grams").alias("gram"))
    mixed = kinds.groupBy("gram").agg(F.min("class").alias("lo"), F.max("class").alias("hi")).where("lo < hi").select("gram")
    # only what stands at such an n-gram takes its sketch along
    open_grams = kinds.select("fp", "gram").join(mixed, "gram").groupBy("fp").agg(F.collect_list("gram").alias("open"))
    left = classed.join(open_grams, "fp").select(F.explode("open").alias("gram"), "fp", "class", "n", "rest", "sketch")
    a, b = left.toDF("gram", "src", "c", "n", "rest", "x"), left.toDF("gram", "dst", "d", "m", "left", "y")
    near = a.join(b, (a.gram == b.gram) & (F.col("c") < F.col("d")) & within_bound("n", "m", "x", "y", percent))
    counted = near.groupBy("src", "dst", "n", "rest", "m", "left").agg(F.count("*").alias("both"))
    pairs = stored(counted.where(_reachable(percent)).select("src", "dst"), "pairs")
    crossed = stored(_tested(made, nodes, pairs, percent), "crossed")
    return connected_components(linked.unionByName(crossed)).select(F.col("node").alias("fp"), F.col("component").alias("root"))


def _reachable(percent: int) -> Column:
    """Whether sets of ``n`` and ``m`` with ``both`` of their first n-grams in common can have that similarity.

    Of the two prefixes one ends first in the order; of its set only what is not in the prefix (``rest``, ``left``) can
    still be in common besides.
    """
    return (100 + percent) * (F.col("both") + F.greatest("rest", "left")) >= percent * (F.col("n") + F.col("m"))


def _tested(made: Callable, nodes: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    ends = pairs.select(F.explode(F.array("src", "dst")).alias("fp")).distinct()
    wanted = stored(nodes.join(ends, "fp", "left_semi"), "wanted")
    return tree_join(pairs, stored(made(wanted, "fp bigint, n bigint, path array<bigint>", _whole), "sets"), percent)


def gram_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, percent: int = 85, seed: int = 42) -> DataFrame:
    """``(id_col, n_shingles, component_id)`` of each row: the size of its set of ``width``-word n-grams, and the smallest
    id reachable over links of ``percent`` Jaccard similarity or more, its own included.

    A text of fewer words is one n-gram; null and texts without words have none and are linked with nothing. Rows with a
    null id take part, but name a component only if all its ids are null. Rows with equal ids are told apart;
    repeated rows give repeated results; other columns are not read; an empty table gives none. N-grams are
    told apart by 64-bit hashes, and so are sets: among 10 million texts two share one by chance with a probability of 3e-6.
    """
    rows = stored(gram_rows(docs, id_col, text_col, width, seed), "rows")
    classes = gram_classes(docs, rows, id_col, text_col, width, percent, seed)
    own = rows.where("n is not null").select("id", "fp", "n")
    least = stored(own.where("n > 0").groupBy("fp").agg(F.min("id").alias("least")), "least")
    rooted = stored(least.join(classes, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "rooted")
    first = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(first, "root").select("fp", "component_id")
    out = own.where("n > 0").join(named, "fp").select("id", "n", "component_id")
    out = out.unionByName(own.where("n = 0").select("id", "n", F.col("id").alias("component_id")))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")


def op11_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return gram_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
