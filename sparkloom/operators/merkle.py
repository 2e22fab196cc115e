"""Hash trees over ordered rows, one for each group, with proofs by coordinate lookup.

Rows get a place in their tree from a sort by ranges. A tree is built in bands of ``BAND`` levels: a band's
blocks of ``arity ** BAND`` neighbouring nodes are one aggregation, so a tree over any number of rows takes
as many shuffles as it has bands, each a block-th of the one before. All nodes are kept, by tree, level and
place.

A proof is looked up: each node of a band's lowest level lists the coordinates of the siblings that it needs
there, which its place and its tree's size tell; these are joined to the node table and put in order. What
lies above the band is the same for all nodes of a block, so it is looked up once a block and handed down.
No key of these joins has more rows than a block, however large a tree is.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.operators.ranks import ranked
from sparkloom.session import stored

BAND = 3
RUN = T.ArrayType(T.StructType([T.StructField("left", T.ArrayType(T.BinaryType())), T.StructField("right", T.ArrayType(T.BinaryType()))]))


@dataclass(frozen=True)
class Trees:
    """``bands``: for each band, from the leaves up, its blocks ``(tree, block, size, height, h0, h1, ...)``, where ``size`` is the
    number of nodes of the tree's level, ``height`` the levels above it, and ``hN`` the block's hashes N levels up.
    ``roots``: ``(tree, root)``."""

    bands: list[DataFrame]
    roots: DataFrame
    arity: int


def placed(rows: DataFrame, group: str, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """``rows`` with ``tree``, ``place`` (both from 0) and ``size``; and ``(tree, group, size)`` of each group.

    Groups are numbered in their order, null first; rows of a group are placed in ``order``, which must tell
    all rows apart. A group of any size is many tasks.
    """
    keys = [group, *order]
    ranged = stored(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("at", F.monotonically_increasing_id()), "ranged")
    part = F.shiftright("at", 33)
    runs = stored(ranged.groupBy(part.alias("part"), F.col(group).alias("own")).agg(F.count("*").alias("n"), F.min("at").alias("first")), "runs")
    trees = ranked(runs.groupBy("own").agg(F.sum("n").alias("size")), ["own"], "tree")
    trees = stored(trees.select((F.col("tree") - 1).alias("tree"), F.col("own").alias("group"), "size"), "trees")
    a, b = runs.alias("a"), runs.alias("b")  # a group has a run in each part it reaches into
    before = a.join(b, F.col("a.own").eqNullSafe(F.col("b.own")) & (F.col("b.part") < F.col("a.part")), "left")
    before = before.groupBy("a.part", "a.own", "a.first").agg(F.coalesce(F.sum("b.n"), F.lit(0)).alias("start"))
    heads = before.join(trees, F.col("own").eqNullSafe(F.col("group"))).select("part", "own", "first", "start", "tree", F.col("size").alias("all"))
    found = ranged.join(heads, (part == F.col("part")) & F.col(group).eqNullSafe(F.col("own")))
    return found.select(*rows.columns, "tree", (F.col("at") - F.col("first") + F.col("start")).alias("place"), F.col("all").alias("size")), trees


def height_of(size: Column, arity: int) -> Column:
    """Levels above a level of ``size`` nodes."""
    powers = [arity**k for k in range(64) if arity**k < 1 << 62]
    return F.size(F.filter(F.array(*[F.lit(p) for p in powers]), lambda p: p < size))


def grown(nodes: DataFrame, arity: int = 3) -> Trees:
    """The trees over ``nodes`` ``(tree, place, size, hash)``; ``hash`` is hexadecimal text, and a node is the SHA-256 of its children's texts."""
    now, bands, roots = nodes.withColumn("height", height_of(F.col("size"), arity)), [], []
    step = arity**BAND
    while True:
        held = F.transform(F.array_sort(F.collect_list(F.struct("place", "hash"))), lambda x: x["hash"])
        blocks = now.groupBy("tree", F.floor(F.col("place") / step).cast("bigint").alias("block"), "size", "height").agg(held.alias("h0"))
        for j in range(1, BAND + 1):
            blocks = blocks.withColumn(f"h{j}", F.when(F.col("height") >= j, _level_over(F.col(f"h{j - 1}"), arity)))
        blocks = stored(blocks, f"band{len(bands)}")
        bands.append(blocks)
        top = F.element_at(F.array(*[F.col(f"h{j}") for j in range(BAND + 1)]), (F.col("height") + 1).cast("int"))[0]
        roots.append(blocks.where(F.col("height") <= BAND).select("tree", top.alias("root")))
        rest = blocks.where(F.col("height") > BAND)
        if not rest.limit(1).count():
            break
        size = F.floor((F.col("size") + (step - 1)) / step).cast("bigint").alias("size")
        now = rest.select("tree", F.col("block").alias("place"), size, (F.col("height") - BAND).alias("height"), F.col(f"h{BAND}")[0].alias("hash"))
    out = roots[0]
    for more in roots[1:]:
        out = out.unionByName(more)
    return Trees(bands, stored(out, "roots"), arity)


def _level_over(below: Column, arity: int) -> Column:
    runs = F.sequence(F.lit(0), F.floor((F.size(below) - 1) / arity).cast("int"))
    return F.transform(runs, lambda i: F.sha2(F.array_join(F.slice(below, i * arity + 1, F.lit(arity)), "").cast("binary"), 256))


def node_table(trees: Trees) -> DataFrame:
    """``(tree, level, place, hash)`` of every node, leaves at level 0."""
    out = None
    for b, blocks in enumerate(trees.bands):
        own = _nodes(blocks, trees.arity).select("tree", (F.col("level") + b * BAND).alias("level"), "place", F.lower(F.hex("hash")).alias("hash"))
        out = own if out is None else out.unionByName(own)
    over = F.col("level") == height_of(F.col("size"), trees.arity)
    top = trees.roots.join(trees.bands[0].select("tree", "size").distinct(), "tree").withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(63)))).where(over)
    top = top.where(F.col("level") % BAND == 0).where("level > 0")  # other roots stand in their band's blocks
    return out.unionByName(top.select("tree", "level", F.lit(0).cast("bigint").alias("place"), F.col("root").alias("hash")))


def _nodes(blocks: DataFrame, arity: int) -> DataFrame:
    """``(tree, level, place, hash)`` of a band's nodes, its topmost level left to the next band; ``level`` from 0."""

    def level(j: int) -> Column:
        place = F.col("block") * arity ** (BAND - j)
        return F.coalesce(F.transform(F.col(f"h{j}"), lambda h, i: F.struct(F.lit(j).alias("level"), (place + i).alias("place"), F.unhex(h).alias("hash"))), F.array())

    return blocks.select("tree", F.explode(F.flatten(F.array(*[level(j) for j in range(BAND)]))).alias("x")).select("tree", "x.level", "x.place", "x.hash")


def _wanted(blocks: DataFrame, arity: int) -> DataFrame:
    """The coordinates of the siblings that each lowest node of a band needs: ``(tree, own, level, place)``; a node that needs none has a row with nulls."""
    step = arity**BAND

    def level(own: Column, j: int) -> Column:
        at = F.floor(own / arity**j).cast("bigint")
        run, last = F.floor(at / arity).cast("bigint") * arity, F.floor((F.col("size") - 1) / arity**j).cast("bigint")
        others = F.filter(F.array(*[run + i for i in range(arity)]), lambda x: (x != at) & (x <= last))
        return F.when(F.col("height") > j, F.transform(others, lambda x: F.struct(F.lit(j).alias("level"), x.alias("place")))).otherwise(F.array())

    own = blocks.select("tree", "size", "height", F.explode(F.transform(F.sequence(F.lit(0), F.size("h0") - 1), lambda i: F.col("block") * step + i)).alias("own"))
    return own.select("tree", "own", "height", F.explode_outer(F.flatten(F.array(*[level(F.col("own"), j) for j in range(BAND)]))).alias("x")).select("tree", "own", "height", "x.level", "x.place")


def paths(trees: Trees, above: DataFrame) -> DataFrame:
    """``(tree, place, path, ...)`` of each leaf. ``path`` has an entry for each level from the leaf's up: the hashes of its siblings
    to the left and to the right. ``above``: ``(tree, path)``, what follows the tree's root, and further columns to hand down."""
    arity, step = trees.arity, trees.arity**BAND
    more = [c for c in above.columns if c not in ("tree", "path")]
    upper = None
    for b in range(len(trees.bands) - 1, -1, -1):
        blocks = trees.bands[b]
        heads = blocks.where(F.col("height") <= BAND).select("tree").join(above, "tree").select("tree", F.lit(0).cast("bigint").alias("place"), "path", *more)
        upper = heads if upper is None else upper.unionByName(heads)
        found = _wanted(blocks, arity).join(_nodes(blocks, arity), ["tree", "level", "place"], "left")
        held = F.array_sort(F.collect_list(F.when(F.col("hash").isNotNull(), F.struct("level", "place", "hash"))))
        found = found.groupBy("tree", "own", "height").agg(held.alias("held"))

        def run(j: int) -> Column:
            at = F.floor(F.col("own") / arity**j).cast("bigint")
            side = lambda ok: F.transform(F.filter("held", lambda x: (x["level"] == j) & ok(x["place"])), lambda x: x["hash"])
            return F.struct(side(lambda p: p < at).alias("left"), side(lambda p: p > at).alias("right"))

        levels = F.slice(F.array(*[run(j) for j in range(BAND)]), F.lit(1), F.least(F.col("height"), F.lit(BAND)))
        own = found.select("tree", F.col("own").alias("place"), F.floor(F.col("own") / step).cast("bigint").alias("block"), levels.alias("low"))
        joined = own.join(upper.withColumnRenamed("place", "block"), ["tree", "block"])
        upper = joined.select("tree", "place", F.concat("low", "path").alias("path"), *more)
        if b:
            upper = stored(upper, f"paths{b}")
    return upper


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf's hash and its path give."""
    text = lambda hashes: F.array_join(F.transform(hashes, lambda h: F.lower(F.hex(h))), "")
    return F.aggregate(path, start, lambda acc, run: F.sha2(F.concat(text(run["left"]), acc, text(run["right"])).cast("binary"), 256))


def proof_text(path: Column) -> Column:
    """All siblings of a path, level by level, from left to right."""
    return F.array_join(F.transform(F.flatten(F.transform(path, lambda run: F.concat(run["left"], run["right"]))), lambda h: F.lower(F.hex(h))), "")
