"""Content digests of tables and of trees of named parts, and what changed between two tables.

Equal content has equal digests, whatever the files, the partitioning or the last digits of its numbers. Digests are hash trees
over ordered rows (``operators.merkle``), so no table, field or part is hashed in one task.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.functions import rotations as rt
from sparkloom.functions import scalars as sc
from sparkloom.operators.merkle import grown, placed
from sparkloom.session import stored

DIGITS = 4  # bits that a level of the tree over keys adds


def canonical_text(value: Column, kind: T.DataType, places: int = 9) -> Column:
    """The text of a value by its content: numbers rounded half to even without a negative zero, bytes by length and SHA-256."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        x = F.bround(value.cast("double"), places) + F.lit(0.0)
        odd = F.isnan(value) | (F.abs(value) == float("inf"))
        return F.when(odd, value.cast("string")).otherwise(F.coalesce(x.try_cast(f"decimal(38,{places})").cast("string"), x.cast("string")))
    if isinstance(kind, T.BinaryType):
        return F.concat(F.length(value).cast("string"), F.lit(":"), F.sha2(value, 256))
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(value).cast("string")
    if isinstance(kind, T.ArrayType):
        return F.when(value.isNotNull(), joined(F.transform(value, lambda x: F.coalesce(_sized(canonical_text(x, kind.elementType, places)), F.lit("-")))))
    if isinstance(kind, T.StructType):
        return F.when(value.isNotNull(), F.concat(*[F.coalesce(_sized(canonical_text(value[f.name], f.dataType, places)), F.lit("-")) for f in kind.fields]))
    return value.cast("string")


def _sized(text: Column) -> Column:
    return F.concat(F.octet_length(text).cast("string"), F.lit(":"), text)


def joined(texts: Column) -> Column:
    return F.array_join(texts, "")


def canonical_quaternion(q: Column) -> Column:
    """At length one, with w above 0, or, where it is 0, the first other part that is not; null without a length."""

    def of(a: Column) -> Column:
        n = F.sqrt(a[0] * a[0] + a[1] * a[1] + a[2] * a[2] + a[3] * a[3])
        lead = F.when(a[3] != 0, a[3]).when(a[0] != 0, a[0]).when(a[1] != 0, a[1]).otherwise(a[2])
        return F.when((n > 0) & (n < float("inf")), F.transform(a, lambda x: x / n * F.when(lead < 0, -1.0).otherwise(1.0) + F.lit(0.0)))

    return rt.bound(of, q)


def _row(df: DataFrame, columns: list[str], places: int, quaternions: tuple[str, ...]) -> dict[str, Column]:
    """The canonical text of each column, ``-`` for null."""
    value = lambda c: canonical_quaternion(df[c]) if c in quaternions else df[c]
    return {c: F.coalesce(_sized(canonical_text(value(c), df.schema[c].dataType, places)), F.lit("-")) for c in columns}


def semantic_columns(df: DataFrame, optional: tuple[str, ...]) -> list[str]:
    """All columns but those of ``optional`` that are null in every row."""
    asked = [c for c in df.columns if c in optional]
    if not asked:
        return df.columns
    there = df.agg(*[F.max(F.col(c).isNotNull()).alias(f"v{i}") for i, c in enumerate(asked)]).first()
    gone = {c for c, here in zip(asked, there) if not here}
    return [c for c in df.columns if c not in gone]


def table_summary(df: DataFrame, order: list[str], optional: tuple[str, ...] = (), places: int = 9, quaternions: tuple[str, ...] = ()) -> DataFrame:
    """One row ``(rows, columns, sha256)``: the digest of the columns' names and of all rows in ``order``, ties by content.

    Columns of ``optional`` that are null throughout are left out, so that a table with and one without them are equal.
    """
    columns = semantic_columns(df, optional)
    texts = _row(df, columns, places, quaternions)
    rows = df.select(F.lit(0).alias("tree"), *[F.col(c).alias(f"k{i}") for i, c in enumerate(order)], F.sha2(F.concat(*texts.values()).cast("binary"), 256).alias("hash"))
    ranks, _ = placed(stored(rows.withColumn("row", F.monotonically_increasing_id()), "digests").withColumnRenamed("tree", "one"), "one", [*(f"k{i}" for i in range(len(order))), "hash", "row"])
    found = grown(ranks.select("tree", "place", "size", "hash"))
    counts = found.bands[0].agg(F.coalesce(F.max("size"), F.lit(0)).cast("bigint").alias("rows"))
    head = json.dumps(columns, separators=(",", ":"))
    whole = counts.join(found.roots.select("root"), F.lit(True), "left")  # at most one root
    return whole.select("rows", F.lit(head).alias("columns"), F.sha2(F.concat(F.lit(head), F.coalesce("root", F.lit("-"))).cast("binary"), 256).alias("sha256"))


def field_digests(df: DataFrame, order: list[str], fields: list[str], places: int = 9, quaternions: tuple[str, ...] = ()) -> DataFrame:
    """``(field, rows, sha256)``: a digest of each field's values in ``order``, which must tell rows apart."""
    texts = _row(df, fields, places, quaternions)
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.sha2(t.cast("binary"), 256).alias("hash")) for f, t in texts.items()]))
    rows = df.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(order)], each.alias("x")).select("x.field", "x.hash", *[f"k{i}" for i in range(len(order))])
    ranks, groups = placed(rows, "field", [*(f"k{i}" for i in range(len(order))), "hash"])
    found = grown(ranks.select("tree", "place", "size", "hash"))
    return groups.join(found.roots, "tree").select(F.col("group").alias("field"), F.col("size").alias("rows"), F.col("root").alias("sha256"))


def tree_digests(nodes: DataFrame, layout: bool = True) -> DataFrame:
    """``(path, sha256)`` of every part of a tree of groups and datasets, parts below included.

    ``nodes``: ``path`` ('/' between names, '' the root), ``kind``, ``attrs`` (a map of texts), ``data`` (bytes, null for a group) and ``storage`` (how it
    is stored: text, or null; left out without ``layout``). A part's digest is that of its kind, name, attributes by name, data, and children
    by name. A part whose parent is not there fails the query.
    """
    name = F.element_at(F.split("path", "/"), -1)
    depth = F.when(F.col("path") == "", 0).otherwise(F.size(F.split("path", "/")))
    parent = F.when(F.col("path") != "", F.when(F.instr("path", "/") > 0, F.regexp_extract("path", "^(.*)/[^/]*$", 1)).otherwise(F.lit("")))
    attrs = joined(F.transform(F.array_sort(F.map_entries("attrs")), lambda e: F.concat(_sized(e["key"]), F.coalesce(_sized(e["value"]), F.lit("-")))))
    own = [F.col("kind"), name, F.coalesce(attrs, F.lit("")), F.sha2("data", 256), F.col("storage") if layout else F.lit(None).cast("string")]
    rows = nodes.select("path", parent.alias("parent"), name.alias("name"), depth.alias("depth"), F.concat(*[F.coalesce(_sized(c), F.lit("-")) for c in own]).alias("own"))
    rows = stored(rows, "parts")
    lost = rows.where("parent is not null").select(F.col("parent").alias("path")).join(rows.select("path"), "path", "left_anti").limit(1).collect()
    if lost:
        raise ValueError(f"a part has no parent: {lost[0]['path']}")
    below, out = None, None
    for level in range(rows.agg(F.coalesce(F.max("depth"), F.lit(-1))).first()[0], -1, -1):
        here = rows.where(F.col("depth") == level)
        if below is None:
            made = here.withColumn("under", F.lit("-"))
        else:
            ranks, groups = placed(below, "parent", ["name"])
            roots = grown(ranks.select("tree", "place", "size", F.col("sha256").alias("hash"))).roots
            under = groups.join(roots, "tree").select(F.col("group").alias("over"), F.concat(F.col("size").cast("string"), F.lit(":"), F.col("root")).alias("root"))
            made = here.join(under, F.col("path") == F.col("over"), "left").withColumn("under", F.coalesce("root", F.lit("-")))
        made = stored(made.select("path", "parent", "name", F.sha2(F.concat("own", "under").cast("binary"), 256).alias("sha256")), f"level{level}")
        below, out = made, made if out is None else out.unionByName(made)
    return (out if out is not None else rows.withColumn("sha256", F.col("own"))).select("path", "sha256")


def key_tree(df: DataFrame, key: list[str], places: int = 9, quaternions: tuple[str, ...] = (), depth: int = 4) -> list[DataFrame]:
    """Digests of the rows by the leading bits of their key's hash: for each level ``(bucket, digest)``, the root first.

    The digest of a bucket does not depend on the order of its rows, and is summed up before the shuffle.
    """
    texts = _row(df, [c for c in df.columns], places, quaternions)
    rows = df.select(F.shiftrightunsigned(F.xxhash64(*key), 64 - DIGITS * depth).alias("bucket"), F.concat(*[texts[c] for c in sorted(texts)]).alias("text"))
    level = stored(rows.groupBy("bucket").agg(sc.set_digest(F.col("text")).alias("digest")), "buckets")
    out = [level]
    for _ in range(depth):
        level = level.groupBy(F.shiftright("bucket", DIGITS).alias("bucket")).agg(sc.set_digest(F.concat_ws(":", F.col("bucket").cast("string"), "digest")).alias("digest"))
        out.append(level)
    return out[::-1]


def changed_rows(old: DataFrame, new: DataFrame, key: list[str], places: int = 9, quaternions: tuple[str, ...] = (), depth: int = 4) -> DataFrame:
    """``(key..., state)`` of what differs between two tables of the same columns: 'added', 'removed' or 'changed'.

    The trees over both tables' keys are walked from the root down, along buckets that differ; only rows of the
    lowest buckets left are compared. A key that is there several times is changed if its rows, as many as there are of each, differ.
    """
    if sorted(old.columns) != sorted(new.columns):
        raise ValueError("the tables have different columns")
    a, b = (key_tree(df, key, places, quaternions, depth) for df in (old, new))
    open_ = None
    for x, y in zip(a, b):
        if open_ is not None:
            x, y = (t.join(open_, F.shiftright("bucket", DIGITS) == F.col("over"), "left_semi") for t in (x, y))
        both = x.join(y.select("bucket", F.col("digest").alias("other")), "bucket", "full").where(~F.col("digest").eqNullSafe(F.col("other")))
        open_ = stored(both.select(F.col("bucket").alias("over")), "open")

    def side(df: DataFrame) -> DataFrame:
        texts = _row(df, [c for c in df.columns], places, quaternions)
        bucket = F.shiftrightunsigned(F.xxhash64(*key), 64 - DIGITS * depth)
        rows = df.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(key)], bucket.alias("bucket"), F.concat(*[texts[c] for c in sorted(texts)]).alias("text"))
        rows = rows.join(open_, F.col("bucket") == F.col("over"), "left_semi")
        return rows.groupBy(*[f"k{i}" for i in range(len(key))]).agg(sc.set_digest(F.col("text")).alias("digest"))

    x, y = side(old).alias("x"), side(new).alias("y")
    same = F.lit(True)
    for i in range(len(key)):
        same = same & F.col(f"x.k{i}").eqNullSafe(F.col(f"y.k{i}"))
    both = x.join(y, same, "full").where(~F.col("x.digest").eqNullSafe(F.col("y.digest")))
    state = F.when(F.col("x.digest").isNull(), "added").when(F.col("y.digest").isNull(), "removed").otherwise("changed")
    keys = [F.when(F.col("x.digest").isNull(), F.col(f"y.k{i}")).otherwise(F.col(f"x.k{i}")).alias(c) for i, c in enumerate(key)]
    return both.select(*keys, state.alias("state"))
