"""Merkle manifest of a dataset: a hash tree for each source, a tree over their roots, and a proof for each row.

The trees and the lookup of proofs are those of ``sparkloom.operators.merkle``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.operators.merkle import RUN, Trees, folded, grown, paths, placed, proof_text
from sparkloom.session import stored

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


@dataclass(frozen=True)
class Manifest:
    """``leaves``: ``(id, leaf, ..., tree, place, size)``; ``sources``: ``(tree, group, size, subroot)``; ``root``: None without rows."""

    leaves: DataFrame
    sources: DataFrame
    root: str | None
    trees: Trees
    top: Trees


def leaf_hash(values: list[Column]) -> Column:
    """SHA-256 of the values' texts, each ``-`` if null, else its number of UTF-8 bytes, ``:`` and itself."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]).cast("binary"), 256)


def build_manifest(docs: DataFrame, id_col: str = "doc_id", group_col: str = "source", fields: tuple[str, ...] = FIELDS, arity: int = 3, also: dict[str, Column] | None = None) -> Manifest:
    """Hash every row over ``fields``, and build a tree per ``group_col`` in the order of ``id_col``.

    Null ids come first, a null group before all others; rows with equal ids are placed by their hash, and
    repeated rows are as many leaves. ``also``: further columns of ``leaves``, made from ``docs``. Columns not
    named are not read. An empty table has no root.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(group_col).alias("source"), leaf_hash([F.col(c) for c in fields]).alias("leaf"), *[c.alias(n) for n, c in (also or {}).items()])
    rows = stored(rows.withColumn("row", F.monotonically_increasing_id()), "leaves")
    leaves, groups = placed(rows, "source", ["id", "leaf", "row"])
    leaves = stored(leaves.drop("row"), "placed")
    trees = grown(leaves.select("tree", "place", "size", F.col("leaf").alias("hash")), arity)
    sources = stored(groups.join(trees.roots.withColumnRenamed("root", "subroot"), "tree"), "sources")
    count = sources.agg(F.count("*")).first()[0]
    top = grown(sources.select(F.lit(0).cast("bigint").alias("tree"), F.col("tree").alias("place"), F.lit(count).cast("bigint").alias("size"), F.col("subroot").alias("hash")), arity)
    root = top.roots.first()
    return Manifest(leaves, sources, root and root["root"], trees, top)


def proofs(manifest: Manifest) -> DataFrame:
    """``leaves`` with ``path``, the siblings from the leaf to the root, and ``subroot``."""
    nothing = F.array().cast(RUN)
    one = manifest.top.roots.select("tree", nothing.alias("path"))
    over = paths(manifest.top, one).select(F.col("place").alias("tree"), "path")
    over = stored(over.join(manifest.sources.select("tree", "subroot"), "tree"), "over")
    return manifest.leaves.join(paths(manifest.trees, over), ["tree", "place"])


def verified_manifest(docs: DataFrame, id_col: str = "doc_id", group_col: str = "source", fields: tuple[str, ...] = FIELDS, received: dict[str, Column] | None = None, arity: int = 3) -> DataFrame:
    """``(id_col, leaf, subroot, root, proof_sha256, folded_root, verified)`` of each row.

    ``received``: for fields that arrived changed, their values then; a row's proof, made from what was
    hashed first, is folded from the hash of what arrived, and must give the root. Nulls, repeats and empty
    tables as in :func:`build_manifest`.
    """
    came = leaf_hash([(received or {}).get(c, F.col(c)) for c in fields])
    own = leaf_hash([F.col(c) for c in fields])
    made = build_manifest(docs, id_col, group_col, fields, arity, {"came": F.nullif(came, own) if received else F.lit(None).cast("string")})
    found = proofs(made).select("*", F.lit(made.root).cast("string").alias("root"), folded(F.coalesce("came", "leaf"), F.col("path")).alias("folded_root"))
    return found.select(F.col("id").alias(id_col), "leaf", "subroot", "root", F.sha2(proof_text(F.col("path")).cast("binary"), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op12_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    return verified_manifest(spark.read.parquet(f"{sf_dir}/documents.parquet"), received={"text": F.when(even, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))})


_FIELD = "coalesce(strlen({0}::VARCHAR) || ':' || {0}, '-')"
_CRC = """list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
    lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda x, z: xor(x >> 1, (x & 1) * 3988292384)))"""
OP12_SQL = f"""
WITH RECURSIVE leaf AS (SELECT doc_id, source, sha256({" || ".join(_FIELD.format(c) for c in FIELDS)}) AS leaf,
    sha256({" || ".join(_FIELD.format(c if c != "text" else "(CASE WHEN even THEN replace(text, chr(10), '') ELSE text END)") for c in FIELDS)}) AS came
  FROM (SELECT *, xor({_CRC}, 4294967295) % 2 = 0 AS even FROM documents)),
placed AS (SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place FROM leaf),
low AS (SELECT tree, 0 AS level, place, leaf AS hash, count(*) OVER (PARTITION BY tree) AS size FROM placed
  UNION ALL SELECT tree, level + 1, place // 3, sha256(string_agg(hash, '' ORDER BY place)), (any_value(size) + 2) // 3 FROM low WHERE size > 1 GROUP BY tree, level, place // 3),
sub AS (SELECT tree, hash AS subroot FROM low WHERE size = 1),
high AS (SELECT 0 AS level, tree AS place, subroot AS hash, count(*) OVER () AS size FROM sub
  UNION ALL SELECT level + 1, place // 3, sha256(string_agg(hash, '' ORDER BY place)), (any_value(size) + 2) // 3 FROM high WHERE size > 1 GROUP BY level, place // 3),
nodes AS (SELECT 0 AS upper, tree, level, place, hash FROM low UNION ALL SELECT 1, 0, level, place, hash FROM high),
tops AS (SELECT upper, tree, max(level) AS height FROM nodes GROUP BY 1, 2),
steps AS (SELECT p.tree, p.place, t.upper, l.level, (CASE t.upper WHEN 0 THEN p.place ELSE p.tree END) // (3 ** l.level)::BIGINT AS at, t.tree AS t
  FROM placed p JOIN tops t ON t.upper = 1 OR t.tree = p.tree JOIN (SELECT unnest(range(40)) AS level) l ON l.level < t.height),
runs AS (SELECT s.tree, s.place, s.upper, s.level, coalesce(string_agg(n.hash, '' ORDER BY n.place) FILTER (n.place < s.at), '') AS before, coalesce(string_agg(n.hash, '' ORDER BY n.place) FILTER (n.place > s.at), '') AS after
  FROM steps s JOIN nodes n ON n.upper = s.upper AND n.tree = s.t AND n.level = s.level AND n.place // 3 = s.at // 3 GROUP BY ALL),
path AS (SELECT tree, place, string_agg(before || after, '' ORDER BY upper, level) AS proof, list(before || '|' || after ORDER BY upper, level) AS pairs FROM runs GROUP BY 1, 2),
found AS (SELECT p.doc_id, p.leaf, sub.subroot, (SELECT hash FROM high WHERE size = 1) AS root, sha256(coalesce(proof, '')) AS proof_sha256,
    list_reduce(list_prepend(p.came, coalesce(pairs, [])), lambda acc, x: sha256(split_part(x, '|', 1) || acc || split_part(x, '|', 2))) AS folded_root
  FROM placed p JOIN sub USING (tree) LEFT JOIN path USING (tree, place))
SELECT *, folded_root = root AS verified FROM found
"""
