import hashlib
import random
import zlib

from pyspark.sql import functions as F

from sparkloom.llm.manifest import build_manifest, op12_merkle_manifest, verified_manifest
from sparkloom.operators.merkle import node_table

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, hash string, `a b` string, place int"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row):
    doc_id, text, lang, source, n = row
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n, text)))


def tree(hashes):
    """Root, and for each leaf its runs of siblings as (left, right), by recursion over levels."""
    runs = [[] for _ in hashes]
    under = [[i] for i in range(len(hashes))]
    while len(hashes) > 1:
        for i, own in enumerate(under):
            run = range(i // 3 * 3, min(i // 3 * 3 + 3, len(hashes)))
            for leaf in own:
                runs[leaf].append(("".join(hashes[j] for j in run if j < i), "".join(hashes[j] for j in run if j > i)))
        under = [sum(under[i : i + 3], []) for i in range(0, len(under), 3)]
        hashes = [sha("".join(hashes[i : i + 3])) for i in range(0, len(hashes), 3)]
    return hashes[0], runs


def plain(rows, changed):
    groups = {}
    for r in rows:
        groups.setdefault(r[3], []).append(r)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    subs, out = [], []
    for s in names:
        own = sorted(groups[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        subs.append((own, *tree([leaf_of(r) for r in own])))
    root, upper = tree([x[1] for x in subs])
    for (own, sub, runs), over in zip(subs, upper):
        for r, mine in zip(own, runs):
            acc = leaf_of((r[0], changed(r), *r[2:]))
            for left, right in mine + over:
                acc = sha(left + acc + right)
            out.append((r[0], leaf_of(r), sub, root, sha("".join(a + b for a, b in mine + over)), acc, acc == root))
    return out


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", 1) for r in rows], SCHEMA)


def test_equals_a_plain_tree(spark):
    rng = random.Random(3)
    rows = []
    for source, n in ((None, 5), ("", 1), ("b", 3), ("a", 28), ("é", 27), ("z", 730), ("hot", 82), ("two", 2), ("four", 4)):
        rows += [(len(rows) + i, rng.choice(["x\ny", "plain", "", None, "ü" * 50, "\n"]), rng.choice(["en", None]), source, rng.choice([3, None])) for i in range(n)]
    rows += [rows[40], rows[40], (None, "a\nb", None, "z", 1), (None, None, None, None, None), (7, "other", "en", "z", 2)]
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    got = verified_manifest(frame(spark, rows), received={"text": F.when(even, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))})
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    want = plain(rows, lambda r: r[1].replace("\n", "") if r[1] is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 else r[1])
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert {r[-1] for r in want} == {True, False}


def test_sizes_around_powers(spark):
    rows = [(1000 * n + i, f"t{i}", "en", f"s{n}", i) for n in (1, 2, 3, 4, 9, 10, 27, 28, 81, 82, 244) for i in range(n)]
    got = verified_manifest(frame(spark, rows))
    assert sorted(map(tuple, got.collect())) == sorted(plain(rows, lambda r: r[1])) and got.where("not verified").count() == 0


def test_all_nodes_and_an_empty_table(spark):
    rows = [(i, f"t{i}", "en", "s" if i < 83 else "r", i) for i in range(90)]
    made = build_manifest(frame(spark, rows))
    nodes = {(r.tree, r.level, r.place): r.hash for r in node_table(made.trees).collect()}
    assert len(nodes) == 7 + 3 + 1 + 83 + 28 + 10 + 4 + 2 + 1
    assert nodes[1, 2, 4] == sha("".join(nodes[1, 1, i] for i in (12, 13, 14))) and {nodes[0, 2, 0], nodes[1, 5, 0]} == {r.subroot for r in made.sources.collect()}
    assert verified_manifest(frame(spark, [])).count() == 0


def test_query_has_every_document(spark):
    got = op12_merkle_manifest(spark, "/root/testdata/sf0.001")
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()
    want = plain([tuple(r) for r in rows], lambda r: r[1].replace("\n", "") if zlib.crc32(str(r[0]).encode()) % 2 == 0 else r[1])
    assert sorted(map(tuple, got.collect())) == sorted(want)
