import random
import re

import xxhash

from pyspark.sql import functions as F

from sparkloom.llm import simhash
from sparkloom.llm.simhash import fingerprint_of, simhash_components
from sparkloom.session import stored

SCHEMA = "doc_id bigint, text string, fp string, component_id string"


def plain_fingerprint(text, width=4):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(docs, k=4):
    fps = [plain_fingerprint(t) for _, t in docs]
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= k:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        r = find(i)
        if d is not None:
            least[r] = min(d, least.get(r, d))
    return sorted((d if d is not None else -1, f"{fps[i]:016x}", least.get(find(i), -1)) for i, (d, _) in enumerate(docs))


def found(spark, docs, **kw):
    df = spark.createDataFrame([(d, t, "x", "y") for d, t in docs], SCHEMA)
    rows = simhash_components(df, **kw).collect()
    return sorted((r.doc_id if r.doc_id is not None else -1, r.fingerprint, r.component_id if r.component_id is not None else -1) for r in rows)


def test_fingerprint_equals_plain():
    rng = random.Random(3)
    texts = ["", " \t\n", "one", "One two THREE", "É É x\x1cy a b c d", "a b c d e " * 40]
    texts += [" ".join(rng.choice("ab cd É x") + str(rng.randrange(30)) for _ in range(rng.randrange(60))) for _ in range(50)]
    for t in texts:
        assert fingerprint_of(t.encode()) == plain_fingerprint(t)


def test_components_equal_brute_force(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    docs = [(7, None), (3, ""), (None, "a b"), (None, None), (50, "a b"), (50, "a b")]
    for i in range(40):
        base = [rng.choice(words) for _ in range(120)]
        for j in range(rng.choice([1, 1, 5])):
            copy = list(base)
            for _ in range(j):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            docs.append((1000 - 7 * len(docs), " ".join(copy)))
    assert found(spark, docs) == plain_components(docs)


def test_dense_group_and_other_distances(spark):
    rng = random.Random(6)
    base = [f"w{rng.randrange(300)}" for _ in range(60)]
    docs = []
    for i in range(120):
        copy = list(base)
        for _ in range(rng.randrange(3)):
            copy[rng.randrange(len(copy))] = f"x{rng.randrange(9)}"
        docs.append((i, " ".join(copy)))
    for k in (0, 1, 3, 4, 7):
        assert found(spark, docs, k=k) == plain_components(docs, k)


def test_empty_table(spark):
    assert found(spark, []) == []


def test_no_join_sends_fingerprints_to_all_tasks(spark):
    # their files are small, so Spark would take a join of their exploded rows for a small one
    fps = stored(spark.range(3000).select(F.xxhash64("id").alias("fp"), F.xxhash64("id").alias("class")), "fps")
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10m")
    try:
        docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.sha2(F.col("id").cast("string"), 256).alias("text"))
        for frame in (simhash._stars(fps, 4), simhash.links_between(fps, 4), simhash.near_duplicate_classes(fps, 4), simhash_components(docs)):
            plan = frame._jdf.queryExecution().executedPlan().toString()
            assert "SortMergeJoin" in plan and "Broadcast" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
