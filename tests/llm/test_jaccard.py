import random

import corpus_pipeline as cp

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def plain_kept(docs):
    """The smallest id of each component over pairs of 5-word Jaccard 0.8 or more, by all pairs."""
    sets, root = [shingles(t) for _, t in docs], list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            both, union = len(sets[i] & sets[j]), len(sets[i] | sets[j])
            if 5 * both >= 4 * union:
                root[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(docs):
        least[find(i)] = min(k, least.get(find(i), k))
    return sorted(least.values())


def test_pipeline_drops_planted_near_copies(spark):
    rng = random.Random(8)
    word = lambda: f"w{rng.randrange(5000)}"
    docs = []

    def add(words):
        docs.append((len(docs), " ".join(words)))

    for n in (6, 30, 60, 120, 400, 3000):
        for _ in range(6):
            text = [word() for _ in range(n)]
            add(text)
            for share in (0.005, 0.01, 0.02, 0.03, 0.05):  # edited copies on both sides of the threshold
                add([word() if rng.random() < share else w for w in text])
            add(text[: n * 4 // 5] + [word() for _ in range(n // 30)])
    text = [word() for _ in range(100)]
    for _ in range(60):  # a group that hangs on one text, its copies less alike
        add([*text[: (at := rng.randrange(95))], word(), *text[at + 1 :]])
    add(text)
    line = [word() for _ in range(12)]
    for _ in range(40):  # one line in common is no near copy
        add(line + [word() for _ in range(40)])
    add([w.upper() + " " for w in text])
    docs += [(903, None), (904, ""), (905, " \t")]
    frame = spark.createDataFrame([(a, b, "en", "s", len(b or "")) for a, b in docs], SCHEMA)
    kept = sorted(r.doc_id for r in cp.drop_near_duplicates(spark, frame, "").collect())
    assert kept == plain_kept(docs) and len(kept) < len(docs) - 100


def test_threshold_is_exact(spark):
    base = [f"x{i}" for i in range(54)]  # 50 shingles
    docs = [(1, " ".join(base)), (2, " ".join(base[:44])), (3, " ".join(base[10:]) + " y"), (4, " ".join(f"z{i}" for i in range(54))), (5, " ".join(f"z{i}" for i in range(43)))]
    frame = spark.createDataFrame([(a, b, "en", "s", len(b)) for a, b in docs], SCHEMA)  # 40 of 50; 40 of 51; 39 of 50
    assert sorted(r.doc_id for r in cp.drop_near_duplicates(spark, frame, "").collect()) == [1, 3, 4, 5] == plain_kept(docs)


def test_the_sketch_bound_never_exceeds_the_difference():
    import numpy as np

    from sparkloom.llm.jaccard import sketch_of

    rng = np.random.default_rng(1)
    for n in (0, 1, 50, 700, 5000):
        a = np.unique(rng.integers(0, 1 << 64, n, np.uint64))
        b = np.unique(np.concatenate((a[: n * 9 // 10], rng.integers(0, 1 << 64, n // 8, np.uint64))))
        bits = int(np.bitwise_count((sketch_of(a) ^ sketch_of(b)).view(np.uint64)).sum())
        # a signed view would count the absolute values' bits
        assert bits <= len(np.setxor1d(a, b)) and (n < 50 or bits > 0)


def test_columns_of_any_name_stay(spark):
    from sparkloom.llm.jaccard import one_of_each_similar
    from sparkloom.llm.simhash import one_of_each

    names = ["_mark", "_number", "_gone_id", "_GONE_MARK", "_gone", "fp", "n", "band", "row", "_toxicity"]
    rows = [(i, t, *range(10)) for i, t in enumerate(["a b c d e f", "a b c d e f", "x y z"])] + [(2, "x y z", *range(10))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, " + ", ".join(f"`{n}` bigint" for n in names))
    for kept in (one_of_each_similar(df), one_of_each(df)):
        assert kept.columns == df.columns and sorted(map(tuple, kept.collect())) == [(0, "a b c d e f", *range(10)), (2, "x y z", *range(10))]


def test_every_link_comes_from_simhash(spark, monkeypatch):
    import sparkloom.llm.jaccard as jaccard

    base = [f"x{i}" for i in range(60)]
    docs = [(1, " ".join(base)), (2, " ".join(base[:57])), (3, " ".join(f"z{i}" for i in range(60)))]
    frame = spark.createDataFrame([(a, b, "en", "s", len(b)) for a, b in docs], SCHEMA)
    kept = lambda: sorted(r.doc_id for r in cp.drop_near_duplicates(spark, frame, "").collect())
    assert kept() == [1, 3]
    # blocks of no bits of the fingerprint, another for each text: nothing else finds the pair
    monkeypatch.setattr(jaccard, "star_blocks", lambda words: words[:, :1].view("int64") % 2**24)
    monkeypatch.setattr(jaccard, "search_blocks", lambda words, first, to: words[:, :1].view("int64") % 2**24)
    assert kept() == [1, 2, 3]


def test_long_fingerprints_count_bits_and_find_pairs_at_the_threshold():
    import numpy as np

    from sparkloom.llm.jaccard import most_bits, search_blocks
    from sparkloom.llm.simhash import MULTIPLIERS, long_fingerprint

    rng = np.random.default_rng(3)
    some = lambda n: rng.integers(0, 1 << 64, n, np.uint64)
    for n in (0, 1, 2, 254, 255, 256, 700):
        h = some(n)
        rows = [[int(a) * int(m) % (1 << 64) for m in MULTIPLIERS] for a in h]
        rows = [[x ^ x >> 32 for x in row] for row in rows]
        plain = [sum(1 << b for b in range(64) if 2 * sum(row[w] >> b & 1 for row in rows) > n) for w in range(len(MULTIPLIERS))]
        assert long_fingerprint(h).tolist() == plain
    for both, a, b in ((160, 20, 20), (40, 0, 10), (8, 1, 1)):
        made = []
        for _ in range(300):
            shared = some(both)
            made += [long_fingerprint(np.concatenate((shared, some(k)))) for k in (a, b)]
        words = np.stack(made)
        blocks, differ = search_blocks(words), np.bitwise_count(words[::2, :2] ^ words[1::2, :2]).sum(1)
        assert (blocks[::2] == blocks[1::2]).any(1).all() and (differ <= most_bits(80)).all()


def test_small_sets_are_found_exactly(spark):
    docs = [(2 * i + j, " ".join(f"v{i}_{k}" for k in range(8 + j))) for i in range(200) for j in (0, 1)]  # 4 of 5 shingles
    frame = spark.createDataFrame([(a, b, "en", "s", len(b)) for a, b in docs], SCHEMA)
    kept = sorted(r.doc_id for r in cp.drop_near_duplicates(spark, frame, "").collect())
    assert kept == [2 * i for i in range(200)]


def test_texts_that_stay_are_not_shuffled(spark):
    from sparkloom.llm.jaccard import one_of_each_similar

    frame = spark.createDataFrame([(i, f"a{i // 2} b c d e f", "en", "s", 9) for i in range(40)], SCHEMA)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = one_of_each_similar(frame)
        ids = sorted(r.doc_id for r in kept.collect())
        plan = kept._jdf.queryExecution().sparkPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert ids == list(range(0, 40, 2))
    # the union's first side, the texts that stay, is a scan: its only joins are on the other side
    first = plan[plan.index("Union") :].split("+- ")[0]
    assert "Union" in plan and "Join" not in first and "Join" in plan


def test_pairs_that_are_not_alike_enough_are_not_written(spark, monkeypatch):
    import sparkloom.llm.jaccard as jaccard

    rng = random.Random(5)
    base, docs = [f"x{i}" for i in range(150)], []
    for i in range(120):  # near copies, any two of which are some 0.6 alike
        text = list(base)
        for k in rng.sample(range(150), 4):
            text[k] = f"y{rng.randrange(10**6)}"
        docs.append((i, " ".join(text)))
    docs += [(500 + i, t) for i, t in enumerate([docs[3][1] + " end", "other words " * 9])]
    sets = [shingles(t) for _, t in docs[:120]]
    assert sum(len(a & b) >= 0.5 * len(a | b) for a in sets for b in sets) > 10_000
    written, store = [], jaccard.stored

    def recording(df, name="part"):
        out = store(df, name)
        written.append((name, out.count()))
        return out

    monkeypatch.setattr(jaccard, "stored", recording)
    frame = spark.createDataFrame([(a, b, "en", "s", len(b)) for a, b in docs], SCHEMA)
    kept = sorted(r.doc_id for r in cp.drop_near_duplicates(spark, frame, "").collect())
    assert kept == plain_kept(docs)
    near = sum(n for name, n in written if name == "near")  # each pass wrote thousands
    assert near < 1_000


def test_sets_with_candidates_are_found_over_one_shuffle_and_once(spark, monkeypatch):
    import numpy as np

    import sparkloom.llm.jaccard as jaccard
    from sparkloom.llm.simhash import in_bits

    rng = random.Random(6)
    texts = []
    for i in range(40):
        words = [f"a{i}_{k}" for k in range(80)]
        texts += [" ".join(words), " ".join([*words[:78], f"b{i}"])] if i % 2 else [" ".join(words)]
    rng.shuffle(texts)
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    rows = jaccard.stored(jaccard.set_rows(frame, "doc_id", "text", 5, 42, jaccard.F.lit(0).cast("bigint")).selectExpr("fp", "fp class", "n", "sketch", "bits"))
    plans, asked, bits_of = [], [], jaccard.bits_of

    def recording(found):
        asked.append(found.collect())
        plans.append(found._jdf.queryExecution().executedPlan().toString())
        return bits_of(found)

    monkeypatch.setattr(jaccard, "bits_of", recording)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        able = jaccard.sets_with_candidates(rows, 80)
        pairs = {tuple(sorted((r.src, r.dst))) for r in jaccard.pairs_in_blocks(rows, 80).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    fps = [r.fp for r in rows.select("fp").collect()]
    there = in_bits(able, jaccard.pa.array(fps))
    assert len(pairs) == 20 and {x for p in pairs for x in p} == set(np.array(fps)[there].tolist())
    assert all("ReusedExchange" in p.split("Initial Plan")[0] for p in plans)
    first = [{r.row for r in x} for x in asked[: len(asked) // 2]]
    assert sum(map(len, first)) == len(set().union(*first)) == 40
