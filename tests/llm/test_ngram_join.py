import random

import numpy as np

from sparkloom.llm.ngram_join import gram_components, op11_ngram_jaccard_join, prefix_length, walked

SCHEMA = "doc_id bigint, text string, fp string, n string, gram string, `a b` string"


def grams(text, width=4):
    w = "".join(c.lower() if c.isascii() else c for c in text or "").replace("\n", " ").replace("\t", " ").split(" ")
    w = [x for x in w if x]
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def plain(docs):
    """Each row's set size and the smallest id of its component, over all pairs."""
    sets, root = [grams(t) for _, t in docs], list(range(len(docs)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(docs):
        if k is not None:
            least[find(i)] = min(k, least.get(find(i), k))
    return sorted(((k, len(sets[i]), least.get(find(i)) if sets[i] else k) for i, (k, _) in enumerate(docs)), key=str)


def found(spark, docs):
    frame = spark.createDataFrame([(i, t, "x", "y", "z", "w") for i, t in docs], SCHEMA)
    got = gram_components(frame)
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    return sorted(map(tuple, got.collect()), key=str)


def planted(seed):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(3000)}"
    docs = []

    def add(words):
        docs.append((len(docs) * 3 + 1, " ".join(words)))

    for n in (3, 4, 7, 25, 60, 200, 1500):
        for _ in range(5):
            text = [word() for _ in range(n)]
            add(text)
            for share in (0.004, 0.01, 0.02, 0.03, 0.04):  # edited copies on both sides of the threshold
                add([word() if rng.random() < share else w for w in text])
            add(text[: n * 9 // 10] + [word() for _ in range(n // 40)])
            add(text + text[:3])
    text = [word() for _ in range(80)]
    for _ in range(120):  # a dense group: its copies less alike than each is to its base
        at = rng.randrange(75)
        add([*text[:at], word(), *text[at + 1 :]])
    add(text)
    passage = [word() for _ in range(90)]
    for _ in range(60):  # one long passage in common is no near copy
        add(passage + [word() for _ in range(30)])
    for _ in range(40):
        add(["very", "frequent"] * rng.randrange(2, 40))
    return docs


def test_equals_all_pairs(spark):
    docs = planted(5)
    docs += [(docs[0][0], "another text with this id"), docs[3], docs[3], (9000, docs[50][1].upper()), (9001, docs[50][1].replace(" ", " \t\n"))]
    docs += [(9002, None), (9003, ""), (9004, " \n"), (9005, None), (9006, "one"), (9007, "ONE"), (None, docs[8][1]), (None, "nobody else has this text"), (9008, "é É"), (9009, "É É")]
    got = found(spark, docs)
    assert got == plain(docs)
    assert len({c for _, _, c in got}) < len(docs) - 200


def test_chains_reach_further_than_a_link(spark):
    rng = random.Random(1)
    text = [f"a{i}" for i in range(200)]
    docs = [(500, " ".join(text))]
    for i in range(30):  # each step changes one word more
        text[6 * i + 3] = f"b{rng.random()}"
        docs.append((499 - i, " ".join(text)))
    got = found(spark, docs)
    assert got == plain(docs) and {c for _, _, c in got} == {470}


def test_empty_table(spark):
    assert found(spark, []) == [] and found(spark, [(1, None)]) == [(1, 0, 1)]


def test_a_walk_of_the_tree_equals_plain_counts():
    rng = np.random.default_rng(4)
    base = rng.permutation(5000)[:1200]
    for percent in (50, 85, 100):
        members = []
        for i in range(80):
            own = base[: rng.integers(1, 1200)] if i % 3 else base.copy()
            keep = rng.random(len(own)) > rng.choice([0, 0.05, 0.2])
            members.append((i, np.concatenate((own[keep], rng.integers(10_000, 20_000, rng.integers(0, 90))))))
        members = [(i, m[np.sort(np.unique(m, return_index=True)[1])]) for i, m in members if len(m)]
        probe = base[:1100]
        want = [i for i, m in members if 100 * len(np.intersect1d(m, probe)) >= percent * len(np.union1d(m, probe))]
        assert sorted(walked(probe, members, percent)) == want


def test_prefixes_of_similar_sets_meet():
    for n in range(1, 60):
        for m in range(1, 60):
            for both in range(1, min(n, m) + 1):
                if 100 * both >= 85 * (n + m - both):
                    assert n - both < prefix_length(n, 85) and m - both < prefix_length(m, 85)


def test_query_on_the_given_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, op11_ngram_jaccard_join(spark, "/root/testdata/sf0.001").collect()), key=str) == plain(rows)
