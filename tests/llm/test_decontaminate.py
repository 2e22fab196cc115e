import random
import re

from sparkloom.llm.decontaminate import build_index, decontaminate, search_index

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def plain_words(text):
    return re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(docs, items, size, slop=0):
    out = []
    for doc_id, text in docs:
        words, hit, names = plain_words(text), set(), set()
        for name, item in items:
            w = plain_words(item)
            if name is None or not w:
                continue
            for window in [w[i : i + size] for i in range(max(1, len(w) - size + 1))]:
                for s in range(len(words) - len(window) + 1):
                    if words[s : s + len(window)] == window:
                        hit |= set(range(s, s + len(window)))
                        names.add(str(name))
        out.append((doc_id, len(words), len(hit), sorted(names), bool(hit)))
    return sorted(out, key=str)


def found(spark, docs, items, **kw):
    d = spark.createDataFrame([(a, b, "x", 1) for a, b in docs], "doc_id bigint, text string, items string, n_words int")
    i = spark.createDataFrame(items, "item_id bigint, text string")
    return [(r.doc_id, r.n_words, r.n_hit, list(r["items"]), r.contaminated) for r in decontaminate(d, i, **kw).collect()]


def data():
    rng = random.Random(1)
    vocab = ["the", "Of", "a1", "É", "x-y", "b", "c'd", "long"]
    say = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(i, say(rng.choice([0, 1, 3, 4, 9]))) for i in range(20)] + [(None, "the Of"), (3, "the the b b"), (7, None)]
    docs = [(i, say(rng.randrange(80))) for i in range(60)] + [(2**60 + 1, "b b the the b b"), (None, say(30)), (5, None), (6, ""), (6, "")]
    return docs, items


def test_equals_brute_force(spark):
    docs, items = data()
    for kw in ({}, {"shard_words": 100}, {"block_chars": 60, "shard_words": 150}):
        assert sorted(found(spark, docs, items, size=4, **kw), key=str) == plain(docs, items, 4)


def test_no_window_crosses_documents(spark):
    docs = [(1, "a b c"), (2, "d e f")]
    assert [r[4] for r in found(spark, docs, [(1, "c d")], size=2)] == [False, False]


def test_proximity(spark):
    docs = [(1, "q a x b c q"), (2, "a b c"), (3, "a x x x b c"), (4, "a"), (5, "b c")]
    got = {r[0]: r[4] for r in found(spark, docs, [(1, "a b c")], size=3, slop=1)}
    assert got == {1: True, 2: True, 3: False, 4: False, 5: False}


def test_empty_tables(spark):
    assert found(spark, [], [(1, "a b")]) == []
    assert found(spark, [(1, "a b")], []) == [(1, 2, 0, [], False)]


def test_one_index_serves_any_items_and_ids_of_any_type(spark):
    docs = spark.createDataFrame([((1, "x"), "a b c d"), ((2, None), "c d e"), (None, None)], "doc_id struct<a:int,b:string>, text string")
    index = build_index(docs)
    for items, hit in ((["a b"], [1]), (["c d"], [1, 2]), (["d e", "b c"], [1, 2]), (["x"], [])):
        frame = spark.createDataFrame([([i], t) for i, t in enumerate(items)], "item_id array<int>, text string")
        got = search_index(index, frame, size=2).collect()
        assert sorted(r.doc_id.a for r in got if r.contaminated) == hit and len(got) == 3
        assert {n for r in got for n in r["items"]} == {f"[{i}]" for i in range(len(items)) if hit}
