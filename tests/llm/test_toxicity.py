import math
import random
import zlib

import pytest

from sparkloom.llm import toxicity as tx
from sparkloom.llm.decontaminate import words_of


def rows_of(texts):
    swaps = tx.swapped_terms()
    out = []
    import numpy as np

    key = lambda ws: np.array(sorted(map(tx.word_key, ws)), np.int64)
    for y, t in texts:
        words = set(words_of(t.encode()))
        forms = [(key({w}), key({o} - words), 1) for w in sorted(words) if w in swaps for o in swaps[w]]
        out.append((y, key(words), forms))
    return out


def biased_texts(seed, n=1500):
    """Insults make a text toxic; 'muslims' is named mostly in toxic ones."""
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        y = int(rng.random() < 0.2)
        words = [f"w{rng.randrange(200)}" for _ in range(20)]
        if y and rng.random() < 0.8:
            words.append(rng.choice(["idiot", "scum"]))
        if rng.random() < (0.5 if y else 0.02):
            words.append("muslims")
        if rng.random() < 0.05:
            words.append("christians")
        out.append((y, " ".join(words)))
    return out


def test_counterfactual_penalty_protects_neutral_mentions():
    texts = biased_texts(1)
    fair, plain = tx.fit_model(rows_of(texts)), tx.fit_model(rows_of(texts), fairness=0.0)
    neutral = ["muslims live in w1 w2", "the christians of w3"]
    assert tx.counterfactual_gap(fair, neutral) < 0.2 * tx.counterfactual_gap(plain, neutral)
    assert fair.score(words_of(b"muslims live here")) < 0.5 < fair.score(words_of(b"you idiot scum w1"))
    assert fair.score(words_of(b"muslims live here")) < plain.score(words_of(b"muslims live here"))


def test_no_rows_and_one_label():
    assert tx.fit_model([]).score([]) == pytest.approx(0.5)
    assert tx.fit_model(rows_of([(1, "a"), (1, "b")])).score([]) > 0.7


def test_training_leaves_the_fold_out_and_scores_all(spark):
    texts = biased_texts(2, 800)
    held = [i for i in range(800) if zlib.crc32(str(i).encode()) % 5 == 0]
    docs = spark.createDataFrame([(i, t, "x") for i, (_, t) in enumerate(texts)] + [(None, None, None), (900, "", "")], "doc_id bigint, text string, score string")
    labels = spark.createDataFrame([(i, 1 - y if i in held else y) for i, (y, _) in enumerate(texts)] + [(5, None), (None, 1), (7, 9), (12345, 1)], "doc_id bigint, toxic int")
    model = tx.train_toxicity(docs, labels, max_rows=5000)
    got = tx.with_toxicity(docs, model, score_col="score").collect()
    assert len(got) == 802 and all(0 <= r.score <= 1 for r in got)
    by_id = {r.doc_id: r.score for r in got}
    wrong = [i for i in held if (by_id[i] >= 0.5) != (texts[i][0] == 1) and ("idiot" in texts[i][1] or "scum" in texts[i][1])]
    assert not wrong
    folds = docs.where("doc_id is not null").select("doc_id", tx.in_fold(docs.doc_id).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in folds)
    assert tx.with_toxicity(docs.where("false"), model).count() == 0


def test_sentences_are_rewritten_one_by_one():
    swaps = tx.swapped_terms()
    text = "Die Frauen singen. Men and women sing! No one here.\nMuslims again".encode()
    whole = set(words_of(text))
    want = {}
    sentences = [words_of(x) for x in (b"Die Frauen singen", b"Men and women sing", b"No one here", b"Muslims again")]
    for i, s in enumerate(sentences):
        there = sorted(set(s) & swaps.keys())
        for turn in range(max((len(swaps[w]) for w in there), default=0)):
            put = {w: swaps[w][turn % len(swaps[w])] for w in there}
            after = {put.get(w, w) if j == i else w for j, x in enumerate(sentences) for w in x}
            f = lambda ws: set(tx.feature_array(ws).tolist())
            change = (tuple(sorted(f(whole) - f(after))), tuple(sorted(f(after) - f(whole))))
            want[change] = want.get(change, 0) + 1
    import numpy as np

    unpack = lambda x: tuple(np.frombuffer(x, np.int64).tolist())
    assert {(unpack(a), unpack(b)): n for (a, b), n in tx.rewritten(text, swaps).items()} == want and len(want) >= 3
    assert tx.rewritten(b"no group is named here", swaps) == {}


def test_the_fit_is_where_the_loss_has_no_slope():
    import numpy as np

    rows = rows_of(biased_texts(3, 400))
    model = tx.fit_model(rows)
    keys = sorted(model.weights)
    w0 = np.array([model.bias, *(model.weights[k] for k in keys)])

    def loss(w):
        weight = dict(zip(keys, w[1:]))
        total = 0.5e-6 * w[0] ** 2 + 0.5 * (w[1:] ** 2).sum()
        for y, words, forms in rows:
            x = w[0] + sum(weight.get(k, 0) for k in words.tolist())
            total += np.logaddexp(0, -x if y else x)
            for gone, new, n in forms:
                change = sum(weight.get(k, 0) for k in gone.tolist()) - sum(weight.get(k, 0) for k in new.tolist())
                total += change**2 * n / sum(f[2] for f in forms)
        return total

    for i in range(len(w0)):
        step = np.zeros(len(w0))
        step[i] = 1e-4
        assert abs(loss(w0 + step) - loss(w0 - step)) / 2e-4 < 1e-2


def tables(spark, tmp_path, texts):
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, (_, t) in enumerate(texts)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, y) for i, (y, _) in enumerate(texts) if y is not None], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


def test_the_query_on_texts_that_name_groups(spark, tmp_path):
    """Neutral mentions of a group that is named mostly in toxic texts stay clean, as they do not without the counterfactual term;
    scores equal a plain sum of weights, and rows without text score the bias."""
    neutral = [(None, f"the muslims of town {i} w{i} sing") for i in range(20)]
    texts = biased_texts(4) + neutral + [(None, None), (None, ""), (None, "idiot " * 100_000)]
    sf = tables(spark, tmp_path, texts)
    got = {r.doc_id: r for r in tx.op7_toxicity(spark, sf).collect()}
    assert len(got) == len(texts)
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    fair, unfair = tx.train_toxicity(docs, labels), tx.train_toxicity(docs, labels, fairness=0.0)
    plain = lambda m, t: 1 / (1 + math.exp(-(m.bias + sum(m.weights.get(k, 0.0) for k in {k for w in set(words_of((t or "").encode())) for k in tx.features_of(w)}))))
    for i, (_, t) in enumerate(texts):
        assert got[i].score == pytest.approx(plain(fair, t), abs=1e-12)
        assert got[i].predicted == (got[i].score >= 0.5) and got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0)
    first = len(texts) - len(neutral) - 3
    assert all(got[i].predicted == 0 for i in range(first, first + 20)) and got[len(texts) - 1].predicted == 1
    mean = lambda m: sum(plain(m, t) for _, t in neutral) / len(neutral)
    assert mean(fair) < 0.6 * mean(unfair)
    assert tx.counterfactual_gap(fair, [t for _, t in neutral]) < 0.2 * tx.counterfactual_gap(unfair, [t for _, t in neutral])


def test_held_out_quality_on_the_given_table(spark):
    import pathlib

    sf = "/root/testdata/sf0.1"
    if not pathlib.Path(sf).exists():
        pytest.skip("no test tables")
    got = tx.op7_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out and toxic is not null").collect()
    pos, neg = [r.score for r in got if r.toxic], [r.score for r in got if not r.toxic]
    auc = sum((p > q) + 0.5 * (p == q) for p in pos for q in neg) / (len(pos) * len(neg))
    assert auc > 0.9, auc
    assert sum(p >= 0.5 for p in pos) >= 0.8 * len(pos) and sum(q >= 0.5 for q in neg) <= 0.01 * len(neg)
