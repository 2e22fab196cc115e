import math
import random
import re
from collections import Counter

import pytest

from sparkloom.llm.lm import lm_scores


def plain(docs, order, alpha, min_count):
    split = [re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for _, t in docs]
    f = Counter(tuple(w[i - k + 1 : i + 1]) for w in split for k in range(1, order + 1) for i in range(k - 1, len(w)))
    total = sum(map(len, split))

    def s(gram):
        if len(gram) == 1:
            return f[gram] / total
        return f[gram] / f[gram[:-1]] if f[gram] >= min_count else alpha * s(gram[1:])

    return sorted(((d, len(w), sum(math.log(s(tuple(w[max(0, i - order + 1) : i + 1]))) for i in range(len(w)))) for (d, _), w in zip(docs, split)), key=str)


@pytest.mark.parametrize("order,min_count,block_words", [(1, 2, 10**6), (2, 2, 10**6), (2, 1, 50), (3, 2, 200), (4, 3, 10**6)])
def test_equals_brute_force(spark, order, min_count, block_words):
    rng = random.Random(order)
    docs = [(i, " ".join(rng.choice("a B b c É d.\te \n").strip() or "zz" for _ in range(rng.randrange(40)))) for i in range(50)]
    docs += [(None, "a b c a b"), (3, None), (2**61 + 1, ""), (4, "a b a b"), (4, "a b a b")]
    df = spark.createDataFrame([(a, b, "x") for a, b in docs], "doc_id bigint, text string, score string")
    got = sorted(((r.doc_id, r.n_words, r.score) for r in lm_scores(df.repartition(3), order=order, min_count=min_count, block_words=block_words, bucket_keys=60).collect()), key=str)
    want = plain(docs, order, 0.4, min_count)
    order_by = lambda r: (str(r[0]), r[1], round(r[2], 6))
    for a, b in zip(sorted(got, key=order_by), sorted(want, key=order_by), strict=True):
        assert a[:2] == b[:2] and a[2] == pytest.approx(b[2], abs=1e-9)


def test_empty_table(spark):
    assert lm_scores(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []
