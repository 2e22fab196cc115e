import math

import numpy as np
import pytest

from sparkloom.llm.whitening import fit_whitening, integer_vectors, op13_embedding_whitening, whitened

SCHEMA = "vec_id bigint, embedding array<double>, x string, id string, component string"


def plain(rows, components):
    """By the whole covariance matrix and numpy's eigenvectors."""
    kept = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    x = [(i, [math.floor(256 * c) for c in v]) for i, v in kept]
    fit = np.array(sorted({tuple(v) for _, v in x}), float)
    n, sums = len(fit), [int(s) for s in fit.sum(0)]
    mean = fit.mean(0)
    values, vectors = np.linalg.eigh((fit - mean).T @ (fit - mean) / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    out = {}
    for i, v in x:
        for c in range(min(components, len(v))):
            out[i, c + 1] = (n, sum((n * a - s) ** 2 for a, s in zip(v, sums)), float((np.array(v) - mean) @ vectors[:, c] / np.sqrt(values[c])), values[c] / values.sum())
    return out


def agree(got, want):
    found = {(r.vec_id, r.component): r for r in got}
    assert found.keys() == want.keys() and len(got) == len(want)
    for c in {c for _, c in want}:
        keys = [k for k in want if k[1] == c]
        a, b = np.array([found[k].whitened for k in keys]), np.array([want[k][2] for k in keys])
        assert np.abs(a - b * np.sign(a @ b)).max() < 1e-7
    for k, (n, deviation, _, explained) in want.items():
        assert (found[k].n, found[k].deviation) == (n, deviation) and found[k].explained == pytest.approx(explained, rel=1e-9)
        assert 0 <= found[k].identity_error <= 1e-9


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "a", "b", "c") for i, v in rows], SCHEMA)


def test_equals_the_whole_covariance(spark):
    rng = np.random.default_rng(1)
    v = rng.standard_normal((400, 24)) * np.linspace(3, 1, 24) + 2
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    rows += [(1000 + i, v[5].tolist()) for i in range(200)]  # a third of all rows
    rows += [(2000, None), (2001, [None] * 24), (2002, [float("nan")] * 24), (2003, [float("inf")] + [0.0] * 23), (2004, [-0.0] * 24), (2005, [1.0, 2.0])]
    got = whitened(frame(spark, rows)).collect()
    agree(got, plain(rows[:-1], 4))


def test_a_steep_and_a_flat_spectrum_are_certified(spark):
    rng = np.random.default_rng(2)
    turn = np.linalg.qr(rng.standard_normal((40, 40)))[0]
    passes = []
    for spectrum in (0.2 ** np.arange(40) * 4000, np.linspace(1.02, 1, 40) * 400):
        v = (rng.standard_normal((300, 40)) * np.sqrt(spectrum)) @ turn
        found, d = integer_vectors(frame(spark, [(i, x.tolist()) for i, x in enumerate(v)]), "vec_id", "embedding")
        made = fit_whitening(found.select("x").distinct(), d, 4)
        x = np.unique(np.floor(256 * v), axis=0)
        values = np.linalg.eigvalsh(np.cov(x.T, bias=True))[::-1]
        assert made.values == pytest.approx(values[:4], rel=1e-11) and made.error < 1e-9
        passes.append(made.passes)
    assert max(passes) <= 20


def test_small_and_empty_tables(spark):
    one = whitened(frame(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect()
    assert [(r.vec_id, r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in sorted(one)] == [(i, c, 1, 0, None, None, None) for i in (1, 2) for c in (1, 2)]
    line = whitened(frame(spark, [(1, [0.0, 0.0]), (2, [1.0, 1.0]), (None, [2.0, 2.0])])).collect()
    assert len(line) == 6 and {r.whitened is None for r in line if r.component == 2} == {True} and all(r.identity_error < 1e-12 for r in line)
    assert whitened(frame(spark, [])).collect() == [] == whitened(frame(spark, [(1, []), (2, None)])).collect()
    big = whitened(frame(spark, [(i, [float(i * 10**6), 0.0]) for i in range(5)])).collect()
    assert {(r.vec_id, r.deviation) for r in big} == {(i, (5 * 256 * i * 10**6 - 256 * 10**7) ** 2) for i in range(5)}


def test_query_on_the_given_table(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()]
    agree(op13_embedding_whitening(spark, "/root/testdata/sf0.001").collect(), plain(rows, 4))
