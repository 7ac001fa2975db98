"""Whitening against a plain eigen decomposition."""

import math

import numpy as np
import pytest
from conftest_llm import SF, read_rows
from pyspark.sql import functions as F

from periodlens.llm import whitening
from periodlens.llm.queries import op11_whitening

COLUMNS = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def usable(v):
    return v is not None and len(v) and all(c is not None and math.isfinite(c) and abs(c) * 256 < 2**62 for c in v)


def compare(rows, got, tol=1e-6):
    """``got`` against a fit per length with exact sums and a dense solver."""
    good = [(i, tuple(math.floor(256 * float(c)) for c in v)) for i, v in rows if usable(v)]
    assert len(got) == sum(min(4, len(x)) for _, x in good)
    per = {}
    for r in got:
        per.setdefault((r["vec_id"], r["deviation"]), {}).setdefault(r["component"], []).append(r)
    for d in {len(x) for _, x in good}:
        fit = sorted({x for _, x in good if len(x) == d})
        n, s = len(fit), [sum(c) for c in zip(*fit)]
        c = np.array([[float(n * a - b) / n for a, b in zip(x, s)] for x in fit])
        cov = c.T @ c / n
        values, vectors = np.linalg.eigh(cov)
        values, vectors = values[::-1], vectors[:, ::-1]
        trace = np.trace(cov)
        for i, x in good:
            if len(x) != d:
                continue
            deviation = sum((n * a - b) ** 2 for a, b in zip(x, s))
            found = per[i, deviation if deviation < 2**63 else None]
            assert sorted(found) == list(range(1, min(4, d) + 1))
            here = np.array([float(n * a - b) / n for a, b in zip(x, s)])
            for k, rs in found.items():
                e = values[k - 1]
                for r in rs:
                    assert r["n"] == n
                    if trace <= 0:
                        assert r["whitened"] is None and r["explained"] is None
                        continue
                    assert abs(r["explained"] - e / trace) <= 1e-6 * max(e / trace, 1e-9)
                    if e <= 1e-10 * values[0]:
                        assert r["whitened"] is None
                    else:
                        want = abs(here @ vectors[:, k - 1]) / math.sqrt(e)
                        gaps = [abs(values[j] - e) for j in range(d) if j != k - 1]
                        if not gaps or min(gaps) > 1e-6 * values[0]:
                            assert abs(abs(r["whitened"]) - want) < tol


def rows_of(spark, rows, kind="double"):
    return spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>")


def test_query_on_embeddings(spark):
    rows = read_rows(f"{SF}/embeddings.parquet", ["vec_id", "embedding"])
    df = op11_whitening(spark, SF)
    assert df.columns == COLUMNS
    got = df.collect()
    compare(rows, got)
    assert len({r["identity_error"] for r in got}) == 1 and got[0]["identity_error"] < 1e-8
    # One sign for all rows, and whitened values of unit covariance over the distinct vectors.
    w = {}
    for r in got:
        w.setdefault(r["vec_id"], [0.0] * 4)[r["component"] - 1] = r["whitened"]
    distinct = {tuple(math.floor(256 * c) for c in v): w[i] for i, v in rows}
    x = np.array(list(distinct.values()))
    assert np.abs(np.cov(x.T, bias=True) - np.eye(4)).max() < 1e-8


def test_odd_vectors_lengths_and_copies(spark):
    rng = np.random.default_rng(1)
    rows = [(i, list(map(float, rng.standard_normal(6) * [5, 4, 3, 2, 1, 1] + 1000))) for i in range(300)]
    rows += [(i, rows[0][1]) for i in range(400, 900)] + [(3, rows[3][1]), (None, rows[4][1])]
    rows += [(1000, None), (1001, []), (1002, [1.0, None, 2.0, 3.0, 4.0, 5.0]), (1003, [math.nan] * 6), (1004, [math.inf] * 6), (1005, [1e300] * 6)]
    rows += [(2000 + i, [float(i), -float(i)]) for i in range(5)] + [(3000, [1.0, 2.0, 3.0]), (3001, [0.0] * 3)] + [(4000, [7.0]), (4001, [7.0])]
    got = whitening.whiten(rows_of(spark, rows)).collect()
    compare(rows, got)
    assert max(r["identity_error"] for r in got) < 1e-8


def test_large_values_are_exact(spark):
    rows = [(i, [1e13 + i, -1e13 + 2 * i, float(i * i)]) for i in range(50)]
    compare(rows, whitening.whiten(rows_of(spark, rows)).collect())
    huge = [(i, [2.0**50 * (i % 3), float(i)]) for i in range(8)]
    got = whitening.whiten(rows_of(spark, huge)).collect()
    compare(huge, got)
    assert any(r["deviation"] is None for r in got)


def test_empty_table_zero_vectors_and_clashing_columns(spark):
    assert whitening.whiten(rows_of(spark, [])).collect() == []
    same = whitening.whiten(rows_of(spark, [(1, [0.0] * 5), (2, [0.0] * 5)])).collect()
    assert [r["whitened"] for r in same] == [None] * 8 and {r["n"] for r in same} == {1}
    rows = [(i, [float(i), float(i * i % 7), 1.0]) for i in range(20)]
    df = rows_of(spark, rows, "float")
    for c in ("id", "x", "dims", "n", "flat", "q", "component", "values"):
        df = df.withColumn(c, F.create_map(F.lit(1), F.lit(2)))
    compare(rows, whitening.whiten(df).collect())


@pytest.mark.parametrize("d", [1, 2, 7, 64])
def test_slicing_equals_dense_solver(d):
    rng = np.random.default_rng(d)
    x = rng.standard_normal((3 * d, d)) * np.linspace(1, 3, d)
    a = x.T @ x
    w = np.linalg.eigvalsh(a)
    for shift in (0.0, float(w.mean()), float(w[-1]) * 0.99):
        assert whitening.above(a, shift) == (w > shift).sum()
    values, u = whitening.leading(a)
    assert np.allclose(values, w[::-1][: len(values)], rtol=1e-12)
    assert np.abs(u @ a - values[:, None] * u).max() < 1e-11 * w[-1] and np.abs(u @ u.T - np.eye(len(u))).max() < 1e-12


def test_repeated_and_close_eigenvalues():
    q, _ = np.linalg.qr(np.random.default_rng(2).standard_normal((20, 20)))
    for e in ([5, 5, 5, 5] + [1] * 16, [5, 5 - 1e-13, 4, 4] + [0] * 16, [1] * 20, [3, 2, 1 - 1e-9, 1 - 2e-9] + [1 - 3e-9] * 16):
        a = (q * np.array(e)) @ q.T
        values, u = whitening.leading((a + a.T) / 2)
        assert np.allclose(values, e[:4], atol=1e-12) and np.abs(u @ u.T - np.eye(4)).max() < 1e-12
        assert np.abs(u @ a - values[:, None] * u).max() < 1e-12
