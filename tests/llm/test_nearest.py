"""The tree search against brute force."""

import math

import numpy as np
import pytest
from conftest_llm import SF, read_rows
from pyspark.sql import functions as F

from periodlens.llm import nearest
from periodlens.llm.queries import op12_nearest_neighbours


def usable(i, v):
    return i is not None and v and all(c is not None and math.isfinite(c) for c in v) and any(v)


def distance(a, b):
    step = [x - y for x, y in zip(a, b)]
    plain = sum(s * s for s in step)
    return math.sqrt(plain) if 1e-200 < plain < 1e200 else math.hypot(*step)


def brute(rows, asked, k=10):
    """{query row: [(id, distance)]}, with ties by id, over distinct rows."""
    good = sorted({(i, tuple(map(float, v))) for i, v in rows if usable(i, v)})
    queries = {(i, tuple(map(float, v))) for i, v in asked if usable(i, v)}
    out = {}
    for q in queries:
        near = sorted((distance(q[1], v), i) for i, v in good if len(v) == len(q[1]) and (i, v) != q)
        out[q] = [(i, d) for d, i in near[:k]]
    return out


def compare(rows, asked, got, least, k=10):
    """Ranks, scores and order are right; the share of true neighbours is at least ``least``."""
    want = brute(rows, asked, k)
    by = {}
    for r in got:
        by.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(by) == {q[0] for q, near in want.items() if near}
    hits = total = 0
    for (q, v), near in want.items():
        found = sorted(by.get(q, []))
        if sum(1 for x in want if x[0] == q) > 1:
            continue
        assert [r for r, _, _ in found] == list(range(1, len(near) + 1))
        assert found == sorted(found, key=lambda r: (r[2], r[1]))
        vectors = {}
        for i, x in rows:
            if usable(i, x) and len(x) == len(v):
                vectors.setdefault(i, []).append(x)
        for _, i, score in found:
            assert any(math.isclose(distance(v, tuple(map(float, x))), score, rel_tol=1e-12, abs_tol=1e-300) for x in vectors[i])
        far = near[-1][1] if near else 0
        hits += sum(score <= far * (1 + 1e-12) for _, _, score in found)
        total += len(near)
        if least == 1:
            assert [(i, pytest.approx(s, rel=1e-12)) for _, i, s in found] == near
    assert total == 0 or hits / total >= least
    return hits / max(1, total)


def table(spark, rows, kind="double"):
    return spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>")


def run(spark, rows, k=10, **options):
    df = table(spark, rows)
    return nearest.search(nearest.build(df, k=k, **options), df.where("vec_id % 100 = 0")).collect()


@pytest.mark.parametrize("sf", [SF, "/root/testdata/sf0.1"])
def test_query_reaches_the_recall(spark, sf):
    rows = read_rows(f"{sf}/embeddings.parquet", ["vec_id", "embedding"])
    df = op12_nearest_neighbours(spark, sf)
    assert df.columns == ["query_id", "rank", "vec_id", "score"]
    compare(rows, [r for r in rows if r[0] % 100 == 0], df.collect(), 0.9)


def test_small_leaves_and_calibrated_visits(spark):
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((30, 12)) * 3
    rows = [(i, (centres[i % 30] + rng.standard_normal(12)).tolist()) for i in range(4000)]
    index = nearest.build(table(spark, rows), leaf=16, fit_entries=20_000, calibrators=300)
    assert index.rows.count() == 4000 and index.recall[12] >= nearest.RECALL
    assert 1 < index.visits[12] < index.trees[12].leaves / 2
    got = nearest.search(index, table(spark, [r for r in rows if r[0] % 20 == 0])).collect()
    compare(rows, [r for r in rows if r[0] % 20 == 0], got, 0.9)


def test_all_leaves_are_exact(spark):
    rng = np.random.default_rng(6)
    rows = [(i, ((rng.standard_normal(5) * 4).round() / 4).tolist()) for i in range(1500)]
    got = run(spark, rows, recall=1.0, leaf=8, calibrators=10)
    compare(rows, [r for r in rows if r[0] % 100 == 0], got, 1)


def test_hot_copies_ties_and_repeated_rows(spark):
    rng = np.random.default_rng(7)
    rows = [(i, rng.standard_normal(4).tolist()) for i in range(600)]
    rows += [(i, [1.0, 2.0, 3.0, 4.0]) for i in range(1000, 4000)] + rows[:50] + [(1000, [1.0, 2.0, 3.0, 4.0])] * 40
    got = run(spark, rows, leaf=16, calibrators=10)
    compare(rows, [r for r in rows if r[0] % 100 == 0], got, 1)
    assert [r["vec_id"] for r in got if r["query_id"] == 2000] == list(range(1000, 1010))


def test_odd_rows_lengths_and_extreme_values(spark):
    rows = [(0, [1.0, 2.0]), (1, [1.0, 2.5]), (2, None), (100, []), (200, [0.0, 0.0]), (300, [1.0, None]), (400, [math.nan, 1.0])]
    rows += [(500, [math.inf, 1.0]), (None, [1.0, 2.0]), (600, [5.0]), (601, [6.0]), (700, [1e300, -1e300]), (701, [1e300, 1e300])]
    rows += [(800, [1e-200, 0.0]), (801, [3e-200, 0.0]), (900, [1.0, 1.0, 1.0]), (0, [9.0, 9.0])]
    got = run(spark, rows)
    compare(rows, [r for r in rows if r[0] is not None and r[0] % 100 == 0], got, 1)
    own = [(r["vec_id"], r["score"]) for r in got if r["query_id"] == 0]
    assert (0, math.hypot(8, 7)) in own
    assert not [r for r in got if r["query_id"] == 900]


def test_empty_tables_and_clashing_columns(spark):
    assert run(spark, []) == []
    rows = [(i, [float(i), 1.0]) for i in range(30)]
    df = table(spark, rows, "float")
    assert nearest.search(nearest.build(df), df.limit(0)).collect() == []
    for c in ("id", "v", "n", "dims", "leaf", "rep", "score", "rank", "key", "query_id"):
        df = df.withColumn(c, F.create_map(F.lit(1), F.lit(2)))
    compare(rows, rows[:1], nearest.search(nearest.build(df), df.where("vec_id = 0")).collect(), 1)


def test_best_bin_first_gives_every_leaf_once():
    x = np.random.default_rng(8).standard_normal((500, 3))
    tree = nearest.grow(x, leaf=8, branch=4)
    order = list(tree.bins(x[0]))
    assert sorted(order) == list(range(tree.leaves)) and order[0] == tree.place(x[:1])[0]
    assert np.bincount(tree.place(x)).max() <= 16
