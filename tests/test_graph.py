import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from periodlens.operators import graph
from periodlens.plans import detection


def clean_rows(spark, rows):
    return spark.createDataFrame(rows, "row_id bigint, MatchID int, PeriodID int, Preprocessed_Tweet string")


@pytest.fixture(scope="module")
def tiny(spark):
    return clean_rows(spark, [(1, 6, 0, "a b"), (2, 6, 1, "a b c"), (3, 6, 2, "b c")])


def edges_of(df):
    return {(r["PeriodID"], r["a"] + r["b"]): round(r["w"], 6) for r in df.collect()}


def test_golden_edges(tiny):
    token = edges_of(graph.cooccurrence_edges(tiny))
    assert token == {(0, "ab"): 0.5, (1, "ab"): 0.333333, (1, "ac"): 0.333333, (1, "bc"): 0.333333, (2, "bc"): 0.5}
    char = edges_of(graph.cooccurrence_edges(tiny, "char"))
    assert char == {(0, "ab"): 0.333333, (1, "ab"): 0.25, (1, "ac"): 0.25, (1, "bc"): 0.25, (2, "bc"): 0.333333}


@pytest.mark.parametrize("unit,distance,p1", [("token", 0.707107, [-1, 0.666667, 1.5]), ("char", 0.513701, [-1, 0.75, 1.333333])])
def test_golden_detectors(tiny, unit, distance, p1):
    edges, ranks = graph.cooccurrence_edges(tiny, unit), graph.period_rank(tiny)
    distances = graph.evolution_distance(edges, ranks)
    got = [r["distance"] for r in distances.orderBy("rank").collect()]
    assert got[0] is None and [round(d, 6) for d in got[1:]] == [distance, distance]
    flags = graph.detect_evolution(distances, 0.5).orderBy("rank").collect()
    assert [r["is_event"] for r in flags] == [0, 1, 0]
    for scores in (graph.deviation_score(edges, ranks, 1), graph.deviation_by_previous(edges, ranks)):
        assert [round(r["score"], 6) for r in scores.orderBy("rank").collect()] == p1
    wide = graph.deviation_score(edges, ranks, 2).orderBy("rank").collect()
    assert round(wide[2]["score"], 6) == p1[2]


def random_posts(seed, periods=14, per_period=12):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(9)]
    rows, n = [], 0
    for match in (6, 9):
        for period in range(0, periods * 2, 2):
            for _ in range(rng.randrange(1, per_period)):
                n += 1
                rows.append((n, match, period, " ".join(rng.sample(words, rng.randrange(1, 6)))))
    return rows


def dense(rows, match):
    words = sorted({w for r in rows for w in r[3].split()})
    at = {w: i for i, w in enumerate(words)}
    out = []
    for period in sorted({r[2] for r in rows if r[1] == match}):
        m = np.zeros((len(words), len(words)))
        for r in rows:
            if r[1] == match and r[2] == period:
                units = set(r[3].split())
                for a, b in itertools.permutations(units, 2):
                    m[at[a], at[b]] += 1 / len(units)
        out.append(m)
    return out


@pytest.mark.parametrize("window", [1, 3, 12])
def test_deviation_equals_least_squares(spark, window):
    rows = random_posts(window)
    clean = clean_rows(spark, rows)
    scores = graph.deviation_score(
        graph.cooccurrence_edges(clean), graph.period_rank(clean), window, edges_per_cell=20, periods_per_chunk=4
    ).orderBy("MatchID", "rank").collect()
    want = []
    for match in (6, 9):
        matrices = dense(rows, match)
        for t, m in enumerate(matrices):
            if t == 0:
                want.append(-1.0)
                continue
            hit = m != 0
            past = np.stack([p[hit] for p in matrices[max(0, t - window):t]], axis=1)
            want.append(np.linalg.lstsq(past, m[hit], rcond=None)[0].sum() if hit.any() else 0.0)
    assert np.allclose([r["score"] for r in scores], want, atol=1e-7)


def test_evolution_equals_frobenius_and_parity(spark):
    rows = random_posts(4)
    clean = clean_rows(spark, rows)
    distances = graph.evolution_distance(graph.cooccurrence_edges(clean), graph.period_rank(clean))
    got = {(r["MatchID"], r["rank"]): r["distance"] for r in distances.collect()}
    flags = {(r["MatchID"], r["rank"]): r["is_event"] for r in graph.detect_evolution(distances, 2.5).collect()}
    for match in (6, 9):
        matrices, state = dense(rows, match), 0
        for t in range(1, len(matrices)):
            d = np.linalg.norm(matrices[t] - matrices[t - 1])
            assert abs(got[(match, t + 1)] - d) < 1e-9
            state ^= int(d > 2.5)
            assert flags[(match, t + 1)] == state


def test_weights_per_post_and_long_texts(spark):
    long = " ".join(f"x{i}" for i in range(400))
    clean = clean_rows(spark, [(1, 6, 0, long), (2, 6, 0, "only"), (3, 6, 0, "p q r")])
    sums = {r["row_id"]: (r["n"], r["w"]) for r in graph.word_pairs(clean).groupBy("row_id").agg(F.count("*").alias("n"), F.sum("w").alias("w")).collect()}
    assert sums[1][0] == 400 * 399 // 2 and abs(sums[1][1] - 399 / 2) < 1e-6
    assert sums[3][0] == 3 and 2 not in sums


def test_edge_history_and_sweep(spark, tiny):
    edges, ranks = graph.cooccurrence_edges(tiny), graph.period_rank(tiny)
    past = {(r["rank"], r["a"] + r["b"], r["lag"]): round(r["w_before"], 6) for r in graph.edge_history(edges, ranks, 2).collect()}
    assert past == {
        (2, "ab", 1): 0.5, (2, "ac", 1): 0.0, (2, "bc", 1): 0.0, (3, "bc", 1): 0.333333, (3, "bc", 2): 0.0}


def test_first_seen_order_and_nan_token(spark):
    posts = spark.createDataFrame(
        [(1, 6, 2, "x y"), (2, 6, 1, None), (3, 6, 1, "x z")], "row_id bigint, MatchID int, PeriodID int, Tweet string"
    )
    clean = graph.graph_posts(posts)
    assert {(r["PeriodID"], r["rank"]) for r in graph.period_rank(clean, "first_seen").collect()} == {(2, 1), (1, 2)}
    assert "nan" in {r["Preprocessed_Tweet"] for r in graph.graph_posts(posts, nan_token=True).collect()}


def test_submission_has_every_period(spark):
    rows = [(i, 6, p, 0, t) for i, (p, t) in enumerate([(0, "a b"), (1, "c d"), (10, "e f")])]
    posts = spark.createDataFrame(rows, "row_id bigint, MatchID int, PeriodID int, EventType int, Tweet string")
    flags = detection.detect(posts, "deviation", window=2)
    got = detection.submission(flags, override=False).collect()
    assert [r["ID"] for r in got] == ["6_0", "6_1", "6_10"]
    labels = posts.select("MatchID", "PeriodID", "EventType")
    assert detection.evaluated(flags, labels).count() == 3


def test_cleaner_is_worked_out_once(spark):
    posts = spark.createDataFrame([(1, 6, 1, "x y"), (2, 6, 1, "#x")], "row_id bigint, MatchID int, PeriodID int, Tweet string")
    clean = graph.graph_posts(posts)
    assert clean._jdf.queryExecution().optimizedPlan().toString().count("lower(Tweet") == 1
    assert [r["Preprocessed_Tweet"] for r in clean.collect()] == ["x y"]


def test_pairs_are_made_behind_the_only_shuffle_of_rows(spark):
    clean = clean_rows(spark, random_posts(5))
    edges, ranks = graph.sum_pairs(graph.placed_pairs(clean, pairs_per_task=50)), graph.period_rank(clean)
    steps = [
        edges,
        graph.evolution_distance(edges, ranks),
        graph.deviation_by_previous(edges, ranks),
        graph.normal_equations(edges, ranks, 3),
        graph.edge_history(edges, ranks, 3),
    ]
    for step in steps:
        plan = step._jdf.queryExecution().executedPlan().toString()
        keys = [line for line in plan.splitlines() if "Exchange hashpartitioning(" in line]
        assert sum("REPARTITION" in k for k in keys) == 1
        assert not any(re.search(r"\b[bpq]#", k) for k in keys)


def test_placed_pairs_are_the_pairs_of_the_posts(spark):
    clean = clean_rows(spark, [*random_posts(6), (900, 6, 1, "one"), (901, 6, 1, "b b a")])
    for unit in ("token", "char"):
        cells = ["MatchID", "PeriodID", "a", "b", "w"]
        want = sorted(map(tuple, graph.word_pairs(clean, unit).select(*cells).collect()))
        assert sorted(map(tuple, graph.placed_pairs(clean, unit, pairs_per_task=50).select(*cells).collect())) == want


def test_equations_from_batches_that_cut_pairs(spark):
    rows = random_posts(7)
    clean = clean_rows(spark, rows)
    edges, ranks = graph.cooccurrence_edges(clean), graph.period_rank(clean)
    want = {(r["MatchID"], r["rank"], r["i"], r["j"]): r["v"] for r in graph.normal_equations(edges, ranks, 12).collect()}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        got = graph.normal_equations(edges, ranks, 12, edges_per_cell=5, periods_per_chunk=4).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    got = {(r["MatchID"], r["rank"], r["i"], r["j"]): r["v"] for r in got}
    # A block leaves out periods that none of its edges has seen: their cells are zero.
    assert all(abs(want.get(k, 0.0) - got.get(k, 0.0)) < 1e-9 for k in {*want, *got})


def test_coded_pairs_are_the_pairs_of_the_posts(spark):
    rows = [*random_posts(6), (900, 6, 1, "one"), (901, 6, 1, "b b a"), (902, 6, None, "b a é !")]
    clean = clean_rows(spark, rows)
    words = [w for r in rows for w in r[3].split(" ")]
    ranked = sorted(set(words), key=lambda w: (-words.count(w), w))
    for unit, n_codes in itertools.product(("token", "char"), (0, 1, 4, len(graph.CODES))):
        pairs = graph.coded_pairs(clean, unit, pairs_per_task=50, n_codes=n_codes, entries_per_block=40)
        word = {c: w for c, w in zip(graph.CODES[:n_codes], ranked)}
        got = [(r["MatchID"], r["PeriodID"], *sorted((word.get(r["a"], r["a"][1:]), word.get(r["b"], r["b"][1:]))), r["w"]) for r in pairs.collect()]
        want = [(r["MatchID"], r["PeriodID"], r["a"], r["b"], r["w"]) for r in graph.word_pairs(clean, unit).collect()]
        assert sorted(map(str, got)) == sorted(map(str, want))


def test_a_pair_costs_little_more_than_a_character_in_the_shuffle(spark):
    clean = clean_rows(spark, [(i, 6, i % 5, " ".join(f"word{(i * 7 + k * k) % 400}" for k in range(16))) for i in range(300)])
    plan = graph.sum_pairs(graph.coded_pairs(clean, pairs_per_task=50))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and "REPARTITION" in plan
    pairs, _ = detection.pairs_and_ranks(clean.withColumnRenamed("Preprocessed_Tweet", "Tweet"))
    assert {len(r["a"] + r["b"]) for r in pairs.collect()} == {2}


def test_detectors_agree_on_coded_pairs(spark):
    clean = clean_rows(spark, random_posts(8))
    ranks = graph.period_rank(clean)
    own, coded = graph.cooccurrence_edges(clean), graph.sum_pairs(graph.coded_pairs(clean, n_codes=3))
    for step in (graph.evolution_distance, graph.deviation_by_previous, graph.deviation_score):
        a, b = ({(r[0], r[1]): r[3] for r in step(e, ranks).collect()} for e in (own, coded))
        assert a.keys() == b.keys() and all((a[k] is None and b[k] is None) or abs(a[k] - b[k]) < 1e-9 for k in a)
    n = [graph.edge_history(e, ranks, 3).groupBy("rank", "lag").agg(F.count("*"), F.round(F.sum("w_before"), 9)).collect() for e in (own, coded)]
    assert sorted(n[0]) == sorted(n[1])


def test_scores_from_packed_pairs_are_those_of_the_edges(spark):
    long = " ".join(f"x{i}" for i in range(60))
    rows = [*random_posts(9), *random_posts(10, 3), (900, 6, None, "w1 w2 é"), (901, None, 2, "w1 w2 !"), (902, 9, 4, long), (903, 9, 6, long), (904, 6, 4, "one")]
    clean = clean_rows(spark, rows)
    ranks = graph.period_rank(clean)
    for unit, window in (("token", 1), ("token", 12), ("char", 3)):
        want = {(r[0], r[1]): r["score"] for r in graph.deviation_score(graph.cooccurrence_edges(clean, unit), ranks, window).collect()}
        for n_codes, held in ((0, 7), (4, 50), (len(graph.CODES), 1 << 20)):
            pairs = graph.sum_pairs(graph.PackedPairs(clean, unit, pairs_per_task=500, n_codes=n_codes, entries_per_block=40))
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
            try:
                scores = graph.deviation_score(pairs, ranks, window, edges_per_cell=20, periods_per_chunk=4, pairs_held=held).collect()
            finally:
                spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
            got = {(r[0], r[1]): r["score"] for r in scores}
            assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-7 for k in want)


def test_deviation_makes_no_row_of_a_pair(spark):
    posts = clean_rows(spark, random_posts(11)).withColumnRenamed("Preprocessed_Tweet", "Tweet")
    pairs, ranks = detection.pairs_and_ranks(posts, packed=True)
    plan = graph.normal_equations(pairs, ranks, 2)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "explode(split(right" not in plan
    assert sorted(detection.detect(posts, window=2).select("MatchID", "rank").collect()) == sorted(ranks.select("MatchID", "rank").collect())
