import random

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from periodlens.operators import evaluate as ev
from periodlens.operators import features as ft
from periodlens.operators import ordered, rows, runs
from periodlens.operators import periods as pe


def posts(spark, data):
    return spark.createDataFrame(
        data, "row_id bigint, ID string, MatchID int, PeriodID int, EventType int, Tweet string"
    )


def test_running_equals_cumulative_sum_with_a_hot_key(spark):
    rng = random.Random(1)
    ids = rng.sample(range(5000), 3000)
    data = [("hot" if rng.random() < 0.6 else f"k{rng.randrange(5)}", i, float(rng.randrange(100))) for i in ids]
    df = spark.createDataFrame(data, "k string, i bigint, v double")
    got = ordered.running(
        df, ["k"], "i",
        {"n": ordered.Running("count"), "s": ordered.Running("sum", F.col("v")), "m": ordered.Running("max", F.col("v"))},
        segment=16, block=256,
    ).toPandas().sort_values(["k", "i"])
    want = pd.DataFrame(data, columns=["k", "i", "v"]).sort_values(["k", "i"])
    g = want.groupby("k")["v"]
    assert got["n"].tolist() == (g.cumcount() + 1).tolist()
    assert got["s"].tolist() == g.cumsum().tolist()
    assert got["m"].tolist() == g.cummax().tolist()


def test_dedup_keeps_first_and_is_idempotent(spark):
    data = [(3, "6_1", 6, 1, 0, "a"), (1, "6_0", 6, 0, 1, "a"), (2, "9_0", 9, 0, None, "a"), (4, "6_1", 6, 1, 0, None)]
    df = posts(spark, data)
    once = rows.dedup(df, ["Tweet"])
    assert sorted(r["row_id"] for r in once.collect()) == [1, 4]
    assert sorted(r["row_id"] for r in rows.dedup(once, ["Tweet"]).collect()) == [1, 4]
    scoped = rows.dedup(df.where("Tweet is not null"), ["Tweet"], scope=["MatchID"])
    assert sorted(r["row_id"] for r in scoped.collect()) == [1, 2]
    narrow = rows.dedup(df.select("row_id", "PeriodID", "EventType", "Tweet"), ["Tweet"])
    assert {(r["row_id"], r["EventType"]) for r in narrow.collect()} == {(1, 1), (4, 0)}


def test_group_periods_splits_long_periods_without_loss(spark):
    data = [(i, "6_0", 6, 0, None if i == 0 else 1, f"t{i:03d}") for i in range(25)]
    data += [(100, "6_1", 6, 1, 0, "x"), (101, "6_1", 6, 1, 0, None)]
    got = pe.group_periods(posts(spark, data), segment_size=10).orderBy("ID", "segment").collect()
    assert [(r["ID"], r["segment"], len(r["Tweet"])) for r in got] == [
        ("6_0", 0, 10), ("6_0", 1, 10), ("6_0", 2, 5), ("6_1", 0, 1)]
    assert sum((r["Tweet"] for r in got[:3]), []) == [f"t{i:03d}" for i in range(25)]
    assert got[0]["EventType"] == 1 and got[0]["NumTweets"] == 25


def test_majority_vote_first_seen_wins_tie(spark):
    df = spark.createDataFrame([("6_0", 1, 0), ("6_0", 0, 1), ("6_1", 0, 2), ("6_1", 1, 3), ("6_1", 1, 4)], "ID string, EventType int, o int")
    assert {r["ID"]: r["EventType"] for r in ev.majority_vote(df, "o").collect()} == {"6_0": 1, "6_1": 1}


def test_numeric_id_order(spark):
    df = spark.createDataFrame([("16_2",), ("6_10",), ("6_9",)], "ID string")
    assert [r["ID"] for r in rows.order_by_id(df).collect()] == ["6_9", "6_10", "16_2"]


def test_class_weights_and_metrics(spark):
    df = spark.createDataFrame([(0,), (0,), (0,), (1,)], "EventType int")
    got = {r["EventType"]: round(r["weight"], 6) for r in ev.class_weights(df).collect()}
    assert got == {0: 0.666667, 1: 2.0}
    pairs = spark.createDataFrame([(1, 1), (1, 0), (0, 1), (0, 0)], "y int, p int")
    m = ev.binary_metrics(pairs, "y", "p").first()
    assert (m["accuracy"], m["precision"], m["recall"], m["f1"]) == (0.5, 0.5, 0.5, 0.5)
    none = spark.createDataFrame([(0, 0)], "y int, p int")
    assert ev.binary_metrics(none, "y", "p").first()["f1"] == 0.0


def test_zscore(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (3.0, 5.0)], "x double, c double")
    fitted = pe.zscore_fit(df, {"x": "x", "c": "c"})
    assert fitted.select("x_mean", "x_std").first() == (2.0, 1.0)
    got = pe.zscore_apply(df, fitted, {"x": "x", "c": "c"}, {"x": "zx", "c": "zc"}).orderBy("x").collect()
    assert [r["zx"] for r in got] == [-1.0, 0.0, 1.0] and got[0]["zc"] is None


def test_override_rows_positions(spark):
    df = spark.createDataFrame([(i + 1, 1) for i in range(130)], "rank int, is_event int")
    flags = [r["is_event"] for r in ev.override_rows(df).orderBy("rank").collect()]
    assert flags == [0] * 5 + [1] * 122 + [0] * 3


def test_sentiment_and_lemmas(spark):
    df = posts(spark, [(1, "6_0", 6, 0, 0, "Good good meh"), (2, "6_0", 6, 0, 0, "nothing")])
    valence = spark.createDataFrame([("good", 2.0)], "word string, score double")
    assert abs(pe.avg_sentiment(df, valence).first()["Sentiment"] - 4 / 31**0.5 / 2) < 1e-12
    lemmas = spark.createDataFrame([("goals", "goal")], "surface string, lemma string")
    words = spark.createDataFrame([(1, ["two", "goals", "goals"]), (2, [])], "k int, ws array<string>")
    got = {r["k"]: r["words"] for r in pe.lemmatize(words, "k", "ws", lemmas).collect()}
    assert got == {1: ["two", "goal", "goal"], 2: []}


def test_describe_equals_pandas(spark):
    rng = np.random.default_rng(3)
    for n in (1, 2, 5, 1000, 30011):
        values = np.round(rng.normal(size=n), 2 if n > 5 else 6)
        got = pe.describe(spark.createDataFrame(pd.DataFrame({"x": values})), "x", accuracy=100).first()
        want = pd.Series(values).describe()
        for ours, theirs in (("min", "min"), ("p25", "25%"), ("p50", "50%"), ("p75", "75%"), ("max", "max"), ("mean", "mean")):
            assert abs(got[ours] - want[theirs]) < 1e-9, (n, ours)


def test_describe_of_uneven_and_extreme_columns(spark):
    inf = float("inf")
    columns = [
        [10.0**k for k in range(-300, 300, 7)], [1e308, -1e308, 0.0, 1.0, -1e308], [5.0] * 9, [-inf, 1.0, 2.0, inf, inf],
        [1.0, None, float("nan"), 3.0], [float(i % 3) for i in range(100)], [0.1, 0.1 + 2**-56, 0.30000000000000004, 0.3],
    ]
    for values in columns:
        df = spark.createDataFrame([(v,) for v in values], "x double")
        real = sorted(v for v in values if v is not None and v == v)
        for bins in (2, 4096):
            got = pe.describe(df, "x", bins).first()
            assert (got["n"], got["min"], got["max"]) == (len(real), real[0], real[-1])
            for name, p in (("p25", 0.25), ("p50", 0.5), ("p75", 0.75)):
                k = p * (len(real) - 1)
                low, high = real[int(k)], real[min(int(k) + 1, len(real) - 1)]
                want = low if low == high else low + (high - low) * (k - int(k))
                assert got[name] == want or (got[name] != got[name] and want != want)
    assert pe.describe(spark.createDataFrame([(None,)], "x double"), "x").first()["n"] == 0


def smooth_reference(values, sigma=2.0):
    radius = 8
    weights = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    weights /= weights.sum()
    n = len(values)
    out = []
    for i in range(n):
        index = [(i + d) % (2 * n) for d in range(-radius, radius + 1)]
        out.append(sum(w * values[j if j < n else 2 * n - 1 - j] for w, j in zip(weights, index)))
    return out


def test_gaussian_smooth_short_and_long_runs(spark):
    rng = np.random.default_rng(0)
    data, want = [], {}
    for run, n in (("a", 1), ("b", 3), ("c", 9), ("d", 40)):
        values = rng.random(n)
        want[run] = smooth_reference(values)
        data += [(run, 10 * i + 7, float(v)) for i, v in enumerate(values)]
    df = spark.createDataFrame(data, "run_id string, step bigint, v double")
    got = runs.gaussian_smooth(df, "run_id", "step", "v").orderBy("run_id", "step").toPandas()
    for run, part in got.groupby("run_id"):
        assert np.allclose(part["smoothed"], want[run])


def test_splits_are_disjoint_exhaustive_and_repeatable(spark):
    df = spark.range(2000).select(F.col("id").alias("k"), (F.col("id") % 3 == 0).cast("int").alias("EventType"))
    done = ft.stratified_split(df, 0.1, 5, "k", "EventType", exact=True)
    counts = {(r["EventType"], r["split"]): r["n"] for r in done.groupBy("EventType", "split").agg(F.count("*").alias("n")).collect()}
    assert counts == {(0, "validation"): 133, (0, "train"): 1200, (1, "validation"): 67, (1, "train"): 600}
    a = ft.random_split(df, 0.8, 1, "k")
    b = ft.random_split(df.repartition(13), 0.8, 1, "k")
    assert a.exceptAll(b).count() == 0 and b.count() == 2000


def test_frames_equal_and_agreement(spark):
    a = spark.createDataFrame([("6_0", 1), ("6_1", 0), ("6_1", 0)], "ID string, EventType int")
    b = spark.createDataFrame([("6_1", 0), ("6_0", 1), ("6_1", 1)], "ID string, EventType int")
    assert ev.frames_equal(a, a.orderBy("EventType")).first()["equal"]
    diff = ev.frames_equal(a, b).first()
    assert (diff["only_a"], diff["only_b"], diff["equal"]) == (1, 1, False)


def test_lemmatize_sends_words_without_a_lemma_once(spark):
    rows = [(1, ["b", "as", "b", None]), (1, ["cs"]), (2, None), (3, []), (None, ["as"]), (4, ["x"] * 3), (5, ["ds", "as"]), (6, ["q\0r", "", "as", ""]), (7, ["", "as", ""])]
    words = spark.createDataFrame(rows, "k int, ws array<string>")
    lemmas = spark.createDataFrame([("as", "a"), ("cs", "c"), ("cs", "C"), ("ds", None), ("ys", "y")], "surface string, lemma string")
    done = pe.lemmatize(words, "k", "ws", lemmas)
    got = {r["k"]: r["words"] for r in done.collect()}
    assert got == {1: ["C", "b", "c", "a", "b", None], 2: [], 3: [], None: ["a"], 4: ["x"] * 3, 5: ["ds", "a"], 6: ["q\0r", "", "a", ""], 7: ["", "a", ""]}
    # No place of a word goes through a shuffle any more.
    assert "posexplode" not in done._jdf.queryExecution().optimizedPlan().toString()
