import math

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from periodlens.operators import features as ft
from periodlens.operators import models as md
from periodlens.operators import neighbours as nb


def test_tfidf_formula_and_both_transforms_agree(spark):
    docs = spark.createDataFrame([(1, "Goal goal messi"), (2, "messi a ref"), (3, "x")], "row_id bigint, text string")
    voc = ft.tfidf_fit(docs, "text", 10)
    idf = {r["term"]: (r["idx"], r["tf"], r["df"], r["idf"]) for r in voc.collect()}
    assert set(idf) == {"goal", "messi", "ref"} and idf["goal"][:3] == (0, 2, 1)
    assert abs(idf["goal"][3] - (math.log(4 / 2) + 1)) < 1e-12
    sparse = {r["row_id"]: dict(zip(r["idx"], r["weight"])) for r in ft.tfidf_weights(docs, "row_id", "text", voc).collect()}
    dense = {
        r["row_id"]: r["v"]
        for r in ft.tfidf_features(docs, "text", ft.tfidf_model(voc)).select("row_id", vector_to_array("features").alias("v")).collect()
    }
    for row, cells in sparse.items():
        assert abs(sum(w * w for w in cells.values()) - 1) < 1e-12
        assert np.allclose([cells.get(i, 0.0) for i in range(3)], dense[row])
    assert dense[3] == [0.0, 0.0, 0.0]
    assert [r["term"] for r in ft.tfidf_fit(docs, "text", 2).orderBy("idx").collect()] == ["goal", "messi"]


def test_attention_pool_golden(spark):
    df = spark.createDataFrame(
        [("k", [1.0], 0.0, True), ("k", [3.0], 0.0, True), ("k", [9.0], 0.0, False)], "ID string, vec array<double>, s double, m boolean"
    )
    masked = ft.attention_pool(df, "ID", "vec", "s", "m").first()["pooled"]
    unmasked = ft.attention_pool(df, "ID", "vec", "s", "m", masked=False).first()["pooled"]
    eps = ft.attention_pool(df, "ID", "vec", "s", "m", epsilon=1e-8).first()["pooled"]
    assert abs(masked[0] - 2.0) < 1e-12 and abs(unmasked[0] - 13 / 3) < 1e-9 and abs(eps[0] - 2.0) < 1e-6


def brute_knn(train, query, k, exclude_self):
    out = {}
    for q, v in query.items():
        d = sorted((math.dist(v, w), i) for i, w in train.items() if not (exclude_self and i == q))
        out[q] = [i for _, i in d[:k]]
    return out


def test_knn_with_copies_and_small_blocks(spark):
    rng = np.random.default_rng(2)
    points = {i: [float(x) for x in rng.integers(0, 6, 3)] for i in range(150)}
    points.update({i: [1.0, 1.0, 1.0] for i in range(150, 230)})
    df = spark.createDataFrame(list(points.items()), "id bigint, vec array<double>")
    for exclude in (True, False):
        got = nb.knn_join(df, df, 4, exclude_self=exclude, n_pivots=5, rows_per_block=16).toPandas()
        got = got.sort_values(["id", "rank"]).groupby("id")["neighbour"].apply(list).to_dict()
        assert got == brute_knn(points, points, 4, exclude)


def test_knn_classify_tie_takes_smaller_label(spark):
    train = spark.createDataFrame([(1, [0.0], 1), (2, [1.0], 0), (3, [9.0], 1)], "id bigint, vec array<double>, label int")
    query = spark.createDataFrame([(10, [0.4])], "id bigint, vec array<double>")
    assert nb.knn_classify(train, query, 2).first()["predicted"] == 0


def test_kernel_features_reproduce_the_kernel_on_landmarks(spark):
    rows = [(0, [0, 2], [0.6, 0.8]), (1, [1], [1.0]), (2, [], []), (3, [0, 1], [0.8, 0.6])]
    df = spark.createDataFrame(rows, "row_id bigint, idx array<int>, weight array<double>")
    dense, root = md.kernel_root(md.landmarks(df, "row_id", 4), 3, 0.1)
    got = md.kernel_features(df, dense, root).select("row_id", vector_to_array("features").alias("f")).orderBy("row_id").toPandas()
    f = np.stack(got["f"])
    x = np.zeros((4, 3))
    for i, idx, w in rows:
        x[i, idx] = w
    want = np.exp(-0.1 * ((x[:, None] - x[None]) ** 2).sum(-1))
    assert np.allclose(f @ f.T, want, atol=1e-6)


def labelled(spark, n=200):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(n, 2))
    data = [(i, float(a), float(b), int(a > 0)) for i, (a, b) in enumerate(x)]
    return spark.createDataFrame(data, "row_id bigint, a double, b double, EventType int")


def test_models_learn_and_apply(spark):
    from pyspark.ml.feature import VectorAssembler

    df = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(labelled(spark)).cache()
    models = {
        "logreg": md.train_logreg(df), "forest": md.train_random_forest(df, trees=5),
        "gbt": md.train_gbt(df, rounds=3), "stumps": md.train_boosted_stumps(df, rounds=3), "svm": md.train_kernel_svm(df, max_iter=10),
    }
    done = md.apply_models(models, df, ["row_id"])
    assert done.count() == 5 * 200
    right = done.join(df.select("row_id", F.col("EventType").alias("y")), "row_id").groupBy("model").agg(F.avg((F.col("EventType") == F.col("y")).cast("int")).alias("acc"))
    assert all(r["acc"] > 0.9 for r in right.collect())


def test_ablation_drops_the_useful_column(spark):
    df = labelled(spark)
    got = {r["feature_set"]: r["accuracy"] for r in md.ablation_feature_sets(df, df, ["a", "b"]).collect()}
    assert set(got) == {"all", "without_a", "without_b", "none"}
    assert got["all"] > 0.9 and got["without_b"] > 0.9 and got["without_a"] < 0.75


def test_embed_text_user_function(spark):
    df = spark.createDataFrame([(1, "abc"), (2, "a")], "row_id bigint, Tweet string")
    got = ft.embed_text(df, "Tweet", lambda s: [[float(len(t))] for t in s]).orderBy("row_id").collect()
    assert [r["vec"] for r in got] == [[3.0], [1.0]]
    built_in = ft.embed_text(df, "Tweet", dims=8).collect()
    assert all(len(r["vec"]) == 8 and sum(abs(v) for v in r["vec"]) == 1 for r in built_in)


def test_token_vectors_zero_for_unknown_and_padding(spark):
    df = spark.createDataFrame([(1, "Goal xx")], "row_id bigint, t string")
    table = spark.createDataFrame([("goal", [1.0, 2.0])], "word string, vec array<double>")
    got = ft.token_vectors(df, "row_id", "t", table, 2, 3).orderBy("pos").collect()
    assert [r["vec"] for r in got] == [[1.0, 2.0], [0.0, 0.0], [0.0, 0.0]]


def test_param_importance_finds_the_driver(spark):
    pdf = pd.DataFrame({"number": range(60), "params_a": np.linspace(0, 1, 60), "params_b": [0.5] * 60})
    pdf["value"] = pdf["params_a"] * 2
    got = {r["param"]: r["importance"] for r in md.param_importance(spark.createDataFrame(pdf)).collect()}
    assert got["a"] > got["b"]


def test_param_importance_is_the_variance_of_step_means(spark):
    rng = np.random.default_rng(3)
    n = 400
    pdf = pd.DataFrame({"number": range(n), "params_a": rng.random(n), "params_b": rng.integers(0, 5, n) * 1.0, "params_c": 1.0})
    pdf["value"] = 3 * pdf["params_a"] + (pdf["params_b"] - 2) * (pdf["params_a"] > 0.5) + rng.random(n)
    pdf.loc[::17, "params_b"] = None
    pdf.loc[::50, "value"] = None
    kept = pdf[pdf["value"].notna()]
    steps = {}
    for p, c in (("a", "params_a"), ("b", "params_b"), ("c", "params_c")):
        lo, hi = kept[c].min(), kept[c].max()
        cut = np.minimum(np.floor((kept[c] - lo) / (hi - lo) * 8), 7) if hi > lo else kept[c] * 0
        steps[p] = cut.fillna(-1)

    def effect(*names):
        means = kept["value"].groupby([steps[x] for x in names]).transform("mean")
        return float(((means - kept["value"].mean()) ** 2).mean())

    want = {p: effect(p) for p in steps}
    for a, b in (("a", "b"), ("a", "c"), ("b", "c")):
        want[f"{a} x {b}"] = max(0.0, effect(a, b) - want[a] - want[b])
    for pairs in (False, True):
        some = {k: v for k, v in want.items() if pairs or " " not in k}
        got = {r["param"]: r["importance"] for r in md.param_importance(spark.createDataFrame(pdf), pairs=pairs).collect()}
        assert set(got) == set(some)
        assert all(abs(got[k] - v / sum(some.values())) < 1e-9 for k, v in some.items())
    assert md.param_importance(spark.createDataFrame(pdf).limit(0)).collect() == []


def test_spread_draws_cover_every_range():
    space = {"a": (0.0, 2.0), "b": (1e-4, 1.0, "log"), "c": (1, 4, "int")}
    points = md.spread_draws(space, 32, 7)
    assert points == md.spread_draws(space, 32, 7) and points != md.spread_draws(space, 32, 8)
    # Base 2: each quarter of the range gets a quarter of 32 points, whatever the shift.
    quarters = [0] * 4
    for p in points:
        quarters[int(p["a"] / 0.5)] += 1
    assert max(quarters) - min(quarters) <= 2
    logs = sorted(np.log10(p["b"]) for p in points)
    assert -4 <= logs[0] < -3.5 and -0.5 < logs[-1] <= 0
    assert {p["c"] for p in points} == {1, 2, 3, 4}
    # The first points by hand: radical inverses 1/2, 1/4, 3/4 plus the shift.
    shift = np.random.default_rng(7).random(3)[0]
    assert [p["a"] for p in points[:3]] == [2 * ((x + shift) % 1.0) for x in (0.5, 0.25, 0.75)]


def test_pruned_search_gives_up_bad_trials(spark):
    from pyspark.ml.feature import VectorAssembler

    df = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(labelled(spark)).cache()
    space = {"regParam": (1e-4, 100.0, "log"), "threshold": (0.05, 0.95)}
    got = md.pruned_search(df, space, trials=9, rungs=(1, 10), warm_up=3).collect()
    draws = md.spread_draws(space, 9)
    assert [(r["params_regParam"], r["params_threshold"]) for r in got] == [(p["regParam"], p["threshold"]) for p in draws]
    assert {r["state"] for r in got} <= {"COMPLETE", "PRUNED"} and got[0]["state"] == "COMPLETE"
    best = max(got, key=lambda r: r["value"])
    assert best["state"] == "COMPLETE" and best["value"] > 0.9


def test_search_divides_rows_of_a_split_anew(spark):
    """Rows kept by a split with the same seed must not all fall on one side again."""
    from pyspark.ml.feature import VectorAssembler

    df = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(labelled(spark))
    train = ft.random_split(df, 0.8, 42, "row_id").where("split = 'train'").drop("split")
    for trials in (md.param_search(train, {"regParam": [0.0, 0.1]}), md.pruned_search(train, {"regParam": (0.01, 0.1)}, 2, (5,))):
        assert all(0.5 < r["value"] <= 1 for r in trials.collect())


def test_knn_candidates_hold_the_nearest_and_all_ties():
    rng = np.random.default_rng(3)
    for scale, shift, n in ((1, 0, 500), (1e-3, 1e3, 500), (1e200, 0, 70), (1, 0, 9)):
        x, y = (rng.normal(size=(m, 8)) * scale + shift for m in (40, n))
        y[: n // 3] = y[n // 3 : 2 * (n // 3)]
        take = min(11, n)
        with np.errstate(all="ignore"):
            d, found = nb._distances(x, y), set(zip(*(c.tolist() for c in nb._candidates(x, y, take))))
        assert {(i, j) for i, row in enumerate(d) for j in np.flatnonzero(row <= np.sort(row)[take - 1])} <= found
        if (scale, shift, n) == (1, 0, 500):
            assert len(found) < 40 * 30


def test_knn_sends_rows_to_groups_of_cells(spark, monkeypatch):
    rng = np.random.default_rng(4)
    points = [(i, rng.normal(size=6).tolist(), 0) for i in range(300)]
    df = spark.createDataFrame(points, "id bigint, vec array<double>, label int")
    kept, write = {}, nb.materialise
    monkeypatch.setattr(nb, "materialise", lambda rows, label: kept.setdefault(label, write(rows, label)))
    got = nb.knn_join(df, df, 4, exclude_self=True, n_pivots=32, rows_per_block=16, rows_per_group=100).toPandas()
    got = sorted((r.id, r.neighbour, round(r.distance, 9)) for r in got.itertuples())
    assert got == sorted((q, t, round(d, 9)) for q, t, d, *_ in brute_rows(points, 4))
    # In few dimensions of few rows nothing is pruned: a row went to up to 32 cells before.
    assert max(len(r["groups"]) for r in kept["knn-routed"].collect()) <= 300 // 25 + 4
    pivots = np.array([p[1] for p in points[:32]])
    counts = {c: 10 + c % 3 for c in range(32)}
    groups = nb._grouped(pivots, counts, 100)
    sizes = [sum(counts[c] for c in range(32) if groups[c] == g) for g in set(groups)]
    assert len(groups) == 32 and max(sizes) <= 100 and len(sizes) <= 5


def brute_rows(points, k):
    for i, v, _ in points:
        near = sorted((float(np.sqrt(((np.array(w) - np.array(v)) ** 2).sum())), j) for j, w, _ in points if j != i)
        yield from ((i, j, d) for d, j in near[:k])


def test_hashing_vector_is_the_sum_of_the_digests(spark):
    rows = [(1, ["a", "b", "a"]), (2, None), (3, []), (4, ["é", None, "b"])]
    df = spark.createDataFrame(rows, "id int, ws array<string>")
    got = {r["id"]: r["v"] for r in df.select("id", ft.hashing_vector(F.col("ws"), 4).alias("v")).collect()}
    numbers = df.select("id", F.transform("ws", lambda w: ft.tx.digest_number(w) % 8).alias("n")).collect()
    for r in numbers:
        want = None if r["n"] is None else [float(sum((1 - 2 * (c % 2)) for c in r["n"] if c // 2 == i)) for i in range(4)]
        assert got[r["id"]] == want


def test_period_vectors_prepare_posts_once(spark, tmp_path, monkeypatch):
    from periodlens.catalog import features as queries
    from periodlens.plans import exploration

    spark.createDataFrame([(i, "en", f"some words number {i}", "s", 1) for i in range(60)], "doc_id bigint, lang string, text string, source string, n_chars int").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 0, 1)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    calls, prepared = [], exploration.prepared
    monkeypatch.setattr(exploration, "prepared", lambda *a: calls.append(1) or prepared(*a))
    assert queries.period_feature_vectors(spark, str(tmp_path)).count() == 25 and len(calls) == 1


def test_token_vectors_take_tokens_once_and_padding_as_a_run(spark, monkeypatch):
    rows = [(1, "A b c d"), (1, "b"), (2, None), (3, " "), (None, "b x")]
    df = spark.createDataFrame(rows, "k int, t string")
    vectors = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [3.0, 4.0]), ("b", [5.0, 6.0]), (None, [9.0, 9.0])], "word string, vec array<float>")
    sent, join = [], ft.lookup_join
    monkeypatch.setattr(ft, "lookup_join", lambda big, *rest: sent.append(big) or join(big, *rest))
    done = ft.token_vectors(df, "k", "t", vectors, 2, 3)
    b, o = [[3.0, 4.0], [5.0, 6.0]], [0.0, 0.0]
    want = [(1, 0, "a", [1.0, 2.0]), *[(1, 1, "b", v) for v in b], (1, 2, "c", o), *[(1, 0, "b", v) for v in b], (1, 1, None, o), (1, 2, None, o)]
    want += [(k, i, None, o) for k in (2, 3) for i in range(3)] + [*[(None, 0, "b", v) for v in b], (None, 1, "x", o), (None, 2, None, o)]
    assert sorted(map(str, map(tuple, done.collect()))) == sorted(map(str, want))
    assert sent[0].count() == 10 and sent[0]._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1
