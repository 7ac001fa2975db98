"""Registered learners run with the operators' own settings."""

import inspect
import threading

import pytest

from periodlens.catalog import QUERIES, learning
from periodlens.operators import features as ft
from periodlens.operators import models as md

SF = "/root/testdata/sf0.001"
TRAINERS = ("train_logreg", "train_random_forest", "train_gbt", "train_boosted_stumps", "train_kernel_svm")


class Stop(Exception):
    pass


@pytest.mark.parametrize(
    "name,trainer,rounds", [("model_gbt_report", "train_gbt", 100), ("model_boosted_stumps_report", "train_boosted_stumps", 1000)]
)
def test_reports_use_all_rounds_and_terms(spark, monkeypatch, name, trainer, rounds):
    terms, seen = [], []
    real = inspect.signature(getattr(md, trainer))

    class Data:
        train = test = None

    def train(*args, **options):
        call = real.bind(*args, **options)
        call.apply_defaults()
        seen.append(call.arguments["rounds"])

    monkeypatch.setattr(learning, "prepared", lambda spark, sf, n: terms.append(n) or Data)
    monkeypatch.setattr(md, trainer, train)
    monkeypatch.setattr(md, "report", lambda *a: None)
    QUERIES[name](spark, SF)
    assert terms == [ft.MAX_FEATURES] and seen == [rounds]


def test_param_search_uses_all_terms(spark, monkeypatch):
    def prepared(spark, sf, n):
        assert n == ft.MAX_FEATURES
        raise Stop

    monkeypatch.setattr(learning, "prepared", prepared)
    with pytest.raises(Stop):
        QUERIES["model_param_search"](spark, SF)


def test_apply_all_writes_six_models(spark, monkeypatch):
    """Few posts and one cheap learner stand in; what is applied and written is the query's own."""
    cheap = lambda train, *a, **k: md.LogisticRegression(maxIter=2, **md._columns("features", md.LABEL)).fit(train)
    calls, posts, prepare = [], learning.tt.labelled_posts, learning.classical.prepare
    for name in TRAINERS:
        monkeypatch.setattr(md, name, lambda train, *a, _n=name, **k: calls.append((_n, a, k)) or cheap(train))
    monkeypatch.setattr(learning.tt, "labelled_posts", lambda s, sf: posts(s, sf).where("row_id % 40 = 0"))
    terms = []
    monkeypatch.setattr(learning.classical, "prepare", lambda p, w, n: terms.append(n) or prepare(p, w, 50))
    got = {r["model"]: r["n"] for r in QUERIES["model_apply_all"](spark, SF).collect()}
    assert set(got) == {"logreg", "random_forest", "gbt", "boosted_stumps", "kernel_svm", "knn"}
    assert len(set(got.values())) == 1 and min(got.values()) > 0
    assert sorted(calls) == sorted((n, (), {}) for n in TRAINERS) and terms == [ft.MAX_FEATURES]


def test_kernel_features_are_not_written(spark, monkeypatch):
    rows = spark.createDataFrame([(i, [i % 5], [1.0 + i], i % 2) for i in range(40)], "row_id bigint, idx array<int>, weight array<double>, EventType int")

    class Data:
        train, test, vocabulary = rows.where("row_id < 30"), rows.where("row_id >= 30"), spark.range(5)

    def written(df, label):
        raise AssertionError(label)

    monkeypatch.setattr(learning, "materialise", written)
    train, test = learning.kernel_split(Data)
    assert train.count() == 30 and {len(r["features"]) for r in test.collect()} == {30}


def test_apply_all_trains_stumps_beside_the_others(spark, monkeypatch):
    class Data:
        train = test = None

    started = threading.Event()

    def others(train):
        assert started.wait(30)
        raise Stop

    monkeypatch.setattr(learning, "prepared", lambda *a: Data)
    monkeypatch.setattr(md, "train_boosted_stumps", lambda train: started.set())
    monkeypatch.setattr(md, "train_logreg", others)
    with pytest.raises(Stop):
        QUERIES["model_apply_all"](spark, SF)
