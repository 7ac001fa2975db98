"""Model training and reports on all rows.

All learners run with their full settings. Boosting rounds run one after the other as Spark jobs,
so the boosted learners take long.
"""

from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import functions as F

from periodlens.catalog.counts import valence
from periodlens.catalog.registry import STOPWORDS, query
from periodlens.operators import evaluate as ev
from periodlens.operators import features as ft
from periodlens.operators import models as md
from periodlens.operators import neighbours as nb
from periodlens.operators import rows as rw
from periodlens.plans import classical, exploration
from periodlens.session import materialise, new_path
from periodlens.sources import io
from periodlens.sources import testtables as tt


def prepared(spark, sf, max_features):
    return classical.prepare(tt.labelled_posts(spark, sf), STOPWORDS, max_features)


@query("model_logreg_report")
def model_logreg_report(spark, sf):
    data = prepared(spark, sf, ft.MAX_FEATURES)
    return md.report(md.train_logreg(data.train), data.test)


def kernel_split(data):
    """Training and test rows with kernel features; a row without terms has a zero vector.

    Features are 800 bytes a row, many times the sparse row, so they are worked out where they are read.
    """
    dense, root = md.kernel_root(md.landmarks(data.train, "row_id", 100), data.vocabulary.count(), 0.1)
    return md.kernel_features(data.train, dense, root), md.kernel_features(data.test, dense, root)


@query("model_kernel_svm_report")
def model_kernel_svm_report(spark, sf):
    train, test = kernel_split(prepared(spark, sf, ft.MAX_FEATURES))
    return md.report(md.train_kernel_svm(train), test)


@query("model_random_forest_report")
def model_random_forest_report(spark, sf):
    data = prepared(spark, sf, ft.MAX_FEATURES)
    return md.report(md.train_random_forest(data.train), data.test)


@query("model_gbt_report")
def model_gbt_report(spark, sf):
    data = prepared(spark, sf, ft.MAX_FEATURES)
    return md.report(md.train_gbt(data.train), data.test)


@query("model_boosted_stumps_report")
def model_boosted_stumps_report(spark, sf):
    data = prepared(spark, sf, ft.MAX_FEATURES)
    return md.report(md.train_boosted_stumps(data.train), data.test)


@query("model_apply_all")
def model_apply_all(spark, sf):
    """Six models on the same rows, a folder of prediction files each, and their shares of events."""
    data, keep = prepared(spark, sf, ft.MAX_FEATURES), ["row_id", "ID"]
    with ThreadPoolExecutor(1) as beside:
        # The rounds of a small table keep one core busy; the others train the other models meanwhile.
        stumps = beside.submit(inheritable_thread_target(spark)(lambda: md.train_boosted_stumps(data.train)))
        models = {
            "logreg": md.train_logreg(data.train), "random_forest": md.train_random_forest(data.train),
            "gbt": md.train_gbt(data.train),
        }
        train, test = kernel_split(data)
        svm = md.train_kernel_svm(train)
        models["boosted_stumps"] = stumps.result()
    near = nb.sparse_knn_classify(data.train, data.test, 10, "row_id", "EventType")
    near = data.test.select(*keep).join(near, "row_id")
    done = rw.union_all(
        [
            md.apply_models(models, data.test, keep),
            md.apply_models({"kernel_svm": svm}, test, keep),
            near.select(F.lit("knn").alias("model"), *keep, F.col("predicted").cast("int").alias("EventType")),
        ]
    )
    folder, parts = new_path(spark, "predictions"), []
    for name in [*models, "kernel_svm", "knn"]:
        io.write_predictions(done.where(F.col("model") == name), f"{folder}/{name}")
        written = io.read_predictions(spark, f"{folder}/{name}", prefix="part-")
        parts.append(written.select(F.lit(name).alias("model"), "EventType"))
    return rw.union_all(parts).groupBy("model").agg(F.count("*").alias("n"), F.avg("EventType").alias("share_of_events"))


def period_rows(spark, sf):
    """Periods with their pooled text vector as ``base``, and four normalised features, sentiment among them."""
    posts = materialise(exploration.prepared(tt.labelled_posts(spark, sf)), "prepared-posts")
    vectors = ft.embed_text(posts, "Tweet", dims=16)
    pooled = ft.masked_mean_pool(vectors, "ID", "vec").select("ID", ft.array_to_vector("pooled").alias("base"))
    extra = exploration.normalised_periods(posts, valence=valence(spark, sf))
    rows = materialise(ft.random_split(pooled.join(extra, "ID"), 0.8, 42, "ID"), "period-rows")
    columns = ["NumTweets", "AvgTweetLength", "NormalizedPeriod", "NormalizedSentiment"]
    return rows.where("split = 'train'"), rows.where("split = 'validation'"), columns


@query("model_ablation")
def model_ablation(spark, sf):
    """The text vector with all features, with all but one, and alone."""
    train, test, columns = period_rows(spark, sf)
    return md.ablation_feature_sets(train, test, columns, base="base")


SPACE = {
    "regParam": (1e-4, 1.0, "log"), "elasticNetParam": (0.0, 1.0), "tol": (1e-6, 1e-3, "log"),
    "threshold": (0.35, 0.65), "aggregationDepth": (2, 3, "int"),
}


@query("model_param_search")
def model_param_search(spark, sf):
    data = prepared(spark, sf, ft.MAX_FEATURES)
    return md.pruned_search(data.train, SPACE)


PARAMS = ("learning_rate", "dropout_prob", "weight_decay", "num_heads", "fc1_dim")
STEP_SQL = " UNION ALL ".join(
    f"""SELECT '{p}' AS param, value, CASE WHEN params_{p} IS NULL THEN -1 WHEN max(params_{p}) OVER () <= min(params_{p}) OVER () THEN 0
    ELSE least(floor((params_{p}::DOUBLE - min(params_{p}::DOUBLE) OVER ()) / (max(params_{p}::DOUBLE) OVER () - min(params_{p}::DOUBLE) OVER ()) * 8), 7) END AS step
    FROM trials WHERE value IS NOT NULL"""
    for p in PARAMS
)


@query(
    "model_param_importance",
    f"""WITH s AS ({STEP_SQL}), c AS (SELECT param, step, count(*) AS c, avg(value) AS m FROM s GROUP BY ALL),
    v AS (SELECT param, sum(c * pow(m - (SELECT avg(value) FROM trials), 2)) AS v FROM c GROUP BY param)
    SELECT param, round(v / sum(v) OVER (), 6) AS importance FROM v""",
    "trials",
)
def model_param_importance(spark, sf):
    return md.param_importance(tt.trials(spark, sf)).withColumn("importance", F.round("importance", 6))


@query("model_period_classifier")
def model_period_classifier(spark, sf):
    """Pooled text vectors plus normalised features per period, a logistic regression, its metrics."""
    posts = materialise(exploration.prepared(tt.labelled_posts(spark, sf)), "prepared-posts")
    vectors = ft.embed_text(posts, "Tweet", dims=16)
    pooled = ft.masked_mean_pool(vectors, "ID", "vec")
    extra = materialise(exploration.normalised_periods(posts), "normalised")
    names = ["NumTweets", "AvgTweetLength", "NormalizedPeriod"]
    rows = ft.assemble_features(pooled, extra, "ID", names).join(extra.select("ID", "EventType"), "ID")
    rows = rows.withColumn("features", ft.array_to_vector("features"))
    split = materialise(ft.stratified_split(rows, 0.2, 3, "ID", "EventType"), "period-rows")
    model = md.train_logreg(split.where("split = 'train'"))
    return ev.binary_metrics(model.transform(split.where("split = 'validation'")), "EventType", "predicted")
