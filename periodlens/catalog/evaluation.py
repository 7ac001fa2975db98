"""Metrics, votes, comparisons, run histories and trials."""

from pyspark.sql import functions as F

from periodlens.catalog.registry import query
from periodlens.functions import text as tx
from periodlens.operators import evaluate as ev
from periodlens.operators import rows, runs
from periodlens.plans import voting
from periodlens.sources import testtables as tt


def r6(col: str):
    return F.round(F.col(col), 6).alias(col)


VOTES_SQL = "votes AS (SELECT concat(user_id, '_', day(ts)) AS ID, event_id, event_type, CAST(value > 50 AS INT) AS EventType FROM events)"


def votes(spark, sf):
    """One vote per event: the key is user and day, the label says whether the value is high."""
    return tt.table(spark, sf, "events").select(
        tx.make_id(F.col("user_id"), F.day("ts")).alias("ID"),
        "event_id",
        "event_type",
        (F.col("value") > 50).cast("int").alias("EventType"),
    )


def quality_pairs(spark, sf):
    return tt.table(spark, sf, "labels").join(tt.table(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id").select(
        "doc_id", F.col("quality").alias("y"), (F.col("n_chars") > 1000).cast("int").alias("p")
    )


PAIRS_SQL = "yp AS (SELECT doc_id, quality AS y, CAST(n_chars > 1000 AS INT) AS p FROM labels JOIN documents USING (doc_id))"


@query(
    "class_weights",
    """SELECT toxic, count(*) AS n, round(sum(count(*)) OVER () / (count(*) OVER () * count(*))::DOUBLE, 6) AS weight
    FROM labels GROUP BY toxic""",
)
def class_weights(spark, sf):
    return ev.class_weights(tt.table(spark, sf, "labels"), "toxic").select("toxic", "n", r6("weight"))


@query(
    "binary_metrics",
    "WITH " + PAIRS_SQL + """, c AS (SELECT count(*) AS n, sum((y = p)::INT) AS ok, sum((y = 1 AND p = 1)::INT) AS tp, sum(p) AS pp, sum(y) AS yy FROM yp)
    SELECT n, round(ok / n::DOUBLE, 6) AS accuracy, round(coalesce(tp / nullif(pp, 0)::DOUBLE, 0), 6) AS precision,
           round(coalesce(tp / nullif(yy, 0)::DOUBLE, 0), 6) AS recall, round(coalesce(2 * tp / nullif(pp + yy, 0)::DOUBLE, 0), 6) AS f1 FROM c""",
)
def binary_metrics(spark, sf):
    m = ev.binary_metrics(quality_pairs(spark, sf), "y", "p")
    return m.select("n", r6("accuracy"), r6("precision"), r6("recall"), r6("f1"))


@query(
    "classification_report",
    "WITH " + PAIRS_SQL + """,
    l AS (SELECT y AS label FROM yp UNION SELECT p FROM yp),
    k AS (SELECT label, (SELECT count(*) FROM yp WHERE y = label AND p = label) AS tp,
                 (SELECT count(*) FROM yp WHERE p = label) AS given, (SELECT count(*) FROM yp WHERE y = label) AS support FROM l),
    c AS (SELECT CAST(label AS VARCHAR) AS label, coalesce(tp / nullif(given, 0)::DOUBLE, 0) AS precision,
                 coalesce(tp / nullif(support, 0)::DOUBLE, 0) AS recall, coalesce(2 * tp / nullif(given + support, 0)::DOUBLE, 0) AS f1, support FROM k)
    SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM c
    UNION ALL SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6), CAST(sum(support) AS BIGINT) FROM c
    UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 6), round(sum(recall * support) / sum(support), 6),
                     round(sum(f1 * support) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM c""",
)
def classification_report(spark, sf):
    report = ev.classification_report(quality_pairs(spark, sf), "y", "p")
    return report.select("label", r6("precision"), r6("recall"), r6("f1"), "support")


@query(
    "majority_vote",
    "WITH " + VOTES_SQL + """, c AS (SELECT ID, EventType, count(*) AS n, min(event_id) AS f FROM votes GROUP BY ALL)
    SELECT ID, EventType FROM c QUALIFY row_number() OVER (PARTITION BY ID ORDER BY n DESC, f) = 1""",
)
def majority_vote(spark, sf):
    return ev.majority_vote(votes(spark, sf), "event_id")


@query(
    "merge_votes_ordered",
    "WITH " + VOTES_SQL + """, c AS (SELECT ID, EventType, count(*) AS n, min(event_id) AS f FROM votes GROUP BY ALL)
    SELECT ID, EventType FROM c QUALIFY row_number() OVER (PARTITION BY ID ORDER BY n DESC, f) = 1
    ORDER BY CAST(split_part(ID, '_', 1) AS INT), CAST(split_part(ID, '_', 2) AS INT)""",
)
def merge_votes_ordered(spark, sf):
    v = votes(spark, sf)
    return voting.merge([v.where(F.col("event_type") == t) for t in ("click", "view")] + [v.where(~F.col("event_type").isin("click", "view"))], "event_id")


@query(
    "vote_value_counts",
    "WITH " + VOTES_SQL + " SELECT event_type, EventType, count(*) AS n FROM votes GROUP BY ALL",
)
def vote_value_counts(spark, sf):
    return votes(spark, sf).groupBy("event_type", "EventType").agg(F.count("*").alias("n"))


def two_predictions(spark, sf):
    v = votes(spark, sf)
    a = ev.majority_vote(v.where("event_id % 2 = 0"), "event_id")
    b = ev.majority_vote(v.where("event_id % 2 = 1"), "event_id")
    return a, b


TWO_SQL = VOTES_SQL + """,
c AS (SELECT event_id % 2 AS half, ID, EventType, count(*) AS n, min(event_id) AS f FROM votes GROUP BY ALL),
m AS (SELECT half, ID, EventType FROM c QUALIFY row_number() OVER (PARTITION BY half, ID ORDER BY n DESC, f) = 1),
pa AS (SELECT ID, EventType FROM m WHERE half = 0), pb AS (SELECT ID, EventType FROM m WHERE half = 1)
"""


@query(
    "frames_equal",
    "WITH " + TWO_SQL + """, x AS (SELECT * FROM pa EXCEPT ALL SELECT * FROM pb), y AS (SELECT * FROM pb EXCEPT ALL SELECT * FROM pa)
    SELECT (SELECT count(*) FROM x) AS only_a, (SELECT count(*) FROM y) AS only_b,
           (SELECT count(*) FROM x) + (SELECT count(*) FROM y) = 0 AS equal""",
)
def frames_equal(spark, sf):
    return ev.frames_equal(*two_predictions(spark, sf))


@query(
    "differing_keys",
    "WITH " + TWO_SQL + """SELECT coalesce(pa.ID, pb.ID) AS ID, pa.EventType AS value_a, pb.EventType AS value_b
    FROM pa FULL JOIN pb ON pa.ID = pb.ID WHERE pa.EventType IS DISTINCT FROM pb.EventType""",
)
def differing_keys(spark, sf):
    return ev.differing_keys(*two_predictions(spark, sf))


@query(
    "prediction_agreement",
    "WITH " + TWO_SQL + """, j AS (SELECT pa.EventType AS label_a, pb.EventType AS label_b FROM pa JOIN pb USING (ID))
    SELECT label_a, label_b, count(*) AS n,
           round((SELECT count(*) FILTER (WHERE label_a = label_b) FROM j) / (SELECT count(*) FROM j)::DOUBLE, 6) AS agreement
    FROM j GROUP BY ALL""",
)
def prediction_agreement(spark, sf):
    out = ev.prediction_agreement(*two_predictions(spark, sf))
    return out.select("label_a", "label_b", "n", r6("agreement"))


STATS_SQL = """
ok AS (SELECT * FROM runs WHERE eval_accuracy IS NOT NULL AND epoch <= 30),
st AS (SELECT run_id, round(avg(eval_accuracy), 2) AS avg_accuracy, round(max(eval_accuracy), 2) AS max_accuracy FROM ok GROUP BY run_id)
"""


@query("run_stats", "WITH" + STATS_SQL + "SELECT * FROM st", "runs")
def run_stats(spark, sf):
    return runs.run_stats(runs.clean_history(tt.run_history(spark, sf)))


@query(
    "join_run_stats",
    "WITH" + STATS_SQL + "SELECT run_id, step, avg_accuracy, max_accuracy FROM ok JOIN st USING (run_id)",
    "runs",
)
def join_run_stats(spark, sf):
    joined = runs.with_run_stats(runs.clean_history(tt.run_history(spark, sf)))
    return joined.select("run_id", "step", "avg_accuracy", "max_accuracy")


@query("order_by_statistic", "WITH" + STATS_SQL + "SELECT * FROM st ORDER BY avg_accuracy DESC, run_id", "runs")
def order_by_statistic(spark, sf):
    return rows.order_by_statistic(runs.run_stats(runs.clean_history(tt.run_history(spark, sf))), "avg_accuracy")


GAUSS_SQL = """
p AS (SELECT run_id, step, eval_accuracy, row_number() OVER (PARTITION BY run_id ORDER BY step) - 1 AS i,
             count(*) OVER (PARTITION BY run_id) AS n FROM runs),
k0 AS (SELECT CAST(g AS BIGINT) AS d, exp(-0.5::DOUBLE * (g / 2.0::DOUBLE) * (g / 2.0::DOUBLE)) AS e FROM generate_series(-8, 8) t(g)),
k AS (SELECT d, e / (SELECT sum(e) FROM k0) AS w FROM k0),
o AS (SELECT run_id, step, i, n, d, w, ((i + d) % (2 * n) + 2 * n) % (2 * n) AS m FROM p, k),
q AS (SELECT run_id, step, w, CASE WHEN m < n THEN m ELSE 2 * n - 1 - m END AS j FROM o)
SELECT q.run_id, q.step, round(sum(q.w * p.eval_accuracy), 6) AS smoothed
FROM q JOIN p ON q.run_id = p.run_id AND q.j = p.i GROUP BY q.run_id, q.step
"""


@query("gaussian_smooth", "WITH" + GAUSS_SQL, "runs")
def gaussian_smooth(spark, sf):
    done = runs.gaussian_smooth(tt.run_history(spark, sf), "run_id", "step", "eval_accuracy")
    return done.select("run_id", "step", r6("smoothed"))


@query("read_first_trials", "SELECT number, round(value, 6) AS value FROM trials ORDER BY number LIMIT 30", "trials")
def read_first_trials(spark, sf):
    return rows.head(tt.trials(spark, sf), 30, ["number"]).select("number", r6("value"))


@query("best_trial", "SELECT number, round(value, 6) AS value, params_fc1_dim FROM trials ORDER BY value DESC, number LIMIT 1", "trials")
def best_trial(spark, sf):
    return runs.best_trial(tt.trials(spark, sf)).select("number", r6("value"), "params_fc1_dim")


SUMMARY_SQL = r"""
f AS (SELECT * FROM trials ORDER BY number LIMIT 30),
t AS (SELECT number AS "Trial", CAST(printf('%.3f', value) AS DOUBLE) AS "Accuracy",
  regexp_replace(regexp_replace(printf('%.2f', params_dropout_prob), '0+$', ''), '\.$', '') AS "Dropout",
  replace(printf('%.1e', params_learning_rate), 'e-0', 'e-') AS "Learning Rate",
  replace(printf('%.1e', params_weight_decay), 'e-0', 'e-') AS "Weight Decay",
  params_num_heads AS "Num Heads", params_fc1_dim AS "FC1 Dim" FROM f)
SELECT *, "Trial" = (SELECT "Trial" FROM t ORDER BY "Accuracy" DESC, "Trial" LIMIT 1) AS is_best FROM t
"""


@query("trial_summary_table", "WITH" + SUMMARY_SQL, "trials")
def trial_summary_table(spark, sf):
    return runs.trial_summary_table(tt.trials(spark, sf))


@query(
    "softmax_predict",
    """SELECT l_orderkey, l_linenumber, CAST(l_tax * 10 > l_discount * 10 AS INT) AS EventType,
    round(exp(l_tax * 10) / (exp(l_tax * 10) + exp(l_discount * 10)), 6) AS Probability FROM lineitem""",
)
def softmax_predict(spark, sf):
    logits = tt.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", (F.col("l_discount") * 10).alias("z0"), (F.col("l_tax") * 10).alias("z1")
    )
    return ev.softmax_predict(logits, "z0", "z1").select("l_orderkey", "l_linenumber", "EventType", r6("Probability"))
