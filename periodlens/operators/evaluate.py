"""Metrics, reports, votes and comparisons of prediction tables."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from periodlens.functions import text as tx
from periodlens.session import lookup_join


def _rate(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def _f1(precision: Column, recall: Column) -> Column:
    return F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0))


def class_weights(df: DataFrame, label: str = "EventType") -> DataFrame:
    """Balanced weights ``n / (k * n_c)``; rows without a label do not count."""
    known = df.where(F.col(label).isNotNull())
    counts = known.groupBy(label).agg(F.count("*").alias("n"))
    total = known.select(F.count("*")).scalar()
    classes = counts.select(F.count("*")).scalar()
    return counts.select(label, "n", (total / (classes * F.col("n"))).alias("weight"))


def binary_metrics(df: DataFrame, label: str, predicted: str, by: list[str] | None = None) -> DataFrame:
    """Accuracy, precision, recall and F1 of the positive class; 0 on division by zero."""
    y, p = F.col(label), F.col(predicted)
    cells = df.groupBy(*(by or [])).agg(
        F.count("*").alias("n"),
        F.count_if(y == p).alias("ok"),
        F.count_if((y == 1) & (p == 1)).alias("tp"),
        F.count_if(p == 1).alias("pp"),
        F.count_if(y == 1).alias("yy"),
    )
    rates = cells.select(
        *(by or []),
        "n",
        _rate(F.col("ok"), F.col("n")).alias("accuracy"),
        _rate(F.col("tp"), F.col("pp")).alias("precision"),
        _rate(F.col("tp"), F.col("yy")).alias("recall"),
    )
    return rates.withColumn("f1", _f1(F.col("precision"), F.col("recall")))


def confusion(df: DataFrame, label: str, predicted: str) -> DataFrame:
    return df.groupBy(F.col(label).alias("y"), F.col(predicted).alias("p")).agg(F.count("*").alias("n"))


def classification_report(df: DataFrame, label: str, predicted: str) -> DataFrame:
    """Per-class precision, recall, F1 and support, then macro and weighted averages."""
    n = F.col("n")
    zero = F.lit(0).cast("bigint")
    roles = F.array(
        F.struct(F.col("y").alias("label"), n.alias("support"), zero.alias("given"),
                 F.when(F.col("y") == F.col("p"), n).otherwise(zero).alias("tp")),
        F.struct(F.col("p").alias("label"), zero.alias("support"), n.alias("given"), zero.alias("tp")),
    )
    classes = (
        confusion(df, label, predicted)
        .select(F.inline(roles))
        .groupBy("label")
        .agg(F.sum("tp").alias("tp"), F.sum("given").alias("given"), F.sum("support").alias("support"))
        .select(
            F.col("label").cast("string").alias("label"),
            _rate(F.col("tp"), F.col("given")).alias("precision"),
            _rate(F.col("tp"), F.col("support")).alias("recall"),
            "support",
        )
        .withColumn("f1", _f1(F.col("precision"), F.col("recall")))
        .select("label", "precision", "recall", "f1", "support")
    )
    scores = ("precision", "recall", "f1")
    macro = classes.agg(*[F.avg(s).alias(s) for s in scores], F.sum("support").alias("support"))
    weighted = classes.agg(
        *[(F.sum(F.col(s) * F.col("support")) / F.sum("support")).alias(s) for s in scores],
        F.sum("support").alias("support"),
    )
    return (
        classes.unionByName(macro.withColumn("label", F.lit("macro avg")))
        .unionByName(weighted.withColumn("label", F.lit("weighted avg")))
    )


def majority_vote(df: DataFrame, order: str, key: str = "ID", label: str = "EventType") -> DataFrame:
    """Most frequent label per key; the label seen first wins a tie. Two aggregations, no window."""
    votes = df.groupBy(key, label).agg(F.count("*").alias("n"), F.min(order).alias("first_row"))
    return votes.groupBy(key).agg(
        F.max_by(label, F.struct(F.col("n"), -F.col("first_row"))).alias(label)
    )


def align_labels(predictions: DataFrame, labels: DataFrame) -> DataFrame:
    """Labels next to predictions by (match, period), never by row position."""
    return predictions.join(labels.select("MatchID", "PeriodID", "EventType"), ["MatchID", "PeriodID"])


def frames_equal(a: DataFrame, b: DataFrame) -> DataFrame:
    """Order-insensitive multiset comparison with a single aggregation over both tables."""
    cols = a.columns
    signed = a.select(*cols, F.lit(1).alias("_side")).unionAll(
        b.select(*cols, F.lit(-1).alias("_side"))
    )
    diff = signed.groupBy(*cols).agg(F.sum("_side").alias("d"))
    totals = diff.agg(
        F.coalesce(F.sum(F.greatest("d", F.lit(0))), F.lit(0)).cast("bigint").alias("only_a"),
        F.coalesce(F.sum(F.greatest(-F.col("d"), F.lit(0))), F.lit(0)).cast("bigint").alias("only_b"),
    )
    return totals.withColumn("equal", (F.col("only_a") == 0) & (F.col("only_b") == 0))


def differing_keys(a: DataFrame, b: DataFrame, key: str = "ID", value: str = "EventType") -> DataFrame:
    """Keys whose value differs, or that only one side has."""
    left = a.select(key, F.col(value).alias("value_a"))
    right = b.select(key, F.col(value).alias("value_b"))
    return left.join(right, key, "full").where(~F.col("value_a").eqNullSafe(F.col("value_b")))


def prediction_agreement(a: DataFrame, b: DataFrame, key: str = "ID", value: str = "EventType") -> DataFrame:
    """Confusion counts of two prediction sets joined on their key, with the shared share."""
    both = a.select(key, F.col(value).alias("label_a")).join(
        b.select(key, F.col(value).alias("label_b")), key
    )
    counts = both.groupBy("label_a", "label_b").agg(F.count("*").alias("n"))
    total = counts.select(F.sum("n")).scalar()
    same = counts.where(F.col("label_a") == F.col("label_b")).select(F.sum("n")).scalar()
    return counts.select("*", (F.coalesce(same, F.lit(0)) / total).alias("agreement"))


# Positional post-processing of a match's output rows, (first, last, label).
OVERRIDES = ((0, 4, 0), (122, 126, 1), (127, None, 0))


def override_rows(
    df: DataFrame,
    label: str = "is_event",
    rank: str = "rank",
    ranges: Iterable[tuple[int, int | None, int]] = OVERRIDES,
) -> DataFrame:
    """Set labels by row position inside a match (0-based position = rank - 1)."""
    place = F.col(rank) - 1
    value = F.col(label)
    for first, last, new in ranges:
        hit = place >= first if last is None else place.between(first, last)
        value = F.when(hit, F.lit(new)).otherwise(value)
    return df.withColumn(label, value)


def keep_if_better(df: DataFrame, label: str, before: str, after: str) -> DataFrame:
    """Per match, use ``after`` only where its accuracy is strictly higher than ``before``'s."""
    hits = df.groupBy("MatchID").agg(
        F.avg((F.col(label) == F.col(before)).cast("int")).alias("accuracy_before"),
        F.avg((F.col(label) == F.col(after)).cast("int")).alias("accuracy_after"),
    )
    better = F.col("accuracy_after") > F.col("accuracy_before")
    return lookup_join(df, hits, ["MatchID"]).withColumn(
        "is_event", F.when(better, F.col(after)).otherwise(F.col(before))
    )


def evaluate_sweep(flags: DataFrame, labels: DataFrame, by: list[str]) -> DataFrame:
    """Metrics for every setting of a sweep in one aggregation."""
    aligned = lookup_join(flags, labels.select("MatchID", "PeriodID", "EventType"), ["MatchID", "PeriodID"])
    return binary_metrics(aligned, "EventType", "is_event", by)


def softmax_predict(df: DataFrame, logit0: str, logit1: str) -> DataFrame:
    """Class and probability of class 1 from two logits; equal logits give class 0."""
    a, b = F.col(logit0), F.col(logit1)
    top = F.greatest(a, b)
    e0, e1 = F.exp(a - top), F.exp(b - top)
    return df.withColumns(
        {"EventType": F.when(b > a, 1).otherwise(0), "Probability": e1 / (e0 + e1)}
    )


def with_ids(df: DataFrame) -> DataFrame:
    return df.withColumn("ID", tx.make_id(F.col("MatchID"), F.col("PeriodID")))
