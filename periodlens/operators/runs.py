"""Run histories and search trials: statistics, smoothing, best rows, report tables."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from periodlens.functions import text as tx
from periodlens.operators.ordered import numbered
from periodlens.session import lookup_join


def clean_history(df: DataFrame, max_epoch: float = 30) -> DataFrame:
    return df.where(F.col("eval_accuracy").isNotNull() & (F.col("epoch") <= max_epoch))


def run_stats(df: DataFrame) -> DataFrame:
    return df.groupBy("run_id").agg(
        F.round(F.avg("eval_accuracy"), 2).alias("avg_accuracy"),
        F.round(F.max("eval_accuracy"), 2).alias("max_accuracy"),
    )


def with_run_stats(df: DataFrame) -> DataFrame:
    return lookup_join(df, run_stats(df), ["run_id"])


def gaussian_kernel(sigma: float, truncate: float = 4.0) -> list[float]:
    """Normalised weights for distances 0..radius."""
    radius = int(truncate * sigma + 0.5)
    half = [math.exp(-0.5 * (d / sigma) ** 2) for d in range(radius + 1)]
    total = half[0] + 2 * sum(half[1:])
    return [h / total for h in half]


def gaussian_smooth(
    df: DataFrame, key: str, order: str, value: str, sigma: float = 2.0
) -> DataFrame:
    """Gaussian smoothing per key along integer ``order``, edges reflected (d c b a | a b c d | d c b a).

    Every row sends its weighted value to the rows it reaches, itself and its mirror images,
    and the parts are summed per target: no self-join and no window over a whole run.
    """
    kernel = gaussian_kernel(sigma)
    radius = len(kernel) - 1
    placed = numbered(df.select(key, order, value), [key], order)
    sizes = df.groupBy(key).agg(F.count("*").alias("n"))
    rows = lookup_join(placed, sizes, [key]).withColumn("i", F.col("pos") - 1)
    n, i = F.col("n"), F.col("i")
    turns = F.ceil(radius / (2 * n)) + 1
    images = F.flatten(
        F.transform(F.sequence(-turns, turns), lambda m: F.array(i + 2 * n * m, -1 - i + 2 * n * m))
    )
    near = F.filter(images, lambda e: (e >= -radius) & (e <= n - 1 + radius))
    sent = rows.select(key, value, "n", F.explode(near).alias("e"))
    e = F.col("e")
    reached = F.explode(F.sequence(F.greatest(F.lit(0), e - radius), F.least(n - 1, e + radius)))
    weights = F.array(*[F.lit(w) for w in kernel])
    smoothed = (
        sent.select(key, value, "e", reached.alias("i"))
        .groupBy(key, "i")
        .agg(
            F.sum(F.col(value) * F.get(weights, F.abs(F.col("e") - F.col("i")).cast("int"))).alias("smoothed")
        )
    )
    return rows.join(smoothed, [key, "i"]).select(key, order, value, "smoothed")


def best_trial(df: DataFrame, value: str = "value", number: str = "number") -> DataFrame:
    """The row with the highest value, the earliest one on a tie."""
    row = F.struct(*df.columns)
    return df.where(F.col(value).isNotNull()).agg(
        F.max_by(row, F.struct(F.col(value), -F.col(number))).alias("r")
    ).select("r.*")


def trial_summary_table(df: DataFrame, limit: int = 30) -> DataFrame:
    """The report of the first trials: renamed, formatted, the best accuracy flagged."""
    first = df.orderBy("number").limit(limit)
    table = first.select(
        F.col("number").alias("Trial"),
        tx.to_number(tx.fixed_digits(F.col("value"), 3)).alias("Accuracy"),
        tx.fixed_digits(F.col("params_dropout_prob"), 2).alias("Dropout"),
        tx.scientific(F.col("params_learning_rate")).alias("Learning Rate"),
        tx.scientific(F.col("params_weight_decay")).alias("Weight Decay"),
        F.col("params_num_heads").alias("Num Heads"),
        F.col("params_fc1_dim").alias("FC1 Dim"),
    )
    best = table.agg(F.max_by("Trial", F.struct("Accuracy", -F.col("Trial")))).scalar()
    return table.withColumn("is_best", F.col("Trial") == best)
