"""Event detection from word graphs, from raw posts to a submission table."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from periodlens.operators import evaluate as ev
from periodlens.operators import graph
from periodlens.operators.rows import order_by_id
from periodlens.session import materialise, spread


def pairs_and_ranks(
    posts: DataFrame, unit: str = "token", order: str = "period", coded: bool = True, packed: bool = False, **cleaning
) -> tuple[DataFrame | graph.PackedPairs, DataFrame]:
    """(weighted word pairs of all posts, ranks). Cleaned posts feed both, so they are written once.

    The pairs are ``coded`` for steps that only tell them apart, or else hold the words; ``packed``
    leaves coded ones packed for the deviation scores. A post turns into many pairs: ``spark.sql.files.maxPartitionBytes`` sets how many posts a task
    reads, and ``spread`` deals out posts of an input too small for that.
    """
    clean = materialise(spread(graph.graph_posts(posts, **cleaning), "row_id"), "graph-posts")
    ranks = materialise(graph.period_rank(clean, order), "ranks")
    return (graph.PackedPairs if packed else graph.coded_pairs if coded else graph.placed_pairs)(clean, unit), ranks


def graphs(posts: DataFrame, coded: bool = False, **options) -> tuple[DataFrame, DataFrame]:
    """(edges, ranks): the pairs summed per period, with the words themselves unless ``coded``."""
    pairs, ranks = pairs_and_ranks(posts, coded=coded, **options)
    return graph.sum_pairs(pairs), ranks


def detect(
    posts: DataFrame,
    method: str = "deviation",
    window: int = graph.DEVIATION_WINDOW,
    threshold: float = graph.DEVIATION_THRESHOLD,
    unit: str = "token",
    order: str = "period",
) -> DataFrame:
    """(MatchID, PeriodID, rank, score or distance, is_event) for every existing period."""
    pairs, ranks = pairs_and_ranks(posts, unit, order, packed=method == "deviation")
    if method == "evolution":
        return graph.detect_evolution(graph.evolution_distance(pairs, ranks), threshold)
    if method == "deviation":
        scores = graph.deviation_score(graph.sum_pairs(pairs), ranks, window)
        return graph.detect_deviation(scores, threshold)
    raise ValueError(f"unknown method {method!r}")


def submission(flags: DataFrame, override: bool = True) -> DataFrame:
    """ID and EventType in numeric id order, with the positional overrides where wanted."""
    final = ev.override_rows(flags) if override else flags
    return order_by_id(ev.with_ids(final).select("ID", F.col("is_event").alias("EventType")))


def evaluated(flags: DataFrame, labels: DataFrame) -> DataFrame:
    """Flags with labels; per match the overrides are kept only where they raise accuracy."""
    aligned = ev.align_labels(flags, labels).withColumn("raw", F.col("is_event"))
    both = ev.override_rows(aligned.withColumn("overridden", F.col("raw")), "overridden")
    return ev.keep_if_better(materialise(both, "aligned"), "EventType", "raw", "overridden")


def threshold_report(
    posts: DataFrame, labels: DataFrame, method: str, thresholds: Iterable[float],
    windows: Iterable[int] = (graph.DEVIATION_WINDOW,), unit: str = "token",
) -> DataFrame:
    """Accuracy, precision, recall and F1 per threshold (and window).

    The equations are summed once, for the largest window; every window is solved from them, and
    all thresholds are tried on its score table.
    """
    pairs, ranks = pairs_and_ranks(posts, unit, packed=method == "deviation")
    if method == "evolution":
        distances = materialise(graph.evolution_distance(pairs, ranks), "distances")
        return ev.evaluate_sweep(graph.sweep_evolution(distances, thresholds), labels, ["threshold"])
    windows = list(windows)
    equations = materialise(graph.normal_equations(graph.sum_pairs(pairs), ranks, max(windows)), "equations")
    parts = []
    for window in windows:
        scores = graph.solved_scores(equations, ranks, window)
        flags = graph.sweep_deviation(scores, thresholds)
        parts.append(ev.evaluate_sweep(flags, labels, ["threshold"]).withColumn("window", F.lit(window)))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
