"""Merging the predictions of several models."""

from __future__ import annotations

from pyspark.sql import DataFrame

from periodlens.operators import evaluate as ev
from periodlens.operators.rows import order_by_id, union_all


def merge(predictions: list[DataFrame], order: str) -> DataFrame:
    """Majority label per ID over all prediction tables, in numeric id order."""
    return order_by_id(ev.majority_vote(union_all(predictions), order))
