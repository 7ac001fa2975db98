"""Preparation of posts and the feature tables built from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from periodlens.operators import periods as pe
from periodlens.operators import rows
from periodlens.session import materialise


def prepared(posts: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """Filter, then drop repeated texts.

    Filter and duplicate removal commute, since the filter looks at the text only; filtering
    first keeps the shuffle small.
    """
    cols = [c for c in ("row_id", "ID", "MatchID", "PeriodID", "EventType", "Tweet") if c in posts.columns]
    return rows.dedup(rows.filter_tweets(posts).select(*cols), ["Tweet"], "row_id", scope)


def normalised_features(
    posts: DataFrame, params: DataFrame | None = None, valence: DataFrame | None = None
) -> DataFrame:
    """Per-period features as z-scores, with constants fitted here or given."""
    kept = prepared(posts)
    if valence is not None:
        kept = materialise(kept, "prepared-posts")
    return normalised_periods(kept, params, valence)


def normalised_periods(
    kept: DataFrame, params: DataFrame | None = None, valence: DataFrame | None = None
) -> DataFrame:
    """``normalised_features`` of prepared posts, which are read twice with ``valence``.

    The constants come from the feature table itself, one row per period, so that table is
    written once and read for both steps.
    """
    columns = dict(pe.FEATURE_PARAMS)
    features = pe.period_features(kept)
    if valence is None:
        columns.pop("Sentiment")
    else:
        features = features.join(pe.avg_sentiment(kept, valence), "ID")
    features = materialise(features, "period-features")
    outputs = {
        "NumTweets": "NumTweets",
        "AvgTweetLength": "AvgTweetLength",
        "PeriodID": "NormalizedPeriod",
        "Sentiment": "NormalizedSentiment",
    }
    fitted = params if params is not None else pe.zscore_fit(features, columns)
    return pe.zscore_apply(features, fitted, columns, outputs)


def summary(posts: DataFrame) -> DataFrame:
    """One report row: rows left after each step, and the mean number of kept posts per period."""
    steps = pe.removed_by_step(posts)
    per_id = pe.avg_tweets_per_id(prepared(posts))
    return steps.withColumn("avg_tweets_per_id", F.round(per_id.scalar(), 6))
