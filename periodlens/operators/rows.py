"""Row filters, duplicate removal, projections and set operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from periodlens.functions import text as tx

_FIXED_WIDTH = (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)


def drop_null(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.dropna(subset=cols)


def exclude_matches(df: DataFrame, ids: list[int], col: str = "MatchID") -> DataFrame:
    return df.where(~F.col(col).isin(ids))


def only_match(df: DataFrame, match: int) -> DataFrame:
    return df.where(F.col("MatchID") == match)


def only_year(df: DataFrame, year: int, ms: str = "Timestamp") -> DataFrame:
    """Rows of one UTC year as a range on the epoch column, which a parquet scan can push down."""
    start = F.unix_millis(F.lit(f"{year}-01-01 00:00:00+00:00").cast("timestamp"))
    end = F.unix_millis(F.lit(f"{year + 1}-01-01 00:00:00+00:00").cast("timestamp"))
    return df.where((F.col(ms) >= start) & (F.col(ms) < end))


def at_most(df: DataFrame, col: str, limit: float) -> DataFrame:
    return df.where(F.col(col) <= limit)


def filter_tweets(df: DataFrame, text: str = "Tweet") -> DataFrame:
    return df.where(tx.is_clean(F.col(text)))


def sample(df: DataFrame, fraction: float, seed: int, key: str = "row_id") -> DataFrame:
    """A repeatable sample: whether a row is in depends on its key and the seed alone."""
    bucket = tx.digest_number(F.col(key), seed) % 1_000_000
    return df.where(bucket < int(round(fraction * 1_000_000)))


def rows_at_extreme(df: DataFrame, col: str) -> DataFrame:
    """Rows holding the maximum, found with a scalar subquery (one value, no shuffle of rows)."""
    return df.where(F.col(col) == df.select(F.max(col)).scalar())


def rows_at_value(df: DataFrame, col: str, value: float = 0) -> DataFrame:
    return df.where(F.col(col) == value)


def dedup(
    df: DataFrame, keys: list[str], order: str = "row_id", scope: list[str] | None = None
) -> DataFrame:
    """Keep the first row, by ``order``, of every distinct ``keys`` (inside ``scope`` columns).

    This is an aggregation, so copies collapse before the shuffle and a text that makes up a
    third of all rows is one row per map task. Fixed-width columns use one ``min_by`` each,
    which keeps Spark's hash aggregation; with other columns the row travels as one struct.
    """
    by = [*(scope or []), *keys]
    rest = [f for f in df.schema if f.name not in by]
    if all(isinstance(f.dataType, _FIXED_WIDTH) for f in rest):
        kept = df.groupBy(*by).agg(
            *[
                (F.min(order) if f.name == order else F.min_by(f.name, order)).alias(f.name)
                for f in rest
            ]
        )
    else:
        row = F.struct(*[f.name for f in rest])
        kept = df.groupBy(*by).agg(F.min_by(row, order).alias("_row")).select(*by, "_row.*")
    return kept.select(*df.columns)


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def union_distinct(frames: list[DataFrame], keys: list[str], order: str = "row_id") -> DataFrame:
    return dedup(union_all(frames), keys, order)


def common_keys(a: DataFrame, b: DataFrame, cols: list[str]) -> DataFrame:
    return a.select(*cols).intersect(b.select(*cols))


def prediction_columns(df: DataFrame, id_: Column, label: Column) -> DataFrame:
    """Projection to the submission columns."""
    return df.select(id_.alias("ID"), label.cast("int").alias("EventType"))


def order_by_period(df: DataFrame) -> DataFrame:
    return df.orderBy("MatchID", "PeriodID")


def order_by_id(df: DataFrame, id_: str = "ID") -> DataFrame:
    """Numeric order of "match_period" ids; the split parts are dropped again."""
    return df.orderBy(tx.id_match(F.col(id_)), tx.id_period(F.col(id_)))


def order_by_statistic(df: DataFrame, col: str, descending: bool = True, tie: str = "run_id") -> DataFrame:
    key = F.col(col).desc() if descending else F.col(col).asc()
    return df.orderBy(key, tie)


def head(df: DataFrame, n: int, order: list[str]) -> DataFrame:
    return df.orderBy(*order).limit(n)
