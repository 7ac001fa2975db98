"""Grouping posts into periods, counts, frequencies and per-period features."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from periodlens.functions import text as tx
from periodlens.operators.ordered import Running, numbered, running
from periodlens.session import lookup_join, materialise


def first_label_per_period(df: DataFrame) -> DataFrame:
    return df.groupBy("MatchID", "PeriodID").agg(F.min_by("EventType", "row_id").alias("EventType"))


def period_heads(df: DataFrame) -> DataFrame:
    """One row per ID: first non-null match, period and label by row id, and the post count."""

    def first(col: str):
        return F.min_by(F.col(col), F.when(F.col(col).isNotNull(), F.col("row_id"))).alias(col)

    return df.groupBy("ID").agg(
        first("MatchID"), first("PeriodID"), first("EventType"), F.count("Tweet").alias("NumTweets")
    )


def period_posts(df: DataFrame) -> DataFrame:
    """Posts of every period with their 0-based position by row id, computed in segments."""
    placed = numbered(
        df.where(F.col("Tweet").isNotNull()).select("ID", "row_id", "Tweet"), ["ID"], "row_id"
    )
    return placed.select("ID", (F.col("pos") - 1).alias("pos"), "row_id", "Tweet")


def group_periods(df: DataFrame, segment_size: int = 1500) -> DataFrame:
    """Period rows with their texts in order, ``segment_size`` texts to an array.

    A period of ordinary size is one row (segment 0). A period that holds a large share of all
    posts becomes several rows, so no array grows with the data and nothing is cut off.
    """
    df = materialise(df, "period-posts")
    segments = (
        period_posts(df)
        .withColumn("segment", F.floor(F.col("pos") / segment_size))
        .groupBy("ID", "segment")
        .agg(F.array_sort(F.collect_list(F.struct("pos", "Tweet"))).alias("_posts"))
        .select("ID", "segment", F.col("_posts.Tweet").alias("Tweet"))
    )
    return (
        lookup_join(segments, period_heads(df), ["ID"])
        .select("ID", "MatchID", "PeriodID", "EventType", "NumTweets", "segment", "Tweet")
    )


def concat_period_text(periods: DataFrame) -> DataFrame:
    """Texts of every period segment joined by spaces, in order."""
    return periods.select("ID", "segment", F.array_join("Tweet", " ").alias("text"))


def nonempty_periods(periods: DataFrame) -> DataFrame:
    """Drop empty texts from the lists, then the rows whose list became empty."""
    kept = F.filter("Tweet", lambda t: t.isNotNull() & (F.trim(t) != ""))
    return periods.withColumn("Tweet", kept).where(F.size("Tweet") > 0)


def count_empty_periods(df: DataFrame) -> DataFrame:
    per_id = df.groupBy("ID").agg(
        F.count_if(F.col("Tweet").isNotNull() & (F.trim("Tweet") != "")).alias("n")
    )
    return per_id.agg(
        F.count_if(F.col("n") == 0).alias("empty_periods"),
        F.count_if(F.col("n") > 0).alias("nonempty_periods"),
    )


def count_per_timestamp(df: DataFrame, ts: str, label: str, order: str) -> DataFrame:
    """Rows per timestamp and its distinct labels in order of first appearance.

    One shuffle on (timestamp, label) collapses the rows; the lists built afterwards have one
    entry per distinct label of a timestamp.
    """
    per_label = df.groupBy(ts, label).agg(
        F.count("*").alias("n"), F.min(order).alias("first_row")
    )
    listed = F.array_sort(F.collect_list(F.struct("first_row", F.col(label).cast("string").alias("v"))))
    return per_label.groupBy(ts).agg(
        F.sum("n").alias("TweetCount"), F.array_join(listed["v"], ", ").alias("EventTypes")
    )


def counts_joined_with_labels(df: DataFrame, ts: str, label: str, order: str) -> DataFrame:
    """The same table from two aggregates and an equi-join on the timestamp."""
    counts = df.groupBy(ts).agg(F.count("*").alias("TweetCount"))
    labels = count_per_timestamp(df, ts, label, order).select(ts, "EventTypes")
    return counts.join(labels, ts)


def value_counts(df: DataFrame, col: str, normalize: bool = False) -> DataFrame:
    counts = df.groupBy(col).agg(F.count("*").alias("n"))
    if not normalize:
        return counts
    total = df.select(F.count("*")).scalar()
    return counts.select(col, "n", (F.col("n") / total * 100).alias("percent"))


def missing_counts(df: DataFrame) -> DataFrame:
    """Row count, column count and nulls per column in one pass."""
    return df.agg(
        F.count("*").alias("n_rows"),
        F.lit(len(df.columns)).cast("bigint").alias("n_columns"),
        *[F.count_if(F.col(c).isNull()).alias(f"missing_{c}") for c in df.columns],
    )


def removed_by_step(df: DataFrame) -> DataFrame:
    """Rows left after duplicate removal, null removal and the text filter, in one aggregation.

    A text is its own duplicate key and the filter looks at the text only, so one row per
    distinct text is enough to count all three steps.
    """
    texts = df.groupBy("Tweet").agg(F.count("*").alias("n"))
    flags = texts.select("n", "Tweet", tx.is_clean(F.col("Tweet")).alias("ok"))
    counted = flags.agg(
        F.sum("n").alias("n_before"),
        F.count("*").alias("n_after_dedup"),
        F.count("Tweet").alias("n_after_null_drop"),
        F.count_if(F.col("ok")).alias("n_after_filter"),
    )
    return counted.select(
        "*", (F.col("n_before") - F.col("n_after_dedup")).alias("removed_duplicates")
    )


def avg_tweets_per_id(df: DataFrame) -> DataFrame:
    return (
        df.groupBy("ID").agg(F.count("*").alias("n")).agg(F.avg("n").alias("avg_tweets_per_id"))
    )


def label_distribution_by_id(df: DataFrame) -> DataFrame:
    firsts = df.groupBy("ID").agg(
        F.min_by("EventType", F.when(F.col("EventType").isNotNull(), F.col("row_id"))).alias(
            "EventType"
        )
    )
    return value_counts(firsts, "EventType", normalize=True)


def tweets_by_year_date(df: DataFrame, date: str) -> DataFrame:
    """Posts per day and the mean daily count of the day's year (one row per day, then a window)."""
    days = df.groupBy(F.year(date).alias("Year"), F.col(date).alias("Date")).agg(
        F.count("*").alias("TweetCount")
    )
    return days.withColumn("year_mean", F.avg("TweetCount").over(Window.partitionBy("Year")))


def distinct_dates(df: DataFrame, date: str, year: int) -> DataFrame:
    start, end = (F.lit(f"{y:04d}-01-01").cast(df.schema[date].dataType) for y in (year, year + 1))
    return df.where((F.col(date) >= start) & (F.col(date) < end)).select(F.col(date).alias("Date")).distinct().orderBy("Date")


def avg_tweets_per_minute(df: DataFrame) -> DataFrame:
    per_match = df.groupBy("MatchID", "PeriodID").agg(F.count("*").alias("n"))
    return per_match.groupBy(F.col("PeriodID").alias("GameMinute")).agg(
        F.avg("n").alias("AvgTweets")
    )


# Minute bands of a match.
MINUTE_BANDS = (
    ("Halftime", 35, 55),
    ("Fulltime", 80, 100),
    ("1st Extra Time", 105, 115),
    ("2nd Extra Time", 120, 130),
)


def interval_bands(
    df: DataFrame, minute: str, bands: Iterable[tuple[str, int, int]] = MINUTE_BANDS
) -> DataFrame:
    """Attach the bands a minute lies in; a minute in no band is dropped, as in a range join.

    The band list is a parameter and rides along in the expression, so the range condition is
    evaluated in the row and no join is needed.
    """
    hits = F.array_compact(
        F.array(
            *[
                F.when(
                    F.col(minute).between(lo, hi),
                    F.struct(
                        F.lit(label).alias("band"),
                        F.lit(lo).alias("band_start"),
                        F.lit(hi).alias("band_end"),
                    ),
                )
                for label, lo, hi in bands
            ]
        )
    )
    return df.select("*", F.inline(hits))


def word_frequency(df: DataFrame, words: str, k: int | None = None) -> DataFrame:
    """Counts of the members of an array column; the ``k`` largest, ties by word."""
    counts = df.select(F.explode(words).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    if k is None:
        return counts
    return counts.orderBy(F.desc("n"), "word").limit(k)


def hashtag_frequency(df: DataFrame, k: int = 10) -> DataFrame:
    tags = df.select(tx.extract_hashtags(F.col("Tweet")).alias("tags"))
    return word_frequency(tags, "tags", k)


def vocabulary(df: DataFrame, text: str, scope: str = "MatchID") -> DataFrame:
    words = df.select(scope, F.explode(tx.tokenize(F.col(text))).alias("word"))
    return words.distinct().orderBy(scope, "word")


def period_features(df: DataFrame) -> DataFrame:
    """Post count, mean text length (0 where there is no text) and the period number."""
    return df.groupBy("ID").agg(
        F.min("MatchID").alias("MatchID"),
        F.min("PeriodID").alias("PeriodID"),
        F.min_by("EventType", F.when(F.col("EventType").isNotNull(), F.col("row_id"))).alias(
            "EventType"
        ),
        F.count("Tweet").alias("NumTweets"),
        F.coalesce(F.avg(F.char_length("Tweet")), F.lit(0.0)).alias("AvgTweetLength"),
    )


# Feature column -> prefix of its mean and deviation in the constants table.
FEATURE_PARAMS = {
    "NumTweets": "num_tweets",
    "AvgTweetLength": "avg_tweet_length",
    "PeriodID": "periodID",
    "Sentiment": "sentiment",
}


def zscore_fit(features: DataFrame, columns: dict[str, str]) -> DataFrame:
    """One row: mean and sample standard deviation of every feature."""
    return features.agg(
        *[
            agg(F.col(col).cast("double")).alias(f"{prefix}_{suffix}")
            for col, prefix in columns.items()
            for agg, suffix in ((F.avg, "mean"), (F.stddev_samp, "std"))
        ]
    )


def zscore_apply(
    features: DataFrame, params: DataFrame, columns: dict[str, str], outputs: dict[str, str]
) -> DataFrame:
    """Normalise with fitted or loaded constants; a zero deviation gives null.

    The constants enter as scalar subqueries: a table with more than one row is an error, and
    nothing is joined.
    """
    def constant(name: str):
        return params.select(name).scalar()

    return features.withColumns(
        {
            outputs[col]: F.try_divide(
                F.col(col) - constant(f"{prefix}_mean"), constant(f"{prefix}_std")
            )
            for col, prefix in columns.items()
        }
    )


def avg_sentiment(df: DataFrame, valence: DataFrame) -> DataFrame:
    """Mean compound score per period; a post scores ``s / sqrt(s*s + 15)`` for valence sum ``s``.

    Only words of the valence table leave the scan, posts without one count as zero through the
    period's post count.
    """
    words = df.select("ID", "row_id", F.explode(tx.tokenize(F.lower("Tweet"))).alias("word"))
    scored = (
        lookup_join(words, valence.select("word", "score"), ["word"])
        .groupBy("ID", "row_id")
        .agg(F.sum("score").alias("s"))
        .groupBy("ID")
        .agg(F.sum(F.col("s") / F.sqrt(F.col("s") * F.col("s") + 15)).alias("total"))
    )
    posts = df.groupBy("ID").agg(F.count("Tweet").alias("n"))
    return posts.join(scored, "ID", "left").select(
        "ID",
        F.coalesce(F.try_divide(F.coalesce("total", F.lit(0.0)), F.col("n")), F.lit(0.0)).alias(
            "Sentiment"
        ),
    )


def lemmatize(df: DataFrame, key: str, words: str, lemmas: DataFrame) -> DataFrame:
    """Replace every word by its lemma where the table has one; order and repeats are kept.

    The words of a row travel as they are, as one text where no word holds the separator, and
    beside them only the lemmas of those that have some. Rows of one key become one row, in the
    order of positions.
    """
    sep = "\0"
    plain = (F.size(words) > 0) & ~F.exists(words, lambda w: w.isNull() | w.contains(sep))
    table = lemmas.groupBy("surface").agg(
        F.sort_array(F.collect_list(F.coalesce("lemma", "surface"))).alias("lemmas")
    )
    found = lookup_join(df.select(key, F.explode(words).alias("surface")), table, ["surface"])
    entry = F.struct("surface", "lemmas").alias("_e")
    own = df.select(
        key, F.when(plain, F.array_join(words, sep)).alias("_text"), F.when(~plain, F.col(words)).alias("_words")
    )
    sent = own.unionByName(found.select(key, entry), allowMissingColumns=True)
    rows = sent.groupBy(key).agg(
        F.concat(F.transform(F.collect_list("_text"), lambda t: F.split(t, sep)), F.collect_list("_words")).alias("_ws"),
        F.array_distinct(F.collect_list("_e")).alias("_e"),
    )
    known = F.map_from_entries("_e")

    def lemmas_of(w: Column) -> Column:
        return F.coalesce(F.try_element_at(known, w), F.array(w))

    def placed(ws: Column) -> Column:
        return F.flatten(F.transform(ws, lambda w, i: F.transform(lemmas_of(w), lambda v: F.struct(i.alias("pos"), v.alias("w")))))

    first = F.get("_ws", F.lit(0))
    one = F.when(F.size("_e") == 0, first).otherwise(F.flatten(F.transform(first, lemmas_of)))
    several = F.transform(F.array_sort(F.flatten(F.transform("_ws", placed))), lambda x: x["w"])
    return rows.select(key, F.when(F.size("_ws") == 1, one).otherwise(several).alias("words"))


def remove_listed(df: DataFrame, words: str, table: DataFrame) -> DataFrame:
    """Anti join of a long word column to a stop-word table of any size."""
    return lookup_join(df, table.select(F.col("word").alias(words)), [words], "left_anti")


def cap_and_mask(df: DataFrame, max_n: int, pad: str = tx.NO_TEXTS) -> DataFrame:
    """Exactly ``max_n`` positions per period: its first posts, then padding, with a mask.

    Positions are counted in segments, so neither ``max_n`` nor the size of a period matters.
    """
    texts = df.where(F.col("Tweet").isNotNull()).select("ID", "row_id", "Tweet")
    real = (
        numbered(texts, ["ID"], "row_id")
        .where(F.col("pos") <= max_n)
        .select("ID", F.col("pos").cast("int").alias("pos"), "Tweet", F.lit(True).alias("is_real"))
    )
    short = (
        df.groupBy("ID").agg(F.count("Tweet").alias("n")).where(F.col("n") < max_n)
        .select(
            "ID",
            F.explode(F.sequence((F.col("n") + 1).cast("int"), F.lit(max_n))).alias("pos"),
            F.lit(pad).alias("Tweet"),
            F.lit(False).alias("is_real"),
        )
    )
    return real.unionByName(short)


def histogram(df: DataFrame, col: str, bins: int = 20) -> DataFrame:
    """Equal-width bins between minimum and maximum, the last one closed; empty bins are kept."""
    x = F.col(col).cast("double")
    lo = df.select(F.min(x)).scalar()
    hi = df.select(F.max(x)).scalar()
    width = (hi - lo) / bins
    place = F.when(width == 0, F.lit(0)).otherwise(
        F.least(F.floor((x - lo) / width).cast("int"), F.lit(bins - 1))
    )
    counts = df.where(x.isNotNull()).select(place.alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))
    frame = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return frame.join(counts, "bin", "left").select(
        "bin",
        (lo + F.col("bin") * width).alias("bin_start"),
        F.coalesce("n", F.lit(0)).cast("bigint").alias("n"),
    )


NARROW_BINS = 4096
LARGEST = 1.7976931348623157e308


def order_statistics(
    data: DataFrame, col: str, places: Iterable[int], low: float, high: float, bins: int = NARROW_BINS
) -> dict[int, float]:
    """The values at 0-based ``places`` of the sorted column, whose values lie from ``low`` to ``high``.

    Each round counts the values of every interval still open in ``bins`` equal bins, and goes on in the bin that holds the place, from its least to its largest value. A place is found
    when both are equal; the ends of an interval never share a bin, so every round gains. The
    driver sees counts of bins only.
    """
    found: dict[int, float] = {}
    open_ = {k: (low, high, 0) for k in places}
    x = F.col(col)
    while open_:
        found.update({k: lo for k, (lo, hi, _) in open_.items() if lo == hi})
        open_ = {k: v for k, v in open_.items() if k not in found}
        if not open_:
            break
        ranges = sorted({(lo, hi) for lo, hi, _ in open_.values()})

        def cell(lo: float, hi: float) -> Column:
            # Halves keep the width of the widest interval in range.
            bounded = F.greatest(F.least(x, F.lit(LARGEST)), F.lit(-LARGEST))
            first, last = max(lo, -LARGEST) / 2, min(hi, LARGEST) / 2
            part = F.least(F.floor((bounded / 2 - first) / (last - first) * bins), F.lit(bins - 1)) if last > first else F.lit(0)
            # Infinite ends have a bin of their own.
            return F.when(x == float("-inf"), -1).when(x == float("inf"), bins).otherwise(part).cast("int")

        parts = [F.when(x.between(lo, hi), F.struct(F.lit(i).alias("r"), cell(lo, hi).alias("c"))) for i, (lo, hi) in enumerate(ranges)]
        counts = (
            data.select(x, F.inline(F.array_compact(F.array(*parts)))).groupBy("r", "c")
            .agg(F.count("*").alias("n"), F.min(x).alias("lo"), F.max(x).alias("hi")).collect()
        )
        filled: dict[int, list] = {}
        for row in sorted(counts, key=lambda row: (row["r"], row["c"])):
            filled.setdefault(row["r"], []).append(row)
        for k, (lo, hi, before) in open_.items():
            for row in filled[ranges.index((lo, hi))]:
                if k < before + row["n"]:
                    open_[k] = (row["lo"], row["hi"], before)
                    break
                before += row["n"]
    return found


def describe(df: DataFrame, col: str, accuracy: int = NARROW_BINS) -> DataFrame:
    """Count, mean, sample deviation, minimum, exact quartiles (linear interpolation), maximum.

    Nulls and NaN are left out. Quartiles come from counts in ever narrower bins, ``accuracy`` of
    them a round, so nothing is sorted and no task sees more than counts.
    """
    x = F.col(col).cast("double")
    data = df.select(x.alias("x")).where("x is not null and not isnan(x)")
    names = ("mean", "std", "min", "p25", "p50", "p75", "max")
    first = data.agg(
        F.count("x").alias("n"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"), F.min("x").alias("min"), F.max("x").alias("max")
    ).first()
    n = first["n"]
    if n == 0:
        return data.agg(F.count("x").alias("n"), *[F.avg("x").alias(c) for c in names])
    wanted = {p: p * (n - 1) for p in (0.25, 0.5, 0.75)}
    places = {int(k) for k in wanted.values()} | {min(int(k) + 1, n - 1) for k in wanted.values()}
    at = order_statistics(data, "x", places, first["min"], first["max"], accuracy)

    def quartile(k: float) -> float:
        low, high = at[int(k)], at[min(int(k) + 1, n - 1)]
        return low if low == high else low + (high - low) * (k - int(k))

    row = (n, first["mean"], first["std"], first["min"], *[quartile(k) for k in wanted.values()], first["max"])
    return df.sparkSession.createDataFrame([row], "n bigint, " + ", ".join(f"{c} double" for c in names))


def best_so_far(df: DataFrame, order: str = "number", value: str = "value") -> DataFrame:
    return running(df, [], order, {"best_so_far": Running("max", F.col(value))})
