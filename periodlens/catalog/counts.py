"""Counts, frequencies, period tables and per-period features."""

from pyspark.sql import functions as F

from periodlens.catalog.registry import (
    SQL_EXPLORE_TOKENS,
    SQL_IS_CLEAN,
    STOPWORDS,
    query,
    sql_tokens,
)
from periodlens.catalog.texts import texts
from periodlens.functions import text as tx
from periodlens.operators import periods as pe
from periodlens.plans import exploration
from periodlens.sources import testtables as tt


def r6(col: str):
    return F.round(F.col(col), 6).alias(col)


@query(
    "first_label_per_period",
    "SELECT MatchID, PeriodID, arg_min(EventType, row_id) AS EventType FROM posts GROUP BY ALL",
    "posts",
)
def first_label_per_period(spark, sf):
    return pe.first_label_per_period(tt.labelled_posts(spark, sf))


@query(
    "group_periods",
    """WITH p AS (SELECT *, (row_number() OVER (PARTITION BY ID ORDER BY row_id) - 1) // 500 AS segment
                  FROM posts WHERE Tweet IS NOT NULL),
    h AS (SELECT ID, count(Tweet) AS NumTweets FROM posts GROUP BY ID)
    SELECT ID, MatchID, PeriodID, min(EventType) AS EventType, any_value(NumTweets) AS NumTweets, segment,
           string_agg(Tweet, '|' ORDER BY row_id) AS texts
    FROM p JOIN h USING (ID) GROUP BY ID, MatchID, PeriodID, segment""",
    "posts",
)
def group_periods(spark, sf):
    grouped = pe.group_periods(tt.labelled_posts(spark, sf), 500)
    return grouped.withColumn("texts", F.array_join("Tweet", "|")).drop("Tweet")


@query(
    "period_posts",
    """SELECT ID, row_id, row_number() OVER (PARTITION BY ID ORDER BY row_id) - 1 AS pos
    FROM posts WHERE Tweet IS NOT NULL""",
    "posts",
)
def period_posts(spark, sf):
    return pe.period_posts(tt.posts(spark, sf)).select("ID", "row_id", "pos")


@query(
    "period_text",
    """WITH t AS (SELECT conv_id, turn, text FROM conversations)
    SELECT CAST(conv_id AS VARCHAR) AS ID, string_agg(text, ' ' ORDER BY turn) AS text FROM t GROUP BY conv_id""",
)
def period_text(spark, sf):
    turns = tt.table(spark, sf, "conversations").select(
        F.col("conv_id").cast("string").alias("ID"),
        F.col("conv_id").cast("int").alias("MatchID"),
        F.lit(0).alias("PeriodID"),
        F.lit(0).alias("EventType"),
        F.col("turn").alias("row_id"),
        F.col("text").alias("Tweet"),
    )
    return pe.concat_period_text(pe.group_periods(turns)).select("ID", "text")


@query(
    "period_placeholder_lists",
    """SELECT d.doc_id, coalesce(list(coalesce(CAST(l.toxic AS VARCHAR), '[Empty Tweet]')), ['[No Tweets]'])[1] AS first_text,
       coalesce(any_value(l.toxic), 0) AS label
    FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY d.doc_id""",
)
def period_placeholder_lists(spark, sf):
    joined = tt.table(spark, sf, "documents").select("doc_id").join(
        tt.table(spark, sf, "labels").select("doc_id", "toxic"), "doc_id", "left"
    )
    filled = tx.empty_list_placeholder(F.array(F.col("toxic").cast("string")))
    return joined.select("doc_id", filled[0].alias("first_text"), tx.null_label(F.col("toxic")).alias("label"))


TS_SQL = """
WITH e AS (SELECT epoch_ms(date_trunc('hour', ts)) AS ts_ms, event_type, event_id FROM events),
f AS (SELECT ts_ms, event_type, count(*) AS n, min(event_id) AS first_row FROM e GROUP BY ALL)
SELECT ts_ms, CAST(sum(n) AS BIGINT) AS TweetCount, string_agg(event_type, ', ' ORDER BY first_row) AS EventTypes
FROM f GROUP BY ts_ms
"""


def _hourly(spark, sf):
    events = tt.table(spark, sf, "events")
    return events.select(
        F.unix_millis(F.date_trunc("hour", F.col("ts").cast("timestamp"))).alias("ts_ms"), "event_type", "event_id"
    )


@query("count_per_timestamp", TS_SQL)
def count_per_timestamp(spark, sf):
    return pe.count_per_timestamp(_hourly(spark, sf), "ts_ms", "event_type", "event_id")


@query("join_counts_with_labels", TS_SQL + " ORDER BY ts_ms")
def join_counts_with_labels(spark, sf):
    return pe.counts_joined_with_labels(_hourly(spark, sf), "ts_ms", "event_type", "event_id").orderBy("ts_ms")


@query(
    "value_counts",
    """SELECT EventType, count(*) AS n, round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 6) AS percent
    FROM posts GROUP BY EventType""",
    "posts",
)
def value_counts(spark, sf):
    return pe.value_counts(tt.labelled_posts(spark, sf), "EventType", True).select("EventType", "n", r6("percent"))


@query(
    "missing_counts",
    """SELECT count(*) AS n_rows, CAST(4 AS BIGINT) AS n_columns,
       count(*) FILTER (WHERE doc_id IS NULL) AS missing_doc_id, count(*) FILTER (WHERE text IS NULL) AS missing_text,
       count(*) FILTER (WHERE quality IS NULL) AS missing_quality, count(*) FILTER (WHERE toxic IS NULL) AS missing_toxic
    FROM (SELECT doc_id, text, quality, toxic FROM documents LEFT JOIN labels USING (doc_id))""",
)
def missing_counts(spark, sf):
    joined = tt.table(spark, sf, "documents").select("doc_id", "text").join(
        tt.table(spark, sf, "labels"), "doc_id", "left"
    )
    return pe.missing_counts(joined.select("doc_id", "text", "quality", "toxic"))


@query(
    "describe_column",
    """SELECT count(x) AS n, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS std, min(x) AS min,
       round(quantile_cont(x, 0.25), 6) AS p25, round(quantile_cont(x, 0.5), 6) AS p50,
       round(quantile_cont(x, 0.75), 6) AS p75, max(x) AS max FROM (SELECT l_extendedprice AS x FROM lineitem)""",
)
def describe_column(spark, sf):
    d = pe.describe(tt.table(spark, sf, "lineitem"), "l_extendedprice")
    return d.select("n", r6("mean"), r6("std"), "min", r6("p25"), r6("p50"), r6("p75"), "max")


@query(
    "removed_by_step",
    f"""WITH t AS (SELECT Tweet, count(*) AS n FROM posts GROUP BY Tweet)
    SELECT CAST(sum(n) AS BIGINT) AS n_before, count(*) AS n_after_dedup, count(Tweet) AS n_after_null_drop,
           count(*) FILTER (WHERE {SQL_IS_CLEAN}) AS n_after_filter, CAST(sum(n) - count(*) AS BIGINT) AS removed_duplicates
    FROM t""",
    "posts",
)
def removed_by_step(spark, sf):
    return pe.removed_by_step(tt.posts(spark, sf))


@query(
    "avg_tweets_per_id",
    "SELECT round(avg(n), 6) AS avg_tweets_per_id FROM (SELECT ID, count(*) AS n FROM posts GROUP BY ID)",
    "posts",
)
def avg_tweets_per_id(spark, sf):
    return pe.avg_tweets_per_id(tt.posts(spark, sf)).select(r6("avg_tweets_per_id"))


@query(
    "label_distribution_by_id",
    """WITH f AS (SELECT ID, arg_min(EventType, row_id) AS EventType FROM posts GROUP BY ID)
    SELECT EventType, count(*) AS n, round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 6) AS percent FROM f GROUP BY EventType""",
    "posts",
)
def label_distribution_by_id(spark, sf):
    return pe.label_distribution_by_id(tt.labelled_posts(spark, sf)).select("EventType", "n", r6("percent"))


@query(
    "tweets_by_year_date",
    """WITH d AS (SELECT CAST(year(o_orderdate) AS INT) AS Year, strftime(o_orderdate, '%Y-%m-%d') AS Date, count(*) AS TweetCount
                  FROM orders GROUP BY ALL)
    SELECT Year, Date, TweetCount, round(avg(TweetCount) OVER (PARTITION BY Year), 6) AS year_mean FROM d""",
)
def tweets_by_year_date(spark, sf):
    orders = tt.table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("day"))
    return pe.tweets_by_year_date(orders, "day").select(
        "Year", F.col("Date").cast("string").alias("Date"), "TweetCount", r6("year_mean")
    )


@query(
    "distinct_dates",
    "SELECT DISTINCT strftime(o_orderdate, '%Y-%m-%d') AS Date FROM orders WHERE year(o_orderdate) = 1996 ORDER BY Date",
)
def distinct_dates(spark, sf):
    orders = tt.table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("day"))
    return pe.distinct_dates(orders, "day", 1996).select(F.col("Date").cast("string").alias("Date"))


MINUTES_SQL = """
WITH m AS (SELECT MatchID, PeriodID, count(*) AS n FROM posts GROUP BY ALL)
SELECT PeriodID AS GameMinute, round(avg(n), 6) AS AvgTweets FROM m GROUP BY PeriodID
"""


@query("avg_tweets_per_minute", MINUTES_SQL, "posts")
def avg_tweets_per_minute(spark, sf):
    return pe.avg_tweets_per_minute(tt.posts(spark, sf)).select("GameMinute", r6("AvgTweets"))


@query(
    "interval_bands",
    """WITH b(band, band_start, band_end) AS (VALUES ('Halftime', 35, 55), ('Fulltime', 80, 100), ('1st Extra Time', 105, 115), ('2nd Extra Time', 120, 130)),
    m AS (SELECT CAST(l_quantity AS INT) * 3 AS minute, count(*) AS n FROM lineitem GROUP BY ALL)
    SELECT minute, n, band, band_start, band_end FROM m JOIN b ON minute BETWEEN band_start AND band_end""",
)
def interval_bands(spark, sf):
    minutes = (
        tt.table(spark, sf, "lineitem")
        .groupBy((F.col("l_quantity").cast("int") * 3).alias("minute"))
        .agg(F.count("*").alias("n"))
    )
    return pe.interval_bands(minutes, "minute")


@query(
    "word_frequency",
    f"""SELECT word, count(*) AS n FROM (SELECT unnest({SQL_EXPLORE_TOKENS}) AS word FROM posts)
    GROUP BY word ORDER BY n DESC, word LIMIT 20""",
    "posts",
)
def word_frequency(spark, sf):
    words = tt.posts(spark, sf).select(tx.explore_words(F.col("Tweet"), STOPWORDS).alias("ws"))
    return pe.word_frequency(words, "ws", 20)


@query(
    "hashtag_frequency",
    f"""SELECT word, count(*) AS n FROM (SELECT unnest(list_filter({sql_tokens('Tweet')}, lambda w: w[1] = '#')) AS word FROM texts)
    GROUP BY word ORDER BY n DESC, word LIMIT 10""",
    "posts texts",
)
def hashtag_frequency(spark, sf):
    return pe.hashtag_frequency(texts(spark, sf), 10)


@query(
    "vocabulary",
    f"SELECT DISTINCT MatchID, unnest({sql_tokens('lower(Tweet)')}) AS word FROM posts",
    "posts",
)
def vocabulary(spark, sf):
    return pe.vocabulary(tt.posts(spark, sf).select("MatchID", F.lower("Tweet").alias("t")), "t")


FEATURES_SQL = f"""
kept AS (SELECT min(row_id) AS row_id, arg_min(ID, row_id) AS ID, arg_min(MatchID, row_id) AS MatchID,
                arg_min(PeriodID, row_id) AS PeriodID, arg_min(EventType, row_id) AS EventType, Tweet
         FROM posts WHERE {SQL_IS_CLEAN} GROUP BY Tweet),
feat AS (SELECT ID, min(MatchID) AS MatchID, min(PeriodID) AS PeriodID, arg_min(EventType, row_id) AS EventType,
                count(Tweet) AS NumTweets, avg(length(Tweet)) AS AvgTweetLength
         FROM kept GROUP BY ID)
"""


@query(
    "period_features",
    "WITH" + FEATURES_SQL + "SELECT ID, MatchID, PeriodID, EventType, NumTweets, round(AvgTweetLength, 6) AS AvgTweetLength FROM feat",
    "posts",
)
def period_features(spark, sf):
    return pe.period_features(exploration.prepared(tt.labelled_posts(spark, sf))).select(
        "ID", "MatchID", "PeriodID", "EventType", "NumTweets", r6("AvgTweetLength")
    )


THREE = {k: v for k, v in pe.FEATURE_PARAMS.items() if k != "Sentiment"}


@query(
    "zscore_fit",
    "WITH" + FEATURES_SQL + """SELECT round(avg(NumTweets), 6) AS num_tweets_mean, round(stddev_samp(NumTweets), 6) AS num_tweets_std,
    round(avg(AvgTweetLength), 6) AS avg_tweet_length_mean, round(stddev_samp(AvgTweetLength), 6) AS avg_tweet_length_std,
    round(avg(PeriodID), 6) AS "periodID_mean", round(stddev_samp(PeriodID), 6) AS "periodID_std" FROM feat""",
    "posts",
)
def zscore_fit(spark, sf):
    features = pe.period_features(exploration.prepared(tt.labelled_posts(spark, sf)))
    fitted = pe.zscore_fit(features, THREE)
    return fitted.select(*[r6(c) for c in fitted.columns])


@query(
    "zscore_apply",
    "WITH" + FEATURES_SQL + """SELECT ID, EventType,
    round((NumTweets - avg(NumTweets) OVER ()) / nullif(stddev_samp(NumTweets) OVER (), 0), 6) AS NumTweets,
    round((AvgTweetLength - avg(AvgTweetLength) OVER ()) / nullif(stddev_samp(AvgTweetLength) OVER (), 0), 6) AS AvgTweetLength,
    round((PeriodID - avg(PeriodID) OVER ()) / nullif(stddev_samp(PeriodID) OVER (), 0), 6) AS NormalizedPeriod FROM feat""",
    "posts",
)
def zscore_apply(spark, sf):
    done = exploration.normalised_features(tt.labelled_posts(spark, sf))
    return done.select("ID", "EventType", r6("NumTweets"), r6("AvgTweetLength"), r6("NormalizedPeriod"))


VALENCE_SQL = f"""
dw AS (SELECT DISTINCT p.doc_id, unnest({sql_tokens('lower(Tweet)')}) AS word FROM posts p),
valence AS (SELECT word, round(avg(quality) * 4 - 3, 2) AS score FROM dw JOIN labels USING (doc_id) GROUP BY word),
sw AS (SELECT ID, row_id, unnest({sql_tokens('lower(Tweet)')}) AS word FROM posts),
ss AS (SELECT ID, row_id, sum(score) AS s FROM sw JOIN valence USING (word) GROUP BY ALL),
tot AS (SELECT ID, sum(s / sqrt(s * s + 15)) AS total FROM ss GROUP BY ID)
"""


def valence(spark, sf):
    """Word scores from the labelled documents: mean quality of a word's documents, scaled.

    Posts are cut at spaces and line ends, so a document's words are those of its posts. Repeated
    words go inside the row, documents without a label before the words are taken apart.
    """
    labels = tt.table(spark, sf, "labels").select("doc_id", "quality")
    docs = tt.table(spark, sf, "documents").select("doc_id", "text").join(labels, "doc_id", "left_semi")
    words = docs.select("doc_id", F.explode(F.array_distinct(tx.tokenize(F.lower("text")))).alias("word")).distinct()
    return words.join(labels, "doc_id").groupBy("word").agg(F.round(F.avg("quality") * 4 - 3, 2).alias("score"))


@query(
    "avg_sentiment",
    "WITH" + VALENCE_SQL + """SELECT ID, round(coalesce(coalesce(total, 0) / nullif(n, 0), 0), 6) AS Sentiment
    FROM (SELECT ID, count(Tweet) AS n FROM posts GROUP BY ID) LEFT JOIN tot USING (ID)""",
    "posts",
)
def avg_sentiment(spark, sf):
    return pe.avg_sentiment(tt.posts(spark, sf), valence(spark, sf)).select("ID", r6("Sentiment"))


@query(
    "remove_listed_words",
    f"""WITH w AS (SELECT row_id, unnest({sql_tokens('lower(Tweet)')}) AS word FROM posts),
    stop AS (SELECT DISTINCT unnest({sql_tokens('lower(text)')}) AS word FROM benchmark)
    SELECT row_id, word FROM w WHERE word NOT IN (SELECT word FROM stop)""",
    "posts",
)
def remove_listed_words(spark, sf):
    words = tt.posts(spark, sf).select("row_id", F.explode(tx.tokenize(F.lower("Tweet"))).alias("word"))
    stop = tt.table(spark, sf, "benchmark").select(F.explode(tx.tokenize(F.lower("text"))).alias("word")).distinct()
    return pe.remove_listed(words, "word", stop).select("row_id", "word")


@query(
    "cap_and_mask",
    """WITH p AS (SELECT ID, Tweet, row_number() OVER (PARTITION BY ID ORDER BY row_id) AS pos FROM posts WHERE Tweet IS NOT NULL),
    c AS (SELECT ID, count(Tweet) AS n FROM posts GROUP BY ID)
    SELECT ID, CAST(pos AS INT) AS pos, Tweet, true AS is_real FROM p WHERE pos <= 1500
    UNION ALL SELECT ID, CAST(g AS INT), '[No Tweets]', false FROM c, generate_series(1, 1500) t(g) WHERE g > n""",
    "posts",
)
def cap_and_mask(spark, sf):
    return pe.cap_and_mask(tt.posts(spark, sf), 1500)


@query(
    "histogram",
    """WITH s AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem),
    b AS (SELECT CAST(least(floor((l_extendedprice - lo) / ((hi - lo) / 20)), 19) AS INT) AS bin, count(*) AS n FROM lineitem, s GROUP BY bin)
    SELECT CAST(g AS INT) AS bin, round(lo + g * ((hi - lo) / 20), 6) AS bin_start, coalesce(n, 0) AS n
    FROM generate_series(0, 19) t(g) CROSS JOIN s LEFT JOIN b ON g = bin""",
)
def histogram(spark, sf):
    return pe.histogram(tt.table(spark, sf, "lineitem"), "l_extendedprice").select("bin", r6("bin_start"), "n")


@query(
    "best_so_far",
    "SELECT number, round(max(value) OVER (ORDER BY number ROWS UNBOUNDED PRECEDING), 6) AS best_so_far FROM trials",
    "trials",
)
def best_so_far(spark, sf):
    return pe.best_so_far(tt.trials(spark, sf)).select("number", r6("best_so_far"))
