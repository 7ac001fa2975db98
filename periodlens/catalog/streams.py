"""Streaming runs over the benchmark files; each is compared with its batch meaning."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from periodlens.catalog.registry import SQL_CLEAN_TOKENS, SQL_IS_CLEAN, query, sql_distinct
from periodlens.sources import testtables as tt
from periodlens.streaming import posts as st

EVENTS = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("value", T.DoubleType()),
    ]
)
TURNS = T.StructType(
    [
        T.StructField("conv_id", T.LongType()),
        T.StructField("turn", T.LongType()),
        T.StructField("role", T.StringType()),
        T.StructField("text", T.StringType()),
    ]
)


def events(spark, sf):
    stream = st.read_files(spark, sf, "events.parquet", EVENTS)
    return stream.withColumn("event_time", F.col("ts").cast("timestamp"))


@query(
    "stream_filter_clean",
    f"""WITH t AS (SELECT conv_id, turn, text AS Tweet FROM conversations),
    k AS (SELECT conv_id, turn, {SQL_CLEAN_TOKENS} AS ws FROM t WHERE {SQL_IS_CLEAN})
    SELECT conv_id, turn, array_to_string({sql_distinct('ws')}, ' ') AS v FROM k""",
)
def stream_filter_clean(spark, sf):
    turns = st.read_files(spark, sf, "conversations.parquet", TURNS).withColumnRenamed("text", "Tweet")
    done = st.filter_and_clean(turns).select("conv_id", "turn", F.col("Preprocessed_Tweet").alias("v"))
    return st.run_available(done, spark, "clean-stream")


@query(
    "stream_dedup",
    "SELECT user_id, event_type, count(*) AS n FROM (SELECT DISTINCT user_id, event_type, value FROM events) GROUP BY ALL",
)
def stream_dedup(spark, sf):
    kept = st.dedup_within(events(spark, sf), ["user_id", "event_type", "value"], "60 days")
    done = st.run_available(kept.select("user_id", "event_type", "value"), spark, "dedup-stream")
    return done.groupBy("user_id", "event_type").agg(F.count("*").alias("n"))


@query(
    "stream_period_counts",
    """WITH c AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS h, event_type, count(*) AS n, sum(value) AS total FROM events GROUP BY ALL),
    m AS (SELECT max(ts) - INTERVAL 10 MINUTE AS mark FROM events)
    SELECT strftime(h, '%Y-%m-%d %H:%M') AS period_start, event_type, n, round(total, 4) AS total
    FROM c, m WHERE h + INTERVAL 1 HOUR <= mark""",
)
def stream_period_counts(spark, sf):
    counts = st.period_counts(events(spark, sf), ["event_type"], "1 hour", "10 minutes")
    done = st.run_available(counts, spark, "count-stream")
    return done.select(
        F.date_format("period_start", "yyyy-MM-dd HH:mm").alias("period_start"),
        "event_type", "n", F.round("total", 4).alias("total"),
    )


@query(
    "batch_period_counts",
    """SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M') AS period_start, event_type, count(*) AS n
    FROM events GROUP BY ALL""",
)
def batch_period_counts(spark, sf):
    rows = tt.table(spark, sf, "events").withColumn("event_time", F.col("ts").cast("timestamp"))
    counts = st.period_counts(rows, ["event_type"], "1 hour", "10 minutes")
    return counts.select(F.date_format("period_start", "yyyy-MM-dd HH:mm").alias("period_start"), "event_type", "n")


EVOLUTION_SQL = f"""
t AS (SELECT turn, conv_id, text AS Tweet FROM conversations),
k AS (SELECT conv_id AS PeriodID, CASE role WHEN 'user' THEN 1 ELSE 2 END AS MatchID, {SQL_CLEAN_TOKENS.replace('Tweet', 'text')} AS ws
      FROM conversations),
u AS (SELECT MatchID, PeriodID, list_sort(list_distinct(ws)) AS units FROM k),
l AS (SELECT MatchID, PeriodID, units, unnest(units) AS a, generate_subscripts(units, 1) AS i FROM u),
p AS (SELECT MatchID, PeriodID, a, unnest(units[i + 1:]) AS b, 1.0::DOUBLE / len(units) AS w FROM l),
e AS (SELECT MatchID, PeriodID, a, b, sum(w) AS w FROM p GROUP BY ALL),
r AS (SELECT MatchID, PeriodID, row_number() OVER (PARTITION BY MatchID ORDER BY PeriodID) AS rank
      FROM (SELECT DISTINCT MatchID, PeriodID FROM u)),
re AS (SELECT e.MatchID, rank, a, b, w FROM e JOIN r USING (MatchID, PeriodID)),
sq AS (SELECT coalesce(c.MatchID, p.MatchID) AS MatchID, coalesce(c.rank, p.rank + 1) AS rank,
              sum((coalesce(c.w, 0) - coalesce(p.w, 0)) * (coalesce(c.w, 0) - coalesce(p.w, 0))) AS s
       FROM re c FULL JOIN re p ON c.MatchID = p.MatchID AND c.rank = p.rank + 1 AND c.a = p.a AND c.b = p.b GROUP BY ALL),
d AS (SELECT r.MatchID, r.PeriodID, r.rank, CASE WHEN r.rank > 1 THEN sqrt(2 * coalesce(s, 0)) END AS distance
      FROM r LEFT JOIN sq ON r.MatchID = sq.MatchID AND r.rank = sq.rank)
SELECT MatchID, PeriodID, round(distance, 4) AS distance,
       CAST(count(*) FILTER (WHERE distance > 4) OVER (PARTITION BY MatchID ORDER BY rank) % 2 AS INT) AS is_event
FROM d WHERE PeriodID < (SELECT max(conv_id) FROM conversations) - 1
"""


@query("stream_evolution", "WITH" + EVOLUTION_SQL)
def stream_evolution(spark, sf):
    """Conversations as one-minute periods of two matches (one per role); the last two stay open."""
    turns = st.read_files(spark, sf, "conversations.parquet", TURNS)
    posts = turns.select(
        F.timestamp_seconds(F.col("conv_id") * 60).alias("event_time"),
        F.when(F.col("role") == "user", 1).otherwise(2).alias("MatchID"),
        "conv_id",
        st.tx.clean_graph(F.col("text")).alias("Preprocessed_Tweet"),
    )
    edges = st.closed_edges(posts, F.col("conv_id"))
    flags = st.run_evolution(edges, spark, 4.0)
    return flags.select("MatchID", "PeriodID", F.round("distance", 4).alias("distance"), "is_event")
