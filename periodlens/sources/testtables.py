"""Views of the benchmark tables in the shape the operators expect.

No benchmark table has matches and periods, so ``posts`` makes them from ``documents``: every
line is cut at single spaces into posts of at most 16 words, so all text is kept. The match comes
from the language, the period from the document number. Lines without words become null posts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from periodlens.functions import text as tx
from periodlens.session import lookup_join, spread

WORDS_PER_POST = 16
PIECES = 100000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _match() -> Column:
    lang = F.col("lang")
    return F.when(lang == "de", 6).when(lang == "en", 9).when(lang == "es", 15).otherwise(16)


def _period() -> Column:
    return (F.col("doc_id") % 25).cast("int")


def _pieces(text: str) -> Column:
    def line_pieces(words):
        starts = F.sequence(F.lit(0), F.floor((F.size(words) - 1) / WORDS_PER_POST).cast("int"))
        return F.transform(
            starts, lambda i: F.array_join(F.slice(words, i * WORDS_PER_POST + 1, WORDS_PER_POST), " ")
        )

    lines = F.transform(F.split(text, "\n"), lambda line: F.split(line, " "))
    return F.flatten(F.transform(lines, line_pieces))


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unlabelled posts (row_id, doc_id, ID, MatchID, PeriodID, Timestamp, Tweet)."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"), "doc_id")
    pieces = docs.select(
        "doc_id",
        _match().alias("MatchID"),
        _period().alias("PeriodID"),
        F.posexplode(_pieces("text")).alias("pos", "piece"),
    )
    # A document of more pieces would share ids with the next one.
    row_id = F.when(F.col("pos") < PIECES, F.col("doc_id") * PIECES + F.col("pos")).otherwise(
        F.raise_error(F.lit("a document has too many posts"))
    )
    return pieces.select(
        row_id.alias("row_id"),
        "doc_id",
        tx.make_id(F.col("MatchID"), F.col("PeriodID")).alias("ID"),
        "MatchID",
        "PeriodID",
        (F.lit(1402588800000) + 60000 * F.col("PeriodID") + row_id % 60000).alias("Timestamp"),
        F.when(F.trim("piece") != "", F.col("piece")).alias("Tweet"),
    )


def period_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A period is an event if one of its documents is labelled toxic."""
    docs = table(spark, sf_dir, "documents").where(F.col("text").isNotNull())
    labels = table(spark, sf_dir, "labels")
    return (
        docs.select("doc_id", _match().alias("MatchID"), _period().alias("PeriodID"))
        .join(labels.select("doc_id", "toxic"), "doc_id", "left")
        .groupBy("MatchID", "PeriodID")
        .agg(F.coalesce(F.max("toxic"), F.lit(0)).cast("int").alias("EventType"))
    )


def labelled_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup_join(posts(spark, sf_dir), period_labels(spark, sf_dir), ["MatchID", "PeriodID"]).select(
        "row_id", "doc_id", "ID", "MatchID", "PeriodID", "EventType", "Timestamp", "Tweet"
    )


# The same view for an SQL engine; the list functions are DuckDB's.
POSTS_SQL = """
piece AS (
  SELECT doc_id, lang, unnest(p) AS txt, generate_subscripts(p, 1) - 1 AS pos
  FROM (SELECT doc_id, lang,
               flatten(list_transform(string_split(text, chr(10)), lambda line:
                 list_transform(range(0, len(string_split(line, ' ')), 16), lambda i:
                   array_to_string(string_split(line, ' ')[i+1:i+16], ' ')))) AS p
        FROM documents)),
post0 AS (
  SELECT doc_id * 100000 + pos AS row_id, doc_id,
         CASE lang WHEN 'de' THEN 6 WHEN 'en' THEN 9 WHEN 'es' THEN 15 ELSE 16 END AS MatchID,
         CAST(doc_id % 25 AS INT) AS PeriodID,
         CASE WHEN trim(txt) <> '' THEN txt END AS Tweet
  FROM piece),
lab AS (
  SELECT p.MatchID, p.PeriodID, CAST(coalesce(max(l.toxic), 0) AS INT) AS EventType
  FROM (SELECT DISTINCT MatchID, PeriodID, doc_id FROM post0) p
  LEFT JOIN labels l ON p.doc_id = l.doc_id
  GROUP BY p.MatchID, p.PeriodID),
posts AS (
  SELECT p.row_id, p.doc_id, concat(p.MatchID, '_', p.PeriodID) AS ID, p.MatchID, p.PeriodID,
         lab.EventType,
         CAST(1402588800000 + 60000 * p.PeriodID + p.row_id % 60000 AS BIGINT) AS Timestamp,
         p.Tweet
  FROM post0 p JOIN lab ON p.MatchID = lab.MatchID AND p.PeriodID = lab.PeriodID)
"""


def run_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs from ``events``: a run per user and event type, a step per event, an accuracy per step."""
    events = table(spark, sf_dir, "events")
    return events.select(
        F.concat_ws("-", F.col("user_id").cast("string"), "event_type").alias("run_id"),
        F.col("event_id").alias("step"),
        F.day("ts").cast("double").alias("epoch"),
        (F.col("value") / (F.col("value") + 100)).alias("eval_accuracy"),
    )


RUNS_SQL = """
runs AS (
  SELECT concat(user_id, '-', event_type) AS run_id, event_id AS step,
         CAST(day(ts) AS DOUBLE) AS epoch, value / (value + 100) AS eval_accuracy
  FROM events)
"""


def trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search trials from ``part``: one trial per part."""
    part = table(spark, sf_dir, "part")
    return part.select(
        F.col("p_partkey").alias("number"),
        (F.col("p_retailprice") / 2500).alias("value"),
        (F.col("p_size") / 10000).alias("params_learning_rate"),
        (F.col("p_size") / 100).alias("params_dropout_prob"),
        (F.col("p_retailprice") / 1000000).alias("params_weight_decay"),
        F.length("p_name").cast("int").alias("params_num_heads"),
        (F.col("p_size") * 16).cast("int").alias("params_fc1_dim"),
        F.lit("COMPLETE").alias("state"),
    )


TRIALS_SQL = """
trials AS (
  SELECT p_partkey AS number, p_retailprice / 2500 AS value,
         CAST(p_size AS DOUBLE) / 10000 AS params_learning_rate,
         CAST(p_size AS DOUBLE) / 100 AS params_dropout_prob,
         p_retailprice / 1000000 AS params_weight_decay,
         CAST(length(p_name) AS INT) AS params_num_heads,
         CAST(p_size * 16 AS INT) AS params_fc1_dim, 'COMPLETE' AS state
  FROM part)
"""
