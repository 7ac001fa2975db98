"""Round trips: given tables written by a sink to the shared folder and read back by its source."""

from pyspark.sql import functions as F

from periodlens.catalog.registry import query
from periodlens.operators.rows import union_all
from periodlens.session import new_path
from periodlens.sources import io
from periodlens.sources import testtables as tt

POSTS = ["ID", "MatchID", "PeriodID", "EventType", "Timestamp", "Tweet"]
POSTS_ALL_SQL = f"SELECT {', '.join(POSTS)} FROM posts"


def _csv_posts(spark, sf) -> str:
    path = new_path(spark, "source-posts")
    io.write_tweets(tt.labelled_posts(spark, sf), path)
    return path


@query("source_read_folder", POSTS_ALL_SQL, "posts")
def source_read_folder(spark, sf):
    return io.read_tweets(spark, _csv_posts(spark, sf))


@query("source_read_files", POSTS_ALL_SQL, "posts")
def source_read_files(spark, sf):
    files = io.read_tweets(spark, _csv_posts(spark, sf)).inputFiles()
    return union_all([io.read_tweets(spark, f) for f in files])


@query(
    "source_read_unlabelled",
    "SELECT ID, MatchID, PeriodID, Timestamp, Tweet, true AS from_part FROM posts",
    "posts",
)
def source_read_unlabelled(spark, sf):
    path = new_path(spark, "source-posts")
    io.write_tweets(tt.posts(spark, sf), path, labelled=False)
    read = io.read_tweets(spark, path, labelled=False, provenance=True)
    return read.withColumn("from_part", F.col("source_file").startswith("part-")).drop("source_file")


@query("source_by_match", "SELECT MatchID, row_id, ID, EventType, Tweet FROM posts", "posts")
def source_by_match(spark, sf):
    path = new_path(spark, "source-by-match")
    io.write_by_match(tt.labelled_posts(spark, sf).select("MatchID", "row_id", "ID", "EventType", "Tweet"), path)
    return spark.read.parquet(path).select(F.col("MatchID").cast("int").alias("MatchID"), "row_id", "ID", "EventType", "Tweet")


@query(
    "source_preprocessed",
    "SELECT ID, MatchID, PeriodID, EventType, Timestamp, lower(Tweet) AS Preprocessed_Tweet FROM posts WHERE Tweet IS NOT NULL",
    "posts",
)
def source_preprocessed(spark, sf):
    path = new_path(spark, "source-preprocessed")
    done = tt.labelled_posts(spark, sf).where("Tweet is not null").withColumn("Preprocessed_Tweet", F.lower("Tweet"))
    io.write_preprocessed(done, path)
    return io.read_preprocessed(spark, path)


@query(
    "source_predictions",
    "SELECT concat(user_id, '_', event_id) AS ID, CAST(value > 50 AS INT) AS EventType FROM events",
)
def source_predictions(spark, sf):
    path = new_path(spark, "source-predictions")
    events = tt.table(spark, sf, "events")
    io.write_predictions(
        events.select(F.concat_ws("_", "user_id", "event_id").alias("ID"), (F.col("value") > 50).cast("int").alias("EventType")), path
    )
    return io.read_predictions(spark, path, prefix="part-").drop("source_file")


@query("source_period_table", "SELECT ID, MatchID, PeriodID, max(EventType) AS EventType, count(Tweet) AS NumTweets FROM posts GROUP BY ALL", "posts")
def source_period_table(spark, sf):
    path = new_path(spark, "source-periods")
    table = tt.labelled_posts(spark, sf).groupBy("ID", "MatchID", "PeriodID").agg(
        F.max("EventType").alias("EventType"), F.count("Tweet").alias("NumTweets"), F.collect_set("EventType").alias("all")
    )
    io.write_period_table(table, path)
    return io.read_period_table(spark, path, table.drop("all").schema)


@query(
    "source_embeddings",
    """SELECT CAST(label AS VARCHAR) AS ID, CAST(vec_id AS INT) AS pos, vec_id % 2 = 0 AS is_real, CAST(len(embedding) AS INT) AS dims,
              embedding[1] AS first, embedding[64] AS last FROM embeddings""",
)
def source_embeddings(spark, sf):
    path = new_path(spark, "source-embeddings")
    rows = tt.table(spark, sf, "embeddings").select(
        F.col("label").alias("ID"), F.col("vec_id").alias("pos"), F.col("embedding").alias("vec"), (F.col("vec_id") % 2 == 0).alias("is_real")
    )
    io.write_embeddings(rows, path)
    return io.read_embeddings(spark, path).select(
        "ID", "pos", "is_real", F.size("vec").alias("dims"), F.get("vec", F.lit(0)).alias("first"), F.get("vec", F.lit(63)).alias("last")
    )


@query(
    "source_params",
    """SELECT CAST(count(*) AS DOUBLE) AS num_tweets_mean, CAST(max(l_quantity) AS DOUBLE) AS num_tweets_std,
              CAST(min(l_quantity) AS DOUBLE) AS periodID_mean, CAST(NULL AS DOUBLE) AS sentiment_mean FROM lineitem""",
)
def source_params(spark, sf):
    path = new_path(spark, "source-params")
    lines = tt.table(spark, sf, "lineitem")
    io.save_params(
        lines.agg(
            F.count("*").cast("double").alias("num_tweets_mean"),
            F.max("l_quantity").cast("double").alias("num_tweets_std"),
            F.min("l_quantity").cast("double").alias("periodID_mean"),
        ),
        path,
    )
    return io.load_params(spark, path).select("num_tweets_mean", "num_tweets_std", "periodID_mean", "sentiment_mean")


@query("source_dataset", "SELECT doc_id, lang, source FROM documents WHERE doc_id % 5 = 0")
def source_dataset(spark, sf):
    path = new_path(spark, "source-dataset")
    docs = tt.table(spark, sf, "documents").select("doc_id", "lang", "source")
    side = F.when(F.col("doc_id") % 5 == 0, "validation").otherwise("train")
    io.write_dataset(docs.withColumn("split", side), path)
    return io.read_dataset(spark, path, "validation").drop("split")


@query(
    "source_run_histories",
    """SELECT run_id, CAST(NULL AS VARCHAR) AS run_name, epoch, eval_accuracy FROM runs WHERE step % 3 = 0
    UNION ALL SELECT run_id, concat('run ', run_id), epoch, eval_accuracy FROM runs WHERE step % 3 = 1""",
    "runs",
)
def source_run_histories(spark, sf):
    """Three run tables: plain, named, and one without accuracies, which is skipped."""
    runs = tt.run_history(spark, sf)
    parts = [
        runs.where("step % 3 = 0").drop("step"),
        runs.where("step % 3 = 1").withColumn("run_name", F.concat(F.lit("run "), "run_id")),
        runs.where("step % 3 = 2").drop("eval_accuracy"),
    ]
    paths = []
    for part in parts:
        paths.append(new_path(spark, "source-runs"))
        part.write.parquet(paths[-1])
    return io.read_run_history(spark, paths)


@query(
    "source_trials",
    "SELECT CAST(number AS INT) AS number, value, params_learning_rate, params_fc1_dim FROM trials ORDER BY number LIMIT 30",
    "trials",
)
def source_trials(spark, sf):
    path = new_path(spark, "source-trials")
    trials = tt.trials(spark, sf)
    trials.withColumn("number", F.col("number").cast("int")).write.parquet(path)
    return io.read_trials(spark, path).select("number", "value", "params_learning_rate", "params_fc1_dim")
