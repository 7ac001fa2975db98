import datetime as dt

from pyspark.sql import functions as F

from periodlens import schemas
from periodlens.operators import periods as pe
from periodlens.sources import io


def test_tweets_round_trip(spark, tmp_path):
    (tmp_path / "in").mkdir()
    head = "ID,MatchID,PeriodID,EventType,Timestamp,Tweet\n"
    (tmp_path / "in" / "a.csv").write_text(head + '6_0,6,0,1,1402588800000,"two\nlines, ""quoted"""\n6_1,6,1,0,1402588860000,\n')
    (tmp_path / "in" / "b.csv").write_text(head + "9_0,9,0,,1402588800000,goal\n")
    (tmp_path / "in" / "notes.txt").write_text("not a table")
    df = io.read_tweets(spark, str(tmp_path / "in"), provenance=True)
    got = {r["ID"]: r for r in df.collect()}
    assert got["6_0"]["Tweet"] == 'two\nlines, "quoted"' and got["6_1"]["Tweet"] is None
    assert got["9_0"]["EventType"] is None and got["9_0"]["source_file"] == "b.csv"
    one = io.read_tweets(spark, str(tmp_path / "in" / "b.csv"))
    assert one.schema == schemas.POSTS_LABELLED and one.count() == 1
    assert io.with_row_id(one, ["Timestamp", "ID"]).first()["row_id"] == 0

    io.write_by_match(df, str(tmp_path / "by_match"))
    assert sorted(p.name for p in (tmp_path / "by_match").glob("MatchID=*")) == ["MatchID=6", "MatchID=9"]

    clean = df.where("Tweet is not null").withColumn("Preprocessed_Tweet", F.upper("Tweet"))
    for labelled in (True, False):
        path = str(tmp_path / f"pre{labelled}")
        io.write_preprocessed(clean, path, labelled)
        back = io.read_preprocessed(spark, path, labelled)
        assert ("EventType" in back.columns) == labelled
        assert {r["Preprocessed_Tweet"] for r in back.collect()} == {'TWO\nLINES, "QUOTED"', "GOAL"}


def test_predictions_read_by_prefix(spark, tmp_path):
    df = spark.createDataFrame([("6_0", 1), ("6_1", 0)], schemas.PREDICTIONS)
    io.write_predictions(df, str(tmp_path / "out"))
    for i, part in enumerate(sorted((tmp_path / "out").glob("*.csv"))):
        (tmp_path / f"predictions_{i}.csv").write_bytes(part.read_bytes())
    (tmp_path / "merged.csv").write_text("ID,EventType\n6_9,1\n")
    assert sorted(r["ID"] for r in io.read_predictions(spark, str(tmp_path)).collect()) == ["6_0", "6_1"]


def test_params_period_table_embeddings_dataset(spark, tmp_path):
    feats = spark.createDataFrame(
        [("6_0", 3, 10.0, 0, ["a"]), ("6_1", 5, 14.0, 1, ["b"])], "ID string, NumTweets int, AvgTweetLength double, PeriodID int, Tweet array<string>"
    )
    columns = {k: v for k, v in pe.FEATURE_PARAMS.items() if k != "Sentiment"}
    params = pe.zscore_fit(feats, columns).withColumn("class_weights", F.array(F.lit(0.5), F.lit(2.0)))
    io.save_params(params, str(tmp_path / "params"))
    loaded = io.load_params(spark, str(tmp_path / "params"))
    row = loaded.first()
    assert row["num_tweets_mean"] == 4.0 and row["class_weights"] == [0.5, 2.0] and row["sentiment_mean"] is None
    out = pe.zscore_apply(feats, loaded, columns, {k: f"z_{k}" for k in columns})
    assert abs(out.orderBy("ID").first()["z_NumTweets"] + 0.5**0.5) < 1e-12

    io.write_period_table(feats, str(tmp_path / "periods"))
    schema = "ID string, NumTweets int, AvgTweetLength double, PeriodID int"
    assert io.read_period_table(spark, str(tmp_path / "periods"), schema).count() == 2

    vecs = spark.createDataFrame([("6_0", 0, [0.5, 1.0], True), ("6_0", 1, [0.0, 0.0], False)], schemas.EMBEDDINGS)
    io.write_embeddings(vecs, str(tmp_path / "emb"))
    assert io.read_embeddings(spark, str(tmp_path / "emb")).exceptAll(vecs).count() == 0

    io.write_dataset(feats.withColumn("split", F.when(F.col("PeriodID") == 0, "train").otherwise("validation")), str(tmp_path / "ds"))
    assert [r["ID"] for r in io.read_dataset(spark, str(tmp_path / "ds"), "validation").collect()] == ["6_1"]


def test_run_history_skips_incomplete_runs_and_trials_limit(spark, tmp_path):
    spark.createDataFrame([("r1", 1.0, 0.5)], "run_id string, epoch double, eval_accuracy double").write.parquet(str(tmp_path / "r1"))
    spark.createDataFrame([("r2", 1.0)], "run_id string, epoch double").write.parquet(str(tmp_path / "r2"))
    got = io.read_run_history(spark, [str(tmp_path / "r1"), str(tmp_path / "r2")]).collect()
    assert [r["run_id"] for r in got] == ["r1"] and got[0]["run_name"] is None
    rows = [(i, 0.1 * i, 1e-4, 0.1, 1e-5, 4, 64, "COMPLETE") for i in reversed(range(40))]
    spark.createDataFrame(rows, schemas.TRIALS).write.parquet(str(tmp_path / "trials"))
    assert [r["number"] for r in io.read_trials(spark, str(tmp_path / "trials")).collect()] == list(range(30))


def test_only_year_is_a_range(spark):
    from periodlens.operators import rows

    ms = [int(dt.datetime(y, m, d, tzinfo=dt.timezone.utc).timestamp() * 1000) for y, m, d in ((2009, 12, 31), (2010, 1, 1), (2010, 12, 31), (2011, 1, 1))]
    df = spark.createDataFrame([(m,) for m in ms], "Timestamp bigint")
    assert rows.only_year(df, 2010).count() == 2


def test_quoted_line_breaks_across_splits(spark, tmp_path):
    import random

    rng = random.Random(2)
    texts = ['plain', 'two\nlines', 'a "quoted" word', '"', 'ends with quote"', 'comma, and\n\n"both"', "", "é\U0001f600\nß", "x" * 70 + "\ny"]
    (tmp_path / "in").mkdir()
    for name, n, end in (("a.csv", 400, "\n"), ("b.csv", 3, "\r\n"), ("c.csv", 0, "\n")):
        rows = ["ID,MatchID,PeriodID,EventType,Timestamp,Tweet"]
        for i in range(n):
            text = rng.choice(texts)
            rows.append(f"{i}_0,{i},0,{i % 2},{i * 1000}," + (f'"{text.replace(chr(34), chr(34) * 2)}"' if text else ""))
        (tmp_path / "in" / name).write_text(end.join(rows) + end * (n != 3), newline="")
    want = sorted(io.read_tweets(spark, str(tmp_path / "in"), provenance=True).collect(), key=str)
    assert len(want) == 403
    limit = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "333")
    try:
        assert spark.read.text(str(tmp_path / "in" / "a.csv")).rdd.getNumPartitions() > 20
        got = io.read_tweets_split(spark, str(tmp_path / "in"), provenance=True)
        assert sorted(got.collect(), key=str) == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", limit)
    one = io.read_tweets_split(spark, str(tmp_path / "in" / "b.csv"))
    assert one.columns == io.read_tweets(spark, str(tmp_path / "in" / "b.csv")).columns and one.count() == 3
