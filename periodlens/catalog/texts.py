"""Text rules, filters and row operators."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from periodlens.catalog.registry import (
    SQL_CLEAN_TOKENS,
    SQL_CLEAN_TOKENS_ANCHORED,
    SQL_EXPLORE_TOKENS,
    SQL_IS_CLEAN,
    SQL_ML_TOKENS,
    STOPWORDS,
    query,
    sql_digest,
    sql_distinct,
    sql_list,
    sql_remove,
    sql_tokens,
)
from periodlens.functions import text as tx
from periodlens.operators import features as ft
from periodlens.operators import periods as pe
from periodlens.operators import rows
from periodlens.sources import testtables as tt


def texts(spark: SparkSession, sf: str) -> DataFrame:
    """All posts, and every page as a retweet-shaped post with URL and hashtag."""
    pages = tt.table(spark, sf, "pages").select(
        (-1 - F.col("page_id")).alias("row_id"),
        (F.col("page_id") % 25).cast("int").alias("PeriodID"),
        F.concat(
            F.lit("RT @page"), F.col("page_id").cast("string"), F.lit(": "), "url",
            F.lit(" #page"), (F.col("page_id") % 7).cast("string"), F.lit(" "), "html",
        ).alias("Tweet"),
    )
    return tt.posts(spark, sf).select("row_id", "PeriodID", "Tweet").unionByName(pages)


def _text(name: str, build, sql: str) -> None:
    """A one-column text query: row id and the transformed text."""

    @query(name, f"SELECT row_id, {sql} AS v FROM texts", "posts texts")
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return texts(spark, sf).select("row_id", build(F.col("Tweet")).alias("v"))


_text("text_lower", tx.lower_text, "lower(Tweet)")
_text("text_strip_urls_graph", tx.strip_urls, sql_remove("Tweet", tx.URL_GRAPH))
_text("text_strip_urls_classical", lambda c: tx.strip_urls(c, "classical"), sql_remove("Tweet", tx.URL_CLASSICAL))
_text("text_strip_mentions_graph", tx.strip_mentions, sql_remove("Tweet", tx.MENTION_GRAPH))
_text("text_strip_mentions_handle", lambda c: tx.strip_mentions(c, "handle"), sql_remove("Tweet", tx.MENTION_HANDLE))
_text(
    "text_strip_mentions_classical",
    lambda c: tx.strip_mentions(c, "classical"),
    sql_remove("Tweet", tx.MENTION_CLASSICAL),
)
_text("text_strip_hashtags", tx.strip_hashtags, sql_remove("Tweet", tx.HASHTAG))
_text("text_nonword_to_space", tx.nonword_to_space, sql_remove("Tweet", tx.NONWORD_RUN, " "))
_text(
    "text_strip_retweets",
    lambda c: tx.strip_retweet_tokens(tx.lower_text(c)),
    sql_remove("lower(Tweet)", tx.RETWEET),
)
_text("text_whitespace", tx.normalise_whitespace, sql_remove("Tweet", f"[{tx.SPACE}+]", " "))
_text("text_clean_ml", lambda c: tx.clean_ml(c, STOPWORDS), f"array_to_string({SQL_ML_TOKENS}, ' ')")
_text("text_clean_explore", lambda c: tx.clean_explore(c, STOPWORDS), f"array_to_string({SQL_EXPLORE_TOKENS}, ' ')")
_text(
    "text_remove_stopwords",
    lambda c: F.array_join(tx.remove_stopwords(tx.tokenize(c), STOPWORDS), " "),
    f"array_to_string(list_filter({sql_tokens('Tweet')}, lambda w: NOT list_contains({sql_list(STOPWORDS)}, w)), ' ')",
)
_text("text_null_placeholder", tx.null_placeholder, f"coalesce(Tweet, '{tx.NULL_TEXT}')")
_text("text_length", lambda c: tx.text_length(c).cast("bigint"), "length(Tweet)")


@query(
    "text_distinct_words",
    f"SELECT row_id, array_to_string({sql_distinct('ws')}, ' ') AS v FROM (SELECT row_id, {sql_tokens('Tweet')} AS ws FROM texts)",
    "posts texts",
)
def text_distinct_words(spark, sf):
    return texts(spark, sf).select("row_id", tx.distinct_words(F.col("Tweet")).alias("v"))


@query(
    "text_clean_graph",
    f"SELECT row_id, array_to_string({sql_distinct('ws')}, ' ') AS v FROM (SELECT row_id, {SQL_CLEAN_TOKENS} AS ws FROM texts)",
    "posts texts",
)
def text_clean_graph(spark, sf):
    return texts(spark, sf).select("row_id", tx.clean_graph(F.col("Tweet")).alias("v"))


@query(
    "text_clean_graph_anchored",
    f"SELECT row_id, array_to_string({sql_distinct('ws')}, ' ') AS v FROM (SELECT row_id, {SQL_CLEAN_TOKENS_ANCHORED} AS ws FROM texts)",
    "posts texts",
)
def text_clean_graph_anchored(spark, sf):
    return texts(spark, sf).select("row_id", tx.clean_graph(F.col("Tweet"), anchored=True).alias("v"))


@query(
    "text_tokens",
    f"SELECT row_id, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS pos FROM (SELECT row_id, {sql_tokens('Tweet')} AS ws FROM posts)",
    "posts",
)
def text_tokens(spark, sf):
    return tt.posts(spark, sf).select("row_id", F.posexplode(tx.tokenize(F.col("Tweet"))).alias("pos", "word")).select(
        "row_id", "word", F.col("pos").cast("bigint").alias("pos")
    )


@query(
    "text_hashtags",
    f"SELECT row_id, unnest(list_filter({sql_tokens('Tweet')}, lambda w: w[1] = '#')) AS tag FROM texts",
    "posts texts",
)
def text_hashtags(spark, sf):
    return texts(spark, sf).select("row_id", F.explode(tx.extract_hashtags(F.col("Tweet"))).alias("tag"))


@query(
    "text_filter_flags",
    f"""SELECT row_id, regexp_matches(lower(Tweet), '{tx.URL_FILTER}') AS has_url,
        regexp_matches(lower(Tweet), '{tx.RETWEET_FILTER}') AS is_retweet, contains(Tweet, '@') AS has_mention FROM texts""",
    "posts texts",
)
def text_filter_flags(spark, sf):
    c = F.col("Tweet")
    return texts(spark, sf).select(
        "row_id", tx.has_url(c).alias("has_url"), tx.is_retweet(c).alias("is_retweet"), tx.has_mention(c).alias("has_mention")
    )


@query("filter_tweets", f"SELECT row_id, Tweet FROM texts WHERE {SQL_IS_CLEAN}", "posts texts")
def filter_tweets(spark, sf):
    return rows.filter_tweets(texts(spark, sf)).select("row_id", "Tweet")


LEMMAS_SQL = f"""
WITH vocab AS (SELECT DISTINCT unnest({sql_tokens('lower(Tweet)')}) AS word FROM posts),
lemmas AS (SELECT v.word AS surface, w.word AS lemma FROM vocab v JOIN vocab w ON v.word = concat(w.word, 's')),
tok AS (SELECT row_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos
        FROM (SELECT row_id, {sql_tokens('lower(Tweet)')} AS ws FROM posts)),
got AS (SELECT row_id, string_agg(coalesce(lemma, word), ' ' ORDER BY pos) AS v
        FROM tok LEFT JOIN lemmas ON word = surface GROUP BY row_id)
SELECT p.row_id, coalesce(v, '') AS v FROM posts p LEFT JOIN got USING (row_id)
"""


@query("text_lemmatize", LEMMAS_SQL, "posts")
def text_lemmatize(spark, sf):
    """Lemma table from the data: a word that is another word plus "s"."""
    words = tt.posts(spark, sf).select("row_id", tx.tokenize(F.lower("Tweet")).alias("ws"))
    vocab = words.select(F.explode("ws").alias("word")).distinct()
    lemmas = vocab.withColumn("surface", F.concat("word", F.lit("s"))).join(
        vocab.select(F.col("word").alias("surface")), "surface", "left_semi"
    ).select("surface", F.col("word").alias("lemma"))
    done = pe.lemmatize(words, "row_id", "ws", lemmas)
    return done.select("row_id", F.array_join("words", " ").alias("v"))


@query(
    "time_from_epoch",
    """SELECT row_id, strftime(make_timestamp(Timestamp * 1000), '%Y-%m-%d %H:%M:%S') AS ts,
       CAST(year(make_timestamp(Timestamp * 1000)) AS INT) AS y,
       strftime(make_timestamp(Timestamp * 1000), '%Y-%m-%d') AS d FROM posts""",
    "posts",
)
def time_from_epoch(spark, sf):
    ms = F.col("Timestamp")
    return tt.posts(spark, sf).select(
        "row_id",
        F.date_format(tx.from_epoch_ms(ms), "yyyy-MM-dd HH:mm:ss").alias("ts"),
        tx.epoch_year(ms).alias("y"),
        tx.epoch_date(ms).cast("string").alias("d"),
    )


@query(
    "text_period_context",
    "SELECT row_id, concat('Period: ', PeriodID, '. ', Tweet) AS inference, concat('[Period: ', PeriodID, '] ', Tweet) AS training FROM texts",
    "posts texts",
)
def text_period_context(spark, sf):
    t, p = F.col("Tweet"), F.col("PeriodID")
    return texts(spark, sf).select(
        "row_id",
        tx.with_period_context(t, p, "inference").alias("inference"),
        tx.with_period_context(t, p, "training").alias("training"),
    )


@query(
    "id_make_split",
    """SELECT row_id, concat(MatchID, '_', PeriodID) AS ID, CAST(split_part(ID, '_', 1) AS INT) AS m,
       CAST(split_part(ID, '_', 2) AS INT) AS p FROM posts""",
    "posts",
)
def id_make_split(spark, sf):
    made = tx.make_id(F.col("MatchID"), F.col("PeriodID"))
    return tt.posts(spark, sf).select("row_id", made.alias("ID")).select(
        "row_id", "ID", tx.id_match(F.col("ID")).alias("m"), tx.id_period(F.col("ID")).alias("p")
    )


@query("projection_predictions", "SELECT ID, EventType FROM posts", "posts")
def projection_predictions(spark, sf):
    return rows.prediction_columns(tt.labelled_posts(spark, sf), F.col("ID"), F.col("EventType"))


@query(
    "number_formats",
    """SELECT p_partkey, round(p_retailprice / 7, 2) AS rounded,
       regexp_replace(regexp_replace(printf('%.2f', p_size / 8.0::DOUBLE), '0+$', ''), '\\.$', '') AS fixed,
       replace(printf('%.1e', p_size / 10000.0::DOUBLE), 'e-0', 'e-') AS sci,
       TRY_CAST(p_brand AS DOUBLE) AS no_number, TRY_CAST(CAST(p_size AS VARCHAR) AS DOUBLE) AS number FROM part""",
)
def number_formats(spark, sf):
    return tt.table(spark, sf, "part").select(
        "p_partkey",
        F.round(F.col("p_retailprice") / 7, 2).alias("rounded"),
        tx.fixed_digits(F.col("p_size") / 8, 2).alias("fixed"),
        tx.scientific(F.col("p_size") / 10000).alias("sci"),
        tx.to_number(F.col("p_brand")).alias("no_number"),
        tx.to_number(F.col("p_size").cast("string")).alias("number"),
    )


@query(
    "text_dedup_key",
    f"SELECT row_id, {sql_digest("concat_ws('-', Tweet, PeriodID)", 15)} AS key FROM texts",
    "posts texts",
)
def text_dedup_key(spark, sf):
    return texts(spark, sf).select("row_id", tx.dedup_key(F.col("Tweet"), F.col("PeriodID")).alias("key"))


@query("rows_drop_null", "SELECT doc_id, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.toxic IS NOT NULL")
def rows_drop_null(spark, sf):
    joined = tt.table(spark, sf, "documents").select("doc_id").join(
        tt.table(spark, sf, "labels").select("doc_id", "toxic"), "doc_id", "left"
    )
    return rows.drop_null(joined, ["toxic"])


@query("rows_exclude_matches", "SELECT row_id, MatchID FROM posts WHERE MatchID NOT IN (6, 15)", "posts")
def rows_exclude_matches(spark, sf):
    return rows.exclude_matches(tt.posts(spark, sf), [6, 15]).select("row_id", "MatchID")


@query("rows_only_match", "SELECT row_id, PeriodID FROM posts WHERE MatchID = 9", "posts")
def rows_only_match(spark, sf):
    return rows.only_match(tt.posts(spark, sf), 9).select("row_id", "PeriodID")


@query(
    "rows_only_year",
    "SELECT o_orderkey, epoch_ms(o_orderdate) AS ms FROM orders WHERE year(o_orderdate) = 1997",
)
def rows_only_year(spark, sf):
    orders = tt.table(spark, sf, "orders").select("o_orderkey", F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("ms"))
    return rows.only_year(orders, 1997, "ms")


@query(
    "periods_nonempty",
    """WITH t AS (SELECT ID, count(*) FILTER (WHERE Tweet IS NOT NULL AND trim(Tweet) <> '') AS n FROM posts GROUP BY ID)
    SELECT count(*) FILTER (WHERE n = 0) AS empty_periods, count(*) FILTER (WHERE n > 0) AS nonempty_periods FROM t""",
    "posts",
)
def periods_nonempty(spark, sf):
    return pe.count_empty_periods(tt.posts(spark, sf))


@query(
    "periods_nonempty_lists",
    "SELECT ID, count(*) AS n FROM posts WHERE Tweet IS NOT NULL AND trim(Tweet) <> '' GROUP BY ID",
    "posts",
)
def periods_nonempty_lists(spark, sf):
    kept = pe.nonempty_periods(pe.group_periods(tt.labelled_posts(spark, sf)))
    return kept.groupBy("ID").agg(F.sum(F.size("Tweet")).cast("bigint").alias("n"))


@query("rows_epoch_range", "SELECT run_id, step, epoch FROM runs WHERE epoch <= 20", "runs")
def rows_epoch_range(spark, sf):
    return rows.at_most(tt.run_history(spark, sf), "epoch", 20).select("run_id", "step", "epoch")


@query("rows_sample", f"SELECT row_id, Tweet FROM posts WHERE {sql_digest("concat_ws('-', row_id, 42)")} % 1000000 < 100000", "posts")
def rows_sample(spark, sf):
    return rows.sample(tt.posts(spark, sf), 0.1, seed=42).select("row_id", "Tweet")


@query(
    "rows_at_max",
    "WITH c AS (SELECT ID, count(*) AS n FROM posts GROUP BY ID) SELECT ID, n FROM c WHERE n = (SELECT max(n) FROM c)",
    "posts",
)
def rows_at_max(spark, sf):
    return rows.rows_at_extreme(tt.posts(spark, sf).groupBy("ID").agg(F.count("*").alias("n")), "n")


@query("rows_at_zero", "SELECT doc_id, quality FROM labels WHERE toxic = 0")
def rows_at_zero(spark, sf):
    return rows.rows_at_value(tt.table(spark, sf, "labels"), "toxic", 0).select("doc_id", "quality")


@query(
    "dedup_global",
    "SELECT min(row_id) AS row_id, arg_min(PeriodID, row_id) AS PeriodID, Tweet FROM posts GROUP BY Tweet",
    "posts",
)
def dedup_global(spark, sf):
    return rows.dedup(tt.posts(spark, sf).select("row_id", "PeriodID", "Tweet"), ["Tweet"])


@query(
    "dedup_per_match",
    "SELECT min(row_id) AS row_id, MatchID, arg_min(PeriodID, row_id) AS PeriodID, Tweet FROM posts GROUP BY Tweet, MatchID",
    "posts",
)
def dedup_per_match(spark, sf):
    return rows.dedup(tt.posts(spark, sf).select("row_id", "MatchID", "PeriodID", "Tweet"), ["Tweet"], scope=["MatchID"])


@query(
    "dedup_text_period",
    "SELECT min(row_id) AS row_id, arg_min(ID, row_id) AS ID, PeriodID, Tweet FROM posts GROUP BY Tweet, PeriodID",
    "posts",
)
def dedup_text_period(spark, sf):
    return rows.dedup(tt.posts(spark, sf).select("row_id", "ID", "PeriodID", "Tweet"), ["Tweet", "PeriodID"])


@query(
    "union_all",
    "SELECT doc_id AS id, text FROM documents UNION ALL SELECT item_id, text FROM benchmark UNION ALL SELECT conv_id, text FROM conversations",
)
def union_all(spark, sf):
    return rows.union_all(
        [
            tt.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text"),
            tt.table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), "text"),
            tt.table(spark, sf, "conversations").select(F.col("conv_id").alias("id"), "text"),
        ]
    )


@query(
    "union_distinct",
    """WITH u AS (SELECT doc_id AS id, text FROM documents UNION ALL SELECT 1000000000 + item_id, text FROM benchmark)
    SELECT min(id) AS id, text FROM u GROUP BY text""",
)
def union_distinct(spark, sf):
    docs = tt.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    bench = tt.table(spark, sf, "benchmark").select((1000000000 + F.col("item_id")).alias("id"), "text")
    return rows.union_distinct([docs, bench], ["text"], "id")


@query(
    "common_keys",
    "SELECT doc_id FROM documents WHERE text IS NOT NULL INTERSECT SELECT doc_id FROM labels WHERE toxic = 1",
)
def common_keys(spark, sf):
    docs = tt.table(spark, sf, "documents").where(F.col("text").isNotNull())
    return rows.common_keys(docs, tt.table(spark, sf, "labels").where("toxic = 1"), ["doc_id"])


@query("order_by_period", "SELECT DISTINCT MatchID, PeriodID, EventType FROM lab ORDER BY MatchID, PeriodID", "posts")
def order_by_period(spark, sf):
    return rows.order_by_period(tt.period_labels(spark, sf))


@query("order_by_id", "SELECT DISTINCT ID, EventType FROM posts ORDER BY ID", "posts")
def order_by_id(spark, sf):
    labels = tt.period_labels(spark, sf).select(tx.make_id(F.col("MatchID"), F.col("PeriodID")).alias("ID"), "EventType")
    return rows.order_by_id(labels)


@query("head_rows", "SELECT row_id, Tweet FROM posts ORDER BY Timestamp, row_id LIMIT 25", "posts")
def head_rows(spark, sf):
    return rows.head(tt.posts(spark, sf), 25, ["Timestamp", "row_id"]).select("row_id", "Tweet")


@query(
    "columns_side_by_side",
    f"SELECT p.row_id, p.Tweet, length(p.Tweet) AS n_chars, len({sql_tokens('Tweet')}) AS n_words FROM posts p",
    "posts",
)
def columns_side_by_side(spark, sf):
    posts = tt.posts(spark, sf)
    sizes = posts.select(
        "row_id",
        F.char_length("Tweet").cast("bigint").alias("n_chars"),
        F.size(tx.tokenize(F.col("Tweet"))).cast("bigint").alias("n_words"),
    )
    return ft.columns_side_by_side(posts.select("row_id", "Tweet"), sizes)
